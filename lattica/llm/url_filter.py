"""URL filtering by gradient-boosted trees on lexical features, with DataFrame functions only.

Features of a URL: lengths of url, host and path, path depth, host labels,
digit ratio, character entropy of the host, longest host label, vowel ratio, query parameters, hyphens, and
the smoothed share of unwanted training URLs among those with its last two host labels (suffix statistics; a training
URL takes the share among the other hosts' folds, so that it does not see its own label).

Trees are grown level by level on histograms: each feature is cut at
quantiles of the training rows, one aggregation a level gives the gradient and
Hessian sums of every (node, feature, bin), and the best split of each node comes out of
that bounded table.  The fitted ensemble is one SQL expression, so
scoring is a projection over all rows.

Labels come from a labelled table, or else from a word list: a host that holds an UNWANTED word is unwanted, any other
is wanted.  The words are labels alone and no feature, and the rules are policy and no labels; the trees judge hosts by their
looks.  Training rows are at most SAMPLE of the labelled URLs, those of least hash;
that bound is for the fit alone.  With no labelled URL, or one class only, the
model is that class's prior (allow when there is none).  A null url has empty host and path, fits no rule, and
is scored like the empty url.  Repeated rows, and null or repeated page_ids, give a result for each row; other columns are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

SAMPLE, TREES, DEPTH, BINS, RATE, SMOOTH, L2 = 20000, 10, 3, 16, 0.3, 20.0, 1.0

#: Words that label a host as unwanted when no labels are given.
UNWANTED = ["adult", "ads", "bet", "casino", "cheap", "escort", "loan", "pills", "porn", "sex", "spam", "track", "viagra", "warez", "xxx"]

FEATURES = ["url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "longest_label", "vowel_ratio", "params", "hyphens", "suffix_rate"]
FOLDS = 4


@dataclass(frozen=True)
class Rule:
    """`pattern` is host[/path prefix]; it fits the host and all its subdomains."""

    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without `://`."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_match(rules: list[Rule]) -> Column:
    """The longest rule that fits, as struct(pattern, verdict); null if none."""
    out = F.lit(None).cast("struct<pattern:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.pattern), r.pattern)):
        fits = (F.col("host") == r.host) | F.endswith("host", F.lit("." + r.host))
        fits = fits & F.startswith("path", F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.pattern).alias("pattern"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def lexical(urls: DataFrame) -> DataFrame:
    """urls(url, host, path, ...) with the lexical features but for suffix_rate, and the suffix."""
    url = F.coalesce("url", F.lit(""))
    count = lambda s, chars: F.length(s) - F.length(F.translate(s, chars, ""))
    letters = "abcdefghijklmnopqrstuvwxyz0123456789-."
    size = F.greatest(F.length("host"), F.lit(1)).cast("double")
    entropy = -sum((F.when((n := count(F.col("host"), c)) > 0, n / size * F.log2(n / size)).otherwise(0.0) for c in letters), F.lit(0.0))
    return urls.withColumns(
        {
            "url_length": F.length(url).cast("double"),
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "depth": count(F.col("path"), "/").cast("double"),
            "labels": count(F.col("host"), ".").cast("double"),
            "digit_ratio": count(url, "0123456789") / F.greatest(F.length(url), F.lit(1)),
            "entropy": entropy,
            "params": F.when(F.instr(url, "?") > 0, count(url, "&") + 1).otherwise(0).cast("double"),
            "hyphens": count(F.col("host"), "-").cast("double"),
            "longest_label": F.array_max(F.transform(F.split("host", r"\."), lambda x: F.length(x))).cast("double"),
            "vowel_ratio": count(F.col("host"), "aeiou") / size,
            "suffix": F.substring_index("host", ".", -2),
        }
    )


@dataclass
class Ensemble:
    """Boosted trees: a node is (feature, threshold, left, right) or a leaf value."""

    prior: float
    suffixes: dict[str, float]
    suffix_prior: float
    trees: list = field(default_factory=list)

    def expression(self) -> str:
        def sql(node) -> str:
            if not isinstance(node, tuple):
                return f"{float(node)!r}D"
            f, t, a, b = node
            return f"IF({f} <= {float(t)!r}D, {sql(a)}, {sql(b)})"

        return " + ".join([f"{self.prior!r}D", *map(sql, self.trees)])

    def with_suffix(self, rows: DataFrame) -> DataFrame:
        """The suffix table has at most `suffix_limit` entries; others take the overall rate."""
        return rows.withColumn("suffix_rate", _looked_up(self.suffixes, F.col("suffix"), self.suffix_prior))

    def score(self, rows: DataFrame, name: str = "score") -> DataFrame:
        """rows from lexical() with the probability of being unwanted."""
        return self.with_suffix(rows).withColumn(name, 1 / (1 + F.exp(-F.expr(self.expression()))))


def _looked_up(table: dict[str, float], key: Column, default: float) -> Column:
    if not table:
        return F.lit(default)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv]), key), F.lit(default))


def fit(labelled: DataFrame, sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH, suffix_limit: int = 256) -> Ensemble:
    """labelled(url, host, path, label: 1 unwanted, 0 wanted) -> trees."""
    work = Workspace(labelled.sparkSession)
    rows = lexical(labelled.where("label is not null").select("url", "host", "path", F.col("label").cast("double").alias("label")))
    rows = work.store(rows.orderBy(F.xxhash64("url", "label")).limit(sample).coalesce(1), "train")
    n, bad = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    rate = (bad + 1) / (n + 2)
    import math

    fold = F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int")
    known = rows.groupBy("suffix").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "suffix").limit(suffix_limit).select("suffix")
    stats = rows.join(F.broadcast(known), "suffix").groupBy("suffix", fold.alias("fold")).agg(F.count("*").alias("n"), F.sum("label").alias("bad")).collect()
    smooth = lambda own: float((sum(r.bad for r in own) + SMOOTH * rate) / (sum(r.n for r in own) + SMOOTH))
    by: dict[str, list] = {}
    for r in stats:
        by.setdefault(r.suffix, []).append(r)
    suffixes = {x: smooth(own) for x, own in by.items()}
    without = {f"{k} {x}": smooth([r for r in own if r.fold != k]) for x, own in by.items() for k in range(FOLDS)}
    model = Ensemble(math.log(rate / (1 - rate)), suffixes, rate)
    if not n or not 0 < bad < n:
        model.prior = math.log(rate / (1 - rate)) if n else -1.0
        return model
    rows = rows.withColumn("suffix_rate", _looked_up(without, F.concat_ws(" ", fold.cast("string"), "suffix"), rate))
    cuts_row = rows.select(*[F.percentile_approx(f, [i / BINS for i in range(1, BINS)], 1000) for f in FEATURES]).first()
    cuts = {f: sorted(set(map(float, v))) for f, v in zip(FEATURES, cuts_row)}
    bins = [F.struct(F.lit(k).alias("f"), sum(((F.col(f) > c).cast("int") for c in cuts[f]), F.lit(0)).alias("b")) for k, f in enumerate(FEATURES)]
    rows = work.store(rows.select(*FEATURES, "label", F.array(*bins).alias("bins")), "binned")
    for _ in range(trees):
        p = 1 / (1 + F.exp(-F.expr(model.expression())))
        state = rows.withColumn("g", p - F.col("label")).withColumn("h", p * (1 - p))
        splits: dict[int, tuple[str, float]] = {}
        leaves: dict[int, float] = {}
        active = {1}
        for level in range(depth + 1):
            node = F.lit(1)
            for k, (f, t) in sorted(splits.items()):
                node = F.when(node == k, F.when(F.col(f) <= t, F.lit(2 * k)).otherwise(F.lit(2 * k + 1))).otherwise(node)
            here = state.withColumn("node", node).where(F.col("node").isin(sorted(active)))
            if level == depth:
                got = here.groupBy("node").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
                leaves |= {r.node: -RATE * r.g / (r.h + L2) for r in got}
                break
            hist = here.select("node", "g", "h", F.explode("bins").alias("x")).groupBy("node", "x.f", "x.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            table: dict[int, dict[int, dict[int, tuple[float, float]]]] = {}
            for r in hist:
                table.setdefault(r.node, {}).setdefault(r.f, {})[r.b] = (r.g, r.h)
            children = set()
            for k in sorted(active):
                own = table.get(k, {})
                if not own:
                    leaves[k] = 0.0
                    continue
                G, H = (sum(v[i] for v in own[0].values()) for i in (0, 1))
                best = (1e-6, None)
                for f in sorted(own):
                    g = h = 0.0
                    for b, t in enumerate(cuts[FEATURES[f]]):
                        g, h = g + own[f].get(b, (0, 0))[0], h + own[f].get(b, (0, 0))[1]
                        if h < 1e-3 or H - h < 1e-3:
                            continue
                        gain = g * g / (h + L2) + (G - g) ** 2 / (H - h + L2) - G * G / (H + L2)
                        if gain > best[0]:
                            best = (gain, (FEATURES[f], t))
                if best[1]:
                    splits[k] = best[1]
                    children |= {2 * k, 2 * k + 1}
                else:
                    leaves[k] = -RATE * G / (H + L2)
            active = children
            if not active:
                break

        def build(k: int):
            if k in splits:
                f, t = splits[k]
                return (f, t, build(2 * k), build(2 * k + 1))
            return leaves.get(k, 0.0)

        model.trees.append(build(1))
    return model


def word_labels(urls: DataFrame) -> DataFrame:
    """urls(url, host, path, ...) with `label`: 1 for a host with an UNWANTED word, else 0; none where there is no host."""
    unwanted = F.lit(False)
    for w in UNWANTED:
        unwanted = unwanted | F.contains("host", F.lit(w))
    return urls.withColumn("label", F.when(F.col("host") != "", unwanted.cast("double")))


def filter_urls(pages: DataFrame, rules: list[Rule], labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """pages(page_id, url, ...) -> (page_id, host, path, rule, verdict, score): the rule's verdict, or else the trees' own.

    labelled(url, label: 1 unwanted, 0 wanted) trains the trees; without it the labels are word_labels() of the pages.
    """
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path).withColumn("_rule", rule_match(rules))
    known = word_labels(rows) if labelled is None else labelled.select("url", "label").withColumn("host", host).withColumn("path", path)
    model = fit(known)
    scored = model.score(lexical(rows))
    own = F.when(F.col("score") > threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", F.col("_rule.pattern").alias("rule"), F.coalesce(F.col("_rule.verdict"), own).alias("verdict"), "score")
