"""Document quality from weak labels.

Overlapping heuristic labellers each vote bad, good or nothing on every
document.  Their votes make patterns, of which there are at most 3**labellers; the
counts of the patterns over all documents are all that expectation-maximisation
needs.  It knows good documents and, as kinds of bad text seldom occur together, a kind of bad for each
labeller, and estimates from the counts alone how many documents each has and how often each labeller votes bad on
it: its accuracy on each kind and its rate of false alarms.  The
posterior of a document's pattern is its training label.

A linear scorer over hashed features (words and word shapes) is fitted by
logistic regression to the posteriors of at most SAMPLE documents, those of least hash
(a bound on the fit alone), and scores every whole text.  Both fits run in one task of an executor, as what they read is bounded.

Toxicity has a second linear scorer, over how often a document has each word and each word's beginning of
TOXIC_STEMS bytes (hashed, ASCII marks at both ends stripped; inflected forms share a beginning), fitted to the toxic labels of at most TOXIC_SAMPLE labelled documents of any language,
those of least hash; what fewer than TOXIC_DOCS of these have has no weight.  Documents that it
finds toxic, or with TOXIC_HITS or more different words of TOXIC (all there is where no labels are given), are marked
toxic.  keep is true for documents that the scorer finds good and that are not toxic.

A null or wordless text has no votes and no features; it scores as bad.
Repeated rows are scored each; other columns pass through keep_good() untouched.  Where there are too few documents to
fit (fewer than MIN_FIT), a document with a bad vote scores as bad.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BYTE_BASE, U, blocks, mix, prefix, released, spans, words

SAMPLE, MIN_FIT, BUCKETS, TOXIC_HITS = 6000, 50, 1 << 12, 2
TOXIC_SAMPLE, TOXIC_BITS, TOXIC_DOCS, TOXIC_STEMS = 6000, 18, 8, (6, 7, 8)
#: Common insults.
TOXIC = ["clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless"]
#: Frequent function words of English, German, French and Spanish.
STOPWORDS = sorted({"the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "with", "der", "die", "das", "und", "in", "zu", "nicht", "den", "von", "le", "la", "les", "de", "des", "et", "un", "une", "en", "que", "pour", "el", "los", "del", "y", "una", "se", "por", "con", "para"})

#: Each kind of bad text is seen by two or more: what one labeller alone sees could as well be its false alarms.
LABELLERS = ["symbols", "clusters", "capitals", "shouting", "bars", "wordless", "stutter", "variety", "stopwords", "word_length"]

CLASS = np.zeros(256, np.uint8)  # 1 symbol, 2 capital, 3 small letter, 4 exclamation mark, 5 bar, 6 digit, 7 stop, 8 byte beyond ASCII
for _chars, _k in (("#$%&*<>=~^\\{}[]@", 1), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), ("abcdefghijklmnopqrstuvwxyz", 3), ("!", 4), ("|", 5), ("0123456789", 6), (".,;:?", 7)):
    CLASS[[ord(c) for c in _chars]] = _k
CLASS[128:] = 8
MARK = np.zeros(256, bool)
MARK[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True
FOLD = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def _hash_of(strings: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(strings).encode(), np.uint8)
    end = np.cumsum([len(s.encode()) for s in strings])
    return spans(prefix(data.astype(U) + U(1), BYTE_BASE), np.r_[0, end[:-1]], end, BYTE_BASE)


_STOP, _TOXIC = np.sort(_hash_of(STOPWORDS)), np.sort(_hash_of(TOXIC))


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, values), known.size - 1)] == values


def _sums(mask: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, weights=mask, minlength=n)


def analyse(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """Votes (1 bad, -1 good, 0 none) of each labeller, distinct toxic words, and hashed features of a block's documents."""
    n = bounds.size - 1
    start, end, doc = words(data, bounds)
    count = np.maximum(1, np.bincount(doc, minlength=n))
    kinds = np.zeros((10, start.size), np.int32)
    if start.size:
        cls = CLASS[data]
        for k in range(1, 9):
            total = np.r_[0, np.cumsum(cls == k)]
            kinds[k] = total[end] - total[start]
    # letters only, folded, for word lists: trailing and leading marks do not count
    core_end = end.copy()
    for _ in range(3):
        core_end -= (core_end > start) & np.isin(CLASS[data[np.maximum(core_end - 1, 0)]] if data.size else np.zeros(0), (1, 4, 5, 7))
    folded = FOLD[data]
    core = bare = np.zeros(0, U)
    stems, stem_doc = np.zeros(0, U), np.zeros(0, np.int64)
    if start.size:
        sums = prefix(folded.astype(U) + U(1), BYTE_BASE)
        core = spans(sums, start, core_end, BYTE_BASE)
        # for toxic words, no marks at either end
        place = np.arange(data.size)
        before = np.maximum.accumulate(np.where(MARK[data], -1, place))
        after = np.minimum.accumulate(np.where(MARK[data], data.size, place)[::-1])[::-1]
        bare_end = np.maximum(before[end - 1] + 1, start)
        bare_start = np.minimum(after[start], bare_end)
        bare = spans(sums, bare_start, bare_end, BYTE_BASE)
        long = [np.flatnonzero(bare_end - bare_start >= k) for k in TOXIC_STEMS]
        stems = np.concatenate([bare, *[mix(spans(sums, bare_start[x], bare_start[x] + k, BYTE_BASE), k) for k, x in zip(TOXIC_STEMS, long)]])
        stem_doc = np.concatenate([doc, *[doc[x] for x in long]])
    size = end - start
    same = np.r_[False, (core[1:] == core[:-1]) & (doc[1:] == doc[:-1])][: core.size]
    letters = kinds[2] + kinds[3]
    chars = np.maximum(1, _sums(size, doc, n))
    key = np.lexsort((core, doc))
    fresh = np.r_[True, (core[key][1:] != core[key][:-1]) | (doc[key][1:] != doc[key][:-1])][: core.size]
    distinct = np.bincount(doc[key][fresh], minlength=n)
    few = count < 20

    def vote(x, bad, good, silent=None):
        v = np.where(x >= bad, 1, np.where(x <= good, -1, 0))
        return np.where(silent, 0, v) if silent is not None else v

    symbols = _sums(kinds[1], doc, n) / chars
    capitals = _sums(kinds[2], doc, n) / np.maximum(1, _sums(letters, doc, n))
    mean = chars / count
    votes = np.stack(
        [
            vote(symbols, 0.05, 0.01),
            vote(_sums(kinds[1] >= 2, doc, n) / count, 0.1, 0.02),
            vote(capitals, 0.4, 0.15),
            vote(_sums(kinds[4] > 0, doc, n) / count, 0.2, 0.02),
            vote(_sums(kinds[5] > 0, doc, n) / count, 0.15, 0.01),
            vote(_sums(letters + kinds[8] == 0, doc, n) / count, 0.2, 0.05),
            vote(_sums(same, doc, n) / count, 0.25, 0.05),
            vote(-distinct / np.sqrt(count), -1.2, -2.5, few),
            vote(-_sums(_among(core, _STOP), doc, n) / count, 0.0, -0.05, few),
            vote(np.abs(np.log(mean / 5.5)), 1.0, 0.5),
        ]
    ).astype(np.int8)
    votes[:, bounds[1:] == bounds[:-1]] = 0
    votes[:, np.bincount(doc, minlength=n) == 0] = 0
    toxic_at = np.flatnonzero(_among(bare, _TOXIC))
    toxic = np.zeros(n, np.int64)
    if toxic_at.size:
        pairs = np.unique(np.stack([doc[toxic_at].astype(np.int64), np.searchsorted(_TOXIC, bare[toxic_at])]), axis=1)
        toxic = np.bincount(pairs[0], minlength=n)
    shape = (
        (np.minimum(kinds[1], 3)) * 256 + (np.minimum(kinds[4], 2)) * 64 + (np.minimum(kinds[5], 1)) * 32 + same * 16 + ((kinds[2] > 1) & (kinds[3] == 0)) * 8 + (kinds[6] > 0) * 4 + _among(core, _STOP) * 2 + (size > 14)
    )
    half = BUCKETS // 2
    features = np.stack([(core >> U(53)).astype(np.int64) % half, half + (shape * 2654435761 % (1 << 32) >> 7) % half])
    return {"votes": votes, "toxic": toxic, "features": features, "stems": (stems >> U(64 - TOXIC_BITS)).astype(np.int64), "stem_doc": stem_doc.astype(np.int64), "doc": doc, "count": count}


def pattern_of(votes: np.ndarray) -> np.ndarray:
    """A base-3 number for each document's votes."""
    return ((votes + 1).astype(np.int64) * (3 ** np.arange(votes.shape[0]))[:, None]).sum(axis=0)


def votes_of(pattern: np.ndarray, n: int = len(LABELLERS)) -> np.ndarray:
    return (pattern[None, :] // (3 ** np.arange(n))[:, None]) % 3 - 1


def estimate(patterns: dict[int, int], labellers: int = len(LABELLERS), rounds: int = 300) -> tuple[dict[int, float], float, np.ndarray]:
    """EM over pattern counts -> posterior of "bad" by pattern, its prior, and P(bad vote | a vote) by labeller on good and on bad text.

    Classes are good text and one kind of bad for each labeller, begun from the documents that it calls bad; silence says
    nothing.  No accuracy is given beforehand: counts of one in each cell keep rates off zero.
    """
    keys = np.array(sorted(patterns), np.int64)
    if not keys.size:
        return {}, 0.5, np.zeros((labellers, 2))
    weight = np.array([patterns[k] for k in keys.tolist()], float)
    votes = votes_of(keys, labellers)
    hit = (votes > 0).astype(float)
    cast = [(votes < 0).astype(float), hit]
    share = np.vstack([np.where(hit.any(0), 0.1, 0.99), np.where(hit.any(0), 0.9 * hit / np.maximum(1, hit.sum(0)), 0.01 / labellers)])
    share /= share.sum(0)
    prior, table = np.full(labellers + 1, 1 / (labellers + 1)), np.full((2, labellers + 1, labellers), 0.5)
    for _ in range(rounds if weight.sum() >= MIN_FIT else 0):
        prior = (share * weight).sum(1) + np.r_[1.0, np.full(labellers, 1 / labellers)]
        prior /= prior.sum()
        table = np.stack([(share * weight) @ x.T for x in cast]) + 1
        table /= table.sum(0)
        log = np.log(prior)[:, None] + np.log(table[0]) @ cast[0] + np.log(table[1]) @ cast[1]
        new = np.exp(log - log.max(0))
        new /= new.sum(0)
        done = np.abs(new - share).max() < 1e-7
        share = new
        if done:
            break
    bad = 1 - share[0]
    bad[(votes == 0).all(0)] = 1.0  # no words at all
    rates = np.stack([table[1, 0], prior[1:] @ table[1, 1:] / prior[1:].sum()], 1)
    return dict(zip(keys.tolist(), bad.tolist())), float(1 - prior[0]), rates


def _features(row: np.ndarray, features: np.ndarray, count: int) -> np.ndarray:
    out = np.zeros(BUCKETS, np.float32)
    for half in features[:, row]:
        out += np.bincount(half, minlength=BUCKETS).astype(np.float32)
    return np.sqrt(out / max(1, count))


def fit_scorer(x: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.5, l2: float = 1e-5) -> np.ndarray:
    """Weights (the last is the bias) of a logistic regression on soft labels, by Adam over all rows."""
    w, m, v = (np.zeros(x.shape[1] + 1) for _ in range(3))
    weight = np.where(y > 0.5, 0.5 / max(1e-9, (y > 0.5).mean()), 0.5 / max(1e-9, (y <= 0.5).mean()))
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1].astype(np.float32) + w[-1], -30, 30)))
        e = (p - y) * weight / y.size
        g = np.r_[x.T @ e.astype(np.float32) + l2 * w[:-1], e.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


Part = tuple[int, np.ndarray, np.ndarray, np.ndarray]  # documents; document, bucket and log count of each of their words


def fit_toxicity(parts: list[Part], toxic: np.ndarray, steps: int = 300, rate: float = 0.1, l2: float = 1e-3) -> np.ndarray | None:
    """Weights by bucket (the last is the bias) of a logistic regression on parts of a few hundred documents each, by Adam."""
    if toxic.size < MIN_FIT or not 0 < toxic.sum() < toxic.size:
        return None
    size = 1 << TOXIC_BITS
    held = sum((np.bincount(x, minlength=size) for _, _, x, _ in parts), np.zeros(size, np.int64))
    common = np.flatnonzero(held >= TOXIC_DOCS)
    at = np.full(size, -1, np.int32)
    at[common] = np.arange(common.size)
    parts = [(n, row[at[x] >= 0], at[x][at[x] >= 0], v[at[x] >= 0]) for n, row, x, v in parts]
    first = np.cumsum([0, *(n for n, _, _, _ in parts)]).tolist()
    w, m, v = (np.zeros(common.size + 1) for _ in range(3))
    weight = np.where(toxic > 0, 0.5 / toxic.mean(), 0.5 / (1 - toxic.mean()))  # both classes count alike
    for t in range(1, steps + 1):
        g = np.r_[l2 * w[:-1], 0.0]
        for i, (n, row, col, value) in zip(first, parts):
            z = np.bincount(row, weights=w[col] * value, minlength=n) + w[-1]
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic[i : i + n]) * weight[i : i + n] / toxic.size
            g[:-1] += np.bincount(col, weights=e[row] * value, minlength=common.size)
            g[-1] += e.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    out = np.zeros(size + 1, np.float32)
    out[common], out[-1] = w[:-1], w[-1]
    return out


def _word_sets(a: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, bucket and log count of each document's different words and beginnings."""
    both, times = np.unique(a["stem_doc"] << TOXIC_BITS | a["stems"], return_counts=True)
    return both >> TOXIC_BITS, both & ((1 << TOXIC_BITS) - 1), np.log1p(times).astype(np.float32)


def _toxicity(texts: DataFrame, labels: DataFrame) -> np.ndarray | None:
    """The toxicity scorer's weights from labels(doc_id, toxic)."""
    known = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").alias("d"), F.col("toxic").cast("int"))
    known = known.orderBy(F.xxhash64("d", F.lit(11)), "toxic").limit(TOXIC_SAMPLE)
    drawn = texts.join(F.broadcast(known), texts["doc_id"] == F.col("d")).select("text", "toxic")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, bounds in blocks(batch):
                row, word, value = _word_sets(analyse(data, bounds))
                cut = np.searchsorted(row, np.arange(j - i + 1))
                x = [word[cut[r] : cut[r + 1]].astype(np.int32).tobytes() for r in range(j - i)]
                v = [value[cut[r] : cut[r + 1]].astype(np.float16).tobytes() for r in range(j - i)]
                yield pa.RecordBatch.from_arrays([batch.column("toxic")[i:j].cast(pa.int32()), pa.array(x, pa.binary()), pa.array(v, pa.binary())], ["toxic", "x", "v"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, parts = [], []
        for batch in batches:  # flat arrays of a few hundred documents each
            for i in range(0, batch.num_rows, 256):
                own = batch.slice(i, 256)
                words_, values = own.column(1).to_pylist(), own.column(2).to_pylist()
                row = np.repeat(np.arange(own.num_rows, dtype=np.int16), [len(x) // 4 for x in words_])
                parts.append((own.num_rows, row, np.frombuffer(b"".join(words_), np.int32), np.frombuffer(b"".join(values), np.float16)))
                toxic += own.column(0).to_pylist()
        w = fit_toxicity(parts, np.array(toxic, float))
        if w is not None:
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], ["w"])

    rows = drawn.mapInArrow(lambda b: released(sets(b)), "toxic int, x binary, v binary").repartition(1).sortWithinPartitions("toxic", "x", "v")
    return _weights(rows.mapInArrow(lambda b: released(fit(b)), "w binary"))


def _weights(fitted: DataFrame) -> np.ndarray | None:
    got = fitted.collect()
    return np.frombuffer(got[0].w, np.float32) if got else None


class Judge:
    """Posteriors by pattern and the weights of both scorers, to score blocks of texts with."""

    def __init__(self, posterior: dict[int, float], weights: np.ndarray | None, toxicity: np.ndarray | None):
        self.posterior, self.weights, self.toxicity = posterior, weights, toxicity

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """Posterior, score, toxic words, toxic score and keep of each text."""
        a, n = analyse(data, bounds), bounds.size - 1
        p = np.array([self.posterior[k] for k in pattern_of(a["votes"]).tolist()], float)
        good = 1 - p
        if (w := self.weights) is not None:
            cut = np.searchsorted(a["doc"], np.arange(n + 1))
            z = np.array([_features(np.arange(cut[r], cut[r + 1]), a["features"], int(a["count"][r])) @ w[:-1] + w[-1] if cut[r + 1] > cut[r] else 30.0 for r in range(n)])
            good = 1 / (1 + np.exp(np.clip(z, -30, 30)))
        toxic = np.zeros(n)
        if (w := self.toxicity) is not None:
            row, word, value = _word_sets(a)
            toxic = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=w[word] * value, minlength=n) + w[-1], -30, 30)))
        return p, good, a["toxic"], toxic, (good > 0.5) & (a["toxic"] < TOXIC_HITS) & (toxic < 0.5)


def fit(docs: DataFrame, sample: int = SAMPLE, labels: DataFrame | None = None) -> Judge:
    """A judge for docs(doc_id, text, ...): votes counted over all documents, scorers fitted to bounded samples."""
    texts = docs.select("doc_id", "text")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, bounds in blocks(batch):
                keys, n = np.unique(pattern_of(analyse(data, bounds)["votes"]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["pattern", "n"])

    counted = texts.mapInArrow(lambda b: released(label(b)), "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    counts = {r[0]: r[1] for r in counted.collect()}  # at most 3 ** labellers
    posterior, _, _ = estimate(counts)
    n = sum(counts.values())
    share = min(1.0, 1.25 * sample / max(1, n))
    drawn = texts.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else texts
    drawn = drawn.where("text is not null").orderBy(F.xxhash64("doc_id", F.lit(7)), F.xxhash64("text")).limit(sample)

    def scorer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All rows of the sample come to one task."""
        x, y = np.zeros((sample, BUCKETS), np.float32), []
        for batch in batches:
            for i, j, data, bounds in blocks(batch):
                a = analyse(data, bounds)
                cut = np.searchsorted(a["doc"], np.arange(j - i + 1))
                for r in range(j - i):
                    x[len(y) + r] = _features(np.arange(cut[r], cut[r + 1]), a["features"], int(a["count"][r]))
                y += [posterior[k] for k in pattern_of(a["votes"]).tolist()]
        y = np.array(y)
        if y.size >= MIN_FIT and 0 < (y > 0.5).sum() < y.size:
            yield pa.RecordBatch.from_arrays([pa.array([fit_scorer(x[: y.size], y).astype(np.float32).tobytes()], pa.binary())], ["w"])

    weights = _weights(drawn.mapInArrow(lambda b: released(scorer(b)), "w binary")) if n >= MIN_FIT else None
    return Judge(posterior, weights, _toxicity(texts, labels) if labels is not None else None)


def score_quality(docs: DataFrame, sample: int = SAMPLE, labels: DataFrame | None = None) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, posterior, score, toxic_words, toxic_score, keep); score is the probability of good,
    toxic_score that of toxic by the scorer fitted to labels(doc_id, toxic), null without one."""
    judge = fit(docs, sample, labels)
    known = judge.toxicity is not None
    shared = docs.sparkSession.sparkContext.broadcast(judge)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, bounds in blocks(batch):
                p, good, words_, toxic, keep = shared.value(data, bounds)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[i:j].cast(pa.int64()), pa.array(p), pa.array(good, pa.float64()), pa.array(words_, pa.int32()), pa.array(toxic) if known else pa.nulls(j - i, pa.float64()), pa.array(keep)],
                    ["doc_id", "posterior", "score", "toxic_words", "toxic_score", "keep"],
                )

    return docs.select("doc_id", "text").mapInArrow(lambda b: released(score(b)), "doc_id long, posterior double, score double, toxic_words int, toxic_score double, keep boolean")


def keep_good(docs: DataFrame, sample: int = SAMPLE, labels: DataFrame | None = None) -> DataFrame:
    """The documents that are kept, with all their columns; each row is judged by its own text."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, sample, labels))

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for i, j, data, bounds in blocks(batch):
                keep[i:j] = shared.value(data, bounds)[4]
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(lambda b: released(good(b)), docs.schema)
