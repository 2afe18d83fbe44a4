"""Best-fit packing of tokenised documents into training sequences.

A document's tokens (its ids, then END) are cut into pieces of CAPACITY only
if there are more; the first piece takes the remainder.  Full pieces are
sequences of their own.  What is left is bin packing over at most CAPACITY - 1
different lengths, so it is solved on the histogram of lengths, whose
size does not grow with the corpus: bin completion around the largest
length left.  Its undominated fillings are enumerated, least waste first and largest lengths first: those in
which no length left over could take the place of some of the filling's, or of its waste.  The search is depth first, each step
packs a filling as often as the counts and the waste that a better packing may
have allow, a branch beyond that waste is cut, and best-fit decreasing is the first
incumbent.  It ends at the lower bound (tokens / capacity), or when it has been through, or after NODES steps;
TESTS fillings of a step are tested for dominance.  These two limits bound the driver's time, not what is packed: the incumbent is always whole
(plan_packing() says which it was).

Pieces then take their places by
their rank within their length, found by counting in groups of about GROUP pieces, so that
a length which many documents share is no single task's work.

Nulls count as empty texts (one token, END).  A null doc_id is packed like any
other; repeated rows are packed as often as they occur.  Extra columns are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import BLOCK_BYTES, released, text_bytes
from .workspace import Workspace

CAPACITY, END, GROUP, NODES, TESTS = 2048, 0, 200_000, 6000, 64
#: A worker's words, and what each of them takes besides its own characters.
CACHE_BYTES, WORD_BYTES = 128 << 20, 220


class _Words(dict):
    """Word -> code, given at first sight; a code's ids are a stretch of one array, which grows by doubling."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []
        self.size, self.used = 0, 0  # bytes in all, ids in use
        self.ids = np.zeros(1 << 12, "<u4")
        self.start, self.length = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int32)

    def __missing__(self, word: str) -> int:
        code = self[word] = len(self)
        self.fresh.append(word)
        return code

    def put(self, words: list[str], ids: list[np.ndarray], length: np.ndarray) -> None:
        """The ids of fresh words, one after another."""
        new = np.concatenate(ids) if ids else np.zeros(0, "<u4")
        while self.used + new.size > self.ids.size:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self) > self.start.size:
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        codes = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        self.start[codes] = self.used + np.cumsum(length) - length
        self.length[codes] = length
        self.ids[self.used : self.used + new.size] = new
        self.used += new.size
        self.size += sum(map(len, words)) + WORD_BYTES * len(words) + 8 * new.size
        self.fresh = []

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the codes, one after another, and how many each has."""
        length = self.length[codes].astype(np.int64)
        ends = np.cumsum(length)
        at = np.repeat(self.start[codes] - ends + length, length)
        at += np.arange(at.size)
        return self.ids[at], length


class _Cache:
    """A Python worker's tokenizer and words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocabulary = self.tok.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[k for word, k in vocabulary.items() if word.startswith("\u0120")]] = True  # tokens that begin with a space
        self.words = _Words()

    def encode(self, strings: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tok.encode_batch_fast(strings, add_special_tokens=False)]

    def _spaced(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Each " word", all in one string, cut again where a token begins with a space."""
        ids = self.encode([" " + " ".join(words)])[0]
        at = np.flatnonzero(self.spaced[ids])
        if at.size == len(words) and not at[0]:
            return [ids], [np.diff(at, append=ids.size)]
        alone = self.encode([" " + x for x in words])
        return alone, [np.array([x.size for x in alone], np.int64)]

    def learn(self) -> None:
        """Ids of the words that were seen for the first time."""
        later, single = [], []
        for x in self.words.fresh:
            (single if x[-1:] in ("", " ") or x[0].isspace() else later).append(x)
        ids = self.encode([x[:-1] if x.endswith(" ") else " " + x for x in single])
        length = [np.array([x.size for x in ids], np.int64)]
        for i in range(0, len(later), 512):
            some, sizes = self._spaced(later[i : i + 512])
            ids += some
            length += sizes
        self.words.put([*single, *later], ids, np.concatenate(length))


_caches: dict[str, _Cache] = {}  # kept from task to task


def token_bytes(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text as little-endian 32-bit integers.

    Byte-level pre-tokenisation never looks across a single space, so a text is encoded
    chunk by chunk, " word" by " word", from a cache of CACHE_BYTES, which begins anew when it is full; texts with double spaces
    or special tokens are encoded whole.  A text's first word has no space before it
    and is known by one behind it.
    """
    if path not in _caches:
        _caches[path] = _Cache(path)
    cache = _caches[path]
    if cache.words.size > CACHE_BYTES:
        cache.words = _Words()
    code = cache.words.__getitem__
    out: list[bytes | None] = [None] * len(texts)
    rows, codes, whole = [], [], []
    for i, text in enumerate(texts):
        if "  " in text or "<|" in text:
            whole.append(i)
            continue
        own = text.split(" ")
        own[0] += " "
        rows.append(i)
        codes.append(np.fromiter(map(code, own), np.int64, len(own)))
    if rows:
        cache.learn()
        ids, length = cache.words.gather(np.concatenate(codes))
        first = np.cumsum([0, *(x.size for x in codes)])
        at = np.r_[0, np.cumsum(length)][first].tolist()
        for i, a, b in zip(rows, at, at[1:]):
            out[i] = ids[a:b].tobytes()
    for i, ids in zip(whole, cache.encode([texts[i] for i in whole])):
        out[i] = ids.tobytes()
    return out


def _stretches(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of rows of about a block's bytes; null is empty."""
    _, at = text_bytes(texts)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + BLOCK_BYTES, "right")) - 1)
        yield i, [t or "" for t in texts[i:j].to_pylist()]
        i = j


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, piece, start, length, ids_crc32[, ids binary of little-endian 32-bit ids])."""
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        for batch in batches:
            doc_ids = batch.column("doc_id").cast(pa.int64())
            for i, texts in _stretches(batch.column("text")):
                row, piece, start, blob = [], [], [], []
                for r, ids in enumerate(token_bytes(texts, tokenizer_path)):
                    ids += end
                    n = len(ids) // 4
                    at = [0] if n <= capacity else [0, *range(n % capacity or capacity, n, capacity)]
                    for k, (a, b) in enumerate(zip(at, [*at[1:], n])):
                        row.append(i + r), piece.append(k), start.append(a), blob.append(ids[4 * a : 4 * b])
                columns = {
                    "doc_id": doc_ids.take(pa.array(row, pa.int64())),
                    "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array([len(x) // 4 for x in blob], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x) for x in blob], pa.int64()),
                }
                if keep_ids:
                    columns["ids"] = pa.array(blob, pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else "")
    return docs.select("doc_id", "text").mapInArrow(lambda b: released(run(b)), schema)


Filling = tuple[tuple[int, int], ...]  # (length, how many), largest first


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing on a histogram: equal bins are filled together."""
    open_bins: dict[int, dict[Filling, int]] = {}
    room: list[int] = []
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            space = next((s for s in room if s >= length and open_bins[s]), None)
            if space is None:
                each = capacity // length
                n, rest = divmod(left, each)
                adds = [(((length, each),), n, capacity - each * length)] if n else []
                adds += [(((length, rest),), 1, capacity - rest * length)] if rest else []
                left = 0
            else:
                filling, n = next(iter(open_bins[space].items()))
                each = min(space // length, left)
                n = min(n, left // each)
                open_bins[space][filling] -= n
                if not open_bins[space][filling]:
                    del open_bins[space][filling]
                adds = [((*filling, (length, each)), n, space - each * length)]
                left -= n * each
            for f, n, s in adds:
                own = open_bins.setdefault(s, {})
                own[f] = own.get(f, 0) + n
        room = sorted(s for s, own in open_bins.items() if own)
    return [(f, n) for own in open_bins.values() for f, n in own.items()]


def _spread(sums: int, by: int) -> int:
    """Bits t to t + by for each bit t."""
    have = 0
    while have < by:
        step = min(have + 1, by - have)
        sums |= sums << step
        have += step
    return sums


def _dominated(filling: Filling, left: dict[int, int], waste: int) -> bool:
    """Whether a length that is left over fits in place of some of the filling's lengths that are no longer together, or into its waste."""
    some = many = 0  # bit t: one or more, two or more of the lengths make up t
    single = 0
    for x, n in filling:
        single |= 1 << x
        for _ in range(n):
            many |= some << x
            some |= some << x | 1 << x
    own, free = dict(filling), 0
    for x, n in left.items():
        if n > own.get(x, 0):
            free |= 1 << x
    longer = _spread(single << 1 | 2, waste - 1) if waste else 0
    return bool(free & (_spread(many, waste) | longer))


def _completions(left: dict[int, int], space: int) -> Iterator[tuple[Filling, int]]:
    """(filling, waste) of each undominated filling of `space` among the first TESTS of each waste, least waste first; reachable sums are
    bit sets, read back from the largest length."""
    lengths = sorted((x for x, n in left.items() if n and x <= space), reverse=True)
    keep = (1 << (space + 1)) - 1
    layers, sums = [1] * (len(lengths) + 1), 1  # layers[k]: sums of lengths[k:]
    for k in range(len(lengths) - 1, -1, -1):
        x = lengths[k]
        n, step = min(left[x], space // x), 1
        while n:
            take = min(step, n)
            sums |= (sums << (take * x)) & keep
            n -= take
            step *= 2
        layers[k] = sums
    while sums:
        total = sums.bit_length() - 1
        sums &= ~(1 << total)
        stack: list[tuple[int, int, Filling]] = [(0, total, ())]
        tests = 0
        while stack and tests < TESTS:
            k, rest, filling = stack.pop()
            if not rest:
                tests += 1
                if not _dominated(filling, left, space - total):
                    yield filling, space - total
                continue
            while k < len(lengths) and lengths[k] > rest:
                k += 1
            if k == len(lengths):
                continue
            x = lengths[k]
            for n in range(min(left[x], rest // x) + 1):  # the most of the largest comes off the stack first
                if layers[k + 1] >> (rest - n * x) & 1:
                    stack.append((k + 1, rest - n * x, (*filling, (x, n)) if n else filling))


@dataclass
class Search:
    """What plan_packing() found: fillings and how often each is used, sequences, their lower bound, steps taken, and why it ended."""

    plan: list[tuple[Filling, int]]
    bins: int
    least: int
    steps: int
    ended: str


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> Search:
    """As few bins as the search finds, and no more than best-fit decreasing."""
    left = {int(x): int(n) for x, n in counts.items() if n}
    total = sum(x * n for x, n in left.items())
    best = best_fit_decreasing(left, capacity)
    out = Search(best, sum(n for _, n in best), -(-total // capacity), 0, "lower bound reached")
    path: list[tuple[Filling, int, int, int]] = []  # filling, times, waste, option
    option = used = waste = 0
    while out.bins > out.least:
        if out.steps == nodes:
            out.ended = "steps used up"
            break
        out.steps += 1
        found = None
        allowed = (out.bins - 1) * capacity - total - waste  # no better packing wastes more
        if left and allowed >= 0:
            largest = max(left)
            left[largest] -= 1
            found = next(islice(_completions(left, capacity - largest), option, None), None)
            left[largest] += 1
        if not left and used < out.bins:
            out.plan, out.bins = [(f, n) for f, n, _, _ in path], used
        if found and found[1] <= allowed:
            merged = dict(found[0])
            merged[largest] = merged.get(largest, 0) + 1
            filling, spare = tuple(sorted(merged.items(), reverse=True)), found[1]
            times = min(min(left[x] // n for x, n in filling), allowed // spare if spare else total)
            path.append((filling, times, spare, option))
            for x, n in filling:
                left[x] -= n * times
                if not left[x]:
                    del left[x]
            used, waste, option = used + times, waste + spare * times, 0
        elif path:
            filling, times, spare, option = path.pop()
            for x, n in filling:
                left[x] = left.get(x, 0) + n * times
            used, waste, option = used - times, waste - spare * times, option + 1
        else:
            out.ended = "all branches taken"
            break
    return out


def _slots(plan: list[tuple[Filling, int]]) -> dict[int, tuple[list[int], list[tuple[int, int, int]]]]:
    """For each length: first ranks, and (first sequence, offset in it, pieces in one sequence) of each use."""
    out: dict[int, tuple[list[int], list[tuple[int, int, int]]]] = {}
    next_rank: dict[int, int] = {}
    sequence = 0
    for filling, times in plan:
        offset = 0
        for length, each in filling:
            ranks, uses = out.setdefault(length, ([], []))
            ranks.append(next_rank.get(length, 0))
            uses.append((sequence, offset, each))
            next_rank[length] = ranks[-1] + each * times
            offset += length * each
        sequence += times
    return out


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, work: Workspace | None = None) -> DataFrame:
    """pieces(doc_id, piece, length, ...) and any other columns -> the same with sequence_id and offset."""
    spark = pieces.sparkSession
    work = work or Workspace(spark)
    many = dict(pieces.groupBy("length").agg(F.count("*").alias("n")).orderBy("length").collect())  # at most capacity lengths
    salts = F.lit(1)
    if many:
        salts = F.element_at(F.create_map(*[F.lit(x) for length, n in many.items() for x in (length, -(-n // GROUP))]), F.col("length"))
    order = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in pieces.columns]
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), salts).cast("int"))
    groups = salted.groupBy("length", "_salt").agg(F.count("*").alias("n")).collect()  # one for about GROUP pieces, and for each length
    base: dict[tuple[int, int], int] = {}
    counts: dict[int, int] = {}
    for length, salt, n in sorted(groups):
        base[length, salt] = counts.get(length, 0)
        counts[length] = base[length, salt] + n
    plan = plan_packing({x: n for x, n in counts.items() if x < capacity}, capacity).plan
    full = counts.get(capacity, 0)
    if full:
        plan = [*plan, (((capacity, 1),), full)]
    shared = spark.sparkContext.broadcast((base, _slots(plan)))
    ranked = salted.withColumn("_nth", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)) - 1)
    names = [c for c in pieces.columns]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, slots = shared.value
        for batch in batches:
            sequences, offsets = [], []
            for length, salt, nth in zip(*(batch.column(c).to_pylist() for c in ("length", "_salt", "_nth"))):
                rank = base[length, salt] + nth
                ranks, uses = slots[length]
                k = bisect_right(ranks, rank) - 1
                sequence, offset, each = uses[k]
                turn, within = divmod(rank - ranks[k], each)
                sequences.append(sequence + turn)
                offsets.append(offset + within * length)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(lambda b: released(place(b)), schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset).

    Each piece's ids are identified by their CRC-32; with keep_ids they are carried along themselves.
    """
    work = Workspace(docs.sparkSession)
    pieces = work.store(tokenize_pieces(docs, tokenizer_path, capacity, keep_ids), "pieces")
    return pack_pieces(pieces, capacity, work)
