"""Benchmark decontamination: item-sized windows, SimHash with multi-index blocks, exact check.

Words are runs of letters and digits in lower case. An item of n words is compared with every
window of n words of a document, by the shingles of five words that they hold, counted as often
as they occur: similarity is the sum of the smaller counts over the sum of the larger ones
(weighted Jaccard). A window leaks an item if the similarity is 0.8 or more. A document shorter
than the item is one window, whole, if it has the share of the item's shingles that 0.8 takes.

A window of an item's size is fingerprinted if enough of its shingles are in the benchmark at
all: less than ``t / (1 + t)`` of the window's and the item's shingles together, and no item can
reach the threshold t. This loses nothing and leaves few windows. Fingerprints (64 bits, each shingle votes with its count) are
looked up in a multi-index: eight blocks of eight bits, each looked up with all values within
``radius // 8`` bits, so all items within the radius are met. Those of the window's size are
verified exactly. At a similarity of 0.8 two fingerprints differ in about ten bits, with a
deviation of three; the radius of 24 is nearly five deviations beyond.

The benchmark is the query set: it is sent to the tasks in blocks of ``words_at_once`` words,
one pass over the documents for each block, so what is broadcast has a fixed bound.

Defined cases: null and empty texts and items have no words and leak nothing. An item of fewer
than five words has one shingle, the whole item. Repeated rows leak one by one: the result has
a row for each document row and item, with the best window (the first of equals). Items with a
null id, and repeated items, are items as well.
"""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from contentloom.llm.texts import in_batches, narrow
from contentloom.session import stage

WORD = re.compile(r"\w+")
SHINGLE = 5
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_FINAL = np.uint64(0xFF51AFD7ED558CCD)


def _hash(ids: np.ndarray, size: int, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``size`` word numbers from each place on."""
    mixed = np.zeros(len(at), np.uint64)
    for k in range(size):
        x = (ids[at + k].astype(np.uint64) + np.uint64(2)) * _MIX[k]
        mixed = (mixed ^ (x ^ (x >> np.uint64(29)))) * _FINAL
    return mixed ^ (mixed >> np.uint64(32))


class _Numbers(dict):
    """Words of the benchmark by number; -1 for any other."""

    def __missing__(self, word: str) -> int:
        return -1


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def simhash(votes: np.ndarray, shingles: int) -> np.ndarray:
    """Fingerprints from the number of shingles that vote for each of the 64 bits, a row each;
    a shingle votes as often as it occurs."""
    return np.packbits(votes * 2 > shingles, axis=1, bitorder="little").view("<u8")[:, 0]


def similarity(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


class SizeIndex:
    """Multi-index over the fingerprints of the items of one size."""

    def __init__(self, places: list[int], hashes: list[np.ndarray], radius: int):
        self.places, self.radius, self.shingles = places, radius, len(hashes[0])
        self.counts = [Counter(h.tolist()) for h in hashes]
        self.fps = np.concatenate([simhash(_bits(h).sum(axis=0, dtype=np.int64)[None], len(h)) for h in hashes])
        values = np.arange(256, dtype=np.uint8)
        blocks = self.fps.view(np.uint8).reshape(-1, 8)
        #: For each block and value of it, one bit for each item that is near there.
        self.near = np.stack(
            [
                np.packbits(np.bitwise_count(values[:, None] ^ blocks[None, :, b]) <= radius // 8, axis=1)
                for b in range(8)
            ]
        )

    def candidates(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and items within the radius, met in at least one block."""
        values = fps.view(np.uint8).reshape(-1, 8)
        met = self.near[0][values[:, 0]]
        for b in range(1, 8):
            met = met | self.near[b][values[:, b]]
        window, item = np.nonzero(np.unpackbits(met, axis=1, count=len(self.places)))
        close = np.bitwise_count(fps[window] ^ self.fps[item]) <= self.radius
        return window[close], item[close]


class Index:
    """A block of benchmark items: their words, their shingles, and a multi-index for each size."""

    def __init__(self, items: list[tuple[object, str]], threshold: float, radius: int):
        self.threshold, self.words = threshold, _Numbers()
        split = [(i, WORD.findall(text.lower())) for i, text in items]
        self.items = [(i, len(words)) for i, words in split if words]
        hashes = []
        for words in (words for _, words in split if words):
            ids = np.array([self.words.setdefault(w, len(self.words)) for w in words], np.int64)
            size = min(SHINGLE, len(ids))
            hashes.append(_hash(ids, size, np.arange(len(ids) - size + 1)))
        by_size: dict[int, list[int]] = {}
        for place, (_, n) in enumerate(self.items):
            by_size.setdefault(n, []).append(place)
        self.by_size = {n: SizeIndex(at, [hashes[p] for p in at], radius) for n, at in sorted(by_size.items())}
        #: Hashes of all shingles, by the number of their words.
        self.known = {
            k: np.unique(np.concatenate([h for h, (_, n) in zip(hashes, self.items, strict=True) if min(n, SHINGLE) == k]))
            for k in {min(n, SHINGLE) for n in self.by_size}
        }

    def leaks(self, text: str) -> list[tuple[object, int, int, float]]:
        """Best window of each item that the text leaks: item, first word, end, similarity."""
        words = WORD.findall(text.lower())
        ids = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        strange = np.concatenate([[0], np.cumsum(ids < 0)])
        best: dict[int, tuple[float, int]] = {}
        for size, known in self.known.items():
            # Runs of the benchmark's words alone; no other run can be a shingle of it.
            at = np.flatnonzero(strange[size:] == strange[: len(strange) - size]) if len(ids) >= size else ids[:0]
            if not len(at):
                continue
            hashes = _hash(ids, size, at)
            at = at[known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes]
            indexes = [(n, ix) for n, ix in self.by_size.items() if min(n, SHINGLE) == size]
            reach = max(ix.shingles for _, ix in indexes)
            total = len(ids) - size + 1
            for start, end in _stretches(at, reach, total):
                is_known = np.zeros(end - start, bool)
                is_known[at[np.searchsorted(at, start) : np.searchsorted(at, end)] - start] = True
                whole = start == 0 and end == total
                self._search(_hash(ids, size, np.arange(start, end)), is_known, start, indexes, best, whole)
        return [
            (self.items[p][0], start, min(start + self.items[p][1], len(words)), sim)
            for p, (sim, start) in sorted(best.items())
        ]

    def _search(self, hashes, is_known, offset: int, indexes, best: dict, whole: bool) -> None:
        """Windows of every item size within a stretch of a text, or the whole text if it is shorter."""
        run = np.concatenate([[0], np.cumsum(is_known)])
        votes = None
        for _, index in indexes:
            k = index.shingles
            span = min(k, len(hashes))
            if span < k and (not whole or span < self.threshold * k - 1e-9):
                continue
            least = self.threshold / (1 + self.threshold) * (span + k)
            starts = np.flatnonzero(run[span:] - run[:-span] >= least - 1e-9)
            if not len(starts):
                continue
            if votes is None:
                votes = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(_bits(hashes), axis=0, dtype=np.int32)])
            windows, items = index.candidates(simhash(votes[starts + span] - votes[starts], span))
            for start, item in zip(starts[windows].tolist(), items.tolist(), strict=True):
                sim = similarity(Counter(hashes[start : start + span].tolist()), index.counts[item])
                place = index.places[item]
                found = (-sim, start + offset)
                if sim >= self.threshold and (place not in best or found < (-best[place][0], best[place][1])):
                    best[place] = (sim, start + offset)


def _stretches(known: np.ndarray, reach: int, total: int, at_once: int = 50_000):
    """Stretches of a text with known shingles no further apart than ``reach``, in overlapping
    pieces if they are long."""
    if not len(known):
        return
    cuts = np.flatnonzero(np.diff(known) > reach)
    firsts, lasts = known[np.append(0, cuts + 1)], known[np.append(cuts, len(known) - 1)]
    for first, last in zip(firsts.tolist(), lasts.tolist(), strict=True):
        start, end = max(first - reach, 0), min(last + reach + 1, total)
        for at in range(start, end, at_once):
            yield at, min(at + at_once + reach, end)


def _blocks(items: DataFrame, words_at_once: int):
    """The benchmark's items, at most about ``words_at_once`` words at a time."""
    held, words = [], 0
    for row in items.toLocalIterator():
        n = len(row.text.split()) + 1
        if held and words + n > words_at_once:
            yield held
            held, words = [], 0
        held.append((row.id, row.text))
        words += n
    if held:
        yield held


def find_leaks(
    spark: SparkSession,
    docs: DataFrame,
    benchmark: DataFrame,
    threshold: float = 0.8,
    radius: int = 24,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    words_at_once: int = 500_000,
) -> DataFrame:
    """``id``, ``item``, ``start_word``, ``end_word`` (exclusive) and ``similarity`` of every leak."""
    rows = narrow(docs, id_col, text_col)
    items = narrow(benchmark, item_col, "text").orderBy("id", "text")
    types = (dict(rows.dtypes)["id"], dict(items.dtypes)["id"])
    schema = f"id {types[0]}, item {types[1]}, start_word long, end_word long, similarity double"
    found = [_pass(spark, rows, Index(block, threshold, radius), schema) for block in _blocks(items, words_at_once)]
    if not found:
        return spark.createDataFrame([], schema)
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole


def _pass(spark: SparkSession, rows: DataFrame, index: Index, schema: str) -> DataFrame:
    shared = spark.sparkContext.broadcast(index)

    def found(batches):
        index = shared.value
        for batch in batches:
            for part in in_batches(batch, 1):
                met = [(at, leak) for at, text in enumerate(part.column(1).to_pylist()) for leak in index.leaks(text)]
                if met:
                    ids = part.column(0).take(pa.array([at for at, _ in met]))
                    item, start, end, sim = zip(*(leak for _, leak in met), strict=True)
                    arrays = [ids, pa.array(item), pa.array(start), pa.array(end), pa.array(sim)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["id", "item", "start_word", "end_word", "similarity"])

    return rows.mapInArrow(found, schema)


def drop_leaks(
    spark: SparkSession,
    docs: DataFrame,
    benchmark: DataFrame,
    threshold: float = 0.8,
    radius: int = 24,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    words_at_once: int = 500_000,
) -> DataFrame:
    """The rows whose text leaks no item, with all their columns. Rows are judged one by one by
    their own text, whatever their id. The first block of the benchmark filters the rows as they
    are read; if there are more, what is left is written once with row numbers for the others."""
    items = narrow(benchmark, item_col, "text").orderBy("id", "text")
    blocks = (Index(block, threshold, radius) for block in _blocks(items, words_at_once))
    first = next(blocks, None)
    if first is None:
        return docs
    kept = _clean(spark, docs, first, text_col)
    row, bad = "row", None
    while row in docs.columns:
        row += "_"
    schema = f"id long, item {dict(items.dtypes)['id']}, start_word long, end_word long, similarity double"
    for index in blocks:
        if bad is None:
            kept = stage(kept.withColumn(row, F.monotonically_increasing_id()), "numbered")
        more = _pass(spark, narrow(kept, row, text_col), index, schema).select(F.col("id").alias("leaky_row"))
        bad = more if bad is None else bad.unionByName(more)
    if bad is None:
        return kept
    return kept.join(bad.distinct(), kept[row] == F.col("leaky_row"), "left_anti").drop(row)


def _clean(spark: SparkSession, docs: DataFrame, index: Index, text_col: str) -> DataFrame:
    """Rows whose text leaks no item of the index."""
    shared = spark.sparkContext.broadcast(index)
    at = docs.columns.index(text_col)

    def kept(batches):
        index = shared.value
        for batch in batches:
            clean = [not (text and index.leaks(text)) for text in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
