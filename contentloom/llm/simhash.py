"""SimHash near-duplicates with pivot distance tables.

A text's fingerprint has 64 bits; bit i is set if it is set in over half the hashes of its
three-word shingles. Texts whose fingerprints differ in at most ``radius`` (3) bits are linked,
and a group is all that links reach.

Links are looked for between distinct fingerprints only, so copies cost nothing. Fingerprints
within three bits agree in at least two of five blocks of bits, and rows are dealt by each of
the ten pairs of blocks; no link is lost. Within a bucket, the table of Hamming distances to
fixed pivots discards pairs: by the triangle inequality, distances to one pivot differ by no
more than the distance of the two. Pairs that no pivot tells apart are verified by their bits.
A bucket gives the links that hold its groups together, never all pairs.

A bucket of more than ``cell`` fingerprints is cut into chunks, and each pair of chunks is a
cell of its own, so no task holds more than two chunks at once and none is left out.

Defined cases: a null or empty text has fingerprint zero and is linked like any other. Repeated
rows are separate rows with equal results. The component's id is the smallest id in it that is
not null.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from contentloom.llm.components import components
from contentloom.llm.texts import in_batches, narrow, utf8
from contentloom.operators.skew import skew_join
from contentloom.session import stage

#: Reference fingerprints: the hashes of the first whole numbers.
PIVOTS = np.array([xxhash.xxh64_intdigest(bytes([i]), 42) for i in range(16)], np.uint64)
#: First bit and width of each block.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
SHINGLES_AT_ONCE = 200_000


def fingerprint(text: bytes, words_in_shingle: int = 3) -> int:
    """Majority bits of the shingles' XXH64 (seed 42); ASCII letters count in lower case."""
    words = text.lower().split()
    if not words:
        return 0
    size = min(words_in_shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    first, last = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    digest, counts, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(first)
    for at in range(0, n, SHINGLES_AT_ONCE):
        pairs = zip(first[at : at + SHINGLES_AT_ONCE], last[at : at + SHINGLES_AT_ONCE], strict=True)
        hashes = np.array([digest(joined[i:j], 42) for i, j in pairs], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``fp`` (the 64 bits as a long) of every row."""

    def batches_in(batches):
        for batch in batches:
            for part in in_batches(batch, 1):
                values = np.array([fingerprint(t) for t in utf8(part.column(1))], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values)], names=["id", "fp"])

    rows = narrow(docs, id_col, text_col)
    return rows.mapInArrow(batches_in, f"id {dict(rows.dtypes)['id']}, fp long")


def _block_keys(fp: str = "fp") -> Column:
    """A key for each pair of blocks: the pair's number and the bits of both."""
    blocks = [F.shiftrightunsigned(fp, at).bitwiseAND((1 << width) - 1) for at, width in BLOCKS]
    pairs = [(i, j) for i in range(len(blocks)) for j in range(i)]
    return F.array(
        *(
            F.shiftleft(blocks[i], 13).bitwiseOR(blocks[j]).bitwiseOR(F.lit(n << 26))
            for n, (i, j) in enumerate(pairs)
        )
    )


def pivot_table(values: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints to each pivot, a row for each pivot."""
    return np.bitwise_count(values[None, :] ^ PIVOTS[:, None]).astype(np.int8)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints of one word each, or of a row of words each."""
    bits = np.bitwise_count(a ^ b)
    return bits if bits.ndim == 1 else bits.sum(axis=1, dtype=np.int16)


def untold_pairs(table: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which of the pairs no pivot tells apart."""
    at = np.arange(len(a))
    for distances in table:
        if not len(at):
            break
        at = at[np.abs(distances[a[at]] - distances[b[at]]) <= radius]
    return at


def near_pairs(values: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which of the pairs (places in ``values``) are within the radius."""
    at = untold_pairs(table, a, b, radius)
    return at[apart(values[a[at]], values[b[at]]) <= radius]


def group_places(values: np.ndarray, table: np.ndarray, radius: int) -> np.ndarray:
    """Pairs of places in ``values`` that connect what is within the radius, for one bucket.

    Groups grow from a fingerprint to all that are near it and not yet in a group, so a dense
    group is soon used up and costs no more than its members.
    """
    order = np.argsort(table[0], kind="stable")
    values, table = values[order], table[:, order]
    free, links = np.arange(len(values)), []
    while len(free) > 1:
        todo, free = [int(free[0])], free[1:]
        while todo and len(free):
            x = todo.pop()
            # ``free`` stays in the order of the first pivot: one stretch of it can be near.
            low, high = np.searchsorted(table[0][free], [table[0][x] - radius, table[0][x] + radius + 1])
            stretch = free[low:high]
            hit = near_pairs(values, table[1:], np.full(len(stretch), x), stretch, radius)
            if len(hit):
                links.append(np.stack([np.full(len(hit), x), stretch[hit]], axis=1))
                todo += stretch[hit].tolist()
                free = np.delete(free, low + hit)
    return order[np.concatenate(links)] if links else np.zeros((0, 2), np.int64)


def group_links(values: np.ndarray, radius: int = 3) -> np.ndarray:
    """Links (pairs of fingerprints) that connect what is within the radius, for one bucket."""
    return values[group_places(values, pivot_table(values), radius)]


def cell_starts(cells: np.ndarray) -> np.ndarray:
    """Where each run of equal cell numbers starts."""
    return np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))


def places_of_cells(cells: np.ndarray, values: np.ndarray, radius: int, table_of, small: int = 48) -> np.ndarray:
    """Pairs of places that connect what is within the radius in each run of equal cell numbers;
    ``table_of`` gives the pivot table of such cells and values."""
    starts = cell_starts(cells)
    sizes = np.diff(np.append(starts, len(cells)))
    found = []
    for s, n in zip(starts[sizes > small], sizes[sizes > small], strict=True):
        now = slice(s, s + n)
        found.append(s + group_places(values[now], table_of(cells[now], values[now]), radius))
    kept = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= small), sizes))
    cells, values = cells[kept], values[kept]
    if len(values):
        table = table_of(cells, values)
        for step in range(1, min(small, len(values))):
            a = np.flatnonzero(cells[:-step] == cells[step:])
            if not len(a):
                break
            hit = a[near_pairs(values, table, a, a + step, radius)]
            found.append(kept[np.stack([hit, hit + step], axis=1)])
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _links_of_cells(cells: np.ndarray, values: np.ndarray, radius: int, small: int = 48) -> np.ndarray:
    """Links within each run of equal cell numbers."""
    return values[places_of_cells(cells, values, radius, lambda _, now: pivot_table(now), small)]


def _whole_cells(batches):
    """Arrays of cell numbers and fingerprints; no cell is cut between two of them."""
    held_cells, held_values = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        key, a, b, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        cell = (key.astype(np.int64) << 32) | (a.astype(np.int64) << 16) | b.astype(np.int64)
        cells = np.concatenate([held_cells, cell])
        values = np.concatenate([held_values, fp.view(np.uint64)])
        last = int(np.searchsorted(cells, cells[-1])) if len(cells) else 0
        if last:
            yield cells[:last], values[:last]
        held_cells, held_values = cells[last:], values[last:]
    if len(held_cells):
        yield held_cells, held_values


def links(distinct: DataFrame, radius: int = 3, cell: int = 16_384) -> DataFrame:
    """Links ``a``, ``b`` that connect all distinct fingerprints ``fp`` within the radius."""
    keys = distinct.select(F.explode(_block_keys()).alias("key"), "fp")
    full = keys.groupBy("key").count().where(F.col("count") > cell)
    chunked = keys.join(full, "key", "left").select(
        "key", "fp", F.coalesce(F.ceil(F.col("count") / cell), F.lit(1)).cast("int").alias("chunks")
    )
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    cells = chunked.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = (
        cells.select(
            F.col("key").cast("long").alias("key"),
            F.least("own", "other").alias("first"),
            F.greatest("own", "other").alias("second"),
            "fp",
        )
        .repartition("key", "first", "second")
        .sortWithinPartitions("key", "first", "second")
    )

    def found(batches):
        for cells_now, values in _whole_cells(batches):
            pairs = _links_of_cells(cells_now, values, radius).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return dealt.mapInArrow(found, "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """``id``, ``fp`` and ``component`` (the smallest id reachable) of every row."""
    own = stage(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = stage(own.groupBy("fp").agg(F.min("id").alias("first")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp"), radius))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component"))
    by_fp = rooted.select("fp", "root").join(smallest, "root").select("fp", "component")
    return skew_join(own, stage(by_fp, "components"), "fp").select("id", "fp", "component")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group stays, the one with the smallest id, with all its columns.

    Where that id is repeated, the row with the smallest text (then the smallest other columns)
    stays. Rows without an id cannot be told apart, so they all stay.
    """
    groups = near_groups(docs, id_col, text_col)
    kept = stage(
        groups.where("id = component").groupBy("id").agg(F.count("*").alias("rows")).withColumnRenamed("id", "kept_id"),
        "kept-ids",
    )

    def rows_of(ids: DataFrame) -> DataFrame:
        # The ids grow with the documents, so they are never sent to all tasks, however few they are.
        return docs.join(ids.hint("merge"), docs[id_col] == ids["kept_id"], "left_semi")

    others = [c for c in docs.columns if c != text_col]
    repeated = (
        rows_of(kept.where("rows > 1"))
        .groupBy(F.col(id_col).alias("kept_id"))
        .agg(F.min(F.struct(text_col, *others)).alias("row"))
        .select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
    )
    return rows_of(kept.where("rows = 1")).unionByName(repeated).unionByName(docs.where(F.col(id_col).isNull()))
