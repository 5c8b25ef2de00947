"""Near copies: one row of each group of texts that share four fifths of their five-word shingles.

Words are split at white space, ASCII letters count in lower case. Two texts are linked if the
Jaccard similarity of their sets of shingles is ``least`` (0.8) or more, and a group is all that
links reach. Texts with the same set are one text from the start, so copies cost nothing.

Candidates: each text has a SimHash of its set, of ``BITS`` (512) bits, and ``BANDS`` keys, each a hash
of ``HASHES`` minima of the set. Texts are dealt by their keys, as in ``simhash`` by blocks of bits, and
in each bucket its pivot search links fingerprints within ``RADIUS`` (156) bits. Distances to numbers
made up beforehand tell nothing apart at such a radius, so a bucket's pivots are members of it, each
the farthest from those before: members near a pivot are 80 to 100 bits from it, others about 256.
At a similarity of 0.8, texts have no key in common once in 3e12 pairs (0.51 a key), and one of 0.16
of the bits differs at most, but for sets of four and five, 0.19 (96 bits, a deviation of nine):
these are farther apart than the radius once in 1.5e10 pairs, any others once in 4e15.
Candidate links only say which texts are compared: within what they reach, sets are compared
exactly, so no other text is ever linked.

Candidates that reach far are cut into chunks by the size of their sets, and each pair of chunks
is a cell of its own. In a cell, a linked text leaves the index, so a dense group costs no more
than its members.

Decisions are made by row, not by id: the row that stays is the one with the smallest id, rows
without an id last. A text of fewer than five words has one shingle, the whole text; texts without
words are copies of each other.
"""

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from contentloom.llm import simhash
from contentloom.llm.components import components
from contentloom.llm.texts import in_batches, utf8
from contentloom.operators.keyfilter import KeyFilter
from contentloom.operators.skew import skew_join
from contentloom.session import stage

SHINGLE = 5
BANDS, HASHES = 40, 3
BITS, RADIUS = 512, 156
#: Members of a bucket that are its pivots, at most.
PIVOTS = 8
_SEEDS = np.array(
    [xxhash.xxh64_intdigest(i.to_bytes(4, "little"), 7) for i in range(2 * BANDS * HASHES + BANDS + BITS // 64)], np.uint64
)
_MASKS, _FACTORS = _SEEDS[: BANDS * HASHES, None], _SEEDS[BANDS * HASHES : 2 * BANDS * HASHES, None] | np.uint64(1)
_BAND = _SEEDS[2 * BANDS * HASHES :][:BANDS]
_WORD = _SEEDS[2 * BANDS * HASHES + BANDS :]
_FOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: bytes, words_in_shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 hashes of the text's shingles, each once, sorted."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    size = min(words_in_shingle, len(words))
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1]
    pairs = zip(starts.tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((digest(joined[i:j], 42) for i, j in pairs), np.uint64, len(starts)))


def fingerprint(hashes: np.ndarray, at_once: int = 255) -> bytes:
    """Majority bits of a set of hashes, each drawn out to ``BITS``; counts of ``at_once`` fit a byte."""
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), at_once):
        words = (hashes[at : at + at_once, None] ^ _WORD) * _FOLD
        words = (words ^ words >> np.uint64(32)) * _FOLD
        words ^= words >> np.uint64(29)
        votes += np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(votes * 2 > len(hashes), bitorder="little").tobytes()


def band_keys(hashes: np.ndarray, at_once: int = 1024) -> np.ndarray:
    """A key for each band; sets of a similarity s have the key of a band in common with s ** HASHES."""
    least = np.full(BANDS * HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), at_once):
        mixed = (hashes[None, at : at + at_once] ^ _MASKS) * _FACTORS
        np.minimum(least, mixed.min(axis=1), out=least)
    keys = _BAND.copy()
    for k in range(HASHES):
        keys = (keys ^ least[k::HASHES]) * _FOLD
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def signatures(rows: DataFrame) -> DataFrame:
    """``row``, ``id``, ``set`` (a digest), ``n`` (shingles), ``fp`` (a digest of ``print``, the
    fingerprint), ``print`` and ``keys`` of every ``row``, ``id``, ``text``."""

    def signed(batches):
        for batch in batches:
            for part in in_batches(batch, 2):
                digests, sizes, prints, keys = [], [], [], []
                for text in utf8(part.column(2)):
                    hashes = shingle_set(text)
                    digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                    sizes.append(len(hashes))
                    prints.append(fingerprint(hashes))
                    keys.append(band_keys(hashes))
                fps = np.array([xxhash.xxh64_intdigest(p) for p in prints], np.uint64)
                arrays = [
                    part.column(0), part.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()),
                    pa.array(fps.view(np.int64)), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["row", "id", "set", "n", "fp", "print", "keys"])

    id_type = dict(rows.dtypes)["id"]
    return rows.mapInArrow(signed, f"row long, id {id_type}, set binary, n long, fp long, print binary, keys array<long>")


def _in_cells(rows: DataFrame, group: str, spread: str) -> DataFrame:
    """Rows with ``cell``: each pair of the group's ``chunks`` is a cell, sorted and not cut."""
    own = F.pmod(F.xxhash64(spread), F.col("chunks")).cast("int")
    cells = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cell = F.xxhash64(F.col(group), F.least("own", "other"), F.greatest("own", "other"))
    dealt = cells.withColumn("cell", cell).drop("own", "other", "chunks", group)
    return dealt.repartition("cell").sortWithinPartitions("cell")


def own_pivots(cells: np.ndarray, prints: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Hamming distances of fingerprints to pivots of their own cell, a row for each pivot: the first
    member, then the one farthest from all before, until every member is near one."""
    starts = simhash.cell_starts(cells)
    sizes = np.diff(np.append(starts, len(cells)))
    of = np.repeat(np.arange(len(starts)), sizes)
    pivots, nearest, table = starts, np.full(len(cells), BITS, np.int16), []
    while len(table) < PIVOTS and (not table or (nearest > radius).any()):
        table.append(simhash.apart(prints, prints[pivots[of]]))
        nearest = np.minimum(nearest, table[-1])
        pivots = np.lexsort((nearest, of))[starts + sizes - 1]
    return np.stack(table)


def candidate_links(own: DataFrame, radius: int = RADIUS, cell: int = 16_384) -> DataFrame:
    """Links ``a``, ``b`` between fingerprints that have a key in common and are within the radius."""
    keys = own.select(F.explode("keys").alias("key"), "fp").distinct()
    sizes = keys.groupBy("key").count().where("count > 1")
    # A key of one fingerprint alone links nothing.
    shared = keys.join(sizes, "key").select("key", "fp", F.ceil(F.col("count") / cell).cast("int").alias("chunks"))
    # Fingerprints grow with the documents, so they are never sent to all tasks, however few they are.
    compared = shared.join(own.select("fp", "print").distinct().hint("merge"), "fp")

    def found(batches):
        held_cells, held_fps, held_prints = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, BITS // 64), np.uint64)
        for batch in batches:
            cells, fps = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("cell", "fp"))
            prints = b"".join(batch.column(batch.schema.get_field_index("print")).to_pylist())
            held_cells, held_fps = np.concatenate([held_cells, cells]), np.concatenate([held_fps, fps])
            held_prints = np.concatenate([held_prints, np.frombuffer(prints, np.uint64).reshape(-1, BITS // 64)])
            last = int(np.searchsorted(held_cells, held_cells[-1])) if len(held_cells) else 0
            if last:
                yield links_of(held_cells[:last], held_fps[:last], held_prints[:last])
                held_cells, held_fps, held_prints = held_cells[last:], held_fps[last:], held_prints[last:]
        if len(held_cells):
            yield links_of(held_cells, held_fps, held_prints)

    def links_of(cells, fps, prints):
        pairs = fps[simhash.places_of_cells(cells, prints, radius, lambda c, p: own_pivots(c, p, radius))]
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return _in_cells(compared, "key", "fp").mapInArrow(found, "a long, b long")


def set_links(nodes: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links that connect all sets with a similarity of ``least`` or more, for one cell."""
    sizes = np.array([len(s) for s in sets], np.int64)
    free, left, links = np.ones(len(sets), bool), len(sets), []

    def index():
        members = np.flatnonzero(free)
        terms = np.concatenate([sets[m] for m in members]) if len(members) else np.zeros(0, np.uint64)
        order = np.argsort(terms, kind="stable")
        return terms[order], np.repeat(members, sizes[members])[order], len(members)

    def owners_of(first, n):
        return owners[np.repeat(first - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())]

    terms, owners, indexed = index()
    for seed in range(len(sets)):
        if not free[seed]:
            continue
        free[seed], left, todo = False, left - 1, [seed]
        while todo and left:
            x = todo.pop()
            if not sizes[x]:
                continue
            if 2 * left < indexed:
                terms, owners, indexed = index()
            first = np.searchsorted(terms, sets[x])
            n = np.searchsorted(terms, sets[x], "right") - first
            # Any set near enough has one of these shingles at least: the rarest of x, and so
            # many that too few for the similarity are left.
            rare = np.argsort(n, kind="stable")[: sizes[x] - math.ceil(least * sizes[x] - 1e-9) + 1]
            met = owners_of(first[rare], n[rare])
            if not free[met].any():
                continue
            both = np.bincount(owners_of(first, n), minlength=len(sets))
            near = np.flatnonzero(free & (both > 0))
            near = near[both[near] >= least * (sizes[x] + sizes[near] - both[near]) - 1e-9]
            links += [(int(nodes[x]), int(nodes[y])) for y in near]
            todo += near.tolist()
            free[near] = False
            left -= len(near)
    return links


def exact_links(rows: DataFrame, least: float) -> DataFrame:
    """Links ``a``, ``b`` between the rows (``root``, ``row``, ``chunks``, ``text``) of a root."""

    def as_sets(batches):
        for batch in batches:
            for part in in_batches(batch, 3):
                sets = pa.array([shingle_set(t).tobytes() for t in utf8(part.column(3))], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], sets], names=["root", "row", "chunks", "hashes"])

    def found(batches):
        now, nodes, sets = None, [], []

        def links_now():
            pairs = set_links(np.array(nodes, np.int64), sets, least) if len(nodes) > 1 else []
            columns = [pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)]
            return pa.RecordBatch.from_arrays(columns, names=["a", "b"])

        for batch in batches:
            columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("cell", "row", "hashes"))
            for cell, row, hashes in zip(*columns, strict=True):
                if cell != now and nodes:
                    yield links_now()
                    nodes, sets = [], []
                now = cell
                nodes.append(row)
                sets.append(np.frombuffer(hashes, np.uint64))
        if nodes:
            yield links_now()

    sets = rows.select("root", "row", "chunks", "text").mapInArrow(as_sets, "root long, row long, chunks int, hashes binary")
    return _in_cells(sets, "root", "row").mapInArrow(found, "a long, b long")


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, cell_shingles: int = 4_000_000
) -> DataFrame:
    """One row of each group stays, with all its columns: the one with the smallest id, rows
    without an id last; of rows with the same id, the first in storage order."""
    name = "row"
    while name in docs.columns:
        name += "_"
    # The numbers are written beside the rows, so every later read sees the same ones.
    numbered = stage(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    texts = numbered.select(
        F.col(name).alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    own = stage(signatures(texts), "signatures")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first")
    distinct = stage(
        own.groupBy("set").agg(first, F.min("row").alias("row"), F.min("fp").alias("fp"), F.min("n").alias("n")).drop("set"),
        "distinct-texts",
    )
    roots = components(candidate_links(own)).withColumnRenamed("node", "fp")
    rooted = stage(
        skew_join(distinct.select("row", "fp", "n"), roots, "fp", "left").select(
            "row", "n", F.coalesce("root", "fp").alias("root")
        ),
        "candidates",
    )
    groups = rooted.groupBy("root").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).where("rows > 1")
    chunks = groups.select("root", F.greatest(F.ceil(F.col("n") / cell_shingles), F.lit(1)).cast("int").alias("chunks"))
    compared = stage(skew_join(rooted.select("root", "row"), stage(chunks, "candidate-groups"), "root"), "compared")
    # Of all texts, only those that are compared (and few by chance) leave their place.
    moved = KeyFilter(compared, "row").maybe_wanted(texts.select("row", "text"))
    found = components(exact_links(moved.join(compared, "row"), least))
    groups = distinct.join(found.withColumnRenamed("node", "row"), "row", "left").withColumn("group", F.coalesce("root", "row"))
    kept = groups.groupBy("group").agg(F.min("first").alias("first")).select(F.col("first.row").alias("kept_row"))
    dropped = stage(own.select("row").join(kept, F.col("row") == F.col("kept_row"), "left_anti"), "dropped-rows").withColumnRenamed("row", name)
    # Rows that are surely not dropped stay where they are; the others are compared with those that are.
    test = KeyFilter(dropped, name)
    checked = test.maybe_wanted(numbered).join(dropped.withColumnRenamed(name, "gone" + name), F.col(name) == F.col("gone" + name), "left_anti")
    return test.surely_unwanted(numbered).unionByName(checked).drop(name)
