"""Near copies against brute-force Jaccard pairs."""

import os

import duckdb
import numpy as np
import pytest

from contentloom.llm import near_copies, simhash

DATA = "/root/testdata/sf0.01"


def shingles(text):
    words = (text or "").encode().lower().split()
    size = min(5, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def kept_by_brute_force(rows):
    """Places of the rows that stay, of (id, text)."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    met, at = {}, [{} for _ in rows]
    for i, s in enumerate(sets):
        for x in s:
            for j in met.setdefault(x, []):
                at[i][j] = at[i].get(j, 0) + 1
            met[x].append(i)
    empty = [i for i, s in enumerate(sets) if not s]
    pairs = [(i, j) for i, c in enumerate(at) for j, n in c.items() if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n) - 1e-9]
    for i, j in pairs + list(zip(empty, empty[1:])):
        root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return sorted(min(g, key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i)) for g in groups.values())


def near(words, changed, rng):
    words = list(words)
    for at in rng.choice(len(words), changed, replace=False):
        words[at] = f"new{rng.integers(10**6)}"
    return " ".join(words)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not there")
def test_stage_equals_brute_force(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet' ORDER BY doc_id").fetchall()
    got = near_copies.drop_near_copies(spark.read.parquet(f"{DATA}/documents.parquet"))
    want = [rows[i][0] for i in kept_by_brute_force(rows)]
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == want
    assert not {56, 255} & set(want)


def test_rows_are_judged_by_text(spark):
    rng = np.random.default_rng(2)
    words = [[f"w{rng.integers(500)}" for _ in range(200)] for _ in range(6)]
    plain = [" ".join(w) for w in words]
    rows = [(1, plain[0]), (1, plain[1]), (2, near(words[0], 2, rng)), (1, plain[2]), (1, near(words[2], 3, rng))]
    rows += [(None, plain[3]), (None, plain[3].upper()), (None, plain[4]), (5, plain[4] + " end"), (1, plain[1])]
    rows += [(7, None), (8, " "), (9, "two words"), (6, "Two  words"), (10, near(words[5], 2, rng)), (11, near(words[5], 30, rng))]
    docs = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, text string, row int").coalesce(1)
    got = near_copies.drop_near_copies(docs)
    assert got.columns == docs.columns
    assert sorted(r.row for r in got.collect()) == kept_by_brute_force(rows)
    small = near_copies.drop_near_copies(docs, cell_shingles=100)
    assert sorted(r.row for r in small.collect()) == kept_by_brute_force(rows)
    assert near_copies.drop_near_copies(docs.limit(0)).count() == 0


def test_set_links_connect_all():
    rng = np.random.default_rng(4)
    for _ in range(20):
        base = [rng.integers(0, 400, 40) for _ in range(5)]
        sets = [np.unique(np.append(b[: rng.integers(30, 41)], rng.integers(0, 400, rng.integers(0, 5)))).astype(np.uint64) for b in base for _ in range(12)]
        root = list(range(len(sets)))

        def labels(pairs):
            own = root.copy()
            for a, b in pairs:
                own = [own[b] if x == own[a] else x for x in own]
            return [own.index(x) for x in own]

        near_pairs = [
            (i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i])
            if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) - 1e-9
        ]
        assert labels(near_copies.set_links(np.arange(len(sets)), sets, 0.8)) == labels(near_pairs)


@pytest.mark.parametrize(
    "numbers",
    [
        # Of 64 bits 33, 31 and 30 differed, beyond a radius of 28.
        [990, 3226, 3589, 395, 2003, 3925, 4587, 4519, 2836],
        [3050, 1768, 510, 3309, 1497, 4643, 2680, 4093, 3776],
        [4833, 4994, 4995, 2872, 3624, 315, 102, 457, 4349],
        # No key of 32 was in common, each of four minima.
        [1629, 4351, 4463, 2875, 4891, 3964, 1431, 3485, 2909],
        [3725, 4703, 4232, 991, 1146, 3941, 3269, 2482, 4968],
        [3047, 26, 2578, 2451, 732, 2545, 1996, 2192, 1982],
    ],
)
def test_short_texts_at_the_least_similarity_are_compared(numbers):
    """Texts of four and five shingles, four in common, are candidates: a key is met, and the radius."""
    words = [str(n) for n in numbers]
    a, b = (near_copies.shingle_set(" ".join(words[:n]).encode()) for n in (8, 9))
    assert len(np.intersect1d(a, b)) == 0.8 * len(np.union1d(a, b))
    assert (near_copies.band_keys(a) == near_copies.band_keys(b)).any()
    prints = np.stack([np.frombuffer(near_copies.fingerprint(x), np.uint64) for x in (a, b)])
    assert simhash.apart(prints[:1], prints[1:])[0] <= near_copies.RADIUS


def test_short_texts_at_the_least_similarity_are_copies(spark):
    cases = [[990, 3226, 3589, 395, 2003, 3925, 4587, 4519, 2836], [1629, 4351, 4463, 2875, 4891, 3964, 1431, 3485, 2909]]
    rows = [(2 * k + n, " ".join(str(x) for x in case[: 8 + n])) for k, case in enumerate(cases) for n in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.drop_near_copies(docs).collect()) == [0, 2]


def test_pivots_of_a_bucket_discard():
    """Of pairs of unrelated texts in a bucket, its pivots tell most apart, and no pair within the radius."""
    rng = np.random.default_rng(6)
    sets = []
    for _ in range(6):
        base = rng.integers(0, 2**63, 200, dtype=np.uint64)
        sets += [np.append(base[rng.permutation(200)[:185]], rng.integers(0, 2**63, 5, dtype=np.uint64)) for _ in range(30)]
    order = rng.permutation(len(sets))
    prints = np.stack([np.frombuffer(near_copies.fingerprint(sets[i]), np.uint64) for i in order])
    groups = order // 30
    a, b = np.triu_indices(len(sets), 1)
    table = near_copies.own_pivots(np.zeros(len(sets), np.int64), prints)
    untold = np.zeros(len(a), bool)
    untold[simhash.untold_pairs(table, a, b, near_copies.RADIUS)] = True
    near = simhash.apart(prints[a], prints[b]) <= near_copies.RADIUS
    assert untold[near].all() and near[groups[a] == groups[b]].all() and not near[groups[a] != groups[b]].any()
    assert untold[groups[a] != groups[b]].mean() < 0.05


def test_cells_are_linked_by_their_own_pivots():
    """Cells of all sizes, in few and many steps, against every pair of each cell."""
    rng = np.random.default_rng(8)
    cells, prints = [], []
    for cell, n in enumerate([1, 2, 3, 0, 47, 48, 49, 120]):
        bases = [rng.integers(0, 2, near_copies.BITS, dtype=np.uint8) for _ in range(1 + n // 5)]
        for _ in range(n):
            flips = rng.random(near_copies.BITS) < rng.choice([0.02, 0.15, 0.25])
            prints.append(np.packbits(bases[rng.integers(len(bases))] ^ flips, bitorder="little").view("<u8"))
            cells.append(cell)
    cells, prints = np.array(cells), np.stack(prints)

    def labels(pairs):
        own = list(range(len(cells)))
        for a, b in pairs:
            own = [own[b] if x == own[a] else x for x in own]
        return [own.index(x) for x in own]

    for radius in (20, 100, near_copies.RADIUS):
        found = simhash.places_of_cells(cells, prints, radius, lambda c, p, r=radius: near_copies.own_pivots(c, p, r))
        a, b = np.triu_indices(len(cells), 1)
        near_now = (cells[a] == cells[b]) & (simhash.apart(prints[a], prints[b]) <= radius)
        assert (cells[found[:, 0]] == cells[found[:, 1]]).all()
        assert labels(found.tolist()) == labels(zip(a[near_now].tolist(), b[near_now].tolist(), strict=True))
