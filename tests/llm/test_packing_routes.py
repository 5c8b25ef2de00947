"""Related documents meet wherever they stand in the input."""

import numpy as np
import public_tokenizers

from contentloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_related_documents_far_apart_share_a_window(spark):
    rng = np.random.default_rng(6)
    common = "the of and a to in is was for on with as by at from".split()
    own = [[f"zq{rng.integers(10**4)}x" for _ in range(3)] for _ in range(60)]
    # Four documents of each subject, 60 rows apart.
    rows = [(i, " ".join([*rng.choice(common, 20), *rng.permutation(own[i % 60] * 4)])) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    pieces = packing.pack(spark, docs, PATH, window=256, shard_docs=16).collect()
    assert sorted({r.id for r in pieces}) == list(range(240))
    within = {}
    for r in pieces:
        within.setdefault(r.sequence_id, set()).add(r.id)
    met = {i for ids in within.values() for i in ids if any(j != i and j % 60 == i % 60 for j in ids)}
    assert len(met) >= 120


def test_tables_of_few_documents_are_indexed(spark):
    docs = [(0, "saxophone saxophone one"), (1, "volcano volcano two"), (2, "saxophone saxophone three")]
    pieces = packing.pack(spark, spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), PATH).collect()
    start = {}
    for r in pieces:
        start.setdefault(r.id, (r.sequence_id, r.offset))
    order = sorted(start, key=start.get)
    assert abs(order.index(0) - order.index(2)) == 1
