"""The prefix trie against one built turn by turn."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from contentloom.llm import prefix_trie
from contentloom.llm.queries import QUERIES

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain_rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, (role or "", text or "")))
    own = {c: [t for *_, t in sorted(turns)] for c, turns in own.items()}
    found = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        found[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    return found


def plain_trie(found):
    members = defaultdict(list)
    for c, turns in found.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = {}
    for node in sorted(members, key=len, reverse=True):
        below = [out[c] for c in children[node]]
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        ends = ",".join(str(c) for c in sorted(members[node]) if len(found[c]) == len(node))
        out[node] = (
            min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(below),
            sum(b[5] for b in below) or 1, own + sum(b[6] for b in below), hashlib.sha256(ends.encode()).hexdigest(),
        )
    return sorted(out.values(), key=repr)


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def made_rows(seed, convs, hot):
    """Conversations that share starts; a third are copies of one, one is long, some are odd."""
    rng, rows = random.Random(seed), []
    for c in range(convs):
        n = rng.choice([1, 1, 2, 3, 4, 7])
        words = ["same"] * 6 if c % 3 == 0 else [rng.choice(["a", "bb", "", None, "é\U0001f600", "ccc"]) for _ in range(n)]
        rows += [(c, t, rng.choice(["user", None]) if c % 5 == 1 else "user", w) for t, w in enumerate(words)]
    rows += [(7, None, "user", "nulls first"), (7, 1, "user", "z"), (7, 1, "user", "z"), (None, 0, "user", "nobody's")]
    rows += [(c, 0, "user", "only") for c in range(901, 909)]  # some are left without a turn
    rows += [(c, t, "user", f"long {t % 50}") for c in (convs, convs + 200) for t in range(hot)]
    return rows


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_made_conversations(spark, parts):
    rows = made_rows(parts, 330, 300)
    df = spark.createDataFrame([(*r, 1, b"x") for r in rows], "conv_id long, turn int, role string, text string, conv int, ids binary")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = rows_of(prefix_trie.conversation_trie(df.repartition(3)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == plain_trie(plain_rebuilt(rows))


def test_own_turns_and_empty_table(spark):
    rows = [(1, 0, "u", "a"), (1, 1, "a", "b"), (2, 0, "u", "a"), (2, 1, "a", "b"), (2, 2, "u", "c"), (3, 0, "a", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {c: [(r, t) for k, _, r, t in rows if k == c] for c in (1, 2, 3)}
    assert rows_of(prefix_trie.conversation_trie(df, rebuild=prefix_trie.as_they_are)) == plain_trie(found)
    assert prefix_trie.conversation_trie(df.limit(0)).count() == 0


def test_query(spark):
    data = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{data}/conversations.parquet'").fetchall()
    got = QUERIES["op11_prefix_trie"](spark, data)
    assert sorted(got.columns) == sorted(COLUMNS)
    assert rows_of(got) == plain_trie(plain_rebuilt(rows))
