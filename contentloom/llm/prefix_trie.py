"""Conversation prefix trie: every distinct start of a conversation is a node, with sums of its subtree.

A turn is known by the MD5 of its role and text (16 bytes), a conversation by the ids of its turns. Spark
deals conversations into shards that are ranges of their ids, so what starts alike lies together. In a
shard the ids become whole numbers in a padded matrix, numpy sorts its rows (``lexsort``), and a column's
changes from row to row, OR-accumulated along the row, mark where nodes start: a row's length up to the
first mark is what it shares with the row before. ``reduceat`` over the starts sums up the nodes of every
depth. The matrix is taken in blocks of columns, each with the rows that are still tied, so one long
conversation does not widen the rows of all. Nodes that only one conversation reaches are made at once,
without a matrix.

A node that holds the first or last row of its shard may go on in the next one. Such nodes, one path
each, are given out in parts under a hash of their ids and added up. What a shard counts twice or not
at all, for not seeing its neighbour, depends only on how much the last row of a shard shares with
the first row of the next, and is corrected from these two rows. Members that end in such a node are
hashed as a stream, in the order of the shards.

Held at once are the turn ids of one shard, and those of one conversation as a cell (16 bytes a turn).

Defined cases: a null role or text is empty. Rows without a conversation id belong to none and are
left out. Turns of the same number (nulls first) are put in order by their id; repeated rows are turns of
their own. An empty table has no nodes. Other columns are not read.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from contentloom.operators.skew import in_order, place_ranks, skew_join
from contentloom.session import stage

ID_BYTES = 16
#: Turns in a shard, about.
SHARD_TURNS = 2_000_000
MATRIX_CELLS = 8_000_000
NOBODY = hashlib.sha256(b"").hexdigest()


def ranked_turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv``, ``rank`` (from 1), ``id`` and ``chars`` of every turn; texts are read, not moved."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    turns = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), digest.alias("id"), F.length(text).alias("chars"),
        F.monotonically_increasing_id().alias("row"),
    )
    placed = in_order(turns, "conv", "turn", "id", "row").select("conv", "id", "chars", "at")
    return place_ranks(placed, "conv").select("conv", "rank", "id", "chars")


def rebuilt(turns: DataFrame) -> DataFrame:
    """``conv`` and ``turns`` (an array of id and chars): the first turns of the hundred's first
    conversation, then the own turns after as many."""
    turns = stage(turns, "ranked-turns")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", "chars"))), lambda t: F.struct(t["id"], t["chars"]))
    head = (F.crc32(F.col("conv").cast("string").cast("binary")) % 6).cast("int")
    convs = turns.select("conv").distinct().withColumn("h", head).withColumn("base", F.expr("conv - conv % 100"))
    leads = turns.where("rank <= 5 AND conv % 100 = 0").groupBy(F.col("conv").alias("base")).agg(ordered.alias("lead"))
    own = turns.withColumn("h", head).where("rank > h").groupBy("conv").agg(ordered.alias("own"))
    nothing = F.array().cast("array<struct<id:binary,chars:int>>")
    lead = F.when(F.col("h") > 0, F.slice(F.coalesce("lead", nothing), F.lit(1), F.col("h"))).otherwise(nothing)
    return convs.join(leads, "base", "left").join(own, "conv", "left").select(
        "conv", F.concat(lead, F.coalesce("own", nothing)).alias("turns")
    )


def sorted_rows(conv: np.ndarray, start: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of their turns (``rank`` from ``start`` on, all above zero) and then of ``conv``; and
    how many turns each row shares with the row before it, -1 for the first."""
    n = len(conv)
    place, shared = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    todo, tied, at, width = np.arange(n), np.zeros(n, np.int64), 0, 8
    while len(todo):
        width = max(8, min(width, MATRIX_CELLS // len(todo)))
        columns = at + np.arange(width)
        there = columns[None, :] < length[todo][:, None]
        matrix = np.zeros((len(todo), width), np.int64)
        matrix[there] = rank[(start[todo][:, None] + columns[None, :])[there]]
        order = np.lexsort([conv[todo], *matrix.T[::-1], tied])
        todo, matrix, tied = todo[order], matrix[order], tied[order]
        # Rows of one tie take the places from its number on.
        first = np.concatenate([[True], tied[1:] != tied[:-1]])
        since = np.arange(len(todo)) - np.maximum.accumulate(np.where(first, np.arange(len(todo)), 0))
        now = tied + since
        marks = np.logical_or.accumulate(matrix[1:] != matrix[:-1], axis=1)
        alike = np.concatenate([[0], (~marks).sum(axis=1)])
        met = ~first
        shared[now[met]] = np.minimum(at + alike[met], length[todo[met]])
        place[now] = todo
        goes_on = met & (alike == width) & (matrix[:, -1] > 0)
        label = np.where(goes_on, 0, now)
        tied = np.maximum.accumulate(label)
        held = goes_on | np.append(goes_on[1:], False)
        todo, tied, at, width = todo[held], tied[held], at + width, 2 * width
    return place, shared


def path_keys(ids: bytes) -> list[bytes]:
    """A hash for the node of each depth on the way of a conversation, the root's first."""
    digest = xxhash.xxh3_128()
    keys = [digest.digest()]
    for at in range(0, len(ids), ID_BYTES):
        digest.update(ids[at : at + ID_BYTES])
        keys.append(digest.digest())
    return keys


def _hashed(members: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, members.tolist())).encode()).hexdigest()


#: Kinds of rows of a shard: whole nodes; nodes whose parent goes beyond the shard; parts of nodes that
#: may do so; the shard's first and last conversation.
WHOLE, CHILD, PART, EDGE = range(4)
SHARD = (
    ("kind", pa.int32(), "int"), ("shard", pa.int64(), "long"), ("key", pa.binary(), "binary"), ("parent_key", pa.binary(), "binary"),
    ("conv_id", pa.int64(), "long"), ("depth", pa.int64(), "long"), ("parent_conv_id", pa.int64(), "long"),
    ("n_convs", pa.int64(), "long"), ("n_children", pa.int64(), "long"), ("n_leaves", pa.int64(), "long"),
    ("saved_tokens", pa.int64(), "long"), ("ends_sha256", pa.string(), "string"), ("ends", pa.string(), "string"),
    ("ids", pa.binary(), "binary"), ("chars", pa.list_(pa.int32()), "array<int>"),
)
NAMES = [name for name, _, _ in SHARD]


def _rows(kind: int, shard: int, n: int, **columns) -> pa.RecordBatch:
    columns = {"kind": np.full(n, kind, np.int32), "shard": np.full(n, shard, np.int64)} | columns
    arrays = [pa.array(columns[name], t) if name in columns else pa.nulls(n, t) for name, t, _ in SHARD]
    return pa.RecordBatch.from_arrays(arrays, names=NAMES)


def shard_nodes(conv: np.ndarray, ids: list[bytes], chars: np.ndarray, shard: int):
    """Batches of the nodes of one shard. ``chars`` are those of all turns, in the order of ``ids``."""
    n = len(conv)
    length = np.array([len(i) // ID_BYTES for i in ids], np.int64)
    start = np.concatenate([[0], np.cumsum(length)[:-1]])
    halves = np.frombuffer(b"".join(ids), ">u8").reshape(-1, 2).astype(np.uint64)
    by_id = np.lexsort((halves[:, 1], halves[:, 0]))
    fresh = np.ones(len(by_id), np.int64)
    fresh[1:] = (halves[by_id[1:]] != halves[by_id[:-1]]).any(axis=1)
    rank = np.zeros(len(by_id), np.int64)
    rank[by_id] = np.cumsum(fresh)
    place, shared = sorted_rows(conv, start, length, rank)
    conv, length, start = conv[place], length[place], start[place]
    ids = [ids[p] for p in place]
    added = np.concatenate([[0], np.cumsum(chars, dtype=np.int64)])

    def chars_of(rows, turns):
        """Characters in the first turns of rows."""
        return added[start[rows] + turns] - added[start[rows]]

    rows = np.arange(n)
    following = np.append(shared[1:], -1)
    leaf = following < length
    twice = np.where(shared >= 0, chars_of(rows, np.maximum(shared, 0)), 0)
    # Up to this depth a row's nodes are shared with a row beside it.
    upto = np.maximum(shared, following)
    keys = path_keys(ids[0]), path_keys(ids[-1])
    # Of the deepest node so far of each row: its least id, and the end of the shard it lies at.
    least, side = np.zeros(n, np.int64), np.full(n, -1, np.int8)

    def given(first, depth, at_side, parent_least, parent_side, found, ends):
        """Rows of nodes: of each its first row, depth, and the end of the shard it or its parent lies at."""
        for kind in (WHOLE, CHILD, PART):
            here = at_side >= 0 if kind == PART else (at_side < 0) & ((parent_side >= 0) == (kind == CHILD))
            at = np.flatnonzero(here)
            if not len(at):
                continue
            columns = {c: v[at] for c, v in found.items()} | {"depth": depth[at]}
            if kind == WHOLE:
                columns["parent_conv_id"] = parent_least[at]
            else:
                columns["parent_key"] = [
                    keys[s][d - 1] if d else None for s, d in zip(parent_side[at].tolist(), depth[at].tolist(), strict=True)
                ]
            if kind == PART:
                columns["key"] = [keys[s][d] for s, d in zip(at_side[at].tolist(), depth[at].tolist(), strict=True)]
                columns["ends"] = [",".join(map(str, ends(k).tolist())) for k in at.tolist()]
            else:
                columns["ends_sha256"] = [_hashed(m) if len(m := ends(k)) else NOBODY for k in at.tolist()]
            yield _rows(kind, shard, len(at), **columns)

    live = np.flatnonzero(upto >= 0)
    depth = 0
    while len(live):
        starts = np.flatnonzero(shared[live] < depth)
        first = live[starts]
        size = np.diff(np.append(starts, len(live)))
        alone = twice[live]
        found = {
            "conv_id": np.minimum.reduceat(conv[live], starts),
            "n_convs": size,
            "n_children": np.add.reduceat(((length[live] > depth) & (shared[live] <= depth)).astype(np.int64), starts),
            "n_leaves": np.add.reduceat(leaf[live].astype(np.int64), starts),
            "saved_tokens": np.add.reduceat(alone, starts) - alone[starts] - (size - 1) * (chars_of(first, depth - 1) if depth else 0),
        }
        ended = np.add.reduceat((length[live] == depth).astype(np.int64), starts)
        at_side = np.where(first == 0, 0, np.where(first + size == n, 1, -1)).astype(np.int8)
        yield from given(
            first, np.full(len(first), depth), at_side, least[first], side[first], found, lambda k: conv[first[k] : first[k] + ended[k]]  # noqa: B023
        )
        least[live], side[live] = np.repeat(found["conv_id"], size), np.repeat(at_side, size)
        depth += 1
        live = live[upto[live] >= depth]
    # What only one row reaches.
    many = length - upto
    row = np.repeat(rows, many)
    depth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + upto[row] + 1
    top = depth == upto[row] + 1
    at_side = np.where(row == 0, 0, np.where(row == n - 1, 1, -1)).astype(np.int8)
    last = depth == length[row]
    one = np.ones(len(row), np.int64)
    found = {"conv_id": conv[row], "n_convs": one, "n_children": (~last).astype(np.int64), "n_leaves": one, "saved_tokens": 0 * one}
    yield from given(
        row, depth, at_side, np.where(top, least[row], conv[row]), np.where(top, side[row], at_side), found,
        lambda k: conv[row[k] : row[k] + last[k]],
    )
    edges = [0, n - 1]
    yield _rows(
        EDGE, shard, 2, depth=np.array([0, 1]), ids=[ids[e] for e in edges],
        chars=[chars[start[e] : start[e] + length[e]].tolist() for e in edges],
    )


def _corrections(batches):
    """Of the edges of all shards in order: what the nodes that two shards share are short of."""
    before = None
    for batch in batches:
        for shard, last, ids, chars in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not last and before is not None:
                a, b = (np.frombuffer(i, f"V{ID_BYTES}") for i in (before, ids))
                common = min(len(a), len(b))
                unlike = np.flatnonzero(a[:common] != b[:common])
                common = int(unlike[0]) if len(unlike) else common
                sums = np.concatenate([[0], np.cumsum(chars, dtype=np.int64)])
                depth = np.arange(common + 1)
                yield _rows(
                    PART, shard, common + 1, key=path_keys(ids[: common * ID_BYTES]), depth=depth,
                    n_convs=0 * depth, n_children=-(depth < common).astype(np.int64),
                    n_leaves=np.full(common + 1, -int(len(a) <= common)), saved_tokens=sums[common] - sums[np.maximum(depth - 1, 0)],
                )
            if last:
                before = ids


def _streamed_hashes(batches):
    """``key`` and hash of the ids that end in it, of rows in order."""
    now, digest = None, None

    def out():
        return pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])

    for batch in batches:
        for key, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != now:
                if now is not None:
                    yield out()
                now, digest = key, hashlib.sha256(ends.encode())
            else:
                digest.update(b"," + ends.encode())
    if now is not None:
        yield out()


def trie(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """All nodes of ``conv``, ``turns`` (an array of id and chars): ``conv_id`` (the smallest member),
    ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``."""
    spark = sequences.sparkSession
    ids = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), ""))
    rows = stage(sequences.select("conv", ids.alias("ids"), F.transform("turns", lambda t: t["chars"]).alias("chars")), "sequences")
    turns = rows.agg(F.coalesce(F.sum(F.size("chars") + 1), F.lit(0))).first()[0]
    shards = max(-(-turns // shard_turns), int(spark.conf.get("spark.sql.shuffle.partitions")))

    def nodes(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        chars = pc.list_flatten(table.column("chars")).to_numpy()
        yield from shard_nodes(table.column("conv").to_numpy(), table.column("ids").to_pylist(), chars, TaskContext.get().partitionId())

    schema = ", ".join(f"{name} {kind}" for name, _, kind in SHARD)
    found = stage(rows.repartitionByRange(shards, "ids", "conv").mapInArrow(nodes, schema), "trie-shards")
    edges = found.where(F.col("kind") == EDGE).select("shard", F.col("depth").alias("last"), "ids", "chars")
    # Two conversations a shard, one after the other.
    corrections = edges.repartition(1).sortWithinPartitions("shard", "last").mapInArrow(_corrections, schema)
    sums = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    parts = found.where(F.col("kind") == PART)
    open_nodes = stage(
        parts.unionByName(corrections)
        .groupBy("key")
        .agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_key").alias("parent_key"), *(F.sum(c).alias(c) for c in sums)),
        "open-nodes",
    )
    ends = parts.where("ends <> ''").repartition("key").sortWithinPartitions("key", "shard").select("key", "ends")
    hashes = ends.mapInArrow(_streamed_hashes, "key binary, ends_sha256 string")
    whole = open_nodes.join(hashes, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOBODY)))
    parents = open_nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", *sums, "ends_sha256"]
    children = found.where(F.col("kind") == CHILD).drop("parent_conv_id")
    return (
        found.where(F.col("kind") == WHOLE)
        .select(*columns)
        .unionByName(skew_join(children, parents, "parent_key").select(*columns))
        .unionByName(whole.join(parents, "parent_key", "left").select(*columns))
    )


def conversation_trie(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    rebuild=rebuilt,
    shard_turns: int = SHARD_TURNS,
) -> DataFrame:
    """The trie of conversations that ``rebuild`` makes of the ranked turns."""
    return trie(rebuild(ranked_turns(conversations, conv_col, turn_col, role_col, text_col)), shard_turns)


def as_they_are(turns: DataFrame) -> DataFrame:
    """Conversations of their own turns."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", "chars"))), lambda t: F.struct(t["id"], t["chars"]))
    return turns.groupBy("conv").agg(ordered.alias("turns"))
