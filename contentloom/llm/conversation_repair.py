"""Conversations brought back to ``system? (user assistant)+`` by the cheapest edits.

Each row of a conversation has a letter for what an edit of it may cost: the initial of its role, and
its first fault (blank, duplicate, truncated). The letters of a conversation span an edit lattice:
a node is a number of rows read and what the next role may be; edges keep, rerole or delete a row, or
insert one. Two Dijkstra searches, from the start and from the ends, each with a heap, meet in the
lattice; both go on until no crossing of the same cost can be left. The nodes and edges of all
cheapest paths are marked from the crossings, and the least audit is read off along the marks: edges
of one node have different letters, and no audit of the same cost starts another one.

Spark deals rows in ranges of conversation and turn. A range turns its rows into segments, letters and
counts of at most ``segment_rows`` rows, so a conversation of any length is many small rows. The
lattice of a segment is searched from each entry state to each exit state; a conversation of several
segments is searched again, over their ends, with the segments as edges. A duplicate is a row whose
role and text come up at an earlier place; first places are found by a sum over digests. Texts are
moved once, to be hashed: one stream for each conversation, as a hash of the whole asks for, of which
a row is held at a time.

Defined cases: rows of the same turn (nulls first) are put in order by role and then by the digest of
role and text; equal rows keep together. A null role or text is one space, and so is a null id or turn
in ``conv_id:turn``. A null ``conv_id`` is a conversation. A role that is empty has no initial: it can
be reroled or deleted. A conversation without rows has zeros, no edits and the hash of the empty text.
Very long texts are read by patterns that do not backtrack. Other columns are not read.
"""

import hashlib
import heapq
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from contentloom.operators.skew import in_order
from contentloom.session import stage

# Costs of the edits, and of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

#: What may come next: a system or user row; a user row; an assistant row; a user row or the end.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
STATES = (START, AFTER_S, AFTER_U, AFTER_A)
ENDS = (START, AFTER_A)
NEXT = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
#: The role that an edit may make in a state.
MADE = {START: "u", AFTER_S: "u", AFTER_U: "a", AFTER_A: "u"}

#: Letters of rows: the initial, ``x`` for any other; upper case if truncated; ``-`` if it must go.
GONE = "-"


def damaged(rows: DataFrame) -> DataFrame:
    """``conv``, ``turn``, ``role``, ``text``, ``copy`` of conversations with planted faults."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", space)
    done = rows.withColumn("kind", kind).where("kind <> 0")
    return done.select(
        "conv",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def _digest() -> Column:
    return F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")))


def lettered(rows: DataFrame) -> DataFrame:
    """Narrow rows ``conv``, ``turn``, ``role``, ``digest``, ``copy``, ``initial``, ``fault``, without texts."""
    shown = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    fault = F.when(shown == "", "b").when(F.right(shown, F.lit(1)).isin(".", "!", "?"), "").otherwise("t")
    return rows.select("conv", "turn", "role", _digest().alias("digest"), "copy", F.left("role", F.lit(1)).alias("initial"), fault.alias("fault"))


def edges_of(letter: str, state: int):
    """(edit, cost, next state) of one row; edits differ."""
    yield "D", DELETE, state
    if letter == GONE:
        return
    extra = TRUNCATED if letter.isupper() else 0
    if (kept := NEXT.get((state, letter.lower()))) is not None:
        yield "K", KEEP + extra, kept
    yield "R", REROLE + extra, NEXT[state, MADE[state]]


class Lattice:
    """Nodes (rows read, state) of the letters of rows. Inserts after the last row are left out if
    more rows are to come, as those belong to the next segment."""

    def __init__(self, letters: str, last: bool):
        self.letters, self.size, self.last = letters, len(letters), last

    def ahead(self, node):
        """(edit, cost, node) of each edge."""
        at, state = node
        if at < self.size:
            for edit, cost, to in edges_of(self.letters[at], state):
                yield edit, cost, (at + 1, to)
        if at < self.size or self.last:
            yield "I", INSERT, (at, NEXT[state, MADE[state]])

    def back(self, node):
        at, state = node
        for before in STATES:
            if at:
                for edit, cost, to in edges_of(self.letters[at - 1], before):
                    if to == state:
                        yield edit, cost, (at - 1, before)
            if (at < self.size or self.last) and NEXT[before, MADE[before]] == state:
                yield "I", INSERT, (at, before)


class Chain:
    """Nodes (segments read, state) over segments whose least costs and audits are known."""

    def __init__(self, tables):
        self.tables = tables

    def ahead(self, node):
        at, state = node
        if at < len(self.tables):
            for (begin, end), (cost, audit) in self.tables[at].items():
                if begin == state:
                    yield audit, cost, (at + 1, end)

    def back(self, node):
        at, state = node
        if at:
            for (begin, end), (cost, audit) in self.tables[at - 1].items():
                if end == state:
                    yield audit, cost, (at - 1, begin)


def cheapest(graph, start, goals) -> tuple[int, list[str]] | None:
    """Cost and edits, those of the least audit, of the cheapest paths from ``start`` to one of ``goals``."""
    reached = ({start: 0}, dict.fromkeys(goals, 0))
    heaps = ([(0, start)], sorted((0, g) for g in goals))
    settled = ({}, {})
    steps = (graph.ahead, graph.back)
    best = 0 if start in goals else None
    while all(heaps):
        if best is not None and heaps[0][0][0] + heaps[1][0][0] > best:
            break
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        cost, node = heapq.heappop(heaps[side])
        if node in settled[side]:
            continue
        settled[side][node] = cost
        for _, step, to in steps[side](node):
            total = cost + step
            if total < reached[side].get(to, total + 1):
                reached[side][to] = total
                heapq.heappush(heaps[side], (total, to))
            if to in reached[1 - side]:
                met = total + reached[1 - side][to]
                best = met if best is None else min(best, met)
    if best is None:
        return None
    # Nodes of the heaps that are as near as they will get count as well: costs are not negative.
    from_start, to_goal = reached
    marked, todo = {}, []

    def mark(node, edit, to):
        marked.setdefault(node, {})[edit] = to

    back, ahead = [], []
    for node, cost in from_start.items():
        if cost + to_goal.get(node, best + 1) == best:
            back.append(node)
            ahead.append(node)
        for edit, step, to in graph.ahead(node):
            if cost + step + to_goal.get(to, best + 1) == best:
                mark(node, edit, to)
                back.append(node)
                ahead.append(to)
    seen = set()
    while back:
        node = back.pop()
        if node in seen:
            continue
        seen.add(node)
        for edit, step, before in graph.back(node):
            if before in from_start and from_start[before] + step == from_start[node]:
                mark(before, edit, node)
                back.append(before)
    seen = set()
    while ahead:
        node = ahead.pop()
        if node in seen:
            continue
        seen.add(node)
        for edit, step, to in graph.ahead(node):
            if to in to_goal and to_goal[to] + step == to_goal[node]:
                mark(node, edit, to)
                ahead.append(to)
    node, audit = start, []
    while node in marked:
        edit = min(marked[node])
        audit.append(edit)
        node = marked[node][edit]
    return best, audit


@lru_cache(maxsize=4096)
def repair(letters: str) -> tuple[int, str]:
    """Cost and least audit of the cheapest repair of one conversation."""
    cost, edits = cheapest(Lattice(letters, True), (0, START), [(len(letters), s) for s in ENDS])
    return cost, "".join(edits)


def segment_table(letters: str, first: bool, last: bool) -> dict:
    """Cost and least audit of a segment from each entry state to each exit state."""
    table = {}
    for begin in (START,) if first else STATES:
        for end in ENDS if last else STATES:
            if found := cheapest(Lattice(letters, last), (0, begin), [(len(letters), end)]):
                table[begin, end] = found[0], "".join(found[1])
    return table


def repair_chain(tables: list[dict]) -> tuple[int, list[str]]:
    """Cost of the cheapest repair and the part of its least audit in each segment."""
    return cheapest(Chain(tables), (0, START), [(len(tables), s) for s in ENDS])


SEGMENT_FIELDS = (
    "letters string, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string,"
    " first_turn long, last_turn long, turns long"
)
LEGAL = ("su", "ua", "au")


def _batch(rows: list[tuple], types: list, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def segments(placed: DataFrame, segment_rows: int) -> DataFrame:
    """Letters and counts of runs of at most ``segment_rows`` rows of a conversation, from rows ``conv``,
    ``at``, ``turn``, ``role``, ``digest``, ``copy``, ``initial``, ``fault``, ``first`` (null for a duplicate)."""
    kept = ["conv", "turn", "role", "digest", "copy", "at"]
    kinds = dict(placed.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in kept) + f", {SEGMENT_FIELDS}"
    counts = [f.split()[0] for f in SEGMENT_FIELDS.split(", ")[1:]]

    def cut(batches):
        now, letters, count, kinds_now = None, [], {}, None

        def row():
            return (*now, "".join(letters), *(count[c] for c in counts))

        for batch in batches:
            types = kinds_now = [batch.schema.field(c).type for c in kept] + [pa.string()] + [
                pa.string() if c.endswith("initial") else pa.int64() for c in counts
            ]
            done = []
            columns = [batch.column(c).to_pylist() for c in (*kept, "initial", "fault", "first")]
            for *head, initial, fault, first in zip(*columns, strict=True):
                if now is None or head[0] != now[0] or len(letters) == segment_rows:
                    if now is not None:
                        done.append(row())
                    now, letters = head, []
                    count = dict.fromkeys(counts, 0) | {"first_initial": initial, "first_turn": None, "last_turn": None}
                elif count["last_initial"] + initial not in LEGAL:
                    count["illegal"] += 1
                count["last_initial"] = initial
                letter = initial if initial in ("s", "u", "a") else "x"
                if fault == "b":
                    count["blank"] += 1
                    letter = GONE
                elif first is None:
                    count["duplicate"] += 1
                    letter = GONE
                elif fault == "t":
                    count["truncated"] += 1
                    letter = letter.upper()
                letters.append(letter)
                turn = head[1]
                if turn is not None and turn != count["last_turn"]:
                    count["turns"] += 1
                    count["last_turn"] = turn
                    if count["first_turn"] is None:
                        count["first_turn"] = turn
            if done:
                yield _batch(done, types, kept + ["letters"] + counts)
        if now is not None:
            yield _batch([row()], kinds_now, kept + ["letters"] + counts)

    rows = placed.repartitionByRange("at").sortWithinPartitions("at")
    return rows.mapInArrow(cut, schema)


def solve(parts: DataFrame) -> DataFrame:
    """``conv``, ``at``, ``cost``, ``piece``: the part of the audit in each segment, and the cost of the whole."""
    kind = dict(parts.dtypes)["conv"]
    schema = f"conv {kind}, at long, cost long, piece string"
    ends = parts.groupBy("conv").agg(F.min("at").alias("from"), F.max("at").alias("upto")).withColumnRenamed("conv", "whole")
    spread = stage(parts.join(ends, F.col("conv").eqNullSafe(F.col("whole"))).select("conv", "at", "letters", "from", "upto"), "segments-of")

    def whole(batches):
        for batch in batches:
            found = [repair(letters) for letters in batch.column(2).to_pylist()]
            arrays = [*batch.columns[:2], pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["conv", "at", "cost", "piece"])

    single = spread.where(F.col("from") == F.col("upto")).select("conv", "at", "letters").mapInArrow(whole, schema)

    def tables(batches):
        for batch in batches:
            conv, at, letters, first, last = batch.columns
            entries = []
            for k, text in enumerate(letters.to_pylist()):
                table = segment_table(text, at[k] == first[k], at[k] == last[k])
                entries.append([{"begin": b, "end": e, "cost": c, "audit": a} for (b, e), (c, a) in table.items()])
            yield pa.RecordBatch.from_arrays([conv, at, pa.array(entries, entry)], names=["conv", "at", "entries"])

    entry = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    of_entry = "array<struct<begin:int,end:int,cost:bigint,audit:string>>"

    # Segments of one conversation are searched apart, then one row of their ends is.
    cut = spread.where(F.col("from") < F.col("upto")).repartition("at").mapInArrow(tables, f"conv {kind}, at long, entries {of_entry}")
    gathered = cut.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("at", "entries"))).alias("segments"))

    def chained(batches):
        for batch in batches:
            rows = []
            for k, found in enumerate(batch.column(1).to_pylist()):
                tables = [{(e["begin"], e["end"]): (e["cost"], e["audit"]) for e in one["entries"]} for one in found]
                cost, pieces = repair_chain(tables)
                rows += [(batch.column(0)[k].as_py(), one["at"], cost, p) for one, p in zip(found, pieces, strict=True)]
            yield _batch(rows, [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string()], ["conv", "at", "cost", "piece"])

    return single.unionByName(gathered.mapInArrow(chained, schema))


def summaries(parts: DataFrame, pieces: DataFrame) -> DataFrame:
    """Counts, cost and audit of each conversation from its segments and the parts of its audit."""
    own = parts.drop("turn", "role", "digest", "copy", "letters").join(
        pieces.select(F.col("at").alias("place"), "cost", "piece"), F.col("at") == F.col("place")
    )
    fields = [c for c in own.columns if c not in ("conv", "place", "at")]
    whole = own.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("at", *fields))).alias("s"))

    def total(field: str) -> Column:
        return F.aggregate("s", F.lit(0).cast("long"), lambda n, x: n + x[field])

    def between(test) -> Column:
        """Neighbouring segments for which the test holds."""
        pairs = F.zip_with("s", F.slice("s", 2, F.size("s")), lambda a, b: F.when(b.isNotNull() & test(a, b), 1).otherwise(0))
        return F.aggregate(pairs, F.lit(0).cast("long"), lambda n, x: n + x)

    first = F.array_min(F.transform("s", lambda x: x["first_turn"]))
    last = F.array_max(F.transform("s", lambda x: x["last_turn"]))
    turns = total("turns") - between(lambda a, b: F.coalesce(a["last_turn"] == b["first_turn"], F.lit(False)))
    broken = between(lambda a, b: ~F.concat(a["last_initial"], b["first_initial"]).isin(*LEGAL))
    return whole.select(
        "conv",
        F.coalesce(last - first + 1 - turns, F.lit(0)).cast("long").alias("gaps"),
        *(total(c).alias(c) for c in ("blank", "duplicate", "truncated")),
        (total("illegal") + broken).alias("illegal"),
        F.col("s")[0]["cost"].alias("cost"),
        F.array_join(F.transform("s", lambda x: x["piece"]), "").alias("audit"),
    )


ROLE_NAMES = {"u": "user", "a": "assistant"}
NO_TEXT = hashlib.sha256(b"").hexdigest()


def repaired_hashes(rows: DataFrame, parts: DataFrame, pieces: DataFrame) -> DataFrame:
    """``conv`` and ``sha256`` of the repaired conversation. Rows and parts of audits are one stream in
    the order of the rows; a part comes no later than its first row."""
    texts = rows.select("conv", "turn", "role", _digest().alias("digest"), "copy", F.lit(None).cast("long").alias("at"), "text")
    audits = parts.select("conv", "turn", "role", "digest", "copy", "at").join(
        pieces.select(F.col("at").alias("place"), F.col("piece").alias("text")), F.col("at") == F.col("place")
    ).drop("place")
    order = ["conv", "turn", "role", "digest", "copy", F.col("at").asc_nulls_last()]
    stream = audits.unionByName(texts).repartition("conv").sortWithinPartitions(*order).select("conv", "role", "at", "text")

    def hashed(batches):
        now, digest, state, audit, nothing, kind = None, None, START, [], True, None

        def put(role: str, text: str) -> None:
            nonlocal nothing
            digest.update((role if nothing else "\n" + role).encode() + b":" + text.encode())
            nothing = False

        def inserted():
            nonlocal state
            while audit and audit[-1] == "I":
                audit.pop()
                put(ROLE_NAMES[MADE[state]], "")
                state = NEXT[state, MADE[state]]

        def finish():
            inserted()
            return now[0], digest.hexdigest()

        for batch in batches:
            done, kind = [], batch.schema.field(0).type
            for conv, role, at, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        done.append(finish())
                    now, digest, state, audit, nothing = (conv,), hashlib.sha256(), START, [], True
                if at is not None:
                    audit[:0] = text[::-1]  # edits still to come are taken from the end
                    continue
                inserted()
                edit = audit.pop()
                if edit == "K":
                    put(role, text)
                    state = NEXT[state, role[0]]
                elif edit == "R":
                    put(ROLE_NAMES[MADE[state]], text)
                    state = NEXT[state, MADE[state]]
            if done:
                yield _batch(done, [kind, pa.string()], ["conv", "sha256"])
        if now is not None:
            yield _batch([finish()], [kind, pa.string()], ["conv", "sha256"])

    return stream.mapInArrow(hashed, f"conv {dict(rows.dtypes)['conv']}, sha256 string")


def audit_conversations(
    conversations: DataFrame,
    damage=damaged,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    segment_rows: int = 65_536,
) -> DataFrame:
    """``conv_id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit`` and
    ``repaired_sha256`` of every conversation. ``damage`` takes and gives rows ``conv``, ``turn``, ``role``,
    ``text`` and adds ``copy``; ``undamaged`` leaves them as they are."""
    raw = conversations.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")
    )
    rows = damage(raw)
    narrow = lettered(rows).withColumn("row", F.monotonically_increasing_id())
    placed = in_order(narrow, "conv", "turn", "role", "digest", "copy", "row").drop("row")
    firsts = placed.groupBy("conv", "digest").agg(F.min("at").alias("first")).select("first")
    met = placed.join(firsts, F.col("at") == F.col("first"), "left")
    parts = stage(segments(met, segment_rows), "segments")
    pieces = stage(solve(parts), "audit-pieces")
    hashes = repaired_hashes(rows, parts, pieces).withColumnRenamed("conv", "hashed")
    counted = summaries(parts, pieces).withColumnRenamed("conv", "counted")
    everything = raw.select("conv").distinct()
    joined = everything.join(counted, F.col("conv").eqNullSafe(F.col("counted")), "left").join(
        hashes, F.col("conv").eqNullSafe(F.col("hashed")), "left"
    )
    return joined.select(
        F.col("conv").alias("conv_id"),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.lit(NO_TEXT)).alias("repaired_sha256"),
    )


def undamaged(rows: DataFrame) -> DataFrame:
    space = F.lit(" ")
    return rows.select("conv", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), F.lit(0).alias("copy"))
