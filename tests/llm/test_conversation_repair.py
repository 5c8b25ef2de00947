"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from contentloom.llm import conversation_repair as cr
from contentloom.llm.queries import QUERIES

COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
FITS = re.compile(r"(s?(ua)+)?")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_repair(rows):
    """Cost, audit and repaired lines of rows (role, text, fault): all edits, from the last row back."""
    best = {}

    def search(at, state):
        """Least (cost, audit, lines) from here; the state is what has been made, as far as it matters."""
        if (at, state) in best:
            return best[at, state]
        found = []
        if at == len(rows):
            found = [(0, "", ())] if FITS.fullmatch(state) else []
            # At most an answer or a pair can be missing at the end.
            if state[-1:] == "u":
                found.append((5, "I", ("assistant:",)))
            elif state:
                found.append((10, "II", ("user:", "assistant:")))
        else:
            for inserts in range(4):
                now, lines = state, []
                for _ in range(inserts):
                    role = "assistant" if now[-1:] == "u" else "user"
                    now, lines = now[-1:] + role[0], [*lines, role + ":"]
                role, text, fault = rows[at]
                options = [("D", 2, now, [])]
                if fault not in ("blank", "duplicate"):
                    extra = 5 if fault == "truncated" else 0
                    options += [("K", extra, now + role[:1], [f"{role}:{text}"])] if role[:1] in tuple("sua") else []
                    options += [("R", 1 + extra, now + r[0], [f"{r}:{text}"]) for r in ("user", "assistant")]
                for edit, cost, then, made in options:
                    if not legal(then):
                        continue
                    rest = search(at + 1, then[-2:] if len(then) > 1 else then)
                    if rest:
                        found.append((5 * inserts + cost + rest[0], "I" * inserts + edit + rest[1], (*lines, *made, *rest[2])))
        best[at, state] = min(found, default=None)
        return best[at, state]

    def legal(made):
        """Neighbours fit, and the first of all is not an answer."""
        return made != "a" and all(a + b in ("su", "ua", "au") for a, b in zip(made, made[1:], strict=False))

    return search(0, "")


def plain_audit(rows):
    by_conv = defaultdict(list)
    everyone = {r[0] for r in rows}
    for row in plain_damage(rows):
        by_conv[row[0]].append(row)
    out = []
    for conv in everyone:
        own = sorted(by_conv[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], digest(r)))
        seen, faults = set(), []
        for _, _, role, text in own:
            shown = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "" if shown[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = {t for _, t, _, _ in own if t is not None}
        initials = [r[:1] for _, _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, lines = plain_repair([(r, t, f) for (_, _, r, t), f in zip(own, faults, strict=True)])
        out.append((
            conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"),
            faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def digest(row):
    return hashlib.md5(f"{len(row[2])}:{row[2]}{row[3]}".encode()).digest()


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def enumerated(letters):
    """Every sequence of edits with at most two inserts in a row, in order of cost and audit."""
    best = {(0, cr.START): (0, "")}
    frontier = best
    for at in range(len(letters) + 1):
        here = dict(frontier)
        for _ in range(3):
            for state, value in [(s, v) for (k, s), v in list(here.items()) if k == at]:
                to, new = cr.NEXT[state, cr.MADE[state]], (value[0] + 5, value[1] + "I")
                if new < here.get((at, to), (9**9, "")):
                    here[at, to] = new
        frontier = {}
        if at == len(letters):
            return min(v for (_, s), v in here.items() if s in cr.ENDS)
        for (_, state), (cost, audit) in here.items():
            for edit, step, to in cr.edges_of(letters[at], state):
                new = (cost + step, audit + edit)
                if new < frontier.get((at + 1, to), (9**9, "")):
                    frontier[at + 1, to] = new


def test_search_gives_the_least_audit():
    rng = random.Random(5)
    for n in list(range(9)) * 60:
        letters = "".join(rng.choice("sssuuuaaaxSUAX-") for _ in range(n))
        want = enumerated(letters)
        assert cr.repair(letters) == want, letters
        for size in (1, 2, 3):
            parts = [letters[k : k + size] for k in range(0, n, size)]
            if parts:
                tables = [cr.segment_table(p, k == 0, k == len(parts) - 1) for k, p in enumerate(parts)]
                cost, pieces = cr.repair_chain(tables)
                assert (cost, "".join(pieces)) == want, (letters, size)
                assert all(sum(c != "I" for c in x) == len(p) for x, p in zip(pieces, parts, strict=True))


def made_rows():
    rng, rows = random.Random(3), []
    for conv in range(60):
        for turn in range(rng.choice([1, 1, 2, 3, 5, 9])):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            rows.append((conv, turn * rng.choice([1, 1, 3]), role, rng.choice(["Yes.", "No", "Why? ", " \t\n", "", None, "So!", "é\U0001f600."])))
    rows += [(None, t, "user", "A null conversation.") for t in (None, 2, 2, 5)] + [(70, None, "user", "Hm."), (70, None, "assistant", "Ah.")]
    rows += [(80, t, ("user", "assistant")[t % 2], f"Turn {t % 40}.") for t in range(500)]
    return rows


@pytest.mark.parametrize("segment_rows", [1, 7, 65_536])
def test_made_conversations(spark, segment_rows):
    rows = made_rows()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn int, role string, text string, conv int, digest string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = rows_of(cr.audit_conversations(df.repartition(3), segment_rows=segment_rows))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == plain_audit(rows)
    assert cr.audit_conversations(df.limit(0)).count() == 0


def test_undamaged(spark):
    rows = [(1, 0, "user", "Hello."), (1, 1, "assistant", "Good day.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (row,) = cr.audit_conversations(df, damage=cr.undamaged).collect()
    assert (row.cost, row.audit, row.illegal) == (0, "KK", 0)
    assert row.repaired_sha256 == hashlib.sha256(b"user:Hello.\nassistant:Good day.").hexdigest()


def test_query(spark):
    data = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{data}/conversations.parquet'").fetchall()
    got = QUERIES["op13_conversation_repair"](spark, data)
    assert sorted(got.columns) == sorted(COLUMNS)
    assert rows_of(got) == plain_audit(rows)
