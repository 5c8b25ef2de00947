"""URL rules and the link graph against plain walks and against the registered SQL."""

import math
import os
import random
import re
from collections import defaultdict

import duckdb

from contentloom.llm import link_trust
from contentloom.llm.queries import ORACLES, QUERIES, URL_RULES

SCHEMA = "page_id long, url string, html string, host string, walk string"


def split(url):
    match = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(c.lower() if "A" <= c <= "Z" else c for c in match[1]), match[2]) if match else ("", "")


def rule_of(host, path):
    fits = [(len(r), r, v) for v, r in URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/"):])]
    return max(fits)[1:] if fits else (None, None)


def plain(pages):
    judged, edges = [], defaultdict(int)
    counts = defaultdict(lambda: {"allow": 0, "block": 0, None: 0})
    for page_id, url, html in pages:
        host, path = split(url)
        rule, verdict = rule_of(host, path)
        judged.append((page_id, host, path, rule, verdict))
        if host:
            counts[host][verdict] += 1
            for target in {h.lower() for h in re.findall(r"""(?i)<a\s[^>]*?\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'>\s]+)""", html or "")}:
                if target != host:
                    edges[host, target] += 1
    scores = {}
    for walk in ("allow", "block"):
        seeds = [h for h, n in counts.items() if 2 * n[walk] > sum(n.values())]
        mass = {h: link_trust.START // len(seeds) for h in seeds}
        ways = edges if walk == "allow" else {(b, a): n for (a, b), n in edges.items()}
        total = defaultdict(int)
        for (a, _), n in ways.items():
            total[a] += n
        score = defaultdict(int)
        for _ in range(link_trust.ROUNDS + 1):
            moved = defaultdict(int)
            for h, m in mass.items():
                score[h] += m
            for (a, b), n in ways.items():
                if a in mass:
                    moved[b] += math.floor(mass[a] * link_trust.DAMPING * (n / total[a]))
            mass = {h: m for h, m in moved.items() if m}
        scores[walk] = score
    out = []
    for page_id, host, path, rule, verdict in judged:
        trust, distrust = (scores[w].get(host, 0) for w in ("allow", "block"))
        by_links = "block" if distrust > (trust + distrust) * 0.5 else "allow"
        out.append((page_id, host, path, rule, verdict or by_links, trust, distrust))
    return sorted(out, key=repr)


def made_pages():
    rng, pages = random.Random(2), []
    hosts = [f"h{i}.{end}" for i in range(12) for end in ("org", "net", "example.net", "com", "example.com")] + ["Hub.ORG"]
    for k in range(700):
        host = "Hub.ORG" if k % 3 == 0 else rng.choice(hosts)
        links = "".join(
            rng.choice([f'<a href="https://{t}/x">t</a>', f"<A class=b HREF = '//{t.upper()}?q'>", "<a href=/own>o</a>", f"<p>https://{t}/</p>"])
            for t in rng.choices(hosts, k=rng.randrange(5))
        )
        path = rng.choice(["/fr/1", "/en/2", "/de/3", "/", "", "/en"])
        pages.append((k, f"{rng.choice(['http', 'https'])}://{host}{path}{rng.choice(['', '?a=/fr/', '#b', '://x/de/'])}", links))
    return [*pages, (None, "http://h1.org/fr/", None), (701, None, '<a href="//h1.net">'), (702, "no address", ""), (703, "x://", ""), (703, "x://", "")]


def rows_of(df, *names):
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


def test_made_pages(spark):
    pages = made_pages()
    df = spark.createDataFrame([(*p, "clash", "clash") for p in pages], SCHEMA)
    names = ("page_id", "host", "path", "rule", "verdict", "trust", "distrust")
    want = plain(pages)
    for edges_at_once in (link_trust.EDGES_AT_ONCE, 3):
        assert rows_of(link_trust.judge(df, URL_RULES, edges_at_once=edges_at_once), *names) == want
    by_links = {r[4] for r in want if r[3] is None and r[5] and r[6]}
    assert by_links == {"allow", "block"}


def test_sql_of_made_pages(spark, tmp_path):
    pages = made_pages()
    df = spark.createDataFrame([(*p, "clash", "clash") for p in pages], SCHEMA)
    df.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    names = ("page_id", "host", "path", "rule", "verdict")
    got = rows_of(QUERIES["op12_link_trust"](spark, os.fspath(tmp_path)), *names)
    want = sorted(duck.execute(f"SELECT {', '.join(names)} FROM ({ORACLES['op12_link_trust']})").fetchall(), key=repr)
    assert got == want == sorted((r[:5] for r in plain(pages)), key=repr)


def test_nothing_to_walk(spark):
    df = spark.createDataFrame([(1, "http://a.com/", "", "", "")], SCHEMA)
    assert rows_of(link_trust.judge(df, URL_RULES), "verdict", "trust", "distrust") == [("allow", 0, 0)]
    assert link_trust.judge(df.limit(0), URL_RULES).count() == 0
    assert rows_of(link_trust.judge(df, [("block", "a.com/"), ("allow", "com/")]), "rule", "verdict") == [("a.com/", "block")]
