import random

from pyspark.sql import functions as F

from contentloom.operators.items import finish_items, limit_items, run_summary, within_limit
from contentloom.operators.skew import group_rank, hot_keys, in_order, settled_join, skew_join
from contentloom.sources.pages import one_per_key
from suite.base import expr

ITEM = (
    "source_id long, page_seq long, item_seq long, source string, is_file boolean, force_content_type string,"
    " max_items int, content string, content_type string"
)


def _items(spark, sources):
    """Sources as (id, max_items, contents), two items to a page."""
    rows = []
    for sid, limit, contents in sources:
        rows += [(sid, i // 2, i % 2, "http://x", False, None, limit, c, "blog") for i, c in enumerate(contents)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, ITEM).repartition(5)


def _kept(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.source_id, r.page_seq, r.item_seq)):
        got.setdefault(r.source_id, []).append(r.page_seq * 2 + r.item_seq)
    return got


def test_limits(spark):
    limits = {1: None, 2: 0, 3: 2, 4: 100, 5: -2, 6: -5, 7: -9}
    items = _items(spark, [(k, n, list("abcde")) for k, n in limits.items()])
    assert _kept(limit_items(items)) == {
        k: kept for k, n in limits.items() if (kept := list(range(5))[: n] if n else list(range(5)))
    }


def test_limit_comes_before_the_empty_filter(spark):
    items = _items(spark, [(1, 2, ["", "b", "c"]), (2, 0, ["", "b"])])
    assert _kept(finish_items(items)) == {1: [1], 2: [1]}
    got = {r.source_id: r for r in run_summary(items).collect()}
    assert (got[1].found, got[1].limited, got[1].written, got[1].skipped) == (3, 2, 1, 1)
    assert got[1].content_type == "blog"


def test_summary_of_a_source_whose_items_are_all_cut(spark):
    (row,) = run_summary(_items(spark, [(1, -5, ["a", "b"])])).collect()
    assert (row.found, row.limited, row.written, row.content_type) == (2, 0, 0, None)


def test_within_limit_without_setting(spark):
    df = spark.range(3).select((F.col("id") + 1).alias("rank"), F.lit(3).alias("size"), F.lit(None).cast("int").alias("n"))
    assert df.where(within_limit(F.col("rank"), F.col("size"), F.col("n"))).count() == 3


def test_group_rank_of_a_hot_group(spark):
    # Two thirds of all rows are in one group, which spans many ranges.
    df = spark.range(6000).select(
        F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 50).alias("g"), F.col("id").alias("a"), (-F.col("id")).alias("b")
    )
    got = group_rank(df, ["g"], ["a", "b"]).collect()
    groups = {}
    for r in sorted(got, key=lambda r: r.a):
        groups.setdefault(r.g, []).append(r)
    assert len(got) == 6000
    for rows in groups.values():
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
        assert {r["size"] for r in rows} == {len(rows)}


def test_group_rank_of_one_place_and_null_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (7, 1)], "g int, a int")
    got = {(r.g, r.a): (r["rank"], r["size"]) for r in group_rank(df, ["g"], ["a"]).collect()}
    assert got == {(None, 1): (1, 2), (None, 2): (2, 2), (7, 1): (1, 1)}
    big = spark.createDataFrame([(1, None), (1, 2**62), (1, 2**62 + 1), (1, -5)], "g int, a long")
    got = {r.a: r["rank"] for r in group_rank(big, ["g"], ["a"]).collect()}
    assert got == {None: 1, -5: 2, 2**62: 3, 2**62 + 1: 4}
    assert group_rank(df.limit(0), ["g"], ["a"]).count() == 0


def test_a_group_of_one_place_is_spread_over_tasks(spark):
    # A third of all rows belongs to one source, all on page 0 and of the same item number.
    rows = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("g"), F.lit(0).alias("a"), F.lit(0).alias("row"), "id"
    )
    # Spark would put so few rows into one range.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = in_order(rows, "g", "a", "id").where("g = -1")
        ranked = group_rank(rows, ["g"], ["a"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by_range = [r["count"] for r in placed.groupBy(F.shiftright("at", 33)).count().collect()]
    assert sum(by_range) == 3000 and len(by_range) >= 3 and max(by_range) < 1800
    assert ranked.columns == ["g", "a", "row", "id", "rank", "size"]
    assert sorted(r["rank"] for r in ranked.where("g = -1").collect()) == list(range(1, 3001))


def test_skew_join_equals_a_plain_join(spark):
    rows = spark.range(5000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 400)).alias("k")
    )
    lookup = spark.range(300).select(F.concat(F.lit("k"), "id").alias("k"), "id").withColumnRenamed("id", "v").union(
        spark.createDataFrame([("hot", -1), ("unused", -2)], "k string, v long")
    )
    assert [r.hot_key for r in hot_keys(rows, "k").collect()] == ["hot"]
    for how in ("inner", "left"):
        for parts in (None, 1000):
            want = sorted(map(tuple, rows.join(lookup, "k", how).select("id", "k", "v").collect()), key=str)
            for join in (skew_join, settled_join):
                met = join(rows, lookup, "k", how, parts=parts)
                assert met.columns == ["k", "id", "v"]
                assert sorted(map(tuple, met.select("id", "k", "v").collect()), key=str) == want


def test_settled_join_reads_each_side_once(spark, tmp_path):
    spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN -1 ELSE id END AS k").write.parquet(f"{tmp_path}/rows")
    spark.range(-1, 3000).selectExpr("id AS k", "id * 2 AS v").write.parquet(f"{tmp_path}/lookup")
    rows, lookup = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("rows", "lookup"))
    # One hot key is salted; without one the join is plain.
    for part, salted in ((rows, True), (rows.where("k >= 0"), False), (rows.where("id < 0"), False)):
        met = settled_join(part, lookup, "k", "left")
        plan = met._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parquet") == 2
        assert ("salt" in plan) == salted
        assert met.where("v = 2 * k").count() == met.count() == part.count()
    nulls = rows.selectExpr("id", "CASE WHEN id % 2 = 0 THEN k END AS k")
    assert settled_join(nulls, lookup, "k", "left").where("k IS NULL AND v IS NULL").count() == 1500
    quoted = rows.select("id", F.concat(F.lit("it's \\ \""), "k").alias("k"))
    assert settled_join(quoted, quoted.groupBy("k").count(), "k").count() == 3000


def test_salts_follow_a_key_s_share(spark):
    # One key owns a third of all rows, ten own a three-hundredth, the others one row each.
    share = F.when(F.col("id") % 3 == 0, -1).when(F.col("id") % 30 < 2, -2 - F.col("id") % 300 % 10).otherwise(F.col("id"))
    rows = spark.range(30_000).select(share.alias("k"))
    counts = {r.k: r["count"] for r in rows.groupBy("k").count().collect()}
    found = {r.hot_key: r.salts for r in hot_keys(rows, "k", parts=400).collect()}
    assert found == {k: -(-n * 400 // 30_000) for k, n in counts.items() if n * 400 > 30_000}
    assert found[-1] == 134 and all(n >= 2 for n in found.values()) and len(found) > 1
    # No piece of a key is larger than a part, but for chance.
    salted = rows.where("k = -1").select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(134)).alias("s"))
    assert salted.groupBy("s").count().agg(F.max("count")).first()[0] < 3 * 30_000 / 400


def test_hot_key_count_is_bounded(spark):
    rows = spark.range(10_000).select((F.col("id") % 10).alias("k"))
    assert hot_keys(rows, "k", parts=256).count() == 10
    assert hot_keys(spark.range(10_000).select(F.col("id").alias("k")), "k").count() == 0
    assert hot_keys(rows.limit(0), "k").count() == 0


def test_one_per_key_keeps_the_lowest_id(spark):
    rows = spark.range(1000).select(
        F.col("id").alias("page_id"), F.when(F.col("id") % 2 == 0, "same").otherwise(F.concat(F.lit("u"), "id")).alias("url_key")
    )
    got = {r.page_id for r in one_per_key(rows).collect()}
    assert got == {0} | set(range(1, 1000, 2))


def test_shared_expressions_read_the_same_in_both_engines(spark):
    import duckdb

    sql = "concat(lpad(cast(7 % 4 AS string), 3, '0'), split_part('a#b', '#', 1), repeat('x', 2))"
    assert spark.range(1).select(expr(sql)).first()[0] == duckdb.sql(f"SELECT {sql}").fetchall()[0][0]
