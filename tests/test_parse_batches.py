"""What a parse task holds at once."""

from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import functions as F, types as T

from contentloom.operators import dom
from contentloom.sources.pages import PARSE_TASKS, met_pages, page_facts, page_nodes

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("html", T.StringType())])


def _parsed(htmls, *more):
    """Batches that a task gives for batches of pages."""
    taken = []
    dom.dom_nodes(SimpleNamespace(schema=PAGES, mapInArrow=lambda parse, schema: taken.append(parse)))
    batches = [pa.record_batch({"page_id": pa.array(range(len(h)), pa.int64()), "html": pa.array(h, pa.string())}) for h in (htmls, *more)]
    return list(taken[0](iter(batches)))


def test_a_batch_is_given_out_by_its_events():
    page = "<p>x<br>y" * 500
    given = _parsed([page] * 100)
    events = [len(b.column("nodes").flatten()) for b in given]
    one = len(_parsed([page])[0].column("nodes").flatten())
    assert sum(events) == 100 * one
    assert max(events) < dom.CHUNK_EVENTS + one
    assert [i for b in given for i in b.column("page_id").to_pylist()] == list(range(100))


def test_batches_without_pages_or_events():
    given = _parsed([], [None, "", "<p>a"], [None] * 5000)
    nodes = [n for b in given for n in b.column("nodes").to_pylist()]
    assert nodes[0] is None and nodes[1] == [] and [e["tag"] for e in nodes[2]] == ["p", "#text", "/p"]
    assert nodes[3:] == [None] * 5000
    assert sum(b.num_rows for b in given) == 5003


def test_pages_of_one_small_file_are_parsed_by_many_tasks(spark, tmp_path):
    spark.range(2000).selectExpr("id AS page_id", "concat('<p>', id) AS html").coalesce(1).write.parquet(str(tmp_path / "pages"))
    setting = spark.conf.get(PARSE_TASKS)
    spark.conf.unset(PARSE_TASKS)
    try:
        nodes = page_nodes(spark.read.parquet(str(tmp_path / "pages")), "page_id")
        tasks = nodes.select(F.spark_partition_id().alias("task"), "page_id", F.size("nodes").alias("n")).collect()
    finally:
        spark.conf.set(PARSE_TASKS, setting)
    assert sorted(r.page_id for r in tasks) == list(range(2000)) and {r.n for r in tasks} == {3}
    assert len({r.task for r in tasks}) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_met_pages_of_one_small_file_are_parsed_by_many_tasks(spark, tmp_path):
    url = "concat('https://x.io/', id % 1900)"
    crawl = spark.range(2000).selectExpr("id AS page_id", f"{url} AS url", f"{url} AS url_key", "concat('<p>', id) AS html")
    crawl.coalesce(1).write.parquet(str(tmp_path / "pages"))
    spark.range(1000, 1900).selectExpr(f"{url} AS url_key").write.parquet(str(tmp_path / "keys"))
    setting = spark.conf.get(PARSE_TASKS)
    spark.conf.unset(PARSE_TASKS)
    try:
        met = met_pages(spark.read.parquet(str(tmp_path / "pages")), spark.read.parquet(str(tmp_path / "keys")))
        facts = page_facts(met, "h1", deal=False).select(F.spark_partition_id().alias("task"), "page_id").collect()
    finally:
        spark.conf.set(PARSE_TASKS, setting)
    assert sorted(r.page_id for r in facts) == list(range(1000, 1900))
    assert len({r.task for r in facts}) == int(spark.conf.get("spark.sql.shuffle.partitions"))
