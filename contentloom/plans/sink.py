"""Where finished items go."""

from pyspark.sql import Column, DataFrame, functions as F

from contentloom.operators.skew import group_rank
from contentloom.schemas import ITEM_FIELDS, POSITION_FIELDS
from contentloom.session import stage


def item_struct() -> Column:
    return F.struct(*[F.col(c) for c in ITEM_FIELDS])


def sink_rows(items: DataFrame) -> DataFrame:
    """Items as they are written: by team and run, each run in order. Files are ranges of that
    order, so a run of any length is spread over as many as it takes."""
    order = ["team_id", *POSITION_FIELDS]
    return items.select(*order, *ITEM_FIELDS).repartitionByRange(*order).sortWithinPartitions(*order)


def write_items(items: DataFrame, path: str, run: str | None = None) -> None:
    """JSON lines by team. Items keep their run and their place in it.

    Without ``run`` everything at the path is replaced. With the name of a run, files lie in folders
    of their team and this name, and only folders that the run writes to are replaced: writing a run
    again leaves other runs and teams as they are. A team that the run no longer has items for keeps
    what it had.
    """
    rows, folders = sink_rows(items), ["team_id"]
    if run is not None:
        rows, folders = rows.withColumn("run", F.lit(run)), ["team_id", "run"]
    mode = "static" if run is None else "dynamic"
    writer = rows.write.mode("overwrite").partitionBy(*folders).option("partitionOverwriteMode", mode)
    writer.option("ignoreNullFields", "false").json(path)


def envelopes(items: DataFrame, part_items: int | None = None) -> DataFrame:
    """``{team_id, items}`` as JSON, one per run, its items in order.

    A run's envelope is whole. A caller who wants parts of at most ``part_items`` items gets them
    numbered by ``part``; ``items`` are read twice then: stage them if they are costly.
    """
    if part_items:
        ranked = group_rank(items, ["source_id"], ["page_seq", "item_seq"])
        placed = ranked.withColumn("part", F.floor((F.col("rank") - 1) / part_items).cast("long"))
    else:
        placed = items.withColumn("part", F.lit(0).cast("long"))
    entries = F.array_sort(F.collect_list(F.struct("page_seq", "item_seq", item_struct().alias("item"))))
    grouped = placed.groupBy("source_id", "team_id", "part").agg(entries.alias("entries"))
    body = F.struct("team_id", F.transform("entries", lambda e: e["item"]).alias("items"))
    return grouped.select(
        "source_id",
        "team_id",
        "part",
        F.size("entries").cast("long").alias("n_items"),
        F.to_json(body, {"ignoreNullFields": "false"}).alias("envelope"),
    )


def write_envelopes(items: DataFrame, path: str, part_items: int | None = None, by: str = "team_id") -> None:
    """One envelope per line in a folder per team, or per run with ``by="source_id"`` for few runs.
    Parts, if asked for, have folders of their own below that of their run."""
    folders = [by, "source_id", "part"] if part_items and by != "source_id" else [by, "part"] if part_items else [by]
    whole = envelopes(stage(items, "finished-items") if part_items else items, part_items)
    whole.select(*folders, "envelope").write.mode("overwrite").partitionBy(*folders).text(path)
