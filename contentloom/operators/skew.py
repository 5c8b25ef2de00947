"""Joins and ranks that hold when one key owns a large part of all rows."""

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window, functions as F

from contentloom.session import stage


def _parts(rows: DataFrame) -> int:
    """Pieces that rows are dealt in: two to a shuffle partition, so that a piece is never most of one."""
    return 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(rows: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """Keys that own more than one of ``parts`` equal pieces of all rows, with ``salts``, the pieces
    that their rows make.

    There are fewer than ``parts`` such keys whatever the size of the data, so the result
    may be broadcast.
    """
    parts = parts or _parts(rows)
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    piece = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).scalar() / parts
    hot = counts.where(F.col("n") > piece)
    return hot.select(F.col(key).alias("hot_key"), F.ceil(F.col("n") / piece).cast("int").alias("salts"))


def skew_join(
    rows: DataFrame, lookup: DataFrame, key: str, how: str = "inner", spread: Column | None = None, parts: int | None = None
) -> DataFrame:
    """Join many ``rows`` to a ``lookup`` that has each key once.

    Rows of a hot key are spread over salts, as many as its share of all rows asks for, and only its
    lookup row is repeated. ``how`` is ``inner`` or ``left``. ``rows`` is read twice, so it should be
    cheap to read or staged.
    """
    return _salted_join(rows, lookup, key, how, spread, hot_keys(rows, key, parts))


def settled_join(
    rows: DataFrame, lookup: DataFrame, key: str, how: str = "inner", spread: Column | None = None, parts: int | None = None
) -> DataFrame:
    """``skew_join`` for plans that are built in steps: the hot keys are counted at once, by a job that
    reads the keys of ``rows`` only, and stand in the plan as constants (there are fewer than
    ``parts``). So ``rows`` and ``lookup`` are each in the plan once, however often the result is
    read, and where no key is hot the join is a plain one. ``rows`` should be a table.
    """
    found = hot_keys(rows, key, parts).collect()
    if not found:
        return rows.join(lookup, key, how)
    known = F.array(*(F.struct(F.lit(k).alias("hot_key"), F.lit(n).alias("salts")) for k, n in found))
    return _salted_join(rows, lookup, key, how, spread, rows.sparkSession.range(1).select(F.inline(known)))


def _salted_join(rows: DataFrame, lookup: DataFrame, key: str, how: str, spread: Column | None, hot: DataFrame) -> DataFrame:
    taken = {*rows.columns, *lookup.columns}
    hot_key, salts, salt = (unused_name(taken, n) for n in ("hot_key", "salts", "salt"))
    hot = F.broadcast(hot.toDF(hot_key, salts))
    spread = F.xxhash64(*rows.columns) if spread is None else spread
    plain = F.col(hot_key).isNull()
    salted = (
        rows.join(hot, F.col(key) == F.col(hot_key), "left")
        .withColumn(salt, F.when(plain, 0).otherwise(F.pmod(spread, F.col(salts))).cast("int"))
        .drop(hot_key, salts)
    )
    spread_lookup = (
        lookup.join(hot, F.col(key) == F.col(hot_key), "left")
        .withColumn(salt, F.explode(F.when(plain, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col(salts) - 1))))
        .drop(hot_key, salts)
    )
    return salted.join(spread_lookup, [key, salt], how).drop(salt)


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """Rows as a stage table with the number of each, which every later read sees the same."""
    return stage(rows.withColumn(name, F.monotonically_increasing_id()), "numbered")


def unused_name(taken: Collection[str], name: str = "row") -> str:
    while name in taken:
        name += "_"
    return name


def in_order(rows: DataFrame, *order: str | Column, at: str = "at") -> DataFrame:
    """Rows as a stage table in order, each with its place ``at``: places rise with the order, and
    follow each other within a stretch (``at >> 33``), a range of the order that one task sorted.

    Rows that are equal in all of ``order`` share a range, so the order should end in a number of
    the row where many may be.
    """
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return stage(sorted_rows.withColumn(at, F.monotonically_increasing_id()), "in-order")


def place_ranks(placed: DataFrame, group: str, at: str = "at") -> DataFrame:
    """Add ``rank`` (from 1) and ``size`` of the row's group to rows of ``in_order``, whose order has
    the group first. A range has consecutive rows of a group, so its first place and the number of
    rows in the ranges before give the rank; only these counts are put in order."""
    stretch = F.shiftright(at, 33).alias("stretch")
    sizes = placed.groupBy(F.struct(group).alias("group_key"), stretch).agg(F.count("*").alias("n"), F.min(at).alias("first"))
    before = Window.partitionBy("group_key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "group_key",
        "stretch",
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"),
        F.sum("n").over(Window.partitionBy("group_key")).alias("size"),
    )
    # A struct is never NULL itself, so a NULL group meets its counts by plain equality.
    keyed = placed.withColumn("group_key", F.struct(group)).withColumn("stretch", stretch)
    met = keyed.join(offsets, ["group_key", "stretch"])
    return met.select(*placed.columns, (F.col(at) + F.col("shift")).alias("rank"), F.col("size").cast("long").alias("size"))


def group_rank(rows: DataFrame, group: list[str], order: list[str], row: str | None = None) -> DataFrame:
    """Add ``rank`` (from 1) and ``size`` of each row's group, in the order given.

    Group, order columns and a number of the row are put in ranges of all of them, so a group of any
    size is cut wherever it takes, even where all its places are equal; ranks are then counted by
    range and joined back by the row's number. ``row`` names the column that numbers the rows of a
    table; without it they are numbered, and so written, first.
    """
    name = row or unused_name(rows.columns)
    table = rows if row else numbered(rows, name)
    narrow = table.select(F.struct(*group).alias("g"), *(F.col(c).alias(f"o{k}") for k, c in enumerate(order)), F.col(name).alias("r"))
    places = in_order(narrow, "g", *(f"o{k}" for k in range(len(order))), "r").select("g", "r", "at")
    ranks = place_ranks(places, "g").select(F.col("r").alias(name), "rank", "size")
    return table.join(ranks, name).select(*rows.columns, "rank", "size")
