"""Token counts by an exact length histogram.

Documents are encoded and only their lengths are kept. Rows of equal length are added up, so what
is left has a row for each length that occurs, however many documents there are. Sums over the
longer lengths answer, for any context limit, how many tokens a corpus has when every document is
cut at the limit, how many documents are cut, and which length a quantile has.

Sums run over stretches of lengths first and over the stretches' totals then, so no task sorts
more than one stretch, whatever the longest document is.

Defined cases: a null or empty text has length 0. Repeated rows count each time, ids are not
looked at. An empty table gives an empty histogram, and answers of 0 (quantiles: null).
"""

from pyspark.sql import DataFrame, Window, functions as F

from contentloom.llm.tokens import token_counts
from contentloom.session import stage

STRETCH = 4096


def histogram(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``tokens`` and ``docs``: how many documents have that length."""
    return token_counts(docs, path, id_col, text_col).groupBy("tokens").agg(F.count("*").alias("docs"))


def suffix_sums(lengths: DataFrame) -> DataFrame:
    """For each length L that occurs, as a context limit:

    ``docs``, ``docs_longer`` (than L), ``docs_up_to``, ``tokens_up_to`` (tokens of documents of at
    most L), ``tokens_total`` and ``tokens_truncated`` (all documents, each cut at L), and
    ``quantile`` (share of documents of at most L).
    """
    rows = lengths.withColumn("stretch", F.floor(F.col("tokens") / STRETCH)).withColumn(
        "mass", F.col("tokens") * F.col("docs")
    )
    later = Window.orderBy(F.col("stretch").desc()).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("stretch").agg(F.sum("docs").alias("docs"), F.sum("mass").alias("mass"))
    beyond = totals.select(
        "stretch",
        F.coalesce(F.sum("docs").over(later), F.lit(0)).alias("docs_beyond"),
        F.coalesce(F.sum("mass").over(later), F.lit(0)).alias("mass_beyond"),
        F.sum("docs").over(Window.partitionBy()).alias("docs_total"),
        F.sum("mass").over(Window.partitionBy()).alias("tokens_total"),
    )
    longer = Window.partitionBy("stretch").orderBy(F.col("tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("docs_after", F.coalesce(F.sum("docs").over(longer), F.lit(0))).withColumn(
        "mass_after", F.coalesce(F.sum("mass").over(longer), F.lit(0))
    )
    met = own.join(beyond, "stretch")
    docs_longer = F.col("docs_after") + F.col("docs_beyond")
    tokens_up_to = F.col("tokens_total") - F.col("mass_after") - F.col("mass_beyond")
    return met.select(
        F.col("tokens").alias("context_limit"),
        "docs",
        docs_longer.alias("docs_longer"),
        (F.col("docs_total") - docs_longer).alias("docs_up_to"),
        tokens_up_to.alias("tokens_up_to"),
        "tokens_total",
        (tokens_up_to + docs_longer * F.col("tokens")).alias("tokens_truncated"),
        ((F.col("docs_total") - docs_longer) / F.col("docs_total")).alias("quantile"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """Answers for any context limits, met by a document or not: ``context_limit``,
    ``docs_longer``, ``tokens_truncated``. The histogram is read once for all of them."""
    limit = F.explode(F.array(*(F.lit(int(k)).cast("long") for k in limits))).alias("limit")
    asked = sums.sparkSession.range(1).select(limit).distinct()
    each = sums.select("context_limit", "docs", limit)
    answers = each.groupBy("limit").agg(
        F.sum(F.when(F.col("context_limit") > F.col("limit"), F.col("docs")).otherwise(0)).alias("docs_longer"),
        F.sum(F.least("context_limit", "limit") * F.col("docs")).alias("tokens_truncated"),
    )
    return asked.join(answers, "limit", "left").select(
        F.col("limit").alias("context_limit"),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("docs_longer", "tokens_truncated")),
    )


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """``share`` and ``length``: the smallest length that at least this share of the documents do
    not exceed."""
    share = F.explode(F.array(*(F.lit(float(q)) for q in shares))).alias("share")
    met = sums.select("context_limit", "quantile", share).where("quantile >= share")
    asked = sums.sparkSession.range(1).select(share)
    return asked.join(met.groupBy("share").agg(F.min("context_limit").alias("length")), "share", "left")


def length_answers(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``suffix_sums`` of the documents' histogram, which is staged: it is read more than once."""
    return suffix_sums(stage(histogram(docs, path, id_col, text_col), "lengths"))
