"""Secret scans with an incremental blob ledger, in DataFrame operations only.

Every version of a text is a blob, named by the SHA-256 of its bytes. The ledger is a folder
with two tables: ``scanned`` (digest, rule, version) and ``findings`` (digest, rule, version,
start, end). A scan takes the pairs of blob and rule version that the ledger lacks, scans each
such blob once however many paths hold it, and adds to the ledger. Findings are joined back to
all paths.

Findings are written before the pairs they come from. A job that is lost in between scans those
blobs again and finds the same; equal findings count once.

A rule's matches are leftmost and do not overlap. Their places come from the pieces between
them: a running sum of lengths, by blob and rule, over the few texts that match at all. A match
whose secret (a group of the pattern) is too short is dropped, and what it covered stays covered.
Places are code points, the end exclusive.

Defined cases: a null text is the empty blob, without findings. Repeated rows, and rows with
equal texts, get equal findings. A null path is a path. Only the path and text columns are read.
"""

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from contentloom.operators.keyfilter import KeyFilter
from contentloom.operators.skew import skew_join
from contentloom.session import stage


@dataclass(frozen=True)
class Rule:
    """``group`` of the match is the secret, of ``least`` characters or more."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1


# The three base rules. A run of letters has the same longest match whether its
# least length is asked for in the pattern or after it; asking in the pattern skips short runs.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    # With the lines of the key, and the last one where it is there.
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\r\n]*+(?:-----END [A-Z ]{0,40}PRIVATE KEY-----)?", version=2),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
RULES = BASE_RULES + MORE_RULES

SCANNED = "digest string, rule string, version int"
FINDINGS = "digest string, rule string, version int, start long, end long"


def digest_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


class Ledger:
    """Two tables in a folder that all executors share; a folder without them is an empty ledger."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def add(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.folder}/{name}")

    def read(self, name: str) -> DataFrame:
        schema = {"scanned": SCANNED, "findings": FINDINGS}[name]
        columns = [f"CAST(NULL AS {c.split()[1]}) AS {c.split()[0]}" for c in schema.split(", ")]
        self.add(name, self.spark.range(0).selectExpr(*columns))
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")


def _key(rule: str, version: str) -> Column:
    return F.concat_ws("@", rule, version)


def _keys(rules: tuple[Rule, ...]) -> Column:
    return F.array(*(F.lit(f"{r.name}@{r.version}") for r in rules))


def _lengths(strings: Column) -> Column:
    return F.transform(strings, lambda s: F.length(s).cast("long"))


def find_spans(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Findings in ``blobs`` (digest, text, todo: keys of the rules to apply)."""
    matches = F.array(
        *(
            F.struct(
                F.lit(r.name).alias("rule"),
                F.lit(r.version).alias("version"),
                F.lit(r.least).alias("least"),
                F.when(
                    F.array_contains("todo", f"{r.name}@{r.version}") & F.rlike("text", F.lit(r.pattern)),
                    F.arrays_zip(
                        _lengths(F.split("text", r.pattern, -1)).alias("gap"),
                        _lengths(F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))).alias("size"),
                        _lengths(F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group))).alias("secret"),
                    ),
                ).alias("matches"),
            )
            for r in rules
        )
    )
    met = blobs.select("digest", F.inline(matches)).where("matches IS NOT NULL")
    each = met.select("digest", "rule", "version", "least", F.posexplode("matches").alias("at", "m")).where(
        "m.size IS NOT NULL"
    )
    until = Window.partitionBy("digest", "rule", "version").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum(F.col("m.gap") + F.col("m.size")).over(until))
    return placed.where("m.secret >= least").select(
        "digest", "rule", "version", (F.col("end") - F.col("m.size")).alias("start"), "end"
    )


def update(docs: DataFrame, digests: DataFrame, ledger: Ledger, rules: tuple[Rule, ...], text_col: str) -> None:
    """Scan the blobs of ``docs`` (``digests`` has their digests) that the ledger lacks."""
    done = ledger.read("scanned").groupBy("digest").agg(F.collect_set(_key("rule", "version")).alias("done"))
    todo = stage(
        digests.distinct()
        .join(done, "digest", "left")
        .select("digest", F.array_except(_keys(rules), F.coalesce("done", F.array().cast("array<string>"))).alias("todo"))
        .where("size(todo) > 0"),
        "unseen",
    )
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("digest", digest_of(F.col("text")))
    # Texts that were scanned before are left out where they are read, and not moved.
    unseen = KeyFilter(todo, "digest").maybe_wanted(texts)
    blobs = unseen.groupBy("digest").agg(F.first("text").alias("text")).join(todo, "digest")
    ledger.add("findings", find_spans(blobs, rules))
    pair = F.split("key", "@")
    ledger.add(
        "scanned",
        todo.select("digest", F.explode("todo").alias("key")).select(
            "digest", pair[0].alias("rule"), pair[1].cast("int").alias("version")
        ),
    )


def scan(
    docs: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES, path_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Scan what the ledger lacks; ``path``, ``digest`` and ``spans`` (start, rank of the rule,
    end, rule; in this order) of every row of ``docs``."""
    paths = stage(docs.select(F.col(path_col).alias("path"), digest_of(F.col(text_col)).alias("digest")), "paths")
    update(docs, paths.select("digest"), ledger, rules, text_col)
    return skew_join(paths, spans_by_blob(ledger, rules), "digest", "left").select(
        "path", "digest", F.coalesce("spans", F.array().cast(SPANS)).alias("spans")
    )


#: What takes the place of a secret.
MARK = "[REDACTED]"
SPANS = "array<struct<start:bigint,rank:int,end:bigint,rule:string>>"


def spans_by_blob(ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``digest`` and ``spans`` of each blob with findings of these rule versions."""
    order = F.create_map(*(F.lit(x) for n, r in enumerate(rules) for x in (r.name, n)))
    found = ledger.read("findings").where(F.array_contains(_keys(rules), _key("rule", "version")))
    span = F.struct("start", order[F.col("rule")].alias("rank"), "end", "rule")
    return found.groupBy("digest").agg(F.array_sort(F.collect_set(span)).cast(SPANS).alias("spans"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    one = F.transform(spans, lambda s: F.concat_ws(":", s["rule"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")


def redacted(text: Column, spans: Column, mark: str = MARK) -> Column:
    """The text with each stretch of spans, overlapping ones as one, replaced by a mark."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("pieces"))

    def step(done: Column, span: Column) -> Column:
        gap = F.substring(text, done["at"].cast("int") + 1, (span["start"] - done["at"]).cast("int"))
        fresh = F.array_append(F.array_append(done["pieces"], gap), F.lit(mark))
        return F.struct(
            F.greatest(done["at"], span["end"]).alias("at"),
            F.when(span["start"] >= done["at"], fresh).otherwise(done["pieces"]).alias("pieces"),
        )

    def close(done: Column) -> Column:
        rest = F.substring(text, done["at"].cast("int") + 1, F.length(text))
        return F.array_join(F.array_append(done["pieces"], rest), "")

    return F.aggregate(spans, start, step, close)


def redact(docs: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """``docs`` with the findings of their texts masked. Texts without findings stay as they are."""
    update(docs, docs.select(digest_of(F.col(text_col)).alias("digest")), ledger, rules, text_col)
    # A text that no pattern matches has no findings and is not moved.
    text = F.coalesce(F.col(text_col), F.lit(""))
    may_match = reduce(or_, (F.rlike(text, F.lit(r.pattern)) for r in rules))
    # The row travels as one column, so its names clash with none.
    rows = docs.where(may_match).select(F.struct(*docs.columns).alias("row"), digest_of(F.col(text_col)).alias("digest"))
    joined = skew_join(rows, spans_by_blob(ledger, rules), "digest", "left")
    text = F.col("row").getField(text_col)
    masked = F.when(F.col("spans").isNull(), text).otherwise(redacted(text, F.col("spans")))
    changed = joined.select(
        *((masked if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns)
    )
    return docs.where(~may_match).unionByName(changed)
