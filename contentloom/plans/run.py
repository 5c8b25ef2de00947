"""One run over a manifest of sources."""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from contentloom.operators.crawl import rejects
from contentloom.operators.items import has_content, judge_items, observed, resolve_types, summary_of
from contentloom.operators.routing import Routes
from contentloom.plans.sites import linkedin_parts, substack_parts
from contentloom.plans.website import Crawl, website_parts
from contentloom.schemas import ITEM_FIELDS, POSITION_FIELDS, check_items, with_run
from contentloom.session import stage
from contentloom.sources.drive import drive_items, exploded_links, first_names, listing_arrays
from contentloom.sources.files import book_items, generic_items, transcript_items
from contentloom.sources.pages import met_pages, page_nodes
from contentloom.sources.reddit import met_threads, thread_items
from contentloom.functions.urls import url_key
from contentloom.operators.skew import numbered, settled_join


@dataclass
class Store:
    """What a run reads instead of the network and the local disk. Any table may be left out.

    ``pages(page_id, url, url_key, html)``, ``threads(json_url, body)``, ``files(path, text)`` (a null
    text could not be read),
    ``book_pages(file, page_no, text)`` for local books and ``drive_pages(url, page_no, text)``
    for downloads.
    """

    pages: DataFrame | None = None
    threads: DataFrame | None = None
    files: DataFrame | None = None
    book_pages: DataFrame | None = None
    drive_pages: DataFrame | None = None

    @property
    def crawl(self) -> Crawl:
        return Crawl(self.pages)


#: Items and rejects of some sources.
Parts = tuple[DataFrame, DataFrame]


def _no_item(rows: DataFrame, where: str, reason: str) -> DataFrame:
    return rejects(rows.withColumn("url", F.col("run.source")), where, reason)


def _file_parts(sources: DataFrame, texts: DataFrame, make, key: str) -> Parts:
    """Texts that no source names are left out first; a path that is stored twice counts once."""
    own = sources.select("source_id", "run", F.col("source").alias(key))
    wanted = texts.join(own.select(key).distinct(), key, "left_semi")
    if key == "path":
        wanted = wanted.groupBy("path").agg(F.min("text").alias("text"))
    stored = wanted.select(key).distinct().join(make(wanted).withColumn("made", F.lit(True)), key, "left")
    met = settled_join(own, stage(stored.withColumn("made", F.coalesce("made", F.lit(False))), "texts"), key, "left")
    items = met.where("made").withColumn("page_seq", F.lit(0)).withColumn("item_seq", F.lit(0))
    lost = _no_item(met.where(F.col("made").isNull()), "file", "not stored").unionByName(
        _no_item(met.where(~F.col("made")), "file", "not UTF-8")
    )
    return items, lost


def _generic_parts(sources: DataFrame, texts: DataFrame) -> Parts:
    is_file = F.coalesce("is_file", F.lit(False))
    items, lost = _file_parts(sources.where(is_file), texts, generic_items, "path")
    return items, lost.unionByName(_no_item(sources.where(~is_file), "file", "not a file"))


def _reddit_parts(sources: DataFrame, threads: DataFrame, unescape: bool) -> Parts:
    met = met_threads(sources, threads, unescape)
    lost = _no_item(met.where(F.col("found").isNull()), "thread", "not stored").unionByName(
        _no_item(met.where(~F.col("found")), "thread", "no comment")
    )
    return thread_items(met), lost


def _drive_parts(sources: DataFrame, store: Store) -> Parts:
    own = sources.select("source_id", "run", F.expr(url_key("source")).alias("url_key"))
    # A source may name the folder in its fragment only, so its key decides and not its address.
    # Keys are narrow; of the crawl, only the listings themselves go through the join.
    wanted = met_pages(store.pages, stage(own.select("url_key").distinct(), "wanted-keys"))
    listings = page_nodes(wanted, "url_key", deal=False)
    # Links are found and made unique once per listing, then handed to its sources.
    read = stage(listings.select("url_key", F.expr(listing_arrays()).alias("links")), "listings")
    links = stage(first_names(exploded_links(read), ["url_key"]), "drive-links")
    named = links.where(~F.col("name").contains("/"))
    books = stage(drive_items(named, store.drive_pages), "books")
    items = settled_join(own, books, "url_key")
    fetched = settled_join(own, read.select("url_key", F.size("links").alias("n")), "url_key", "left")
    lost_links = links.join(books.select("url_key", F.col("source_url").alias("url")), ["url_key", "url"], "left_anti")
    reason = F.when(F.col("name").contains("/"), "name with a slash").otherwise("not stored")
    met_links = settled_join(own, links.withColumn("reason", reason).join(lost_links.select("url_key", "url"), ["url_key", "url"], "left_semi"), "url_key")
    lost = (
        _no_item(fetched.where(F.col("n").isNull()), "listing", "not fetched")
        .unionByName(_no_item(fetched.where("n = 0"), "listing", "no files"))
        .unionByName(met_links.select("source_id", "url", F.lit("download").alias("stage"), "reason"))
    )
    return items, lost


def _builders(store: Store, unescape: bool):
    """Per built-in route: the tables it reads, and how it makes items and rejects of its sources."""
    is_text = F.lower("path").endswith(".txt")
    return {
        "drive": ((store.pages, store.drive_pages), lambda s: _drive_parts(s, store)),
        "website": ((store.pages,), lambda s: website_parts(s, store.crawl)),
        "pdf": ((store.book_pages,), lambda s: _file_parts(s, store.book_pages, book_items, "file")),
        "reddit": ((store.threads,), lambda s: _reddit_parts(s, store.threads, unescape)),
        "substack": ((store.pages,), lambda s: substack_parts(s, store.crawl)),
        "linkedin": ((store.pages,), lambda s: linkedin_parts(s, store.crawl)),
        # The scan leaves out the files that the other of the two routes takes.
        "transcript": ((store.files,), lambda s: _file_parts(s, store.files.where(is_text), transcript_items, "path")),
        "generic": ((store.files,), lambda s: _generic_parts(s, store.files.where(~is_text))),
    }


def route_parts(
    routed: DataFrame, names: set[str], store: Store, routes: Routes, unescape: bool = True
) -> tuple[list[DataFrame], list[DataFrame]]:
    """Items of the named routes, with their place of discovery, and rejects.

    A registered extractor gets its sources and hands on their ``source_id`` and ``run``. Sources
    of a route whose tables the store lacks are rejects.
    """
    builders = _builders(store, unescape)
    items, lost = [], []
    for route in routes.routes:
        if route.name not in names:
            continue
        own = routed.where(F.col("route") == route.name).drop("route")
        if route.extract:
            found = route.extract(own)
        elif all(t is not None for t in builders[route.name][0]):
            found, missed = builders[route.name][1](own)
            lost.append(missed)
        else:
            lost.append(_no_item(own, "store", f"no table for the route {route.name}"))
            continue
        items.append(check_items(found).select(*POSITION_FIELDS, "run.*", *ITEM_FIELDS))
    return items, lost


def _limited() -> Column:
    return F.coalesce(F.col("max_items"), F.lit(0)) != 0


def _present(routed: DataFrame) -> tuple[set[str], bool]:
    """Routes that have sources, and whether a source has a limit. At most one row per route is collected."""
    rows = routed.groupBy("route").agg(F.bool_or(_limited()).alias("limited")).collect()
    return {r["route"] for r in rows}, any(r["limited"] for r in rows)


def _union(parts: list[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


FOUND = "source_id long, page_seq long, item_seq long, source string, is_file boolean, team_id string, " + (
    "force_content_type string, max_items int, " + ", ".join(f"{c} string" for c in ITEM_FIELDS)
)
REJECT = "source_id long, url string, stage string, reason string"


@dataclass
class Run:
    """What a run gives: ``judged``, all items found, with whether their source's limit lets them pass,
    and the rejects (source_id, url, stage, reason): what gave no item, and why."""

    judged: DataFrame
    rejects: DataFrame

    @property
    def found(self) -> DataFrame:
        """All items found before limit and filter."""
        return self.judged.drop("within")

    @property
    def items(self) -> DataFrame:
        """Finished items: within the limit, typed, not empty."""
        return _finished(self.judged)

    def counted_items(self) -> tuple[DataFrame, dict[str, int]]:
        """Finished items, and the counts of the run (found, limited, written, skipped). The judged items
        are written as a table once, and counted on the way; sinks that put items in order read them
        more than once, and read that table then."""
        judged, counts = observed(self.judged)
        self.judged = stage(judged, "judged-items")
        return self.items, counts.get

    def summary(self) -> DataFrame:
        """The counts by source, in one pass over the judged items."""
        return summary_of(self.judged)


def _finished(judged: DataFrame) -> DataFrame:
    done = resolve_types(judged.where("within")).where(has_content(F.col("content")))
    return done.select(*POSITION_FIELDS, "team_id", *ITEM_FIELDS)


def run_all(sources: DataFrame, store: Store, routes: Routes | None = None, unescape: bool = True) -> Run:
    """A manifest routed, extracted, limited, typed and without empty items.

    Stage tables (routed sources, facts of met pages, links between hops, items with a limit) are
    written while the plan is built; ``session.remove_stages`` deletes them once the results are.
    """
    spark, routes = sources.sparkSession, routes or Routes()
    routed = stage(routes.apply(with_run(sources)), "routed")  # each route reads its sources several times
    names, limited = _present(routed)
    parts, lost = route_parts(routed, names, store, routes, unescape)
    judged = _union(parts, spark, FOUND).withColumn("within", F.lit(True))
    if limited:  # ranks read their items twice; those of sources without a limit are never ranked
        ranked = numbered(judged.where(_limited()).drop("within"), "row")
        judged = judged.where(~_limited()).unionByName(judge_items(ranked, "row").drop("row"))
    return Run(judged, _union(lost, spark, REJECT))


def extract(sources: DataFrame, store: Store, routes: Routes | None = None, unescape: bool = True) -> DataFrame:
    """All items found, before limit and filter, with the settings of their run."""
    return run_all(sources, store, routes, unescape).found


def run(sources: DataFrame, store: Store, routes: Routes | None = None, unescape: bool = True) -> DataFrame:
    """Finished items of a manifest."""
    return run_all(sources, store, routes, unescape).items
