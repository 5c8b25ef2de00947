"""Which extractor takes a source, and what type its items get."""

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from contentloom.functions.urls import url_host

# Predicates take the source and whether it is an existing file.
Predicate = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Route:
    name: str
    accepts: Predicate
    # Sources of this route to items; None for the built-in routes, which the run plan knows.
    extract: Callable[[DataFrame], DataFrame] | None = None


def _file_ending(ending: str) -> Predicate:
    return lambda source, is_file: is_file & F.lower(source).endswith(ending)


def _holding(part: str) -> Predicate:
    return lambda source, is_file: source.contains(part)


# How the built-in routes are told apart, in their order.
DRIVE_FOLDER = "drive.google.com/drive/folders/"
DEFAULT_ROUTES = (
    Route("drive", _holding(DRIVE_FOLDER)),
    Route("website", lambda source, is_file: source.startswith("http")),
    Route("pdf", _file_ending(".pdf")),
    Route("reddit", _holding("reddit.com")),
    Route("substack", _holding("substack.com")),
    Route("linkedin", _holding("linkedin.com")),
    Route("transcript", _file_ending(".txt")),
    Route("generic", lambda source, is_file: F.lit(True)),
)
HOST_ROUTES = ("reddit", "substack", "linkedin")


@dataclass
class Routes:
    """An ordered list of routes; the first that accepts a source wins."""

    routes: list[Route] = field(default_factory=lambda: list(DEFAULT_ROUTES))

    @classmethod
    def hosts_first(cls) -> "Routes":
        """Reddit, Substack and LinkedIn addresses go to their own routes even with a scheme."""
        hosts = [r for r in DEFAULT_ROUTES if r.name in HOST_ROUTES]
        rest = [r for r in DEFAULT_ROUTES if r.name not in HOST_ROUTES]
        return cls([rest[0], *hosts, *rest[1:]])

    def register(
        self,
        name: str,
        accepts: Predicate,
        extract: Callable[[DataFrame], DataFrame],
        before: str | None = None,
    ) -> "Routes":
        """Add a route ahead of ``before``, or else ahead of the one that takes all."""
        names = [r.name for r in self.routes]
        if name in names:
            raise ValueError(f"route {name} is there already")
        at = names.index(before) if before else len(names) - 1
        self.routes.insert(at, Route(name, accepts, extract))
        return self

    def column(self, source: Column, is_file: Column) -> Column:
        file = F.coalesce(is_file, F.lit(False))
        first, *rest = self.routes
        chain = F.when(first.accepts(source, file), first.name)
        for route in rest:
            chain = chain.when(route.accepts(source, file), route.name)
        return chain

    def apply(self, sources: DataFrame) -> DataFrame:
        return sources.withColumn("route", self.column(F.col("source"), F.col("is_file")))

    def custom(self) -> list[Route]:
        return [r for r in self.routes if r.extract is not None]


# File endings that count as plain text, and compression endings put after them.
PLAIN_ENDINGS = ("txt", "bat", "c", "h", "ksh", "pl")
PACKED_ENDINGS = ("gz", "Z", "bz2", "xz", "br")


def infer_content_type(source: str, exists: str) -> Column:
    """From the file ending of an existing file, else from the host. Takes column names."""
    name = F.regexp_replace(source, rf"\.(?:{'|'.join(PACKED_ENDINGS)})\z", "")
    ending = F.lower(F.regexp_extract(name, r"[^/.][^/]*\.([^./]*)\z", 1))
    file = F.coalesce(F.col(exists), F.lit(False))
    host = F.expr(url_host(source))
    return (
        F.when(file & (ending == "pdf"), "book")
        .when(file & ending.isin(*PLAIN_ENDINGS), "call_transcript")
        .when(host.contains("reddit.com"), "reddit_comment")
        .when(host.contains("linkedin.com"), "linkedin_post")
        .otherwise("blog")
    )


def resolve_content_type(forced: str, own: str, source: str, exists: str) -> Column:
    """The forced type, else the item's own, else one told from the source. Takes column names."""
    return F.coalesce(
        F.expr(f"nullif({forced}, '')"), F.expr(f"nullif({own}, '')"), infer_content_type(source, exists)
    )
