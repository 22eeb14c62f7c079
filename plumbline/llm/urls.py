"""URL filters by a temporal list join. DataFrame functions only.

A list is a log of dated entries: at some time a pattern was added to or removed
from it. Entries become validity intervals (until the next entry of the same list and
pattern), and every capture is joined to the intervals that hold at its fetch
time. A pattern is a host, which covers its subdomains, or a host with a path
prefix of whole segments. So a capture asks for its host's suffixes and its path's
prefixes, and the join is an equality on the pattern with the time between the ends.
The longest pattern decides; of equal ones the block list does.

The intervals are broadcast while below MAX_BROADCAST, else both sides are
shuffled by pattern, where Spark splits the partitions of hot hosts.

Defined results: captures with a null or malformed URL or a null time match nothing
(verdict none); entries with a null list, pattern, action or time are ignored;
at one time a removal wins over an addition; captures that repeat whole are one
row; empty lists leave every capture with none; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_BROADCAST = 500_000
_URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)(?::\d*)?([^?#]*)"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _URL, 1))


def patterns(url: Column) -> Column:
    """All patterns that cover a URL: suffixes of the host, then the host with each path prefix."""
    def of(h: Column) -> Column:
        labels = F.split(h, r"\.")
        segments = F.filter(F.split(F.regexp_extract(url, _URL, 2), "/"), lambda s: s != "")
        suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
        longer = lambda paths, s: F.concat(paths, F.array(F.concat(F.get(paths, F.size(paths) - 1), F.lit("/"), s)))
        prefixes = F.aggregate(segments, F.array(h), longer)
        return F.when(h == "", F.array().cast("array<string>")).otherwise(F.concat(suffixes, F.slice(prefixes, F.lit(2), F.size(segments))))

    return F.get(F.transform(F.array(host(url)), of), F.lit(0))


def intervals(entries: DataFrame) -> DataFrame:
    """list, pattern, since, until (null: still) of entries (list, pattern, action add or remove, listed_at)."""
    e = entries.select("list", F.lower("pattern").alias("pattern"), "action", "listed_at").where("list is not null and pattern is not null and action in ('add', 'remove') and listed_at is not null")
    e = e.groupBy("list", "pattern", "listed_at").agg(F.max("action").alias("action"))
    until = F.lead("listed_at").over(Window.partitionBy("list", "pattern").orderBy("listed_at"))
    return e.withColumn("until", until).where("action = 'add'").select("list", "pattern", F.col("listed_at").alias("since"), "until")


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """capture_id, fetched_at, verdict (block, allow, none), pattern, n_active of captures (capture_id, url, fetched_at)."""
    spans = intervals(entries)
    if spans.count() <= MAX_BROADCAST:
        spans = F.broadcast(spans)
    asks = captures.select("capture_id", "url", "fetched_at", F.explode_outer(patterns(F.col("url"))).alias("ask"))
    holds = (F.col("ask") == F.col("pattern")) & (F.col("fetched_at") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched_at") < F.col("until")))
    hit = asks.join(spans, holds, "left")
    rank = F.struct(F.length("pattern").alias("size"), (F.col("list") == "block").cast("int").alias("first"), "list", "pattern")
    best = hit.groupBy("capture_id", "url", "fetched_at").agg(F.max(F.when(F.col("pattern").isNotNull(), rank)).alias("best"), F.count("pattern").alias("n_active"))
    return best.select("capture_id", "fetched_at", F.coalesce("best.list", F.lit("none")).alias("verdict"), F.col("best.pattern").alias("pattern"), "n_active")


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures from the pages. These carry no time, so each is dated by its number within 30 days."""
    return pages.select(F.col("page_id").alias("capture_id"), "url", _day("page_id", 7919, 0).alias("fetched_at"))


def entries_of(pages: DataFrame) -> DataFrame:
    """List entries for the hosts and first path segments of the pages: each is added, removed and added again."""
    segment = F.regexp_extract(F.regexp_extract("url", _URL, 2), r"^/([^/]+)", 1)
    both = F.array(host(F.col("url")), F.concat(host(F.col("url")), F.lit("/"), segment))
    named = pages.select("page_id", F.explode(both).alias("pattern")).where("pattern rlike '^[^/]+(/[^/]+)?$'")
    named = named.groupBy("pattern").agg(F.min("page_id").alias("first"))
    steps = named.select("pattern", "first", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    action = F.when(F.col("k") % 2 == 0, "add").otherwise("remove")
    which = F.when(F.length("pattern") % 3 == 0, "allow").otherwise("block")
    return steps.select(which.alias("list"), "pattern", action.alias("action"), _day("first", 104729, 432000 * F.col("k")).alias("listed_at"))


def _day(number: str, factor: int, later) -> Column:
    return F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col(number) * factor + later, F.lit(2592000)))
