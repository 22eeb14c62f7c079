"""Site lists: filtering, ranking, de-duplication and what is still to do."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import constants as K
from plumbline.functions import taxonomy
from plumbline.operators.domains import with_domain


def filter_scrapable(sites: DataFrame) -> DataFrame:
    """Reachable status and a CrUX status of 200; an empty status is 0, one that is no integer drops the row."""
    status = F.when(F.coalesce(F.trim("status_code"), F.lit("")) == "", 0).otherwise(F.expr("try_cast(trim(status_code) as int)"))
    return sites.where(status.isin(K.REACHABLE) & (F.trim("crux_code") == "200"))


def exclude_domains(sites: DataFrame, suffixes: list[str] = K.EXCLUDED_SUFFIXES, exact: DataFrame | None = None, col: str = "domain") -> DataFrame:
    """Drop domains that are listed, or equal or lie under a suffix. Each domain's own suffixes are looked up, so any list length is an equality test."""
    name = F.regexp_replace(F.lower(F.trim(col)), r"\.$", "")
    labels = F.split(name, r"\.")
    own = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    bad = [s.lower().strip(".") for s in suffixes]
    df = sites.where(~F.coalesce(F.arrays_overlap(own, F.array(*[F.lit(s) for s in bad])), F.lit(False))) if bad else sites
    if exact is None:
        return df
    listed = exact.select(F.regexp_replace(F.lower(F.trim(exact.columns[0])), r"\.$", "").alias("__d")).distinct()
    return df.withColumn("__d", name).join(listed, "__d", "left_anti").drop("__d")


def unique_ranked(ranked: DataFrame, n: int, start_after: int = 0, suffixes: list[str] = K.EXCLUDED_SUFFIXES, rules: DataFrame | None = None) -> DataFrame:
    """Registrable domains (by the rules of a suffix list, where given) with their earliest rank; de-duplicated first, then those after a rank, the first n."""
    by = with_domain(ranked.select("rank", F.col("domain").alias("__name")), F.col("__name"), "domain", rules).select("rank", "domain").where("domain is not null")
    by = exclude_domains(by, suffixes).groupBy("domain").agg(F.min("rank").alias("rank"))
    return by.where(F.col("rank") > start_after).orderBy("rank", "domain").limit(n).select("rank", "domain")


def load_dataset(sites: DataFrame, n: int, start_after: int = 0) -> DataFrame:
    """Rows of (seq: number of the row, from 1; tranco_id, domain, ...) after a rank first, then each domain's first row, in file order, the first n."""
    rank = F.coalesce(F.expr("try_cast(trim(tranco_id) as bigint)"), F.col("seq"))
    df = sites.withColumns({"rank": rank, "__key": F.lower(F.trim("domain"))}).where("__key <> ''").where(F.col("rank") > start_after)
    first = F.row_number().over(Window.partitionBy("__key").orderBy("seq"))
    return df.withColumn("__at", first).where("__at = 1").drop("__at", "__key").orderBy("seq").limit(n)


def fill_target(candidates: DataFrame, passes, n: int, order: str = "rank") -> DataFrame:
    """The first n candidates that pass a condition."""
    return candidates.where(passes).orderBy(order).limit(n)


def skip_failed_home(results: DataFrame) -> DataFrame:
    return results.where("coalesce(status, '') <> 'home_fetch_failed'")


def resume_plan(sites: DataFrame, done: DataFrame, scraped: DataFrame, annotated: DataFrame, key: str = "site") -> DataFrame:
    """Every site with the first reason to skip it (done, scraped, annotated) or null when it is to be done."""
    df = sites
    for name, seen in (("done", done), ("scraped", scraped), ("annotated", annotated)):
        df = df.join(seen.select(key).distinct().withColumn(f"__{name}", F.lit(True)), key, "left")
    reason = F.when(F.col("__done"), "done").when(F.col("__scraped"), "scraped").when(F.col("__annotated"), "annotated")
    return df.withColumn("skip_reason", reason).drop("__done", "__scraped", "__annotated")


def pending_sites(requested: DataFrame, results: DataFrame) -> DataFrame:
    """Requested sites (seq, site), first spelling of each, without a result."""
    first = requested.withColumn("__key", F.lower(F.trim("site"))).where("__key <> ''").groupBy("__key").agg(F.min_by("site", "seq").alias("site"), F.min("seq").alias("seq"))
    seen = results.select(F.lower(F.trim("site")).alias("__key")).distinct()
    return first.join(seen, "__key", "left_anti").select("seq", "site")


def origin_allowed(sites: DataFrame, origins: DataFrame) -> DataFrame:
    """Sites whose https or http origin is in the table."""
    host = F.lower(F.trim("site"))
    keys = sites.withColumn("__o", F.explode(F.array(F.concat(F.lit("https://"), host), F.concat(F.lit("http://"), host))))
    return sites.join(keys.join(origins.select(F.col("origin").alias("__o")), "__o", "left_semi").select("site").distinct(), "site", "left_semi")


def unmapped_categories(sites: DataFrame) -> DataFrame:
    """Fine categories without a main one, with their number of sites."""
    return sites.select(F.explode(taxonomy.unknown_categories(F.col("categories"))).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def category_distribution(sites: DataFrame, col: str = "main_category") -> DataFrame:
    by = sites.groupBy(F.col(col).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    total = by.agg(F.sum("n").alias("total"))
    return by.crossJoin(F.broadcast(total)).select("category", "n", F.round(F.col("n") / F.col("total") * 100, 2).alias("pct"))  # total is one row


def plan_sites(sites: DataFrame, n: int, done: DataFrame, scraped: DataFrame, annotated: DataFrame, start_after: int = 0) -> DataFrame:
    """From a dataset list (seq, tranco_id, domain, status_code, crux_code, categories): what a run would take, and what it skips."""
    df = filter_scrapable(sites).withColumn("main_category", taxonomy.main_category(F.col("categories")))
    df = load_dataset(exclude_domains(df), n, start_after).withColumnRenamed("domain", "site")
    return resume_plan(df, done, scraped, annotated)
