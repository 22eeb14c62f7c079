"""Frames behind browsing, audit and consistency views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_site(results: DataFrame) -> DataFrame:
    """Rows with any site key."""
    return results.where("coalesce(nullif(trim(site_etld1), ''), nullif(trim(input), '')) is not null")


def audit_backlog(results: DataFrame, verified: DataFrame, overrides: DataFrame, ok_artifacts: DataFrame | None = None) -> DataFrame:
    """Sites not verified yet, with the overriding or found policy URL, by rank (none or not positive: last), then site."""
    df = results.join(verified.select("site_etld1").distinct(), "site_etld1", "left_anti")
    if ok_artifacts is not None:
        df = df.join(ok_artifacts.select("site_etld1").distinct(), "site_etld1", "left_semi")
    df = df.join(overrides.select("site_etld1", F.col("url").alias("__o")), "site_etld1", "left")
    return df.select("site_etld1", "rank", F.coalesce(F.nullif("__o", F.lit("")), "policy_url").alias("policy_url")).orderBy(F.asc_nulls_last(F.when(F.col("rank") > 0, F.col("rank"))), "site_etld1")


def consistency_pairs(results: DataFrame, texts: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """Of each run, sites with a policy by their third parties with one: both texts, how they were extracted, their lengths and word counts.

    shared: texts of services (service_domain, text) that are the same for every site, in place of
    those of texts. Tables that have chars and words already, with a digest as the text, are taken as they are.
    """
    from plumbline.functions.text import space_words

    def measured(df: DataFrame) -> DataFrame:
        return df if "words" in df.columns else df.withColumns({"chars": F.length("text"), "words": space_words(F.col("text"))})

    method = F.col("first_party_policy.extraction_method") if "first_party_policy" in results.columns else F.lit(None).cast("string")
    t, on = measured(texts), ["run_id", "site_etld1", "service_domain"]
    own = t.where("service_domain is null").select("run_id", "site_etld1", *[F.col(c).alias(f"site_{c}") for c in ("text", "chars", "words")])
    tp = F.col("tp")
    pairs = results.where("status = 'ok'").select("run_id", "site_etld1", method.alias("site_method"), F.explode("third_parties").alias("tp")).where("tp.policy_url <> ''")
    pairs = pairs.select("run_id", "site_etld1", "site_method", tp["third_party_etld1"].alias("service_domain"), tp["policy_url"].alias("policy_url"), tp["policy_extraction_method"].alias("method"))
    theirs = t.where("service_domain is not null").select(*on, "text", "chars", "words") if shared is None else measured(shared).select("service_domain", "text", "chars", "words")
    return pairs.join(own, ["run_id", "site_etld1"]).join(theirs, on if shared is None else "service_domain", "left")


def line_window(lines: DataFrame, offset: int = 0, limit: int = 250) -> DataFrame:
    """A window of the non-blank lines (seq, line); at most 2000."""
    return lines.where("trim(line) <> ''").orderBy("seq").offset(max(0, offset)).limit(max(1, min(2000, limit)))


def bundle_order(results: DataFrame) -> DataFrame:
    return results.orderBy(F.asc_nulls_last("rank"), "site_etld1")


def dataset_state(results: DataFrame, persisted_total: int = 0, persisted_processed: int = 0) -> DataFrame:
    """Total, processed, last successful rank and progress in percent, at most 100."""
    key = F.lower(F.trim(F.coalesce("site_etld1", "input")))
    a = results.agg(F.count_distinct(key).alias("sites"), F.max(F.when(F.col("status") == "ok", F.col("rank"))).alias("last_successful_rank"))
    a = a.select(F.greatest(F.lit(persisted_total).cast("long"), "sites").alias("total"), F.greatest(F.lit(persisted_processed).cast("long"), "sites").alias("processed"), "last_successful_rank")
    return a.withColumn("progress_pct", F.when(F.col("total") > 0, F.least(F.lit(100.0), F.round(F.col("processed") / F.col("total") * 100, 1))).otherwise(0.0))


def upsert_results(old: DataFrame, new: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A new record removes every earlier one (of the same run, with by=("run_id",)) that shares any of site_etld1, input, site; records without a key stay.

    A record stays if it is the last for all its keys: one that is itself
    removed later has already removed those before it.
    """
    df = old.unionByName(new, allowMissingColumns=True)
    keys = [c for c in ("site_etld1", "input", "site") if c in df.columns]
    each = df.select(*by, "ingest_seq", F.explode(F.array_distinct(F.filter(F.array(*[F.trim(k) for k in keys]), lambda k: k != ""))).alias("k"))
    last = each.withColumn("newest", F.max("ingest_seq").over(Window.partitionBy(*by, "k")))
    gone = last.where("ingest_seq < newest").select(*by, "ingest_seq").distinct()
    return df.join(gone, [*by, "ingest_seq"], "left_anti")


def upsert_explorer(old: DataFrame, new: DataFrame) -> DataFrame:
    """The last row of each exact site; rows without a site stay."""
    df = old.unionByName(new, allowMissingColumns=True)
    at = F.row_number().over(Window.partitionBy("site").orderBy(F.desc("ingest_seq")))
    kept = df.where("site is not null").withColumn("__at", at).where("__at = 1").drop("__at")
    return kept.unionByName(df.where("site is null"))
