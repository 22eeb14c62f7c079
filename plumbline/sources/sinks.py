"""Plain sinks. A write that breaks leaves no _SUCCESS; versions.Store is the sink whose readers see all of a write or nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_english(results: DataFrame, path: str) -> None:
    """Records with an English policy."""
    write_jsonl(results.where("policy_is_english"), path)


def write_report(df: DataFrame, path: str, name: str) -> None:
    """A small report table as one JSON document."""
    doc = df.agg(F.to_json(F.struct(F.collect_list(F.struct(*df.columns)).alias(name))).alias("value"))  # reports have at most some hundred rows
    doc.write.mode("overwrite").text(path)


def write_by_run(df: DataFrame, path: str) -> None:
    """Replace only the runs that df has, one folder after another: for tables that can be written again, not for the only copy."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def scrape_markers(results: DataFrame, texts: DataFrame) -> DataFrame:
    """Markers of ok sites with a policy text; its length is in bytes."""
    t = texts.where("service_domain is null and text <> ''").select("run_id", "site_etld1", F.octet_length("text").alias("policy_text_len"))
    return results.where("status = 'ok'").join(t, ["run_id", "site_etld1"]).select("site_etld1", "status", "run_id", F.col("ended_at").alias("scraped_at"), "policy_text_len", "policy_is_english")


def qualified_sites(results: DataFrame, texts: DataFrame) -> DataFrame:
    """Sites with an English policy and a third-party text that is not empty."""
    have = texts.where("service_domain is not null and length(text) > 0").select("run_id", "site_etld1").distinct()
    return results.where("policy_is_english").join(have, ["run_id", "site_etld1"], "left_semi")
