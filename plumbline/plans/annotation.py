"""Which policies to annotate, which to reuse, and the policy cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import urls


def annotation_plan(dirs: DataFrame, force: bool = False) -> DataFrame:
    """Of policy directories (path, source_url, has_output): action (annotate, reuse_now, reuse_later, skip) and from which path.

    Directories of one normalised URL share the work: an existing output is
    reused at once, else the least path leads and the rest wait for it.
    """
    key = F.coalesce(F.nullif(urls.normalize_policy_url(F.col("source_url")), F.lit("")), F.concat(F.lit("path:"), F.col("path")))
    w = Window.partitionBy("__key")
    done = F.lit(False) if force else F.col("has_output")
    df = dirs.withColumn("__key", key).withColumn("__done", done)
    df = df.withColumns({"__owner": F.min(F.when(F.col("__done"), F.col("path"))).over(w), "__first": F.min("path").over(w)})
    action = F.when(F.col("__done"), "skip").when(F.col("__owner").isNotNull(), "reuse_now").when(F.col("path") == F.col("__first"), "annotate").otherwise("reuse_later")
    return df.select("path", "source_url", action.alias("action"), F.when(action == "reuse_now", F.col("__owner")).when(action == "reuse_later", F.col("__first")).alias("reuse_from"))


def reuse_outputs(plan: DataFrame, outputs: DataFrame) -> DataFrame:
    """Outputs (path, ...) of leaders copied to the paths that reuse them, marked with their origin."""
    users = plan.where("reuse_from is not null").select(F.col("path").alias("to"), F.col("reuse_from").alias("path"))
    copied = outputs.join(users, "path").withColumn("reused_from", F.col("path")).withColumn("path", F.col("to")).drop("to")
    return outputs.withColumn("reused_from", F.lit(None).cast("string")).unionByName(copied)


def filter_targets(dirs: DataFrame, targets: DataFrame, root: str) -> DataFrame:
    """Directories that are listed and lie under root."""
    return dirs.where(F.startswith("path", F.lit(root.rstrip("/") + "/"))).join(targets.select("path").distinct(), "path", "left_semi")


def first_writer(artifacts: DataFrame) -> DataFrame:
    """Artifacts (seq, url, path) with the first of each normalised URL as canonical_path."""
    key = F.coalesce(F.nullif(urls.normalize_policy_url(F.col("url")), F.lit("")), F.concat(F.lit("path:"), F.col("path")))
    w = Window.partitionBy("__key")
    first = F.min(F.struct("seq", "path")).over(w)
    return artifacts.withColumn("__key", key).withColumn("canonical_path", first["path"]).withColumn("is_canonical", F.col("path") == F.col("canonical_path")).drop("__key")


def source_urls(dirs: DataFrame, extraction: DataFrame, legacy: DataFrame) -> DataFrame:
    """Normalised source URL of each directory: from its extraction record, else the older text file."""
    e = extraction.select("path", F.nullif(F.trim("source_url"), F.lit("")).alias("__e")).dropDuplicates(["path"])
    t = legacy.select("path", F.nullif(F.trim("text"), F.lit("")).alias("__t")).dropDuplicates(["path"])
    return dirs.join(e, "path", "left").join(t, "path", "left").withColumn("source_url", F.nullif(urls.normalize_policy_url(F.coalesce("__e", "__t")), F.lit(""))).drop("__e", "__t")


def usage_totals(lines: DataFrame) -> DataFrame:
    """Tokens over log lines (line): done lines add up; a usage line raises the total to at least its figure.

    The sum is taken first, then the usage lines' maximum: the two orders
    agree unless usage lines stand before done lines.
    """
    num = lambda p, i: F.regexp_replace(F.regexp_extract("line", p, i), ",", "").try_cast("bigint")
    done, usage = r"\|\s*([\d,]+)↑/([\d,]+)↓", r"(?i)prompt_tokens\s*=\s*([\d,]+).*completion_tokens\s*=\s*([\d,]+)"
    a = lines.agg(*[f(F.coalesce(num(p, i), F.lit(0))).alias(n) for n, f, p, i in (("di", F.sum, done, 1), ("do", F.sum, done, 2), ("ui", F.max, usage, 1), ("uo", F.max, usage, 2))])
    z = lambda c: F.coalesce(c, F.lit(0))
    return a.select(F.greatest(z("di"), z("ui")).alias("tokens_in"), F.greatest(z("do"), z("uo")).alias("tokens_out"))


def compact_cache(cache: DataFrame) -> DataFrame:
    """Key of an entry becomes its normalised final URL, other keys of the same entry aliases of it; an entry that differs keeps its own key."""
    body = ["text", "status_code", "extraction_method", "error_message"]
    df = cache.where("key <> ''")
    alias = df.where("coalesce(alias_of, '') <> ''").select("key", *[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in [*body, "final_url"]], "alias_of")
    own = df.where("coalesce(alias_of, '') = ''").withColumn("text", F.coalesce("text", F.lit("")))
    own = own.withColumn("final_key", F.coalesce(F.nullif(urls.normalize_policy_url(F.coalesce(F.nullif("final_url", F.lit("")), F.col("key"))), F.lit("")), F.col("key")))
    lead = F.first(F.struct(*body, "final_url")).over(Window.partitionBy("final_key").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    own = own.withColumn("same", F.struct(*body, "final_url").eqNullSafe(lead)).withColumn("at", F.row_number().over(Window.partitionBy("final_key").orderBy("seq")))
    entry = [*body, "final_url", F.lit(None).cast("string").alias("alias_of")]
    heads = own.where("at = 1").select(F.col("final_key").alias("key"), *entry)
    odd = own.where("not same").select("key", *entry)
    moved = own.where("same and key <> final_key").select("key", *[F.lit(None).cast(own.schema[c].dataType).alias(c) for c in [*body, "final_url"]], F.col("final_key").alias("alias_of"))
    return heads.unionByName(odd).unionByName(moved).unionByName(alias).dropDuplicates(["key"])


def resolve_aliases(cache: DataFrame, hops: int = 8) -> DataFrame:
    """key, target: where each key's alias chain ends within so many hops; null for a cycle or a dead end."""
    step = cache.select(F.col("key").alias("at"), F.lit(True).alias("known"), F.nullif("alias_of", F.lit("")).alias("next")).dropDuplicates(["at"])
    df = cache.select("key").distinct().withColumns({"at": F.col("key"), "target": F.lit(None).cast("string")})
    for _ in range(hops):
        df = df.join(step, "at", "left")
        end = F.col("known") & F.col("next").isNull() & F.col("at").isNotNull()
        df = df.select("key", F.coalesce("target", F.when(end, F.col("at"))).alias("target"), F.col("next").alias("at"))
    return df.select("key", "target")


def cache_stats(cache: DataFrame) -> DataFrame:
    """total, fetched, failed and entries by status (unknown by default)."""
    base = cache.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("text").isNotNull()).alias("fetched"), F.count_if((F.coalesce("error_message", F.lit("")) != "") & F.col("text").isNull()).alias("failed"))
    by = cache.groupBy(F.coalesce(F.col("status_code").cast("string"), F.lit("unknown")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return base.select(F.explode(F.map_from_arrays(F.array(F.lit("total"), F.lit("fetched"), F.lit("failed")), F.array("total", "fetched", "failed"))).alias("name", "n")).union(by.select(F.concat(F.lit("status "), "name"), "n"))
