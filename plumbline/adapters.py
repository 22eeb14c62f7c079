"""Canonical tables from the driver's star-schema tables, in Spark and (PRELUDE) in SQL for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.functions.constants import ENGLISH_WORDS

# Raw website and service categories that stand for the star schema's segments and part types.
SEGMENTS = {"AUTOMOBILE": "Technology", "BUILDING": "business and finance", "FURNITURE": "Shopping", "HOUSEHOLD": "Lifestyle", "MACHINERY": "news"}
PART_TYPES = {"LARGE": "advertising", "ECONOMY": "site analytics", "SMALL": "cdn", "STANDARD": "social - share", "MEDIUM": "tag manager", "PROMO": "sso"}


#: Most services that are broadcast to the pairs of sites and services; more are shuffled.
BROADCAST_SERVICES = 200_000
#: Most documents of which the measures are broadcast.
BROADCAST_MEASURES = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _named(col, names: dict[str, str]):
    out = F.lit(None).cast("string")
    for raw, name in names.items():
        out = F.when(col == raw, name).otherwise(out)
    return F.coalesce(out, col)


def few(spark, sf, of_services: DataFrame) -> DataFrame:
    """A table of a row for each service, to be broadcast up to the bound."""
    return F.broadcast(of_services) if table(spark, sf, "supplier").count() <= BROADCAST_SERVICES else of_services


def runs(spark, sf):
    return table(spark, sf, "region").select(F.col("r_name").alias("run_id"))


def documents(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return d.select("doc_id", X.content_hash(F.col("text")).alias("content_hash"), X.word_count(F.col("text")).alias("word_count"), F.length("text").alias("char_count"), X.is_english(F.col("text")).alias("is_english"))


def sites(spark, sf):
    """One row for each customer, with the policy document's columns where there is one."""
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    s = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    s = s.join(documents(spark, sf), F.col("c_custkey") == F.col("doc_id"), "left")
    status = F.when(F.col("c_acctbal") < 0, "home_fetch_failed").when(F.col("doc_id").isNull(), "policy_not_found").otherwise("ok")
    ok = status == "ok"
    at_ok = lambda c: F.when(ok, F.col(c)).alias(c)
    return s.select(F.col("c_custkey").alias("site_key"), F.col("c_name").alias("site"), F.col("r_name").alias("run_id"), (F.col("c_custkey") + 1).cast("int").alias("rank"), _named(F.col("c_mktsegment"), SEGMENTS).alias("main_category"), status.alias("status"), *[at_ok(x) for x in ("doc_id", "content_hash", "word_count", "char_count", "is_english")])


def services(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    k = F.col("s_suppkey")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        k.alias("service_key"), F.col("s_name").alias("service_domain"),
        F.when(k % 10 != 9, F.col("n_name")).alias("entity"),
        F.when(k % 7 != 0, F.col("s_acctbal") / 10000).alias("prevalence"),
        F.when(k % 4 != 3, F.concat(F.lit("https://"), F.lower("n_name"), F.lit(".example.com/privacy/"), (k % 5).cast("string"))).alias("policy_url"),
        F.when(k % 3 == 0, "domains/a.json").alias("radar_file"),
        F.when(k % 3 == 1, "patterns/b.eno").alias("pattern_file"),
    )


def service_categories(spark, sf):
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    li = li.select("l_suppkey", "l_partkey").distinct()
    return li.join(p.select("p_partkey", "p_type"), li.l_partkey == p.p_partkey).select(F.col("l_suppkey").alias("service_key"), _named(F.col("p_type"), PART_TYPES).alias("category")).distinct()


def site_services(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    li = li.select("l_orderkey", "l_suppkey")
    pairs = o.select("o_orderkey", "o_custkey").join(li, o.o_orderkey == li.l_orderkey).select(F.col("o_custkey").alias("site_key"), F.col("l_suppkey").alias("service_key"))
    return pairs.repartition("site_key").distinct()  # dealt once: what groups or joins by site comes after in the same partitions


def site_results(spark, sf, categories: bool = True):
    """Nested site records: one row for each site with its third parties, without their categories where nothing asks for them."""
    s = services(spark, sf)
    if categories:
        cats = service_categories(spark, sf).groupBy("service_key").agg(F.array_sort(F.collect_set("category")).alias("categories"))
        s = s.join(cats, "service_key", "left")
    else:
        s = s.withColumn("categories", F.lit(None).cast("array<string>"))
    tp = F.struct(
        F.col("service_domain").alias("third_party_etld1"), "entity", F.coalesce("categories", F.array().cast("array<string>")).alias("categories"), "prevalence", "policy_url",
        F.col("radar_file").alias("tracker_radar_source_domain_file"), F.col("pattern_file").alias("trackerdb_source_pattern_file"), F.lit(None).cast("string").alias("trackerdb_source_org_file"), F.lit(None).cast("string").alias("policy_extraction_method"),
    )
    docs = documents(spark, sf).select((F.col("doc_id") / 10).cast("bigint").alias("service_key"), (F.col("doc_id") % 10).alias("__r"), F.col("is_english").alias("tp_english")).where("__r = 0").drop("__r")
    s = s.select("service_key", tp.alias("tp")).join(docs, "service_key", "left")
    pairs = site_services(spark, sf).join(few(spark, sf, s), "service_key")
    nested = pairs.groupBy("site_key").agg(F.array_sort(F.collect_list("tp")).alias("third_parties"), F.count_if(F.coalesce("tp_english", F.lit(False))).cast("int").alias("third_party_with_english_policy_count"))
    df = sites(spark, sf).join(nested, "site_key", "left")
    return df.select(
        F.col("site_key").alias("ingest_seq"), "run_id", F.col("site").alias("input"), F.col("site").alias("site_etld1"), "rank", "main_category", "status", F.col("is_english").alias("policy_is_english"),
        F.col("word_count").alias("first_party_policy_word_count"), F.coalesce("third_party_with_english_policy_count", F.lit(0)).alias("third_party_with_english_policy_count"), F.coalesce("third_parties", F.array().cast(pairs.select(F.array("tp")).schema[0].dataType)).alias("third_parties"),
    )


def events(spark, sf):
    e = table(spark, sf, "events")
    kind = {"error": "site_failed", "view": "site_started", "click": "site_finished", "purchase": "site_finished", "signup": "site_stage"}
    return e.select(F.col("event_id").alias("seq"), _named(F.col("event_type"), kind).alias("type"), F.concat(F.lit("run"), (F.col("user_id") % 7).cast("string")).alias("run_id"), F.concat(F.lit("site"), F.col("user_id").cast("string")).alias("site"), F.get_json_object("props", "$.k").cast("int").alias("rank"), F.col("value").alias("value"), F.col("ts").alias("timestamp"), F.col("props").alias("payload"))


def _case(col: str, names: dict[str, str]) -> str:
    return "case " + " ".join(f"when {col} = '{a}' then '{b}'" for a, b in names.items()) + f" else {col} end"


#: Common table expressions of the same tables: docs, sites, services, cats, pairs (site, service), occ (third-party occurrences).
PRELUDE = rf"""
with docs0 as (select doc_id, text, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}_]+'), lambda x: regexp_matches(x, '^[a-z]{{2,}}$')) w from documents),
docs as (
  select doc_id, sha256(text) content_hash, length(text)::int char_count,
    len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}_]')))::int word_count,
    case when text is null then null when len(w) < 80 then true else len(list_filter(w, lambda x: list_contains([{', '.join(f"'{w}'" for w in ENGLISH_WORDS if len(w) > 1)}], x))) / len(w) >= 0.07 end is_english
  from docs0),
sites0 as (
  select c_custkey site_key, c_name site, r_name run_id, (c_custkey + 1)::int rank, {_case('c_mktsegment', SEGMENTS)} main_category,
    case when c_acctbal < 0 then 'home_fetch_failed' when d.doc_id is null then 'policy_not_found' else 'ok' end status, d.*
  from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey left join docs d on d.doc_id = c_custkey),
sites as (
  select site_key, site, run_id, rank, main_category, status, case when status = 'ok' then doc_id end doc_id, case when status = 'ok' then content_hash end content_hash,
    case when status = 'ok' then word_count end word_count, case when status = 'ok' then char_count end char_count, case when status = 'ok' then is_english end is_english from sites0),
services as (
  select s_suppkey service_key, s_name service_domain, case when s_suppkey % 10 <> 9 then n_name end entity, case when s_suppkey % 7 <> 0 then s_acctbal / 10000 end prevalence,
    case when s_suppkey % 4 <> 3 then 'https://' || lower(n_name) || '.example.com/privacy/' || (s_suppkey % 5) end policy_url,
    case when s_suppkey % 3 = 0 then 'domains/a.json' end radar_file, case when s_suppkey % 3 = 1 then 'patterns/b.eno' end pattern_file
  from supplier join nation on s_nationkey = n_nationkey),
cats as (select distinct l_suppkey service_key, {_case('p_type', PART_TYPES)} category from lineitem join part on l_partkey = p_partkey),
pairs as (select distinct o_custkey site_key, l_suppkey service_key from orders join lineitem on o_orderkey = l_orderkey),
"""
