"""The catalog: normalised tables, derived tables, filtered queries, facets and metrics."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import taxonomy
from plumbline.functions import text as X


@dataclass
class Catalog:
    """The catalog's tables as DataFrames.

    runs (run_id, out_dir, updated_at); sites (run_id, site_etld1, rank,
    main_category, status); documents (document_id, content_hash, language,
    word_count, char_count); site_policies (run_id, site_etld1, document_id);
    services (service_domain, entity); service_categories (service_domain, category);
    site_services (run_id, site_etld1, service_domain, fetched_policy_document_id).
    """

    runs: DataFrame
    sites: DataFrame
    documents: DataFrame
    site_policies: DataFrame
    services: DataFrame
    service_categories: DataFrame
    site_services: DataFrame


@dataclass
class Request:
    """A catalog query. The limit is 1 to 500 (100 when falsy), the offset not negative, an unknown sort is site_asc."""

    run_ids: list[str] = field(default_factory=list)
    site_statuses: list[str] = field(default_factory=list)
    site_categories_any: list[str] = field(default_factory=list)
    first_party_english: bool | None = None
    first_party_word_count_min: int | None = None
    requires_third_party_policy: bool | None = None
    requires_third_party_english_policy: bool | None = None
    third_party_categories_any: list[str] = field(default_factory=list)
    third_party_domain: str | None = None
    entity: str | None = None
    limit: int = 100
    offset: int = 0
    sort: str = "site_asc"

    def __post_init__(self):
        self.limit = max(1, min(500, int(self.limit or 100)))
        self.offset = max(0, int(self.offset or 0))
        self.sort = self.sort if self.sort in SORTS else "site_asc"
        for name in ("run_ids", "site_statuses", "site_categories_any", "third_party_categories_any"):
            setattr(self, name, list(dict.fromkeys(s for v in getattr(self, name) if (s := str(v).strip()))))

    @classmethod
    def from_payload(cls, payload: dict[str, Any] | None) -> Request:
        """From camel-case JSON; unknown keys are ignored."""
        snake = lambda k: "".join("_" + c.lower() if c.isupper() else c for c in k)
        return cls(**{snake(k): v for k, v in (payload or {}).items() if v is not None and snake(k) in cls.__dataclass_fields__})


_SITE = F.asc
SORTS = {
    "site_asc": lambda: [F.asc("site_etld1")],
    "site_desc": lambda: [F.desc("site_etld1")],
    "rank_asc": lambda: [F.asc_nulls_last("rank"), F.asc("site_etld1")],
    "rank_desc": lambda: [F.desc_nulls_last("rank"), F.asc("site_etld1")],
    "word_count_asc": lambda: [F.asc("word_count"), F.asc("site_etld1")],
    "word_count_desc": lambda: [F.desc("word_count"), F.asc("site_etld1")],
    "third_party_count_asc": lambda: [F.asc("third_party_count"), F.asc("site_etld1")],
    "third_party_count_desc": lambda: [F.desc("third_party_count"), F.asc("site_etld1")],
    "updated_desc": lambda: [F.desc("run_updated_at"), F.asc("site_etld1")],
}
KEY = ["run_id", "site_etld1"]


def site_search(c: Catalog) -> DataFrame:
    """One row for each site: its policy, and how many services it has, with a document, with an English one."""
    docs = c.documents
    per_service = c.site_services.join(docs.select(F.col("document_id").alias("fetched_policy_document_id"), F.col("language").alias("tp_language")), "fetched_policy_document_id", "left")
    per_service = per_service.join(c.services.select("service_domain", "entity"), "service_domain", "left")
    cats = c.service_categories.where("category <> ''").groupBy("service_domain").agg(F.collect_set("category").alias("cats"))  # a service's categories: bounded by the taxonomy
    agg = per_service.join(cats, "service_domain", "left").groupBy(*KEY).agg(
        F.count_distinct("service_domain").alias("third_party_count"),
        F.count_distinct(F.when(F.col("fetched_policy_document_id").isNotNull(), F.col("service_domain"))).alias("third_party_with_policy_count"),
        F.count_distinct(F.when(F.col("tp_language") == "en", F.col("service_domain"))).alias("third_party_with_english_policy_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("cats")))).alias("third_party_categories"),
        F.array_sort(F.collect_set(F.nullif("entity", F.lit("")))).alias("third_party_entities"),
    )
    s = c.sites.join(c.runs.select("run_id", F.col("updated_at").alias("run_updated_at")), "run_id").join(c.site_policies, KEY, "left").join(docs, "document_id", "left").join(agg, KEY, "left")
    none = F.array().cast("array<string>")
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    return s.select(
        *KEY, "rank", "main_category", "status", "run_updated_at", "language", zero("word_count"), zero("char_count"), F.col("content_hash").isNotNull().alias("has_policy"), F.coalesce(F.col("language") == "en", F.lit(False)).alias("is_english"),
        zero("third_party_count"), zero("third_party_with_policy_count"), zero("third_party_with_english_policy_count"), F.coalesce("third_party_categories", none).alias("third_party_categories"), F.coalesce("third_party_entities", none).alias("third_party_entities"),
    )


def category_rollups(c: Catalog) -> DataFrame:
    s = c.sites.select(*KEY, F.coalesce("main_category", F.lit("Uncategorized")).alias("site_category"))
    df = s.join(c.site_services.select(*KEY, "service_domain"), KEY).join(c.service_categories, "service_domain")
    return df.groupBy("run_id", "site_category", F.col("category").alias("service_category")).agg(F.count_distinct("site_etld1").alias("site_count"))


def matching_sites(c: Catalog, search: DataFrame, r: Request) -> DataFrame:
    """Rows of the search table that meet every condition of the request."""
    some = lambda name, wish: (F.col(name) > 0) if wish else (F.col(name) == 0)
    conds: list[Column] = [F.col(n).isin(v) for n, v in (("run_id", r.run_ids), ("status", r.site_statuses), ("main_category", r.site_categories_any)) if v]
    if r.first_party_english is not None:
        conds.append(F.col("is_english") == r.first_party_english)
    if r.first_party_word_count_min is not None:
        conds.append(F.col("word_count") >= r.first_party_word_count_min)
    if r.requires_third_party_policy is not None:
        conds.append(some("third_party_with_policy_count", r.requires_third_party_policy))
    if r.requires_third_party_english_policy is not None:
        conds.append(some("third_party_with_english_policy_count", r.requires_third_party_english_policy))
    df = search.where(reduce(lambda a, b: a & b, conds)) if conds else search
    links = c.site_services.select(*KEY, "service_domain")
    if r.third_party_domain:
        df = df.join(links.where(F.col("service_domain") == r.third_party_domain.strip().lower()), KEY, "left_semi")
    if r.entity:
        df = df.join(links.join(c.services.where(F.lower(F.coalesce("entity", F.lit(""))) == r.entity.strip().lower()), "service_domain"), KEY, "left_semi")
    if r.third_party_categories_any:
        df = df.join(links.join(c.service_categories.where(F.col("category").isin(r.third_party_categories_any)), "service_domain", "left_semi"), KEY, "left_semi")
    return df


def query(c: Catalog, r: Request, search: DataFrame | None = None) -> DataFrame:
    """One page of the matching sites in the request's order."""
    found = matching_sites(c, site_search(c) if search is None else search, r)
    return found.orderBy(*SORTS[r.sort](), "run_id").offset(r.offset).limit(r.limit)


def query_total(c: Catalog, r: Request, search: DataFrame | None = None) -> DataFrame:
    return matching_sites(c, site_search(c) if search is None else search, r).agg(F.count(F.lit(1)).alias("total"))


def word_bucket(n: Column) -> Column:
    n = F.coalesce(n, F.lit(0))
    return F.when(n <= 0, "0").when(n < 100, "1-99").when(n < 500, "100-499").when(n < 1000, "500-999").when(n < 5000, "1000-4999").otherwise("5000+")


def facets(c: Catalog, r: Request, search: DataFrame | None = None, n_entities: int = 50) -> DataFrame:
    """facet, name, n: statuses, site categories, word counts (one pass), then service categories and entities (distinct sites)."""
    found = matching_sites(c, site_search(c) if search is None else search, r)
    three = found.select(F.explode(F.array(*[F.struct(F.lit(k).alias("facet"), v.alias("name")) for k, v in (("status", F.col("status")), ("site_category", F.col("main_category")), ("word_count", word_bucket(F.col("word_count"))))])).alias("f"))
    rows = three.where("f.name is not null").groupBy("f.facet", "f.name").agg(F.count(F.lit(1)).alias("n"))
    links = found.select(*KEY).join(c.site_services.select(*KEY, "service_domain"), KEY)
    both = lambda df, name: df.groupBy(F.col(name).alias("name")).agg(F.count_distinct(*KEY).alias("n"))
    cats = both(links.join(c.service_categories, "service_domain"), "category").select(F.lit("service_category").alias("facet"), "name", "n")
    ents = both(links.join(c.services.where("entity <> ''"), "service_domain"), "entity").orderBy(F.desc("n"), "name").limit(n_entities)
    return rows.union(cats).union(ents.select(F.lit("entity").alias("facet"), "name", "n"))


def quality_metrics(search: DataFrame) -> DataFrame:
    """Counts, rates in percent of all sites (of 1 when there are none) and totals."""
    wc = F.col("word_count")
    conds = {"success": F.col("status") == "ok", "policy": F.col("has_policy"), "english": F.col("is_english"), "words_100": wc >= 100, "words_500": wc >= 500, "words_1000": wc >= 1000, "third_party": F.col("third_party_count") > 0, "third_party_policy": F.col("third_party_with_policy_count") > 0, "third_party_english": F.col("third_party_with_english_policy_count") > 0}
    a = search.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(v).alias(k) for k, v in conds.items()], *[F.coalesce(F.sum(t), F.lit(0)).alias(t) for t in ("third_party_count", "third_party_with_policy_count", "third_party_with_english_policy_count")])
    total = F.greatest(F.col("total"), F.lit(1))
    return a.select("total", *[F.round(F.col(k) / total * 100, 2).alias(f"{k}_rate") for k in conds], "third_party_count", "third_party_with_policy_count", "third_party_with_english_policy_count")


#: Sites that count as qualified.
QUALIFIED = Request(site_statuses=["ok"], first_party_english=True, first_party_word_count_min=100, requires_third_party_english_policy=True)


def metrics(c: Catalog, search: DataFrame | None = None, ingestions: DataFrame | None = None, pending: DataFrame | None = None, applied: DataFrame | None = None, samples: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """Everything that is measured of a catalog as rows (section, name, value): tables, policies, quality, dedup, breakdowns, word counts and, where their tables are given, ingestion, outbox and latency.

    The search table is aggregated once for policies and quality; every other row is an aggregate of its own table.
    """
    search = site_search(c) if search is None else search

    def told(section: str, df: DataFrame, name: str | None = None, value: str = "n") -> DataFrame:
        df = df.select(name, value).toDF("name", "value") if name else df.unpivot([], df.columns, "name", "value")
        return df.select(F.lit(section).alias("section"), "name", F.col("value").cast("double").alias("value"))

    def numbers(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(x).cast("double").alias(x) for x in df.columns])

    one = F.count(F.lit(1)).alias("n")
    tables = {"runs": c.runs, "sites": c.sites, "documents": c.documents, "services": c.services, "site_search": search}
    out = [df.agg(one).select(F.lit("tables").alias("section"), F.lit(name).alias("name"), F.col("n").cast("double").alias("value")) for name, df in tables.items()]
    good = (F.col("status") == "ok") & F.col("is_english") & (F.col("word_count") >= 100) & (F.col("third_party_with_english_policy_count") > 0)  # QUALIFIED
    out.append(told("policies", numbers(search.agg(F.count_if("is_english").alias("english"), F.count_if(good).alias("qualified")))))
    out += [told("quality", numbers(quality_metrics(search))), told("dedup", numbers(dedup_ratio(c.documents))), told("word_count", word_buckets(c.documents), "bucket")]
    parts = breakdowns(c)
    out.append(parts.select(F.concat(F.lit("by_"), "kind").alias("section"), "name", F.col("n").cast("double").alias("value")))
    if ingestions is not None:
        out.append(told("ingestion", numbers(ingestion_audit(ingestions))))
    if pending is not None and applied is not None:
        every = outbox_status(pending, applied, F.current_timestamp() if now is None else now).where("run_id is null")
        out.append(told("outbox", every.select(F.col("pending").cast("double"), F.col("oldest_pending_sec").cast("double"), F.unix_timestamp("last_success_at").cast("double").alias("last_success_at"), F.col("ready").cast("int").cast("double").alias("ready"))))
    if samples is not None:
        for q in ("p50", "p95"):
            out.append(told(f"latency_{q}", latency_percentiles(samples), "op", q))
    return reduce(DataFrame.unionByName, out)


def dedup_ratio(documents: DataFrame) -> DataFrame:
    a = documents.agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("content_hash").alias("unique_hashes"))
    return a.withColumn("dedup_ratio", F.when(F.col("documents") > 0, F.round(1 - F.col("unique_hashes") / F.col("documents"), 6)).otherwise(0.0))


def word_buckets(documents: DataFrame) -> DataFrame:
    return documents.groupBy(word_bucket(F.col("word_count")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def breakdowns(c: Catalog) -> DataFrame:
    """kind, name, n: sites by status and by category, distinct services by category."""
    by = lambda df, kind, name, agg: df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(agg.alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    one = F.count(F.lit(1))
    return by(c.sites, "status", "status", one).union(by(c.sites, "category", "main_category", one)).union(by(c.service_categories, "service_category", "category", F.count_distinct("service_domain")))


def ingestion_audit(log: DataFrame) -> DataFrame:
    return log.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "completed").alias("completed"), F.coalesce(F.sum("processed_sites"), F.lit(0)).alias("processed_sites"), F.coalesce(F.sum("error_count"), F.lit(0)).alias("errors"))


def latency_percentiles(samples: DataFrame, last: int = 200) -> DataFrame:
    """Of the last 200 samples of each operation: median, and the value at place int(n * 0.95)."""
    recent = samples.withColumn("at", F.row_number().over(Window.partitionBy("op").orderBy(F.desc("seq")))).where(F.col("at") <= last)
    a = recent.groupBy("op").agg(F.percentile("ms", 0.5).alias("p50"), F.array_sort(F.collect_list("ms")).alias("all"), F.count(F.lit(1)).cast("int").alias("n"))  # at most 200 values
    place = F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95).cast("int"))
    return a.select("op", "n", F.round("p50", 3).alias("p50"), F.round(F.get("all", place), 3).alias("p95"))


def outbox_status(pending: DataFrame, applied: DataFrame, now: Column) -> DataFrame:
    """Of each run: pending events, ready, age of the oldest in seconds, last success; and of all runs (run_id null): sum, all, max, max."""
    p = pending.groupBy("run_id").agg(F.count(F.lit(1)).alias("pending"), F.min("queued_at").alias("oldest"))
    a = applied.groupBy("run_id").agg(F.max("applied_at").alias("last_success_at"))
    age = F.coalesce(F.greatest(F.lit(0).cast("long"), F.unix_timestamp(now) - F.unix_timestamp("oldest")), F.lit(0).cast("long"))
    runs = p.join(a, "run_id", "full").select("run_id", F.coalesce("pending", F.lit(0)).alias("pending"), age.alias("oldest_pending_sec"), "last_success_at")
    every = runs.agg(F.coalesce(F.sum("pending"), F.lit(0)).alias("pending"), F.coalesce(F.max("oldest_pending_sec"), F.lit(0)).alias("oldest_pending_sec"), F.max("last_success_at").alias("last_success_at")).select(F.lit(None).cast("string").alias("run_id"), "pending", "oldest_pending_sec", "last_success_at")
    return runs.unionByName(every).withColumn("ready", F.col("pending") == 0)


def latest(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("__at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__at = 1").drop("__at")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_first: str | None = None) -> DataFrame:
    """New rows replace old ones of the same key; keep_first names a column whose least value survives."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    if keep_first:
        both = both.withColumn(keep_first, F.min(keep_first).over(Window.partitionBy(*keys)))
    return latest(both, keys, F.desc("__new")).drop("__new")


def replace_stale_runs(runs: DataFrame, tables: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Of the runs of one out_dir only the newest survives; rows of the others leave the dependent tables."""
    kept = latest(runs, ["out_dir"], F.desc("updated_at"), F.desc("run_id"))
    gone = runs.select("run_id").join(kept.select("run_id"), "run_id", "left_anti")
    return kept, {name: df.join(gone, "run_id", "left_anti") for name, df in tables.items()}


def _with_fetches(third_parties: Column, fetches: Column) -> Column:
    """Each third party (tp) with the last fetch of its domain in the same record (f)."""
    name = lambda x: F.lower(F.trim(x["third_party_etld1"]))
    each = lambda last: F.transform(third_parties, lambda tp: F.struct(tp.alias("tp"), F.get(last["f"], F.array_position(last["names"], name(tp)).cast("int") - 1).alias("f")))
    return F.get(F.transform(F.array(F.struct(F.transform(F.reverse(fetches), name).alias("names"), F.reverse(fetches).alias("f"))), each), F.lit(0))


def site_bundles(results: DataFrame, texts: DataFrame, blank: bool = False, shared: DataFrame | None = None) -> dict[str, DataFrame]:
    """Normalised tables of site records and policy texts (run_id, site_etld1, service_domain or null, text); blank texts are policies of sites too with blank.

    shared: texts of services (service_domain, text) that are the same for every site, in place of those of texts.
    """
    def measured(df: DataFrame) -> DataFrame:
        t = F.col("text")
        return df.select(*[c for c in df.columns if c != "text"], X.content_hash(t).alias("content_hash"), X.word_count(t).alias("word_count"), F.length(t).alias("char_count"), F.when(X.is_english(t), "en").otherwise("other").alias("language"))

    first = measured(texts.where("service_domain is null" if blank else "service_domain is null and trim(text) <> ''").select(*KEY, "text")).drop("language")
    site = F.trim(F.coalesce(F.nullif(F.trim("site_etld1"), F.lit("")), F.col("input")))
    res = results.withColumn("site_etld1", site)
    url = X.text_or_null(F.col("first_party_policy.url")) if "first_party_policy" in results.columns else F.lit(None).cast("string")
    document_id = lambda scope: X.document_id(F.lit(scope), F.col("url"), F.col("content_hash"))
    cols = ["document_id", "scope", "url", "content_hash", "language", "word_count", "char_count", "ingest_seq"]

    own = res.withColumn("url", url).join(first, KEY).withColumns({"scope": F.lit("first_party"), "document_id": document_id("first_party"), "language": F.when(F.coalesce("policy_is_english", F.lit(False)), "en").otherwise("other")})
    if "third_party_policy_fetches" in results.columns:
        found = _with_fetches(F.col("third_parties"), F.col("third_party_policy_fetches"))
    else:
        found = F.transform("third_parties", lambda tp: F.struct(tp.alias("tp"), F.lit(None).cast("struct<fetch_success:boolean,status_code:int,extraction_method:string,error_message:string>").alias("f")))
    tps = res.select(*KEY, "ingest_seq", F.explode(found).alias("x")).select(*KEY, "ingest_seq", "x.tp", "x.f").withColumn("service_domain", F.lower(F.trim("tp.third_party_etld1"))).where("service_domain <> ''").withColumn("url", X.text_or_null(F.col("tp.policy_url")))
    pair = [*KEY, "service_domain"]
    on = pair if shared is None else ["service_domain"]
    theirs = measured((texts.where("service_domain is not null") if shared is None else shared).where("trim(text) <> ''").select(*on[:-1], F.lower("service_domain").alias("service_domain"), "text"))
    latest_seq = F.max("ingest_seq").alias("ingest_seq")  # many sites have one document; it is found once before its id is made
    used = tps.select(*on, "url", "ingest_seq").groupBy(*on, "url").agg(latest_seq) if shared is not None else tps.select(*on, "url", "ingest_seq")
    used = used.join(theirs, on).groupBy("url", "content_hash", "language", "word_count", "char_count").agg(latest_seq).withColumns({"scope": F.lit("third_party"), "document_id": document_id("third_party")})
    tp = F.col("tp")
    links = tps.select(*pair, "url", tp["prevalence"].alias("prevalence"), F.col("f.fetch_success").alias("fetch_success"), F.col("f.status_code").alias("status_code"))
    if shared is not None:
        links = links.repartition(*pair)  # before the digests come, which are longer than the rest
    linked = links.join(theirs.select(*on, "content_hash"), on, "left").withColumn("document_id", F.when(F.col("content_hash").isNotNull(), document_id("third_party")))
    linked = linked.groupBy(*pair).agg(F.max("prevalence").alias("prevalence"), F.coalesce(F.max("fetch_success"), F.lit(False)).alias("fetch_success"), F.max("status_code").alias("fetch_status_code"), F.max("document_id").alias("fetched_policy_document_id"))
    return {
        "sites": res.select(*KEY, "rank", "main_category", "status"),
        "documents": latest(own.select(*cols).unionByName(used.select(*cols)), ["document_id"], F.desc("ingest_seq"), "language").drop("ingest_seq"),
        "site_policies": own.select(*KEY, "document_id"),
        "services": latest(tps.select("service_domain", X.text_or_null(tp["entity"]).alias("entity"), "url", X.mapping_source(tp["tracker_radar_source_domain_file"], tp["trackerdb_source_pattern_file"], tp["trackerdb_source_org_file"]).alias("mapping_source"), "ingest_seq"), ["service_domain"], F.desc("ingest_seq")).drop("ingest_seq"),
        "service_categories": tps.select("service_domain", F.explode(taxonomy.tracker_categories(tp["categories"])).alias("category")).distinct(),
        "site_services": linked,
    }
