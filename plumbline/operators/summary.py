"""Summary and figure tables over nested site records (one row for each site)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import constants as K
from plumbline.functions import taxonomy, urls


def _truthy(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def is_mapped(tp: Column) -> Column:
    """Whether any of radar file, entity, policy URL, prevalence or categories is there; 0 and '' are not."""
    has = [_truthy(tp[c]) for c in ("tracker_radar_source_domain_file", "entity", "policy_url")]
    return reduce(lambda a, b: a | b, has) | F.coalesce(tp["prevalence"] != 0, F.lit(False)) | F.coalesce(F.size(tp["categories"]) > 0, F.lit(False))


def occurrences(results: DataFrame) -> DataFrame:
    """One row for each third party of each site, with its keys, flags and normalised categories."""
    tp = F.col("tp")
    df = results.select("ingest_seq", "run_id", "site_etld1", "main_category", "policy_is_english", F.posexplode("third_parties").alias("tp_no", "tp"))
    keys = [tp["third_party_etld1"], tp["entity"], tp["policy_url"]]
    radar = _truthy(tp["tracker_radar_source_domain_file"])
    tdb = ~radar & (_truthy(tp["trackerdb_source_pattern_file"]) | _truthy(tp["trackerdb_source_org_file"]))
    raw = F.filter(F.coalesce(tp["categories"], F.array().cast("array<string>")), lambda c: F.trim(c) != "")
    return df.select(
        "ingest_seq", "run_id", "site_etld1", "main_category", "policy_is_english", "tp_no", tp["entity"].alias("entity"), tp["prevalence"].alias("prevalence"),
        F.nullif(urls.unique_key(*keys), F.lit("")).alias("count_key"), F.nullif(urls.service_key(*keys), F.lit("")).alias("service_key"),
        is_mapped(tp).alias("mapped"), _truthy(tp["policy_url"]).alias("has_policy"), radar.alias("radar"), tdb.alias("trackerdb"),
        F.transform(raw, taxonomy.tracker_category).alias("categories"),
    )


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy(F.coalesce(F.nullif("status", F.lit("")), F.lit("unknown")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def overview(results: DataFrame) -> DataFrame:
    """Processed and successful sites, success rate, last ranks (ties: the later record), English and qualified counts."""
    rank = F.when(F.col("rank") > 0, F.col("rank"))
    ok = F.col("status") == "ok"
    site = F.coalesce(F.nullif(F.trim("site_etld1"), F.lit("")), F.nullif(F.trim("input"), F.lit("")))
    at = F.struct(rank.alias("rank"), "ingest_seq", site.alias("site"))
    english = F.coalesce("policy_is_english", F.lit(False))
    qualified = ok & english & (F.coalesce("first_party_policy_word_count", F.lit(0)) >= 100) & (F.coalesce("third_party_with_english_policy_count", F.lit(0)) > 0)
    agg = results.agg(
        F.count(F.lit(1)).alias("processed_sites"), F.count_if(ok).alias("ok_sites"), F.max(F.when(rank.isNotNull(), at)).alias("last"), F.max(F.when(ok & rank.isNotNull(), at)).alias("last_ok"),
        F.count_if(english).alias("english_policy_count"), F.count_if(qualified).alias("qualified_site_count"),
    )
    rate = F.when(F.col("processed_sites") > 0, F.round(F.col("ok_sites") / F.col("processed_sites") * 100, 2)).otherwise(0.0)
    return agg.select("processed_sites", "ok_sites", rate.alias("success_rate"), F.col("last.rank").alias("last_processed_rank"), F.col("last.site").alias("last_processed_site"), F.col("last_ok.rank").alias("last_successful_rank"), F.col("last_ok.site").alias("last_successful_site"), "english_policy_count", "qualified_site_count")


def third_party_counters(results: DataFrame, *by: str) -> DataFrame:
    """Occurrence counters and unique service counts, in one pass over the occurrences; of all records or by some columns."""
    o = occurrences(results)
    m, p, r, t = (F.col(c) for c in ("mapped", "has_policy", "radar", "trackerdb"))
    uniq = lambda cond: F.count_distinct(F.when(cond, F.col("count_key")))
    out = o.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(m).alias("mapped"), F.count_if(~m).alias("unmapped"), F.count_if(m & ~p).alias("no_policy_url"), F.count_if(r).alias("radar_mapped"), F.count_if(t).alias("trackerdb_mapped"),
        uniq(F.lit(True)).alias("unique_services"), uniq(m).alias("unique_mapped"), uniq(m & p).alias("unique_with_policy"), uniq(r).alias("unique_radar"), uniq(t).alias("unique_trackerdb"), uniq(~r & ~t).alias("unique_unmapped"),
    )
    return out.withColumn("without_source", F.greatest(F.lit(0).cast("long"), F.col("total") - F.col("radar_mapped") - F.col("trackerdb_mapped")))


def run_summaries(results: DataFrame) -> DataFrame:
    """One row for each run: sites, ok, English and qualified ones, success rate, last successful rank and the service counters."""
    sites = overview_by(results, "run_id")
    counters = third_party_counters(results, "run_id")
    out = sites.join(counters, "run_id", "left")
    return out.fillna(0, [c for c in counters.columns if c != "run_id"])


def overview_by(results: DataFrame, *by: str) -> DataFrame:
    ok, english = F.col("status") == "ok", F.coalesce("policy_is_english", F.lit(False))
    qualified = ok & english & (F.coalesce("first_party_policy_word_count", F.lit(0)) >= 100) & (F.coalesce("third_party_with_english_policy_count", F.lit(0)) > 0)
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("processed_sites"), F.count_if(ok).alias("ok_sites"), F.round(F.count_if(ok) / F.count(F.lit(1)) * 100, 2).alias("success_rate"), F.count_if(english).alias("english_policy_count"), F.count_if(qualified).alias("qualified_site_count"),
        F.max(F.when(ok & (F.col("rank") > 0), F.col("rank"))).alias("last_successful_rank"),
    )


def _coverage(o: DataFrame) -> DataFrame:
    """(category, n): distinct services of each category; a record without a key counts by itself."""
    by = o.select("ingest_seq", "tp_no", "service_key", F.explode(F.array_distinct("categories")).alias("category"))
    own = F.coalesce(F.col("service_key"), F.concat_ws("#", F.lit("row"), "ingest_seq", "tp_no"))
    return by.groupBy("category").agg(F.count_distinct(own).alias("n"))


def top(df: DataFrame, n: int, name: str, count: str = "n") -> DataFrame:
    """The n largest; ties by name."""
    return df.orderBy(F.desc(count), F.asc(name)).limit(n)


def category_coverage(results: DataFrame, n: int = 20) -> DataFrame:
    return top(_coverage(occurrences(results)), n, "category")


def site_categories(results: DataFrame, n: int = 20) -> DataFrame:
    return top(results.where(F.trim("main_category") != "").groupBy(F.trim("main_category").alias("category")).agg(F.count(F.lit(1)).alias("n")), n, "category")


def entities(results: DataFrame, n: int = 20, n_categories: int = 3) -> DataFrame:
    """Entities by occurrences, with mean prevalence over all of them, largest prevalence (both null where none is known) and top categories."""
    o = occurrences(results).where(F.trim("entity") != "").where("service_key is not null")
    base = o.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.sum("prevalence").alias("total"), F.when(F.count("prevalence") > 0, F.greatest(F.max("prevalence"), F.lit(0.0))).alias("prevalence_max"))
    base = top(base, n, "entity")
    cats = o.select("entity", F.explode("categories").alias("category")).groupBy("entity", "category").agg(F.count(F.lit(1)).alias("c"))
    ranked = cats.withColumn("at", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("c"), "category"))).where(F.col("at") <= n_categories)
    names = ranked.groupBy("entity").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "category"))), lambda x: x["category"]), ", ").alias("categories"))
    return base.join(names, "entity", "left").select("entity", "n", (F.col("total") / F.col("n")).alias("prevalence_avg"), "prevalence_max", F.coalesce("categories", F.lit("")).alias("categories"))


def _grid(spark) -> DataFrame:
    """Website by service categories, in display order: 16 by 9 rows."""
    rows = [(i, w, j, s) for i, w in enumerate(K.WEBSITE_CATEGORIES) for j, s in enumerate(K.SERVICE_CATEGORIES)]
    return spark.createDataFrame(rows, "website_order int, website_category string, service_order int, service_category string")


def density_heatmap(results: DataFrame) -> DataFrame:
    """English sites: of each website category, sites with at least one service of each service category."""
    en = results.where("policy_is_english").withColumn("website_category", taxonomy.website_category(F.col("main_category")))
    totals = en.where("website_category is not null").groupBy("website_category").agg(F.count(F.lit(1)).alias("sites_total"))
    cats = F.array_distinct(F.flatten(F.transform("third_parties", lambda tp: taxonomy.tracker_categories(tp["categories"]))))
    hits = en.select("website_category", F.explode(cats).alias("service_category")).groupBy("website_category", "service_category").agg(F.count(F.lit(1)).alias("sites_with"))
    df = F.broadcast(_grid(results.sparkSession)).join(totals, "website_category", "left").join(hits, ["website_category", "service_category"], "left")
    n, t = F.coalesce("sites_with", F.lit(0)), F.coalesce("sites_total", F.lit(0))
    return df.select("website_order", "website_category", "service_order", "service_category", n.alias("sites_with"), t.alias("sites_total"), F.when(t > 0, F.round(n / t * 100, 4)).otherwise(0.0).alias("pct"), (n == 0).alias("zero_overlap"))


def heatmap_peak(heatmap: DataFrame) -> DataFrame:
    """The largest share of the grid, for its scale; 0 without sites."""
    return heatmap.agg(F.coalesce(F.max("pct"), F.lit(0.0)).alias("max_pct"))


def figure_entities(results: DataFrame, n: int = 15) -> DataFrame:
    """English sites: categories of the top entities with their share of the entity's category counts."""
    o = occurrences(results).where("policy_is_english").where(F.trim("entity") != "")
    best = top(o.groupBy("entity").agg(F.count(F.lit(1)).alias("occurrences")), n, "entity", "occurrences")
    cats = o.select("entity", F.explode(F.array_distinct("categories")).alias("category")).groupBy("entity", "category").agg(F.count(F.lit(1)).alias("n"))
    share = F.round(F.col("n") / F.sum("n").over(Window.partitionBy("entity")) * 100, 4)
    return best.join(cats, "entity").select("entity", "occurrences", "category", "n", share.alias("pct"))


def figure_distribution(results: DataFrame) -> DataFrame:
    """English sites: dense tables of website and service categories in display order."""
    spark = results.sparkSession
    order = spark.createDataFrame([("website", i, c) for i, c in enumerate(K.WEBSITE_CATEGORIES)] + [("service", i, c) for i, c in enumerate(K.SERVICE_CATEGORIES)], "kind string, position int, category string")
    en = results.where("policy_is_english")
    web = en.groupBy(taxonomy.website_category(F.col("main_category")).alias("category")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("website"))
    svc = _coverage(occurrences(en)).withColumn("kind", F.lit("service"))
    return F.broadcast(order).join(web.unionByName(svc), ["kind", "category"], "left").select("kind", "position", "category", F.coalesce("n", F.lit(0)).alias("n"))


def figure_overview(results: DataFrame, targeted: int | None = None) -> DataFrame:
    """Sites asked for (at least those processed), processed and English ones, and the services of the English ones."""
    o = occurrences(results.where("policy_is_english"))
    uniq = lambda cond: F.count_distinct(F.when(cond, F.col("count_key")))
    a = o.agg(uniq(F.lit(True)).alias("unique_services"), uniq(F.col("mapped")).alias("mapped_services"), uniq(F.col("mapped") & F.col("has_policy")).alias("services_with_policy"))
    s = results.agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.coalesce("policy_is_english", F.lit(False))).alias("english"))
    pct = F.when(F.col("unique_services") > 0, F.round(F.col("mapped_services") / F.col("unique_services") * 100, 4)).otherwise(0.0)
    return s.crossJoin(a).withColumns({"coverage_pct": pct, "targeted": F.greatest("processed", F.lit(targeted or 0).cast("long"))})  # one row each


def live_results(results: DataFrame) -> DataFrame:
    """The last record of each site (lower-cased, trimmed key); records without a key stay."""
    key = F.lower(F.trim(F.coalesce(F.nullif(F.trim("site_etld1"), F.lit("")), F.col("input"))))
    df = results.withColumn("__key", F.coalesce(F.nullif(key, F.lit("")), F.concat(F.lit("row#"), F.col("ingest_seq").cast("string"))))
    last = F.row_number().over(Window.partitionBy("__key").orderBy(F.desc("ingest_seq")))
    return df.withColumn("__at", last).where("__at = 1").drop("__at", "__key")


def explorer_results(sites: DataFrame) -> DataFrame:
    """Explorer rows as records: services without a name are left out, none has a source file, and no site is qualified."""
    no = F.lit(None).cast("string")
    tp = lambda t: F.struct(t["name"].alias("third_party_etld1"), t["entity"].alias("entity"), t["categories"].alias("categories"), t["prevalence"].alias("prevalence"), t["policyUrl"].alias("policy_url"), *[no.alias(c) for c in ("tracker_radar_source_domain_file", "trackerdb_source_pattern_file", "trackerdb_source_org_file")], t["extractionMethod"].alias("policy_extraction_method"))
    named = F.filter("thirdParties", lambda t: t["name"] != "")
    return sites.select(
        "ingest_seq", "run_id", F.col("site").alias("input"), F.col("site").alias("site_etld1"), "rank", F.col("mainCategory").alias("main_category"), "status", "policy_is_english",
        F.lit(0).alias("first_party_policy_word_count"), F.lit(0).alias("third_party_with_english_policy_count"), F.transform(named, tp).alias("third_parties"),
    )


def _live(results: DataFrame, sites: DataFrame | None) -> DataFrame:
    return live_results(explorer_results(sites) if sites is not None and results.isEmpty() else results)


def live_summary(results: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """Counters of the last record of each site; of explorer rows only where there is no record.

    Here a service with any source file is mapped, and an unmapped one is one that is not mapped;
    without_source is the summary's number of services without a file.
    """
    live = _live(results, sites)
    o = occurrences(live)
    m, p, r, t = F.col("mapped") | F.col("radar") | F.col("trackerdb"), F.col("has_policy"), F.col("radar"), F.col("trackerdb")
    uniq = lambda cond: F.count_distinct(F.when(cond, F.col("count_key")))
    a = o.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(m).alias("mapped"), F.count_if(~m).alias("unmapped"), F.count_if(m & ~p).alias("no_policy_url"), F.count_if(r).alias("radar_mapped"), F.count_if(t).alias("trackerdb_mapped"),
        uniq(F.lit(True)).alias("unique_services"), uniq(m).alias("unique_mapped"), uniq(~m).alias("unique_unmapped"), uniq(m & p).alias("unique_with_policy"), uniq(r).alias("unique_radar"), uniq(t).alias("unique_trackerdb"),
    )
    a = a.withColumn("without_source", F.greatest(F.lit(0).cast("long"), F.col("total") - F.col("radar_mapped") - F.col("trackerdb_mapped")))
    ok, english = F.col("status") == "ok", F.coalesce("policy_is_english", F.lit(False))
    qualified = ok & english & (F.coalesce("first_party_policy_word_count", F.lit(0)) >= 100) & (F.coalesce("third_party_with_english_policy_count", F.lit(0)) > 0)
    if "qualified_site" in live.columns:
        qualified = F.coalesce("qualified_site", F.lit(False)) | qualified
    s = live.agg(F.count(F.lit(1)).alias("processed_sites"), F.count_if(ok).alias("ok_sites"), F.count_if(english).alias("english_policy_count"), F.count_if(qualified).alias("qualified_site_count"))
    rate = F.when(F.col("processed_sites") > 0, F.round(F.col("ok_sites") / F.col("processed_sites") * 100, 2)).otherwise(0.0)
    return s.withColumn("success_rate", rate).crossJoin(a)  # one row each


def live_categories(results: DataFrame, sites: DataFrame | None = None, n: int = 20) -> DataFrame:
    """Distinct services of each category, known categories in display order first, then others by number and name."""
    order = F.create_map(*[x for i, c in enumerate(K.SERVICE_CATEGORIES) for x in (F.lit(c), F.lit(i))])
    counts = _coverage(occurrences(_live(results, sites))).withColumn("position", order[F.col("category")])
    return counts.orderBy(F.asc_nulls_last("position"), F.desc("n"), "category").limit(n)


def resolve_summary(persisted: DataFrame, live: DataFrame) -> DataFrame:
    """The persisted summary where it has more processed sites, else the live one (one row each)."""
    both = live.withColumn("origin", F.lit("live")).unionByName(persisted.withColumn("origin", F.lit("persisted")), allowMissingColumns=True)
    return both.orderBy(F.desc("processed_sites"), "origin").limit(1)


def mapping_shares(counters: DataFrame) -> DataFrame:
    """Services by source and whole percentages of them, from one row of counters.

    Counters without unique numbers by source (older summaries) share the unique services out by
    occurrences; without occurrences every mapped service counts for the first source.
    """
    half_up = lambda c: F.floor(c + 0.5)
    n, rest = F.coalesce("unique_services", F.lit(0)), lambda *c: F.greatest(F.lit(0).cast("long"), *c)
    known = [c if c in counters.columns else None for c in ("unique_radar", "unique_trackerdb", "unique_unmapped")]
    own_radar, own_tdb, own_rest = [F.col(c) if c else F.lit(None).cast("long") for c in known]
    raw = [F.coalesce(c, F.lit(0)) for c in ("radar_mapped", "trackerdb_mapped", "without_source")]
    total = raw[0] + raw[1] + raw[2]
    new, shared = own_radar.isNotNull() | own_tdb.isNotNull(), (total > 0) & (n > 0)
    radar = F.when(new, F.coalesce(own_radar, F.lit(0))).when(shared, half_up(n * raw[0] / total)).otherwise(F.coalesce("unique_mapped", F.lit(0)))
    tdb = F.when(new, F.coalesce(own_tdb, F.lit(0))).when(shared, half_up(n * raw[1] / total)).otherwise(0)
    df = counters.select(n.alias("services"), radar.alias("radar"), tdb.alias("trackerdb"), F.when(new, own_rest).alias("__rest"))
    pct = lambda c: F.when(F.col("services") > 0, half_up(F.col(c) / F.col("services") * 100)).otherwise(0)
    df = df.select("services", "radar", "trackerdb", F.coalesce("__rest", rest(F.col("services") - F.col("radar") - F.col("trackerdb"))).alias("unmapped"), pct("radar").alias("radar_pct"), pct("trackerdb").alias("trackerdb_pct"))
    df = df.withColumn("unmapped_pct", rest(100 - F.col("radar_pct") - F.col("trackerdb_pct")))
    return df.withColumn("mapped_pct", rest(100 - F.col("unmapped_pct")))


def failure_shares(results: DataFrame) -> DataFrame:
    """Each status' share of all sites, and whether it is a failure."""
    c = status_counts(results)
    total = c.agg(F.sum("n").alias("total"))
    bad = F.col("status").isin("home_fetch_failed", "exception", "non_browsable")
    return c.crossJoin(F.broadcast(total)).select("status", "n", F.round(F.col("n") / F.col("total") * 100, 2).alias("pct"), bad.alias("is_failure"))  # total is one row


def progress(results: DataFrame, total_override: int | None = None) -> DataFrame:
    """First start, sites seen and the run's target total: at least the distinct sites."""
    seen = F.count_distinct(F.lower(F.coalesce("site_etld1", "input")))
    return results.groupBy("run_id").agg(F.min("ingest_seq").alias("first_seq"), seen.alias("sites_seen"), F.greatest(seen, F.lit(total_override or 0).cast("long")).alias("total_sites"))


def run_starts(results: DataFrame, persisted: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """run_id, started_at: the persisted one (run_id, started_at), else that of the run's first record that has one, else now; runs without a record too."""
    said = F.nullif(F.trim("started_at"), F.lit(""))
    first = results.groupBy("run_id").agg(F.min_by("started_at", F.when(said.isNotNull(), F.col("ingest_seq"))).alias("first"))
    if persisted is not None:
        first = first.join(persisted.groupBy("run_id").agg(F.min(F.when(said.isNotNull(), F.col("started_at"))).alias("kept")), "run_id", "full")
    else:
        first = first.withColumn("kept", F.lit(None).cast("string"))
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX") if now is None else now
    return first.select("run_id", F.coalesce("kept", "first", now).alias("started_at"))


def snapshot_totals(snapshots: DataFrame) -> DataFrame:
    """run_id, target_total: of (summary_total, state_total, expected_total, top_n) the first that is there; null when that is not positive."""
    total = F.coalesce("summary_total", "state_total", "expected_total", "top_n")
    return snapshots.select("run_id", F.when(total > 0, total).alias("target_total"))


def enrich_policy_metrics(results: DataFrame, texts: DataFrame, contents: DataFrame | None = None, empty: bool = False) -> DataFrame:
    """First-party word count and number of English third-party policies, from (run_id, site_etld1, service_domain, text).

    With contents (text_id, text), texts have a text_id in place of the text, and each text is measured
    once. Empty texts are English with empty, else not.
    """
    from plumbline.functions import text as X

    def measured(df: DataFrame) -> DataFrame:
        t = F.col("text")
        english = X.is_english(t) if empty else (t != "") & X.is_english(t)
        return df.select(*[c for c in df.columns if c != "text"], X.word_count(t).alias("__n"), english.alias("__en"))

    first = F.col("service_domain").isNull()
    t = measured(texts) if contents is None else texts.join(measured(contents), "text_id")
    t = t.groupBy("run_id", "site_etld1").agg(F.max(F.when(first, F.col("__n"))).alias("__words"), F.count_if(~first & F.col("__en")).cast("int").alias("__english"))
    df = results.drop("first_party_policy_word_count", "third_party_with_english_policy_count").join(t, ["run_id", "site_etld1"], "left")
    return df.withColumns({"first_party_policy_word_count": F.coalesce("__words", F.lit(0)), "third_party_with_english_policy_count": F.coalesce("__english", F.lit(0))}).drop("__words", "__english")


def recover_english_flag(results: DataFrame, markers: DataFrame) -> DataFrame:
    """Take policy_is_english from the markers (site_etld1, policy_is_english) where a record lacks it."""
    m = markers.groupBy("site_etld1").agg(F.max("policy_is_english").alias("__flag"))
    return results.join(m, "site_etld1", "left").withColumn("policy_is_english", F.coalesce("policy_is_english", "__flag")).drop("__flag")


def explorer(results: DataFrame) -> DataFrame:
    """Flat records for browsing: the site with its third parties' names, entities, raw categories and fetch methods.

    A service without a method of its own takes that of its last fetch, where the records have fetches.
    """
    fetches = F.col("third_party_policy_fetches") if "third_party_policy_fetches" in results.columns else None

    def one(tp: Column) -> Column:
        method = F.nullif(tp["policy_extraction_method"], F.lit(""))
        if fetches is not None:
            method = F.coalesce(method, F.try_element_at(F.filter(fetches, lambda f: f["third_party_etld1"] == tp["third_party_etld1"]), F.lit(-1))["extraction_method"])
        raw = F.coalesce(tp["categories"], F.array().cast("array<string>"))
        return F.struct(tp["third_party_etld1"].alias("name"), tp["entity"].alias("entity"), raw.alias("categories"), tp["prevalence"].alias("prevalence"), tp["policy_url"].alias("policyUrl"), method.alias("extractionMethod"))

    site = F.coalesce(F.nullif("site_etld1", F.lit("")), F.col("input"))
    first = F.col("first_party_policy") if "first_party_policy" in results.columns else F.lit(None).cast("struct<url: string, extraction_method: string>")
    return results.where(site.isNotNull()).select(
        "ingest_seq", "run_id", site.alias("site"), "rank", F.col("main_category").alias("mainCategory"), "status", "policy_is_english", first["url"].alias("policyUrl"), first["extraction_method"].alias("extractionMethod"), F.transform("third_parties", one).alias("thirdParties"),
    )


def filter_explorer(df: DataFrame, status: str | None = None, min_third_parties: int = 0, query: str = "") -> DataFrame:
    df = df.where(F.size("thirdParties") >= min_third_parties)
    if status:
        df = df.where(F.col("status") == status)
    return df.where(F.contains(F.lower("site"), F.lit(query.strip().lower()))) if query.strip() else df
