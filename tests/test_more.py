"""Whole-catalog jobs and the smaller operators."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import catalog, mapping, pages, sites, summary, views
from plumbline.plans import annotation, reindex
from plumbline.schemas import schema
from plumbline.streaming import events as E

from .test_golden import results


def texts(spark, *rows):
    return spark.createDataFrame(rows, schema("policy_text"))


def runs(spark, *rows):
    return spark.createDataFrame(rows, "run_id string, out_dir string, updated_at string")


def test_reindex_replaces_runs(spark):
    tp = {"third_party_etld1": "t.com", "entity": "E", "categories": ["cdn"], "policy_url": "https://t.com/p"}
    site = {"site_etld1": "a.com", "input": "a.com", "status": "ok", "policy_is_english": True, "main_category": "news", "third_parties": [tp]}
    text = texts(spark, ("r", "a.com", None, "own policy"), ("r", "a.com", "t.com", "their policy"))
    first = reindex.reindex(results(spark, site), text, runs(spark, ("r", "out", "1")))
    s = first["site_search"].first()
    assert (s.third_party_count, s.third_party_with_policy_count, s.has_policy, s.third_party_categories) == (1, 1, True, ["CDN & Hosting"])
    assert first["category_rollups"].first().site_category == "news"
    second = reindex.reindex(results(spark, {**site, "run_id": "r2"}), text.withColumn("run_id", F.lit("r2")), runs(spark, ("r2", "out", "2")), first)
    assert [r.run_id for r in second["site_search"].collect()] == ["r2"] and second["documents"].count() == 2 and second["services"].count() == 1


def test_a_broken_run_is_logged(spark, tmp_path):
    def load(run):
        if run == "bad":
            raise ValueError("no such folder")
        return results(spark, {"site_etld1": "a.com", "status": "ok"}), texts(spark, ("r", "a.com", None, "x")), runs(spark, ("r", "o", "1"))

    log = {r.run_id: r for r in reindex.ingest_runs(spark, ["r", "bad"], load, str(tmp_path)).collect()}
    assert (log["r"].status, log["bad"].status, log["bad"].error) == ("completed", "failed", "no such folder")
    a = catalog.ingestion_audit(spark.createDataFrame(list(log.values()))).first()
    assert (a.total, a.completed, a.errors) == (2, 1, 1)


def test_reports_and_state(spark):
    rep = reindex.run_reports(results(spark, {"status": "ok", "rank": 2, "site_etld1": "a"}))
    assert {n: df.count() for n, df in rep.items()}["heatmap"] == 144
    assert reindex.run_state(rep["overview"], 9).first().last_successful_rank == 2


def test_site_plan(spark):
    rows = [(1, "1", "A.com", "200", "200", "Games"), (2, "2", "a.com", "200", "200", ""), (3, "3", "x.gtld-servers.net", "200", "200", ""), (4, "4", "b.com", "404", "200", ""), (5, "5", "c.com", "", "200", ""), (6, "6", "d.com", "301", " 200 ", "Nudity|Games"), (7, "7", "e.com", "oops", "200", "")]
    df = spark.createDataFrame(rows, "seq long, tranco_id string, domain string, status_code string, crux_code string, categories string")
    none = spark.createDataFrame([], "site string")
    got = {r.site: (r.main_category, r.skip_reason) for r in sites.plan_sites(df, 10, spark.createDataFrame([("d.com",)], "site string"), none, none).collect()}
    assert got == {"A.com": ("Entertainment", None), "d.com": ("Adult", "done")}
    names = spark.createDataFrame([("a.com",), ("www.b.com.",), ("c.org",)], "domain string")
    assert sorted(r.domain for r in sites.exclude_domains(names, ["b.com"], spark.createDataFrame([("A.com",)], "d string")).collect()) == ["c.org"]
    assert [r.site for r in sites.origin_allowed(spark.createDataFrame([("A.com",), ("b.com",)], "site string"), spark.createDataFrame([("http://a.com",)], "origin string")).collect()] == ["A.com"]
    assert [r.rank for r in sites.fill_target(spark.createDataFrame([(3, True), (1, False), (2, True)], "rank int, ok boolean"), F.col("ok"), 1).collect()] == [2]
    assert sites.skip_failed_home(spark.createDataFrame([("home_fetch_failed",), (None,)], "status string")).count() == 1


def test_radar_index_precedence(spark):
    files = lambda *rows: spark.createDataFrame(rows, "path string, text string")
    d = files(
        ("d/a.json", '{"domain": "A.com", "owner": {"name": "Own", "displayName": "Disp", "policyUrl": "ftp://no"}, "prevalence": 0.5, "categories": ["x", 1]}'),
        ("d/b.json", '{"domain": "b.com", "owner": {"name": "", "displayName": "Disp"}, "privacyPolicy": "https://b", "prevalence": {"overall": 2}}'),
        ("d/c.com.json", '{"owner": "text", "entity": "Ent", "categories": "one", "prevalence": "0.5"}'), ("d/d.json", "no json"), ("d/e.json", "{}"), ("d/f.json", '{"domain": "b.com", "entity": "Last"}'),
    )
    e = files(("e/o.json", '{"name": "Own", "policy_url": "https://own"}'), ("e/Ent.json", '{"name": " ", "properties": {"policy": "https://ent"}}'))
    got = {r.etld1: tuple(r[1:]) for r in mapping.radar_index(d, e).collect()}
    assert got == {"a.com": ("Own", ["x"], 0.5, "https://own", "d/a.json"), "b.com": ("Last", [], None, None, "d/f.json"), "c.com": ("Ent", ["one"], None, "https://ent", "d/c.com.json")}


def test_records(spark):
    homes = spark.createDataFrame([("a", True, None, None), ("b", True, "no_links_short_text", None), ("c", False, None, None), ("d", True, None, "timeout"), ("e", True, None, None)], "site string, home_ok boolean, reason string, error string")
    pol = spark.createDataFrame([("a", "https://a/p")], "site string, policy_url string")
    status = pages.site_status(homes, pol)
    assert {r.site: r.status for r in status.collect()} == {"a": "ok", "b": "non_browsable", "c": "home_fetch_failed", "d": "exception", "e": "policy_not_found"}
    tps = spark.createDataFrame([("a", "t.com", "E")], "site string, third_party_etld1 string, entity string")
    f = spark.createDataFrame([("a", "t.com", True, 200, 9, "main")], "site string, third_party_etld1 string, fetch_success boolean, status_code int, text_len int, extraction_method string")
    r = {x.site: x for x in pages.assemble_records(status, pol, tps, f).collect()}["a"]
    assert r.third_parties[0].policy_extraction_method == "main" and r.third_party_policy_fetches[0].text_len == 9 and r.first_party_policy.policy_url == "https://a/p"


def test_hubs(spark):
    c = spark.createDataFrame([("p", f"https://a/{n}", n, "body", True, s, i) for i, (n, s) in enumerate((("about", 1.0), ("shop", 9.0), ("legal", 3.0), ("terms", 2.0), ("imprint", 0.5)))], "url string, target string, anchor string, source string, same_site boolean, score double, ord int")
    assert [r.anchor for r in pages.hub_links(c).orderBy("hub_no").collect()] == ["legal", "terms", "about"]


def test_reuse(spark):
    plan = annotation.annotation_plan(spark.createDataFrame([("/r/a", "u.com", False), ("/r/b", "u.com", False)], "path string, source_url string, has_output boolean"))
    out = annotation.reuse_outputs(plan, spark.createDataFrame([("/r/a", 5)], "path string, statements int"))
    assert {(r.path, r.reused_from, r.statements) for r in out.collect()} == {("/r/a", None, 5), ("/r/b", "/r/a", 5)}
    p = lambda *names: spark.createDataFrame([(n,) for n in names], "path string")
    assert [r.path for r in annotation.filter_targets(p("/r/a", "/x/b"), p("/r/a", "/r/a", "/x/b"), "/r/").collect()] == ["/r/a"]
    got = annotation.source_urls(p("a", "b", "c"), spark.createDataFrame([("a", "HTTP://X.com")], "path string, source_url string"), spark.createDataFrame([("a", "http://y"), ("b", " http://y.com ")], "path string, text string"))
    assert {r.path: r.source_url for r in got.collect()} == {"a": "http://x.com/", "b": "http://y.com/", "c": None}


def test_views(spark):
    lines = spark.createDataFrame([(i, " " if i == 1 else f"l{i}") for i in range(5)], "seq long, line string")
    assert [r.seq for r in views.line_window(lines, 1, 2).collect()] == [2, 3]
    res = results(spark, {"site_etld1": "b", "rank": None}, {"site_etld1": "a", "rank": 2}, {"input": " "})
    assert [r.site_etld1 for r in views.bundle_order(views.with_site(res)).collect()] == ["a", "b"]
    old = spark.createDataFrame([(1, "a", "x"), (2, None, "y")], "ingest_seq long, site string, v string")
    assert {(r.site, r.v) for r in views.upsert_explorer(old, spark.createDataFrame([(3, "a", "z")], old.schema)).collect()} == {("a", "z"), (None, "y")}
    live = summary.live_results(results(spark, {"site_etld1": "A ", "status": "x"}, {"site_etld1": "a", "status": "ok"}, {"status": "n"}, {"status": "m"}))
    assert sorted(r.status for r in live.collect()) == ["m", "n", "ok"]


def test_event_frames(spark):
    d = spark.createDataFrame([("s", 0, 1, "p", 2, "b"), ("s", 0, 1, "p", 1, "a")], "site string, chunk int, round int, phase string, seq int, delta string")
    assert E.join_deltas(d).first().text == "ab"
    ev = spark.createDataFrame([(i, "site_started" if i % 2 else "odd", "t") for i in range(6)], "seq long, type string, timestamp string")
    assert [r.seq for r in E.replay(ev, 1, 3).collect()] == [3, 4, 5] and E.known_types(ev).count() == 3
    use = spark.createDataFrame([("r", "2024-01-01 00:00:00", 5), ("r", "2024-01-01 00:00:50", 7), ("r", "2024-01-01 00:01:55", 1)], "run_id string, ts string, tokens int")
    assert sorted(r.tokens_last_minute for r in E.token_rate(use).collect()) == [1, 5, 12]


@pytest.mark.parametrize("name", ["site_result", "policy_cache", "event", "tracker_entry"])
def test_schemas_parse(name):
    assert len(schema(name)) > 5


def test_rows_are_numbered_across_partitions(spark):
    from plumbline.operators import sites
    from plumbline.sources import readers

    df = readers.numbered(spark.range(0, 1000, 1, 7).withColumn("domain", F.concat(F.lit("d"), F.col("id").cast("string"))))
    assert all(r.seq == r.id + 1 for r in df.collect())
    got = sites.load_dataset(df.select("seq", "domain", F.lit(None).cast("string").alias("tranco_id")), 5, 990).collect()
    assert [(r.domain, r["rank"]) for r in got] == [(f"d{i}", i + 1) for i in range(990, 995)]


def test_phrases_keep_words_apart():
    from plumbline.operators.statements import phrase_pattern

    assert phrase_pattern("no tice").search("a notice") is None and phrase_pattern("no tice").search("no  tice")
    assert phrase_pattern("e-mail address").search("Email addresses") and phrase_pattern("share, data").search("shares data")


def test_cost_bands(spark):
    from plumbline.functions import text as X

    c = X.annotation_cost(F.lit(4000), F.lit("chars"), F.lit("gpt-4o"))
    r = spark.range(1).select(*[v.alias(k) for k, v in c.items()]).first()
    assert (r.tokens, r.chunks, r.tokens_in_low, r.tokens_out_low) == (1000, 3, 2100 + 3 * 858, 160)
    assert abs(r.usd_high - ((4200 + 3 * 1615) * 2.5 + 450 * 10) / 1e6) < 1e-12
    est = lambda n, u: spark.range(1).select(X.estimate_tokens(F.lit(n), F.lit(u)).alias("x")).first().x
    assert [est(10, "tokens"), est(10, "words"), est(2, "kb"), est(10, "chars"), est(-5, "words")] == [10, 13, 512, 3, 0]


def test_live_rules(spark):
    from plumbline.operators import summary
    from plumbline.schemas import schema

    tp = lambda name, **kw: {"third_party_etld1": name, **kw}
    rows = [
        {"ingest_seq": 1, "site_etld1": "A.com", "status": "exception", "third_parties": [tp("gone.com")]},
        {"ingest_seq": 2, "site_etld1": " a.com", "status": "ok", "qualified_site": True, "third_parties": [tp("t.com", trackerdb_source_org_file="o"), tp("u.com"), tp(None)]},
        {"ingest_seq": 3, "input": " ", "status": None, "third_parties": None},
        {"ingest_seq": 4, "input": " ", "status": "", "third_parties": [], "policy_is_english": True},
    ]
    df = spark.createDataFrame(rows, schema("site_result"))
    got = summary.live_summary(df).first()
    assert (got.processed_sites, got.ok_sites, got.qualified_site_count, got.english_policy_count, got.success_rate) == (3, 1, 1, 1, 33.33)
    assert (got.total, got.mapped, got.unmapped, got.unique_services, got.unique_unmapped, got.trackerdb_mapped, got.without_source) == (3, 1, 2, 2, 1, 1, 2)
    sites = summary.explorer(df)
    alone = summary.live_summary(df.limit(0), sites).first()
    assert (alone.processed_sites, alone.total, alone.mapped, alone.trackerdb_mapped, alone.qualified_site_count) == (3, 2, 0, 0, 0)
    assert summary.live_summary(df, sites.limit(0)).first() == got
    live, persisted = summary.live_summary(df), summary.live_summary(df)
    assert summary.resolve_summary(persisted, live).first().origin == "live"
    assert summary.resolve_summary(persisted.withColumn("processed_sites", F.lit(4).cast("long")), live).first().origin == "persisted"
    empty = summary.live_summary(df.limit(0)).first()
    assert (empty.processed_sites, empty.success_rate, empty.total) == (0, 0.0, 0) and summary.live_categories(df.limit(0)).count() == 0


def test_mapping_shares(spark):
    from plumbline.operators import summary

    kind = "unique_services long, unique_mapped long, radar_mapped long, trackerdb_mapped long, without_source long"
    old = spark.createDataFrame([(10, 4, 1, 1, 2), (10, 4, 0, 0, 0), (0, 0, 5, 0, 0), (None, None, None, None, None)], kind)
    got = [tuple(r) for r in summary.mapping_shares(old).collect()]
    assert got == [(10, 3, 3, 4, 30, 30, 40, 60), (10, 4, 0, 6, 40, 0, 60, 40), (0, 0, 0, 0, 0, 0, 100, 0), (0, 0, 0, 0, 0, 0, 100, 0)]
    new = old.limit(1).select("*", F.lit(7).cast("long").alias("unique_radar"), F.lit(None).cast("long").alias("unique_trackerdb"))
    assert tuple(summary.mapping_shares(new).first()) == (10, 7, 0, 3, 70, 0, 30, 70)


def test_explorer_methods(spark):
    from plumbline.operators import summary
    from plumbline.schemas import schema

    fetches = [{"third_party_etld1": "a.com", "extraction_method": "first"}, {"third_party_etld1": "a.com", "extraction_method": "last"}, {"third_party_etld1": "b.com", "extraction_method": "first"}, {"third_party_etld1": "b.com"}]
    tps = [{"third_party_etld1": n, "policy_extraction_method": m, "categories": c} for n, m, c in (("a.com", "", ["x", "x"]), ("b.com", None, None), ("c.com", None, []), ("a.com", "own", []), (None, None, []))]
    rows = [{"ingest_seq": 1, "site_etld1": "", "input": "in", "third_parties": tps, "third_party_policy_fetches": fetches, "first_party_policy": {"url": "p", "extraction_method": "m"}}, {"ingest_seq": 2, "site_etld1": "s", "third_parties": tps}, {"ingest_seq": 3}]
    got = {r.site: r for r in summary.explorer(spark.createDataFrame(rows, schema("site_result"))).collect()}
    assert [t.extractionMethod for t in got["in"].thirdParties] == ["last", None, None, "own", None] and [t.categories for t in got["in"].thirdParties][:2] == [["x", "x"], []]
    assert (got["in"].policyUrl, got["in"].extractionMethod) == ("p", "m") and [t.extractionMethod for t in got["s"].thirdParties] == [None, None, None, "own", None] and len(got) == 2
