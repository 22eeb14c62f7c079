"""Queries against their SQL on tables with odd rows."""

import duckdb
from pyspark.sql import functions as F

from plumbline import queries
from plumbline.functions import html
from plumbline.functions import text as X
from plumbline.operators import catalog, summary, views
from plumbline.streaming import events as E
from tests.test_sql import SF, TABLES, plain


def same(spark, tmp_path, name, **changed):
    """Rows of the query on the smallest tables with some replaced by SQL over them; they have to equal those of its SQL."""
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t}0 as select * from read_parquet('{SF}/{t}.parquet')")
        con.sql(f"copy ({changed.get(t, f'select * from {t}0')}) to '{tmp_path}/{t}.parquet'")
        con.sql(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet')")
    df = queries.QUERIES[name](spark, str(tmp_path))
    cols = sorted(df.columns)
    key = lambda r: [(x is None, str(x)) for x in r]
    got = sorted([tuple(map(plain, r)) for r in df.select(*cols).collect()], key=key)
    rel = con.sql(queries.ORACLE_SQL[name])
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted([tuple(plain(r[i]) for i in at) for r in rel.fetchall()], key=key)
    return got


def test_references_without_semicolon(spark, tmp_path):
    assert html.main_text("<p>a&amp;&amp</p><p>&lt;b&gt; &copy &#65; &#66 &none; &notit; &") == ("a&&amp\n<b> &copy A &#66 &none; &notit; &", "body")
    assert html.links('<a href="/x?a=1&amp;b&copy=2">&quot;t&quot</a>') == [("body", '"t&quot', "/x?a=1&b&copy=2")]
    same(spark, tmp_path, "main_text", pages="select * replace (replace(html, '<article>', '<article>cut &amp;&amp' || chr(10) || '&lt &copy; &#x27; ') as html) from pages0")


def test_runs_beyond_their_total(spark, tmp_path):
    got = same(spark, tmp_path, "run_eta", events="select * replace (event_id * 3000 as event_id) from events0")
    assert all(int(r[0]) < 0 < int(r[1]) for r in got)  # eta_min, left_sites, run_id
    s = spark.createDataFrame([("r", 90, 100, 1000), ("r", 120, 100, 101000), ("r", 100, 100, 1000)], "run_id string, processed_sites int, total_sites int, timestamp_ms long")
    [r] = E.eta(s, spark.createDataFrame([], "run_id string, started_at_ms long")).collect()
    assert (r.eta_ms, r.ahead_sites, round(r.ahead_ms)) == (0, -20, -66667)  # 30 sites in 100 s: of two samples of one time the first


ODD_TEXTS = "select * replace (case doc_id when 0 then '' when 1 then ' ' when 2 then chr(9) || chr(10) when 3 then chr(11) || 'a b' || chr(11) || 'c' when 4 then 'cookie' when 5 then 'PR\u0130VACY' when 10 then '' when 20 then chr(160) || 'a' || chr(133) || 'b' else text end as text) from documents0"


def test_likeliness_of_odd_texts(spark, tmp_path):
    got = same(spark, tmp_path, "policy_likeliness", documents=ODD_TEXTS.replace("case doc_id", "case doc_id when 6 then null"))
    assert [r for r in got if r[0] == 0] == [(0, 0.0)]
    t = spark.createDataFrame([("",), (None,), (" ",)], "text string").select(X.policy_likeliness(F.col("text")).alias("s")).collect()
    assert [r.s for r in t] == [-10.0, -10.0, 0.0]


def test_bundles_of_blank_texts(spark, tmp_path):
    got = {t: n for n, t in same(spark, tmp_path, "site_bundles", documents=ODD_TEXTS.replace("case doc_id", "case doc_id when 6 then null when 7 then ''"), customer="select * replace (abs(c_acctbal) as c_acctbal) from customer0")}
    assert got["site_policies"] == 150


def test_shared_texts_by_digest(spark):
    tps = "array<struct<third_party_etld1: string, policy_url: string, policy_extraction_method: string>>"
    res = spark.createDataFrame([("r", "a", "ok", [("s", "u", "m"), ("t", "u", None), ("v", "", "m")]), ("r", "b", "ok", [("s", "w", "m")]), ("r", "c", "failed", [("s", "u", "m")])], f"run_id string, site_etld1 string, status string, third_parties {tps}")
    texts = spark.createDataFrame([("r", "a", None, "own a"), ("r", "b", None, " "), ("r", "a", "s", "of all  s"), ("r", "b", "s", "of all  s"), ("r", "c", "s", "of all  s")], "run_id string, site_etld1 string, service_domain string, text string")
    whole = views.consistency_pairs(res, texts)
    digest = F.sha2("text", 256).alias("text")
    measures = [digest, F.length("text").alias("chars"), X.space_words(F.col("text")).alias("words")]
    own = texts.where("service_domain is null").select("run_id", "site_etld1", "service_domain", *measures)
    got = views.consistency_pairs(res, own, spark.createDataFrame([("s", "of all  s")], "service_domain string, text string").select("service_domain", *measures))
    want = whole.withColumns({"site_text": F.sha2("site_text", 256), "text": F.sha2("text", 256)}).select(*got.columns)
    rows = sorted(map(str, got.collect()))
    assert len(rows) == 3 and rows == sorted(map(str, want.collect()))


def test_metrics_of_texts_by_id(spark, tmp_path):
    same(spark, tmp_path, "policy_metrics", documents=ODD_TEXTS.replace("chr(11)", "chr(9)"))
    res = spark.createDataFrame([("r", "a"), ("r", "b")], "run_id string, site_etld1 string")
    texts = spark.createDataFrame([("r", "a", None, 1), ("r", "a", "s", 1), ("r", "a", "t", 2), ("r", "a", "u", 3)], "run_id string, site_etld1 string, service_domain string, text_id int")
    contents = spark.createDataFrame([(1, "two words"), (2, ""), (3, None)], "text_id int, text string")
    rows = lambda **more: sorted((r.site_etld1, r.first_party_policy_word_count, r.third_party_with_english_policy_count) for r in summary.enrich_policy_metrics(res, **more).collect())
    assert rows(texts=texts, contents=contents) == rows(texts=texts.join(contents, "text_id")) == [("a", 2, 1), ("b", 0, 0)]
    assert rows(texts=texts, contents=contents, empty=True) == [("a", 2, 2), ("b", 0, 0)]


def bundles_by_both(spark):
    """Bundles with texts of each site's services, and with texts that are shared."""
    tps = "array<struct<third_party_etld1: string, entity: string, categories: array<string>, prevalence: double, policy_url: string, tracker_radar_source_domain_file: string, trackerdb_source_pattern_file: string, trackerdb_source_org_file: string>>"
    fetches = "array<struct<third_party_etld1: string, fetch_success: boolean, status_code: int>>"
    tp = lambda name, p, url: (name, None, None, p, url, None, None, None)
    rows = [(1, "r", "a", "a", 1, None, "ok", True, [tp(" S", None, "u"), tp("s", 0.5, "v"), tp("t", 0.1, None), tp("", 1.0, "x")], [("s", False, 500), ("S ", True, 200), (None, True, 201)]), (2, "r", "b", "b", 2, None, "ok", None, [tp("s", 0.2, "u"), tp("none", 0.3, "u")], None)]
    res = spark.createDataFrame(rows, f"ingest_seq long, run_id string, input string, site_etld1 string, rank int, main_category string, status string, policy_is_english boolean, third_parties {tps}, third_party_policy_fetches {fetches}")
    own = spark.createDataFrame([("r", "a", None, "own")], "run_id string, site_etld1 string, service_domain string, text string")
    shared = spark.createDataFrame([("S", "of s"), ("t", " ")], "service_domain string, text string")
    each = res.select("run_id", "site_etld1").crossJoin(shared).select(*own.columns)
    return catalog.site_bundles(res, own.union(each)), catalog.site_bundles(res, own, shared=shared)


def test_services_of_shared_texts(spark):
    whole, got = (sorted(tuple(r) for r in t["site_services"].select("site_etld1", "service_domain", "prevalence", "fetch_success", "fetch_status_code", F.col("fetched_policy_document_id").isNotNull()).collect()) for t in bundles_by_both(spark))
    assert whole == got == [("a", "s", 0.5, True, 200, True), ("a", "t", 0.1, False, None, False), ("b", "none", 0.3, False, None, False), ("b", "s", 0.2, False, None, True)]


def test_documents_of_shared_texts(spark):
    whole, got = (sorted(map(str, t["documents"].select("scope", "url", "document_id", "content_hash", "language", "word_count", "char_count").collect())) for t in bundles_by_both(spark))
    assert whole == got and len(got) == 3  # the site's own, and that of s under u and v
