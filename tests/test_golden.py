"""Golden cases of the operators, restated on small inputs."""

import json
from urllib.parse import urljoin

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from plumbline.functions import taxonomy, urls
from plumbline.functions import text as X
from plumbline.operators import catalog as C
from plumbline.operators import domains, mapping, pages, sites, statements, summary, views
from plumbline.plans import annotation
from plumbline.schemas import schema
from plumbline.sources import readers


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def results(spark, *rows):
    s = schema("site_result")
    tp = [f.name for f in s["third_parties"].dataType.elementType.fields]
    made = []
    for i, r in enumerate(rows):
        r = {"ingest_seq": i, "run_id": "r", **r}
        r["third_parties"] = [{k: t.get(k) for k in tp} for t in r.get("third_parties", [])]
        made.append(tuple(r.get(f.name) for f in s.fields))
    return spark.createDataFrame(made, s)


def test_ranked_list(spark):
    names = ["m.tulip.nl", "tulip.nl", "a.root-servers.net", "img.fern.com.ph", "fern.com.ph", "moss.github.io", "oak.example.co.ke"]
    df = spark.createDataFrame(list(enumerate(names, 1)), "rank int, domain string")
    assert [tuple(r) for r in sites.unique_ranked(df, 4).collect()] == [(1, "tulip.nl"), (4, "fern.com.ph"), (6, "github.io"), (7, "example.co.ke")]
    assert [tuple(r) for r in sites.unique_ranked(df, 2, 4).collect()] == [(6, "github.io"), (7, "example.co.ke")]


def test_url_functions(spark):
    n = lambda u: one(spark, urls.normalize_policy_url(F.lit(u)).alias("x")).x
    assert n(" HTTPS://User:pw@EX.com:443/P;v=1?q=1#f ") == "https://ex.com/P?q=1"
    assert n("http://a.b:8080") == "http://a.b:8080/" and n("//Host/p") == "https://host/p" and n("nothing") == "nothing" and n("") == ""
    j = lambda b, h: one(spark, urls.join_url(F.lit(b), F.lit(h)).alias("x")).x
    resolved = [(b, h, urljoin(b, h)) for b in ("http://a/b/c/d;p?q", "https://a.com", "https://u:p@A.com:8080/x/y/z/?k#f") for h in [*"g:h g ./g g/ /g //g ?y g?y #s g#s g?y#s ;x g;x g;x?y#s . ./ .. ../ ../g ../.. ../../ ../../g ../../../g ../../../../g /./g /../g g. .g g.. ..g ./../g ./g/. g/./h g/../h g;x=1/./y g;x=1/../y g?y/./x g?y/../x g#s/./x g#s/../x http:g a//b/ x?".split(), ""]]
    got = spark.createDataFrame(resolved, "b string, h string, want string").withColumn("got", urls.join_url(F.col("b"), F.col("h")))
    assert [tuple(r) for r in got.where("not (got <=> want)").collect()] == []  # the examples of RFC 3986, section 5.4, and more
    base = "https://a.com/x/y?z=1"
    assert [j(base, h) for h in ("http://b.org/", "//c.net/q", "/p", "?k=2", "w.html", "./w")] == ["http://b.org/", "https://c.net/q", "https://a.com/p", "https://a.com/x/y?k=2", "https://a.com/x/w.html", "https://a.com/x/w"]
    assert one(spark, urls.service_key(F.lit(" A.com "), F.lit("E"), F.lit("u")).alias("a"), urls.unique_key(F.lit("A.com"), F.lit("E"), F.lit("https://u.com")).alias("b"), urls.service_key(F.lit(""), F.lit(" En "), F.lit(None).cast("string")).alias("c")) == Row(a="a.com", b="https://u.com/", c="entity:en")
    assert one(spark, urls.score_link(F.lit("Privacy  Policy"), F.lit("https://a.com/privacy"), F.lit(True)).alias("s")).s == pytest.approx(9.8)
    assert one(spark, urls.low_value(F.lit("https://a.com/"), F.lit("http://A.com/x")).alias("a"), urls.low_value(F.lit("https://a.com/sitemap"), F.lit("http://b.com")).alias("b"), urls.full_page_scan(F.lit("https://x.onetrust.com/a")).alias("c")) == Row(a=True, b=True, c=True)


HOSTS = {"a.asn.au": "a.asn.au", "www.foo.ltd.uk": "foo.ltd.uk", "foo.gob.es": "foo.gob.es", "foo.gouv.fr": "foo.gouv.fr", "www.foo.gc.ca": "foo.gc.ca", "a.b.kobe.jp": "a.b.kobe.jp", "x.a.b.kobe.jp": "a.b.kobe.jp", "x.city.kobe.jp": "city.kobe.jp", "kobe.jp": "kobe.jp", "co.uk": "co.uk", "www.gov.uk": "www.gov.uk", "https://www.Foo.co.uk:8/x": "foo.co.uk", "1.2.3.4": "1.2.3.4", "localhost": "localhost", "x.www.ck": "www.ck", "foo.bar.ck": "foo.bar.ck", "": None}


def test_registrable_domains(spark, tmp_path):
    df = spark.createDataFrame([(h,) for h in HOSTS], "h string")
    assert dict(map(tuple, df.select("h", urls.registrable_domain(F.col("h"))).collect())) == HOSTS
    (tmp_path / "list.dat").write_text("// ===BEGIN ICANN DOMAINS===\n// comment\ncom\nuk\nco.uk\njp\n*.kobe.jp\n!city.kobe.jp\n\n// ===END ICANN DOMAINS===\n// ===BEGIN PRIVATE DOMAINS===\nblogs.com\n// ===END PRIVATE DOMAINS===\n")
    rules = readers.read_suffix_list(spark, str(tmp_path / "list.dat"))
    assert rules.count() == 6 and readers.read_suffix_list(spark, str(tmp_path / "list.dat"), private=True).count() == 7
    named = ["a.b.co.uk", "x.a.b.kobe.jp", "x.city.kobe.jp", "my.blogs.com", "what.is.this", "com", "9.9.9.9", None]
    got = domains.with_domain(spark.createDataFrame([(h,) for h in named], "h string"), F.col("h"), "d", rules)
    assert {r.h: r.d for r in got.collect()} == {"a.b.co.uk": "b.co.uk", "x.a.b.kobe.jp": "a.b.kobe.jp", "x.city.kobe.jp": "city.kobe.jp", "my.blogs.com": "blogs.com", "what.is.this": "what.is.this", "com": "com", "9.9.9.9": "9.9.9.9", None: None}
    wide = domains.with_domain(spark.createDataFrame([("my.blogs.com",)], "h string"), F.col("h"), "d", readers.read_suffix_list(spark, str(tmp_path / "list.dat"), private=True))
    assert wide.first().d == "my.blogs.com"


def test_text_functions(spark):
    english = " ".join(["we use the data of you and our partners"] * 12)
    french = " ".join(["nous utilisons vos informations avec nos partenaires pour cela"] * 12)
    got = one(spark, X.is_english(F.lit(english)).alias("a"), X.is_english(F.lit(french)).alias("b"), X.is_english(F.lit("court")).alias("c"), X.word_count(F.lit("a, b -- c_1 é!")).alias("d"), X.policy_likeliness(F.lit("")).alias("e"), X.policy_likeliness(F.lit("cookie cookie")).alias("f"))
    assert (got.a, got.b, got.c, got.d, got.e) == (True, False, True, 4, -10.0) and got.f == pytest.approx(2 / 400 - 1.5)
    reason = lambda code, t, n: one(spark, X.non_browsable_reason(F.lit(code), F.lit(t), F.lit(n)).alias("x")).x
    assert reason(503, "x", 9) == "http_status_503" and reason(200, "Access Denied " + "x" * 300, 9) == "error_page_text" and reason(200, "hi", 0) == "no_links_short_text" and reason(200, "hi", 1) == "very_sparse_page" and reason(200, "x" * 300, 0) is None
    assert one(spark, X.string_list(F.array(F.lit(" a "), F.lit(""), F.lit("a"), F.lit("b"))).alias("a"), X.combine_errors(F.lit("x"), F.lit(" "), F.lit("y")).alias("b"), X.decode_list(F.lit("oops")).alias("c"), X.to_bool(F.lit(" YES")).alias("d"), X.match_count(F.lit("aAaa"), F.lit("aa")).alias("e"), X.format_eta(F.lit(3_725_000)).alias("f")) == Row(a=["a", "b"], b="x | y", c=[], d=True, e=2, f="1h 02m")


def test_taxonomy(spark):
    assert one(spark, taxonomy.tracker_category(F.lit(" Site Analytics ")).alias("a"), taxonomy.tracker_category(F.lit(" Odd ")).alias("b"), taxonomy.website_category(F.lit("news")).alias("c"), taxonomy.main_category(F.lit("Web Ads| Nudity ")).alias("d"), taxonomy.main_category(F.lit("")).alias("e"), taxonomy.unknown_categories(F.lit("Chat|Odd")).alias("f")) == Row(a="Analytics", b="Odd", c="News & Media", d="Adult", e="Other", f=["Odd"])


def test_category_counts_once_per_service(spark):
    tp = {"third_party_etld1": "t.com", "categories": ["Analytics", "site analytics"]}
    df = results(spark, {"third_parties": [{**tp, "policy_url": "https://a"}, {**tp, "policy_url": "https://b"}]})
    assert [tuple(r) for r in summary.category_coverage(df).collect()] == [("Analytics", 1)]


def test_shared_policy_url_is_one_service(spark):
    df = results(spark, {"third_parties": [{"third_party_etld1": d, "policy_url": "https://p.com/x"} for d in ("a.com", "b.com")]})
    r = summary.third_party_counters(df).first()
    assert (r.total, r.unique_services, r.unique_mapped) == (2, 1, 1)


def test_prevalence_zero_is_not_mapped_and_still_divides(spark):
    tps = [{"third_party_etld1": "a.com", "prevalence": 0.0}, {"third_party_etld1": "b.com", "entity": "E", "prevalence": 0.5}, {"third_party_etld1": "c.com", "entity": "E"}]
    df = results(spark, {"third_parties": tps})
    assert summary.third_party_counters(df).first().mapped == 2
    e = summary.entities(df).first()
    assert (e.entity, e.n, e.prevalence_avg, e.prevalence_max) == ("E", 2, 0.25, 0.5)


def test_last_ranks_and_qualified(spark):
    rows = [{"rank": 1, "status": "exception"}, {"rank": 2, "status": "ok"}, {"rank": 3, "status": "policy_not_found"}]
    r = summary.overview(results(spark, *rows)).first()
    assert (r.last_processed_rank, r.last_successful_rank) == (3, 2)
    rows = [{"status": "ok", "policy_is_english": True, "first_party_policy_word_count": w, "third_party_with_english_policy_count": n} for w, n in ((180, 2), (90, 3), (220, 0))]
    r = summary.overview(results(spark, *rows)).first()
    assert (r.english_policy_count, r.qualified_site_count, r.success_rate) == (3, 1, 100.0)


def test_heatmap_is_dense(spark):
    tp = {"third_party_etld1": "t.com", "categories": ["advertising"]}
    rows = [{"main_category": "shopping", "policy_is_english": True, "third_parties": [tp]}, {"main_category": "news", "policy_is_english": False, "third_parties": [tp]}]
    grid = {(r.website_category, r.service_category): r for r in summary.density_heatmap(results(spark, *rows)).collect()}
    assert len(grid) == 16 * 9 and grid["E-commerce", "Advertising"].pct == 100.0 and grid["News & Media", "Advertising"].zero_overlap


def test_any_key_upsert_chain(spark):
    s = "ingest_seq long, site_etld1 string, input string"
    old = spark.createDataFrame([(1, "a", "b"), (2, None, None)], s)
    new = spark.createDataFrame([(3, "b", "c"), (4, "c", "b"), (5, "x", "d")], s)
    assert sorted(r.ingest_seq for r in views.upsert_results(old, new).collect()) == [2, 4, 5]  # 3 has removed 1 before 4 removes it


def catalog(spark):
    k = "run_id string, site_etld1 string"
    return C.Catalog(
        spark.createDataFrame([("r", "o", "2024")], "run_id string, out_dir string, updated_at string"),
        spark.createDataFrame([("r", "a.com", 1, "News & Media", "ok"), ("r", "b.com", None, "Technology", "ok"), ("r", "c.com", 3, None, "exception")], f"{k}, rank int, main_category string, status string"),
        spark.createDataFrame([(1, "h", "en", 120, 900), (2, "h", "other", 10, 90), (3, "g", "en", 7, 70)], "document_id long, content_hash string, language string, word_count int, char_count int"),
        spark.createDataFrame([("r", "a.com", 1), ("r", "b.com", 2)], f"{k}, document_id long"),
        spark.createDataFrame([("t.com", "Ent"), ("u.com", None)], "service_domain string, entity string"),
        spark.createDataFrame([("t.com", "Analytics"), ("t.com", "Advertising")], "service_domain string, category string"),
        spark.createDataFrame([("r", "a.com", "t.com", 3), ("r", "a.com", "u.com", None), ("r", "b.com", "u.com", 2)], f"{k}, service_domain string, fetched_policy_document_id long"),
    )


def test_catalog(spark):
    c = catalog(spark)
    s = {r.site_etld1: r for r in C.site_search(c).collect()}
    assert (s["a.com"].third_party_count, s["a.com"].third_party_with_policy_count, s["a.com"].third_party_with_english_policy_count, s["a.com"].third_party_categories, s["a.com"].third_party_entities) == (2, 1, 1, ["Advertising", "Analytics"], ["Ent"])
    assert (s["c.com"].third_party_count, s["c.com"].has_policy, s["c.com"].third_party_categories) == (0, False, [])
    ask = lambda **k: [r.site_etld1 for r in C.query(c, C.Request(**k)).collect()]
    assert ask() == ["a.com", "b.com", "c.com"] and ask(sort="rank_desc") == ["c.com", "a.com", "b.com"] and ask(limit=-5) == ["a.com"] and ask(offset=2) == ["c.com"]
    assert ask(entity=" ent ") == ask(third_party_categories_any=["Analytics"]) == ask(first_party_word_count_min=100) == ["a.com"] and ask(third_party_domain="U.com") == ["a.com", "b.com"]
    r = C.Request.from_payload({"limit": 9999, "offset": -3, "sort": "odd", "firstPartyEnglish": True, "runIds": [" r ", "r", ""]})
    assert (r.limit, r.offset, r.sort, r.first_party_english, r.run_ids) == (500, 0, "site_asc", True, ["r"]) and C.Request(limit=0).limit == 100
    assert {(x.facet, x.name): x.n for x in C.facets(c, C.Request()).collect()}["service_category", "Analytics"] == 1
    m = C.quality_metrics(C.site_search(c)).first()
    assert (m.total, m.success_rate, m.policy_rate) == (3, 66.67, 66.67) and C.dedup_ratio(c.documents).first().dedup_ratio == pytest.approx(0.333333)


def test_stale_runs_leave(spark):
    runs = spark.createDataFrame([("old", "o", "2024-01"), ("new", "o", "2024-02"), ("x", "p", "2023")], "run_id string, out_dir string, updated_at string")
    kept, t = C.replace_stale_runs(runs, {"sites": spark.createDataFrame([("old", "a"), ("new", "a"), ("x", "b")], "run_id string, site string")})
    assert sorted(r.run_id for r in kept.collect()) == ["new", "x"] == sorted(r.run_id for r in t["sites"].collect())


def test_bundles(spark):
    tp = {"third_party_etld1": " T.com ", "entity": " E ", "categories": ["analytics"], "policy_url": "https://t.com/p"}
    res = results(spark, {"site_etld1": "a.com", "input": "a.com", "status": "ok", "policy_is_english": True, "third_parties": [tp]})
    texts = spark.createDataFrame([("r", "a.com", None, "own policy"), ("r", "a.com", "t.com", "their policy"), ("r", "b.com", None, " ")], schema("policy_text"))
    t = C.site_bundles(res, texts)
    assert {r.scope for r in t["documents"].collect()} == {"first_party", "third_party"} and t["services"].first().entity == "E" and t["service_categories"].first().category == "Analytics"
    assert t["site_services"].first().fetched_policy_document_id is not None and t["site_policies"].count() == 1


def test_links(spark):
    html = '<a href="/a">home</a><a href="https://other.org/x">x</a><a href="mailto:me">m</a><footer><a href="/privacy">Privacy <b>Policy</b></a><a href="https://iubenda.com/p/1">Legal</a></footer>'
    df = spark.createDataFrame([("https://site.com/", html)], "url string, html string")
    links = [(r.source, r.anchor, r.target) for r in pages.extract_links(df).orderBy("ord").collect()]
    assert links[0] == ("footer", "Privacy Policy", "https://site.com/privacy") and len(links) == 4
    c = {r.target: r.score for r in pages.link_candidates(df).collect()}
    assert max(c, key=c.get) == "https://site.com/privacy" and "https://iubenda.com/p/1" in c and "https://other.org/x" not in c
    t = pages.main_text(spark.createDataFrame([("u", "<nav>n</nav><main> a <p>b</p></main><script>x</script>"), ("v", None)], "url string, html string")).collect()
    assert (t[0].text, t[0].method, t[1].text) == ("a\nb", "main", None)


def test_choose_policy(spark):
    rows = [("s", "u1", 0, "body", True, 3.5, 400), ("s", "u2", 1, "body", True, 4.2, 600), ("s", "u3", 2, "body", True, 9.0, 900), ("t", "v1", 0, "hub", True, 2.9, 300), ("w", "w1", 0, "body", False, 9.0, 900)]
    df = spark.createDataFrame(rows, "url string, target string, ord int, source string, ok boolean, score double, text_len int")
    assert {r.url: r.policy_target for r in pages.choose_policy(df).collect()} == {"s": "u2", "t": "v1", "w": None}


def test_mapping_takes_whole_entries(spark):
    e = "etld1 string, entity string, categories array<string>, prevalence double, policy_url string"
    radar, tdb = spark.createDataFrame([("a.com", None, None, None, None)], e), spark.createDataFrame([("a.com", "T", ["x"], 1.0, "u"), ("b.com", "B", [], 0.0, None)], e)
    tps = spark.createDataFrame([("s.com", "a.com"), ("s.com", "b.com"), ("s.com", "c.com")], "site_etld1 string, third_party_etld1 string")
    got = {r.third_party_etld1: (r.mapping_source, r.entity) for r in mapping.map_third_parties(tps, radar, tdb).collect()}
    assert got == {"a.com": ("tracker_radar", None), "b.com": ("trackerdb", "B"), "c.com": (None, None)} and mapping.mapping_mode(True, False) == "radar"
    reqs = spark.createDataFrame([("https://www.s.com", u, k) for u, k in (("https://x.t.com/a", "request"), ("https://s.com/b", "request"), ("ftp://z.com", "request"), ("https://q.com", "response"))], schema("network_request"))
    assert mapping.third_parties(reqs).first().third_parties == ["t.com"]
    pat = spark.createDataFrame([("p/a.eno", "name: A\ncategory: cat\norganization: org\n\n--- domains\n*.t.com\nu.org\n--- domains")], "path string, text string")
    more = spark.createDataFrame([("p/b.eno", "category: odd\n--- filters\nname: no\n--- filters\n--- domains\n\nv.com\nT.com\n"), ("p/c.eno", "--- domains\n--- domains\nname: C\nw.com: x")], "path string, text string")
    files = lambda *rows: spark.createDataFrame(rows, "path string, text string")
    idx = mapping.trackerdb_index(pat.union(more), files(("o/org.eno", "name: Org\nprivacyPolicyUrl: https://p")), files(("c/cat.eno", "name: Cat")))
    got = {r.etld1: (r.entity, r.categories, r.policy_url, r.source_pattern_file, r.source_org_file) for r in idx.collect()}
    assert got == {"t.com": ("Org", ["Cat", "odd"], "https://p", "p/a.eno", "o/org.eno"), "u.org": ("Org", ["Cat"], "https://p", "p/a.eno", "o/org.eno"), "v.com": ("b", ["odd"], None, "p/b.eno", None)}


def test_plans_and_cache(spark):
    dirs = spark.createDataFrame([("a", "https://X.com", False), ("b", "https://x.com/", False), ("c", None, False), ("d", "https://y.com", True), ("e", "https://y.com/", False)], "path string, source_url string, has_output boolean")
    got = {r.path: (r.action, r.reuse_from) for r in annotation.annotation_plan(dirs).collect()}
    assert got == {"a": ("annotate", None), "b": ("reuse_later", "a"), "c": ("annotate", None), "d": ("skip", None), "e": ("reuse_now", "d")}
    assert {r.path: r.action for r in annotation.annotation_plan(dirs, force=True).collect()}["e"] == "reuse_later"
    cache = spark.createDataFrame([(1, "https://a.com/old", "t", 200, None, None, "https://a.com/new", None), (2, "https://b.com/", "u", 200, None, None, None, None), (3, "https://c.com/", "v", 200, None, None, "https://b.com/", None)], schema("policy_cache"))
    c = annotation.compact_cache(cache)
    assert {r.key: r.alias_of for r in c.collect()} == {"https://a.com/new": None, "https://a.com/old": "https://a.com/new", "https://b.com/": None, "https://c.com/": None}
    loop = spark.createDataFrame([(i, k, None, None, None, None, None, a) for i, (k, a) in enumerate((("p", "q"), ("q", "p"), ("x", "y"), ("y", None), ("z", "gone")))], schema("policy_cache"))
    assert {r.key: r.target for r in annotation.resolve_aliases(loop).collect()} == {"p": None, "q": None, "x": "y", "y": "y", "z": None}
    lines = spark.createDataFrame([("[done] x | 1,200↑/30↓",), ("[done] y | 100↑/5↓",), ("[usage] prompt_tokens=900 completion_tokens=99",)], "line string")
    assert tuple(annotation.usage_totals(lines).first()) == (1300, 99)


def test_chunks():
    text = "one two three\n\n" + " ".join(f"w{i}" for i in range(25)) + "\n\nlast block"
    blocks, chunks = statements.chunk_document(text, 10)
    assert all(len(c["text"].split()) <= 10 for c in chunks) and " ".join(blocks).split() == text.split()
    for c in chunks:
        for b in c["block_map"]:
            assert c["text"][b["start"] : b["end"]] == blocks[b["index"]]
    parts = statements.heading_chunks("# A\nx\n## B\n" + "y" * 30 + "\nz\n", 40)
    assert len(parts) > 1 and parts[1].startswith("# A\n## B\n")


def test_responses():
    s = {"action": ["collect"], "data": ["email"]}
    for text in (json.dumps([s]), "<think>[1]</think>" + json.dumps({"statements": [s]}), '```json\n[{"action": ["collect"], "data": ["email"],},]\n```', "<|im_start|>Sure: " + json.dumps([s]) + " ok", json.dumps([json.dumps(s)]), '// c\n[{"action": ["collect"], /* x */ "data": ["email"]}]'):
        assert statements.parse_response(text) == [s]
    assert statements.parse_response("no list") is None and statements.parse_response(None) is None


def test_statements(spark):
    docs = spark.createDataFrame([("d", "We collect your emails.\n\nPartners may share emails and phone numbers.")], "doc_id string, text string")
    ch = statements.blocks_and_chunks(docs, 500)
    say = [{"action": "collecting", "data": ["email"], "prohibition": "yes"}, {"action": ["share"], "data": ["phone number", "emails"]}, {"data": ["email"]}]
    resp = spark.createDataFrame([("d", 0, json.dumps(say))], schema("llm_response"))
    st = statements.extract_statements(ch, resp)
    got = st.orderBy("statement_no").collect()
    assert [(r.action[0].phrase, r.action[0].block_index, r.prohibition) for r in got] == [("collect", 0, True), ("share", 1, False)]
    assert [p.phrase for p in got[1].data] == ["phone numbers", "emails"]
    assert statements.dedup_statements(st.union(st.withColumn("chunk_index", F.lit(7)))).count() == 2
    rec = statements.annotated_records(st, ch).orderBy("statement_no").collect()
    assert rec[0].source_text == "We collect your emails."
    ph = statements.phrases(st)
    assert statements.block_coverage(ph, ch).first().coverage_pct == 100 and statements.statement_stats(st).first().prohibition_rate == 50.0
    assert {r.phrase: r.n for r in statements.phrase_frequency(ph).where("field = 'data'").collect()} == {"emails": 2, "phone numbers": 1}
    infos = statements.block_infos(st, ch).orderBy("block_index").collect()
    assert len(infos) == 2 and sum(len(r.highlights) for r in infos) == ph.count() and {i for r in infos for i in r.statements} == set(range(st.count())) and statements.entity_sets(st).first().prohibitions == 1 and statements.top_action(ph).first().top_action == "collect"
    spans = spark.createDataFrame([("d", 0, 5, "a"), ("d", 3, 9, "b"), ("d", 9, 12, "c")], "doc_id string, start int, end int, field string")
    assert sorted((r.start, r.end, r.field) for r in statements.merge_spans(spans, ["doc_id"]).collect()) == [(0, 9, "a"), (9, 12, "c")]
    texts = spark.createDataFrame([("d", r"Aaa b\E. aaB\E."), ("e", ""), ("f", None)], "doc_id string, text string")
    needles = spark.createDataFrame([(k, "a", p) for k in "def" for p in ("aa", r"B\E.")], "doc_id string, field string, phrase string")
    assert sorted((r.doc_id, r.start, r.end) for r in statements.highlight_spans(texts, needles).collect()) == [("d", 0, 3), ("d", 4, 8), ("d", 9, 11), ("d", 11, 15)]
    status = spark.createDataFrame([("s", None, "extracting"), ("t", None, "completed")], "site string, tp string, status string").withColumns({c: F.lit(None).cast("string") for c in ("previous_status", "reason", "finished_at", "updated_at")})
    assert {r.site: (r.status, r.previous_status) for r in statements.mark_stale(status, "now").collect()} == {"s": ("stopped", "extracting"), "t": ("completed", None)}
