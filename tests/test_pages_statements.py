"""Strict HTML, statement trees, intervals and the new reports on small inputs."""

import random

from pyspark.sql import functions as F

from plumbline.functions import html
from plumbline.operators import pages, statements, summary
from plumbline.sources import readers


def test_strict_links(spark):
    page = """<body><p title="a > b"><a class='x' href="/one?a=1&amp;b=2">One &amp; <b>only</b></a>
    <footer><div><a HREF=/f1>F1</a><footer><a href='/f2'> F
    2 </a></footer><a href="/f3">F3</a></div></footer><a href="/two">open <a href="/three">three</a> <a name="n">no link</a>
    <script>document.write('<a href="/no">no</a>')</script><a href="/f>4" title=">">quoted</a><img alt="<a href='/no2'>"><a href="#top">t</a></body>"""
    got = html.links(page)
    assert got == [("footer", "F1", "/f1"), ("footer", "F 2", "/f2"), ("footer", "F3", "/f3"), ("body", "One & only", "/one?a=1&b=2"), ("body", "open", "/two"), ("body", "three", "/three"), ("body", "quoted", "/f>4"), ("body", "t", "#top")]
    assert html.links(None) == html.links("") == html.links("<<a") == []
    df = spark.createDataFrame([("https://s.org/x/", page), ("https://t.org", None)], "url string, html string")
    rows = pages.parse_links(df).orderBy("ord").collect()
    assert [r.target for r in rows] == ["https://s.org/f1", "https://s.org/f2", "https://s.org/f3", "https://s.org/one?a=1&b=2", "https://s.org/two", "https://s.org/three", "https://s.org/f>4"]
    native = {r.target for r in pages.extract_links(df).collect()}
    assert not native & {"https://s.org/f>4", "https://s.org/three"} and {"https://s.org/no", "https://s.org/no2"} <= native  # what the native form can't tell


def test_strict_candidates(spark):
    page = '<a href="https://other.example/x">news</a><a href="/privacy">Privacy</a><footer><a href="/privacy">Privacy policy</a><a href="https://www.iubenda.com/p">P</a></footer>'
    got = pages.link_candidates(spark.createDataFrame([("https://zebra.org/", page)], "url string, html string"), strict=True).orderBy("ord").collect()
    assert [(r.target, r.source) for r in got] == [("https://zebra.org/privacy", "footer"), ("https://www.iubenda.com/p", "footer")]


def test_text_cascade():
    assert html.main_text("<nav>menu</nav><article> own\n text </article> rest") == ("own\ntext", "main")
    assert html.main_text("<nav>menu</nav><p>body</p><footer>foot</footer>") == ("body", "body")
    assert html.main_text("<nav>only <b>menu</b></nav><script>x()</script><style>p{}</style>") == ("only\nmenu", "all")
    assert html.main_text("<template><p>in a template</p></template><!-- c -->after") == ("after", "body")
    assert html.main_text("") == html.main_text(None) == html.main_text("<script>x</script>") == (None, None)
    assert html.main_text("<p>unclosed <b>tags<p>go on") == ("unclosed\ntags\ngo on", "body")


def test_statement_tree(spark, tmp_path):
    def put(path, text):
        p = tmp_path / "arts" / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)

    put("a.com/policy_statements.jsonl", '{"chunk_index": 2, "source_text": "s", "statement": {"action": ["x"]}}\n\nnot json\n{"statement": null}\n[1]\n{"statement": {"data": []}, "chunk_index": "no"}\n')
    put("b.com/policy_statements.jsonl", '{"statement": {"action": ["plain"]}}\n')
    put("b.com/policy_statements_annotated.jsonl", '{"statement": {"action": ["better"]}}\n')
    put("b.com/third_party/t.net/policy_statements.jsonl", '{"statement": {"action": ["their"]}, "chunk_index": 1}\n')
    put("c.com/policy_statements.jsonl", '{"statement": {"action": ["plain too"]}}\n')
    put("c.com/policy_statements_annotated.jsonl", "")
    got = sorted(tuple(r) for r in readers.read_statements(spark, str(tmp_path / "arts")).select("base", "site", F.coalesce("tp", F.lit("")), "annotated", "chunk_index", "source_text", "statement").collect())
    assert got == [("a.com", "a.com", "", False, 0, "", '{"data":[]}'), ("a.com", "a.com", "", False, 2, "s", '{"action":["x"]}'), ("b.com", "b.com", "", True, 0, "", '{"action":["better"]}'), ("b.com/third_party/t.net", "b.com", "t.net", False, 1, "", '{"action":["their"]}'), ("c.com", "c.com", "", False, 0, "", '{"action":["plain too"]}')]


def test_overlaps_against_brute_force(spark):
    rng = random.Random(3)
    made = lambda n: [(rng.randrange(3), s := rng.randrange(5000), s + rng.choice([0, 1, 7, 900, 3000]), i) for i in range(n)]
    a, b = made(150), made(120)
    left, right = (spark.createDataFrame(x, f"k int, start int, end int, {name} int") for x, name in ((a, "i"), (b, "j")))
    got = sorted((r.i, r.j) for r in statements.overlaps(left, right, "k", 64).select("i", "j").collect())
    assert got == sorted((i, j) for k, s, e, i in a for m, t, f, j in b if k == m and s < e and t < f and s < f and t < e)


def test_run_starts(spark):
    r = spark.createDataFrame([("a", 2, "t2"), ("a", 1, " "), ("a", 3, "t3"), ("b", 1, None), ("c", 1, "x")], "run_id string, ingest_seq long, started_at string")
    kept = spark.createDataFrame([("c", "kept"), ("d", "old"), ("a", "")], "run_id string, started_at string")
    assert {x.run_id: x.started_at for x in summary.run_starts(r, kept, F.lit("now")).collect()} == {"a": "t2", "b": "now", "c": "kept", "d": "old"}
    assert {x.run_id: x.started_at for x in summary.run_starts(r, now=F.lit("now")).collect()} == {"a": "t2", "b": "now", "c": "x"}
