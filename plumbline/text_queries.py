"""Registered queries over chunks, statements and blocks, with SQL that states every row. Importing adds them to queries.QUERIES."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import adapters as A
from plumbline.operators import statements
from plumbline.queries import ORACLE_SQL, query

_TOKENS = "len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> ''))"
_BARE = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_SENTENCE = "regexp_replace({0}, '([.!?])\\s+([A-Z0-9\"“(])', '\\1' || chr(1) || '\\2', 'g')"


def _pieces(source: str, keys: str, pattern: str, no: str, text: str = "t") -> str:
    """Pieces of texts that are not blank, numbered by no."""
    return f"(select {keys}, {no}, {_BARE.format('x')} t, {_TOKENS.format('x')} n from (select {keys}, unnest(ps) x, generate_subscripts(ps, 1) {no} from (select {keys}, regexp_split_to_array({text}, '{pattern}') ps from {source})) where {_BARE.format('x')} <> '')"


def chunks_sql(text: str, limit: int) -> str:
    """SQL of statements.blocks_and_chunks: tables parts (doc_id, g, i, p, at) - the blocks in order - and heads of a recursive query."""
    return f"""
with recursive d as (select doc_id, {text} t from documents),
b as materialized {_pieces('d', 'doc_id', '\\n\\s*\\n+', 'b')},
l as materialized {_pieces(f'(select * from b where n > {limit})', 'doc_id, b', '\\n+', 'i')},
s as materialized {_pieces(f"(select doc_id, b, i, {_SENTENCE.format('t')} t from l where n > {limit})", 'doc_id, b, i', chr(1), 'j')},
w as (select doc_id, b, i, j, (k - 1) // {limit} k, string_agg(x, ' ' order by k) t, count(*) n from (
  select doc_id, b, i, j, unnest(ws) x, generate_subscripts(ws, 1) k from (select doc_id, b, i, j, list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '') ws from s where n > {limit})) group by all),
seq as (
  select doc_id, b, i, 0 j, t, n, doc_id || '/' || b || '/' || sum((n > {limit})::int) over (partition by doc_id, b order by i) sid from l
  union all select doc_id, b, i, j, t, n, doc_id || '/' || b || '/' || i || '/' || sum((n > {limit})::int) over (partition by doc_id, b, i order by j) from s),
q as materialized (select *, row_number() over (partition by sid order by i, j) o from seq where n <= {limit}),
pk(sid, o, g, h) as (
  select sid, o, 0, n from q where o = 1
  union all select q.sid, q.o, case when h + n <= {limit} then g else g + 1 end, case when h + n <= {limit} then h + n else n end from pk join q on q.sid = pk.sid and q.o = pk.o + 1),
units as (
  select doc_id, b, 0 i, 0 j, 0::bigint k, n, [t] ps from b where n <= {limit}
  union all select doc_id, b, min(i), arg_min(j, (i, j)), 0, sum(n), list(t order by i, j) from q join pk using (sid, o) group by doc_id, b, sid, g
  union all select doc_id, b, i, j, k, n, [t] from w),
u as materialized (select *, row_number() over (partition by doc_id order by b, i, j, k) o from units),
ck(doc_id, o, g, h) as (
  select doc_id, o, 0, n from u where o = 1
  union all select u.doc_id, u.o, case when h + n <= {limit} then g else g + 1 end, case when h + n <= {limit} then h + n else n end from ck join u on u.doc_id = ck.doc_id and u.o = ck.o + 1),
flat as (select doc_id, g, o, unnest(ps) p, generate_subscripts(ps, 1) r from u join ck using (doc_id, o)),
parts as (
  select doc_id, g, p, row_number() over (partition by doc_id order by o, r) - 1 i, coalesce(sum(length(p) + 2) over (partition by doc_id, g order by o, r rows between unbounded preceding and 1 preceding), 0)::bigint at_ from flat)
"""


_MIXED = "case when doc_id % 2 = 0 then replace(text, chr(10), chr(10) || ' ' || chr(10)) else text end"
ORACLE_SQL["document_chunks"] = chunks_sql("text", 500) + """,
c as (select doc_id, g, sum(length(p) + 2) - 1 n from parts group by all)
select d.doc_id, (select count(*) from parts where parts.doc_id = d.doc_id)::int n_blocks, (select count(*) from c where c.doc_id = d.doc_id)::int n_chunks, (select max(n) from c where c.doc_id = d.doc_id)::int longest from d"""


def _mixed(spark, sf) -> DataFrame:
    """Documents, every other one with blank lines instead of line ends."""
    t = F.col("text")
    return A.table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.replace(t, F.lit("\n"), F.lit("\n \n"))).otherwise(t).alias("text"))


@query("chunk_offsets", chunks_sql(_MIXED, 60) + """
select doc_id, g as chunk_index, sha256(string_agg(p, chr(10) || chr(10) order by i) || chr(10)) text_sha256, string_agg(i || ':' || at_ || '-' || at_ + length(p), ',' order by i) block_map from parts group by all""")
def _(spark, sf):
    c = statements.blocks_and_chunks(_mixed(spark, sf), 60).select("doc_id", F.posexplode("chunks").alias("chunk_index", "c"))
    places = F.transform("c.block_map", lambda b: F.concat(b["index"].cast("string"), F.lit(":"), b["start"].cast("string"), F.lit("-"), b["end"].cast("string")))
    return c.select("doc_id", "chunk_index", F.sha2("c.text", 256).alias("text_sha256"), F.array_join(places, ",").alias("block_map"))


def headings_sql(text: str, most: int) -> str:
    """SQL of statements.heading_chunks: table h (doc_id, g, t), the chunks' texts."""
    return f"""
with recursive d as (select doc_id, {text} t from documents),
l0 as (select doc_id, n, x || case when n < m then chr(10) else '' end x from (select doc_id, unnest(ls) x, generate_subscripts(ls, 1) n, len(ls) m from (select doc_id, string_split(t, chr(10)) ls from d where length(t) > {most})) where n < m or x <> ''),
l1 as (select *, length(regexp_extract(x, '^(#{{1,3}}) ', 1)) lv from l0),
l2 as (select *, max(case when lv = 1 then n end) over o n1, max(case when lv = 2 then n end) over o n2, max(case when lv = 3 then n end) over o n3, {_BARE.format('x')} || chr(10) bare from l1 window o as (partition by doc_id order by n)),
l as materialized (
  select l2.*, coalesce(a.bare, '') || coalesce(b.bare, '') || coalesce(c.bare, '') crumbs from l2
  left join l2 a on a.doc_id = l2.doc_id and a.n = l2.n1 left join l2 b on b.doc_id = l2.doc_id and b.n = l2.n2 and l2.n2 > coalesce(l2.n1, 0) left join l2 c on c.doc_id = l2.doc_id and c.n = l2.n3 and l2.n3 > greatest(coalesce(l2.n1, 0), coalesce(l2.n2, 0))),
pk(doc_id, n, g, h, front) as (
  select doc_id, n, 0, length(x), '' from l where n = 1
  union all select l.doc_id, l.n, case when h + length(x) > {most} then g + 1 else g end, case when h + length(x) > {most} then length(crumbs) + length(x) else h + length(x) end, case when h + length(x) > {most} then crumbs else '' end from pk join l on l.doc_id = pk.doc_id and l.n = pk.n + 1),
h as (select doc_id, g, string_agg(front || x, '' order by n) t from pk join l using (doc_id, n) group by all union all select doc_id, 0, t from d where length(t) <= {most})
"""


ORACLE_SQL["heading_chunks"] = headings_sql("text", 4000) + "select doc_id, g as chunk_index, length(t)::int n_chars from h"
_HEADED = "array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: case when i % 5 = 1 then repeat('#', 1 + (i // 5) % 3) || ' ' || x else x end), chr(10))"


@query("heading_pieces", headings_sql(_HEADED, 700) + "select doc_id, g as chunk_index, length(t)::int n_chars, sha256(t) text_sha256 from h")
def _(spark, sf):
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 5 == 0, F.concat(F.repeat(F.lit("#"), (F.floor((i + 1) / 5) % 3 + 1).cast("int")), F.lit(" "), x)).otherwise(x))
    d = A.table(spark, sf, "documents").select("doc_id", F.array_join(lines, "\n").alias("text"))
    return statements.chunk_by_heading(d, 700).select("doc_id", "chunk_index", F.length("chunk").alias("n_chars"), F.sha2("chunk", 256).alias("text_sha256"))


# ---- statements whose answers are generated from known ones

_N_BLOCKS = 4


def _known(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Of every document a chunk of blocks that name an action and data of their own, and the model's answer that states them, in one of eight wrappings.

    Of the statements s some lack data, some name data that no block has, some say their action in another form of the word.
    """
    d = A.table(spark, sf, "documents").select("doc_id", "source")
    i = F.col("doc_id").cast("string")
    block = lambda j: F.concat(F.lit(f"We act{j}of"), i, F.lit(f" your dat{j}of"), i, F.lit(" by "), "source", F.lit("."))
    texts = d.select("doc_id", F.concat_ws("\n\n", *[block(j) for j in range(_N_BLOCKS)]).alias("text"))

    def said(j: int):
        n = F.col("doc_id") + j
        data = F.when(n % 7 == 0, F.concat(F.lit("nothing"), i)).otherwise(F.concat(F.lit(f"dat{j}of"), i))
        action = F.concat(F.lit(f"Act{j}of"), i, F.when(n % 3 == 0, "s").otherwise(""))
        two = F.array(data, F.concat(F.lit("absent"), i))
        return F.struct(F.array(action).alias("action"), F.when(n % 4 != 0, two).alias("data"), F.when(n % 5 == 0, "yes").when(n % 5 == 1, "True").when(n % 5 == 2, "no").alias("prohibition"))

    items = [F.to_json(said(j)) for j in range(_N_BLOCKS)]
    listed = F.concat(F.lit("["), F.concat_ws(", ", *items, F.when(F.col("doc_id") % 6 == 0, items[1])), F.lit("]"))
    quoted = F.concat(F.lit("["), F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('\\"')), F.lit('"')) for x in items]), F.lit("]"))
    dressed = [
        listed, F.concat(F.lit("<think>[1, {\"x\": 2}]</think>"), listed), F.concat(F.lit("Sure:\n```json\n"), listed, F.lit("\n```\nDone.")), F.concat(F.lit("<|im_start|>note <answer>"), listed, F.lit("</answer><|im_end|>")),
        F.concat(F.lit('{"note": "a [b] c", "statements": '), listed, F.lit("}")), F.regexp_replace(listed, r"\]$", ", // the end\n]"), F.concat(F.lit("Here is what I found: "), listed, F.lit(" and no more [sic]")), quoted,
    ]
    answers = d.select("doc_id", F.lit(0).alias("chunk_index"), F.get(F.array(*dressed), (F.col("doc_id") % len(dressed)).cast("int")).alias("response"))
    chunks = statements.blocks_and_chunks(texts, 500)
    return chunks, statements.extract_statements(chunks, answers)


#: The statements that survive: data was given and is in the text; a repeated one once.
KNOWN = f"""
with known as (
  select doc_id, j, 'act' || j || 'of' || doc_id act, 'dat' || j || 'of' || doc_id dat, (doc_id + j) % 5 in (0, 1) prohibition, 'We act' || j || 'of' || doc_id || ' your dat' || j || 'of' || doc_id || ' by ' || source || '.' block,
    row_number() over (partition by doc_id order by j) - 1 idx
  from documents, (select unnest(range({_N_BLOCKS})) j) where (doc_id + j) % 4 <> 0 and (doc_id + j) % 7 <> 0)
"""


@query("known_statements", KNOWN + """
select doc_id, 0 chunk_index, '[{"block_index":' || j || ',"phrase":"' || act || '"}]' "action", '[{"block_index":' || j || ',"phrase":"' || dat || '"}]' "data", prohibition, block source_text from known""")
def _(spark, sf):
    ch, st = _known(spark, sf)
    return statements.annotated_records(statements.dedup_statements(st), ch).select("doc_id", "chunk_index", F.to_json("action").alias("action"), F.to_json("data").alias("data"), "prohibition", "source_text")


@query("known_phrases", KNOWN + ", p as (select doc_id, 'action' field, act phrase from known union all select doc_id, 'data', dat from known) select field, phrase, n from (select field, lower(phrase) phrase, count(*) n from p group by 1, 2) qualify row_number() over (partition by field order by n desc, phrase) <= 12")
def _(spark, sf):
    return statements.phrase_frequency(statements.phrases(statements.dedup_statements(_known(spark, sf)[1]))).drop("at")


@query("known_coverage", KNOWN + f"select d.doc_id, round(count(k.j) * 100 / {_N_BLOCKS})::int coverage_pct from documents d left join known k using (doc_id) group by 1")
def _(spark, sf):
    ch, st = _known(spark, sf)
    return statements.block_coverage(statements.phrases(st), ch)


@query("block_infos", KNOWN + f""", b as (select doc_id, j, 'We act' || j || 'of' || doc_id || ' your dat' || j || 'of' || doc_id || ' by ' || source || '.' text from documents, (select unnest(range({_N_BLOCKS})) j))
select b.doc_id, b.j::int block_index, b.text, 0 chunk_index, coalesce(idx::varchar, '') statements, case when idx is null then '' else idx || ':action:' || act || ',' || idx || ':data:' || dat end highlights from b left join known using (doc_id, j)""")
def _(spark, sf):
    ch, st = _known(spark, sf)
    shown = F.transform("highlights", lambda h: F.concat_ws(":", h["statement_index"].cast("string"), h["field"], h["phrase"]))
    return statements.block_infos(statements.dedup_statements(st), ch).withColumns({"statements": F.array_join("statements", ","), "highlights": F.array_join(shown, ",")})


@query("block_spans", """
with n(field, phrase) as (values ('action', 'license'), ('data', 'licensed under'), ('purpose', 'the ')),
p as (select doc_id, field, phrase, unnest(ps) x, generate_subscripts(ps, 1) i, len(ps) m from (select doc_id, field, phrase, string_split(lower(text), phrase) ps from documents, n)),
s as (select doc_id, field, s::bigint s, s::bigint + length(phrase) e from (select *, sum(length(x)) over (partition by doc_id, field order by i) + (i - 1) * length(phrase) s from p) where i < m),
r as (select *, sum(fresh) over (partition by doc_id order by s, e desc, field) run from (
  select *, case when coalesce(s >= max(e) over (partition by doc_id order by s, e desc, field rows between unbounded preceding and 1 preceding), true) then 1 else 0 end fresh from s)),
m as (select doc_id, min(s) s, max(e) e, arg_min(field, (s, -e, field)) field from r group by doc_id, run),
b as (select doc_id, k block_index, k * 300 + k * k % 7 bs, least((k + 1) * 300 + (k + 1) * (k + 1) % 7, length(text)) be from (select doc_id, text, unnest(range(length(text) // 300 + 1)) k from documents) where k * 300 + k * k % 7 < length(text))
select doc_id, block_index::int block_index, (greatest(s, bs) - bs)::int "start", (least(e, be) - bs)::int "end", field from m join b using (doc_id) where s < be and bs < e""")
def _(spark, sf):
    d = A.table(spark, sf, "documents").select("doc_id", "text")
    n = d.select("doc_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(p).alias("phrase")) for f, p in (("action", "license"), ("data", "licensed under"), ("purpose", "the "))])).alias("n")).select("doc_id", "n.*")
    k = F.col("k")
    b = d.select("doc_id", F.length("text").alias("size"), F.explode(F.sequence(F.lit(0), F.floor(F.length("text") / 300).cast("int"))).alias("k"))
    b = b.select("doc_id", k.alias("block_index"), (k * 300 + k * k % 7).alias("start"), F.least((k + 1) * 300 + (k + 1) * (k + 1) % 7, "size").alias("end")).where("`start` < `end`")
    return statements.block_spans(d, n, b, 256)
