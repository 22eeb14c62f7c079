"""The registered queries of this subpackage: thin digests over the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, jaccard, languages, licenses, mixing, passages, periodic, pii, quality, shards, toxicity, turns, urls
from plumbline.llm.common import id_bucket, table


#: Production parameters: target weights of the mix, key of the surrogates.
MIX = {"src0": 4.0, **{f"src{i}": 2.0 if i % 3 == 0 else 1.0 for i in range(1, 20)}}
KEY = "plumbline-surrogates-1"


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"), MIX).select("doc_id", "mix_source", "block", "slot", "position")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_captures(urls.captures_of(pages), urls.entries_of(pages))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"]).drop("rejected_by")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_bucket(F.col("doc_id"), 3) == 1
    crf = languages.fit(docs.where(~held_out))
    return languages.label(docs, crf, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "n_switches")


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.shared_passages(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = id_bucket(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs.where(~held_out), labels.where(~held_out))
    return toxicity.score(docs, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", "predicted", "n_tokens", "n_passages")


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)
    tailed = periodic.repeat_tail(F.col("text"), lambda n: g % n, lambda n, a: 1 + F.floor((n - a) / (3 + g % 8)))
    found = periodic.find_runs(docs.withColumn("text", F.when(h % 10 == 0, tailed).otherwise(F.col("text"))), ["doc_id"])
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("b"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length, period = F.col("b.length"), -F.col("b.period")
    return best.select("doc_id", "n_runs", (-F.col("b.start")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(table(spark, sf_dir, "documents"), 24, ["doc_id"])


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    x = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]).cast("binary")) % 20
    damaged = t.select("conv_id", "turn", F.when(x == 4, "user").otherwise(role).alias("role"), F.when(x == 1, "").when(x == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), x.alias("x"))
    return turns.repair(damaged, F.when(F.col("x") == 0, 0).when(F.col("x") == 3, 2).otherwise(1))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_decontamination": op2_decontamination,
    "op3_url_filter": op3_url_filter,
    "op4_quality": op4_quality,
    "op5_toxicity": op5_toxicity,
    "op6_language": op6_language,
    "op7_jaccard": op7_jaccard,
    "op8_passages": op8_passages,
    "op9_licenses": op9_licenses,
    "op10_pii": op10_pii,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_sharding": op12_sharding,
    "op13_conversations": op13_conversations,
}

_TEMPLATES = licenses.templates()
_GRAMS = ", ".join(f"({i}, {at}, '{a} {b}', {len(ws) - 1}, {len(ws) // 8})" for i, _, _, ws in _TEMPLATES for at, (a, b) in enumerate(zip(ws, ws[1:], strict=False)))
_LABELS = ", ".join(f"({i}, '{label}', {str(base).lower()})" for i, label, base, _ in _TEMPLATES)

#: crc32 of a list of bytes in SQL: the table of 256 entries follows from the polynomial.
_CRC = "(select list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end, n)) t)"


def _crc(bytes_: str, t: str = "t") -> str:
    return f"xor(list_reduce({bytes_}, lambda c, b: xor(c >> 8, {t}[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295)"


def _ascii(text: str) -> str:
    return f"list_transform(string_split({text}, ''), lambda c: ord(c)::bigint)"


#: Ways past a row, or past none (before), from state a to b, with what they cost more and their letters.
_EDGES = ", ".join(f"('{i or '-'}', {f}, {a}, {b}, {c}, '{x}')" for (i, f), edges in turns.EDGES.items() for a, b, c, x in edges)

ORACLE_SQL: dict[str, str] = {
    "op11_periodic_runs": rf"""
with d as (
  select doc_id, h % 10 = 0 tailed, h // 10 g, ws, len(ws) n from (
    select doc_id, {_crc(_ascii("doc_id::varchar"))} h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents, {_CRC})),
p as (select *, g % n a, 1 + (n - g % n) // (3 + g % 8) p from d where tailed and n > 0),
w as (
  select doc_id, i, case when p.doc_id is null or i < a then d.ws[i + 1] else d.ws[a + (i - a) % p + 1] end w
  from (select doc_id, ws, unnest(range(n)) i from d) d left join p using (doc_id)),
l as (select doc_id, list(w order by i) ws from w group by 1),
grams as (select doc_id, s, hash(ws[s + 1:s + 6]) g from (select doc_id, ws, unnest(range(0, greatest(len(ws) - 5, 0))) s from l)),
pairs as (select x.doc_id, x.s, y.s - x.s q from grams x join grams y on x.doc_id = y.doc_id and x.g = y.g and x.s < y.s),
islands as (select *, s - row_number() over (partition by doc_id, q order by s) isle from pairs),
stretches as (select doc_id, q, min(s) s, count(*) + 5 + q len from islands group by doc_id, q, isle),
runs as (select doc_id, s, len, min(q) q from stretches where len >= greatest(12, 2 * q) group by 1, 2, 3),
r as (select doc_id, count(*) n, max(row(len, -s, -q)) b, string_agg(s || ',' || len || ',' || q || chr(10), '' order by s, q) t from runs group by 1),
gone as (select distinct doc_id, unnest(range(s + q, s + len)) i from runs),
kept as (select doc_id, string_agg(w.w, ' ' order by w.i) t from w anti join gone using (doc_id, i) group by 1)
select d.doc_id, coalesce(r.n, 0) n_runs, -b[2] as start, b[1] as length, -b[3] as period, 1000 * b[1] // -b[3] exponent_milli, sha256(coalesce(r.t, '')) runs_sha256, sha256(coalesce(kept.t, '')) collapsed_sha256
from d left join r using (doc_id) left join kept using (doc_id)
""",
    "op12_sharding": rf"""
with recursive d as materialized (
  select doc_id, coalesce(text, '') t, strlen(coalesce(text, '')) + 8 size from documents),
g as (select t, min(doc_id) least, sum(size)::bigint bytes from d group by 1),
p as materialized (select t, least, bytes, (sum(bytes) over (order by least))::bigint - bytes place from g),
ends as materialized (select place e from p union select sum(bytes)::bigint from p),
total as materialized (select max(e) n from ends),
fill(lo, hi, p0, k) as (
  select greatest(max(bytes), (sum(bytes)::bigint + 23) // 24)::bigint, sum(bytes)::bigint, 0::bigint, 0 from p
  union all
  select case when k = 23 and reach < n then (lo + hi) // 2 + 1 else lo end, case when reach = n then (lo + hi) // 2 else hi end, case when reach = n or k = 23 then 0 else reach end, case when reach = n or k = 23 then 0 else k + 1 end
  from (select f.*, n, (select max(e) from ends where e <= f.p0 + (f.lo + f.hi) // 2) reach from fill f, total where lo < hi)),
c as materialized (select max(lo) c from fill where lo = hi),
back(k, r) as (select 24, n from total union all select k - 1, (select min(e) from ends where e >= r - c) from back, c where k > 1),
near as (
  select k, case when x - below <= above - x then below else above end e from (
    select k, k * n // 24 x, (select max(e) from ends where e <= k * n // 24) below, (select min(e) from ends where e >= k * n // 24) above from total, (select unnest(range(1, 24)) k))),
cut(k, x) as (
  select 0, 0::bigint union all
  select k + 1, least(greatest((select e from near where near.k = cut.k + 1), (select r from back where back.k = cut.k + 1)), (select max(e) from ends where e <= x + c)) from cut, c where k < 23),
s as (select t, place, (select count(*) from cut where k > 0 and x <= place)::int shard from p),
utf8 as (
  select doc_id, flatten(list_transform(string_split(t, ''), lambda x: case
      when ord(x) < 128 then [ord(x)::bigint] when ord(x) < 2048 then [192 + (ord(x) >> 6), 128 + (ord(x) & 63)]::bigint[]
      when ord(x) < 65536 then [224 + (ord(x) >> 12), 128 + ((ord(x) >> 6) & 63), 128 + (ord(x) & 63)]::bigint[]
      else [240 + (ord(x) >> 18), 128 + ((ord(x) >> 12) & 63), 128 + ((ord(x) >> 6) & 63), 128 + (ord(x) & 63)]::bigint[] end)) bytes
  from d where t <> ''),
crc as (select doc_id, {_crc("bytes")} c from utf8, {_CRC})
select d.doc_id, d.size::bigint size, coalesce(crc.c, 0)::bigint text_crc32, 'bytes' law, shard, (row_number() over (partition by shard order by place, d.doc_id) - 1)::bigint slot, null::int grown_shard
from d join s using (t) left join crc using (doc_id)
""",
    "op13_conversations": rf"""
with recursive t as (
  select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text, {_crc(_ascii("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')"))} % 20 x from conversations, {_CRC}),
damaged as (
  select conv_id, turn, case when x = 4 then 'user' else role end role, case x when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end text from t, (select unnest(range(2)) again) where x <> 0 and (again = 0 or x = 3)),
numbered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) i from damaged),
ordered as (select *, row_number() over (partition by conv_id, role, text order by i) seen from numbered),
f as materialized (
  select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 1 when seen > 1 then 2 when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 3 else 0 end fault,
    case when role[1] in ('s', 'u', 'a') then role[1] else '-' end initial from ordered),
edges(initial, fault, a, b, more, letters) as (values {_EDGES}),
way(conv_id, i, states) as (
  select distinct conv_id, 0::bigint, [{{'s': 0, 'c': 0, 'l': ''}}, {{'s': 2, 'c': 3, 'l': 'I'}}, {{'s': 3, 'c': 6, 'l': 'II'}}] from f
  union all
  select w.conv_id, w.i + 1, (
    select list({{'s': s, 'c': m[1], 'l': m[2]}}) from (select e.b s, min(row(st.u.c + e.more, st.u.l || e.letters)) m from (select unnest(w.states) u) st join edges e on e.a = st.u.s and e.initial = f.initial and e.fault = f.fault group by 1))
  from way w join f on f.conv_id is not distinct from w.conv_id and f.i = w.i + 1),
last as (select conv_id, max(i) i from way group by 1),
best as materialized (select w.conv_id, min(row(u.c, u.l)) m from (select conv_id, i, unnest(states) u from way) w join last on last.conv_id is not distinct from w.conv_id and last.i = w.i where u.s in (0, 3) group by 1),
letters as (select conv_id, k, m[2][k] c, k - len(replace(m[2][1:k], 'I', '')) ins from (select conv_id, m, unnest(range(1, len(m[2]) + 1)) k from best)),
told as (
  select l.conv_id, l.k, l.c, f.role, f.text, count(*) over (partition by l.conv_id order by l.k) - case when bool_or(f.role[1] = 's' and l.c = 'K') over (partition by l.conv_id) then 1 else 0 end n
  from letters l left join f on f.conv_id is not distinct from l.conv_id and f.i = l.k - l.ins and l.c <> 'I' where l.c <> 'D'),
repaired as (select conv_id, string_agg(case when c = 'K' then role when n % 2 = 1 then 'user' else 'assistant' end || ':' || coalesce(text, ''), chr(10) order by k) t from told group by 1),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count_if(fault = 1) blank, count_if(fault = 2) duplicate, count_if(fault = 3) truncated, count_if(p is not null and p || role[1] not in ('su', 'ua', 'au')) illegal
  from (select *, lag(role[1]) over (partition by conv_id order by i) p from f) group by 1)
select o.conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0)::bigint blank, coalesce(duplicate, 0)::bigint duplicate, coalesce(truncated, 0)::bigint truncated, coalesce(illegal, 0)::bigint illegal, coalesce(m[1], 0)::bigint as cost, coalesce(m[2], '') audit, sha256(coalesce(r.t, '')) repaired_sha256
from (select distinct conv_id from conversations) o left join counts c on c.conv_id is not distinct from o.conv_id left join best b on b.conv_id is not distinct from o.conv_id left join repaired r on r.conv_id is not distinct from o.conv_id
""",
    "op3_url_filter": r"""
with p as (
  select page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)(?::\d*)?([^?#]*)', 1)) h,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)(?::\d*)?([^?#]*)', 2), '/'), lambda s: s <> '') seg
  from pages),
named as (
  select pattern, min(page_id) first from (
    select page_id, h pattern from p where h <> '' union all select page_id, h || '/' || seg[1] from p where h <> '' and len(seg) > 0) group by 1),
entries as (
  select case when length(pattern) % 3 = 0 then 'allow' else 'block' end list, pattern, k,
    timestamp '2024-01-01' + to_seconds((first * 104729 + 432000 * k) % 2592000) since
  from named cross join (select unnest(range(5)) k)),
dated as (select list, pattern, since, max(case when k % 2 = 0 then 'add' else 'remove' end) act from entries group by all),
spans as (select * from (select *, lead(since) over (partition by list, pattern order by since) until from dated) where act = 'add'),
asks as (
  select page_id, url, timestamp '2024-01-01' + to_seconds((page_id * 7919) % 2592000) seen, unnest(
    case when h = '' then cast([] as varchar[]) else
      list_concat(list_transform(range(1, len(string_split(h, '.')) + 1), lambda i: array_to_string(string_split(h, '.')[i:], '.')),
                  list_transform(range(1, len(seg) + 1), lambda i: h || '/' || array_to_string(seg[1:i], '/'))) end) ask
  from p),
hits as (select a.page_id, s.list, s.pattern from asks a join spans s on a.ask = s.pattern and a.seen >= s.since and (s.until is null or a.seen < s.until)),
best as (select page_id, count(*) n, max(row(length(pattern), case when list = 'block' then 1 else 0 end, list, pattern)) b from hits group by 1)
select p.page_id capture_id, timestamp '2024-01-01' + to_seconds((p.page_id * 7919) % 2592000) fetched_at, coalesce(b[3], 'none') verdict, b[4] pattern, coalesce(n, 0) n_active
from p left join best using (page_id)
""",
    "op4_quality": r"""
with d as (
  select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
lines as (
  select doc_id, sum(n - 1) dup from (
    select doc_id, line, count(*) n from (select doc_id, unnest(string_split(t, chr(10))) line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by all) group by 1),
win as (select doc_id, s, array_to_string(ws[s:s + 4], ' ') g from (select doc_id, ws, unnest(range(1, len(ws) - 3)) s from d where len(ws) > 4)),
twice as (select doc_id, s from (select *, count(*) over (partition by doc_id, g) n from win) where n > 1),
rep as (select doc_id, count(distinct p) n from (select doc_id, unnest(range(s, s + 5)) p from twice) group by 1),
c as (
  select d.doc_id, t, ws, len(ws) n_words, length(array_to_string(ws, '')) word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) n_symbols,
    coalesce(l.dup, 0) n_dup_lines, coalesce(r.n, 0) n_repeat_words
  from d left join lines l using (doc_id) left join rep r using (doc_id)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed from c)
select doc_id, n_words::bigint n_words, word_chars::bigint word_chars, n_symbols::bigint n_symbols, n_dup_lines::bigint n_dup_lines, n_repeat_words::bigint n_repeat_words, base_failed,
  not (base_failed or not (2 * n_words <= word_chars and word_chars <= 15 * n_words) or 10 * n_symbols > 3 * n_words
    or 10 * n_dup_lines > 3 * len(string_split(t, chr(10))) or 2 * len(regexp_extract_all(t, '[A-Z]')) > word_chars
    or 10 * len(list_filter(ws, lambda w: regexp_matches(w, '[A-Za-z]|[^\x00-\x7F]'))) < 7 * n_words or 20 * len(list_distinct(ws)) < n_words) kept
from b
""",
    "op7_jaccard": r"""
with recursive d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
g as (
  select distinct doc_id, g from (
    select doc_id, array_to_string(ws[s:s + 4], ' ') g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) s from d where len(ws) > 0))),
n as (select doc_id, count(*) n, string_agg(g, chr(10) order by g) whole from g group by 1),
links as (
  select a, b from (select x.doc_id a, y.doc_id b, count(*) c from g x join g y on x.g = y.g and x.doc_id <> y.doc_id group by all)
  join n na on na.doc_id = a join n nb on nb.doc_id = b where c >= 0.8 * (na.n + nb.n - c) - 1e-9),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
grp as (select a, min(b) m from reach group by 1),
cls as (select doc_id, min(doc_id) over (partition by whole) c from n),
cnt as (select a, count(*) n from links group by 1)
select d.doc_id, coalesce(c, d.doc_id) class_id, least(d.doc_id, coalesce(m, d.doc_id)) group_id, coalesce(cnt.n, 0) n_links
from d left join cls on cls.doc_id = d.doc_id left join grp on grp.a = d.doc_id left join cnt on cnt.a = d.doc_id
""",
    "op9_licenses": rf"""
with d as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') ws from documents),
tpl(template, spot, g, n_grams, slack) as (values {_GRAMS}),
lab(template, label, base) as (values {_LABELS}),
pairs as (select doc_id, pos, ws[pos + 1] || ' ' || ws[pos + 2] g from (select doc_id, ws, unnest(range(0, len(ws) - 1)) pos from d where len(ws) > 1)),
votes as (select doc_id, template, n_grams, slack, pos - spot diag, list(spot) ats from pairs join tpl using (g) group by all),
runs as (
  select *, sum(fresh) over (partition by doc_id, template order by diag) span from (
    select *, case when diag - lag(diag) over (partition by doc_id, template order by diag) <= slack then 0 else 1 end fresh from votes)),
spans as (select doc_id, template, n_grams, span, min(diag) start, len(list_distinct(flatten(list(ats)))) found from runs group by all),
m as (select *, base and found = n_grams is_base, (base and found = n_grams) or (not base and found / n_grams >= 0.8) good from spans join lab using (template)),
s as (
  select doc_id, count_if(is_base) n_base, min(start) filter (is_base) f, max(start) filter (is_base) l, max(found / n_grams) score,
    array_to_string(list_sort(coalesce(list(distinct label) filter (is_base), [])), ',') bl, array_to_string(list_sort(coalesce(list(distinct label) filter (good), [])), ',') al
  from m group by 1)
select d.doc_id, len(ws)::bigint n_words, coalesce(n_base, 0)::bigint n_base, f::bigint first_word, l::bigint last_word, coalesce(bl, '') base_labels, coalesce(al, '') labels, coalesce(score, 0.0)::double score
from d left join s using (doc_id)
""",
}
