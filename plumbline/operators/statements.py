"""Policy texts as blocks and chunks, and the statements extracted from them."""

from __future__ import annotations

import difflib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import constants as K

FIELDS = ["action", "data", "processor", "recipient", "purpose", "context"]
PHRASES = "array<struct<block_index:int,phrase:string>>"
CHUNKS = "array<struct<block_map:array<struct<index:int,start:int,end:int>>,text:string>>"
# Where a block that is too long is split, from the coarsest to the finest; what joins its pieces again.
SPLITS = [(r"\n\s*\n+", "\n\n"), (r"\n+", "\n\n"), (r"(?<=[.!?])\s+(?=[A-Z0-9\"“(])", "\n\n"), (r"\s+", " ")]


def _tokens(text: str) -> int:
    return len(text.split())


def pack(pieces: list[str], limit: int, glue: str) -> list[str]:
    """Join neighbouring pieces while they stay within limit tokens."""
    out: list[list[str]] = []
    held = 0
    for p in pieces:
        n = _tokens(p)
        if out and held + n <= limit:
            out[-1].append(p)
            held += n
        else:
            out.append([p])
            held = n
    return [glue.join(group) for group in out]


def split_block(text: str, limit: int, level: int = 0) -> list[str]:
    """Pieces of at most limit tokens, split as coarsely as possible."""
    if _tokens(text) <= limit or level == len(SPLITS):
        return [text] if text else []
    pattern, glue = SPLITS[level]
    pieces = [p.strip() for p in re.split(pattern, text) if p.strip()]
    if len(pieces) <= 1:
        return split_block(text, limit, level + 1)
    out: list[str] = []
    small: list[str] = []
    for p in pieces:
        if _tokens(p) <= limit:
            small.append(p)
            continue
        out += pack(small, limit, glue) + split_block(p, limit, level + 1)
        small = []
    return out + pack(small, limit, glue)


def chunk_document(text: str | None, limit: int) -> tuple[list[str], list[dict]]:
    """Blocks between blank lines, and chunks of whole blocks with each block's place in its chunk."""
    blocks = [p for b in re.split(r"\n\s*\n+", text or "") if b.strip() for p in split_block(b.strip(), limit)]
    parts_of = [[p.strip() for p in re.split(r"\n\s*\n+", chunk) if p.strip()] for chunk in pack(blocks, limit, "\n\n")]
    flat, chunks = [], []
    for parts in parts_of:
        at, where = 0, []
        for p in parts:
            where.append({"index": len(flat), "start": at, "end": at + len(p)})
            flat.append(p)
            at += len(p) + 2
        chunks.append({"block_map": where, "text": "\n\n".join(parts) + "\n"})
    return flat, chunks


def blocks_and_chunks(docs: DataFrame, limit: int = 500) -> DataFrame:
    """doc_id, blocks, chunks of (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [chunk_document(t, limit) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "blocks": [m[0] for m in made], "chunks": [m[1] for m in made]})

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, blocks array<string>, chunks {CHUNKS}")


def heading_chunks(text: str, most: int) -> list[str]:
    """Pieces of about most characters cut at line ends; each begins with the headings it stands under."""
    if len(text) <= most:
        return [text]
    out, held, size = [], [], 0
    path: dict[int, str] = {}
    for line in text.splitlines(keepends=True):
        if m := re.match("(#{1,3}) ", line):
            path = {level: h for level, h in path.items() if level < len(m[1])} | {len(m[1]): line.rstrip() + "\n"}
        if held and size + len(line) > most:
            out.append("".join(held))
            held = list(path.values())
            size = sum(map(len, held))
        held.append(line)
        size += len(line)
    return [*out, "".join(held)] if held else out


def chunk_by_heading(docs: DataFrame, most: int = 60_000) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "chunks": [heading_chunks(t or "", most) for t in b["text"]]})

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, chunks array<string>").select("doc_id", F.posexplode("chunks").alias("chunk_index", "chunk"))


_WRAP = re.compile(r"<\|[^|>]*\|>")
_LOOSE = re.compile(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/|,(?=(?:\s|//[^\n]*|/\*.*?\*/)*[\]}])', re.S)


def balanced(text: str) -> Iterator[str]:
    """Top-level bracketed parts, brackets inside strings aside."""
    depth = start = 0
    for m in re.finditer(r'"(?:\\.|[^"\\])*"|[\[\]{}]', text):
        c = m[0]
        if c in "[{":
            start = m.start() if not depth else start
            depth += 1
        elif c in "]}" and depth:
            depth -= 1
            if not depth:
                yield text[start : m.end()]


def parse_response(response: str | None) -> list[dict] | None:
    """The first list of objects in a model's answer; None when there is none. Comments and trailing commas are allowed."""
    text = _WRAP.sub("", response or "").strip()
    bare = re.sub(r"(?is)<think>.*?</think>", " ", text)
    tries = re.findall(r"(?is)<answer>(.*?)</answer>", text) + re.findall(r"(?is)```(?:json)?\s*(.*?)```", text) + [bare, *balanced(bare), *balanced(text)]
    for t in tries:
        try:
            found = _objects(json.loads(_LOOSE.sub(lambda m: m[1] or "", t)))
        except ValueError:
            continue
        if found is not None:
            return found
    return None


def _objects(value) -> list[dict] | None:
    if isinstance(value, dict):
        named = [value.get(k) for k in ("statements", "privacy_statements", "items", "results", "data")]
        value = next((v for v in [*named, *value.values()] if isinstance(v, list)), None)
    if not isinstance(value, list):
        return None
    items = [json.loads(_LOOSE.sub(lambda m: m[1] or "", v)) if isinstance(v, str) else v for v in value]
    return items if all(isinstance(v, dict) for v in items) else None


def clean_statement(raw: dict) -> dict:
    """Known fields as lists of strings; prohibition only when true."""
    out: dict = {}
    for k in FIELDS:
        v = raw.get(k)
        if isinstance(v, str):
            out[k] = [v]
        elif isinstance(v, list) and v:
            out[k] = [x for x in v if isinstance(x, str) and x]
    if raw.get("prohibition") is True or str(raw.get("prohibition")).lower() in ("true", "yes"):
        out["prohibition"] = True
    return out


def _forms(word: str) -> list[str]:
    """A word and its forms by suffix rules."""
    low = word.lower()
    stems = {low} | {low[: -len(s)] for s in ("s", "ed", "ing", "d") if low.endswith(s) and len(low) > len(s) + 2}
    forms = {w + s for w in stems for s in ("", "s", "ed", "ing")} | {w[:-1] + "ing" for w in stems if w.endswith("e")} | {w + "d" for w in stems if w.endswith("e")}
    return sorted(forms, key=lambda w: (-len(w), w))


def phrase_pattern(phrase: str) -> re.Pattern:
    """Matches a phrase with other forms of its words and other marks between them; words that a space parts stay apart."""
    out, owed = "", False  # owed: white space since the last word
    for space, word, mark in re.findall(r"(\s*)(?:(\w+)|([^\w\s]+))", phrase):
        owed = owed or bool(space)
        if word:
            out += (r"\W+" if owed else r"\W*") * bool(out) + "(?:" + "|".join(map(re.escape, _forms(word))) + ")"
            owed = False
        elif not out:
            out = f"(?:{re.escape(mark)})?"
    return re.compile(out or r"(?!)", re.I)


def align(blocks: list[dict], text: str, statement: dict) -> dict:
    """Give each phrase the block it stands in, within the shortest run of blocks that has every phrase found."""
    places: dict[str, dict[int, str]] = {}
    for phrase in {p for k in FIELDS for p in statement.get(k, [])}:
        hits = sorted(phrase_pattern(phrase).finditer(text), key=lambda m: (-difflib.SequenceMatcher(None, phrase, m[0]).ratio(), m.start()))
        for m in hits:
            for b in blocks:
                if m[0] and b["start"] <= m.start() and m.end() <= b["end"]:
                    places.setdefault(phrase, {}).setdefault(b["index"], m[0])
    found = sorted({i for p in places.values() for i in p})
    runs = [(b - a, a, found[a:b]) for a in range(len(found)) for b in range(a + 1, len(found) + 1) if all(set(p) & set(found[a:b]) for p in places.values())]
    span = min(runs)[2] if runs else []
    at = {phrase: next(((i, p[i]) for i in reversed(span) if i in p), None) for phrase, p in places.items()}
    out = {k: [at[p] for p in statement[k] if at.get(p)] for k in FIELDS if statement.get(k)}
    return {k: v for k, v in out.items() if v} | ({"prohibition": True} if statement.get("prohibition") else {})


STATEMENT = "doc_id {kind}, chunk_index int, statement_no int, " + ", ".join(f"{f} {PHRASES}" for f in FIELDS) + ", prohibition boolean"


def extract_statements(chunks: DataFrame, responses: DataFrame) -> DataFrame:
    """Parsed, validated and aligned statements of responses (doc_id, chunk_index, response) on chunks (doc_id, chunks).

    A statement stays only when both action and data are found in the chunk.
    """
    kind = chunks.schema["doc_id"].dataType.simpleString()
    rows = chunks.select("doc_id", F.posexplode("chunks").alias("chunk_index", "chunk")).join(responses, ["doc_id", "chunk_index"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["doc_id", "chunk_index", "statement_no", *FIELDS, "prohibition"]
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                for n, raw in enumerate(parse_response(r.response) or []):
                    s = align([dict(x) for x in r.block_map], r.text, clean_statement(raw))
                    if "action" in s and "data" in s:
                        out.append([r.doc_id, r.chunk_index, n, *[[{"block_index": i, "phrase": p} for i, p in s.get(f, [])] for f in FIELDS], bool(s.get("prohibition"))])
            yield pd.DataFrame(out, columns=cols)

    return rows.select("doc_id", "chunk_index", "response", "chunk.block_map", "chunk.text").mapInPandas(run, STATEMENT.format(kind=kind))


def dedup_statements(statements: DataFrame) -> DataFrame:
    """Distinct statements of a document; the first chunk's stays."""
    body = F.to_json(F.struct(*FIELDS, "prohibition"))
    at = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64(body), body).orderBy("chunk_index", "statement_no"))
    return statements.withColumn("__at", at).where("__at = 1").drop("__at")


def annotated_records(statements: DataFrame, blocks: DataFrame) -> DataFrame:
    """Add source_text: the statement's blocks (doc_id, blocks), in order, joined by spaces."""
    ids = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.transform(f, lambda p: p["block_index"]) for f in FIELDS]))))
    df = statements.join(blocks.select("doc_id", "blocks"), "doc_id", "left")
    return df.withColumn("source_text", F.array_join(F.transform(ids, lambda i: F.get("blocks", i)), " ")).drop("blocks")


def phrases(statements: DataFrame) -> DataFrame:
    """doc_id, chunk_index, statement_no, field, block_index, phrase."""
    def of(f: str):
        return F.transform(f, lambda p: F.struct(F.lit(f).alias("field"), p["block_index"].alias("block_index"), p["phrase"].alias("phrase")))

    each = F.concat(*map(of, FIELDS))
    return statements.select("doc_id", "chunk_index", "statement_no", F.explode(each).alias("p")).select("doc_id", "chunk_index", "statement_no", "p.*")


def phrase_frequency(phrase_rows: DataFrame, n: int = 12) -> DataFrame:
    """Most frequent phrases of each field, lower case, trimmed; ties by phrase."""
    c = phrase_rows.groupBy("field", F.lower(F.trim("phrase")).alias("phrase")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("at", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "phrase"))).where(F.col("at") <= n)


def statement_stats(statements: DataFrame) -> DataFrame:
    """Statements, documents, prohibition rate in percent and statements per document, to one decimal."""
    a = statements.agg(F.count(F.lit(1)).alias("statements"), F.count_distinct("doc_id").alias("documents"), F.count_if("prohibition").alias("prohibitions"))
    per = lambda x, y, k: F.when(y > 0, F.round(x * k / y, 1)).otherwise(0.0)
    return a.select("statements", "documents", per(F.col("prohibitions"), F.col("statements"), 100).alias("prohibition_rate"), per(F.col("statements"), F.col("documents"), 1).alias("per_document"))


def top_action(phrase_rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """The most frequent action of each document, or site where key names one; ties by phrase."""
    c = phrase_rows.where("field = 'action'").groupBy(key, F.lower(F.trim("phrase")).alias("phrase")).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy(key).agg(F.min_by("phrase", F.struct(-F.col("n"), F.col("phrase"))).alias("top_action"))


def block_coverage(phrase_rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Percent of a document's blocks with a statement, as an integer."""
    hit = phrase_rows.groupBy("doc_id").agg(F.count_distinct("block_index").alias("hit"))
    return blocks.join(hit, "doc_id", "left").select("doc_id", F.when(F.size("blocks") > 0, F.round(F.coalesce("hit", F.lit(0)) * 100 / F.size("blocks"))).otherwise(0.0).cast("int").alias("coverage_pct"))


def numbered_statements(statements: DataFrame) -> DataFrame:
    """Statements with statement_index, their place in the document from 0, by chunk and number."""
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index", "statement_no")) - 1
    return statements.withColumn("statement_index", at)


def block_infos(statements: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, block_index, text, chunk_index (the last that has it), statements (indices) and highlights (statement_index, field, phrase; by statement, field and place) of every block.

    Phrases that are empty or name a block that the document lacks count nowhere. Lists are as long as one block has phrases.
    """
    own = chunks.select("doc_id", F.posexplode("chunks").alias("chunk_index", "c")).select("doc_id", "chunk_index", F.explode("c.block_map").alias("b")).groupBy("doc_id", F.col("b.index").alias("block_index")).agg(F.max("chunk_index").alias("chunk_index"))
    every = chunks.select("doc_id", F.posexplode("blocks").alias("block_index", "text")).join(own, ["doc_id", "block_index"], "left")
    st = numbered_statements(statements)

    def of(no: int, f: str) -> Column:
        return F.transform(f, lambda p, i: F.struct(F.lit(no).alias("no"), i.alias("at"), F.lit(f).alias("field"), p["phrase"].alias("phrase"), p["block_index"].alias("block_index")))

    each = F.concat(*[of(no, f) for no, f in enumerate(FIELDS)])
    said = st.select("doc_id", "statement_index", F.explode(each).alias("p")).where("p.phrase <> ''")
    row = F.struct("statement_index", "p.no", "p.at", "p.field", "p.phrase")
    lists = said.groupBy("doc_id", F.col("p.block_index").alias("block_index")).agg(F.array_sort(F.collect_set("statement_index")).alias("statements"), F.array_sort(F.collect_list(row)).alias("h"))
    df = every.join(lists, ["doc_id", "block_index"], "left")
    shown = F.transform("h", lambda h: F.struct(h["statement_index"].alias("statement_index"), h["field"].alias("field"), h["phrase"].alias("phrase")))
    none = "array<struct<statement_index:int,field:string,phrase:string>>"
    return df.select("doc_id", "block_index", "text", "chunk_index", F.coalesce("statements", F.array().cast("array<int>")).alias("statements"), F.coalesce(shown, F.array().cast(none)).alias("highlights"))


def overlaps(spans: DataFrame, ranges: DataFrame, key: str, width: int = 1024) -> DataFrame:
    """Pairs of a span and a range (both with start and end, end excluded) of one key that share a place; the columns of spans, range_start, range_end and the other columns of ranges.

    Both sides are cut into buckets of width places and joined on (key, bucket); a pair that meets in
    several buckets is kept in the one where it begins. So no pair is compared that lies in no common bucket.
    """
    cut = lambda df: df.where(F.col("end") > F.col("start")).withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    r = cut(ranges).withColumnsRenamed({"start": "range_start", "end": "range_end"})
    both = cut(spans).join(r, [key, "__bucket"])
    meet = (F.col("start") < F.col("range_end")) & (F.col("range_start") < F.col("end"))
    first = F.floor(F.greatest("start", "range_start") / width) == F.col("__bucket")
    return both.where(meet & first).drop("__bucket")


def block_spans(texts: DataFrame, needles: DataFrame, blocks: DataFrame, width: int = 1024) -> DataFrame:
    """doc_id, block_index, start, end, field: the merged highlights of each document's needles, cut to its blocks (doc_id, block_index, start, end in the document's text); places count from the block's beginning."""
    found = overlaps(highlight_spans(texts, needles), blocks, "doc_id", width)
    at = F.col("range_start")
    return found.select("doc_id", "block_index", (F.greatest("start", at) - at).alias("start"), (F.least("end", "range_end") - at).alias("end"), "field")


def merge_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Merge overlapping (start, end, field) spans of each key; a merged span has its first field."""
    order = Window.partitionBy(*keys).orderBy("start", F.desc("end"), "field")
    seen = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    df = spans.withColumn("__new", F.when(seen.isNull() | (F.col("start") >= seen), 1).otherwise(0))
    df = df.withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(*keys, "__run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min(F.struct("start", (-F.col("end")).alias("e"), "field")).alias("f")).select(*keys, "start", "end", F.col("f.field").alias("field"))


def highlight_spans(texts: DataFrame, needles: DataFrame, key: str = "doc_id") -> DataFrame:
    """All places, whatever the case, of each document's needles (key, field, phrase) in its text (one of each key), merged."""
    asked = needles.where("phrase <> ''").select(key, "field", F.lower("phrase").alias("n")).distinct()
    df = texts.join(asked, key).withColumn("low", F.lower("text"))
    # cut before every place, so that a place is the length of all pieces before it
    before = F.concat(F.lit(r"(?=\Q"), F.replace("n", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    pieces = df.select(key, "field", "n", F.length("n").alias("size"), F.startswith("low", F.col("n")).alias("first"), F.posexplode(F.transform(F.split("low", before), F.length)).alias("i", "piece"))
    ahead = F.sum("piece").over(Window.partitionBy(key, "field", "n").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    starts = pieces.withColumn("start", F.coalesce(ahead, F.lit(0)).cast("int")).where("i > 0 or first")
    spans = starts.select(key, "field", "start", (F.col("start") + F.col("size")).alias("end")).distinct()
    return merge_spans(spans, [key])


def set_status(rows: DataFrame, status: Column, now: str) -> DataFrame:
    """Rows of annotation states with a new status: work that begins gets its first started_at, work that ends its finished_at."""
    df = rows.withColumns({"status": status, "updated_at": F.lit(now)})
    begins, ends = F.col("status").isin(K.IN_PROGRESS), F.col("status").isin(K.TERMINAL)
    return df.withColumns({"started_at": F.when(begins, F.coalesce("started_at", F.lit(now))).otherwise(F.col("started_at")), "finished_at": F.when(ends, F.lit(now)).otherwise(F.col("finished_at"))})


def mark_stale(status: DataFrame, now: str, reason: str = K.STALE_REASON) -> DataFrame:
    """What was in progress becomes stopped and finished now, with the reason and the earlier status."""
    stale = F.col("status").isin(K.IN_PROGRESS)
    to = lambda c, new: F.when(stale, new).otherwise(F.col(c))
    return status.withColumns({"previous_status": to("previous_status", F.col("status")), "reason": to("reason", F.lit(reason)), "finished_at": to("finished_at", F.lit(now)), "updated_at": to("updated_at", F.lit(now)), "status": to("status", F.lit("stopped"))})


def annotation_stats(status: DataFrame, statements: DataFrame) -> DataFrame:
    """Of each (site, tp): statements, completed, status (pending by default, completed with statements)."""
    c = statements.groupBy(F.col("site").alias("__site"), F.col("tp").alias("__tp")).agg(F.count(F.lit(1)).alias("n"))
    df = status.select("site", "tp", "status").join(c, F.col("site").eqNullSafe(F.col("__site")) & F.col("tp").eqNullSafe(F.col("__tp")), "full")
    n = F.coalesce("n", F.lit(0))
    state = F.coalesce("status", F.when(n > 0, "completed").otherwise("pending"))
    return df.select(F.coalesce("site", "__site").alias("site"), F.coalesce("tp", "__tp").alias("tp"), n.alias("statements"), state.isin("completed", "reused").alias("completed"), state.alias("status"))


def annotation_totals(stats: DataFrame) -> DataFrame:
    """Of annotation_stats' rows, for first parties (tp null) and third parties: policies, completed ones, statements."""
    party = F.when(F.col("tp").isNull(), "first").otherwise("third").alias("party")
    return stats.groupBy(party).agg(F.count(F.lit(1)).alias("policies"), F.count_if("completed").alias("completed"), F.sum("statements").alias("statements"))


def entity_sets(statements: DataFrame) -> DataFrame:
    """Of each document and chunk, and site and round where they are there: distinct lower-case action, data, processor and purpose phrases, and prohibitions."""
    keys = [k for k in ("site", "doc_id", "chunk_index", "round") if k in statements.columns]
    fields = ("action", "data", "processor", "purpose")
    sets = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.transform(f, lambda p: F.lower(p["phrase"])))))).alias(f) for f in fields]
    return statements.groupBy(*keys).agg(*sets, F.count_if("prohibition").alias("prohibitions"))
