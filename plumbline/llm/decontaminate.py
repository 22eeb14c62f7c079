"""Benchmark decontamination by pigeonhole edit matching.

A test item that occurs in a document with at most e edits (characters
inserted, deleted or changed, after lower-casing and reducing everything but
letters and digits to single spaces) contains at least one of any e + 1 pieces
of it unchanged. So each item is split into e + 1 pieces; an Aho-Corasick
automaton over all pieces finds their exact hits in one pass over a document;
each hit is verified with Myers' bit-parallel edit distance in the window
where the item would have to lie.

The items are dealt into blocks of bounded size; each block is one pass over the
documents and is all that is broadcast. Where there is more than one block, a pass
is written to the shared folder and its block given up before the next is read, so
any number of items is searched with the memory of one block.

Defined results: null or empty texts and items match nothing; an item repeated
under one id counts once; an item shorter than min_chars must occur exactly,
between word ends; rows of one doc_id are searched row by row and the best match
per (doc_id, item_id) is returned; null ids are kept as ids. drop_leaks judges every row
by its own text, whatever its id. Other columns of both tables are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.llm.common import SLICE_ROWS, materialize

#: Characters of one edit's share of an item; shorter items allow no edit; characters of items in a broadcast block.
CHARS_PER_EDIT, MIN_CHARS, BLOCK_CHARS = 16, 32, 4_000_000
_WORD = re.compile(r"[^\W_]+")


def normal(text: str | None) -> str:
    """Lower case, one space around each run of letters and digits."""
    t = " ".join(_WORD.findall(text.lower())) if text else ""
    return f" {t} " if t else ""


def myers(pattern: str, text: str, anchored: bool = False) -> tuple[int, int]:
    """Least edit distance between pattern and any substring of text (anchored: any beginning of it), and the end of the first such substring."""
    m = len(pattern)
    ones, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        peq[c] |= 1 << i
    pv, mv, score, best, end = ones, 0, m, m, 0
    for j, c in enumerate(text):
        eq = peq[c] if c in peq else 0
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & ones
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1 | anchored) & ones, (mh << 1) & ones
        pv = mh | ~(xv | ph) & ones
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    """The pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], chars_per_edit: int, min_chars: int):
        self.items = [(i, t, len(t) // chars_per_edit if len(t) >= min_chars else 0) for i, t in items]
        where = defaultdict(list)
        for n, (_, t, e) in enumerate(self.items):
            cuts = [round(k * len(t) / (e + 1)) for k in range(e + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                where[t[a:b]].append((n, a))
        self.auto = ahocorasick.Automaton()
        for piece, at in where.items():
            self.auto.add_word(piece, (len(piece), at))
        self.auto.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, end) in the normalised text: each item's best match."""
        t = normal(text)
        if not t:
            return []
        windows = defaultdict(list)
        for end, (size, at) in self.auto.iter(t):
            for n, offset in at:
                windows[n].append(end + 1 - size - offset)
        found = []
        for n, starts in windows.items():
            item, pattern, e = self.items[n]
            best, done = None, -1
            for s in sorted(set(starts)):
                if t[max(s, 0) : s + len(pattern)] == pattern:
                    best = (0, max(s, 0), s + len(pattern))
                    break
                lo, hi = max(0, s - e), min(len(t), s + len(pattern) + e)
                if not e or hi <= done:  # the window lies in one that was verified
                    continue
                run_hi = hi + len(pattern)  # one scan covers the windows of the next starts too
                d, end = myers(pattern, t[lo:run_hi])
                done = min(len(t), run_hi)
                if d <= e and (best is None or d < best[0]):
                    best = (d, -1, lo + end)
            if best and best[1] < 0:  # from the end that was found backwards, the beginning at the same distance
                d, _, end = best
                before = t[max(0, end - len(pattern) - e) : end]
                best = (d, end - myers(pattern[::-1], before[::-1], True)[1], end)
            if best:
                found.append((item, *best))
        return found


def item_blocks(items: list[tuple[int, str]], block_chars: int) -> Iterator[list[tuple[int, str]]]:
    block, held = [], 0
    for item in items:
        if block and held + len(item[1]) > block_chars:
            yield block
            block, held = [], 0
        block.append(item)
        held += len(item[1])
    if block:
        yield block


def read_items(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """Blocks of normalised items, streamed to the driver a partition at a time; one block is held at a time."""
    rows = benchmark.where("text is not null").select("item_id", "text").distinct()
    return item_blocks(((r.item_id, t) for r in rows.toLocalIterator() if (t := normal(r.text))), block_chars)


def _search(docs: DataFrame, block: Broadcast, item_type: pa.DataType, schema: str, chars_per_edit: int, min_chars: int) -> DataFrame:
    """Matches of one block of items in every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(block.value, chars_per_edit, min_chars)
        for batch in batches:
            rows = []
            for i in range(0, batch.num_rows, SLICE_ROWS):
                for j, text in enumerate(batch.column(1).slice(i, SLICE_ROWS).to_pylist(), i):
                    rows += [(j, *hit) for hit in matcher.find(text)]
            ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            items = pa.array([r[1] for r in rows]).cast(item_type)
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "item_id": items, **{c: pa.array([r[k] for r in rows], pa.int32()) for k, c in enumerate(("distance", "start", "end"), 2)}})

    return docs.mapInArrow(run, schema)


def _clean(docs: DataFrame, block: Broadcast, chars_per_edit: int, min_chars: int) -> DataFrame:
    """The rows of docs in which no item of the block occurs; every row is judged by its own text."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(block.value, chars_per_edit, min_chars)
        for batch in batches:
            kept: list[bool] = []
            for i in range(0, batch.num_rows, SLICE_ROWS):
                kept += [not matcher.find(text) for text in batch.column(at).slice(i, SLICE_ROWS).to_pylist()]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _one_block(benchmark: DataFrame, block_chars: int) -> bool:
    """Whether all items fit in one block, before they are normalised."""
    size = benchmark.agg(F.coalesce(F.sum(F.length("text") + 2), F.lit(0)).alias("n")).first()
    return size.n <= block_chars


def leaks(docs: DataFrame, benchmark: DataFrame, chars_per_edit: int = CHARS_PER_EDIT, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance, start, end: every test item that occurs in a document within its error budget.

    start and end (excluded) are characters of the text as normal() gives it, spaces at both
    ends included; that stretch is distance edits away from the normalised item.
    """
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, distance int, start int, end int"
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    docs, single = docs.select("doc_id", "text"), _one_block(benchmark, block_chars)
    out = None
    for block in read_items(benchmark, block_chars):
        sent = spark.sparkContext.broadcast(block)
        part = _search(docs, sent, item_type, schema, chars_per_edit, min_chars)
        if not single:  # written at once, so that no block outlives its pass
            part = materialize(part)
            sent.destroy()
        out = part if out is None else out.union(part)
    if out is None:
        return spark.createDataFrame([], schema)
    best = F.min(F.struct("distance", "start", "end")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.distance", "best.start", "best.end")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, chars_per_edit: int = CHARS_PER_EDIT, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs in which no test item occurs, rows of null and of repeated ids among them. No shuffle."""
    single = _one_block(benchmark, block_chars)
    for block in read_items(benchmark, block_chars):
        sent = docs.sparkSession.sparkContext.broadcast(block)
        docs = _clean(docs, sent, chars_per_edit, min_chars)
        if not single:
            docs = materialize(docs)
            sent.destroy()
    return docs
