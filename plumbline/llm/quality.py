"""Quality rules as a short-circuit cascade.

Each rule is a bound on a few counts of a text. On a bounded, hash-chosen sample
every rule is timed and its rejections are counted; the cascade then runs
the rules in the order of rejections per second, and a text that one rule rejects is
not given to the next. The order changes the work, never the verdict.

Words are [^\\x20\\x09-\\x0D]+ of the whole text. The counts that every row returns
(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) are computed first
and for all rows; the cascade's rules look at what these leave over: letters, capitals,
line ends, the variety of words.

Defined results: null and empty texts have zero counts and are rejected;
rows are judged one by one, so null or repeated ids do not matter; columns not asked
for are dropped, columns named like the new ones replaced.

Five of the six rules read what the counts have made already, so the cascade saves most on
the one that looks at every word. A rule's selectivity is measured on all of the sample, not
on what earlier rules leave.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import WordHashes, rolling, with_columns_py

#: Texts of the sample on which the rules are timed.
SAMPLE_ROWS = 400
K = 5
_KEEP_SYMBOLS = bytes(set(range(256)) - set(b"#*$%&|<>"))
_SPACES = b" \t\n\r\x0b\x0c"


@dataclass
class Doc:
    """A text with what the counts have already made of it."""

    text: str
    raw: bytes
    words: list[bytes]
    n_symbols: int
    n_dup_lines: int
    word_chars: int


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Doc], bool]


# The bounds of the rules, in whole numbers so that every engine agrees.
RULES = (
    Rule("mean_word_length", lambda d: not 2 * len(d.words) <= d.word_chars <= 15 * len(d.words)),
    Rule("symbols", lambda d: 10 * d.n_symbols > 3 * len(d.words)),
    Rule("dup_lines", lambda d: 10 * d.n_dup_lines > 3 * (d.raw.count(b"\n") + 1)),
    Rule("capitals", lambda d: 2 * sum(map(d.raw.count, _CAPITALS)) > d.word_chars),
    Rule("wordless", lambda d: 10 * sum(1 for w in d.words if w.translate(None, _NOT_LETTERS)) < 7 * len(d.words)),
    Rule("few_distinct_words", lambda d: 20 * len(set(d.words)) < len(d.words)),
)
_CAPITALS = [bytes([c]) for c in range(65, 91)]
_NOT_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha())


def measure(text: str | None, hashes: WordHashes) -> tuple[Doc, int]:
    """The counts of a text, and its words in 5-word windows that it holds twice or more."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    seen: set[bytes] = set()
    dup = 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += bool(line.strip(_SPACES))
        else:
            seen.add(line)
    chars = len(text) - sum(map(raw.count, (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c")))
    return Doc(text, raw, words, len(raw.translate(None, _KEEP_SYMBOLS)), dup, chars), repeated_words(hashes.of(words))


def repeated_words(h: np.ndarray) -> int:
    w = rolling(h, K)
    if len(w) < 2:
        return 0
    order = np.argsort(w, kind="stable")
    same = w[order][1:] == w[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(w), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(h) + 1, int)
    np.add.at(covered, np.flatnonzero(twice), 1)
    np.add.at(covered, np.flatnonzero(twice) + K, -1)
    return int((covered.cumsum()[:-1] > 0).sum())


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of the rules by rejections per second on about sample_rows texts (a bounded sample)."""
    n = docs.count()
    some = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < max(1, int((1 << 20) * min(1.0, sample_rows / max(n, 1))))).limit(sample_rows)
    hashes = WordHashes()
    sample = [measure(r.text, hashes)[0] for r in some.toLocalIterator()]
    worth = {}
    for rule in rules:
        start = time.perf_counter()
        bad = sum(map(rule.rejects, sample))
        worth[rule.name] = bad / (time.perf_counter() - start + 1e-9)
    return sorted(worth, key=lambda name: -worth[name])


FIELDS = [
    *[T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()),
    T.StructField("rejected_by", T.StringType()),
]


def judge(docs: DataFrame, keep: list[str] | None = None, rules: tuple[Rule, ...] = RULES, order: list[str] | None = None) -> DataFrame:
    """Add the counts, base_failed, kept and rejected_by (the first rule in the cascade's order that rejects) to every row."""
    order = order_rules(docs, rules) if order is None else order
    by_name = {r.name: r for r in rules}
    cascade = tuple(by_name[n].rejects for n in order)

    def make():
        hashes = WordHashes()

        def one(text):
            doc, repeat = measure(text, hashes)
            n = len(doc.words)
            failed = n < 10 or 100 * repeat > 20 * n
            by = "base" if failed else next((name for name, rejects in zip(order, cascade, strict=True) if rejects(doc)), None)
            return n, doc.word_chars, doc.n_symbols, doc.n_dup_lines, repeat, failed, by is None, by

        return lambda texts: [one(t) for t in texts]

    return with_columns_py(docs, "text", make, FIELDS, keep)
