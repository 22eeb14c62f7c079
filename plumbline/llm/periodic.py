"""Runs of repeated words inside a text: a suffix automaton whose link tree is a link-cut tree.

A run is a stretch of words with smallest period q (words q apart are the same) that is at
least min_words and at least 2 q long and that no neighbouring word extends keeping q.

Every appended word makes a new state of the automaton. An access in the link-cut tree
recolours the new state's path to the root with the word's number, and the pieces of other
colours that it passes are the suffixes by their last occurrence: a piece whose deepest state
has h words and whose colour is e says that the longest suffix last ended at e is h words long.
Where i - e <= h, words i - e apart agree over h words up to i: a square, and i - e is its
smallest period, for a smaller one would mean a later occurrence. Squares of one period
and start follow each other from word to word as long as their run goes on, so each run is
reported where that ends. Recolouring costs O(log n) pieces and rotations a word, amortised.

Only stretches that can hold a run go through the automaton: a run of min_words or more
has, around every one of its words, a gram of min_words / 2 words that the run has
twice. Words that no such gram covers cut a text into stretches; stretches are cut again until each
gram that counts occurs twice in its own stretch. Nothing else is left out, whatever a text's length.

Memory: one text and the automaton of one of its stretches (about 0.5 KB a word).

Defined results: a null, empty or blank text has no words, no runs and an empty collapsed
text; repeated rows are judged one by one; null ids are ids like others; an empty table
gives an empty table; columns named like the new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import WordHashes, ascii_words, rolling, with_columns_py

MIN_WORDS = 12

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())]


class LinkCut:
    """Forest of paths to the root: splay trees by depth, one colour for each path; node 0 is none."""

    def __init__(self) -> None:
        self.left, self.right, self.up, self.colour = [0], [0], [0], [-1]

    def add(self, parent: int) -> int:
        for xs, x in ((self.left, 0), (self.right, 0), (self.up, parent), (self.colour, -1)):
            xs.append(x)
        return len(self.up) - 1

    def splay(self, x: int) -> None:
        """Bring x to the top of its path's tree; the path's colour is kept at the top."""
        left, right, up = self.left, self.right, self.up
        top = x
        while True:
            p = up[x]
            if not p or (left[p] != x and right[p] != x):
                break
            g = up[p]
            if g and (left[g] == p or right[g] == p):
                top = g
                for y in (p, x) if (left[g] == p) == (left[p] == x) else (x, x):
                    self._rotate(y)
            else:
                top = p
                self._rotate(x)
        if top != x:
            self.colour[x] = self.colour[top]

    def _rotate(self, x: int) -> None:
        left, right, up = self.left, self.right, self.up
        p = up[x]
        g = up[p]
        if left[p] == x:
            b = left[p] = right[x]
            right[x] = p
        else:
            b = right[p] = left[x]
            left[x] = p
        if b:
            up[b] = p
        if g:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x
        up[p], up[x] = x, g

    def above(self, x: int) -> int:
        """A new node between x and its parent, of x's colour."""
        self.splay(x)
        new = self.add(x)
        self.left[new] = below = self.left[x]
        if below:
            self.up[below] = new
        self.left[x] = new
        return new

    def recolour(self, x: int, colour: int) -> list[tuple[int, int]]:
        """Give the path from x to the root a colour; the pieces passed as (colour, deepest node), from x upwards."""
        left, right, up, colours = self.left, self.right, self.up, self.colour
        pieces, lower, u = [], 0, x
        while u:
            p = up[u]
            if p and (left[p] == u or right[p] == u):
                self.splay(u)
            c = colours[u]
            pieces.append((c, u))
            if right[u]:
                colours[right[u]] = c
            right[u] = lower
            if lower:
                up[lower] = u
            lower, u = u, up[u]
        colours[lower] = colour
        self.splay(x)
        return pieces


def runs_of(words: list[int], min_words: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a list of word numbers."""
    tree = LinkCut()
    root = tree.add(0)
    to: list[dict[int, int]] = [{}, {}]
    link, size = [0, 0], [0, 0]
    last, out, going = root, [], {}
    for i, w in enumerate(words):
        new = tree.add(0)
        to.append({})
        link.append(root)
        size.append(size[last] + 1)
        p = last
        while p and w not in to[p]:
            to[p][w] = new
            p = link[p]
        if p:
            q = to[p][w]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                twin = tree.above(q)
                to.append(to[q].copy())
                link.append(link[q])
                size.append(size[p] + 1)
                while p and to[p].get(w) == q:
                    to[p][w] = twin
                    p = link[p]
                link[q] = link[new] = twin
        tree.up[new] = link[new]
        last, still = new, {}
        for e, deepest in tree.recolour(new, i):
            if 0 <= e and 0 < i - e <= size[deepest]:
                still[i - e] = i - size[deepest] - (i - e) + 1
        out += [(s, i - s, q) for q, s in going.items() if still.get(q) != s and i - s >= min_words]
        going = still
    n = len(words)
    return out + [(s, n - s, q) for q, s in going.items() if n - s >= min_words]


def stretches(h: np.ndarray, gram: int) -> list[tuple[int, int]]:
    """Stretches (first, beyond) of words by their hashes, each word of which is in a gram that its stretch has twice."""
    grams = rolling(h, gram)
    held = np.sort(grams)
    if not len(held) or not (held[1:] == held[:-1]).any():
        return []
    todo, out = [(0, len(h))], []
    while todo:
        a, b = todo.pop()
        g = grams[a : b - gram + 1]
        if len(g) < 2:
            continue
        order = np.argsort(g, kind="stable")
        same = g[order][1:] == g[order][:-1]
        twice = np.zeros(len(g), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        edge = np.zeros(b - a + 1, np.int32)
        at = np.flatnonzero(twice)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + gram, -1)
        covered = np.concatenate(([False], np.cumsum(edge)[:-1] > 0, [False]))
        turns = np.flatnonzero(covered[1:] != covered[:-1])
        parts = [(a + int(x), a + int(y)) for x, y in zip(turns[::2], turns[1::2], strict=True)]
        if parts == [(a, b)]:
            out.append((a, b))
        else:
            todo += parts
    return sorted(out)


def make_finder(min_words: int) -> Callable[[list], list[tuple]]:
    gram, hashes = max(1, -(-min_words // 2)), WordHashes()

    def find(text: str | None) -> tuple:
        words = ascii_words(text)
        runs: list[tuple[int, int, int]] = []
        if len(words) > gram:
            for a, b in stretches(hashes.of(words), gram):
                numbers: dict[bytes, int] = {}
                part = [numbers.setdefault(w, len(numbers)) for w in words[a:b]]
                runs += [(a + s, n, q) for s, n, q in runs_of(part, min_words)]
        runs.sort(key=lambda r: (r[0], r[2]))
        kept = words
        if runs:
            stay = np.ones(len(words), bool)
            for s, n, q in runs:
                stay[s + q : s + n] = False
            kept = [words[x] for x in np.flatnonzero(stay)]
        return len(words), [{"start": s, "length": n, "period": q} for s, n, q in runs], b" ".join(kept).decode("utf-8", "replace")

    return lambda texts: [find(t) for t in texts]


def find_runs(docs: DataFrame, keep: list[str] | None = None, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs (or the columns in keep) with n_words, runs (by start, then period) and collapsed: the words, one space apart, without those that a run contains after its first period."""
    return with_columns_py(docs, text, lambda: make_finder(min_words), FIELDS, keep)


def words_of(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def repeat_tail(text: Column, first: Callable[[Column], Column], period: Callable[[Column, Column], Column]) -> Column:
    """text with every word from number first(n) on taken from the period(n, first) words that start there, over and over."""

    def tailed(ws: Column) -> Column:
        n = F.size(ws).cast("long")
        a = first(n)
        p = period(n, a)
        block = F.slice(ws, (a + 1).cast("int"), p.cast("int"))
        tail = F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int")))
        return F.when(n == 0, ws).otherwise(F.concat(F.slice(ws, F.lit(1), a.cast("int")), F.slice(tail, F.lit(1), (n - a).cast("int"))))

    return F.array_join(F.transform(F.array(words_of(text)), tailed)[0], " ")  # words are bound once
