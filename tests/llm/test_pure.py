"""Parts that need no Spark: brute force beside the fast forms."""

import itertools
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import decontaminate, jaccard, languages, mixing, passages, quality, queries, toxicity
from plumbline.llm.common import WordHashes


def edit_ends(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row), row.index(min(row))


@given(st.text("ab c", min_size=1, max_size=12), st.text("ab c", max_size=40))
@settings(max_examples=200, deadline=None)
def test_myers_is_the_edit_distance(p, t):
    assert decontaminate.myers(p, t) == edit_ends(p, t)


def test_matcher_finds_every_item_within_its_budget():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 7)))
    items = [(i, decontaminate.normal(" ".join(word() for _ in range(25)))) for i in range(20)]
    m = decontaminate.Matcher(items, 16, 32)
    for i, t in items:
        budget = len(t) // 16
        bad = list(t)
        for _ in range(budget):
            bad[rng.randrange(1, len(bad) - 1)] = rng.choice("xyz")
        text = " ".join(word() for _ in range(50)) + "".join(bad) + " ".join(word() for _ in range(50))
        found = {x[0]: x[1] for x in m.find(text)}
        assert found.get(i, 99) <= budget
        assert set(found) == {j for j, u in items if edit_ends(u, decontaminate.normal(text))[0] <= len(u) // 16}


@given(st.lists(st.floats(0.01, 1), min_size=1, max_size=12))
@settings(max_examples=60, deadline=None)
def test_pattern_deviates_by_less_than_a_block(weights):
    slots = mixing.shares({f"s{i}": w for i, w in enumerate(weights)}, 97)
    q, at = sum(slots.values()), mixing.pattern(slots)
    assert sorted(itertools.chain(*at.values())) == list(range(q))
    for s, p in slots.items():
        had = np.cumsum(np.isin(np.arange(q), at[s]))
        assert (abs(had - p * np.arange(1, q + 1) / q) < 1).all()


@given(st.dictionaries(st.sampled_from("abcdef"), st.integers(0, 60), min_size=1))
@settings(max_examples=60, deadline=None)
def test_phases_place_every_block_once(blocks):
    plan = mixing.phases(blocks, {s: i + 1.0 for i, s in enumerate("abcdef")}, 20)
    seen = []
    for p in plan:
        for x in p["sources"].values():
            seen += [p["slot"] + n // len(x["at"]) * p["period"] + x["at"][n % len(x["at"])] for n in range(x["took"])]
    assert sorted(seen) == list(range(sum(blocks.values())))


def all_segments(scores, drift, n):
    """Maximal segments by their definition: split recursively around the best one."""
    v = [-drift] * n
    for i, s in scores:
        v[i] = s

    def best(lo, hi):
        found = max(((sum(v[a:b]), -a, -(b - a), a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0,))
        if found[0] <= 1e-9:
            return []
        a, b = found[3], found[4]
        return best(lo, a) + [(a, b - 1, found[0])] + best(b, hi)

    return best(0, n)


@given(st.dictionaries(st.integers(0, 18), st.sampled_from([1.2571, 2.5133, 4.0419, -1.7537]), min_size=1, max_size=9))
@settings(max_examples=150, deadline=None)
def test_segments_are_the_maximal_ones(scores):
    scores = sorted(scores.items())
    got = [(a, b, round(s, 6)) for a, b, s in toxicity.segments(scores, 0.60071)]
    want = [(a, b, round(s, 6)) for a, b, s in all_segments(scores, 0.60071, 20)]
    assert sorted(s for *_, s in got) == sorted(s for *_, s in want)
    assert all(x <= y for (_, x, _), (y, _, _) in zip(got, got[1:], strict=False))


def test_least_matches_follows_the_beta_posterior():
    least = jaccard.least_matches(0.8, 1e-6, 48)
    t = 0.8 + 0.2 / 256
    grid = (np.arange(200_000) + 0.5) / 200_000
    for n in (24, 48):
        for m in (least[n] - 1, least[n]):
            density = grid**m * (1 - grid) ** (n - m)
            tail = density[grid >= t].sum() / density.sum()
            assert (tail >= 1e-6) == (m >= least[n]) or math.isclose(tail, 1e-6, rel_tol=0.05)


@given(st.lists(st.integers(0, 3), max_size=18), st.lists(st.integers(0, 3), max_size=18))
@settings(max_examples=150, deadline=None)
def test_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert passages.lcs(a, b) == t[-1][-1]


@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), min_size=1, max_size=25))
@settings(max_examples=150, deadline=None)
def test_best_chain(points):
    k, gap = passages.K, passages.GAP
    pts, f = sorted(points), []
    for i, (a, b) in enumerate(pts):
        f.append(k + max([0] + [f[j] - gap * (a - x + b - y) for j, (x, y) in enumerate(pts[:i]) if x < a and y < b]))
    got = passages.chain(np.array([p[0] for p in points]), np.array([p[1] for p in points]))
    assert got[0][4] == pytest.approx(max(f))
    x = np.array(sorted({p[0] // 2 for p in points}))  # an exact run
    apart = passages.chain(np.r_[x, 500], np.r_[x + 7, 900])  # the same run beside a match elsewhere takes the long way
    assert passages.chain(x, x + 7)[0] == pytest.approx(apart[0]) or len(x) == 1


@given(st.lists(st.sampled_from(["a", "b", "c"]), max_size=40))
@settings(max_examples=150, deadline=None)
def test_repeated_words(words):
    win = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + j for i, w in enumerate(win) if win.count(w) > 1 for j in range(5)}
    assert quality.repeated_words(WordHashes().of([w.encode() for w in words])) == len(covered)


def test_quality_counts():
    doc, _ = quality.measure("a# b\n\na# b\n \né|c\x85d", WordHashes())
    assert (len(doc.words), doc.word_chars, doc.n_symbols, doc.n_dup_lines) == (5, 11, 3, 1)


def test_forward_backward_is_enumeration():
    rng = np.random.default_rng(0)
    e, trans = rng.normal(size=(2, 5, 3)), rng.normal(size=(3, 3))
    mask = np.ones((2, 5), bool)
    mask[1, 3:] = False
    m, _, log_z = languages.forward_backward(e * mask[..., None], mask, trans)
    for n, length in enumerate((5, 3)):
        paths = list(itertools.product(range(3), repeat=length))
        w = np.array([math.exp(sum(e[n, t, p[t]] for t in range(length)) + sum(trans[p[t], p[t + 1]] for t in range(length - 1))) for p in paths])
        assert log_z[n] == pytest.approx(math.log(w.sum()), rel=1e-6)
        for t in range(length):
            for k in range(3):
                assert m[n, t, k] == pytest.approx(sum(x for x, p in zip(w, paths, strict=True) if p[t] == k) / w.sum(), abs=1e-6)


def test_tokens_of_toxicity_are_letters_and_digits():
    assert toxicity._TOKEN.findall("a_b c1!d") == ["a", "b", "c1", "d"] and re.fullmatch(r"\w+", "a_b")


@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 40), st.integers(1, 9)), max_size=25))
@settings(max_examples=300, deadline=None)
def test_fewest_spans_cover_all_words(spans):
    spans = [(d, 0, a, a + n) for d, a, n in spans]
    got = passages.fewest(spans)
    words = lambda rows: {(d, x) for d, _, a, b in rows for x in range(a, b)}
    assert set(got) <= set(spans) and words(got) == words(spans)
    assert all(sum(a <= x < b for d, _, a, b in got if d == e) <= 2 for e, x in words(got))


@pytest.mark.parametrize("weights", [queries.MIX, {**queries.MIX, mixing.OTHER: 0.01}, {"a": 0.12345, "b": 0.3, "c": 1 / 3}])
def test_sources_keep_their_weights_over_many_periods(weights):
    plan = mixing.phases(dict.fromkeys(weights, 12_000), weights, mixing.PERIOD)[0]
    total, slots = sum(map(Fraction, map(str, weights.values()))), {}
    for s, x in plan["sources"].items():
        n = np.arange(x["took"])
        slots[s] = plan["slot"] + n // len(x["at"]) * plan["period"] + np.array(x["at"])[n % len(x["at"])]
    end = sum(map(len, slots.values()))
    assert end > 25_000 and (np.sort(np.concatenate(list(slots.values()))) == np.arange(end)).all()
    for s, at in slots.items():
        share = Fraction(str(weights[s])) / total
        for t in [*range(1, 3000), *range(end - 3000, end + 1)]:
            assert abs(int(np.searchsorted(at, t)) - share * t) < 1


class Counted(float):
    """A number that counts how often it is compared."""

    n = 0

    def __add__(self, o):
        return Counted(float(self) + float(o))

    __radd__ = __add__

    def __sub__(self, o):
        return Counted(float(self) - float(o))

    def __ge__(self, o):
        Counted.n += 1
        return float(self) >= float(o)


@pytest.mark.parametrize("gap", [1, 9, 40])
def test_segments_take_linear_time(gap):
    took = []
    for n in (1000, 4000):
        Counted.n = 0
        rng = random.Random(2)
        toxicity.segments([(gap * i, Counted(rng.choice((1.5, 2.5, 4.0)))) for i in range(n)], 0.5)
        took.append(Counted.n)
    assert took[1] <= 4.5 * took[0] and took[1] <= 8 * 4000


@given(st.lists(st.integers(0, 9), min_size=1, max_size=60), st.integers(1, 50))
@settings(max_examples=200, deadline=None)
def test_least_places(values, window):
    h = np.array(values, np.uint64) << np.uint64(40)
    want = [x + int(h[x : x + window].argmin()) for x in range(len(h) - window + 1)]
    assert passages.least_places(h, window).tolist() == want
    if want:
        assert passages.minimizers(h, window).tolist() == sorted(set(want))
