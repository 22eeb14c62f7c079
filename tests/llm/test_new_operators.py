"""Runs, shards and conversations: brute force, planted cases and awkward rows."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, passages, periodic, pii, shards, turns
from tests.llm.test_operators import ALL_IDS, AWKWARD, DOCS, ids


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def brute_runs(ws, least):
    """Every stretch of equal words q apart, longest first period only."""
    out, n = {}, len(ws)
    for q in range(1, n // 2 + 1):
        j = 0
        while j < n - q:
            s = j
            while j < n - q and ws[j] == ws[j + q]:
                j += 1
            if j - s and j - s + q >= max(least, 2 * q):
                out.setdefault((s, j - s + q), q)
            j += j == s
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def test_runs_against_brute_force():
    rng = random.Random(1)
    for _ in range(800):
        n, letters = rng.randint(0, 70), rng.randint(1, 4)
        ws = [rng.randrange(letters) for _ in range(n)]
        if n and rng.random() < 0.5:
            a, p = rng.randrange(n), rng.randint(1, 9)
            ws = [ws[i] if i < a else ws[a + (i - a) % min(p, n - a)] for i in range(n)]
        least = rng.choice([1, 2, 5, 12])
        assert sorted(periodic.runs_of(ws, least)) == sorted(brute_runs(ws, least))
        (_, found, text) = periodic.make_finder(least)([" \t".join(map(str, ws))])[0]
        assert [(r["start"], r["length"], r["period"]) for r in found] == brute_runs(ws, least)
        gone = {i for s, m, q in brute_runs(ws, least) for i in range(s + q, s + m)}
        assert text == " ".join(str(w) for i, w in enumerate(ws) if i not in gone)


def test_runs_of_long_texts_take_linear_time():
    rng = random.Random(2)
    base = [rng.randrange(5000) for _ in range(9000)]
    assert periodic.runs_of([base[i % 9000] for i in range(40_000)]) == [(0, 40_000, 9000)]
    assert periodic.runs_of([0] * 50_000) == [(0, 50_000, 1)]


def test_runs_on_awkward_rows(spark, awkward, empty):
    got = periodic.find_runs(awkward.withColumn("runs", F.lit("clash"))).collect()
    assert ids(got) == ALL_IDS
    for r in got:
        assert r.n_words == len((r.text or "").split()) and (r.runs != []) == (r.doc_id == 4) and (r.collapsed == " ".join((r.text or "").split()) or r.doc_id == 4)
    long = next(r for r in got if r.doc_id == 4)
    assert [tuple(x) for x in long.runs] == [(0, 30_000, 1)] and long.collapsed == "word"
    assert periodic.find_runs(empty).count() == 0
    text = F.lit(" a b c  d e f ")
    tailed = spark.range(1).select(periodic.repeat_tail(text, lambda n: n - 4, lambda n, a: F.lit(3)), periodic.repeat_tail(F.lit(" \n"), lambda n: n, lambda n, a: n)).first()
    assert tuple(tailed) == ("a b c d e c", "")


def brute_cuts(sizes, k):
    def parts(c):
        n, now = 1, 0
        for s in sizes:
            n, now = (n + 1, s) if now + s > c else (n, now + s)
        return n

    capacity = next(c for c in range(max(sizes), sum(sizes) + 1) if parts(c) <= k)
    places = [sum(sizes[:i]) for i in range(len(sizes) + 1)]
    floor, ceil = (lambda x: max(p for p in places if p <= x)), (lambda x: min(p for p in places if p >= max(x, 0)))
    back = [places[-1]]
    for _ in range(k - 1):
        back.append(ceil(back[-1] - capacity))
    cuts = [0]
    for j in range(1, k):
        even = j * places[-1] // k
        near = min(floor(even), ceil(even), key=lambda p: (abs(p - even), p))
        cuts.append(min(max(near, back[k - j]), floor(cuts[-1] + capacity)))
    return capacity, cuts[1:]


@pytest.fixture
def coarse():
    """Few bins and small steps: many rounds give the same cuts."""
    old = shards.FIRST_BITS, shards.SPLIT_BITS, shards.BINS
    shards.FIRST_BITS, shards.SPLIT_BITS, shards.BINS = 3, 2, 8
    yield
    shards.FIRST_BITS, shards.SPLIT_BITS, shards.BINS = old


def places_of(sizes):
    at, out = 0, []
    for s in sizes:
        out.append((at,))
        at += s
    return out


def test_minimax_against_brute_force(spark, coarse):
    rng = random.Random(5)
    for n, k in ((1, 3), (40, 5), (200, 24), (30, 24)):
        sizes = [8 + int(rng.expovariate(0.05)) for _ in range(n)]
        if n == 40:
            sizes[17] += sum(sizes) // 2
        groups = spark.createDataFrame(places_of(sizes), "place long")
        assert shards.minimax(groups, k, sum(sizes), max(sizes)) == brute_cuts(sizes, k)


def test_shards(spark, awkward, empty, tmp_path):
    rng = random.Random(6)
    rows = [(i, "copy " * 30 if i % 3 == 0 else "x" * rng.randint(0, 400) + str(i)) for i in range(600)] + [(None, "no id"), (None, None), (1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("slot", F.lit("clash"))
    out = shards.shard(docs, 7)
    got = out.collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"bytes"} and all(r.size == len(r.text or "") + 8 and r.grown_shard is None for r in got)
    for s in range(7):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    by_text = {}
    for r in got:
        assert by_text.setdefault(r.text or "", r.shard) == r.shard
    groups = {}
    for r in got:
        groups.setdefault(r.text or "", []).append(r)
    line = sorted((min((x.doc_id is not None, x.doc_id or 0) for x in g), sum(x.size for x in g)) for g in groups.values())
    total = [sum(r.size for r in got if r.shard == s) for s in range(7)]
    assert max(total) <= brute_cuts([b for _, b in line], 7)[0]
    shards.write_shards(out, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(rows)
    some = shards.shard(awkward, 3, ["doc_id", "row"]).collect()
    assert ids(some) == ALL_IDS and len({r.shard for r in some if r.doc_id == 3}) == 1 and {r.text_crc32 for r in some if r.doc_id in (1, 2)} == {0}
    assert shards.shard(empty, 3).count() == 0


def brute_repair(rows):
    """Cheapest letters by going through all of them in the order of cost and letters; rows of (role, fault)."""
    from heapq import heappop, heappush

    heap, best = [(0, "", 0, "")], None
    while heap:
        cost, letters, i, roles = heappop(heap)
        if best and cost > best[0]:
            return best
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best or (cost, letters), (cost, letters))
        legal = lambda r: re.fullmatch("s?(ua)*u?", roles + r)  # noqa: B023, E731
        if i < len(rows):
            heappush(heap, (cost + 4, letters + "D", i + 1, roles))
            if (fault := rows[i][1]) in (turns.FINE, turns.TRUNCATED):
                more, initial = 3 * (fault == turns.TRUNCATED), rows[i][0][:1]
                if initial in ("s", "u", "a") and legal(initial):
                    heappush(heap, (cost + more, letters + "K", i + 1, roles + initial))
                for r in filter(legal, "ua"):
                    heappush(heap, (cost + 3 + more, letters + "R", i + 1, roles + r))
        if not letters.endswith("II"):
            for r in filter(legal, "ua"):
                heappush(heap, (cost + 3, letters + "I", i, roles + r))
    return best


def test_repair_against_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        rows = [(rng.choice(["system", "user", "assistant", "user", "assistant", "tool", " ", ""]), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(1, 6))]
        found = turns.search([(role, "", 1, fault) for role, fault in rows])
        assert found.end()[:2] == brute_repair(rows)


def test_settled_letters_leave_the_tree():
    rng = random.Random(4)
    rows = [(rng.choice(["user", "assistant"]), "", 1, rng.choice([0, 0, 0, 1, 3])) for _ in range(5000)]
    found = turns.search(rows)
    assert len(found.settled) > 4900 and len(found.path(found.end()[2])) == 5001  # one step for turns put in before the first row


CONV = "conv_id long, turn long, role string, text string, cost string"


def expected(rows):
    """Everything that repair returns of one conversation, in plain Python."""
    rows = sorted(((t is not None, t or 0, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows))
    seen, faults, kept = set(), [], []
    for _, _, role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        faults.append(1 if not bare else 2 if (role, text) in seen else 0 if bare[-1] in ".!?" else 3)
        seen.add((role, text))
    cost, letters = brute_repair([(r[2], f) for r, f in zip(rows, faults, strict=True)])
    rest = iter(rows)
    for c in letters:
        row = None if c == "I" else next(rest)
        if c != "D":
            n = len(kept) - (bool(kept) and kept[0][0][0] == "s")
            kept.append((row[2] if c == "K" else ("user", "assistant")[n % 2], row[3] if row else ""))
    named = [t for has, t, *_ in rows if has]
    pairs = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(named) - min(named) + 1 - len(set(named)) if named else 0
    digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in kept).encode()).hexdigest()
    return (gaps, faults.count(1), faults.count(2), faults.count(3), pairs, cost, letters, digest), kept


@pytest.mark.parametrize("block", [turns.BLOCK, 2])
def test_conversations(spark, block):
    rng = random.Random(7)
    texts = ["Hello there.", "Why?", "cut off", " \n", "", None, "Yes! ", "no.\t"]
    rows = [(c if c else None, rng.choice([None, *range(9)]), rng.choice(["system", "user", "assistant", "user", "assistant", None, "tool"]), rng.choice(texts)) for c in range(40) for _ in range(rng.randint(1, 7))]
    rows += rng.choices(rows, k=20) + [(77, t, ("user", "assistant")[t % 2], f"fine {t}.") for t in range(8)] + [(78, t, "user", "") for t in range(6)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], CONV)
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    got = {r.conv_id: tuple(r[n] for n in names) for r in turns.repair(df, block=block).collect()}
    want = {c: expected([r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert got == {c: w for c, (w, _) in want.items()}
    fixed = {}
    for r in turns.repaired_turns(df, block=block).orderBy("position").collect():
        fixed.setdefault(r.conv_id, []).append((r.role, r.text))
    assert fixed == {c: kept for c, (_, kept) in want.items() if kept}


def test_conversations_without_rows(spark):
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    df = spark.createDataFrame([(1, 0, "user", "x", ""), (1, 5, "user", "x", ""), (None, None, None, None, "")], CONV)
    assert [tuple(r)[1:] for r in turns.repair(df, F.lit(0)).collect()] == [nothing] * 2
    assert turns.repair(df.limit(0)).count() == 0 and turns.repaired_turns(df.limit(0)).count() == 0
    long = " ".join(["word"] * 200_000) + "."
    got = turns.repair(spark.createDataFrame([(1, 0, "user", long, ""), (1, 1, "assistant", long, "")], CONV)).first()
    assert (got.cost, got.audit) == (0, "KK") and got.repaired_sha256 == hashlib.sha256(f"user:{long}\nassistant:{long}".encode()).hexdigest()


def test_passages_of_repeated_ids(spark):
    """Every text of an id is searched: on either side, against other ids only."""
    from tests.llm.test_operators import prose

    one, two = prose(80, 501), prose(80, 502)
    rows = [(1, f"{prose(20, 1)} {one}"), (2, prose(60, 2)), (2, f"{prose(5, 3)} {one}"), (2, f"{one} {prose(9, 4)}"), (3, f"{prose(7, 5)} {two}"), (3, f"{two} {prose(30, 6)}"), (4, f"{prose(11, 7)} {two} {prose(3, 8)}"), (4, f"{prose(11, 7)} {two} {prose(3, 8)}"), (None, one)]
    got = {(r.doc_id, r.start, r.end, r.home_id, r.home_end - r.home_start) for r in passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(2, 5, 85, 1, 80), (2, 0, 80, 1, 80), (4, 11, 91, 3, 80)}


def test_passages_go_on_beyond_any_margin(spark):
    """Behind the last seed in common a passage may go on over short runs between changes, further than what is fetched at first."""
    from tests.llm.test_operators import prose

    base = prose(400, 77).split()
    new = [*base[:40], *[f"x{i}" if i % 7 == 6 else w for i, w in enumerate(base[40:])]]
    got = passages.shared_passages(spark.createDataFrame([(1, " ".join(base)), (2, " ".join(new))], "doc_id long, text string")).collect()
    assert [(r.start, r.end) for r in got] == [(0, 396)]  # three words behind the last change are too few to go on


def test_alignment_of_long_sides():
    import tracemalloc

    import numpy as np

    rng = random.Random(8)
    for _ in range(60):
        a = [rng.randrange(30) for _ in range(rng.randint(0, 90))]
        b = list(a)
        for _ in range(rng.randint(0, 9)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 2)] = [rng.randrange(30)] * rng.randint(0, 2)
        assert passages.common(np.array(a, np.uint32), np.array(b, np.uint32)) == passages.lcs(a, b)
    long = np.array([rng.randrange(1 << 32) for _ in range(200_000)], np.uint32)
    other = np.delete(long, range(500, 200_000, 1000))
    other[70_000] += 1
    tracemalloc.start()
    assert passages.common(long, other) == len(other) - 1
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()


def test_reported_span_has_the_reported_distance(spark):
    from tests.llm.test_operators import prose

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng, items, rows = random.Random(12), [], []
    for i in range(30):
        item = prose(20, 3000 + i)
        text = list(item)
        for _ in range(5):
            at = rng.randrange(8, len(text) - 8)
            text[at : at + rng.randint(0, 2)] = rng.choice(["", "q", "zz"])
        items.append((i, item))
        rows.append((i, f"{prose(12, 4000 + i)} {''.join(text)} {prose(9, 5000 + i)}"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert len(got) >= 15  # the others have more edits than their budget
    for r in got:
        assert distance(decontaminate.normal(items[r.item_id][1]), decontaminate.normal(rows[r.doc_id][1])[r.start : r.end]) == r.distance


def test_more_kinds_of_personal_data(spark):
    long = "Z" + "abcdefghij" * 6
    cases = {f"Mr {long}": r"Mr \w+", "Dr Smith": r"Dr \w+", "Prof. Anna Weber": r"Prof\. \w+ \w+", "123-45-6789": r"\d{3}-\d\d-\d{4}", "0171 5551234": r"\d{4} \d{7}", "DE89 3704 0044 0532 0130 00": r"DE\d\d(?: \d{4}){4} \d\d", "GB29NWBK60161331926819": r"GB\d\d[A-Z]{4}\d{14}", "2001:0db8:85a3:0:0:8a2e:0370:7334": r"(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}", "fe80::1ff:fe23": r"[0-9a-f]{4}::[0-9a-f]{3}:[0-9a-f]{4}"}
    kept = ["at 12:30:45", "10:11", "1999-12-31", "a::b c", "chapter 0 12 345", "IT21"]
    rows = [f"see {x}, then" for x in (*cases, *kept)]
    got = [r.text for r in pii.pseudonymize(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    for old, new, shape in zip(rows, got, [*cases.values(), *[None] * len(kept)], strict=True):
        if shape is None:
            assert new == old
        else:
            was, now = old[4:-6], new[4:-6]
            assert re.fullmatch(shape, now) and now != was and len(now) >= len(was), (old, new)
            assert now.removeprefix("Mr ")[-20:] != was[-20:]


def test_long_entities_take_linear_time(spark):
    import time

    docs = lambda n: spark.createDataFrame([(1, "x" * n + "@y.org"), (2, "x" * (n - 1) + "z@y.org")], "doc_id long, text string")
    pii.pseudonymize(docs(20), "k").collect()
    start = time.time()
    a, b = (r.text.split("@")[0] for r in pii.pseudonymize(docs(6000), "k").orderBy("doc_id").collect())
    assert len(a) == len(b) == 6000 and a[:-1] == b[:-1] and a[-1] != b[-1] and "x" * 9 not in a
    assert time.time() - start < 60


def test_stages_on_awkward_tables(spark):
    """Every stage of the pipeline on nulls, blanks, repeated rows, very long texts and clashing columns, and on no rows."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    odd = spark.createDataFrame(AWKWARD, DOCS).select("doc_id", "text", "lang", "source", "n_chars", F.lit("clash").alias("score"), F.lit(1).alias("slot"), F.lit("x").alias("item_id"))
    texts = lambda df: sorted(str(r.text)[:40] for r in df.collect())
    every = texts(odd)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, sf)
        last = name == corpus_pipeline.STAGES[-1][0]
        assert last or out.columns == corpus_pipeline.COLUMNS
        want = every
        if name == "n-gram Jaccard join":  # of the repeated rows of id 3 one stays
            want = sorted({*every})
        assert texts(out) == want, name
        assert stage(spark, odd.limit(0), sf).count() == 0


def test_pairs_that_share_one_seed_are_not_chained(spark):
    """Of documents whose texts share one place of one seed no seeds are joined; runs of a word and whole passages keep their chains, and repeated places make no square."""
    stuff = lambda n, at: [f"w{at}x{i}" for i in range(n)]
    texts = {1: stuff(80, 1), 2: ["of"] * 70 + stuff(9, 2), 3: stuff(9, 3) + ["of"] * 60, 4: stuff(80, 1)[:8] + stuff(70, 4)}
    docs = passages.hashed(spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string"))
    seeds = passages.seeds(docs, passages.K, 1).cache()
    homes = passages.seed_homes(seeds)
    pairs = spark.createDataFrame([(3, 2), (4, 1), (4, 2)], "doc_id long, home long")
    got = {(r.doc_id, r.home, r.x0, r.x1, r.y0, r.y1) for r in passages.pair_chains(seeds, homes, pairs, passages.K).collect()}
    assert got == {(3, 2, 9, 69, 0, 60), (4, 1, 0, 8, 0, 8)}
    x, y = passages.meetings(list(range(60)), list(range(70)), True)
    assert len(x) == len(y) == 60 and len(passages.meetings(list(range(60)), list(range(70)), False)[0]) == 60 + 59 + 69


def test_short_runs_of_a_word_are_no_keys(spark):
    """Runs inside a stretch of one word that is no passage make no pairs; those across its ends, beyond it, and of long stretches do."""
    far = [f"y{i}" for i in range(40)]
    texts = {1: ["a1", *["of"] * 40, "b1"], 2: ["a2", *["of"] * 44, "b2"], 3: ["a3", *["of"] * 40, *far], 4: ["a4", *["of"] * 45, *far], 5: ["a5", *["of"] * 60], 6: ["a6", *["of"] * 70]}
    docs = passages.hashed(spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string"))
    members = spark.createDataFrame([(7, i, list(range(1, 1 + t.count("of") - 5)), i == 1) for i, t in texts.items()], "seed long, doc_id long, at array<int>, main boolean")
    keys = {}
    for r in passages.beside(docs, members, passages.K, 50).collect():
        keys.setdefault(r.doc_id, set()).add(r.key)
    meet = {(a, b) for a in texts for b in texts if a < b and keys.get(a, set()) & keys.get(b, set())}
    assert meet == {(3, 4), (5, 6)}
