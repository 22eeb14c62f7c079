"""Toxicity by maximum-scoring segments of token log-odds, calibrated by extreme values.

1. Word counts of labelled documents give log-odds between the classes, each
   smoothed by a Dirichlet prior whose mean is the word's share in all labelled
   text. A word that is rare by itself falls back on its longest frequent prefix.
2. A token scores its log-odds where these are significant, else a small
   negative drift. The Ruzzo-Tompa scan finds, in time linear in the tokens,
   every maximal segment of a text.
3. The best segment of a harmless text follows an extreme-value (Gumbel) law
   with n: P(S >= x) = 1 - exp(-K n exp(-lambda x)). lambda solves
   sum p(s) exp(lambda s) = 1 over harmless tokens, K is fitted to harmless
   texts. The log of the expected count of such segments is turned into
   a probability by a logistic fit on the labelled sample.

Defined results: a null or empty text has no token, no segment and the score
of a text with no evidence; documents of one id are scored row by row; other
columns are carried along, those named like the new ones replaced; an empty label table gives a model that finds
nothing (score 0).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import WORD_CACHE, WordHashes, ascii_words, materialize, rolling, with_columns_py

#: Bound on the labelled rows the model is fitted on; its features are words and prefixes of these.
MAX_LABELLED = 20_000
PREFIXES = (4, 5, 6, 7, 8)
_TOKEN = re.compile(r"[^\W_]+")


@dataclass
class ToxicityModel:
    words: dict[str, float] = field(default_factory=dict)
    prefixes: dict[str, float] = field(default_factory=dict)
    drift: float = 0.5
    lam: float = 1.0
    log_k: float = 0.0
    slopes: tuple[float, float] = (0.5, 1.0)
    bias: float = 0.0
    base: float = 0.01

    def scorer(self) -> TokenScores:
        return TokenScores(self)

    def evidence(self, best: float, n: int) -> float:
        """-log of the expected number of harmless segments at least this good."""
        return self.lam * best - self.log_k - math.log(max(n, 1))

    def features(self, segs: list[float], n: int) -> tuple[float, float]:
        """Of segment scores: the best one's evidence, and the log of one plus the sum of what is significant."""
        return self.evidence(max(segs), n), math.log1p(sum(e for s in segs if (e := self.evidence(s, n)) > 0))

    def probability(self, segs: list[float], n: int) -> float:
        """Of a toxic text; without any evidence, half the share of toxic texts among such."""
        if not segs:
            return self.base
        a, b = self.features(segs, n)
        x = self.slopes[0] * a + self.slopes[1] * b + self.bias
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, x))))


class TokenScores(dict):
    """Log-odds of a token; 0 stands for no significant evidence."""

    def __init__(self, model: ToxicityModel):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) > WORD_CACHE:
            self.clear()
        s = self.model.words.get(word)
        if s is None:
            s = next((p for n in reversed(PREFIXES) if n <= len(word) and (p := self.model.prefixes.get(word[:n])) is not None), 0.0)
        self[word] = s
        return s


def segments(scores: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), by Ruzzo and Tompa.

    scores lists the tokens with positive or negative evidence as (position,
    score); every token between two of them costs drift. A candidate keeps the
    place of the nearest one to its left with a smaller sum left of it; whatever
    lies between has a larger one and is passed over in one step.
    """
    stack: list[list[float]] = []  # start, end, sum left of it, sum up to its end, place of the one to the left
    total, last = 0.0, -1
    for at, s in scores:
        total -= drift * (at - last - 1)
        last = at
        if s <= 0:
            total += s
            continue
        new = [at, at, total, total + s]
        total += s
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= new[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= new[3]:
                stack.append([*new, j])
                break
            new = [stack[j][0], new[1], stack[j][2], new[3]]
            left = stack[j][4]
            del stack[j:]
            j = left
    return [(int(a), int(b), r - lo) for a, b, lo, r, _ in stack]


def scan(text: str | None, scores: TokenScores, drift: float) -> tuple[int, list[tuple[int, int, float]]]:
    """Number of tokens of the whole text, and its maximal segments."""
    tokens = _TOKEN.findall(text.lower()) if text else []
    hits = [(i, s) for i, s in enumerate(map(scores.__getitem__, tokens)) if s]
    return len(tokens), segments(hits, drift) if hits else []


def log_odds(counts: DataFrame, key: str, n1: int, n0: int, prior_docs: float) -> DataFrame:
    """Features (key, y1, y0, n_words, delta, z) of a table (key, toxic, n, word).

    y1 and y0 count the toxic and harmless documents with the feature. The
    Dirichlet prior has half a document for each feature, and prior_docs more
    that are spread as in all labelled text. delta is the difference of the
    smoothed log-odds, z the signed root of the deviance of the two counts from
    the classes' shares, which is standard normal for harmless features.
    """
    n_of = lambda c: F.sum(F.when(F.col("toxic") == c, F.col("n")).otherwise(0))
    by = counts.groupBy(key).agg(n_of(1).alias("y1"), n_of(0).alias("y0"), F.count_distinct("word").alias("n_words"))
    a = F.lit(0.5) + F.lit(prior_docs / (n1 + n0)) * (F.col("y1") + F.col("y0"))
    up = lambda y, n: F.log((y + a) / (F.lit(float(n) + prior_docs + 1) - F.least(y, F.lit(n))))
    by = by.withColumn("delta", up(F.col("y1"), n1) - up(F.col("y0"), n0))
    y1, y0, share = F.col("y1"), F.col("y0"), n1 / (n1 + n0)
    term = lambda y, p: F.when(y > 0, y * F.log(y / ((y1 + y0) * p))).otherwise(0.0)
    deviance = 2 * (term(y1, share) + term(y0, 1 - share))
    return by.withColumn("z", F.signum(y1 / (y1 + y0) - F.lit(share)) * F.sqrt(F.greatest(deviance, F.lit(0.0))))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED, drift: float = 0.5, odds: float = 0.2) -> ToxicityModel:
    """Learn from docs (doc_id, text) and labels (doc_id, toxic); at most about max_rows labelled rows.

    Conflicting labels of one document count as toxic; null labels as none. A
    feature is significant when less than odds of the tested ones would look so by chance.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    share = max_rows / max(known.count(), 1)
    if share < 1:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(int(max_rows * 1.1))
    sample = materialize(one_of_each(docs.select("doc_id", "text").where("text is not null").join(F.broadcast(known), "doc_id").select("text", "toxic")))
    n1, n0 = sample.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    model = ToxicityModel(drift=drift)
    if not n1 or not n0:
        return model
    words = sample.select("toxic", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("word")).where("word <> ''")
    words = materialize(words.groupBy("word", "toxic").agg(F.count(F.lit(1)).alias("n")))
    least = NormalDist().inv_cdf(1 - odds / max(words.select("word").distinct().count(), 1000))
    heads = words.select("toxic", "n", "word", F.explode(F.array(*[F.when(F.length("word") >= p, F.substring("word", 1, p)) for p in PREFIXES])).alias("head")).where("head is not null")
    tops = log_odds(heads, "head", n1, n0, 10.0).where(F.col("n_words") >= 4).where((F.col("y1") >= 8) & (F.col("z") >= least) & (F.col("delta") >= 2.0))
    model.prefixes = {r.head: r.delta for r in tops.select("head", "delta").collect()}
    at = F.array(*[F.lit(p) for p in model.prefixes]) if model.prefixes else F.array(F.lit(""))
    under = F.arrays_overlap(at, F.array(*[F.substring("word", 1, p) for p in PREFIXES]))
    seen = log_odds(words, "word", n1, n0, 10.0).where((F.col("z") >= least) & (F.col("y1") >= 5) | under & (F.col("y1") + F.col("y0") >= 8))
    for r in seen.select("word", "delta", "z").collect():
        model.words[r.word] = r.delta if r.z > 2 else 0.0
    _calibrate(model, sample)
    return model


def one_of_each(sample: DataFrame) -> DataFrame:
    """One labelled text of those that share their least word 5-gram hash.

    Copies and near copies agree in it, and would otherwise make every rare
    word of a copied text look like evidence.
    """
    def make():
        words = WordHashes()

        def least(text):
            h = words.of(ascii_words(text))
            return (int(rolling(h, min(5, len(h))).min().view(np.int64)),) if len(h) else (None,)

        return lambda texts: [least(t) for t in texts]

    keyed = with_columns_py(sample, "text", make, [T.StructField("least", T.LongType())])
    return keyed.groupBy("least").agg(F.max_by(F.struct("text", "toxic"), F.xxhash64("text")).alias("r")).select("r.*")


def _calibrate(model: ToxicityModel, sample: DataFrame) -> None:
    """Fit the extreme-value law and the logistic step; the driver gets a few numbers for each text and a count for each score."""
    doubles = T.ArrayType(T.DoubleType())
    fields = [T.StructField("n", T.IntegerType()), T.StructField("segs", doubles), T.StructField("scores", doubles), T.StructField("times", T.ArrayType(T.IntegerType()))]

    def make():
        scores = model.scorer()

        def one(text):
            n, segs = scan(text, scores, model.drift)
            hits = Counter(s for s in map(scores.__getitem__, _TOKEN.findall(text.lower())) if s) if segs else {}
            return n, [s for *_, s in segs], list(hits), list(hits.values())

        return lambda texts: [one(t or "") for t in texts]

    found = materialize(with_columns_py(sample, "text", make, fields, ["toxic"]).withColumn("best", F.coalesce(F.array_max("segs"), F.lit(0.0))))
    seen = found.select("toxic", "n", "best").collect()
    y = np.array([r.toxic for r in seen])
    n = np.array([max(r.n, 1) for r in seen], float)
    best = np.array([r.best for r in seen])
    calm = y == 0
    counts = found.where("toxic = 0").select(F.explode(F.arrays_zip("scores", "times")).alias("h")).groupBy("h.scores").agg(F.sum("h.times").alias("times")).collect()
    hits = np.array([r.scores for r in counts] or [max([*model.words.values(), *model.prefixes.values()], default=1.0)])
    times = np.array([r.times for r in counts] or [1], float)
    tokens = max(n[calm].sum(), times.sum() + 1.0)
    low, high = 1e-3, 5.0
    moment = lambda lam: ((times * np.exp(np.minimum(lam * hits, 50))).sum() + (tokens - times.sum()) * math.exp(-lam * model.drift)) / tokens - 1
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if moment(mid) < 0 else (low, mid)
    model.lam = (low + high) / 2
    got = calm & (best > 0)
    # K by maximum likelihood over the harmless texts' best segments
    model.log_k = math.log(max(got.sum(), 1) / max((n[calm] * np.exp(-model.lam * best[calm])).sum(), 1e-9))
    has = best > 0
    evidence = lambda s: F.lit(model.lam) * s - F.lit(model.log_k) - F.log(F.greatest("n", F.lit(1)))
    sums = F.aggregate("segs", F.lit(0.0), lambda total, s: total + F.greatest(evidence(s), F.lit(0.0)))
    rows = found.where("best > 0").select("toxic", evidence(F.col("best")).alias("a"), F.log1p(sums).alias("b")).orderBy("a", "b", "toxic").collect()
    x = np.array([(r.a, r.b) for r in rows])
    t = np.array([r.toxic for r in rows], float)
    if len(x) and 0 < t.sum() < len(t):
        mu, sd = x.mean(0), np.maximum(x.std(0), 1e-3)
        u, w = np.c_[(x - mu) / sd, np.ones(len(x))], np.zeros(3)
        for _ in range(100):  # Newton steps of bounded length, with a ridge
            p = 1 / (1 + np.exp(-np.clip(u @ w, -30, 30)))
            step = np.linalg.solve((u * (p * (1 - p))[:, None]).T @ u + np.eye(3), u.T @ (p - t) + w)
            w -= step * min(1.0, 1.0 / (np.linalg.norm(step) + 1e-12))
        model.slopes = tuple(float(v) for v in w[:2] / sd)
        model.bias = float(w[2] - (w[:2] * mu / sd).sum())
    none = ~has
    model.base = float((y[none].sum() + 0.5) / (none.sum() + 2)) / 2


PASSAGES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))


def score(docs: DataFrame, model: ToxicityModel, keep: list[str] | None = None, passages: bool = False) -> DataFrame:
    """Add n_tokens, n_passages, score and predicted to every row of docs; no shuffle.

    With passages, add passages too: the significant segments (start and
    end token, score) whose expected number in harmless text is below 1.
    """
    fields = [T.StructField("n_tokens", T.IntegerType()), T.StructField("n_passages", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    fields += [T.StructField("passages", PASSAGES)] * passages

    def make():
        scores = model.scorer()

        def one(text):
            n, segs = scan(text, scores, model.drift)
            good = [s for s in segs if model.evidence(s[2], n) > 0]
            p = model.probability([s for *_, s in segs], n)
            row = (n, len(good), p, int(p >= 0.5))
            return (*row, [{"start": a, "end": b, "score": s} for a, b, s in good]) if passages else row

        return lambda texts: [one(t) for t in texts]

    return with_columns_py(docs, "text", make, fields, keep)
