"""Language ID of words in code-switched text by a linear-chain conditional random field.

Every word has features - itself if it is in the learned lexicon, its prefixes and
suffixes, its character n-grams - in a weight table with a row for each
language. The lexicon is the words of LEXICON_RUNS training runs or more, with a place each; affixes and
n-grams are hashed. Transitions between neighbouring words' languages are learned with
them, by gradient ascent on the conditional likelihood. Forward-backward gives
every word its probability of each language; a document's language is the one with the
largest expected number of letters.

The training rows know one language for a whole document, so code-switched
sequences are made from them: runs of words of randomly chosen documents, each
labelled with its document's language.

A chain is at most CHAIN words long; longer texts are several chains, all of them
scored. Chains of a batch run through the recursions side by side.

Defined results: und with score 0 where the text is null or has no letter; rows
are labelled one by one, so null or repeated ids do not matter; without any labelled
row every text is und; columns not asked for are dropped.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import WORD_CACHE, with_columns_py

#: Bounds of the labelled sample: documents of a language, runs of words that one gives (spread over its whole text).
DOCS_PER_LANGUAGE, RUNS_PER_DOC = 300, 16
HASHED, CHAIN, EPOCHS = 1 << 16, 64, 12
LEXICON_RUNS = 3
_WORD, _LETTERS = re.compile(r"[^\W\d_]+"), regex.compile(r"\p{L}+")


def words_of(text: str) -> list[str]:
    """Runs of letters, lower case. The plain pattern takes some numerals too, so words with such are cut again."""
    words = _WORD.findall(text.lower())
    if all(map(str.isalpha, words)):
        return words
    return [part for w in words for part in _LETTERS.findall(w)]


class FeatureIds(dict):
    """Place of a feature in the hashed table; remembers a bounded number."""

    def __missing__(self, feature: str) -> int:
        if len(self) > WORD_CACHE:
            self.clear()
        i = self[feature] = xxhash.xxh3_64_intdigest(feature.encode()) % HASHED
        return i


_IDS = FeatureIds()


def features(word: str, lexicon: dict[str, int]) -> list[int]:
    """Places of a word's features: itself in the lexicon, affixes of 1 to 4 letters, n-grams of 2 and 3."""
    w = f"<{word}>"
    found = ["P" + w[:2], "P" + w[:3], "P" + w[:4], "P" + w[:5], "S" + w[-2:], "S" + w[-3:], "S" + w[-4:], "S" + w[-5:]]
    found += [w[i : i + 2] for i in range(len(w) - 1)]
    found += [w[i : i + 3] for i in range(len(w) - 2)]
    places = list(map(_IDS.__getitem__, found))
    if (own := lexicon.get(word)) is not None:
        places.append(HASHED + own)
    return places


@dataclass
class Crf:
    langs: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((HASHED, 0), np.float32))
    trans: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    lexicon: dict[str, int] = field(default_factory=dict)


class Emissions(dict):
    """A word's row in a growing table of emission scores."""

    def __init__(self, crf: Crf):
        super().__init__()
        self.crf = crf
        self.table = np.zeros((4096, len(crf.langs)), np.float32)
        self.letters = np.zeros(4096, np.float32)

    def learn(self, words: list[str]) -> None:
        """Add rows for new words, all at once."""
        if not words:
            return
        n, m = len(self), len(words)
        while n + m > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
        found = [features(w, self.crf.lexicon) for w in words]
        sizes = np.fromiter(map(len, found), int, m)
        flat = np.fromiter(chain.from_iterable(found), int, sizes.sum())
        sums = np.add.reduceat(self.crf.weights[flat], np.r_[0, sizes.cumsum()[:-1]])
        self.table[n : n + m] = sums / sizes[:, None] * 4
        self.letters[n : n + m] = np.fromiter(map(len, words), int, m)
        self.update(zip(words, range(n, n + m), strict=True))


def forward_backward(e: np.ndarray, mask: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals (chains, words, languages), alphas and the log normaliser of padded chains; mask marks the real words."""
    n, t_max, _ = e.shape
    move = np.exp(trans)
    top = e.max(2, keepdims=True)
    p = np.exp(e - top)
    alpha, scale = np.empty_like(p), np.ones((n, t_max), p.dtype)
    a = p[:, 0]
    for t in range(t_max):
        if t:
            a = np.where(mask[:, t, None], (a @ move) * p[:, t], a)
        scale[:, t] = a.sum(1)
        a = a / scale[:, t, None]
        alpha[:, t] = a
    beta = np.ones_like(p)
    b = np.ones_like(p[:, 0])
    for t in range(t_max - 1, 0, -1):
        nxt = (b * p[:, t]) @ move.T
        b = np.where(mask[:, t, None], nxt / nxt.sum(1, keepdims=True), b)
        beta[:, t - 1] = b
    m = alpha * beta
    m /= m.sum(2, keepdims=True)
    return m, alpha, np.log(scale).sum(1) + (top[..., 0] * mask).sum(1)


def fit(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, runs_per_doc: int = RUNS_PER_DOC, epochs: int = EPOCHS, seed: int = 7) -> Crf:
    """Learn from the text and non-null lang of docs; a bounded hash sample of each language's rows is used."""
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Crf()
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(int((1 << 20) * min(1.0, docs_per_language / n)) + 1))])
    taken = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < share[F.col("lang")]).distinct()
    cut = with_columns_py(taken, "text", lambda: lambda texts: [(word_runs(t, runs_per_doc, seed),) for t in texts], [T.StructField("runs", T.ArrayType(T.StringType()))], ["lang"])
    langs = sorted(counts)
    runs = [(langs.index(lang), run.split(" ")) for lang, run in sorted((r.lang, run) for r in cut.collect() for run in r.runs)]
    return _train(langs, runs, epochs, np.random.default_rng(seed)) if runs else Crf()


def word_runs(text: str, most: int, seed: int) -> list[str]:
    """Up to most runs of 4 to 40 words, evenly spread over the whole text."""
    words = words_of(text)
    rng = np.random.default_rng([seed, len(words)])
    starts = range(0, len(words), max(24, -(-len(words) // most)))
    return [" ".join(words[a : a + int(rng.integers(4, 40))]) for a in starts]


def _train(langs: list[str], runs: list[tuple[int, list[str]]], epochs: int, rng: np.random.Generator) -> Crf:
    """Adam on the mean conditional log-likelihood of chains glued from shuffled runs."""
    n_lang = len(langs)
    words = sorted({w for _, ws in runs for w in ws})
    row = {w: i for i, w in enumerate(words)}
    runs_of = Counter(w for _, ws in runs for w in set(ws))
    lexicon = {w: i for i, w in enumerate(w for w in words if runs_of[w] >= LEXICON_RUNS)}
    feats = [features(w, lexicon) for w in words]
    # only places that some training word has are learned; the others stay 0
    used, flat = np.unique(np.concatenate([np.array(f) for f in feats]), return_inverse=True)
    owner = np.repeat(np.arange(len(words)), [len(f) for f in feats])
    first = np.r_[0, np.cumsum([len(f) for f in feats])[:-1]]
    by_place = np.argsort(flat, kind="stable")
    place_first = np.searchsorted(flat[by_place], np.arange(len(used)))
    size = np.array([len(f) for f in feats], float)
    weights, trans = np.zeros((len(used), n_lang)), np.eye(n_lang) * 2.0
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (weights, trans)]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(runs))
        tokens = np.concatenate([[row[w] for w in runs[i][1]] for i in order]).astype(int)
        gold = np.concatenate([np.full(len(runs[i][1]), runs[i][0]) for i in order])
        chains = len(tokens) // CHAIN
        if not chains:
            tokens, gold, chains = np.resize(tokens, CHAIN), np.resize(gold, CHAIN), 1
        tokens, gold = tokens[: chains * CHAIN].reshape(-1, CHAIN), gold[: chains * CHAIN].reshape(-1, CHAIN)
        for part in np.array_split(rng.permutation(chains), max(1, chains // 400)):
            step += 1
            x, y = tokens[part], gold[part]
            base = np.add.reduceat(weights[flat], first) / size[:, None] * 4
            e = base[x]
            m, alpha, _ = forward_backward(e, np.ones(x.shape, bool), trans)
            err = np.eye(n_lang)[y] - m
            by_word = np.stack([np.bincount(x.ravel(), err[..., k].ravel(), len(words)) for k in range(n_lang)], 1) / size[:, None] * 4
            g_w = np.add.reduceat(by_word[owner[by_place]], place_first) / x.size - 1e-7 * weights
            move, p = np.exp(trans), np.exp(e - e.max(2, keepdims=True))
            right = m[:, 1:] / np.maximum((alpha[:, :-1] @ move) * p[:, 1:], 1e-30)  # expected transitions
            g_t = move * np.einsum("nti,ntj->ij", alpha[:, :-1], right * p[:, 1:])
            seen = np.bincount((y[:, :-1] * n_lang + y[:, 1:]).ravel(), minlength=n_lang * n_lang).reshape(n_lang, n_lang)
            g_t = (seen - g_t) / x.size
            for value, grad, mom, rate in ((weights, g_w, moments[0], 0.1), (trans, g_t, moments[1], 0.02)):
                mom[0][:] = 0.9 * mom[0] + 0.1 * grad
                mom[1][:] = 0.99 * mom[1] + 0.01 * grad**2
                value += rate * (mom[0] / (1 - 0.9**step)) / (np.sqrt(mom[1] / (1 - 0.99**step)) + 1e-8)
    table = np.zeros((HASHED + len(lexicon), n_lang), np.float32)
    table[used] = weights
    return Crf(langs, table, trans, lexicon)


class Tagger:
    def __init__(self, crf: Crf):
        self.crf, self.known = crf, Emissions(crf)

    def marginals(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For all words of all texts, in order: owner text, number of letters, language probabilities."""
        if len(self.known) > WORD_CACHE:
            self.known = Emissions(self.crf)
        words = [words_of(t) if t else [] for t in texts]
        n = np.array([len(w) for w in words])
        flat = list(chain.from_iterable(words))
        self.known.learn(list(set(flat).difference(self.known)))
        ids = np.fromiter(map(self.known.__getitem__, flat), int, len(flat))
        owner = np.repeat(np.arange(len(texts)), n)
        first = np.r_[0, n.cumsum()[:-1]]
        place = np.arange(len(ids)) - first[owner]
        chains = -(-n // CHAIN)
        at_chain = np.r_[0, chains.cumsum()[:-1]][owner] + place // CHAIN
        out = np.empty((len(ids), len(self.crf.langs)), np.float32)
        total = int(chains.sum())
        for a in range(0, total, 1024):
            lo, hi = np.searchsorted(at_chain, [a, a + 1024])
            at = (at_chain[lo:hi] - a, place[lo:hi] % CHAIN)
            count = min(1024, total - a)
            e = np.zeros((count, CHAIN, len(self.crf.langs)), np.float32)
            mask = np.zeros((count, CHAIN), bool)
            e[at] = self.known.table[ids[lo:hi]]
            mask[at] = True
            out[lo:hi] = forward_backward(e, mask, self.crf.trans.astype(np.float32))[0][at]
        return owner, self.known.letters[ids], out

    def documents(self, texts: list[str | None]) -> list[tuple[str, float, int]]:
        """(language, share of the letters expected in it, number of switches) of each text."""
        if not self.crf.langs:
            return [("und", 0.0, 0)] * len(texts)
        owner, letters, p = self.marginals(texts)
        mass = np.stack([np.bincount(owner, p[:, k] * letters, len(texts)) for k in range(p.shape[1])], 1)
        best = p.argmax(1)
        switch = np.bincount(owner[1:][(best[1:] != best[:-1]) & (owner[1:] == owner[:-1])], minlength=len(texts)) if len(owner) else np.zeros(len(texts), int)
        total = mass.sum(1)
        return [(self.crf.langs[int(m.argmax())], float(min(1.0, m.max() / s)), int(c)) if s > 0 else ("und", 0.0, 0) for m, s, c in zip(mass, total, switch, strict=True)]


FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_switches", T.IntegerType())]


def label(docs: DataFrame, crf: Crf, keep: list[str] | None = None) -> DataFrame:
    """Add lang_pred, score and n_switches (changes of language between words) to every row; no shuffle."""
    return with_columns_py(docs, "text", lambda: Tagger(crf).documents, FIELDS, keep)


def label_words(docs: DataFrame, crf: Crf, keep: list[str] | None = None) -> DataFrame:
    """Add word_langs, every word's most probable language in order, to every row."""
    def make():
        tagger = Tagger(crf)

        def of(texts):
            if not crf.langs:
                return [([],) for _ in texts]
            owner, _, p = tagger.marginals(texts)
            best = p.argmax(1)
            cuts = np.searchsorted(owner, np.arange(1, len(texts)))
            return [([crf.langs[k] for k in part],) for part in np.split(best, cuts)]

        return of

    return with_columns_py(docs, "text", make, [T.StructField("word_langs", T.ArrayType(T.StringType()))], keep)
