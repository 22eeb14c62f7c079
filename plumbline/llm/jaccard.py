"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of word 5-grams (shorter texts: one gram of all their
words). Which pairs reach a Jaccard similarity of 0.8?

1. One Python pass hashes each text: a fingerprint of its gram set, a MinHash
   signature and band keys. Documents of one gram set are a class; its least
   id stands for it. Only such representatives go on.
2. Representatives that share a band key are candidates. Their MinHash values
   are compared a few at a time; a pair is dropped as soon as the posterior
   probability (uniform prior, binomial matches) of reaching the threshold is
   below the tolerance. First each row of a bucket is compared with the bucket's
   least one; what survives is labelled, and then only rows of different
   labels are compared, so a bucket of copies makes one edge a row.
3. The labels are candidate groups. In each the pairs are pruned in the same
   way, and those that survive are verified exactly on the gram sets.

A group of any size is cut into blocks of bounded rows and grams. First each block is
compared with itself, which labels its rows; then the blocks are paired. What leaves a
task is a link count for each row and edges between different labels, never the pairs.

Defined results: null or empty texts have no gram, a class of their own and no
link; rows repeated whole count once; rows with a null id are returned with
null class and group and no link; one id with several texts is one node that
has the links of all of them. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import WordHashes, ascii_words, components, ids_join, materialize, mix, rolling, with_columns_py

BANDS, ROWS = 24, 5
STEP = 24  # MinHash values compared between two looks at the posterior
BLOCK, BLOCK_GRAMS = 512, 300_000  # rows and grams of a block
PORTION = 1 << 15  # grams whose MinHash values are computed at a time
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def gram_hashes(text: str | None, words: WordHashes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-grams; of all the words when there are fewer than k."""
    h = words.of(ascii_words(text))
    return np.unique(rolling(h, min(k, len(h)))) if len(h) else np.empty(0, np.uint64)


def least_matches(threshold: float, tolerance: float, n_max: int) -> np.ndarray:
    """least[n]: fewest matches of n at which the posterior P(J >= threshold) is at least the tolerance.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), and its
    upper tail at t equals P(Binomial(n + 1, t) <= m). Signatures keep
    8 bits of a value, so t counts the accidental matches too.
    """
    t = threshold + (1 - threshold) / 256
    out = np.zeros(n_max + 1, int)
    for n in range(1, n_max + 1):
        total, m = 0.0, 0
        for m in range(n + 1):
            total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total >= tolerance:
                break
        out[n] = m
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values (a row for each set, none may be empty), computed for many short sets at a time."""
    out = np.empty((len(sets), len(_SEEDS)), np.uint64)
    sizes = np.fromiter(map(len, sets), int, len(sets))
    ends = sizes.cumsum()
    a = 0
    while a < len(sets):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PORTION, "right")))
        g = np.concatenate(sets[a:b])
        starts = np.r_[0, sizes[a : b - 1].cumsum()]
        h = np.empty_like(g)
        for i, s in enumerate(_SEEDS):
            np.bitwise_xor(g, s, out=h)
            np.multiply(h, s, out=h)
            out[a:b, i] = np.minimum.reduceat(h, starts)
        a = b
    return mix(out)


def low_bytes(values: np.ndarray) -> np.ndarray:
    return (values & np.uint64(255)).astype(np.uint8)


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, fp_hi, fp_lo, n_grams, sig (a byte for each MinHash value), bands."""
    fields = [T.StructField("fp_hi", T.LongType()), T.StructField("fp_lo", T.LongType()), T.StructField("n_grams", T.IntegerType()), T.StructField("sig", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]

    def make():
        words = WordHashes()

        def all_of(texts):
            sets = [gram_hashes(t, words, k) for t in texts]
            low = signatures([g for g in sets if len(g)])
            sig, keys = low_bytes(low), band_keys(low).view(np.int64)
            rows, at = [], 0
            for g in sets:
                if len(g):
                    rows.append((int(mix(g).sum().view(np.int64)), int(np.bitwise_xor.reduce(mix(g * _SEEDS[1])).view(np.int64)), len(g), sig[at].tobytes(), keys[at].tolist()))
                    at += 1
                else:
                    rows.append((None, None, 0, None, None))
            return rows

        return all_of

    return with_columns_py(docs.select("doc_id", "text"), "text", make, fields, ["doc_id"])


def band_keys(low: np.ndarray) -> np.ndarray:
    """One key for each band of ROWS values of every row; the band's number is part of it."""
    bands = low.reshape(len(low), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _SEEDS[0], (len(low), BANDS)).copy()
    for i in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + bands[..., i])
    return out


def sorted_groups(batches: Iterator[pd.DataFrame], keys: list[str], most_rows: int = 4096) -> Iterator[pd.DataFrame]:
    """Regroup batches of a partition sorted by keys so that no group is cut; small groups stay together."""
    kept: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        last = batch[keys].iloc[-1].tolist()
        same = (batch[keys] == last).all(axis=1).to_numpy()
        cut = len(batch) - int(same[::-1].cumprod().sum())
        if cut == 0:
            if kept and kept[-1][keys].iloc[-1].tolist() != last:
                yield pd.concat(kept)
                kept = []
            kept.append(batch)
            continue
        yield pd.concat([*kept, batch.iloc[:cut]])
        kept = [batch.iloc[cut:]]
    if kept:
        yield pd.concat(kept)


def surviving(sig_a: np.ndarray, sig_b: np.ndarray, i: np.ndarray, j: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) of rows of two tables of signatures that no look at the posterior drops."""
    same = np.zeros(len(i), int)
    for a in range(0, BANDS * ROWS, STEP):
        same += (sig_a[i, a : a + STEP] == sig_b[j, a : a + STEP]).sum(1)
        keep = same >= least[a + STEP]
        i, j, same = i[keep], j[keep], same[keep]
    return i, j


def signature_table(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)


def local_components(n: int, i: np.ndarray, j: np.ndarray, node: np.ndarray) -> np.ndarray:
    """For each row the least node that its links lead to."""
    label = node.copy()
    while True:
        old = label.copy()
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        if (label == old).all():
            return label


def leader_edges(reps: DataFrame, asked: DataFrame, least: np.ndarray) -> DataFrame:
    """Edges (u, v) of the rows asked (node, leader) whose pair survives the pruning."""
    def run(batches):
        for g in batches:
            n = np.arange(len(g))
            i, _ = surviving(signature_table(g["sig"]), signature_table(g["leader_sig"]), n, n, least)
            yield pd.DataFrame({"u": g["node"].to_numpy()[i], "v": g["leader"].to_numpy()[i]})

    sigs = reps.select("node", "sig")
    both = asked.join(sigs, "node").join(sigs.select(F.col("node").alias("leader"), F.col("sig").alias("leader_sig")), "leader")
    return both.select("node", "leader", "sig", "leader_sig").mapInPandas(run, "u long, v long")


def label_edges(reps: DataFrame, rows: DataFrame, least: np.ndarray) -> DataFrame:
    """Edges (u, v) between labels of rows (bucket, node, label) of which a pair in one bucket survives.

    Rows that have the label of the bucket's least row are compared with the others only.
    """
    main = materialize(rows.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min_by("label", "node").alias("main")).where("lo <> hi").select("bucket", "main"))
    rows = materialize(rows.join(main, "bucket").select("bucket", "node", "label", (F.col("label") == F.col("main")).alias("own")))
    sizes = materialize(rows.groupBy("bucket").agg(F.ceil(F.count_if("own") / BLOCK).cast("int").alias("n_own"), F.ceil(F.count_if(~F.col("own")) / BLOCK).cast("int").alias("n_out")))
    rows = rows.join(sizes, "bucket").withColumn("h", F.xxhash64("node", "bucket"))
    block = F.when(F.col("own"), F.col("n_out") + F.pmod("h", "n_own")).otherwise(F.pmod("h", "n_out")).cast("int")
    others = F.sequence(F.lit(0), F.col("n_out") + F.when(F.col("own"), 0).otherwise(F.col("n_own")) - 1)
    rows = rows.withColumn("block", block).withColumn("other", F.explode(others)).withColumns({"p": F.least("block", "other"), "q": F.greatest("block", "other")})
    rows = rows.join(reps.select("node", "sig"), "node").select("bucket", "p", "q", "block", "node", "label", "sig")

    def run(batches):
        for part in sorted_groups(batches, ["bucket", "p", "q"]):
            sig = signature_table(part["sig"])
            label, block, p, q = (part[c].to_numpy() for c in ("label", "block", "p", "q"))
            left, right = [], []
            cuts = group_cuts(part, ["bucket", "p", "q"])
            for a, b in zip(cuts, cuts[1:], strict=False):
                x, y = np.flatnonzero(block[a:b] == p[a]) + a, np.flatnonzero(block[a:b] == q[a]) + a
                i, j = np.repeat(x, len(y)), np.tile(y, len(x))
                keep = label[i] < label[j] if p[a] == q[a] else label[i] != label[j]
                i, j = surviving(sig, sig, i[keep], j[keep], least)
                left.append(i)
                right.append(j)
            i, j = np.concatenate(left), np.concatenate(right)
            yield spanning(label[i], label[j])

    return rows.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q").mapInPandas(run, "u long, v long")


def group_cuts(part: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Where groups of sorted rows begin, and the end."""
    k = part[keys].to_numpy()
    return np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(1), True]) if len(k) else np.zeros(1, int)


def spanning(u: np.ndarray, v: np.ndarray) -> pd.DataFrame:
    """Edges (u, v) that connect what the given ones do: each node with the least it leads to."""
    nodes, at = np.unique(np.r_[u, v], return_inverse=True)
    label = local_components(len(nodes), at[: len(u)], at[len(u) :], nodes)
    moved = label != nodes
    return pd.DataFrame({"u": nodes[moved], "v": label[moved]})


def candidate_groups(reps: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """node, comp: representatives that chains of surviving pairs connect; none for a row without such a pair."""
    least = least_matches(threshold, tolerance, BANDS * ROWS)
    rows = reps.select("node", F.explode("bands").alias("bucket"))
    full = materialize(rows.groupBy("bucket").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader <> last").drop("last"))
    rows = materialize(rows.join(full, "bucket"))
    star = components(leader_edges(reps, materialize(rows.where("node <> leader").select("node", "leader").distinct()), least))
    labelled = rows.select("bucket", "node").join(star, "node", "left").select("bucket", "node", F.coalesce("comp", "node").alias("label"))
    edges = materialize(label_edges(reps, materialize(labelled.distinct()), least))
    return relabel(star, edges)


def relabel(star: DataFrame, edges: DataFrame) -> DataFrame:
    """node, comp of star after its labels are merged along the edges (u, v) between labels."""
    if edges.isEmpty():
        return star
    merged = components(edges)
    rows = star.union(merged.select("node", F.col("node").alias("comp"))).distinct()
    return rows.join(merged.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").groupBy("node").agg(F.min(F.coalesce("to", "comp")).alias("comp"))


def overlaps(a: list[np.ndarray], b: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of each set of a with each of b."""
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(np.unique(flat_a), np.unique(flat_b), assume_unique=True)  # other grams count for no pair
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(shared):
        return out.astype(int)
    places = []
    for flat, sets in ((flat_a, a), (flat_b, b)):
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        col = np.searchsorted(shared, flat)
        col[col == len(shared)] = 0
        keep = shared[col] == flat
        col, owner = col[keep], owner[keep]
        order = np.argsort(col, kind="stable")
        places.append((col[order], owner[order], len(sets)))
    for at in range(0, len(shared), width):  # a bounded dense matrix at a time
        dense = []
        for col, owner, n in places:
            lo, hi = np.searchsorted(col, [at, at + width])
            m = np.zeros((n, min(width, len(shared) - at)), np.float32)
            m[owner[lo:hi], col[lo:hi] - at] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out.astype(int)


def verified(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs (i, j) reach the threshold exactly."""
    x, xi = np.unique(i, return_inverse=True)
    y, yj = np.unique(j, return_inverse=True)
    if len(i) > 4 * (len(x) + len(y)):
        both = overlaps([sets[n] for n in x], [sets[n] for n in y])[xi, yj]
    else:
        both = np.fromiter((len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)), int, len(i))
    size = np.fromiter(map(len, sets), int, len(sets))
    return both >= threshold * (size[i] + size[j] - both) - 1e-9


def exact_links(docs: DataFrame, members: DataFrame, k: int, threshold: float, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """Of members (node, comp, copies, grams: how many): rows (node, links), how many documents exact links reach; and (node, comp), the groups of exact links."""
    least = least_matches(threshold, tolerance, BANDS * ROWS)

    def make():
        words = WordHashes()

        def all_of(texts):
            sets = [gram_hashes(t, words, k) for t in texts]
            sig = iter(low_bytes(signatures([g for g in sets if len(g)])))
            return [(g.tobytes(), next(sig).tobytes() if len(g) else None) for g in sets]

        return all_of

    texts = ids_join(docs.where("doc_id is not null").select("doc_id", "text"), members.select(F.col("node").alias("doc_id")), "doc_id")
    sets = with_columns_py(texts, "text", make, [T.StructField("grams", T.BinaryType()), T.StructField("sig", T.BinaryType())], ["doc_id"]).withColumnRenamed("doc_id", "node").where("sig is not null")
    sizes = materialize(members.groupBy("comp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("grams") / BLOCK_GRAMS)).cast("int").alias("blocks")))
    rows = members.drop("grams").join(sizes, "comp").withColumn("block", F.pmod(F.xxhash64("node", "comp"), "blocks").cast("int"))
    sets = materialize(rows.join(sets, "node").select("comp", "blocks", "block", "node", "copies", "sig", "grams"))

    def run(batches):
        for part in sorted_groups(batches, ["comp", "p", "q"]):
            cuts = group_cuts(part, ["comp", "p", "q"])
            for a, b in zip(cuts, cuts[1:], strict=False):
                g = part.iloc[a:b].drop_duplicates(["node", "grams"])
                node, block, copies, label = (g[c].to_numpy() for c in ("node", "block", "copies", "label"))
                p, q = g["p"].iloc[0], g["q"].iloc[0]
                x, y = np.flatnonzero(block == p), np.flatnonzero(block == q)
                i, j = np.repeat(x, len(y)), np.tile(y, len(x))
                keep = (node[i] != node[j]) & (i < j if p == q else True)
                sig = signature_table(g["sig"])
                i, j = surviving(sig, sig, i[keep], j[keep], least)
                if len(i):
                    good = verified([np.frombuffer(x, np.uint64) for x in g["grams"]], i, j, threshold)
                    i, j = i[good], j[good]
                links = np.zeros(len(g), np.int64)
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                yield pd.DataFrame({"node": node, "links": links, "u": None, "v": None}).astype(kinds)
                yield spanning(label[i], label[j]).assign(node=None, links=None)[["node", "links", "u", "v"]].astype(kinds)

    kinds = dict.fromkeys(("node", "links", "u", "v"), "Int64")

    def compare(rows: DataFrame) -> DataFrame:
        rows = rows.repartition("comp", "p", "q").sortWithinPartitions("comp", "p", "q").select("comp", "p", "q", "block", "node", "copies", "label", "sig", "grams")
        return materialize(rows.mapInPandas(run, "node long, links long, u long, v long"))

    inside = compare(sets.withColumns({"p": F.col("block"), "q": F.col("block"), "label": F.col("node")}))
    star = inside.where("u is not null").select(F.col("u").alias("node"), F.col("v").alias("comp"))
    star = materialize(star.union(star.select("comp", "comp")).distinct())
    large = sets.where("blocks > 1").join(star.withColumnRenamed("comp", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other <> block")
    across = compare(large.withColumns({"p": F.least("block", "other"), "q": F.greatest("block", "other")}))
    links = inside.union(across).where("node is not null").select("node", "links")
    return links, relabel(star, across.where("u is not null").select("u", "v"))


def jaccard_join(docs: DataFrame, k: int = 5, threshold: float = 0.8, tolerance: float = 1e-6) -> DataFrame:
    """doc_id, class_id, group_id, n_links for every document of docs (doc_id, text).

    class_id: least id with the same gram set. n_links: other documents, copies
    included, at or above the threshold. group_id: least id of all documents
    that chains of links reach.
    """
    docs = docs.select("doc_id", "text")
    sketches = materialize(sketch(docs, k))
    narrow = materialize(sketches.where("doc_id is not null and n_grams > 0").select("doc_id", "fp_hi", "fp_lo", "n_grams").distinct())
    fp = ["fp_hi", "fp_lo", "n_grams"]
    classes = materialize(narrow.groupBy(*fp).agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies")))
    member = materialize(narrow.join(classes, fp))
    heads = member.where("doc_id = node")
    reps = heads.select("doc_id", *fp, "node").join(sketches.select("doc_id", *fp, "sig", "bands"), ["doc_id", *fp]).select("node", "sig", "bands").dropDuplicates(["node", "bands"])
    reps = materialize(reps)
    weights = materialize(heads.groupBy("node").agg(F.sum("copies").alias("copies"), F.sum("n_grams").alias("grams")))
    members = materialize(candidate_groups(reps, threshold, tolerance).join(weights, "node"))
    links, groups = exact_links(docs, members, k, threshold, tolerance)
    totals = links.groupBy("node").agg(F.sum("links").alias("links"))
    per_class = materialize(weights.join(totals, "node", "left").join(groups, "node", "left").select("node", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("comp", "node").alias("group_id")))
    found = member.join(per_class, "node").groupBy("doc_id").agg(F.min("node").alias("class_id"), F.min("group_id").alias("group_id"), F.sum(F.col("copies") - 1 + F.col("links")).alias("n_links"))
    bare = sketches.where("doc_id is null or n_grams = 0").select("doc_id").distinct().join(narrow.select("doc_id").distinct(), "doc_id", "left_anti")
    bare = bare.select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("group_id"), F.lit(0).cast("long").alias("n_links"))
    return found.unionByName(bare)


def keep_one_per_group(docs: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of docs whose id is its group's least, and rows with a null id.

    Of several rows of a kept id the one with the least hash of its text stays.
    """
    found = jaccard_join(docs, k, threshold)
    kept = ids_join(docs, materialize(found.where("doc_id <> group_id").select("doc_id")), "doc_id", "left_anti")
    often = materialize(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if often.isEmpty():
        return kept
    one = ids_join(kept, often, "doc_id").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.xxhash64("text")).alias("r")).select("r.*")
    return ids_join(kept, often, "doc_id", "left_anti").union(one)
