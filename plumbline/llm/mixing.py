"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are cut into blocks. A source of weight w has its
i-th block (from 1) released at slot floor((i - 1) / w) with the deadline
ceil(i / w); in every slot the released block of the earliest deadline goes next.
At any slot the number of blocks that a source has had differs by less than one
from weight times slots.

Weights are taken as the decimal fractions they are written as, p / Q of the total in
lowest terms, so the schedule repeats after exactly Q slots: one period of it is computed on
the driver, or the whole phase where that is shorter, and every block's slot follows
from its number by arithmetic inside Spark. Nothing is rounded, so no source
drifts from its weight. When a source runs out, a new
phase begins with the weights of those that are left, scaled up to one; there
are as many phases as sources at most. No row is dropped or repeated.

Documents within a source are taken in the order of a keyed hash of their id. The
order is computed in buckets of bounded size - a source's hash range is cut into as
many buckets as its count asks for - so that no source is sorted in one task.

Defined results: documents of a null source or one without a weight form the
source "(other)", whose weight is other_weight; null texts are rows as others are;
null or repeated ids are ordered by their hash, ties by the row's own columns; an
empty table gives an empty mix; columns named like the new ones are replaced.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from fractions import Fraction
from heapq import heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import materialize

OTHER = "(other)"
#: Documents of a block; slots in a row of the table of slots; documents of an ordering bucket.
BLOCK_DOCS, PERIOD, BUCKET_DOCS = 16, 1000, 2000


def shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """Whole slots of a given period for each source, by largest remainder, at least one each; only near the weights, so phases uses exact."""
    total = sum(weights.values())
    period = max(period, 4 * len(weights))
    exact = {s: Fraction(w) / Fraction(total) * period for s, w in weights.items()}
    got = {s: max(1, math.floor(x)) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (got[s] - exact[s], s)):
        if sum(got.values()) >= period:
            break
        got[s] += 1
    while (over := sum(got.values()) - period) > 0:
        most = max(got, key=lambda s: (got[s], s))
        got[most] -= min(over, got[most] - 1)
    return got


def exact(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in the proportion of the weights as they are written, in lowest terms; their sum is the period."""
    parts = {s: Fraction(str(w)) for s, w in weights.items()}
    least = math.lcm(*(x.denominator for x in parts.values()))
    whole = {s: int(x * least) for s, x in parts.items()}
    common = math.gcd(*whole.values())
    return {s: n // common for s, n in whole.items()}


def pattern(slots: dict[str, int], blocks: dict[str, int] | None = None) -> dict[str, list[int]]:
    """Slots of each source's blocks by earliest deadline first among what is released.

    For one period, or up to the slot with the last of a source's blocks where that comes first.
    """
    period = sum(slots.values())
    wait = [(0, s, 1) for s in sorted(slots)]  # (release, source, number): the next block of a source
    ready, out = [], {s: [] for s in slots}
    for t in range(period):
        while wait and wait[0][0] <= t:
            _, s, i = heappop(wait)
            heappush(ready, (-(-i * period // slots[s]), s, i))
        deadline, s, i = heappop(ready)
        assert deadline > t, "the weights are feasible, so no deadline passes"
        out[s].append(t)
        if blocks and i == blocks[s]:
            break
        heappush(wait, (i * period // slots[s], s, i + 1))
    return out


def phases(blocks: dict[str, int], weights: dict[str, float], period: int) -> list[dict]:
    """Phases of the schedule: first slot, period, and for each active source its first block and slots.

    Of a phase that is longer than its period one period is listed, of others every slot;
    period has no part in this: the schedule's own period is exact. mix cuts its table by it.
    """
    left = {s: n for s, n in blocks.items() if n > 0}
    out, slot, used = [], 0, dict.fromkeys(left, 0)
    while left:
        got = exact({s: weights[s] for s in left if weights[s] > 0} or dict.fromkeys(left, 1))  # sources of weight zero come last
        at, q = pattern(got, left), sum(got.values())
        if (length := sum(map(len, at.values()))) == q:
            ends = {s: (left[s] - 1) // n * q + at[s][(left[s] - 1) % n] for s, n in got.items()}
            length = min(ends.values()) + 1
        took = {s: length // q * got[s] + bisect_left(at[s], length % q) for s in got}
        out.append({"slot": slot, "period": q, "sources": {s: {"first": used[s], "took": took[s], "at": at[s]} for s in got}})
        slot += length
        for s, n in took.items():
            used[s] += n
            left[s] -= n
        left = {s: n for s, n in left.items() if n > 0}
    return out


def mix(docs: DataFrame, weights: dict[str, float], other_weight: float = 0.01, block_docs: int = BLOCK_DOCS, period: int = PERIOD, bucket_docs: int = BUCKET_DOCS, seed: int = 17) -> DataFrame:
    """docs with mix_source, block (number within the source), slot and position (dense, from 0) of every row."""
    spark = docs.sparkSession
    docs = docs.select(*[c for c in docs.columns if c not in ("mix_source", "block", "slot", "position")])
    names = F.array(*[F.lit(s) for s in weights]) if weights else F.array(F.lit(OTHER))
    rows = docs.withColumn("mix_source", F.when(F.array_contains(names, F.col("source").cast("string")), F.col("source").cast("string")).otherwise(OTHER))
    rows = rows.withColumn("__h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 33))
    counts = {r.mix_source: r.n for r in rows.groupBy("mix_source").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each weight at most
    if not counts:
        return rows.select(*docs.columns, "mix_source", *[F.lit(None).cast("long").alias(c) for c in ("block", "slot", "position")])
    all_weights = {**weights, OTHER: other_weight}
    plan = phases({s: -(-n // block_docs) for s, n in counts.items()}, all_weights, period)
    parts = F.create_map(*[x for s, n in counts.items() for x in (F.lit(s), F.lit(-(-n // bucket_docs)))])
    rows = rows.withColumn("__bucket", F.floor(F.col("__h") * parts[F.col("mix_source")] / F.lit(1 << 31)).cast("long"))
    return _place(spark, rows, docs, counts, plan, block_docs, period)


def _place(spark, rows: DataFrame, docs: DataFrame, counts: dict[str, int], plan: list[dict], block_docs: int, cut: int) -> DataFrame:
    from pyspark.sql import Window

    key = ["mix_source", "__bucket"]
    sizes = materialize(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")))
    # first row number of each bucket: summed over groups of 1000 buckets first, so that no window holds them all
    sizes = sizes.withColumn("__far", F.floor(F.col("__bucket") / 1000))
    far = sizes.groupBy("mix_source", "__far").agg(F.sum("n").alias("m"))
    below = F.sum("m").over(Window.partitionBy("mix_source").orderBy("__far").rowsBetween(Window.unboundedPreceding, -1))
    far = far.select("mix_source", "__far", F.coalesce(below, F.lit(0)).alias("base"))
    near = F.sum("n").over(Window.partitionBy("mix_source", "__far").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    firsts = sizes.withColumn("near", F.coalesce(near, F.lit(0))).join(far, ["mix_source", "__far"]).select(*key, (F.col("base") + F.col("near")).alias("__first"))
    plain = [c for c in docs.columns if c != "doc_id" and not docs.schema[c].dataType.typeName().startswith(("map", "variant"))]
    order = Window.partitionBy(*key).orderBy("__h", "doc_id", *plain)
    rows = rows.withColumn("__rank", F.row_number().over(order) - 1).join(firsts, key)
    number = F.col("__first") + F.col("__rank")
    rows = rows.withColumn("block", F.floor(number / block_docs)).withColumn("__in", number % block_docs)
    once = lambda x: range(0, x["took"], cut) if x["took"] == len(x["at"]) else [0]
    steps = spark.createDataFrame(
        [(s, x["first"] + i, x["first"] + (min(i + cut, x["took"]) if len(once(x)) > 1 else x["took"]), p["slot"], p["period"], x["at"][i : i + cut] if len(once(x)) > 1 else x["at"]) for p in plan for s, x in p["sources"].items() if x["took"] for i in once(x)],
        "mix_source string, first long, beyond long, start long, period long, at array<long>",
    )  # at most a period's slots for each phase, and no more than there are blocks
    near_phase = (F.col("r.mix_source") == F.col("s.mix_source")) & (F.col("block") >= F.col("first")) & (F.col("block") < F.col("beyond"))
    mine = F.col("block") - F.col("first")
    slot = F.col("start") + F.floor(mine / F.size("at")) * F.col("period") + F.element_at("at", (mine % F.size("at") + 1).cast("int"))
    rows = rows.alias("r").join(F.broadcast(steps).alias("s"), near_phase).select(*[F.col(f"r.{c}") for c in [*docs.columns, "mix_source", "block", "__in"]], slot.alias("slot"))
    return rows.withColumn("position", F.col("slot") * block_docs + F.col("__in") - _missing(plan, counts, block_docs)).drop("__in")


def _missing(plan: list[dict], counts: dict[str, int], block_docs: int):
    """Documents that the short last blocks of sources in earlier slots lack."""
    short = []
    for s, n in counts.items():
        if gap := -n % block_docs:
            p = next(p for p in reversed(plan) if s in p["sources"] and p["sources"][s]["took"])
            x = p["sources"][s]
            last = x["took"] - 1
            short.append((p["slot"] + last // len(x["at"]) * p["period"] + x["at"][last % len(x["at"])], gap))
    total = F.lit(0)
    for at, gap in short:
        total = total + F.when(F.col("slot") > at, gap).otherwise(0)
    return total
