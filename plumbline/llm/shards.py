"""Sharding by a minimax contiguous partition.

Documents of equal text form a group, which no cut divides. Groups lie one after another in
the order of their least doc_id, and shards are contiguous pieces of that line. The
smallest capacity that fits all groups into the given number of shards is found by
binary search; each try fills shards greedily. Then the line is cut: each cut is
put at the place between groups that is nearest to its even place, as far as that
leaves every shard within the capacity (the greedy cuts from either end bound it), so no
shard is larger than the minimax size and the others are near the mean.

The groups stay in Spark. A group's place is the running sum of sizes before it, made of sums
inside range partitions and the offsets of those. The driver holds places only as bins:
equal spans of the line with their first and last place. Greedy fills on bins give bounds for every cut; bins
that lie between the bounds of a cut are split, SPLIT_BITS at a time, until all cuts
are exact. So each of a few rounds reads the groups once and sends back BINS bins at most.

Slots number a shard's rows in the order of groups and ids.

Defined results: a null text counts as an empty one, of size 8 and crc32 0; rows of one id or
repeated rows each have their own slot; groups of null ids only come first; ties of the
least id go by the text's hash; an empty table gives an empty table; shards may stay empty
(fewer groups than shards, or one group larger than several shares); columns named like the new ones are replaced.
Groups are told apart by two hashes and the size: texts that agree in all of these would share a shard, no more.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import materialize, running

#: Bins of the first round and bits by which later rounds split one, at most; bins of a round at most.
FIRST_BITS, SPLIT_BITS, BINS = 12, 6, 1 << 15
#: A group of more rows than SHARE of all is joined by broadcast: there are 1 / SHARE of them at most.
SHARE = 1 / 1000
#: Bytes that a row counts besides its text.
ROW_BYTES = 8

NEW = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


class Places:
    """What the driver knows of the places where cuts may lie: known ones, and spans between two of them that hold others."""

    def __init__(self, total: int) -> None:
        self.total, self.bins, self.bits = total, {}, {}
        self._sort()

    def put(self, bits: int, bins: list[tuple[int, int, int, int]]) -> None:
        """Bins (number at a width of 2 ** bits, first place, last place, places)."""
        for number, first, last, n in bins:
            self.bins[first] = (last, n <= 2 or first == last)
            self.bits[first] = (bits, number)
        self._sort()

    def drop(self, first: int) -> None:
        del self.bins[first], self.bits[first]

    def _sort(self) -> None:
        self.firsts = sorted(self.bins)
        self.known = sorted({0, self.total, *self.bins, *(last for last, _ in self.bins.values())})

    def _open(self, x: int) -> int | None:
        """The first place of the span around x that holds unknown places."""
        at = bisect_right(self.firsts, x) - 1
        if at >= 0 and not (b := self.bins[self.firsts[at]])[1] and self.firsts[at] < x < b[0]:
            return self.firsts[at]
        return None

    def floor(self, lo: int, hi: int) -> tuple[int, int]:
        """Bounds of the largest place up to x, for x between lo and hi."""
        top = min(hi, self.total)
        return self.known[bisect_right(self.known, min(lo, self.total)) - 1], top if self._open(top) is not None else self.known[bisect_right(self.known, top) - 1]

    def ceil(self, lo: int, hi: int) -> tuple[int, int]:
        """Bounds of the least place from x on, for x between lo and hi."""
        low = max(lo, 0)
        return low if self._open(low) is not None else self.known[bisect_left(self.known, low)], self.known[bisect_left(self.known, max(hi, 0))]

    def between(self, lo: int, hi: int) -> set[int]:
        """Spans with unknown places that meet [lo, hi]."""
        out = set()
        for at in range(max(bisect_right(self.firsts, lo) - 1, 0), bisect_right(self.firsts, hi)):
            first = self.firsts[at]
            last, closed = self.bins[first]
            if not closed and last > lo and first < hi:
                out.add(first)
        return out


def fits(places: Places, capacity: int, shards: int, surely: bool) -> bool:
    """Does the greedy fill reach the end? By known places only (surely), or with every unknown place where it would help most."""
    at = 0
    for _ in range(shards):
        if at + capacity >= places.total:
            return True
        at = places.floor(at + capacity, at + capacity)[0 if surely else 1]
    return False


def least(low: int, high: int, good) -> int:
    """The smallest number from low to high that is good, if high is."""
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if good(mid) else (mid + 1, high)
    return low


def plan(places: Places, shards: int, largest: int) -> tuple[int, list[int], set[int]]:
    """Capacity, cuts, and the spans that must be split before these are exact (none: they are)."""
    total = places.total
    bottom = max(largest, -(-total // shards))
    high = least(bottom, total, lambda c: fits(places, c, shards, True))
    low = least(bottom, high, lambda c: fits(places, c, shards, False))
    wanted: set[int] = set()
    if low < high:
        a = b = 0
        for _ in range(shards):
            wanted |= places.between(a + low, min(b + high, total))
            a, b = places.floor(a + low, a + low)[0], places.floor(b + high, b + high)[1]
        if wanted:
            return high, [], wanted
    back = [(total, total)]  # earliest cuts, from the end
    for _ in range(shards - 1):
        x = (back[-1][0] - high, back[-1][1] - high)
        wanted |= places.between(*x)
        back.append(places.ceil(*x))
    cuts: list[tuple[int, int]] = [(0, 0)]
    for k in range(1, shards):
        even = k * total // shards
        below, above = places.floor(even, even), places.ceil(even, even)
        wanted |= places.between(even, even)
        near = below if even - below[0] <= above[1] - even else above
        x = (cuts[-1][0] + high, cuts[-1][1] + high)
        wanted |= places.between(*x)
        far, early = places.floor(*x), back[shards - k]
        cuts.append(tuple(min(max(near[i], early[i]), far[i]) for i in (0, 1)))
    return high, [a for a, _ in cuts[1:]], wanted


def minimax(groups: DataFrame, shards: int, total: int, largest: int, place: str = "place") -> tuple[int, list[int]]:
    """Smallest capacity and the cuts, by rounds over groups that have a place each."""
    places = Places(total)
    bits = max(0, total.bit_length() - FIRST_BITS)
    found = _bins(groups, place, bits).collect()
    places.put(bits, [tuple(r) for r in found])
    while True:
        capacity, cuts, wanted = plan(places, shards, largest)
        if not wanted:
            return capacity, cuts
        coarsest = max(places.bits[x][0] for x in wanted)
        now = sorted(x for x in wanted if places.bits[x][0] == coarsest)
        now = now[:BINS]
        fewer = max(0, coarsest - max(1, min(SPLIT_BITS, (BINS // len(now)).bit_length() - 1)))
        numbers = [places.bits[x][1] for x in now]
        rows = _bins(groups.where(F.shiftright(place, coarsest).isin(numbers)), place, fewer).collect()
        for x in now:
            places.drop(x)
        places.put(fewer, [tuple(r) for r in rows])


def _bins(groups: DataFrame, place: str, bits: int) -> DataFrame:
    return groups.groupBy(F.shiftright(place, bits).alias("bin")).agg(F.min(place), F.max(place), F.count(F.lit(1)))


def shard(docs: DataFrame, shards: int = 24, keep: list[str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs (or the columns in keep) with size, text_crc32, law ("bytes"), shard, slot (from 0 in each shard) and grown_shard (null: another number of shards moves rows)."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in NEW]
    plain = F.coalesce(F.col(text).cast("string"), F.lit(""))
    key = ["__hash", "text_crc32", "size"]
    rows = docs.select(*keep, F.col(doc_id).alias("__id"), (F.octet_length(plain) + ROW_BYTES).cast("long").alias("size"), F.crc32(plain.cast("binary")).alias("text_crc32"), F.xxhash64(plain).alias("__hash"), F.monotonically_increasing_id().alias("__row"))
    rows = materialize(rows)
    groups = materialize(rows.groupBy(*key).agg(F.min("__id").alias("__least"), F.count(F.lit(1)).alias("__n")))
    whole = groups.agg(F.count(F.lit(1)).alias("groups"), F.sum("__n").alias("rows"), F.sum(F.col("size") * F.col("__n")).alias("total"), F.max(F.col("size") * F.col("__n")).alias("largest")).first()
    if not whole.groups:
        return rows.select(*keep, "size", "text_crc32", *[F.lit(None).cast(t).alias(c) for c, t in (("law", "string"), ("shard", "int"), ("slot", "long"), ("grown_shard", "int"))])
    order = [F.asc_nulls_first("__least"), *[F.col(c) for c in key]]
    placed = running(groups, order, F.col("size") * F.col("__n"), whole.groups, "__place")
    _, cuts = minimax(placed, shards, whole.total, whole.largest, "__place")
    number = reduce(lambda n, cut: n + (F.col("__place") >= cut).cast("int"), cuts, F.lit(0))
    placed = placed.select(*key, "__place", "__n", number.alias("shard"))
    sizes = {r.shard: r.n for r in placed.groupBy("shard").agg(F.sum("__n").alias("n")).collect()}
    hot = F.col("__n") > max(1, int(whole.rows * SHARE))
    large = materialize(placed.where(hot).drop("__n"))  # 1 / SHARE rows at most
    apart = rows.join(F.broadcast(large.select(*key, F.lit(True).alias("__large"))), key, "left")
    joined = rows.join(F.broadcast(large), key).unionByName(apart.where("__large is null").drop("__large").join(placed.where(~hot).drop("__n"), key))
    out = running(joined, [F.col("__place"), F.asc_nulls_first("__id"), F.col("__row")], F.lit(1), whole.rows, "__at")
    firsts = F.create_map(*[x for s in range(shards) for x in (F.lit(s), F.lit(sum(n for t, n in sizes.items() if t < s)))])
    return out.select(*keep, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("__at") - firsts[F.col("shard")]).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write each shard into a folder of its own, shard=N, rows of a file in the order of their slots. No shard goes through one task: shards are dealt by slots too."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("errorifexists").parquet(path)
