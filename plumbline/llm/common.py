"""Helpers that the text operators share: lineage cuts, Arrow passes, word hashes, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that one inner step of a Python pass holds as Python objects at a time.
SLICE_ROWS = 256
#: Distinct words a worker remembers before it starts over; bounds its memory.
WORD_CACHE = 300_000
#: Rows of a range partition of running().
PART_ROWS = 100_000
#: Largest id set, in rows, that is sent to every executor; more are shuffled.
BROADCAST_IDS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share. Only where none is named, and Spark runs on this machine alone (tests), is one made."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf
    hadoop = spark.sparkContext._jsc.sc().getCheckpointDir()
    if hadoop.isDefined():
        return hadoop.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plumbline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bucket(id_col: Column, n: int) -> Column:
    """crc32 of the id's text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % n


def with_columns_py(df: DataFrame, text_col: str, make: Callable[[], Callable[[list], list[tuple]]], fields: list[T.StructField], keep: list[str] | None = None) -> DataFrame:
    """Add columns computed from one text column, batch by batch.

    make() runs once per task and returns a function from a list of texts to
    a list of tuples, one per text. Rows stay where they are: no shuffle.
    Columns named like the new ones are replaced.
    """
    new = {f.name for f in fields}
    keep = [c for c in (df.columns if keep is None else keep) if c not in new]
    src = df.select(*keep, F.col(text_col).alias("__text")) if text_col not in keep else df.select(*keep)
    at = "__text" if text_col not in keep else text_col
    schema = T.StructType([df.schema[c] for c in keep] + fields)
    arrow = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for batch in batches:
            rows: list[tuple] = []
            texts = batch.column(batch.schema.get_field_index(at))
            for i in range(0, batch.num_rows, SLICE_ROWS):
                rows += score(texts.slice(i, SLICE_ROWS).to_pylist())
            cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            cols += [pa.array([r[j] for r in rows], type=f.type) for j, f in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *arrow.names])

    return src.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([pa.field(f.name, _arrow(f.dataType)) for f in kind.fields])
    return {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}[{"bigint": "long"}.get(kind.simpleString(), kind.simpleString())]


class WordHashes(dict):
    """64-bit hash of a word (bytes), the same in every process; remembers a bounded number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def ascii_words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ as UTF-8; null has none."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k word hashes; fewer than k words make no run."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return mix(out)


def running(df: DataFrame, order: list[Column], amount: Column, rows: int, before: str) -> DataFrame:
    """df with the sum of amount over all rows that come earlier in a total order; written to the shared folder.

    Rows are dealt into range partitions; one sum of each goes through the driver (rows / PART_ROWS of them).
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART_ROWS))
    dealt = materialize(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    at, offsets = 0, []
    for r in dealt.groupBy("__part").agg(F.sum(amount).alias("n")).orderBy("__part").collect():
        offsets.append((r["__part"], at))
        at += r.n
    inside = F.sum(amount).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    firsts = spark.createDataFrame(offsets, "__part int, __first long")
    out = dealt.withColumn("__inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(firsts), "__part")
    return materialize(out.withColumn(before, F.col("__first") + F.col("__inside")).drop("__part", "__first", "__inside"))


def ids_join(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Join on an id set: broadcast when its counted size is under BROADCAST_IDS, else by shuffle."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, how)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (u, v): rows (node, comp), comp the least node of each.

    Min-label propagation with pointer jumping; every round is written to the
    shared folder. No node's neighbours are ever gathered in one place: the
    minimum is combined before the shuffle.
    """
    both = materialize(edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))).where("u <> v").distinct())
    label = materialize(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("comp")))
    if label.isEmpty():
        return label
    for _ in range(max_rounds):
        near = both.join(label, both.v == label.node).groupBy("u").agg(F.min("comp").alias("near"))
        step = label.join(near, label.node == near.u).select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("old"))
        up = label.select(F.col("node").alias("via"), F.col("comp").alias("above"))
        step = materialize(step.join(up, step.comp == up.via, "left").select("node", F.least("comp", F.coalesce("above", "comp")).alias("comp"), "old"))
        if step.where("comp <> old").isEmpty():
            return step.select("node", "comp")
        label = step.select("node", "comp")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
