"""Event log operators, as batch frames and as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.functions import constants as K
from plumbline.operators import summary, views
from plumbline.schemas import schema
from plumbline.sources.versions import Store

TYPES = ["run_started", "run_completed", "stage_started", "stage_finished", "site_started", "site_stage", "site_finished", "site_failed", "run_progress", "log"]
METRICS = ["statements", "chunks", "blocks", "tokens_in", "tokens_out"]


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Append-only JSON lines as a stream."""
    return spark.readStream.schema(schema("event")).json(path)


def normalize(raw: DataFrame) -> DataFrame:
    """Envelope of (channel, timestamp, payload JSON): run, site, phase, message and metrics inferred; rows without channel or timestamp dropped."""
    p = lambda *keys: F.coalesce(*[F.nullif(F.trim(F.get_json_object("payload", f"$.{k}")), F.lit("")) for k in keys])
    ends = lambda s: F.endswith("channel", F.lit(s))
    phase = F.coalesce(p("phase"), F.when(ends(":start"), "start").when(ends(":exit"), "exit").when(ends(":log"), "log"))
    left = F.when(ends(":exit"), F.concat(F.lit("process_exit code="), F.coalesce(p("code"), F.lit("none")), F.lit(" signal="), F.coalesce(p("signal"), F.lit("none"))))
    names = [*METRICS, "chunk_index", "chunk_total"]
    inferred = F.map_filter(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[p(n) for n in names])), lambda k, v: v.isNotNull())
    given = F.from_json(F.get_json_object("payload", "$.metrics"), "map<string,string>")
    metrics = F.when(F.size(given) > 0, given).when(F.size(inferred) > 0, inferred)
    df = raw.where("channel <> '' and timestamp is not null")
    return df.select("channel", "timestamp", "payload", p("runId", "run_id").alias("run_id"), p("site", "site_etld1", "target_site", "input").alias("site"), phase.alias("phase"), F.coalesce(p("message"), left).alias("message"), metrics.alias("metrics"))


def known_types(events: DataFrame) -> DataFrame:
    return events.where(F.col("type").isin(TYPES) & F.col("timestamp").isNotNull())


def replay(events: DataFrame, after: int, last: int = 500) -> DataFrame:
    """The last so many events beyond a cursor, in order."""
    return events.where(F.col("seq") > after).orderBy(F.desc("seq")).limit(last).orderBy("seq")


def active_sites(events: DataFrame) -> DataFrame:
    """Sites of each run that have started or moved on and not finished since; a start of the run clears those before it.

    Two aggregates and a join of a row for each run; stateful.active_sites_stream is the form for a stream.
    """
    start = events.where("type = 'run_started'").groupBy("run_id").agg(F.max("seq").alias("__start"))
    last = _last_of_site(events).join(start, "run_id", "left")
    return last.where(F.col("__start").isNull() | (F.col("seq") > F.col("__start"))).drop("__start")


def _last_of_site(events: DataFrame) -> DataFrame:
    at = F.struct("seq", F.col("type").alias("type"), F.col("rank").alias("rank"))
    last = events.where(F.col("type").isin("site_started", "site_stage", "site_finished", "site_failed")).groupBy("run_id", "site").agg(F.max(at).alias("last"))
    return last.where(~F.col("last.type").isin("site_finished", "site_failed")).select("run_id", "site", F.col("last.type").alias("last_type"), F.col("last.rank").alias("rank"), F.col("last.seq").alias("seq"))


def run_progress(events: DataFrame) -> DataFrame:
    """Of each run: distinct sites started, finished events and failures."""
    kind = F.col("type")
    return events.groupBy("run_id").agg(F.count_distinct(F.when(kind == "site_started", F.col("site"))).alias("started"), F.count_if(kind == "site_finished").alias("finished"), F.count_if(kind == "site_failed").alias("failed"), F.max("seq").alias("last_seq"))


def recent_completed(events: DataFrame, n: int = 15, per_site: bool = False) -> DataFrame:
    """The last n finished sites of each run; with per_site, each site once."""
    df = events.where("type = 'site_finished'")
    if per_site:
        df = df.groupBy("run_id", "site").agg(F.max("seq").alias("seq"))
    return df.withColumn("at", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("seq")))).where(F.col("at") <= n).select("run_id", "site", "seq", "at")


def annotation_runs(events: DataFrame) -> DataFrame:
    """Of each (run_id, site): last status, and every metric's last value that was given."""
    given = lambda m: F.coalesce(F.max_by(m, F.when(F.col(m).isNotNull(), F.col("seq"))), F.lit(0))
    return events.groupBy("run_id", "site").agg(F.max("seq").alias("seq"), F.max_by("status", "seq").alias("status"), *[given(m).alias(m) for m in METRICS])


def annotation_totals(runs: DataFrame) -> DataFrame:
    """Totals of each run over its sites' states: seen, processed (in a final state), completed, under way, tokens."""
    state = F.col("status")
    return runs.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("sites"), F.count_if(state.isin(K.TERMINAL)).alias("processed"), F.count_if(state.isin("completed", "reused")).alias("completed"), F.count_if(state.isin(K.IN_PROGRESS)).alias("active"),
        F.sum(F.col("tokens_in").cast("long")).alias("tokens_in"), F.sum(F.col("tokens_out").cast("long")).alias("tokens_out"),
    )


def annotation_runs_stream(events: DataFrame) -> DataFrame:
    """annotation_runs as a stateful stream: each trigger's touched sites, in update mode."""
    out = "run_id string, site string, seq long, status string, " + ", ".join(f"{m} int" for m in METRICS)

    def fold(key: Any, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = list(state.get) if state.exists else [-1, None, *[0] * len(METRICS)]
        rows = pd.concat(list(batches)).sort_values("seq")
        for r in rows.itertuples(index=False):
            if r.seq >= now[0]:
                now[0], now[1] = int(r.seq), r.status
            for i, m in enumerate(METRICS, 2):
                if pd.notna(v := getattr(r, m)):
                    now[i] = int(v)
        state.update(tuple(now))
        yield pd.DataFrame([[*key, *now]], columns=["run_id", "site", "seq", "status", *METRICS])

    kept = "seq long, status string, " + ", ".join(f"{m} int" for m in METRICS)
    return events.groupBy("run_id", "site").applyInPandasWithState(fold, out, kept, "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Events by type and tumbling window of event time; later data than the watermark is dropped on a stream."""
    return events.withWatermark("timestamp", late).groupBy(F.window("timestamp", width).alias("w"), "type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "type", "n")


def summarize_stream(stream: DataFrame, store, merge, checkpoint: str):
    """Start an incremental summary: each micro-batch is merged into the stored records and the touched runs are summed anew.

    merge(batch, spark) upserts the batch and returns the touched run ids as a
    DataFrame; store(run_ids) recomputes and writes their summaries. Both are idempotent, so
    a repeated batch does no harm.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            store(merge(batch, batch.sparkSession))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _of_runs(store: Store, name: str, runs: list[str], like: DataFrame) -> DataFrame:
    return store.read(name, runs) if store.has(name) else like.limit(0)


def _records_parts(store: Store, batch: DataFrame) -> dict:
    """Parts of a commit that upserts records and sums the runs they touch anew."""
    batch = batch.where("run_id is not null")
    runs = [r.run_id for r in batch.select("run_id").distinct().collect()]  # the runs of a batch
    old = _of_runs(store, "results", runs, batch).join(batch.select("run_id", "ingest_seq"), ["run_id", "ingest_seq"], "left_anti")
    return {"results": ("run_id", views.upsert_results(old, batch, ("run_id",))), "summaries": ("run_id", lambda written: summary.run_summaries(written("results")))}


def _is_done(store: Store, stream: str, batch_id: int) -> bool:
    """Has a batch of a stream been committed? A restarted stream repeats its last batch if it fell between commit and checkpoint."""
    return store.manifest()["info"].get("batches", {}).get(stream, -1) >= batch_id


def _batches(store: Store, stream: str, batch_id: int) -> dict:
    return {"batches": {**store.manifest()["info"].get("batches", {}), stream: batch_id}}


def summarize_records(records: DataFrame, root: str, checkpoint: str):
    """Start an incremental summary of a stream of site records in the store at root: table results has the last record of each site of a run, table summaries one row for each run.

    Distinct counts can't be kept as running sums, so each micro-batch recomputes the runs that it
    touches and no others. Both tables change in one version, so a crash leaves the version before and a
    repeated batch is left out.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        store = Store(batch.sparkSession, root)
        if not _is_done(store, checkpoint, batch_id) and not batch.isEmpty():
            store.commit(_records_parts(store, batch), info=_batches(store, checkpoint, batch_id))

    return records.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


PENDING = "event_id string, run_id string, out_dir string, site string, queued_at string, attempt_count int, last_error string, result_offset long, replay_key string"


def apply_pending(store: Store, events: DataFrame | None, results: DataFrame, most: int = 5, info: dict | None = None) -> int:
    """One attempt at all pending events of a store: those that earlier attempts left, and new ones. The new version's number.

    Records of events that are found go into results and summaries, the events into applied; the others
    get one attempt more and the error, and after most attempts they go to dead. All of it is one
    version. Where applying breaks, every event whose record was found counts as failed by that error. An
    event that has been applied or given up is not taken up again; of one id the first copy counts.
    """
    spark = store.spark
    fields = [f.split()[0] for f in PENDING.split(", ")]
    left = store.read("pending").select(*fields) if store.has("pending") else spark.createDataFrame([], PENDING)
    new = left.limit(0) if events is None else events.select(*fields)
    for name in ("applied", "dead"):
        if store.has(name):
            new = new.join(store.read(name).select("event_id"), "event_id", "left_anti")
    both = left.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    first = F.row_number().over(Window.partitionBy("event_id").orderBy("__new", F.desc_nulls_last("attempt_count"), "queued_at"))
    due = both.withColumn("__at", first).where("__at = 1").select(*fields)

    def parts(done: DataFrame, failed: DataFrame) -> dict:
        given_up = F.col("attempt_count") >= most
        now = f"after-{store.manifest()['version']}"  # applied and dead only grow: by a part for each attempt
        part = lambda df, name: ("part", df.select(*fields).withColumn("part", F.lit(name)))
        return {"applied": part(done, now), "dead": part(failed.where(given_up), now), "pending": part(failed.where(~given_up), "all")}

    gone = {"pending": ["all"]}
    records, failed = replay_outbox(due, results)
    try:
        done = due.join(records.select("event_id"), "event_id", "left_semi").withColumn("attempt_count", F.coalesce("attempt_count", F.lit(0)))
        return store.commit({**_records_parts(store, records.drop("event_id", "site")), **parts(done, failed)}, gone, info)
    except PySparkException as e:
        again = {"attempt_count": F.coalesce("attempt_count", F.lit(0)) + 1, "last_error": F.lit(str(e)[:500])}
        failed = failed.select(*fields).unionByName(due.join(failed.select("event_id"), "event_id", "left_anti").withColumns(again).select(*fields))
        return store.commit(parts(due.limit(0), failed), gone, info)


def replay_stream(outbox: DataFrame, results: Callable[[], DataFrame], root: str, checkpoint: str, most: int = 5):
    """Apply a stream of pending events to the store at root, each micro-batch together with what earlier ones left; results() gives the records as they are by then."""

    def each(batch: DataFrame, batch_id: int) -> None:
        store = Store(batch.sparkSession, root)
        if not _is_done(store, checkpoint, batch_id):
            apply_pending(store, batch, results(), most, _batches(store, checkpoint, batch_id))

    return outbox.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay_outbox(outbox: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Result rows that pending events stand for, and the events that found none (attempt_count + 1, with the error).

    An event's row is the one at its recorded position when that is the site's, else the site's latest in the run.
    """
    r = results.select("run_id", "site", "ingest_seq")
    at = outbox.select("event_id", "run_id", "site", "result_offset").join(r, ["run_id", "site"])
    pick = at.groupBy("event_id", "run_id", "site").agg(F.coalesce(F.max(F.when(F.col("ingest_seq") == F.col("result_offset"), F.col("ingest_seq"))), F.max("ingest_seq")).alias("ingest_seq"))
    applied = results.join(pick.select("event_id", "run_id", "site", "ingest_seq"), ["run_id", "site", "ingest_seq"])
    failed = outbox.join(pick.select("event_id"), "event_id", "left_anti").withColumns({"attempt_count": F.coalesce("attempt_count", F.lit(0)) + 1, "last_error": F.lit("result_not_found")})
    return applied, failed


def join_deltas(deltas: DataFrame) -> DataFrame:
    """Streamed model output put together by (site, chunk, round, phase) in order."""
    return deltas.groupBy("site", "chunk", "round", "phase").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "delta"))), lambda x: x["delta"]), "").alias("text"))


def eta_samples(samples: DataFrame, hours: int = 6, most: int = 180) -> DataFrame:
    """Samples that count: after the last step back, of equal progress the latest, within 6 h of the last, at most 180."""
    w = Window.partitionBy("run_id").orderBy("timestamp_ms")
    df = samples.where("total_sites > 0 and processed_sites >= 0 and timestamp_ms > 0")
    df = df.withColumn("back", (F.col("processed_sites") < F.lag("processed_sites").over(w)).cast("int"))
    df = df.withColumn("epoch", F.sum(F.coalesce("back", F.lit(0))).over(w))
    df = df.withColumn("last_epoch", F.max("epoch").over(Window.partitionBy("run_id"))).where("epoch = last_epoch")
    df = df.groupBy("run_id", "processed_sites", "total_sites").agg(F.max("timestamp_ms").alias("timestamp_ms"))
    df = df.withColumn("last_ms", F.max("timestamp_ms").over(Window.partitionBy("run_id"))).where(F.col("last_ms") - F.col("timestamp_ms") <= hours * 3_600_000)
    at = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("timestamp_ms")))
    return df.withColumn("at", at).where(F.col("at") <= most).drop("last_ms", "at")


def eta(samples: DataFrame, runs: DataFrame, now_ms: Column | None = None) -> DataFrame:
    """eta_ms, milliseconds left of each run (run_id, started_at_ms): by 0.7 of the last 15 minutes' rate and 0.3 of the whole run's, or the one there is.

    The rate is taken at the last sample or, if that is later, now. The recent one starts at the
    first sample of the window that is two sites back and 30 seconds away, else at the window's
    first sample that is behind; of one time the one with the fewest sites. A run beyond its total has 0 left; ahead_sites and ahead_ms, not
    rounded, are below 0 there by what it has gone beyond.
    """
    last = samples.groupBy("run_id").agg(F.max(F.struct("timestamp_ms", "processed_sites", "total_sites")).alias("l"))
    if now_ms is not None:
        last = last.select("run_id", F.struct(F.greatest("l.timestamp_ms", now_ms).alias("timestamp_ms"), "l.processed_sites", "l.total_sites").alias("l"))
    df = samples.alias("df").join(last, "run_id")
    sites, secs = F.col("l.processed_sites") - F.col("processed_sites"), (F.col("l.timestamp_ms") - F.col("timestamp_ms")) / 1000
    near = (F.col("timestamp_ms") >= F.col("l.timestamp_ms") - 900_000) & (sites > 0)
    one = F.struct("timestamp_ms", "df.processed_sites", F.when(secs >= 30, sites / secs).alias("rate"))
    recent = df.groupBy("run_id", "l").agg(F.min(F.when(near & (sites >= 2) & (secs >= 30), one)).alias("two"), F.min(F.when(near, one)).alias("any"))
    df = recent.join(runs, "run_id", "left")
    age = (F.col("l.timestamp_ms") - F.col("started_at_ms")) / 1000
    seen = F.col("l.processed_sites") > 0
    life = F.when((F.col("started_at_ms") > 0) & (age >= 30) & seen, F.col("l.processed_sites") / age)
    fast = F.coalesce("two.rate", "any.rate")
    rate = F.when(seen, F.coalesce(fast * 0.7 + life * 0.3, fast, life))
    ahead = F.col("l.total_sites") - F.col("l.processed_sites")
    ms = ahead / rate * 1000
    return df.select("run_id", F.when(ahead <= 0, 0).otherwise(F.ceil(ms)).cast("long").alias("eta_ms"), ahead.alias("ahead_sites"), ms.alias("ahead_ms"))


def token_rate(usage: DataFrame, seconds: int = 60) -> DataFrame:
    """Tokens of the trailing minute at each call (run_id, ts, tokens)."""
    w = Window.partitionBy("run_id").orderBy(F.col("ts").cast("timestamp").cast("long")).rangeBetween(-seconds, 0)
    return usage.withColumn("tokens_last_minute", F.sum("tokens").over(w))


def resource_summary(samples: DataFrame) -> DataFrame:
    """Of each run's samples (run_id, ts, rss_mb, cpu_pct, processed): count, memory at start, peak, end and change, CPU mean and peak; a flag beyond 512 MB."""
    a = samples.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("rss_mb", "ts").alias("rss_start"), F.max("rss_mb").alias("rss_peak"), F.max_by("rss_mb", "ts").alias("rss_end"), F.round(F.avg("cpu_pct"), 6).alias("cpu_avg"), F.max("cpu_pct").alias("cpu_peak"), F.max("processed").alias("processed"))
    return a.withColumn("rss_delta", F.col("rss_end") - F.col("rss_start")).withColumn("grew", F.col("rss_delta") > 512)
