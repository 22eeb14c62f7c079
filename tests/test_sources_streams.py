"""Files in and out, and streams that equal their batch forms."""

import json

from pyspark.sql import functions as F

from plumbline.schemas import schema
from plumbline.sources import readers, sinks
from plumbline.sources.versions import Store
from plumbline.streaming import events as E


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_readers(spark, tmp_path):
    p = put(tmp_path / "r.jsonl", '{"site_etld1": "a", "rank": 1}\n\nnot json\n{"site_etld1": "b"}\n')
    assert sorted(r.site_etld1 for r in readers.read_results(spark, p).collect()) == ["a", "b"]
    bad = readers.read_jsonl_lenient(spark, p, "site_etld1 string").where("_error is not null").collect()
    assert [r.raw for r in bad] == ["not json"]
    p = put(tmp_path / "s.csv", "tranco_id,domain,status_code\n1,a.com,200\n2,b.com,\n")
    assert [r.domain for r in readers.read_site_csv(spark, p).orderBy("seq").collect()] == ["a.com", "b.com"]
    p = put(tmp_path / "s.txt", " a.com \n# no\n\nb.com\n")
    assert [r.site for r in readers.read_site_lines(spark, p).collect()] == ["a.com", "b.com"]
    put(tmp_path / "art/a.com/policy.txt", "own\ntext")
    put(tmp_path / "art/a.com/third_party/t.com/policy.txt", "theirs")
    got = {(r.site_etld1, r.service_domain): r.text for r in readers.read_policy_texts(spark, str(tmp_path / "art")).collect()}
    assert got == {("a.com", None): "own\ntext", ("a.com", "t.com"): "theirs"}
    put(tmp_path / "runs/output_1/results.summary.json", json.dumps({"run_id": "r1", "status": "done"}))
    put(tmp_path / "runs/output_1/run_state.json", json.dumps({"run_id": "zz", "updated_at": "2024"}))
    put(tmp_path / "runs/output_2/run_state.json", json.dumps({"updated_at": "2025"}))
    runs = readers.list_runs(readers.read_run_metadata(spark, str(tmp_path / "runs"))).collect()
    assert [(r.run_id, r.status) for r in runs] == [("output_2", None), ("r1", "done")]
    p = put(tmp_path / "radar.json", json.dumps({"T.com": {"entity": "E", "categories": ["c"], "prevalence": 0.1}}))
    assert [(r.etld1, r.entity) for r in readers.read_tracker_index(spark, p).collect()] == [("t.com", "E")]
    put(tmp_path / "m/a.com/scrape_complete.json", json.dumps({"status": "ok", "policy_is_english": True}))
    put(tmp_path / "m/b.com/annotation_complete.json", "{}")
    assert {r.site: (r.scraped, r.annotated) for r in readers.read_markers(spark, str(tmp_path / "m")).collect()} == {"a.com": (True, False), "b.com": (False, True)}
    a, b = spark.createDataFrame([("d", "s1")], "doc_id string, statement string"), spark.createDataFrame([("d", "s2"), ("e", "s3"), ("f", None)], "doc_id string, statement string")
    assert sorted(r.statement for r in readers.preferred_statements(a, b).collect()) == ["s1", "s3"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("r1", "a", True), ("r2", "b", False)], "run_id string, site_etld1 string, policy_is_english boolean")
    sinks.write_by_run(df, str(tmp_path / "t"))
    sinks.write_by_run(spark.createDataFrame([("r2", "c", True)], df.schema), str(tmp_path / "t"))
    assert sorted(r.site_etld1 for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["a", "c"]
    sinks.write_english(df, str(tmp_path / "en"))
    sinks.write_jsonl(df, str(tmp_path / "en"), append=True)
    assert spark.read.json(str(tmp_path / "en")).count() == 3
    sinks.write_report(df.select("run_id"), str(tmp_path / "rep"), "runs")
    assert json.loads(spark.read.text(str(tmp_path / "rep"), wholetext=True).first().value)["runs"][0] == {"run_id": "r1"}
    texts = spark.createDataFrame([("r1", "a", None, "é"), ("r1", "a", "t", "x")], schema("policy_text"))
    res = df.withColumns({"status": F.lit("ok"), "ended_at": F.lit("now")})
    assert sinks.scrape_markers(res, texts).first().policy_text_len == 2 and [r.site_etld1 for r in sinks.qualified_sites(res, texts).collect()] == ["a"]


FIELDS = "seq long, run_id string, site string, type string, rank int, status string, statements int, chunks int, blocks int, tokens_in int, tokens_out int, timestamp timestamp"


def log(spark):
    kinds = ["site_started", "site_stage", "site_finished", "site_failed", "site_started"]
    rows = [(i, f"r{i % 2}", f"s{i % 5}", kinds[i * 7 % 5], i, f"st{i % 3}", i if i % 2 else None, None, 3 if i % 4 == 0 else None, i * 10 if i % 3 else None, None) for i in range(60)]
    df = spark.createDataFrame(rows, FIELDS.rsplit(", ", 1)[0])
    return df.withColumn("timestamp", F.timestamp_seconds(F.lit(1704067200) + F.col("seq") * 600))


def streamed(spark, df, make, mode, tmp_path):
    for part in range(3):
        df.where(F.col("seq") % 60 >= part * 20).where(F.col("seq") < (part + 1) * 20).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    source = spark.readStream.schema(FIELDS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    name = f"q{abs(hash(str(tmp_path)))}"
    q = make(source).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_stateful_stream_equals_batch(spark, tmp_path):
    df = log(spark)
    want = sorted(tuple(r) for r in E.annotation_runs(df).collect())
    out = streamed(spark, df, E.annotation_runs_stream, "update", tmp_path)
    last = out.groupBy("run_id", "site").agg(F.max_by(F.struct(*out.columns), "seq").alias("r")).select("r.*")
    assert sorted(tuple(r) for r in last.collect()) == want


def test_progress_stream_equals_batch(spark, tmp_path):
    df = log(spark)
    last = lambda s: s.groupBy("run_id", "site").agg(F.max(F.struct("seq", "type")).alias("last")).select("run_id", "site", "last.*")
    out = streamed(spark, df, last, "complete", tmp_path)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, last(df).collect()))
    started = {(r.run_id, r.site) for r in E.active_sites(df).collect()}
    assert started == {(r.run_id, r.site) for r in last(df).collect() if r.type not in ("site_finished", "site_failed")}


def test_windows_and_incremental_summary(spark, tmp_path):
    df = log(spark)
    out = streamed(spark, df, E.windowed_counts, "append", tmp_path)
    have = {(r.start, r.type): r.n for r in E.windowed_counts(df).collect()}
    assert all(have[r.start, r.type] == r.n for r in out.collect()) and out.count() > 0
    store, summaries = [], {}

    def merge(batch, s):
        store.extend(map(tuple, batch.select("run_id", "seq").collect()))
        return batch.select("run_id").distinct()

    def save(runs):
        summaries.update({r.run_id: sum(x[0] == r.run_id for x in set(store)) for r in runs.collect()})

    source = spark.readStream.schema(FIELDS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    E.summarize_stream(source, save, merge, str(tmp_path / "ck2")).awaitTermination()
    assert summaries == {"r0": 30, "r1": 30}


def test_envelope_and_outbox(spark):
    raw = spark.createDataFrame([("annotator:exit", "t", json.dumps({"site_etld1": " a ", "runId": "r", "code": 1})), ("x:log", "t", json.dumps({"message": "m", "tokens_in": 5})), ("", "t", "{}"), ("c", None, "{}")], "channel string, timestamp string, payload string")
    got = {r.channel: r for r in E.normalize(raw).collect()}
    assert len(got) == 2 and (got["annotator:exit"].site, got["annotator:exit"].phase, got["annotator:exit"].message) == ("a", "exit", "process_exit code=1 signal=none") and got["x:log"].metrics == {"tokens_in": "5"}
    box = spark.createDataFrame([("e1", "r", None, "a", None, 0, None, 5, None), ("e2", "r", None, "a", None, 0, None, 99, None), ("e3", "r", None, "z", None, 1, None, 1, None)], schema("outbox_event"))
    res = spark.createDataFrame([("r", "a", 5), ("r", "a", 8)], "run_id string, site string, ingest_seq long")
    done, failed = E.replay_outbox(box, res)
    assert sorted((r.event_id, r.ingest_seq) for r in done.collect()) == [("e1", 5), ("e2", 8)] and [(r.event_id, r.attempt_count) for r in failed.collect()] == [("e3", 2)]


def test_eta(spark):
    s = spark.createDataFrame([("r", p, 100, t * 1000) for p, t in ((5, 10), (3, 100), (3, 160), (13, 260), (23, 360))], schema("eta_sample"))
    kept = E.eta_samples(s)
    assert sorted((r.processed_sites, r.timestamp_ms) for r in kept.collect()) == [(3, 160000), (13, 260000), (23, 360000)]
    assert E.eta(kept, spark.createDataFrame([("r", 130000)], "run_id string, started_at_ms long")).first().eta_ms in (770000, 770001)  # the rate is 0.1 up to its last bit


def test_incremental_summary_and_replay(spark, tmp_path):
    rows = [(1, "r0", "a.com", "ok", 5), (2, "r0", "b.com", "exception", 3), (3, "r1", "a.com", "ok", 1)], [(4, "r0", "b.com", "ok", 9), (5, "r0", " ", "ok", 2), (6, None, "z.com", "ok", 2)]
    kind = schema("site_result")
    for i, batch in enumerate(rows):
        spark.createDataFrame([{"ingest_seq": q, "run_id": r, "site_etld1": s, "status": st, "rank": k, "third_parties": [{"third_party_etld1": f"t{q}.com"}]} for q, r, s, st, k in batch], kind).coalesce(1).write.json(str(tmp_path / "in" / f"b={i}"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    root = str(tmp_path / "out")
    for name in ("one", "two"):  # a second reader repeats every batch
        E.summarize_records(stream, root, str(tmp_path / name)).awaitTermination()
        got = {r.run_id: r for r in Store(spark, root).read("summaries").collect()}
        assert {k: (r.processed_sites, r.ok_sites, r.last_successful_rank, r.total, r.unique_services) for k, r in got.items()} == {"r0": (3, 3, 9, 3, 3), "r1": (1, 1, 1, 1, 1)}
    assert sorted(r.ingest_seq for r in Store(spark, root).read("results").collect()) == [1, 3, 4, 5]
    box = [("e1", "r0", None, "a.com", None, 0, None, 1, None), ("e2", "r0", None, "q.com", None, 2, None, 7, None)]
    spark.createDataFrame(box, schema("outbox_event")).write.json(str(tmp_path / "box"))
    results = spark.read.schema(kind).json(str(tmp_path / "in")).drop("b").withColumn("site", F.col("site_etld1"))
    pending = spark.readStream.schema(schema("outbox_event")).json(str(tmp_path / "box"))
    E.replay_stream(pending, lambda: results, str(tmp_path / "new"), str(tmp_path / "three")).awaitTermination()
    new = Store(spark, str(tmp_path / "new"))
    assert [(r.run_id, r.processed_sites) for r in new.read("summaries").collect()] == [("r0", 1)]
    assert [(r.event_id, r.attempt_count, r.last_error) for r in new.read("pending").collect()] == [("e2", 3, "result_not_found")]
    E.replay_stream(pending, lambda: results.withColumn("rank", F.assert_true(F.lit(False), "lost").cast("int")), str(tmp_path / "bad"), str(tmp_path / "four")).awaitTermination()
    broken = {r.event_id: (r.attempt_count, r.last_error) for r in Store(spark, str(tmp_path / "bad")).read("pending").collect()}
    assert broken["e2"] == (3, "result_not_found") and broken["e1"][0] == 1 and "lost" in broken["e1"][1]
