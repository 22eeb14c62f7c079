"""Versioned tables, the catalog of many runs, stateful streams, the cursor source and retries."""

import json
import random

import pytest
from pyspark.sql import functions as F

from plumbline.plans import reindex
from plumbline.schemas import schema
from plumbline.sources.cursor import poll_events
from plumbline.sources.versions import Conflict, Store
from plumbline.streaming import events as E
from plumbline.streaming import stateful

from .test_golden import results
from .test_more import runs, texts


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    df = spark.createDataFrame([("r1", 1), ("r 2/x", 2)], "run_id string, n int")
    assert store.manifest()["version"] == 0 and not store.has("t")
    assert store.commit({"t": ("run_id", df), "u": ("run_id", lambda written: written("t").withColumn("n", F.col("n") * 10))}) == 1
    assert rows(store.read("t"), "run_id", "n") == [("r 2/x", 2), ("r1", 1)] == [(r, n // 10) for r, n in rows(store.read("u"), "run_id", "n")]
    assert store.commit({"t": ("run_id", df.where("n = 1").withColumn("n", F.lit(5)))}, {"u": ["r1"]}, {"by": "x"}) == 2
    assert rows(store.read("t"), "run_id", "n") == [("r 2/x", 2), ("r1", 5)] and rows(store.read("u"), "run_id") == [("r 2/x",)]
    assert rows(store.read("t", version=1), "n") == [(1,), (2,)] and rows(store.read("t", ["r1"]), "n") == [(5,)] and store.read("t", ["no"]).count() == 0
    with pytest.raises(Exception, match="lost"):  # the second table breaks: the first one's new rows are not seen
        store.commit({"t": ("run_id", df), "u": ("run_id", df.withColumn("n", F.assert_true(F.lit(False), "lost").cast("int")))})
    assert rows(store.read("t"), "n") == [(2,), (5,)] and store.manifest()["info"] == {"by": "x"}
    (tmp_path / "s/manifests/000000000003.json").write_text('{"version": 3, "tab')  # a commit that died while it wrote the manifest
    assert store.manifest()["version"] == 2 and store.commit({"t": ("run_id", df)}) == 4
    with pytest.raises(Conflict):
        store._put(4, {})
    gone = store.vacuum(1)
    assert any(g.startswith("data/t/commit=1-") for g in gone) and rows(store.read("t"), "n") == [(1,), (2,)] and rows(store.read("u"), "n") == [(20,)]


def site(name, tp, run, **more):
    return {"site_etld1": name, "input": name, "status": "ok", "policy_is_english": True, "main_category": "news", "run_id": run, "third_parties": [{"third_party_etld1": tp, "entity": f"E {run}", "categories": ["cdn"], "policy_url": "https://t.com/p"}], **more}


def test_catalog_of_many_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(reindex, "BUCKETS", 2)
    store, at = Store(spark, str(tmp_path / "cat")), lambda t: F.lit(t).cast("timestamp")
    text = texts(spark, ("r1", "a.com", None, "own policy"), ("r1", "a.com", "t.com", "their policy"), ("other", "b.com", "t.com", "their policy"))
    reindex.commit_runs(store, results(spark, site("a.com", "t.com", "r1"), site("b.com", "t.com", "other")), text, runs(spark, ("r1", "out", "1"), ("other", "out2", "1")), at("2024-01-01"))
    first = {n: df.cache() for n, df in reindex.read_catalog(store).items()}
    assert rows(first["sites"], "run_id", "site_etld1") == [("other", "b.com"), ("r1", "a.com")] and first["documents"].count() == 2
    two = results(spark, site("a.com", "t.com", "r2"), site("c.com", "n.com", "r2"))
    reindex.commit_runs(store, two, text.where("run_id = 'r1'").withColumn("run_id", F.lit("r2")), runs(spark, ("r2", "out", "2")), at("2024-02-01"))
    now = reindex.read_catalog(Store(spark, str(tmp_path / "cat")))
    assert {n: {r for (r,) in rows(now[n], "run_id")} for n in ("runs", "sites", "site_search", "site_services", "category_rollups")} == dict.fromkeys(("runs", "sites", "site_search", "site_services", "category_rollups"), {"other", "r2"})
    assert {r.service_domain: (r.entity, str(r.created_at)[:7], str(r.updated_at)[:7]) for r in now["services"].collect()} == {"t.com": ("E r2", "2024-01", "2024-02"), "n.com": ("E r2", "2024-02", "2024-02")}
    assert {str(r.created_at)[:7] for r in now["documents"].collect()} == {"2024-01"}
    whole = reindex.reindex(two.unionByName(results(spark, site("b.com", "t.com", "other"))), text.withColumn("run_id", F.when(F.col("run_id") == "r1", "r2").otherwise(F.col("run_id"))), runs(spark, ("r2", "out", "2"), ("other", "out2", "1")))
    for name in ("sites", "site_search", "site_services", "category_rollups"):
        mine = [df.where("run_id = 'r2'" if name == "site_search" else "true").select(*sorted(now[name].columns)).collect() for df in (now[name], whole[name])]  # other runs' search rows are not made anew
        assert sorted(map(str, mine[0])) == sorted(map(str, mine[1])), name
    reindex.commit_runs(store, results(spark, site("old.com", "t.com", "r0")), text.limit(0), runs(spark, ("r0", "out", "0")))  # older than what out has
    assert {r for (r,) in rows(reindex.read_catalog(store)["sites"], "run_id")} == {"other", "r2"}


def test_ingest_isolates_a_broken_run(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(reindex, "BUCKETS", 2)

    def load(run):
        bad = F.assert_true(F.lit(run != "bad"), "broken texts").isNull()
        return results(spark, site(f"{run}.com", "t.com", run)), texts(spark, (run, f"{run}.com", None, "x")).where(bad), runs(spark, (run, f"out-{run}", "1"))

    log = {r.run_id: r for r in reindex.ingest_runs(spark, ["a", "bad", "b"], load, str(tmp_path)).collect()}
    assert {k: r.status for k, r in log.items()} == {"a": "completed", "bad": "failed", "b": "completed"} and "broken texts" in log["bad"].error
    assert rows(reindex.read_catalog(Store(spark, f"{tmp_path}/catalog"))["sites"], "run_id") == [("a",), ("b",)]
    assert spark.read.json(f"{tmp_path}/ingestions").count() == 3


def test_pending_events_are_retried(spark, tmp_path):
    kind, root = schema("site_result"), str(tmp_path / "out")
    have = []

    def records():
        return spark.createDataFrame(have, kind).withColumn("site", F.col("site_etld1"))

    def put(n, *events):
        spark.createDataFrame(events, schema("outbox_event")).coalesce(1).write.json(str(tmp_path / "box" / f"b={n}"))
        box = spark.readStream.schema(schema("outbox_event")).option("maxFilesPerTrigger", 1).json(str(tmp_path / "box"))
        E.replay_stream(box, records, root, str(tmp_path / "ck"), most=3).awaitTermination()
        return Store(spark, root)

    late, never = ("late", "r", None, "a.com", "t", 0, None, 1, None), ("never", "r", None, "z.com", "t", None, None, 1, None)
    store = put(0, late, never)
    assert rows(store.read("pending"), "event_id", "attempt_count", "last_error") == [("late", 1, "result_not_found"), ("never", 1, "result_not_found")]
    store = put(1, late)  # a copy of an event that waits
    assert rows(store.read("pending"), "event_id", "attempt_count") == [("late", 2), ("never", 2)]
    have.append({"ingest_seq": 1, "run_id": "r", "site_etld1": "a.com", "status": "ok", "third_parties": []})
    store = put(2, late)
    assert rows(store.read("applied"), "event_id", "attempt_count") == [("late", 2)] and rows(store.read("dead"), "event_id", "attempt_count") == [("never", 3)]
    assert store.read("pending").count() == 0 and rows(store.read("results"), "site_etld1") == [("a.com",)] and store.read("summaries").first().processed_sites == 1
    version = store.manifest()["version"]
    assert E.apply_pending(store, spark.createDataFrame([late, never], schema("outbox_event")), records()) == version + 1
    assert store.read("applied").count() == 1 and store.read("pending").count() == 0  # neither is taken up again
    assert store.manifest()["info"]["batches"] == {str(tmp_path / "ck"): 2}


EVENT = "run_id string, seq long, type string, site string, rank int"


def test_active_sites_on_every_prefix(spark, tmp_path):
    rng = random.Random(4)
    log = [(f"r{rng.randrange(3)}", seq, rng.choice(["run_started", "log", *["site_started"] * 4, "site_stage", "site_stage", "site_finished", "site_failed"]), f"s{rng.randrange(6)}", rng.choice([None, seq])) for seq in range(1, 61)]
    for n in range(6):
        spark.createDataFrame(log[10 * n : 10 * n + 10], EVENT).coalesce(1).write.json(str(tmp_path / "in" / f"b={n}"))
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    seen = {"a": {}, "p": {}}

    def collect(name):
        return lambda df, batch: seen[name].setdefault(batch, [r.asDict() for r in df.collect()])

    for name, out in (("a", stateful.active_sites_stream(stream)), ("p", stateful.run_progress_stream(stream))):
        out.writeStream.outputMode("update").foreachBatch(collect(name)).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    now, progress, files = {}, {}, [f[1] for f in sorted((json.loads(x.read_text().splitlines()[0])["seq"], x) for x in (tmp_path / "in").glob("*/*.json"))]
    order = [int(f.parent.name[2:]) for f in sorted(files, key=lambda f: f.stat().st_mtime)]
    assert len(seen["a"]) == len(seen["p"]) == 6
    for n in range(6):
        for r in seen["a"][n]:
            now[r["run_id"], r["site"]] = r
        for r in seen["p"][n]:
            progress[r["run_id"]] = tuple(r.values())
        prefix = spark.createDataFrame([x for b in order[: n + 1] for x in log[10 * b : 10 * b + 10]], EVENT)
        want = rows(E.active_sites(prefix), "run_id", "site", "last_type", "seq")
        assert sorted((r["run_id"], r["site"], r["last_type"], r["seq"]) for r in now.values() if r["active"]) == want
        assert sorted(progress.values()) == rows(E.run_progress(prefix), "run_id", "started", "finished", "failed", "last_seq")


def test_cursor_source(spark, tmp_path):
    def log(name, first, beyond):
        (tmp_path / "log").mkdir(exist_ok=True)
        with (tmp_path / "log" / name).open("a") as f:
            f.writelines(json.dumps({"seq": q, "type": "log", "run_id": "r", "payload": "x" * 40}) + "\n" for q in range(first, beyond))

    def poll():
        taken = []
        q = poll_events(spark, str(tmp_path / "log")).writeStream.foreachBatch(lambda df, _: taken.extend(r.seq for r in df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(taken)

    log("one.jsonl", 1, 101)
    assert poll() == list(range(1, 101))
    log("one.jsonl", 101, 131)
    (tmp_path / "log" / "one.jsonl").open("a").write('{"seq": 9999, "ty')  # a line that is still being written
    assert poll() == list(range(101, 131)) and poll() == []
    log("two.jsonl", 131, 10_001)
    assert poll() == list(range(6_001, 10_001))  # the ring has wrapped: its last 4,000
