"""Streams with a state for each run: sites under way and progress, cleared by the start of a run.

State is held by transformWithState, which needs the RocksDB state store; with_state_store sets it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MOVES, ENDS = ("site_started", "site_stage", "site_finished", "site_failed"), ("site_finished", "site_failed")

ACTIVE = "run_id string, site string, active boolean, last_type string, rank int, seq long"
PROGRESS = "run_id string, started long, finished long, failed long, last_seq long"


def with_state_store(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


def _int(v: Any) -> int | None:
    return None if pd.isna(v) else int(v)


class ActiveSites(StatefulProcessor):
    """Of one run: the last event of each site since the run's last start, by seq, whatever order they come in.

    Sites that ended stay in the state until the next start, so that an earlier event that
    comes late changes nothing: at most the sites of one run.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.start = handle.getValueState("start", "seq long")
        self.sites = handle.getMapState("sites", "site string", "last_type string, rank int, seq long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        start = self.start.get()[0] if self.start.exists() else -1
        changed: dict[str, tuple] = {}
        for batch in rows:
            for r in batch.sort_values("seq").itertuples(index=False):
                if r.type == "run_started" and r.seq > start:
                    start = int(r.seq)
                    self.start.update((start,))
                    for (site,), (last, rank, seq) in list(self.sites.iterator()):
                        if seq < start:
                            self.sites.removeKey((site,))
                            if last not in ENDS:
                                changed[site] = (False, "run_started", rank, start)
                elif r.type in MOVES and r.seq > start and isinstance(r.site, str):
                    held = self.sites.getValue((r.site,)) if self.sites.containsKey((r.site,)) else None
                    if held is None or r.seq > held[2]:
                        now = (r.type, _int(r.rank), int(r.seq))
                        self.sites.updateValue((r.site,), now)
                        changed[r.site] = (r.type not in ENDS, *now)
        if changed:
            out = pd.DataFrame([(key[0], site, *row) for site, row in sorted(changed.items())], columns=["run_id", "site", "active", "last_type", "rank", "seq"])
            yield out.astype({"rank": "Int32"})

    def close(self) -> None:
        pass


class Progress(StatefulProcessor):
    """Of one run: distinct sites started, finished events and failures."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.started = handle.getMapState("started", "site string", "seq long")
        self.counts = handle.getValueState("counts", "started long, finished long, failed long, last_seq long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        started, finished, failed, last = self.counts.get() if self.counts.exists() else (0, 0, 0, -1)
        for batch in rows:
            for r in batch.itertuples(index=False):
                last = max(last, int(r.seq))
                finished += r.type == "site_finished"
                failed += r.type == "site_failed"
                if r.type == "site_started" and isinstance(r.site, str) and not self.started.containsKey((r.site,)):
                    self.started.updateValue((r.site,), (int(r.seq),))
                    started += 1
        self.counts.update((started, finished, failed, last))
        yield pd.DataFrame([(key[0], started, finished, failed, last)], columns=["run_id", "started", "finished", "failed", "last_seq"])

    def close(self) -> None:
        pass


def _by_run(events: DataFrame, processor: StatefulProcessor, out: str) -> DataFrame:
    with_state_store(events.sparkSession)
    return events.groupBy("run_id").transformWithStateInPandas(processor, out, "Update", "None")


def active_sites_stream(events: DataFrame) -> DataFrame:
    """Changes of the sites under way (run_id, site, active, last_type, rank, seq): one row for each site that a trigger changes. The last rows that are active are what events.active_sites gives."""
    return _by_run(events.select("run_id", "seq", "type", "site", "rank"), ActiveSites(), ACTIVE)


def run_progress_stream(events: DataFrame) -> DataFrame:
    """events.run_progress as a stream: a row for each run that a trigger touches."""
    return _by_run(events.select("run_id", "seq", "type", "site"), Progress(), PROGRESS)
