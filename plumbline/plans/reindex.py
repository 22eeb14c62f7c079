"""Whole-catalog jobs: reindex from run folders into one catalog of many runs, and the reports of a run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import catalog, summary
from plumbline.sources.versions import Store

KEYS = {"sites": ["run_id", "site_etld1"], "documents": ["document_id"], "site_policies": ["run_id", "site_etld1"], "services": ["service_domain"], "service_categories": ["service_domain", "category"], "site_services": ["run_id", "site_etld1", "service_domain"]}
#: Tables whose rows belong to a run; the others are shared by all runs and cut into BUCKETS parts by their first key.
OF_RUN = ["sites", "site_policies", "site_services", "site_search", "category_rollups"]
SHARED = ["documents", "services", "service_categories"]
BUCKETS = 64


def _stamped(df: DataFrame, now: Column) -> DataFrame:
    return df.withColumns({"created_at": now, "updated_at": now})


def reindex(results: DataFrame, texts: DataFrame, runs: DataFrame, old: dict[str, DataFrame] | None = None, now: Column | None = None) -> dict[str, DataFrame]:
    """All catalog tables of some runs, put over the old ones: normalised, stale runs left out, derived tables rebuilt.

    Rows of documents, services and their categories keep the created_at of their first run; updated_at is now.
    """
    now = F.current_timestamp() if now is None else now
    new = catalog.site_bundles(results, texts)
    new = {name: _stamped(df, now) if name in SHARED else df for name, df in new.items()}
    tables = {name: catalog.upsert(old[name], df, KEYS[name], "created_at" if name in SHARED else None) if old and name in old else df for name, df in new.items()}
    kept, dependent = catalog.replace_stale_runs(catalog.upsert(old["runs"], runs, ["run_id"]) if old and "runs" in old else runs, {n: tables[n] for n in ("sites", "site_policies", "site_services")})
    tables |= dependent
    c = catalog.Catalog(kept, tables["sites"], tables["documents"], tables["site_policies"], tables["services"], tables["service_categories"], tables["site_services"])
    return tables | {"runs": kept, "site_search": catalog.site_search(c), "category_rollups": catalog.category_rollups(c)}


def _bucket(name: str) -> Column:
    return F.pmod(F.xxhash64(KEYS[name][0]), F.lit(BUCKETS)).cast("string")


def commit_runs(store: Store, results: DataFrame, texts: DataFrame, runs: DataFrame, now: Column | None = None) -> int:
    """Put runs into the store's catalog as one new version; its number.

    Only parts that the runs touch are read and written: their own rows, the buckets of the documents and
    services they have, and the list of runs. A run that another of its out_dir replaces goes, with all its rows.
    """
    spark, now = store.spark, F.current_timestamp() if now is None else now
    had = {name: store.has(name) for name in [*SHARED, "runs"]}
    every = catalog.upsert(store.read("runs").drop("part"), runs, ["run_id"]) if had["runs"] else runs
    kept, _ = catalog.replace_stale_runs(every, {})
    ids = {r.run_id for r in kept.select("run_id").collect()}  # one row for each run
    known = {r.run_id for r in every.select("run_id").collect()}
    touched = sorted(r.run_id for r in runs.select("run_id").distinct().collect() if r.run_id in ids)
    here = F.col("run_id").isin(touched)
    bundles = catalog.site_bundles(results.where(here), texts.where(here))
    parts: dict = {}
    for name in SHARED:
        df = _stamped(bundles[name], now).withColumn("bucket", _bucket(name))
        if had[name]:
            of = [r.bucket for r in df.select("bucket").distinct().collect()]  # BUCKETS at most
            df = catalog.upsert(store.read(name, of), df, KEYS[name], "created_at")
        parts[name] = ("bucket", df)
    parts |= {name: ("run_id", bundles[name]) for name in ("sites", "site_policies", "site_services")}
    parts["runs"] = ("part", kept.withColumn("part", F.lit("all")))

    def tables(written: Callable[[str], DataFrame]) -> catalog.Catalog:
        shared = {n: written(n).drop("bucket") for n in SHARED}
        return catalog.Catalog(kept.where(here), written("sites"), shared["documents"], written("site_policies"), shared["services"], shared["service_categories"], written("site_services"))

    parts["site_search"] = ("run_id", lambda written: catalog.site_search(tables(written)))
    parts["category_rollups"] = ("run_id", lambda written: catalog.category_rollups(tables(written)))
    gone = {name: sorted((known - ids) | set(touched)) for name in OF_RUN}
    return store.commit(parts, gone, {"runs": touched})


def read_catalog(store: Store, version: int | None = None) -> dict[str, DataFrame]:
    """All tables of a version of the catalog."""
    return {name: store.read(name, version=version).drop("bucket", "part") for name in store.manifest(version)["tables"]}


def ingest_runs(spark: SparkSession, run_ids: list[str], load: Callable[[str], tuple[DataFrame, DataFrame, DataFrame]], root: str, now: Column | None = None) -> DataFrame:
    """Ingest run after run into one catalog; one that breaks leaves a failed row with its error and the version before it, and does not stop the others.

    load(run_id) returns (results, texts, runs). The log has one row for each run asked for and is appended to root/ingestions.
    """
    log, store = [], Store(spark, f"{root}/catalog")
    for i, run in enumerate(run_ids):
        try:
            results, texts, runs = load(run)
            version = commit_runs(store, results, texts, runs, now)
            n = store.read("sites", [run]).count() if store.has("sites") else 0
            log.append((f"{run}-{i}", run, "completed", n, 0, None, version))
        except Exception as e:  # noqa: BLE001  the log says what broke
            log.append((f"{run}-{i}", run, "failed", 0, 1, str(e)[:500], None))
    df = spark.createDataFrame(log, "ingestion_id string, run_id string, status string, processed_sites long, error_count int, error string, version long")
    df.coalesce(1).write.mode("append").json(f"{root}/ingestions")
    return df


def run_reports(results: DataFrame) -> dict[str, DataFrame]:
    """The summary and the figure tables of a run's records."""
    s = summary
    return {"overview": s.overview(results), "status": s.status_counts(results), "third_parties": s.third_party_counters(results), "categories": s.category_coverage(results), "site_categories": s.site_categories(results), "entities": s.entities(results), "figure_overview": s.figure_overview(results), "heatmap": s.density_heatmap(results), "figure_entities": s.figure_entities(results), "distribution": s.figure_distribution(results)}


def run_state(overview: DataFrame, total_sites: int, status: str = "completed") -> DataFrame:
    """The state record of a run, from its overview."""
    return overview.select(F.lit(status).alias("status"), F.lit(total_sites).cast("int").alias("total_sites"), F.col("processed_sites").cast("int").alias("processed_sites"), F.col("last_processed_rank").cast("int").alias("last_processed_rank"), F.col("last_successful_rank").cast("int").alias("last_successful_rank"))
