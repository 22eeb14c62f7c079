"""Sources: result records, lists, texts, markers, tracker indexes and events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.schemas import schema


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Site records as JSON lines; lines that are no object are dropped."""
    return spark.read.schema(schema("site_result")).option("mode", "DROPMALFORMED").json(path)


def read_jsonl_lenient(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """JSON lines with _error and raw where a line can't be read."""
    df = spark.read.schema(f"{fields}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return df.withColumns({"_error": F.when(F.col("_corrupt").isNotNull(), "invalid_json"), "raw": F.col("_corrupt")}).drop("_corrupt")


def numbered(df: DataFrame) -> DataFrame:
    """df with seq, the number of the row from 1 without gaps. The driver gets one count for each partition."""
    df = df.withColumn("__at", F.monotonically_increasing_id())  # partition in the upper bits, row in the lower 33
    part = F.shiftright("__at", 33)
    sizes = {r.p: r.n for r in df.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = {}, 0
    for p in sorted(sizes):
        before[p] = total
        total += sizes[p]
    first = F.create_map(*[F.lit(x).cast("long") for item in before.items() for x in item])[part] if before else F.lit(0)
    return df.withColumn("seq", first + F.col("__at") - F.shiftleft(part, 33) + 1).drop("__at")


def read_site_csv(spark: SparkSession, path: str) -> DataFrame:
    """Site list with a header, every column as text; seq is the row's number in the file, from 1."""
    df = numbered(spark.read.option("header", True).csv(path))
    names = [f.name for f in schema("site_csv").fields]
    return df.select("seq", *[(F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in names])


def read_site_lines(spark: SparkSession, path: str) -> DataFrame:
    """One site a line, without blanks and # comments."""
    df = spark.read.text(path).select(F.monotonically_increasing_id().alias("seq"), F.trim("value").alias("site"))
    return df.where("site <> '' and not startswith(site, '#')")


def read_policy_texts(spark: SparkSession, root: str) -> DataFrame:
    """<site>/policy.txt and <site>/third_party/<service>/policy.txt under root."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "policy.txt").text(root, wholetext=True).select("value", F.col("_metadata.file_path").alias("p"))
    service = F.nullif(F.regexp_extract("p", r"/third_party/([^/]+)/policy\.txt$", 1), F.lit(""))
    site = F.when(service.isNull(), F.regexp_extract("p", r"/([^/]+)/policy\.txt$", 1)).otherwise(F.regexp_extract("p", r"/([^/]+)/third_party/[^/]+/policy\.txt$", 1))
    return df.select(site.alias("site_etld1"), service.alias("service_domain"), F.col("value").alias("text"))


def _json_files(spark: SparkSession, root: str, name: str, fields: str) -> DataFrame:
    df = spark.read.schema(fields).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).json(root)
    return df.select("*", F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1).alias("dir"))


def read_run_metadata(spark: SparkSession, root: str) -> DataFrame:
    """One row for each run folder: summary, state and manifest files, in this order of precedence."""
    fields = "run_id string, status string, mode string, total_sites int, started_at string, updated_at string"
    names = [c.split()[0] for c in fields.split(", ")]
    parts = [_json_files(spark, root, f, fields).select("dir", *[F.col(c).alias(f"{c}_{i}") for c in names]) for i, f in enumerate(("results.summary.json", "run_state.json", "dashboard_run_manifest.json"))]
    df = reduce(lambda a, b: a.join(b, "dir", "full"), parts)
    return df.select(F.col("dir").alias("out_dir"), *[F.coalesce(*[f"{c}_{i}" for i in range(3)]).alias(c) for c in names])


def list_runs(runs: DataFrame) -> DataFrame:
    """Runs that say who they are or are named output_*, newest first."""
    return runs.where("run_id is not null or startswith(out_dir, 'output_')").withColumn("run_id", F.coalesce("run_id", "out_dir")).orderBy(F.desc_nulls_last("updated_at"), "run_id")


def read_tracker_index(spark: SparkSession, path: str, source: str = "source_domain_file string") -> DataFrame:
    """A JSON object of domain to entry as rows."""
    entry = f"struct<entity:string,categories:array<string>,prevalence:double,policy_url:string,{source.replace(' ', ':')}>"
    df = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{entry}>")).alias("etld1", "e"))
    return df.select(F.lower("etld1").alias("etld1"), "e.*")


def read_tree(spark: SparkSession, root: str, name: str = "*.json") -> DataFrame:
    """Files under root as (path, text), paths from root on; for the trees that the tracker indexes are built from."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(root, wholetext=True)
    tail = root.rstrip("/").rsplit("/", 1)[-1]
    return df.select(F.substring_index(F.col("_metadata.file_path"), f"/{tail}/", -1).alias("path"), F.col("value").alias("text"))


def read_suffix_list(spark: SparkSession, path: str, private: bool = False) -> DataFrame:
    """Rules of a public suffix list file, without comments; those of private registries only on request."""
    text = spark.read.text(path, wholetext=True).select(F.col("value") if private else F.regexp_replace("value", r"(?s)// ===BEGIN PRIVATE DOMAINS===.*?(// ===END PRIVATE DOMAINS===|\z)", "").alias("value"))
    rules = text.select(F.explode(F.split("value", r"\r?\n")).alias("line")).select(F.regexp_extract("line", r"^\s*(\S*)", 1).alias("rule"))
    return rules.where("rule <> '' and not startswith(rule, '//')")


def read_network_requests(df: DataFrame) -> DataFrame:
    """Requests and failed requests with a URL, from (site_url, network_requests array)."""
    r = df.select("site_url", F.explode("network_requests").alias("r")).select("site_url", "r.url", "r.event_type")
    return r.where(F.col("event_type").isin("request", "request_failed") & F.col("url").isNotNull())


def distinct_http_urls(http_requests: DataFrame) -> DataFrame:
    return http_requests.select("url").where("url rlike '^https?://'").distinct()


def read_markers(spark: SparkSession, root: str) -> DataFrame:
    """Sites with a scrape or annotation marker in their folder."""
    fields = "status string, policy_is_english boolean"
    s = _json_files(spark, root, "scrape_complete.json", fields).select(F.col("dir").alias("site"), F.lit(True).alias("scraped"), "policy_is_english")
    a = _json_files(spark, root, "annotation_complete.json", fields).select(F.col("dir").alias("site"), F.lit(True).alias("annotated"))
    return s.join(a, "site", "full").select("site", F.coalesce("scraped", F.lit(False)).alias("scraped"), F.coalesce("annotated", F.lit(False)).alias("annotated"), "policy_is_english")


def read_statements(spark: SparkSession, root: str) -> DataFrame:
    """Statement files of a tree of policies: base (folder from root on), site, tp, annotated, seq, chunk_index, source_text, statement (JSON).

    A folder with an annotated file gives its lines, others the plain file's; Spark's readers leave out files of no byte, so an
    empty annotated file counts as none. Lines that
    are no object or lack a statement are dropped; a chunk_index that is no number is 0.
    """
    tail = root.rstrip("/").rsplit("/", 1)[-1]
    folder = lambda path: F.regexp_extract(F.substring_index(path, f"/{tail}/", -1), r"^(.*?)/?[^/]*$", 1)
    tree = lambda kind, name: spark.read.format(kind).option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root)
    have = tree("binaryFile", "policy_statements_annotated.jsonl").select(folder(F.col("path")).alias("base")).distinct()
    path = F.col("_metadata.file_path")
    lines = tree("text", "policy_statements*.jsonl").select("value", folder(path).alias("base"), F.endswith(path, F.lit("_annotated.jsonl")).alias("annotated"), F.monotonically_increasing_id().alias("seq"))
    kept = lines.where("annotated").unionByName(lines.where("not annotated").join(have, "base", "left_anti"))
    value = F.expr("try_parse_json(value)")
    part = lambda name, kind: F.try_variant_get(value, f"$.{name}", kind)
    rows = kept.select("base", F.regexp_extract("base", "^([^/]*)", 1).alias("site"), F.nullif(F.regexp_extract("base", "/third_party/([^/]+)$", 1), F.lit("")).alias("tp"), "annotated", "seq", F.coalesce(part("chunk_index", "int"), F.lit(0)).alias("chunk_index"), F.coalesce(part("source_text", "string"), F.lit("")).alias("source_text"), F.to_json(part("statement", "variant")).alias("statement"))
    return rows.where("statement is not null and statement not in ('null', 'false', '0', '\"\"')")


def preferred_statements(annotated: DataFrame, base: DataFrame) -> DataFrame:
    """Annotated statements, and the plain ones of policies that have none; lines without a statement are dropped."""
    have = annotated.select("doc_id").distinct()
    return annotated.unionByName(base.join(have, "doc_id", "left_anti"), allowMissingColumns=True).where("statement is not null")
