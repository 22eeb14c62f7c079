"""Tracker lists and the mapping of third parties to entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import urls
from plumbline.operators.domains import with_domain


def _lookup(index: DataFrame, name: str) -> DataFrame:
    return index.select("etld1", F.struct(*[c for c in index.columns if c != "etld1"]).alias(name)).dropDuplicates(["etld1"])


def map_third_parties(tps: DataFrame, radar: DataFrame, trackerdb: DataFrame) -> DataFrame:
    """Add the entry of the first list that has a domain, whole: a hit wins even where its fields are null."""
    fields = ["entity", "categories", "prevalence", "policy_url"]
    df = tps.join(_lookup(radar, "__r"), tps.third_party_etld1 == F.col("etld1"), "left").drop("etld1")
    df = df.join(_lookup(trackerdb, "__t"), df.third_party_etld1 == F.col("etld1"), "left").drop("etld1")
    hit_r, hit_t = F.col("__r").isNotNull(), F.col("__t").isNotNull()
    df = df.withColumns({f: F.when(hit_r, F.col(f"__r.{f}")).when(hit_t, F.col(f"__t.{f}")) for f in fields})
    return df.withColumn("mapping_source", F.when(hit_r, "tracker_radar").when(hit_t, "trackerdb")).drop("__r", "__t")


def mapping_mode(has_radar: bool, has_trackerdb: bool) -> str:
    return {(True, True): "mixed", (False, True): "trackerdb", (True, False): "radar", (False, False): "none"}[has_radar, has_trackerdb]


def site_entities(sites: DataFrame, radar: DataFrame, trackerdb: DataFrame) -> DataFrame:
    """(site_etld1, site_entity): the first list's entity that is not empty."""
    r = radar.select(F.col("etld1").alias("site_etld1"), F.nullif("entity", F.lit("")).alias("__r")).dropDuplicates(["site_etld1"])
    t = trackerdb.select(F.col("etld1").alias("site_etld1"), F.nullif("entity", F.lit("")).alias("__t")).dropDuplicates(["site_etld1"])
    return sites.select("site_etld1").distinct().join(r, "site_etld1", "left").join(t, "site_etld1", "left").select("site_etld1", F.coalesce("__r", "__t").alias("site_entity"))


def exclude_same_entity(mapped: DataFrame, entities: DataFrame) -> DataFrame:
    """Drop third parties of the site's own entity."""
    return mapped.join(entities, "site_etld1", "left").where(~F.coalesce(F.col("entity") == F.col("site_entity"), F.lit(False))).drop("site_entity")


def third_parties(requests: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Of (site_url, url, event_type): each site's third-party domains, sorted; by the rules of a suffix list, where given."""
    asked = requests.where(F.col("event_type").isin("request", "request_failed") & urls.is_http(F.col("url")))
    df = with_domain(with_domain(asked.select("site_url", "url"), F.col("site_url"), "site_etld1", rules), F.col("url"), "tp", rules)
    return df.where("tp is not null and not (tp <=> site_etld1)").distinct().groupBy("site_url", "site_etld1").agg(F.array_sort(F.collect_set("tp")).alias("third_parties"))


# Keys of a policy URL and of a nested prevalence in tracker files, in order of precedence.
POLICY_KEYS = ["privacyPolicy", "privacy_policy", "privacyPolicyUrl", "privacy_policy_url", "policyUrl", "policy_url", "policy"]
PREVALENCE_KEYS = ["total", "overall", "prevalence", "value"]


def _stem(path) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def _of_type(v: Column, at: str, types: str, cast: str) -> Column:
    """The value at a path of a variant if it is of one of the types, else null."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, at, "variant")).rlike(f"^({types})"), F.try_variant_get(v, at, cast))


def _string(v: Column, at: str) -> Column:
    return _of_type(v, at, "STRING", "string")


def _policy(v: Column, under: str = "") -> Column:
    """The first policy key of an object whose text begins with http."""
    found = [_string(v, f"${under}.{k}") for k in POLICY_KEYS]
    return F.coalesce(*[F.when(F.startswith(x, F.lit("http")), x) for x in found])


def _said(x: Column) -> Column:
    return F.when(x.rlike(r"\S"), x)


def _objects(files: DataFrame) -> DataFrame:
    """path, v: the files that hold a JSON object with anything in it."""
    df = files.select("path", F.try_parse_json("text").alias("v"))
    return df.where(F.schema_of_variant("v").rlike("^OBJECT<[^>]"))


def radar_index(domains: DataFrame, entities: DataFrame) -> DataFrame:
    """Index of domains from domain and entity files (path, text), both JSON; of files of one domain the last by path.

    The entity is the owner's name or display name, else the file's own entity. The policy URL is the
    domain's, its owner's, or that of the entity so found. Files that hold no object are left out.
    """
    v = F.col("v")
    e = _objects(entities).select("path", F.coalesce(_said(_string(v, "$.name")), _stem("path")).alias("entity"), F.coalesce(_policy(v), _policy(v, ".properties")).alias("policy"))
    e = e.where("policy is not null").groupBy("entity").agg(F.max_by("policy", "path").alias("__policy"))
    owner = F.coalesce(F.nullif(_string(v, "$.owner.name"), F.lit("")), _string(v, "$.owner.displayName"))
    texts = F.filter(F.try_variant_get(v, "$.categories", "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING")
    one = _string(v, "$.categories")
    categories = F.when(one.isNotNull(), F.array(one)).otherwise(F.coalesce(F.transform(texts, lambda x: F.try_variant_get(x, "$", "string")), F.array().cast("array<string>")))
    number = lambda at: _of_type(v, at, "BIGINT|DECIMAL|DOUBLE", "double")
    df = _objects(domains).select(
        F.lower(F.coalesce(_said(_string(v, "$.domain")), _stem("path"))).alias("etld1"), F.coalesce(_said(owner), _string(v, "$.entity")).alias("entity"), categories.alias("categories"),
        F.coalesce(number("$.prevalence"), *[number(f"$.prevalence.{k}") for k in PREVALENCE_KEYS]).alias("prevalence"), F.coalesce(_policy(v), _policy(v, ".owner")).alias("own_policy"), F.col("path").alias("source_domain_file"),
    )
    df = df.groupBy("etld1").agg(F.max_by(F.struct(*df.columns[1:]), "source_domain_file").alias("d")).select("etld1", "d.*")
    return df.join(e, "entity", "left").select("etld1", "entity", "categories", "prevalence", F.coalesce("own_policy", "__policy").alias("policy_url"), "source_domain_file")


def _sections(files: DataFrame) -> DataFrame:
    """path, slug, own (lines outside of sections), domains (lines of the sections of that name) of files in the eno form.

    A line "--- name" opens a section, or closes it where it is the open one.
    """
    lines = F.filter(F.transform(F.split("text", r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    df = files.select("path", _stem("path").alias("slug"), lines.alias("lines"))
    numbered = F.transform("lines", lambda x, i: F.struct((i + 1).alias("at"), F.regexp_extract(x, r"^---\s*(.*)$", 1).alias("name"), F.startswith(x, F.lit("---")).alias("mark")))
    start = F.array(F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("name")))

    def turn(states: Column, m: Column) -> Column:
        opened = F.when(~F.element_at(states, -1)["name"].eqNullSafe(m["name"]), m["name"])
        return F.concat(states, F.array(F.struct(m["at"].alias("at"), opened.alias("name"))))

    df = df.withColumn("states", F.aggregate(F.filter(numbered, lambda m: m["mark"]), start, turn))
    until = lambda i: F.coalesce(F.get("states", i + 1)["at"], F.size("lines") + 1)
    parts = F.transform("states", lambda s, i: F.struct(F.coalesce(s["name"], F.lit("")).alias("name"), F.slice("lines", s["at"] + 1, until(i) - s["at"] - 1).alias("lines")))
    of = lambda name: F.flatten(F.transform(F.filter(parts, lambda p: p["name"] == name), lambda p: p["lines"]))
    return df.select("path", "slug", of("").alias("own"), of("domains").alias("domains"))


def _value(key: str) -> Column:
    """The last value of a key among a file's own lines; null where it is empty."""
    pattern = rf"^{key}\s*:\s*(.*)$"
    held = F.filter("own", lambda x: x.rlike(pattern))
    return F.nullif(F.regexp_extract(F.get(held, F.size(held) - 1), pattern, 1), F.lit(""))


def trackerdb_index(patterns: DataFrame, organizations: DataFrame, categories: DataFrame) -> DataFrame:
    """Index of registrable domains from pattern, organisation and category files (path, text) in the eno form.

    A file is named by its stem where it gives no name, a category without a file by its slug.
    Each domain gets its files' first value that is not empty, in path order, and all their
    categories once. The small organisation and category files join by slug.
    """
    org = _sections(organizations).select(F.col("slug").alias("org"), F.coalesce(_value("name"), "slug").alias("org_name"), F.coalesce(_value("privacy_policy_url"), _value("privacyPolicyUrl")).alias("org_policy"), F.col("path").alias("org_file")).dropDuplicates(["org"])
    cat = _sections(categories).select(F.col("slug").alias("category"), F.coalesce(_value("name"), "slug").alias("category_name")).dropDuplicates(["category"])
    rows = _sections(patterns).select("path", "slug", _value("name").alias("name"), _value("organization").alias("org"), _value("category").alias("category"), F.explode("domains").alias("domain"))
    rows = rows.withColumn("domain", F.regexp_replace(F.lower("domain"), r"^\*\.", "")).where("domain <> ''")
    rows = rows.withColumn("etld1", F.coalesce(urls.registrable_domain(F.col("domain")), "domain")).join(org, "org", "left").join(cat, "category", "left")
    rows = rows.withColumns({"entity": F.coalesce("org_name", "name", "slug"), "category_name": F.coalesce("category_name", "category")})
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("path")))
    names = F.array_distinct(F.transform(F.array_sort(F.collect_set(F.when(F.col("category_name").isNotNull(), F.struct("path", "category_name")))), lambda x: x["category_name"]))
    return rows.groupBy("etld1").agg(first("entity").alias("entity"), names.alias("categories"), F.lit(None).cast("double").alias("prevalence"), first("org_policy").alias("policy_url"), F.min("path").alias("source_pattern_file"), first("org_file").alias("source_org_file"))


def fetch_plan(tps: DataFrame, n: int = 30) -> DataFrame:
    """Which policy URLs of a site to fetch: one leader for each normalised URL (largest prevalence, then name), the first n leaders; members follow their leader."""
    df = tps.withColumn("url_key", F.nullif(urls.normalize_policy_url(F.col("policy_url")), F.lit(""))).where("url_key is not null")
    order = [F.desc(F.coalesce("prevalence", F.lit(-1.0))), F.asc("third_party_etld1")]
    df = df.withColumn("__at", F.row_number().over(Window.partitionBy("site_etld1", "url_key").orderBy(*order)))
    lead = df.where("__at = 1").withColumn("fetch_no", F.row_number().over(Window.partitionBy("site_etld1").orderBy(*order)))
    lead = lead.where(F.col("fetch_no") <= n).select("site_etld1", "url_key", F.col("third_party_etld1").alias("leader"), "fetch_no")
    return df.join(lead, ["site_etld1", "url_key"]).select("site_etld1", "third_party_etld1", "url_key", "leader", "fetch_no")
