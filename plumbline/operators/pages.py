"""Pages: links, candidate policies, main text, site status and assembled site records."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import constants as K
from plumbline.functions import html, urls
from plumbline.functions import text as X
from plumbline.operators.domains import with_domain

_ANCHOR = r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]*)[^>]*>(.*?)</a\s*>"
_FOOTER = r"(?is)<footer\b.*?</footer\s*>"


def parse_links(pages: DataFrame) -> DataFrame:
    """extract_links by a parser that keeps a stack of open elements: for nested footers, quoted > and entities."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(url, i, *x) for url, h in zip(b["url"], b["html"], strict=True) for i, x in enumerate(html.links(h))]
            yield pd.DataFrame(found, columns=["url", "ord", "source", "anchor", "href"])

    df = pages.select("url", "html").mapInPandas(run, "url string, ord int, source string, anchor string, href string")
    return _usable(df.withColumn("href", urls.clean_href(F.col("href"))))


def _usable(links: DataFrame) -> DataFrame:
    return links.where("href is not null").withColumn("target", urls.join_url(F.col("url"), F.col("href"))).where(urls.is_http(F.col("target")))


def extract_links(pages: DataFrame) -> DataFrame:
    """url, ord, source, anchor, href, target: links of the footer first, then those of the rest; unusable ones are left out.

    The native form, by regular expressions; parse_links is the strict one.
    """
    foot = F.array_join(F.regexp_extract_all("html", F.lit(_FOOTER), F.lit(0)), " ")
    rest = F.regexp_replace("html", _FOOTER, " ")
    found = lambda part, name: F.transform(F.regexp_extract_all(part, F.lit(_ANCHOR), F.lit(0)), lambda a: F.struct(F.lit(name).alias("source"), F.regexp_extract(a, _ANCHOR, 1).alias("href"), urls.squeeze(F.regexp_replace(F.regexp_extract(a, _ANCHOR, 2), r"<[^>]*>", " ")).alias("anchor")))
    df = pages.select("url", F.posexplode(F.concat(found(foot, "footer"), found(rest, "body"))).alias("ord", "a"))
    df = df.select("url", "ord", "a.source", "a.anchor", urls.clean_href(F.col("a.href")).alias("href"))
    return _usable(df)


def link_candidates(pages: DataFrame, rules: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Links that may be policies, scored; of one target the best, the earlier on ties. Domains by the rules of a suffix list, where given; strict reads pages by parse_links."""
    df = with_domain(with_domain(parse_links(pages) if strict else extract_links(pages), F.col("url"), "site_domain", rules), F.col("target"), "target_domain", rules)
    df = df.withColumn("same_site", F.coalesce(F.col("target_domain") == F.col("site_domain"), F.lit(False)))
    df = df.where(urls.allow_external(F.col("site_domain"), F.col("target"), F.col("anchor"), F.col("source"), F.col("target_domain")))
    df = df.withColumn("score", urls.score_link(F.col("anchor"), F.col("target"), F.col("same_site")))
    best = F.row_number().over(Window.partitionBy("url", "target").orderBy(F.desc("score"), "ord"))
    return df.withColumn("__at", best).where("__at = 1").select("url", "target", "anchor", "source", "same_site", "score", "ord")


def hub_links(candidates: DataFrame, k: int = 3) -> DataFrame:
    """The first k candidates of each page, by score, that lead to legal pages."""
    df = candidates.where(urls.is_hub(F.col("anchor"), F.col("target")))
    at = F.row_number().over(Window.partitionBy("url").orderBy(F.desc("score"), "ord"))
    return df.withColumn("hub_no", at).where(F.col("hub_no") <= k)


def fallback_candidates(pages: DataFrame) -> DataFrame:
    """Common policy paths of every site, at score 2.8."""
    paths = F.posexplode(F.array(*[F.lit(p) for p in K.PRIVACY_PATHS])).alias("ord", "path")
    return pages.select("url", paths).select("url", "ord", urls.join_url(F.col("url"), F.col("path")).alias("target"), F.lit(2.8).alias("score"))


def choose_policy(fetched: DataFrame) -> DataFrame:
    """Of each site's fetched candidates (url, target, ord, source, ok, score, text_len): in order the first good one, else the best acceptable one."""
    score = F.col("score") + F.when(F.col("source") == "hub", 0.2).otherwise(0.0)
    good = X.is_policy_candidate(F.col("ok"), score, F.col("text_len"))
    fair = F.coalesce("ok", F.lit(False)) & (score >= 3) & (F.col("text_len") >= 200)
    a = fetched.groupBy("url").agg(F.min(F.when(good, F.struct("ord", "target"))).alias("first"), F.max(F.when(fair, F.struct(score.alias("s"), "text_len", (-F.col("ord")).alias("o"), "target"))).alias("best"))
    return a.select("url", F.coalesce("first.target", "best.target").alias("policy_target"), F.col("first").isNotNull().alias("is_good"))


def top_candidates(candidates: DataFrame, n: int = 25) -> DataFrame:
    """Of each page's candidates (url, target, score, ord, ...) the n best as one array, best first, the earlier on ties."""
    best = F.row_number().over(Window.partitionBy("url").orderBy(F.desc("score"), "ord"))
    fields = [c for c in candidates.columns if c not in ("url", "ord")]
    df = candidates.withColumn("at", best).where(F.col("at") <= n)
    return df.groupBy("url").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", *fields))), lambda c: F.struct(*[c[f].alias(f) for f in fields])).alias("candidates_top"))


def page_quality(pages: DataFrame) -> DataFrame:
    """url, text_len, n_links, is_html, reason (why it is not browsable, or null), likeliness: from each page's visible text and, where it is there, its status_code."""
    status = F.col("status_code") if "status_code" in pages.columns else F.lit(None).cast("int")
    text = visible_text(F.col("html"))
    links = F.regexp_count("html", F.lit(r"(?is)<a\b[^>]*\bhref\b"))
    df = pages.select("url", "html", status.alias("status"), text.alias("text"), links.alias("n_links"))
    return df.select("url", F.length("text").alias("text_len"), "n_links", X.looks_like_html(F.col("html")).alias("is_html"), X.non_browsable_reason(F.col("status"), F.col("text"), F.col("n_links")).alias("reason"), X.policy_likeliness(F.col("text")).alias("likeliness"))


def visible_text(source: Column) -> Column:
    """Text between tags, without scripts, styles and comments, space squeezed. A native form for measures; main_text parses."""
    bare = F.regexp_replace(source, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return urls.squeeze(F.regexp_replace(bare, r"<[^>]*>", " "))


def main_text(pages: DataFrame) -> DataFrame:
    """url, text, method: the first that is not blank of main elements, body text, all text, source without tags; null for a page without text."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [html.main_text(x) for x in b["html"]]
            yield pd.DataFrame({"url": b["url"], "text": [r[0] for r in rows], "method": [r[1] for r in rows]})

    return pages.select("url", "html").mapInPandas(run, "url string, text string, method string")


def site_status(homes: DataFrame, policies: DataFrame) -> DataFrame:
    """Status, error code and stage of each site from its home page (site, home_ok, reason, error and, where it is there, stage) and its policy (site, policy_url)."""
    df = homes.join(policies.select("site", F.col("policy_url").isNotNull().alias("has_policy")), "site", "left")
    df = df.withColumn("status", X.site_status(F.col("home_ok"), F.col("has_policy"), F.col("reason"), F.col("error")))
    code, stage = X.site_error(F.col("status"), F.col("error"), F.col("stage") if "stage" in homes.columns else F.lit(None).cast("string"))
    return df.select("site", "status", F.when(F.col("status") == "non_browsable", F.col("reason")).alias("non_browsable_reason"), code.alias("error_code"), stage.alias("error_stage"))


def assemble_records(status: DataFrame, policies: DataFrame, mapped: DataFrame, fetches: DataFrame) -> DataFrame:
    """One nested record for each site: its policy, its mapped third parties with their fetch method, its fetches with the lengths of raw and clean text. Of repeated fetches the one with the most text stays."""
    fields = [c for c in ("fetch_success", "status_code", "text_len", "text_len_raw", "extraction_method") if c in fetches.columns]
    f = fetches.groupBy("site", "third_party_etld1").agg(F.max(F.struct("text_len", *[c for c in fields if c != "text_len"])).alias("f")).select("site", "third_party_etld1", *[F.col(f"f.{c}").alias(c) for c in fields])
    tps = mapped.join(f.select("site", "third_party_etld1", F.col("extraction_method").alias("policy_extraction_method")), ["site", "third_party_etld1"], "left")
    nest = lambda df, name: df.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("third_party_etld1", *[c for c in df.columns if c not in ("site", "third_party_etld1")]))).alias(name))
    pol = policies.select("site", F.struct(*[c for c in policies.columns if c != "site"]).alias("first_party_policy"))
    return status.join(pol, "site", "left").join(nest(tps, "third_parties"), "site", "left").join(nest(f, "third_party_policy_fetches"), "site", "left")
