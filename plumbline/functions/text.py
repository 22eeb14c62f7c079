"""Text functions as native column expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import constants as K


def any_of(text: Column, needles: list[str]) -> Column:
    """Whether text contains one of the literals; false for null."""
    return F.coalesce(text.rlike("|".join(rf"\Q{n}\E" for n in needles)), F.lit(False))


def text_or_null(value: Column) -> Column:
    return F.when(F.trim(value) != "", F.trim(value))


def word_count(text: Column) -> Column:
    """Whitespace-separated tokens that hold a letter, digit or underscore; null counts 0."""
    tokens = F.split(F.coalesce(text, F.lit("")), r"\s+")
    return F.size(F.filter(tokens, lambda t: t.rlike(r"[\p{L}\p{N}_]")))


def space_words(text: Column) -> Column:
    """Whitespace-separated tokens."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != ""))


def english_share(text: Column) -> Column:
    """Share of English stop words among lower-case ASCII words of two letters or more; null below 80 words."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w.rlike("^[a-z]{2,}$"))
    known = F.array(*[F.lit(w) for w in K.ENGLISH_WORDS if len(w) > 1])
    of = lambda ws: F.when(F.size(ws) >= 80, F.size(F.filter(ws, lambda w: F.array_contains(known, w))) / F.size(ws))
    return F.get(F.transform(F.array(words), of), F.lit(0))


def is_english(text: Column, least: float = 0.07) -> Column:
    """Short texts pass; null is null."""
    return F.when(text.isNotNull(), F.coalesce(english_share(text) >= least, F.lit(True)))


def policy_score(text: Column) -> Column:
    """min(words / 400, 6) + 1.2 for each of at most 6 terms - 1.5 for cookie-only texts."""
    t = F.lower(text)
    hits = reduce(lambda a, b: a + b, [F.contains(t, F.lit(x)).cast("int") for x in K.POLICY_TERMS])
    cookie_only = F.contains(t, F.lit("cookie")) & ~any_of(t, ["privacy", "datenschutz", "confidential"])
    return F.least(space_words(t) / 400.0, F.lit(6.0)) + F.least(hits, F.lit(6)) * 1.2 - F.when(cookie_only, 1.5).otherwise(0.0)


def policy_likeliness(text: Column) -> Column:
    """policy_score; -10 for no text."""
    return F.when(F.coalesce(text, F.lit("")) == "", -10.0).otherwise(policy_score(text))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def document_id(scope: Column, url: Column, digest: Column) -> Column:
    return F.sha2(F.concat_ws("|", scope, F.coalesce(url, F.lit("")), digest), 256)


def policy_language(english: Column) -> Column:
    return F.when(english, "en").when(~english, "other")


def mapping_source(radar_file: Column, pattern_file: Column, org_file: Column) -> Column:
    has = lambda c: F.coalesce(c != "", F.lit(False))
    return F.when(has(radar_file), "tracker_radar").when(has(pattern_file) | has(org_file), "trackerdb")


def safe_dirname(name: Column) -> Column:
    return F.substring(F.regexp_replace(name, r"[^\p{L}\p{N}\-_.]", "_"), 1, 200)


def combine_errors(*messages: Column) -> Column:
    kept = F.filter(F.array(*messages), lambda m: F.trim(m) != "")
    return F.when(F.size(kept) > 0, F.array_join(kept, " | "))


def string_list(values: Column) -> Column:
    """Trimmed, without blanks, each once in order."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: v != ""))


def decode_list(json: Column) -> Column:
    """JSON array of strings; anything else is empty."""
    return F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))


def to_bool(value: Column) -> Column:
    v = F.lower(F.trim(value.cast("string")))
    return F.when(v.isin("true", "1", "yes"), True).when(v.isin("false", "0", "no"), False)


def estimate_tokens(amount: Column, unit: Column) -> Column:
    """Of tokens, words (times 1.33), kilobytes (times 256) or characters (a quarter); negative amounts count as 0."""
    v = F.greatest(amount.cast("double"), F.lit(0.0))
    return F.floor(F.when(unit == "tokens", v).when(unit == "words", v * 1.33).when(unit == "kb", v * 1024 / 4).otherwise(v / 4) + 0.5)


def match_count(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of a literal, whatever its case; an empty needle has none."""
    low, n = F.lower(F.coalesce(text, F.lit(""))), F.lower(needle)
    return F.when(F.coalesce(n, F.lit("")) == "", 0).otherwise(((F.length(low) - F.length(F.replace(low, n, F.lit("")))) / F.length(n)).cast("int"))


def format_eta(ms: Column) -> Column:
    """Rounded seconds as 1h 02m, 3m 04s or 5s; 0s for null and for no time left."""
    s = F.floor(F.coalesce(F.greatest(ms, F.lit(0)), F.lit(0)) / 1000 + 0.5).cast("long")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(h > 0, F.format_string("%dh %02dm", h, m)).when(m > 0, F.format_string("%dm %02ds", m, s % 60)).otherwise(F.format_string("%ds", s))


def status_label(status: Column) -> Column:
    """How a site's status is shown; unknown ones as they are."""
    shown = status
    for name, label in K.STATUS_LABELS.items():
        shown = F.when(status == name, label).otherwise(shown)
    return shown


def looks_like_html(html: Column, need_link: bool = False) -> Column:
    ok = F.coalesce(html.rlike(K.HTML_MARK), F.lit(False))
    return ok & F.coalesce(html.rlike(r"(?is)<\s*a\b"), F.lit(False)) if need_link else ok


def non_browsable_reason(status_code: Column, text: Column, links: Column) -> Column:
    """First rule that a page meets: an HTTP error, an error text, no links and short, very sparse; else null."""
    t = F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\n\r"))
    error = F.lower(t).rlike("|".join(K.ERROR_PAGES))
    n = F.coalesce(links, F.lit(0))
    return F.when(status_code >= 400, F.concat(F.lit("http_status_"), status_code.cast("string"))).when(error, "error_page_text").when((F.length(t) < 200) & (n == 0), "no_links_short_text").when((F.length(t) < 80) & (n <= 1), "very_sparse_page")


def is_policy_candidate(ok: Column, score: Column, size: Column) -> Column:
    s, n = F.coalesce(score, F.lit(-10.0)), F.coalesce(size, F.lit(0))
    return F.coalesce(ok, F.lit(False)) & (((s >= 5) & (n >= 300)) | ((s >= 4) & (n >= 500)) | ((s >= 3) & (n >= 800)))


def site_status(home_ok: Column, has_policy: Column, reason: Column, error: Column) -> Column:
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return F.when(F.coalesce(error, F.lit("")) != "", "exception").when(no(home_ok), "home_fetch_failed").when(no(has_policy) & reason.isNotNull(), "non_browsable").when(no(has_policy), "policy_not_found").otherwise("ok")


def site_error(status: Column, error: Column, stage: Column) -> tuple[Column, Column]:
    """Error code and stage of a status: timeouts have a code of their own, other exceptions none; only exceptions have a stage."""
    broke = status == "exception"
    code = F.when(broke & F.startswith(error, F.lit("site_timed_out_after_")), "site_timeout").when(~broke & (status != "ok"), status)
    return code, F.when(broke, stage)


def _rounded(c: Column) -> Column:
    return F.floor(c + 0.5)


def annotation_cost(amount: Column, unit: Column, model: Column | None = None, token_limit: int = 500, exhaustion_check: bool = True) -> dict[str, Column]:
    """Tokens, chunks, and low, typical and high prompt and output tokens and dollars of annotating a text of so many units.

    A chunk brings 0.78 of the token limit in new text. Every chunk adds a prompt and, where the
    check for exhausted chunks is on, 0.45 further calls. Unknown models cost what the default one does.
    """
    tokens = F.greatest(F.lit(1).cast("long"), estimate_tokens(amount, unit))
    per_chunk = max(120, math.floor(max(100, token_limit) * 0.78 + 0.5))
    chunks = F.greatest(F.lit(1).cast("long"), F.ceil(tokens / per_chunk))
    out = {"tokens": tokens, "chunks": chunks}
    default = K.MODEL_PRICES["gpt-4o-mini"]
    price = [F.lit(default[side]) for side in (0, 1)]
    if model is not None:
        price = [F.coalesce(F.create_map(*[F.lit(x) for m, p in K.MODEL_PRICES.items() for x in (m, p[side])])[model], F.lit(default[side])) for side in (0, 1)]
    for band, (factor, prompt, call, share) in K.COST_BANDS.items():
        more = prompt + (math.floor(0.45 * call + 0.5) if exhaustion_check else 0)
        out[f"tokens_in_{band}"] = _rounded(tokens * factor + chunks * more)
        out[f"tokens_out_{band}"] = _rounded(tokens * share)
        out[f"usd_{band}"] = out[f"tokens_in_{band}"] / 1e6 * price[0] + out[f"tokens_out_{band}"] / 1e6 * price[1]
    return out
