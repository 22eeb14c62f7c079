"""URL functions as native column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import constants as K
from plumbline.functions.text import any_of

_PARTS = r"^\s*(?:([A-Za-z][A-Za-z0-9+.\-]*):)?//(?:[^/?#@]*@)?([^/?#:]*)(?::(\d*))?([^?#;]*)(?:;[^?#]*)?(\?[^#]*)?"


def _let(value: Column, body) -> Column:
    """body of a value that is computed once; also keeps long expressions out of the generated code."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, _PARTS, n)


def hostname(url: Column) -> Column:
    return F.nullif(F.lower(_part(url, 2)), F.lit(""))


def path(url: Column) -> Column:
    return F.when(_part(url, 4) == "", "/").otherwise(_part(url, 4))


def host_of(value: Column) -> Column:
    """Host of a URL, or of a text that begins with one; lower case, without dots at its ends; null if there is none."""
    bare = F.regexp_replace(F.regexp_extract(F.trim(value), r"^([^/?#:]+)", 1), r"^\.+|\.+$", "")
    return F.coalesce(hostname(value), F.nullif(F.lower(bare), F.lit("")))


def tails(host: Column) -> Column:
    """A host's own suffixes, from its last label to the whole host; none of an IPv4 address."""
    labels = F.split(host, r"\.")
    every = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    return F.when(host.rlike(r"^[\d.]+$"), F.array().cast("array<string>")).otherwise(every)


def suffix_labels(tail: Column, rule: Column) -> Column:
    """How many labels the public suffix has by a rule that holds for a host's tail: a rule names the tail itself (plain, !) or what stands before its first label (*.)."""
    n = F.size(F.split(tail, r"\."))
    return F.when(F.startswith(rule, F.lit("!")), n - 1).otherwise(n)


def registrable_domain(value: Column, rules: list[str] | None = None) -> Column:
    """The last labels of a host or URL up to one before its public suffix; a bare suffix or an address is itself; null without a host.

    Of the rules that hold an exception wins, then the longest; without one the suffix is one
    label. For short lists of rules; operators.domains joins whole lists.
    """
    rules = K.SUFFIX_RULES if rules is None else rules
    plain = [r for r in rules if r[0] not in "*!"]
    wild, out = ([r.removeprefix(p) for r in rules if r.startswith(p)] for p in ("*.", "!"))
    some = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")

    def of(host: Column) -> Column:
        every = tails(host)
        held = lambda keep: F.array_max(F.transform(F.filter(every, keep), lambda t: F.size(F.split(t, r"\."))))
        exception = held(lambda t: F.array_contains(some(out), t)) - 1
        longest = held(lambda t: F.array_contains(some(plain), t) | (F.array_contains(some(wild), F.regexp_replace(t, r"^[^.]*\.", "")) & F.contains(t, F.lit("."))))
        n = F.coalesce(exception, longest, F.lit(1))
        return F.when(host.isNull() | (F.size(every) <= n), host).otherwise(F.get(every, n))

    return _let(host_of(value), of)


def normalize_policy_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port, fragment, user or parameters; path / when empty; without a host as it is."""
    raw = F.trim(F.coalesce(url, F.lit("")))
    scheme = F.when(_part(raw, 1) == "", "https").otherwise(F.lower(_part(raw, 1)))
    port = _part(raw, 3)
    plain = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    query = F.when(_part(raw, 5) == "?", "").otherwise(_part(raw, 5))
    whole = F.concat(scheme, F.lit("://"), F.lower(_part(raw, 2)), F.when(plain, "").otherwise(F.concat(F.lit(":"), port)), path(raw), query)
    return F.when(_part(raw, 2) == "", raw).otherwise(whole)


def origin(site: Column) -> Column:
    """Scheme and host of a site; https where it names no scheme."""
    full = F.when(site.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), site).otherwise(F.concat(F.lit("https://"), site))
    return F.when(F.coalesce(F.trim(site), F.lit("")) != "", F.concat(F.lower(_part(full, 1)), F.lit("://"), hostname(full)))


def clean_href(href: Column) -> Column:
    h = F.trim(href)
    return F.when((h != "") & ~h.rlike(r"^(mailto:|tel:|javascript:|#)"), h)


_REFERENCE = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def _folded(segments: Column) -> Column:
    """Path of segments in which .. takes away what stands before it and . nothing."""
    def step(done: Column, s: Column) -> Column:
        return F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.concat(done, F.array(s)))

    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    last = F.element_at(segments, -1)
    joined = F.array_join(F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")
    return F.when(F.startswith(joined, F.lit("/")), joined).otherwise(F.concat(F.lit("/"), joined))


def join_url(base: Column, href: Column) -> Column:
    """Resolve a reference against a base URL as RFC 3986, section 5.2 has it: a fold over the path's segments.

    A reference with the base's scheme and no host counts as relative; one with another scheme or with a host
    keeps its path as it is; empty segments inside a joined path and empty queries or
    fragments go; an empty reference is the base.
    """
    part = lambda url, n: F.regexp_extract(url, _REFERENCE, n)

    def of(x: Column) -> Column:
        b, r = x["b"], x["r"]
        scheme, path = F.lower(b["scheme"]), r["path"]
        tail = F.concat(F.nullif(r["query"], F.lit("?")), F.lit(""))
        query, fragment = F.coalesce(tail, F.lit("")), F.coalesce(F.nullif(r["fragment"], F.lit("#")), F.lit(""))
        root = F.concat(scheme, F.lit("://"), b["host"])
        other = (r["scheme"] != "") & (F.lower(r["scheme"]) != scheme)
        own, theirs = F.split(b["path"], "/"), F.split(path, "/")
        beside = F.concat(F.when(b["path"] == "", F.array(F.lit(""))).otherwise(F.slice(own, F.lit(1), F.greatest(F.size(own) - 1, F.lit(0)))), theirs)
        inner = F.filter(F.slice(beside, 2, F.greatest(F.size(beside) - 2, F.lit(0))), lambda s: s != "")
        beside = F.concat(F.slice(beside, 1, 1), inner, F.slice(beside, -1, 1))
        at = F.when(F.startswith(path, F.lit("/")), theirs).otherwise(beside)
        same_path = F.concat(root, b["path"], F.when(query == "", F.coalesce(F.nullif(b["query"], F.lit("?")), F.lit(""))).otherwise(query), fragment)
        with_host = F.concat(scheme, F.lit("://"), r["host"], path, query, fragment)
        return F.when(r["whole"] == "", b["whole"]).when(other, r["whole"]).when(r["host"] != "", with_host).when(path == "", same_path).otherwise(F.concat(root, _folded(at), query, fragment))

    def parts(url: Column) -> Column:
        clean = F.regexp_replace(F.trim(url), r"[\t\r\n]", "")
        names = ("scheme", "host", "path", "query", "fragment")
        return F.struct(clean.alias("whole"), *[part(clean, i).alias(n) for i, n in enumerate(names, 1)])

    return _let(F.struct(parts(base).alias("b"), parts(href).alias("r")), of)


def is_http(url: Column) -> Column:
    return F.coalesce(url.rlike(r"(?i)^https?:"), F.lit(False))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def score_link(anchor: Column, url: Column, same_site: Column) -> Column:
    """How likely a link leads to a privacy policy."""
    add = lambda cond, v: F.when(cond, v).otherwise(0.0)
    t, u = F.lower(squeeze(anchor)), F.lower(url)
    return add(any_of(u, K.URL_SIGNALS), 5.0) + add(any_of(u, ["cookie"]), -1.0) + add(any_of(t, K.PRIVACY_WORDS), 4.0) + add(any_of(t, K.COOKIE_WORDS), -0.5) + add(any_of(u, K.NOT_POLICY_URL), -2.0) + F.when(same_site, 0.8).otherwise(-0.8)


def is_hub(anchor: Column, url: Column) -> Column:
    return any_of(F.lower(anchor), K.HUB_WORDS) | any_of(F.lower(url), K.HUB_URL_WORDS)


def allow_external(site_domain: Column, url: Column, anchor: Column, source: Column, domain: Column | None = None) -> Column:
    """Whether a link may be a site's policy: its own domain, a known hoster, its name in the URL, or keyword evidence (links of the body need it in anchor and URL)."""
    own = registrable_domain(url) if domain is None else domain
    label = F.lower(F.substring_index(site_domain, ".", 1))
    says, points = any_of(F.lower(squeeze(anchor)), K.PRIVACY_WORDS), any_of(F.lower(url), K.EXTERNAL_URL_SIGNALS)
    evidence = F.when(source.isin("footer", "hub", "fallback"), says | points).otherwise(says & points)
    named = F.coalesce((label != "") & F.contains(F.lower(url), label), F.lit(False))
    return own.isNotNull() & (F.coalesce(own == site_domain, F.lit(False)) | own.isin(K.POLICY_HOSTERS) | named | evidence)


def low_value(url: Column, site_url: Column) -> Column:
    p = F.lower(path(url))
    home = F.coalesce(hostname(url) == hostname(site_url), F.lit(False)) & (p == "/")
    return home | F.endswith(p, F.lit(".xml")) | any_of(p, K.LOW_VALUE_PATHS)


def under(host: Column, domains: list[str]) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [(host == d) | F.endswith(host, F.lit("." + d)) for d in domains]), F.lit(False))


def full_page_scan(url: Column) -> Column:
    return under(hostname(url), K.FULL_PAGE_HOSTS)


def homepage_is_policy(url: Column, text: Column, score: Column) -> Column:
    told = any_of(F.lower(path(url)), ["privacy", "policy", "notice", "datenschutz"]) | any_of(F.lower(text), ["privacy policy", "privacy notice"])
    return F.coalesce(F.length(text) >= 1000, F.lit(False)) & (score >= 8) & told


def _has(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def service_key(domain: Column, entity: Column, policy_url: Column) -> Column:
    """Identity of a service for category coverage: domain, then entity, then policy URL; '' for none."""
    return F.when(_has(domain), F.lower(F.trim(domain))).when(_has(entity), F.concat(F.lit("entity:"), F.lower(F.trim(entity)))).when(_has(policy_url), normalize_policy_url(policy_url)).otherwise("")


def unique_key(domain: Column, entity: Column, policy_url: Column) -> Column:
    """Identity of a service for unique counts: policy URL, then domain, then entity; '' for none."""
    return F.when(_has(policy_url), normalize_policy_url(policy_url)).when(_has(domain), F.lower(F.trim(domain))).when(_has(entity), F.concat(F.lit("entity:"), F.lower(F.trim(entity)))).otherwise("")
