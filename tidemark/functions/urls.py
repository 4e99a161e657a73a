"""URL functions (C1-C3, PF9) as built-in Spark expressions.

``add_normalized_url`` resolves an href against a base url and canonicalises it the way a browser URL
object does for http(s): fragment dropped, host lower-cased, default port dropped, dot segments
resolved, path characters percent-encoded, query re-encoded in form style with tracking keys removed and
keys sorted (stable), one trailing slash removed unless the path is ``/``. Anything that is not http(s) or
does not parse becomes null (PF9).

The split is the RFC 3986 appendix-B regex. The whole canonicalisation is one expression whose
intermediate values are bound once as lambda variables (``transform(array(x), f)[0]``), so a predicate
pushed through it stays linear in size. Hosts are canonicalised by ``hosts.canonical_host``; ``scheme:rest`` with the base's
own scheme and without two slashes is relative to the base.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hosts import canonical_host

# Query keys dropped during canonicalisation (exact case).
TRACKING_KEYS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
                 "fbclid", "gclid", "ref", "igshid"]
# Default ports of the two accepted schemes.
DEFAULT_PORTS = {"http": "80", "https": "443"}

ABS_RE = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):(.*)$"
SPECIAL_REST_RE = r"^[/\\]*([^/\\?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
REL_RE = r"^([^?#]*)(\?[^#]*)?(#.*)?$"
# characters of a path that a browser percent-encodes: controls, blank, " < > ` { } and non-ASCII
PATH_ENCODE_RE = r'[^\x21-\x7e]|["<>`{}]'
# a host is a bracketed address or ends at a colon
HOST_RE = r"^(\[[^\]]*\]|[^:]*)"
PORT_RE = r"^(?:\[[^\]]*\]|[^:\[]*):(.*)$"


def _g(c: Column, pattern: str, idx: int) -> Column:
    return F.regexp_extract(c, pattern, idx)


def _opt_group(c: Column, pattern: str, idx: int) -> Column:
    """Text after the leading '?' of an optional query group; null when the group did not take part."""
    v = F.regexp_extract(c, pattern, idx)
    return F.when(F.length(v) > 0, F.substr(v, F.lit(2)))


def _encode_path(path: Column) -> Column:
    chars = F.split(path, "")
    enc = F.transform(
        chars,
        lambda ch: F.when(ch == " ", F.lit("%20")).when(ch.rlike(PATH_ENCODE_RE), F.url_encode(ch)).otherwise(ch),
    )
    return F.when(path.rlike(PATH_ENCODE_RE), F.array_join(enc, "")).otherwise(path)


def _remove_dot_segments(path: Column) -> Column:
    """'/a/./b/../c' -> '/a/c'; a trailing '.' or '..' leaves a trailing '/'."""
    segs = F.split(F.substr(path, F.lit(2)), "/")
    lowered = F.transform(segs, lambda s: F.lower(s))
    dots = ["..", ".%2e", "%2e.", "%2e%2e"]
    zipped = F.arrays_zip(segs.alias("s"), lowered.alias("l"))
    out = F.aggregate(
        zipped,
        F.array().cast("array<string>"),
        lambda acc, z: F.when(z["l"].isin(*dots), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(z["l"].isin(".", "%2e"), acc)
        .otherwise(F.concat(acc, F.array(z["s"]))),
    )
    last = F.element_at(lowered, -1)
    out = F.when(last.isin("..", ".", ".%2e", "%2e.", "%2e%2e", "%2e"), F.concat(out, F.array(F.lit("")))).otherwise(
        out
    )
    return F.concat(F.lit("/"), F.array_join(out, "/"))


def _canonical_query(q: Column) -> Column:
    """Form-style re-encoding: parse pairs, drop tracking keys, stable sort by key, serialise."""
    parts = F.filter(F.split(q, "&"), lambda p: F.length(p) > 0)

    def decode(x: Column) -> Column:
        spaced = F.regexp_replace(x, r"\+", " ")
        return F.coalesce(F.try_url_decode(spaced), spaced)

    pairs = F.transform(
        parts,
        lambda p, i: F.struct(
            decode(F.substring_index(p, "=", 1)).alias("k"),
            i.alias("pos"),
            decode(F.when(F.instr(p, "=") > 0, F.substr(p, F.instr(p, "=") + 1)).otherwise(F.lit(""))).alias("v"),
        ),
    )
    kept = F.filter(pairs, lambda s: ~s["k"].isin(*TRACKING_KEYS))
    ordered = F.array_sort(kept)
    text = F.array_join(
        F.transform(ordered, lambda s: F.concat(F.url_encode(s["k"]), F.lit("="), F.url_encode(s["v"]))), "&"
    )
    return F.when(F.length(text) > 0, text)


def _bind(value: Column, fn) -> Column:
    """Evaluate ``value`` once and hand it to ``fn`` as a lambda variable (keeps the tree linear)."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _split_parts(hh: Column, bb: Column) -> Column:
    """struct(scheme, auth, path, query) of href ``hh`` resolved against base ``bb``."""
    same = F.lower(_g(hh, ABS_RE, 1)) == F.lower(_g(bb, ABS_RE, 1))
    relative = hh.rlike("^[hH][tT][tT][pP][sS]?:") & F.coalesce(same, F.lit(False)) & ~hh.rlike(r"^[a-zA-Z]+:[/\\]{2}")
    return _bind(F.when(relative, _g(hh, ABS_RE, 2)).otherwise(hh), lambda h: _resolved(h, bb, relative))


def _resolved(hh: Column, bb: Column, relative: Column) -> Column:
    h_abs = hh.rlike(ABS_RE) & ~relative
    scheme = F.when(h_abs, F.lower(_g(hh, ABS_RE, 1))).otherwise(F.lower(_g(bb, ABS_RE, 1)))
    br = _g(bb, ABS_RE, 2)
    hr = _g(hh, ABS_RE, 2)
    b_path = _g(br, SPECIAL_REST_RE, 2)
    rel_path = _g(hh, REL_RE, 1)
    rel_query = _opt_group(hh, REL_RE, 2)
    scheme_rel = hh.rlike(r"^[/\\]{2}")
    auth = (
        F.when(h_abs, _g(hr, SPECIAL_REST_RE, 1))
        .when(scheme_rel, _g(hh, SPECIAL_REST_RE, 1))
        .otherwise(_g(br, SPECIAL_REST_RE, 1))
    )
    b_dir = F.regexp_extract(F.when(F.length(b_path) > 0, b_path).otherwise(F.lit("/")), r"^(.*/)", 1)
    path = (
        F.when(h_abs, _g(hr, SPECIAL_REST_RE, 2))
        .when(scheme_rel, _g(hh, SPECIAL_REST_RE, 2))
        .when(hh.startswith("/") | hh.startswith("\\"), rel_path)
        .when(F.length(rel_path) == 0, b_path)
        .otherwise(F.concat(b_dir, rel_path))
    )
    query = (
        F.when(h_abs, _opt_group(hr, SPECIAL_REST_RE, 3))
        .when(scheme_rel, _opt_group(hh, SPECIAL_REST_RE, 3))
        .when((F.length(rel_path) == 0) & rel_query.isNull(), _opt_group(br, SPECIAL_REST_RE, 3))
        .otherwise(rel_query)
    )
    return F.struct(scheme.alias("scheme"), auth.alias("auth"), F.translate(path, "\\", "/").alias("path"),
                    query.alias("query"))


def _assemble(parts: Column) -> Column:
    """Canonical url string from struct(scheme, auth, path, query), or null when invalid."""
    a = parts["auth"]
    hostport = F.regexp_extract(a, r"^(?:.*@)?([^@]*)$", 1)
    userinfo = F.regexp_extract(a, r"^(.*@)", 1)
    host = canonical_host(F.lower(F.regexp_extract(hostport, HOST_RE, 1)))
    return _bind(host, lambda h: _with_host(parts, userinfo, h, F.regexp_extract(hostport, PORT_RE, 1)))


def _with_host(parts: Column, userinfo: Column, host: Column, port: Column) -> Column:
    scheme = parts["scheme"]
    port_num = F.when(port.rlike(r"^[0-9]+$"), F.regexp_replace(port, r"^0+(?=.)", ""))
    default_port = F.when(scheme == "http", F.lit("80")).when(scheme == "https", F.lit("443"))
    port_txt = F.when((F.length(port) == 0) | (port_num == default_port), F.lit("")).otherwise(
        F.concat(F.lit(":"), port_num)
    )
    valid = (
        scheme.isin("http", "https")
        & host.isNotNull()
        & ((F.length(port) == 0) | (port_num.isNotNull() & (F.length(port_num) <= 5)
                                    & (port_num.try_cast("int") <= 65535)))
    )
    p = parts["path"]
    p_abs = F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))

    def finish(path: Column) -> Column:
        trimmed = F.when((F.length(path) > 1) & path.endswith("/"),
                         F.substring(path, 1, F.length(path) - 1)).otherwise(path)
        return _bind(_canonical_query(parts["query"]), lambda q: F.concat(
            F.concat(scheme, F.lit("://"), userinfo, host, port_txt), trimmed,
            F.when(q.isNotNull(), F.concat(F.lit("?"), q)).otherwise(F.lit(""))))

    return F.when(valid, _bind(_remove_dot_segments(_encode_path(p_abs)), finish))


def normalize_url(href: Column, base: Column | None = None) -> Column:
    """C1 normalizeUrl(href, base) as one expression; null when not http(s) or not parseable."""
    h = F.regexp_replace(F.regexp_replace(href, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")
    b = base if base is not None else F.lit(None).cast("string")
    cleaned = F.struct(h.alias("h"), b.alias("b"))
    return _bind(cleaned, lambda c: _bind(_split_parts(c["h"], c["b"]), _assemble))


_BUILT: dict = {}


def add_normalized_url(df: DataFrame, href: str, base: str | None, out: str) -> DataFrame:
    """Append ``out`` = normalizeUrl(href, base) (C1); null when not http(s) or not parseable.

    The expression is built once per Spark context and column pair (it is large and always the same)."""
    from pyspark import SparkContext

    sc = SparkContext._active_spark_context
    hit = _BUILT.get((href, base))
    if hit is None or hit[0] is not sc:
        hit = _BUILT[(href, base)] = (sc, normalize_url(F.col(href), F.col(base) if base else None))
    return df.withColumn(out, hit[1])


def url_host(url: Column) -> Column:
    """C2 getDomain: lower-cased host of an absolute url; '' for a scheme without authority; null if
    the url is not absolute."""
    rest = F.regexp_extract(url, ABS_RE, 2)
    hostport = F.regexp_extract(F.regexp_extract(rest, r"^//([^/?#]*)", 1), r"^(?:.*@)?([^@]*)$", 1)
    host = F.lower(F.regexp_extract(hostport, HOST_RE, 1))
    special = F.lower(F.regexp_extract(url, ABS_RE, 1)).isin("http", "https", "ftp", "ws", "wss", "file")
    special_host = F.lower(
        F.regexp_extract(F.regexp_extract(F.regexp_extract(rest, SPECIAL_REST_RE, 1), r"^(?:.*@)?([^@]*)$", 1),
                         HOST_RE, 1)
    )
    return F.when(~url.rlike(ABS_RE), F.lit(None).cast("string")).when(special, special_host).otherwise(host)


def get_domain(url: Column) -> Column:
    """Host of a url or null; an http(s) url without host is invalid (null)."""
    h = url_host(url)
    special = F.lower(F.regexp_extract(url, ABS_RE, 1)).isin("http", "https")
    return F.when(special & (F.length(h) == 0), F.lit(None).cast("string")).otherwise(h)


def classify_source(url: Column) -> Column:
    """Wikipedia / youtube / instagram / archive by host suffix (no dot boundary, K10), else google."""
    host = F.regexp_replace(get_domain(url), r"^www\.", "")
    return (
        F.when(host.isNull() | (F.length(host) == 0), F.lit("google"))
        .when(host.endswith("wikipedia.org"), F.lit("wikipedia"))
        .when(host.endswith("youtube.com") | (host == "youtu.be"), F.lit("youtube"))
        .when(host.endswith("instagram.com"), F.lit("instagram"))
        .when(host.endswith("archive.org"), F.lit("archive"))
        .otherwise(F.lit("google"))
    )


def display_url(url: Column, n: int = 70) -> Column:
    """PF13: a url longer than ``n`` shows its first ``n`` characters and '...'."""
    return F.when(F.length(url) > n, F.concat(F.substring(url, 1, n), F.lit("..."))).otherwise(url)
