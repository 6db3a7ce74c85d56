"""URL expressions: resolving, cleaning and taking apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Query keys that analytics systems leave behind, compared in lower case (so the first never matches).
JUNK_KEYS = ["PHPSESSID", "utm_source", "utm_campaign", "utm_medium", "utm_content", "utm_hp_ref"]
_SESSION = ";jsessionid="


def _rooted(root: Column) -> Column:
    return F.when(root.startswith("http://") | root.startswith("https://"), root).otherwise(F.concat(F.lit("http://"), root))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, "(?s)^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def path(url: Column) -> Column:
    """The path of an absolute or relative URL, without query and fragment."""
    return F.regexp_extract(url, "(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def absolute(root: Column, url: Column, strict_rfc: bool = False) -> Column:
    """url against root. The default keeps the known quirks (https is downgraded, `//` is a path, a relative URL under a
    page without a closing slash stays as it is); strict_rfc resolves as RFC 3986 does."""
    if strict_rfc:
        return joined(root, url)
    home = lambda: F.concat(F.lit("http://"), netloc(_rooted(root)))
    return let(
        url,
        lambda u: F.when((u == "") | u.startswith("/"), F.concat(home(), u))
        .when(u.startswith("./"), F.concat(F.regexp_replace(root, "/[^/]*$", ""), F.substring(u, 2, 1 << 30)))
        .when(~u.startswith("http://") & ~u.startswith("https://") & path(_rooted(root)).endswith("/"), F.concat(root, u))
        .otherwise(u),
    )


def _decoded(c: Column) -> Column:
    return F.coalesce(F.expr("try_url_decode(x)") if c is None else F.call_function("try_url_decode", c), F.translate(c, "+", " "))


def query_pairs(query: Column) -> Column:
    """Array of (k, v): the first value of each key in order, decoded; `x` is `x=`."""
    parts = F.filter(F.split(query, "&", -1), lambda p: p != "")
    pairs = F.transform(parts, lambda p: F.struct(_decoded(F.regexp_extract(p, "(?s)^([^=]*)", 1)).alias("k"), _decoded(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)).alias("v")))
    return let(pairs, lambda all_: F.filter(all_, lambda p, i: F.array_position(F.transform(all_, lambda q: q["k"]), p["k"]) == i + 1))


def is_junk(key: Column) -> Column:
    return F.lower(key).isin(JUNK_KEYS)


def clean_query(query: Column) -> Column:
    kept = F.filter(query_pairs(query), lambda p: ~is_junk(p["k"]))
    return F.array_join(F.transform(kept, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, "(?s)^[^?#]*\\?([^#]*)", 1)


def without_session(url: Column) -> Column:
    at = F.instr(url, _SESSION)
    return F.when(at > 0, F.concat(F.substring(url, F.lit(1), at - 1), F.substring(url, at + len(_SESSION) + 32, F.lit(1 << 30)))).otherwise(url)


def lower_scheme(url: Column) -> Column:
    scheme = F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    return F.when(scheme != "", F.concat(F.lower(scheme), F.substring(url, F.length(scheme) + 1, F.lit(1 << 30)))).otherwise(url)


def clean(url: Column) -> Column:
    """url without session id and junk keys. A query costs the fragment; without one the fragment stays."""
    plain = lambda u: F.regexp_replace(F.regexp_replace(u, "(?s)\\?(#|$)", "$1"), "#$", "")
    with_query = lambda u: let(clean_query(query_of(u)), lambda kept: F.concat(F.substring_index(u, "?", 1), F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept))))
    return let(lower_scheme(without_session(url)), lambda u: F.when(query_of(u) == "", plain(u)).otherwise(with_query(u)))


def joined(base: Column, ref: Column) -> Column:
    """RFC 3986 reference resolution."""
    scheme = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    site = F.regexp_extract(base, "(?s)^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    whole = F.regexp_extract(base, "(?s)^([^?#]*)", 1)
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    rel = F.regexp_extract(ref, "(?s)^([^?#]*)", 1)
    tail = F.regexp_extract(ref, "(?s)^[^?#]*(.*)$", 1)
    merged = F.when(rel.startswith("/"), rel).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), rel))
    return (
        F.when(ref == "", base)
        .when(ref.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(scheme, F.lit(":"), ref))
        .when(ref.startswith("#"), F.concat(F.regexp_extract(base, "(?s)^([^#]*)", 1), ref))
        .when(ref.startswith("?"), F.concat(whole, ref))
        .otherwise(F.concat(site, _no_dots(merged), tail))
    )


def _no_dots(p: Column) -> Column:
    """p without `.` and `..` segments."""
    parts = F.split(p, "/", -1)
    last = F.element_at(parts, -1)
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc).when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)).otherwise(F.concat(acc, F.array(s))),
    )
    out = F.array_join(folded, "/")
    return F.when(last.isin(".", "..") & ~out.endswith("/"), F.concat(out, F.lit("/"))).otherwise(out)


def last_segment(p: Column) -> Column:
    """The lower-cased last segment of a path, the one before if that is empty."""
    parts = F.split(p, "/", -1)
    last = F.element_at(parts, -1)
    return F.lower(F.when((last == "") & (F.size(parts) > 1), F.try_element_at(parts, F.lit(-2))).otherwise(last))


def stem(name: Column) -> Column:
    """A name without its extension."""
    return F.regexp_replace(name, "(?s)\\.[^.]*$", "")


def extension(name: Column) -> Column:
    return F.when(name.contains("."), F.substring_index(name, ".", -1)).otherwise(F.lit(""))
