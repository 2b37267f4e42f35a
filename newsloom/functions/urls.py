"""Canonical URLs as one column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track where a reader came from.
TRACKING_PARAMS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "tsrc", "yptr", "ncid", "cmpid", "cid"]

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"


def _decoded(x: Column) -> Column:
    plain = F.replace(x, F.lit("+"), F.lit(" "))
    return F.coalesce(F.try_url_decode(x), plain)


def _encoded(x: Column) -> Column:
    """Form encoding with `~` left as it is and `*` escaped."""
    return F.replace(F.replace(F.url_encode(x), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case without `www.`, no trailing slash, fragment, `;params`, blank or
    tracking parameters; the other parameters sorted and encoded anew. Null stays null."""
    u = F.trim(url)
    scheme = F.lower(F.regexp_extract(u, _SCHEME, 1))
    host = F.regexp_replace(F.lower(F.regexp_extract(u, _HOST, 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(u, _PATH, 1), r";[^/]*$", ""), "/+$", "")
    path = F.when(path == "", "/").otherwise(path)
    pairs = F.transform(
        F.split(F.regexp_extract(u, _QUERY, 1), "&"),
        lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), F.when(F.contains(p, F.lit("=")), _decoded(F.regexp_replace(p, "^[^=]*=", ""))).otherwise("").alias("v")),
    )
    kept = F.array_sort(F.filter(pairs, lambda p: (p["v"] != "") & ~F.lower(p["k"]).isin(TRACKING_PARAMS)))
    query = F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    front = F.when(host != "", F.concat(scheme, F.when(scheme != "", ":").otherwise(""), F.lit("//"), host)).when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise("")
    return F.concat(front, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def canonical_url_sql(url: str) -> str:
    """The same as DuckDB SQL."""
    u = f"trim({url})"
    scheme = f"lower(regexp_extract({u}, '{_SCHEME}', 1))"
    host = f"regexp_replace(lower(regexp_extract({u}, '{_HOST}', 1)), '^www\\.', '')"
    path = f"regexp_replace(regexp_replace(regexp_extract({u}, '{_PATH}', 1), ';[^/]*$', ''), '/+$', '')"
    tracking = ", ".join(f"'{p}'" for p in TRACKING_PARAMS)
    dec = lambda x: f"url_decode(replace({x}, '+', ' '))"
    enc = lambda x: f"replace(url_encode({x}), '%20', '+')"
    pairs = f"list_transform(string_split(regexp_extract({u}, '{_QUERY}', 1), '&'), lambda p: {{'k': {dec("split_part(p, '=', 1)")}, 'v': case when contains(p, '=') then {dec("regexp_replace(p, '^[^=]*=', '')")} else '' end}})"
    kept = f"list_sort(list_filter({pairs}, lambda p: p.v <> '' and lower(p.k) not in ({tracking})))"
    query = f"array_to_string(list_transform({kept}, lambda p: {enc('p.k')} || '=' || {enc('p.v')}), '&')"
    front = f"case when {host} <> '' then {scheme} || case when {scheme} <> '' then ':' else '' end || '//' || {host} when {scheme} <> '' then {scheme} || ':' else '' end"
    return f"({front} || case when {path} = '' then '/' else {path} end || case when {query} <> '' then '?' || {query} else '' end)"
