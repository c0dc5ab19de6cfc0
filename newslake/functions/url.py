"""URL functions (F1, F2, F28): columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newslake.lexicons import TRACKING

SCHEME = r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://"
HOST = r"^\s*[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def host(url: Column) -> Column:
    """Lower-case host with its port, empty without one."""
    return F.lower(F.regexp_extract(url, HOST, 1))


def domain(url: Column) -> Column:
    """Host without port and leading ``www.``."""
    return F.regexp_replace(F.regexp_replace(host(url), r":\d+$", ""), r"^www\.", "")


def _plain(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def _encoded(text: Column) -> Column:
    """Form encoding in which ``~`` stays and ``*`` does not."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query_pairs(query: Column, dropped: list[str]) -> Column:
    """Sorted (key, value) structs of a query string without blank values and without ``dropped`` keys."""
    parts = F.filter(F.split(query, "&"), lambda p: p.contains("=") & (F.length(F.substring_index(p, "=", 1)) < F.length(p) - 1))
    pairs = F.transform(parts, lambda p: F.struct(_plain(F.substring_index(p, "=", 1)).alias("k"), _plain(F.substr(p, F.instr(p, "=") + 1)).alias("v")))
    return F.array_sort(F.filter(pairs, lambda x: ~F.lower(x["k"]).isin(*dropped)))


def canonical_url(url: Column, dropped: list[str] = TRACKING) -> Column:
    """lower scheme and host, no default port, no closing slash, sorted query without tracking or fragment.

    ``;params`` stay. Null for other schemes, a missing host or an empty address.
    """
    u = F.trim(url)
    scheme, net = F.lower(F.regexp_extract(u, SCHEME, 1)), host(u)
    net = F.when((scheme == "http") & net.endswith(":80"), F.regexp_replace(net, ":80$", "")).when((scheme == "https") & net.endswith(":443"), F.regexp_replace(net, ":443$", "")).otherwise(net)
    rest = F.regexp_extract(u, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    params = F.regexp_extract(rest, r"(;[^/]*)$", 1)
    path = F.concat(F.regexp_replace(F.substr(rest, F.lit(1), F.length(rest) - F.length(params)), "/+$", ""), params)
    pairs = query_pairs(F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1), dropped)
    query = F.array_join(F.transform(pairs, lambda x: F.concat(_encoded(x["k"]), F.lit("="), _encoded(x["v"]))), "&")
    whole = F.concat(scheme, F.lit("://"), net, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(scheme.isin("http", "https") & (net != ""), whole)


def loose_url(url: Column, dropped: list[str] = [*TRACKING, "source", "via"]) -> Column:
    """the whole address in lower case, without scheme, ``www.``, fragment, closing slash and tracking."""
    u = F.regexp_replace(F.lower(F.trim(url)), "#.*$", "")
    body = F.regexp_replace(F.substring_index(u, "?", 1), r"^[a-z][a-z0-9+.-]*://(www\.)?", "")
    query = F.array_join(F.transform(query_pairs(F.regexp_extract(u, r"\?(.*)$", 1), dropped), lambda x: F.concat(x["k"], F.lit("="), x["v"])), "&")
    return F.concat(F.regexp_replace(body, "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def image_url(image: Column, page: Column, blocked: str = r"(?i)(pixel|tracker|1x1|spacer|beacon|doubleclick)") -> Column:
    """absolute image address, null for data addresses and known trackers."""
    origin = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(?:/[^?#]*/)?)", 1)
    i = F.trim(image)
    whole = F.when(i.rlike(r"^https?://"), i).when(i.startswith("//"), F.concat(F.regexp_extract(page, SCHEME, 1), F.lit(":"), i)).when(i.startswith("/"), F.concat(origin, i)).otherwise(F.concat(F.regexp_replace(folder, "/$", ""), F.lit("/"), i))
    return F.when(i.isNull() | (i == "") | i.startswith("data:") | i.rlike(blocked), F.lit(None)).otherwise(whole)
