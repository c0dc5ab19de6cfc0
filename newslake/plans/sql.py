"""Shared pieces of DuckDB SQL: the adapters' rows and the functions of words."""

from __future__ import annotations

from newslake.functions.text import bounded
from newslake.plans.registry import q

PAGES = r"""obs AS (SELECT page_id, url, lower(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS source_id, CAST(page_id % 4 + 1 AS INTEGER) AS source_tier,
  regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS raw_title, regexp_extract(html, '(?s)<p>(.*?)</p>', 1) AS raw_summary,
  TIMESTAMP '2024-01-31' + to_minutes(CAST(page_id AS BIGINT)) AS observed_at, CASE WHEN page_id % 10 <> 0 THEN TIMESTAMP '2024-01-31' + to_minutes(CAST(page_id AS BIGINT)) - to_hours(CAST(page_id % 80 AS BIGINT)) END AS published_at FROM pages)"""
ARTICLES = r"""art AS (SELECT doc_id, CASE WHEN contains(coalesce(text, ''), chr(10)) THEN split_part(text, chr(10), 1) ELSE substring(coalesce(text, ''), 1, 120) END AS title, coalesce(text, '') AS clean_text,
  source AS source_name, CAST(doc_id % 4 + 1 AS INTEGER) AS source_tier, lang, TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id AS BIGINT)) AS discovered_at FROM documents)"""
ATTEMPTS = r"""att AS (SELECT event_id, user_id AS source_id, ts, event_type <> 'error' AS success, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  CASE WHEN event_type = 'error' THEN CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 = 0 THEN 404 WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 = 1 THEN 429 ELSE 500 END ELSE 200 END AS status_code, value AS response_time_ms, event_type FROM events)"""
SQUEEZE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


def words(text: str) -> str:
    return rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+')"


def has(text: str, word: str) -> str:
    return f"regexp_matches({text}, {q(bounded(word))})"


def one_edit(text: str, word: str) -> str:
    """``text`` is within one edit of ``word`` in code points, which DuckDB's own distance counts in bytes."""
    ways = [word[:i] + ".?" + word[i + 1 :] for i in range(len(word))] + [word[:i] + "." + word[i:] for i in range(len(word) + 1)]
    return f"regexp_full_match({text}, {q('(?s)' + '|'.join(ways))})"


def literal_list(items: list[str]) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]"


def word_count(text: str) -> str:
    return rf"CAST(len(list_filter(regexp_split_to_array({text}, '\s+'), lambda x: x <> '')) AS BIGINT)"


def unescape(text: str) -> str:
    from newslake.functions.text import REFERENCES

    for a, b in REFERENCES.items():
        text = f"replace({text}, {q(a)}, {q(b)})"
    return text


def canonical(url: str) -> str:
    """Canonical address of ``url`` where no percent-encoding is needed."""
    from newslake.lexicons import TRACKING

    u = f"trim({url})"
    scheme = rf"lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))"
    net = rf"lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
    net = f"CASE WHEN {scheme} = 'http' THEN regexp_replace({net}, ':80$', '') ELSE regexp_replace({net}, ':443$', '') END"
    path = rf"regexp_replace(regexp_extract({u}, '^[^:]+://[^/?#]*([^?#]*)', 1), '/+$', '')"
    pairs = rf"list_sort(list_filter(string_split(regexp_extract({u}, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: regexp_matches(p, '=.') AND NOT list_contains({literal_list(TRACKING)}, lower(split_part(p, '=', 1)))))"
    query = f"array_to_string({pairs}, '&')"
    return f"CASE WHEN {scheme} IN ('http', 'https') AND {net} <> '' THEN {scheme} || '://' || {net} || {path} || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END END"


def headline(raw: str) -> str:
    t = unescape(unescape(raw))
    t = f"translate({t}, '‘’“”', '''''\"\"')"
    t = f"regexp_replace({t}, '[—–]', ' - ', 'g')"
    t = SQUEEZE.format(f"regexp_replace({t}, '<[^>]+>', ' ', 'g')")
    return f"CASE WHEN length({t}) >= 3 THEN {t} END"


def summary(raw: str) -> str:
    return SQUEEZE.format(f"regexp_replace({unescape(unescape(f'coalesce({raw}, {q('')})'))}, '<[^>]+>', ' ', 'g')")


def level(age: str) -> str:
    from newslake.functions.dates import LEVELS

    return f"CASE WHEN {age} IS NULL THEN 'unknown' " + " ".join(f"WHEN {age} <= {b} THEN '{n}'" for n, b in LEVELS) + " ELSE 'stale' END"


def score(age: str) -> str:
    return f"CASE WHEN {age} IS NULL THEN 0.5 WHEN {age} <= 5 THEN 1.0 WHEN {age} >= 4320 THEN 0.0 ELSE round(greatest(0.0, 1 - {age} / 4320 * 0.95), 3) END"


def minutes(then: str, now: str) -> str:
    return f"((epoch_us({now}) - epoch_us({then})) / 60e6)"
