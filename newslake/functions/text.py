"""Text functions (F3-F9, F13-F19, F22, F25-F29, H6): columns in, columns out."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from newslake.lexicons import CLICKBAIT, HIGH_IMPACT, LOW_IMPACT, PAYWALL, TITLE_PREFIXES

WORD = r"[\p{L}\p{N}_]+"
#: Character references that occur in feeds; others are left to ``unescaped``.
REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&nbsp;": " ", "&#160;": " ", "&middot;": "·", "&copy;": "©", "&hellip;": "…", "&mdash;": "—", "&ndash;": "–", "&lsquo;": "‘", "&rsquo;": "’", "&ldquo;": "“", "&rdquo;": "”", "&#8217;": "’", "&#8216;": "‘", "&#8220;": "“", "&#8221;": "”", "&#8211;": "–", "&#8212;": "—", "&amp;": "&"}


def squeezed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def unescaped_common(text: Column) -> Column:
    """The frequent character references decoded, inside the JVM."""
    return reduce(lambda t, x: F.replace(t, F.lit(x[0]), F.lit(x[1])), REFERENCES.items(), text)


@F.pandas_udf(StringType())
def unescaped(text):  # noqa: ANN001, ANN201
    """All HTML character references decoded, as there is no built-in for it."""
    import html

    return text.map(lambda t: html.unescape(t) if isinstance(t, str) else None)


def _whole(text: Column, decode) -> Column:  # noqa: ANN001
    return decode(decode(text))


def clean_headline(title: Column, decode=unescaped_common) -> Column:  # noqa: ANN001
    """references decoded twice, straight quotes, dashes as " - ", no tags, squeezed; null under 3 characters."""
    t = F.translate(_whole(title, decode), "‘’“”", "''\"\"")
    t = F.regexp_replace(t, "[—–]", " - ")
    t = squeezed(F.regexp_replace(t, "<[^>]+>", " "))
    return F.when(F.length(t) >= 3, t)


def clean_summary(summary: Column, decode=unescaped_common) -> Column:  # noqa: ANN001
    """as F3 without quotes and dashes; empty for null."""
    return squeezed(F.regexp_replace(_whole(F.coalesce(summary, F.lit("")), decode), "<[^>]+>", " "))


def sanitized_title(title: Column) -> Column:
    """a leading rank ("3. ", "12) ", "#4 ") goes, "3D" and "5G" stay."""
    return F.regexp_replace(F.regexp_replace(F.trim(title), r"^#?\d{1,3}\s*[.):\-]\s+", ""), r"^#\d{1,3}\s+", "")


def plain_title(title: Column, prefixes: list[str] = TITLE_PREFIXES) -> Column:
    """lower case, without opening labels and punctuation, squeezed."""
    t = F.regexp_replace(F.lower(F.trim(title)), f"^({'|'.join(prefixes)})\\s*:\\s*", "")
    return squeezed(F.regexp_replace(t, r"[^\p{L}\p{N}_\s]", " "))


def words(text: Column) -> Column:
    """Lower-case word tokens in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def let(value: Column, body) -> Column:  # noqa: ANN001
    """``body`` of ``value``, which is computed once, even where lambdas name it."""
    return F.transform(F.array(value), body)[0]


def shingles(text: Column, n: int = 2) -> Column:
    """distinct single words and runs of ``n`` words."""
    return let(words(text), lambda w: _shingles(w, n))


def _shingles(w: Column, n: int) -> Column:
    runs = F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(w, runs))


def word_runs(text: Column, n: int = 3) -> Column:
    """distinct runs of ``n`` words; a shorter text is one run."""
    return let(words(text), lambda w: _word_runs(w, n))


def _word_runs(w: Column, n: int) -> Column:
    return F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) < n, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct members, 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.size(F.array_union(a, b)))


def edit_ratio(a: Column, b: Column) -> Column:
    """F8: one minus the edit distance over the longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def token_sort_ratio(a: Column, b: Column) -> Column:
    """F8: edit ratio of the sorted words."""
    line = lambda x: F.array_join(F.array_sort(words(x)), " ")
    return edit_ratio(line(a), line(b))


def partial_ratio(a: Column, b: Column) -> Column:
    """F8: the best edit ratio of the shorter text with a stretch of the longer one of its length."""
    swap = F.length(a) > F.length(b)
    pair = F.struct(F.when(swap, b).otherwise(a).alias("short"), F.when(swap, a).otherwise(b).alias("long"))

    def best(p: Column) -> Column:
        n = F.length(p["short"])
        at = F.sequence(F.lit(1), F.length(p["long"]) - n + 1)
        near = F.array_min(F.transform(at, lambda i: F.levenshtein(p["short"], F.substr(p["long"], i, n))))
        return F.when(n == 0, F.when(F.length(p["long"]) == 0, 1.0).otherwise(0.0)).otherwise(1 - near / n)

    return let(pair, best)


def similarity_score(a: Column, b: Column) -> Column:
    """F8: the best of edit ratio, token-sort ratio and word Jaccard."""
    return F.greatest(edit_ratio(a, b), token_sort_ratio(a, b), jaccard(F.array_distinct(words(a)), F.array_distinct(words(b))))


def hash_id(text: Column, n: int = 16, bits: int = 256) -> Column:
    """the first hex digits of a digest; ``bits`` 0 is md5."""
    return F.substring(F.sha2(text, bits) if bits else F.md5(text), 1, n)


def event_id(headline: Column, first_seen: Column) -> Column:
    """identity of an event by its headline and day."""
    return hash_id(F.concat(F.lit("event:"), squeezed(F.lower(headline)), F.lit("|"), F.date_format(first_seen, "yyyy-MM-dd")))


EDGE = r"[^\p{L}\p{N}_]"


def bounded(word: str) -> str:
    """A pattern for ``word`` between word boundaries, or anywhere for a phrase; Java and RE2 read it alike."""
    plain = re.escape(word).replace("\\ ", " ")
    return plain if " " in word else f"(?:^|{EDGE}){plain}(?:{EDGE}|$)"


def present_words(text: Column, vocabulary: list[str]) -> Column:
    """Those of ``vocabulary`` in a lower-case text, in one pass for plain words: as words, phrases anywhere."""
    plain = [w for w in vocabulary if re.fullmatch(r"\w+", w)]
    other = [w for w in vocabulary if w not in plain]
    own = F.array_intersect(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), F.array(*map(F.lit, plain)).cast("array<string>"))
    return F.concat(own, F.array_compact(F.array(*(F.when(text.contains(w) if " " in w else present(text, w), F.lit(w)) for w in other)).cast("array<string>")))


def any_of(text: Column, patterns: list[str]) -> Column:
    return reduce(or_, (text.rlike(f"(?i){p}") for p in patterns))


def clickbait(title: Column, patterns: list[str] = CLICKBAIT) -> Column:
    return any_of(title, patterns)


def paywalled(text: Column, patterns: list[str] = PAYWALL) -> Column:
    return any_of(text, patterns)


def importance(text: Column, high_impact: list[tuple[str, float]] = HIGH_IMPACT, low_impact: str = LOW_IMPACT) -> Column:
    """C4: one half, plus the first high pattern, minus the low one, within 0.1 and 1."""
    high = None
    for pattern, boost in high_impact:
        p = text.rlike(f"(?i){pattern}")
        high = F.when(p, boost) if high is None else high.when(p, boost)
    low = F.when(text.rlike(f"(?i){low_impact}"), -0.20).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.10), F.least(F.lit(1.0), F.lit(0.5) + high.otherwise(0.0) + low)), 3)


def present(text: Column, word: str) -> Column:
    return text.rlike(bounded(word))


def matched(text: Column, vocabulary: list[str]) -> Column:
    """The words of ``vocabulary`` in lower-case ``text``, sorted."""
    found = F.array(*(F.when(present(text, w), F.lit(w)) for w in sorted(vocabulary)))
    return F.array_compact(found)


def matched_categories(text: Column, taxonomy: dict[str, list[str]]) -> Column:
    """sorted names of the categories with a word in lower-case ``text``."""
    return F.array_compact(F.array(*(F.when(reduce(or_, (present(text, w) for w in taxonomy[c])), F.lit(c)) for c in sorted(taxonomy))))


def counts(text: Column, vocabulary: list[str]) -> Column:
    """Occurrences of all single words of ``vocabulary`` among the words of ``text``."""
    return F.size(F.filter(words(text), lambda w: w.isin(*vocabulary)))


def sentiment(text: Column, positive: list[str], negative: list[str]) -> Column:
    """(p - n) / (p + n + 1) over occurrences."""
    p, n = counts(text, positive), counts(text, negative)
    return (p - n) / (p + n + 1)


def sentiment_label(score: Column) -> Column:
    return F.when(score >= 0.5, "very_positive").when(score >= 0.15, "positive").when(score <= -0.5, "very_negative").when(score <= -0.15, "negative").otherwise("neutral")


def set_sentiment(text: Column, positive: list[str], negative: list[str]) -> Column:
    """which word set has more than one and a half times the other's distinct hits."""
    w = F.array_distinct(words(text))
    lit = lambda xs: F.array(*(F.lit(x) for x in xs))
    p, n = F.size(F.array_intersect(w, lit(positive))), F.size(F.array_intersect(w, lit(negative)))
    return F.when(p > 1.5 * n, "positive").when(n > 1.5 * p, "negative").otherwise("neutral")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def reading_minutes(text: Column) -> Column:
    """F19."""
    return F.greatest(F.lit(1), F.floor(word_count(text) / 200).cast("int"))


def sentences(text: Column) -> Column:
    """Sentences with their closing sign."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"([^.!?]+[.!?]+|[^.!?]+$)"), F.lit(1)), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))


def local_summary(text: Column) -> Column:
    """the first three sentences of over 20 characters, else the first 200 characters."""
    long = F.slice(F.filter(sentences(text), lambda s: F.length(s) > 20), 1, 3)
    return F.when(F.size(long) > 0, F.array_join(long, " ")).otherwise(F.substring(text, 1, 200))


def route_template(path: Column) -> Column:
    """ids in a path as ``{id}``."""
    return F.regexp_replace(path, r"/(\d+|[0-9a-f]{8,}(?:-[0-9a-f]{4,})*)(?=/|$)", "/{id}")


def status_category(code: Column) -> Column:
    """what a status code asks of the next try."""
    return F.when(code == 429, "rate_limited").when(code.isin(404, 410), "gone").when(code.isin(401, 403), "forbidden").when(code >= 500, "server_error").when(code >= 400, "client_error").when(code >= 300, "redirect").otherwise("ok")


def status_backoff(code: Column) -> Column:
    return F.when(code == 429, 300).when(code.isin(404, 410), 7 * 86400).when(code.isin(401, 403), 3600).when(code >= 500, 60).otherwise(0)


def tweet_title(text: Column) -> Column:
    """the first sentence, or 97 characters and an ellipsis."""
    first = F.regexp_extract(text, r"^([^.!?\n]+[.!?]?)", 1)
    return F.when(F.length(first) <= 100, F.trim(first)).otherwise(F.concat(F.substring(first, 1, 97), F.lit("...")))


def engagement(retweets: Column, likes: Column, replies: Column, quotes: Column) -> Column:
    return 2 * retweets + likes + 1.5 * replies + 2.5 * quotes
