"""Dates (P2, P5, C6, T1-T7): every function takes ``now``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Levels by their upper bound in minutes.
LEVELS = [("breaking", 5), ("very_fresh", 30), ("fresh", 120), ("recent", 360), ("aging", 1440), ("old", 4320)]
STEPS = [(5, 1.0), (30, 0.9), (120, 0.75), (360, 0.5), (1440, 0.3), (4320, 0.1)]
FORMATS = ["yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "d MMM yyyy HH:mm:ss Z", "yyyy-MM-dd", "dd/MM/yyyy", "MMMM d, yyyy", "d MMM yyyy", "yyyy/MM/dd"]


def minutes_between(then: Column, now: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / 60e6


def level(age: Column) -> Column:
    """Name of an age in minutes; null is unknown, the future is breaking."""
    out = F.when(age.isNull(), "unknown")
    for name, bound in LEVELS:
        out = out.when(age <= bound, name)
    return out.otherwise("stale")


def score(age: Column) -> Column:
    """From 1 down to 0.05 over 72 hours, 0 from there, one half if unknown."""
    fall = F.round(F.greatest(F.lit(0.0), 1 - age / 4320 * 0.95), 3)
    return F.when(age.isNull(), 0.5).when(age <= 5, 1.0).when(age >= 4320, 0.0).otherwise(fall)


def step_score(age: Column) -> Column:
    """The score of an event by its age."""
    a = F.greatest(age, F.lit(0.0))
    out = None
    for bound, value in STEPS:
        out = F.when(a <= bound, value) if out is None else out.when(a <= bound, value)
    return out.otherwise(0.0)


def shown_freshness(age: Column) -> Column:
    """T4: the bands of the reader's view."""
    return F.when(age < 15, "just_now").when(age < 60, "last_hour").when(age < 360, "last_6_hours").when(age < 1440, "today").when(age < 10080, "this_week").otherwise("older")


def relative(age: Column) -> Column:
    """T3: "5 mins ago"."""
    whole = lambda x: F.floor(x).cast("bigint")
    say = lambda n, one: F.concat(n.cast("string"), F.lit(f" {one}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
    return F.when(age < 1, "just now").when(age < 60, say(whole(age), "min")).when(age < 1440, say(whole(age / 60), "hour")).when(age < 10080, say(whole(age / 1440), "day")).otherwise(say(whole(age / 10080), "week"))


def parsed(text: Column, now: Column, url: Column | None = None) -> Column:
    """Relative phrases, then known formats, then a date in the address; null if none fits."""
    n = F.regexp_extract(F.lower(text), r"(\d+)\s*(second|sec|minute|min|hour|hr|day|week)s?\s+ago", 1)
    unit = F.regexp_extract(F.lower(text), r"(\d+)\s*(second|sec|minute|min|hour|hr|day|week)s?\s+ago", 2)
    seconds = F.when(unit.isin("second", "sec"), 1).when(unit.isin("minute", "min"), 60).when(unit.isin("hour", "hr"), 3600).when(unit == "day", 86400).when(unit == "week", 604800)
    ago = F.when(n != "", F.timestamp_seconds(F.unix_timestamp(now.cast("timestamp")) - n.cast("bigint") * seconds))
    word = F.when(F.lower(F.trim(text)) == "yesterday", F.timestamp_seconds(F.unix_timestamp(now.cast("timestamp")) - 86400)).when(F.lower(F.trim(text)).isin("now", "just now", "today"), now.cast("timestamp"))
    # the name of a week day adds nothing
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3,9},\s*", "")
    tries = [F.try_to_timestamp(bare, F.lit(f)) for f in FORMATS]
    if url is not None:
        tries.append(F.try_to_timestamp(F.regexp_replace(F.regexp_extract(url, r"/(20\d{2}/\d{1,2}/\d{1,2})(?:/|$)", 1), "/", "-"), F.lit("yyyy-M-d")))
    return F.coalesce(ago, word, *tries)


def zone_of(domain: Column, exact: dict[str, str], by_suffix: dict[str, str]) -> Column:
    """T5: time zone of a domain: listed, by its last label, or UTC."""
    out = None
    for name, zone in exact.items():
        out = F.when(domain == name, zone) if out is None else out.when(domain == name, zone)
    for suffix, zone in by_suffix.items():
        out = F.when(domain.endswith(suffix), zone) if out is None else out.when(domain.endswith(suffix), zone)
    return out.otherwise("UTC") if out is not None else F.lit("UTC")


def digest_due(last_sent: Column, now: Column, period: str) -> Column:
    """23 hours since a daily digest, six days and 23 hours since a weekly one; never sent is due."""
    least = {"daily": 23 * 60, "weekly": (6 * 24 + 23) * 60}[period]
    return last_sent.isNull() | (minutes_between(last_sent, now) >= least)
