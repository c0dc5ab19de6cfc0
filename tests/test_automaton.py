"""Many patterns at once against brute force."""

import random
import time

from newslake.operators.automaton import Automaton, occurrences, tallies


def brute(text, words, bounded):
    word = lambda c: c.isalnum() or c == "_"
    out = []
    for w in words:
        at = text.find(w)
        while w and at >= 0:
            end = at + len(w)
            if not bounded or not (at and word(text[at - 1]) and word(text[at]) or end < len(text) and word(text[end]) and word(text[end - 1])):
                out.append((w, at, end))
            at = text.find(w, at + 1)
    return sorted(out)


def test_occurrences(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("ab é漢_", k=rng.randrange(1, 6))) for _ in range(60)] + ["", "aa", "aaa", "a-a", "c++", "ab ab"]
    texts = [(i, "".join(rng.choices("ab é漢_-c+", k=rng.randrange(90))), "x") for i in range(80)] + [(900, None, "x"), (901, "", "x"), (902, "aa " * 20_000, "x"), (None, "aa c++", "x")]
    rows = spark.createDataFrame(texts, "id bigint, text string, word string")
    patterns = spark.createDataFrame([(w, 1) for w in [*words, *words, None]], "word string, n int")
    for bounded in (True, False):
        for block in (40, 10**6):
            got = {}
            for r in occurrences(rows, patterns, bounded, block).collect():
                got.setdefault(r.id, []).append((r.word, r.start, r.end))
            want = {i: found for i, t, _ in texts if (found := brute(t or "", sorted(set(words)), bounded))}
            assert {i: sorted(x) for i, x in got.items()} == want
    counted = {(r.id, r.word): r.n for r in tallies(rows, patterns).collect()}
    assert counted == {(i, w): sum(x[0] == w for x in brute(t or "", [w], True)) for i, t, _ in texts for w in set(words) if brute(t or "", [w], True)}
    assert occurrences(rows, patterns.limit(0)).count() == 0 and tallies(rows.limit(0), patterns).count() == 0


def test_many_patterns():
    """100,000 patterns cost a text about what a few do."""
    words = [f"w{i:06d}x" for i in range(100_000)]
    many, few = Automaton(words), Automaton(words[:10])
    text = " ".join(f"w{i % 200_000:06d}x" for i in range(0, 2_000_000, 37))
    start = time.perf_counter()
    n = sum(1 for _ in many.found(text))
    took = time.perf_counter() - start
    start = time.perf_counter()
    assert sum(1 for _ in few.found(text)) <= 10 and n == sum(i % 200_000 < 100_000 for i in range(0, 2_000_000, 37))
    assert took < 40 * (time.perf_counter() - start) + 1
    assert many.prefixed("w00001") == words[10:20]
