"""Language identification of mixed-language text by Viterbi over words.

The script of a word (by ranges of code points) narrows the candidates to the languages that use it;
a word's score in a language is the sum of the log probabilities of the trigrams of its code points; a
change of language between neighbouring words costs a penalty; Viterbi labels each word, and runs of a label
are spans. A document's language is the one with the most letters in its spans.

A word is a run of letters and their marks by Unicode category; the script ranges only narrow candidates.
Trigram counts by language come from all labelled training documents, as hashed sums over the corpus.
The model has ``BUCKETS`` numbers for each language and script shares, so its size is bounded by the
number of languages, of which more than ``MAX_LANGUAGES`` are refused.

Null texts and texts without a letter are ``und`` with score 0. Without any labelled document all are
``und``. Texts of any length are labelled whole; above ``LONG`` characters they go through the same recurrence in
segments, with one bit a word and language kept for the way back (a run of letters beyond four segments is cut).
Of languages with equal letters the more likely wins, then the first by name. Repeated rows each return; an
empty table gives an empty result; extra columns are not read, or kept whole by ``rejected_out``.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslake.llm.common import freed, groups_of, parts_of, texts_of

BUCKETS = 1 << 16
MAX_LANGUAGES = 512
PENALTY = 6.0
GROUP = 512  # texts side by side in Viterbi
CELLS = 1 << 24  # numbers that Viterbi holds at once: words or letters times languages
LONG = 1 << 19  # characters of a text that goes through alone, and of a batch
BREAK = re.compile(r"[\s!-/:-@\[-`{-~]")
UNIFORM = -16 * float(np.log(2))  # log probability of a trigram's bucket by a guess
#: First code points of script ranges; the name holds up to the next one.
SCRIPTS = [
    (0x0000, "other"), (0x0041, "latin"), (0x005B, "other"), (0x0061, "latin"), (0x007B, "other"), (0x00AA, "latin"), (0x00AB, "other"),
    (0x00B5, "latin"), (0x00B6, "other"), (0x00BA, "latin"), (0x00BB, "other"), (0x00C0, "latin"), (0x00D7, "other"), (0x00D8, "latin"),
    (0x00F7, "other"), (0x00F8, "latin"), (0x02B0, "other"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0531, "armenian"),
    (0x0591, "hebrew"), (0x0600, "arabic"), (0x0700, "more"), (0x0900, "devanagari"), (0x0980, "more"), (0x0E01, "thai"), (0x0E80, "more"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "more"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"),
    (0x2C80, "more"), (0x2E00, "other"), (0x3040, "kana"), (0x3100, "more"), (0x3400, "han"), (0x4DC0, "other"), (0x4E00, "han"), (0xA000, "more"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "more"), (0xFE00, "other"), (0xFF21, "latin"), (0xFF3B, "other"),
    (0xFF41, "latin"), (0xFF5B, "other"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x323B0, "other"),
]
NAMES = sorted({n for _, n in SCRIPTS} - {"other"})
_STARTS = np.array([a for a, _ in SCRIPTS])
_CODES = np.array([NAMES.index(n) if n in NAMES else NAMES.index("more") for _, n in SCRIPTS], np.int8)


@functools.cache
def _kinds() -> np.ndarray:
    """2 for a letter, 1 for a mark, 0 for any other code point."""
    return np.frombuffer(bytes({"L": 2, "M": 1}.get(unicodedata.category(chr(i))[0], 0) for i in range(0x110000)), np.uint8)


class Words:
    """Words of some texts: where they lie, their trigrams, scripts and letters."""

    def __init__(self, texts: list[str]):
        line = " ".join(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer(line.lower().encode("utf-32-le") if len(line.lower()) == len(line) else "".join(c.lower()[0] for c in line).encode("utf-32-le"), "<u4")
        kind = _kinds()[points]
        letter = kind > 0
        # a word is a run of letters and marks: signs and digits say nothing of the language
        first, last = letter.copy(), letter.copy()
        first[1:] &= ~letter[:-1]
        last[:-1] &= ~letter[1:]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        if len(starts):
            bare = np.maximum.reduceat(kind, starts) < 2  # marks alone are no word
            for a, b in zip(starts[bare], ends[bare]):
                letter[a:b] = False
            starts, ends = starts[~bare], ends[~bare]
        self.starts, self.ends = starts, ends
        # ideographs stand without spaces; a run of them is one word here
        self.letters = self.ends - self.starts
        self.script = _CODES[np.searchsorted(_STARTS, points[self.starts], "right") - 1]
        offsets = np.concatenate([[0], np.cumsum(lengths + 1)])
        self.offsets = offsets
        self.counts = np.diff(np.searchsorted(self.starts, offsets))
        # trigrams centred on each letter, with a space for what is not a letter
        held = np.where(letter, points, 32).astype(np.uint32)
        wide = np.concatenate([[32], held, [32]]).astype(np.uint32)
        code = (wide[:-2] * np.uint32(0x9E3779B1) ^ wide[1:-1] * np.uint32(0x85EBCA77)) * np.uint32(0xC2B2AE3D) ^ wide[2:] * np.uint32(0x27D4EB2F)
        code ^= code >> np.uint32(15)
        code *= np.uint32(0x2C1B3C6D)
        self.grams = (code >> np.uint32(16))[letter].astype(np.int64) & (BUCKETS - 1)
        self.gram_at = np.concatenate([[0], np.cumsum(self.letters)[:-1]]) if len(self.starts) else np.zeros(0, np.int64)


def _segments(text: str, size: int) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters that cut no word (or one of more than four times that size)."""
    at = 0
    while len(text) - at > size:
        found = BREAK.search(text, at + size, at + 4 * size)
        cut = found.start() if found else min(len(text), at + 4 * size)
        yield text[at:cut]
        at = cut
    yield text[at:]


def _batches(texts: list[str], size: int = LONG) -> Iterator[list[str]]:
    """Lists of about ``size`` characters of all of ``texts``; longer ones come in segments."""
    for i, j in groups_of([len(x) for x in texts], size):
        yield from [[x] for x in _segments(texts[i], size)] if j == i + 1 else [texts[i:j]]


def gram_counts(documents: DataFrame) -> DataFrame:
    """Columns lang, bucket, n over all rows of ``documents`` with a text and a lang; scripts take buckets from BUCKETS on."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in (part for whole in batches for part in parts_of(whole, whole.column(1))):
            texts, langs = texts_of(batch.column(1)), batch.column(0).to_pylist()
            by: dict[str, list[str]] = {}
            for lang, text in zip(langs, texts):
                by.setdefault(lang, []).append(text)
            for lang, own in by.items():
                sums = held.setdefault(lang, np.zeros(BUCKETS + len(NAMES), np.int64))
                if len(held) > MAX_LANGUAGES:
                    raise ValueError(f"more than {MAX_LANGUAGES} languages")
                for w in map(Words, _batches(own)):
                    sums[:BUCKETS] += np.bincount(w.grams, minlength=BUCKETS)
                    sums[BUCKETS:] += np.bincount(w.script, w.letters, len(NAMES)).astype(np.int64)
        for lang, sums in held.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(sums[at])], names=["lang", "bucket", "n"])
        freed()

    rows = documents.filter("text IS NOT NULL AND lang IS NOT NULL").select(F.col("lang").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Log probabilities of trigrams by language, and which languages use a script."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        grams = counts[:, :BUCKETS] + 0.5
        self.scores = np.log(grams / grams.sum(axis=1, keepdims=True)).T.astype(np.float32).copy()
        letters = counts[:, BUCKETS:]
        self.uses = (letters >= 0.001 * letters.sum(axis=1, keepdims=True)) & (letters > 0)
        # a script that no language has leaves all of them
        self.uses[:, ~self.uses.any(axis=0)] = True

    def word_scores(self, w: Words) -> np.ndarray:
        if not len(w.starts):
            return np.zeros((0, len(self.languages)), np.float32)
        scores = np.add.reduceat(self.scores[w.grams], w.gram_at, axis=0)
        scores[~self.uses.T[w.script]] -= 1e4
        return scores

    def labels(self, counts: np.ndarray, scores: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
        """Viterbi labels of all words of texts with ``counts`` words; texts of like length go side by side."""
        n_lang = len(self.languages)
        out = np.zeros(len(scores), np.int64)
        order = np.argsort(-counts, kind="stable")
        order = order[counts[order] > 0]
        first = np.concatenate([[0], np.cumsum(counts)])[:-1]
        a = 0
        while a < len(order):
            own = order[a : a + min(GROUP, max(1, CELLS // int(counts[order[a]] * n_lang)))]
            a += len(own)
            n, at = counts[own], first[own]
            best = np.zeros((len(own), n_lang), np.float32)
            stays = np.zeros((n[0], len(own), n_lang), bool)
            came = np.zeros((n[0], len(own)), np.int16)
            for t in range(n[0]):
                k = int(np.searchsorted(-n, -t, "left"))  # texts with a word t
                top = best[:k].argmax(axis=1)
                best[:k] -= best[np.arange(k), top][:, None]  # only differences tell
                stays[t, :k] = best[:k] >= -penalty
                came[t, :k] = top
                best[:k] = np.maximum(best[:k], np.float32(-penalty)) + scores[at[:k] + t]
            state = best.argmax(axis=1)
            for t in range(n[0] - 1, -1, -1):
                k = int(np.searchsorted(-n, -t, "left"))
                rows = np.arange(k)
                out[at[:k] + t] = state[:k]
                state[:k] = np.where(stays[t, rows, state[:k]], state[:k], came[t, :k])
        return out

    def _size(self) -> int:
        """Characters whose trigrams' scores are held at once."""
        return max(1 << 12, min(LONG, CELLS // 2 // len(self.languages)))

    def labels_of_long(self, text: str, penalty: float = PENALTY) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Labels, letters and scores' sum under the labels and under each language, of segments of a text from the last to the first."""
        best, held = np.zeros(len(self.languages)), []
        for part in _segments(text, self._size()):
            w = Words([part])
            scores = self.word_scores(w)
            stays, came = np.zeros(scores.shape, bool), np.zeros(len(scores), np.int16)
            for t, own in enumerate(scores):
                top = best.argmax()
                best -= best[top]
                came[t] = top
                np.greater_equal(best, -penalty, out=stays[t])
                np.maximum(best, -penalty, out=best)
                best += own
            held.append((np.packbits(stays, axis=1), came, w.letters.astype(np.int32), part))
        state = int(best.argmax())
        while held:
            packed, came, letters, part = held.pop()
            stays = np.unpackbits(packed, axis=1, count=len(self.languages)) if len(packed) else packed
            out = np.zeros(len(came), np.int64)
            for t in range(len(came) - 1, -1, -1):
                out[t] = state
                if not stays[t, state]:
                    state = int(came[t])
            yield out, letters, self.word_scores(Words([part]))

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """Runs of one language: start and end of their words in code points, language."""
        w = Words([text])
        if not len(w.starts):
            return []
        own = self.labels(w.counts, self.word_scores(w))
        edges = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
        return [(int(w.starts[a]), int(w.ends[b - 1]), self.languages[own[a]]) for a, b in zip(edges, edges[1:])]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language and score of each text, and its fit.

        The score is the language's share of the letters, times how surely its spans are told apart; the fit
        is the mean log probability of a letter's trigram under the labels of the words (0 without a letter).
        """
        n_lang = len(self.languages)
        names, sure, fit = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        if not n_lang:
            return names, sure, fit
        together = max(self._size(), CELLS // n_lang)
        for i, j in groups_of([len(x) for x in texts], together):
            letters, total, inner = np.zeros((j - i, n_lang)), np.zeros((j - i, n_lang)), np.zeros(j - i)

            def add(doc: np.ndarray, own: np.ndarray, lengths: np.ndarray, scores: np.ndarray) -> None:
                n = j - i  # noqa: B023
                letters[:] += np.bincount(doc * n_lang + own, lengths, n * n_lang).reshape(-1, n_lang)  # noqa: B023
                total[:] += np.stack([np.bincount(doc, scores[:, k], n) for k in range(n_lang)], axis=1)  # noqa: B023
                inner[:] += np.bincount(doc, scores[np.arange(len(own)), own], n)  # noqa: B023

            short = [k for k in range(i, j) if len(texts[k]) <= LONG]
            parts = []
            for a, b in groups_of([len(texts[k]) for k in short], self._size()):
                w = Words([texts[k] for k in short[a:b]])
                parts.append((w.counts, self.word_scores(w), w.letters))
            if parts:
                counts, scores, lengths = (np.concatenate(x) for x in zip(*parts))
                add(np.repeat(np.array(short) - i, counts), self.labels(counts, scores), lengths, scores)
            for k in set(range(i, j)) - set(short):
                for own, lengths, scores in self.labels_of_long(texts[k]):
                    add(np.full(len(own), k - i), own, lengths, scores)
            # of equal letters the more likely language, then the first by name
            pick = np.lexsort((np.broadcast_to(-np.arange(n_lang), letters.shape), total, letters), axis=1)[:, -1]
            rows, size = np.arange(j - i), letters.sum(axis=1)
            gap = np.clip(total - total[rows, pick][:, None], -700, 50)
            posterior = np.maximum(1 / np.exp(gap).sum(axis=1), 0.5)
            sure[i:j] = np.where(size > 0, letters[rows, pick] / np.maximum(size, 1) * posterior, 0)
            fit[i:j] = inner / np.maximum(size, 1)
            for k in rows[size > 0]:
                names[i + k] = self.languages[pick[k]]
        return names, np.clip(sure, 0, 1), fit


def train(documents: DataFrame) -> Model:
    """A model from all rows with a text and a lang."""
    rows = gram_counts(documents).collect()  # at most BUCKETS + scripts rows a language
    languages = sorted({r.lang for r in rows})
    counts = np.zeros((len(languages), BUCKETS + len(NAMES)))
    index = {x: i for i, x in enumerate(languages)}
    for lang, bucket, n in rows:
        counts[index[lang], bucket] = n
    return Model(languages, counts)


def identified(documents: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with lang_pred and score of each row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kept = documents.select(*keep)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts_of(whole, whole.column(0))):
            names, sure, _ = shared.value.predict(texts_of(batch.column(0)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(names, pa.string()), pa.array(sure, pa.float64())], names=[*batch.schema.names[1:], "lang_pred", "score"])
        freed()

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "lang_pred string, score double"])
    return documents.select(F.col("text").cast("string").alias("_text"), *keep).mapInArrow(predict, schema)


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def language_of(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from documents that are not held out."""
    out = F.coalesce(held_out(), F.lit(False))
    model = train(documents.filter(~out).select("text", "lang"))
    return identified(documents, model).select(F.col("doc_id").cast("bigint"), out.alias("held_out"), "lang_pred", "score")


def rejected_out(documents: DataFrame, least_fit: float = UNIFORM, min_score: float = 0.0) -> DataFrame:
    """Documents in a language that the model knows; columns are kept.

    It rejects what is ``und``, and texts whose letters every learned language explains worse than a guess among
    all trigrams does (``least_fit``): noise, and languages that no labelled document has. Learns from the
    documents themselves that are not held out; without labelled ones it knows no language and all go.
    """
    model = train(documents.filter(~F.coalesce(held_out(), F.lit(False))).select("text", "lang"))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def keeps(text: pa.Array) -> pa.Array:
        out = []
        for part in parts_of(text, text):
            names, sure, fit = shared.value.predict(texts_of(part))
            out += [n != "und" and s >= min_score and f >= least_fit for n, s, f in zip(names, sure, fit)]
        freed()
        return pa.array(out, pa.bool_())

    return documents.filter(keeps(F.col("text").cast("string")))
