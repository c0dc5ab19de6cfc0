"""Ids of the public byte-pair tokenizers: every id comes from the tokenizers library.

Both vocabularies part a text into pieces before they merge, and no piece reaches over a space before a
visible character, or from a letter to an ASCII sign behind it. So the ids of a text are those of its chunks in turn, cut
there, whatever the script.
The distinct chunks of a batch of texts go to the library together, many in one string; its ids are dealt
to the chunks by the bytes that each id stands for, or by a separator where the vocabulary changes bytes.
Where that vocabulary only lower-cases a chunk, as its letters are Latin-1, it is lowered here and goes to the same model
of the library without the steps before it; there a chunk's last id is one that ends a word.
A bounded cache keeps the ids of chunks that came more than once. Texts longer than ``SEGMENT`` go
through in segments cut at such places, so memory is bounded by a batch.

Vocabulary files are read from a path given by the caller.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from newslake.llm.common import groups_of

#: A visible character: letters, digits and ASCII signs are white space to no engine.
CUT = re.compile(r"(?= [\w!-~])")
UNSURE = r"(?s) (?:[^!-~\pL\pN]|\z)|<\|"  # a space at which a text may not be cut; what opens an added token
TAIL = r"([A-Za-zÀ-ÖØ-öø-įı-ɏ])([!-/:-@\[-`{-~])"  # a letter with a sign behind it; İ is two signs in lower case
LETTERS = r"\A[A-Za-zÀ-ÖØ-öø-ÿ]+\z"  # composed letters alone: nothing to compose, nowhere to part
CACHE, MARKS = 250_000, 1 << 22  # chunks whose ids are kept, and slots of the marks of those seen
LONGEST_KEY = 40
SEGMENT = 1 << 21
TOGETHER, LETTERED = 1 << 16, 1 << 12  # characters of distinct chunks in one string, and of those of letters
FIRST = "\0"  # opens the first chunk of a text and what stood behind a letter; the others have a space before them
BETWEEN = "\0"  # parts the chunks of a vocabulary of words; chunks that hold it go alone


def _flat(parts: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all parts in turn, and how many each has."""
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.fromiter((i for p in parts for i in p), np.uint32, int(size.sum())), size


def _ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places first.., as many as ``size`` says, of each range in turn."""
    end = np.cumsum(size)
    return np.repeat(first - end + size, size) + np.arange(int(end[-1]) if len(end) else 0)


class Encoder:
    """The tokenizer of a vocabulary file. ``words``: white space is dropped (word ends are in the vocabulary)."""

    def __init__(self, path: str, words: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole, self.words = Tokenizer.from_file(path), words
        vocabulary = self.whole.get_vocab()
        if words:
            (self.between,) = self.whole.encode(BETWEEN, add_special_tokens=False).ids
            self.letters, suffix = Tokenizer(self.whole.model), self.whole.model.end_of_word_suffix
            self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
            self.last[[i for name, i in vocabulary.items() if name.endswith(suffix)]] = True
        else:
            self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # that an id stands for: a character of its name each
            self.bytes[list(vocabulary.values())] = list(map(len, vocabulary))
        self.seen = np.zeros(MARKS, bool)
        self.known: dict[str, int] = {}  # places in ``first`` and ``size``, in their order
        self.ids, self.first, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _chunks(self, texts: list[str]) -> pa.ListArray:
        """The chunks of each text; see ``_spelt`` for how they are written."""
        column = pa.array(texts, pa.string())
        if self.words:
            parted = pc.replace_substring_regex(column, TAIL, r"\1 \2")
            if len(odd := np.flatnonzero(pc.match_substring(column, "<|").to_numpy(zero_copy_only=False))):
                parted = pc.replace_with_mask(parted, np.isin(np.arange(len(texts)), odd), column.take(pa.array(odd)))
            return pc.split_pattern(pc.replace_substring(parted, "\n", " "), " ")
        parted = pc.replace_substring_regex(column, TAIL, rf"\1 {FIRST}\2")
        out = pc.split_pattern(pc.binary_join_element_wise(FIRST, parted, ""), " ")
        odd = np.flatnonzero(pc.match_substring_regex(column, UNSURE).to_numpy(zero_copy_only=False))
        if len(odd):
            cut = [CUT.split(texts[i]) for i in odd]
            slow = pa.array([[FIRST + c[0], *(x[1:] for x in c[1:])] for c in cut], pa.list_(pa.string()))
            order = np.arange(len(texts))
            order[odd] = len(texts) + np.arange(len(odd))
            out = pa.concat_arrays([out, slow]).take(pa.array(order))
        return out

    def _spelt(self, chunk: str) -> str:
        return chunk if self.words else chunk[1:] if chunk[:1] == FIRST else " " + chunk

    def _alone(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return _flat([e.ids for e in self.whole.encode_batch([self._spelt(c) for c in chunks], add_special_tokens=False)])

    def _joined(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``chunks`` that may stand in one string, and how many each has."""
        line = f" {BETWEEN} ".join(chunks) if self.words else " " + " ".join(chunks)
        (found,) = self.whole.encode_batch_fast([line], add_special_tokens=False)
        ids = np.array(found.ids, np.uint32)
        if self.words:
            edges = np.flatnonzero(ids == self.between)
            if len(edges) == len(chunks) - 1:
                return np.delete(ids, edges), np.diff(np.concatenate([[-1], edges, [len(ids)]])) - 1
        else:
            ends, wanted = np.cumsum(self.bytes[ids]), np.cumsum([len(c.encode()) + 1 for c in chunks])
            last = np.searchsorted(ends, wanted)
            if len(ends) and ends[-1] == wanted[-1] and (ends[last] == wanted).all():
                return ids, np.diff(last, prepend=-1)
        return self._alone(chunks)

    def _lettered(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``chunks`` of ``LETTERS``, and how many each has."""
        (found,) = self.letters.encode_batch_fast([" ".join(chunks).lower()], add_special_tokens=False)
        ids = np.array(found.ids, np.uint32)
        ends = np.flatnonzero(self.last[ids])
        if len(ends) == len(chunks) and ends[-1] == len(ids) - 1:
            return ids, np.diff(ends, prepend=-1)
        return self._alone(chunks)

    def _new(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``chunks`` by the library, and how many each has."""
        column = pa.array(chunks, pa.string())
        length = pc.utf8_length(column).to_numpy()
        kind = np.ones(len(chunks), np.int8)  # 0: alone, 1: joined, 2: of letters
        if self.words:
            kind[pc.match_substring_regex(column, LETTERS).to_numpy(zero_copy_only=False)] = 2
        kind[pc.match_substring(column, BETWEEN if self.words else FIRST).to_numpy(zero_copy_only=False) | (length > TOGETHER)] = 0
        order = np.argsort(kind, kind="stable")
        own, length = np.array(chunks, object)[order].tolist(), length[order].tolist()
        n, m = np.searchsorted(kind[order], [1, 2]).tolist()
        parts = [self._alone(own[:n])] if n else []
        parts += [self._joined(own[n + i : n + j]) for i, j in groups_of(length[n:m], TOGETHER)]
        parts += [self._lettered(own[m + i : m + j]) for i, j in groups_of(length[m:], LETTERED)]
        ids, size = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        back = np.argsort(order)
        return ids[_ragged((np.cumsum(size) - size)[back], size[back])], size[back]

    def _keep(self, chunks: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        if len(self.known) + len(chunks) > CACHE:  # the older half goes
            half = len(self.known) // 2
            cut = self.first[half] if half < len(self.first) else 0
            self.known = dict(zip(list(self.known)[half:], range(len(self.known))))
            self.ids, self.first, self.size = self.ids[cut:], self.first[half:] - cut, self.size[half:]
            chunks = chunks[: CACHE - len(self.known)]
            size = size[: len(chunks)]
            ids = ids[: size.sum()]
        self.known.update(zip(chunks, range(len(self.known), len(self.known) + len(chunks))))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(size) - size])
        self.ids, self.size = np.concatenate([self.ids, ids]), np.concatenate([self.size, size])

    def _ids(self, chunks: list[str], times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids that hold those of all ``chunks``, where each has its first, and how many; ``times`` each occurs."""
        at = np.fromiter(map(self.known.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(at < 0)
        if not len(missing):
            return self.ids, self.first[at], self.size[at]
        new = [chunks[i] for i in missing]
        ids, n = self._new(new)
        at[missing] = len(self.first) + np.arange(len(new))
        begin = np.cumsum(n) - n
        out = np.concatenate([self.ids, ids]), np.concatenate([self.first, len(self.ids) + begin])[at], np.concatenate([self.size, n])[at]
        slots = np.fromiter(map(hash, new), np.int64, len(new)) & (MARKS - 1)
        short = np.fromiter(map(len, new), np.int64, len(new)) <= LONGEST_KEY
        again = np.flatnonzero((self.seen[slots] | (times[missing] > 1)) & short)
        self.seen[slots] = True
        self._keep([new[i] for i in again], ids[_ragged(begin[again], n[again])], n[again])
        return out

    def _batch(self, texts: list[str]) -> list[np.ndarray]:
        chunks = self._chunks(texts)
        coded = chunks.flatten().dictionary_encode()
        at = coded.indices.to_numpy()
        ids, first, size = self._ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), np.bincount(at, minlength=len(coded.dictionary)))
        n = size[at]
        flat = ids[_ragged(first[at], n)]
        return np.split(flat, np.concatenate([[0], np.cumsum(n)])[chunks.offsets.to_numpy()[1:-1] - chunks.offsets[0].as_py()])

    def _segments(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > SEGMENT and (cut := CUT.search(text, at + SEGMENT)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def encode_batch(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each whole text."""
        for i, j in groups_of([len(x) for x in texts], SEGMENT):
            if j == i + 1 and len(texts[i]) > SEGMENT:
                yield np.concatenate([self._batch([s])[0] for s in self._segments(texts[i])])
            else:
                yield from self._batch(texts[i:j])

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_batch([text]))


_loaded: dict[tuple[str, str], Encoder] = {}


def tokenizer(kind: str, path: str) -> Encoder:
    """The encoder of a vocabulary file, loaded once in a worker. ``kind``: byte or word."""
    if (kind, path) not in _loaded:
        _loaded[kind, path] = Encoder(path, {"byte": False, "word": True}[kind])
    return _loaded[kind, path]
