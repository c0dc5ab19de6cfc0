"""A kept inverted index (Q2, Q3, Q4, Q9): postings by term, so that a query reads its own terms and no text.

A posting is a term in a document: its frequency and places in each column, and the document's length. Postings
are parquet folders, partitioned by a hash of the first ``HEAD`` letters of the term and sorted by term in each file: an exact
term or a prefix reads one partition, and of it the row groups that can hold it (``StartsWith`` and equality are pushed down).
Terms of a third of all documents are many files: Spark splits large partitions when it rebalances them by that hash.

A document has one row more, without a term, in a partition of its own.

Documents are added and deleted in batches, each a commit of ``Segments``: an added batch is a folder more; a deleted or
replaced document is a row (id, version) that hides its postings of earlier versions. Numbers of documents and words
are sums over commits. ``merged`` makes one folder of all. Searches score exactly as ``engine.bm25`` does over the live rows.

Null columns are empty; rows with a null id are not indexed; of rows that repeat an id within a batch the last by text counts.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import chain
from operator import add, and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newslake.lake import forgotten, written
from newslake.operators.segments import Segments
from newslake.search.engine import K1, B, parsed

HEAD, BUCKETS = 2, 64
DOCUMENT = -1  # the bucket of the documents' own rows
ROWS = 50_000  # postings at once
WORD = re.compile(r"\w+")  # letters, numbers and _, as ``text.WORD``


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(term, 1, HEAD)), F.lit(BUCKETS)).cast("int")


def edits_of(word: str) -> int:
    """Q4: AUTO fuzziness, edits by length."""
    return 0 if len(word) < 3 else 1 if len(word) < 6 else 2


class TextIndex:
    """An index over ``weights`` (columns and their weights in scores) of rows with ``id_column``, kept at ``path``."""

    def __init__(self, spark: SparkSession, path: str, weights: dict[str, float], id_column: str = "doc_id"):
        self.spark, self.weights, self.id_column = spark, weights, id_column
        self.parts = Segments(spark, path)
        counts = ", ".join(f"f{i} int" for i in range(len(weights)))
        self.posting = f"term string, id bigint, version bigint, n int, {counts}, at array<int>, bucket int"

    # --- changes ------------------------------------------------------------------------------------------------------

    def add(self, rows: DataFrame) -> int:
        """Index ``rows``; those whose id is there take its place. The new version; one commit, all or nothing."""
        version, entries = self.parts.state()
        own = [F.lower(F.coalesce(F.array_join(c, " ") if rows.schema[c].dataType.typeName() == "array" else F.col(c).cast("string"), F.lit(""))).alias(f"w{i}") for i, c in enumerate(self.weights)]
        texts = rows.select(F.col(self.id_column).cast("bigint").alias("id"), *own).filter("id IS NOT NULL")
        if not texts.groupBy("id").count().filter("count > 1").isEmpty():
            texts = texts.groupBy("id").agg(F.max(F.struct(*(f"w{i}" for i in range(len(self.weights))))).alias("t")).select("id", "t.*")
        postings = texts.mapInArrow(_postings(len(self.weights)), "term string, id bigint, n int, at array<int>")
        dealt = postings.withColumn("bucket", F.when(F.col("term").isNull(), DOCUMENT).otherwise(bucket(F.col("term")))).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "id")
        counts = [F.size(self._of(F.col("at"), i)).alias(f"f{i}") for i in range(len(self.weights))]
        dealt = dealt.select("term", "id", F.lit(version + 1).cast("bigint").alias("version"), "n", *counts, "at", "bucket")
        new = self.parts.stored(dealt, "postings", "bucket")
        documents = self._documents([new])
        total = documents.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
        gone = self._gone(entries, documents.select("id"), version + 1)
        return self.parts.commit(version, [*entries, *gone, new | {"docs": total.docs, "words": total.words}])

    def delete(self, ids: DataFrame) -> int:
        """Take the documents of ``ids`` (the id column) out of the index; the new version."""
        version, entries = self.parts.state()
        return self.parts.commit(version, entries + self._gone(entries, ids.select(F.col(self.id_column).cast("bigint").alias("id")).distinct(), version + 1))

    def _of(self, at: Column, column: int) -> Column:
        """Of places those in a column."""
        return F.filter(at, lambda x: x % len(self.weights) == column)

    def _documents(self, entries: list[dict]) -> DataFrame:
        """id, version, n: each document's own row, dead ones too."""
        return self.parts.read(entries, "postings", self.posting).filter(F.col("bucket") == DOCUMENT).select("id", "version", "n")

    def _gone(self, entries: list[dict], ids: DataFrame, version: int) -> list[dict]:
        live = self._live(self._documents(entries), entries)
        dead = written(live.join(ids, "id", "left_semi").select("id", F.lit(version).cast("bigint").alias("before"), "n"))
        total = dead.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
        stored = [self.parts.stored(dead, "gone", docs=-total.docs, words=-total.words)] if total.docs else []
        forgotten(dead)
        return stored

    def _live(self, rows: DataFrame, entries: list[dict]) -> DataFrame:
        if not any(e["kind"] == "gone" for e in entries):
            return rows
        gone = self.parts.read(entries, "gone", "id bigint, before bigint, n int").groupBy("id").agg(F.max("before").alias("before"))
        return rows.join(gone.withColumnRenamed("id", "dead"), (F.col("id") == F.col("dead")) & (F.col("version") < F.col("before")), "left_anti")

    def merged(self) -> int:
        """Rewrite all live postings as one folder; the new version. Old folders stay until ``parts.vacuumed``."""
        version, entries = self.parts.state()
        live = self._live(self.parts.read(entries, "postings", self.posting), entries)
        dealt = live.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "id")
        docs, words = self.totals(entries)
        return self.parts.commit(version, [self.parts.stored(dealt, "postings", "bucket", docs=docs, words=words)])

    # --- queries ------------------------------------------------------------------------------------------------------

    def totals(self, entries: list[dict] | None = None) -> tuple[int, int]:
        """Live documents and their words."""
        entries = self.parts.state()[1] if entries is None else entries
        return sum(e.get("docs", 0) for e in entries), sum(e.get("words", 0) for e in entries)

    def postings(self, where: list[tuple[str, bool]], entries: list[dict] | None = None) -> DataFrame:
        """Live postings of terms: (word, True) the word itself, (word, False) all that begin with it."""
        entries = self.parts.state()[1] if entries is None else entries
        rows = self.parts.read(entries, "postings", self.posting)
        if all(exact or len(w) >= HEAD for w, exact in where):
            heads = sorted({w[:HEAD] for w, _ in where})
            rows = rows.filter(F.col("bucket").isin(*(bucket(F.lit(h)) for h in heads)))
        return self._live(rows.filter((F.col("bucket") != DOCUMENT) & reduce(or_, (_fits(w, exact) for w, exact in where))), entries)

    def search(self, query: str, k: int | None = None, within: DataFrame | None = None) -> DataFrame:
        """Q2: id and score of documents that hold all terms, best first, then smaller id; as ``engine.bm25``.

        Words match as prefixes, quoted ones as they are, several quoted words in a row. ``within``: ids that may be found.
        """
        return self.scored([("phrase" if phrase and len(text.split()) > 1 else "word" if phrase else "prefix", [text]) for text, phrase in parsed(query)], k, within)

    def fuzzy(self, query: str, k: int | None = None, within: DataFrame | None = None, expansions: int = 50) -> DataFrame:
        """Q4: as ``search`` for words with AUTO fuzziness: each stands for the terms within its edits (``expanded``)."""
        words = [w for text, _ in parsed(query) for w in text.split()]
        return self.scored([("word", list(self.expanded(w, expansions))) for w in words], k, within)

    def scored(self, terms: list[tuple[str, list[str]]], k: int | None = None, within: DataFrame | None = None) -> DataFrame:
        """Scores of documents that hold all ``terms``: (word, alternatives), (prefix, [start]) or (phrase, [words])."""
        _, entries = self.parts.state()
        docs, words = self.totals(entries)
        if not terms or not docs or any(not alternatives for _, alternatives in terms):
            return self.spark.createDataFrame([], f"{self.id_column} bigint, score double")
        where = [(w, kind != "prefix") for kind, alternatives in terms for text in alternatives for w in (text.split() if kind == "phrase" else [text])]
        rows = self.postings(where, entries)
        weight = [float(w) for w in self.weights.values()]
        weighed = reduce(add, (F.col(f"f{i}") * w for i, w in enumerate(weight)))
        sums = [F.max("n").alias("n")]
        for i, (kind, alternatives) in enumerate(terms):
            if kind == "phrase":
                sums += [F.max(F.when(F.col("term") == w, F.col("at"))).alias(f"t{i}_{j}") for j, w in enumerate(alternatives[0].split())]
            else:
                fits = reduce(or_, (_fits(w, kind != "prefix") for w in alternatives))
                sums.append(F.coalesce(F.sum(F.when(fits, weighed)), F.lit(0.0)).alias(f"t{i}"))
        held = rows.groupBy("id").agg(*sums)

        def in_a_row(i: int, n: int) -> Column:
            starts = reduce(F.array_intersect, (_shifted(F.coalesce(F.col(f"t{i}_{j}"), F.array().cast("array<int>")), j * len(weight)) for j in range(n)))
            return reduce(add, (F.size(self._of(starts, c)) * w for c, w in enumerate(weight)))

        held = held.select("id", "n", *((in_a_row(i, len(alternatives[0].split())) if kind == "phrase" else F.col(f"t{i}")).cast("double").alias(f"t{i}") for i, (kind, alternatives) in enumerate(terms)))
        frequency = held.agg(*(F.count_if(F.col(f"t{i}") > 0).alias(f"d{i}") for i in range(len(terms))))  # one row; its scan and shuffle are the other's
        norm = K1 * (1 - B + B * F.col("n") / (words / docs))
        idf = [F.greatest(F.lit(1e-6), F.ln((docs - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))) for i in range(len(terms))]
        score = reduce(add, (idf[i] * F.col(f"t{i}") * (K1 + 1) / (F.col(f"t{i}") + norm) for i in range(len(terms))))
        found = held.filter(reduce(and_, (F.col(f"t{i}") > 0 for i in range(len(terms))))).crossJoin(F.broadcast(frequency))
        if within is not None:
            found = found.join(within.select(F.col(self.id_column).alias("id")), "id", "left_semi")
        out = found.select(F.col("id").alias(self.id_column), F.round(score, 6).alias("score")).orderBy(F.desc("score"), self.id_column)
        return out.limit(k) if k else out

    def terms(self, prefix: str = "") -> DataFrame:
        """term and df: the live terms that begin with ``prefix``, with their numbers of documents."""
        return self.postings([(prefix, False)]).groupBy("term").agg(F.count("*").alias("df"))

    def expanded(self, word: str, most: int = 50) -> dict[str, int]:
        """Q4: terms within ``edits_of`` the word, with their numbers of documents: fewest edits, then most documents, ``most`` at most.

        Edits are insertions, deletions, replacements and swaps of neighbours, in code points. The terms' column
        alone is read; what passes the distance in the JVM is a few terms, counted there.
        """
        edits = edits_of(word)
        if not edits:
            return {r.term: r.df for r in self.postings([(word, True)]).groupBy("term").agg(F.count("*").alias("df")).collect()}
        _, entries = self.parts.state()
        rows = self._live(self.parts.read(entries, "postings", self.posting), entries)
        near = rows.filter(F.col("bucket") != DOCUMENT).filter(F.length("term").between(len(word) - edits, len(word) + edits)).select("term").filter(F.levenshtein("term", F.lit(word), 2 * edits) >= 0)  # a swap is two edits
        counted = near.groupBy("term").agg(F.count("*").alias("df"))
        found = [(within, -r.df, r.term) for r in counted.toLocalIterator() if (within := _apart(word, r.term)) <= edits]
        return {term: -df for _, df, term in sorted(found)[:most]}


def _fits(word: str, exact: bool) -> Column:
    return F.col("term") == word if exact else F.col("term").startswith(word)


def _shifted(places: Column, by: int) -> Column:
    return F.transform(places, lambda p: p - by)


def _apart(a: str, b: str) -> int:
    """Edits from a to b: insertions, deletions, replacements, swaps of neighbours (each place changed once)."""
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        before, last = last, row
    return last[-1]


def _postings(columns: int):  # noqa: ANN202
    """Arrow batches of (id, lower-case texts) as postings, and a row without a term for each document.

    A place is the number of a word in its column, times ``columns``, plus the column's number.
    """

    def rows_of(terms: list, ids: list, sizes: list, places: list) -> pa.RecordBatch:
        ends = np.cumsum([0, *map(len, places)])
        at = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.fromiter(chain.from_iterable(places), np.int32, int(ends[-1]))))
        return pa.record_batch({"term": pa.array(terms, pa.string()), "id": pa.array(ids, pa.int64()), "n": pa.array(sizes, pa.int32()), "at": at})

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [], [], [], []
        for batch in batches:
            for row, id_ in enumerate(batch.column(0).to_pylist()):
                found: defaultdict[str, list[int]] = defaultdict(list)
                n = 0
                for c in range(columns):
                    words = WORD.findall(batch.column(c + 1)[row].as_py())
                    n += len(words)
                    for w, at in zip(words, range(c, len(words) * columns + c, columns)):
                        found[w].append(at)
                terms, ids, sizes, places = held
                terms += [None, *found]
                places += [[], *found.values()]
                ids += [id_] * (len(found) + 1)
                sizes += [n] * (len(found) + 1)
                if len(terms) > ROWS:
                    yield rows_of(*held)
                    held = [], [], [], []
        if held[0]:
            yield rows_of(*held)

    return compute


def marked(text: Column, words: list[str]) -> Column:
    """Q4: ``text`` with every occurrence of the words, as whole words in any case, between <mark> and </mark>."""
    if not words:
        return text
    quoted = "|".join(r"\Q" + unicodedata.normalize("NFC", w).replace(r"\E", "") + r"\E" for w in sorted(words, key=len, reverse=True))
    return F.regexp_replace(text, rf"(?iu)(?<![\p{{L}}\p{{N}}_])({quoted})(?![\p{{L}}\p{{N}}_])", "<mark>$1</mark>")
