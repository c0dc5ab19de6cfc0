"""Search (Q1-Q9, F10, F24): query parsing on the driver, ranking as DataFrame plans."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslake.functions import text as T

#: Weights of columns and constants of BM25.
WEIGHTS = {"title": 5.0, "clean_text": 1.0, "summary": 2.0, "tags": 3.0}
K1, B = 1.2, 0.75


def parsed(query: str) -> list[tuple[str, bool]]:
    """terms of a query: (words, is a phrase); other words match as prefixes. Operators are dropped."""
    terms = [(p.strip().lower(), True) for p in re.findall(r'"([^"]+)"', query) if re.search(r"\w", p)]
    rest = re.sub(r'"[^"]*"?', " ", query)
    words = [w.lower() for w in re.findall(r"\w+", rest) if w not in ("AND", "OR", "NOT", "NEAR")]
    return terms + [(w, False) for w in words]


def match_expression(query: str) -> str:
    """the terms as a full-text match expression."""
    return " ".join(f'"{w}"' if phrase else f'"{w}"*' for w, phrase in parsed(query))


def like(rows: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Q1, Q6: rows with the query anywhere in a column; ``%`` and ``_`` in it are literal."""
    safe = re.sub(r"([%_\\])", r"\\\1", query)
    return rows.filter(reduce(or_, (F.col(c).ilike(f"%{safe}%") for c in columns)))


def bm25(rows: DataFrame, query: str, weights: dict[str, float], id_column: str = "doc_id", k: int | None = None) -> DataFrame:
    """Q2: id and score of rows that hold all terms, best first, then smaller id.

    A term's frequency in a row is the sum over columns of weight times occurrences; lengths count all
    columns. Statistics are one aggregate over the table.
    """
    terms = parsed(query)
    if not terms:
        return rows.select(id_column, F.lit(0.0).alias("score")).limit(0)

    def occurrences(words: Column, term: tuple[str, bool]) -> Column:
        text, phrase = term
        own = text.split()
        if phrase and len(own) > 1:
            at = F.sequence(F.lit(1), F.greatest(F.size(words) - len(own) + 1, F.lit(1)))
            return F.size(F.filter(at, lambda i: F.slice(words, i, len(own)) == F.array(*map(F.lit, own))))
        return F.size(F.filter(words, (lambda w: w == text) if phrase else (lambda w: w.startswith(text))))

    held = rows.select(id_column, *(T.words(F.col(c).cast("string") if c != "tags" else F.array_join(c, " ")).alias(f"w_{c}") for c in weights))
    counted = held.select(id_column, reduce(lambda a, b: a + b, (F.size(f"w_{c}") for c in weights)).alias("n"), *(reduce(lambda a, b: a + b, (occurrences(F.col(f"w_{c}"), t) * w for c, w in weights.items())).cast("double").alias(f"t{i}") for i, t in enumerate(terms)))
    stats = counted.agg(F.count("*").alias("total"), F.avg("n").alias("avg_n"), *(F.count_if(F.col(f"t{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    both = counted.filter(reduce(and_, (F.col(f"t{i}") > 0 for i in range(len(terms))))).crossJoin(F.broadcast(stats))  # one row
    norm = K1 * (1 - B + B * F.col("n") / F.col("avg_n"))
    idf = lambda i: F.greatest(F.lit(1e-6), F.ln((F.col("total") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)))
    score = reduce(lambda a, b: a + b, (idf(i) * F.col(f"t{i}") * (K1 + 1) / (F.col(f"t{i}") + norm) for i in range(len(terms))))
    out = both.select(id_column, F.round(score, 6).alias("score")).orderBy(F.desc("score"), id_column)
    return out.limit(k) if k else out


def snippet(query: str, *columns: Column) -> Column:
    """Q2: 120 characters around the first term in the first column that holds one."""
    first = None
    for c in columns:
        for words, _ in parsed(query):
            at = F.instr(F.lower(c), words)
            piece = F.substr(c, F.greatest(F.lit(1), at - 40), F.lit(120))
            first = F.when(at > 0, piece) if first is None else first.when(at > 0, piece)
    return first.otherwise(F.substring(columns[0], 1, 120)) if first is not None else F.substring(columns[0], 1, 120)


@dataclass(frozen=True)
class Search:
    """Q3: a fluent query; each method returns a new one and ``build`` a plan."""

    text: str = ""
    fields: tuple[tuple[str, float], ...] = ()
    fuzzy: int = 0
    filters: tuple[Column, ...] = ()
    least: float = 0.0
    order: tuple[Column, ...] = ()
    page: tuple[int, int] = (0, 20)
    synonyms: dict[str, list[str]] = field(default_factory=dict)

    def match(self, text: str, fuzzy: int = 0, **fields: float) -> Search:
        return replace(self, text=text, fuzzy=fuzzy, fields=tuple(fields.items()))

    def term(self, column: str, *values) -> Search:  # noqa: ANN002
        return replace(self, filters=(*self.filters, F.col(column).isin(*values)))

    def span(self, column: str, low=None, high=None) -> Search:  # noqa: ANN001
        own = [F.col(column) >= low] * (low is not None) + [F.col(column) <= high] * (high is not None)
        return replace(self, filters=(*self.filters, *own))

    def without(self, column: str, *values) -> Search:  # noqa: ANN002
        return replace(self, filters=(*self.filters, ~F.col(column).isin(*values)))

    def min_score(self, least: float) -> Search:
        return replace(self, least=least)

    def sort(self, *order: Column) -> Search:
        return replace(self, order=order)

    def paged(self, start: int, size: int) -> Search:
        return replace(self, page=(max(0, start), min(100, max(1, size))))

    def also(self, **synonyms: list[str]) -> Search:
        return replace(self, synonyms=synonyms)

    def scored(self, rows: DataFrame) -> DataFrame:
        """Rows that pass the filters with ``score``: the best column's boost times the share of words found."""
        rows = reduce(lambda r, c: r.filter(c), self.filters, rows)
        words = [w for w, _ in parsed(self.text)]
        if not words:
            return rows.withColumn("score", F.lit(1.0))

        def found(column: str) -> Column:
            own = F.array_distinct(T.words(F.col(column)))
            hit = lambda w: F.array_contains(own, w) if not self.fuzzy else F.exists(own, lambda x: F.levenshtein(x, F.lit(w), self.fuzzy) >= 0)
            one = lambda w: reduce(or_, (hit(x) for x in [w, *self.synonyms.get(w, [])]))
            return reduce(lambda a, b: a + b, (one(w).cast("double") for w in words)) / len(words)

        best = [found(c) * boost for c, boost in self.fields]
        score = F.greatest(*best) if len(best) > 1 else best[0]
        return rows.withColumn("score", F.round(score, 6)).filter((F.col("score") > 0) & (F.col("score") >= self.least))

    def build(self, rows: DataFrame, id_column: str = "doc_id") -> DataFrame:
        start, size = self.page
        return self.scored(rows).orderBy(*(self.order or (F.desc("score"),)), id_column).offset(start).limit(size)

    def facet(self, rows: DataFrame, column: str, size: int = 20) -> DataFrame:
        return self.scored(rows).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(size)


def semantic(rows: DataFrame, query: list[float], k: int, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Q5: the ``k`` nearest by cosine, then smaller id."""
    length = sum(x * x for x in query) ** 0.5
    own = F.transform(vector, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(own, F.array(*(F.lit(float(x)) for x in query)), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    size = F.sqrt(F.aggregate(own, F.lit(0.0), lambda a, x: a + x * x))
    return rows.select(id_column, F.round(dot / (size * length), 6).alias("score")).orderBy(F.desc("score"), id_column).limit(k)


@dataclass(frozen=True)
class Analysis:
    """what a query wants."""

    query: str
    intent: str
    terms: list[str]
    score: float
    accepted: bool
    reason: str


def analyzed(query: str, vocabulary: list[str], synonyms: dict[str, list[str]], least: float = 0.1) -> Analysis:
    """2 to 500 characters; addresses, help, trending and discovery are told apart; others need words of the field."""
    q = query.strip()
    if not 2 <= len(q) <= 500:
        return Analysis(q, "invalid", [], 0.0, False, "LENGTH")
    low = q.lower()
    words = re.findall(r"\w+", low)
    terms = list(dict.fromkeys([*words, *(s for w in words for s in synonyms.get(w, []))]))
    intent = "url" if re.match(r"https?://", low) else "help" if low in ("help", "?") else "trending" if re.search(r"\b(trending|popular|top)\b", low) else "discovery" if re.search(r"\b(find|discover|new sources)\b", low) else "search"
    score = round(sum(t in vocabulary for t in terms) / max(1, len(terms)), 3)
    ok = intent != "search" or score >= least
    return Analysis(q, intent, terms, score, ok, "" if ok else "NOT_TECH")


def sanitized(query: Column) -> Column:
    """F10 as a column: quoted phrases, then the other words as prefixes; operators and signs are dropped."""
    phrases = F.filter(F.transform(F.regexp_extract_all(query, F.lit('"([^"]+)"'), F.lit(1)), lambda p: F.lower(F.trim(p))), lambda p: p.rlike(T.WORD))
    rest = F.regexp_replace(query, '"[^"]*"?', " ")
    words = F.filter(F.regexp_extract_all(rest, F.lit(f"({T.WORD})"), F.lit(1)), lambda w: ~w.isin("AND", "OR", "NOT", "NEAR"))
    quoted = F.transform(phrases, lambda p: F.concat(F.lit('"'), p, F.lit('"')))
    return F.array_join(F.concat(quoted, F.transform(words, lambda w: F.concat(F.lit('"'), F.lower(w), F.lit('"*')))), " ")
