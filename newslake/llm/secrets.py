"""Secret scans with corpus-wide ownership frequency, in DataFrame functions alone.

Patterns find candidates in whole texts. Each candidate's hash is counted over the corpus by distinct
repositories and distinct owners: a value that more than ``MAX_OWNERS`` owners or ``MAX_REPOSITORIES``
repositories hold is a copied example; one that stays below both and looks random is a live credential. The
three base kinds are always reported; the further kinds only where ownership and form say "live".

Repository and owner are parameters, SQL expressions over the documents. By default the owner is ``source``, and
what a source has in one language is a repository of its own, so an owner may have several.

``split`` and ``regexp_extract_all`` on one pattern give the gaps and the matches in turn, so running
sums of their lengths are the places, in code points. Only documents with a match go on from the scan.

Null and empty texts have no spans; very long texts are matched whole, in the JVM. A null repository or owner
counts as one name of its own. Repeated rows return each and count once. An empty table gives an empty result. Extra
columns are not read, or kept whole by ``redacted``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newslake.llm.common import written

#: Kind, pattern, group of the secret, least length of it. The order is that of kinds.
#: No pattern relies on case folding or look-around, so that Java and RE2 agree.
BASE = [
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
#: A private key through its closing line (single hyphens may occur in fields, another opening line may not); where that is
#: missing, fields and lines of 16 and more base64 characters with a padded last one; or else the opening line alone. Line
#: breaks may be escaped. Java keeps no way back into a possessive group, so any number of lines takes no stack; RE2 has no
#: such groups and needs none. What follows the lines may be empty, so both take the same ones.
PEM = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(([^-]+-){0,8}[^-]*-----END [A-Z ]*PRIVATE KEY-----"
    r"|([\x20\t\r\n\\]+n?Proc-Type: [^\n\\]*[\x20\t\r\n\\]+n?DEK-Info: [^\n\\]*)?([\x20\t\r\n\\]+(r\\)?[A-Za-z0-9+/]{16,}={0,2})*+([\x20\t\r\n\\]+(r\\)?[A-Za-z0-9+/]{1,15}={1,2})?)"
)
PEM_RE2 = PEM.replace("*+([", "*([")
FURTHER = [
    ("pem", PEM, 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("vendor", r"(gh[opsur]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|[rs]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})", 0, 0),
    ("basic", r"[Bb]asic [A-Za-z0-9+/]{16,}={0,2}", 0, 0),
]
KINDS = BASE + FURTHER
#: Words that mark a placeholder.
PLACEHOLDER = "example|sample|changeme|placeholder|dummy|xxxx|your"
MAX_OWNERS, MAX_REPOSITORIES, MIN_VARIETY = 2, 4, 6
REPOSITORY, OWNER = "concat_ws('/', source, lang)", "source"
LONG_PEM = 200  # characters of a key from which such a word in its base64 is chance


def _found(text: Column, order: int) -> Column:
    """Struct of gaps, matches and secrets of a kind, null without a match."""
    _, pattern, group, _ = KINDS[order]
    p = F.lit(pattern)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    own = F.regexp_extract_all(text, p, F.lit(group)) if group else whole
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    return F.when(text.rlike(pattern), F.struct(F.lit(order).alias("kind"), gaps.alias("gaps"), F.transform(whole, lambda x: F.length(x)).alias("lengths"), own.alias("secrets")))


def scan(documents: DataFrame, repository: str, owner: str, keep_rows: bool = False) -> DataFrame:
    """One row a document: a row number, its names and what each kind's pattern matched; written once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    matched = F.array_compact(F.array(*(_found(text, i) for i in range(len(KINDS)))))
    columns = [F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.expr(repository).cast("string").alias("repository"), F.expr(owner).cast("string").alias("owner"), matched.alias("matched")]
    if keep_rows:
        columns.append(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("document"))
    return written(documents.select(*columns))


def candidates(scanned: DataFrame) -> DataFrame:
    """One row a match that is long enough: row, kind (its order), start, end, secret's hash and form."""
    kinds = scanned.filter(F.size("matched") > 0).select("row", "repository", "owner", F.explode("matched").alias("m"))
    each = kinds.select("row", "repository", "owner", "m.kind", F.posexplode(F.arrays_zip(F.slice("m.gaps", F.lit(1), F.size("m.lengths")).alias("gap"), F.col("m.lengths").alias("length"), F.col("m.secrets").alias("secret"))))
    each = each.select("row", "repository", "owner", "kind", "pos", "col.gap", "col.length", "col.secret")
    upto = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(upto))
    least = F.element_at(F.array(*(F.lit(k[3]) for k in KINDS)), F.col("kind") + 1)
    variety = F.size(F.array_distinct(F.split("secret", "")))
    key = (F.col("kind") == [k[0] for k in KINDS].index("pem")) & (F.length("secret") >= LONG_PEM)
    random = (variety >= MIN_VARIETY) & (key | ~F.lower("secret").rlike(PLACEHOLDER))
    return placed.filter(F.length("secret") >= least).select("row", "repository", "owner", "kind", (F.col("end") - F.col("length")).alias("start"), "end", F.sha2("secret", 256).alias("hash"), random.alias("random"))


def ownership(found: DataFrame) -> DataFrame:
    """Distinct repositories and owners of each candidate hash over the corpus."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    holders = found.select("hash", name("repository").alias("repository"), name("owner").alias("owner")).distinct()
    return holders.groupBy("hash").agg(F.countDistinct("repository").alias("n_repositories"), F.countDistinct("owner").alias("n_owners"))


def judged(found: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """Candidates with their holders' numbers and the verdicts live and example."""
    held = written(ownership(found))
    wide = (F.col("n_owners") > max_owners) | (F.col("n_repositories") > max_repositories)
    out = found.join(held, "hash").select("row", "kind", "start", "end", "n_repositories", "n_owners", (F.col("random") & ~wide).alias("live"))
    return out.withColumn("example", wide)


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k[0]) for k in KINDS))
    shown = F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"]))
    return F.array_join(shown, ",")


def scanned_secrets(documents: DataFrame, repository: str = REPOSITORY, owner: str = OWNER, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, most_owners, most_repositories."""
    scanned = scan(documents, repository, owner)
    verdicts = judged(written(candidates(scanned)), max_owners, max_repositories)
    kept = verdicts.filter((F.col("kind") < len(BASE)) | F.col("live"))
    count = lambda c: F.count_if(c)
    by_row = kept.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("all"),
        *(count(F.col("kind") == i).alias(f"n_{BASE[i][0]}") for i in range(len(BASE))),
        count(F.col("live")).alias("n_live"), count(F.col("example")).alias("n_example"), F.max("n_owners").alias("most_owners"), F.max("n_repositories").alias("most_repositories"),
    )
    joined = scanned.select("row", "doc_id").join(by_row, "row", "left")
    spans = F.coalesce("all", F.expr("CAST(array() AS array<struct<start:bigint,kind:int,end:bigint>>)"))
    base = F.filter(spans, lambda s: s["kind"] < len(BASE))
    zero = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint")).alias(c)
    return joined.select("doc_id", zero("n_assign"), zero("n_access"), zero("n_hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"), zero("n_live"), zero("n_example"), zero("most_owners"), zero("most_repositories"))


def redacted(documents: DataFrame, repository: str = REPOSITORY, owner: str = OWNER, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES, mask: str = "[SECRET]") -> DataFrame:
    """All documents with their columns; live credentials in ``text`` are masked, ``n_chars`` follows if there.

    Copied examples (more than ``max_owners`` owners or ``max_repositories`` repositories) and values without a random form stay.
    """
    scanned = scan(documents, repository, owner, keep_rows=True)
    live = judged(written(candidates(scanned)), max_owners, max_repositories).filter("live")
    # islands of overlapping spans
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    opened = live.withColumn("reach", F.max("end").over(before)).withColumn("island", F.count_if(F.col("reach").isNull() | (F.col("start") >= F.col("reach"))).over(upto))
    islands = opened.groupBy("row", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    masks = islands.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("masks"))
    hits = scanned.filter(F.size("matched") > 0).select("row", "document").join(masks, "row", "left")
    text = F.col("document.text")
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.col("masks.end"))
    gaps = F.zip_with(ends, F.concat(F.col("masks.start"), F.array(F.length(text).cast("bigint"))), lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int")))
    clean = F.when(F.col("masks").isNull(), text).otherwise(F.array_join(gaps, mask))
    own = dict.fromkeys(documents.columns)
    fields = {c: F.col(f"document.`{c}`") for c in own}
    fields["text"] = clean
    if "n_chars" in fields:
        fields["n_chars"] = F.when(F.col("masks").isNull(), F.col("document.n_chars")).otherwise(F.length(clean)).cast(documents.schema["n_chars"].dataType)
    changed = hits.select(*(v.alias(c) for c, v in fields.items()))
    rest = scanned.filter(F.size("matched") == 0).select(*(F.col(f"document.`{c}`").alias(c) for c in own))
    return rest.unionByName(changed)


def oracle(table: str = "documents", repository: str = REPOSITORY, owner: str = OWNER) -> str:
    """``scanned_secrets`` as DuckDB SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for i, (_, pattern, group, least) in enumerate(KINDS):
        p = q(PEM_RE2 if pattern == PEM else pattern)
        parts.append(f"SELECT rid, rep, own, {i} AS kind, {least} AS least, unnest(range(len(regexp_extract_all(t, {p}, 0)))) AS i, string_split_regex(t, {p}) AS gaps, regexp_extract_all(t, {p}, 0) AS ms, regexp_extract_all(t, {p}, {group}) AS ss FROM d WHERE regexp_matches(t, {p})")
    names = "[" + ", ".join(q(k[0]) for k in KINDS) + "]"
    text = f"string_agg({names}[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind, e)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || {repository}, '') AS rep, coalesce('=' || {owner}, '') AS own, coalesce(text, '') AS t FROM {table}),
m AS ({' UNION ALL '.join(parts)}),
p AS (SELECT rid, rep, own, kind, ss[i + 1] AS secret, list_sum(list_transform(gaps[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i], lambda x: length(x))), 0) AS s, length(ms[i + 1]) AS n FROM m WHERE length(ss[i + 1]) >= least),
h AS (SELECT secret, count(DISTINCT own) AS owners, count(DISTINCT rep) AS reps FROM p GROUP BY secret),
j AS (SELECT rid, kind, CAST(s AS BIGINT) AS s, CAST(s + n AS BIGINT) AS e, owners, reps, owners <= {MAX_OWNERS} AND reps <= {MAX_REPOSITORIES} AND len(list_distinct(string_split(secret, ''))) >= {MIN_VARIETY} AND (kind = {[k[0] for k in KINDS].index('pem')} AND length(secret) >= {LONG_PEM} OR NOT regexp_matches(lower(secret), {q(PLACEHOLDER)})) AS live FROM p JOIN h USING (secret)),
a AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, {text.replace(' ORDER', ' ORDER', 1)} FILTER (kind < {len(BASE)}) AS base, {text} AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (owners > {MAX_OWNERS} OR reps > {MAX_REPOSITORIES}) AS n_example, max(owners) AS most_owners, max(reps) AS most_repositories FROM j WHERE kind < {len(BASE)} OR live GROUP BY rid)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, CAST(coalesce(n_live, 0) AS BIGINT) AS n_live, CAST(coalesce(n_example, 0) AS BIGINT) AS n_example, CAST(coalesce(most_owners, 0) AS BIGINT) AS most_owners, CAST(coalesce(most_repositories, 0) AS BIGINT) AS most_repositories
FROM d LEFT JOIN a USING (rid)"""
