"""Secret scans, native: pattern candidates judged by corpus-wide ownership frequency.

Spans of three base kinds and five further kinds are found with built-in regular expressions; offsets come from the
lengths of what lies between the matches. The hash of every candidate value is counted over the whole corpus by distinct
repositories and distinct owners. A value that at least `widely` owners hold is a copied example, and so is one that at least two owners hold in
at least `spread` repositories; any other is owner-specific and live-looking, in however many repositories of one owner it stands. Base
spans are always reported, further kinds only where they are live-looking.

Defined results: a null text is an empty one and has no spans; a null owner or repository counts as one of its own;
very long texts are scanned whole; spans that start together are listed by kind; repeated rows are each reported and count once for their
repository; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_unique, saved, split, table

# The base kinds, in their order of rank, and the group that is the secret.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: Kinds that the ownership method adds.
FURTHER = {
    "bearer": (r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 20),
    "platform": (r"(?:gh[pousr]_[A-Za-z0-9]{36,}|[rs]k_(?:live|test)_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35})", 0, 15),
    "private": (r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}", 0, 40),
    "url": (r"[A-Za-z][A-Za-z0-9+.]{0,20}://[^\s:/@]{1,64}:([^\s:/@]{6,128})@", 1, 6),
    "upper": (r"(?<![0-9A-Za-z])(?=[0-9A-F]{0,40}[0-9])[0-9A-F]{32,}(?![0-9A-Za-z])", 0, 32),
}
KINDS = BASE | FURTHER
#: From so many distinct owners on, a value is a copied example.
WIDELY = 4
#: From so many distinct repositories on, a value that two owners or more hold is a copied example.
SPREAD = 50
_SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string,secret:string>"


def spans_of(text: Column, kind: str) -> Column:
    """All spans of a kind as structs, by start: leftmost matches that don't overlap, the short ones dropped."""
    pattern, group, least = KINDS[kind]
    rank = list(KINDS).index(kind)
    between, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["b"])
        end = start + F.length(pair["m"])
        secret = F.regexp_extract(pair["m"], pattern if kind != "upper" else "^.*$", group)
        span = F.struct(start.cast("bigint").alias("start"), F.lit(rank).alias("rank"), end.cast("bigint").alias("end"), F.lit(kind).alias("kind"), secret.alias("secret"))
        out = F.when(F.length(secret) >= least, F.concat(state["out"], F.array(span))).otherwise(state["out"])
        return F.struct(end.cast("bigint").alias("at"), out.alias("out"))

    pairs = F.transform(F.arrays_zip(F.slice(between, 1, F.size(matches)).alias("b"), matches.alias("m")), lambda x: F.struct(x["b"].alias("b"), x["m"].alias("m")))
    found = F.aggregate(pairs, begin, step, lambda s: s["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{_SPAN}>"))


def listed(spans: Column) -> Column:
    """kind:start:end of spans by start and rank, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def candidates(docs: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """Per row: row_id, doc_id, repository, owner, base spans and further spans."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", text.alias("text"), repository.cast("string").alias("repository"), owner.cast("string").alias("owner"))
    one = docs.select("row_id", "doc_id", "repository", "owner", *(spans_of(F.col("text"), k).alias(k) for k in KINDS))
    return one.select("row_id", "doc_id", "repository", "owner", F.concat(*BASE).alias("base"), F.concat(*FURTHER).alias("further"))


def ownership(found: DataFrame) -> DataFrame:
    """secret_hash, repositories and owners (distinct numbers over the whole corpus) of every candidate value."""
    one = found.select("row_id", "repository", "owner", F.explode(F.array_distinct(F.transform(F.concat("base", "further"), lambda s: s["secret"]))).alias("secret"))
    one = one.select(F.sha2("secret", 256).alias("secret_hash"), F.coalesce("repository", F.concat(F.lit("row "), F.col("row_id"))).alias("repository"), F.coalesce("owner", F.concat(F.lit("row "), F.col("row_id"))).alias("owner"))
    count = [one.select("secret_hash", c).distinct().groupBy("secret_hash").agg(F.count("*").alias(n)) for c, n in (("repository", "repositories"), ("owner", "owners"))]
    return reduce(lambda a, b: a.join(b, "secret_hash"), count)


def judged(found: DataFrame, widely: int = WIDELY, spread: int = SPREAD) -> DataFrame:
    """row_id, its judged spans (structs as in `candidates`, with live: not a copied example), and the most repositories and owners of a value in it. Rows without spans are absent."""
    counts = saved(ownership(found), "secret-owners")
    one = found.select("row_id", F.explode(F.concat("base", "further")).alias("span")).withColumn("secret_hash", F.sha2(F.col("span.secret"), 256))
    live = (F.col("owners") < widely) & ((F.col("owners") < 2) | (F.col("repositories") < spread))
    one = join_unique(one, counts, "secret_hash").select("row_id", F.struct("span.start", "span.rank", "span.end", "span.kind", live.alias("live")).alias("span"), "repositories", "owners")
    return one.groupBy("row_id").agg(F.array_sort(F.collect_list("span")).alias("spans"), F.max("repositories").alias("repositories"), F.max("owners").alias("owners"))


def scan(docs: DataFrame, repository: Column | None = None, owner: Column | None = None, widely: int = WIDELY, spread: int = SPREAD) -> DataFrame:
    """One row per document row: numbers of base spans, their digest, all reported spans, live and copied numbers, and the most repositories and owners that a value in it has (0 without one)."""
    repository = F.col("doc_id") if repository is None else repository
    owner = F.col("source") if owner is None else owner
    found = saved(candidates(docs, repository, owner), "secret-spans")
    out = found.drop("repository", "owner").join(judged(found, widely, spread), "row_id", "left")
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = F.coalesce(F.filter("spans", lambda s: (s["rank"] < len(BASE)) | s["live"]), F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,live:boolean>>"))
    live = F.size(F.filter(spans, lambda s: s["live"])).cast("long")
    return out.select("doc_id", *map(n, BASE), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(spans).alias("spans"), live.alias("n_live"), (F.size(spans).cast("long") - live).alias("n_copied"), *(F.coalesce(c, F.lit(0)).cast("long").alias(f"most_{c}") for c in ("repositories", "owners")))


def redact(docs: DataFrame, repository: Column | None = None, owner: Column | None = None, widely: int = WIDELY, spread: int = SPREAD, mark: str = "[secret]") -> DataFrame:
    """docs with `mark` in place of every live-looking span; copied examples and all other text stay."""
    repository = F.col("doc_id") if repository is None else repository
    owner = F.col("source") if owner is None else owner
    some = reduce(lambda a, b: a | b, (F.coalesce("text", F.lit("")).rlike(p) for p, _, _ in KINDS.values()))
    # The row stands in one column, so that its names clash with none.
    row = [F.monotonically_increasing_id().alias("row_id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")]
    held = saved(docs.where(some).select(*row, repository.cast("string").alias("repository"), owner.cast("string").alias("owner")), "secret-documents")
    # The patterns run once over a text: what certainly isn't among the held texts is clean.
    maybe, certain = split(docs, held.select("doc.text"), "text")
    clean = certain.union(maybe.where(~some))
    found = held.select("row_id", "repository", "owner", *(spans_of(F.coalesce("doc.text", F.lit("")), k).alias(k) for k in KINDS))
    found = saved(found.select("row_id", "repository", "owner", F.concat(*BASE).alias("base"), F.concat(*FURTHER).alias("further")), "secret-spans")
    spans = judged(found, widely, spread).select("row_id", F.filter("spans", lambda s: s["live"]).alias("spans"))
    both = held.select("row_id", "doc").join(spans, "row_id", "left")

    def step(state: Column, s: Column) -> Column:
        piece = F.concat(state["out"], F.substr("doc.text", (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int")), F.lit(mark))
        later = F.struct(s["end"].alias("at"), piece.alias("out"))
        longer = F.struct(F.greatest(s["end"], state["at"]).alias("at"), state["out"].alias("out"))
        return F.when(s["start"] >= state["at"], later).otherwise(longer)

    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    rest = lambda s: F.concat(s["out"], F.substr("doc.text", (s["at"] + 1).cast("int")))
    text = F.when(F.size("spans") > 0, F.aggregate("spans", zero, step, rest)).otherwise(F.col("doc.text"))
    return clean.union(both.select(*(text.alias(c) if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns)))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _duck(kind: str, rank: int) -> str:
    """A kind's spans in DuckDB: matches and what lies between them, side by side. The look-around of `upper` becomes a condition on whole runs of letters and digits."""
    pattern, group, least = KINDS[kind]
    pattern = "[0-9A-Za-z]+" if kind == "upper" else pattern.replace("'", "''")
    fits = "AND regexp_full_match(m, '[0-9A-F]+') AND regexp_matches(left(m, 41), '[0-9]')" if kind == "upper" else ""
    return f"""SELECT row_id, '{kind}' AS kind, {rank} AS rank, starts AS start, starts + length(m) AS stop, secret FROM (
      SELECT row_id, m, regexp_extract(m, '{pattern}', {group}) AS secret, CAST(sum(length(b)) OVER w + sum(length(m)) OVER w - length(m) AS BIGINT) AS starts
      FROM (SELECT row_id, unnest(regexp_extract_all(text, '{pattern}')) AS m, unnest(string_split_regex(text, '{pattern}')) AS b, unnest(range(len(string_split_regex(text, '{pattern}')))) AS k FROM docs)
      WHERE m IS NOT NULL WINDOW w AS (PARTITION BY row_id ORDER BY k)) WHERE length(secret) >= {least} {fits}"""


_LISTED = "string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY start, rank)"
OP4_SQL = f"""
WITH docs AS (
  SELECT *, coalesce(CAST(doc_id AS VARCHAR), 'row ' || row_id) AS repository, coalesce(source, 'row ' || row_id) AS owner FROM (SELECT row_number() OVER () AS row_id, doc_id, source, coalesce(text, '') AS text FROM documents)
), spans AS ({" UNION ALL ".join(_duck(k, n) for n, k in enumerate(KINDS))}
), counts AS (SELECT secret, count(DISTINCT repository) AS repositories, count(DISTINCT owner) AS owners FROM spans JOIN docs USING (row_id) GROUP BY secret
), judged AS (SELECT spans.*, repositories, owners, owners < {WIDELY} AND (owners < 2 OR repositories < {SPREAD}) AS live FROM spans JOIN counts USING (secret)
), told AS (
  SELECT row_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)}, {_LISTED} FILTER (rank < 3) AS base, {_LISTED} FILTER (rank < 3 OR live) AS spans,
    count(*) FILTER (live) AS n_live, count(*) FILTER (rank < 3 AND NOT live) AS n_copied, max(repositories) AS most_repositories, max(owners) AS most_owners FROM judged GROUP BY row_id
)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("n_live", "n_copied", "most_repositories", "most_owners"))}
FROM docs LEFT JOIN told USING (row_id)
"""
