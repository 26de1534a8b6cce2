"""Secret scans with corpus-wide ownership frequency.

Candidates are found by patterns in whole texts, as spans in code points. A candidate's value is kept only
as a hash. Hashes are counted over the corpus by distinct repositories and by distinct owners: a value that
many owners hold is a copied example, one that a single owner holds, in however many repositories, and that looks
random is live. In ``documents`` a row is a repository and ``source`` is its owner.

All of it is Column expressions, joins and aggregations. Positions come from cutting a text at a pattern's
matches: the lengths of the parts and of the matches add up to the offsets.

Defined results: null and empty texts have no spans; a null owner counts as an owner of its own; spans of one
kind don't overlap, spans of different kinds may; repeated rows each have their spans and count as one
repository where their id is the same; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written


class Kind(NamedTuple):
    """A pattern, the group that holds the secret value, and the least characters of that group."""

    name: str
    pattern: str
    group: int
    least: int


#: The base kinds.
BASE_KINDS = [
    Kind("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Kind("access", r"(AKIA[A-Z0-9]+)", 1, 16),
    Kind("hex", r"([0-9a-f]{32,})", 1, 32),  # a run of fewer can't hold a run of 32, so the bound may stand in the pattern
]
#: Public formats of further credentials; only owner-specific ones are reported.
MORE_KINDS = [
    Kind("bearer", r"Bearer\x20+([A-Za-z0-9._~+/-]{20,})", 1, 20),
    Kind("userinfo", r"://([A-Za-z0-9._-]+:[^\x00-\x20/@:]+)@", 1, 3),
    Kind("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----([A-Za-z0-9+/=\x0A\x0D]+)-----END", 1, 32),
]
MASK = "[SECRET]"

#: A value is an example from so many distinct owners.
EXAMPLE_OWNERS = 2
#: Distinct characters of a value that looks random.
LIVE_CHARACTERS = 6

SPAN = "array<struct<start:int,end:int,no:int,kind:string,base:boolean,hash:string,random:boolean>>"


def spans_of(text: Column, kind: Kind, no: int, base: bool) -> Column:
    """Leftmost non-overlapping matches of a kind, without those whose value is too short."""
    found, values = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group))
    between = F.split(text, kind.pattern, -1)
    steps = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda b, m: F.struct(F.length(b).alias("b"), F.length(m).alias("m")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    placed = F.aggregate(
        steps,
        zero,
        lambda acc, s: F.struct(
            (acc["at"] + s["b"] + s["m"]).alias("at"),
            F.array_append(acc["spans"], F.struct((acc["at"] + s["b"]).alias("start"), (acc["at"] + s["b"] + s["m"]).alias("end"))).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    whole = F.zip_with(
        placed,
        values,
        lambda p, v: F.struct(
            p["start"].alias("start"),
            p["end"].alias("end"),
            F.lit(no).alias("no"),
            F.lit(kind.name).alias("kind"),
            F.lit(base).alias("base"),
            F.when(F.length(v) >= kind.least, F.sha2(v, 256)).alias("hash"),
            (F.size(F.array_distinct(F.split(v, ""))) >= LIVE_CHARACTERS).alias("random"),
        ),
    )
    return F.when(text.rlike(kind.pattern), F.filter(whole, lambda s: s["hash"].isNotNull())).otherwise(F.array().cast(SPAN))


def all_spans(text: Column) -> Column:
    kinds = [(k, True) for k in BASE_KINDS] + [(k, False) for k in MORE_KINDS]
    return F.sort_array(F.concat(*(spans_of(text, k, no, base) for no, (k, base) in enumerate(kinds))))


def ownership(candidates: DataFrame, repository: str, owner: str, spans: str = "spans") -> DataFrame:
    """For each hash, over rows of ``spans``: n_repositories and n_owners that hold it."""
    flat = candidates.select(
        F.explode(F.array_distinct(F.transform(spans, lambda s: s["hash"]))).alias("hash"),
        F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"),
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
    )
    return flat.groupBy("hash").agg(F.countDistinct("repository").alias("n_repositories"), F.countDistinct("owner").alias("n_owners"))


def with_verdicts(found: DataFrame, repository: str, owner: str, spans: str = "spans", live: str = "live") -> DataFrame:
    """``found`` (a written table: ``_row``, id columns and ``spans``) with ``live``: for each span whether its value is live.

    ``n_<live>`` says beside it how many repositories hold the value, where one owner alone holds it (null elsewhere). Hashes meet their counts
    in a join of small rows; texts stay out of it. ``_row`` numbers the rows in the table itself, so that both readings agree.
    """
    # A table of its own, so that Spark can split a widely copied value in the join; those of many owners stay out of it.
    rare = written(ownership(found, repository, owner, spans).filter(F.col("n_owners") < EXAMPLE_OWNERS).select("hash", "n_repositories"), "rare-secrets")
    single = found.select("_row", F.posexplode(spans).alias("_at", "span")).withColumn("hash", F.col("span.hash"))
    live_span = F.col("span.random") & F.col("n_repositories").isNotNull()
    judged = single.join(rare, "hash", "left").select("_row", F.struct(F.col("_at"), live_span.alias("live"), "n_repositories").alias("v"))
    rows = judged.groupBy("_row").agg(F.sort_array(F.collect_list("v")).alias("_v"))
    rows = rows.select("_row", F.transform("_v", lambda v: v["live"]).alias(live), F.transform("_v", lambda v: v["n_repositories"]).alias(f"n_{live}"))
    none = {live: F.array().cast("array<boolean>"), f"n_{live}": F.array().cast("array<long>")}
    return found.join(rows, "_row", "left").withColumns({c: F.coalesce(c, empty) for c, empty in none.items()}).drop("_row")


def scan_secrets(docs: DataFrame, repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """doc_id, ``spans`` (all candidates in order), ``live`` and ``n_live`` for every row of ``docs`` (doc_id, text, owner)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keep = [F.col(c) for c in dict.fromkeys(["doc_id", repository, owner])]
    found = written(docs.select(F.monotonically_increasing_id().alias("_row"), *keep, all_spans(text).alias("spans")), "secret-spans")
    return with_verdicts(found, repository, owner).select("doc_id", "spans", "live", "n_live")


def mask_secrets(docs: DataFrame, repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """``docs`` with every live value's span replaced by MASK and n_chars brought up to date; other rows as they were.

    Only rows with candidates are written, joined and rebuilt.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    some = F.lit(False)
    for kind in (*BASE_KINDS, *MORE_KINDS):
        some = some | text.rlike(kind.pattern)
    hit = written(docs.filter(some).withColumns({"_spans": all_spans(text), "_row": F.monotonically_increasing_id()}), "secret-texts")
    judged = with_verdicts(hit, repository, owner, "_spans", "_live")
    chosen = F.filter(F.transform("_spans", lambda s, i: F.when(F.get("_live", i), s)), lambda s: s.isNotNull())
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    masked = F.aggregate(
        chosen,
        zero,
        lambda acc, s: F.struct(
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(MASK))).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))),
    )
    rebuilt = judged.withColumn("text", F.when(F.exists("_live", lambda v: v), masked).otherwise(F.col("text"))).select(*docs.columns)
    if "n_chars" in docs.columns:
        rebuilt = rebuilt.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs.filter(~some).unionByName(rebuilt)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_digests(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_examples and live_repositories (the most repositories that
    hold one of the row's live values, 0 without any) of what ``scan_secrets`` gives.
    """
    of = lambda name: F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long")
    shown = F.filter(F.transform("spans", lambda s, i: F.when(s["base"] | F.get("live", i), s)), lambda s: s.isNotNull())
    base = F.filter("spans", lambda s: s["base"])
    return scanned.select(
        "doc_id",
        *(of(k.name).alias(f"n_{k.name}") for k in BASE_KINDS),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(shown).alias("spans"),
        F.size(F.filter("live", lambda v: v)).cast("long").alias("n_live"),
        F.size(F.filter("live", lambda v: ~v)).cast("long").alias("n_examples"),
        F.coalesce(F.array_max(F.zip_with("live", "n_live", lambda v, n: F.when(v, n))), F.lit(0)).cast("long").alias("live_repositories"),
    )


def oracle() -> str:
    """The same for DuckDB: matches as rows, offsets as running sums."""
    parts = []
    for no, (kind, base) in enumerate([(k, True) for k in BASE_KINDS] + [(k, False) for k in MORE_KINDS]):
        pattern = kind.pattern.replace("'", "''")
        parts.append(f"""
SELECT rid, {no} AS no, '{kind.name}' AS kind, {str(base).lower()} AS base, i, least_chars, m, v, p FROM (
  SELECT rid, {kind.least} AS least_chars, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(vs) AS v, unnest(ps[1 : len(ms)]) AS p FROM (
    SELECT rid, regexp_extract_all(t, '{pattern}') AS ms, regexp_extract_all(t, '{pattern}', {kind.group}) AS vs, string_split_regex(t, '{pattern}') AS ps
    FROM d WHERE regexp_matches(t, '{pattern}')))""")
    cells = ", ".join(f"CAST(count(*) FILTER (kind = '{k.name}') AS BIGINT) AS n_{k.name}" for k in BASE_KINDS)
    joined = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, e, no)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
placed AS (SELECT *, sum(length(p) + length(m)) OVER (PARTITION BY rid, no ORDER BY i) AS e FROM m),
s AS (SELECT rid, no, kind, base, CAST(e - length(m) AS BIGINT) AS s, CAST(e AS BIGINT) AS e, sha256(v) AS hash,
             len(list_distinct(string_split(v, ''))) >= {LIVE_CHARACTERS} AS random
      FROM placed WHERE length(v) >= least_chars),
own AS (SELECT hash, count(DISTINCT coalesce(source, '')) AS owners, count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), '')) AS repositories FROM s JOIN d USING (rid) GROUP BY hash),
j AS (SELECT s.*, random AND owners < {EXAMPLE_OWNERS} AS live, repositories FROM s JOIN own USING (hash)),
g AS (SELECT rid, {cells}, {joined} FILTER (base) AS b, {joined} FILTER (base OR live) AS a,
             count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_examples, max(repositories) FILTER (live) AS r FROM j GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in BASE_KINDS)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans,
       coalesce(n_live, 0) AS n_live, coalesce(n_examples, 0) AS n_examples, coalesce(r, 0) AS live_repositories
FROM d LEFT JOIN g USING (rid)"""
