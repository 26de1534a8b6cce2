"""Quality rules as one projection.

Word, line and symbol counts of a text are Column expressions; a table of thresholds over ratios of those
counts is compiled into one boolean Column and one array of the rules that failed. There is no user
function and no shuffle.

Defined results: null and empty texts have zero counts, fail the base rule and are not kept; texts of any
length are read whole; repeated rows give repeated rows; an empty table gives an empty table; other columns
of the input are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW_WORDS = 8
#: The base rule.
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = [
    *"the of and to in is that it for was with on as are this be by at from or".split(),
    *"le la les de des du et un une est en que pour dans au sur par ce il ne".split(),
    *"der die das und in zu den von mit ist auf ein eine nicht für dem sich im es auch".split(),
    *"el la los las de del y en que un una es por con para se no su al lo".split(),
]


class Rule(NamedTuple):
    """A ratio of two counts, and where it must lie. With a zero denominator the ratio is 0."""

    name: str
    over: str
    under: str
    least: float | None
    most: float | None


RULES = [
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 14.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.1),
    Rule("stop_words_per_word", "n_stop_words", "n_words", 0.04, None),
    Rule("duplicate_lines_per_line", "n_dup_lines", "n_lines", None, 0.35),
]


def _filled(column: Column) -> Column:
    return F.coalesce(column, F.lit(0)).cast("long")


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_stop_words and n_repeat_words.

    Intermediate arrays are columns of their own and each is used more than once, so Spark keeps them as
    separate projections and cuts a text into words a single time.
    """
    own = F.coalesce(F.col(text).cast("string"), F.lit(""))
    cut = docs.withColumn("_text", own).withColumns(
        {
            "_words": F.array_remove(F.split("_text", r"[\x20\x09-\x0D]+", -1), ""),
            "_lines": F.filter(F.split("_text", "\n", -1), lambda line: F.length(F.translate(line, SPACES, "")) > 0),
        }
    )
    n = F.size("_words")
    windows = F.transform(F.sequence(F.lit(1), n - (WINDOW_WORDS - 1)), lambda i: F.xxhash64(F.slice("_words", i, WINDOW_WORDS)))
    hashed = cut.withColumn("_windows", F.when(n >= WINDOW_WORDS, windows))
    again = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    sorted_windows = hashed.withColumn("_sorted", F.when(again, placed))
    hash_at = lambda k: F.try_element_at(F.col("_sorted"), k)["h"]
    repeated = F.filter("_sorted", lambda w, k: F.coalesce(w["h"] == F.when(k > 0, hash_at(k)), F.lit(False)) | F.coalesce(w["h"] == hash_at(k + 2), F.lit(False)))
    starts = F.sort_array(F.transform(repeated, lambda w: w["i"]))
    start = F.struct(F.lit(-WINDOW_WORDS).alias("last"), F.lit(0).alias("covered"))
    covered = F.aggregate(
        starts,
        start,
        lambda acc, i: F.struct(i.alias("last"), (acc["covered"] + F.least(F.lit(WINDOW_WORDS), i - acc["last"])).alias("covered")),
        lambda acc: acc["covered"],
    )
    bare = F.length(F.translate("_text", SPACES, ""))
    return sorted_windows.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": bare.cast("long"),
            "n_symbols": (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_stop_words": F.size(F.filter("_words", lambda w: F.lower(w).isin(sorted({*STOP_WORDS})))).cast("long"),
            "n_repeat_words": _filled(covered),
        }
    ).drop("_text", "_words", "_lines", "_windows", "_sorted")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def failed_rules(rules: list[Rule]) -> Column:
    """Names of the rules that a row of counts breaks, compiled from the table of thresholds."""
    found = []
    for rule in rules:
        ratio = F.when(F.col(rule.under) > 0, F.col(rule.over) / F.col(rule.under)).otherwise(F.lit(0.0))
        low = ratio < rule.least if rule.least is not None else F.lit(False)
        high = ratio > rule.most if rule.most is not None else F.lit(False)
        found.append(F.when(low | high, F.lit(rule.name)))
    return F.array_compact(F.array(*found))


def judge_quality(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """``docs`` with the counts, base_failed, failed_rules and kept."""
    judged = with_counts(docs, text).withColumns({"base_failed": base_failed(), "failed_rules": failed_rules(RULES if rules is None else rules)})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


QUERY_COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def oracle() -> str:
    """The same for DuckDB: windows as rows instead of arrays, and the threshold table as conditions."""
    spaces, symbols = r"[\x20\x09-\x0D]", "[#*$%&|<>]"
    stops = ", ".join(f"'{w}'" for w in sorted({*STOP_WORDS}))
    ratio = lambda r: f"(CASE WHEN {r.under} > 0 THEN CAST({r.over} AS DOUBLE) / {r.under} ELSE 0.0 END)"
    bounds = [f"{ratio(r)} >= {r.least}" for r in RULES if r.least is not None] + [f"{ratio(r)} <= {r.most}" for r in RULES if r.most is not None]
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, list_filter(string_split_regex(t, '{spaces}+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '{spaces}', '', 'g') <> '') AS ls FROM d),
win AS (SELECT rid, i, array_to_string(ws[i : i + {WINDOW_WORDS - 1}], ' ') AS g
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW_WORDS - 2})) AS i FROM w WHERE len(ws) >= {WINDOW_WORDS})),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
cover AS (SELECT rid, sum(least({WINDOW_WORDS}, i - coalesce(before, i - {WINDOW_WORDS}))) AS n
          FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM twice) GROUP BY rid),
c AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '{spaces}', '', 'g')) AS word_chars,
             length(t) - length(regexp_replace(t, '{symbols}', '', 'g')) AS n_symbols, len(ls) AS n_lines,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines,
             len(list_filter(ws, lambda x: lower(x) IN ({stops}))) AS n_stop_words, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN cover USING (rid)),
j AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM c)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(bounds)} AS kept
FROM j"""
