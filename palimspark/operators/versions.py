"""Versions of documents: inventories, truth checks, reconciliation and hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the domain.
STATUS_NAMES = {1: "repealed", 2: "superseded", 3: "current", 4: "pending", -1: "unknown"}
REQUIRED = ["bbbs", "title", "category", "status_code", "effective_date"]


def status_name(code: Column) -> Column:
    """NULL means not labelled, which isn't the same as unknown."""
    return F.coalesce(*(F.when(code == k, v) for k, v in STATUS_NAMES.items()), F.when(code.isNull(), "unlabelled"))


def front_matter(fields: list[str]) -> Column:
    """``key: value`` lines, quotes and line feeds taken out, nulls empty."""
    clean = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r'["\n\r]', " ")
    return F.concat_ws("\n", *(F.concat(F.lit(f"{c}: "), clean(c)) for c in fields))


def slug(title: Column, version: Column) -> Column:
    return F.concat(F.substring(F.regexp_replace(title, r'[\\/:*?"<>|\s]+', ""), 1, 70), F.lit("_"), version)


def violations(rows: DataFrame, key: str = "bbbs") -> DataFrame:
    """One row per broken rule: a column that must exist, an unknown status, a missing key."""
    missing = [c for c in REQUIRED if c not in rows.columns]
    if missing:
        raise ValueError(f"required columns are missing: {missing}")
    bad_status = F.when(F.col("status_code").isNotNull() & ~F.col("status_code").isin(list(STATUS_NAMES)), "unknown_status")
    found = F.array_compact(F.array(bad_status, F.when(F.coalesce(F.col(key), F.lit("")) == "", "missing_key"), F.when(F.col("title").isNull(), "missing_title")))
    return rows.select(key, F.explode(found).alias("rule"))


def inventory(rows: DataFrame) -> DataFrame:
    """Items, titles, titles with several versions and surplus versions, per category and in all."""
    titles = rows.groupBy("category", "title").agg(F.count("*").alias("n"))
    counted = titles.rollup("category").agg(F.sum("n").alias("items"), F.count("*").alias("titles"), F.count_if(F.col("n") > 1).alias("multi_version"), F.sum(F.col("n") - 1).alias("surplus"))
    return counted.withColumn("category", F.coalesce("category", F.lit("total")))


def status_distribution(rows: DataFrame) -> DataFrame:
    counted = rows.groupBy("status_code").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))  # one row
    return counted.join(F.broadcast(total)).select("status_code", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def truth_checks(rows: DataFrame, today: str) -> DataFrame:
    """Per category: pending versions and those in the past; current ones and those that aren't their title's newest."""
    date = F.col("effective_date")
    titles = rows.groupBy("category", "title").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("status_code") == 4).alias("pending"),
        F.count_if((F.col("status_code") == 4) & (F.coalesce(date, F.lit(today).cast("date")) <= F.lit(today).cast("date"))).alias("pending_past"),
        F.count_if(F.col("status_code") == 3).alias("current"),
        F.max(F.coalesce(date, F.lit("1970-01-01").cast("date"))).alias("newest"),
        F.min(F.when(F.col("status_code") == 3, F.coalesce(date, F.lit("1970-01-01").cast("date")))).alias("oldest_current"),
    )
    late = F.count_if((F.col("n") > 1) & (F.col("oldest_current") < F.col("newest")))
    return titles.groupBy("category").agg(F.sum("pending").alias("pending"), F.sum("pending_past").alias("pending_past"), F.sum("current").alias("current"), late.alias("current_not_newest"))


def reconcile(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row per field that differs between two tables with the same keys; nulls equal each other."""
    joined = left.alias("l").join(right.alias("r"), key)
    differ = F.array_compact(F.array(*(F.when(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), F.struct(F.lit(c).alias("field"), F.col(f"l.{c}").cast("string").alias("ours"), F.col(f"r.{c}").cast("string").alias("theirs"))) for c in fields)))
    return joined.select(key, F.explode(differ).alias("d")).select(key, "d.*")


def dropped(master: DataFrame, kept: DataFrame, key: str, reason: Column) -> DataFrame:
    """Rows of the master that are missing, with the reason."""
    return master.join(kept.select(key), key, "left_anti").select(key, reason.alias("reason"))


def parent_titles(rows: DataFrame, child: Column) -> DataFrame:
    """Each child with the longest other title that it starts with and that has a higher rank (a smaller number).

    A child meets parents by its own prefixes, as an equality of titles, so titles of any length count. Rows of equal title and
    rank share their parent, and of possible parents of one title and rank the first by id is enough, so copies meet only once.
    """
    n = F.length("title")
    prefixes = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.left(F.col("title"), i))).otherwise(F.array().cast("array<string>"))
    children = rows.filter(child).select("id", "rank", "title")
    c = children.select("rank", "title").distinct().select("rank", F.col("title").alias("_own"), F.explode(prefixes).alias("title"))
    p = rows.groupBy("title", F.col("rank").alias("_rank")).agg(F.min("id").alias("_first"))
    best = lambda parent: F.max(F.struct(F.length("title").alias("n"), (-F.col(parent)).alias("parent")))
    found = c.join(p, "title").filter("_rank < rank").groupBy("rank", "_own").agg(best("_first").alias("_best"))
    met = children.join(found.withColumnRenamed("_own", "title"), ["rank", "title"])
    return met.groupBy("id").agg((-F.max("_best")["parent"]).alias("parent"))


def pending_with_current(rows: DataFrame) -> DataFrame:
    """Pending versions and the current version of the same category and title, if there is one."""
    current = rows.filter("status_code = 3").groupBy("category", "title").agg(F.min("bbbs").alias("current"))
    return rows.filter("status_code = 4").select("category", "title", F.col("bbbs").alias("pending")).join(current, ["category", "title"], "left")


def current_version(rows: DataFrame) -> DataFrame:
    """One version per title: the current one, else the first by id."""
    return rows.groupBy("title").agg(F.min_by("bbbs", F.struct(~F.coalesce(F.col("status_code") == 3, F.lit(False)), F.col("bbbs"))).alias("bbbs"))


def proven_seeds(seeds: DataFrame, versions: DataFrame, texts: DataFrame, least: int = 1) -> DataFrame:
    """Seeds (seed_id, titles, keyword) that the sources prove, with ``sources``, the versions whose text matches the keyword.

    Each title stands for its current version (else its first). ``keyword`` is a regular expression, ``versions`` is
    (title, bbbs, status_code), ``texts`` is (bbbs, text); a version without text proves nothing. A seed with fewer than
    ``least`` proven sources goes. Texts are read where a seed asks for them only.
    """
    asked = seeds.select("seed_id", "keyword", F.explode(F.array_distinct("titles")).alias("title"))
    met = asked.join(current_version(versions), "title").join(texts, "bbbs").filter(F.regexp_like("text", F.col("keyword")))
    found = met.groupBy("seed_id").agg(F.array_sort(F.collect_set("bbbs")).alias("sources"))
    return found.filter(F.size("sources") >= least)


def version_questions(rows: DataFrame) -> DataFrame:
    """Titles with several dated versions that lie two years apart or more: a probe year half-way and its true version."""
    own = rows.filter("effective_date IS NOT NULL")
    spans = own.groupBy("category", "title").agg(F.count("*").alias("n"), F.year(F.min("effective_date")).alias("first"), F.year(F.max("effective_date")).alias("last")).filter("n > 1 AND last - first >= 2")
    probe = spans.withColumn("probe", F.floor((F.col("first") + F.col("last")) / 2).cast("int"))
    eligible = own.join(probe, ["category", "title"]).filter(F.col("effective_date") <= F.make_date("probe", F.lit(12), F.lit(31)))
    return eligible.groupBy("category", "title", "probe").agg(F.max_by("bbbs", F.struct("effective_date", "bbbs")).alias("truth"))


def version_ladder(rows: DataFrame, n_current: int, n_all: int, seed: str) -> DataFrame:
    """(difficulty, category, title, probe, truth) of questions about titles with several versions: which one is current, which ones
    there are, which one was in force in a probe year.

    Titles with a current version are taken in a seeded order, the first ``n_current`` for the first kind, the next ``n_all``
    for the second; the third takes every title that ``version_questions`` does. ``truth`` holds the ids, sorted.
    """
    current = F.min(F.when(F.col("status_code") == 3, F.col("bbbs")))
    several = rows.groupBy("category", "title").agg(F.count("*").alias("n"), current.alias("current"), F.array_sort(F.collect_list("bbbs")).alias("all")).filter("n > 1 AND current IS NOT NULL")
    order = F.md5(F.concat(F.lit(seed), "category", F.lit("/"), "title"))
    first = several.withColumn("place", order).orderBy("place", "category", "title").limit(n_current + n_all)  # bounded
    placed = first.withColumn("place", F.row_number().over(Window.orderBy("place", "category", "title")))
    easy = F.col("place") <= n_current
    asked = placed.select(F.when(easy, "version_current").otherwise("version_enumerate").alias("difficulty"), "category", "title", F.lit(None).cast("int").alias("probe"), F.when(easy, F.array("current")).otherwise(F.col("all")).alias("truth"))
    dated = version_questions(rows).select(F.lit("version_time_travel").alias("difficulty"), "category", "title", "probe", F.array("truth").alias("truth"))
    return asked.unionByName(dated)


def sampled(rows: DataFrame, by: str, key: str, n: int, seed: str) -> DataFrame:
    """The first n rows of each class in a seeded order that any engine can repeat, and a dev or test half."""
    order = Window.partitionBy(by).orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key)
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n).withColumn("split", F.when(F.col("place") % 2 == 1, "dev").otherwise("test"))
