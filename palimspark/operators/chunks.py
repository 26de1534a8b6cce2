"""Cutting documents: bounded overlapping windows, sections by headings, duplicates and coverage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the domain: what ends a sentence.
ENDERS = ["。", "！", "？", "；", "\n"]


def window_step(most: int, overlap: int) -> int:
    return max(most - min(max(overlap, 0), most - 1), min(64, most), 1)


def _cuts(text: Column, most: int, overlap: int) -> Column:
    """(start, cut, piece) of the windows of a text, all cut inside its row."""
    step, n = window_step(most, overlap), F.length(text)
    starts = F.when(n <= most, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1, F.lit(step)))
    held = F.transform(starts, lambda s: F.struct(s.alias("s"), F.substring(text, s + 1, F.lit(most)).alias("w")))
    # how far the last sentence end behind the step reaches; 0: there is none
    last = f"(?s)^.*[{''.join(ENDERS)}]"
    ended = F.transform(held, lambda x: F.struct(x["s"].alias("s"), x["w"].alias("w"), F.length(F.regexp_extract(F.substr(x["w"], F.lit(step + 1)), last, 0)).alias("best")))
    taken = lambda x: F.when((n > most) & (x["best"] > 0), step + x["best"]).otherwise(F.length(x["w"]))
    return F.transform(ended, lambda x: F.struct(x["s"].alias("start"), (x["s"] + taken(x)).alias("cut"), F.left(x["w"], taken(x)).alias("piece")))


def windows(docs: DataFrame, most: int, overlap: int) -> DataFrame:
    """(doc_id, start, cut, piece): windows start at multiples of the step and end after the last sentence end inside.

    The end is looked for behind start + step only; where there is none the window is cut hard. A text of at most
    ``most`` characters is one window. Starts don't depend on cuts, and only pieces leave a text's row.
    """
    cut = docs.filter(F.length(F.trim("text")) > 0).select("doc_id", F.explode(_cuts(F.col("text"), most, overlap)).alias("w"))
    return cut.select("doc_id", "w.start", "w.cut", "w.piece")


def pieces(text: Column, most: int, overlap: int, least: int = 50) -> Column:
    """The trimmed windows of a text, short ones merged into the one before where both fit into twice ``most``."""
    parts = F.transform(_cuts(text, most, overlap), lambda w: F.regexp_replace(w["piece"], r"(?U)^\s+|\s+$", ""))
    parts = F.filter(parts, lambda p: F.length(p) > 0)

    def fold(done: Column, part: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joins = F.coalesce((F.length(part) < least) & (F.length(last) + 1 + F.length(part) <= 2 * most), F.lit(False))
        merged = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat(last, F.lit("\n"), part)))
        return F.when(joins, merged).otherwise(F.concat(done, F.array(part)))

    def whole(parts: Column) -> Column:  # the fold copies; most texts have no short piece
        return F.when(F.exists(parts, lambda p: F.length(p) < least), F.aggregate(parts, F.array().cast("array<string>"), fold)).otherwise(parts)

    return F.element_at(F.transform(F.array(parts), whole), 1)


def chunks(docs: DataFrame, most: int, overlap: int, least: int = 50) -> DataFrame:
    """(doc_id, child_index, child_total, text, overlap_prev) of (doc_id, text): the pieces of each text, cut and merged inside its row."""
    cut = docs.filter(F.length(F.trim("text")) > 0).select("doc_id", pieces(F.col("text"), most, overlap, least).alias("parts"))
    rows = F.transform("parts", lambda p, i: F.struct(p.alias("text"), F.when(i > 0, F.right(F.get("parts", i - 1), F.lit(overlap))).otherwise("").alias("overlap_prev")))
    return cut.select("doc_id", F.size("parts").alias("child_total"), F.posexplode(rows).alias("child_index", "c")).select("doc_id", "child_index", "child_total", "c.text", "c.overlap_prev")


def folded_sections(docs: DataFrame, level: Callable[[Column], Column], article: Callable[[Column], Column] | None = None) -> DataFrame:
    """(doc_id, section, level, article, open, lines) of (doc_id, text), cut at headings and at articles, inside each row.

    ``level`` gives a line's heading level (0: none), ``article`` the name of an article that begins there, if any. One fold over a
    text's marks carries the stack of open headings: a heading closes those of its own or a deeper level, an article
    opens none. ``open`` holds their titles; ``lines`` begins with the mark's own line, but for section 0, which comes before all marks.
    """
    named = article or (lambda line: F.lit(None).cast("string"))
    title = lambda line: F.regexp_replace(line, r"^#{1,6}\s+|\s+$", "")
    mark = lambda line, i: F.struct((i + 1).alias("at"), level(line).alias("level"), named(line).alias("article"), title(line).alias("title"))
    cut = docs.filter("text is not null").select("doc_id", F.split("text", "\n", -1).alias("_lines"))
    cut = cut.withColumn("_marks", F.filter(F.transform("_lines", mark), lambda m: (m["level"] > 0) | m["article"].isNotNull()))
    none = F.struct(F.array().cast("array<struct<level:int,title:string>>").alias("open"), F.array().cast("array<array<string>>").alias("paths"))

    def step(done: Column, m: Column) -> Column:
        own = F.concat(F.filter(done["open"], lambda o: o["level"] < m["level"]), F.array(F.struct(m["level"].alias("level"), m["title"].alias("title"))))
        open_ = F.when(m["level"] > 0, own).otherwise(done["open"])
        return F.struct(open_.alias("open"), F.concat(done["paths"], F.array(F.transform(open_, lambda o: o["title"]))).alias("paths"))

    cut = cut.withColumn("_paths", F.aggregate("_marks", none, step, lambda done: done["paths"]))
    own = lambda j: F.get("_marks", j - 1)

    def section(j: Column) -> Column:
        begin, end = F.coalesce(own(j)["at"], F.lit(1)), F.coalesce(own(j + 1)["at"], F.size("_lines") + 1)
        return F.struct(
            j.cast("long").alias("section"),
            F.coalesce(own(j)["level"], F.lit(0)).alias("level"),
            own(j)["article"].alias("article"),
            F.coalesce(F.get("_paths", j - 1), F.array().cast("array<string>")).alias("open"),
            F.slice("_lines", begin, end - begin).alias("lines"),
        )

    parts = F.transform(F.sequence(F.lit(0), F.size("_marks")), section)
    return cut.select("doc_id", F.explode(F.filter(parts, lambda s: F.size(s["lines"]) > 0)).alias("s")).select("doc_id", "s.*")


def sections(docs: DataFrame) -> DataFrame:
    """(doc_id, section, level, path, body) of Markdown texts: a section owns the lines up to the next heading.

    Its path is the stack of open headings. Lines before the first heading are section 0 with an empty path.
    """
    found = folded_sections(docs, lambda line: F.length(F.regexp_extract(line, r"^(#{1,6})\s+\S", 1)))
    body = F.when(F.col("section") > 0, F.slice("lines", 2, F.size("lines"))).otherwise(F.col("lines"))
    return found.select("doc_id", "section", "level", F.array_join("open", " > ").alias("path"), F.array_join(body, "\n").alias("body"))


def duplicate_report(rows: DataFrame) -> DataFrame:
    """One row: chunks, distinct digests, groups, surplus in one place and across places, and the largest group."""
    digest = rows.withColumn("digest", F.md5("text"))
    placed = digest.groupBy("digest", "place").agg(F.count("*").alias("n"))
    groups = placed.groupBy("digest").agg(F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("same_place"), (F.count("*") - 1).alias("across"))
    return groups.agg(F.sum("n").alias("chunks"), F.count("*").alias("digests"), F.count_if(F.col("n") > 1).alias("groups"), F.sum("same_place").alias("same_place"), F.sum("across").alias("across"), F.max("n").alias("largest"))
