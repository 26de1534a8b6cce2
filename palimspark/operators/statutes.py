"""Statutes: clean paragraphs, headings, articles, and the ingest job that puts them together.

A statute's paragraphs are an array in its row, so cleaning never shuffles; only sections are rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimspark.functions import text as T
from palimspark.operators.chunks import folded_sections, pieces
from palimspark.storage import shared_path

# Fixed values of the domain: what the lines of a statute look like.
NUMERAL = "[一二三四五六七八九十百千零〇0-9]+"
PART, CHAPTER, SECTION, ARTICLE = (f"^第{NUMERAL}{unit}" for unit in "编章节条")
NUMBERED = f"^{NUMERAL}、"
ATTACHMENT = rf"^附\s*件\s*{NUMERAL}\s*(?:[：:]|$)"
CONTENTS = "^目录$"
MARKED_ARTICLE = rf"\*\*\s*(第{NUMERAL}条)\s*\*\*"
PUNCTUATION = r"[\p{P}\p{S}]"
#: Lines in which a title is looked for, lines that it may take, lines of contents, lines behind a heading, and the longest short line.
TITLE_WINDOW, TITLE_LINES, CONTENTS_LINES, AHEAD, SHORT = 15, 5, 200, 5, 30


def _upto(n: Column) -> Column:
    """0, 1, ..., n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it occurs and in whatever lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def without_leading_title(paras: Column, title: Column) -> Column:
    """Without the first run of lines near the start whose letters, put together, are the title's."""
    loose = lambda c: F.regexp_replace(T.bare(c), PUNCTUATION, "")
    head = F.slice(paras, F.lit(1), F.lit(TITLE_WINDOW + TITLE_LINES))

    def found(own: Column) -> Column:
        plain, wanted = own["plain"], own["title"]
        tries = F.flatten(F.transform(_upto(F.least(F.size(plain), F.lit(TITLE_WINDOW))), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(TITLE_LINES), F.size(plain) - i)), lambda k: F.struct(i.alias("i"), k.alias("k")))))
        return F.get(F.filter(tries, lambda t: (F.array_join(F.slice(plain, t["i"] + 1, t["k"]), "") == wanted) & (wanted != "")), F.lit(0))

    hit = _let(F.struct(F.transform(head, loose).alias("plain"), loose(title).alias("title")), found)
    return _let(hit, lambda h: F.when(h.isNull(), paras).otherwise(F.concat(F.slice(paras, F.lit(1), h["i"]), F.slice(paras, h["i"] + h["k"] + 1, F.size(paras)))))


def body_start(paras: Column) -> Column:
    """The place of the first line behind a table of contents; 0 without one.

    The contents are the short lines behind their mark. The body begins where their first entry stands for the last time with
    an article or a long line close behind it, else where it stands for the last time, else behind the contents.
    """
    lines = F.transform(paras, lambda x: _let(T.bare(x), lambda t: F.struct(t.alias("t"), (t.rlike(ARTICLE) | (F.length(t) > SHORT)).alias("solid"))))

    def behind_mark(own: Column) -> Column:
        mark = own["mark"]
        ahead = F.slice(own["lines"], mark + 2, F.lit(CONTENTS_LINES))  # from the line behind the mark on
        return F.when(mark.isNull(), 0).otherwise(_let(F.struct(ahead.alias("ahead"), F.slice(own["lines"], mark + 2, F.lit(CONTENTS_LINES + AHEAD + 1)).alias("more")), lambda x: mark + 1 + in_window(x)))

    def in_window(x: Column) -> Column:
        places = F.transform(x["ahead"], lambda line, i: F.struct(i.alias("i"), line["t"].alias("t"), line["solid"].alias("solid")))
        stop = lambda ps: F.coalesce(F.get(F.filter(ps, lambda p: p["solid"]), F.lit(0))["i"], F.size(ps))
        stopped = _let(places, lambda ps: F.struct(ps.alias("ps"), stop(ps).alias("stop")))
        with_first = _let(stopped, lambda y: F.struct(y["ps"].alias("ps"), y["stop"].alias("stop"), F.get(F.filter(y["ps"], lambda p: (p["i"] < y["stop"]) & (p["t"] != "")), F.lit(0)).alias("first")))
        again = _let(with_first, lambda y: F.struct(y["stop"].alias("stop"), y["first"].alias("first"), F.filter(y["ps"], lambda p: (p["i"] > y["first"]["i"]) & (p["t"] == y["first"]["t"])).alias("again")))

        def chosen(y: Column) -> Column:
            leads = F.filter(y["again"], lambda p: F.exists(F.slice(x["more"], p["i"] + 2, F.lit(AHEAD)), lambda line: line["solid"]))
            return F.when(y["first"].isNull(), y["stop"]).otherwise(F.coalesce(F.try_element_at(leads, F.lit(-1))["i"], F.try_element_at(y["again"], F.lit(-1))["i"], y["stop"]))

        return _let(again, chosen)

    marked = _let(lines, lambda ls: F.struct(ls.alias("lines"), (F.array_position(F.transform(ls, lambda x: x["t"].rlike(CONTENTS)), F.lit(True)).cast("int")).alias("at")))
    placed = _let(marked, lambda m: F.struct(m["lines"].alias("lines"), F.when(m["at"] > 0, m["at"] - 1).alias("mark")))
    return _let(placed, behind_mark)


def reheaded(paras: Column) -> Column:
    """The lines as Markdown: chapters and sections move one level up where there is no part; articles in bold."""

    def line(t: Column, parted: Column) -> Column:
        mark = lambda deep: F.when(parted, "#" * deep + " ").otherwise("#" * (deep - 1) + " ")
        wide, narrow = F.instr(t, "\u3000"), F.instr(t, " ")
        cut = F.when((wide > 0) & (wide < F.length(t)), wide).when(narrow > 0, narrow).otherwise(F.length(t) + 1)
        article = _let(cut, lambda c: F.concat(F.lit("**"), F.left(t, c - 1), F.lit("** "), F.trim(F.substring(t, c + 1, F.length(t)))))
        return (
            F.when(t.rlike(PART), F.concat(F.lit("## "), t))
            .when(t.rlike(CHAPTER), F.concat(mark(3), t))
            .when(t.rlike(SECTION), F.concat(mark(4), t))
            .when(t.rlike(ARTICLE), article)
            .when(t.rlike(NUMBERED) & (F.length(t) <= 24), F.concat(mark(4), t))
            .when(t.rlike(ATTACHMENT), F.concat(F.lit("# "), t))
            .otherwise(t)
        )

    parted = F.exists(paras, lambda t: t.rlike(PART))
    lines = _let(parted, lambda p: F.filter(F.transform(paras, lambda t: line(t, p)), lambda t: F.length(F.trim(t)) > 0))
    near = lambda ls, t, i: t.startswith("#") | F.get(ls, i - 1).startswith("#")
    gap = lambda ls: F.transform(ls, lambda t, i: F.concat(F.when(i == 0, "").when(near(ls, t, i), "\n\n\n\n").otherwise("\n\n"), t))
    return F.array_join(_let(lines, gap), "")


def rendered(paras: Column, title: Column) -> Column:
    """A statute's paragraphs as Markdown, without its title and contents."""
    own = lambda p: _let(body_start(p), lambda start: _let(F.slice(p, start + 1, F.size(p)), reheaded))
    return _let(without_leading_title(paras, title), own)


def article_bodies(text: Column, most: int = 120) -> Column:
    """(article, body) of every bold article mark; white space in a body is collapsed, and it ends after ``most`` characters."""
    names = F.regexp_extract_all(text, F.lit(MARKED_ARTICLE), F.lit(1))
    parts = F.split(text, MARKED_ARTICLE, -1)
    bodies = F.transform(F.slice(parts, F.lit(2), F.size(names)), lambda p: F.left(F.trim(F.regexp_replace(p, r"\s+", " ")), F.lit(most)))
    return F.zip_with(names, bodies, lambda a, b: F.struct(a.alias("article"), b.alias("body")))


def article_sections(docs: DataFrame) -> DataFrame:
    """(doc_id, section, path, body, level): texts cut at Markdown headings and at bold articles.

    An article hangs below all open headings and opens none; its level is their number and one. Sections of white space go.
    """
    level = lambda line: F.length(F.regexp_extract(line, r"^(#{1,6})\s", 1))
    article = lambda line: F.when(level(line) == 0, F.nullif(F.regexp_extract(F.trim(line), f"^{MARKED_ARTICLE}", 1), F.lit("")))
    body = F.regexp_replace(F.array_join("lines", "\n"), r"^\s+|\s+$", "")
    found = folded_sections(docs, level, article).withColumn("body", body).filter(F.length("body") > 0)
    path = F.array_join(F.concat("open", F.when(F.col("article").isNull(), F.array().cast("array<string>")).otherwise(F.array("article"))), " > ")
    # Behind an article the path is the article's until the next mark; a heading's level is its own.
    own = F.when(F.col("article").isNotNull(), F.size("open") + 1).otherwise(F.col("level"))
    return found.select("doc_id", "section", path.alias("path"), "body", own.cast("int").alias("level"))


def resolved_files(records: DataFrame, listing: DataFrame) -> DataFrame:
    """``records`` (record_id, category, file) with the ``found`` file: the original, or for ``.doc`` first its conversion.

    ``listing`` is (category, kind, name): kind is 'files' or 'converted', where names end in ``.docx``. Of either
    that is missing the other counts; folders in a file's name and the kind of slash don't matter.
    """
    name = F.substring_index(F.translate(F.coalesce("file", F.lit("")), "\\", "/"), "/", -1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    wanted = records.withColumns({"_name": name, "_converted": F.concat(stem, F.lit(".docx"))})
    names = listing.select(F.col("category").alias("_c"), "kind", "name").distinct()
    direct = names.filter("kind = 'files'").select("_c", F.col("name").alias("_direct"))
    other = names.filter("kind = 'converted'").select(F.col("_c").alias("_c2"), F.col("name").alias("_other"))
    met = wanted.join(direct, (F.col("category") == F.col("_c")) & (F.col("_name") == F.col("_direct")), "left").join(other, (F.col("category") == F.col("_c2")) & (F.col("_converted") == F.col("_other")), "left")
    own, made = F.concat(F.lit("files/"), F.col("_direct")), F.concat(F.lit("converted/"), F.col("_other"))
    old = F.lower("_name").endswith(".doc")
    found = F.when(F.col("_name") == "", None).when(old, F.coalesce(made, own)).otherwise(F.coalesce(own, made))
    return met.withColumn("found", found).select(*records.columns, "found")


def chunk_table(docs: DataFrame, most: int, overlap: int, least: int) -> DataFrame:
    """Parents and children of (doc_id, text): a section of at most ``most`` characters is both; a longer one is a
    parent with its first ``2 * most`` characters, and its pieces are the children."""
    row = lambda parent, child, i, n, text: F.struct(F.lit(parent).alias("is_parent"), F.lit(child).alias("is_child"), i.alias("child_index"), n.alias("chunk_count"), text.alias("text"))
    body = F.col("body")
    family = lambda ps: F.concat(F.array(row(True, False, F.lit(0), F.size(ps), F.left(body, F.lit(2 * most)))), F.transform(ps, lambda p, i: row(False, True, i, F.size(ps), p)))
    rows = F.when(F.length(body) <= most, F.array(row(True, True, F.lit(0), F.lit(1), body))).otherwise(_let(pieces(body, most, overlap, least), family))
    return article_sections(docs).select("doc_id", "section", "path", "level", F.inline(rows))  # sections are cut once


def ingest(records: DataFrame, listing: DataFrame, texts: DataFrame, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """The corpus (record_id, category, title, text) and the counts by category of an ingest.

    ``records`` is (record_id, category, title, file), ``texts`` is (category, found, paras). Counted are records, those
    without a file, those whose text has fewer than ``least`` characters, and those with a table of contents.
    """
    read = resolved_files(records, listing).join(texts, ["category", "found"], "left")
    has_contents = F.exists("paras", lambda t: T.bare(t).rlike(CONTENTS))
    made = read.withColumns({"text": rendered(F.col("paras"), F.col("title")), "contents": F.coalesce(has_contents, F.lit(False))})
    made = made.withColumn("outcome", F.when(F.col("paras").isNull(), "missing").when(F.length(T.bare(F.col("text"))) < least, "short").otherwise("kept"))
    path = shared_path(records.sparkSession, "rendered")  # the counts and the corpus read it
    made.select("record_id", "category", "title", "text", "contents", "outcome").write.parquet(path)
    made = records.sparkSession.read.parquet(path)
    counts = made.groupBy("category").agg(F.count("*").alias("records"), *(F.count_if(F.col("outcome") == o).alias(o) for o in ("missing", "short", "kept")), F.count_if("contents").alias("with_contents"))
    return made.filter("outcome = 'kept'").select("record_id", "category", "title", "text"), counts
