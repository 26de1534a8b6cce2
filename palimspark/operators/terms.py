"""Domain terms of a corpus: weighted candidates from titles, short titles, headings and listed offences, cleaned and cut off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the domain: weights, what the sources look like, and what is no term.
WEIGHTS = {"title": 50, "short": 30, "heading": 5, "offence": 20}
TITLE_DOMAINS = ["statute", "interpretation"]
COUNTRY = "中华人民共和国"
NUMERALS = "一二三四五六七八九十百千零〇"
HEADING = r"^#{2,4}\s+(.+?)\s*$"
OFFENCE = r"^[0-9一二三四五六七八九十]+[．.、]\s*(.{2,20}?罪)\s*[（(]"
NUMBERED = rf"^第[{NUMERALS}0-9]+[编章节]"
STOP_TERMS = [
    "中华人民共和国", "全国人民代表大会", "全国人民代表大会常务委员会",
    "最高人民法院", "最高人民检察院", "国务院", "人民法院", "人民检察院",
    "决定", "规定", "办法", "通知", "公告", "批复", "解释", "意见", "规则",
    "若干问题", "若干规定", "有关问题", "试行", "修正案",
]
NO_TERM = [r"[，。；：、（）()《》〈〉\[\]【】0-9]", rf"^[第{NUMERALS}0-9编章节条款项]+$", r"(的内容是什么|是什么|有哪些|怎么办|如何|吗[？?]?$)"]


def _of(source: str, terms: Column) -> Column:
    return F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(WEIGHTS[source]).alias("weight"), F.lit(source).alias("source")))


def candidates(docs: DataFrame) -> DataFrame:
    """(term, weight, source), one row per occurrence, of (title, domain, text); a text is read once, inside its row."""
    title = F.trim(F.coalesce("title", F.lit("")))
    titled = F.array_compact(F.array(F.when(F.col("domain").isin(TITLE_DOMAINS) & (title != ""), title)))
    short = F.filter(F.transform(titled, lambda t: F.trim(F.replace(t, F.lit(COUNTRY), F.lit("")))), lambda t: F.length(t) >= 4)
    lines = F.split(F.coalesce("text", F.lit("")), r"\r?\n", -1)
    heads = F.transform(F.filter(lines, lambda x: x.rlike(HEADING)), lambda x: F.regexp_replace(F.regexp_replace(F.regexp_extract(x, HEADING, 1), r"(?U)\s+", ""), NUMBERED, ""))
    offences = F.transform(F.filter(lines, lambda x: F.trim(x).rlike(OFFENCE)), lambda x: F.regexp_extract(F.trim(x), OFFENCE, 1))
    found = [("title", titled), ("short", short), ("heading", F.filter(heads, lambda h: F.length(h).between(3, 30))), ("offence", offences)]
    return docs.select(F.explode(F.concat(*(_of(source, terms) for source, terms in found))).alias("t")).select("t.*")


def is_term(term: Column) -> Column:
    """Neither a stop term nor too short or long, nor with punctuation or digits, a mere numbering or the rest of a question."""
    odd = F.lit(False)
    for pattern in NO_TERM:
        odd = odd | term.rlike(pattern)
    return F.length(term).between(2, 40) & ~term.isin(STOP_TERMS) & ~odd


def mined(docs: DataFrame, least: int, top: int) -> DataFrame:
    """The ``top`` terms with their summed weights, of at least ``least``; partial sums leave the tasks that read."""
    own = candidates(docs).select(F.trim("term").alias("term"), "weight").filter(is_term(F.col("term")))
    return own.groupBy("term").agg(F.sum("weight").alias("freq")).filter(F.col("freq") >= least).orderBy(F.desc("freq"), "term").limit(top)
