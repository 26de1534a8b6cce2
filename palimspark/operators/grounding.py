"""How far answers are supported by their evidence, and the citations in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimspark.functions import text as T

MAX_UNSUPPORTED = 0.35
SUPPORTED = 0.45
# What an article, an item, a bracketed item and the name of a law look like.
_N = "".join(T.CN_DIGITS) + "".join(T.CN_UNITS) + "0-9０-９"
ARTICLE = rf"第\s*([{_N}]+)\s*条"
ITEM = rf"第\s*([{_N}]+)\s*([项款])"
BRACKETED = rf"[（(]\s*([{_N}]+)\s*[）)]"
LAW = "《([^》]{2,60})》"


def best_support(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each sentence of an answer (query_id, answer_id, text) with its best piece of evidence (query_id, chunk_id, text).

    Sentences meet the evidence of their own query only.
    """
    said = answers.select("query_id", "answer_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    said = said.withColumn("_s", T.bare(F.col("sentence")))
    held = evidence.select("query_id", "chunk_id", T.bare(F.col("text")).alias("_c"))
    met = said.join(held, "query_id", "left").withColumns({"_gs": T.char_ngrams(F.col("_s")), "_gc": T.char_ngrams(F.col("_c"))})
    score = F.round(F.greatest(T.run_boost(F.col("_s"), F.col("_c")), T.jaccard(F.col("_gs"), F.col("_gc"))), 6)
    scored = met.withColumn("score", F.when(F.col("chunk_id").isNull(), F.lit(0.0)).otherwise(score))
    return scored.groupBy("query_id", "answer_id", "pos").agg(F.max("score").alias("score"), F.max_by("chunk_id", F.struct(F.col("score"), -F.col("chunk_id"))).alias("chunk_id"))


def grounding_report(support: DataFrame) -> DataFrame:
    """Per answer: sentences, the share without support, and whether it passes."""
    share = F.avg((F.col("score") < SUPPORTED).cast("int"))
    return support.groupBy("query_id", "answer_id").agg(F.count("*").alias("n_sentences"), F.round(share, 6).alias("unsupported"), (share <= MAX_UNSUPPORTED).alias("passed"))


def verified_answers(answers: DataFrame, evidence: DataFrame, notice: str = "") -> DataFrame:
    """Per answer (query_id, answer_id, text) all that is checked before it is shown, against (query_id, chunk_id, text).

    Grounding of its statements without Markdown scaffolding; citations, and those whose article the evidence names; the share of
    chunks with a common run of 12 characters; what must be redacted; and the answer that is left: without unsupported sentences,
    redacted (``notice`` where nothing is left). A query's answers meet its evidence in one row, whose n-grams are cut once for all of them.
    """
    listed = F.array_sort(F.collect_list(F.struct("chunk_id", "text")))
    held = evidence.groupBy("query_id").agg(listed.alias("_held")).withColumn("_held", F.transform("_held", lambda c: c["text"]))
    asked = answers.groupBy("query_id").agg(F.collect_list(F.struct("answer_id", "text")).alias("_answers"))
    judged = asked.join(held, "query_id", "left").select("query_id", F.explode(_judged(F.col("_answers"), F.col("_held"))).alias("a")).select("query_id", "a.*")
    context = held.select("query_id", normalised(F.concat_ws("\n", "_held")).alias("context"))  # what one prompt holds
    keyed = answers.select(F.struct("query_id", "answer_id").alias("doc_id"), "text")
    cited = citations(keyed).select("doc_id.query_id", "doc_id.answer_id", "article").join(context, "query_id", "left")
    named = F.contains("context", F.concat(F.lit("第"), F.col("article").cast("string"), F.lit("条")))
    cited = cited.groupBy("query_id", "answer_id").agg(F.count("article").alias("n_citations"), F.count_if(named).alias("n_verified"))
    weak = F.transform(F.filter("_said", lambda s: ~s["supported"]), lambda s: s["sentence"])
    n = F.size("_said")
    share = F.size("_weak") / F.nullif(n, F.lit(0))
    left = T.redacted(without_unsupported(F.col("text"), F.col("_weak"), notice))
    found = judged.withColumn("_weak", weak).join(cited, ["query_id", "answer_id"], "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_citations", "n_verified")]
    return found.select(
        "query_id", "answer_id", T.redactions(F.col("text")).alias("redactions"), n.cast("long").alias("n_sentences"), F.round(share, 6).alias("unsupported"),
        F.coalesce(share <= MAX_UNSUPPORTED, F.lit(False)).alias("passed"), *counts, "overlap", F.md5(left).alias("clean_md5"))


def _judged(answers: Column, texts: Column) -> Column:
    """Of each answer (answer_id, text) against the texts of its evidence: ``_said``, its sentences and whether one text supports each, and ``overlap``.

    A common run of 4 characters gives a sentence more than the least support, so grams are compared only where there is none.
    """

    def supported(sentence: Column, held: Column) -> Column:
        def run(s: Column) -> Column:
            return F.exists(T.char_runs(s, 4), lambda g: F.contains(held["all"], g))

        def near(s: Column) -> Column:
            # Of two sets of grams the smaller must be SUPPORTED of the larger; what rounding may add is left to the exact test.
            fits = lambda a, b: F.least(F.size(a), F.size(b)) >= (SUPPORTED - 0.001) * F.greatest(F.size(a), F.size(b))
            alike = lambda a, b: F.when(fits(a, b), F.round(T.jaccard(a, b), 6) >= SUPPORTED).otherwise(False)
            return T.once(T.char_ngrams(s), lambda a: F.exists(held["grams"], lambda b: alike(a, b)))

        return T.once(T.bare(sentence), lambda s: run(s) | near(s))

    def overlap(answer: Column, held: Column) -> Column:
        common = F.array_intersect(held["runs"], T.char_runs(answer, 12))
        hits = T.once(common, lambda gs: F.size(F.filter(held["chunks"], lambda c: F.exists(gs, lambda g: F.contains(c, g)))))
        n = F.size(held["chunks"])
        return F.round(F.when((F.length(answer) < 8) | (n == 0), 1.0).otherwise(F.least(F.lit(1.0), hits / F.least(F.lit(3), n))), 6)

    def judge(a: Column, held: Column) -> Column:
        said = F.transform(T.sentences(T.without_scaffolding(a["text"])), lambda s: F.struct(s.alias("sentence"), supported(s, held).alias("supported")))
        return F.struct(a["answer_id"].alias("answer_id"), a["text"].alias("text"), said.alias("_said"), T.once(T.bare(a["text"]), lambda t: overlap(t, held)).alias("overlap"))

    def held(chunks: Column) -> Column:
        every = F.array_join(chunks, "\n")  # no bare text holds a line end, so no run passes from one to the next
        return F.struct(chunks.alias("chunks"), every.alias("all"), F.transform(chunks, lambda c: T.char_ngrams(c)).alias("grams"), F.array_distinct(T.char_runs(every, 12)).alias("runs"))

    chunks = F.filter(F.transform(F.coalesce(texts, F.array().cast("array<string>")), lambda t: T.bare(t)), lambda t: t.isNotNull())
    return T.once(chunks, lambda cs: T.once(held(cs), lambda h: F.transform(answers, lambda a: judge(a, h))))


def overlap_ratio(pairs: DataFrame) -> DataFrame:
    """Per answer: chunks with a run of 12 characters in it, over at most three, at most 1.

    ``pairs`` is (answer_id, answer, chunk), both texts bare and chunk null where there is none. A longer run holds
    one of 12, so only those are looked for. Answers of fewer than 8 characters have ratio 1.
    """
    n = F.length("chunk")
    hit = F.when(n >= 12, F.exists(F.sequence(F.lit(1), n - 11), lambda i: F.contains(F.col("answer"), F.substring(F.col("chunk"), i, F.lit(12))))).otherwise(False)
    grouped = pairs.groupBy("answer_id").agg(F.max(F.length("answer")).alias("_n"), F.count("chunk").alias("chunks"), F.count_if(hit).alias("hits"))
    ratio = F.when((F.col("_n") < 8) | (F.col("chunks") == 0), 1.0).otherwise(F.least(F.lit(1.0), F.col("hits") / F.least(F.lit(3), F.col("chunks"))))
    return grouped.select("answer_id", "chunks", "hits", F.round(ratio, 6).alias("ratio"))


def shared_runs(answers: DataFrame, chunks: DataFrame, n: int = 12) -> DataFrame:
    """(answer_id, chunk_ids): the chunks of (chunk_id, chunk) that share a run of ``n`` characters with each answer (answer_id, answer).

    An inverted table of the chunks' n-grams is the join key, so any answer meets any chunk with a common run and nothing
    else. A gram stands there once, with all its chunks; an answer's gram leaves its task once.
    """
    grams = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1)))  # noqa: E731 - one pass; substring counts from the start each time
    inverted = chunks.select("chunk_id", F.explode(grams(F.col("chunk"))).alias("gram")).groupBy("gram").agg(F.collect_set("chunk_id").alias("_chunks"))
    said = answers.select("answer_id", F.explode(grams(F.col("answer"))).alias("gram"))
    return said.join(inverted, "gram").groupBy("answer_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("_chunks")))).alias("chunk_ids"))


def overlap_with_all(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """As ``overlap_ratio``, each answer against all chunks; both texts are bare."""
    total = chunks.filter("chunk is not null").agg(F.count("*").alias("chunks"))  # one row
    met = answers.join(shared_runs(answers, chunks), "answer_id", "left").join(F.broadcast(total))
    hits = F.coalesce(F.size("chunk_ids"), F.lit(0)).cast("long")
    hits = F.greatest(hits, F.lit(0).cast("long"))
    ratio = F.when((F.coalesce(F.length("answer"), F.lit(0)) < 8) | (F.col("chunks") == 0), 1.0).otherwise(F.least(F.lit(1.0), hits / F.least(F.lit(3), F.col("chunks"))))
    return met.select("answer_id", "chunks", hits.alias("hits"), F.round(ratio, 6).alias("ratio"))


def normalised(text: Column) -> Column:
    """Article, item and bracketed numbers written with digits."""

    def rewrite(text: Column, pattern: str, write) -> Column:
        def own(t: Column) -> Column:
            whole, number = F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), F.regexp_extract_all(t, F.lit(pattern), F.lit(1))
            new = F.zip_with(whole, number, lambda w, n: F.coalesce(write(w, T.cn_number(n).cast("string")), w))
            return F.array_join(F.zip_with(F.split(t, pattern, -1), F.concat(new, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")

        # A lambda's variable, since each pass reads its text three times and would work out the passes before it as often.
        return F.get(F.transform(F.array(text), own), F.lit(0))

    text = rewrite(text, ARTICLE, lambda w, n: F.concat(F.lit("第"), n, F.lit("条")))
    text = rewrite(text, ITEM, lambda w, n: F.concat(F.lit("第"), n, F.right(w, F.lit(1))))
    return rewrite(text, BRACKETED, lambda w, n: F.concat(F.lit("（"), n, F.lit("）")))


def citations(texts: DataFrame) -> DataFrame:
    """One row per citation of (doc_id, text): law, article, item and kind.

    A sentence's last law name holds for it and for the sentences after it until the next name; an item belongs to
    an article if it follows within 12 characters.
    """
    sentences = texts.select("doc_id", F.posexplode(F.split("text", r"[。；;\n]+", -1)).alias("pos", "s"))
    named = sentences.withColumn("_law", F.try_element_at(F.regexp_extract_all("s", F.lit(LAW), F.lit(1)), F.lit(-1)))
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    carried = named.withColumn("law", F.last("_law", ignorenulls=True).over(order))
    found = carried.withColumns({"_a": F.regexp_extract_all("s", F.lit(ARTICLE), F.lit(1)), "_parts": F.split("s", ARTICLE, -1)})
    rows = found.select("doc_id", "pos", "law", "_parts", F.posexplode("_a").alias("at", "raw"))
    tail = F.left(F.try_element_at("_parts", F.col("at") + 2), F.lit(12))
    rows = rows.withColumn("_tail", F.coalesce(tail, F.lit("")))
    direct, bracketed = F.regexp_extract("_tail", ITEM, 1), F.regexp_extract("_tail", BRACKETED, 1)
    item = F.when(direct != "", T.cn_number(direct)).when(bracketed != "", T.cn_number(bracketed))
    kind = F.when(direct != "", F.regexp_extract("_tail", ITEM, 2)).when(bracketed != "", "项")
    return rows.select("doc_id", "pos", "at", "law", T.cn_number(F.col("raw")).alias("article"), item.alias("item"), kind.alias("kind"))


def citation_hits(cited: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per document: citations, those whose article the evidence (doc_id, context) names, and precision (null without any)."""
    held = evidence.select("doc_id", normalised(F.col("context")).alias("context"))
    hit = F.contains(F.col("context"), F.concat(F.lit("第"), F.col("article").cast("string"), F.lit("条")))
    met = held.join(cited, "doc_id", "left")
    return met.groupBy("doc_id").agg(F.count("article").alias("total"), F.count_if(hit).alias("hits")).withColumn("precision", F.when(F.col("total") > 0, F.round(F.col("hits") / F.col("total"), 6)))


def precision_by_model(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per model of answers (doc_id, model, text, latency): answers, median and mean latency, mean precision of articles and of
    items against the evidence (doc_id, context), and answers that cite an item at all.

    An answer without citations, or without items, has no precision and counts for no mean. An item is found where the
    evidence has its number in brackets or between 第 and its kind.
    """
    held = evidence.select("doc_id", normalised(F.col("context")).alias("context"))
    number = F.col("item").cast("string")
    named = F.contains("context", F.concat(F.lit("第"), F.col("article").cast("string"), F.lit("条")))
    itemised = F.contains("context", F.concat(F.lit("（"), number, F.lit("）"))) | F.contains("context", F.concat(F.lit("第"), number, "kind"))
    met = citations(answers).join(held, "doc_id", "left")
    counts = met.groupBy("doc_id").agg((F.count_if(named) / F.nullif(F.count("article"), F.lit(0))).alias("_articles"), (F.count_if(itemised) / F.nullif(F.count("item"), F.lit(0))).alias("_items"), F.count("item").alias("_n"))
    rows = answers.select("doc_id", "model", "latency").join(counts, "doc_id", "left")
    return rows.groupBy("model").agg(
        F.count("*").alias("n"), F.round(F.percentile("latency", F.lit(0.5)), 2).alias("latency_p50"), F.round(F.avg("latency"), 2).alias("latency_mean"),
        F.round(F.avg("_articles"), 6).alias("article_precision"), F.round(F.avg("_items"), 6).alias("item_precision"), F.count_if(F.col("_n") > 0).alias("cites_item"))


def without_unsupported(text: Column, unsupported: Column, notice: str) -> Column:
    """The text without its unsupported sentences; the notice where nothing is left."""
    left = F.aggregate(unsupported, text, lambda t, s: F.trim(F.replace(t, s, F.lit(""))))
    return F.coalesce(F.nullif(left, F.lit("")), F.lit(notice))
