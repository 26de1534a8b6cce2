"""Conversations: bounded histories, packed contexts and evidence blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimspark.functions import text as T

# Fixed values of the domain.
TITLE = "--- 对话历史 ---"
ROLES = {"user": "用户", "assistant": "助手", "system": "系统", "tool": "工具"}


def role_label(role: Column) -> Column:
    return F.coalesce(*(F.when(role == k, v) for k, v in ROLES.items()), role)


def _ordered(rows: DataFrame, key: str, line: Column, sep: str, name: str) -> DataFrame:
    lines = F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"])
    return rows.groupBy(key).agg(F.array_join(lines, sep).alias(name))


def packed_context(turns: DataFrame, messages: int = 20, most: int = 4000) -> DataFrame:
    """The newest messages whose lines fit into ``most`` characters, in order, with the title line last."""
    line = F.concat(role_label(F.col("role")), F.lit(": "), F.coalesce("text", F.lit("")))
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = turns.withColumn("line", line).withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= messages)
    rows = rows.withColumn("_sum", F.sum(F.length("line")).over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    every = turns.select("conv_id").distinct()
    fitting = _ordered(rows.filter(F.col("_sum") <= most), "conv_id", F.col("line"), "\n", "context")
    return every.join(fitting, "conv_id", "left").select("conv_id", F.concat_ws("\n", "context", F.lit(TITLE)).alias("context"))


def recent_turns(turns: DataFrame, rounds: int, chars: int, sep: str = "\n") -> DataFrame:
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = turns.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= 2 * rounds)
    label = F.when(F.col("role") == "user", ROLES["user"]).otherwise(ROLES["assistant"])
    return _ordered(rows, "conv_id", F.concat(label, F.lit(": "), F.substring(F.coalesce("text", F.lit("")), 1, chars)), sep, "recent")


def bounded_history(turns: DataFrame, most: int = 60) -> DataFrame:
    """Messages kept, number of user turns and the last user message."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    kept = turns.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= most)
    mine = F.col("role") == "user"
    return kept.groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.count_if(mine).alias("user_turns"), F.max_by("text", F.when(mine, F.col("turn"))).alias("last_user"))


def evidence_block(hits: DataFrame, per: int = 900, most: int = 8000) -> DataFrame:
    """Numbered snippets in order of score up to the first that would not fit; whether any was left out."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), "node_id")
    rows = hits.withColumn("turn", F.row_number().over(order)).withColumn("line", F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("] "), F.substring("text", 1, per)))
    rows = rows.withColumn("_sum", F.sum(F.length("line")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    counted = rows.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(F.col("_sum") <= most).alias("kept"))
    block = _ordered(rows.filter(F.col("_sum") <= most), "query_id", F.col("line"), "\n", "block")
    return counted.join(block, "query_id", "left").select("query_id", "kept", (F.col("kept") < F.col("n")).alias("truncated"), F.coalesce("block", F.lit("")).alias("block"))


def summary_due(turns: DataFrame, keep: int, markers: list[str], budget: int, reserve: int) -> DataFrame:
    """Per conversation of (conv_id, turn, text): whether its older messages should be summarised, up to which, and from where.

    Due where there are more than ``keep`` messages, one holds a marker of what must not be forgotten, and the token ``budget``
    leaves the ``reserve`` that a summary takes. ``upto`` messages from the start go into it; with a column ``summarised``
    (messages that an earlier summary holds) it starts behind those, and nothing new means not due.
    """
    done = F.max("summarised") if "summarised" in turns.columns else F.lit(0)
    marked = F.bool_or(F.coalesce(F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(F.col("text"), m)), F.lit(False)))
    sums = turns.groupBy("conv_id").agg(F.count("*").alias("n"), marked.alias("marked"), F.sum(T.estimated_tokens(F.col("text"))).alias("tokens"), F.coalesce(done, F.lit(0)).cast("long").alias("start"))
    upto = F.greatest(F.lit(0).cast("long"), F.col("n") - keep)
    due = (F.col("n") > keep) & F.col("marked") & (budget - F.col("tokens") >= reserve) & (upto > F.col("start"))
    return sums.select("conv_id", due.alias("due"), "start", upto.alias("upto"))
