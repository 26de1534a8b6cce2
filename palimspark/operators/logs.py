"""Retrieval traces, run logs and call logs: replay, loops, rates, roll-ups and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stage_deltas(trace: DataFrame) -> DataFrame:
    """Each event with what it adds to the time of the one before, in replay order."""
    order = Window.partitionBy("query_id").orderBy("ts", "event_id")
    return trace.withColumn("step", F.row_number().over(order)).withColumn("delta_ms", F.col("elapsed_ms") - F.lag("elapsed_ms", 1, 0.0).over(order))


def loops(steps: DataFrame, most: int = 2) -> DataFrame:
    """(run_id, signature, break_step): where a signature comes up more often than allowed."""
    seen = F.row_number().over(Window.partitionBy("run_id", "signature").orderBy("step"))
    return steps.withColumn("seen", seen).filter(F.col("seen") == most + 1).select("run_id", "signature", F.col("step").alias("break_step"))


def without_news(rounds: DataFrame) -> DataFrame:
    """(run_id, round, nothing_new): no evidence that the round before lacked, or a signature seen before."""
    order = Window.partitionBy("run_id").orderBy("round")
    before = F.coalesce(F.lag("evidence").over(order), F.array().cast("array<string>"))
    known = F.row_number().over(Window.partitionBy("run_id", "signature").orderBy("round")) > 1
    return rounds.select("run_id", "round", ((F.size(F.array_except("evidence", before)) == 0) | known).alias("nothing_new"))


def request_rate(calls: DataFrame, limit: int, gap_s: float, seconds: int = 60) -> DataFrame:
    """Calls in the trailing window, whether the limit is broken, and the wait that would have been needed."""
    second = F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0
    own = Window.partitionBy("key").orderBy("_s")
    inside = own.rangeBetween(-seconds, 0)
    order = Window.partitionBy("key").orderBy("_s", "event_id")
    rows = calls.withColumn("_s", second).withColumns({"in_window": F.count("*").over(inside), "_first": F.min("_s").over(inside), "_before": F.lag("_s").over(order)})
    rate_wait = F.when(F.col("in_window") > limit, F.col("_first") + seconds - F.col("_s")).otherwise(0.0)
    gap_wait = F.greatest(F.lit(0.0), gap_s - (F.col("_s") - F.coalesce("_before", F.col("_s") - gap_s)))
    return rows.select("key", "event_id", "in_window", (F.col("in_window") > limit).alias("breach"), F.round(F.greatest(rate_wait, gap_wait), 3).alias("wait_s"))


def run_rollup(steps: DataFrame) -> DataFrame:
    """One row per run of steps (run_id, seq, action, kind, latency): steps, calls, errors, denials, latency, state, last action.

    ``kind`` is tool, error, denial or another word. A run whose last step is an error has failed, one whose last step is a
    denial waits for a person. Steps of equal ``seq`` are told apart by their action.
    """
    order = F.struct("seq", "action")
    last = F.max_by("kind", order)
    kinds = {"tool_calls": "tool", "errors": "error", "denials": "denial"}
    state = F.when(last == "error", "failed").when(last == "denial", "needs_human").otherwise("done")
    return steps.groupBy("run_id").agg(F.count("*").alias("steps"), *(F.count_if(F.col("kind") == k).alias(n) for n, k in kinds.items()), F.round(F.sum("latency"), 4).alias("latency"), state.alias("status"), F.max_by("action", order).alias("final_action"))


def budget_use(rollup: DataFrame, limits: dict[str, float]) -> DataFrame:
    """used/limit per dimension and whether any is exceeded (strictly)."""
    over = F.lit(False)
    for name, most in limits.items():
        over = over | (F.col(name) > most)
    return rollup.select("run_id", *(F.concat(F.col(n).cast("string"), F.lit(f"/{m}")).alias(f"{n}_budget") for n, m in limits.items()), over.alias("over_budget"))


def latency_summary(calls: DataFrame) -> DataFrame:
    """Cold call, upper median of the others, and whether both stay within their bounds."""
    numbered = calls.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("ts", "event_id")))
    rest = F.sort_array(F.collect_list(F.when(F.col("_n") > 1, F.col("value"))))
    grouped = numbered.groupBy("key").agg(F.max(F.when(F.col("_n") == 1, F.col("value"))).alias("cold"), rest.alias("_hot"))
    hot = F.try_element_at("_hot", (F.floor(F.size("_hot") / 2) + 1).cast("int"))
    return grouped.withColumn("hot", hot).select("key", "cold", "hot", ((F.col("cold") <= 60) & (F.col("hot") <= 10)).alias("accepted"))


# What in the parameters of a call looks like an attempt to steer it.
SUSPICIOUS = ["ignore previous instructions", "ignore all instructions", "system prompt", "sudo ", "you are now", "act as", "pretend"]


def _field(json: Column, name: str) -> Column:
    return F.try_variant_get(F.try_parse_json(json), f"$.{name}", "variant")


def _kind(json: Column, name: str) -> Column:
    """Type of a field of a JSON object, such as BIGINT or ARRAY<STRING>; null where the field is absent."""
    return F.schema_of_variant(_field(json, name))


def context_valid(context: Column) -> Column:
    """A caller's context (JSON): null and {} are anonymous; else an object whose user_id, where given, is text that isn't
    blank, and whose roles and scopes, where given, are lists."""
    user = F.try_variant_get(F.try_parse_json(context), "$.user_id", "string")
    named = _kind(context, "user_id").isNull() | ((_kind(context, "user_id") == "STRING") & (F.trim(user) != ""))
    lists = [_kind(context, k).isNull() | _kind(context, k).startswith("ARRAY") for k in ("roles", "scopes")]
    whole = F.schema_of_variant(F.try_parse_json(context)).startswith("OBJECT")
    return context.isNull() | (F.coalesce(whole, F.lit(False)) & named & lists[0] & lists[1])


def permission_decisions(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """(call_id, decision) of calls (call_id, tool, tenant_id, params, context; the last two as JSON texts).

    The checks come in order: context, steering texts in the parameters, a foreign tenant in them, then the tool's tier by
    ``tools`` (tool, risk, required_scopes; one row per tool). Roles of a high tier are matched by part of the name, of a
    critical tier by the whole. Unknown tools and tiers are denied. Parameters that are null count as empty.
    """
    rows = calls.join(tools.select("tool", "risk", "required_scopes"), "tool", "left")
    of = lambda k: F.coalesce(F.try_variant_get(F.try_parse_json("context"), f"$.{k}", "array<string>"), F.array().cast("array<string>"))
    low = F.lower(F.coalesce("params", F.lit("")))
    steering = F.exists(F.array(*map(F.lit, SUSPICIOUS)), lambda p: F.contains(low, p))
    other = F.try_variant_get(F.try_parse_json("params"), "$.tenant_id", "string")
    foreign = F.coalesce((other != "") & (other != F.col("tenant_id")), F.lit(False))
    scoped = F.coalesce(F.arrays_overlap("required_scopes", of("scopes")), F.lit(False))
    senior = F.exists(of("roles"), lambda r: F.lower(r).rlike("supervisor|admin"))
    risk = F.col("risk")
    decision = (
        F.when(~context_valid(F.col("context")), "deny:context").when(steering, "deny:injection").when(foreign, "deny:tenant").when(risk == "low", "allow").when(risk == "medium", "allow+audit")
        .when(risk == "high", F.when(scoped | senior, "allow+audit").otherwise("approval:scope"))
        .when(risk == "critical", F.when(F.array_contains(of("roles"), "admin"), "allow+audit").otherwise("deny:admin")).otherwise("deny:tool")
    )
    return rows.select("call_id", decision.alias("decision"))


def parameter_errors(params: Column, spec: dict[str, tuple[str, bool]]) -> Column:
    """Errors of a call's parameters (a JSON object) by a table of name: (integer or string, required).

    A field that is given as null is there but of no type. Other types than the two aren't checked.
    """
    missing = [F.when(_kind(params, name).isNull(), F.lit(f"missing:{name}")) for name, (_, required) in spec.items() if required]
    fits = {"integer": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL|BOOLEAN)", "string": "^STRING"}
    wrong = [F.when(~_kind(params, name).rlike(fits[kind]), F.lit(f"type:{name}")) for name, (kind, _) in spec.items() if kind in fits]
    return F.array_compact(F.array(*missing, *wrong))


def plan_errors(plan: Column) -> Column:
    """Errors of a plan, an array of steps (type, tool, query, description); a step without a type executes."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""

    def error(step: Column, at: Column) -> Column:
        kind = F.coalesce(step["type"], F.lit("execute"))
        found = F.when(~kind.isin("execute", "retrieve"), "type").when((kind == "execute") & blank(step["tool"]), "tool").when((kind == "retrieve") & blank(step["query"]) & blank(step["description"]), "query")
        return F.concat(F.lit("step["), at.cast("string"), F.lit("]: "), found)

    empty = F.coalesce(F.size(plan), F.lit(0)) <= 0
    return F.when(empty, F.array(F.lit("empty plan"))).otherwise(F.array_compact(F.transform(plan, error)))


def steps_to_do(steps: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Steps (run_id, step_index, args_hash) without a checkpoint of the same index and arguments that has a result."""
    return steps.join(checkpoints.filter(F.col("result_hash").isNotNull()), ["run_id", "step_index", "args_hash"], "left_anti")


def route(risk: Column, intent: Column, fast: bool) -> Column:
    if not fast:
        return F.lit("full")
    return F.when(risk.isin("high", "critical"), "hitl_pre").when((risk == "low") & (intent == "kb_qa"), "fast").otherwise("full")
