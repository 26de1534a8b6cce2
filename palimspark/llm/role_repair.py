"""Repair of the turn structure of conversations by generalised LR parsing of their roles.

The rows of a conversation, by turn, must spell the role grammar (an optional system turn, then pairs of user and assistant).
Faulty rows are blank, repeat an earlier row's role and text, or are truncated (their last character doesn't end a
sentence); the first fault counts. Edits keep, rerole, delete or insert rows; ``role_parser.Parser`` finds the cheapest
ones, and of those the ASCII-least string of their initials. The job around it:

1. Faults are Columns; repeated rows are found by one aggregation over (conversation, role, SHA-256 of the text), joined
   back only where a key occurs twice.
2. Two characters a row are range-partitioned by the whole order of rows and cut into blocks of BLOCK rows. A
   conversation that holds a third of all rows thus lies in many blocks and tasks.
3. Each block is parsed by itself: once where a conversation begins in it, else from every stack that the parser can
   have; the cheapest moves between stacks of all blocks of a conversation are then joined in order. This join and the
   audit are the only things that one task holds of a whole conversation, some ten bytes for each of its rows.
4. Edits go back to the rows by row number.

``repair_digests`` reads the repaired rows of a conversation in order and hashes them as they come: SHA-256 is sequential,
so one task reads a whole conversation there, but holds one batch of it.

Defined results: a null conv_id is a conversation like another; null turns come first; null role or text counts as one
space; rows of one turn stand in the order of role, then the first 32 characters of the text, then its SHA-256; rows equal
in all four columns are adjacent repeats; roles count by their first character; very long texts are read whole; a
conversation without rows has cost 0 and an empty audit; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .role_parser import BLANK, DELETE, DUPLICATE, INSERT, OTHER, ROLES, SOUND, START, TRUNCATED, Move, Parser, Weights
from .shared import Scratch

BLOCK = 4096
SPACES = " \t\n\x0b\x0c\r"
ENDERS = ".!?"
#: Neighbouring roles' initials that are in order.
LEGAL = {"su", "ua", "au"}

_LONG, _TEXT = pa.int64(), pa.string()
_COUNTS = [("illegal", _LONG), ("blank", _LONG), ("duplicate", _LONG), ("truncated", _LONG)]
_MOVE = pa.struct([("source", pa.int32()), ("target", pa.int32()), ("cost", _LONG), ("audit", _TEXT), ("roles", _TEXT)])
_PART = pa.struct([("block", _LONG), ("audit", _TEXT), ("roles", _TEXT)])
BLOCKS = pa.schema([("conv_id", _LONG), ("block", _LONG), ("rows", pa.list_(_LONG)), ("first", _TEXT), ("last", _TEXT), *_COUNTS, ("moves", pa.list_(_MOVE))])
PLANS = pa.schema([("conv_id", _LONG), ("cost", _LONG), *_COUNTS, ("audit", _TEXT), ("parts", pa.list_(_PART))])
EDITS = pa.schema([("conv_id", _LONG), ("block", _LONG), ("at", _LONG), ("row", _LONG), ("edit", _TEXT), ("role", _TEXT)])
DIGESTS = pa.schema([("conv_id", _LONG), ("repaired_sha256", _TEXT)])


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with every twentieth row dropped, emptied, stripped of sentence ends, repeated or given to the user."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    rows = _plain(conversations).withColumn("kind", kind).where("kind != 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ENDERS, "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, F.lit(2)).otherwise(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _plain(conversations: DataFrame) -> DataFrame:
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), filled("role"), filled("text"))


def _last(text: Column) -> Column:
    return F.right(F.rtrim(text, F.lit(SPACES)), F.lit(1))


def _coded(rows: DataFrame) -> DataFrame:
    """conv_id, row, what orders the rows, and the code of each: its role's initial and its first fault."""
    keyed = rows.select("conv_id", "turn", "role", "row", F.left("text", F.lit(32)).alias("head"), F.sha2("text", 256).alias("digest"), _last(F.col("text")).alias("last"))
    key = ["conv_id", "role", "digest"]
    place = F.struct((F.col("turn").isNotNull()).alias("known"), "turn", "row")
    firsts = keyed.where("last != ''").groupBy(*key).agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    firsts = firsts.select(*(F.col(c).alias(f"f_{c}") for c in key), F.col("first.row").alias("f_row"))
    met = keyed.join(firsts, F.col("conv_id").eqNullSafe(F.col("f_conv_id")) & (F.col("role") == F.col("f_role")) & (F.col("digest") == F.col("f_digest")), "left")
    fault = (
        F.when(F.col("last") == "", F.lit(BLANK))
        .when(F.col("f_row") != F.col("row"), F.lit(DUPLICATE))
        .when(~F.col("last").isin(*ENDERS), F.lit(TRUNCATED))
        .otherwise(F.lit(SOUND))
    )
    initial = F.left("role", F.lit(1))
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit(OTHER))
    return met.select("conv_id", "turn", "role", "head", "digest", "row", F.concat(known, fault).alias("code"))


def _blocks(coded: DataFrame, weights: Weights, block: int) -> DataFrame:
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "head", "digest", "row")]
    partitions = int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = coded.repartitionByRange(partitions, *order).sortWithinPartitions(*order).select("conv_id", "row", "code")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, number = Parser(weights=weights), TaskContext.get().partitionId() << 32
        conv, codes, rows, begun = None, [], [], False  # begun: the block starts its conversation for sure
        out: list[dict] = []

        def close() -> None:
            nonlocal number
            initials, faults = [c[0] for c in codes], "".join(c[1] for c in codes)
            pairs = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
            moves = parser.block("".join(codes), [START] if begun else [START, *parser.nodes])
            out.append(
                {"conv_id": conv, "block": number, "rows": rows, "first": initials[0], "last": initials[-1], "illegal": pairs, "moves": [m._asdict() for m in moves]}
                | {"blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED)}
            )
            number += 1

        for batch in batches:
            for own, row, code in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "row", "code")), strict=True):
                if codes and (own != conv or len(codes) >= block):
                    close()
                    codes, rows, begun = [], [], own != conv
                conv = own
                codes.append(code)
                rows.append(row)
            if len(out) > 1000:
                yield pa.RecordBatch.from_pylist(out, schema=BLOCKS)
                out.clear()
        if codes:
            close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=BLOCKS)

    return ordered.mapInArrow(cut, from_arrow_schema(BLOCKS))


def _plans(blocks: DataFrame, weights: Weights) -> DataFrame:
    """For each conversation the cheapest edits, block by block, and its counts."""
    parts = F.array_sort(F.collect_list(F.struct("block", "first", "last", "illegal", "blank", "duplicate", "truncated", "moves")))

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(weights=weights)
        for batch in batches:
            out = []
            for conv, found in zip(batch.column("conv_id").to_pylist(), batch.column("found").to_pylist(), strict=True):
                cost, edits = parser.joined([[Move(**m) for m in b["moves"]] for b in found])
                between = sum(a["last"] + b["first"] not in LEGAL for a, b in zip(found, found[1:], strict=False))
                sums = {c: sum(b[c] for b in found) for c in ("illegal", "blank", "duplicate", "truncated")}
                sums["illegal"] += between
                own = [{"block": b["block"], "audit": audit, "roles": roles} for b, (audit, roles) in zip(found, edits, strict=True)]
                out.append({"conv_id": conv, "cost": cost, "audit": "".join(a for a, _ in edits), "parts": own} | sums)
            yield pa.RecordBatch.from_pylist(out, schema=PLANS)

    return blocks.drop("rows").groupBy("conv_id").agg(parts.alias("found")).mapInArrow(plan, from_arrow_schema(PLANS))


def _edits(blocks: DataFrame, plans: DataFrame) -> DataFrame:
    """One row for each edit: its block and place there, the number of the row it is about (null: inserted) and the role it leaves."""
    chosen = plans.select(F.explode("parts").alias("p")).select("p.*")
    met = blocks.select("conv_id", "block", "rows").join(chosen, "block").select("conv_id", "block", "rows", "audit", "roles")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.to_pylist():
                rows = iter(one["rows"])
                found = [{"conv_id": one["conv_id"], "block": one["block"], "at": i, "row": None if edit == INSERT else next(rows), "edit": edit, "role": role} for i, (edit, role) in enumerate(zip(one["audit"], one["roles"], strict=True))]
                yield pa.RecordBatch.from_pylist(found, schema=EDITS)

    return met.mapInArrow(spread, from_arrow_schema(EDITS))


def repair(conversations: DataFrame, weights: Weights = Weights(), block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The repaired rows, and a report of the conversations.

    Rows: conv_id, block and at (which order the rows of a conversation), turn (null where inserted), edit, role, text.
    Report: conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit.
    """
    scratch = Scratch(conversations.sparkSession)
    rows = scratch.written(_plain(conversations).withColumn("row", F.monotonically_increasing_id()), "conversation-rows")
    blocks = scratch.written(_blocks(_coded(rows), weights, block), "role-blocks")
    plans = scratch.written(_plans(blocks, weights), "role-plans")
    edits = _edits(blocks, plans).where(F.col("edit") != DELETE)
    named = F.coalesce(*(F.when(F.col("new") == initial, F.lit(name)) for initial, name in ROLES.items()))
    left = edits.select("conv_id", "block", "at", "edit", F.col("role").alias("new"), F.col("row").alias("e_row"))
    own = rows.select("row", "turn", "role", "text")
    kept = left.where(F.col("edit") != INSERT).join(own, F.col("e_row") == F.col("row"))
    kept = kept.select("conv_id", "block", "at", "turn", "edit", F.when(F.col("edit") == "K", F.col("role")).otherwise(named).alias("role"), "text")
    added = left.where(F.col("edit") == INSERT).select("conv_id", "block", "at", F.lit(None).cast("long").alias("turn"), "edit", named.alias("role"), F.lit("").alias("text"))
    spread = F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")
    gaps = rows.groupBy("conv_id").agg(F.coalesce(spread, F.lit(0)).cast("long").alias("gaps"))
    report = plans.drop("parts").join(gaps.withColumnRenamed("conv_id", "g_conv_id"), F.col("conv_id").eqNullSafe(F.col("g_conv_id")))
    return kept.unionByName(added), report.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def repair_digests(repaired: DataFrame, report: DataFrame, conversations: DataFrame) -> DataFrame:
    """The report of every conversation of ``conversations``, with the SHA-256 of its repaired rows."""
    lines = repaired.select("conv_id", "block", "at", F.concat("role", F.lit(":"), "text").alias("line"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None
        for batch in batches:
            out = []
            for own, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if state is None or own != conv:
                    if state is not None:
                        out.append({"conv_id": conv, "repaired_sha256": state.hexdigest()})
                    conv, state = own, hashlib.sha256(line.encode())
                else:
                    state.update(b"\n" + line.encode())
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=DIGESTS)
        if state is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "repaired_sha256": state.hexdigest()}], schema=DIGESTS)

    ordered = lines.repartition("conv_id").sortWithinPartitions("conv_id", "block", "at").select("conv_id", "line")
    digests = ordered.mapInArrow(digest, from_arrow_schema(DIGESTS))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    none = {c: F.lit(None).cast("long").alias(c) for c in counts} | {c: F.lit(None).cast("string").alias(c) for c in ("audit", "repaired_sha256")}
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), *none.values())
    told = report.select("conv_id", *counts, "audit", none["repaired_sha256"])
    hashed = digests.select("conv_id", *(none[c] for c in (*counts, "audit")), "repaired_sha256")
    joined = ids.unionByName(told).unionByName(hashed).groupBy("conv_id")
    filled = [F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in counts]
    return joined.agg(*filled, F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
