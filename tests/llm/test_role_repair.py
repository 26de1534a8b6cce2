from __future__ import annotations

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from palimspark.llm import role_repair
from palimspark.llm.role_parser import START, Parser

SCHEMA = "conv_id long, turn long, role string, text string"
FOLLOW = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NAMES = {"u": "user", "a": "assistant"}
rng = random.Random(5)


def cheapest(rows):
    """Least (cost, audit) for each last role, audits spelled out; rows are (role, text, must go, truncated)."""

    def with_insertions(best):
        for _ in range(3):
            for last, (cost, audit, out) in [*best.items()]:
                for r in "ua":
                    if (last, r) in FOLLOW:
                        offer(best, FOLLOW[last, r], (cost + 2, audit + "I", (*out, f"{NAMES[r]}:")))
        return best

    def offer(best, last, way):
        best[last] = min(best.get(last, way), way)

    best = with_insertions({"": (0, "", ())})
    for role, text, gone, cut in rows:
        after = {}
        for last, (cost, audit, out) in best.items():
            offer(after, last, (cost + 3, audit + "D", out))
            if not gone:
                if (last, role[:1]) in FOLLOW:
                    offer(after, FOLLOW[last, role[:1]], (cost + cut, audit + "K", (*out, f"{role}:{text}")))
                for r in "ua":
                    if (last, r) in FOLLOW:
                        offer(after, FOLLOW[last, r], (cost + 2 + cut, audit + "R", (*out, f"{NAMES[r]}:{text}")))
        best = with_insertions(after)
    return min(best[last] for last in ("", "a") if last in best)


def search(rows):
    """All sequences of edits, cheapest and ASCII-least first."""
    heap = [(0, "", 0, "", ())]
    while True:
        cost, audit, i, last, out = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, out
        for r in "ua":
            if (last, r) in FOLLOW and not audit.endswith("III"):
                heapq.heappush(heap, (cost + 2, audit + "I", i, FOLLOW[last, r], (*out, f"{NAMES[r]}:")))
        if i < len(rows):
            role, text, gone, cut = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last, out))
            if not gone:
                if (last, role[:1]) in FOLLOW:
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, FOLLOW[last, role[:1]], (*out, f"{role}:{text}")))
                for r in "ua":
                    if (last, r) in FOLLOW:
                        heapq.heappush(heap, (cost + 2 + cut, audit + "R", i + 1, FOLLOW[last, r], (*out, f"{NAMES[r]}:{text}")))


def damaged(row):
    conv, turn, role, text = (" " if v is None else v for v in row)
    kind = zlib.crc32(f"{conv}:{turn}".encode()) % 20
    text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
    return [(row[1], "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)


def expected(rows, harm=True):
    found = {}
    for row in rows:
        found.setdefault(row[0], []).extend(damaged(row) if harm else [(row[1], row[2] or " ", row[3] or " ")])
    result = []
    for conv, own in found.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:32], hashlib.sha256(r[2].encode()).hexdigest()))
        counts, seen, judged = [0, 0, 0], set(), []
        for _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            judged.append((role, text, fault in (0, 1), int(fault == 2)))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, out = cheapest(judged)
        result.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()))
    return sorted(result, key=str)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def made(n):
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["system"] * (turn == 0) + ["user", "assistant"] * 3 + ["tool", "", None] * rng.randrange(2))
            text = rng.choice(["Fine.", "Is it?", "cut off", "", None, " \n", f"Text {rng.random()}!", f"é {rng.random()}", "same words."])
            rows.append((conv, rng.choice([turn] * 9 + [None, turn + 3]), role, text))
    return rows


ODD = [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (-1, None, "user", "one."), (-1, None, "assistant", "two."), (-2, 1, "user", "x" * 300_000 + "."), (-3, 5, "u", "Same."), (-3, 5, "u", "Same."), (-3, 5, "u", "Same.")]


@pytest.mark.parametrize("block", [role_repair.BLOCK, 2])
def test_equals_brute_force(spark, block):
    rows = [*made(120), *ODD]
    table = spark.createDataFrame(rows, SCHEMA).withColumn("audit", role_repair.F.lit("x")).withColumn("row", role_repair.F.lit(1))
    repaired, report = role_repair.repair(role_repair.damage(table), block=block)
    got = role_repair.repair_digests(repaired, report, table).select(COLUMNS)
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)


def test_yardstick_equals_search():
    kinds = [("s", "", 0, 0), ("u", "", 0, 0), ("a", "", 0, 1), ("t", "", 0, 0), ("u", "", 1, 0)]
    for n in range(4):
        for rows in itertools.product(kinds, repeat=n):
            assert cheapest(rows) == search(rows)


def test_a_long_conversation_in_blocks(spark):
    """One conversation with most rows, many of them alike, cut into blocks and partitions."""
    rows = [(1, i // 2, rng.choice(["user", "assistant", "user", "assistant", "system"]), rng.choice([f"t{i}.", f"t{i}", "again."])) for i in range(800)]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", "All is well.") for c in range(10, 14) for t in range(2)]
    repaired, report = role_repair.repair(spark.createDataFrame(rows, SCHEMA).repartition(7), block=37)
    got = role_repair.repair_digests(repaired, report, spark.createDataFrame(rows, SCHEMA)).select(COLUMNS)
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows, harm=False)
    roles = [r["role"][0] for r in repaired.where("conv_id = 1").orderBy("block", "at").collect()]
    assert re.fullmatch("s?(ua)+", "".join(roles))


def test_empty_table_and_dropped_conversations(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert role_repair.repair_digests(*role_repair.repair(role_repair.damage(none)), none).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    table = spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)
    got = role_repair.repair_digests(*role_repair.repair(role_repair.damage(table)), table).select(COLUMNS).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_blocks_join_as_one():
    parser = Parser()
    for _ in range(300):
        codes = "".join(rng.choice("suaua?") + rng.choice("   bdt") for _ in range(rng.randrange(1, 30)))
        whole = parser.joined([parser.block(codes, [START])])
        for size in (1, 3, 7):
            parts = [codes[i : i + 2 * size] for i in range(0, len(codes), 2 * size)]
            cost, found = parser.joined([parser.block(p, [START] if k == 0 else parser.nodes) for k, p in enumerate(parts)])
            assert (cost, "".join(a for a, _ in found)) == (whole[0], whole[1][0][0])
