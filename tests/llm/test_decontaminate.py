from __future__ import annotations

import hashlib
import random
import re

import pytest
from llm.conftest import ODD

from palimspark.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEM = "The quick brown fox jumps over the lazy dog while seven wizards brew potions"
rng = random.Random(7)
NOISE = " ".join(rng.choice("abcdef") for _ in range(3000))
BENCH = [(3, ITEM), (12, "short item here"), (7, NOISE[200:260]), (5, None), (6, " .. "), (3, "Another text of the same id, which has as many as twelve words in it"), (None, "nameless item of four words"), (21, ITEM)]
TEXTS = [
    *ODD, f"before, {ITEM.upper()}! after", ITEM[:60], "a SHORT--item\nhere and short item", f"{ITEM} {ITEM}", NOISE, "a nameless item of four words b",
    "jumps over the lazy dog while seven wizards brew potions jumps over", "shöрt item here", "\x00short\x7fitem|here　x", f"{LONG}" if (LONG := ODD[4]) else "",
]


def brute(text, bench):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words, hit, items = WORD.findall(lower(text)), set(), set()
    for item, body in bench:
        w = WORD.findall(lower(body))
        n = min(len(w), 10)
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1) if n else ():
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                items.add(item)
    named = sorted(str(i) for i in items if i is not None)
    return len(words), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(BENCH, "item_id long, text string")


@pytest.mark.parametrize("most", [decontaminate.BROADCAST_WINDOWS, 0])
def test_equals_brute_force(spark, make_docs, bench, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", most)
    rows = [*enumerate(TEXTS), (None, ITEM), (None, "clean")]
    got = sorted(map(tuple, decontaminate.item_digests(decontaminate.scan(make_docs(rows, clash=True), bench)).collect()), key=str)
    assert got == sorted(((i, *brute(t, BENCH)) for i, t in rows), key=str)


def test_few_bits_only_add_candidates(make_docs, bench, monkeypatch):
    monkeypatch.setattr(decontaminate, "MIN_BITS", 64)
    monkeypatch.setattr(decontaminate, "MAX_BITS", 64)
    got = sorted(map(tuple, decontaminate.item_digests(decontaminate.scan(make_docs(TEXTS), bench)).collect()))
    assert got == sorted((i, *brute(t, BENCH)) for i, t in enumerate(TEXTS))


def test_spans_and_documents_go(make_docs, bench):
    docs = make_docs(TEXTS, clash=True).withColumn("items", decontaminate.F.lit(1)).withColumns({c: decontaminate.F.lit(1) for c in ("_n_words", "n", "at", "gram")})
    cut = decontaminate.remove_spans(docs, bench)
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    n = len(ODD)
    assert cut.columns == docs.columns and len(texts) == len(TEXTS)
    assert texts[n] == "before, after" and texts[n + 2] == "a and short item" and texts[n + 1] == "wiza" and texts[0] is None and texts[1] == ""
    assert texts[n + 3] == "" and texts[n + 5] == "a b"
    clean = decontaminate.remove_documents(docs, bench)
    bad = {i for i, t in enumerate(TEXTS) if brute(t, BENCH)[4]}
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == set(range(len(TEXTS))) - bad
    assert {r["doc_id"] for r in decontaminate.remove_documents(docs, bench, most_percent=50).collect()} > set(range(len(TEXTS))) - bad


def test_empty_tables(spark, make_docs, bench):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.scan(make_docs([]), bench).collect() == []
    assert [r["n_hit"] for r in decontaminate.scan(make_docs(TEXTS), none).collect()] == [0] * len(TEXTS)
    assert decontaminate.remove_spans(make_docs([]), none).collect() == []
