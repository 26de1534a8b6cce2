from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
from llm.conftest import LONG, ODD

from palimspark.llm import runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
rng = random.Random(3)


def brute_runs(words):
    """Every period by itself, by comparing words that far apart."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(12, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, m, q) for (s, m), q in found.items())


def planted(doc, words):
    h = zlib.crc32(str(doc).encode())
    if doc is not None and h % 10 == 0 and words:
        a = h // 10 % len(words)
        p = 1 + (len(words) - a) // (3 + h // 10 % 8)
        return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def expected(doc, text):
    words = planted(doc, WORD.findall(text or ""))
    found = brute_runs(words)
    drop = {i for s, m, q in found for i in range(s + q, s + m)}
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    longest = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    return doc, len(found), *longest, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()


def texts():
    made = [*ODD, "a b c " * 4, "a b c " * 3, "x " * 5000, "a b " * 6 + "c " * 12 + "a b " * 6, "é\x0bü\tö  " * 5 + "\x85nbsp x " * 13]
    for _ in range(150):
        words = [f"w{rng.randrange(rng.choice([1, 2, 3, 30]))}" for _ in range(rng.randrange(150))]
        if words and rng.random() < 0.6:
            a = rng.randrange(len(words))
            p = 1 + rng.randrange(max(1, (len(words) - a) // 2))
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        made.append(" ".join(words * rng.choice([1, 1, 2])))
    return made


def test_equals_brute_force(make_docs):
    rows = [*enumerate(t for t in texts() if t != LONG), (None, "p q r s " * 9)]
    docs = make_docs(rows, clash=True).withColumn("runs", runs.F.lit(1))
    got = sorted(map(tuple, runs.run_digests(runs.find_runs(docs, runs.planted)).collect()), key=str)
    assert got == sorted((expected(i, t) for i, t in rows), key=str)


def test_long_texts_and_slices(make_docs):
    """One long period, and a long text without runs, beside short ones in the same batch."""
    long = " ".join(f"w{i % 6001}" for i in range(30_000))
    got = {r["doc_id"]: r for r in runs.find_runs(make_docs([LONG, long, "u v " * 10, None])).collect()}
    assert [tuple(r) for r in got[1]["runs"]] == [(0, 30_000, 6001)] and len(got[1]["collapsed"].split()) == 6001
    assert got[0]["runs"] == [] and got[0]["collapsed"] == LONG
    assert [tuple(r) for r in got[2]["runs"]] == [(0, 20, 2)] and got[2]["collapsed"] == "u v" and got[3]["collapsed"] == ""
    assert runs.find_runs(make_docs([])).collect() == []


def test_grammar_spells_the_words():
    for _ in range(200):
        words = [rng.randrange(rng.choice([1, 2, 5])) for _ in range(rng.randrange(1, 200))]
        free = max(words) + 1
        level, rules = runs.re_pair(words, free)
        spelled = lambda s: [s] if s < free else spelled(rules[s - free][0]) + spelled(rules[s - free][1])
        assert [w for s in level for w in spelled(s)] == words
        pairs, last = {}, {}
        for i, pair in enumerate(zip(level, level[1:], strict=False)):
            if last.get(pair) != i - 1 or pair[0] != pair[1]:
                pairs[pair], last[pair] = pairs.get(pair, 0) + 1, i
        assert max(pairs.values(), default=0) < 2


def test_stretches_hold_all_runs():
    for _ in range(300):
        words = np.array([rng.randrange(rng.choice([2, 3, 9])) for _ in range(90)], np.int32)
        held = runs.stretches(words, np.array([40, 90]))
        assert all(b <= 40 or a >= 40 for a, b in held)
        for base, part in ((0, words[:40]), (40, words[40:])):
            for s, m, _ in brute_runs(part.tolist()):
                assert any(a <= base + s and base + s + m <= b for a, b in held)
