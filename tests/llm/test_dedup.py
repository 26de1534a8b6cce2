from __future__ import annotations

import itertools
import random
import time
from pathlib import Path

import numpy as np
import pytest
from llm.conftest import ODD

from palimspark.llm import embed_dedup, line_dedup, minhash
from palimspark.llm.components import connected_components


def closure(n, links):
    root = list(range(n))
    for _ in range(n):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def shingles(text, k):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(texts, k, percent):
    sets = [shingles(t, k) for t in texts]
    links = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return [len(s) for s in sets], closure(len(sets), links)


def edited(words, rng, share):
    return [rng.choice("abcdefgh") * rng.randint(3, 6) if rng.random() < share else w for w in words]


def test_minhash_equals_brute_force(spark, make_docs):
    rng = random.Random(5)
    texts = []
    for g in range(12):
        base = [f"w{rng.randint(0, 4000)}" for _ in range(rng.randint(8, 120))]
        texts += [" ".join(edited(base, rng, share)) for share in (0, 0, 0.01, 0.03, 0.05, 0.1, 0.2)]
    for k in (2, 5):
        n, root = brute(texts, k, 80)
        got = {r["doc_id"]: r for r in minhash.near_duplicates(make_docs(texts), words=k).collect()}
        assert [got[i]["n_shingles"] for i in range(len(texts))] == n
        assert [got[i]["component_id"] for i in range(len(texts))] == root


def test_minhash_joins_a_dense_group_and_leaves_strangers(spark, make_docs):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(edited(base, rng, 0.04 if i % 5 else 0.3)) for i in range(120)]
    _, root = brute(texts, 2, 80)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(make_docs(texts), words=2).collect()}
    assert [got[i] for i in range(len(texts))] == root


def test_minhash_edge_cases(spark, make_docs):
    rows = minhash.near_duplicates(make_docs([*ODD, (None, "a b c"), (None, None)], clash=True), words=2).collect()
    got = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert len(rows) == len(ODD) + 2
    assert [got[i]["n_shingles"] for i in (0, 1, 2, 3)] == [0, 0, 0, 1]
    assert all(got[i]["kept"] for i in (0, 1, 2, 3, 4, 5)) and not got[6]["kept"] and got[6]["component_id"] == 5
    assert minhash.near_duplicates(make_docs([]), words=2).collect() == []


def test_near_duplicates_go_by_row(spark, make_docs):
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"other{i}" for i in range(30))
    rows = [(1, a), (1, a), (2, f"{a} z"), (2, b), (None, a), (3, ""), (3, ""), (None, None), (None, b)]
    got = minhash.without_near_duplicates(make_docs(rows, clash=True)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted([(1, a), (2, b), (3, ""), (3, ""), (None, None)], key=str)
    assert minhash.without_near_duplicates(make_docs([])).collect() == []


def test_parity_bits_never_overstate_a_difference():
    rng = np.random.default_rng(4)
    for n in (1, 30, 400, 5000):
        pool = np.unique(rng.integers(0, 2**63, 2 * n).astype(np.uint64))
        x, y = set(rng.choice(pool, n).tolist()), set(rng.choice(pool, n).tolist())
        bits = [minhash.parity_bits(np.array(sorted(s), dtype=np.uint64)) for s in (x, y)]
        assert sum(int(w).bit_count() for w in bits[0] ^ bits[1]) <= len(x ^ y)


def test_minhash_leaves_only_tables_that_the_result_reads(spark, make_docs):
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(folder.iterdir()) if folder.exists() else set()
    minhash.near_duplicates(make_docs([f"{'a b c d e f g h i j k l m n o p ' * 3}{i % 7}" for i in range(40)]), words=2).collect()
    assert sorted(p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before) == ["heads", "linked", "nodes", "sketches"]


def test_sketches_estimate_jaccard_and_fill_every_bin():
    rng = np.random.default_rng(1)
    for n in (1, 3, 40, 2000):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        assert minhash.sketch(a, 240).max() < np.iinfo(np.uint64).max
    pool = rng.integers(0, 2**63, 1000).astype(np.uint64)
    x, y = minhash.sketch(pool[:900], 1024), minhash.sketch(pool[100:], 1024)
    assert abs((x == y).mean() - 0.8) < 0.06


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert connected_components(edges.limit(0)).collect() == []


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_line_dedup_equals_brute_force(spark, make_docs):
    rng = random.Random(3)
    lines = ["".join(rng.choice("abc déf") for _ in range(rng.randint(22, 40))).strip() + "x" for _ in range(30)]
    for line in lines[:20]:
        at = rng.randrange(len(line))
        lines.append([line[:at] + line[at + 1 :], line[:at] + "z" + line[at:], line[:at] + "z" + line[at + 1 :]][rng.randrange(3)])
    texts = ["\n".join(rng.choices([*lines, "short", "shore", "", " "], k=6)) for _ in range(25)]
    seen, want = [], {}
    for i, text in enumerate(texts):
        want[i] = []
        for pos, line in enumerate(text.split("\n")):
            line = line.strip(line_dedup.SPACES)
            if not line:
                continue
            long = line_dedup.NEAR_CHARS
            if any(line == s or (min(len(line), len(s)) >= long and abs(len(line) - len(s)) < 2 and distance(line, s) < 2) for s in seen):
                want[i].append(pos)
            seen.append(line)
    docs = make_docs(texts)
    got = {r["doc_id"]: r for r in line_dedup.line_digests(docs).collect()}
    assert {i: got[i]["dropped"] for i in want} == {i: ",".join(map(str, p)) for i, p in want.items()}
    left = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    for i, text in enumerate(texts):
        rest = "\n".join(line for pos, line in enumerate(text.split("\n")) if pos not in want[i])
        assert left.get(i, "") == (rest if not want[i] or rest.strip() else "")


def test_one_edit_counts_in_lines_of_any_length(make_docs):
    rng = random.Random(9)
    texts = ["\n".join("".join(rng.choice("ab1é ") for _ in range(rng.randint(0, 6))) for _ in range(4)) for _ in range(40)]
    seen, want = [], {}
    for i, text in enumerate(texts):
        want[i] = []
        for pos, line in enumerate(t.strip(line_dedup.SPACES) for t in text.split("\n")):
            if line:
                if any(distance(line, s) < 2 for s in seen):
                    want[i].append(pos)
                seen.append(line)
    got = {r["doc_id"]: r["dropped"] for r in line_dedup.line_digests(make_docs(texts)).collect()}
    assert got == {i: ",".join(map(str, p)) for i, p in want.items()}


def test_an_edit_may_be_one_byte_as_in_the_sql(make_docs):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(11)
    texts = ["\n".join("".join(rng.choice("ab1éèe漢𝄞 ") for _ in range(rng.randint(0, 5))) for _ in range(4)) for _ in range(60)]
    got = {r["doc_id"]: tuple(r) for r in line_dedup.line_digests(make_docs(texts), by_bytes=True).collect()}
    assert got != {r["doc_id"]: tuple(r) for r in line_dedup.line_digests(make_docs(texts)).collect()}
    own = duckdb.connect()
    own.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    own.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    assert got == {r[0]: r for r in own.execute(line_dedup.oracle()).fetchall()}


def test_a_text_of_very_many_dropped_lines_is_cut_in_linear_time(make_docs):
    lines = [f"line number {i * 7919} of a long text" for i in range(60_000)]
    docs = make_docs(["\n".join(lines[::2]), "\n".join(lines)])
    began = time.time()
    left = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs, near_chars=100).collect()}
    assert left[1].split("\n") == lines[1::2] and time.time() - began < 30


def test_line_dedup_edge_cases(spark, make_docs):
    docs = make_docs([*ODD, (None, "a line that is long enough to count"), (7, "a line that is long enough to count!")], clash=True)
    got = line_dedup.line_digests(docs).collect()
    assert len(got) == len(ODD) + 2
    assert {r["doc_id"]: r["n_near"] for r in got}[7] == 1
    assert line_dedup.dedup_lines(docs).columns == docs.columns
    assert line_dedup.line_digests(make_docs([])).collect() == []


def test_line_verdicts_stay_with_their_row(spark, make_docs):
    line = "a common line that several documents hold"
    unique = [f"{w} " * 8 + "stands in one text only" for w in ("alpha", "bravo", "charlie", "delta")]
    docs = make_docs([(1, line), (None, unique[0]), (None, f"{line}\n{unique[1]}"), (5, unique[2]), (5, line), (5, f"{line}\n{unique[3]}")])
    left = "\n".join(r["text"] for r in line_dedup.dedup_lines(docs).collect()).split("\n")
    assert sorted(left) == sorted([*unique, line])


def test_deletion_hashes_agree_where_strings_do():
    line = "abbcadé漢𝄞x"
    hashes = line_dedup.deletion_hashes(line).tolist()
    whole = lambda s: int(line_dedup.deletion_hashes(s)[-1])
    assert hashes == [*(whole(line[:i] + line[i + 1 :]) for i in range(len(line))), whole(line)]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_embedding_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [rng.normal(size=16) for _ in range(300)]
    for g in range(5):
        rows += [rows[g] + rng.normal(size=16) * 0.12 for _ in range(30)]
    rows += [rows[0], rows[0], rows[1] * 3]
    m = np.array(rows, dtype=np.float32).astype(float)
    u = m / np.sqrt((m * m).sum(axis=1, keepdims=True))
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    root = closure(len(m), np.argwhere(near).tolist())
    got = {r["vec_id"]: r for r in embed_dedup.near_vectors(vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(m)])).collect()}
    assert sum(got[i]["n_links"] for i in range(len(m))) >= 0.98 * near.sum()
    assert all(got[i]["n_links"] <= near[i].sum() for i in range(len(m)))
    assert np.mean([got[i]["component_id"] == root[i] for i in range(len(m))]) > 0.98


def test_embedding_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None, 0), (1, [0.0, 0.0], 0), (2, [nan, 1.0], 0), (3, [inf, 1.0], 0), (4, [1.0, 0.0], None), (5, [2.0, 0.0], 1), (5, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (6, [1.0, 0.0, 0.0], 1), (7, [], 0), (8, [None, 1.0], 0)]
    got = embed_dedup.near_vectors(vectors(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r["vec_id"]: r["n_links"] for r in got if r["vec_id"] in (0, 1, 2, 3, 6, 7, 8)} == {i: 0 for i in (0, 1, 2, 3, 6, 7, 8)}
    assert all(r["n_links"] == 3 and r["component_id"] == 4 for r in got if r["vec_id"] in (4, 5, None))
    assert embed_dedup.near_vectors(vectors(spark, rows).limit(0)).collect() == []
