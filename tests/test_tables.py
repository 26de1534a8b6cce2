"""Tables that are built, appended to and read with bad rows; intake with memory; proofs, runs and cuts, by hand-made rows."""

from __future__ import annotations

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from palimspark.functions import text as T
from palimspark.operators import evaluation, grounding, vectors, versions
from palimspark.sources import files
from palimspark.storage import shared_path
from palimspark.streaming import jobs


def test_a_failed_vector_build_leaves_the_current_version(spark):
    base = shared_path(spark, "vectors")
    make = lambda rows: spark.createDataFrame(rows, "node_id long, embedding array<double>")
    with pytest.raises(ValueError):
        vectors.current_table(spark, base)
    vectors.build_table(make([(1, [1.0, 2.0])]), base, 2)
    for bad in ([(2, [1.0])], [(2, None)], [(None, [1.0, 2.0])]):
        with pytest.raises(ValueError):
            vectors.build_table(make([(1, [1.0, 2.0]), *bad]), base, 2)
        assert [r["node_id"] for r in vectors.current_table(spark, base).collect()] == [1]
    old = vectors.current_table(spark, base)
    vectors.build_table(make([(3, [0.5, 0.5]), (4, [0.0, 1.0])]), base, 2)
    assert sorted(r["node_id"] for r in vectors.current_table(spark, base).collect()) == [3, 4] and old.count() == 1


def test_a_replayed_audit_batch_adds_no_row(spark):
    path = shared_path(spark, "audit")
    at = lambda d: datetime.datetime(2024, 1, d, 12)
    rows = spark.createDataFrame([(at(1), "a"), (at(2), "b"), (at(2), "c")], "ts timestamp, action string")
    for batch in (0, 1, 1, 0):
        files.append_audit(rows, batch, path)
    back = files.read_audit(spark, path, "ts timestamp, action string")
    assert back.count() == 6 and back.filter("day = date'2024-01-02'").count() == 4
    streamed = jobs.finished(files.read_audit(spark, path, "ts timestamp, action string", stream=True).groupBy("day").count(), ["day"])
    assert {(r["day"].day, r["count"]) for r in streamed.collect()} == {(1, 2), (2, 4)}


def test_bad_lines_are_reported_with_file_and_line(spark):
    path = shared_path(spark, "lines")
    spark.createDataFrame([('{"a": 1}\n\n{"a": oops\n{"a": 2}\nnot json',)], "value string").coalesce(1).write.text(f"{path}/x")
    spark.createDataFrame([('{"a": 3}',)], "value string").coalesce(1).write.text(f"{path}/y")
    good, bad = files.quarantined(spark, f"{path}/*", "a int")
    assert sorted(r["a"] for r in good.collect()) == [1, 2, 3]
    assert sorted((r["line"], r["text"]) for r in bad.collect()) == [(3, '{"a": oops'), (5, "not json")]
    assert all("/x/" in r["file"] for r in bad.collect())


def test_a_failure_does_not_block_its_repeat_and_a_success_is_forgotten(spark):
    path = shared_path(spark, "calls")
    day = lambda d, h=0: datetime.datetime(2024, 1, d, h)
    first = [("k", 1, day(1), False), ("k", 2, day(1, 1), False), ("k", 3, day(1, 2), True), ("k", 4, day(1, 3), True), ("m", 5, day(1), True)]
    later = [("k", 6, day(2), True), ("k", 7, day(9), False), ("k", 8, day(9, 1), True), ("k", 9, day(9, 2), True), ("m", 10, day(3), False)]
    for n, rows in enumerate((first, later)):
        spark.createDataFrame(rows, "key string, event_id long, ts timestamp, success boolean").coalesce(1).write.mode("append").parquet(f"{path}/{n}")
    schema = spark.read.parquet(f"{path}/0").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)
    ran = jobs.finished(jobs.success_intake(stream, ["key"], 5 * 86_400_000, "30 days"), ["key", "event_id"], "append")
    assert {r["event_id"] for r in ran.collect()} == {1, 2, 3, 5, 7, 8}


def _intake(spark, calls):
    """The rows that a stream gave, and how many rows of state it held after each of its micro-batches."""
    met = shared_path(spark, "met")
    run = calls.writeStream.option("checkpointLocation", shared_path(spark, "offsets")).trigger(availableNow=True).foreachBatch(lambda rows, _: rows.write.mode("append").parquet(met)).start()
    run.awaitTermination()
    return spark.read.parquet(met), [op.numRowsTotal for p in run.recentProgress for op in p.stateOperators]


def test_success_intake_equals_brute_force_and_keys_share_state(spark):
    rng, path, ttl = random.Random(24), shared_path(spark, "calls"), 30 * 3_600_000
    start, names = datetime.datetime(2024, 1, 1), [None, "", "None", "a", "b"]
    batches, ids = [], iter(range(10**6))
    for day in range(4):
        at = lambda: start + datetime.timedelta(days=day, hours=rng.randrange(24), microseconds=rng.randrange(3))  # noqa: B023, E731
        batches.append([(rng.choice(names), rng.choice([None, *range(2**60, 2**60 + 300)]), next(ids), at(), rng.choice([True, False, False, None])) for _ in range(6000)])
        batches[-1].append(("late riser", 1, next(ids), start + datetime.timedelta(days=day, hours=23, minutes=59), True))
    schema = "name string, part long, event_id long, ts timestamp, success boolean"
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)
    until, want = {}, []
    for name, part, event, at, success in (row for rows in batches for row in sorted(rows, key=lambda r: (r[3], r[2]))):
        if at >= until.get((name, part), start):
            want.append((name, part, event))
            if success:
                until[name, part] = at + datetime.timedelta(milliseconds=ttl)
    got, states = _intake(spark, jobs.success_intake(stream, ["name", "part"], ttl, "1 hour", buckets=7))
    assert got.dtypes == [("name", "string"), ("part", "bigint"), ("event_id", "bigint")]
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[2]) == sorted(want, key=lambda r: r[2])
    assert 0 < max(states) <= 7 and len(until) > 1000


def test_a_bucket_is_forgotten_with_its_last_success(spark):
    path, day = shared_path(spark, "calls"), lambda d, h=0: datetime.datetime(2024, 1, d, h)
    batches = [[("m", 1, day(1), True)], [("k", 2, day(10), True)], [("k", 3, day(20), True)], [("m", 4, day(20, 2), False), ("m", 5, day(20, 3), True), ("m", 6, day(20, 4), True)]]
    schema = "key string, event_id long, ts timestamp, success boolean"
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)
    got, states = _intake(spark, jobs.success_intake(stream, ["key"], 86_400_000))
    assert sorted(r["event_id"] for r in got.collect()) == [1, 2, 3, 4, 5]
    assert max(states) == 2 and 1 in states[states.index(2) :]


def test_a_call_a_moment_before_a_success_runs(spark):
    path, at = shared_path(spark, "calls"), lambda us: datetime.datetime(2024, 1, 1, 0, 0, 0, us)
    spark.createDataFrame([("k", 2, at(100), False), ("k", 1, at(900), True), ("k", 3, at(901), False)], "key string, event_id long, ts timestamp, success boolean").coalesce(1).write.parquet(path)
    ran = jobs.finished(jobs.success_intake(jobs.table_stream(spark, path), ["key"], 86_400_000), ["key", "event_id"], "append")
    assert sorted(r["event_id"] for r in ran.collect()) == [1, 2]


def test_seeds_need_proof_in_current_texts(spark):
    own = spark.createDataFrame([("A", "1", 2), ("A", "2", 3), ("B", "3", None), ("C", "4", 3)], "title string, bbbs string, status_code int")
    texts = spark.createDataFrame([("1", "old word"), ("2", "new fine"), ("3", "a fine of 10"), ("4", None)], "bbbs string, text string")
    seeds = spark.createDataFrame([(1, ["A"], "word"), (2, ["A", "B"], r"fine( of \d+)?$"), (3, ["A", "B", "A"], "10"), (4, ["C", "Z"], "."), (5, ["B"], "(?i)FINE")], "seed_id long, titles array<string>, keyword string")
    got = lambda n: {r["seed_id"]: r["sources"] for r in versions.proven_seeds(seeds, own, texts, n).collect()}
    assert got(1) == {2: ["2", "3"], 3: ["3"], 5: ["3"]} and got(2) == {2: ["2", "3"]}


def test_shared_runs_equal_brute_force(spark):
    rng = random.Random(4)
    answers = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(40)))) for i in range(40)] + [(99, None)]
    chunks = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(30)))) for i in range(25)] + [(77, None)]
    want = {a: [c for c, held in chunks if held and any(held[i : i + 12] in (said or "") for i in range(len(held) - 11))] for a, said in answers}
    a, c = spark.createDataFrame(answers, "answer_id long, answer string"), spark.createDataFrame(chunks, "chunk_id long, chunk string")
    assert {r["answer_id"]: r["chunk_ids"] for r in grounding.shared_runs(a, c).collect()} == {k: v for k, v in want.items() if v}
    rows = {r["answer_id"]: (r["chunks"], r["hits"], r["ratio"]) for r in grounding.overlap_with_all(a, c).collect()}
    assert rows == {k: (25, len(want[k]), 1.0 if len(said or "") < 8 else round(min(1.0, len(want[k]) / 3), 6)) for k, said in answers}


def test_runs_of_a_long_text_are_cut_in_linear_time(spark):
    rng = random.Random(8)
    text = "".join(rng.choice("abcé漢\U0001f600") for _ in range(400_000))
    a = spark.createDataFrame([(1, text)], "answer_id long, answer string")
    c = spark.createDataFrame([(5, text[-12:]), (6, text[300_000:300_011] + "\n")], "chunk_id long, chunk string")
    began = time.time()
    assert [tuple(r) for r in grounding.shared_runs(a, c).collect()] == [(1, [5])] and time.time() - began < 30


def test_cut_rules(spark):
    texts = ["x" * 7 + "。" + "y" * 9, "x" * 4 + "。" + "y" * 9, "x" * 5 + "\n" + "y" * 9, "x" * 4 + " " + "y" * 9, "y" * 20, "short", "x" * 6 + "。\n" + "。y" + "z" * 9, None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.boundary_before(F.col("t"), 10).alias("cut"))
    plain = lambda t: next((t.rfind(m, 0, 10) + len(m) for m, p in T.CUT_RULES if t.rfind(m, 0, 10) > 10 * p / 100), 10) if len(t) > 10 else len(t)
    assert [r["cut"] for r in rows.orderBy("i").collect()] == [None if t is None else plain(t) for t in texts]


def test_capability_counts_unknown_apart(spark):
    rows = [("c", "A", "x", True, 3), ("c", "B", "x", False, 2), ("c", "B", "dated", True, 1), ("c", "B", None, None, None)]
    got = evaluation.capability(spark.createDataFrame(rows, "config string, category string, difficulty string, passed boolean, top_status int"), "A", ["dated"]).first()
    assert tuple(got) == ("c", 4, 0.6667, 0.5, 1, 3, 1, 0.3333)


def test_progress_tells_what_is_left(spark):
    rows = [("a", 0, 100, 10.0), ("a", 1, 100, 5.0), ("b", 0, 5, 0.0)]
    progress = spark.createDataFrame(rows, "name string, batch long, n_rows long, seconds double")
    totals = spark.createDataFrame([("a", 400), ("b", 5), ("c", 7)], "name string, total long")
    got = {r["name"]: tuple(r)[1:] for r in jobs.with_eta(progress, totals).collect()}
    assert got == {"a": (400, 200, 50.0, 15.0, 13.3), "b": (5, 5, 100.0, 5000.0, 0.0), "c": (7, 0, 0.0, None, None)}
