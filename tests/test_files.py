from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import functions as F

from palimspark.functions import registered
from palimspark.sources import files
from palimspark.streaming import jobs


def test_front_matter_keeps_strings_and_reads_one_number(spark):
    rows = [("---\nversion: \"0012345678\"\nstatus_code: 3\na: b: c\n---\nbody\n",), ("---\nstatus_code: null\n---\nx",), ("---\nstatus_code:\n---\nx",), ("---\nstatus_code: -1\n---\nx",), ("---\nversion: 1\nno fence",), ("plain",)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select(files.front_matter(F.col("t")).alias("m"), files.body(F.col("t")).alias("b")).withColumn("s", files.status_of(F.col("m"))).collect()
    assert got[0]["m"] == {"version": "0012345678", "status_code": "3", "a": "b: c"} and got[0]["b"] == "body\n"
    assert [r["s"] for r in got] == [3, None, None, -1, None, None]
    assert got[4]["m"] == {} and got[4]["b"] == rows[4][0]


def test_markdown_scan(spark, tmp_path):
    (tmp_path / "docs" / "law").mkdir(parents=True)
    (tmp_path / "docs" / "law" / "a.md").write_text("one\ntwo")
    (tmp_path / "docs" / "law" / "b.txt").write_text("no")
    rows = files.read_markdown(spark, str(tmp_path / "docs")).collect()
    assert [(r["text"], r["file_name"], r["source_path"], r["doc_group"]) for r in rows] == [("one\ntwo", "a.md", "law/a.md", "law")]


def test_docx_paragraphs(spark, tmp_path):
    ns = files.WORD[1:-1]
    xml = f'<w:document xmlns:w="{ns}"><w:body><w:p><w:r><w:t>第一</w:t></w:r><w:r><w:t>条</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "x.docx", "w") as archive:
        archive.writestr("word/document.xml", xml)
    assert [(r["pos"], r["paragraph"]) for r in files.read_docx(spark, str(tmp_path)).orderBy("pos").collect()] == [(0, "第一条"), (1, "two")]


def test_json_lines(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a": 1}\nbroken\n')
    kept = files.read_json_lines(spark, str(path), "a int", strict=False).collect()
    assert [(r["a"], r["_corrupt_record"]) for r in kept] == [(1, None), (None, "broken")]
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        files.read_json_lines(spark, str(path), "a int").collect()


def test_frozen_sets_are_never_replaced(spark, tmp_path):
    items = spark.createDataFrame([(1, "q"), (2, "r")], "id int, question string")
    manifest = files.freeze(items, str(tmp_path / "set"), "id", "7").collect()[0]
    assert manifest["n"] == 2 and manifest["seed"] == "7"
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        files.freeze(items, str(tmp_path / "set"), "id", "7")


def test_encoder_is_called_once_per_text(spark):
    docs = spark.createDataFrame([("a b",), ("a b",), ("c",)], "text string")
    first = registered.incremental(docs.limit(2), None, "text", registered.hashing_encoder, 64)
    assert first.count() == 1
    both = registered.incremental(docs, first, "text", registered.hashing_encoder, 64)
    assert both.count() == 2 and all(len(r["embedding"]) == 64 for r in both.collect())
    with pytest.raises(Exception, match="the encoder gives"):
        registered.encoded(docs, "text", registered.hashing_encoder, 32).collect()


def test_registry(spark):
    tools = registered.Registry(spark)
    tools.register("doubled_value", lambda s: s * 2, "long", "medium")
    assert spark.sql("SELECT doubled_value(id) AS d FROM range(3)").agg(F.sum("d")).first()[0] == 6
    assert [t.name for t in tools.listed("medium")] == ["doubled_value"] and tools.listed("low") == []
    with pytest.raises(ValueError, match="already"):
        tools.register("doubled_value", lambda s: s, "long")
    with pytest.raises(KeyError):
        tools.get("missing")


def test_materialise_in_batches(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    encode = lambda rows: registered.encoded(rows, "text", registered.hashing_encoder, 64)
    batch = lambda texts: spark.createDataFrame([(t,) for t in texts], "text string").withColumn("key", F.md5("text"))
    jobs.materialise(batch(["a", "a", "b"]), store, encode)
    jobs.materialise(batch(["b", "c"]), store, encode)
    assert sorted(r["text"] for r in spark.read.parquet(store).collect()) == ["a", "b", "c"]
