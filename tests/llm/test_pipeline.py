from __future__ import annotations

import random
import shutil
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
import pytest
from llm.test_dedup import edited
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palimspark.llm.queries import WORD_BPE

ROOT = Path(corpus_pipeline.__file__).resolve().parent


def test_stages_take_effect(spark, make_docs, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    clean = [" ".join(word() for _ in range(60)) for _ in range(20)]
    shared = " ".join(word() for _ in range(55))
    texts = [
        *clean,
        clean[0],  # an exact copy: all its lines occur earlier
        " ".join(edited(clean[1].split(), rng, 0.0)[:-1]),  # a near copy, more than one edit away as a line
        f"{clean[2][:30]} first\n{shared}", f"{clean[3][:30]} second\n{shared}",  # a passage that repeats
        "my password = Xy7kQ92LmZpT4 stays here with other words",
    ]
    docs = make_docs(texts)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    after, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, after, str(tmp_path))
        assert after.columns == docs.columns
        kept[name] = {r["doc_id"]: r["text"] for r in after.collect()}
    assert set(kept["toxicity"]) == set(range(25))
    assert set(kept["line_dedup"]) == set(range(25)) - {20} and shared not in kept["line_dedup"][23] and shared in kept["line_dedup"][22]
    assert set(kept["minhash_dedup"]) == set(kept["line_dedup"]) - {21}
    assert "Xy7kQ92LmZpT4" not in kept["secret_scan"][24] and all(kept["secret_scan"][i] == clean[i] for i in range(20))
    tokenizer = Tokenizer.from_file(WORD_BPE)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("doc_tokens")).collect()
    want = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in kept["secret_scan"].items()}
    assert {r["doc_id"]: r["n"] for r in pieces} == want == {r["doc_id"]: r["doc_tokens"] for r in pieces}


def test_empty_tables(spark, make_docs, tmp_path):
    make_docs([]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("gone", [True, False])
def test_the_rest_stands_without_these_operators(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *(["corpus_pipeline.py"] if gone else [])))
    code = "import __spark_entry__ as e; names = e.queries(); assert 'pipeline' not in names and not any(n.startswith('op') for n in names) and len(names) > 100; assert set(e.oracle_sql()) <= set(names)"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert done.returncode == 0, done.stderr
