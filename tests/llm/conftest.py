from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A table of documents from texts (or pairs of id and text), with columns whose names clash with results."""

    def make(texts, clash=False):
        pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(i, t, "en", f"src{n % 3}", len(t or "")) for n, (i, t) in enumerate(pairs)]
        df = spark.createDataFrame(rows, DOCS)
        if clash:
            for name in ("kept", "score", "spans", "node", "key", "component", "n_words", "pos"):
                df = df.withColumn(name, df["doc_id"].cast("string"))
        return df

    return make


LONG = " ".join(f"word{i}" for i in range(20_000))
ODD = [None, "", " \n\t ", "one", LONG, "same text here twice over", "same text here twice over"]
