from __future__ import annotations

import base64
import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from llm.conftest import ODD
from tokenizers import Tokenizer

from palimspark.llm import byte_bpe, packing, token_orc, word_bpe
from palimspark.llm.queries import BYTE_RANKS, WORD_BPE
from palimspark.llm.shared import shared_path

TEXTS = [*ODD, "It's 12 o'clock, we'LL see: naïve Ångström ΑΣ ² ½ 漢字 ", "a\x00b\x1fc\x85d\xa0e", "é ﬁ İstanbul", "<|endoftext|> x", "a<|startoftext|>b <|ENDOFTEXT|> c<|endoftext|>", "ab\U0001fae9cd 1\u0378 \U0001c000x", "###$$$ the*** 'sss", "🙂🙃" * 20, "z" * 3000]


@pytest.fixture(scope="module")
def library_ids():
    tokenizer = Tokenizer.from_file(WORD_BPE)
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in TEXTS]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_orc_round_trip(spark, make_docs, library_ids):
    docs = make_docs(list(reversed(list(enumerate(TEXTS)))), clash=True)
    path = shared_path(spark, "t")
    token_orc.write_tokens(docs, path, WORD_BPE, partitions=3)
    got = sorted(map(tuple, token_orc.token_digests(token_orc.read_tokens(spark, path)).collect()))
    want, start = [], 0
    for i, ids in enumerate(library_ids):
        want.append((i, start, len(ids) + 1, crc([*ids, 1])))
        start += len(ids) + 1
    assert got == want
    assert token_orc.lookup_tokens(spark, path, [3]).collect()[0]["tokens"] == [*library_ids[3], 1]


def test_orc_edge_cases(spark, make_docs):
    for texts, n in (([], 0), ([(None, "b"), (2, "a"), (2, "a"), (2, "c")], 4)):
        path = shared_path(spark, "t")
        token_orc.write_tokens(make_docs(texts), path, WORD_BPE)
        rows = token_orc.token_digests(token_orc.read_tokens(spark, path)).collect()
        assert len(rows) == n
        assert sorted(r["start"] for r in rows) == list(range(0, 2 * n, 2))


def test_packing(spark, make_docs, library_ids):
    path = shared_path(spark, "t")
    packing.write_sequences(make_docs(TEXTS, clash=True), path, WORD_BPE)
    rows = packing.sequence_digests(packing.read_sequences(spark, path)).collect()
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))
    for i, ids in enumerate(library_ids):
        own, at, full = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"]), 0, [*ids, 2]
        for r in own:
            n = r["length"]
            assert r["start"] == at and r["offset"] == 0 and n & n - 1 == 0 and n <= 4096 and r["doc_tokens"] == len(full)
            assert r["ids_crc32"] == crc(full[at : at + n])
            at += n
        assert at == len(full)
    empty = shared_path(spark, "t")
    packing.write_sequences(make_docs([]), empty, WORD_BPE)
    assert packing.sequence_digests(packing.read_sequences(spark, empty)).collect() == []


def test_pieces():
    owners, starts, lengths = packing.pieces(np.array([10_001, 0, 4096, 3]))
    assert lengths.tolist() == [4096, 4096, 1024, 512, 256, 16, 1, 4096, 2, 1]
    assert owners.tolist() == [0] * 7 + [2, 3, 3] and starts.tolist() == [0, 4096, 8192, 9216, 9728, 9984, 10_000, 0, 0, 2]
    assert [len(x) for x in packing.pieces(np.zeros(0, dtype=np.int64))] == [0, 0, 0]


def test_packing_of_repeated_and_nameless_rows(spark, make_docs):
    path = shared_path(spark, "t")
    packing.write_sequences(make_docs([(1, "a b c"), (1, "a b c"), (None, None), (None, "x"), (1, "")]), path, WORD_BPE)
    rows = packing.sequence_digests(packing.read_sequences(spark, path)).collect()
    assert sorted((str(r["doc_id"]), r["start"], r["length"]) for r in rows) == [("1", 0, 1), ("1", 0, 4), ("1", 0, 4), ("None", 0, 1), ("None", 0, 2)]
    assert sorted(r["sequence_id"] for r in rows) == list(range(5))


def test_word_ids_equal_the_library_on_any_characters():
    rng, tokenizer, own = random.Random(7), Tokenizer.from_file(WORD_BPE), word_bpe.encoder(WORD_BPE)
    pools = [lambda: chr(rng.randrange(0x20, 0x250)), lambda: chr(rng.choice([rng.randrange(0x250, 0xD800), rng.randrange(0xE000, 0x30000)])), lambda: rng.choice(" ab1'_.\n<|>"), lambda: "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rng.choices(pools, (6, 2, 4, 0.2))[0]() for _ in range(rng.randrange(1, 30)))
        assert np.frombuffer(own.encode([text], 1)[0], dtype="<u4").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1], ascii(text)


def test_word_ids_do_not_depend_on_memory():
    rng, small = random.Random(3), word_bpe.WordEncoder(WORD_BPE, memo_entries=5)
    texts = [" ".join(rng.choices(["it's", "don't,", "x_1", "a" * 100, "###", "12b", "word", "naïve"], k=9)) for _ in range(50)]
    assert small.encode(texts, 1) == word_bpe.encoder(WORD_BPE).encode(texts, 1)


def test_codecs_of_two_patterns_stay_apart(spark, make_docs):
    docs = make_docs(["ab ab ab"] * 3).coalesce(1)
    sizes = [byte_bpe.codec_digests(byte_bpe.encode_documents(docs, BYTE_RANKS, p)).first()["n_tokens"] for p in (public_tokenizers.PATTERN, "(?s).")]
    assert sizes[0] < sizes[1] == 8


def test_orc_files_hold_row_index_and_bloom_filter(spark, make_docs):
    path = shared_path(spark, "t")
    token_orc.write_tokens(make_docs([f"some words {i}" for i in range(5000)]), path, WORD_BPE, partitions=2)
    files = sorted(Path(path.removeprefix("file://")).glob("*.orc"))
    assert len(files) == 2
    found = token_orc.lookup_tokens(spark, path, [17, 4000])
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().toString() and found.count() == 2
    streams = spark._jvm.org.apache.orc.OrcFile
    reader = streams.createReader(spark._jvm.org.apache.hadoop.fs.Path(f"file://{files[0]}"), streams.readerOptions(spark._jsc.hadoopConfiguration()))
    kinds = {str(s.getKind()) for s in reader.rows().readStripeFooter(reader.getStripes()[0]).getStreamsList()}
    assert "ROW_INDEX" in kinds and any(k.startswith("BLOOM_FILTER") for k in kinds)


def test_byte_bpe(spark, make_docs):
    with open(BYTE_RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = byte_bpe.encode_documents(make_docs(TEXTS, clash=True), BYTE_RANKS, public_tokenizers.PATTERN)
    got = {r["doc_id"]: r for r in byte_bpe.codec_digests(encoded).collect()}
    for i, text in enumerate(TEXTS):
        ids = library.encode_ordinary(text or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert byte_bpe.encode_documents(make_docs([]), BYTE_RANKS, public_tokenizers.PATTERN).collect() == []


def test_perfect_hash_is_minimal_and_perfect():
    keys = [f"key{i}".encode() for i in range(5000)]
    index = byte_bpe.PerfectHash(keys)
    assert sorted(index.slots) == list(range(5000))
    assert [index.candidate(k) for k in keys] == list(range(5000))


def test_files_sort_by_number_beyond_five_digits(spark):
    names = [f"part-{i:05d}-abc.c000.zstd.orc" for i in (99_999, 100_000, 7, 100_001, 12)]
    rows = spark.createDataFrame([(n,) for n in names], "name string").select(token_orc.ordered_name(token_orc.F.col("name")).alias("o"))
    assert [r["o"].split("-")[2] for r in rows.orderBy("o").collect()] == ["00007", "00012", "99999", "100000", "100001"]
