"""Byte-level BPE by a table of ranks, with a two-tier look-up.

A text is cut by the vocabulary's pattern. Tier one is a minimal perfect hash over the vocabulary: two small
integer arrays give the only slot a pre-token can have, and one comparison tells whether it is there. Tier
two merges the bytes of the other pre-tokens: a linked list of parts and a heap of their neighbouring pairs
by rank. Distinct pre-tokens of a task are resolved once and remembered within a bound.

Defined results: null and empty texts have no ids and decode to no bytes; nothing is read as a special
token; repeated rows give repeated rows; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import slices

#: Distinct pre-tokens that a worker remembers before it starts afresh: about 150 MB.
MEMO_ENTRIES = 700_000
KEYS_PER_BUCKET = 4
_TRIES = 64  # displacements tried at a time
_MASK = (1 << 64) - 1
_ODD = 0x9E3779B97F4A7C15  # the golden ratio in 64 bits, a usual multiplier for hashing


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by id, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class PerfectHash:
    """Minimal perfect hash over distinct byte strings: as many slots as keys, each key in a slot of its own.

    Keys fall into buckets by one hash; large buckets first, each gets the first displacement that sends
    all its keys to free slots. Buckets of one key name a free slot outright (stored as a negative number).
    """

    def __init__(self, keys: list[bytes]) -> None:
        self.n = len(keys)
        self.buckets = max(1, self.n // KEYS_PER_BUCKET)
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
        order = np.argsort(hashes % np.uint64(self.buckets), kind="stable")
        sizes = np.bincount((hashes % np.uint64(self.buckets)).astype(np.int64), minlength=self.buckets)
        starts = np.cumsum(sizes) - sizes
        self.displacement = np.zeros(self.buckets, dtype=np.int64)
        self.slots = np.full(self.n, -1, dtype=np.int64)
        for b in np.argsort(-sizes, kind="stable").tolist():
            members = order[starts[b] : starts[b] + sizes[b]]
            if len(members) < 2:
                break
            first, found = 0, np.zeros(0, dtype=np.int64)
            while not len(found):
                d = np.arange(first, first + _TRIES, dtype=np.uint64)
                places = ((hashes[members] ^ d[:, None] * np.uint64(_ODD)) * np.uint64(_ODD) % np.uint64(self.n)).astype(np.int64)
                ranked = np.sort(places, axis=1)
                found = np.flatnonzero((self.slots[places] < 0).all(axis=1) & (ranked[:, 1:] != ranked[:, :-1]).all(axis=1))
                first += _TRIES
            d, places = int(d[found[0]]), places[found[0]]
            self.displacement[b] = d
            self.slots[places] = members
        free = iter(np.flatnonzero(self.slots < 0).tolist())
        for b in np.flatnonzero(sizes == 1).tolist():
            place = next(free)
            self.displacement[b] = -1 - place
            self.slots[place] = order[starts[b]]
        self.displacement, self.slots = array("q", self.displacement.tolist()), array("q", self.slots.tolist())

    def _place(self, h: int, d: int) -> int:
        return (((h ^ d * _ODD) & _MASK) * _ODD & _MASK) % self.n

    def candidate(self, key: bytes) -> int:
        """Index of the only key that ``key`` can be equal to."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.displacement[h % self.buckets]
        return self.slots[-1 - d if d < 0 else self._place(h, d)]


class ByteBpe:
    """The vocabulary with both tiers; small enough to broadcast (its size is that of the vocabulary)."""

    def __init__(self, tokens: list[bytes], pattern: str, memo_entries: int = MEMO_ENTRIES) -> None:
        self.tokens, self.pattern, self.memo_entries = tokens, pattern, memo_entries
        self.index = PerfectHash(tokens)
        self.byte_ids = [self.rank(bytes([b])) for b in range(256)]
        known = {t: i for i, t in enumerate(tokens)}
        self.pairs: dict[int, int] = {}
        for merged, token in enumerate(tokens):
            for cut in range(1, len(token)):
                left, right = known.get(token[:cut]), known.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = merged

    def rank(self, piece: bytes) -> int | None:
        """Tier one: the id of a whole piece, or None."""
        at = self.index.candidate(piece)
        return at if self.tokens[at] == piece else None

    def merge(self, piece: bytes) -> list[int]:
        """Tier two: lowest rank first, leftmost among equals, until no neighbouring pair is in the vocabulary."""
        ids = [*map(self.byte_ids.__getitem__, piece)]
        n, rank = len(ids), self.pairs.get
        ranks = [rank(a << 32 | b, -1) for a, b in zip(ids, ids[1:], strict=False)]  # of the pair that starts at each part
        ranks.append(-1)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [r << 40 | i for i, r in enumerate(ranks) if r >= 0]
        heapify(heap)
        while heap:
            top = heappop(heap)
            i = top & 0xFFFFFFFFFF
            r = top >> 40
            if ranks[i] != r:
                continue  # one of the two has been merged since
            j = after[i]
            k = after[i] = after[j]
            ids[i], ids[j], ranks[j] = r, -1, -1
            if k < n:
                before[k] = i
                s = ranks[i] = rank(r << 32 | ids[k], -1)
                if s >= 0:
                    heappush(heap, s << 40 | i)
            else:
                ranks[i] = -1
            h = before[i]
            if h >= 0:
                s = ranks[h] = rank(ids[h] << 32 | r, -1)
                if s >= 0:
                    heappush(heap, s << 40 | h)
        return [i for i in ids if i >= 0]


class _Memo(dict):
    """Ids of a pre-token as bytes, found at its first use."""

    def __init__(self, bpe: ByteBpe) -> None:
        self._bpe = bpe

    def __missing__(self, pre_token: str) -> bytes:
        piece = pre_token.encode()
        whole = self._bpe.rank(piece)
        got = self[pre_token] = array("I", self._bpe.merge(piece) if whole is None else (whole,)).tobytes()
        return got


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, bpe: ByteBpe) -> None:
        import regex

        self._cut, self._memo, self._bpe = regex.compile(bpe.pattern).findall, _Memo(bpe), bpe

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if len(self._memo) > self._bpe.memo_entries:
            self._memo.clear()
        return b"".join(map(self._memo.__getitem__, self._cut(text))) if text else b""

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self._bpe.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_codecs: dict[tuple, Codec] = {}


def codec(bpe: ByteBpe, path: str) -> Codec:
    """This worker's codec for a vocabulary file, pattern and bound, kept from task to task."""
    key = path, bpe.pattern, bpe.memo_entries
    if key not in _codecs:
        _codecs[key] = Codec(bpe)
    return _codecs[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and ``tokens`` (ids as little-endian unsigned 32-bit integers) of every text, and ``decoded``, their bytes.

    Narrow: one pass over the input without a shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ByteBpe(read_ranks(ranks_path), pattern))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, ranks_path)
        for batch in batches:
            for part in slices(batch, "text"):
                tokens = [own.encode(t) for t in part.column("text").to_pylist()]
                columns = [part.column("doc_id"), pa.array(tokens, pa.binary()), pa.array(map(own.decode, tokens), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tokens", "decoded"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(encode, "doc_id long, tokens binary, decoded binary")


def codec_digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what ``encode_documents`` gives."""
    return encoded.select(
        "doc_id",
        (F.octet_length("tokens") / 4).cast("long").alias("n_tokens"),
        F.sha2("tokens", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
