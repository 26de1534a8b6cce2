"""Periodic runs of words, found on a Re-Pair grammar of each text.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), at least LEAST_WORDS and 2q
long, that no neighbouring word extends with period q. Per text:

1. Words become numbers. Every word of a run lies in a window of SEED words that occurs again in the text: two windows
   q apart, for a run of length m has m - q >= SEED equal pairs in a row, and these cover it from both ends. So runs lie in
   the stretches that repeated windows cover, and a text without them has no run. This loses nothing; equal hashes of
   different windows only lengthen a stretch.
2. Re-Pair replaces the most frequent pair of neighbours by a new symbol until no pair occurs twice; what is left is
   joined by balanced pairs. Each nonterminal X = YZ spells a string and has a boundary in it.
3. For each nonterminal once, the runs that cross its boundary: for a period q either the words q before and at the boundary
   agree, or the last word before it and the one q behind do, so both are tried for all q at once, and the agreement is extended
   both ways inside X by the longest common extension (names of words' blocks of length 1, 2, 4 and so on, equal exactly
   where the blocks are).
4. The intervals are translated to all places where X is derived. A run is found whole at the lowest nonterminal that
   contains it; what X cut off is part of such a one. So intervals of one period that overlap by q words or more are
   merged, and of equal intervals the smallest period stays.

Texts are independent: one narrow pass, a slice of texts at a time, no shuffle. A task's memory is bounded by its largest
text (about 100 bytes for each word of its repeated stretches and block length).

Defined results: null and empty texts and texts without words have no runs and collapse to an empty text; a null doc_id is
passed on (and isn't rearranged); texts of any length are read whole; repeated rows give repeated rows; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import slices

LEAST_WORDS = 12
#: Equal pairs in a row that a run of LEAST_WORDS words and exponent 2 has at least.
SEED = LEAST_WORDS // 2
#: Fixed value: white space between words.
SPACES = r"[\x20\x09-\x0D]+"

Rearrange = Callable[[int | None, int], np.ndarray | None]
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def re_pair(symbols: list[int], free: int) -> tuple[list[int], list[tuple[int, int]]]:
    """The start sequence, in which no pair occurs twice without overlap, and the pairs behind symbols ``free``, ``free + 1``, ..."""
    rules: list[tuple[int, int]] = []
    while True:  # a second turn finds pairs of one symbol that overlapped others in the first
        symbols, more = _replaced(symbols, free + len(rules))
        if not more:
            return symbols, rules
        rules += more


def _replaced(symbols: list[int], free: int) -> tuple[list[int], list[tuple[int, int]]]:
    """Re-Pair with linked positions and a heap of counts: the most frequent pair first, the oldest among equals."""
    after, before = [*range(1, len(symbols)), -1], [*range(-1, len(symbols) - 1)]
    at = list(symbols)
    places: dict[tuple[int, int], set[int]] = defaultdict(set)

    def add(i: int, changed: set | None) -> None:
        j = after[i]
        if j < 0:
            return
        pair = at[i], at[j]
        h = before[i]
        if pair[0] == pair[1] and h >= 0 and at[h] == at[i] and h in places.get(pair, ()):
            return  # overlaps the occurrence before
        places[pair].add(i)
        if changed is not None:
            changed.add(pair)

    def remove(i: int) -> None:
        j = after[i]
        if j >= 0 and (found := places.get((at[i], at[j]))):
            found.discard(i)

    for i in range(len(at)):
        add(i, None)
    order: dict[tuple[int, int], int] = {}
    heap = []
    for pair, found in places.items():
        if len(found) > 1:
            order[pair] = len(order)
            heap.append((-len(found), order[pair], pair))
    heapify(heap)
    rules: list[tuple[int, int]] = []
    while heap:
        n, rank, pair = heappop(heap)
        found = places.get(pair)
        count = len(found) if found else 0
        if count < 2:
            continue
        if count != -n:
            heappush(heap, (-count, rank, pair))
            continue
        symbol, changed = free + len(rules), set()
        rules.append(pair)
        del places[pair]
        for i in sorted(found):
            j = after[i]
            if j < 0 or at[i] != pair[0] or at[j] != pair[1]:
                continue
            h, k = before[i], after[j]
            if h >= 0:
                remove(h)
            remove(j)
            at[i], at[j], after[i] = symbol, -1, k
            if k >= 0:
                before[k] = i
            if h >= 0:
                add(h, changed)
            add(i, changed)
        for fresh in changed:
            if len(places.get(fresh, ())) > 1:
                heappush(heap, (-len(places[fresh]), order.setdefault(fresh, len(order)), fresh))
    left, i = [], 0
    while i >= 0 and symbols:
        left.append(at[i])
        i = after[i]
    return left, rules


class Grammar:
    """Nonterminals of one word sequence, the balanced ones above its start sequence included, with where each is derived."""

    def __init__(self, words: list[int]) -> None:
        terminals = max(words) + 1
        level, rules = re_pair(words, terminals)
        while len(level) > 1:
            pairs = [(level[i], level[i + 1]) for i in range(0, len(level) - 1, 2)]
            level = [*range(terminals + len(rules), terminals + len(rules) + len(pairs)), *level[len(pairs) * 2 :]]
            rules += pairs
        lengths = [1] * terminals
        for left, right in rules:
            lengths.append(lengths[left] + lengths[right])
        #: Of each nonterminal with room for a run, from the last (the root) down: offsets in the sequence, words of its left part and of all.
        self.nodes: list[tuple[np.ndarray, int, int]] = []
        derived: dict[int, list[np.ndarray]] = defaultdict(list)
        if rules:
            derived[level[0]].append(np.zeros(1, np.int64))
        for k in range(len(rules) - 1, -1, -1):
            symbol = terminals + k
            if lengths[symbol] < LEAST_WORDS or symbol not in derived:
                continue
            offsets, (left, right) = np.concatenate(derived.pop(symbol)), rules[k]
            self.nodes.append((offsets, lengths[left], lengths[symbol]))
            derived[left].append(offsets)
            derived[right].append(offsets + lengths[left])


class Extensions:
    """Longest common extensions of two places of a sequence, by names of its blocks of length 1, 2, 4, ..."""

    def __init__(self, words: np.ndarray, longest: int) -> None:
        self.names, size = [words], 1
        while size * 2 <= longest and len(words) >= size * 2:
            last = self.names[-1].astype(np.int64)
            self.names.append(np.unique(last[:-size] * (last.max() + 1) + last[size:], return_inverse=True)[1].astype(np.int32))
            size *= 2

    def forward(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from ``i`` and from ``j`` > i on agree, at most ``most``."""
        got = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            size, names = 1 << k, self.names[k]
            for _ in range(2 if k == len(self.names) - 1 else 1):
                fits = np.flatnonzero(got + size <= most)
                same = names[i[fits] + got[fits]] == names[j[fits] + got[fits]]
                got[fits[same]] += size
        return got

    def backward(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words before ``i`` and before ``j`` > i agree, at most ``most``."""
        got = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            size, names = 1 << k, self.names[k]
            for _ in range(2 if k == len(self.names) - 1 else 1):
                fits = np.flatnonzero(got + size <= most)
                same = names[i[fits] - got[fits] - size] == names[j[fits] - got[fits] - size]
                got[fits[same]] += size
        return got


def _crossing(words: np.ndarray, grammar: Grammar) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Node, start inside it, length and period of the runs that cross each nonterminal's boundary."""
    first = np.array([offsets[0] for offsets, _, _ in grammar.nodes])
    cut = first + np.array([left for _, left, _ in grammar.nodes])
    end = first + np.array([whole for _, _, whole in grammar.nodes])
    half = (end - first) // 2
    found = [np.zeros((4, 0), np.int64)]
    extensions = Extensions(words, int((end - first).max()))
    for behind in (False, True):
        periods = np.minimum(half, end - cut if behind else cut - first)
        ends = np.cumsum(periods)
        lo = 0
        while lo < len(periods):  # some millions of candidates at a time
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 4_000_000, "right")))
            node = np.repeat(np.arange(lo, hi), periods[lo:hi])
            q = np.arange(len(node)) - np.repeat(ends[lo:hi] - periods[lo:hi] - (ends[lo - 1] if lo else 0), periods[lo:hi]) + 1
            anchor = cut[node] - 1 if behind else cut[node] - q
            near = words[anchor] == words[anchor + q]
            node, q, anchor = node[near], q[near], anchor[near]
            ahead = extensions.forward(anchor, anchor + q, end[node] - anchor - q)
            back = extensions.backward(anchor, anchor + q, anchor - first[node])
            length = ahead + back + q
            whole = length >= np.maximum(LEAST_WORDS, 2 * q)
            found.append(np.stack([node, anchor - back - first[node], length, q])[:, whole])
            lo = hi
    return tuple(np.concatenate(found, axis=1))


def runs_of(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of word numbers, by start, then period."""
    if len(words) < LEAST_WORDS:
        return []
    grammar = Grammar(words.tolist())
    node, start, length, q = _crossing(words, grammar)
    if not len(node):
        return []
    seen = np.unique(np.stack([q, node, start, length], axis=1), axis=0)
    times = np.array([len(grammar.nodes[k][0]) for k in seen[:, 1].tolist()])
    offsets = np.concatenate([grammar.nodes[k][0] for k in seen[:, 1].tolist()])
    rows = np.repeat(seen, times, axis=0)
    placed = np.unique(np.stack([rows[:, 0], rows[:, 2] + offsets, rows[:, 2] + offsets + rows[:, 3]], axis=1), axis=0)
    merged: dict[tuple[int, int], int] = {}
    period, begin, stop = placed[0].tolist()
    for q1, a, b in [*placed[1:].tolist(), (0, 0, 0)]:
        if q1 == period and a <= stop - period:
            stop = max(stop, b)
        else:
            merged.setdefault((begin, stop), period)  # periods ascend, so the smallest one comes first
            period, begin, stop = q1, a, b
    return sorted((a, b - a, p) for (a, b), p in merged.items())


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0xD1B54A32D192ED03) + (a >> np.uint64(31)))
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def stretches(words: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal intervals of the texts that end at ``ends`` whose words lie in windows of SEED words that occur again in their text."""
    n = len(words)
    if n < SEED:
        return []
    text = np.searchsorted(ends, np.arange(n), "right").astype(np.uint64)
    hashed = _mixed(words.astype(np.uint64), text)[: n - SEED + 1]
    for k in range(1, SEED):
        hashed = _mixed(hashed, words[k : n - SEED + 1 + k].astype(np.uint64))
    inside = text[: n - SEED + 1] == text[SEED - 1 :]
    order = np.argsort(hashed, kind="stable")
    same = hashed[order[1:]] == hashed[order[:-1]]
    again = np.zeros(len(hashed), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    at = np.flatnonzero(again & inside)
    if not len(at):
        return []
    # a stretch ends where the next window starts behind it, or in another text
    breaks = np.flatnonzero((at[1:] > at[:-1] + SEED) | (text[at[1:]] != text[at[:-1]]))
    return [*zip(at[np.concatenate([[0], breaks + 1])].tolist(), (at[np.concatenate([breaks, [len(at) - 1]])] + SEED).tolist(), strict=True)]


def collapsed(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay when every run keeps its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def _results(part: pa.RecordBatch, rearranged: Rearrange | None) -> pa.RecordBatch:
    import pyarrow.compute as pc

    ids = part.column("doc_id")
    cut = pc.split_pattern_regex(pc.fill_null(part.column("text"), ""), SPACES)
    flat = cut.flatten().dictionary_encode()
    spelled, numbers = flat.dictionary, flat.indices.to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(ids)), np.diff(cut.offsets.to_numpy()))
    filled = (pc.binary_length(spelled).to_numpy(zero_copy_only=False) > 0)[numbers] if len(numbers) else np.zeros(0, bool)
    numbers, owner = numbers[filled], owner[filled]
    sizes = np.bincount(owner, minlength=len(ids))
    ends = np.cumsum(sizes)
    if rearranged is not None:
        for i, (doc, n) in enumerate(zip(ids.to_pylist(), sizes.tolist(), strict=True)):
            if (index := rearranged(doc, n)) is not None:
                numbers[ends[i] - n : ends[i]] = numbers[ends[i] - n : ends[i]][index]
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(len(ids))]
    keep = np.ones(len(numbers), bool)
    for a, b in stretches(numbers, ends):
        if b - a < LEAST_WORDS:
            continue
        i = int(np.searchsorted(ends, a, "right"))
        own = np.unique(numbers[a:b], return_inverse=True)[1].astype(np.int32)
        found = runs_of(own)
        if found:
            keep[a:b] = collapsed(b - a, found)
            base = a - int(ends[i] - sizes[i])
            runs[i] += [(base + s, m, q) for s, m, q in found]
    kept = pa.array(numbers[keep])
    offsets = np.concatenate([[0], np.cumsum(np.bincount(np.repeat(np.arange(len(ids)), sizes)[keep], minlength=len(ids)))])
    lists = pa.LargeListArray.from_arrays(pa.array(offsets.astype(np.int64)), spelled.take(kept).cast(pa.large_string()))
    joined = pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())
    spans = pa.array([[{"start": s, "length": m, "period": q} for s, m, q in r] for r in runs], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])))
    return pa.RecordBatch.from_arrays([ids, pa.array(sizes.astype(np.int64)), spans, joined], ["doc_id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, rearranged: Rearrange | None = None, text: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period by start, then period) and collapsed, the text without repeats inside runs.

    ``rearranged`` gives for a doc_id and its number of words the words' order to judge instead, or None to leave the text.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield _results(part, rearranged)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(judge, SCHEMA)


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The order of words that makes every tenth document periodic from some word on."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    index = np.arange(n)
    return np.where(index >= a, a + (index - a) % p, index)


def run_digests(found: DataFrame) -> DataFrame:
    """The number of runs, the longest one, and digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    ended = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    longest = found.withColumn("_best", best)
    return longest.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_best.start")).alias("start"),
        F.col("_best.length").alias("length"),
        (-F.col("_best.period")).alias("period"),
        F.floor(1000 * F.col("_best.length") / -F.col("_best.period")).cast("long").alias("exponent_milli"),
        F.sha2(ended, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
