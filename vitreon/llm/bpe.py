"""Byte-level BPE encoding and decoding by replaying merges over the distinct words of a corpus slice.

Each slice of documents is split into words by the tokenizer's pattern. Words not met before by this worker are
encoded together: an inverted index leads from the rank of a mergeable pair to the positions where it stands, a
heap hands out ranks in ascending order, and each merge touches only its two neighbours. The documents are then
spelled from the encoded words. Nothing is shuffled, and the word cache is emptied when it exceeds a byte bound,
so memory doesn't grow with the corpus; a lost executor only repeats its own slices.

A merge may create a pair of lower rank in the same word. That word's other occurrences of the current rank then
wait until the lower one is applied, so every word sees exactly the sequence of merges that lowest-rank-first,
leftmost-first encoding of that word alone would see.
"""

from __future__ import annotations

import base64
import hashlib
from collections import defaultdict
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spans, texts, tidy

#: Distinct words that a worker keeps encoded; beyond it the vocabulary of words starts anew.
WORDS_KEPT = 200_000
#: Bytes of text whose new words are encoded together.
SLICE = 4 << 20
#: Words of one text that are looked up at once, so that a very long text needs no list of all its words.
WORDS_AT_ONCE = 500_000
#: Positions of one rank below which plain Python beats array operations.
FEW = 12
NONE = np.int32(1 << 30)


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The concatenation of arange(first[i], first[i] + size[i])."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + size, size)


class Codec:
    """Ranks of byte strings (ids are ranks) and the pattern that cuts text into words."""

    def __init__(self, ranks: bytes, pattern: str, words_kept: int = WORDS_KEPT):
        import regex

        lines = [line.split() for line in ranks.splitlines() if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in lines}
        self.bytes = {v: k for k, v in self.ranks.items()}
        if any(bytes([i]) not in self.ranks for i in range(256)):
            raise ValueError("the ranks lack a single byte")
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = {}
        for token, r in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 24 | b] = r
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        if not len(self.keys):
            self.keys, self.made = np.array([-1], np.int64), np.array([NONE], np.int32)
        self.find = regex.compile(pattern).finditer
        self.findall = regex.compile(pattern).findall
        self.words_kept = words_kept
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = defaultdict(count().__next__)
        self.known = 0
        self.first = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 24 | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.made[at], NONE)

    def learn(self) -> None:
        """Encode the words numbered since the last time, replaying the merges over all of them at once."""
        words = list(islice(self.number, self.known, None))
        if not words:
            return
        raw = [w.encode("utf-8", "replace") for w in words]
        size = np.array([len(r) for r in raw], np.int64)
        ids, n = self.replay(np.frombuffer(b"".join(raw), np.uint8), size)
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(n) - n])
        self.size = np.concatenate([self.size, n])
        self.ids = np.concatenate([self.ids, ids])
        self.known += len(words)

    def replay(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the words that lie in data one after another, and each word's number of them."""
        m = len(data)
        word = np.repeat(np.arange(len(size), dtype=np.int32), size)
        sym = self.single[data]
        nxt, prv = np.arange(1, m + 1, dtype=np.int32), np.arange(-1, m - 1, dtype=np.int32)
        ends = np.cumsum(size)[size > 0]
        nxt[ends - 1] = -1
        prv[np.concatenate([np.zeros(1, np.int64), ends[:-1]])[: len(ends)]] = -1
        at = np.full(m, NONE, np.int32)  # rank of the pair that starts here
        inner = np.flatnonzero(nxt >= 0)
        at[inner] = self.pair_ranks(sym[inner], sym[inner + 1])
        # The index: positions by rank, first those of the plain bytes, then what merges add
        start = np.flatnonzero(at < NONE)
        start = start[np.argsort(at[start], kind="stable")]
        have, where = np.unique(at[start], return_index=True)
        index: dict[int, list[np.ndarray]] = {r: [x] for r, x in zip(have.tolist(), np.split(start, where[1:]), strict=True)} if len(have) else {}
        heap = have.tolist()  # sorted, hence a heap
        pairs = self.pairs

        def note(p: int, r: int) -> None:
            if r in index:
                index[r].append(np.array([p]))
            else:
                index[r] = [np.array([p])]
                heappush(heap, r)

        def one_by_one(r: int, some: list[int]) -> None:
            """Merge r at these positions from left to right; a word that gains a pair of r or lower waits."""
            waiting: set[int] = set()
            for p in some:
                if at[p] != r:
                    continue
                w = int(word[p])
                if w in waiting:
                    note(p, r)
                    continue
                q = int(nxt[p])
                after, before = int(nxt[q]), int(prv[p])
                sym[p], nxt[p], at[q] = r, after, NONE
                new = NONE
                if after >= 0:
                    prv[after] = p
                    new = pairs.get(r << 24 | int(sym[after]), NONE)
                at[p] = new
                if new != NONE:
                    note(p, int(new))
                    if new <= r:
                        waiting.add(w)
                if before >= 0:
                    new = pairs.get(int(sym[before]) << 24 | r, NONE)
                    at[before] = new
                    if new != NONE:
                        note(before, int(new))
                        if new <= r:
                            waiting.add(w)

        while heap:
            r = heappop(heap)
            found = index.pop(r)
            p = found[0] if len(found) == 1 else np.concatenate(found)
            p = p[at[p] == r]
            if len(found) > 1:
                p = np.unique(p)
            if len(p) <= FEW:
                one_by_one(r, p.tolist())
                continue
            w = word[p]
            alone = np.ones(len(p), bool)
            same = w[1:] == w[:-1]
            alone[1:] &= ~same
            alone[:-1] &= ~same
            if not alone.all():
                one_by_one(r, p[~alone].tolist())
                p = p[alone]
            q = nxt[p]
            after, before = nxt[q], prv[p]
            sym[p], nxt[p], at[q], at[p] = r, after, NONE, NONE
            a, b = after >= 0, before >= 0
            pa_, after, pb, before = p[a], after[a], p[b], before[b]
            prv[after] = pa_
            spot = np.concatenate([pa_, before])
            rank = self.pair_ranks(np.concatenate([sym[pa_], sym[before]]), np.concatenate([sym[after], sym[pb]]))
            at[spot] = rank
            live = rank < NONE
            spot, rank = spot[live], rank[live]
            if len(spot):
                order = np.argsort(rank, kind="stable")
                spot, rank = spot[order], rank[order]
                cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
                lo = 0
                for hi, x in zip([*cuts.tolist(), len(spot)], rank[np.concatenate([cuts - 1, [len(rank) - 1]])].tolist(), strict=True):
                    if x in index:
                        index[x].append(spot[lo:hi])
                    else:
                        index[x] = [spot[lo:hi]]
                        heappush(heap, x)
                    lo = hi
        alive = np.ones(m, bool)
        inner = nxt[nxt >= 0]
        # a position lives if it begins a word or another living one leads to it
        alive[:] = False
        alive[np.concatenate([np.zeros(1, np.int64), ends[:-1]])[: len(ends)]] = True
        lead = np.flatnonzero(nxt >= 0)
        alive[nxt[lead[prv[nxt[lead]] == lead]]] = True
        return sym[alive], np.bincount(word[alive], minlength=len(size))

    def words(self, text: str) -> np.ndarray:
        """The numbers of a text's words."""
        get = self.number.__getitem__
        if len(text) < 1_000_000:
            found = self.findall(text)
            return np.fromiter(map(get, found), np.int32, len(found))
        return np.fromiter((get(m[0]) for m in self.find(text)), np.int32)

    def spell(self, words: np.ndarray) -> np.ndarray:
        return self.ids[ranges(self.first[words], self.size[words])]

    def encode_batch(self, batch: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        if len(self.number) > self.words_kept:
            self.forget()
        numbers = [self.words(t) for t in batch]
        self.learn()
        for x in numbers:
            if len(x) <= WORDS_AT_ONCE:
                yield self.spell(x)
            else:
                yield np.concatenate([self.spell(x[i : i + WORDS_AT_ONCE]) for i in range(0, len(x), WORDS_AT_ONCE)])

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_batch([text]))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


_codecs: dict[tuple, Codec] = {}


def _codec(ranks, pattern: str) -> Codec:
    key = (hash(ranks.value), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(ranks.value, pattern)
    return _codecs[key]


def encode(docs: DataFrame, ranks: bytes, pattern: str, digests: bool = False, decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens and ids array<int>; with decoded also the SHA-256 of the bytes they decode to; with digests instead of ids their SHA-256 (as little-endian unsigned
    32-bit integers) and that of the bytes they decode to.

    ranks: content of a rank file (a line per token: base64 of its bytes, its id). It has the vocabulary's size,
    whatever the corpus, and is broadcast. A null or empty text has no tokens and decodes to the empty string;
    rows pass one by one, repeated or not, a null doc_id included; other columns are ignored; an empty table gives
    an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, pattern)
        codec.forget()  # words of an earlier partition: their memory is worth more than their encoding
        for b in batches:
            off = texts(b)[1]
            for start, stop in spans(off, SLICE):
                made = codec.encode_batch([(t.as_py() or b"").decode("utf-8", "replace") for t in b.column(1).slice(start, stop - start)])
                who = b.column(0).slice(start, stop - start)
                if digests:
                    rows = [(len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()) for ids in made]
                    n, x, y = zip(*rows, strict=True)
                    yield pa.record_batch([who, pa.array(n, pa.int64()), pa.array(x, pa.string()), pa.array(y, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                    continue
                ids = list(made)
                n = np.array([len(x) for x in ids], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)))
                cols = {"doc_id": who, "n_tokens": pa.array(n), "ids": lists}
                if decoded:
                    cols["decoded_sha256"] = pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in ids], pa.string())
                yield pa.record_batch(list(cols.values()), list(cols))
        codec.forget()

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>" + ", decoded_sha256 string" * decoded)
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """doc_id and the text (bytes that aren't UTF-8 replaced) of rows of doc_id and ids; null ids give the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, pattern)
        for b in batches:
            text = [codec.decode(np.array(x.as_py() or [], np.int32)).decode("utf-8", "replace") for x in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def tokenizer(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[bytes, str]:
    """A public rank file and the pattern that goes with it."""
    import public_tokenizers as P

    with open(P.path(name), "rb") as f:
        return f.read(), P.PATTERN


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    ranks, pattern = tokenizer()
    return encode(docs, ranks, pattern, digests=True)
