"""Byte-level BPE by a two-tier lookup.

A pre-token that is itself in the vocabulary is resolved by a minimal perfect hash: as many slots as tokens, found by
one hash and the displacement of its bucket, and confirmed by comparing the bytes. Any other pre-token is merged on a linked list of its bytes,
with a heap of the ranks of adjacent pairs, in O(n log n). Each worker remembers the ids of the
pieces and pre-tokens used most lately, none longer than ``LONGEST`` and all of them in a bounded number of bytes; that changes no result.

Tables go to the workers once; their size is that of the vocabulary. No special tokens are known: their strings are ordinary text.

Defined cases: a null text is encoded as an empty one, to no ids; null ids are decoded to no bytes. Ids are kept as little-endian
unsigned 32-bit integers in one binary value. An id outside the vocabulary raises ValueError. Whole texts are encoded, of any length.
"""

from __future__ import annotations

import base64
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblattice.llm.arrow import pieces

#: White space as Unicode's property has it.
_SPACE = r"\t-\r \x85\xa0  -     　"
#: Pieces at whose bounds the pre-tokens of any pattern of this family also have bounds: a word with one blank before it, or white space.
PIECES = re.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PerfectHash:
    """A minimal perfect hash of byte strings: key -> slot, all slots used.

    Keys fall into buckets by one half of their hash; the fullest buckets first look for a displacement that sends
    all their keys to free slots, and buckets of one key take what is left.
    """

    def __init__(self, keys: list[bytes], per_bucket: int = 3):
        n = self.n = len(keys)
        self.buckets = max(1, n // per_bucket)
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        self.shift = np.zeros(self.buckets, np.int64)
        self.keys: list[bytes] = [b""] * n
        free = np.ones(n, bool)
        sizes = np.diff(starts)
        for b in np.argsort(-sizes, kind="stable"):
            own = order[starts[b] : starts[b + 1]]
            if len(own) < 2:
                break
            tried = 0
            while True:
                slots = self._slots(hashes[own], np.arange(tried, tried + 64, dtype=np.uint64)[:, None])
                fits = free[slots].all(axis=1) & (np.diff(np.sort(slots, axis=1), axis=1) > 0).all(axis=1)
                if fits.any():
                    break
                tried += 64
            k = int(fits.argmax())
            self.shift[b] = tried + k
            free[slots[k]] = False
            for i, slot in zip(own, slots[k], strict=True):
                self.keys[slot] = keys[i]
        left = iter(np.flatnonzero(free))
        for b in np.flatnonzero(sizes == 1):
            slot = next(left)
            self.shift[b] = -1 - slot
            self.keys[slot] = keys[order[starts[b]]]

    def _slots(self, hashes: np.ndarray, shift: np.ndarray) -> np.ndarray:
        x = (hashes >> np.uint64(17)) ^ (shift * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return ((x ^ (x >> np.uint64(29))) % np.uint64(self.n)).astype(np.int64)

    def slots(self, keys: list[bytes]) -> np.ndarray:
        """The slot of each key, or -1 if it is not one of the keys."""
        if not keys or not self.n:
            return np.full(len(keys), -1, np.int64)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
        shift = self.shift[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        slots = np.where(shift < 0, -1 - shift, self._slots(hashes, np.maximum(shift, 0).astype(np.uint64)))
        mine = self.keys
        return np.fromiter((s if mine[s] == k else -1 for s, k in zip(slots.tolist(), keys, strict=True)), np.int64, len(keys))


#: The longest string whose result is remembered, in characters, and about the bytes that an entry takes besides its contents.
LONGEST, ENTRY = 64, 160


class Memo:
    """The results of a function for strings, kept for the strings used most lately.

    Of two generations of about ``size`` bytes each the older is dropped when the younger is full. Strings of more than
    ``LONGEST`` characters are computed each time.
    """

    def __init__(self, size: int, function):
        self.size, self.function = size, function
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.used = 0

    def all(self, keys: list[str]) -> list[bytes]:
        young = self.young
        new = [k for k in set(keys) if k not in young]
        if not new:
            return [young[k] for k in keys]
        old, long, unknown, used = self.old, [], [], 0
        for k in new:
            if (value := old.get(k)) is not None:
                young[k] = value
                used += len(k) + len(value) + ENTRY
            elif len(k) > LONGEST:
                long.append(k)
            else:
                unknown.append(k)
        found = self.function(unknown)
        more = sum(map(len, unknown)) + sum(map(len, found)) + ENTRY * len(unknown)
        once = dict(zip(long, self.function(long), strict=True)) if long else {}
        if more <= self.size:
            young.update(zip(unknown, found, strict=True))
            used += more
        else:  # more than a generation holds
            once.update(zip(unknown, found, strict=True))
        out = [young[k] if k in young else once[k] for k in keys] if once else [young[k] for k in keys]
        self.used += used
        if self.used > self.size:
            self.old, self.young, self.used = young, {}, 0
        return out


class Bpe:
    """An encoder and decoder for one vocabulary and split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = 16 << 20):
        self.pattern, self.memo = pattern, memo
        self.lookup = PerfectHash(list(ranks))
        self.slot_ids = np.array([ranks[k] for k in self.lookup.keys], np.uint32)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.bytes = [ranks.get(bytes([k]), -1) for k in range(256)]
        self.width = max(ranks.values(), default=0) + 1
        # every way in which two tokens side by side make a third
        self.pairs = {a * self.width + b: rank for token, rank in ranks.items() for k in range(1, len(token)) if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None}
        self._ready()

    def _ready(self) -> None:
        self.split = regex.compile(self.pattern).findall
        self.of_tokens = Memo(2 * self.memo, self._pre_tokens)  # ``memo`` is a number of bytes
        self.of_pieces = Memo(self.memo, self._pieces)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("split", "of_tokens", "of_pieces")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._ready()

    def merge(self, token: bytes) -> list[int]:
        """Ids of a pre-token that is not in the vocabulary: its bytes are a linked list, adjacent pairs wait in a heap by rank and place."""
        n, width, pair = len(token), self.width, self.pairs.get
        ids = [self.bytes[c] for c in token]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [pair(a * width + b, -1) for a, b in zip(ids, ids[1:])] + [-1]
        shift = n.bit_length()
        place, pop, push = (1 << shift) - 1, heapq.heappop, heapq.heappush
        heap = [rank << shift | i for i, rank in enumerate(waiting) if rank >= 0]
        heapq.heapify(heap)
        while heap:
            rank = pop(heap)
            i = rank & place
            rank >>= shift
            if waiting[i] != rank:
                continue  # one of the two has been merged meanwhile
            j = after[i]
            k = after[i] = after[j]
            ids[i] = rank
            waiting[i] = waiting[j] = -1
            if k < n:
                before[k] = i
                if (r := pair(rank * width + ids[k], -1)) >= 0:
                    waiting[i] = r
                    push(heap, r << shift | i)
            if (h := before[i]) >= 0:
                waiting[h] = r = pair(ids[h] * width + rank, -1)
                if r >= 0:
                    push(heap, r << shift | h)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def _pre_tokens(self, tokens: list[str]) -> list[bytes]:
        raw = [t.encode() for t in tokens]
        slots = self.lookup.slots(raw)
        whole = self.slot_ids[slots].astype("<u4").tobytes()
        out = []
        for k, (slot, token) in enumerate(zip(slots.tolist(), raw, strict=True)):
            if slot >= 0:
                out.append(whole[4 * k : 4 * k + 4])
            else:
                merged = self.merge(token)
                out.append(struct.pack(f"<{len(merged)}I", *merged))
        return out

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        split = [self.split(p) for p in pieces]
        ids = iter(self.of_tokens.all([t for tokens in split for t in tokens]))
        return [next(ids) if len(tokens) == 1 else b"".join([next(ids) for _ in tokens]) for tokens in split]

    def encode(self, text: str | None) -> bytes:
        """The ids of a text, as little-endian unsigned 32-bit integers."""
        return b"".join(self.of_pieces.all(PIECES.findall(text or "")))

    def decode(self, ids: bytes | None) -> bytes:
        tokens = self.tokens
        try:
            return b"".join([tokens[i] for i in np.frombuffer(ids or b"", "<u4").tolist()])
        except KeyError as unknown:
            raise ValueError(f"id {unknown} is not in the vocabulary") from None


def load(path: str, pattern: str) -> Bpe:
    return Bpe(read_ranks(path), pattern)


def encode(docs: DataFrame, bpe: Bpe, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(bpe)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, 1):
            ids = [sent.value.encode(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary")


def decode(encoded: DataFrame, bpe: Bpe) -> DataFrame:
    """The columns of ``encode`` and decoded, the bytes of the text."""
    sent = encoded.sparkSession.sparkContext.broadcast(bpe)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 64) for b in batches for k in range(0, b.num_rows, 64)):
            decoded = [sent.value.decode(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    rows = encoded.select("doc_id", "n_tokens", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary, decoded binary")


def encode_decode(docs: DataFrame, bpe: Bpe, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids and decoded of every row: ``encode`` and ``decode`` in one pass of the workers."""
    sent = docs.sparkSession.sparkContext.broadcast(bpe)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, 1):
            ids = [sent.value.encode(t) for t in texts]
            columns = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([sent.value.decode(x) for x in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "decoded"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """The digest columns: SHA-256 of the ids and of the decoded bytes."""
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
