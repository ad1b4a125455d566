"""Byte-level BPE by ranks, encoding and decoding, with a two-tier lookup of pre-tokens.

Tier one is a minimal perfect hash over the vocabulary's byte strings (hash and displace: a first hash names a bucket,
the bucket's displacement sends each of its keys to a slot of its own; as many slots as keys). A pre-token whose slot
holds the very same bytes has that slot's id. Tier two merges the rest: a heap of (rank, position) over bytes in a
doubly linked list; a popped pair that no longer stands as it was pushed is passed over.

A worker keeps what it worked out for the pieces between spaces in a bounded cache of two generations (see `tokens`).

Results for odd input: a null text is an empty one, with no ids; decoding gives the text's UTF-8 bytes back whatever
they are; rows are handled one by one, so repeated rows, null ids and ties have no effect on each other; an empty table
gives none; columns other than the two named are ignored.
"""

from __future__ import annotations

import base64
import heapq
import struct

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame

from proselens.llm import shared, tokens

#: The public pattern of this family of vocabularies; a file with another is given its own.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The largest prime under 2^32; displaced hashes are taken by it before they are taken by the number of slots.
PRIME = 4294967291
SCHEMA = "doc_id long, n_tokens long, ids binary, decoded binary"


class PerfectHash:
    """A minimal perfect hash of distinct byte strings: `slot(key)` is within the number of keys, and is the key's own."""

    PER_BUCKET = 4

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, -(-n // self.PER_BUCKET))
        self.shift = np.zeros(self.buckets, dtype=np.int64).tolist()
        held: list[list[tuple[int, int]]] = [[] for _ in range(self.buckets)]
        for key in keys:
            h = xxhash.xxh3_128_intdigest(key)
            held[(h >> 96) % self.buckets].append((h & 0xFFFFFFFF, (h >> 32) & 0xFFFFFFFF))
        free = bytearray(b"\x01" * n)
        at = 0
        for b in sorted(range(self.buckets), key=lambda b: -len(held[b])):
            if not held[b]:
                break
            if len(held[b]) == 1:  # a key alone in its bucket is sent straight to a slot that is left
                at = free.index(1, at)
                self.shift[b], free[at] = -1 - at, 0
                continue
            d = 0
            while True:
                slots = [(lo + d * hi) % PRIME % n for lo, hi in held[b]]
                if len(set(slots)) == len(slots) and all(free[s] for s in slots):
                    break
                d += 1
                if d > 1 << 22:
                    raise ValueError("no displacement: are the keys distinct?")
            self.shift[b] = d
            for s in slots:
                free[s] = 0

    def slot(self, key: bytes) -> int:
        h = xxhash.xxh3_128_intdigest(key)
        d = self.shift[(h >> 96) % self.buckets]
        if d < 0:
            return -1 - d
        return ((h & 0xFFFFFFFF) + d * ((h >> 32) & 0xFFFFFFFF)) % PRIME % self.n


class Bpe(tokens.Pieces):
    """Encoder and decoder for the ranks of a `.tiktoken` file: lines of base64 bytes and a rank."""

    def __init__(self, path: str, pattern: str = PATTERN, cache_pieces: int = tokens.CACHE_PIECES):
        super().__init__(cache_pieces)
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.vocabulary = [(base64.b64decode(a), int(b)) for a, b in pairs]
        self.bytes_of = {b: a for a, b in self.vocabulary}
        rank_of = dict(self.vocabulary)
        self.byte_id = [rank_of[bytes([b])] for b in range(256)]
        #: (left id, right id) -> the id of both: every way to cut an entry of the vocabulary into two.
        self.pair_rank = {rank_of[a[:i]] << 32 | rank_of[a[i:]]: b for a, b in self.vocabulary for i in range(1, len(a)) if a[:i] in rank_of and a[i:] in rank_of}.get
        self.hash = PerfectHash([a for a, _ in self.vocabulary])
        self.slots: list[tuple[bytes, int]] = [(b"", -1)] * len(self.vocabulary)
        for a, b in self.vocabulary:
            self.slots[self.hash.slot(a)] = (a, b)
        self.findall = regex.compile(pattern).findall
        sizes = np.zeros(max(self.bytes_of) + 1, dtype=np.int64)
        for a, b in self.vocabulary:
            sizes[b] = len(a)
        #: Every entry's bytes, in the order of ids, and where they begin.
        self.sizes, self.begins = sizes, np.cumsum(sizes) - sizes
        self.letters = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(len(sizes))), np.uint8)

    def found(self, piece: bytes) -> int:
        """The piece's id where it is in the vocabulary as it stands, else -1."""
        key, rank = self.slots[self.hash.slot(piece)]
        return rank if key == piece else -1

    def merged(self, piece: bytes) -> list[int]:
        """Ids by merging the adjacent pair of least rank, the leftmost of equals, until none is in the vocabulary."""
        pair_rank, part = self.pair_rank, [self.byte_id[b] for b in piece]
        n = len(part)
        heap = [(r, i) for i in range(n - 1) if (r := pair_rank(part[i] << 32 | part[i + 1])) is not None]
        if not heap:
            return part
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            r, i = pop(heap)
            j = after[i]
            if part[i] < 0 or j >= n or pair_rank(part[i] << 32 | part[j]) != r:
                continue
            part[i], part[j] = r, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (x := pair_rank(r << 32 | part[k])) is not None:
                    push(heap, (x, i))
            h = before[i]
            if h >= 0 and (x := pair_rank(part[h] << 32 | r)) is not None:
                push(heap, (x, h))
        return [p for p in part if p >= 0]

    def distinct(self, pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts_known: dict[str, list[int]] = {}
        out, counts = [], []
        for piece in pieces.to_pylist():
            n = len(out)
            for part in parts(piece.decode(), self.findall):
                ids = parts_known.get(part)
                if ids is None:
                    raw = part.encode()
                    rank = self.found(raw)
                    ids = parts_known[part] = [rank] if rank >= 0 else self.merged(raw)
                out += ids
            counts.append(len(out) - n)
        n = np.array(counts, dtype=np.int64)
        return np.array(out, dtype=np.uint32), np.cumsum(n) - n, n

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids in a row, and the bounds of each text's."""
        size = self.sizes[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        data = self.letters[np.repeat(self.begins[ids] - ends[:-1], size) + np.arange(int(ends[-1]))]
        return data, ends[bounds]


#: Marks that may follow a word in a piece; with more than one kind of them in a row they are still one pre-token.
_MARKS = ".,;:!?%#&$*|()-"


def parts(piece: str, findall) -> list[str]:
    """The piece's pre-tokens. Letters after at most one space, with or without marks after them, need no pattern:
    `isalpha` is true of letters only, as \\p{L} is."""
    word = piece.rstrip(_MARKS)
    if (word[1:] if word[:1] == " " else word).isalpha():
        return [piece] if len(word) == len(piece) else [word, piece[len(word) :]]
    return findall(piece)


_made: dict[tuple[str, str], Bpe] = {}


def of(path: str, pattern: str = PATTERN) -> Bpe:
    """The worker's coder; made once and kept while the worker lives."""
    if (path, pattern) not in _made:
        _made[path, pattern] = Bpe(path, pattern)
    return _made[path, pattern]


def encoded(docs: DataFrame, ranks: str, pattern: str = PATTERN) -> DataFrame:
    """Per document: n_tokens, ids (little-endian uint32) and the bytes that the ids decode to."""

    def rows(batches):
        import pyarrow as pa

        coder = of(ranks, pattern)
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1)
            for a, b in tokens.slices(texts):
                ids, bounds = coder.encode(texts.slice(a, b - a))
                data, ends = coder.decode(ids, bounds)
                cells = [tokens.binaries(x, e) for x, e in ((ids.astype("<u4").view(np.uint8), 4 * bounds), (data, ends))]
                yield pa.RecordBatch.from_arrays([doc_ids.slice(a, b - a), pa.array(np.diff(bounds)), *cells], names=["doc_id", "n_tokens", "ids", "decoded"])

    return shared.id_text(docs).mapInArrow(rows, SCHEMA)
