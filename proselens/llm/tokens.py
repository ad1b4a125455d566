"""Ids of whole texts by a byte-level BPE file of the tokenizers library, a batch of texts at a time.

A byte-level BPE pre-tokeniser never lets a token run from a character that isn't white space over a following one. A text
may therefore be cut before every space, and on both sides of every lone line end, whose neighbours aren't white space;
the ids of the pieces, joined, are those of the whole text. The pieces of a batch are found in its bytes, told apart by
Arrow's dictionary coding, and each distinct one is encoded once while it stays in a bounded cache; ids are then gathered
by numpy.

Distinct pieces without inner white space are encoded as lines of one text by the rank encoder; that is only done for a
file whose merges are in the order of its ids, as is checked when it is read. All others, and every text that holds one of
the file's added tokens, go through the library itself.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

#: UTF-8 bytes of texts that are encoded together; a longer text is encoded by itself.
BATCH_BYTES = 4 << 20
#: Distinct pieces that a worker knows the ids of, some 50 bytes each; beyond, it begins again with those of the batch.
CACHE_PIECES = 400_000
#: Longer pieces go through the library, whose merging is not quadratic.
LONG_PIECE = 400


def byte_letters() -> dict[int, int]:
    """The public byte-level alphabet: every byte has a printable letter, most have their own."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: b for b in own} | {b: 256 + k for k, b in enumerate(rest)}


def _mergeable(vocab: dict[str, int], merges: list) -> dict[bytes, int] | None:
    """The vocabulary as ranks of byte strings, or None where merges aren't made in the order of their ids."""
    letters = {chr(to): byte for byte, to in byte_letters().items()}
    if any(c not in vocab for c in letters):
        return None
    ranks = {bytes([byte]): vocab[c] for c, byte in letters.items()}
    last = max(ranks.values())
    for pair in merges:
        made = pair.replace(" ", "") if isinstance(pair, str) else "".join(pair)
        if vocab.get(made, -1) <= last:
            return None
        last = ranks[bytes([letters[c] for c in made])] = vocab[made]
    return ranks


def _offsets(array) -> np.ndarray:
    """Where the values of a string or binary array begin and end in its buffer."""
    kind = np.int64 if str(array.type).startswith("large") else np.int32
    return np.frombuffer(array.buffers()[1], kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)


class Pieces:
    """Gathers the ids of texts from those of their distinct pieces, of which up to `cache_pieces` stay known. A coder
    says what the ids of distinct pieces are, and which strings of a text send it to `whole` as it is."""

    added: tuple[str, ...] = ()

    def __init__(self, cache_pieces: int = CACHE_PIECES):
        import pyarrow as pa

        self.cache_pieces, self.known = cache_pieces, pa.array([], pa.binary())
        self.known_ids, self.known_starts, self.known_counts = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def distinct(self, pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the distinct `pieces` (a binary array) in a row, where each piece's begin and how many they are."""
        raise NotImplementedError

    def whole(self, text: str) -> np.ndarray:
        """Ids of a text that isn't cut."""
        raise NotImplementedError

    def _looked_up(self, pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As `distinct`, with the ids of pieces that earlier batches had taken from the cache."""
        import pyarrow as pa
        import pyarrow.compute as pc

        found = pc.fill_null(pc.index_in(pieces, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(self.known) + np.count_nonzero(found < 0) > self.cache_pieces:  # keep those that this batch has
            old = np.flatnonzero(found >= 0)
            starts, counts = self.known_starts[found[old]], self.known_counts[found[old]]
            self.known, self.known_counts = pieces.take(pa.array(old)), counts
            self.known_starts = np.cumsum(counts) - counts
            self.known_ids = self.known_ids[np.repeat(starts - self.known_starts, counts) + np.arange(int(counts.sum()))]
            found[old] = np.arange(len(old))
        new = pieces.filter(pa.array(found < 0))
        ids, starts, counts = self.distinct(new)
        found[found < 0] = len(self.known) + np.arange(len(new))
        self.known = pa.concat_arrays([self.known, new])
        self.known_starts = np.concatenate([self.known_starts, starts + len(self.known_ids)])
        self.known_ids, self.known_counts = np.concatenate([self.known_ids, ids]), np.concatenate([self.known_counts, counts])
        return self.known_ids, self.known_starts[found], self.known_counts[found]

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of all `texts` (an Arrow string array without nulls) in a row, and the bounds of each text's."""
        import pyarrow as pa
        import pyarrow.compute as pc

        n = len(texts)
        offsets = _offsets(texts)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        if not len(data):
            return np.zeros(0, dtype=np.uint32), np.zeros(n + 1, dtype=np.int64)
        # a text's end is a piece's end whatever its neighbours are; neighbours in other texts only keep a cut away
        starts_here = np.zeros(len(data) + 1, dtype=bool)
        starts_here[_cuts(data)] = True
        starts_here[offsets] = True
        bounds = np.flatnonzero(starts_here).astype(np.int32)
        pieces = pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        ids, starts, counts = self._looked_up(coded.dictionary)
        each = counts[index]
        ends = np.cumsum(each)
        total = int(ends[-1])
        place = np.repeat((starts[index] - (ends - each)).astype(np.int32), each)
        place += np.arange(total, dtype=np.int32)
        out = ids[place]
        limits = np.concatenate([[0], ends])[np.searchsorted(bounds, offsets)]
        special = np.zeros(n, dtype=bool)
        for token in self.added:
            special |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if special.any():
            parts = [self.whole(texts[k].as_py()) if special[k] else out[limits[k] : limits[k + 1]] for k in range(n)]
            out, limits = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return out, limits


class Encoder(Pieces):
    """Encodes Arrow arrays of texts with tokenizers' file at `path`; no special tokens are added."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__(cache_pieces)
        self.library = Tokenizer.from_file(path)
        self.added = tuple(t.content for t in self.library.get_added_tokens_decoder().values() if t.content)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        ranks = _mergeable(model["vocab"], model["merges"])
        self.ranked = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranks else None
        self.line_end = ranks[b"\n"] if ranks else -1

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def distinct(self, pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(pieces)
        offsets = _offsets(pieces)
        data = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)[: offsets[-1]]
        first = data[np.minimum(offsets[:-1], max(len(data) - 1, 0))] if n else data
        # plain: at most one space, at the front, then no byte of white space or of a longer code that may be white space
        odd_byte = (data <= 0x20) | (data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3))
        odd_count = np.concatenate([[0], np.cumsum(odd_byte)])
        length, space = np.diff(offsets), first == 0x20
        plain = (odd_count[offsets[1:]] - odd_count[offsets[:-1]] == space) & (length > space) & (length <= LONG_PIECE)
        if self.ranked is None:
            plain[:] = False
        out_n = np.zeros(n, dtype=np.int64)
        parts: list[np.ndarray] = []
        at = np.flatnonzero(plain)
        if len(at):
            # all plain pieces as lines of one text: every line end is a token by itself
            step = length[at] + 1
            to = np.cumsum(step) - step
            text = np.full(int(step.sum()), 0x0A, dtype=np.uint8)
            source = np.repeat(offsets[at] - (np.cumsum(length[at]) - length[at]), length[at]) + np.arange(int(length[at].sum()))
            goal = np.repeat(to - (np.cumsum(length[at]) - length[at]), length[at]) + np.arange(int(length[at].sum()))
            text[goal] = data[source]
            ids = self.ranked.encode_to_numpy(text.tobytes().decode(), disallowed_special=())
            ends = np.flatnonzero(ids == self.line_end)
            if len(ends) != len(at):
                raise AssertionError("a line end that isn't a token by itself")
            out_n[at] = np.diff(np.concatenate([[-1], ends])) - 1
            parts.append(np.delete(ids, ends))
        others = np.flatnonzero(~plain)
        for k in others.tolist():
            got = self.whole(data[offsets[k] : offsets[k + 1]].tobytes().decode())
            out_n[k] = len(got)
            parts.append(got)
        order = np.concatenate([at, others])
        starts = np.empty(n, dtype=np.int64)
        starts[order] = np.cumsum(out_n[order]) - out_n[order]
        return (np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)).astype(np.uint32), starts, out_n

def _cuts(data: np.ndarray) -> np.ndarray:
    """Places in UTF-8 bytes where a text may be cut: before a space, and before and after a line end, whose neighbours
    can't be white space. Bytes up to 0x20 and codes that begin with C2 or E1 to E3 are taken for white space here."""
    tight = data > 0x20
    begins = tight & (data != 0xC2) & ((data < 0xE1) | (data > 0xE3))  # a character that isn't white space may begin so
    ended = tight.copy()  # the byte may end a character that isn't white space
    c2 = np.flatnonzero(data == 0xC2) + 1
    e = np.flatnonzero((data >= 0xE1) & (data <= 0xE3)) + 2
    ended[c2[c2 < len(data)]] = False
    ended[e[e < len(data)]] = False
    space = np.flatnonzero(data == 0x20)
    space = space[space > 0]
    space = space[ended[space - 1]]
    line = np.flatnonzero(data == 0x0A)
    line = line[(line > 0) & (line < len(data) - 1)]
    line = line[ended[line - 1] & begins[line + 1]]
    return np.concatenate([space, line, line + 1])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of the file at `path`; made once and kept while the worker lives."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def slices(texts, most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of an Arrow string array of about `most` bytes each; a longer text has a range of its own."""
    n = len(texts)
    if not n:
        return
    offsets, at = _offsets(texts), 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """`ids` with the end id after each text's, and the bounds with it."""
    if end_id is None:
        return ids, bounds
    return np.insert(ids, bounds[1:], np.uint32(end_id)), bounds + np.arange(len(bounds))


def binaries(data: np.ndarray, bounds: np.ndarray):
    """An Arrow binary array over `data` (uint8), cut at `bounds`."""
    import pyarrow as pa

    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def in_bytes(texts: list[str], most: int) -> Iterable[tuple[int, int]]:
    """Ranges of `texts` of about `most` characters each; a longer text has a range of its own."""
    at = 0
    while at < len(texts):
        to, chars = at, 0
        while to < len(texts) and (to == at or chars + len(texts[to]) <= most):
            chars += len(texts[to])
            to += 1
        yield at, to
        at = to
