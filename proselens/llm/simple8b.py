"""Token ids as files of Simple-8b words.

A word is 64 bits, little-endian: 4 bits of selector, 60 of payload. Selectors 0 to 13 hold 60, 30, 20, 15, 12, 10, 8,
7, 6, 5, 4, 3, 2 or 1 ids of 60 // count bits; 14 is a run (32 bits of value, 28 of length); 15 is an escape: the next
word is one id of up to 64 bits, raw. Ids go in blocks of `BLOCK`; the file's index has each block's first word, so
that any block is decoded alone, and all words of one selector at once.

File: magic, then words, then (as little-endian uint64) the first word of every block, the documents' doc_id, whether
it is null, and id counts, then a footer of counts and the magic. Files are written to a name of the attempt and moved
into place: a lost task leaves nothing that is read, and a repeated one writes the same bytes.

Results for odd input: a null text is an empty one; a null doc_id sorts first; rows with one doc_id are ordered by
text; an empty table makes no files and no rows; columns other than the two named are ignored.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proselens.llm import shared, tokens

MAGIC = b"PLS8B\x00\x00\x01"
BLOCK = 1024
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = 60 // COUNTS
RUN, ESCAPE = 14, 15
_WIDTH = np.array([x.bit_length() for x in range(1 << 17)], dtype=np.uint8)


def encode_blocks(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Words of `ids` (uint64) and the first word of each block. All blocks advance together, a word a step."""
    n = len(ids)
    if not n:
        return np.zeros(0, dtype="<u8"), np.zeros(0, dtype="<u8")
    blocks = -(-n // block)
    grid = np.zeros((blocks, block + 60), dtype=np.uint64)
    padded = np.zeros(blocks * block, dtype=np.uint64)
    padded[:n] = ids
    grid[:, :block] = padded.reshape(blocks, block)
    held = np.full(blocks, block)
    held[-1] = n - (blocks - 1) * block
    if grid.max() < len(_WIDTH):
        width = _WIDTH[grid.astype(np.uint32)]
    else:
        width, rest = np.zeros(grid.shape, dtype=np.uint8), grid.copy()
        for shift in (32, 16, 8, 4, 2, 1):
            big = rest >> np.uint64(shift) > 0
            width[big] += np.uint8(shift)
            rest[big] >>= np.uint64(shift)
        width += rest > 0
    # selector: the first (most ids) whose next `count` ids all fit
    selector = np.full(grid.shape, ESCAPE, dtype=np.uint8)
    np.copyto(selector, 13, where=width <= 60)
    widest = {1: width}  # of the next 1, 2, 4 ... ids; beyond the grid there is nothing
    for c in (2, 4, 8, 16, 32):
        half = widest[c // 2]
        widest[c] = half.copy()
        np.maximum(half[:, : -(c // 2)], half[:, c // 2 :], out=widest[c][:, : -(c // 2)])
    top = int(width.max())
    for s in range(12, -1, -1):
        if s < 12 and BITS[s + 1] >= top and BITS[s] >= top:
            selector.fill(s)  # every id fits, and more of them than by the selector before
            continue
        c = int(COUNTS[s])
        half = widest[1 << (c.bit_length() - 1)]
        gap = c - (1 << (c.bit_length() - 1))
        fits = half <= BITS[s]
        if gap:
            fits[:, :-gap] &= half[:, gap:] <= BITS[s]
        np.copyto(selector, s, where=fits)
    # equal ids ahead, for runs: worth a word where they are more than the selector takes
    same = np.ones(grid.shape, dtype=np.int16)
    equal = np.zeros((blocks, block), dtype=bool)
    equal[:, : block - 1] = grid[:, : block - 1] == grid[:, 1:block]
    stop = np.where(equal, np.int16(block), np.arange(block, dtype=np.int16))
    same[:, :block] = np.minimum.accumulate(stop[:, ::-1], axis=1)[:, ::-1] - np.arange(block, dtype=np.int16) + 1
    # what a word at each place would take: its selector's ids, or a longer run
    take = np.where(selector < 14, COUNTS[np.minimum(selector, 13)], 1).astype(np.int16)
    run = np.minimum(same, (held[:, None] - np.arange(block + 60)).astype(np.int16))
    as_run = (run > take) & (width <= 32)
    np.copyto(take, run, where=as_run)
    # all blocks follow their chains of words together
    step, columns = take.reshape(-1), block + 60
    at = np.arange(blocks, dtype=np.int64) * columns
    end, chain = at + held, []
    while len(at):
        chain.append(at)
        at = at + step[at]
        go = at < end
        at, end = at[go], end[go]
    place = np.sort(np.concatenate(chain))
    # then all words of one selector are made at once
    kind, flat = np.where(as_run.reshape(-1)[place], RUN, selector.reshape(-1)[place]), grid.reshape(-1)
    escaped = kind == ESCAPE
    slot = np.arange(len(place)) + np.concatenate([[0], np.cumsum(escaped)[:-1]])
    words = np.zeros(len(place) + int(escaped.sum()), dtype=np.uint64)
    for s in np.unique(kind).tolist():
        k = np.flatnonzero(kind == s)
        if s == RUN:
            words[slot[k]] = np.uint64(RUN) | flat[place[k]] << np.uint64(4) | take.reshape(-1)[place[k]].astype(np.uint64) << np.uint64(36)
        elif s == ESCAPE:
            words[slot[k]] = ESCAPE
            words[slot[k] + 1] = flat[place[k]]
        else:
            word = np.full(len(k), s, dtype=np.uint64)
            for j in range(int(COUNTS[s])):
                word |= flat[place[k] + j] << np.uint64(4 + j * int(BITS[s]))
            words[slot[k]] = word
    starts = slot[np.searchsorted(place, np.arange(blocks, dtype=np.int64) * columns)]
    return words.astype("<u8"), starts.astype("<u8")


def decode_blocks(words: np.ndarray, starts: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The `n` ids of `words`, by selector."""
    if not n:
        return np.zeros(0, dtype=np.uint64)
    words = words.astype(np.uint64)
    selector = (words & np.uint64(15)).astype(np.uint8)
    # a word after an escape is raw, whatever its low bits say
    raw = np.zeros(len(words), dtype=bool)
    for k in np.flatnonzero(selector == ESCAPE):
        if not raw[k]:
            raw[k + 1] = True
    count = np.where(selector < 14, COUNTS[np.minimum(selector, 13)], 1)
    runs = (selector == RUN) & ~raw
    count[runs] = (words[runs] >> np.uint64(36)).astype(np.int64)
    count[(selector == ESCAPE) & ~raw] = 0
    count[raw] = 1
    # the last word of a block may have room beyond the block's ids
    held = np.full(len(starts), block)
    held[-1] = n - (len(starts) - 1) * block
    first = np.concatenate([[0], np.cumsum(count)])
    bounds = np.concatenate([starts.astype(np.int64), [len(words)]])
    spare = np.repeat(first[bounds[:-1]] - np.concatenate([[0], np.cumsum(held)])[:-1], np.diff(bounds))
    place = first[:-1] - spare
    ids = np.zeros(n + 64, dtype=np.uint64)
    limit = np.repeat(np.cumsum(held), np.diff(bounds))
    for s in range(14):
        k = np.flatnonzero((selector == s) & ~raw)
        if len(k):
            c, b = int(COUNTS[s]), int(BITS[s])
            values = (words[k][:, None] >> (np.arange(c, dtype=np.uint64) * np.uint64(b) + np.uint64(4))) & np.uint64((1 << b) - 1)
            to = place[k][:, None] + np.arange(c)
            inside = to < limit[k][:, None]
            ids[to[inside]] = values[inside]
    k = np.flatnonzero(runs)
    if len(k):
        length = count[k]
        to = np.repeat(place[k], length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        ids[to] = np.repeat(words[k] >> np.uint64(4) & np.uint64(0xFFFFFFFF), length)
    k = np.flatnonzero(raw)
    ids[place[k]] = words[k]
    return ids[:n]


class Writer:
    """One file: ids are added in any amounts; whole groups of blocks are encoded and written at once."""

    GROUP = 1024 * BLOCK

    def __init__(self, sink):
        self.sink, self.held, self.n_held, self.n, self.words = sink, [], 0, 0, 0
        self.starts, self.docs, self.n_docs = [], [], 0
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.add_all(np.array([doc_id or 0]), np.array([doc_id is None]), np.array([len(ids)]), ids)

    def add_all(self, doc_ids: np.ndarray, null: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        """The `ids` of several documents in a row."""
        self.docs.append(np.stack([doc_ids, null, lengths], axis=1).astype(np.int64))
        self.n_docs += len(doc_ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.GROUP:
            self._flush(self.n_held // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, dtype=np.uint64)
        for at in range(0, n, self.GROUP):
            words, starts = encode_blocks(ids[at : min(n, at + self.GROUP)].astype(np.uint64))
            self.sink.write(words.tobytes())
            self.starts.append(starts + np.uint64(self.words))
            self.words += len(words)
        self.n += n
        self.held, self.n_held = [ids[n:]], len(ids) - n

    def close(self) -> None:
        self._flush(self.n_held)
        starts = np.concatenate(self.starts) if self.starts else np.zeros(0, dtype="<u8")
        docs = np.concatenate(self.docs) if self.docs else np.zeros((0, 3), dtype=np.int64)
        self.sink.write(starts.astype("<u8").tobytes() + docs[:, 0].astype("<i8").tobytes() + docs[:, 1].astype("<u8").tobytes() + docs[:, 2].astype("<u8").tobytes())
        self.sink.write(struct.pack("<QQQQ", self.words, len(starts), len(docs), self.n) + MAGIC)


class Reader:
    """Reads a file's index, and its ids by blocks."""

    def __init__(self, source):
        self.source = source
        size = source.seek(0, 2)
        source.seek(size - 40)
        foot = source.read(40)
        if foot[32:] != MAGIC:
            raise ValueError("not a whole file of Simple-8b words")
        self.words, blocks, docs, self.n = struct.unpack("<QQQQ", foot[:32])
        source.seek(8 + 8 * self.words)
        index = source.read(8 * (blocks + 3 * docs))
        self.starts = np.frombuffer(index, "<u8", blocks)
        self.doc_ids = np.frombuffer(index, "<i8", docs, 8 * blocks)
        self.null = np.frombuffer(index, "<u8", docs, 8 * (blocks + docs)) > 0
        self.lengths = np.frombuffer(index, "<u8", docs, 8 * (blocks + 2 * docs)).astype(np.int64)

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids of the blocks from `first` to before `last`."""
        last = min(last, len(self.starts))
        if first >= last:
            return np.zeros(0, dtype=np.uint64)
        a = int(self.starts[first])
        b = int(self.starts[last]) if last < len(self.starts) else self.words
        self.source.seek(8 + 8 * a)
        words = np.frombuffer(self.source.read(8 * (b - a)), "<u8")
        return decode_blocks(words, self.starts[first:last] - np.uint64(a), min(self.n, last * BLOCK) - first * BLOCK)

    def documents(self):
        """(doc_id, ids) in file order, holding a few hundred blocks at a time."""
        held, at, step = np.zeros(0, dtype=np.uint64), 0, 256
        for doc, null, n in zip(self.doc_ids.tolist(), self.null.tolist(), self.lengths.tolist()):
            if len(held) < n:
                parts = [held]
                have = len(held)
                while have < n:
                    parts.append(self.ids(at, at + step))
                    have += len(parts[-1])
                    at += step
                held = np.concatenate(parts)
            yield None if null else doc, held[:n]
            held = held[n:]


def write_ids(docs: DataFrame, tokenizer: str, end_id: int | None = 0, folder: str | None = None) -> DataFrame:
    """Write the ids of all texts in ascending doc_id order; returns the manifest: part, file, n_docs, n_ids, words."""
    spark = docs.sparkSession
    folder = folder or shared.new_path(spark, "ids")

    def files(batches):
        import uuid

        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        where, root = fs.FileSystem.from_uri(folder)
        coder, writer, out, temp = tokens.encoder(tokenizer), None, None, f"{root}/.part-{part:06d}-{uuid.uuid4().hex}"
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in tokens.slices(texts):
                if writer is None:
                    where.create_dir(root, recursive=True)
                    out = where.open_output_stream(temp)
                    writer = Writer(out)
                got, bounds = tokens.with_end(*coder.encode(texts.slice(a, b - a)), end_id)
                own = ids.slice(a, b - a)
                writer.add_all(own.fill_null(0).to_numpy(), own.is_null().to_numpy(zero_copy_only=False), np.diff(bounds), got)
        if writer is not None:
            writer.close()
            out.close()
            name = f"part-{part:06d}.s8b"
            where.move(temp, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [f"{folder}/{name}"], "n_docs": [writer.n_docs], "n_ids": [writer.n], "words": [writer.words]})

    ordered = shared.id_text(docs).repartitionByRange(shared.partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return shared.written(ordered.mapInArrow(files, "part int, file string, n_docs long, n_ids long, words long"), "manifest")


def read_ids(manifest: DataFrame) -> DataFrame:
    """Documents of the files, read back: doc_id, start, n_tokens, ids (little-endian uint32).

    The manifest has a row a file; a file is a task's whole output, so the running sum over it is over as many rows as
    there were tasks.
    """
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("file", before.alias("before"))

    def rows(batches):
        import pyarrow as pa
        from pyarrow import fs

        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                where, path = fs.FileSystem.from_uri(file)
                with where.open_input_file(path) as source:
                    held, size = [], 0
                    for doc, ids in Reader(source).documents():
                        held.append((doc, start, len(ids), ids.astype("<u4").tobytes()))
                        start += len(ids)
                        size += 4 * len(ids)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    spread = files.repartition(shared.partitions(manifest.sparkSession), "file")
    return spread.mapInArrow(rows, "doc_id long, start long, n_tokens long, ids binary")
