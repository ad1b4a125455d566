"""Packing, Simple-8b, BPE and GIF against libraries, references and round trips."""

import base64
import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from proselens.llm import bpe, gif, packing, queries, shared, simple8b, tokens

ODD = [(1, "It is so, e.g. 'tis  odd\n\n x."), (2, None), (3, ""), (4, "ab " * 3000), (4, "ab " * 3000), (None, "none"), (5, "ünïcödé 日本 👩‍👩‍👧"), (6, "\x1c \x01 \t "), (7, "a" * 3000)]
SCHEMA = "doc_id long, text string"


def _library():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def _texts():
    rng = random.Random(5)
    pools = ["  \n\t\r\x0b\x1c\x85\xa0　", "abc'sdtrevmll", "0129²½Ⅷ٣", "éñßЖ日👩‍", "?.,'\"$%&"]
    return ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + [t or "" for _, t in ODD]


def _ids(coder, texts):
    got, bounds = coder.encode(pa.array(texts, pa.string()))
    return [got[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


def test_pieces_give_the_library_ids():
    want, coder, texts = _library(), tokens.encoder(P.path("byte_bpe_50k.json")), _texts()
    for some in (texts, texts[::-1]):  # together, so that texts are neighbours in one buffer
        for text, ids in zip(some, _ids(coder, some)):
            assert ids == want(text), repr(text)
    for text in texts[:300]:
        assert _ids(coder, [text]) == [want(text)], repr(text)
    sliced = pa.array(texts, pa.string()).slice(40, 60)
    got, bounds = coder.encode(sliced)
    assert [got[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [want(t) for t in texts[40:100]]


def test_long_texts_and_pieces():
    want, coder = _library(), tokens.encoder(P.path("byte_bpe_50k.json"))
    texts = ["abcde" * 40_000, "word, and more " * 100_000, "\n".join(["line of it"] * 50_000), "é\u00a0b\u3000 c\u2028d" * 2000]
    assert _ids(coder, texts) == [want(t) for t in texts]
    assert [*tokens.slices(pa.array(texts), 1 << 20)] == [(0, 1), (1, 2), (2, 4)]


def test_a_file_of_other_merge_order_goes_through_the_library(tmp_path):
    import json

    made = json.load(open(P.path("byte_bpe_50k.json"), encoding="utf-8"))
    merges = made["model"]["merges"]
    merges[5], merges[60] = merges[60], merges[5]
    path = tmp_path / "other.json"
    path.write_text(json.dumps(made))
    coder, library = tokens.Encoder(str(path)), Tokenizer.from_file(str(path))
    assert coder.ranked is None
    texts = _texts()[:200]
    assert _ids(coder, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_cache_does_not_change_ids():
    small, want = tokens.Encoder(P.path("byte_bpe_50k.json"), 10), _library()
    texts = [f"word{k} and word{k % 7}, again" for k in range(200)]
    assert _ids(small, texts) == [want(t) for t in texts]
    for k in range(0, 200, 3):
        assert _ids(small, texts[k : k + 3]) == [want(t) for t in texts[k : k + 3]]


def test_added_tokens_are_the_library_ids(spark):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["first part.<|endoftext|>second part", "<|endoftext|>", " <|endoftext|> \n<|endoftext|><|endoftext|>x", "no <|endoftext| >", "<|endoftext|", "ends so <|endoftext|>", ""]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [11085, 636, 13, 50256, 12227, 636]
    assert _ids(tokens.encoder(P.path("byte_bpe_50k.json")), texts) == want
    rows = packing.pack_documents(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], SCHEMA), queries.JSON).collect()
    assert {r.doc_id: r.doc_tokens for r in rows} == {k: len(w) + 1 for k, w in enumerate(want)}


def test_bpe_is_tiktoken():
    coder = bpe.of(P.path("byte_bpe_50k.tiktoken"))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    assert bpe.PATTERN == P.PATTERN
    assert sorted(coder.hash.slot(k) for k in ranks) == list(range(len(ranks)))
    assert coder.found(b"nota vocabulary entry") == -1
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*_texts(), "a <|endoftext|> b", "abcde" * 2000]
    got, bounds = coder.encode(pa.array(texts))
    data, ends = coder.decode(got, bounds)
    for k, text in enumerate(texts):
        assert got[bounds[k] : bounds[k + 1]].tolist() == library.encode_ordinary(text), repr(text)
        assert data[ends[k] : ends[k + 1]].tobytes() == text.encode()


def test_op8(spark, tmp_path):
    spark.createDataFrame(ODD, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    want = _library()
    got = sorted(((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op8_byte_bpe(spark, str(tmp_path)).collect()))
    digest = lambda b: hashlib.sha256(b).hexdigest()
    assert got == sorted((d or 0, len(want(t)), digest(np.array(want(t), "<u4").tobytes()), digest((t or "").encode())) for d, t in ODD)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50256), st.integers(0, 2**64 - 1)), max_size=2500), st.integers(1, 200))
def test_simple8b_round_trip(ids, step):
    array = np.array(ids, dtype=np.uint64)
    words, starts = simple8b.encode_blocks(array)
    assert (simple8b.decode_blocks(words, starts, len(array)) == array).all()
    sink = io.BytesIO()
    writer = simple8b.Writer(sink)
    for at in range(0, len(array), step):
        writer.add(at, array[at : at + step])
    writer.add(None, array[:0])
    writer.close()
    reader = simple8b.Reader(sink)
    got = list(reader.documents())
    assert got[-1][0] is None and (np.concatenate([x for _, x in got]) == array).all()
    for k in range(len(reader.starts)):  # any block by itself
        assert (reader.ids(k, k + 1) == array[k * simple8b.BLOCK : (k + 1) * simple8b.BLOCK]).all()


def test_simple8b_runs_are_short():
    words, _ = simple8b.encode_blocks(np.zeros(1024, dtype=np.uint64))
    assert len(words) == 1


def test_cut_file_is_refused():
    sink = io.BytesIO()
    writer = simple8b.Writer(sink)
    writer.add(1, np.arange(5, dtype=np.uint64))
    writer.close()
    try:
        simple8b.Reader(io.BytesIO(sink.getvalue()[:-3]))
    except ValueError:
        return
    raise AssertionError


def test_op5(spark, tmp_path):
    spark.createDataFrame(ODD, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    want, start, rows = _library(), 0, []
    for d, t in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*want(t), 0], "<u4")
        rows.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = [tuple(r) for r in queries.op5_token_output(spark, str(tmp_path)).collect()]
    assert sorted(got, key=lambda r: r[1]) == rows


def _check_packing(rows, docs, want):
    held, seen = {}, {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
        seen.setdefault(r.doc_id, []).append(r)
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    for d in {d for d, _ in docs}:
        mine = sorted((np.array([*want(t), 0], "<u4") for x, t in docs if x == d), key=len)
        pieces = sorted(seen[d], key=lambda r: r.start)
        assert sum(r.length for r in pieces) == sum(map(len, mine))
        for r in pieces:
            assert any(len(ids) == r.doc_tokens and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for ids in mine)
    return sum(length for p in held.values() for _, length in p), len(held)


def test_op1(spark, tmp_path):
    spark.createDataFrame(ODD, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op1_packing(spark, str(tmp_path)).collect()
    _check_packing(rows, ODD, _library())
    packed = packing.pack_documents(spark.createDataFrame(ODD, SCHEMA), queries.JSON)
    whole = packing.sequences(packed).collect()
    assert sum(len(r.ids) for r in whole) == 4 * sum(r.length for r in rows)


def test_cut_is_sent_small_batches(spark, monkeypatch):
    limit, write = "spark.sql.execution.arrow.maxBytesPerBatch", shared.written
    before = spark.conf.get(limit)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "size"])

    sent = []

    def written(df, what):
        if what == "pieces":
            sent.extend(texts.mapInArrow(sizes, "rows long, size long").collect())
        return write(df, what)

    monkeypatch.setattr(shared, "written", written)
    texts = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("abcd efghi"), 500).alias("text"))
    for own, most in ((None, shared.SENT_BYTES), ("1m", 1 << 20)):
        if own:
            spark.conf.set(limit, own)
        try:
            sent.clear()
            got = packing.cut(texts, queries.JSON)
            assert spark.conf.get(limit) == (own or before)
        finally:
            spark.conf.set(limit, before)
        assert sum(r.rows for r in sent) == 3000 and max(r.size for r in sent) < most + 10_000
        assert got.select("doc_id").distinct().count() == 3000


def test_op1_pads_little(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack_documents(docs, queries.JSON).select("sequence_id", "length").collect()
    used, n = sum(r.length for r in rows), len({r.sequence_id for r in rows})
    assert used / (n * packing.CAPACITY) > 0.97


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 50), max_size=40))
def test_plan_places_every_piece_once(histogram):
    runs, n = packing.plan(histogram, 64)
    fill = [[] for _ in range(n)]
    for length, count in histogram.items():
        ranks = []
        for r in (r for r in runs if r.length == length):
            for c in range(r.copies):
                for k in range(r.count):
                    ranks.append(r.rank + c * r.count + k)
                    fill[r.sequence + k].append((r.offset + c * length, length))
        assert sorted(ranks) == list(range(count))
    for held in fill:
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert 0 < at <= 64
    # patterns are longest first, each length into the emptiest: at most one sequence may be under half full
    assert sum(sum(x for _, x in h) <= 32 for h in fill) <= 1


def _reference_lzw(data, size, most):
    clear, bits, at, width, table, before, out = 1 << size, int.from_bytes(data, "little"), 0, size + 1, None, None, bytearray()
    while at + width <= 8 * len(data):
        code = bits >> at & ((1 << width) - 1)
        at += width
        if code == clear:
            table, width, before = [bytes([i]) for i in range(clear)] + [b"", b""], size + 1, None
            continue
        if code == clear + 1:
            break
        entry = table[code] if code < len(table) else before + before[:1]
        out += entry
        if before is not None and len(table) < 4096:
            table.append(before + entry[:1])
            if len(table) == 1 << width and width < 12:
                width += 1
        before = entry
    return bytes(out[:most])


def test_lzw_against_a_plain_decoder():
    rng = np.random.default_rng(0)
    for n in (1, 2, 64, 3000, 20000):
        for high in (1, 2, 7, 256):
            data = rng.integers(0, high, n, dtype=np.uint8).tobytes()
            stream = gif.lzw_encode(data)
            assert _reference_lzw(stream, 8, n) == data == gif.lzw_decode(stream, 8, n).tobytes()


def _deferred_lzw(data, size=8, clear_at=None):
    """A stream whose full table is kept; with `clear_at`, it is cleared after so many codes."""
    clear, out, n = 1 << size, [(1 << size, size + 1)], 0
    table, width, held = {bytes([i]): i for i in range(clear)}, size + 1, b""
    for c in data:
        if held + bytes([c]) in table:
            held += bytes([c])
            continue
        out.append((table[held], width))
        n += 1
        if len(table) + 2 < 4096:
            table[held + bytes([c])] = len(table) + 2
            width = min(12, max(width, (len(table) + 1).bit_length()))
        held = bytes([c])
        if n == clear_at:
            out += [(table[held], width), (clear, width)]
            table, width, held = {bytes([i]): i for i in range(clear)}, size + 1, b""
    out += [(table[held], width)] * bool(held) + [(clear + 1, width)]
    value, at = 0, 0
    for code, w in out:
        value |= code << at
        at += w
    return value.to_bytes(-(-at // 8), "little")


def test_lzw_with_a_deferred_clear():
    data = np.random.default_rng(1).integers(0, 256, 30_000, dtype=np.uint8).tobytes()
    for clear_at in (None, 4608, 9000):
        stream = _deferred_lzw(data, clear_at=clear_at)
        assert _reference_lzw(stream, 8, len(data)) == data
        assert gif.lzw_decode(stream, 8, len(data)).tobytes() == data
        assert gif.lzw_decode(stream, 8, 20_000).tobytes() == data[:20_000]


def test_gif_frames():
    red_green = bytes([255, 0, 0, 0, 255, 0] + [0] * 762)
    a, b = np.zeros((2, 2), np.uint8), np.array([[1, 0], [0, 1]], np.uint8)
    data = bytearray(gif.write([a, b], red_green, 250, 1))
    width, height, found, status = gif.parse(bytes(data))
    assert (width, height, status, len(found), found[1].delay_ms) == (2, 2, "ok", 2, 250)
    found[1].transparent = 0
    shown = [c.copy() for c in gif.composed(width, height, found)]
    assert shown[1][0, 0].tolist() == [0, 255, 0, 255] and shown[1][0, 1].tolist() == [255, 0, 0, 255]
    found[0].disposal = 2
    assert [c.copy() for c in gif.composed(width, height, found)][1][0, 1].tolist() == [0, 0, 0, 0]
    found[0].disposal = 3
    assert [c.copy() for c in gif.composed(width, height, found)][1][0, 1, 3] == 0
    assert sum(gif.histogram(shown[0])) == 4


def test_gif_odd_files(spark):
    good = gif.stored(gif.payload("x" * 100)[0])
    rows = [(1, good), (2, None), (3, b""), (4, b"GIF89a"), (5, good[:-20]), (6, b"\x89PNG"), (7, good)]
    got = {r.media_id: r for r in gif.frames(spark.createDataFrame(rows, "k long, g binary"), "k", "g").collect()}
    assert got[1].status == "ok" and got[1].rgba == got[7].rgba and len(got[1].histogram) == 65
    assert all(got[k].status.startswith("error") and got[k].frame is None for k in (2, 3, 4, 5, 6))


def test_op3(spark, tmp_path):
    docs = [*ODD, (8, "long " * 30_000)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.n_bytes): r for r in queries.op3_gif(spark, str(tmp_path)).collect()}
    for d, t in docs:
        raw = (t or "").encode()
        data = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[d, len(raw)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        assert r.media_sha256 == hashlib.sha256(gif.stored(data)).hexdigest()


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).collect() == [], name
