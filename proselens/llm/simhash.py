"""SimHash near-duplicates by tiled exact comparison.

Fingerprints: every shingle's XXH64 votes on every bit. Rows with one fingerprint are one class, counted before anything
moves. Classes are compared in tiles with numpy's exclusive-or and bit counts. A tile is the classes whose population
counts, taken lane by lane (a lane is an equal part of the bits), are the same: two fingerprints that differ in `radius`
bits at most have lane counts that differ by `radius` at most in sum, so tile pairs beyond that are skipped, none other.
Wide fingerprints with a wide radius, for which population counts skip little, are tiled by bands of minimum hashes of
their shingles instead, so that only texts which share much are compared (`similar_links`).

A tile is split into blocks of a bounded size; the visitors of a block stream past it. The links that a block and a
batch of visitors give are thinned to a spanning forest before they leave the task. Components come from repeated
min-label rounds over the links, with each round written to the shared folder.

Results for odd input: a null or empty text (no words) has fingerprint zero and is linked like any other; fewer words
than a shingle has are one shingle; repeated rows have the same fingerprint and component; a null doc_id never names a
component unless the component has no other; an empty table gives none; columns other than the two named are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proselens.llm import shared, tokens

_WORDS = re.compile(rb"[^\x20\x09-\x0d]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Classes in a block of a tile.
BLOCK = 1 << 16
#: Classes from which a finer division into lanes is used, so that tiles stay small.
FINER = 1 << 25


def shingles(text: str, words: int) -> list[bytes]:
    found = _WORDS.findall(text.encode("utf-8", "surrogatepass").translate(_LOWER))
    if not found:
        return []
    if len(found) <= words:
        return [b" ".join(found)]
    return [b" ".join(x) for x in zip(*(found[i:] for i in range(words)))]


def hashed(grams: list[bytes]) -> np.ndarray:
    """Every shingle's XXH64."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(g, 42) for g in grams], dtype=np.uint64, count=len(grams))


def voted(h: np.ndarray, parts: int = 1) -> np.ndarray:
    """`parts` words of 64 bits, each bit set where over half of the hashes have it. Part k > 0 votes with hashes mixed from
    the first."""
    out = np.zeros(parts, dtype=np.uint64)
    for k in range(parts if len(h) else 0):
        x = h if not k else mixed(h, k)
        # bits of many hashes at a time: 64 counts, summed in slices that stay small
        votes = np.zeros(64, dtype=np.int64)
        for at in range(0, len(x), 1 << 14):
            votes += np.unpackbits(x[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(votes * 2 > len(h), bitorder="little").view(np.uint64)[0]
    return out


def fingerprint(text: str, words: int, parts: int = 1, repeats: bool = True) -> tuple[np.ndarray, int]:
    """The text's bits, and the number of its distinct shingles. Without `repeats` a shingle votes once however often it
    occurs."""
    h = hashed(shingles(text, words))
    distinct = np.unique(h)
    return voted(h if repeats else distinct, parts), len(distinct)


#: Bands of minimum hashes, and hashes in one: two texts that share 0.8 of their shingles miss each other in all bands 7
#: times in 10^5; at 0.85 less than once in 10^6; at 0.1 they meet in one 2 times in 10^4.
BANDS, IN_BAND = 24, 5
_ODD = (np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, BANDS * IN_BAND, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def bands(distinct: np.ndarray) -> np.ndarray:
    """A key for each band: a hash of its minimum hashes."""
    least = np.full(len(_ODD), np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(distinct), 512):
            np.minimum(least, (distinct[at : at + 512, None] * _ODD).min(axis=0), out=least)
        key = np.arange(1, BANDS + 1, dtype=np.uint64)
        for k in range(IN_BAND):
            key = mixed(key ^ least[k::IN_BAND], k + 1)
    return key


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Another 64-bit hash of each: the finaliser of a well-known generator, seeded by k."""
    with np.errstate(over="ignore"):
        x = h + np.uint64(0x9E3779B97F4A7C15) * np.uint64(k)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, words: int = 3, parts: int = 1, id_col: str = "doc_id") -> DataFrame:
    """doc_id, fp (bytes, little-endian), size (distinct shingles) of every row."""

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in tokens.in_bytes(texts, 1 << 22):
                got = [fingerprint(t, words, parts) for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array([f.astype("<u8").tobytes() for f, _ in got], pa.binary()), pa.array([n for _, n in got], pa.int64())], names=["doc_id", "fp", "size"])

    return shared.id_text(docs, id_col).mapInArrow(rows, "doc_id long, fp binary, size long")


def set_prints(rows: DataFrame, words: int, parts: int, most: int) -> DataFrame:
    """For `rows` (r, doc_id, text): r, doc_id, size (distinct shingles), fp and h. fp is the fingerprint of the set of
    shingles, of which each votes once, then 16 bytes that tell different sets apart, then the keys of the bands; h are the
    shingles' hashes in order, where they are `most` or fewer."""

    def made(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in tokens.in_bytes(texts, 1 << 22):
                sets = [np.unique(hashed(shingles(t, words))) for t in texts[a:b]]
                fps = [voted(h, parts).astype("<u8").tobytes() + hashlib.blake2b(h.tobytes(), digest_size=16).digest() + bands(h).astype("<u8").tobytes() for h in sets]
                few = [h.astype("<u8").tobytes() if len(h) <= most else None for h in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([len(h) for h in sets], pa.int64()), pa.array(fps, pa.binary()), pa.array(few, pa.binary())], names=["r", "doc_id", "size", "fp", "h"])

    return rows.mapInArrow(made, "r long, doc_id long, size long, fp binary, h binary")


def lane_keys(fp: np.ndarray, lanes: int) -> np.ndarray:
    """Population count of each lane of each row: (n, lanes)."""
    return np.unpackbits(np.ascontiguousarray(fp).view(np.uint8), axis=1).reshape(len(fp), lanes, -1).sum(axis=2, dtype=np.int64)


def offsets(lanes: int, radius: int) -> np.ndarray:
    """The vectors of lane differences within the radius that are zero or whose first non-zero entry is positive."""
    out = [(0,) * lanes]
    for k in range(1, min(radius, lanes) + 1):
        for where in itertools.combinations(range(lanes), k):
            for by in itertools.product(*[range(-radius, radius + 1)] * k):
                if by[0] > 0 and all(by) and sum(map(abs, by)) <= radius:
                    v = [0] * lanes
                    for w, b in zip(where, by):
                        v[w] = b
                    out.append(tuple(v))
    return np.array(out, dtype=np.int64)


def _near_by_tile(home: np.ndarray, guest: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows that differ in `radius` bits at most, tile by tile. Rows are taken in the order of their
    population counts, and tile pairs whose counts are further apart than the radius are skipped."""
    step_a, step_b = 512, 2048
    parts = home.shape[1]
    sorted_by = [(order, x[order], pop[order]) for x in (home, guest) for pop in (np.bitwise_count(x).sum(axis=1, dtype=np.int64),) for order in (np.argsort(pop, kind="stable"),)]
    (order_a, xs, pops_a), (order_b, ys, pops_b) = sorted_by
    for a in range(0, len(home), step_a):
        x, low, high = xs[a : a + step_a], pops_a[a], pops_a[min(a + step_a, len(xs)) - 1]
        first, last = np.searchsorted(pops_b, low - radius), np.searchsorted(pops_b, high + radius, side="right")
        for b in range(int(first), int(last), step_b):
            y = ys[b : min(b + step_b, int(last))]
            apart = np.bitwise_count(x[:, None, 0] ^ y[None, :, 0])
            for k in range(1, min(parts, 3)):  # most pairs are beyond the radius by three parts already
                apart = apart + np.bitwise_count(x[:, None, k] ^ y[None, :, k])
            i, j = np.nonzero(apart <= radius)
            if parts > 3 and len(i):
                rest = apart[i, j].astype(np.int64)
                for k in range(3, parts):
                    rest += np.bitwise_count(x[i, k] ^ y[j, k])
                i, j = i[rest <= radius], j[rest <= radius]
            if len(i):
                yield order_a[i + a], order_b[j + b]


def _near(home: np.ndarray, guest: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of `_near_by_tile`."""
    found = [*_near_by_tile(home, guest, radius)]
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which of the links (a, b) over n nodes make a spanning forest."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    keep = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = find(x), find(y)
        if x != y:
            root[y] = x
            keep.append(k)
    return np.array(keep, dtype=np.int64)


def links(classes: DataFrame, n: int, radius: int, parts: int = 1) -> DataFrame:
    """Links (a, b) between the fingerprints of `classes` (fp; distinct) that keep all components."""
    spark = classes.sparkSession
    lanes = 4 if n < FINER or parts > 1 else 8
    moves = offsets(lanes, radius)
    words = parts
    weight = np.array([33 ** k for k in range(lanes)], dtype=np.int64)

    def spread(batches):
        """Each class at home in its tile's block, and as a visitor to the blocks it must be compared with."""
        import pyarrow as pa

        for batch in batches:
            raw = batch.column(0).to_pylist()
            if not raw:
                continue
            fp = np.frombuffer(b"".join(raw), "<u8").reshape(-1, words)
            blocks = tile_blocks.value
            home_block = mixed(fp[:, 0], 77)
            own = lane_keys(fp, lanes)
            tiles, home = [], own @ weight
            for move in moves:
                to = own + move
                inside = (to >= 0).all(axis=1) & (to <= 64 * parts // lanes).all(axis=1)
                tiles.append((np.flatnonzero(inside), (to @ weight)[inside]))
            counts = np.array([blocks.get(int(t), 1) for t in home], dtype=np.uint64)
            own_block = (home_block % counts).astype(np.int64)
            at, tile, block, guest = [np.arange(len(fp))], [home], [own_block], [np.zeros(len(fp), dtype=bool)]
            for k, (rows, to) in enumerate(tiles):
                if k and len(rows):  # a tile with no class of its own needs no visitors
                    known = np.fromiter((int(t) in blocks for t in to), dtype=bool, count=len(to))
                    rows, to = rows[known], to[known]
                n_blocks = np.fromiter((blocks.get(int(t), 1) for t in to), dtype=np.int64, count=len(to))
                at.append(np.repeat(rows, n_blocks))
                tile.append(np.repeat(to, n_blocks))
                block.append(np.concatenate([np.arange(x) for x in n_blocks]) if len(n_blocks) else n_blocks)
                guest.append(np.ones(int(n_blocks.sum()), dtype=bool))
                if not k:  # within the own tile, only blocks up to the own one
                    ok = block[-1] <= own_block[at[-1]]
                    at[-1], tile[-1], block[-1], guest[-1] = at[-1][ok], tile[-1][ok], block[-1][ok], guest[-1][ok]
            at, tile, block, guest = map(np.concatenate, (at, tile, block, guest))
            for s in range(0, len(at), 1 << 16):
                e = s + (1 << 16)
                yield pa.RecordBatch.from_arrays([pa.array(tile[s:e]), pa.array(block[s:e]), pa.array(guest[s:e]), pa.array([raw[i] for i in at[s:e].tolist()], pa.binary())], names=["tile", "block", "guest", "fp"])

    def compare(batches):
        import pyarrow as pa

        key, home = None, np.zeros((0, words), dtype=np.uint64)
        for batch in batches:
            tile, block, guest = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            fp = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<u8").reshape(-1, words)
            cuts = np.flatnonzero((np.diff(tile) != 0) | (np.diff(block) != 0)) + 1
            a_out, b_out = [], []
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(tile)]):
                if s == e:
                    continue
                if (tile[s], block[s]) != key:
                    key, home = (tile[s], block[s]), np.zeros((0, words), dtype=np.uint64)
                split = s + int(np.searchsorted(guest[s:e], True))
                if split > s:
                    home = np.concatenate([home, fp[s:split]])
                guests = fp[split:e]
                if len(guests):
                    i, j = _near(home, guests, radius)
                    if len(i):
                        nodes, back = np.unique(np.concatenate([home[i], guests[j]]), axis=0, return_inverse=True)
                        back = back.reshape(-1)
                        x, y = back[: len(i)], back[len(i) :]
                        keep = _forest(x, y, len(nodes))
                        a_out.append(nodes[x[keep]])
                        b_out.append(nodes[y[keep]])
            if a_out:
                a, b = np.concatenate(a_out), np.concatenate(b_out)
                cells = [[r.tobytes() for r in m.astype("<u8")] for m in (a, b)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in cells], names=["a", "b"])

    # blocks of each tile, from its exact count: the tiles are as many as lane counts allow
    tile_of = F.lit(0).cast("long")
    lane_bits = 64 * parts // lanes
    hexed = F.hex("fp")
    for k in range(lanes):
        lane = F.conv(F.substring(hexed, k * lane_bits // 4 + 1, lane_bits // 4), 16, 10).cast("long")
        tile_of = tile_of + F.lit(int(weight[k])) * F.bit_count(lane)
    per_tile = classes.groupBy(tile_of.alias("tile")).agg(F.count(F.lit(1)).alias("n"))
    tile_blocks = spark.sparkContext.broadcast({r.tile: max(1, -(-r.n // BLOCK)) for r in per_tile.collect()})
    placed = classes.select("fp").mapInArrow(spread, "tile long, block long, guest boolean, fp binary")
    sorted_ = placed.repartition(max(shared.partitions(spark), 1), "tile", "block").sortWithinPartitions("tile", "block", "guest")
    return sorted_.mapInArrow(compare, "a binary, b binary").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of the links, the least node that it reaches. Alternates two kinds of rounds:
    every node's larger neighbours are given its least neighbour, then its smaller ones are; it ends when every node has one
    parent and no parent has one. A round's table is deleted once the next is written."""
    spark = edges.sparkSession
    pairs, path = shared.written_at(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u != v").distinct(), "links")
    while True:
        ends = pairs.select(F.col("v").alias("x"), F.lit(1).alias("as_v"), F.lit(0).alias("as_u")).unionByName(pairs.select(F.col("u").alias("x"), F.lit(0).alias("as_v"), F.lit(1).alias("as_u")))
        if ends.groupBy("x").agg(F.sum("as_v").alias("as_v"), F.max("as_u").alias("as_u")).where("as_v > 1 or (as_v > 0 and as_u > 0)").isEmpty():
            return pairs.select(F.col("v").alias("node"), F.col("u").alias("root"))
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u != v").distinct()
        small_least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(small_least, "v").select(F.col("m").alias("u"), F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"))
        before, (pairs, path) = path, shared.written_at(small.where("u != v").distinct(), "links")
        shared.removed(spark, before)


#: A fingerprint that holds more than this share of the rows is joined by broadcast: there are 1 / share of them at most.
HOT_SHARE = 1e-3


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, parts: int = 1, id_col: str = "doc_id") -> DataFrame:
    """Per row: doc_id, fp (bytes), size, component_id (the least doc_id that its links reach). A link is a radius."""
    prints = shared.written(fingerprints(docs, words, parts, id_col), "prints")
    classes = shared.written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.max("size").alias("size"), F.count(F.lit(1)).alias("n")), "classes")
    n, rows = classes.agg(F.count(F.lit(1)), F.sum("n")).first()
    linked = components(links(classes.select("fp"), n, radius, parts))
    of_root = classes.join(linked, classes["fp"] == linked["node"], "left").select(classes["fp"], "rep", "n", F.coalesce("root", "fp").alias("root"))
    named = shared.written(of_root.join(of_root.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("fp", "component_id", "n"), "named")
    # a fingerprint with a large share of all rows would be one task's; those few are sent to every task instead
    hot = named.where(F.col("n") > max(1, HOT_SHARE * (rows or 0))).select(F.col("fp").alias("hot_fp"), F.col("component_id").alias("hot_id"))
    marked = prints.join(F.broadcast(hot), prints["fp"] == hot["hot_fp"], "left")
    direct = marked.where("hot_fp is not null").select("doc_id", "fp", "size", F.col("hot_id").alias("component_id"))
    rest = marked.where("hot_fp is null").select("doc_id", "fp", "size").join(named.select("fp", "component_id"), "fp").select("doc_id", "fp", "size", "component_id")
    return direct.unionByName(rest)


#: For texts that share 0.8 of their distinct five-word shingles, two 256-bit fingerprints differ in 39 bits on average
#: (the angle between the sets), give or take 6; for half of them in 69; for none in 128. The radius only finds candidates:
#: every pair is then held against the shingles themselves. Of pairs at 0.8 with more than SHORT shingles, 2 in 10^9 differ
#: in more than 76 bits.
SIMILAR = {"words": 5, "parts": 4, "radius": 76, "similarity": 0.8}
#: Few shingles are few votes, and ties move more bits: pairs with a text of at most so many are found by the shingles. At
#: 0.8 they differ in 48 bits on average at most (4 shingles of 5), give or take 6; unrelated ones in 128, give or take 8.
SHORT, SHORT_RADIUS = 64, 108
#: Classes that the members of a tile are first held against, at most; what they leave is compared in full.
LEADERS = 64


def short_keys(sets: DataFrame, similarity: float) -> DataFrame:
    """(r, key) of `sets` (r, h): any pair of the similarity has a key in common. Shingles are ordered by how many texts have
    them, rarest first: two sets that share a part s of their shingles share one of the first n - ceil(s n) + 1 of each."""
    least = Fraction(str(similarity))

    def listed(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.frombuffer(h, "<u8").astype(np.int64) for h in batch.column(1).to_pylist()], pa.list_(pa.int64()))], names=["r", "shingles"])

    told = sets.mapInArrow(listed, "r long, shingles array<long>")
    each = told.select("r", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("s"))
    common = each.groupBy("s").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    ranked = each.join(common, "s", "left").groupBy("r", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("texts", F.lit(1)).alias("texts"), "s"))).alias("ranked"))
    needed = F.floor((F.col("n") * least.numerator + least.denominator - 1) / least.denominator)
    first = ranked.select("r", F.explode(F.slice("ranked", F.lit(1), (F.col("n") - needed + 1).cast("int"))).alias("e")).where("e.texts > 1")
    return first.select("r", F.xxhash64(F.lit("shingle"), F.col("e.s")).alias("key"))


def tile_members(classes: DataFrame, few: DataFrame, parts: int, similarity: float) -> DataFrame:
    """(key, short, n, r, size, fp) of the tiles that have two classes or more: a tile is a band's key, among classes of more
    than SHORT shingles, or one of the rarest shingles, among shorter ones."""
    at = 8 * parts + 16
    long_keys = classes.where(F.col("size") > SHORT).select("r", F.explode(F.array(*[F.xxhash64(F.lit(k), F.substring("fp", at + 8 * k + 1, 8)) for k in range(BANDS)])).alias("key")).withColumn("short", F.lit(False))
    keys = shared.written(long_keys.unionByName(short_keys(few, similarity).withColumn("short", F.lit(True))), "keys")
    met = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return keys.join(met, "key").join(classes.select("r", "size", F.substring("fp", 1, 8 * parts).alias("fp")), "r").select("key", "short", "n", "r", "size", "fp")


def _groups_of(batches, parts: int):
    """Runs of one (key, block) in sorted batches: (key, short, guest, r, size, comp, fp); a group may come in several."""
    for batch in batches:
        key, block, short, guest, r, size, comp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(7))
        fp = np.frombuffer(b"".join(batch.column(7).to_pylist()), "<u8").reshape(-1, parts)
        cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(block) != 0) | (np.diff(guest.astype(np.int8)) != 0)) + 1
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
            if e > s:
                yield (int(key[s]), int(block[s])), bool(short[s]), bool(guest[s]), r[s:e], size[s:e], comp[s:e], fp[s:e]


def _sizes_allow(x: np.ndarray, y: np.ndarray, least: Fraction) -> np.ndarray:
    return np.minimum(x, y) * least.denominator >= np.maximum(x, y) * least.numerator


def candidates(members: DataFrame, parts: int, radius: int, similarity: float, first: bool) -> DataFrame:
    """Pairs (a, b), a < b, of `members` (key, short, n, r, size, fp, comp). `first`: each member with a leader of its tile,
    so that a group of copies is linked by about as many pairs as it has members. Else all pairs of different components
    that the sizes and the radius allow (SHORT_RADIUS in tiles of shorter texts).

    A tile of more than BLOCK members is cut into blocks, each of which is visited by the members of earlier ones; in the
    first pass, by the tile's least member alone."""
    spark, least = members.sparkSession, Fraction(str(similarity))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("r"), blocks).cast("int")
    placed = members.withColumn("blocks", blocks).withColumn("own", own)
    home = placed.select("key", F.col("own").alias("block"), "short", F.lit(False).alias("guest"), "r", "size", "comp", "fp")
    big = placed.where("blocks > 1")
    if first:
        lead = big.groupBy("key").agg(F.min("r").alias("r"))
        visits = big.join(lead, ["key", "r"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        order = ["key", "block", F.desc("guest"), "r"]
    else:
        visits = big.where("own > 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("own") - 1)))
        order = ["key", "block", "guest"]
    rows = home.unionByName(visits.select("key", "block", "short", F.lit(True).alias("guest"), "r", "size", "comp", "fp"))

    def found(a: np.ndarray, b: np.ndarray):
        import pyarrow as pa

        apart = a != b
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[apart]), pa.array(np.maximum(a, b)[apart])], names=["a", "b"])

    def led(batches):
        at, leaders = None, []
        for key, _, _, r, size, _, fp in _groups_of(batches, parts):
            if key != at:
                at, leaders = key, []
            left, k = np.arange(len(r)), 0
            while len(left):
                if k == len(leaders):
                    if k == LEADERS:
                        break
                    leaders.append((r[left[0]], size[left[0]], fp[left[0]]))
                number, n, bits = leaders[k]
                near = (np.bitwise_count(fp[left] ^ bits).sum(axis=1, dtype=np.int64) <= radius) & _sizes_allow(size[left], n, least)
                if near.any():
                    yield found(r[left[near]], np.full(int(near.sum()), number))
                left, k = left[~near], k + 1

    def all_pairs(x, y, short: bool, same: bool):
        limit = SHORT_RADIUS if short else radius
        for i, j in _near_by_tile(x[3], y[3], limit):
            ok = (x[2][i] != y[2][j]) & _sizes_allow(x[1][i], y[1][j], least)
            if same:
                ok &= i < j
            if ok.any():
                yield found(x[0][i[ok]], y[0][j[ok]])

    def compared(batches):
        at, held, short_ = None, None, False
        for key, short, guest, *row in _groups_of(batches, parts):
            if key != at:
                if held is not None and len(held[0]) > 1:
                    yield from all_pairs(held, held, short_, True)
                at, held, short_ = key, None, short
            if not guest:
                held = row if held is None else [np.concatenate([u, v]) for u, v in zip(held, row)]
            elif held is not None:
                yield from all_pairs(held, row, short, False)
        if held is not None and len(held[0]) > 1:
            yield from all_pairs(held, held, short_, True)

    sorted_ = rows.repartition(shared.partitions(spark), "key", "block").sortWithinPartitions(*order)
    return sorted_.mapInArrow(led if first else compared, "a long, b long").distinct()


def jaccard_links(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of `pairs` (a, b) whose `sets` (r, h: sorted 64-bit hashes of distinct shingles) have a Jaccard similarity of
    `similarity` at least."""
    least = Fraction(str(similarity))

    def true(batches):
        import pyarrow as pa

        last, x = None, np.zeros(0, dtype=np.uint64)
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            keep = []
            for k, i in enumerate(a.tolist()):
                if i != last:
                    last, x = i, np.frombuffer(batch.column(2)[k].as_py(), "<u8")
                y = np.frombuffer(batch.column(3)[k].as_py(), "<u8")
                both = int(np.intersect1d(x, y, assume_unique=True).size)
                if both * least.denominator >= (len(x) + len(y) - both) * least.numerator:
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    first, second = sets.select(F.col("r").alias("a"), F.col("h").alias("x")), sets.select(F.col("r").alias("b"), F.col("h").alias("y"))
    return pairs.join(second, "b").join(first, "a").select("a", "b", "x", "y").mapInArrow(true, "a long, b long")


def similar_links(classes: DataFrame, few: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between `classes` (r, size, fp of `set_prints`) that keep all components of the exact similarity. `few`
    (r, h) has the shingles of the classes with few of them, `texts` (r, text) all rows' texts.

    First the members of each tile are held against a few leaders; groups of copies become components by that, in about
    as many pairs as they have members. Then all pairs of different components are compared. Every pair of either pass is
    held against the shingles' sets."""
    words, parts, radius, similarity = (SIMILAR[k] for k in ("words", "parts", "radius", "similarity"))

    def sets_of(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.unique(hashed(shingles(t, words))).astype("<u8").tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["r", "h"])

    members = shared.written(tile_members(classes, few, parts, similarity), "members")
    met = members.select("r").distinct()
    passes = shared.sieve(met, "r")  # few texts share a tile: the others don't move
    # never by broadcast: a task that has both the sieve and the sets holds two Python workers, which stay and take turns
    sets = shared.written(texts.where(passes(F.col("r"))).join(met.hint("merge"), "r", "left_semi").select("r", "text").mapInArrow(sets_of, "r long, h binary"), "sets")
    led = shared.written(jaccard_links(candidates(members.withColumn("comp", F.col("r")), parts, radius, similarity, True), sets, similarity), "led")
    root = components(led)
    placed = members.join(root.select(F.col("node").alias("r"), "root"), "r", "left").withColumn("comp", F.coalesce("root", "r")).drop("root")
    rest = jaccard_links(candidates(placed, parts, radius, similarity, False), sets, similarity)
    return led.unionByName(rest)


def one_of_each(docs: DataFrame) -> DataFrame:
    """`docs` (with columns doc_id and text) without near-duplicates: of each group the row of least doc_id stays, as it
    is; rows without a doc_id come last, and rows that tie are told apart by their place in the input. Rows with one set of
    shingles are one class, whose number is its least row; classes are linked where the sets' similarity is high enough."""
    row, most = shared.free_name(docs, "row"), int(SHORT / Fraction(str(SIMILAR["similarity"])))
    fixed = shared.written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    texts = fixed.select(F.col(row).alias("r"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    prints = shared.written(set_prints(texts, SIMILAR["words"], SIMILAR["parts"], most), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("r"))).alias("first")
    classes = shared.written(prints.groupBy("fp").agg(F.min("r").alias("r"), F.max("size").alias("size"), first), "classes")
    few = prints.where("h is not null").select("r", "h").join(classes.select("r"), "r", "left_semi")
    linked = components(similar_links(classes.select("r", "size", "fp"), few, texts.select("r", "text")))
    group = F.coalesce("root", "r").alias("g")
    stays = shared.written(classes.join(linked, classes["r"] == linked["node"], "left").select(group, "first").groupBy("g").agg(F.min("first").alias("first")).select(F.col("first.r").alias(row)), "stays")
    goes = prints.select(F.col("r").alias(row)).join(stays, row, "left_anti")
    # most rows stay: those that the sieve doesn't hold back are kept where they are
    held = shared.sieve(goes, row)(F.col(row))
    return fixed.where(~held).unionByName(fixed.where(held).join(stays, row, "left_semi")).drop(row)


def as_hex(fp: str = "fp") -> Column:
    """A one-part fingerprint as 16 lowercase hex digits, most significant first."""
    h = F.lower(F.hex(fp))
    return F.concat(*[F.substring(h, 2 * k + 1, 2) for k in range(7, -1, -1)])
