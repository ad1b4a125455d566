"""Document fingerprints: a Merkle tree over sections, paragraphs and sentences. DataFrame functions only.

Sections end at a blank line, paragraphs at a line's end, and a paragraph's leaves at a sentence's end; every part keeps
its terminator, so the parts joined are the text. A leaf is hashed with XXH64, a paragraph's node from its leaves', a
section's from its paragraphs' nodes, and the root (SHA-256) from the sections' nodes and the number of code points: roots
test equality, and two trees are walked from the root down by nodes alone to the paragraphs that differ.

The likeness of two fingerprints is Dice's measure over their sets of leaves: 1 where the trees are equal, 0 where they
share no leaf.

Results for odd input: a null text is an empty one, whose tree has a root only; two empty texts have likeness 1; a null
doc_id comes last in descending order, and rows with one doc_id follow each other by text; a single row is its own next
document; an empty table gives none; columns other than the two named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proselens.llm import shared

#: After a blank line; after a line's end; after a sentence's end and its space. All keep what they split after.
SECTION, PARAGRAPH, LEAF = r"(?<=\n\n)(?!\n)", r"(?<=\n)", r"(?<=[.!?|;:] )"


def _parts(text: Column, pattern: str) -> Column:
    return F.filter(F.split(text, pattern, -1), lambda x: x != "")


def tree(text: Column) -> Column:
    """The tree below the root: array<struct<node, paragraphs: array<struct<node, leaves: array<long>>>>>."""

    def paragraph(p: Column) -> Column:
        made = F.transform(_parts(p, LEAF), lambda x: F.xxhash64(x))
        return F.transform(F.array(made), lambda leaves: F.struct(F.xxhash64(leaves).alias("node"), leaves.alias("leaves")))[0]

    def section(s: Column) -> Column:
        made = F.transform(_parts(s, PARAGRAPH), paragraph)
        return F.transform(F.array(made), lambda ps: F.struct(F.xxhash64(F.transform(ps, lambda p: p["node"])).alias("node"), ps.alias("paragraphs")))[0]

    return F.transform(_parts(text, SECTION), section)


def root(made: Column, n_chars: Column) -> Column:
    """64 hexadecimal digits that stand for the whole text, made from the sections' nodes and the length."""
    return F.sha2(F.concat_ws("|", n_chars.cast("string"), F.array_join(F.transform(made, lambda s: s["node"].cast("string")), ",")), 256)


def leaves(made: Column) -> Column:
    return F.array_distinct(F.flatten(F.flatten(F.transform(made, lambda s: F.transform(s["paragraphs"], lambda p: p["leaves"])))))


def likeness(a: Column, b: Column) -> Column:
    """Dice's measure of two sets of leaves."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def differing(a: Column, b: Column) -> Column:
    """Where two trees differ, from the root down by nodes alone: array<struct<section, paragraph>> by position, counted
    from 0. A section whose node equals its counterpart's isn't entered."""
    nowhere = F.array().cast("array<int>")
    places = lambda x, y: F.when(F.greatest(F.size(x), F.size(y)) > 0, F.sequence(F.lit(0), F.greatest(F.size(x), F.size(y)) - 1)).otherwise(nowhere)
    apart = lambda x, y: ~x["node"].eqNullSafe(y["node"])
    none = F.array().cast("array<struct<node:bigint,leaves:array<bigint>>>")

    def inside(i: Column) -> Column:
        x, y = (F.coalesce(F.get(t, i)["paragraphs"], none) for t in (a, b))
        return F.transform(F.filter(places(x, y), lambda j: apart(F.get(x, j), F.get(y, j))), lambda j: F.struct(i.alias("section"), j.alias("paragraph")))

    return F.flatten(F.transform(F.filter(places(a, b), lambda i: apart(F.get(a, i), F.get(b, i))), inside))


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_chars, tree, fingerprint of every row."""
    made = shared.id_text(docs).withColumn("n_chars", F.length("text").cast("long")).withColumn("tree", tree(F.col("text")))
    return made.withColumn("fingerprint", root(F.col("tree"), F.col("n_chars")))


def _below(bounds: list[int], x: Column) -> Column:
    """How many of the sorted `bounds` are less than `x`, by two short scans."""
    if not bounds:
        return F.lit(0)
    k = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + k] for i in range(0, len(bounds), k)]
    group = F.greatest(F.size(F.filter(F.array(*[F.lit(g[0]) for g in groups]), lambda b: b < x)) - 1, F.lit(0))
    held = F.get(F.array(*[F.array(*map(F.lit, g)) for g in groups]), group)
    return group * k + F.size(F.filter(held, lambda b: b < x))


#: Ranges by rows that are weighed by bytes, for each range of the result.
FINE = 8


def _ranges(rows: DataFrame, n: int) -> tuple[list[int], dict[int, int | None]]:
    """Upper bounds of up to `n` ranges of doc_id with about as many bytes each, and the largest id of each range (range 0
    holds the largest ids; rows without one are the last). At most FINE * n rows reach the driver."""
    fine = sorted(set(rows.agg(F.percentile_approx("doc_id", [k / (FINE * n) for k in range(1, FINE * n)], max(10_000, 4 * FINE * n))).first()[0] or []))
    weighed = rows.where("doc_id is not null").groupBy(_below(fine, F.col("doc_id")).alias("k")).agg(F.sum(F.octet_length("text") + 64).alias("bytes"), F.max("doc_id").alias("most")).orderBy("k").collect()
    share = sum(r.bytes for r in weighed) / n
    bounds, held = [], 0
    for r, after in zip(weighed, weighed[1:]):
        held += r.bytes
        if held + after.bytes / 2 > share:
            bounds.append(fine[r.k])
            held = 0
    heads: dict[int, int | None] = {}
    for r in weighed:
        at = len(bounds) - sum(x < r.most for x in bounds)
        heads[at] = max(heads.get(at, r.most), r.most)
    return bounds, heads


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and next_text: the text of the next row in descending doc_id; the first one follows the last.

    The ids are cut into ranges of about as many bytes, one a task. The texts then move once, to the task of their range; a
    range is also sent the first row of the range after it, as a guest at its end, so that each row's next one is in its own
    range. Rows of one doc_id, and those without one, are one range's: ids are taken to be few to a value.
    """
    spark = docs.sparkSession
    rows = shared.id_text(docs)
    bounds, heads = _ranges(rows, shared.partitions(spark))
    last = len(bounds) + 1
    of = F.when(F.col("doc_id").isNull(), F.lit(last)).otherwise(F.lit(len(bounds)) - _below(bounds, F.col("doc_id"))).cast("int")
    if not rows.where("doc_id is null").isEmpty():
        heads[last] = None
    if not heads:
        return rows.withColumn("next_text", F.col("text"))
    own = rows.select(of.alias("_to"), F.lit(False).alias("_guest"), "doc_id", "text")
    used = sorted(heads)
    before = {k: used[i - 1] for i, k in enumerate(used)}
    at = spark.createDataFrame([(heads[k], before[k]) for k in used], "head long, to int")  # a row a range
    first = rows.join(F.broadcast(at), F.col("doc_id").eqNullSafe(F.col("head"))).select(F.col("to").alias("_to"), F.lit(True).alias("_guest"), "doc_id", "text")
    guests = first.groupBy("_to", "_guest", "doc_id").agg(F.max("text").alias("text"))
    placed = own.unionByName(guests).repartitionById(last + 1, F.col("_to"))
    order = [F.col("_guest"), F.col("doc_id").desc_nulls_last(), F.col("text").desc()]
    led = placed.withColumn("next_text", F.lead("text").over(Window.partitionBy("_to").orderBy(*order)))
    return led.where("not _guest").select("doc_id", "text", "next_text")


def edited(text: Column, other: Column) -> Column:
    """`text` with its last floor(n / 2) code points replaced by the first as many (or all) of `other`."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(other, F.lit(1), half))


def compared(docs: DataFrame) -> DataFrame:
    """Per row: fingerprints of the text and of its edited form, and their likeness to each other and to the next text's."""
    rows = with_next(docs).select("doc_id", F.length("text").cast("long").alias("n_chars"), tree(F.col("text")).alias("tree"), edited(F.col("text"), F.col("next_text")).alias("edited"), leaves(tree(F.col("next_text"))).alias("next_leaves"))
    rows = rows.withColumn("edited_tree", tree(F.col("edited"))).withColumn("leaves", leaves(F.col("tree")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        root(F.col("tree"), F.col("n_chars")).alias("fingerprint"),
        root(F.col("edited_tree"), F.length("edited")).alias("edited_fingerprint"),
        likeness(F.col("leaves"), leaves(F.col("edited_tree"))).alias("near_edited"),
        likeness(F.col("leaves"), F.col("next_leaves")).alias("near_next"),
        differing(F.col("tree"), F.col("edited_tree")).alias("differing"),
    )
