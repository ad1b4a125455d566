"""Prose rules over documents(path, text) as DataFrame plans: each returns findings (code, path, line, col).

Lines, sentences and paragraphs are derived with SQL functions. A rule that looks at one line at a time needs no
exchange; a rule about a whole document works on arrays in its row; only paragraphs, sentence places and passages group
rows, by path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proselens.functions import lexicon as L
from proselens.functions.patterns import Panel, exact_java, java, phrase

NATLANGS = ("en", "pt")
HEADING = r"^ {0,3}#{1,6}\s+\S"
LIST_ITEM = r"^\s*(?:[-*+]|\d+[.)])\s+\S"
#: Lines that keep their block from being a paragraph.
NOT_PROSE = r"^ {0,3}#{1,6}\s+\S|^\s*(?:[-*+]|\d+[.)])\s+\S|^\s*\||\|.*\||^\s*(?:-{3,}|\*{3,}|_{3,})\s*$|^\s*<!--"
SENTENCE_END = r"""([.!?]+["')\]]*)\s+"""
EMOJI_LINE = r"^\s*(?:#{1,6}\s+|[-*+]\s+|\d+[.)]\s+)?[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"
REFERENCES = ("acknowledgements", "authors", "bibliography", "contact", "credits", "further reading", "licence", "license", "links", "references", "see also", "sources", "autores", "licença", "referências", "ver também")
DIFF_PATHS = r"(?:^|/)(?:CHANGELOG|HISTORY|MIGRATION|NEWS|RELEASE|UPGRADING)[^/]*$|(?:^|/)(?:changelog|release-notes|whatsnew)/"


def any_of(panels: dict[str, str] | str, natlangs=NATLANGS) -> str:
    """One pattern for a rule's panels of the enabled natural languages."""
    if isinstance(panels, str):
        return panels
    found = [panels[n] for n in natlangs if n in panels]
    if not found:
        return r"(?!)"
    return either(*found) if len(found) > 1 else found[0]


def either(*patterns: str) -> str:
    """One pattern for several; it has needles where all of them have."""
    made = "(?:" + "|".join(patterns) + ")"
    held = [getattr(p, "needles", frozenset()) for p in patterns]
    return Panel.of(made, frozenset().union(*held)) if all(held) else made


def has_any(text: Column, needles) -> Column:
    """Whether a text has one of the lower-case `needles` in any case. Letters whose lower case isn't the plain one that they
    also match count as a hit."""
    words = sorted(needles)
    return F.transform(F.array(F.lower(text)), lambda t: reduce(Column.__or__, [F.contains(t, F.lit(w)) for w in [*words, "\u017f", "\u0131", "\u0130"]]))[0]


def likely(docs: DataFrame, pattern: str) -> DataFrame:
    """`docs` without those that have none of the pattern's needles."""
    return docs.where(has_any(F.col("text"), pattern.needles)) if getattr(pattern, "needles", None) else docs


def lines(docs: DataFrame) -> DataFrame:
    """path, i (from 0), s."""
    return docs.select("path", F.posexplode(F.split("text", "\n", -1)).alias("i", "s"))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+", -1), lambda w: w != "")


def n_words(text: Column) -> Column:
    """As many as `words`: the parts between white space, less the empty ones that white space at either end leaves."""
    ends = F.substring(text, 1, 1).rlike(r"\s").cast("int") + F.substring(text, -1, 1).rlike(r"\s").cast("int")
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, r"\s+", -1)) - ends)


def fixed(rows: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """`keep` and the columns, each worked out once a row. A filter on a column of a projection is pushed below it, with
    all that the column is made of; one on the output of a generator isn't."""
    return rows.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _findings(rows: DataFrame, code: str, line: Column, col: Column) -> DataFrame:
    return rows.select(F.lit(code).alias("code"), "path", line.cast("int").alias("line"), col.cast("int").alias("col"))


def at_match(rows: DataFrame, code: str, pattern: str, text: str = "text") -> DataFrame:
    """Findings at the first match of `pattern` in a whole text."""
    before = F.substring(F.col(text), F.lit(1), F.regexp_instr(F.col(text), F.lit(pattern)) - 1)
    return _findings(rows, code, F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1, F.length(F.substring_index(before, "\n", -1)) + 1)


def first_per_line(docs: DataFrame, code: str, pattern: str, unless: str | None = None, tail_group: bool = False) -> DataFrame:
    """A finding on each line that matches, at its leftmost match (or at the group that ends it)."""
    hit = lines(docs.where(F.col("text").rlike("(?m)" + pattern))).where(F.col("s").rlike(pattern))
    if unless:
        hit = hit.where(~F.col("s").rlike(unless))
    col = F.regexp_instr("s", F.lit(pattern))
    if tail_group:
        col = col + F.length(F.regexp_extract("s", pattern, 0)) - F.length(F.regexp_extract("s", pattern, 1))
    return _findings(hit, code, F.col("i") + 1, col)


def residue(docs: DataFrame, natlangs=NATLANGS) -> DataFrame:
    return first_per_line(docs, "PL011", java(f"{any_of(L.RESIDUE, natlangs)}|{any_of(L.RESIDUE_EDGES, natlangs)}"))


def tool_tokens(docs: DataFrame, natlangs=NATLANGS) -> DataFrame:
    return first_per_line(docs, "PL012", exact_java(L.TOOL_TOKENS))


def template(docs: DataFrame, natlangs=NATLANGS) -> DataFrame:
    return first_per_line(docs, "PL013", exact_java(f"(?i:{L.TEMPLATE_BRACKET})|{L.TEMPLATE_CAPITALS}"))


def cliche(docs: DataFrame, natlangs=NATLANGS) -> DataFrame:
    return first_per_line(likely(docs, any_of(L.CLICHE, natlangs)), "PL014", java(any_of(L.CLICHE, natlangs)))


def opener(docs: DataFrame, natlangs=NATLANGS) -> DataFrame:
    return first_per_line(docs, "PL022", java(f"{L.SENTENCE_START}({any_of(L.OPENERS, natlangs)})"), tail_group=True)


def contrast(docs: DataFrame, natlangs=NATLANGS) -> DataFrame:
    """A contrast, or two denials in a row from the start of a sentence; the leftmost on a line."""
    found = first_per_line(docs, "PL023", java(any_of(L.CONTRAST, natlangs)))
    if "en" in natlangs:
        found = found.unionByName(first_per_line(docs, "PL023", java(f"{L.SENTENCE_START}({L.NEGATIVE_LISTING})"), tail_group=True))
    return found.groupBy("code", "path", "line").agg(F.min("col").alias("col"))


def puffery(docs: DataFrame, natlangs=NATLANGS) -> DataFrame:
    return first_per_line(likely(docs, any_of(L.PUFFERY, natlangs)), "PL024", java(any_of(L.PUFFERY, natlangs)))


def weasel(docs: DataFrame, natlangs=NATLANGS) -> DataFrame:
    return first_per_line(likely(docs, any_of(L.WEASEL, natlangs)), "PL025", java(any_of(L.WEASEL, natlangs)), unless=exact_java(L.CITED))


def colon_reveal(docs: DataFrame, natlangs=NATLANGS) -> DataFrame:
    pattern = exact_java(any_of(L.REVEAL, natlangs))
    hit = lines(docs).where(F.col("s").rlike(pattern) & ~F.col("s").rlike(HEADING))
    lead = F.length(F.regexp_extract(F.regexp_extract("s", pattern, 0), r"^(?:[.!?]\s+|[ \t]*)", 0))
    start = F.regexp_instr("s", F.lit(pattern)) + lead
    return _findings(hit, "PL026", F.col("i") + 1, start)


def dense(docs: DataFrame, code: str, panel: str, least: int, repeats: int = 2) -> DataFrame:
    """One finding a document where matches reach max(least, ceil(least * words / 1000)) or one phrase repeats."""
    pattern = java(panel)
    found = fixed(likely(docs, panel).where(F.col("text").rlike(pattern)), ["path", "text"], m=F.array_sort(F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), F.lower)))
    n, floor = F.size("m"), F.greatest(F.lit(least), F.ceil(F.lit(least) * n_words(F.col("text")) / 1000))
    # in order, a phrase that repeats is the same as the one so many places on
    often = F.exists(F.arrays_zip(F.col("m").alias("a"), F.slice("m", repeats, 1 << 30).alias("b")), lambda z: z["a"] == z["b"])
    return at_match(found.where((n >= floor) | often), code, pattern)


def hedging(docs: DataFrame, natlangs=NATLANGS) -> DataFrame:
    return dense(docs, "PL015", any_of(L.HEDGING, natlangs), 3)


def hedge_stack(docs: DataFrame, natlangs=NATLANGS) -> DataFrame:
    """Two hedges side by side: a finding for every occurrence."""
    return each_match(likely(docs, any_of(L.HEDGE_STACK, natlangs)), "PL015", java(any_of(L.HEDGE_STACK, natlangs)))


def places(marked: Column, mark: str) -> Column:
    """Places, from 1, of every `mark` in a string: one look at each character."""
    return F.transform(F.filter(F.transform(F.split(marked, "", -1), lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda z: z["c"] == mark), lambda z: z["i"] + 1)


def each_match(docs: DataFrame, code: str, pattern: str) -> DataFrame:
    """A finding for every match: a sign is put before each, whose place, less the signs before, is the match's."""
    hit = lines(docs.where(F.col("text").rlike("(?m)" + pattern))).where(F.col("s").rlike(pattern))
    marked = F.regexp_replace(F.replace("s", F.lit("\u0001"), F.lit("\u0002")), f"(?:{pattern})", "\u0001$0")
    found = hit.select("path", "i", F.posexplode(places(marked, "\u0001")).alias("k", "c"))
    return _findings(found, code, F.col("i") + 1, F.col("c") - F.col("k"))


def promo(docs: DataFrame, natlangs=NATLANGS) -> DataFrame:
    return dense(docs, "PL031", any_of(L.PROMO, natlangs), 3)


def hyphens(docs: DataFrame, natlangs=NATLANGS) -> DataFrame:
    return dense(docs, "PL032", L.HYPHENS, 4, 3)


def vocabulary(docs: DataFrame, natlangs=NATLANGS) -> DataFrame:
    strong, weak = java(L.VOCABULARY_STRONG), java(L.VOCABULARY_WEAK)
    all_words = java(f"(?:{L.VOCABULARY_STRONG}|{L.VOCABULARY_WEAK})")
    kinds = F.size(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(all_words), F.lit(0)), lambda x: F.lower(F.substring(x, 1, 6)))))
    # four kinds of words are needed, each of which begins like one of the list
    begins = sorted({x[:6] for x in L.VOCABULARY_STRONG.needles | L.VOCABULARY_WEAK.needles})
    some = F.transform(F.array(F.lower(F.col("text"))), lambda t: F.size(F.filter(F.array(*map(F.lit, begins)), lambda w: F.contains(t, w))))[0]
    odd = F.col("text").rlike("[\u017f\u0131\u0130]")
    found = fixed(docs.where((some >= 4) | odd), ["path", "text"], n=n_words(F.col("text")), w=2 * F.regexp_count("text", F.lit(strong)) + F.regexp_count("text", F.lit(weak)), kinds=kinds)
    flagged = F.when(F.col("n") >= 250, (F.floor(F.try_divide(F.col("w") * 1000, F.col("n"))) >= 12) & (F.col("kinds") >= 6)).otherwise((F.col("w") >= 6) & (F.col("kinds") >= 4))
    return at_match(found.where(flagged), "PL016", all_words)


def parallelism(docs: DataFrame, natlangs=NATLANGS) -> DataFrame:
    # words and gaps are taken whole: giving one back letter by letter never helps
    triple, negative, trailing = exact_java(L.TRICOLON).replace(r"\w+", r"\w++").replace(r"\s+", r"\s++"), java(any_of(L.NEGATIVE_PARALLELISM, natlangs)), exact_java(any_of(L.TRAILING_PARTICIPLE, natlangs))
    some = has_any(F.col("text"), L.PARALLEL_NEEDLES) | F.col("text").rlike(r"(?s),\s+(?:and|or)\s.*,\s+(?:and|or)\s.*,\s+(?:and|or)\s")
    counts = fixed(docs.where(some), ["path", "text"], a=F.regexp_count("text", F.lit(triple)), b=F.regexp_count("text", F.lit(negative)) + F.regexp_count("text", F.lit(trailing)))
    flagged = counts.where("b >= 2 or a >= 3")
    place = lambda p: F.when(F.col("text").rlike(p), F.regexp_instr("text", F.lit(p)))
    at = F.when(F.col("b") >= 2, F.least(place(negative), place(trailing))).otherwise(place(triple))
    before = F.substring(F.col("text"), F.lit(1), F.col("at") - 1)
    return _findings(flagged.withColumn("at", at), "PL017", F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1, F.length(F.substring_index(before, "\n", -1)) + 1)


def dashes(docs: DataFrame, natlangs=NATLANGS) -> DataFrame:
    """Every em dash, and every en dash that isn't between digits, unless it begins the line's text."""
    hit = lines(docs.where(F.contains("text", F.lit("—")) | F.contains("text", F.lit("–")))).where(F.col("s").rlike("[—–]"))
    # an exempt dash is put out of sight by a sign of the same length
    between = F.regexp_replace("s", r"(\d ?)–( ?\d)", "$1\u0002$2")
    kept = hit.withColumn("v", F.regexp_replace(between, r"^(\s*(?:[-*+>]\s+)*)[—–]", "$1\u0002"))
    one_kind = F.translate("v", "–", "—")
    return _findings(kept.where(F.col("v").rlike("[—–]")).select("path", "i", F.explode(places(one_kind, "—")).alias("c")), "PL018", F.col("i") + 1, F.col("c"))


def smart_quotes(docs: DataFrame, natlangs=NATLANGS) -> DataFrame:
    return at_match(docs.where(F.regexp_count("text", F.lit("[‘’“”]")) >= 2), "PL020", "[‘’“”]")


def boldface(docs: DataFrame, natlangs=NATLANGS) -> DataFrame:
    """Four bold spans or more, one to forty words or denser; and three list items in a row that open in bold."""
    bold = r"\*\*[^*\n]+\*\*"
    many = docs.where(F.col("text").rlike(bold)).withColumn("n", F.regexp_count("text", F.lit(bold))).where((F.col("n") >= 4) & (40 * F.col("n") > n_words(F.col("text"))))
    items = lines(docs).where(F.col("s").rlike(LIST_ITEM)).withColumn("lead", F.col("s").rlike(r"^\s*(?:[-*+]|\d+[.)])\s+\*\*[^*\n]+(?:\*\*:|:\*\*|\*\*\s+[-–—]|\*\*)"))
    islands = items.where("lead").withColumn("g", F.col("i") - F.row_number().over(Window.partitionBy("path").orderBy("i")))
    runs = islands.groupBy("path", "g").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("i")).where("n >= 3").groupBy("path").agg(F.min("i").alias("i"))
    return at_match(many, "PL019", bold).unionByName(_findings(runs, "PL019", F.col("i") + 1, F.lit(1)))


def headings(docs: DataFrame, natlangs=NATLANGS) -> DataFrame:
    """Lines marked with emoji, twice or more; three headings of three words or more, three quarters of them in title
    case; and two thin sections: under 25 words and two sentences, without fence or table, not the first title, not the
    parent of a deeper heading, not a list of references."""
    numbered = lines(docs)
    marked = numbered.where(F.col("s").rlike(EMOJI_LINE)).groupBy("path").agg(F.min("i").alias("i"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    found = numbered.where(F.col("s").rlike(HEADING)).withColumn("w", words(F.regexp_replace("s", r"^ {0,3}#{1,6}\s+|\s+#*\s*$", ""))).where(F.size("w") >= 3)
    plain = F.filter("w", lambda x: x.rlike(r"^\p{L}") & ~F.lower(x).isin(*"a an and as at but by for from in nor of on or the to with de da do das dos e em para por com o os um uma".split()))
    title = (F.size(F.filter(plain, lambda x: x.rlike(r"^\p{Lu}"))) >= 0.8 * F.size(plain)) & (F.size(plain) >= 2)
    cased = found.groupBy("path").agg(F.min("i").alias("i"), F.count(F.lit(1)).alias("n"), F.count_if(title).alias("t")).where("n >= 3 and t >= 0.75 * n")
    # only documents with two headings are numbered by section
    some = lines(docs.where(F.col("text").rlike(r"(?ms)" + HEADING.replace("\\S", r"\S.*^ {0,3}#{1,6}\s+\S"))))
    head = F.col("s").rlike(HEADING)
    sections = some.withColumn("g", F.sum(head.cast("int")).over(Window.partitionBy("path").orderBy("i"))).where("g > 0")
    body = F.when(~head, F.col("s"))
    level = F.length(F.regexp_extract("s", r"^ {0,3}(#{1,6})", 1))
    title_of = F.lower(F.trim(F.regexp_replace("s", r"^ {0,3}#{1,6}\s+|\s+#*\s*$", "")))
    per = sections.groupBy("path", "g").agg(F.min("i").alias("i"), F.max(F.when(head, level)).alias("level"), F.max(F.when(head, title_of)).alias("title"), F.coalesce(F.sum(n_words(body)), F.lit(0)).alias("n"), F.coalesce(F.sum(F.regexp_count(body, F.lit(r"[.!?](?:\s|$)"))), F.lit(0)).alias("ends"), F.coalesce(F.max(body.rlike(r"^\s*(?:```|~~~|\|)")), F.lit(False)).alias("other"))
    after = F.lead("level").over(Window.partitionBy("path").orderBy("g"))
    thin = per.withColumn("after", after).where((F.col("n") < 25) & (F.col("ends") < 2) & ~F.col("other") & ~((F.col("g") == 1) & (F.col("level") == 1)) & ~F.coalesce(F.col("after") > F.col("level"), F.lit(False)) & ~F.col("title").isin(*REFERENCES))
    twice = thin.groupBy("path").agg(F.min("i").alias("i"), F.count(F.lit(1)).alias("k")).where("k >= 2")
    out = [_findings(rows, "PL021", F.col("i") + 1, F.lit(1)) for rows in (marked, cased, twice)]
    return out[0].unionByName(out[1]).unionByName(out[2])


def filler(docs: DataFrame, natlangs=NATLANGS) -> DataFrame:
    said, adverb = java(any_of(L.FILLER, natlangs)), "(?m)" + java(L.FILLER_ADVERB)
    some = docs.where(has_any(F.col("text"), any_of(L.FILLER, natlangs).needles | set(L.ADVERBS)))
    found = fixed(some, ["path", "text"], m=F.transform(F.regexp_extract_all("text", F.lit(said), F.lit(0)), F.lower), a=F.regexp_count("text", F.lit(adverb))).where((F.size("m") > 0) | (F.col("a") > 0))
    weighed = 2 * F.size("m") + F.col("a") >= F.greatest(F.lit(6), F.ceil(6 * n_words(F.col("text")) / 1000))
    return at_match(found.where(weighed | (F.size("m") > F.size(F.array_distinct("m")))), "PL027", f"(?m){said}|{java(L.FILLER_ADVERB)}")


def weak_verbs(docs: DataFrame, natlangs=NATLANGS) -> DataFrame:
    """Weak verb phrases, and vague quantifiers on lines without a digit."""
    vague = java(any_of(L.VAGUE, natlangs))
    both = java(f"(?:{any_of(L.WEAK_VERB, natlangs)}|{any_of(L.VAGUE, natlangs)})")
    # a line with a digit keeps its weak verbs alone
    shown = F.array_join(F.transform(F.split("text", "\n", -1), lambda s: F.when(s.rlike("[0-9]"), F.regexp_replace(s, vague, " ")).otherwise(s)), "\n")
    found = fixed(likely(docs, either(any_of(L.WEAK_VERB, natlangs), any_of(L.VAGUE, natlangs))).where(F.col("text").rlike(both)), ["path"], text=shown, n=n_words(F.col("text")))
    m = fixed(found.where(F.col("text").rlike(both)), ["path", "text", "n"], m=F.transform(F.regexp_extract_all("text", F.lit(both), F.lit(0)), F.lower))
    flagged = (F.size("m") >= F.greatest(F.lit(3), F.ceil(3 * F.col("n") / 1000))) | (F.size("m") > F.size(F.array_distinct("m")))
    return at_match(m.where(flagged), "PL028", both)


def blocks(text: Column) -> Column:
    """array<struct<first, text>>: every block of lines between blank ones that is prose throughout, and its first line from
    1. Lines that aren't blank are numbered, so that a block knows its place and blank lines are line ends alone."""
    numbered = F.array_join(F.transform(F.split(text, "\n", -1), lambda s, i: F.when(s.rlike(r"^\s*$"), F.lit("")).otherwise(F.concat(i.cast("string"), F.lit(":"), s))), "\n")
    cut = F.filter(F.split(numbered, "\n\n+", -1), lambda b: b != "")
    plain = lambda b: F.regexp_replace(b, r"(?md)^\d+:", "")
    made = F.transform(cut, lambda b: F.struct((F.regexp_extract(b, r"^\n?(\d+):", 1).cast("int") + 1).alias("first"), plain(F.regexp_replace(b, r"^\n|\n$", "")).alias("text")))
    return F.filter(made, lambda b: ~F.exists(F.split(b["text"], "\n", -1), lambda s: s.rlike(NOT_PROSE)) & (b["text"] != ""))


def paragraphs(docs: DataFrame) -> DataFrame:
    """path, first (line), text (lines joined by line ends) of every block that is prose throughout."""
    return docs.select("path", F.inline(blocks(F.col("text"))))


def sentences(text: Column) -> Column:
    """The text's sentences with the white space after them cut off."""
    return F.filter(F.split(F.regexp_replace(text, SENTENCE_END, "$1\u0001"), "\u0001", -1), lambda s: s.rlike(r"\S"))


def recap(docs: DataFrame, natlangs=NATLANGS) -> DataFrame:
    """The last paragraph, where it is short and sums up, kicks or cheers."""
    last = paragraphs(docs).groupBy("path").agg(F.max_by("text", "first").alias("text"), F.max("first").alias("first"))
    n, t = n_words(F.col("text")), F.col("text")
    hit = (t.rlike(java(any_of(L.RECAP, natlangs))) & (n <= 20)) | (t.rlike(java(f"(?:{any_of(L.KICKER, natlangs)}|{any_of(L.POSITIVE_END, natlangs)})")) & (n <= 12))
    return _findings(last.where(hit), "PL029", F.col("first"), F.lit(1))


def fragmentation(docs: DataFrame, natlangs=NATLANGS) -> DataFrame:
    """Paragraphs with three short sentences in a row, or two in a row that open with and, but or or, or four of about one
    length throughout."""
    cut = fixed(paragraphs(docs), ["path", "first"], s=sentences(F.col("text")))
    # a letter a sentence: its length and how it opens, so that runs are substrings
    lengths = F.transform("s", n_words)
    rows = fixed(cut, ["path", "first"], n=lengths, c=F.array_join(F.transform("s", lambda x: F.when(x.rlike(r"(?i)^\s*(?:and|but|or)(?![A-Za-z0-9_])"), "c").otherwise("-")), ""))
    short = F.array_join(F.transform("n", lambda x: F.when(x <= 5, "s").otherwise("-")), "").contains("sss")
    even = (F.size("n") >= 4) & (F.array_max("n") - F.array_min("n") <= 2)
    return _findings(rows.where(short | F.col("c").contains("cc") | even), "PL030", F.col("first"), F.lit(1))


def overlong(docs: DataFrame, natlangs=NATLANGS) -> DataFrame:
    """Sentences of more than 50 words (57 where Portuguese alone is enabled), at their first character."""
    most = 57 if tuple(natlangs) == ("pt",) else 50
    marked = F.split(F.regexp_replace("text", r"""([.!?]+["')\]]*\s+)""", "$1\u0001"), "\u0001", -1)
    rows = fixed(paragraphs(docs).where(n_words(F.col("text")) > most), ["path", "first", "text"], p=marked)
    # one walk over the sentences, which keeps the places of long ones alone
    begun = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("long"))
    step = lambda a, x: F.struct((a["at"] + F.length(x)).alias("at"), F.when((F.length(x) > 2 * most) & (n_words(x) > most), F.concat(a["long"], F.array(a["at"]))).otherwise(a["long"]).alias("long"))
    hit = rows.select("path", "first", "text", F.explode(F.aggregate("p", begun, step)["long"]).alias("at"))
    before = F.substring(F.col("text"), F.lit(1), F.col("at"))
    return _findings(hit, "PL033", F.col("first") + F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))), F.length(F.substring_index(before, "\n", -1)) + 1)


def synonym_forms() -> list[tuple[str, str, str]]:
    """(form, set, member) of every inflected form."""
    import itertools
    import re

    out = []
    for group, members in L.SYNONYMS.items():
        for member, spec in members.items():
            pattern = re.compile(phrase(spec, False))
            stem = spec.rstrip("~+^")
            forms = spec.split("/") if "/" in spec else ["".join(x) for x in itertools.product([stem], {"~": ["e", "es", "ed", "ing"], "+": ["", "s", "ed", "ing"], "^": ["y", "ies", "ied", "ying"]}.get(spec[-1], [""]))]
            out += [(f, group, member) for f in forms if pattern.fullmatch(f)]
    return out


def rotation(docs: DataFrame, natlangs=NATLANGS) -> DataFrame:
    """The first place of a set of synonyms where two members have each been used twice within 200 words."""
    forms = docs.sparkSession.createDataFrame(synonym_forms(), "form string, grp string, member string")
    known = sorted({f for f, _, _ in synonym_forms()})
    plain = F.transform(words(F.col("text")), lambda t, i: F.struct(i.alias("w"), F.lower(F.regexp_replace(t, r"^\P{L}+|\P{L}+$", "")).alias("form")))
    # a paragraph without any form isn't cut into words
    firsts = "".join(sorted({f[0] for f in known}))
    some = r"(?iu)(?<!\p{L})(?=[" + firsts + r"])(?:" + "|".join(known) + r")(?!\p{L})"
    told = paragraphs(docs).where(F.col("text").rlike(some)).select("path", "first", F.inline(F.filter(plain, lambda z: z["form"].isin(known))))
    hits = told.select("path", (F.col("first").cast("long") * 1_000_000 + F.col("w")).alias("at"), "first", "form").join(F.broadcast(forms), "form")
    near = F.collect_list("member").over(Window.partitionBy("path", "grp", "first").orderBy("at").rangeBetween(-199, 0))
    twice = F.size(F.filter(F.array_distinct("near"), lambda m: F.size(F.filter("near", lambda x: x == m)) >= 2)) >= 2
    first = hits.withColumn("near", near).where(twice).groupBy("path", "grp").agg(F.min("first").alias("first"))
    return _findings(first, "PL034", F.col("first"), F.lit(1))


def outline(docs: DataFrame, natlangs=NATLANGS) -> DataFrame:
    title = F.lower(F.trim(F.regexp_replace("s", r"^ {0,3}#{1,6}\s+|\s+#*\s*$", "")))
    heads = lines(docs).where(F.col("s").rlike(HEADING)).where(title.isin(*sorted(L.FILLER_HEADINGS)))
    return _findings(heads, "PL035", F.col("i") + 1, F.lit(1)).unionByName(first_per_line(docs, "PL035", java(any_of(L.FILLER_BODY, natlangs))))


def diff_anchored(docs: DataFrame, natlangs=NATLANGS) -> DataFrame:
    """Prose that tells of a change, unless the file or the nearest heading above is about changes."""
    pattern = java(any_of(L.DIFF, natlangs))
    title = F.when(F.col("s").rlike(HEADING), F.lower(F.trim(F.regexp_replace("s", r"^ {0,3}#{1,6}\s+|\s+#*\s*$", ""))))
    # only documents with a hit are numbered and sorted
    some = docs.where(F.col("text").rlike(pattern) & ~F.col("path").rlike(DIFF_PATHS))
    under = lines(some).withColumn("under", F.last(title, ignorenulls=True).over(Window.partitionBy("path").orderBy("i")))
    hit = under.where(F.col("s").rlike(pattern) & ~F.coalesce(F.col("under").isin(*sorted(L.DIFF_HEADINGS)), F.lit(False)))
    return _findings(hit, "PL036", F.col("i") + 1, F.regexp_instr("s", F.lit(pattern)))


def uniformity(docs: DataFrame, natlangs=NATLANGS) -> DataFrame:
    """200 words or more of which sentence lengths vary little, and words or word triples repeat much."""
    plain = F.transform(words(F.col("text")), lambda x: F.lower(F.regexp_replace(x, r"[^\p{L}\p{N}'-]", "")))
    long = docs.where(n_words(F.col("text")) >= 200)
    rows = fixed(long, ["path", "text"], n=F.transform(sentences(F.col("text")), lambda s: n_words(s).cast("double")))
    total = lambda c, f: F.aggregate(c, F.lit(0.0), lambda a, x: a + f(x))
    mean = F.try_divide(total("n", lambda x: x), F.size("n"))
    cv = F.when(F.size("n") >= 2, F.try_divide(F.sqrt(F.greatest(F.try_divide(total("n", lambda x: x * x), F.size("n")) - mean * mean, F.lit(0.0))), mean))
    ttr = F.try_divide(F.size(F.array_distinct(F.slice("w", 1, 500))), F.size(F.slice("w", 1, 500)))
    part = F.slice("w", 1, 30_000)
    # triples of the part as one array: the words, the words from the second and from the third, side by side
    triples = F.slice(F.transform(F.arrays_zip(part.alias("a"), F.slice(part, 2, 30_000).alias("b"), F.slice(part, 3, 30_000).alias("c")), lambda z: F.concat_ws(" ", z["a"], z["b"], z["c"])), F.lit(1), F.greatest(F.size(part) - 2, F.lit(0)))
    # the variation decides first: words and triples are made only where it is low
    low = fixed(rows, ["path", "text"], cv=F.round(cv, 6)).where("cv < 0.45")
    even = fixed(fixed(low, ["path", "cv"], w=plain), ["path", "cv", "w"], ttr=F.round(ttr, 6))
    measured = fixed(even, ["path", "cv", "ttr"], t=triples)
    repeated = F.round(1 - F.try_divide(F.size(F.array_distinct("t")), F.size("t")), 6)
    return _findings(measured.where((F.col("cv") < 0.45) & ((F.col("ttr") < 0.45) | (repeated > 0.04))), "PL041", F.lit(1), F.lit(1))


def page_title(pages: DataFrame) -> DataFrame:
    """HTML documents(path, text) whose first title is empty or says Document."""
    title = F.regexp_extract("text", r"(?is)<title[^>]*>(.*?)</title", 1)
    found = pages.where(F.col("text").rlike(r"(?is)<title[^>]*>.*?</title")).where(F.trim(F.regexp_replace(title, r"\s+", " ")).isin("", "Document"))
    return at_match(found, "PL044", r"(?i)<title")


def separators(pages: DataFrame) -> DataFrame:
    """HTML and TSX documents with two or more space-flanked dots, bullets or arrows: one finding each."""
    glyph = "(?<= )(?:[·•→]|&(?:middot|bull|rarr|#183|#8226|#8594);)(?= )"
    return each_match(pages.where(F.regexp_count("text", F.lit(glyph)) >= 2), "PL057", glyph)


#: The rules over plain text, by code.
RULES = {
    "PL011": residue, "PL012": tool_tokens, "PL013": template, "PL014": cliche, "PL015": hedging, "PL016": vocabulary, "PL017": parallelism, "PL018": dashes, "PL019": boldface, "PL020": smart_quotes, "PL021": headings,
    "PL022": opener, "PL023": contrast, "PL024": puffery, "PL025": weasel, "PL026": colon_reveal, "PL027": filler, "PL028": weak_verbs, "PL029": recap, "PL030": fragmentation, "PL031": promo, "PL032": hyphens,
    "PL033": overlong, "PL034": rotation, "PL035": outline, "PL036": diff_anchored, "PL041": uniformity,
}
