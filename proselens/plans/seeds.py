"""The documents table as texts with seeded sentences, so that lexicon rules have something to find.

The driver's texts are invented words; a sentence chosen by doc_id is put after each on a line of its own. Spark and the
oracle build the same texts from the same list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proselens.sources.scan import spread

SEEDS = [
    "As an AI language model I cannot browse the internet. I hope this helps!",
    "See turn0search1 and the link utm_source=chatgpt.com for more.",
    "Dear [insert name here], use YOUR_API_KEY by 2024-XX-XX.",
    "In today's fast-paced world this is a testament to the power of ideas.",
    "It is important to note that this matters. In conclusion, it's worth noting that it matters. In conclusion, enough.",
    "We delve into the intricate tapestry, underscoring a robust, seamless and holistic landscape; moreover it fosters pivotal, vibrant synergy.",
    "It is not only fast but also cheap, highlighting the change. It was not just new but odd, showcasing a shift.",
    "The plan — long overdue — covers pages 3–5 and 7 – 9 as well – mostly.",
    "He said “yes” and then ‘no’.",
    "Here's the thing: nobody asked. The work went on. Let me be clear, it did.",
    "It's not about speed, it's about trust. No fuss. No noise.",
    "This marks a pivotal moment and sets a new standard for everyone; it serves as a quiet reminder.",
    "Experts say it works.\nStudies show [a link](http://x.example/y) too.",
    "The best part: it just works. Another thing that nobody sees: the cost is low.",
    "In order to begin, in order to end, it is basically simple. It is simply done. It is clearly fine.",
    "We made a decision. It has the ability to grow. A wide range of options significantly improves things.",
    "Nestled in the hills, this breathtaking, world-renowned place is unparalleled.",
    "A data-driven, user-friendly, end-to-end, real-time and data-driven data-driven tool.",
    "First we check the file and verify the sum, then we check the name and verify the date.",
    "The field was renamed in 2019. We have changed the default and it now uses tabs instead of spaces.",
    "Despite these challenges the town remains. Apesar desses desafios, segue.",
    "É importante ressaltar que vale lembrar isto. De certa forma, na maioria dos casos, em tese serve.",
    "It could potentially work, or may perhaps fail, or might possibly wait.",
    "",
    "\n\nUltimately, that is all there is.",
    "\n\nA b. C d. E f. G h.",
    "\n\n# Challenges\n\n## The Long Road Home\n\n### A Second Great Idea\n\n# What We Learned Today",
    "**One** two **three** four **five** six **seven**.\n- **A**: x\n- **B**: y\n- **C**: z",
    "✅ Done\n- 🚀 Launch\n## Notes\nA few words. And more. And then some.\n## Rest\nShort\n## See also\nx\n## Last\nTiny",
    " ".join(["The small cat sat down here."] * 300),
    "Plain words with nothing to find in them.",
]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def seed() -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for k, text in enumerate(SEEDS):
        out = out.when(F.col("doc_id") % len(SEEDS) == k, F.lit("\n" + text))
    return out.otherwise(F.lit(""))


def seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text, lang, source of every document."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"), "doc_id")
    return docs.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.concat(F.col("text"), seed()).alias("text"), "lang", "source", "doc_id")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text of every page, with a title or separators seeded into some."""
    table = spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id")
    extra = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("html", "<title>[^<]*</title>", "<title> Document </title>")).when(F.col("page_id") % 3 == 1, F.concat("html", F.lit("<p>a · b → c &middot; d</p>"))).otherwise(F.col("html"))
    return table.select(F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("path"), extra.alias("text"))


SEEDED_SQL = (
    "seeded AS (SELECT 'doc/' || doc_id AS path, text || CASE doc_id % " + str(len(SEEDS)) + " " + " ".join(f"WHEN {k} THEN chr(10) || " + " || chr(10) || ".join(_quoted(x) for x in text.split("\n")) for k, text in enumerate(SEEDS)) + " END AS text, lang, source, doc_id FROM documents)"
)
PAGES_SQL = "p AS (SELECT 'page/' || page_id AS path, CASE page_id % 3 WHEN 0 THEN regexp_replace(html, '<title>[^<]*</title>', '<title> Document </title>', 'g') WHEN 1 THEN html || '<p>a · b → c &middot; d</p>' ELSE html END AS text FROM pages)"
