"""Seeded documents with known findings, and near misses with none."""

import pytest

from proselens.operators import prose

# (code, text, lines with a finding)
CASES = [
    ("PL011", "Plain.\nAs an AI language model I cannot browse the internet.", [2]),
    ("PL011", "The language model was trained.", []),
    ("PL012", "See turn0search1 and turn2view3.\nNothing.", [1]),
    ("PL012", "We turn right, then search.", []),
    ("PL013", "Dear [insert name here], hello.\nUse YOUR_KEY_HERE.", [1, 2]),
    ("PL013", "See [insert](http://x) for the link.", []),
    ("PL014", "a\nIt is a testament to care.", [2]),
    ("PL014", "The witness gave testament.", []),
    ("PL018", "He came — late — today.", [1, 1]),
    ("PL018", "Pages 3–5 only.\n— spoken line", []),
    ("PL020", "“a” is quoted", [1]),
    ("PL020", "only one ’ here", []),
    ("PL022", "It rained. Here's the thing: it stopped.", [1]),
    ("PL023", "It's not about size, it's about shape.", [1]),
    ("PL023", "It is not large.", []),
    ("PL023", "Words. No fuss. No noise.", [1]),
    ("PL024", "This marks a turning point.", [1]),
    ("PL025", "Experts say so.\nExperts say so (Smith, 2019).", [1]),
    ("PL026", "The best part: it works.", [1]),
    ("PL026", "# The best part: it works.", []),
    ("PL031", "Nestled in hills, breathtaking and world-renowned.", [1]),
    ("PL031", "A breathtaking view.", []),
    ("PL033", " ".join(["word"] * 51) + ".", [1]),
    ("PL033", " ".join(["word"] * 50) + ".", []),
    ("PL035", "# Challenges\n\nText.", [1]),
    ("PL036", "# Guide\n\nThe key was renamed in May.", [3]),
    ("PL036", "# Changelog\n\nThe key was renamed in May.", []),
    ("PL029", "Long text here about things.\n\nUltimately, that is all.", [3]),
    ("PL019", "- **A**: x\n- **B**: y\n- **C**: z and more words to keep bold rare " + "w " * 300, [1]),
    ("PL021", "# The Long Road Home\n\nOne thing. And another thing.\n\n## A Second Great Idea\n\nOne thing. And another thing.\n\n## What We Learned Today\n\nOne thing. And another thing.", [1]),
    ("PL021", "# The long road home\n\nOne thing. And another thing.\n\n## A second great idea\n\nOne thing. And another thing.\n\n## What we learned today\n\nOne thing. And another thing.", []),
    ("PL021", "# Home\n\n## One\n\nShort.\n\n## Two\n\nShort.", [3]),
    ("PL021", "# Home\n\n## One\n\nShort.\n\n## References\n\nShort.", []),
    ("PL034", "We check it and verify it, then check again and verify again.", [1]),
    ("PL034", "We check it and verify it once.", []),
]


def test_cases(spark):
    for code in sorted({c for c, _, _ in CASES}):
        mine = [(k, t, lines) for k, (c, t, lines) in enumerate(CASES) if c == code]
        docs = spark.createDataFrame([(str(k), t) for k, t, _ in mine], "path string, text string")
        got = {}
        for r in prose.RULES[code](docs).collect():
            got.setdefault(r.path, []).append(r.line)
        for k, text, lines in mine:
            assert sorted(got.get(str(k), [])) == lines, (code, text)


def test_uniformity(spark):
    text = " ".join(f"The small cat sat down on mat {k % 3}." for k in range(40))
    docs = spark.createDataFrame([("a", text), ("b", "Short text.")], "path string, text string")
    assert [r.path for r in prose.uniformity(docs).collect()] == ["a"]


@pytest.mark.parametrize("n", [1, 7])
def test_partitioning_has_no_effect(spark, n):
    docs = spark.createDataFrame([(str(k), t) for k, (_, t, _) in enumerate(CASES)], "path string, text string")
    for code in ("PL014", "PL018", "PL034"):
        assert sorted(prose.RULES[code](docs.repartition(n)).collect()) == sorted(prose.RULES[code](docs).collect())


def test_odd_texts(spark):
    docs = spark.createDataFrame([("n", None), ("e", ""), ("s", " \n\n "), ("l", "x" * 100_000)], "path string, text string")
    for code, rule in prose.RULES.items():
        assert rule(docs).collect() == [], code
