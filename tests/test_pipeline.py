import json
import subprocess

import duckdb
import pytest

from proselens.operators import pipeline, prose
from proselens.plans import catalog, lint, registry
from proselens.sources import config, scan, sinks
from proselens.streaming import lint as streams

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_oracles_at_the_smallest_size(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    queries, sql = registry.queries(), registry.oracles()
    assert set(queries) == set(sql)
    for name in queries:
        df = queries[name](spark, SF)
        cur = con.execute(sql[name])
        columns = [c[0] for c in cur.description]
        assert sorted(df.columns) == sorted(columns), name
        norm = lambda rows: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
        assert norm(tuple(r[c] for c in columns) for r in df.collect()) == norm(cur.fetchall()), name


def test_selection():
    on, bad = catalog.enabled()
    assert "PL010" not in on and "PL020" not in on and "PL014" in on and not bad
    assert catalog.enabled(select=["artifact", "PL014"], ignore=["PL00"])[0] == {"PL011", "PL012", "PL013", "PL014", "PL044", "PL050", "PL051"}
    assert catalog.enabled(select=["nope", "PL033"]) == ({"PL033"}, ["nope"])
    assert "PL010" in catalog.enabled(check_imports=True)[0]
    with pytest.raises(ValueError):
        catalog.enabled(select=["PL033"], ignore=["ALL"])
    assert len(catalog.RULES) == 57 and sum(map(len, catalog.GROUPS.values())) == 57
    assert all(not r.default_on for r in catalog.RULES.values() if r.tier == "C")
    assert catalog.fails(["B"], "B") and not catalog.fails(["C"], "B") and catalog.fails(["C"], None)


def test_globs():
    import re

    for glob, path, hit in [("*.md", "a.md", True), ("*.md", "d/a.md", False), ("**/*.md", "d/e/a.md", True), ("**/*.md", "a.md", True), ("src/**", "src/a/b", True), ("a?.txt", "./ab.txt", True), ("{a,b}.c", "b.c", True)]:
        assert bool(re.search(pipeline.glob_regex(glob), path)) == hit, glob


def test_suppression_scopes(spark):
    docs = spark.createDataFrame([("a", "# proselens: ignore\nx\ny"), ("b", "# proselens: ignore-file[PL014]\nx"), ("c", "text proselens: nothing")], "path string, text string")
    found = spark.createDataFrame([("PL014", "a", 2, 1), ("PL018", "a", 1, 1), ("PL014", "a", 3, 1), ("PL014", "b", 9, 1), ("PL018", "b", 2, 1), ("PL014", "c", 1, 1)], "code string, path string, line int, col int")
    which = pipeline.suppressions(docs)
    assert sorted((r.code, r.path, r.line) for r in pipeline.suppressed(found, which).collect()) == [("PL014", "a", 3), ("PL014", "c", 1), ("PL018", "b", 2)]
    assert pipeline.dead_suppressions(found, which).count() == 0


def test_baseline_is_a_multiset(spark):
    rows = [("PL1", "a", k, 1, f"m {k}") for k in (1, 2, 3)]
    found = spark.createDataFrame(rows, "code string, path string, line int, col int, message string")
    accepted = pipeline.baseline_of(found.where("line < 3"))
    assert [r.line for r in pipeline.beyond_baseline(found, accepted).collect()] == [3]


def test_scan_and_git(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "a.md").write_text("hello")
    (tmp_path / "d" / "b.py").write_text("x = 1\n")
    (tmp_path / "c.min.css").write_text("a{}")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    files = scan.scan(spark, [str(tmp_path)], exclude=["d/*.py"])
    assert [(r.lang, r.text) for r in scan.documents(files).collect()] == [("md", "hello")]
    assert sorted(r.why for r in scan.skipped(files).collect()) == ["not UTF-8", "unknown kind"]
    with pytest.raises(FileNotFoundError):
        scan.scan(spark, [str(tmp_path / "none")])
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "a.md")
    assert scan.git_paths(str(tmp_path), "staged") == ["a.md"]


def test_config(tmp_path):
    (tmp_path / config.NAME).write_text('select = ["PL014"]\nlanguage = "pt-BR"\n[per-file-ignores]\n"a" = ["PL018"]\n')
    (tmp_path / "x").mkdir()
    got = config.Config.find(str(tmp_path / "x"))
    assert got.select == ["PL014"] and got.language == ["pt"] and got.per_file_ignores == {"a": ["PL018"]}
    for bad in ({"nope": 1}, {"language": "xx"}, {"fail-on-tier": "D"}, {"custom-rule": [{"phrase": "a", "forbid": "b"}]}):
        with pytest.raises(ValueError):
            config.config.Config.of(bad)


def test_sinks(spark, tmp_path):
    found = spark.createDataFrame([("PL014", "cliche", "B", "a", 1, 2, "m", "f")], "code string, name string, tier string, path string, line int, col int, message string, fix string")
    for form in ("text", "json", "sarif", "markdown"):
        sinks.write(found, form, str(tmp_path / form))
    assert spark.read.text(str(tmp_path / "text")).first()[0] == "a:1:2 PL014 m"
    log = json.loads("".join(sinks.sarif(found, ["PL014"])))
    assert log["runs"][0]["results"][0]["level"] == "warning"


def test_streams(spark, tmp_path):
    from proselens.operators import prose

    spark.createDataFrame([("a", "It is a testament to care."), ("b", "None.")], "path string, text string").write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    docs = spark.readStream.schema("path string, text string").parquet(str(tmp_path / "in"))
    q = streams.lint_stream(docs, [prose.cliche, prose.dashes], lambda df, n: df.write.mode("overwrite").parquet(f"{out}/{n}"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert [(r.path, r.code) for r in spark.read.parquet(f"{out}/0").collect()] == [("a", "PL014")]
    events = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double, props string").option("pathGlobFilter", "events.parquet").parquet(SF)
    assert events.isStreaming and streams.counts(events).columns == ["start", "event_type", "n", "total"]


def test_custom_rules_keep_name_tier_and_message(spark):
    settings = config.Config.of({"select": ["PL900"], "custom-rule": [{"phrase": "foo", "name": "no foo", "tier": "A", "message": "foo is out", "fix": "bar"}]})
    docs = spark.createDataFrame([("a.md", "md", "some foo here")], "path string, lang string, text string")
    rows = [tuple(r) for r in lint.lint(docs, settings).collect()]
    assert rows == [("PL900", "no foo", "A", "a.md", 1, 6, "foo is out", "bar")]


def test_every_rule_has_a_message_and_a_fix(spark):
    rows = catalog.frame(spark).collect()
    assert len(rows) == 57 and all(r.message and r.fix for r in rows)


def test_baseline_files(spark, tmp_path):
    found = pipeline.with_catalog(spark.createDataFrame([("PL014", "a.md", k, 1) for k in range(1, 4)], "code string, path string, line int, col int"))
    pipeline.write_baseline(found.where("line < 3"), str(tmp_path / "b"))
    left = pipeline.beyond_baseline(found, pipeline.read_baseline(spark, str(tmp_path / "b"))).collect()
    assert [(r.line, r.fix) for r in left] == [(3, "say it plainly")]


def test_a_line_of_many_dashes_is_linear(spark):
    import time

    docs = spark.createDataFrame([("a.md", "word — and " * 100_000)], "path string, text string")
    began = time.time()
    assert prose.dashes(docs).count() == 100_000 and time.time() - began < 30
    found = prose.each_match(docs, "PLX", "and").orderBy("col").limit(2).collect()
    assert [r.col for r in found] == [8, 19]


def test_phrases_move_only_where_they_may_have_the_support(spark):
    from collections import Counter

    from proselens.operators import corpus

    texts = [("ai", "a b c a b"), ("ai", "A b, c d"), ("human", "a b x y z"), ("human", "b c d"), ("none", "a b c d"), ("ai", None), ("ai", "")]
    files = spark.createDataFrame([(str(k), t, label) for k, (label, t) in enumerate(texts)], "path string, text string, label string")
    counts = {"ai": Counter(), "human": Counter(), "none": Counter()}
    for label, text in texts:
        w = (text or "").lower().replace(",", "").split()
        counts[label].update({" ".join(w[k : k + n]) for n in range(1, 5) for k in range(len(w) - n + 1)})
    for support in (0, 1, 2, 3):
        found = corpus.phrase_differential(files, support=support)
        want = {(p, counts["ai"][p], counts["human"][p], p.count(" ") + 1) for p in counts["ai"] | counts["human"] if counts["ai"][p] >= support}
        assert {(r.phrase, r.ai_files, r.human_files, r.n) for r in found.collect()} == want, support
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1
