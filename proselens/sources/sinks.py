"""Sinks: findings as files. Rows are written by the executors; only the wrapper of a SARIF log is made on the driver."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from proselens.operators import pipeline


def write(findings: DataFrame, form: str, path: str) -> None:
    made = {"text": pipeline.as_text, "json": pipeline.as_json, "sarif": pipeline.as_sarif}
    if form == "markdown":
        pipeline.as_markdown(findings).write.mode("overwrite").partitionBy("tier").text(path)
    else:
        made[form](pipeline.ordered(findings)).write.mode("overwrite").text(path)


def sarif(findings: DataFrame, enabled: list[str]):
    """The pieces of a SARIF log, in order: results are streamed from the executors a partition at a time."""
    from proselens.plans.catalog import RULES

    rules = [{"id": c, "name": RULES[c].name} for c in sorted(enabled) if c in RULES]
    head = {"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0"}
    yield json.dumps(head)[:-1] + ', "runs": [{"tool": {"driver": ' + json.dumps({"name": "proselens", "rules": rules}) + '}, "results": ['
    for k, row in enumerate(pipeline.as_sarif(findings).toLocalIterator()):
        yield (", " if k else "") + row.value
    yield "]}]}"
