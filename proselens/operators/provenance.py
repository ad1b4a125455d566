"""Provenance rules over image metadata fields: the first field of a file that qualifies, by its order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROMPT_KEYS = ("invokeai_metadata", "invokeai_workflow", "parameters", "prompt", "sd-metadata", "workflow")
GENERATORS = ("midjourney", "dall-e", "dall·e", "stable diffusion", "automatic1111", "comfyui", "novelai", "invokeai", "adobe firefly", "ideogram ai", "leonardo.ai", "nightcafe", "bing image creator", "playground ai", "gpt-4o", "gpt-image", "flux.1")
RIDGE = 0.4
_NAMED = r"(?<![a-z0-9])(?:" + "|".join(g.replace(".", r"\.") for g in GENERATORS) + r")(?![a-z0-9])"


def rules(fields: DataFrame) -> DataFrame:
    """Findings of prompts (046), declared source types (047) and generator names (048): a field belongs to the first of
    the three that it qualifies for."""
    prompt = F.col("key").isin(*PROMPT_KEYS)
    declared = F.lower("value").contains("trainedalgorithmicmedia")
    named = F.lower("value").rlike(_NAMED)
    code = F.when(prompt, "PL046").when(declared, "PL047").when(named, "PL048")
    hit = fields.withColumn("code", code).where("code is not null")
    return hit.groupBy("code", "path").agg(F.min("k")).select("code", "path", F.lit(1).alias("line"), F.lit(1).alias("col"))


def spectrum(ridges: DataFrame) -> DataFrame:
    return ridges.where(F.col("ridge") >= RIDGE).select(F.lit("PL049").alias("code"), "path", F.lit(1).alias("line"), F.lit(1).alias("col"))
