"""Evidence mass of proposals as a stream (an extension: the batch operator's sums, kept up to date)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomscope.operators.masks import evidence_mass


def running_evidence(observed: DataFrame, keys: tuple[str, ...] = ("scene_id", "mask_id")) -> DataFrame:
    """For a stream of observations (keys, score, weight); write it in update or complete mode."""
    return evidence_mass(observed, list(keys))


def windowed_evidence(observed: DataFrame, ts: str = "ts", size: str = "10 minutes", late: str = "5 minutes", keys: tuple[str, ...] = ("scene_id", "mask_id")) -> DataFrame:
    """The same in windows of event time; rows later than the watermark are dropped, as the watermark defines."""
    w = F.window(ts, size)
    return evidence_mass(observed.withWatermark(ts, late).withColumn("window", w), ["window", *keys])
