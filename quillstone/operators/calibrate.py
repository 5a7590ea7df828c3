"""Isotonic calibration by pooling adjacent violators, merged part by part.

A block is a range of scores with its rows and positives. Blocks whose rates do not rise are pooled; pooling parts first and
their blocks afterwards gives what pooling all scores at once gives. So scores are pooled in ranges, these in
groups, and only blocks meet in the last step: their rates rise strictly, so that there are far fewer of them than scores.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.evaluate import calibration_error, probability_metrics
from quillstone.operators.ranks import SIDE, ranged

#: Blocks that a fitted curve may have to be handed to the workers.
MOST_BLOCKS = 1 << 20
_BLOCK = "part int, lo double, hi double, n long, pos long"


def _pooled(table: pa.Table) -> pa.Table:
    """The blocks of one part, in order of scores, pooled until their rates rise."""
    part = table.column("part")[0].as_py()
    kept: list[tuple[float, float, int, int]] = []
    rows = table.select(["lo", "hi", "n", "pos"]).sort_by("lo").to_pydict()
    for lo, hi, n, pos in zip(*rows.values(), strict=True):
        while kept and kept[-1][3] * n >= pos * kept[-1][2]:
            lo, _, m, p = kept.pop()
            n, pos = n + m, pos + p
        kept.append((lo, hi, n, pos))
    return pa.table({"part": pa.array([part] * len(kept), pa.int32()), **{k: pa.array([b[i] for b in kept], t) for i, (k, t) in enumerate((("lo", pa.float64()), ("hi", pa.float64()), ("n", pa.int64()), ("pos", pa.int64())))}})


def isotonic_blocks(df: DataFrame, score: str = "p", label: str = "label") -> DataFrame:
    """(lo, hi, n, pos, value): the least-squares rising steps of the label over the score. Rows without score or label are left out."""
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    steps = rows.groupBy(F.col(score).cast("double").alias("lo")).agg(F.count("*").alias("n"), F.sum(label).cast("long").alias("pos"))
    parts = ranged(steps, [], "lo").select(F.col("range").cast("int").alias("part"), "lo", F.col("lo").alias("hi"), "n", "pos")
    for narrower in (1, SIDE, SIDE * SIDE * SIDE):  # ranges, groups of ranges, all
        parts = parts.withColumn("part", (F.col("part") / narrower).cast("int")).groupBy("part").applyInArrow(_pooled, _BLOCK)
    return parts.select("lo", "hi", "n", "pos", (F.col("pos") / F.col("n")).alias("value"))


def calibrated(blocks: DataFrame, score: Column) -> Column:
    """The score on the fitted curve: steps, joined by straight lines between them, constant beyond both ends; null stays null."""
    found = blocks.orderBy("lo").limit(MOST_BLOCKS + 1).collect()
    if not 0 < len(found) <= MOST_BLOCKS:
        raise ValueError(f"a curve of {len(found)} blocks")
    at = np.array([x for b in found for x in (b.lo, b.hi)])
    value = np.array([b.value for b in found for _ in range(2)])

    @F.pandas_udf("double")
    def on_curve(s: pd.Series) -> pd.Series:
        return pd.Series(np.where(s.isna(), np.nan, np.interp(s, at, value))).replace({np.nan: None})

    return on_curve(score.cast("double"))


def calibration_gain(df: DataFrame, holdout: str = "is_holdout", score: str = "p") -> DataFrame:
    """Calibration error and log loss of the other rows, before and after a fit on the rows held out."""
    blocks = isotonic_blocks(df.where(F.col(holdout)), score)
    rest = df.where(~F.col(holdout)).select("label", F.col(score).alias("before"), calibrated(blocks, F.col(score)).alias("after"))
    long = rest.select("label", F.inline(F.array(*(F.struct(F.lit(c).alias("score"), F.col(c).alias("p")) for c in ("before", "after")))))
    return probability_metrics(long, ("score",)).join(calibration_error(long, by=("score",)), "score")
