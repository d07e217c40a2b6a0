"""Correlations of all pairs of many columns by one scan: moment matrices of each task's rows, added up by pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.shipping import ship_package

#: Tasks at most, as each makes a row for each pair of columns.
MOST_TASKS = 4096


def _moments(shift: list[float]) -> object:
    """For mapInArrow: (a, b, n, sa, sb, qa, qb, p) of each pair a <= b: how many rows have both, and over those rows the sums
    of each, of their squares and of their product, less the shift."""
    c = len(shift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q, p = (np.zeros((c, c)) for _ in range(4))
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype("f8") for i in range(c)]) - np.array(shift)[:, None]
            here = ~np.isnan(x)
            x = np.where(here, x, 0.0)
            mask = here.astype("f8")
            n += mask @ mask.T
            s += x @ mask.T
            q += (x * x) @ mask.T
            p += x @ x.T
        a, b = np.triu_indices(c)
        columns = [a.astype("i4"), b.astype("i4"), n[a, b].astype("i8"), s[a, b], s[b, a], q[a, b], q[b, a], p[a, b]]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], ["a", "b", "n", "sa", "sb", "qa", "qb", "p"])

    return run


def correlations(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(a, b, n, r) for every pair of the values' places, a <= b: the rows that have both, and their correlation; null for
    fewer than two rows or a side of one value.

    A first row's values are taken off, so that large values of little spread keep their digits.
    """
    ship_package(df.sparkSession)
    read = df.select(*[v.cast("double").alias(f"v{i}") for i, v in enumerate(values.values())])
    first = read.limit(1).collect()
    shift = [float(x) if x is not None and np.isfinite(x) else 0.0 for x in (first[0] if first else [None] * len(values))]
    made = read.coalesce(MOST_TASKS).mapInArrow(_moments(shift), "a int, b int, n long, sa double, sb double, qa double, qb double, p double")
    sums = made.groupBy("a", "b").agg(*[F.sum(k).alias(k) for k in ("n", "sa", "sb", "qa", "qb", "p")])
    va, vb = F.col("n") * F.col("qa") - F.col("sa") * F.col("sa"), F.col("n") * F.col("qb") - F.col("sb") * F.col("sb")
    r = (F.col("n") * F.col("p") - F.col("sa") * F.col("sb")) / F.sqrt(va * vb)
    return sums.select("a", "b", "n", F.when((F.col("n") > 1) & (va > 0) & (vb > 0), r).alias("r"))
