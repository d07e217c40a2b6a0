"""Exact order statistics of many columns by two scans, without gathering a column in one task.

The first scan makes a rank table of each column: its count and its approximate quantiles at every thousandth, which merge
from task to task.  Whatever ranks are wanted then, the table puts a bracket around each, and the second scan counts the rows
below each bracket and the values inside it.  A bracket that may hold more than MOST_ROWS rows (of a column with 70 million
rows or more) is narrowed first, which takes a scan for each further factor of about a thousand.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.shipping import ship_package

#: Rank errors of the approximate quantiles are at most a share of 1 / ACCURACY of the rows.
ACCURACY = 10_000
#: A bracket with more rows is narrowed before its values are counted.
MOST_ROWS = 200_000
#: Quantiles of a rank table.
STEPS = 1000


@dataclass
class Ranks:
    """A column's rank table."""

    rows: int  # of the table, missing values too
    count: int
    grid: list[float]  # STEPS + 1 approximate quantiles

    def bracket(self, rank: int) -> tuple[float, float]:
        slack = 2 / ACCURACY
        low, high = math.floor((rank / self.count - slack) * STEPS), math.ceil(((rank + 1) / self.count + slack) * STEPS)
        return self.grid[low] if low > 0 else -math.inf, self.grid[high] if high < STEPS else math.inf


    def approximate_imputed_quartiles(self) -> tuple[float, float, float]:
        """imputed_quartiles() by the grid, ranks being off by a share of some 1 / STEPS."""
        missing = self.rows - self.count
        at = lambda rank: self.grid[round(rank / max(1, self.count - 1) * STEPS)]
        half, median = (self.count - 1) // 2 + 1, self.grid[STEPS // 2]
        merged = [round(s * (self.rows - 1)) for s in (0.25, 0.75)]
        return median, *[at(r) if r < half else median if r < half + missing else at(r - missing) for r in merged]


def _aggregated(df: DataFrame, cells: list[Column]) -> dict:
    """One row of aggregates; a few hundred to a pass."""
    out: dict = {}
    for at in range(0, len(cells), 200):
        out |= df.agg(*cells[at : at + 200]).first().asDict()
    return out


def rank_tables(df: DataFrame, values: dict[str, Column]) -> dict[str, Ranks]:
    """A rank table of each column, by one scan."""
    asked = [i / STEPS for i in range(STEPS + 1)]
    cells = [F.count(F.lit(1)).alias("rows")]
    for i, v in enumerate(values.values()):
        cells += [F.count(v).alias(f"n{i}"), F.percentile_approx(v.cast("double"), asked, ACCURACY).alias(f"q{i}")]
    row = _aggregated(df, cells) if values else {}
    return {c: Ranks(row["rows"], row[f"n{i}"], row[f"q{i}"] or []) for i, c in enumerate(values)}


def _counted(edges: np.ndarray, of: list[int], width: int) -> object:
    """For mapInArrow: (k, v, n) of the values inside each bracket, and with a null v how many are below it.  Bracket k is
    edges[k], of column of[k]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = np.zeros(len(of), "i8")
        held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, "i8")) for _ in of]
        for batch in batches:
            columns = [batch.column(i) for i in range(width)]
            present = [c.drop_null().to_numpy(zero_copy_only=False) for c in columns]
            for k, i in enumerate(of):
                v = present[i]
                below[k] += np.count_nonzero(v < edges[k, 0])
                inside = v[(v >= edges[k, 0]) & (v <= edges[k, 1])]
                if len(inside):
                    both, where = np.unique(np.concatenate([held[k][0], inside]), return_inverse=True)
                    counts = np.concatenate([held[k][1], np.ones(len(inside), "i8")])
                    held[k] = both, np.bincount(where, counts, len(both)).astype("i8")
        for k, (v, n) in enumerate(held):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v) + 1, k, "i4")), pa.array([None, *v.tolist()], pa.float64()), pa.array(np.append(below[k : k + 1], n))], ["k", "v", "n"])

    return run


def _narrowed(df: DataFrame, values: dict[str, Column], todo: dict[tuple[str, int], tuple[float, float]]) -> None:
    """Narrows brackets, in place, until none holds more than MOST_ROWS rows or it holds one value."""
    again = dict(todo)
    while again:
        cells, v = [], {}
        for j, (k, (lo, hi)) in enumerate(again.items()):
            v[k] = values[k[0]].cast("double")
            cells += [F.count_if(v[k] < lo).alias(f"b{j}"), F.count_if(v[k].between(lo, hi)).alias(f"i{j}")]
        row = _aggregated(df, cells)
        large = {}
        for j, (k, (lo, hi)) in enumerate(again.items()):
            below, inside = row[f"b{j}"], row[f"i{j}"]
            if not below <= k[1] < below + inside:
                large[k] = (-math.inf, math.inf, k[1] / max(1, below + inside))
            elif inside > MOST_ROWS and lo < hi:
                large[k] = (lo, hi, (k[1] - below) / inside)
        cells = []
        for j, (k, (lo, hi, share)) in enumerate(large.items()):
            inner = F.when(v[k].between(lo, hi), v[k])
            cells.append(F.percentile_approx(inner, [max(0.0, share - 2 / ACCURACY), min(1.0, share + 2 / ACCURACY)], ACCURACY).alias(f"q{j}"))
        row = _aggregated(df, cells) if cells else {}
        again = {}
        for j, k in enumerate(large):
            found = tuple(row[f"q{j}"])
            if found != todo[k]:
                todo[k] = again[k] = found


def at_ranks(df: DataFrame, values: dict[str, Column], tables: dict[str, Ranks], wanted: set[tuple[str, int]]) -> dict[tuple[str, int], float]:
    """{(column, rank): value} of all wanted ranks, by one scan more."""
    if not wanted:
        return {}
    brackets = {k: tables[k[0]].bracket(k[1]) for k in sorted(wanted)}
    share = 1 / STEPS + 4 / ACCURACY
    wide = {k: b for k, b in brackets.items() if tables[k[0]].count * share * 2 > MOST_ROWS and b[0] < b[1]}
    if wide:
        _narrowed(df, values, wide)
        brackets |= wide
    ship_package(df.sparkSession)
    while True:
        shared = sorted({(c, b) for (c, _), b in brackets.items()})
        place = {s: i for i, s in enumerate(shared)}
        names = sorted({c for c, _ in shared})
        run = _counted(np.array([b for _, b in shared]), [names.index(c) for c, _ in shared], len(names))
        read = df.select(*[values[c].cast("double").alias(f"v{i}") for i, c in enumerate(names)])
        counts = read.mapInArrow(run, "k int, v double, n long").groupBy("k", "v").agg(F.sum("n").alias("n"))
        upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("k").orderBy(F.asc_nulls_first("v"))))
        asked = F.broadcast(df.sparkSession.createDataFrame([(place[c, b], r) for (c, r), b in brackets.items()], "its int, rank long"))
        met = upto.join(asked, (F.col("k") == F.col("its")) & (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        found = {(shared[r["k"]][0], r["rank"]): r["v"] for r in met.where("v is not null").select("k", "rank", "v").collect()}
        missed = {k: (-math.inf, math.inf) for k in brackets if k not in found}
        if not missed:
            return found
        _narrowed(df, values, missed)  # an approximate quantile was further off than its bound says
        brackets |= missed


def between(low: float, high: float, at: float) -> float:
    """The value at a place between two ranks."""
    return low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high


def quantiles(df: DataFrame, values: dict[str, Column], shares: list[float], exact: bool = True) -> dict[str, list[float] | None]:
    """Each column's quantiles at the shares, interpolated between neighbours; None for a column without values.

    With exact=False the approximate quantiles are the answer, their rank being off by a share of 1 / ACCURACY at most.
    """
    if not values:
        return {}
    if not exact:
        row = _aggregated(df, [F.percentile_approx(v.cast("double"), list(shares), ACCURACY).alias(f"q{i}") for i, v in enumerate(values.values())])
        return {c: row[f"q{i}"] for i, c in enumerate(values)}
    tables = rank_tables(df, values)
    ranks = {(c, s): (t.count - 1) * s for c, t in tables.items() if t.count for s in shares}
    found = at_ranks(df, values, tables, {(c, f(at)) for (c, _), at in ranks.items() for f in (math.floor, math.ceil)})
    return {c: [between(found[c, math.floor(ranks[c, s])], found[c, math.ceil(ranks[c, s])], ranks[c, s]) for s in shares] if t.count else None for c, t in tables.items()}


def imputed_quartiles(found: dict[tuple[str, int], float], column: str, table: Ranks) -> tuple[float, float, float]:
    """(median, q1, q3): the quartiles are those of the column with its missing values at the median.  Sorted, that is what
    is present up to the median, the median as often as a value is missing, and the rest: no scan sees the imputed column."""
    n, missing = table.count, table.rows - table.count
    half = (n - 1) // 2 + 1
    median = between(found[column, half - 1], found[column, n // 2], (n - 1) / 2)

    def value(rank: int) -> float:
        return found[column, rank] if rank < half else median if rank < half + missing else found[column, rank - missing]

    places = [s * (table.rows - 1) for s in (0.25, 0.75)]
    return median, *[between(value(math.floor(at)), value(math.ceil(at)), at) for at in places]


def ranks_of_imputed_quartiles(column: str, table: Ranks) -> set[tuple[str, int]]:
    """The ranks that imputed_quartiles() looks up."""
    n, missing = table.count, table.rows - table.count
    half = (n - 1) // 2 + 1
    merged = {f(s * (table.rows - 1)) for s in (0.25, 0.75) for f in (math.floor, math.ceil)}
    return {(column, half - 1), (column, n // 2)} | {(column, r if r < half else r - missing) for r in merged if not half <= r < half + missing}
