"""Summaries that are written once and merged later: distinct counts, quantiles, heavy ids.

Every task makes one summary of bounded size, and summaries merge in two rounds, the first
over `FAN` groups, so that no task has the summaries of all tasks in memory: a group streams
through one summary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tunetally.operators.profile import top_by_plays
from tunetally.operators.summaries import Compactor, Counters
from tunetally.session import materialize

FAN = 64
# Registers of a distinct sketch are 2**LG_K; four standard errors of 1.04 / sqrt(2**LG_K).
LG_K = 14
DISTINCT_BOUND = 4 * 1.04 / 2 ** (LG_K / 2)
# Values of a level that are compacted at a time are twice as many.
QUANTILE_K = 4_096
COUNTERS = 65_536

QUANTILE_SKETCH = "column string, levels array<array<double>>, n long, error long"

Batches = Iterator[pa.RecordBatch]


# ---------------------------------------------------------------- distinct counts


def distinct_sketches(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """One row per group, such as a source file, with a sketch of the distinct values of each
    column. Nulls are no values."""
    return df.groupBy(*by).agg(*(F.hll_sketch_agg(_hashable(df, c), LG_K).alias(c) for c in columns))


def merged_distinct(sketches: DataFrame, columns: list[str]) -> DataFrame:
    """Sketches of groups to one of all."""
    return sketches.agg(*(F.hll_union_agg(c).alias(c) for c in columns))


def distinct_counts(sketches: DataFrame, columns: list[str]) -> DataFrame:
    """Estimates over all groups, as a rule within `DISTINCT_BOUND` of the count."""
    merged = merged_distinct(sketches, columns)
    return merged.select(*(F.hll_sketch_estimate(c).alias(c) for c in columns))


def _hashable(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType.simpleString()
    return F.col(column) if kind in ("int", "bigint", "string", "binary") else F.col(column).cast("string")


# ---------------------------------------------------------------------- quantiles


def quantile_sketches(df: DataFrame, columns: list[str], k: int = QUANTILE_K) -> DataFrame:
    """One row per column and task: values by level, their number, and the bound on the error
    of a rank. Nulls and NaNs are no values."""

    def run(batches: Batches) -> Batches:
        sketches = [Compactor(k) for _ in columns]
        for batch in batches:
            for sketch, values in zip(sketches, batch.columns):
                values = values.drop_null().to_numpy(zero_copy_only=False)
                sketch.add(values[~np.isnan(values)])
        yield _sketch_rows(columns, sketches)

    return df.select(*(F.col(c).cast("double").alias(c) for c in columns)).mapInArrow(run, QUANTILE_SKETCH)


def _sketch_rows(columns: list[str], sketches: list[Compactor]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(columns, pa.string()),
            pa.array([[v.tolist() for v in s.levels] for s in sketches], pa.list_(pa.list_(pa.float64()))),
            pa.array([s.n for s in sketches], pa.int64()),
            pa.array([s.error for s in sketches], pa.int64()),
        ],
        names=["column", "levels", "n", "error"],
    )


def merged_quantiles(sketches: DataFrame, k: int = QUANTILE_K) -> DataFrame:
    """Sketches of parts to one row per column, whatever the parts."""

    def run(key: tuple[pa.Scalar, ...], batches: Batches) -> Batches:
        merged = Compactor(k)
        for batch in batches:
            for row in batch.select(["levels", "n", "error"]).to_pylist():
                merged.merge([np.array(v, float) for v in row["levels"]], row["n"], row["error"])
        yield _sketch_rows([key[0].as_py()], [merged])

    some = _dealt(sketches).groupBy("column", "slot").applyInArrow(run, QUANTILE_SKETCH)
    return some.groupBy("column").applyInArrow(run, QUANTILE_SKETCH)


def quantiles(sketches: DataFrame, shares: list[float], k: int = QUANTILE_K) -> DataFrame:
    """Per column and share: a value whose rank is at most `error` away from that share of the
    `n` values."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for row in batch.to_pylist():
                sketch = Compactor(k)
                sketch.merge([np.array(v, float) for v in row["levels"]], row["n"], row["error"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["column"]] * len(shares)), pa.array(shares, pa.float64()),
                        pa.array(sketch.quantiles(shares), pa.float64()),
                        pa.array([sketch.n] * len(shares), pa.int64()),
                        pa.array([sketch.error] * len(shares), pa.int64()),
                    ],
                    names=["column", "share", "value", "n", "error"],
                )

    kind = "column string, share double, value double, n long, error long"
    return merged_quantiles(sketches, k).mapInArrow(run, kind)


def _dealt(sketches: DataFrame) -> DataFrame:
    return sketches.withColumn("slot", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(FAN)))


# ---------------------------------------------------------------------- heavy ids


def heavy_summaries(plays: DataFrame, id_col: str, counters: int = COUNTERS) -> DataFrame:
    """One row per task: ids with counts, `lost`, and whether there was a count below 0."""
    kind = _summary_type(plays, id_col)

    def run(batches: Batches) -> Batches:
        summary = Counters(counters)
        for batch in batches:
            summary.add(batch.column(0), batch.column(1))
        if summary.held is not None:
            yield _summary_row(summary)

    return plays.select(id_col, F.col("play_count").cast("long")).mapInArrow(run, kind)


def merged_heavy(summaries: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Summaries of parts to one row."""
    kind = summaries.schema

    def run(_: tuple[pa.Scalar, ...], batches: Batches) -> Batches:
        merged = Counters(counters)
        for batch in batches:
            for k in range(batch.num_rows):
                ids, counts, lost, negative = (batch.column(c)[k] for c in ("ids", "counts", "lost", "negative"))
                merged.add(ids.values, counts.values)
                merged.lost += lost.as_py()
                merged.negative |= negative.as_py()
        yield _summary_row(merged)

    some = _dealt(summaries).groupBy("slot").applyInArrow(run, kind)
    return some.withColumn("slot", F.lit(0)).groupBy("slot").applyInArrow(run, kind)


def _summary_type(plays: DataFrame, id_col: str) -> str:
    ids = plays.schema[id_col].dataType.simpleString()
    return f"ids array<{ids}>, counts array<long>, lost long, negative boolean"


def _summary_row(summary: Counters) -> pa.RecordBatch:
    held = summary.held
    ends = pa.array([0, held.num_rows], pa.int32())
    lists = [
        pa.ListArray.from_arrays(ends, pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type))
        for c in held.columns
    ]
    rest = [pa.array([summary.lost], pa.int64()), pa.array([summary.negative])]
    return pa.RecordBatch.from_arrays([*lists, *rest], names=["ids", "counts", "lost", "negative"])


def top_by_counters(plays: DataFrame, id_col: str, n: int = 10, counters: int = COUNTERS) -> DataFrame:
    """As `top_by_plays`, without a shuffle of all ids: bounded summaries find the candidates
    and one more pass adds up their plays.

    If the n-th best candidate has more plays than an id outside can have, these are the best.
    Otherwise, or with counts below 0, all ids are counted.
    """
    summary = materialize(merged_heavy(heavy_summaries(plays, id_col, counters), counters), "heavy")
    row = summary.select("lost", "negative", F.size("ids").alias("size")).first()
    if row is None:
        return top_by_plays(plays, id_col, n)
    # At most `counters` ids.
    candidates = F.broadcast(summary.select(F.explode("ids").alias("_candidate")))
    held = plays.join(candidates, F.col(id_col).eqNullSafe(F.col("_candidate")), "left_semi")
    best = materialize(top_by_plays(held, id_col, n), "heavy-ids")
    return best if _proven(best, n, row) else top_by_plays(plays, id_col, n)


def _proven(best: DataFrame, n: int, row: Row) -> bool:
    if row["negative"]:
        return False
    if not row["lost"]:
        return True  # every id is a candidate
    last = best.agg(F.count(F.lit(1)).alias("n"), F.min("total_plays").alias("least")).first()
    return last["n"] == n and last["least"] > row["lost"]
