"""Sums before a row within its group, by ranges, and what follows from them.

A window over a whole group sorts it in one task. Where a group has more than
``ROWS_PER_RANGE`` rows, the rows are dealt into ranges of about as many over
all groups, each range is summed apart and shifted by its group's sums in the
ranges before it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.lineage import settled

ROWS_PER_RANGE = 1_000_000
#: Sums of ranges by group that are sent to the rows, at most.
MOST_STARTS = 100_000


def same_group(left: DataFrame, by: Sequence[str], prefix: str) -> Column:
    """Null-safe equality of the group columns with their prefixed namesakes."""
    out = F.lit(True)
    for c in by:
        out = out & left[c].eqNullSafe(F.col(f"{prefix}{c}"))
    return out


def join_groups(df: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """``df`` with the other columns of ``groups``, which has one row for each
    group of ``by`` (nulls are one group; no ``by`` is one group of all)."""
    other = groups.select(*[F.col(c).alias(f"_g_{c}") for c in by], *[c for c in groups.columns if c not in by])
    if not by:
        return df.crossJoin(F.broadcast(other))  # one row
    return df.join(other, same_group(df, by, "_g_")).drop(*[f"_g_{c}" for c in by])


def _summed_in_place(df: DataFrame, by: Sequence[str], sums: Mapping[str, str]) -> DataFrame:
    """``df``, sorted in each partition, with ``_range``, the partition's
    number, and for each {name: column} the sum of the column over the rows of
    the same group that come before in the partition as ``_b_<name>``."""
    values = list(sums.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, last, total = TaskContext.get().partitionId(), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            key = table.select(list(by))
            head = [key[c][0].as_py() for c in by]
            new = np.zeros(batch.num_rows, dtype=bool)
            for c in by:
                x = key[c].combine_chunks()
                x, before = x.slice(1), x.slice(0, batch.num_rows - 1)
                differs = pc.fill_null(pc.not_equal(x, before), False)
                if pa.types.is_floating(x.type):
                    differs = pc.and_(differs, pc.invert(pc.fill_null(pc.and_(pc.is_nan(x), pc.is_nan(before)), False)))
                new[1:] |= np.asarray(pc.or_(differs, pc.xor(pc.is_null(x), pc.is_null(before))))
            same = last is not None and repr(head) == repr(last)
            new[0] = True
            first = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            columns, left = [], []
            for i, c in enumerate(values):
                v = pc.fill_null(table[c], 0).to_numpy()
                run_ = np.cumsum(v) - v
                run_ = run_ - run_[first][group]
                if same:
                    run_[: first[1] if len(first) > 1 else None] += total[i]
                columns.append(pa.array(run_))
                left.append(run_[-1] + v[-1])
            last, total = [key[c][-1].as_py() for c in by], left
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, number, dtype=np.int32)), *columns], names=[*batch.schema.names, "_range", *[f"_b_{n}" for n in sums]])

    schema = StructType([*df.schema.fields, StructField("_range", IntegerType()), *[StructField(f"_b_{n}", df.schema[c].dataType) for n, c in sums.items()]])
    return df.mapInArrow(run, schema)


def running_sums(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], sums: dict[str, Column | str], rows_per_range: int = ROWS_PER_RANGE, most: int | None = None, merged: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``df`` with, for each {name: column}, the sum of the column over the
    rows before this one in its group of ``by`` (nulls are one group), in the
    order of ``order``, which tells a group's rows apart. First rows have 0.

    ``most``, where it is known, bounds the rows; ``df`` is then not written
    out to be counted. Ranges are sorted and summed where they were dealt to.
    ``merged`` makes one row of those of equal group and order, which ``sums``
    then read; it takes place in the ranges, where there are any."""
    ranges = 1 if most is None else max(1, math.ceil(most / rows_per_range))
    if merged and ranges == 1:
        df, merged = merged(df), None
    if not merged:
        given = df.columns
        df, at = _with_values(df, sums)
        if most is None:
            df = settled(df)
            # rows in all, and in the largest group: groups that are small enough are summed as they are
            sizes = df.groupBy(*by).count().agg(F.coalesce(F.max("count"), F.lit(0)), F.coalesce(F.sum("count"), F.lit(0))).first()
            ranges = 1 if sizes[0] <= rows_per_range else math.ceil(sizes[1] / rows_per_range)
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if ranges == 1:
        w = Window.partitionBy(*by).orderBy(*order)
        return df.withColumns({n: before(at[n], w) for n in sums}).select(*given, *sums)
    whole = df.repartitionByRange(ranges, *by, *order)
    if merged:
        whole = merged(whole)
        given = whole.columns
        whole, at = _with_values(whole, sums)
    kinds = dict(whole.dtypes)
    whole = whole.withColumns({c: F.coalesce(F.col(c).cast("double" if kinds[c] in ("float", "double") else "long"), F.lit(0)) for c in set(at.values()) - set(given)})
    # settled, as a second sample would draw other bounds of the ranges
    dealt = settled(_summed_in_place(whole.sortWithinPartitions(*by, *order), by, at))
    starts = settled(dealt.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_v_{n}") for n, c in at.items()]))
    few = starts.count() <= MOST_STARTS
    shift = Window.partitionBy(*by).orderBy("_range")  # a row for each range that a group reaches
    starts = starts.select(F.col("_range").alias("_r"), *[F.col(c).alias(f"_g_{c}") for c in by], *[before(f"_v_{n}", shift).alias(f"_s_{n}") for n in sums])
    joined = dealt.join(F.broadcast(starts) if few else starts, (F.col("_range") == F.col("_r")) & same_group(dealt, by, "_g_"))
    return joined.withColumns({n: F.col(f"_b_{n}") + F.col(f"_s_{n}") for n in sums}).select(*given, *sums)


def _with_values(df: DataFrame, sums: Mapping[str, Column | str]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with what is summed, and the name of each column of it: long and
    double columns are summed as they are, others as copies."""
    kinds = dict(df.dtypes)
    at = {n: c if isinstance(c, str) and kinds[c] in ("bigint", "double") else f"_v_{n}" for n, c in sums.items()}
    return df.select("*", *[(F.col(c) if isinstance(c, str) else c).alias(f"_v_{n}") for n, c in sums.items() if at[n] == f"_v_{n}"]), at


def join_by_class(df: DataFrame, classes: DataFrame, keys: Sequence[str], size: str, rows: int, how: str = "inner", most: int = 4096) -> DataFrame:
    """``df`` joined with ``classes`` (unique by ``keys``, whose column
    ``size`` tells how many rows of ``df`` hold the key).

    Classes of at least ``rows`` / ``most`` rows, of which there are ``most``
    at most, are broadcast, so that the rows of a hot class stay where they
    are; all others meet by shuffle. Null keys meet nothing."""
    big = F.col(size) * most >= rows
    hot, cold = classes.where(big).drop(size), classes.where(~big).drop(size)
    rest = df.join(F.broadcast(hot.select(*keys)), list(keys), "left_anti")
    return df.join(F.broadcast(hot), list(keys)).unionByName(rest.join(cold, list(keys), how))


def at_rank(below: str, count: str, value: str, rank: Column) -> Column:
    """Aggregate: the value whose ``count`` equal rows, after ``below`` smaller
    ones, hold the rank (from 0)."""
    return F.max(F.when((F.col(below) <= rank) & (rank < F.col(below) + F.col(count)), F.col(value)))


def interpolated(below: str, count: str, value: str, total: Column, p: float) -> Column:
    """Aggregate: the exact quantile, linear between ranks; null without rows."""
    h = (total - 1) * F.lit(float(p))
    low, high = at_rank(below, count, value, F.floor(h)), at_rank(below, count, value, F.ceil(h))
    part = F.max(h - F.floor(h))
    return F.when(low == high, low).otherwise(low + (high - low) * part)


def quantiles(long: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], rows_per_range: int = ROWS_PER_RANGE, weight: str | None = None) -> DataFrame:
    """(by, n, q): the rows with a value and their exact quantiles, in the
    order of ``probs``, by counts of different values. Groups without a value
    have no row. ``weight`` counts a row so many times."""
    cells = long.where(F.col(value).isNotNull()).groupBy(*by, value).agg((F.sum(weight) if weight else F.count("*")).alias("_c"))
    run = running_sums(cells, by, [value], {"_below": "_c"}, rows_per_range)
    run = join_groups(run, run.groupBy(*by).agg(F.sum("_c").alias("_n")), by)
    return run.groupBy(*by).agg(F.max("_n").alias("n"), F.array(*[interpolated("_below", "_c", value, F.col("_n"), p) for p in probs]).alias("q"))
