"""Least squares per group from mergeable triangular factors.

A group of rows is reduced to its count, its means and the triangular factor of its centred columns. Two such
summaries merge into that of all their rows: the factors are stacked, with one row for each that tells how far its means lie
from the common ones, and made triangular again. Nothing is squared and subtracted, so the residual of a column that the others
nearly span keeps its digits, and one pass over the rows is enough.

Tasks reduce their rows before anything is shuffled. Summaries of a key then arrive sorted and are merged as they
stream by, so a key of very many summaries never has to be held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

COUNT, MEAN, FACTOR, SUMS = "_n", "_mean", "_factor", "_sums"
FOLD_ROWS = 1 << 18  # rows that a task holds before it reduces them
DROP = 1e-13  # share of a column's length below which it is spanned by those before it
ROUNDING = 4 * np.finfo(float).eps  # spread, against the mean, below which a column is constant


def upper(m: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the entries of a packed factor."""
    return np.triu_indices(m)


def entry(i: int, j: int, m: int) -> Column:
    """The entry (i, j) of a packed factor of ``m`` columns."""
    return F.col(FACTOR)[i * m - i * (i - 1) // 2 + j - i]


def triangular(x: np.ndarray, first: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """The factor of every group of consecutive rows that begins at ``first``; twice orthogonalised.

    A column that the earlier ones span up to rounding, or not longer than ``floor``, gets a zero row.
    """
    m, groups = x.shape[1], len(first)
    owner = np.repeat(np.arange(groups), np.diff(np.append(first, len(x))))
    x, out = x.copy(), np.zeros((groups, m, m))
    least = np.maximum(DROP * np.sqrt(np.add.reduceat(x * x, first, axis=0)), floor)
    for k in range(m):
        length = np.sqrt(np.add.reduceat(x[:, k] ** 2, first))
        live = ~(length <= least[:, k])  # a NaN is passed on
        out[:, k, k] = np.where(live, length, 0.0)
        unit = x[:, k] * np.divide(1.0, length, out=np.zeros(groups), where=live)[owner]
        for _ in range(2):
            along = np.add.reduceat(unit[:, None] * x[:, k + 1 :], first, axis=0)
            x[:, k + 1 :] -= along[owner] * unit[:, None]
            out[:, k, k + 1 :] += along
    return out


def reduced(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, means and factor of every group of consecutive rows. Rows with a missing value (NaN in the mask's
    sense) must have been left out."""
    n = np.diff(np.append(first, len(values)))
    owner = np.repeat(np.arange(len(first)), n)
    start = values[first]
    shifted = values - start[owner]
    center = np.add.reduceat(shifted, first, axis=0) / n[:, None]
    shifted -= center[owner]
    rest = np.add.reduceat(shifted, first, axis=0) / n[:, None]
    mean = start + center + rest
    floor = ROUNDING * np.sqrt(n)[:, None] * np.abs(mean)
    return n, mean, triangular(shifted - rest[owner], first, floor)


def merged(n: np.ndarray, mean: np.ndarray, factor: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The summaries of groups of consecutive summaries."""
    m, parts = mean.shape[1], np.diff(np.append(first, len(n)))
    owner = np.repeat(np.arange(len(first)), parts)
    total = np.add.reduceat(n, first)
    # measured from the mean of a part that has rows, so equal means stay equal
    some = np.where(n > 0, np.arange(len(n)), len(n))
    base = mean[np.minimum(np.minimum.reduceat(some, first), len(n) - 1)]
    moved = np.add.reduceat(n[:, None] * (mean - base[owner]), first, axis=0)
    common = base + moved / np.maximum(total, 1)[:, None]
    rows = np.concatenate([factor, (np.sqrt(n)[:, None] * (mean - common[owner]))[:, None]], axis=1)
    floor = ROUNDING * np.sqrt(total)[:, None] * np.abs(common)
    return total, common, triangular(rows.reshape(-1, m), first * (m + 1), floor)


def picked(mean: np.ndarray, factor: np.ndarray, n: np.ndarray, columns: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Means and factor of some columns, in the order given."""
    groups, m = mean.shape
    columns = list(columns)
    rows = factor[:, :, columns].reshape(groups * m, len(columns))
    floor = ROUNDING * np.sqrt(n)[:, None] * np.abs(mean[:, columns])
    return mean[:, columns], triangular(rows, np.arange(groups) * m, floor)


def codes(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """A number for every row, equal where all keys are (nulls too)."""
    out = np.zeros(table.num_rows, dtype=np.int64)
    for k in keys:
        found = table[k].combine_chunks().dictionary_encode()
        own = found.indices.fill_null(len(found.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
        _, out = np.unique(out * (len(found.dictionary) + 1) + own, return_inverse=True)
    return out


def _lists(values: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(values, dtype=np.float64).reshape(-1))
    width = values.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * width, pa.int32()), flat)


def summary_columns(n: np.ndarray, mean: np.ndarray, factor: np.ndarray, sums: np.ndarray) -> dict:
    """The columns of summaries, as a task returns them."""
    return {
        COUNT: pa.array(n.astype(np.int64)), MEAN: _lists(mean), FACTOR: _lists(factor[:, *upper(mean.shape[1])]), SUMS: _lists(sums),
    }


def mean_columns(n: np.ndarray, mean: np.ndarray) -> dict:
    """Counts and means alone."""
    return {COUNT: pa.array(n.astype(np.int64)), MEAN: _lists(mean)}


def summary_fields() -> list[T.StructField]:
    doubles = T.ArrayType(T.DoubleType())
    return [
        T.StructField(COUNT, T.LongType()), T.StructField(MEAN, doubles), T.StructField(FACTOR, doubles), T.StructField(SUMS, doubles),
    ]


def summaries(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """``(*keys, _n, _mean, _factor, _sums)``: what a task's rows of a key come to, several rows a key.

    A row with a NULL among ``columns`` counts for nothing but keeps its key; NULLs of ``sums`` are skipped, and each
    sum is followed by its count.
    """
    keys, columns, sums = list(keys), list(columns), list(sums)
    schema = T.StructType([rows.schema[k] for k in keys] + summary_fields())
    arrow = to_arrow_schema(schema)

    def reduce(table: pa.Table) -> pa.RecordBatch:
        which = codes(table, keys)
        order = np.argsort(which, kind="stable")
        held = which[order]
        groups = int(which.max()) + 1
        values = np.stack([table[c].to_numpy() for c in columns], axis=1)[order]
        known = np.ones(len(order), dtype=bool)
        for c in columns:
            if table[c].null_count:
                known &= table[c].is_valid().to_numpy()[order]
        m = len(columns)
        n, mean, factor = np.zeros(groups, dtype=np.int64), np.zeros((groups, m)), np.zeros((groups, m, m))
        values, own = values[known], held[known]
        if len(own):
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            n[own[first]], mean[own[first]], factor[own[first]] = reduced(values, first)
        totals = np.zeros((groups, 2 * len(sums)))
        for i, c in enumerate(sums):
            valid = table[c].is_valid().to_numpy() if table[c].null_count else np.ones(len(which), dtype=bool)
            totals[:, 2 * i] = np.bincount(which[valid], weights=table[c].to_numpy()[valid], minlength=groups)
            totals[:, 2 * i + 1] = np.bincount(which[valid], minlength=groups)
        one = order[np.searchsorted(held, np.arange(groups))]
        data = {k: table[k].combine_chunks().take(pa.array(one)) for k in keys} | summary_columns(n, mean, factor, totals)
        return pa.RecordBatch.from_arrays([data[f.name].cast(f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                size += batch.num_rows
            if size >= FOLD_ROWS:
                yield reduce(pa.Table.from_batches(waiting))
                waiting, size = [], 0
        if waiting:
            yield reduce(pa.Table.from_batches(waiting))

    wanted = rows.select(*keys, *[F.col(c).cast("double").alias(c) for c in dict.fromkeys([*columns, *sums])])
    return wanted.mapInArrow(run, schema)


Finish = Callable[[np.ndarray, np.ndarray, np.ndarray], dict]


def combined(
    parts: DataFrame, keys: Sequence[str], finish: Finish | None = None, fields: Sequence[T.StructField] = (),
    pick: Sequence[int] | None = None,
) -> DataFrame:
    """One row for each key from its summaries, of the columns ``pick`` (None: all); with ``finish(n, mean, factor)`` its
    columns instead of the factor."""
    keys = list(keys)
    key_fields = [parts.schema[k] for k in keys]
    schema = T.StructType(key_fields + (list(fields) if finish else summary_fields()))
    arrow = to_arrow_schema(schema)

    def join(table: pa.Table) -> pa.Table:
        """Summaries in the order of their keys, one for each."""
        which = codes(table, keys)
        first = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
        n, mean, factor, sums = opened(table)
        n, mean, factor = merged(n, mean, factor, first)
        data = {k: table[k].combine_chunks().take(pa.array(first)) for k in keys}
        return pa.table(data | summary_columns(n, mean, factor, np.add.reduceat(sums, first, axis=0)))

    def opened(table: pa.Table) -> tuple[np.ndarray, ...]:
        rows = table.num_rows
        matrix = lambda c: table[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)
        mean, packed = matrix(MEAN), matrix(FACTOR)
        factor = np.zeros((rows, mean.shape[1], mean.shape[1]))
        factor[:, *upper(mean.shape[1])] = packed
        return table[COUNT].to_numpy(), mean, factor, matrix(SUMS)

    def finished(table: pa.Table) -> pa.RecordBatch:
        n, mean, factor, sums = opened(table)
        if pick is not None:
            mean, factor = picked(mean, factor, n, pick)
        own = finish(n, mean, factor) if finish else summary_columns(n, mean, factor, sums)
        data = {k: table[k].combine_chunks() for k in keys} | own
        as_array = lambda v, kind: v.cast(kind) if isinstance(v, pa.Array) else pa.array(v, kind, from_pandas=True)
        return pa.RecordBatch.from_arrays([as_array(data[f.name], f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.Table | None = None  # the key that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = join(pa.concat_tables([last, table.cast(last.schema)]) if last is not None else table)
            if table.num_rows > 1:
                yield finished(table.slice(0, table.num_rows - 1))
            last = table.slice(table.num_rows - 1)
        if last is not None:
            yield finished(last)

    # a key carried from one batch to the next has these columns alone, whatever else the rows hold
    parts = parts.select(*keys, COUNT, MEAN, FACTOR, SUMS)
    dealt = parts.repartition(*keys).sortWithinPartitions(*keys) if keys else parts.repartition(1)
    return dealt.mapInArrow(run, schema)


def least_squares(n: np.ndarray, mean: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Regression of the last column on a constant and the others: intercept, slopes, the constant's entry of the
    (pseudo-)inverse of the normal matrix, and the sum of squared residuals.

    Where the columns are collinear or constant the coefficients, intercept included, are those of least length.
    """
    groups, m = mean.shape
    p = m - 1
    design, right = factor[:, :p, :p], factor[:, :p, p]
    left = (factor[:, p, p] ** 2).copy()
    regular = (np.diagonal(design, axis1=1, axis2=2) > 0).all(axis=1) & (n > 0)
    slopes, level, corner = np.zeros((groups, p)), np.zeros(groups), np.full(groups, np.nan)
    if regular.any():
        r, x = design[regular], mean[regular, :p]
        slopes[regular] = np.linalg.solve(r, right[regular][:, :, None])[:, :, 0]
        level[regular] = mean[regular, p] - (slopes[regular] * x).sum(axis=1)
        away = np.linalg.solve(r.transpose(0, 2, 1), x[:, :, None])[:, :, 0]
        corner[regular] = 1.0 / n[regular] + (away * away).sum(axis=1)
    for g in np.flatnonzero(~regular & (n > 0)):
        root = np.sqrt(n[g])
        full = np.zeros((m, m))
        full[0, 0], full[0, 1:], full[1:, 1:] = root, root * mean[g, :p], design[g]
        if not np.isfinite(full).all():
            slopes[g], level[g] = np.nan, np.nan
            continue
        inverse = np.linalg.pinv(full)
        found = inverse @ np.concatenate([[root * mean[g, p]], right[g]])
        level[g], slopes[g], corner[g] = found[0], found[1:], inverse[0] @ inverse[0]
    return level, slopes, corner, left
