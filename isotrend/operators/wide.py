"""Models of hundreds of columns, and of columns that are nearly combinations of each other.

``block_moments`` builds the matrix of centred products as square blocks, a batch of rows at a time, and merges
the blocks of all tasks up a tree. ``ols_qr`` keeps a triangular factor in place of products, which squares no
condition number. Both hold one small state per task and group, whatever the number of rows, and their plans
have a few steps, whatever the number of columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isotrend.functions.values import named, nan_to_null
from isotrend.operators.linear import MODEL, fit_moments
from isotrend.operators.moments import result_keys
from isotrend.operators.pca import COMPONENT, components_of

# Columns and rows of a block of the product matrix.
BLOCK = 64
# Parts that the states of all tasks are merged into, level by level, before they become one.
LEVELS = (1024, 32)
# States of groups that a task holds before it passes them on.
HELD = 64
# A column is a combination of earlier ones if its length beside them falls below this share of its length.
QR_TOLERANCE = 1e-7

State = Any


def vector_of(columns: Sequence[str]) -> Column:
    """The columns as one array, to be given where a table holds its measures apart."""
    return F.array(*[nan_to_null(named(c).cast("double")) for c in columns])


def _rows(df: DataFrame, vector: Column, keys: Sequence[str]) -> DataFrame:
    whole = vector.cast("array<double>")
    return df.select(*[named(k).alias(f"__key{i}") for i, k in enumerate(keys)], whole.alias("v")).filter(F.col("v").isNotNull())


def _accumulated(rows: DataFrame, keys: int, size: int, add: Callable[[State | None, np.ndarray], State],
                 out: Callable[[State], list[dict]], fields: Sequence[pa.Field]) -> DataFrame:
    """States of every task, one row or several for each of its groups; rows with a missing value are left out."""
    key_fields = rows.schema.fields[:keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, states = TaskContext.get().partitionId() % LEVELS[0], {}
        key_types: list[pa.DataType] = []

        def flush() -> pa.RecordBatch:
            found = [(key, line) for key, state in states.items() for line in out(state)]
            states.clear()
            columns = [pa.array([key[i] for key, _ in found], t) for i, t in enumerate(key_types)]
            columns.append(pa.array([task] * len(found), pa.int32()))
            columns += [pa.array([line[f.name] for _, line in found], f.type) for f in fields]
            return pa.RecordBatch.from_arrays(columns, [f.name for f in key_fields] + ["bucket"] + [f.name for f in fields])

        for batch in batches:
            key_types = [batch.schema.field(i).type for i in range(keys)]
            lists = batch.column(keys)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            if (lengths != size).any():
                raise ValueError(f"vectors of {size} values are expected")
            flat = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(float)
            good = np.isfinite(flat).all(axis=1) | ~np.isnan(flat).any(axis=1)
            if keys:
                names = list(zip(*[batch.column(i).to_pylist() for i in range(keys)]))
                order = {name: i for i, name in enumerate(dict.fromkeys(names))}
                codes = np.array([order[name] for name in names])
            else:
                order, codes = {(): 0}, np.zeros(len(flat), int)
            for name, code in order.items():
                part = flat[good & (codes == code)] if len(order) > 1 else flat[good]
                if len(part):
                    if name not in states and len(states) >= HELD:
                        yield flush()
                    states[name] = add(states.get(name), part)
        if states:
            yield flush()

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in key_fields] + ["bucket int"]
    return rows.mapInArrow(run, ", ".join(kinds + [f"{f.name} {_sql_type(f.type)}" for f in fields]))


def _sql_type(kind: pa.DataType) -> str:
    return "array<double>" if pa.types.is_list(kind) else {pa.int32(): "int", pa.int64(): "long", pa.float64(): "double"}[kind]


def _merged(parts: DataFrame, keys: Sequence[str], merge: Callable[[list[dict]], dict], fields: Sequence[pa.Field]) -> DataFrame:
    """One row per key: states are merged in parts, those in fewer, and those in one, so no task gets many."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema.fields)

    def up(found: pa.Table) -> pa.Table:
        state = merge(found.select([f.name for f in fields]).to_pylist())
        head = found.slice(0, 1)
        columns = [pa.array([state[f.name]], f.type) if f.name in state else head.column(f.name) for f in found.schema]
        return pa.table(columns, found.schema.names)

    for level in (*LEVELS, 1):
        parts = parts.withColumn("bucket", (F.col("bucket") % level).cast("int")).groupBy(*keys, "bucket").applyInArrow(up, schema)
    return parts.drop("bucket")


def add_moments(state: State | None, rows: np.ndarray) -> State:
    """Count, means and centred products of some more rows beside those of ``state``."""
    means = rows.mean(axis=0)
    away = rows - means
    new = len(rows), means, away.T @ away
    return new if state is None else merged_moments(state, new)


def merged_moments(a: State, b: State) -> State:
    """Moments of two sets of rows together; for a square block its means are those of its rows and columns."""
    n = a[0] + b[0]
    between = [(y - x) for x, y in zip(a[1:-1], b[1:-1])]
    products = a[-1] + b[-1] + np.outer(between[0], between[-1]) * (a[0] * b[0] / n)
    return n, *[x + d * (b[0] / n) for x, d in zip(a[1:-1], between)], products


MOMENT = [pa.field("across", pa.int32()), pa.field("down", pa.int32()), pa.field("n", pa.int64()),
          *[pa.field(c, pa.list_(pa.float64())) for c in ("row_means", "column_means", "products")]]


def blocks_of(state: State) -> list[dict]:
    """The upper triangle of the product matrix in blocks of ``BLOCK``, each with what it takes to merge it."""
    n, means, products = state
    cuts = range(0, len(means), BLOCK)
    return [{"across": i, "down": j, "n": n, "row_means": means[i:i + BLOCK].tolist(), "column_means": means[j:j + BLOCK].tolist(),
             "products": products[i:i + BLOCK, j:j + BLOCK].ravel().tolist()} for i in cuts for j in cuts if j >= i]


def merge_blocks(lines: list[dict]) -> dict:
    total = None
    for line in lines:
        row, column = (np.array(line[c]) for c in ("row_means", "column_means"))
        part = line["n"], row, column, np.array(line["products"]).reshape(len(row), len(column))
        total = part if total is None else merged_moments(total, part)
    return {"n": total[0], "row_means": total[1].tolist(), "column_means": total[2].tolist(), "products": total[3].ravel().tolist()}


def block_moments(df: DataFrame, vector: Column, size: int, keys: Sequence[str] = ()) -> DataFrame:
    """Blocks of the centred products of an array column of ``size`` values, by group.

    A row with a missing value is left out. What shuffles is the blocks of each task, none of its rows.
    """
    inner = [f"__key{i}" for i in range(len(keys))]
    parts = _accumulated(_rows(df, vector, keys), len(keys), size, add_moments, blocks_of, MOMENT)
    return _merged(parts, [*inner, "across", "down"], merge_blocks, MOMENT[2:])


def wide_moments(df: DataFrame, vector: Column, size: int, keys: Sequence[str] = ()) -> DataFrame:
    """One row per group as ``moment_matrix`` gives it: ``n``, ``means`` and the upper triangle ``cross``.

    A row is as large as the matrix, k × k, whatever the rows behind it.
    """
    blocks, inner = block_moments(df, vector, size, keys), [f"__key{i}" for i in range(len(keys))]
    names = [*inner, "n", "means", "cross"]

    def join(found: pa.Table) -> pa.Table:
        lines = found.select(["across", "down", "n", "row_means", "products"]).to_pylist()
        means, cross = np.zeros(size), np.zeros((size, size))
        for line in lines:
            i, j, height = line["across"], line["down"], len(line["row_means"])
            means[i:i + height] = line["row_means"]
            cross[i:i + height, j:j + len(line["products"]) // height] = np.array(line["products"]).reshape(height, -1)
        kind = pa.list_(pa.float64())
        values = [pa.array([lines[0]["n"]], pa.int64()), pa.array([means.tolist()], kind),
                  pa.array([cross[np.triu_indices(size)].tolist()], kind)]
        return pa.table([*[found.slice(0, 1).column(k) for k in inner], *values], names)

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema.fields[:len(keys)]]
    joined = blocks.groupBy(*inner).applyInArrow(join, ", ".join(kinds + ["n long, means array<double>, cross array<double>"]))
    return joined.toDF(*result_keys(keys), *names[len(keys):])


def ols_wide(df: DataFrame, vector: Column, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Least squares of an array's first value on its others, called ``names``; models as ``linear.ols`` gives them."""
    return fit_moments(wide_moments(df, vector, len(names) + 1, keys), names, keys)


def pca_wide(df: DataFrame, vector: Column, size: int, keys: Sequence[str] = ()) -> DataFrame:
    """Principal components of the standardised values of an array column; rows as ``pca.pca`` gives them."""
    return components_of(wide_moments(df, vector, size, keys), size, len(keys))


FACTOR = [pa.field("n", pa.int64()), pa.field("factor", pa.list_(pa.float64()))]


def add_rows(state: State | None, rows: np.ndarray) -> State:
    """Rows of a group so far and the triangular factor of (1, predictors, response)."""
    table = np.column_stack([np.ones(len(rows)), rows[:, 1:], rows[:, 0]])
    n, factor = state if state is not None else (0, np.empty((0, table.shape[1])))
    return n + len(rows), np.linalg.qr(np.vstack([factor, table]), mode="r")


def merge_factors(lines: list[dict]) -> dict:
    stacked = np.vstack([np.array(line["factor"]).reshape(-1, line["width"]) for line in lines])
    return {"n": sum(line["n"] for line in lines), "factor": np.linalg.qr(stacked, mode="r").ravel().tolist()}


def solve_factor(n: int, factor: np.ndarray, names: Sequence[str]) -> dict:
    """The model behind a triangular factor of (1, predictors, response), each column beside the ones before it.

    A predictor whose part beside earlier ones is shorter than ``QR_TOLERANCE`` of it gets no estimate.
    """
    width = len(names) + 2
    full = np.zeros((width, width))
    full[:len(factor)] = factor
    kept: list[int] = []
    work = full
    for j in range(width - 1):
        if len(kept) < n and abs(work[len(kept), j]) > QR_TOLERANCE * np.linalg.norm(full[:, j]):
            kept.append(j)
        elif j < width - 1:
            # Without the redundant column the factor is triangular again.
            left = kept + list(range(j + 1, width))
            part = np.linalg.qr(full[:, left], mode="r")
            work = np.zeros((width, width))
            work[:len(part), left] = part
    k = len(kept)
    triangle = work[:k, kept]
    beta = np.linalg.solve(triangle, work[:k, -1])
    inverse = np.linalg.solve(triangle, np.eye(k))
    spread = (full[1:] ** 2).sum(axis=0)
    sst, sse = float(spread[-1]), float((work[k:, -1] ** 2).sum())
    sse = 0.0 if sse <= sst * 1e-28 else sse
    df_model, df_resid = k - 1, n - k
    mse = sse / df_resid if df_resid > 0 else None
    share = (inverse ** 2).sum(axis=1)
    terms = []
    for j, name in enumerate(["(Intercept)", *names]):
        term = dict.fromkeys(["estimate", "std_error", "t", "std_estimate", "std_estimate_error", "ss", "vif"])
        if j in kept:
            at = kept.index(j)
            error = None if mse is None else float(np.sqrt(mse * share[at]))
            term |= {"estimate": float(beta[at]), "std_error": error, "t": float(beta[at] / error) if error else None}
            scale = float(np.sqrt(spread[j] / sst)) if sst > 0 else None
            if j and scale is not None:
                term |= {"std_estimate": float(beta[at]) * scale, "std_estimate_error": None if error is None else error * scale,
                         "ss": float(beta[at] ** 2 / share[at]), "vif": float(share[at] * spread[j])}
        terms.append({"position": j, "term": name, **term})
    r2 = 1 - sse / sst if sst > 0 else None
    adjusted = 1 - (1 - r2) * (n - 1) / df_resid if r2 is not None and df_resid > 0 else None
    f = float((sst - sse) / df_model / mse) if df_model and mse else None
    return {"n": n, "df_model": df_model, "df_resid": df_resid, "sse": sse, "sst": sst, "r2": r2, "adj_r2": adjusted,
            "sigma": None if mse is None else float(np.sqrt(mse)), "f": f, "terms": terms}


def ols_qr(df: DataFrame, vector: Column, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Least squares of an array's first value on its others by orthogonal factors; models as ``linear.ols`` gives them.

    Each task factors its rows a batch at a time and keeps the triangle; triangles are stacked and factored
    again up a tree. Predictors are told apart down to a share of 1e-14 of their sum of squares, where products
    of moments end at 1e-10.
    """
    width, inner = len(names) + 2, [f"__key{i}" for i in range(len(keys))]
    names = list(names)

    def out(state: State) -> list[dict]:
        return [{"n": state[0], "factor": state[1].ravel().tolist()}]

    def merge(lines: list[dict]) -> dict:
        return merge_factors([{**line, "width": width} for line in lines])

    parts = _accumulated(_rows(df, vector, keys), len(keys), width - 1, add_rows, out, FACTOR)
    whole = _merged(parts, inner, merge, FACTOR)
    key_fields = whole.schema.fields[:len(keys)]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            models = [solve_factor(n, np.array(factor).reshape(-1, width), names)
                      for n, factor in zip(batch.column("n").to_pylist(), batch.column("factor").to_pylist())]
            table = pa.Table.from_pylist(models, MODEL_ARROW)
            yield from pa.table([*batch.columns[:len(keys)], *table.columns], [*inner, *MODEL.names]).to_batches()

    MODEL_ARROW = arrow_schema(MODEL)
    schema = T.StructType([*key_fields, *MODEL.fields])
    return whole.mapInArrow(solve, schema).toDF(*result_keys(keys), *MODEL.names)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
