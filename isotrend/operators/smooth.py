"""Local quadratic smoother on an even grid: its curve, its 95 % band, and its value between the places of the grid.

Equal x values are merged, put in order over all tasks and cut into blocks, an index whose outline says which
blocks a neighbourhood ends in. Each row shuffles once into its block; every later step works on whole blocks
in numpy and passes on a few sums per place.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isotrend.functions.distributions import t_quantile_975
from isotrend.functions.values import named, nan_to_null
from isotrend.operators.joins import attach
from isotrend.operators.wide import LEVELS, _merged
from isotrend.session import stored

# Distinct x values in a block.
BLOCK = 1024
# Sums of weights times powers of the distance, the same times y, and of squared weights.
SUMS = [*[f"s{p}" for p in range(5)], *[f"t{p}" for p in range(3)], *[f"v{p}" for p in range(5)]]
# A place's fit: value and slope, and what each observation's weight is multiplied by, a quadratic in its distance, to give its share of them.
FIT = ["reach", "smooth", "slope", "a0", "a1", "a2", "b0", "b1", "b2", "norm"]
DOUBLES = pa.list_(pa.float64())


def numbers(values: pa.Array) -> np.ndarray:
    """A list cell as numbers."""
    return np.asarray(values.values.to_numpy(zero_copy_only=False), float)


def _kinds(df: DataFrame, keys: Sequence[str]) -> str:
    return "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys)


def blocks_of(df: DataFrame, x: str, y: str, keys: Sequence[str]) -> DataFrame:
    """The index: per block its ends and rows, and arrays of distinct x in order, with counts, means and squares of y."""
    inner = [f"__key{i}" for i in range(len(keys))] or ["__key0"]
    rows = df.select(*[c.alias(k) for c, k in zip([named(k) for k in keys] or [F.lit(0)], inner)],
                     *[nan_to_null(named(c).cast("double")).alias(a) for c, a in ((x, "__x"), (y, "__y"))])
    # Zero and minus zero are one place.
    merged = rows.filter(F.col("__x").isNotNull() & F.col("__y").isNotNull()).groupBy(*inner, (F.col("__x") + 0.0).alias("__x")).agg(
        F.count(F.lit(1)).cast("double").alias("c"), F.avg("__y").alias("y"), (F.var_pop("__y") * F.count(F.lit(1))).alias("ss"))
    ordered = merged.repartitionByRange(*inner, "__x").sortWithinPartitions(*inner, "__x")
    k = len(inner)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def rows_of(table: pa.Table, whole: bool) -> tuple[pa.RecordBatch, pa.Table]:
            """Blocks of the rows at hand; the last group's rest waits for more unless this is all."""
            names = list(zip(*[table.column(i).to_pylist() for i in range(k)]))
            edges = [0] + [i for i in range(1, len(names)) if names[i] != names[i - 1]] + [len(names)]
            spans = [(at, min(at + BLOCK, b)) for a, b in zip(edges, edges[1:]) for at in range(a, b, BLOCK)]
            if not whole and spans and spans[-1][1] - spans[-1][0] < BLOCK:
                rest = spans.pop()[0]
            else:
                rest = len(names)
            columns = [table.column(i).to_numpy() for i in range(k, k + 4)]
            cells = [[c[a:b] for a, b in spans] for c in columns]
            arrays = [table.column(i).take(pa.array([a for a, _ in spans], pa.int64())).combine_chunks() for i in range(k)]
            arrays += [pa.array([c[0] for c in cells[0]], pa.float64()), pa.array([c[-1] for c in cells[0]], pa.float64()),
                       pa.array([c.sum() for c in cells[1]], pa.float64()), *[pa.array(c, DOUBLES) for c in cells]]
            return pa.RecordBatch.from_arrays(arrays, [*inner, "lo", "hi", "n", "xs", "cs", "ys", "ss"]), table.slice(rest)

        left = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if left is None else pa.concat_tables([left, pa.Table.from_batches([batch])])
            done, left = rows_of(table, False)
            yield done
        if left is not None and left.num_rows:
            yield rows_of(left, True)[0]

    lists = "lo double, hi double, n double, xs array<double>, cs array<double>, ys array<double>, ss array<double>"
    return stored(ordered.mapInArrow(cut, f"{_kinds(ordered, inner)}{lists}"), "smoother-index")


def reaches(blocks: DataFrame, inner: list[str], span: float, points: int) -> DataFrame:
    """One row per group: its grid and the distance of the q-th nearest observation of every place, q = floor(n · span)."""
    kinds = _kinds(blocks, inner)
    outline = blocks.groupBy(*inner).agg(F.collect_list(F.struct("lo", "hi", "n")).alias("parts"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From the ends of blocks alone: distances between which the q-th lies, and what is nearer for certain."""
        for batch in batches:
            out = []
            for parts in batch.column(len(inner)):
                lo, hi, n = (parts.values.field(c).to_numpy(zero_copy_only=False) for c in ("lo", "hi", "n"))
                total, low, high = n.sum(), lo.min(), hi.max()
                grid = low + (high - low) * np.arange(points) / max(1, points - 1)
                q = min(max(np.floor(total * span + 1e-5), 1), total)
                away = grid[:, None]
                nearest = np.maximum(np.maximum(lo - away, away - hi), 0)
                farthest = np.maximum(np.abs(lo - away), np.abs(hi - away))
                bounds = []
                for distance in (nearest, farthest):
                    order = np.argsort(distance, axis=1, kind="stable")
                    enough = (np.cumsum(n[order], axis=1) >= q).argmax(axis=1)
                    bounds.append(np.take_along_axis(distance, order, 1)[np.arange(points), enough])
                surely = (farthest < bounds[0][:, None]) @ n
                out.append({"total": total, "grid": grid.tolist(), "least": bounds[0].tolist(), "most": bounds[1].tolist(),
                            "rank": (q - surely).tolist()})
            fields = [pa.field("total", pa.float64()), *[pa.field(c, DOUBLES) for c in ("grid", "least", "most", "rank")]]
            found = pa.Table.from_pylist(out, pa.schema(fields))
            yield from pa.table([*batch.columns[:len(inner)], *found.columns], [*inner, *found.column_names]).to_batches()

    asked = outline.mapInArrow(ask, f"{kinds}total double, grid array<double>, least array<double>, most array<double>, rank array<double>")
    lists = "grid array<double>, point array<int>, rank array<double>, ds array<array<double>>, cs array<array<double>>"

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From each block, per place, what may be the q-th: a few blocks have any. A block that is its whole group decides."""
        for batch in batches:
            column = {name: batch.column(name) for name in batch.schema.names}
            keep, out = [], []
            for i in range(batch.num_rows):
                xs, cs, grid, least, most, rank = (numbers(column[c][i]) for c in ("xs", "cs", "grid", "least", "most", "rank"))
                alone = column["n"][i].as_py() == column["total"][i].as_py()
                edge = np.maximum(np.maximum(xs[0] - grid, grid - xs[-1]), 0)
                far = np.maximum(np.abs(xs[0] - grid), np.abs(xs[-1] - grid))
                places = np.flatnonzero((edge <= most) & (far >= least))
                ds, counts, below = [], [], np.zeros(len(grid))
                for p in places:
                    d = np.abs(xs - grid[p])
                    inside = (d >= least[p]) & (d <= most[p])
                    below[p] = cs[d < least[p]].sum()
                    d, c = d[inside], cs[inside]
                    if alone:
                        order = np.argsort(d, kind="stable")
                        at = int(np.searchsorted(np.cumsum(c[order]), rank[p] - below[p] - 0.5))
                        d, c = d[order][at:at + 1], np.array([rank[p] - below[p]])
                    ds.append(d.tolist())
                    counts.append(c.tolist())
                if len(places):
                    keep.append(i)
                    out.append({"grid": grid.tolist(), "point": places.tolist(), "rank": below[places].tolist(), "ds": ds, "cs": counts})
            fields = [pa.field("grid", DOUBLES), pa.field("point", pa.list_(pa.int32())), pa.field("rank", DOUBLES),
                      pa.field("ds", pa.list_(DOUBLES)), pa.field("cs", pa.list_(DOUBLES))]
            found = pa.Table.from_pylist(out, pa.schema(fields))
            heads = [batch.column(c).take(pa.array(keep, pa.int64())) for c in [*inner, "wanted"]]
            yield from pa.table([*heads, *found.columns], [*inner, "wanted", *found.column_names]).to_batches()

    joined = attach(blocks.select(*inner, "n", "xs", "cs"), asked, inner).withColumn("wanted", F.col("rank"))
    spread = joined.mapInArrow(near, f"{kinds}wanted array<double>, {lists}")

    def pick(found: pa.Table) -> pa.Table:
        grid, wanted = (np.array(found.column(c)[0].as_py(), float) for c in ("grid", "wanted"))
        ds, cs = [[] for _ in grid], [[] for _ in grid]
        for points_here, below, d, c in zip(*(found.column(name).to_pylist() for name in ("point", "rank", "ds", "cs"))):
            for p, b, more, counts in zip(points_here, below, d, c):
                ds[p] += more
                cs[p] += counts
                wanted[p] -= b
        reach = []
        for d, c, rank in zip(ds, cs, wanted):
            order = np.argsort(d, kind="stable")
            reach.append(float(np.array(d)[order][np.searchsorted(np.cumsum(np.array(c)[order]), rank - 0.5)]))
        head = found.slice(0, 1)
        return pa.table([*[head.column(k) for k in inner], pa.array([grid.tolist()], DOUBLES), pa.array([reach], DOUBLES)],
                        [*inner, "grid", "reach"])

    return spread.groupBy(*inner).applyInArrow(pick, f"{kinds}grid array<double>, reach array<double>")


def weights(xs: np.ndarray, grid: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tricube weights and scaled distances of observations, a row per place; a neighbourhood without width weighs nothing."""
    s = (xs - grid[:, None]) / np.where(reach > 0, reach, np.inf)[:, None]
    u = np.abs(s)
    w = np.where((u < 1) & (reach > 0)[:, None], (1 - np.minimum(u, 1) ** 3) ** 3, 0.0)
    return w, s


def vertices(df: DataFrame, x: str, y: str, keys: Sequence[str], span: float, points: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """One row per group and place with its local fit (``FIT``), the index behind it, and the names of its keys."""
    blocks = blocks_of(df, x, y, keys)
    inner = [f"__key{i}" for i in range(len(keys))] or ["__key0"]
    kinds = _kinds(blocks, inner)
    reached = reaches(blocks, inner, span, points)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {name: batch.column(name) for name in batch.schema.names}
            out = []
            for i in range(batch.num_rows):
                xs, cs, ys, grid, reach = (numbers(column[c][i]) for c in ("xs", "cs", "ys", "grid", "reach"))
                w, s = weights(xs, grid, reach)
                wc = w * cs
                powers = [np.ones_like(s), s, s * s]
                powers += [powers[2] * s, powers[2] * powers[2]]
                out.append(np.stack([grid, reach, (w > 0).sum(axis=1), *[(wc * p).sum(axis=1) for p in powers],
                                     *[(wc * p) @ ys for p in powers[:3]], *[(wc * w * p).sum(axis=1) for p in powers]]))
            place = np.tile(np.arange(points), len(out)).astype(np.int32)
            at = pa.array(np.repeat(np.arange(batch.num_rows), points))
            values = np.concatenate(out, axis=1) if out else np.empty((3 + len(SUMS), 0))
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in inner], pa.array(place), *map(pa.array, values)],
                                             [*inner, "point", "x", "reach", "support", *SUMS])

    names = ", ".join(f"{c} double" for c in ("x", "reach", "support", *SUMS))
    parts = attach(blocks.select(*inner, "xs", "cs", "ys"), reached, inner).mapInArrow(sums, f"{kinds}point int, {names}")
    total = parts.groupBy(*inner, "point").agg(F.first("x").alias("x"), F.first("reach").alias("reach"),
                                               *[F.sum(c).alias(c) for c in ("support", *SUMS)])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in batch.schema.names[len(inner):]}
            s0, s1, s2, s3, s4 = (c[f"s{p}"] for p in range(5))
            cofactors = [s2 * s4 - s3 * s3, s2 * s3 - s1 * s4, s1 * s3 - s2 * s2]
            whole = s0 * cofactors[0] + s1 * cofactors[1] + s2 * cofactors[2]
            good = (c["support"] >= 3) & (whole != 0)
            scale, reach = np.where(good, whole, 1.0), np.where(c["reach"] > 0, c["reach"], 1.0)
            a = [f / scale for f in cofactors]
            b = [f / scale / reach for f in (cofactors[1], s0 * s4 - s2 * s2, s1 * s2 - s0 * s3)]
            value, slope = (sum(f * c[f"t{p}"] for p, f in enumerate(row)) for row in (a, b))
            norm = sum(a[p] * a[q] * c[f"v{p + q}"] for p in range(3) for q in range(3))
            found = [c["reach"], value, slope, *a, *b, norm]
            arrays = [pa.array(found[0]), *[pa.array(f, mask=~good) for f in found[1:]]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(inner)], batch.column("point"), batch.column("x"), *arrays],
                                             [*inner, "point", "x", *FIT])

    return total.mapInArrow(solve, f"{kinds}point int, x double, " + ", ".join(f"{c} double" for c in FIT)), blocks, inner


def _renamed(df: DataFrame, inner: list[str], keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(i).alias(k) for i, k in zip(inner, keys)], *columns)


def loess_curve(df: DataFrame, x: str, y: str, keys: Sequence[str] = (), span: float = 0.75,
                points: int = 80) -> DataFrame:
    """Weighted quadratic fit around each of ``points`` grid places between min and max x.

    The neighbourhood of a place reaches to its q-th nearest observation, q = floor(n · span),
    with tricube weights. NaN counts as missing. A place whose neighbourhood holds fewer than three distinct x
    values gives NULL.
    """
    fit, _, inner = vertices(df, x, y, keys, span, points)
    return _renamed(fit, inner, keys, ["point", "x", "smooth"])


def hermite(xs: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Cubic blending: what the values and then the slopes at the grid's places add up to at ``xs``, a row each."""
    n, step = len(grid), (grid[-1] - grid[0]) / max(1, len(grid) - 1)
    out = np.zeros((len(xs), 2 * n))
    if step <= 0:
        out[:, 0] = 1
        return out
    at = np.clip(((xs - grid[0]) / step).astype(int), 0, n - 2)
    t = (xs - grid[at]) / step
    row = np.arange(len(xs))
    out[row, at], out[row, at + 1] = (1 + 2 * t) * (1 - t) ** 2, t * t * (3 - 2 * t)
    out[row, n + at], out[row, n + at + 1] = step * t * (1 - t) ** 2, step * t * t * (t - 1)
    return out


STATE = [pa.field("n", pa.float64()), pa.field("squares", pa.float64()), pa.field("products", DOUBLES)]


def loess_band(df: DataFrame, x: str, y: str, keys: Sequence[str] = (), span: float = 0.75, points: int = 80) -> DataFrame:
    """The curve with its standard error and 95 % band.

    The smoother is linear in y: fitted = L y, where L blends the local fits at the grid's places (values and
    slopes) over the observations. Residual variance is the sum of squares over δ1 and the band uses t with δ1² / δ2
    degrees of freedom, δ1 and δ2 the traces of (I - L)(I - L)ᵀ and of its square. Both follow from three square
    matrices of twice the places, summed over the observations, so they are exact at any number of rows. A group
    with a place without a fit has no band.
    """
    fit, blocks, inner = vertices(df, x, y, keys, span, points)
    fit = stored(fit, "smoother-fit")
    kinds = _kinds(blocks, inner)
    listed = F.sort_array(F.collect_list(F.struct("point", "x", *FIT)))
    whole = fit.groupBy(*inner).agg(listed.alias("fit"), F.count("smooth").alias("fitted")).filter(F.col("fitted") == points)
    arrays = whole.select(*inner, *[F.col(f"fit.{c}").alias(c) for c in ("x", *FIT)])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, size = TaskContext.get().partitionId() % LEVELS[0], 3 * (2 * points) ** 2
        key_types, states = [], {}

        def flush() -> pa.RecordBatch:
            columns = [pa.array([key[i] for key in states], t) for i, t in enumerate(key_types)]
            columns += [pa.array([task] * len(states), pa.int32()), pa.array([s[0] for s in states.values()], pa.float64()),
                        pa.array([s[1] for s in states.values()], pa.float64()), pa.array([s[2] for s in states.values()], DOUBLES)]
            states.clear()
            return pa.RecordBatch.from_arrays(columns, [*inner, "bucket", "n", "squares", "products"])

        for batch in batches:
            key_types = [batch.schema.field(k).type for k in inner]
            names = list(zip(*[batch.column(k).to_pylist() for k in inner]))
            for i, name in enumerate(names):
                at = {c: numbers(batch.column(c)[i]) for c in ("xs", "cs", "ys", "ss", "x", *FIT)}
                w, s = weights(at["xs"], at["x"], at["reach"])
                shares = np.vstack([w * (at[f"{c}0"][:, None] + s * (at[f"{c}1"][:, None] + s * at[f"{c}2"][:, None])) for c in "ab"])
                blend = hermite(at["xs"], at["x"])
                away = at["ys"] - blend @ np.concatenate([at["smooth"], at["slope"]])
                weighed = shares * at["cs"]
                products = np.stack([(blend * at["cs"][:, None]).T @ blend, weighed @ shares.T, weighed @ blend]).ravel()
                if name not in states:
                    if len(states) >= 16:
                        yield flush()
                    states[name] = [0.0, 0.0, np.zeros(size)]
                state = states[name]
                state[0] += at["cs"].sum()
                state[1] += float(at["cs"] @ (away * away) + at["ss"].sum())
                state[2] += products
        if states:
            yield flush()

    parts = attach(blocks.select(*inner, "xs", "cs", "ys", "ss"), arrays, inner).filter(F.col("x").isNotNull()).mapInArrow(
        grams, f"{kinds}bucket int, n double, squares double, products array<double>")

    def add(lines: list[dict]) -> dict:
        return {"n": sum(r["n"] for r in lines), "squares": sum(r["squares"] for r in lines),
                "products": np.sum([r["products"] for r in lines], axis=0).tolist()}

    def traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, squares, products in zip(*(batch.column(c).to_pylist() for c in ("n", "squares", "products"))):
                blends, norms, mixed = np.array(products).reshape(3, 2 * points, 2 * points)
                own, both = np.trace(mixed), norms @ blends
                first = n - 2 * own + np.trace(both)
                second = n - 4 * own + 2 * np.trace(both) + 2 * np.trace(mixed @ mixed) + 2 * np.trace(both) \
                    - 4 * np.trace(mixed @ both) + np.trace(both @ both)
                good = first > 1e-9 * n and second > 0
                out.append((np.sqrt(squares / first), first * first / second) if good else (None, None))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(inner)], *[pa.array([r[i] for r in out], pa.float64()) for i in (0, 1)]],
                                             [*inner, "sigma", "df"])

    scale = _merged(parts, inner, add, STATE).mapInArrow(traces, f"{kinds}sigma double, df double")
    rows = attach(fit, scale.withColumn("t975", t_quantile_975("df")), inner)
    se = F.col("sigma") * F.sqrt("norm")
    banded = rows.withColumn("se", se).withColumns({"lower": F.col("smooth") - F.col("t975") * F.col("se"),
                                                    "upper": F.col("smooth") + F.col("t975") * F.col("se")})
    return _renamed(banded, inner, keys, ["point", "x", "smooth", "se", "lower", "upper", "sigma", "df"])


def loess_values(df: DataFrame, x: str, y: str, keys: Sequence[str] = (), span: float = 0.75, points: int = 80,
                 name: str = "smooth") -> DataFrame:
    """Every row with the smoother's value at its x, blended from the fits at the two places of the grid beside it.

    The blend is cubic in value and slope: it equals the direct local fit at the grid's places, and between them is
    off by a term of fourth order in their distance. A row without x, or beside a place without a fit, gets NULL.
    """
    fit, _, inner = vertices(df, x, y, keys, span, points)
    listed = F.sort_array(F.collect_list(F.struct("point", "x", "smooth", "slope")))
    grids = fit.groupBy(*inner).agg(listed.alias("__grid"))
    if keys:
        rows = attach(df, grids.toDF(*keys, "__grid"), list(keys))
    else:
        rows = df.withColumn("__grid", grids.select("__grid").scalar())
    place = nan_to_null(named(x).cast("double"))
    low = F.get("__grid", F.lit(0))["x"]
    step = (F.element_at("__grid", -1)["x"] - low) / (points - 1)
    at = F.least(F.greatest(F.floor(F.try_divide(place - low, F.nullif(step, F.lit(0.0)))), F.lit(0)), F.lit(points - 2)).cast("int")
    a, b = F.get("__grid", at), F.get("__grid", at + 1)
    t = (place - a["x"]) / step
    blend: Column = (1 + 2 * t) * (1 - t) * (1 - t) * a["smooth"] + t * t * (3 - 2 * t) * b["smooth"] \
        + step * (t * (1 - t) * (1 - t) * a["slope"] + t * t * (t - 1) * b["slope"])
    return rows.withColumn(name, blend).drop("__grid")
