"""Imputation of missing values in a long table of protein measures; a column of the matrix is a sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom import schema as S
from quantloom.checkpoints import checkpointed
from quantloom.operators.pairs import vectors

#: Rows with a gap, and rows that may fill it, whose distances are held at once.
ASKING, DONORS = 128, 2048
#: Rows in a leaf of a tree; sets of columns that have trees and cells of their own at most; rows of which the limits are read at most.
LEAF, KINDS, GUIDE = 64, 64, 32768
#: By how much rounding may make a square too small or too large.
SLACK = 1e-9


def complete(df: DataFrame, value: str, row: str = S.PROTEIN, column: str = S.SAMPLE) -> DataFrame:
    """Every pair of row and column, missing values as null. Columns are samples: a short list, taken to the driver."""
    names = sorted(r[0] for r in df.select(column).distinct().collect() if r[0] is not None)
    grid = df.select(row).distinct().select(row, F.explode(F.array(*[F.lit(n) for n in names]).cast(f"array<{df.schema[column].dataType.simpleString()}>")).alias(column))
    return grid.join(df.select(row, column, value), [row, column], "left")


def nearest(x: np.ndarray, y: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, distance): the ``most`` nearest rows of y of every row of x; equal distances by row of y.

    Matrix products of centred values tell which pairs may be among the nearest, within their rounding error;
    only of these the distance is computed, from the differences.
    """
    size = x.shape[1]
    hx, hy = np.isfinite(x).astype(float), np.isfinite(y).astype(float)
    middle = np.nansum(y, axis=0) / np.maximum(hy.sum(axis=0), 1)
    zx, zy = np.where(hx > 0, x - middle, 0), np.where(hy > 0, y - middle, 0)
    left, right = np.concatenate([zx * zx, hx, -2 * zx], axis=1), np.concatenate([hy, zy * zy, zy], axis=1)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, len(x), ASKING):
        here = slice(a, a + ASKING)
        slack = 1e-12 * ((zx[here] ** 2).sum(axis=1) + ((zy**2).sum(axis=1).max() if len(y) else 0))[:, None]
        limit = np.full((len(x[here]), 1), np.inf)
        i, j, d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for b in range(0, len(y), DONORS):
            shared = hx[here] @ hy[b : b + DONORS].T
            with np.errstate(divide="ignore", invalid="ignore"):
                near = left[here] @ right[b : b + DONORS].T / shared
            if b == 0 and near.shape[1] > most:
                # rows that share no column are none of the nearest
                limit = np.partition(np.where(shared > 0, near, np.inf), most - 1, axis=1)[:, most - 1 : most] + 2 * slack
            ni, nj = np.nonzero((near <= limit) & (shared > 0))
            if not len(ni):
                continue
            diff = y[nj + b] - x[a + ni]
            nd = np.sqrt(size / shared[ni, nj] * np.nansum(diff * diff, axis=1))
            i, j, d = np.concatenate([i, ni]), np.concatenate([j, nj + b]), np.concatenate([d, nd])
            order = np.lexsort((j, d, i))
            i, j, d = i[order], j[order], d[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            last = place == most - 1
            limit[i[last], 0] = np.minimum(limit[i[last], 0], d[last] ** 2 / size * (1 + 1e-12) + slack[i[last], 0])
            i, j, d = i[place < most], j[place < most], d[place < most]
        out.append((i + a, j, d))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


class Tree:
    """Rows that have the same columns, as leaves of at most LEAF rows with the box of their values."""

    def __init__(self, y: np.ndarray, rows: np.ndarray, has: np.ndarray):
        self.size, self.has = y.shape[1], has
        self.rows, cuts = halves(y[rows][:, has], rows, LEAF)
        self.y = y[self.rows]
        self.cuts = np.append(cuts, len(rows))
        self.lo, self.hi = np.minimum.reduceat(self.y, cuts), np.maximum.reduceat(self.y, cuts)

    def nearest(self, x: np.ndarray, has: np.ndarray, limit: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of x, row of y, distance) of the ``most`` nearest within ``limit`` of every row of x, whose columns are ``has``; equal distances by row of y.

        Leaves are looked into in the order of the least distance to their boxes, as long as that is within what is found.
        """
        if not len(x):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        shared = has & self.has
        scale = self.size / shared.sum()
        x, y, lo, hi = (np.ascontiguousarray(z[:, shared]) for z in (x, self.y, self.lo, self.hi))
        order, starts = halves(x, np.arange(len(x)), ASKING)
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for at, end in zip(starts, np.append(starts[1:], len(x)), strict=True):
            here = order[at:end]
            q = x[here]
            least = np.zeros((len(q), len(lo)))
            for k in range(q.shape[1]):
                least += np.maximum(np.maximum(lo[:, k] - q[:, k, None], q[:, k, None] - hi[:, k]), 0) ** 2
            # boxes and squares are rounded: no pair at the limit is passed over
            reach = limit[here] ** 2 * (1 + SLACK)
            least *= scale * (1 - SLACK)
            best = np.full((len(q), most), np.inf)
            found = []
            for leaf in np.argsort(least.min(axis=0), kind="stable"):
                near = np.flatnonzero(least[:, leaf] <= reach)
                if not len(near):
                    if least[:, leaf].min() > reach.max():
                        break
                    continue
                a, b = self.cuts[leaf], self.cuts[leaf + 1]
                diff = y[a:b] - q[near, None]
                d = np.sqrt(scale * (diff * diff).sum(axis=2))
                i, j = np.nonzero(d * d <= reach[near, None])
                if len(i):
                    found.append((near[i], self.rows[a + j], d[i, j]))
                    best[near] = np.partition(np.concatenate([best[near], d], axis=1), most - 1, axis=1)[:, :most]
                    reach[near] = np.minimum(reach[near], best[near].max(axis=1) ** 2 * (1 + SLACK))
            if found:
                i, j, d = (np.concatenate(z) for z in zip(*found, strict=True))
                out.append(first(here[i], j, d, most))
        return tuple(np.concatenate(z) for z in zip(*out, strict=True))


def first(i: np.ndarray, j: np.ndarray, d: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every i the ``most`` least by (d, j)."""
    order = np.lexsort((j, d, i))
    i, j, d = i[order], j[order], d[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < most
    return i[keep], j[keep], d[keep]


def halves(y: np.ndarray, rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """``rows`` in an order of parts of at most ``most``, halved by the column of the widest range, and where parts begin."""
    order, cuts, todo = np.arange(len(rows)), [], [(0, len(rows))]
    while todo:
        a, b = todo.pop()
        if b - a <= most:
            cuts.append(a)
            continue
        part = y[order[a:b]]
        k, middle = int(np.ptp(part, axis=0).argmax()) if part.shape[1] else 0, (b - a) // 2
        if part.shape[1]:
            order[a:b] = order[a:b][np.argpartition(part[:, k], middle)]
        todo += [(a, a + middle), (a + middle, b)]
    return rows[order], np.sort(np.array(cuts, np.int64))


def kinds(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(columns that have values, rows) for every such set of columns."""
    if not len(x):
        return []
    sets, of = np.unique(np.isfinite(x), axis=0, return_inverse=True)
    order = np.argsort(of.reshape(-1), kind="stable")
    return list(zip(sets, np.split(order, np.cumsum(np.bincount(of.reshape(-1), minlength=len(sets)))[:-1]), strict=True))


class Donors:
    """Rows that may fill gaps: trees by set of columns, or, where there are many sets, all as they are."""

    def __init__(self, y: np.ndarray):
        self.y = y
        sets = kinds(y)
        self.trees = [Tree(y, rows, has) for has, rows in sets if has.any()] if len(sets) <= KINDS else None

    def nearest(self, x: np.ndarray, limit: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row of x, column, row of y, distance): for every gap of x, where its limit is not negative, the ``most`` nearest rows within it that have the column."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if self.trees is None:
            for c in range(x.shape[1]):
                asks, has = np.flatnonzero(~np.isfinite(x[:, c]) & (limit[:, c] >= 0)), np.flatnonzero(np.isfinite(self.y[:, c]))
                i, j, d = nearest(x[asks], self.y[has], most)
                found.append((asks[i], np.full(len(i), c), has[j], d))
        for has, rows in kinds(x) if self.trees is not None else ():
            for tree in self.trees:
                wanted = np.flatnonzero(tree.has & ~has)
                if not len(wanted) or not (has & tree.has).any():
                    continue
                asks = rows[limit[rows][:, wanted].max(axis=1) >= 0]
                i, j, d = tree.nearest(x[asks], has, limit[asks][:, wanted].max(axis=1), most)
                found += [(asks[i], np.full(len(i), c), j, d) for c in wanted]
        i, c, j, d = (np.concatenate(z) for z in zip(*found, strict=True))
        keep = d <= limit[i, c] * (1 + SLACK)
        cell, j, d = first(i[keep] * x.shape[1] + c[keep], j[keep], d[keep], most)
        return cell // x.shape[1], cell % x.shape[1], j, d


class Cells:
    """Where rows are looked for: a part of the rows of one set of columns, cut by values, or a share of the rows of rare sets."""

    def __init__(self, guide: np.ndarray, sets: dict[int, tuple[np.ndarray, int]], rest: int, block: int):
        """``guide``: some rows, from which cuts are read; ``sets``: columns and number of rows of the frequent sets, by their code."""
        self.cuts: dict[int, list] = {}
        self.n = max(1, -(-rest // (16 * block)))
        self.shares = self.n
        own = {self.code(has[None])[0]: rows for has, rows in kinds(guide)} if len(guide) else {}
        for code, (has, n) in sets.items():
            self.cuts[code] = self.cut(guide[own[code]][:, has] if code in own else np.zeros((0, has.sum())), n, 4 * block)

    @staticmethod
    def code(has: np.ndarray) -> np.ndarray:
        """A number for each set of columns, up to 62 of them; more columns have no cells of their own."""
        return has @ (1 << np.arange(has.shape[1], dtype=np.int64)) if has.shape[1] <= 62 else np.zeros(len(has), np.int64)

    def cut(self, y: np.ndarray, n: int, most: int) -> list:
        """[cell], or [column, value, below, from it on]."""
        if n > most and len(y) > 1:
            k = int(np.ptp(y, axis=0).argmax())
            value = float(np.partition(y[:, k], len(y) // 2)[len(y) // 2])
            low = y[:, k] < value
            if low.any():
                return [k, value, self.cut(y[low], n // 2, most), self.cut(y[~low], n - n // 2, most)]
        self.n += 1
        return [self.n - 1]

    def of(self, y: np.ndarray, share: np.ndarray) -> np.ndarray:
        """The cell of each row; rows of rare sets by ``share``."""
        out = share % self.shares

        def go(node: list, rows: np.ndarray, part: np.ndarray) -> None:
            if len(node) == 1:
                out[rows] = node[0]
                return
            low = part[:, node[0]] < node[1]
            go(node[2], rows[low], part[low])
            go(node[3], rows[~low], part[~low])

        codes = self.code(np.isfinite(y))
        for code in np.unique(codes):
            if (node := self.cuts.get(int(code))) is not None:
                rows = np.flatnonzero(codes == code)
                go(node, rows, y[rows][:, np.isfinite(y[rows[0]])])
        return out


def matrix(v: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    """Rows of a column of lists of ``size`` numbers each; null as NaN."""
    flat = (v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v).flatten()
    return flat.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, size)


def lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))


def neighbours(df: DataFrame, value: str, row: str, column: str, most: int, block: int = 4096) -> DataFrame:
    """(row, column, d, v): for each gap the values of the ``most`` nearest rows that have one, equal distances by row.

    Rows are packed into vectors over the columns. Equal vectors ask once, and the ``most`` least of them by row
    may be neighbours. Those are divided into cells; a row with gaps goes to the cells that may hold a row within
    the distance of its ``most`` nearest rows among GUIDE of all, an upper limit.
    """
    names, packed = vectors(df, row, column, value)
    size = len(names)
    if not names:
        return df.where(F.lit(False)).select(row, column, F.lit(0.0).alias("d"), F.lit(0.0).alias("v"))
    schema = df.schema[row].dataType.simpleString()
    packed = checkpointed(packed.select(F.col(row).alias("id"), "v"))
    gap = F.exists("v", lambda x: x.isNull())
    finite = lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))
    donors = checkpointed(packed.withColumn("__rn", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("__rn") <= most).drop("__rn"))
    asking = checkpointed(packed.where(gap).groupBy("v").agg(F.min("id").alias("one")))

    sets = donors.groupBy(F.transform("v", finite).alias("has")).agg(F.count(F.lit(1)).alias("n"))
    common = sets.where(F.col("n") >= 2 * block).orderBy(F.desc("n"), "has").limit(KINDS).collect() if size <= 62 else []
    total = donors.count()
    own = {int(Cells.code(h[None])[0]): (h, r["n"]) for r in common for h in [np.array(r["has"], bool)]}
    some = max(most, min(GUIDE, GUIDE * 16 // max(size, 1)))
    guide = np.array([[np.nan if z is None else z for z in r[0]] for r in donors.orderBy(F.xxhash64("id")).limit(some).select("v").collect()], dtype=float).reshape(-1, size)
    cells = Cells(guide, own, total - sum(n for _, n in own.values()), block)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = cells.of(matrix(batch.column("v"), size), batch.column("share").to_numpy(zero_copy_only=False).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), batch.column("id"), batch.column("v")], names=["cell", "id", "v"])

    # a set of columns that is rare stays together as far as one share holds it
    share = F.pmod(F.xxhash64(F.transform("v", finite)) if size <= 62 and len(own) < KINDS else F.xxhash64("id"), F.lit(cells.shares)).alias("share")
    placed = donors.select("id", "v", share).mapInArrow(place, f"cell int, id {schema}, v array<double>")
    within = lambda k: F.when(finite(F.col("v")[k]), F.col("v")[k])
    stats = [F.array(*[f(within(k)) for k in range(size)]).alias(a) for a, f in (("lo", F.min), ("hi", F.max), ("n", F.count))]
    box = sorted(placed.groupBy("cell").agg(*stats, F.count(F.lit(1)).alias("rows")).collect(), key=lambda r: r["cell"])
    number = np.array([r["cell"] for r in box])
    counts = np.array([r["n"] for r in box], dtype=np.int64).reshape(-1, size)
    holds, whole = counts > 0, ((counts == 0) | (counts == np.array([r["rows"] for r in box], np.int64).reshape(-1, 1))).all(axis=1)
    lo, hi = (np.array([[s * np.inf if z is None else z for z in r[k]] for r in box], dtype=float).reshape(-1, size) for k, s in (("lo", -1), ("hi", 1)))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guides = Donors(guide)
        for batch in batches:
            every = matrix(batch.column("v"), size)
            for a in range(0, len(every), 512):
                x = every[a : a + 512]
                has = np.isfinite(x)
                limit = np.where(has, -1.0, np.inf)
                i, c, j, d = guides.nearest(x, limit, most)
                last = np.flatnonzero(np.arange(len(i)) - np.searchsorted(i * size + c, i * size + c) == most - 1)
                limit[i[last], c[last]] = d[last]
                least, shared = np.zeros((len(x), len(box))), has.astype(float) @ holds.T
                for k in range(size):
                    z = x[:, k, None]
                    least += np.where(has[:, k, None], np.maximum(np.maximum(lo[:, k] - z, z - hi[:, k]), 0), 0) ** 2
                least *= np.where(whole, size / np.maximum(shared, 1), 0) * (1 - SLACK)
                wanted = np.zeros(least.shape, bool)
                for c in range(size):
                    wanted |= holds[:, c] & (limit[:, c, None] >= 0) & (least <= limit[:, c, None] ** 2 * (1 + SLACK))
                i, at = np.nonzero(wanted & (shared > 0))
                rows = pa.array(i + a)
                for b in range(0, len(i), 65536):
                    some = slice(b, b + 65536)
                    yield pa.RecordBatch.from_arrays([pa.array(number[at[some]], pa.int32()), batch.column("one").take(rows[some]), lists(x[i[some]]), lists(limit[i[some]])], names=["cell", "id", "v", "lim"])

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if a.num_rows and b.num_rows:
            b = b.sort_by("id")
            x, y = matrix(a["v"], size), matrix(b["v"], size)
            i, c, j, d = Donors(y).nearest(x, matrix(a["lim"], size), most)
        else:
            i, c, j, d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            y = np.zeros((0, size))
        return pa.table([a["id"].take(pa.array(i)), pa.array(c, pa.int32()), pa.array(d), b["id"].take(pa.array(j)), pa.array(y[j, c])], names=["id", "c", "d", "b", "v"])

    # small shares, as a search takes long beside its rows
    asks = asking.repartition(min(max(8, asking.count() // 2048), 4096), "one")
    visits = checkpointed(asks.mapInArrow(visit, f"cell int, id {schema}, v array<double>, lim array<double>"))
    parts = {r["cell"]: max(1, -(-r["count"] // (4 * block))) for r in visits.groupBy("cell").count().collect()}
    tasks = max(1, min(sum(parts.values()), max(64, visits.count() // 4096), 4096))
    n_parts = df.sparkSession.createDataFrame([(int(k), n) for k, n in parts.items()], "cell int, parts int")
    asks = visits.join(F.broadcast(n_parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).select("cell", "part", "id", "v", "lim").repartition(tasks, "cell", "part")
    gives = placed.join(F.broadcast(n_parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("cell", "part", "id", "v").repartition(tasks, "cell", "part")
    met = asks.groupBy("cell", "part").cogroup(gives.groupBy("cell", "part")).applyInArrow(meet, f"id {schema}, c int, d double, b {schema}, v double")
    best = met.withColumn("__rn", F.row_number().over(Window.partitionBy("id", "c").orderBy("d", "b"))).where(F.col("__rn") <= most)
    best = best.select(F.col("id").alias("one"), F.get(F.array(*[F.lit(x) for x in names]), F.col("c")).alias(column), "d", F.col("v").alias("x"))
    return packed.where(gap).join(asking, "v").select("id", "one").join(best, "one").select(F.col("id").alias(row), column, "d", F.col("x").alias("v"))


def impute(df: DataFrame, value: str, method: str = "knn", n_neighbors: int = 5, weights: str = "uniform", fill_value: float = 0.0, row: str = S.PROTEIN, column: str = S.SAMPLE) -> DataFrame:
    """(row, column, value) without gaps where the method gives a value; a column without values stays null.

    knn: the mean over the nearest rows that have the value, by Euclidean distance over shared columns scaled
    up to all; rows without such a neighbour take the column's mean.
    """
    full = complete(df, value, row, column)
    by = Window.partitionBy(column)
    if method == "constant":
        return full.withColumn(value, F.coalesce(value, F.lit(fill_value)))
    if method in ("mean", "median"):
        return full.withColumn(value, F.coalesce(value, (F.avg if method == "mean" else F.median)(value).over(by)))
    if method == "most_frequent":
        counts = full.where(F.col(value).isNotNull()).groupBy(column, value).count()
        top = counts.groupBy(column).agg(F.min_by(value, F.struct(-F.col("count"), F.col(value))).alias("__f"))
        return full.join(F.broadcast(top), column, "left").withColumn(value, F.coalesce(value, "__f")).select(row, column, value)
    if method != "knn":
        raise ValueError(f"unknown method {method!r}: knn, mean, median, most_frequent or constant")
    known = full.where(F.col(value).isNotNull())
    near = neighbours(df, value, row, column, n_neighbors)
    if weights == "distance":
        zero = F.max(F.when(F.col("d") == 0, 1).otherwise(0)).over(Window.partitionBy(row, column))
        near = near.withColumn("w", F.when(zero == 1, (F.col("d") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), F.col("d"))))
    else:
        near = near.withColumn("w", F.lit(1.0))
    filled = near.groupBy(row, column).agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("__k"))
    mean = F.broadcast(known.groupBy(column).agg(F.avg(value).alias("__m")))
    return full.join(filled, [row, column], "left").join(mean, column, "left").withColumn(value, F.coalesce(value, "__k", "__m")).select(row, column, value)
