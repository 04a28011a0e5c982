"""Principal components and density clusters of samples, and the removal of outliers.

Spark forms the samples' Gram matrix over the proteins; what is left is as small as the number of samples
squared, and done with numpy.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom import schema as S
from quantloom.operators.pairs import pair_sums, vectors


def gram(df: DataFrame, value: str, key: str = S.PROTEIN, sample: str = S.SAMPLE) -> tuple[list, np.ndarray]:
    """Sample names and the inner products of their values, each protein centred over samples; missing values are the protein's mean."""
    x = df.where(F.col(value).isNotNull()).groupBy(key, sample).agg(F.avg(value).alias("x"))
    names, packed = vectors(x.withColumn("x", F.col("x") - F.avg("x").over(Window.partitionBy(key))), key, sample, "x")
    g = np.zeros((len(names), len(names)))
    # missing values are the mean, which is 0 here
    sums = pair_sums(packed, len(names)).select("i", "j", "sxy").toArrow()
    i, j, v = (sums.column(c).to_numpy() for c in ("i", "j", "sxy"))
    g[i, j], g[j, i] = v, v
    return names, g


def pca(df: DataFrame, value: str, n_components: int = 5, key: str = S.PROTEIN, sample: str = S.SAMPLE) -> tuple[DataFrame, list[float]]:
    """(sample, PC1, PC2, ...) and the share of variance of each; of either sign that with the larger first entry positive."""
    names, g = gram(df, value, key, sample)
    w, v = np.linalg.eigh(g) if names else (np.zeros(0), np.zeros((0, 0)))
    order = np.argsort(-w)[:n_components]
    scores = v[:, order] * np.sqrt(np.maximum(w[order], 0))
    if len(names):
        scores *= np.where(scores[np.abs(scores).argmax(axis=0), range(len(order))] < 0, -1, 1)
    total = max(float(np.maximum(w, 0).sum()), 1e-300)
    cols = [f"PC{i + 1}" for i in range(len(order))]
    rows = [(s, *map(float, x)) for s, x in zip(names, scores, strict=True)]
    out = df.sparkSession.createDataFrame(rows, f"`{sample}` {df.schema[sample].dataType.simpleString()}" + "".join(f", {c} double" for c in cols))
    return out, [float(max(x, 0) / total) for x in w[order]]


def hdbscan(x: np.ndarray, min_cluster_size: int = 10, min_samples: int = 10, epsilon: float = 0.01) -> np.ndarray:
    """Cluster of each point by excess of mass, one cluster for all allowed; -1: an outlier."""
    n = len(x)
    if n < 2:
        return np.full(n, -1)
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, min(min_samples, n) - 1]
    reach = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    # the minimum spanning tree, then single linkage
    best, source, done = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool)
    done[0], best, edges = True, reach[0].copy(), []
    for _ in range(n - 1):
        j = int(np.where(done, np.inf, best).argmin())
        edges.append((float(best[j]), int(source[j]), j))
        done[j] = True
        closer = ~done & (reach[j] < best)
        best[closer], source[closer] = reach[j][closer], j
    edges.sort()
    top, kids, size = list(range(n)), {}, [1] * n
    find = list(range(n))

    def root(i: int) -> int:
        while find[i] != i:
            find[i] = i = find[find[i]]
        return i

    for dist, a, b in edges:
        a, b = root(a), root(b)
        k = len(top)
        top.append(k)
        find.append(k)
        kids[k] = (a, b, dist)
        size.append(size[a] + size[b])
        find[a] = find[b] = k

    def points(node: int) -> list[int]:
        out, stack = [], [node]
        while stack:
            v = stack.pop()
            if v < n:
                out.append(v)
            else:
                stack += kids[v][:2]
        return out

    # condensed tree: a cluster lives from its birth until it splits in two of the least size, or its points fall out
    clusters: list[dict] = []

    def grow(node: int, birth: float) -> int:
        me = len(clusters)
        clusters.append({"birth": birth, "stability": 0.0, "children": [], "points": points(node)})
        while node >= n:
            a, b, dist = kids[node]
            lam = 1 / max(dist, 1e-12)
            big = [k for k in (a, b) if size[k] >= min_cluster_size]
            if len(big) == 2:
                clusters[me]["stability"] += size[node] * (lam - birth)
                clusters[me]["children"] = [grow(k, lam) for k in big]
                return me
            if not big:
                clusters[me]["stability"] += size[node] * (lam - birth)
                clusters[me]["last"] = lam
                return me
            small = a if big[0] == b else b
            clusters[me]["stability"] += size[small] * (lam - birth)
            clusters[me].setdefault("fell", []).append((lam, points(small)))
            node = big[0]
        return me

    grow(len(top) - 1, 0.0)
    chosen: set[int] = set()

    def choose(k: int) -> float:
        below = [choose(c) for c in clusters[k]["children"]]
        if below and sum(below) > clusters[k]["stability"]:
            return sum(below)
        drop = list(clusters[k]["children"])
        while drop:
            c = drop.pop()
            chosen.discard(c)
            drop += clusters[c]["children"]
        chosen.add(k)
        return clusters[k]["stability"]

    choose(0)
    label = np.full(n, -1)
    for name, k in enumerate(sorted(chosen)):
        label[clusters[k]["points"]] = name
        if k == 0:  # points that fall out of the one cluster before its core does, and beyond epsilon, are outliers
            last = max([lam for lam, _ in clusters[k].get("fell", [])], default=np.inf)
            for lam, own in clusters[k].get("fell", []):
                if lam < last / 2 and 1 / lam > epsilon:
                    label[own] = -1
    return label


def remove_outliers(df: DataFrame, value: str, n_components: int = 5, min_cluster_size: int = 10, min_samples: int = 10, n_iter: int = 10) -> DataFrame:
    """Samples that no cluster takes are dropped, again and again until none is."""
    for _ in range(n_iter):
        names, g = gram(df, value)
        if len(names) < 2:
            return df
        w, v = np.linalg.eigh(g)
        order = np.argsort(-w)[:n_components]
        label = hdbscan(v[:, order] * np.sqrt(np.maximum(w[order], 0)), min_cluster_size, min_samples)
        out = [s for s, k in zip(names, label, strict=True) if k < 0]
        if not out or len(out) == len(names):
            return df
        df = df.where(~F.col(S.SAMPLE).isin(out))
    return df


def tsne(x: np.ndarray, perplexity: float = 30.0, rate: float = 200.0, n_iter: int = 1000, seed: int = 0) -> np.ndarray:
    """Two coordinates per row of a small matrix."""
    n = len(x)
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    p = np.zeros((n, n))
    want = np.log(min(perplexity, max((n - 1) / 3, 1.0)))
    for i in range(n):
        lo, hi, beta = 0.0, np.inf, 1.0
        for _ in range(60):
            q = np.exp(-(d[i] - np.delete(d[i], i).min() if n > 1 else d[i]) * beta)
            q[i] = 0
            q /= max(q.sum(), 1e-300)
            h = -(q * np.log(np.maximum(q, 1e-300))).sum()
            if abs(h - want) < 1e-5:
                break
            lo, hi = (beta, hi) if h > want else (lo, beta)
            beta = beta * 2 if hi == np.inf else (lo + hi) / 2
        p[i] = q
    p = np.maximum((p + p.T) / (2 * max(n, 1)), 1e-12)
    y = np.random.default_rng(seed).normal(0, 1e-4, (n, 2))
    step = np.zeros_like(y)
    for it in range(n_iter):
        num = 1 / (1 + ((y[:, None, :] - y[None, :, :]) ** 2).sum(axis=2))
        np.fill_diagonal(num, 0)
        q = np.maximum(num / max(num.sum(), 1e-300), 1e-12)
        pq = ((4.0 if it < 100 else 1.0) * p - q) * num
        grad = 4 * (pq.sum(axis=1)[:, None] * y - pq @ y)
        step = (0.5 if it < 250 else 0.8) * step - rate * grad
        y = y + step - (y + step).mean(axis=0)
    return y
