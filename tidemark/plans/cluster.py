"""Clusters and outliers of a contract's transactions.

Features, distances over shared addresses, ranks, verdicts and publishing are DataFrame operations. DBSCAN, isolation
forest and local outlier factor need all points of one target together: they run on the most recent ``max_txs`` of it, a
bound that is part of their definition, one target a group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_TXS = 5000
TREES, SAMPLE, NEIGHBOURS, CONTAMINATION = 300, 256, 20, 0.05
SILHOUETTE_SAMPLE = 2000
COMPONENTS = 8
FAR, SOME, WELL = 4.0, 2.0, 2.75
DRIFT, COVERAGE = 0.25, 0.6


#: Rows of a distance matrix that are worked on at once, as the whole has 200 MB for MAX_TXS rows.
BLOCK = 256


def distances(x: np.ndarray) -> np.ndarray:
    s, d = np.einsum("ij,ij->i", x, x), 2 * x @ x.T
    for i in range(0, len(x), BLOCK):
        d[i : i + BLOCK] = np.sqrt(np.maximum(s[i : i + BLOCK, None] + s[None] - d[i : i + BLOCK], 0))
    np.fill_diagonal(d, 0)
    return d


def nearest(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` nearest others of each point, of equal ones the first, and how far they are."""
    near, reach = np.empty((len(d), k), int), np.empty((len(d), k))
    for i in range(0, len(d), BLOCK):
        e = d[i : i + BLOCK].copy()
        e[np.arange(len(e)), np.arange(i, i + len(e))] = np.inf
        near[i : i + BLOCK] = np.argsort(e, 1, kind="stable")[:, :k]
        reach[i : i + BLOCK] = np.take_along_axis(e, near[i : i + BLOCK], 1)
    return near, reach


def dbscan(d: np.ndarray, eps: float, min_samples: int) -> np.ndarray:
    """Labels by density over a distance matrix, -1 for noise; clusters are numbered by their first core point, and a
    border point goes to the first cluster that reaches it."""
    near = d <= eps
    core = near.sum(1) >= min_samples
    labels, k = np.full(len(d), -1), 0
    for i in np.flatnonzero(core):
        if labels[i] >= 0:
            continue
        labels[i], front = k, [i]
        while front:
            new = near[front].any(0) & (labels < 0)
            labels[new] = k
            front = np.flatnonzero(new & core).tolist()
        k += 1
    return labels


def isolation(x: np.ndarray, seed: int = 0, trees: int = TREES, sample: int = SAMPLE) -> np.ndarray:
    """Isolation forest scores, larger for points that random cuts part early."""
    r, n = np.random.default_rng(seed), len(x)
    size = min(sample, n)
    mean = lambda m: 0.0 if m < 2 else 1.0 if m == 2 else 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m
    depth, limit = np.zeros(n), int(np.ceil(np.log2(max(2, size))))

    def part(own: np.ndarray, every: np.ndarray, at: int) -> None:
        spread = x[own].max(0) - x[own].min(0) if len(own) else np.zeros(x.shape[1])
        if at >= limit or len(own) < 2 or not spread.any():
            depth[every] += at + mean(len(own))
            return
        c = r.choice(np.flatnonzero(spread))
        cut = x[own, c].min() + r.random() * spread[c]
        part(own[x[own, c] < cut], every[x[every, c] < cut], at + 1)
        part(own[x[own, c] >= cut], every[x[every, c] >= cut], at + 1)

    for _ in range(trees):
        part(r.choice(n, size, replace=False), np.arange(n), 0)
    return 2 ** (-(depth / trees) / max(mean(size), 1e-9))


def local_outlier_factor(d: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    n = len(d)
    k = min(k, n - 1)
    if k < 1:
        return np.ones(n)
    near, reach = nearest(d, k)
    far = reach[:, -1]
    density = 1 / (np.maximum(reach, far[near]).mean(1) + 1e-10)
    return density[near].mean(1) / density


def rank_share(v: np.ndarray) -> np.ndarray:
    """(mean rank - 1) / (n - 1)."""
    if len(v) < 2:
        return np.zeros(len(v))
    _, back, count = np.unique(v, return_inverse=True, return_counts=True)
    first = np.cumsum(count) - count
    return (first + (count - 1) / 2)[back] / (len(v) - 1)


def silhouette(d: np.ndarray, labels: np.ndarray, seed: int = 0) -> float | None:
    own = np.flatnonzero(labels >= 0)
    if len(own) > SILHOUETTE_SAMPLE:
        own = np.sort(np.random.default_rng(seed).choice(own, SILHOUETTE_SAMPLE, replace=False))
    kinds = np.unique(labels[own])
    if len(kinds) < 2 or len(kinds) >= len(own):
        return None
    sums = np.stack([d[np.ix_(own, own[labels[own] == k])].sum(1) for k in kinds], 1)
    sizes = np.array([(labels[own] == k).sum() for k in kinds])
    at = np.searchsorted(kinds, labels[own])
    rows = np.arange(len(own))
    a = sums[rows, at] / np.maximum(sizes[at] - 1, 1)
    other = sums / sizes
    other[rows, at] = np.inf
    b = other.min(1)
    return float(np.where(sizes[at] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-12), 0).mean())


def knee(curve: np.ndarray) -> float:
    """The value of a sorted curve farthest below the line between its ends."""
    if len(curve) < 3 or curve[-1] == curve[0]:
        return float(curve[-1]) if len(curve) else 0.0
    x, y = np.linspace(0, 1, len(curve)), (curve - curve[0]) / (curve[-1] - curve[0])
    return float(curve[int((x - y).argmax())])


def recommend(d: np.ndarray, n_features: int) -> tuple[float, int]:
    """eps and min_samples: of a grid over the distances to the k-th neighbour, the viable pair with the best silhouette,
    then least noise; else the knee."""
    least = min(24, max(4, 2 * n_features))
    k = min(least, len(d) - 1)
    curve = np.sort(np.sort(d, 1)[:, k]) if k > 0 else np.zeros(len(d))
    curve = curve[curve <= np.quantile(curve, 0.975)]
    grid = sorted({float(v) for v in (*np.percentile(curve, range(50, 96, 5)), knee(curve)) if v > 0})
    best: tuple | None = None
    for eps in grid:
        labels = dbscan(d, eps, least)
        noise, n = (labels < 0).mean(), labels.max() + 1
        s = silhouette(d, labels)
        if n >= 2 and noise < 0.9 and s is not None:
            top = np.bincount(labels[labels >= 0]).max() / len(d)
            rank = (top < 0.9, s, -noise)
            if best is None or rank > best[0]:
                best = (rank, eps)
    return (best[1] if best else knee(curve) or 0.5), least


def project(x: np.ndarray, dims: int = 3) -> np.ndarray:
    """Principal components, signs fixed by their largest weight."""
    x = x - x.mean(0)
    _, s, v = np.linalg.svd(x, full_matrices=False)
    v = v[:dims] * np.sign(v[:dims][np.arange(len(v[:dims])), np.abs(v[:dims]).argmax(1)])[:, None]
    return x @ v.T


def _scaled(x: np.ndarray) -> np.ndarray:
    a, m, b = np.percentile(x, (25, 50, 75), axis=0)
    return (x - m) / np.where(b == a, 1, b - a)


def incidence_components(items: Sequence[Sequence | None], k: int = COMPONENTS, seed: int = 0) -> np.ndarray:
    """The first ``k`` principal coordinates of rows by the items they hold (each counts once; signs are arbitrary), by
    subspace iteration over the pairs of row and item. ``k`` is less where there are fewer rows or items; rows without items
    are at 0."""
    held = [sorted(set(filter(lambda v: v is not None, own if own is not None else ())), key=str) for own in items]
    place = {v: j for j, v in enumerate(dict.fromkeys(v for own in held for v in own))}
    n, m = len(held), len(place)
    k = min(k, n - 1, m - 1)
    if k < 1:
        return np.zeros((n, 0))
    rows = np.repeat(np.arange(n), [len(own) for own in held])
    cols = np.array([place[v] for own in held for v in own], int)

    def times(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
        return np.stack([np.bincount(at, v, size) for v in values.T], 1)

    q = np.random.default_rng(seed).normal(size=(m, min(2 * k + 8, n, m)))
    for _ in range(16):
        q = np.linalg.qr(times(rows, q[cols], n))[0]
        q = np.linalg.qr(times(cols, q[rows], m))[0]
    u, sizes, _ = np.linalg.svd(times(rows, q[cols], n), full_matrices=False)
    return (u * sizes)[:, :k]


def recent(df: DataFrame, target: str, order: Sequence[Column], n: int = MAX_TXS) -> DataFrame:
    """The first ``n`` rows of each target; partial limits keep a large target from one task."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(target).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


OUTLIERS = "cluster int, iso double, lof double, noise boolean, votes int, consensus double, score_rank long"


def outliers(df: DataFrame, target: str, row: str, features: Sequence[str], eps: float | None = None, seed: int = 0, items: str | None = None) -> DataFrame:
    """target, row and OUTLIERS: clusters and the ensemble of three detectors for each target of bounded size (see
    ``recent``). Fewer than three rows are not judged. With ``items`` (an array, such as a row's addresses) the features are
    those given and the coordinates of ``incidence_components``."""
    features = list(features)

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(row).reset_index(drop=True)
        x = _scaled(pdf[features].fillna(0).to_numpy(float))
        x = np.hstack([x, incidence_components(pdf[items], seed=seed)]) if items else x
        d = distances(x)
        at, least = (eps, min(24, max(4, 2 * x.shape[1]))) if eps else recommend(d, x.shape[1])
        labels = dbscan(d, at, least)
        iso, lof = rank_share(isolation(x, seed)), rank_share(local_outlier_factor(d))
        noise = labels < 0
        votes = (iso >= 1 - CONTAMINATION).astype(int) + (lof >= 1 - CONTAMINATION) + noise
        consensus = (iso + lof + noise) / 3
        rank = np.empty(len(x), int)
        rank[np.argsort(-consensus, kind="stable")] = np.arange(1, len(x) + 1)
        return pd.DataFrame({target: pdf[target], row: pdf[row], "cluster": labels, "iso": iso, "lof": lof, "noise": noise, "votes": votes, "consensus": consensus, "score_rank": rank})

    few = df.groupBy(target).agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 3").select(target)
    kinds = dict(df.dtypes)
    return df.select(target, row, *features, *([items] if items else [])).join(few, target).groupBy(target).applyInPandas(judge, f"{target} {kinds[target]}, {row} {kinds[row]}, {OUTLIERS}")


def fit_model(clustered: DataFrame, target: str, cluster: str, features: Sequence[str]) -> DataFrame:
    """A frozen model: for each target and cluster (noise left out) its centroid and the radius that holds 95 % of it."""
    own = clustered.filter(F.col(cluster) >= 0)
    centers = own.groupBy(target, cluster).agg(*[F.avg(f).alias(f"c_{f}") for f in features])
    gap = F.sqrt(sum((F.pow(F.col(f) - F.col(f"c_{f}"), 2) for f in features), F.lit(0.0)))
    radius = own.join(centers, [target, cluster]).groupBy(target, cluster).agg(F.percentile(gap, 0.95).alias("radius"))
    return centers.join(radius, [target, cluster])


def classify(df: DataFrame, model: DataFrame, target: str, row: str, cluster: str, features: Sequence[str]) -> DataFrame:
    """row, cluster (-1 outside every radius), distance: new rows against the frozen model of their target."""
    gap = F.sqrt(sum((F.pow(F.col(f) - F.col(f"c_{f}"), 2) for f in features), F.lit(0.0)))
    met = df.join(model, target).select(target, row, cluster, "radius", gap.alias("d"))
    best = met.groupBy(target, row).agg(F.min(F.struct("d", cluster, "radius")).alias("b"))
    return best.select(target, row, F.when(F.col("b.d") <= F.col("b.radius"), F.col(f"b.{cluster}")).otherwise(-1).alias(cluster), F.col("b.d").alias("distance"))


def verdict(explicit: Column, inherited: Column, cluster: Column, votes: Column) -> Column:
    """An explicit label, else its cluster's (never noise's), else an anomaly by two votes, else normal."""
    return F.coalesce(explicit, F.when(cluster >= 0, inherited), F.when(votes >= 2, F.lit("anomaly")), F.lit("normal"))


def cluster_labels(labels: DataFrame, target: str, cluster: str, label: str) -> DataFrame:
    """The label that a cluster hands on: malicious wins over benign."""
    return labels.groupBy(target, cluster).agg(F.max_by(label, F.when(F.col(label) == "malicious", 1).otherwise(0)).alias("inherited"))


def reasons(scaled: dict[str, Column]) -> Column:
    """Up to three features that stand out, by size; else their combination."""
    found = F.filter(F.array(*[F.struct(F.abs(v).alias("m"), F.lit(k).alias("f")) for k, v in scaled.items()]), lambda x: x["m"] >= SOME)
    grade = lambda m: F.when(m >= FAR, "far").when(m >= WELL, "well").otherwise("somewhat")
    top = F.transform(F.slice(F.sort_array(found, asc=False), 1, 3), lambda x: F.concat_ws(" ", grade(x["m"]), F.lit("off in"), x["f"]))
    return F.when(F.size(top) > 0, top).otherwise(F.array(F.lit("combination")))


def refit(drift: Column, coverage: Column, since_fit: Column, least_seconds: int) -> Column:
    return ((drift >= DRIFT) | (coverage < COVERAGE)) & (since_fit >= least_seconds)
