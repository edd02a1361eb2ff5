"""A model of a target's clusters and detectors, fitted once and kept as a row, and verdicts on new rows without fitting again.

The fit sees the rows of a target together, which ``cluster.recent`` bounds. What it keeps: how features were scaled, centroid, radius and
verdict of each cluster, the trees of an isolation forest as arrays of nodes, each training point with the distance to its k-th neighbour
and its local density, and for both detectors the threshold and the range that training rows had. A model has megabytes, so it meets new rows
PART at a time: trees are walked node by node, and the outlier factor comes from the nearest training points.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.lineage import cut
from tidemark.plans.cluster import BLOCK, CONTAMINATION, NEIGHBOURS, SAMPLE, distances, nearest

TREES, RADIUS = 100, 0.95
#: About so many rows of a target are held against its model at once.
PART = 20_000
NODE = "struct<feature:int,cut:double,left:int,right:int,path:double>"
MODEL = (
    "center array<double>, scale array<double>, clusters array<struct<cluster:int,at:array<double>,radius:double,verdict:string>>, "
    f"forest array<array<{NODE}>>, size int, points array<struct<x:array<double>,far:double,density:double>>, k int, "
    "iso struct<threshold:double,lo:double,hi:double>, lof struct<threshold:double,lo:double,hi:double>"
)
ANOMALY, NORMAL = "anomaly", "normal"


def mean_path(n: int) -> float:
    """The mean length of an unsuccessful search in a tree of ``n`` points."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def forest(x: np.ndarray, trees: int, sample: int, seed: int) -> list[list[tuple]]:
    """Isolation trees as nodes (feature, cut, left, right, path): a leaf has -1 for both children, and the path's length to it with what is
    left to part there."""
    r, n = np.random.default_rng(seed), len(x)
    size = min(sample, n)
    limit = int(np.ceil(np.log2(max(2, size))))
    out = []
    for _ in range(trees):
        nodes: list[tuple] = []

        def grow(own: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append((-1, 0.0, -1, -1, depth + mean_path(len(own))))
            spread = x[own].max(0) - x[own].min(0)
            if depth < limit and len(own) > 1 and spread.any():
                c = int(r.choice(np.flatnonzero(spread)))
                cut = float(x[own, c].min() + r.random() * spread[c])
                less = x[own, c] < cut
                if less.any() and not less.all():
                    left, right = grow(own[less], depth + 1), grow(own[~less], depth + 1)
                    nodes[at] = (c, cut, left, right, 0.0)
            return at

        grow(r.choice(n, size, replace=False), 0)
        out.append(nodes)
    return out


def _walked(x: np.ndarray, feature: np.ndarray, cut_at: np.ndarray, left: np.ndarray, right: np.ndarray, path: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Scores of rows by trees whose nodes lie one after the other from ``starts`` on, children by their places there."""
    at = np.tile(starts, (len(x), 1))
    rows = np.arange(len(x))[:, None]
    while (inner := left[at] >= 0).any():
        less = x[rows, feature[at]] < cut_at[at]
        at = np.where(inner, np.where(less, left[at], right[at]), at)
    total = np.zeros(len(x))
    for t in range(len(starts)):
        total += path[at[:, t]]
    return 2 ** (-(total / len(starts)) / max(mean_path(size), 1e-9))


def isolation_scores(x: np.ndarray, trees: list[list[tuple]], size: int) -> np.ndarray:
    starts = np.cumsum([0, *map(len, trees)])[:-1]
    feature, cut_at, left, right, path = (np.concatenate(v) for v in zip(*([np.array(c) for c in zip(*t)] for t in trees)))
    first = np.repeat(starts, [len(t) for t in trees])
    left, right = np.where(left < 0, -1, left + first), np.where(right < 0, -1, right + first)
    return np.concatenate([np.zeros(0), *(_walked(x[i : i + BLOCK], feature, cut_at, left, right, path, starts, size) for i in range(0, len(x), BLOCK))])


def neighbours(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distance to the k-th neighbour, local density and outlier factor of each point among the others."""
    near, reach = nearest(distances(x), k)
    far = reach[:, -1]
    density = 1 / (np.maximum(reach, far[near]).mean(1) + 1e-10)
    return far, density, density[near].mean(1) / density


def fit(df: DataFrame, target: str, cluster: str, features: Sequence[str], verdicts: DataFrame | None = None, trees: int = TREES, contamination: float = CONTAMINATION, seed: int = 0) -> DataFrame:
    """target and MODEL of each target with three rows or more, from rows (target, cluster, features) of bounded number. ``verdicts`` (target, cluster,
    verdict) are handed on to new rows of a cluster; a cluster that it has not hands none on. Null features count as 0."""
    features = list(features)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = pdf[features].fillna(0).to_numpy(float)
        a, m, b = np.percentile(raw, (25, 50, 75), axis=0)
        scale = np.where(b == a, 1, b - a)
        x, labels = (raw - m) / scale, pdf[cluster].to_numpy()
        kinds = []
        for c in np.unique(labels[labels >= 0]):
            own = x[labels == c]
            gap = np.linalg.norm(own - own.mean(0), axis=1)
            said = pdf["_verdict"][labels == c].dropna()
            kinds.append({"cluster": int(c), "at": own.mean(0).tolist(), "radius": float(np.quantile(gap, RADIUS)), "verdict": said.iloc[0] if len(said) else None})
        size, k = min(SAMPLE, len(x)), min(NEIGHBOURS, len(x) - 1)
        grown = forest(x, trees, SAMPLE, seed)
        far, density, lof = neighbours(x, k)
        iso = isolation_scores(x, grown, size)
        bounds = lambda v: {"threshold": float(np.quantile(v, 1 - contamination)), "lo": float(v.min()), "hi": float(v.max())}
        nodes = [[dict(zip(("feature", "cut", "left", "right", "path"), n)) for n in t] for t in grown]
        points = [{"x": p.tolist(), "far": float(f), "density": float(d)} for p, f, d in zip(x, far, density)]
        row = {target: pdf[target].iloc[0], "center": m.tolist(), "scale": scale.tolist(), "clusters": kinds, "forest": nodes, "size": size, "points": points, "k": k, "iso": bounds(iso), "lof": bounds(lof)}
        return pd.DataFrame([row])

    rows = df.select(target, cluster, *features)
    said = rows.withColumn("_verdict", F.lit(None).cast("string")) if verdicts is None else rows.join(verdicts.select(target, cluster, F.col("verdict").alias("_verdict")), [target, cluster], "left")
    few = rows.groupBy(target).agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 3").select(target)
    return said.join(few, target).groupBy(target).applyInPandas(one, f"{target} {dict(df.dtypes)[target]}, {MODEL}")


class _Model:
    """A row of a model as arrays."""

    def __init__(self, row: pa.StructScalar):
        plain = lambda v, f: np.asarray(v.field(f))
        self.center, self.scale = (np.array(row[n].as_py(), float) for n in ("center", "scale"))
        self.clusters, self.size, self.k, self.iso, self.lof = (row[n].as_py() for n in ("clusters", "size", "k", "iso", "lof"))
        trees = row["forest"].values
        nodes, self.starts = trees.flatten(), np.cumsum([0, *trees.value_lengths().to_pylist()])[:-1]
        first = np.repeat(self.starts, trees.value_lengths().to_pylist())
        self.feature, self.cut_at, self.path = plain(nodes, "feature"), plain(nodes, "cut"), plain(nodes, "path")
        self.left, self.right = (np.where(c < 0, -1, c + first) for c in (plain(nodes, "left"), plain(nodes, "right")))
        points = row["points"].values
        far, density = plain(points, "far"), plain(points, "density")
        order = np.lexsort((density, far))  # of points as near as each other those that are first in this order count
        self.points, self.far, self.density = np.asarray(points.field("x").flatten()).reshape(len(points), -1)[order], far[order], density[order]

    def outlier_factors(self, x: np.ndarray) -> np.ndarray:
        d, k = _gaps(x, self.points), min(self.k, len(self.points))
        within = d <= np.partition(d, k - 1, 1)[:, k - 1 : k]
        near = np.empty((len(x), k), int)
        for many in (False, True):  # more than k where points are as far as each other
            rows = np.flatnonzero((within.sum(1) != k) == many)
            if len(rows):
                near[rows] = np.argsort(d[rows], 1, kind="stable")[:, :k] if many else np.nonzero(within[rows])[1].reshape(len(rows), k)
        reach = np.take_along_axis(d, near, 1)
        order = np.argsort(reach, 1, kind="stable")
        near, reach = np.take_along_axis(near, order, 1), np.take_along_axis(reach, order, 1)
        wide, dense = np.zeros(len(x)), np.zeros(len(x))
        for j in range(k):
            wide, dense = wide + np.maximum(reach[:, j], self.far[near[:, j]]), dense + self.density[near[:, j]]
        return dense / k * (wide / k + 1e-10)


def _gaps(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    d = np.zeros((len(x), len(points)))
    for f in range(x.shape[1]):
        d += (x[:, f, None] - points[None, :, f]) ** 2
    return np.sqrt(d)


def _votes(v: np.ndarray, bounds: dict) -> tuple[np.ndarray, np.ndarray]:
    """Whether scores are at the threshold or above, and where they lie in the range of training rows, cut to 0..1. What isn't a number is above all."""
    odd, wide = np.isnan(v), bounds["hi"] - bounds["lo"]
    share = np.where(odd, 1.0, np.clip((v - bounds["lo"]) / wide, 0.0, 1.0)) if wide > 0 else np.zeros(len(v))
    return ((v >= bounds["threshold"]) | odd).astype(np.int32), share


def _judged(raw: np.ndarray, m: _Model) -> tuple[np.ndarray, ...]:
    """cluster, iso, lof, votes, consensus, verdict of a block of rows."""
    x = (raw - m.center) / m.scale
    home, inside, said = np.full(len(x), -1, np.int32), np.zeros(len(x), bool), np.full(len(x), None, object)
    if m.clusters:
        known = sorted(m.clusters, key=lambda c: c["cluster"])
        d = _gaps(x, np.array([c["at"] for c in known], float))
        best = d.argmin(1)
        inside = d[np.arange(len(x)), best] <= np.array([c["radius"] for c in known])[best]
        home, said = np.where(inside, np.array([c["cluster"] for c in known], np.int32)[best], home), np.where(inside, np.array([c["verdict"] for c in known], object)[best], said)
    iso, lof = _walked(x, m.feature, m.cut_at, m.left, m.right, m.path, m.starts, m.size), m.outlier_factors(x)
    (v_iso, s_iso), (v_lof, s_lof) = _votes(iso, m.iso), _votes(lof, m.lof)
    votes, consensus = v_iso + v_lof, (np.where(inside, 0.0, 1.0) + s_lof + s_iso) / 3
    verdict = np.where(pd.isna(said), np.where(votes >= 2, ANOMALY, NORMAL).astype(object), said)
    return home, iso, lof, votes, consensus, verdict


def classify(df: DataFrame, model: DataFrame, target: str, row: str, features: Sequence[str]) -> DataFrame:
    """target, row, cluster, iso, lof, votes, consensus, verdict of new rows by the model of their target; rows whose target has none are left
    out. cluster is -1 outside the radius of the nearest one. Both detectors vote from their thresholds on; being outside every cluster
    is none, as it tells what the detectors tell. The verdict is the cluster's, else an anomaly where both vote.

    The rows of a large target are dealt to parts by their ids, and each part gets its model."""
    features, kinds = list(features), dict(df.dtypes)
    large = F.broadcast(cut(df.groupBy(target).agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("_parts")).filter("_parts > 1")))
    parts = F.coalesce("_parts", F.lit(1))
    rows = df.select(target, row, *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features]).join(large, target, "left")
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(F.col(row), *features), parts).cast("int")).drop("_parts")
    model = model.join(large, target, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")

    def one(new: pa.Table, of: pa.Table) -> pa.Table:
        own = new.select([target, row])
        if not of.num_rows or not new.num_rows:
            blank = [np.zeros(0, np.int32), np.zeros(0), np.zeros(0), np.zeros(0, np.int32), np.zeros(0), np.zeros(0, object)]
            found, own = blank, own.slice(0, 0)
        else:
            m = _Model(of.combine_chunks().to_batches()[0].to_struct_array()[0])
            raw = np.stack([np.asarray(new[f].combine_chunks()) for f in features], 1)
            found = [np.concatenate(v) for v in zip(*(_judged(raw[i : i + BLOCK], m) for i in range(0, len(raw), BLOCK)))]
        for name, v, kind in zip(("cluster", "iso", "lof", "votes", "consensus", "verdict"), found, (pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.float64(), pa.string())):
            own = own.append_column(name, pa.array(v, kind))
        return own

    key = [target, "_part"]
    return rows.groupBy(*key).cogroup(model.groupBy(*key)).applyInArrow(one, f"{target} {kinds[target]}, {row} {kinds[row]}, cluster int, iso double, lof double, votes int, consensus double, verdict string")


def scaled_positions(d: np.ndarray, dims: int = 3) -> np.ndarray:
    """Classical multidimensional scaling: coordinates whose distances come nearest to those of a matrix, from the largest
    eigenvectors of the doubly centred squares. Signs are fixed by each coordinate's largest value; coordinates without weight are 0."""
    n = len(d)
    if n == 0:
        return np.zeros((0, dims))
    squares = np.asarray(d, float) ** 2
    centred = -0.5 * (squares - squares.mean(0) - squares.mean(1)[:, None] + squares.mean())
    values, vectors = np.linalg.eigh(centred)
    order = np.argsort(-values, kind="stable")[:dims]
    out = np.zeros((n, dims))
    kept = vectors[:, order] * np.sqrt(np.maximum(values[order], 0))
    signs = np.sign(kept[np.abs(kept).argmax(0), np.arange(kept.shape[1])])
    out[:, : kept.shape[1]] = kept * np.where(signs == 0, 1, signs)
    return out


def positions(df: DataFrame, target: str, row: str, features: Sequence[str], dims: int = 3) -> DataFrame:
    """target, row, at (array of ``dims`` doubles): where the rows of a target, of bounded number, lie on a map that keeps their distances."""
    features, kinds = list(features), dict(df.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(row).reset_index(drop=True)
        at = scaled_positions(distances(pdf[features].fillna(0).to_numpy(float)), dims)
        return pd.DataFrame({target: pdf[target], row: pdf[row], "at": at.tolist()})

    return df.select(target, row, *features).groupBy(target).applyInPandas(one, f"{target} {kinds[target]}, {row} {kinds[row]}, at array<double>")
