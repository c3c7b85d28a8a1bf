"""Clusters of the vectors of one video: density clusters with a k-means fallback, splits and gates.

The functions work on the matrix of one group; ``fit_clusters`` runs them for all groups in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.operators import clusters as C


@dataclass(frozen=True)
class FitSettings:
    min_size: int = 6
    min_samples: int = 2
    max_count: int = 10
    reduce_from: int = 150
    reduce_to: int = 64
    accept_noise: float = 0.35
    accept_small_noise: float = 0.50
    soft: float = 0.50
    noise_split_size: int = 60
    noise_split_share: float = 0.35
    noise_split_target: int = 15
    split_groups: int = 3
    large_share: float = 0.25
    silhouette_small: float = 0.05
    silhouette_large: float = 0.08
    group_coherence: float = 0.18
    mean_coherence: float = 0.30
    # splits of large clusters
    split_coherence: float = 0.72
    split_gain: float = 0.06
    dominant_share: float = 0.72
    topic_coherence: float = 0.45
    # ambiguous rows, rows that are removed, clusters that are collapsed
    ambiguous_confidence: float = 0.65
    ambiguous_margin: float = 0.12
    low_confidence: float = 0.35
    low_cosine: float = 0.25
    ambiguous_share: float = 0.45
    emerging_coherence: float = 0.70


def unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1.0)


def reduced(x: np.ndarray, dims: int) -> tuple[np.ndarray, float]:
    """Principal components, rows of length 1, and the share of variance they keep."""
    c = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    k = min(dims, len(s))
    total = float((s**2).sum())
    return unit_rows(c @ vt[:k].T), float((s[:k] ** 2).sum()) / total if total else 0.0


def distances(x: np.ndarray) -> np.ndarray:
    sq = (x * x).sum(axis=1)
    d = np.sqrt(np.maximum(sq[:, None] + sq[None, :] - 2 * x @ x.T, 0.0))
    np.fill_diagonal(d, 0.0)
    return d


def _rows_at_once(n: int) -> int:
    """Rows of distances to ``n`` points that are held at a time: all of them up to 4096, else 128 MB."""
    return n if n <= 4096 else max(1, 2**24 // n)


def _distances_to(x: np.ndarray, sq: np.ndarray, at: slice) -> np.ndarray:
    d = np.sqrt(np.maximum(sq[at, None] + sq[None, :] - 2 * x[at] @ x.T, 0.0))
    d[np.arange(len(d)), np.arange(len(x))[at]] = 0.0
    return d


def silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    """Mean euclidean silhouette over all rows; -1 for fewer than two clusters."""
    kinds, at = np.unique(labels, return_inverse=True)
    if len(kinds) < 2 or len(kinds) >= len(labels):
        return -1.0
    size, sq, step = np.bincount(at), (x * x).sum(axis=1), _rows_at_once(len(x))
    sums = np.vstack([np.stack([d[:, at == k].sum(axis=1) for k in range(len(kinds))], axis=1) for i in range(0, len(x), step) for d in [_distances_to(x, sq, slice(i, i + step))]])
    rows = np.arange(len(labels))
    inner = sums[rows, at] / np.maximum(size[at] - 1, 1)
    mean = sums / size
    mean[rows, at] = np.inf
    outer = mean.min(axis=1)
    s = np.where(size[at] > 1, (outer - inner) / np.maximum(np.maximum(outer, inner), 1e-12), 0.0)
    return float(s.mean())


def _spanning_tree(x: np.ndarray, samples: int) -> np.ndarray:
    """Edges (a, b, length) of the minimum spanning tree of mutual reachability, by length.

    The distances of small groups are held; those of large ones are computed row by row as they are needed.
    """
    n, sq, at = len(x), (x * x).sum(axis=1), min(samples, len(x) - 1)
    step = _rows_at_once(n)
    d = distances(x) if step == n else None
    core = np.concatenate([np.partition(d if d is not None else _distances_to(x, sq, slice(i, i + step)), at, axis=1)[:, at] for i in range(0, n, step)])
    inside = np.zeros(n, bool)
    best, source = np.full(n, np.inf), np.zeros(n, np.int64)
    edges = np.zeros((n - 1, 3))
    now = 0
    for i in range(n - 1):
        inside[now] = True
        row = d[now] if d is not None else _distances_to(x, sq, slice(now, now + 1))[0]
        reach = np.maximum(np.maximum(row, core[now]), core)
        closer = ~inside & (reach < best)
        best[closer], source[closer] = reach[closer], now
        now = int(np.where(inside, np.inf, best).argmin())
        edges[i] = source[now], now, best[now]
    return edges[np.argsort(edges[:, 2], kind="stable")]


def density_clusters(x: np.ndarray, min_size: int, samples: int, epsilon: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Labels (-1 for noise) and membership of hierarchical density clustering, by excess of mass."""
    n = len(x)
    labels, strength = np.full(n, -1), np.zeros(n)
    if n < max(2, min_size):
        return labels, strength
    # dendrogram: node n + i joins two nodes at a distance
    parent = np.arange(2 * n - 1)
    left, right, height, size = np.zeros(n - 1, np.int64), np.zeros(n - 1, np.int64), np.zeros(n - 1), np.ones(2 * n - 1, np.int64)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, (a, b, h) in enumerate(_spanning_tree(x, samples)):
        ra, rb = root(int(a)), root(int(b))
        left[i], right[i], height[i] = ra, rb, max(h, 1e-9)
        size[n + i] = size[ra] + size[rb]
        parent[ra] = parent[rb] = n + i

    def leaves(node: int) -> list[int]:
        out, stack = [], [node]
        while stack:
            k = stack.pop()
            if k < n:
                out.append(k)
            else:
                stack += [left[k - n], right[k - n]]
        return out

    # condensed tree: a cluster lives until it falls apart into two that are large enough
    birth, stability, children, members = {0: 0.0}, {0: 0.0}, {0: []}, {0: []}
    stack, count = [(2 * n - 2, 0)], 1
    while stack:
        node, c = stack.pop()
        lam = 1.0 / height[node - n]
        parts = [left[node - n], right[node - n]]
        big = [p for p in parts if size[p] >= min_size]
        if len(big) == 2 and height[node - n] > epsilon:
            stability[c] += (lam - birth[c]) * size[node]
            for p in parts:
                birth[count], stability[count], children[count], members[count] = lam, 0.0, [], []
                children[c].append(count)
                if p >= n:
                    stack.append((p, count))
                else:
                    members[count].append((p, lam))
                count += 1
            continue
        keep = max(parts, key=lambda p: size[p]) if big else None
        for p in parts:
            if p == keep and p >= n:
                stack.append((p, c))
            else:
                stability[c] += (lam - birth[c]) * size[p]
                members[c] += [(q, lam) for q in leaves(p)]
    chosen: set[int] = set()
    value = dict(stability)
    for c in range(count - 1, 0, -1):
        below = sum(value[k] for k in children[c])
        if children[c] and below > stability[c]:
            value[c] = below
        else:
            drop = list(children[c])
            while drop:
                k = drop.pop()
                chosen.discard(k)
                drop += children[k]
            chosen.add(c)
    for label, c in enumerate(sorted(chosen)):
        got, stack2 = [], [c]
        while stack2:
            k = stack2.pop()
            got += members[k]
            stack2 += children[k]
        top = max((lam for _, lam in got), default=1.0)
        for p, lam in got:
            labels[p], strength[p] = label, min(1.0, lam / top)
    return labels, strength


def k_means(x: np.ndarray, k: int, tries: int = 5, seed: int = 42) -> np.ndarray:
    """Labels of Lloyd's algorithm from spread-out starts, the best of several tries."""
    r = np.random.default_rng(seed)
    best, labels = np.inf, np.zeros(len(x), np.int64)
    for _ in range(tries):
        centers = x[[r.integers(len(x))]]
        while len(centers) < k:
            d = ((x[:, None] - centers[None]) ** 2).sum(axis=2).min(axis=1)
            total = d.sum()
            centers = np.vstack([centers, x[r.choice(len(x), p=d / total) if total > 0 else r.integers(len(x))]])
        for _ in range(60):
            d = ((x[:, None] - centers[None]) ** 2).sum(axis=2)
            at = d.argmin(axis=1)
            new = np.stack([x[at == j].mean(axis=0) if (at == j).any() else centers[j] for j in range(k)])
            if np.allclose(new, centers):
                break
            centers = new
        inertia = float(d.min(axis=1).sum())
        if inertia < best - 1e-12:
            best, labels = inertia, at
    return labels


def coherence(x: np.ndarray) -> float:
    """Mean cosine to the centroid, within 0 and 1."""
    c = x.mean(axis=0)
    n = np.linalg.norm(x, axis=1) * np.linalg.norm(c)
    return float(np.clip(np.where(n > 0, x @ c / np.where(n > 0, n, 1.0), 0.0).mean(), 0.0, 1.0))


def grid(n: int, s: FitSettings) -> list[tuple[int, int, float]]:
    """Sizes, samples and distances to try, coarser for larger groups."""
    base = max(3, min(s.min_size, max(3, n // 4)))
    sizes = sorted({base, max(3, base // 2), max(3, min(n // 3 or 3, round(np.sqrt(n)))), max(3, min(n // 3 or 3, base * 2))})
    return [(size, samples, eps) for size in sizes for samples in sorted({1, s.min_samples}) for eps in (0.0, 0.1)]


def fit_labels(x: np.ndarray, s: FitSettings) -> tuple[np.ndarray, np.ndarray]:
    """Labels and membership of the best try: covered rows, silhouette and number of clusters are weighed.

    The first try that leaves little noise and separates well is taken at once. If no try finds a
    cluster, k-means with the best silhouette takes over.
    """
    n = len(x)
    wanted = max(2, min(s.max_count, round(np.sqrt(n / 12.0)) + 1))
    best, out = -np.inf, (np.full(n, -1), np.zeros(n))
    for size, samples, eps in grid(n, s):
        labels, strength = density_clusters(x, size, samples, eps)
        found = len(set(labels.tolist()) - {-1})
        noise = float((labels == -1).mean())
        sil = silhouette(x, labels) if found >= 2 else -1.0
        score = 3.0 * (1.0 - noise) + 2.5 * (sil if sil >= 0 else 2.0 * sil) + 1.5 * (1.0 - min(1.0, 0.8 * abs(found - wanted) / wanted))
        if score > best:
            best, out = score, (labels, strength)
        calm = noise <= s.accept_noise and found >= 2 and (sil >= 0.08 or (noise <= 0.6 * s.accept_noise and sil >= 0.0))
        if calm or (n < 40 and found >= 1 and noise <= s.accept_small_noise):
            return labels, strength
    if (out[0] == -1).all() and n >= 4:
        tries = [(silhouette(x, at), k, at) for k in range(2, max(3, min(s.max_count, n // max(2, s.min_samples)) + 1)) if (np.bincount(at := k_means(x, k), minlength=k) >= max(2, s.min_samples)).all()]
        if tries:
            return max(tries, key=lambda t: (t[0], -t[1]))[2], np.full(n, 0.75)
    return out


def passes_gate(x: np.ndarray, groups: Sequence[np.ndarray], s: FitSettings) -> bool:
    """Whether a split separates its groups and keeps each together."""
    if len(groups) < 2:
        return False
    at = np.concatenate(groups)
    sil = silhouette(x[at], np.repeat(np.arange(len(groups)), [len(g) for g in groups]))
    held = [coherence(x[g]) for g in groups]
    return sil >= (s.silhouette_small if len(at) < 80 else s.silhouette_large) and float(np.mean(held)) >= s.mean_coherence and min(held) >= s.group_coherence


@dataclass
class Assigned:
    """What the fit says of each row: label (-1 for noise), confidence, and whether it is ambiguous or joined softly."""

    labels: np.ndarray
    confidence: np.ndarray
    ambiguous: np.ndarray
    soft: np.ndarray


def assigned(unit: np.ndarray, s: FitSettings) -> Assigned:
    """Labels of the fit; noise near a cluster joins it. Centroids are those of the fit, before rows join."""
    n = len(unit)
    work = reduced(unit, s.reduce_to)[0] if n >= s.reduce_from and unit.shape[1] > s.reduce_to else unit
    labels, strength = fit_labels(work, s)
    kinds = np.array(sorted(set(labels.tolist()) - {-1}), int)
    if not len(kinds):
        return Assigned(labels, np.zeros(n), np.ones(n, bool), np.zeros(n, bool))
    near = np.maximum(work @ unit_rows(np.stack([work[labels == k].mean(axis=0) for k in kinds])).T, 0.0)
    order = np.sort(near, axis=1)
    top, second = order[:, -1], order[:, -2] if len(kinds) > 1 else np.zeros(n)
    soft = (labels == -1) & (top >= s.soft)
    confidence = np.minimum(1.0, np.where(labels == -1, top, np.maximum(strength, top)))
    labels = np.where(soft, kinds[near.argmax(axis=1)], labels)
    ambiguous = (labels == -1) | (confidence < s.ambiguous_confidence) | (confidence - second < s.ambiguous_margin)
    return Assigned(labels, confidence, ambiguous, soft)


def split_noise(unit: np.ndarray, noise: np.ndarray, keys: np.ndarray, s: FitSettings) -> None:
    """Name the groups of large noise in ``keys``, where the gate lets them pass."""
    if noise.sum() < s.noise_split_size or noise.mean() < s.noise_split_share:
        return
    at = np.flatnonzero(noise)
    k = min(s.split_groups, max(2, round(len(at) / s.noise_split_target)))
    part = k_means(unit[at], k)
    groups = sorted((at[part == j] for j in range(k) if (part == j).sum() >= max(3, s.min_samples)), key=len, reverse=True)
    if passes_gate(unit, groups, s):
        keys[at] = None  # rows of groups that are too small are in none
        for j, g in enumerate(groups, 1):
            keys[g] = f"emerging_{j}"


def large_parts(unit: np.ndarray, at: np.ndarray, n: int, s: FitSettings) -> list[np.ndarray]:
    """The parts of three rows or more into which k-means cuts a large cluster; none for a cluster that is not large among ``n`` rows."""
    if len(at) < max(12, s.min_size, s.large_share * n):
        return []
    k = max(2, min(4, round(len(at) / max(6, s.noise_split_target))))
    part = k_means(unit[at], k)
    return sorted((at[part == j] for j in range(k) if (part == j).sum() >= 3), key=len, reverse=True)


def split_large(unit: np.ndarray, keys: np.ndarray, fit: Assigned, s: FitSettings) -> None:
    """Name the parts of large clusters in ``keys``, where the gate lets them pass; rows of parts that are too small are in none."""
    for key in [k for k in _named(keys) if k.startswith("cluster_")]:
        at = np.flatnonzero(keys == key)
        groups = large_parts(unit, at, len(keys), s)
        if groups and passes_large_gate(unit, at, groups, fit, s):
            keys[at] = None
            for j, g in enumerate(groups):
                keys[g] = f"{key}_sub{j}"


def passes_large_gate(unit: np.ndarray, at: np.ndarray, groups: Sequence[np.ndarray], fit: Assigned, s: FitSettings) -> bool:
    """Whether a split of the large cluster ``at`` makes clearly cleaner groups out of a mixed one."""
    if not passes_gate(unit, groups, s):
        return False
    whole, ambiguous = coherence(unit[at]), float(fit.ambiguous[at].mean())
    if whole >= max(s.split_coherence, s.topic_coherence + 0.12) and float(fit.confidence[at].mean()) >= 0.78 and ambiguous <= 0.30:
        return False
    held = [coherence(unit[g]) for g in groups]
    gain = sum(len(g) * h for g, h in zip(groups, held, strict=True)) / len(at) - whole
    largest = max(map(len, groups)) / len(at)
    if largest >= s.dominant_share or (largest > 0.8 and gain < max(0.08, s.split_gain + 0.01)):
        return False
    centers = unit_rows(np.stack([unit[g].mean(axis=0) for g in groups]))
    alike = max(0.0, float((centers @ centers.T)[np.triu_indices(len(groups), 1)].max()))
    if whole >= s.split_coherence and gain < max(s.split_gain + 0.01, 0.07):
        return False
    if alike > 0.92 and gain < max(s.split_gain + 0.01, 0.08):
        return False
    if gain >= s.split_gain and min(held) >= max(0.34, whole + 0.02):
        return True
    return whole < max(s.split_coherence, s.topic_coherence) and ambiguous >= 0.35 and gain >= 0.03 and alike <= 0.9


def _named(keys: np.ndarray) -> list[str]:
    return sorted({k for k in keys.tolist() if k is not None})


def drop_low_quality(unit: np.ndarray, keys: np.ndarray, fit: Assigned, s: FitSettings) -> None:
    """Take rows of low confidence, or far from their cluster's centroid, out of ``keys``, then clusters that are too small.

    As in the reference, clusters are only looked at where some row is taken out.
    """
    bad = (fit.confidence < s.low_confidence) & np.array([k is not None for k in keys])
    for k in _named(keys):
        at = np.flatnonzero(keys == k)
        bad[at[unit[at] @ unit_rows(unit[at].mean(axis=0)[None])[0] < s.low_cosine]] = True
    if not bad.any():
        return
    keys[bad] = None
    for k in _named(keys):
        if (keys == k).sum() < max(3, s.min_samples):
            keys[keys == k] = None


def collapse_small(unit: np.ndarray, keys: np.ndarray, fit: Assigned, s: FitSettings) -> None:
    """Move small clusters that are incoherent or ambiguous to ``emerging_other``; drop an incoherent one that was there before."""
    names = _named(keys)
    if len(names) < 2:
        return
    moved, n = [], len(keys)
    for k in names:
        at = np.flatnonzero(keys == k)
        held = coherence(unit[at])
        if k == "emerging_other" and held < s.emerging_coherence:
            keys[at] = None
            continue
        small = len(at) < max(12, 2 * s.min_size) and len(at) / n < max(0.06, s.large_share / 4)
        if small and (held < max(0.28, s.topic_coherence - 0.08) or float(fit.ambiguous[at].mean()) >= s.ambiguous_share):
            moved.append(at)
    for at in moved:
        keys[at] = "emerging_other"


def cluster_rows(x: np.ndarray, s: FitSettings = FitSettings(), weight: np.ndarray | None = None) -> pd.DataFrame:  # noqa: B008
    """Cluster key, confidence, second key and flags of each row of one video's matrix.

    Rows that the quality filter or the collapse removes stay in the result with a null key.
    """
    n = len(x)
    unit = unit_rows(np.asarray(x, float))
    weight = np.ones(n) if weight is None else np.asarray(weight, float)
    cols = ["cluster_key", "confidence", "second_key", "second_confidence", "is_ambiguous", "is_soft", "is_noise"]
    if n < max(3, s.min_size):
        return pd.DataFrame([("emerging_other", 1.0, None, 0.0, False, False, False)] * n, columns=cols)
    fit = assigned(unit, s)
    keys = np.array([f"cluster_{k}" if k >= 0 else "emerging_other" for k in fit.labels], object)
    noise = fit.labels == -1
    split_noise(unit, noise, keys, s)
    split_large(unit, keys, fit, s)
    drop_low_quality(unit, keys, fit, s)
    names = _named(keys)
    if 0 < s.max_count < len(names):
        share = {k: float(weight[keys == k].sum()) for k in names}
        keys[np.isin(keys, sorted(names, key=lambda k: (-share[k], k))[max(0, s.max_count - 1) :])] = "emerging_other"
    collapse_small(unit, keys, fit, s)
    names = _named(keys)
    if not names:
        return pd.DataFrame({"cluster_key": keys, "confidence": fit.confidence, "second_key": [None] * n, "second_confidence": 0.0, "is_ambiguous": fit.ambiguous, "is_soft": fit.soft, "is_noise": noise})
    near = unit @ unit_rows(np.stack([unit[keys == k].mean(axis=0) for k in names])).T
    for j, k in enumerate(names):
        near[keys == k, j] = -np.inf
    second = near.argmax(axis=1)
    value = near[np.arange(n), second]
    has = np.isfinite(value)
    return pd.DataFrame({"cluster_key": keys, "confidence": fit.confidence, "second_key": [names[j] if h else None for j, h in zip(second, has, strict=True)], "second_confidence": np.where(has, value, 0.0), "is_ambiguous": fit.ambiguous, "is_soft": fit.soft, "is_noise": noise})


#: Rows of one group that are fitted together, twice what a run collects of a video at most.
MOST = 3000
ASSIGNED = "cluster_key string, confidence double, second_key string, second_confidence double, is_ambiguous boolean, is_soft boolean, is_noise boolean"


def fit_clusters(points: DataFrame, group: str, id_col: str = "id", vector: str = "v", s: FitSettings = FitSettings(), weight: str | None = None, most: int = MOST) -> DataFrame:  # noqa: B008
    """Cluster assignments of all groups (videos) at once, one task a group. Without ``weight`` each row weighs 1.

    A fit's time grows with the square of its rows. A group of up to ``most`` rows is fitted whole; of a
    larger one the ``most`` rows with the least hashes of their ids are, and all its other rows join the
    nearest cluster of that fit: softly, as noise does, or to none where it is too far. They are spread
    over tasks, so that no task holds a group larger than ``most``.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(id_col)
        out = cluster_rows(np.stack(part[vector].to_numpy()), s, part[weight].to_numpy() if weight else None)
        return pd.concat([part[[group, id_col]].reset_index(drop=True), out], axis=1)

    kind = dict(points.dtypes)
    cols = [group, id_col, vector, *([weight] if weight else [])]
    first, rest = sample_and_rest(points.select(*cols), group, id_col, most)
    fitted = first.groupBy(group).applyInPandas(run, f"{group} {kind[group]}, {id_col} {kind[id_col]}, {ASSIGNED}")
    return fitted.unionByName(_joined_softly(fitted, first, rest, group, id_col, vector, s))


def sample_and_rest(points: DataFrame, group: str, id_col: str, most: int) -> tuple[DataFrame, DataFrame]:
    """The ``most`` rows of each group with the least hashes of their ids, and all others."""
    place = F.row_number().over(W.partitionBy(group).orderBy(F.xxhash64(id_col), id_col))
    first = points.withColumn("_place", place).filter(F.col("_place") <= most).drop("_place")
    large = points.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select(group)
    rest = points.join(large, group, "left_semi").join(first.select(id_col), id_col, "left_anti")
    return first, rest.select(*points.columns)


def _joined_softly(fitted: DataFrame, first: DataFrame, rest: DataFrame, group: str, id_col: str, vector: str, s: FitSettings) -> DataFrame:
    """Rows that were not fitted, with the nearest of the fitted clusters of their group."""
    known = fitted.filter(F.col("cluster_key").isNotNull() & (F.col("cluster_key") != "emerging_other")).select(id_col, "cluster_key").join(first.select(group, id_col, F.col(vector).alias("v")), id_col)
    names = C.centroids(known, [group, "cluster_key"]).withColumn("at", F.row_number().over(W.partitionBy(group).orderBy("cluster_key")))
    near = C.nearest_two(rest.select(group, F.col(id_col).alias("id"), F.col(vector).alias("v")), names, "at", run=[group])
    label = names.select(group, F.col("at").alias("primary"), F.col("cluster_key").alias("key"))
    other = names.select(group, F.col("at").alias("secondary"), F.col("cluster_key").alias("second_key"))
    j = near.join(label, [group, "primary"], "left").join(other, [group, "secondary"], "left")
    cos, second = F.greatest(F.coalesce("primary_cos", F.lit(0.0)), F.lit(0.0)), F.greatest(F.coalesce("secondary_cos", F.lit(0.0)), F.lit(0.0))
    soft = F.col("key").isNotNull() & (cos >= s.soft)
    return j.select(
        group, F.col("id").alias(id_col), F.when(soft, F.col("key")).alias("cluster_key"), F.least(F.lit(1.0), cos).alias("confidence"), "second_key", second.alias("second_confidence"),
        (~soft | (cos < s.ambiguous_confidence) | (cos - second < s.ambiguous_margin)).alias("is_ambiguous"), soft.alias("is_soft"), (~soft).alias("is_noise"),
    )


def sub_clusters(x: np.ndarray) -> np.ndarray:
    """Labels of positions inside a topic: density clusters from 6 rows on, else k-means."""
    n = len(x)
    unit = unit_rows(np.asarray(x, float))
    if n < 4:
        return np.zeros(n, np.int64)
    if n >= 6:
        labels, _ = density_clusters(unit, int(np.clip(round(0.75 * np.sqrt(n)), 2, 8)), 1)
        if len(set(labels.tolist()) - {-1}) >= 2:
            return labels
    most = min(max(8, round(2.5 * np.sqrt(n))), n - 1)
    tries = [(silhouette(unit, at), -k, at) for k in range(2, min(most, 8) + 1) for at in [k_means(unit, k)]]
    best = max(tries, key=lambda t: t[:2])
    return best[2] if best[0] > 0 else np.zeros(n, np.int64)


def merged_clusters(centroids: np.ndarray, sizes: np.ndarray, keywords: Sequence[set[str]], cosine: float = 0.88, jaccard: float = 0.20, rounds: int = 3) -> list[int]:
    """For each cluster the cluster it ends up in: near centroids with shared keywords are merged, largest first."""
    c, n = [v.astype(float) for v in centroids], sizes.astype(float).copy()
    words, home = [set(k) for k in keywords], list(range(len(sizes)))
    alive = list(range(len(sizes)))
    for _ in range(rounds):
        alive.sort(key=lambda i: (-n[i], i))
        changed, gone = False, set()
        for i in alive:
            for j in alive:
                if i == j or i in gone or j in gone or (n[j], -j) > (n[i], -i):
                    continue
                length = np.linalg.norm(c[i]) * np.linalg.norm(c[j])
                union = words[i] | words[j]
                if length > 0 and c[i] @ c[j] / length >= cosine and union and len(words[i] & words[j]) / len(union) >= jaccard:
                    c[i] = (c[i] * n[i] + c[j] * n[j]) / (n[i] + n[j])
                    n[i] += n[j]
                    words[i] |= words[j]
                    gone.add(j)
                    home = [i if h == j else h for h in home]
                    changed = True
        alive = [i for i in alive if i not in gone]
        if not changed:
            break
    return home
