"""One step at a time over a matrix of all distances: what the distributed choices are compared with."""

from __future__ import annotations

from collections import Counter

import numpy as np


def matrix(points: np.ndarray) -> np.ndarray:
    square = (points**2).sum(axis=1)
    d = square[:, None] + square[None, :] - 2 * points @ points.T
    np.fill_diagonal(d, 0)
    return np.sqrt(np.maximum(d, 0))


def farthest_points(d: np.ndarray, k: int, groups: list | None = None, cap: int | None = None, start: int | None = None, soft: list | None = None, soft_cap: int | None = None, penalty: np.ndarray | None = None, twin: float = 0.0, seed: list[int] | None = None, relax: bool = False) -> list[int]:
    """Greedy max-min choice of k points. No more than ``cap`` of a group; ``soft_cap`` of a soft group while any
    other candidate is left. ``penalty`` lowers a point's score; points nearer than ``twin`` to a chosen one are
    left out. With ``relax`` the caps give way where they leave no candidate. A running distance to the chosen set
    makes a step linear."""
    n = len(d)
    chosen = list(seed or [])
    near = d[chosen].min(axis=0) if chosen else np.full(n, np.inf)
    bias = penalty if penalty is not None else np.zeros(n)
    count: dict = {}
    soft_count: dict = {}
    for i in chosen:
        if groups is not None:
            count[groups[i]] = count.get(groups[i], 0) + 1
        if soft is not None:
            soft_count[soft[i]] = soft_count.get(soft[i], 0) + 1
    free = np.ones(n, bool)
    free[chosen] = False
    fresh: list[int] = []
    while len(fresh) < k and free.any():
        allowed = free & (near >= twin) if chosen else free.copy()
        if groups is not None and cap is not None:
            capped = allowed & np.array([count.get(g, 0) < cap for g in groups])
            allowed = allowed if relax and not capped.any() else capped
        if soft is not None and soft_cap is not None:
            strict = allowed & np.array([soft_count.get(g, 0) < soft_cap for g in soft])
            allowed = strict if strict.any() else allowed
        if not allowed.any():
            break
        if not chosen:
            first = start if start is not None else int(np.argmax(np.where(allowed, d.mean(axis=1) + bias, -np.inf)))
            at = first
        else:
            at = int(np.argmax(np.where(allowed, near + bias, -np.inf)))
        chosen.append(at)
        fresh.append(at)
        free[at] = False
        near = np.minimum(near, d[at])
        if groups is not None:
            count[groups[at]] = count.get(groups[at], 0) + 1
        if soft is not None:
            soft_count[soft[at]] = soft_count.get(soft[at], 0) + 1
    return fresh


def ward(points: np.ndarray, k: int) -> np.ndarray:
    """Labels of k clusters by Ward's criterion: nearest-neighbour chains, then the k-1 dearest merges undone."""
    n = len(points)
    size, center = np.ones(n), points.astype(float).copy()
    alive, chain, merges = np.ones(n, bool), [], []
    parent = np.arange(n)
    while alive.sum() > 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        a = chain[-1]
        cost = size * size[a] / (size + size[a]) * ((center - center[a]) ** 2).sum(axis=1)
        cost[~alive] = np.inf
        cost[a] = np.inf
        b = int(np.argmin(cost))
        if len(chain) > 1 and cost[chain[-2]] <= cost[b]:
            b = chain[-2]
        if len(chain) > 1 and b == chain[-2]:
            chain = chain[:-2]
            merges.append((float(cost[b]), a, b))
            center[a] = (center[a] * size[a] + center[b] * size[b]) / (size[a] + size[b])
            size[a] += size[b]
            alive[b] = False
        else:
            chain.append(b)

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for _, a, b in sorted(merges)[: max(0, n - k)]:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    roots = [root(i) for i in range(n)]
    order = {r: i for i, r in enumerate(sorted(set(roots)))}
    return np.array([order[r] for r in roots])


def twin_sweep(d: np.ndarray, chosen: list[int], value: np.ndarray, classes: list, threshold: float, most: int = 60, clusters: list | None = None, cluster_cap: int = 5) -> list[int]:
    """While two chosen points are nearer than the threshold, the less valuable one goes. In its place comes a
    point that is no twin and whose cluster has fewer than ``cluster_cap`` points chosen: one of the same class
    before others, the farthest from the rest first."""
    now, classes = list(chosen), np.array(classes)
    used = np.zeros(len(d), bool)
    used[now] = True
    for _ in range(most):
        sub = d[np.ix_(now, now)] + np.eye(len(now)) * 1e9
        if len(now) < 2 or sub.min() >= threshold:
            break
        pair = [now[x] for x in np.unravel_index(int(np.argmin(sub)), sub.shape)]
        out = min(pair, key=lambda x: (value[x], -x))
        now.remove(out)
        used[out] = False
        near = d[now].min(axis=0) if now else np.full(len(d), np.inf)
        free = ~used & (near >= threshold)
        if clusters is not None:
            count = Counter(clusters[x] for x in now)
            free &= np.array([count[c] < cluster_cap for c in clusters])
        pool = np.flatnonzero(free)
        if len(pool):
            best = int(pool[np.lexsort((pool, -near[pool], classes[pool] != classes[out]))[0]])
            now.append(best)
            used[best] = True
    return sorted(now)


def class_ceiling(d: np.ndarray, chosen: list[int], over: np.ndarray, value: np.ndarray, ceiling: int, most: int = 80) -> list[int]:
    """Exchanges the least valuable marked points over the ceiling for unmarked ones, each the farthest from what
    is chosen then. Who leaves is known at the start, so distances to those that are still to leave are suffix
    minima and only the distance to the newcomers runs."""
    picked = np.array(chosen, np.int64)
    marked = picked[over[picked]]
    free = np.setdiff1d(np.flatnonzero(~over), picked)
    swaps = max(0, min(len(marked) - ceiling, len(free), most))
    leaving = marked[np.lexsort((marked, value[marked]))][:swaps]
    staying = np.setdiff1d(picked, leaving)

    def near(to: np.ndarray) -> np.ndarray:
        return d[np.ix_(to, free)].min(axis=0) if len(to) else np.full(len(free), np.inf)

    still = [near(leaving[i + 1 :]) for i in range(swaps)]
    run, open_, come = near(staying), np.ones(len(free), bool), []
    for i in range(swaps):
        score = np.minimum(run, still[i])
        score = np.where(np.isinf(score), 0, score)
        at = int(np.argmax(np.where(open_, score, -1.0)))
        open_[at] = False
        come.append(int(free[at]))
        run = np.minimum(run, d[come[-1], free])
    return sorted([*staying.tolist(), *come])
