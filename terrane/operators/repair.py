"""Repair of recorded partitions: rounded coordinates are moved, as little as possible, until neighbours share their borders."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .decompose import Ring, area

ROUNDS = 12


def repair(rings: list[Ring], fixed: list[Ring], near: float, *, tol: float = 1e-9) -> tuple[list[Ring], float, float]:
    """(rings, largest displacement, largest residual).

    Vertices closer than ``near`` become one point; a point so close to a corner
    of a ``fixed`` ring (boundary, obstacles) is that corner; a point so close to
    the inside of an edge has to lie on it. Gauss-Newton steps of least norm
    move the free points; ValueError if a residual over ``tol`` is left or a
    point has moved by more than ``near``.
    """
    corners = [tuple(map(float, p)) for r in fixed for p in r]
    at: list[tuple[float, float]] = list(corners)
    of: list[list[int]] = []
    start: dict[int, list[tuple[float, float]]] = {}
    for ring in rings:
        own = []
        for p in ring:
            d = [math.dist(p, q) for q in at]
            k = int(np.argmin(d)) if d else -1
            if k < 0 or d[k] > near:
                at.append(tuple(map(float, p)))
                k = len(at) - 1
            start.setdefault(k, []).append(tuple(map(float, p)))
            if not own or own[-1] != k:
                own.append(k)
        of.append(own if own[0] != own[-1] else own[:-1])
    free = np.arange(len(corners), len(at))
    x = np.array(at, dtype=float)
    for k in free:
        x[k] = np.mean(start[int(k)], axis=0)
    sides = {(min(a, b), max(a, b)) for own in of for a, b in zip(own, [*own[1:], own[0]], strict=True)}
    n = 0
    for r in fixed:
        sides |= {(min(n + i, n + (i + 1) % len(r)), max(n + i, n + (i + 1) % len(r))) for i in range(len(r))}
        n += len(r)
    used = sorted(start)
    triples = []
    for a, b in sorted(sides):
        v = x[b] - x[a]
        length = float(np.hypot(*v))
        for p in used:
            if p in (a, b) or length == 0:
                continue
            along = float((x[p] - x[a]) @ v) / length
            if near < along < length - near and abs(float(v[0] * (x[p] - x[a])[1] - v[1] * (x[p] - x[a])[0])) / length <= near:
                triples.append((a, b, p))
    column = {int(k): 2 * i for i, k in enumerate(free)}

    def residuals() -> np.ndarray:
        return np.array([((x[b] - x[a])[0] * (x[p] - x[a])[1] - (x[b] - x[a])[1] * (x[p] - x[a])[0]) / np.hypot(*(x[b] - x[a])) for a, b, p in triples])

    first = x.copy()
    for _ in range(ROUNDS):
        r = residuals()
        if not len(r) or np.abs(r).max() <= tol:
            break
        jacobian = np.zeros((len(triples), 2 * len(free)))
        for i, (a, b, p) in enumerate(triples):
            v, w = x[b] - x[a], x[p] - x[a]
            length = np.hypot(*v)
            slopes = {p: np.array([-v[1], v[0]]), b: np.array([w[1], -w[0]]), a: np.array([v[1] - w[1], w[0] - v[0]])}
            for k, slope in slopes.items():
                if k in column:
                    jacobian[i, column[k] : column[k] + 2] += slope / length
        step = np.linalg.lstsq(jacobian, -r, rcond=None)[0]
        x[free] += step.reshape(-1, 2)
    left = float(np.abs(residuals()).max()) if triples else 0.0
    moved = max((math.dist(x[k], p) for k, ps in start.items() for p in ps), default=0.0)
    if left > max(tol, 1e-12) or moved > near:
        raise ValueError(f"not repaired: residual {left:.3g}, displacement {max(moved, float(np.abs(x - first).max())):.3g}")
    return [[(float(x[k][0]), float(x[k][1])) for k in own] for own in of], moved, left


def repair_partitions(partitions: DataFrame, near: float) -> DataFrame:
    """(map, id, polygon, area, displacement) of (map, ids, rings, fixed) rows, one kernel for each map."""

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in frame.itertuples():
            out, moved, _ = repair([[tuple(p) for p in ring] for ring in r.rings], [[tuple(p) for p in ring] for ring in r.fixed], near)
            rows += [(r.map, i, [list(p) for p in ring], area(ring), moved) for i, ring in zip(r.ids, out, strict=True)]
        return pd.DataFrame(rows, columns=["map", "id", "polygon", "area", "displacement"])

    return partitions.groupBy("map").applyInPandas(solve, "map string, id string, polygon array<array<double>>, area double, displacement double")
