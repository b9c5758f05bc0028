"""Seeded sampling planners, one grouped kernel for each run of a job matrix.

A run stops on its iterations or nodes, never on wall time, so a seed gives the
same path on any machine. Trees grow by nearest node and bounded step; the
starred planners choose parents and rewire by cost, 'rrt#' lets an improved
cost cascade through the neighbours, the 'b' planners grow a tree from either
end and join them.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

PLANNERS = ("rrt", "rrt*", "rrt#", "brrt", "brrt*")
STEP, RADIUS, MOST_NODES = 2.0, 6.0, 5000
#: Tasks that planning jobs are dealt to at most.
MOST_TASKS = 10_000
SCHEMA = "map string, planner string, mode string, seed bigint, success boolean, iterations int, nodes_added int, first_solution_iteration int, path_length double, straight_line_distance double, solutions array<double>, path array<array<double>>"


class World:
    """A boundary ring, obstacle rings and the clearance that states and segments keep."""

    def __init__(self, boundary: list, obstacles: list, clearance: float):
        self.boundary = np.asarray(boundary, dtype=float)
        self.obstacles = [np.asarray(o, dtype=float) for o in obstacles]
        rings = [self.boundary, *self.obstacles]
        self.a = np.concatenate(rings)
        self.b = np.concatenate([np.roll(r, -1, axis=0) for r in rings])
        self.clearance = max(clearance, 1e-10)
        self.low, self.high = self.boundary.min(axis=0), self.boundary.max(axis=0)

    @staticmethod
    def _inside(p: np.ndarray, ring: np.ndarray) -> bool:
        x, y = ring[:, 0], ring[:, 1]
        nx, ny = np.roll(x, -1), np.roll(y, -1)
        over = (y > p[1]) != (ny > p[1])
        at = x + (p[1] - y) * (nx - x) / np.where(ny == y, 1, ny - y)
        return bool((over & (p[0] < at)).sum() % 2)

    def _clear(self, p: np.ndarray) -> float:
        d = self.b - self.a
        t = np.clip(((p - self.a) * d).sum(axis=1) / np.maximum((d * d).sum(axis=1), 1e-300), 0, 1)
        return float(np.sqrt(((self.a + t[:, None] * d - p) ** 2).sum(axis=1).min()))

    def valid(self, p: np.ndarray) -> bool:
        return self._inside(p, self.boundary) and not any(self._inside(p, o) for o in self.obstacles) and self._clear(p) >= self.clearance

    def free(self, p: np.ndarray, q: np.ndarray) -> bool:
        """Whether the disk that sweeps from p to q, both valid, keeps its clearance: ends of walls, and walls crossed."""
        d = q - p
        t = np.clip(((self.a - p) @ d) / max(float(d @ d), 1e-300), 0, 1)
        if (((p + t[:, None] * d - self.a) ** 2).sum(axis=1) < self.clearance**2).any():
            return False
        if not self.valid(q):
            return False
        w = self.b - self.a

        def side(o: np.ndarray, v: np.ndarray, x: np.ndarray) -> np.ndarray:
            return v[..., 0] * (x - o)[..., 1] - v[..., 1] * (x - o)[..., 0]

        return not bool(((side(p, d, self.a) * side(p, d, self.b) < 0) & (side(self.a, w, p) * side(self.a, w, q) < 0)).any())


class _Tree:
    def __init__(self, root: np.ndarray, size: int):
        self.at = np.empty((size + 2, 2))
        self.at[0] = root
        self.n = 1
        self.parent = [-1]
        self.cost = [0.0]
        self.children: list[set[int]] = [set()]

    def nearest(self, p: np.ndarray) -> int:
        return int(((self.at[: self.n] - p) ** 2).sum(axis=1).argmin())

    def near(self, p: np.ndarray, radius: float) -> list[int]:
        return np.flatnonzero(((self.at[: self.n] - p) ** 2).sum(axis=1) <= radius * radius).tolist()

    def add(self, p: np.ndarray, parent: int, cost: float) -> int:
        i = self.n
        self.at[i] = p
        self.n += 1
        self.parent.append(parent)
        self.cost.append(cost)
        self.children.append(set())
        self.children[parent].add(i)
        return i

    def hang(self, i: int, parent: int, cost: float) -> None:
        """A new parent; costs of all below follow."""
        self.children[self.parent[i]].discard(i)
        self.children[parent].add(i)
        self.parent[i] = parent
        change, todo = cost - self.cost[i], [i]
        for k in todo:
            self.cost[k] += change
            todo.extend(self.children[k])

    def back(self, i: int) -> list[np.ndarray]:
        out = []
        while i >= 0:
            out.append(self.at[i])
            i = self.parent[i]
        return out[::-1]


def _length(path: list[np.ndarray]) -> float:
    return float(sum(math.dist(a, b) for a, b in zip(path, path[1:], strict=False)))


def plan(world: World, start: list[float], goal: list[float], planner: str, seed: int, iterations: int, *, guidance: list | None = None, step: float = STEP, radius: float = RADIUS, most_nodes: int = MOST_NODES) -> dict:
    """One run. ``guidance`` is a list of (score, convex ring): samples then come from its regions by score."""
    if planner not in PLANNERS:
        raise ValueError(f"no planner {planner}")
    rng = np.random.default_rng(seed)
    s, g = np.asarray(start, dtype=float), np.asarray(goal, dtype=float)
    trees = [_Tree(s, most_nodes), _Tree(g, most_nodes)]
    star, both = planner in ("rrt*", "rrt#", "brrt*"), planner[0] == "b"
    best: list[np.ndarray] = []
    length, solutions, first, done = math.inf, [], -1, 0
    if not (world.valid(s) and world.valid(g)):
        iterations = 0
    shares = np.cumsum([x for x, _ in guidance]) if guidance else None

    def sample() -> np.ndarray:
        if shares is None or shares[-1] <= 0:
            return world.low + rng.random(2) * (world.high - world.low)
        ring = np.asarray(guidance[int(np.searchsorted(shares, rng.random() * shares[-1], side="right"))][1], dtype=float)
        areas = np.abs((ring[1:-1] - ring[0])[:, 0] * (ring[2:] - ring[0])[:, 1] - (ring[1:-1] - ring[0])[:, 1] * (ring[2:] - ring[0])[:, 0])
        k = int(np.searchsorted(np.cumsum(areas), rng.random() * areas.sum(), side="right"))
        u, v = rng.random(2)
        return (1 - math.sqrt(u)) * ring[0] + math.sqrt(u) * (1 - v) * ring[k + 1] + math.sqrt(u) * v * ring[k + 2]

    def extend(tree: _Tree, p: np.ndarray) -> int:
        """The node added towards p, -1 if none."""
        i = tree.nearest(p)
        d = math.dist(tree.at[i], p)
        if d < 1e-9 or tree.n >= most_nodes:
            return -1
        q = p if d <= step else tree.at[i] + (p - tree.at[i]) * (step / d)
        if not world.free(tree.at[i], q):
            return -1
        if not star:
            return tree.add(q, i, tree.cost[i] + math.dist(tree.at[i], q))
        around = tree.near(q, radius)
        for k in sorted(around, key=lambda k: (tree.cost[k] + math.dist(tree.at[k], q), k)):
            if k == i or world.free(tree.at[k], q):
                new = tree.add(q, k, tree.cost[k] + math.dist(tree.at[k], q))
                break
        else:
            new = tree.add(q, i, tree.cost[i] + math.dist(tree.at[i], q))
        # Rewire around the node; 'rrt#' goes on from what improved, cheapest first.
        queue = [(tree.cost[new], new)]
        while queue:
            _, at = heapq.heappop(queue)
            for k in around if at == new else tree.near(tree.at[at], radius):
                cost = tree.cost[at] + math.dist(tree.at[at], tree.at[k])
                if cost + 1e-9 < tree.cost[k] and cost + math.dist(tree.at[k], g if tree is trees[0] else s) < length and world.free(tree.at[at], tree.at[k]):
                    tree.hang(k, at, cost)
                    if planner == "rrt#":
                        heapq.heappush(queue, (cost, k))
        return new

    for it in range(1, iterations + 1):
        done = it
        if trees[0].n + trees[1].n - 2 >= most_nodes:
            break
        p = sample()
        if star and first > 0 and math.dist(s, p) + math.dist(p, g) >= length:
            continue
        a, b = (trees[0], trees[1]) if it % 2 or not both else (trees[1], trees[0])
        new = extend(a, p)
        if new < 0:
            continue
        path: list[np.ndarray] = []
        if both:
            end = b.nearest(a.at[new])
            if math.dist(b.at[end], a.at[new]) <= radius and world.free(a.at[new], b.at[end]):
                one, two = a.back(new), b.back(end)
                path = [*one, *two[::-1]] if a is trees[0] else [*two, *one[::-1]]
        elif math.dist(a.at[new], g) <= step and world.free(a.at[new], g):
            path = [*a.back(new), g]
        if path and (found := _length(path)) < length - 1e-9:
            best, length = path, found
            solutions.append(found)
            first = it if first < 0 else first
            if not star:
                break
    return {
        "success": bool(best), "iterations": done, "nodes_added": trees[0].n + trees[1].n - 2, "first_solution_iteration": first,
        "path_length": length if best else None, "straight_line_distance": math.dist(s, g), "solutions": solutions, "path": [[float(x) for x in p] for p in best],
    }


def run_jobs(jobs: DataFrame, maps: DataFrame, *, iterations: int = 2000) -> DataFrame:
    """One row for each job (map, planner, mode, seed); ``maps`` has (map, boundary, obstacles, clearance, start, goal[, guidance]).

    Mode 'none' samples the box, any other the map's guidance regions. Jobs are
    spread by their whole key, a task for each; a map's document goes with its jobs.
    """
    guided = "guidance" in maps.columns

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in frame.itertuples():
            world = World([list(p) for p in r.boundary], [[list(p) for p in o] for o in r.obstacles], r.clearance)
            guidance = [(x["score"], [list(p) for p in x["polygon"]]) for x in r.guidance] if guided and r.mode != "none" else None
            out = plan(world, list(r.start), list(r.goal), r.planner, int(r.seed), iterations, guidance=guidance)
            rows.append({"map": r.map, "planner": r.planner, "mode": r.mode, "seed": r.seed, **out})
        return pd.DataFrame(rows, columns=[c.strip().split(" ")[0] for c in SCHEMA.replace("array<array<double>>", "a").replace("array<double>", "a").split(",")])

    # A run is work that its few bytes hide from a coalescing planner, so the number of tasks is given.
    keys = ["map", "planner", "mode", "seed"]
    tasks = max(1, min(jobs.count(), MOST_TASKS))
    return jobs.join(maps, "map").repartition(tasks, *keys).groupBy(*keys).applyInPandas(solve, SCHEMA)
