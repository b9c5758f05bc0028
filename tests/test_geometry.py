"""Closed forms and exact small fixtures."""

import math
import random

import pytest

from terrane.functions import geometry as g
from terrane.functions import rings
from terrane.operators import decompose, graph, planners, runs, sampling, scoring, spatial


def ring(spark, **polygons):
    return spark.createDataFrame([(k, o, float(x), float(y)) for k, p in polygons.items() for o, (x, y) in enumerate(p)], "id string, ord int, x double, y double")


def test_square_moments_do_not_depend_on_place_or_winding(spark):
    v = ring(spark, a=[(0, 0), (2, 0), (2, 2), (0, 2)], b=[(1e4, 1e4 + 2), (1e4 + 2, 1e4 + 2), (1e4 + 2, 1e4), (1e4, 1e4)])
    for m in rings.moments(v).collect():
        assert m.area == pytest.approx(4) and m.diameter == pytest.approx(math.sqrt(8))
        assert m.compactness == pytest.approx(4 / math.pi) and m.eigen_major == pytest.approx(1 / 3) and m.eigen_ratio == pytest.approx(1)


def test_long_rectangle_has_eigen_ratio_sixteen(spark):
    assert rings.moments(ring(spark, a=[(0, 0), (4, 0), (4, 1), (0, 1)])).first().eigen_ratio == pytest.approx(16)


def test_shared_edge_and_clearance(spark):
    v = ring(spark, A=[(0, 0), (1, 0), (1, 1), (0, 1)], B=[(1, 0), (2, 0), (2, 1), (1, 1)])
    p = spatial.shared_portals(v).first()
    assert (p.source, p.target, p.portal_width) == ("A", "B", 1.0)
    tight = spatial.shared_portals(v, clearance_=0.5)
    d = {r.id: r for r in spatial.region_descriptors(v, tight).collect()}
    assert tight.first().safe_portal_width is None
    assert (d["A"].degree, d["A"].safe_degree, d["A"].conductance, d["A"].safe_conductance) == (1, 0, 0.25, 0.0)


@pytest.mark.parametrize("other", [[(1, 1), (2, 1), (2, 2), (1, 2)], [(3, 0), (4, 0), (4, 1), (3, 1)]])
def test_point_contact_and_gaps_are_no_portals(spark, other):
    assert spatial.shared_portals(ring(spark, A=[(0, 0), (1, 0), (1, 1), (0, 1)], B=other)).isEmpty()


def test_boundary_point_belongs_to_all_and_counts_for_the_smallest(spark):
    v = ring(spark, Z=[(0, 0), (1, 0), (1, 1), (0, 1)], A=[(1, 0), (2, 0), (2, 1), (1, 1)])
    p = spark.createDataFrame([(1, 1.0, 0.5), (2, 5.0, 5.0), (3, None, 1.0)], "pid int, x double, y double")
    assert sorted(tuple(r) for r in spatial.points_in_regions(p, v).collect()) == [(1, "A"), (1, "Z")]
    assert [tuple(r) for r in spatial.first_region(p, v).collect()] == [(1, "A")]


def test_grid_joins_agree_with_all_pairs(spark):
    r = random.Random(3)
    rows = [(i, r.uniform(-5, 5), r.uniform(-5, 5)) for i in range(60)]
    a, b = spark.createDataFrame(rows, "a int, x double, y double"), spark.createDataFrame(rows, "b int, x double, y double")
    got = {(x.a, x.b) for x in spatial.within_radius(a, b, 1.5).collect()}
    assert got == {(i, j) for i, x, y in rows for j, u, v in rows if (x - u) ** 2 + (y - v) ** 2 <= 2.25}
    near = spatial.k_nearest(a.withColumnRenamed("a", "q"), b.withColumnRenamed("b", "p"), 4, cell=0.3).collect()
    want = {(i, k + 1, j) for i, x, y in rows for k, (_, j) in enumerate(sorted(((x - u) ** 2 + (y - v) ** 2, j) for j, u, v in rows)[:4])}
    assert {(n.q, n["rank"], n.p) for n in near} == want


def test_kernel_paths_match_enumeration():
    for seed in range(15):
        r = random.Random(seed)
        nodes = "abcdef"
        adj = {a: {b: float(r.randint(1, 4)) for b in nodes if a != b and r.random() < 0.35} for a in nodes}
        every = []

        def walk(path, cost, adj=adj, every=every):
            if path[-1] == "f":
                every.append((cost, path))
                return
            for b, w in adj[path[-1]].items():
                if b not in path:
                    walk((*path, b), cost + w)

        walk(("a",), 0.0)
        assert graph.k_loopless(adj, "a", "f", 5) == sorted(every)[:5]
        near = {a: {b for b in nodes if b in adj[a] or a in adj[b]} for a in nodes}
        both = {a: dict.fromkeys(near[a], 1.0) for a in nodes}
        paths = graph.k_loopless(both, "a", "f", 10**6)
        members, edges = graph.simple_route_edges(near, ["a"], ["f"])
        assert members == {v for _, p in paths for v in p}
        assert edges == {(min(e), max(e)) for _, p in paths for e in zip(p, p[1:], strict=False)}


def test_components_keep_lone_vertices(spark):
    v = spark.createDataFrame([(x,) for x in "abcde"], "id string")
    e = spark.createDataFrame([("b", "a"), ("c", "b")], "source string, target string")
    assert {r.id: r.component for r in graph.components(v, e).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e"}


def test_decay_waits_for_whole_epochs(spark):
    regions = spark.createDataFrame([("A", 1.0, 0.8), ("B", 1.0, 0.8)], "id string, area double, base double")
    visits = spark.createDataFrame([(1, "A"), (2, None), (3, "A"), (4, "B")], "seq int, id string")
    out = {r.id: (r.nodes, round(r.adjusted, 9)) for r in sampling.density_decay(regions, visits, interval=3).collect()}
    assert out == {"A": (2, 0.6), "B": (0, 0.8)}
    early = sampling.density_decay(regions.withColumn("base", regions.base * 0 + 0.01), visits, interval=9).first()
    assert early.adjusted == pytest.approx(0.01)


def test_result_records(spark):
    base = " ".join(["guidance=none", *(f"{m}=1.0" for m in runs.METRICS)])
    logs = spark.createDataFrame([(1, f"[RESULT] planner=p success=0 {base}"), (2, "nothing"), (3, f"[RESULT] planner=q success=1 {base.replace('=1.0', '=nan', 1)}"), (4, f"[RESULT] planner=a success=1 {base}\n\x1b[1m[RESULT] planner=b success=1 planner=c {base}\x1b[0m")], "id int, text string")
    out = {r.id: r for r in runs.parse_results(logs).collect()}
    assert out[1].success is False and out[1].path_length is None and out[1].planning_time_ms == 1.0
    assert out[2].success is None and out[3].success is None and out[3].iterations is None
    assert out[4].planner == "c" and out[4].path_length == 1.0


def test_summary_of_one_value_has_no_spread(spark):
    r = spark.createDataFrame([("p", "m", True, 2.0)], "planner string, mode string, success boolean, path_length double")
    out = runs.summarize(r, metrics=("path_length",)).first()
    assert (out.path_length_mean, out.path_length_stdev) == (2.0, 0.0)


def test_answers(spark):
    bad = ['{"status":"scored","score":11,"reason":"x"}', '{"status":"scored","score":true,"reason":"x"}', '{"status":"scored","reason":"x","score":1,"more":1}', "no json", '{"status":"insufficient_data","score":3,"reason":"x"}', '{"status":"scored","score":3,"reason":"' + "x" * 321 + '"}']
    good = '{"status":"scored","score":10,"reason":"x"}'
    out = scoring.parsed_answers(spark.createDataFrame([(x,) for x in [*bad, good]], "reply string")).collect()
    assert [r.problem is None for r in out] == [False] * 6 + [True]


def test_decomposition_covers_exactly():
    boundary = [(0, 0), (16, 0), (16, 10), (0, 10)]
    holes = [[(3, 2), (5, 2), (4, 6)], [(8, 3), (11, 3), (11, 7), (8, 7)], [(13, 1), (14, 1), (14, 2), (13, 2)]]
    parts = decompose.decompose(boundary, holes)
    assert all(decompose.is_convex(p) for p in parts)
    assert sum(map(decompose.area, parts)) == pytest.approx(160 - 4 - 12 - 1)
    assert all(not decompose.intersection(a, b, 1e-7) for i, a in enumerate(parts) for b in parts[:i])
    ell = decompose.decompose([(0, 0), (4, 0), (4, 1), (2, 1), (2, 3), (0, 3)], [])
    assert len(ell) > 1 and sum(map(decompose.area, ell)) == pytest.approx(8)


@pytest.mark.parametrize("planner", planners.PLANNERS)
def test_planner_paths_are_free_and_repeat(planner):
    world = planners.World([[0, 0], [10, 0], [10, 10], [0, 10]], [[[4, 4], [6, 4], [6, 6], [4, 6]]], 0.3)
    assert world.valid([1, 1]) and not world.valid([4.1, 5]) and not world.valid([3.8, 5]) and not world.valid([0.2, 5])
    import numpy as np

    assert world.free(np.array([1, 3.6]), np.array([9, 3.6])) and not world.free(np.array([1, 3.8]), np.array([9, 3.8]))
    one = planners.plan(world, [1, 1], [9, 9], planner, 42, 600)
    assert one == planners.plan(world, [1, 1], [9, 9], planner, 42, 600)
    assert one["success"] and one["path"][0] == [1, 1] and one["path"][-1] == [9, 9]
    path = [np.array(p) for p in one["path"]]
    assert all(world.free(a, b) for a, b in zip(path, path[1:], strict=False))
    assert one["solutions"] == sorted(one["solutions"], reverse=True)


def test_segment_distance(spark):
    d = g.segment_distance(("0.0", "0.0"), ("2.0", "0.0"), ("1.0", "1.0"), ("1.0", "3.0"))
    x = g.segment_distance(("0.0", "0.0"), ("2.0", "0.0"), ("1.0", "-1.0"), ("1.0", "3.0"))
    p = g.line_intersection(("0.0", "0.0"), ("2.0", "0.0"), ("1.0", "-1.0"), ("1.0", "3.0"))
    row = spark.sql(f"select {d} as d, {x} as x, {p[0]} as px, {p[1]} as py").first()
    assert (row.d, row.x, row.px, row.py) == (1.0, 0.0, 1.0, 0.0)


def test_decay_stream_equals_batch(spark, tmp_path):
    from terrane.streaming.decay import density_decay_stream

    rows = [("r", i, "A" if i % 3 else "B") for i in range(1, 13)]
    spark.createDataFrame(rows, "run string, seq bigint, id string").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("run string, seq bigint, id string").json(str(tmp_path / "in"))
    out = density_decay_stream(stream, {"A": (1.0, 0.8), "B": (2.0, 0.5)}, interval=5)
    q = out.writeStream.format("memory").queryName("decay").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.epoch, r.id): (r.nodes, round(r.adjusted, 9)) for r in spark.table("decay").collect()}
    regions = spark.createDataFrame([("A", 1.0, 0.8), ("B", 2.0, 0.5)], "id string, area double, base double")
    for epoch in (1, 2):
        batch = sampling.density_decay(regions, spark.createDataFrame([(s, i) for _, s, i in rows if s <= 5 * epoch], "seq bigint, id string"), interval=5)
        assert {(epoch, r.id): (r.nodes, round(r.adjusted, 9)) for r in batch.collect()} == {k: v for k, v in got.items() if k[0] == epoch}


def facts(spark, connections, starts=("S",), goals=("G",), k=3):
    rows = [("m", a, b, float(w)) for x, y, w in connections for a, b in ((x, y), (y, x))]
    ends = [("m", x, "start") for x in starts] + [("m", x, "goal") for x in goals]
    out = graph.route_facts(spark.createDataFrame(rows, "graph string, source string, target string, cost double"), spark.createDataFrame(ends, "graph string, id string, role string"), k).collect()
    return {r.a if r.b is None else (r.a, r.b): r for r in out}


def test_shared_edge_of_all_sequences_need_not_be_mandatory(spark):
    f = facts(spark, [("S", "A", 1), ("A", "B", 1), ("B", "G", 1), ("A", "C", 1), ("C", "G", 1), ("A", "D", 1), ("D", "G", 1), ("S", "Z", 50), ("G", "Z", 50)])
    assert f["A", "S"].hits == f["A", "S"].returned == 3 and not f["A", "S"].mandatory


def test_pockets_and_alternatives(spark):
    f = facts(spark, [("S", "A", 1), ("A", "G", 1), ("S", "B", 2), ("B", "G", 2), ("B", "P", 1), ("P", "Q", 1)])
    assert f["P"].in_pocket and f["Q"].in_pocket and not f["B"].in_pocket and f["Q"].degree == 1
    assert f["B"].on_alternative and f["B", "S"].on_alternative and not f["P"].on_alternative and not f["A"].on_alternative


def test_cycles_off_the_route_are_off_it(spark):
    f = facts(spark, [("S", "A", 1), ("A", "G", 1), ("A", "X", 1), ("X", "Y", 1), ("A", "Y", 1)])
    assert {v for v, r in f.items() if isinstance(v, str) and r.on_route} == {"S", "A", "G"} and f["A", "S"].mandatory


def test_disconnected_ends(spark):
    f = facts(spark, [("S", "A", 1), ("G", "B", 1)])
    assert f["S"].returned == 0 and f["A", "S"].on_alternative is None and f["G"].from_start is None


def test_regions_without_edges_and_one_way_graphs(spark):
    from terrane.operators import prepare

    edges = [("m", "a", "b", 1.0), ("m", "b", "a", 1.0), ("o", "a", "b", 1.0), ("o", "b", "c", 1.0), ("o", "c", "b", 1.0), ("e", "a", "b", 1.0), ("e", "b", "a", 1.0)]
    ends = [("m", "a", "start"), ("m", "b", "goal"), ("o", "a", "start"), ("o", "c", "goal"), ("e", "a", "start"), ("e", "z", "goal")]
    regions = [(g_, x, 2.0, 0.5, None) for g_, x in (("m", "a"), ("m", "b"), ("m", "z"), ("o", "a"), ("o", "b"), ("o", "c"), ("e", "z"))] + [("e", "a", 2.0, None, 1.0)]
    portals = spark.createDataFrame([], "graph string, a string, b string, portal_inradius double, robot_radius double")
    of_regions, of_connections, status = prepare.prepare(
        spark.createDataFrame(edges, "graph string, source string, target string, cost double"), spark.createDataFrame(ends, "graph string, id string, role string"),
        spark.createDataFrame(regions, "graph string, id string, inradius double, robot_radius double, ellipse_ratio double"), portals,
    )
    r = {(x.graph, x.id): x for x in of_regions.collect()}
    assert r["m", "z"].degree == 0 and r["m", "z"].hits == 0 and not r["m", "z"].on_route and r["m", "z"].pocket_level == "inactive"
    assert r["m", "a"].open == pytest.approx(1 / (1 + 2.718281828459045 ** (5 - 4))) and r["e", "a"].open_level == "unavailable"
    assert r["o", "b"].pocket_level == r["o", "b"].alternative_route_level == "unavailable" and r["o", "b"].on_route is None and r["o", "b"].from_start == 1.0
    c = {(x.graph, x.a, x.b): x for x in of_connections.collect()}
    assert c["m", "a", "b"].mandatory and c["o", "a", "b"].mandatory and c["e", "a", "b"].mandatory is None and c["m", "a", "b"].narrow_level == "unavailable"
    assert {x.graph: x.status for x in status.collect()} == {"m": "connected", "o": "connected", "e": "disconnected"}


def test_order_statistics_are_exact(spark, monkeypatch):
    from terrane.operators import voxels

    monkeypatch.setattr(voxels, "SORTED", 50)
    r = random.Random(3)
    values = [float(r.randrange(400)) for _ in range(3000)] + [7.0] * 500
    frame = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    for rank in (0, 17, 1200, 1750, 3499):
        assert voxels.order_statistic(frame, "v", rank) == sorted(values)[rank]


def test_results_are_added_and_snapshots_stay(spark, tmp_path):
    import gzip

    from pyspark.errors import AnalysisException

    from terrane.sources import documents

    for k in (1, 2):
        documents.append_results(spark.createDataFrame([(k, "ok")], "run int, status string"), f"{tmp_path}/results")
    assert sorted(r.run for r in spark.read.json(f"{tmp_path}/results").collect()) == [1, 2]
    nodes = spark.createDataFrame([(k, 9 - k) for k in range(6)], "node int, parent int").repartition(3)
    documents.write_snapshot(nodes, f"{tmp_path}/tree", ("parent",))
    lines = [line for f in sorted((tmp_path / "tree").glob("part-*.json.gz")) for line in gzip.open(f, "rt")]
    assert [int(x.split('"parent":')[1].rstrip("}\n")) for x in lines] == [4, 5, 6, 7, 8, 9]
    with pytest.raises(AnalysisException):
        documents.write_snapshot(nodes, f"{tmp_path}/tree", ("parent",))


def test_verification_finds_what_is_wrong(spark):
    from terrane.operators import assemble

    runs_ = spark.createDataFrame([(1, True, 2.0), (1, True, 2.0), (2, True, 3.1), (3, False, 1.0), (4, True, 1.0), (5, False, None)], "run int, success boolean, path_length double")
    lengths = spark.createDataFrame([(1, 2.0004), (2, 3.0), (3, 1.0)], "run int, measured double")
    r = assemble.verification(runs_, lengths, ("run",)).first()
    assert (r.recorded, r.repeated, r.failed, r.checked, r.unmeasured, r.stray, r.sound) == (6, 1, 2, 3, 1, 1, False) and r.max_error == pytest.approx(0.1)
    fine = assemble.verification(runs_.where("run = 1").limit(1), lengths, ("run",)).first()
    assert fine.sound and fine.max_error < 1e-3


def test_every_open_cell_of_a_maze_is_reached(spark):
    from terrane.operators import maps

    walls = {(r.i, r.j) for r in maps.maze_walls(spark.range(1).withColumnRenamed("id", "seed"), 21, 15).collect()}
    open_ = {(i, j) for i in range(21) for j in range(15)} - walls
    seen, todo = {(0, 0)}, [(0, 0)]
    for i, j in todo:
        for c in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
            if c in open_ and c not in seen:
                seen.add(c)
                todo.append(c)
    assert len(walls) > 40 and seen == open_


def test_repair_makes_neighbours_share_their_border():
    from terrane.operators.repair import repair

    boundary = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)]
    e = 4e-4
    rings = [
        [(0 + e, 0), (2 + e, 0 - e), (2 - e, 3 + e), (0, 3 - e)],
        [(2, 0 + e), (4 - e, 0), (4, 1.5 + e), (2 + 2 * e, 1.5)],
        [(2 - 2 * e, 1.5 + e), (4 + e, 1.5), (4, 3 - e), (2, 3)],
    ]
    out, moved, left = repair(rings, [boundary], 5e-3)
    assert left <= 1e-9 and 0 < moved < 5e-3
    assert sum(map(decompose.area, out)) == pytest.approx(12, abs=1e-9)


def test_functions_in_sql(spark):
    from terrane.functions.register import register

    names = register(spark)
    row = spark.sql("select plane_cross(0, 0, 1, 0, 0, 1) as c, point_segment_distance(1, 2, 0, 0, 2, 0) as d, segments_intersect(0, 0, 2, 2, 0, 2, 2, 0) as x, soft_step(1e6, 0, 1) as s, soft_step_down(1e6, 0, 1) as t, membership_level(null) as m").first()
    assert (row.c, row.d, row.x, row.s, row.t, row.m) == (1.0, 2.0, True, 1.0, 0.0, "unavailable") and len(names) == 10
