import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.graphs import A, A_LEFT, BOOST, C, SEED, graph, ids, plain
from tidemark.functions.draw import draw
from tidemark.graph import Graph
from tidemark.operators import boost, cascade, coarsen, components, match, ordering, rank, sketch, whole
from tidemark.plans import experiment
from tidemark.sources import dataset, edges


def order(rows):
    return [r.id for r in rows.orderBy("ord").collect()]


def test_draw_is_the_documented_hash(spark):
    assert spark.range(1).select(draw(1, F.lit(2), F.lit(3))).first()[0] == 129426073


def test_degree_and_strength_orders(spark):
    g = graph(spark, A)
    assert order(rank.max_out_degree(g)) == [4, 9, 0, 1, 2, 3, 5, 7, 6, 8]
    assert order(rank.max_out_strength(g)) == [4, 9, 3, 1, 0, 5, 7, 2, 6, 8]
    assert order(rank.max_out_degree(g, 3)) == [4, 9, 0]


@pytest.mark.parametrize(
    ("weighted", "transpose", "first", "expected"),
    [
        (False, False, [0.8583, 0.7875, 0.5750, 1.0708, 1.8500, 0.7875, 1.7083, 1.2125, 1.0000, 0.1500], [7, 4, 6, 8, 3, 5, 1, 2, 0, 9]),
        (True, True, [11.9815, 16.0856, 10.7138, 13.1558, 22.2212, 13.2584, 8.6190, 11.2789, 4.6947, 16.8412], [9, 4, 1, 0, 3, 2, 5, 7, 6, 8]),
    ],
)
def test_pagerank(spark, weighted, transpose, first, expected):
    g = graph(spark, A, weights=range(10, 20))
    params = rank.PageRankParams(iterations=1, transpose=transpose, vertex_weights=weighted, edge_weights=weighted)
    assert [r.rank for r in rank.pagerank(g, params).orderBy("id").collect()] == pytest.approx(first, abs=1e-3)
    params = rank.PageRankParams(iterations=15, transpose=transpose, vertex_weights=weighted, edge_weights=weighted)
    assert order(rank.pagerank_topk(g, None, params)) == expected


def test_pagerank_rejects_weights_that_are_not_positive(spark):
    with pytest.raises(ValueError, match="positive"):
        rank.pagerank(graph(spark, A, weights=[0] * 10))


def test_imrank(spark):
    # in ascending order of sources the first sweep leaves 2.2072 at vertex 4 and 2.1275 at vertex 9
    assert order(rank.imrank(graph(spark, A), 2, 1)) == [4, 9]
    assert sorted(order(rank.imrank(graph(spark, A), None, 3, 3))) == list(range(10))


@pytest.mark.parametrize(
    ("text", "extra", "wcc", "skips", "scc", "condition", "filtered"),
    [
        ("01 12 13 23", (), 1, {(1,): 2}, 4, "true", 4),
        ("01 12 23 31", (), 1, {(3,): 1}, 2, "src < dst", 4),
        ("01 02 12 14 31 32 43", (), 1, {(1,): 1, (1, 3): 2}, 3, "src <> 3", 5),
        ("01 02 12 14 23 30 31 41", (), 1, {(1,): 2}, 1, "not (src = 3 and dst = 0)", 2),
        ("12 13 15 24 31 35 42 51", (0,), 2, {(2,): 3, (1, 5): 3}, 3, "not ((src = 1 and dst = 3) or (src = 3 and dst = 1))", 4),
    ],
)
def test_components(spark, text, extra, wcc, skips, scc, condition, filtered):
    g = plain(spark, text, extra)
    assert components.n_wcc(g) == wcc
    for skipped, n in skips.items():
        assert components.n_wcc(g, ids(spark, skipped)) == n
    assert components.n_scc(g) == scc
    assert components.n_scc(g, F.expr(condition)) == filtered


def test_activation_probability(spark):
    g = graph(spark, C, BOOST)
    rows = {r.id: r for r in cascade.activation_probability(g, ids(spark, [1, 4, 6, 7, 8, 10, 12, 14, 16, 17]), 18).collect()}
    expected = {0: 0.34140295, 2: 0.495205, 3: 0.3691156, 5: 0.3, 9: 0.42679894, 11: 0.37, 13: 0.52898085, 15: 0.40999997}
    boosted = {0: 0.6019707, 2: 0.80588, 3: 0.6689191, 5: 0.6, 9: 0.74864817, 11: 0.74, 13: 0.8521062, 15: 0.82}
    for v in range(18):
        assert rows[v].p_in == pytest.approx(expected.get(v, 0), abs=1e-6)
        assert rows[v].p_in_boosted == pytest.approx(boosted.get(v, 0), abs=1e-6)


def test_simulation(spark):
    g = graph(spark, A_LEFT)
    assert cascade.simulate(g, ids(spark, []), 0) == 0.0
    with pytest.raises(ValueError, match="positive"):
        cascade.simulate(g, ids(spark, [0]), 0)
    few, more = (cascade.simulate(g, ids(spark, s), 300) for s in ([0], [0, 2]))
    assert more >= few >= 1


def test_simulation_of_plain_probabilities(spark):
    rows = [(int(a), int(b), float(p), float(p)) for a, b, p in (x.split(",") for x in A_LEFT.split())]
    g = Graph.of(spark.createDataFrame(rows, "src long, dst long, p double, p_seed double"), SEED)
    got = cascade.target_reach(g, ids(spark, [0]), ids(spark, [1, 3, 5]), 8000)
    assert got == pytest.approx(0.421093, abs=4 * (0.25 / 8000) ** 0.5)


def test_frequency_on_a_tree_is_the_activation_probability(spark):
    g = graph(spark, C, BOOST)
    seeds = ids(spark, [1, 4, 6, 7, 8, 10, 12, 14, 16, 17])
    rows = {r.id: r.frequency for r in cascade.simulate_frequency(g, seeds, 4000).collect()}
    for v, p in {0: 0.34140295, 2: 0.495205, 9: 0.42679894, 13: 0.52898085}.items():
        assert rows[v] == pytest.approx(p, abs=4 * (0.25 / 4000) ** 0.5)


def test_sketches_and_cover(spark):
    g = graph(spark, A, weights=range(10, 20))
    centres = sketch.centres(g.vertices, 0, 200, "1c")
    assert centres.count() == 200
    members = sketch.rr_sketches(g, 200)
    assert centres.join(members, ["sketch_id", "id"], "left_anti").count() == 0
    again = sketch.append(g, sketch.rr_sketches(g, 80), 80, 200)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, members.collect()))
    chosen = sketch.select(members, 20, g.vertices).orderBy("ord").collect()
    gains = [r.gain for r in chosen]
    assert len(chosen) == 10 and gains == sorted(gains, reverse=True) and sum(gains) == 200
    skipped = sketch.select(members, 3, g.vertices, ids(spark, [chosen[0].id]))
    assert chosen[0].id not in order(skipped)


def test_boost_sketches(spark):
    g = graph(spark, C, BOOST)
    seeds = ids(spark, [10, 14, 17])
    made = boost.boost_sketches(g, seeds, 300, 2)
    by_distance = sorted(map(tuple, made.critical.collect()))
    by_closure = sorted(map(tuple, boost.critical_by_closures(g, seeds, sketch.centres(g.vertices, 0, 300, "1c")).collect()))
    assert by_distance == by_closure and by_distance
    full, fast = boost.select(made, 2, g.vertices), boost.select_critical(made, 2, g.vertices)
    assert order(full)[0] == order(fast)[0] and not {10, 14, 17} & set(order(full))
    assert 0 < made.success_rate() < 1
    assert made.distances.where("dist_s + dist_r > 2").count() == 0


GROUPS = [0, 1, 2, 0, 1, 2, 0, 1, 2, 3]
COARSE = {
    "SEPARATE_SIMPLE": {(0, 1): (0.402243, 0.741153), (1, 2): (0.438589, 0.795980), (2, 0): (0.093201, 0.101200)},
    "MERGED_PRECISE": {(0, 1): (0.473057, 0.741153), (1, 2): (0.504086, 0.795980), (2, 0): (0.116750, 0.116750)},
    "SEPARATE_PRECISE": {(0, 1): (0.398591, 0.741153), (1, 2): (0.435078, 0.795980), (2, 0): (0.093201, 0.101200)},
}


@pytest.mark.parametrize("rule", COARSE)
def test_coarse_edges(spark, rule):
    g = graph(spark, A, weights=range(10, 20))
    level = coarsen.coarsen_by_groups(g, spark.createDataFrame(list(enumerate(GROUPS)), "id long, group_id long"), coarsen.CoarseningParams(edge_rule=rule))
    rows = {(r.src, r.dst): (r.p, r.p_seed) for r in level.coarse.edges.collect()}
    for edge, expected in (COARSE[rule] | {(1, 0): (0.22, 0.44), (2, 1): (0, 0.46), (3, 0): (0, 0.952)}).items():
        assert rows[edge] == pytest.approx(expected, abs=2e-6)
    assert [r.weight for r in level.coarse.vertices.orderBy("id").collect()] == pytest.approx([16.5917, 19.1358, 18.8621, 19.0], abs=1e-4)


@pytest.mark.parametrize("prefer", ["HEM", "LEM"])
def test_matching_invariants_and_expansion(spark, prefer):
    g = graph(spark, A, BOOST)
    seeds = ids(spark, [1, 9])
    groups = match.match(g.vertices, match.undirect(g.edges), seeds, prefer)
    rows = groups.collect()
    assert sorted(r.id for r in rows) == list(range(10))
    sizes = {}
    for r in rows:
        sizes.setdefault(r.group_id, []).append(r.id)
    assert all(1 <= len(m) <= 3 for m in sizes.values()) and [1] in sizes.values() and [9] in sizes.values()
    assert sorted(sizes) == list(range(len(sizes))) and [min(sizes[k]) for k in sorted(sizes)] == sorted(min(m) for m in sizes.values())
    level = coarsen.coarsen_by_groups(g, groups, seeds=seeds)
    assert level.coarse.edges.where("p < 0 or p > p_boost or p_boost > 1").count() == 0
    chosen = spark.createDataFrame([(0, 0), (1, 1)], "ord int, id long")
    for rule in ("LOCAL", "RANDOM"):
        for r in coarsen.expand(level, chosen, rule).collect():
            assert r.id in sizes[r.ord]
    with pytest.raises(ValueError, match="seed model"):
        coarsen.expand(level, chosen, "SIMULATIVE")
    with pytest.raises(ValueError, match="shares"):
        coarsen.coarsen_by_groups(g, spark.createDataFrame(list(enumerate(GROUPS)), "id long, group_id long"), seeds=seeds)


@pytest.mark.parametrize("rule", ["SIMULATIVE", "ITERATIVE"])
def test_expansion_by_simulation(spark, rule):
    g = graph(spark, A)
    level = coarsen.coarsen_by_groups(g, spark.createDataFrame(list(enumerate(GROUPS)), "id long, group_id long"))
    got = coarsen.expand(level, spark.createDataFrame([(0, 1)], "ord int, id long"), rule, tries=20, iterations=1)
    assert order(got)[0] in (1, 4, 7)


def test_robust_components(spark):
    g = graph(spark, "0,1,1 1,0,1 1,2,.5 2,3,1 3,2,1")
    rows = {r.id: r.group_id for r in rank.robust_groups(g, 2).collect()}
    assert rows == {0: 0, 1: 0, 2: 2, 3: 2}
    small = rank.contracted(g, rank.robust_groups(g, 2))
    assert small.n() == 2 and small.edges.first().p == pytest.approx(0.5)
    assert rank.robust_scc(g, 1, 2, 50).first().id in (0, 1, 2, 3)
    with pytest.raises(ValueError, match="sample"):
        rank.robust_groups(g, 0)


def test_ranks_do_not_depend_on_partitions(spark):
    df = spark.range(50).select(((F.col("id") * 37) % 50).alias("id"), F.lit(2.0).alias("w"))
    for n in (1, 4, 16):
        rows = ordering.ranked(df, [F.col("id")], "r", "w", "upto", n).orderBy("id").collect()
        assert [r.r for r in rows] == list(range(1, 51)) and rows[-1].upto == 100


def test_histogram(spark):
    rows = ordering.histogram(spark.createDataFrame([(float(x),) for x in (0, 1, 2, 10)], "x double"), "x", 5).orderBy("bin").collect()
    assert [r.n for r in rows] == [2, 1, 0, 0, 1]
    assert "#" in ordering.bars(ordering.histogram(spark.range(4).select(F.lit(1.0).alias("x")), "x", 3))
    assert ordering.histogram(spark.createDataFrame([], "x double"), "x", 3).count() == 0


def test_matrix_market_round_trip(spark, tmp_path):
    (tmp_path / "edges.txt").write_text("# head\n7 7\n7 3\n3 9\n9 7\n7 3\n")
    edges.text_to_matrix_market(spark, str(tmp_path / "edges.txt"), str(tmp_path / "out"), skip=1)
    got = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert got[:2] == ["%%MatrixMarket matrix coordinate pattern general", "3 3 3"]
    back = edges.read_matrix_market(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == [(0, 1), (1, 2), (2, 0)]
    assert not edges.directed(spark.createDataFrame([(1, 2), (2, 5)], "u long, v long"))


def test_dataset_and_storage(spark, tmp_path):
    bare = graph(spark, A).edges.select("src", "dst")
    params = dataset.DatasetParams(mu_max=0.9, alpha=2.0, penalized_ratio=0.2, penalize_factor=4.0, unweighted_ratio=0.3)
    g = dataset.create_dataset(bare, params).validate()
    assert g.m() == 21 and g.vertices.where("weight < 1").count() == 0
    g.write(str(tmp_path / "g"))
    back = Graph.read(spark, str(tmp_path / "g"), SEED)
    assert back.edges.exceptAll(g.edges).count() == g.edges.exceptAll(back.edges).count() == 0
    with pytest.raises(ValueError, match="not a boost"):
        Graph.read(spark, str(tmp_path / "g"), BOOST)
    for bad in ('{"mu_min": 2}', '{"lambda_in": 0, "lambda_second": 0}', '{"what": 1}'):
        with pytest.raises(ValueError):
            dataset.DatasetParams.from_json(bad)
    with pytest.raises(ValueError, match="range"):
        Graph.of(spark.createDataFrame([(0, 1, 0.5, 0.4)], "src long, dst long, p double, p_boost double"), BOOST).validate()


def test_experiments(spark):
    g = graph(spark, A)
    p = experiment.Params.of(json.dumps({"n_sketches": [60, 30], "n_chosen": [2, 1], "tries": 30}), coarsening_threshold=4, robust_r=1)
    assert p.n_sketches == (30, 60)
    out = experiment.run_wim(g, p)
    assert [len(f["selected"]) for f in out["sketching"]] == [2, 2]
    assert json.loads(experiment.to_json(out, p))["result"]["graph"] == {"n": 10, "m": 21}
    levels = experiment.run_wim_coarsening(g, experiment.Params(n_sketches=(30,), n_chosen=(1,), tries=20, coarsening_threshold=6, skips_first_level=True))
    assert levels["levels"] and levels["levels"][0]["sketching"][0]["selected_expanded"]
    with pytest.raises(ValueError, match="threshold"):
        experiment.run_wim_coarsening(g, p.__class__())
    with pytest.raises(ValueError):
        experiment.Params(n_chosen=())


def test_boost_experiment(spark):
    g = graph(spark, C, BOOST)
    p = experiment.Params(n_sketches=(60,), n_chosen=(1,), tries=30, n_seeds=1, candidate_ratio=0.3, max_n_wcc=20)
    out = experiment.run_wbim(g, p)
    assert len(out["seeds"]) == 1 and out["sketching"][0]["simulated"][0]["objective"] >= 0


def test_contrast_experiment(spark):
    p = experiment.Params(n_sketches=(30,), n_chosen=(1,), tries=20, algorithms=("max_degree", "max_strength"))
    out = experiment.run_contrast(graph(spark, A), p)
    assert out["algorithms"]["max_degree"]["lists"][0]["selected"] == [4]


@pytest.mark.parametrize("bound", [0, 1_000_000])
def test_strong_components_over_tables_and_in_one_task(spark, monkeypatch, bound):
    rng = np.random.default_rng(5)
    n = 40
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, n, (60, 2)) if a != b} | {(100 + i, 100 + (i + 1) % 12) for i in range(12)}
    reach = {v: {v} for v in range(n)} | {100 + i: {100 + i} for i in range(12)}
    for _ in range(60):
        for a, b in pairs:
            reach[a] |= reach[b]
    exact = {v: min(u for u in reach[v] if v in reach[u]) for v in reach}
    monkeypatch.setattr(components, "IN_ONE_TASK", bound)
    g = Graph(spark.createDataFrame([(v, 1.0) for v in reach], "id long, weight double"), spark.createDataFrame(sorted(pairs), "src long, dst long"), SEED)
    assert {r.id: r.component for r in components.scc(g).collect()} == exact


def jobs(spark, run):
    """What ``run`` returns, and how many jobs it took."""
    name = f"jobs-{id(run)}"
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = run()
    finally:
        spark.sparkContext.setJobGroup("others", "others")
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def long_path(spark, model, n=60):
    """0, 1, ..., n - 1, all edges certain but the last one, which takes a seed or a boost."""
    name = "p_seed" if model == SEED else "p_boost"
    return Graph.of(spark.createDataFrame([(i, i + 1, float(i < n - 2), 1.0) for i in range(n - 1)], f"src long, dst long, p double, {name} double"), model)


def test_reverse_sketches_take_no_job_a_hop(spark):
    g = long_path(spark, SEED)
    rows, n = jobs(spark, lambda: sorted(map(tuple, sketch.rr_sketches(g, 30).collect())))
    starts = dict(map(tuple, sketch.centres(g.vertices, 0, 30, "1c").collect()))
    assert rows == sorted((s, v) for s, c in starts.items() for v in (range(c + 1) if c < 59 else (58, 59)))
    assert n < 40


def test_reverse_sketches_by_tasks_and_by_hops(spark, monkeypatch):
    g = graph(spark, A)
    by_tasks = sorted(map(tuple, sketch.rr_sketches(g, 100).collect()))
    monkeypatch.setattr(whole, "EDGES_IN_TASK", 0)
    assert sorted(map(tuple, sketch.rr_sketches(g, 100).collect())) == by_tasks


def test_boost_sketches_take_no_job_a_hop(spark):
    g, seeds = long_path(spark, BOOST), ids(spark, [0])
    made, n = jobs(spark, lambda: boost.boost_sketches(g, seeds, 200, 2))
    last = [s for s, c in sketch.centres(g.vertices, 0, 200, "1c").collect() if c == 59]
    assert last and sorted(map(tuple, made.critical.collect())) == [(s, 59) for s in last]
    assert n < 60
    by_closure, n = jobs(spark, lambda: boost.critical_by_closures(g, seeds, sketch.centres(g.vertices, 0, 200, "1c")).collect())
    assert sorted(map(tuple, by_closure)) == [(s, 59) for s in last]
    assert n < 40


@pytest.mark.parametrize("text, first", [(A, [9]), (C, [17, 8, 4])])
def test_boost_sketches_by_tasks_and_by_hops(spark, monkeypatch, text, first):
    g, seeds = graph(spark, text, BOOST), ids(spark, first)

    def found():
        made = boost.boost_sketches(g, seeds, 150, 2)
        closures = boost.critical_by_closures(g, seeds, sketch.centres(g.vertices, 0, 150, "1c"))
        tables = made.touched, made.distances, made.edges, made.critical, closures, boost.select(made, 2, g.vertices)
        return [sorted(map(tuple, t.select(sorted(t.columns)).collect()), key=repr) for t in tables]

    by_tasks = found()
    assert by_tasks[0] and by_tasks[3] == by_tasks[4]
    monkeypatch.setattr(whole, "EDGES_IN_TASK", 0)
    monkeypatch.setattr(boost, "SKETCH_IN_TASK", -1)
    assert found() == by_tasks


def millions(spark):
    """``long_path``, and 4,200,000 edges beside it that no sketch meets."""
    g = long_path(spark, BOOST)
    wide = spark.range(4_200_000).selectExpr("1000 + id % 2100 as src", "5000 + id div 2100 as dst", "0D as p", "1e-8D as p_boost")
    last = [s for s, c in sketch.centres(g.vertices, 0, 100, "1c").collect() if c == 59]
    assert last
    return Graph.of(g.edges.union(wide), BOOST, g.vertices.union(wide.selectExpr("explode(array(src, dst)) id", "0D weight").distinct())), ids(spark, [0]), sorted(last)


def test_critical_on_millions_of_edges_takes_no_job_a_hop(spark):
    g, seeds, last = millions(spark)
    found, n = jobs(spark, lambda: boost.critical_by_closures(g, seeds, sketch.centres(g.vertices, 0, 100, "1c")).collect())
    assert sorted(map(tuple, found)) == [(s, 59) for s in last]
    assert n < 40


def test_greedy_critical_on_millions_of_edges_takes_no_job_a_hop(spark):
    g, seeds, last = millions(spark)
    found, n = jobs(spark, lambda: boost.cover_critical(boost.critical_by_closures(g, seeds, sketch.centres(g.vertices, 0, 100, "1c")), 2, g.vertices, seeds).collect())
    assert sorted(map(tuple, found)) == [(0, 59, len(last)), (1, 1, 0)]
    assert n < 70


def test_sketch_stats_on_millions_of_edges_take_no_job_a_hop(spark):
    g, seeds, last = millions(spark)
    found, n = jobs(spark, lambda: boost.stats(boost.boost_sketches(g, seeds, 100, 2)).collect())
    assert [tuple(r) for r in found] == [(len(last), len(last), len(last), len(last) / 100)]
    assert n < 70


def test_full_select_on_millions_of_edges_takes_no_job_a_hop(spark):
    g, seeds, last = millions(spark)
    found, n = jobs(spark, lambda: boost.select(boost.boost_sketches(g, seeds, 100, 2), 1, g.vertices).collect())
    assert [tuple(r) for r in found] == [(0, 59, len(last))]
    assert n < 70


def test_sketch_critical_on_millions_of_edges_takes_no_job_a_hop(spark):
    g, seeds, last = millions(spark)
    found, n = jobs(spark, lambda: boost.boost_sketches(g, seeds, 100, 2).critical.collect())
    assert sorted(map(tuple, found)) == [(s, 59) for s in last]
    assert n < 60


@pytest.mark.parametrize("shift", [0, 1 << 33])
def test_packed_edges_are_all_edges(spark, monkeypatch, shift):
    monkeypatch.setattr(whole, "PACKED", 7)
    rows = [(a * a % 101 + (shift if a % 2 else -a), a * b % 13 + shift, a, b) for a in range(40) for b in range(5)]
    made = whole.packed(spark.createDataFrame(rows, "src long, dst long, t long, s long")).toArrow()
    assert made.num_rows > 3
    into = whole.Into(*[[c] for c in whole.unpacked(made.combine_chunks().to_batches()[0])])
    assert sorted(into.names.tolist()) == into.names.tolist() == sorted({r[1] for r in rows})
    at = np.concatenate([np.arange(f, f + n) for f, n in zip(into.first, into.n, strict=True)])
    held = zip(into.src[at].tolist(), np.repeat(into.names, into.n).tolist(), into.t[at].tolist(), into.s[at].tolist(), strict=True)
    assert sorted(held) == sorted(rows)
    assert into.src.itemsize == (8 if shift else 4) and into.t.itemsize == into.s.itemsize == 4


def test_cascades_take_no_job_a_hop(spark):
    g = long_path(spark, BOOST)
    rows, n = jobs(spark, lambda: cascade.reached_both(g, ids(spark, [0]), 2, ids(spark, [59])).collect())
    assert sorted(map(tuple, rows)) == [(s, v, v < 59, True) for s in range(2) for v in range(60)]
    assert n < 30
    assert jobs(spark, lambda: cascade.reached(g, ids(spark, [0]), 2).count())[1] < 30


def test_cascades_ahead_and_by_hops(spark, monkeypatch):
    g, seeds, more = graph(spark, A, BOOST), ids(spark, [9, 2, 77]), ids(spark, [4, 5])
    seen = lambda: [sorted(map(tuple, rows.collect())) for rows in (cascade.reached_both(g, seeds, 40, more), cascade.reached(g, seeds, 40), cascade.reached(g, seeds, 40, more), cascade.reached(graph(spark, A), seeds, 40))]
    ahead = seen()
    assert [r[:2] for r in ahead[0] if r[2]] == ahead[1] and [r[:2] for r in ahead[0] if r[3]] == ahead[2] != ahead[1]
    monkeypatch.setattr(cascade, "DRAWS_AHEAD", 0)
    assert seen() == ahead


def test_strong_components_trim_until_one_task_holds_the_rest(spark, monkeypatch):
    monkeypatch.setattr(components, "IN_ONE_TASK", 10)
    monkeypatch.setattr(components, "_spread", lambda *_: pytest.fail("the rest fits one task after some rounds of trimming"))
    tree = [(i, i // 2) for i in range(2, 128)] + [(1, 200), (200, 201), (201, 1)]
    found = dict(map(tuple, components.scc(Graph.of(spark.createDataFrame(tree, "src long, dst long"))).collect()))
    assert found == {v: 1 if v > 127 else v for v in [*range(1, 128), 200, 201]}
