"""Queries of the graph engine over the driver's tables, and their SQL for DuckDB.

Random choices are keyed hashes, so Monte Carlo results are the same in both. Results that rest on sums of doubles are
rounded to 6 digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import prob
from .functions.draw import RANGE, draw, draw_sql, fires_sql
from .graph import BOOST, SEED, Graph
from .operators import boost, cascade, coarsen, components, match, ordering, rank, sketch
from .sources import dataset, edges

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

SIMS, SKETCHES, K = 20, 200, 5


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = f"WITH RECURSIVE {sql.strip()}"
        return f

    return put


# --- graphs -------------------------------------------------------------------------------------------------------

PART = """part_edges AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem) WHERE dst IS NOT NULL AND src <> dst)"""
EVENT = """event_edges AS (SELECT DISTINCT src, dst FROM (SELECT user_id AS src, lead(user_id) OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL AND src <> dst)"""
NATION = """nation_edges AS (SELECT DISTINCT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey <> s_nationkey)"""


def _degrees(table: str) -> str:
    return f"""ids AS (SELECT src AS id FROM {table} UNION SELECT dst FROM {table}),
indeg AS (SELECT dst AS id, count(*) AS d FROM {table} GROUP BY 1), outdeg AS (SELECT src AS id, count(*) AS d FROM {table} GROUP BY 1),
degrees AS (SELECT ids.id, coalesce(i.d, 0)::BIGINT AS in_degree, coalesce(o.d, 0)::BIGINT AS out_degree, (coalesce(i.d, 0) + coalesce(o.d, 0))::BIGINT AS degree FROM ids LEFT JOIN indeg i USING (id) LEFT JOIN outdeg o USING (id))"""


def _model(table: str) -> str:
    """Edges with p and a second probability: 1 / in-degree, and that plus 1 / out-degree, at most 1."""
    return f"""{_degrees(table)},
edges AS (SELECT src, dst, 1e0 / i.d AS p, least(1e0 / i.d + 1e0 / o.d, 1e0) AS q FROM {table} JOIN indeg i ON i.id = dst JOIN outdeg o ON o.id = src)"""


def part_graph(spark: SparkSession, sf_dir: str, model: str = SEED) -> Graph:
    return dataset.create_dataset(edges.part_edges(spark, sf_dir), dataset.DatasetParams(model=model, unweighted_ratio=1.0))


def _ids(spark: SparkSession, ids) -> DataFrame:
    return spark.createDataFrame([(int(i),) for i in ids], "id long")


@query("edges_part", f"{PART} SELECT src, dst FROM part_edges")
def edges_part(spark, sf_dir):
    return edges.part_edges(spark, sf_dir)


@query("edges_event", f"{EVENT} SELECT src, dst FROM event_edges")
def edges_event(spark, sf_dir):
    return edges.event_edges(spark, sf_dir)


@query("edges_nation", f"{NATION} SELECT src, dst FROM nation_edges")
def edges_nation(spark, sf_dir):
    return edges.nation_edges(spark, sf_dir)


@query("degree_table", f"{PART}, {_degrees('part_edges')} SELECT id, in_degree, out_degree, degree FROM degrees")
def degree_table(spark, sf_dir):
    return Graph.of(edges.part_edges(spark, sf_dir)).degrees().selectExpr("id", "cast(in_degree as long) in_degree", "cast(out_degree as long) out_degree", "cast(degree as long) degree")


@query("graph_size", f"{PART}, {_degrees('part_edges')} SELECT (SELECT count(*) FROM ids) AS n, (SELECT count(*) FROM part_edges) AS m")
def graph_size(spark, sf_dir):
    g = Graph.of(edges.part_edges(spark, sf_dir))
    return g.vertices.agg(F.count("*").alias("n"), F.lit(g.m()).cast("long").alias("m"))


@query("degree_histogram", f"""{PART}, {_degrees('part_edges')}, lim AS (SELECT min(degree)::DOUBLE AS lo, max(degree)::DOUBLE AS hi FROM degrees),
bins AS (SELECT least(floor((degree - lo) / ((hi - lo) / 20)), 19)::INT AS bin, count(*) AS n FROM degrees, lim GROUP BY 1)
SELECT r.range::INT AS bin, coalesce(n, 0)::BIGINT AS n FROM range(20) r LEFT JOIN bins ON bins.bin = r.range""")
def degree_histogram(spark, sf_dir):
    return ordering.histogram(Graph.of(edges.part_edges(spark, sf_dir)).degrees(), "degree", 20).select("bin", "n")


@query("degree_summary", f"{PART}, {_degrees('part_edges')} SELECT count(degree) AS n, min(degree) AS least, max(degree) AS greatest, round(avg(degree), 6) AS mean, round(stddev_pop(degree), 6) AS deviation FROM degrees")
def degree_summary(spark, sf_dir):
    return ordering.summary(Graph.of(edges.part_edges(spark, sf_dir)).degrees(), "degree").withColumns({"mean": F.round("mean", 6), "deviation": F.round("deviation", 6)})


# --- datasets -----------------------------------------------------------------------------------------------------


@query("dataset_wim_edges", f"{PART}, {_model('part_edges')} SELECT src, dst, round(p, 6) AS p, round(q, 6) AS p_seed FROM edges")
def dataset_wim_edges(spark, sf_dir):
    return part_graph(spark, sf_dir).edges.select("src", "dst", F.round("p", 6).alias("p"), F.round("p_seed", 6).alias("p_seed"))


@query("dataset_wbim_edges", f"{PART}, {_model('part_edges')} SELECT src, dst, round(p, 6) AS p, round(q, 6) AS p_boost FROM edges")
def dataset_wbim_edges(spark, sf_dir):
    return part_graph(spark, sf_dir, BOOST).edges.select("src", "dst", F.round("p", 6).alias("p"), F.round("p_boost", 6).alias("p_boost"))


RANKED = f"{PART}, {_degrees('part_edges')}, ranked AS (SELECT *, row_number() OVER (ORDER BY degree, id) AS r, count(*) OVER () AS n FROM degrees)"


@query("hub_penalty_vertices", f"{RANKED} SELECT id FROM ranked WHERE r > n - floor(0.05::DOUBLE * n)")
def hub_penalty_vertices(spark, sf_dir):
    params = dataset.DatasetParams(penalized_ratio=0.05, penalize_factor=2.0)
    return dataset.vertex_table(Graph.of(edges.part_edges(spark, sf_dir)), params).where("penalized").select("id")


@query("vertex_weights_geometric", f"""{RANKED}, top AS (SELECT max(degree) AS m FROM ranked WHERE r <= floor(0.8::DOUBLE * n))
SELECT id, CASE WHEN r <= floor(0.8::DOUBLE * n) AND degree < m AND degree > 0 THEN 1e0 + floor(ln(1 - ({draw_sql(1, 'id')} + 0.5::DOUBLE) / {float(RANGE)}::DOUBLE) / ln(1 - degree / m::DOUBLE)) ELSE 1e0 END AS weight FROM ranked, top""")
def vertex_weights_geometric(spark, sf_dir):
    return dataset.vertex_table(Graph.of(edges.part_edges(spark, sf_dir)), dataset.DatasetParams(unweighted_ratio=0.2)).select("id", "weight")


@query("matrix_market_pairs", """lines AS (SELECT l_orderkey * 16 + l_linenumber AS line, min(l_partkey) AS u, max(l_suppkey) AS v FROM lineitem GROUP BY 1), pairs AS (SELECT * FROM lines WHERE u <> v),
seen AS (SELECT id, min(spot) AS spot FROM (SELECT u AS id, line * 2 AS spot FROM pairs UNION ALL SELECT v, line * 2 + 1 FROM pairs) GROUP BY id), num AS (SELECT id, row_number() OVER (ORDER BY spot) AS k FROM seen)
SELECT DISTINCT a.k AS u, b.k AS v FROM pairs JOIN num a ON a.id = u JOIN num b ON b.id = v""")
def matrix_market_pairs(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy((F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("line")).agg(F.min("l_partkey").alias("u"), F.max("l_suppkey").alias("v"))
    return edges.renumbered(rows.where("u <> v"))


@query("directedness_flag", f"{PART} SELECT bool_or(src < dst) AND bool_or(src > dst) AS directed FROM part_edges")
def directedness_flag(spark, sf_dir):
    return edges.directed_flag(edges.part_edges(spark, sf_dir).toDF("u", "v"))


@query("undirected_merge_max", f"{PART}, {_model('part_edges')} SELECT least(src, dst) AS u, greatest(src, dst) AS v, round(max(p), 6) AS p FROM edges GROUP BY 1, 2")
def undirected_merge_max(spark, sf_dir):
    return match.undirect(part_graph(spark, sf_dir).edges).withColumn("p", F.round("p", 6))


@query("undirected_merge_product", f"{PART}, {_model('part_edges')} SELECT least(src, dst) AS u, greatest(src, dst) AS v, round(1 - product(1 - p), 6) AS p FROM edges GROUP BY 1, 2")
def undirected_merge_product(spark, sf_dir):
    return match.undirect(part_graph(spark, sf_dir).edges, match.P_PRODUCT).withColumn("p", F.round("p", 6))


# --- ranking ------------------------------------------------------------------------------------------------------


@query("max_out_degree_topk", f"{PART}, {_degrees('part_edges')} SELECT id, out_degree AS degree FROM degrees ORDER BY out_degree DESC, id LIMIT 50")
def max_out_degree_topk(spark, sf_dir):
    return rank.max_out_degree(Graph.of(edges.part_edges(spark, sf_dir)), 50).select("id", F.col("degree").cast("long").alias("degree"))


@query("max_out_strength_topk", f"{PART}, {_model('part_edges')}, s AS (SELECT ids.id, round(coalesce(sum(p), 0), 9) AS strength FROM ids LEFT JOIN edges ON src = ids.id GROUP BY 1) SELECT id, round(strength, 6) AS strength FROM s ORDER BY s.strength DESC, id LIMIT 50")
def max_out_strength_topk(spark, sf_dir):
    return rank.max_out_strength(part_graph(spark, sf_dir), 50).select("id", F.round("strength", 6).alias("strength"))


def _pagerank_sql(src: str, dst: str, w: str, rounds: int) -> str:
    steps = [f"{PART}, {_model('part_edges')}, tot AS (SELECT {src} AS id, sum({w}) AS l FROM edges GROUP BY 1), flow AS (SELECT {src} AS s, {dst} AS t, {w} / l AS share FROM edges JOIN tot ON tot.id = {src}), r0 AS (SELECT id, 1e0 AS rank FROM ids)"]
    for k in range(rounds):
        steps.append(f"r{k + 1} AS (SELECT ids.id, 0.85::DOUBLE * coalesce(x.f, 0) + 0.15::DOUBLE AS rank FROM ids LEFT JOIN (SELECT t, sum(rank * share) AS f FROM flow JOIN r{k} ON r{k}.id = s GROUP BY t) x ON x.t = ids.id)")
    return ", ".join(steps)


@query("pagerank_n10", f"{_pagerank_sql('src', 'dst', 'p', 10)} SELECT id, round(rank, 6) AS rank FROM r10")
def pagerank_n10(spark, sf_dir):
    return rank.pagerank(part_graph(spark, sf_dir), rank.PageRankParams(iterations=10, epsilon=0)).withColumn("rank", F.round("rank", 6))


@query("pagerank_transpose_n10", f"{_pagerank_sql('dst', 'src', '1e0', 10)} SELECT id, round(rank, 6) AS rank FROM r10")
def pagerank_transpose_n10(spark, sf_dir):
    return rank.pagerank(part_graph(spark, sf_dir), rank.PageRankParams(iterations=10, epsilon=0, transpose=True, edge_weights=False)).withColumn("rank", F.round("rank", 6))


@query("pagerank_topk", f"{_pagerank_sql('src', 'dst', 'p', 10)} SELECT id, round(rank, 6) AS rank FROM r10 ORDER BY round(r10.rank, 9) DESC, id LIMIT 20")
def pagerank_topk(spark, sf_dir):
    return rank.pagerank_topk(part_graph(spark, sf_dir), 20, rank.PageRankParams(iterations=10, epsilon=0)).select("id", F.round("rank", 6).alias("rank"))


@query("pagerank_bottomk", f"{_pagerank_sql('src', 'dst', 'p', 10)} SELECT id, round(rank, 6) AS rank FROM r10 ORDER BY round(r10.rank, 9), id LIMIT 20")
def pagerank_bottomk(spark, sf_dir):
    return rank.pagerank_topk(part_graph(spark, sf_dir), 20, rank.PageRankParams(iterations=10, epsilon=0), largest=False).select("id", F.round("rank", 6).alias("rank"))


@query("imrank_topk")
def imrank_topk(spark, sf_dir):
    return rank.imrank(part_graph(spark, sf_dir), 20, iterations=3)


# --- components ---------------------------------------------------------------------------------------------------

WHOLE = f"{PART}, ids AS (SELECT src AS id FROM part_edges UNION SELECT dst FROM part_edges)"
STRONG = "strong AS (SELECT r.a AS id, min(r.b) AS component FROM reach r JOIN reach s ON r.a = s.b AND r.b = s.a GROUP BY 1)"


def _reach(table: str, both: bool = False, name: str = "reach") -> str:
    """All pairs of ids of which the first reaches the second."""
    steps = f"(SELECT src AS x, dst AS y FROM {table} UNION SELECT dst, src FROM {table})" if both else f"(SELECT src AS x, dst AS y FROM {table})"
    return f"{name} AS (SELECT id AS a, id AS b FROM ids UNION SELECT a, y FROM {name} JOIN {steps} ON x = b)"


def whole_graph(spark, sf_dir) -> Graph:
    return Graph.of(edges.part_edges(spark, sf_dir))


@query("wcc_labels", f"{WHOLE}, {_reach('part_edges', True)} SELECT a AS id, min(b) AS component FROM reach GROUP BY 1")
def wcc_labels(spark, sf_dir):
    return components.wcc(whole_graph(spark, sf_dir))


@query("wcc_count", f"{WHOLE}, {_reach('part_edges', True)} SELECT count(DISTINCT component) AS n_wcc FROM (SELECT a, min(b) AS component FROM reach GROUP BY 1)")
def wcc_count(spark, sf_dir):
    return components.wcc(whole_graph(spark, sf_dir)).agg(F.countDistinct("component").alias("n_wcc"))


@query("wcc_without_seeds", f"{PART}, {_degrees('part_edges').replace('ids AS', 'all_ids AS').replace('FROM ids', 'FROM all_ids ids')}, hubs AS (SELECT id FROM degrees WHERE degree > (SELECT avg(degree) FROM degrees)), ids AS (SELECT id FROM all_ids WHERE id NOT IN (SELECT id FROM hubs)), rest AS (SELECT src, dst FROM part_edges WHERE src IN (SELECT id FROM ids) AND dst IN (SELECT id FROM ids)), {_reach('rest', True)} SELECT a AS id, min(b) AS component FROM reach GROUP BY 1")
def wcc_without_seeds(spark, sf_dir):
    g = whole_graph(spark, sf_dir)
    degrees = g.degrees()
    return components.wcc(g, degrees.join(F.broadcast(degrees.agg(F.avg("degree").alias("mean"))), F.col("degree") > F.col("mean")).select("id"))  # one row


@query("scc_labels", f"{WHOLE}, {_reach('part_edges')}, {STRONG} SELECT id, component FROM strong")
def scc_labels(spark, sf_dir):
    return components.scc(whole_graph(spark, sf_dir))


@query("scc_filtered_count", f"{WHOLE}, live AS (SELECT src, dst FROM part_edges WHERE src < dst OR src % 2 = 0), {_reach('live')}, {STRONG} SELECT count(DISTINCT component) AS n_scc FROM strong")
def scc_filtered_count(spark, sf_dir):
    return components.scc(whole_graph(spark, sf_dir), F.expr("src < dst or src % 2 = 0")).agg(F.countDistinct("component").alias("n_scc"))


ROBUST = f"""{PART}, {_model('part_edges')},
live0 AS (SELECT src, dst FROM edges WHERE {fires_sql('p', '1s0', 'src', 'dst')}), live1 AS (SELECT src, dst FROM edges WHERE {fires_sql('p', '1s1', 'src', 'dst')}),
{_reach('live0', name='reach0')}, {_reach('live1', name='reach1')},
c0 AS (SELECT r.a AS id, min(r.b) AS c FROM reach0 r JOIN reach0 s ON r.a = s.b AND r.b = s.a GROUP BY 1), c1 AS (SELECT r.a AS id, min(r.b) AS c FROM reach1 r JOIN reach1 s ON r.a = s.b AND r.b = s.a GROUP BY 1)
SELECT id, min(id) OVER (PARTITION BY c0.c, c1.c) AS group_id FROM c0 JOIN c1 USING (id)"""


@query("robust_scc_groups", ROBUST)
def robust_scc_groups(spark, sf_dir):
    return rank.robust_groups(part_graph(spark, sf_dir), 2, 1)


@query("robust_scc_seeds")
def robust_scc_seeds(spark, sf_dir):
    return rank.robust_scc(part_graph(spark, sf_dir), 3, 2, SKETCHES)


# --- cascades -----------------------------------------------------------------------------------------------------

SEEDS = "seeds AS (SELECT id FROM ids WHERE id % 400 = 7)"
SIMULATED = f"{PART}, {_model('part_edges')}, {SEEDS}, e AS (SELECT src, dst, CASE WHEN src IN (SELECT id FROM seeds) THEN q ELSE p END AS pr FROM edges), reach AS (SELECT s.range AS sim, id FROM seeds, range({SIMS}) s UNION SELECT sim, dst FROM reach JOIN e ON src = id WHERE {fires_sql('pr', 1, 'sim', 'src', 'dst')})"
BOOSTED = f"{PART}, {_model('part_edges')}, {SEEDS}, e AS (SELECT src, dst, p AS pr FROM edges), eb AS (SELECT src, dst, CASE WHEN dst % 50 = 1 THEN q ELSE p END AS pr FROM edges), base AS (SELECT s.range AS sim, id FROM seeds, range({SIMS}) s UNION SELECT sim, dst FROM base JOIN e ON src = id WHERE {fires_sql('pr', 1, 'sim', 'src', 'dst')}), more AS (SELECT s.range AS sim, id FROM seeds, range({SIMS}) s UNION SELECT sim, dst FROM more JOIN eb ON src = id WHERE {fires_sql('pr', 1, 'sim', 'src', 'dst')})"


def _seeds(g: Graph) -> DataFrame:
    return g.vertices.where("id % 400 = 7").select("id")


@query("simulate_spread", f"{SIMULATED} SELECT sim, count(*) AS n_active FROM reach GROUP BY 1")
def simulate_spread(spark, sf_dir):
    g = part_graph(spark, sf_dir)
    return cascade.reached(g, _seeds(g), SIMS).groupBy("sim").agg(F.count("*").alias("n_active"))


@query("simulate_vertex_freq", f"{SIMULATED} SELECT ids.id, count(sim) / {float(SIMS)}::DOUBLE AS frequency FROM ids LEFT JOIN reach USING (id) GROUP BY 1")
def simulate_vertex_freq(spark, sf_dir):
    g = part_graph(spark, sf_dir)
    return cascade.simulate_frequency(g, _seeds(g), SIMS)


@query("simulate_boost_gain", f"{BOOSTED} SELECT (SELECT count(*) FROM more)::BIGINT - (SELECT count(*) FROM base)::BIGINT AS gained, (SELECT count(*) FROM base)::BIGINT AS base")
def simulate_boost_gain(spark, sf_dir):
    g = part_graph(spark, sf_dir, BOOST)
    rows = cascade.reached_both(g, _seeds(g), SIMS, g.vertices.where("id % 50 = 1"))
    return rows.agg((F.count_if("boosted") - F.count_if("plain")).alias("gained"), F.count_if("plain").alias("base"))


def _activation_sql(rounds: int) -> str:
    steps = [f"{PART}, {_model('part_edges')}, {SEEDS}, f0 AS (SELECT id, (id % 400 = 7) AS s, 0e0 AS a, 0e0 AS b FROM ids)"]
    for k in range(rounds):
        steps.append(f"f{k + 1} AS (SELECT f.id, f.s, CASE WHEN f.s THEN 0e0 ELSE coalesce(x.a, 0) END AS a, CASE WHEN f.s THEN 0e0 ELSE coalesce(x.b, 0) END AS b FROM f{k} f LEFT JOIN (SELECT dst, 1 - product(1 - p * (CASE WHEN u.s THEN 1e0 ELSE u.a END)) AS a, 1 - product(1 - q * (CASE WHEN u.s THEN 1e0 ELSE u.a END)) AS b FROM edges JOIN f{k} u ON u.id = src GROUP BY dst) x ON x.dst = f.id)")
    return ", ".join(steps)


@query("activation_probability_k3", f"{_activation_sql(3)} SELECT id, round(a, 6) AS p_in, round(b, 6) AS p_in_boosted FROM f3")
def activation_probability_k3(spark, sf_dir):
    g = part_graph(spark, sf_dir, BOOST)
    return cascade.activation_probability(g, _seeds(g), 3).select("id", F.round("p_in", 6).alias("p_in"), F.round("p_in_boosted", 6).alias("p_in_boosted"))


# --- sketches -----------------------------------------------------------------------------------------------------

CENTRES = f"cum AS (SELECT id, row_number() OVER (ORDER BY id) AS upto, count(*) OVER () AS n FROM ids), drawn AS (SELECT r.range AS sketch_id, {draw_sql('1c', 'r.range')} AS x FROM range({SKETCHES}) r), centres AS (SELECT sketch_id, id FROM drawn JOIN cum ON x * (n::DOUBLE / {float(RANGE)}::DOUBLE) >= upto - 1 AND x * (n::DOUBLE / {float(RANGE)}::DOUBLE) < upto)"
RR = f"{PART}, {_model('part_edges')}, {CENTRES}, inn AS (SELECT sketch_id, id FROM centres UNION SELECT sketch_id, src FROM inn JOIN edges ON dst = id WHERE {fires_sql('p', 1, 'sketch_id', 'src', 'dst')}), members AS (SELECT sketch_id, id FROM inn UNION SELECT sketch_id, src FROM inn JOIN edges ON dst = id WHERE {fires_sql('q', 1, 'sketch_id', 'src', 'dst')})"


@query("rr_centres", f"{PART}, {_degrees('part_edges')}, {CENTRES} SELECT sketch_id, id FROM centres")
def rr_centres(spark, sf_dir):
    return sketch.centres(Graph.of(edges.part_edges(spark, sf_dir)).vertices, 0, SKETCHES, "1c")


@query("rr_members", f"{RR} SELECT sketch_id, id FROM members")
def rr_members(spark, sf_dir):
    return sketch.rr_sketches(part_graph(spark, sf_dir), SKETCHES)


@query("rr_stats", f"{RR}, sizes AS (SELECT sketch_id, count(*) AS size FROM members GROUP BY 1) SELECT count(*) AS n_sketches, sum(size)::BIGINT AS n_members, round(avg(size), 6) AS average_size, round(avg((size = 1)::INT::DOUBLE), 6) AS single_ratio FROM sizes")
def rr_stats(spark, sf_dir):
    out = sketch.sketch_stats(sketch.rr_sketches(part_graph(spark, sf_dir), SKETCHES))
    return out.withColumns({"average_size": F.round("average_size", 6), "single_ratio": F.round("single_ratio", 6)})


def _cover_sql(members: str, k: int) -> str:
    steps, live = [], members
    for i in range(k):
        steps.append(f"pick{i} AS (SELECT {i} AS ord, id, count(*)::BIGINT AS gain FROM {live} GROUP BY id ORDER BY gain DESC, id LIMIT 1), left{i} AS (SELECT * FROM {live} WHERE sketch_id NOT IN (SELECT sketch_id FROM {live} WHERE id = (SELECT id FROM pick{i})))")
        live = f"left{i}"
    return ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT * FROM pick{i}" for i in range(k))


@query("rr_greedy_seeds", f"{RR}, {_cover_sql('members', K)}")
def rr_greedy_seeds(spark, sf_dir):
    g = part_graph(spark, sf_dir)
    return sketch.select(sketch.rr_sketches(g, SKETCHES), K, g.vertices)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds by reverse-reachable sketches."""
    return rr_greedy_seeds(spark, sf_dir)


# --- boosting -----------------------------------------------------------------------------------------------------

STATES = f"{PART}, {_model('part_edges')}, states AS (SELECT src, dst, {draw_sql(1, "'0'", 'src', 'dst')} AS x, floor(p * {float(RANGE)}::DOUBLE) AS a, floor(q * {float(RANGE)}::DOUBLE) AS b FROM edges)"


@query("prr_edge_states", f"{STATES} SELECT CASE WHEN x < a THEN 'LIVE' WHEN x < b THEN 'LIVE_UPON_BOOST' ELSE 'BLOCKED' END AS state, count(*) AS n FROM states GROUP BY 1")
def prr_edge_states(spark, sf_dir):
    g = part_graph(spark, sf_dir, BOOST)
    return g.edges.groupBy(cascade.edge_state(F.col("p"), F.col("p_boost"), draw(1, F.lit(0), "src", "dst")).alias("state")).agg(F.count("*").alias("n"))


_live = fires_sql("p", 1, "sketch_id", "src", "dst")
_lub = f"(NOT {_live} AND {fires_sql('q', 1, 'sketch_id', 'src', 'dst')})"
CRITICAL = f"""{PART}, {_model('part_edges')}, {SEEDS}, {CENTRES}, starts AS (SELECT * FROM centres WHERE id NOT IN (SELECT id FROM seeds)),
back AS (SELECT sketch_id, id FROM starts UNION SELECT sketch_id, src FROM back JOIN edges ON dst = id WHERE {_live}),
alive AS (SELECT * FROM back WHERE sketch_id NOT IN (SELECT sketch_id FROM back WHERE id IN (SELECT id FROM seeds))),
lit AS (SELECT sketch_id, id FROM (SELECT DISTINCT sketch_id FROM alive), seeds UNION SELECT sketch_id, dst FROM lit JOIN edges ON src = id WHERE {_live}),
critical AS (SELECT DISTINCT a.sketch_id, a.id FROM alive a JOIN edges ON dst = a.id JOIN lit l ON l.sketch_id = a.sketch_id AND l.id = src WHERE {_lub.replace('sketch_id', 'a.sketch_id')})"""


@query("prr_critical", f"{CRITICAL} SELECT sketch_id, id FROM critical")
def prr_critical(spark, sf_dir):
    g = part_graph(spark, sf_dir, BOOST)
    return boost.critical_by_closures(g, _seeds(g), sketch.centres(g.vertices, 0, SKETCHES, "1c"))


@query("prr_greedy_critical", f"{CRITICAL}, {_cover_sql('critical', 3)}")
def prr_greedy_critical(spark, sf_dir):
    g = part_graph(spark, sf_dir, BOOST)
    critical = boost.critical_by_closures(g, _seeds(g), sketch.centres(g.vertices, 0, SKETCHES, "1c"))
    return boost.cover_critical(critical, 3, g.vertices, _seeds(g))


@query("prr_sketch_critical", f"{CRITICAL} SELECT sketch_id, id FROM critical")
def prr_sketch_critical(spark, sf_dir):
    """The same sets from whole sketches with distances."""
    g = part_graph(spark, sf_dir, BOOST)
    return boost.boost_sketches(g, _seeds(g), SKETCHES, 2).critical


@query("prr_sketch_stats")
def prr_sketch_stats(spark, sf_dir):
    g = part_graph(spark, sf_dir, BOOST)
    return boost.stats(boost.boost_sketches(g, _seeds(g), SKETCHES, 2))


@query("prr_full_select")
def prr_full_select(spark, sf_dir):
    g = part_graph(spark, sf_dir, BOOST)
    return boost.select(boost.boost_sketches(g, _seeds(g), SKETCHES, 2), 3, g.vertices)


@query("seed_candidates", f"{PART}, {_model('part_edges')}, s AS (SELECT ids.id, round(coalesce(sum(p), 0), 9) AS strength FROM ids LEFT JOIN edges ON src = ids.id GROUP BY 1) SELECT id FROM s ORDER BY strength DESC, id LIMIT (SELECT floor(count(*) * 0.1::DOUBLE)::BIGINT FROM ids)")
def seed_candidates(spark, sf_dir):
    from .plans.experiment import seed_candidates as candidates

    return candidates(part_graph(spark, sf_dir, BOOST), 0.1).select("id")


# --- coarsening with the groups id div 3 --------------------------------------------------------------------------

GROUPED = f"{PART}, {_model('part_edges')}, groups AS (SELECT id, id // 3 AS group_id, row_number() OVER (PARTITION BY id // 3 ORDER BY id) - 1 AS j FROM ids)"


def _groups(g: Graph) -> DataFrame:
    return g.vertices.select("id", F.expr("id div 3").alias("group_id"))


def _level(spark, sf_dir, model: str = SEED, **params) -> coarsen.Level:
    g = part_graph(spark, sf_dir, model)
    return coarsen.coarsen_by_groups(g, _groups(g), coarsen.CoarseningParams(**params))


def _tables(model: str) -> str:
    """gt: the group table; pairs: cross probabilities with the reverse pair and both groups' columns."""
    second = "o" if model == SEED else "i"
    z = lambda c: f"coalesce({c}, 0e0)"
    members = ", ".join([f"max(CASE WHEN j = {k} THEN groups.id END) AS m{k}" for k in prob.MEMBERS] + [f"{z(f'max(CASE WHEN j = {k} THEN 1e0 END)')} AS w{k}" for k in prob.MEMBERS] + [f"{z(f'max(CASE WHEN j = {k} THEN {c} END)')} AS {n}{k}" for n, c in (("h_in", "hi.p"), ("h_out", "ho.p"), ("h_second", f"h{second}.q")) for k in prob.MEMBERS])
    inner = ", ".join(f"{z(f'max(CASE WHEN ju = {a} AND jv = {b} THEN {c} END)')} AS {n}{a}{b}" for n, c in (("i", "p"), ("s", "q")) for a in prob.MEMBERS for b in prob.MEMBERS if a != b)
    names = [f"{n}{a}{b}" for n in "is" for a in prob.MEMBERS for b in prob.MEMBERS if a != b]
    cross = ", ".join(f"{z(f'max(CASE WHEN ju = {a} AND jv = {b} THEN {c} END)')} AS {n}{a}{b}" for n, c in (("c", "p"), ("x", "q")) for a in prob.MEMBERS for b in prob.MEMBERS)
    cells = [f"{n}{a}{b}" for n in "cx" for a in prob.MEMBERS for b in prob.MEMBERS]
    return f"""g_edges AS (SELECT a.group_id AS gu, b.group_id AS gv, a.j AS ju, b.j AS jv, src, dst, p, q FROM edges JOIN groups a ON a.id = src JOIN groups b ON b.id = dst),
hi AS (SELECT dst AS id, sum(p) AS p, sum(q) AS q FROM g_edges WHERE gu <> gv GROUP BY 1), ho AS (SELECT src AS id, sum(p) AS p, sum(q) AS q FROM g_edges WHERE gu <> gv GROUP BY 1),
g0 AS (SELECT group_id, count(*)::INT AS size, {members} FROM groups LEFT JOIN hi ON hi.id = groups.id LEFT JOIN ho ON ho.id = groups.id GROUP BY 1),
gi AS (SELECT gu AS group_id, {inner} FROM g_edges WHERE gu = gv GROUP BY 1), g1 AS (SELECT g0.*, {', '.join(f'{z(n)} AS {n}' for n in names)} FROM g0 LEFT JOIN gi USING (group_id)),
gt AS (SELECT *, {coarsen.best_member(model)} AS best FROM g1),
cr AS (SELECT gu, gv, {cross} FROM g_edges WHERE gu <> gv GROUP BY 1, 2), ev AS (SELECT gu, gv FROM cr UNION SELECT gv, gu FROM cr),
pairs AS (SELECT ev.gu, ev.gv, {', '.join(f'{z(f"f.{c}")} AS {c}' for c in cells)}, {', '.join(f'b.c{i}{j} AS r{i}{j}' for i in prob.MEMBERS for j in prob.MEMBERS)}, u.* EXCLUDE (group_id), v.size AS size_v, v.best AS best_v, {', '.join(f'v.w{k} AS v{k}' for k in prob.MEMBERS)}
FROM ev LEFT JOIN cr f ON f.gu = ev.gu AND f.gv = ev.gv LEFT JOIN cr b ON b.gu = ev.gv AND b.gv = ev.gu JOIN gt u ON u.group_id = ev.gu JOIN gt v ON v.group_id = ev.gv),
norm AS (SELECT *, {', '.join(f'{x} AS h{k}' for k, x in enumerate(prob.normalised(coarsen.in_heuristics(coarsen.CoarseningParams()))))} FROM pairs)"""


def _edge_sql(rule: str) -> str:
    by = [prob.simple_path(j, "x", "c", "s", "i") for j in prob.MEMBERS]
    seed = f"CASE WHEN size = 1 THEN {prob.direct(0, 'x')} ELSE CASE best {' '.join(f'WHEN {k} THEN {x}' for k, x in enumerate(by))} END END"
    p = f"least(greatest(CASE WHEN h0 IS NULL THEN 0e0 WHEN size = 1 THEN {prob.direct(0)} ELSE {prob.merged(rule)} END, 0e0), 1e0)"
    return f"{GROUPED}, {_tables(SEED)}, merged AS (SELECT gu AS src, gv AS dst, {p} AS p, {seed} AS s FROM norm) SELECT src, dst, round(p, 6) AS p, round(least(greatest(s, p), 1e0), 6) AS p_seed FROM merged"


def _edge_query(rule: str):
    def run(spark, sf_dir):
        return _level(spark, sf_dir, edge_rule=rule).coarse.edges.select("src", "dst", F.round("p", 6).alias("p"), F.round("p_seed", 6).alias("p_seed"))

    return run


for _name, _rule in (("simple", "SEPARATE_SIMPLE"), ("merged_simple", "MERGED_SIMPLE"), ("precise", "SEPARATE_PRECISE"), ("merged", "MERGED_PRECISE")):
    query(f"coarse_edges_{_name}", _edge_sql(_rule))(_edge_query(_rule))


@query("coarse_edges_boost")
def coarse_edges_boost(spark, sf_dir):
    return _level(spark, sf_dir, BOOST).coarse.edges.select("src", "dst", F.round("p", 6).alias("p"), F.round("p_boost", 6).alias("p_boost"))


@query("group_members", f"{GROUPED} SELECT id, group_id, j::BIGINT AS index_in_group FROM groups")
def group_members(spark, sf_dir):
    return match.member_index(_groups(Graph.of(edges.part_edges(spark, sf_dir)))).select("id", "group_id", F.col("index_in_group").cast("long").alias("index_in_group"))


@query("group_heuristics", f"{GROUPED}, {_tables(SEED)} SELECT ids.id, round(coalesce(hi.p, 0), 6) AS h_in, round(coalesce(ho.p, 0), 6) AS h_out, round(coalesce(ho.q, 0), 6) AS h_out_seed FROM ids LEFT JOIN hi ON hi.id = ids.id LEFT JOIN ho ON ho.id = ids.id")
def group_heuristics(spark, sf_dir):
    g = part_graph(spark, sf_dir)
    return coarsen.heuristics(g, _groups(g), "P").select("id", F.round("h_in", 6).alias("h_in"), F.round("h_out", 6).alias("h_out"), F.round("h_second", 6).alias("h_out_seed"))


_INNER = [f"{x}{a}{b}" for x in "is" for a in prob.MEMBERS for b in prob.MEMBERS if a != b]


@query("group_internal_p", f"{GROUPED}, {_tables(SEED)} SELECT group_id, {', '.join(f'round({c}, 6) AS {c}' for c in _INNER)} FROM gt")
def group_internal_p(spark, sf_dir):
    return _level(spark, sf_dir).table.select("group_id", *[F.round(c, 6).alias(c) for c in _INNER])


_NORMAL = prob.normalised([f"h_in{j}" for j in prob.MEMBERS])


@query("normalized_heuristics", f"{GROUPED}, {_tables(SEED)} SELECT group_id, {', '.join(f'round({x}, 6) AS h{k}' for k, x in enumerate(_NORMAL))} FROM gt")
def normalized_heuristics(spark, sf_dir):
    return _level(spark, sf_dir).table.select("group_id", *[F.round(F.expr(x), 6).alias(f"h{k}") for k, x in enumerate(_NORMAL)])


@query("coarse_vertex_weights", f"{GROUPED}, {_tables(SEED)} SELECT group_id AS id, round({coarsen.coarse_weight(coarsen.CoarseningParams())}, 6) AS weight FROM gt")
def coarse_vertex_weights(spark, sf_dir):
    return _level(spark, sf_dir).coarse.vertices.select("id", F.round("weight", 6).alias("weight"))


@query("best_seed_in_group", f"{GROUPED}, {_tables(SEED)} SELECT group_id, best::INT AS best FROM gt")
def best_seed_in_group(spark, sf_dir):
    return _level(spark, sf_dir).table.select("group_id", F.col("best").cast("int").alias("best"))


@query("best_boosted_in_group", f"{GROUPED}, {_tables(BOOST)} SELECT group_id, best::INT AS best FROM gt")
def best_boosted_in_group(spark, sf_dir):
    return _level(spark, sf_dir, BOOST).table.select("group_id", F.col("best").cast("int").alias("best"))


@query("expand_local", f"{GROUPED}, {_tables(SEED)} SELECT group_id AS ord, CASE best WHEN 2 THEN m2 WHEN 1 THEN m1 ELSE m0 END AS id FROM gt WHERE group_id % 7 = 0")
def expand_local(spark, sf_dir):
    level = _level(spark, sf_dir)
    chosen = level.table.where("group_id % 7 = 0").select(F.col("group_id").alias("ord"), F.col("group_id").alias("id"))
    return coarsen.expand(level, chosen)


@query("mongoose_groups")
def mongoose_groups(spark, sf_dir):
    g = part_graph(spark, sf_dir)
    return match.match(g.vertices, match.undirect(g.edges))


@query("coarsened_graph")
def coarsened_graph(spark, sf_dir):
    return coarsen.coarsen(part_graph(spark, sf_dir)).coarse.edges
