"""Registered queries over interaction and regulation graphs."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as N
from .registry import query

NODES = [5, 17, 42, 99, 123]
KEPT = """
SELECT src, dst, mode, effect, mechanism, ordinal FROM (
  SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY ordinal DESC) AS r FROM {regulations} WHERE dst IS NOT NULL) WHERE r = 1"""
EDGES = "SELECT DISTINCT src, dst FROM {regulations} WHERE dst IS NOT NULL"
CHOSEN = "SELECT * FROM (VALUES (5, 0), (17, 1), (42, 2), (99, 3), (123, 4)) t(node, ordinal)"
WALK_LEN = 4


@query("g1_neighbours_of", """
SELECT DISTINCT x.gene AS a, y.gene AS b FROM {complexes} x JOIN {complexes} y ON y.complex_id = x.complex_id AND x.gene <> y.gene""")
def _(fx):
    return N.neighbours_of(fx.complexes, fx.complexes)


@query("g1_clique_edges", """
WITH star AS (SELECT DISTINCT gene, concat('group:', complex_id) AS hub FROM {complexes} WHERE complex_id IN (
  SELECT complex_id FROM {complexes} GROUP BY complex_id HAVING count(DISTINCT gene) > 1))
SELECT gene AS a, hub AS b, hub AS via FROM star UNION ALL SELECT hub, gene, hub FROM star""")
def _(fx):
    return N.clique_edges(fx.complexes)


@query("g2_canonical_members", """
SELECT DISTINCT complex_id, lower(coalesce(canonical, gene)) AS gene FROM {cx} LEFT JOIN (
  SELECT lower(synonym) AS k, arg_max(name, ordinal) AS canonical FROM {synonyms} GROUP BY 1) ON k = lower(gene)""",
       cx="SELECT complex_id, CASE WHEN complex_id % 2 = 0 THEN concat('SYN', substr(gene, 2)) ELSE upper(gene) END AS gene FROM {complexes}")
def _(fx):
    raw = fx.complexes.withColumn("gene", F.when(F.col("complex_id") % 2 == 0, F.concat(F.lit("SYN"), F.expr("substr(gene, 2)"))).otherwise(F.upper("gene")))
    return N.canonical_members(raw, fx.synonyms)


@query("g3_neighbourhood", """
WITH RECURSIVE reach(centre, gene, layer) AS (
  SELECT gene, gene, 0 FROM (VALUES ('p10'), ('p77'), ('p150')) t(gene)
  UNION
  SELECT r.centre, y.gene, layer + 1 FROM reach r JOIN {complexes} x ON x.gene = r.gene JOIN {complexes} y ON y.complex_id = x.complex_id WHERE layer < 2)
SELECT centre, gene, min(layer) AS layer FROM reach GROUP BY centre, gene""")
def _(fx):
    centres = fx.spark.createDataFrame([("p10",), ("p77",), ("p150",)], "gene string")
    return N.neighbourhood(fx.complexes, centres, 2)


@query("g4_directed_graph", "SELECT * FROM {kept}", kept=KEPT)
def _(fx):
    return N.directed_graph(fx.regulations)


_WALK = """
WITH RECURSIVE walk(source, path) AS (
  SELECT node, [node] FROM {chosen}
  UNION ALL
  SELECT source, list_append(path, dst) FROM walk JOIN {edges} ON src = path[len(path)] WHERE len(path) <= 4 AND NOT list_contains(path, dst)),
short AS (SELECT source, path[len(path)] AS node, len(path) - 1 AS d, path FROM walk),
best AS (SELECT source, node, min(d) AS d FROM short GROUP BY source, node),
sp AS (SELECT s.* FROM short s JOIN best b ON b.source = s.source AND b.node = s.node AND b.d = s.d),
pairs AS (SELECT a.node AS source, b.node AS target FROM {chosen} a JOIN {chosen} b ON a.ordinal < b.ordinal),
onpath AS (SELECT p.source, p.target, sp.path, sp.d FROM pairs p JOIN sp ON sp.source = p.source AND sp.node = p.target)
"""
GRAPH = {"chosen": CHOSEN, "edges": EDGES}


@query("g5_shortest_paths", _WALK + """
SELECT p.source, p.target, coalesce(bool_or(o.d = 1), false) AS direct, count(o.path) AS n_paths, min(o.d) AS dist,
       array_to_string(min(o.path), ' -> ') AS example_path
FROM pairs p LEFT JOIN onpath o ON o.source = p.source AND o.target = p.target GROUP BY p.source, p.target""", **GRAPH)
def _(fx):
    return N.shortest_paths(N.directed_graph(fx.regulations), NODES, WALK_LEN)


@query("g6_intermediate_counts", _WALK + """
SELECT node, count(*) AS n_paths FROM (SELECT unnest(path[2:len(path) - 1]) AS node FROM onpath WHERE d >= 2) GROUP BY node""", **GRAPH)
def _(fx):
    return N.intermediate_counts(N.directed_graph(fx.regulations), NODES, WALK_LEN)


@query("g7_edges_among_chosen", f"""
SELECT src, dst, mode, effect, mechanism, ordinal, concat(coalesce(effect, mode, ''), ' (', coalesce(mechanism, ''), ')') AS label
FROM {{kept}} WHERE src IN (SELECT p_partkey FROM part WHERE p_size <= 25) AND dst IN (SELECT p_partkey FROM part WHERE p_size <= 25)""", kept=KEPT)
def _(fx):
    picked = fx.part.where("p_size <= 25").select(F.col("p_partkey").alias("node"))
    return N.edges_among(N.directed_graph(fx.regulations), picked)


@query("g8_feedback_loops", """
WITH RECURSIVE walk(source, path, closed) AS (
  SELECT node, [node], false FROM {chosen}
  UNION ALL
  SELECT source, CASE WHEN dst = source THEN path ELSE list_append(path, dst) END, dst = source
  FROM walk JOIN {edges} ON src = path[len(path)] WHERE NOT closed AND len(path) <= 4 AND (dst = source OR (NOT list_contains(path, dst) AND len(path) < 4)))
SELECT DISTINCT len(path) AS length, array_to_string(list_concat(path[lo:len(path)], path[1:lo - 1]), ' -> ') AS loop
FROM (SELECT path, list_position(path, list_min(path)) AS lo FROM walk WHERE closed)""", **GRAPH)
def _(fx):
    return N.feedback_loops(N.directed_graph(fx.regulations), NODES, 4)


@query("g9_path_nodes", _WALK + "SELECT DISTINCT unnest(path) AS node FROM onpath", **GRAPH)
def _(fx):
    return N.path_nodes(N.directed_graph(fx.regulations), NODES, WALK_LEN)


@query("g9_path_edges", _WALK + """
SELECT DISTINCT path[i] AS src, path[i + 1] AS dst FROM (SELECT path, unnest(range(1, len(path))) AS i FROM onpath)""", **GRAPH)
def _(fx):
    return N.path_edges(N.directed_graph(fx.regulations), NODES, WALK_LEN)


PAIRS = """
SELECT interaction_id, a, b FROM (SELECT interaction_id, min(molecule_id) AS a, max(molecule_id) AS b, count(*) AS n FROM {interactions} GROUP BY 1)
WHERE n = 2 AND a IN (SELECT id FROM {molecules} WHERE type = 'Protein') AND b IN (SELECT id FROM {molecules} WHERE type = 'Protein')"""


@query("p9_protein_edges", "SELECT * FROM {two}", two=PAIRS)
def _(fx):
    return N.protein_edges(fx.interactions, fx.molecules)


@query("g10_degree", "SELECT node, count(*) AS degree FROM (SELECT a AS node FROM {two} UNION ALL SELECT b FROM {two}) GROUP BY node", two=PAIRS)
def _(fx):
    return N.degree(N.protein_edges(fx.interactions, fx.molecules))


LINKED = "SELECT DISTINCT a AS src, b AS dst FROM {supplier_links} WHERE a <> b UNION SELECT b, a FROM {supplier_links} WHERE a <> b"


@query("g11_centrality", """
WITH RECURSIVE reach(s, v, d) AS (
  SELECT DISTINCT src, src, 0 FROM {linked} UNION SELECT s, dst, d + 1 FROM reach JOIN {linked} ON src = v WHERE d < 12),
dist AS MATERIALIZED (SELECT s, v, min(d) AS d FROM reach GROUP BY s, v),
path(s, v, d) AS (
  SELECT DISTINCT src, src, 0 FROM {linked} UNION ALL
  SELECT p.s, dst, p.d + 1 FROM path p JOIN {linked} ON src = p.v JOIN dist t ON t.s = p.s AND t.v = dst AND t.d = p.d + 1),
sigma AS MATERIALIZED (SELECT s, v, d, count(*) AS n FROM path GROUP BY s, v, d)
SELECT k.node, round(coalesce(b, 0), 6) AS betweenness, round(coalesce(c, 0), 6) AS closeness
FROM (SELECT DISTINCT src AS node FROM {linked}) k
LEFT JOIN (SELECT x.v AS node, sum(x.n * y.n / z.n::DOUBLE) AS b FROM sigma x JOIN sigma y ON y.s = x.v JOIN sigma z ON z.s = x.s AND z.v = y.v AND z.d = x.d + y.d
           WHERE x.v <> x.s AND x.v <> y.v GROUP BY x.v) t1 ON t1.node = k.node
LEFT JOIN (SELECT v AS node, sum(1.0::DOUBLE / d) AS c FROM dist WHERE d > 0 GROUP BY v) t2 ON t2.node = k.node""",
       linked=LINKED)
def _(fx):
    links = fx.supplier_links
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    out = N.centrality(links, nodes)
    return out.select("node", F.round("betweenness", 6).alias("betweenness"), F.round("closeness", 6).alias("closeness"))


@query("g11_closeness_sketch", """
WITH RECURSIVE reach(s, v, d) AS (
  SELECT DISTINCT src, src, 0 FROM {linked} UNION SELECT s, dst, d + 1 FROM reach JOIN {linked} ON src = v WHERE d < 12)
SELECT v AS node, round(sum(1.0::DOUBLE / d), 6) AS exact, true AS within_5_percent FROM (SELECT s, v, min(d) AS d FROM reach GROUP BY s, v) WHERE d > 0 GROUP BY v""", linked=LINKED)
def _(fx):
    links = fx.supplier_links
    exact = N.closeness(links).withColumnRenamed("closeness", "exact")
    both = exact.join(N.closeness_by_sketch(links), "node")
    return both.select("node", F.round("exact", 6).alias("exact"), (F.abs(F.col("closeness") - F.col("exact")) <= 0.05 * F.col("exact")).alias("within_5_percent"))


@query("a27_graph_summary", """
SELECT count(*) AS molecules, count(*) FILTER (WHERE type = 'Protein') AS proteins, (SELECT count(DISTINCT interaction_id) FROM {interactions}) AS interactions FROM {molecules}""")
def _(fx):
    return N.graph_summary(fx.molecules, fx.interactions)


@query("s15_sif_lines", "SELECT concat(a, chr(9), 'interacts_with', chr(9), b) AS value FROM {two}", two=PAIRS)
def _(fx):
    return N.sif_lines(N.protein_edges(fx.interactions, fx.molecules))
