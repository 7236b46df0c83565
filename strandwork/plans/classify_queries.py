"""Registered queries for rule-based classification."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify as C
from .registry import query

# Names that meet the rules: part names glued to rule-like stems.
NAMES = """
SELECT p_partkey AS id, CASE p_size % 10 WHEN 0 THEN concat('sig', substr(p_name, 1, 3)) WHEN 1 THEN concat('yab', p_partkey)
  WHEN 2 THEN concat('murA_', p_name) WHEN 3 THEN 'tpiA' WHEN 4 THEN concat(p_name, 'ABC permease transport')
  WHEN 5 THEN concat('rpoB regulator ', p_name) WHEN 6 THEN 'fbaA' WHEN 7 THEN concat('glcK kinase dps ', p_name)
  WHEN 8 THEN 'ctcrpsA' ELSE p_name END AS gene FROM {part}"""


def _share(cat: str) -> str:
    rules = C.PATTERNS[cat]
    return "((" + " + ".join(f"CASE WHEN regexp_matches(gene, '{r}', 'i') THEN 1 ELSE 0 END" for r in rules) + f")::DOUBLE / {len(rules)})"


SHARES = "SELECT *, " + ", ".join(f"{_share(c)} AS {c}" for c in C.PATTERNS) + " FROM {nm}"
LONG = " UNION ALL ".join(f"SELECT id, gene, {i} AS rank, '{c}' AS function, {c} AS share FROM {{sh}}" for i, c in enumerate(C.PATTERNS))
KNOWN = "CASE " + " ".join(
    f"WHEN lower(gene) IN ({', '.join(repr(n.lower()) for n in ns)}) THEN '{c}'" for c, ns in C.KNOWN.items()) + " END"
PRED = f"""
SELECT n.id, n.gene, coalesce(f.function, {KNOWN.replace('gene', 'n.gene')}, 'unknown') AS predicted_function,
       round(coalesce(f.share, CASE WHEN {KNOWN.replace('gene', 'n.gene')} IS NOT NULL THEN 0.9 ELSE 0.1 END), 6) AS confidence
FROM {{nm}} n LEFT JOIN (SELECT id, arg_min(function, rank) AS function, arg_min(share, rank) AS share FROM {{lg}} WHERE share > 0 GROUP BY id) f ON f.id = n.id"""
CTES = {"nm": NAMES, "sh": SHARES, "lg": LONG, "pred": PRED}


def genes(fx):
    return fx.sql(NAMES)


@query("f15_name_features", "SELECT id, gene, length(gene) AS name_length, regexp_matches(gene, '[0-9]')::DOUBLE AS has_numbers, (lower(gene) <> gene)::DOUBLE AS has_uppercase, "
       "(lower(gene) LIKE 'y%')::DOUBLE AS starts_with_y, " + ", ".join(f"round({c}, 6) AS {c}_pattern_score" for c in C.PATTERNS) + " FROM {sh}", nm=NAMES, sh=SHARES)
def _(fx):
    feats = {n: (F.round(c, 6) if n.endswith("score") else c) for n, c in C.name_features("gene").items()}
    return genes(fx).withColumns(feats)


@query("r1_rule_prediction", "SELECT * FROM {pred}", **CTES)
def _(fx):
    return C.predict(genes(fx)).select("id", "gene", "predicted_function", F.round("confidence", 6).alias("confidence"))


@query("r2_alternatives", """
SELECT id, position, function, confidence FROM (
  SELECT l.id, l.function, round(share * 0.8, 6) AS confidence, row_number() OVER (PARTITION BY l.id ORDER BY share DESC, rank) AS position
  FROM {lg} l JOIN {pred} p ON p.id = l.id WHERE l.function <> p.predicted_function AND share * 0.8 > 0.1) WHERE position <= 3""", **CTES)
def _(fx):
    # From a plain explode Spark infers a filter that repeats all patterns on every name.
    return C.predict(genes(fx)).select("id", F.posexplode_outer("alternatives").alias("i", "a")).where("i IS NOT NULL").select(
        "id", (F.col("i") + 1).alias("position"), "a.function", F.round("a.confidence", 6).alias("confidence"))


def _measured(fx):
    return genes(fx).where("id % 2 = 0").select("gene", F.col("id").cast("double").alias("v")).groupBy("gene").agg(F.max("v").alias("v")).select(
        "gene", F.col("v").alias("mean_expression"), (F.col("v") * 2).alias("max_expression"),
        F.lit(None).cast("double").alias("expression_variance"), F.lit(1.0).alias("stress_upregulated"),
        (F.col("v") % 3).alias("degree"), F.lit(0.25).alias("betweenness"), F.lit(None).cast("double").alias("clustering"))


MEAS = "SELECT gene, max(id)::DOUBLE AS v FROM {nm} WHERE id % 2 = 0 GROUP BY gene"


@query("r3_expression_features", """
SELECT s.id, s.gene, CASE WHEN m.gene IS NOT NULL THEN v WHEN stress_response > 0 THEN 2.5 ELSE 1.0 END::DOUBLE AS mean_expression,
  CASE WHEN m.gene IS NOT NULL THEN v * 2 WHEN stress_response > 0 THEN 3.75 ELSE 1.5 END::DOUBLE AS max_expression,
  CASE WHEN m.gene IS NOT NULL THEN 0 ELSE 0.5 END::DOUBLE AS expression_variance,
  CASE WHEN m.gene IS NOT NULL THEN 1 WHEN stress_response > 0 THEN 1 ELSE 0 END::DOUBLE AS stress_upregulated
FROM {sh} s LEFT JOIN {meas} m ON m.gene = s.gene""", nm=NAMES, sh=SHARES, meas=MEAS)
def _(fx):
    return C.expression_features(genes(fx), _measured(fx))


@query("r4_network_features", """
SELECT s.id, s.gene, CASE WHEN m.gene IS NOT NULL THEN v % 3 ELSE 0.2 END::DOUBLE AS degree_centrality,
  CASE WHEN m.gene IS NOT NULL THEN 0.25 ELSE 0.1 END::DOUBLE AS betweenness_centrality,
  CASE WHEN m.gene IS NOT NULL THEN 0 ELSE 0.3 END::DOUBLE AS clustering_coefficient,
  CASE WHEN m.gene IS NOT NULL THEN (v % 3 > 0)::INT ELSE 0.5 END::DOUBLE AS has_interactions
FROM {nm} s LEFT JOIN {meas} m ON m.gene = s.gene""", nm=NAMES, meas=MEAS)
def _(fx):
    return C.network_features(genes(fx), _measured(fx))


@query("r5_feature_matrix", "SELECT id, gene, length(gene) AS name_length, " + ", ".join(f"round({c}, 6) AS {c}_pattern_score" for c in C.PATTERNS) + """,
  1000 AS sequence_length, 0.43::DOUBLE AS gc_content, CASE WHEN stress_response > 0 THEN 2.5 ELSE 1.0 END::DOUBLE AS mean_expression,
  0.2::DOUBLE AS degree_centrality, CASE WHEN id % 2 = 0 THEN id::DOUBLE ELSE 0 END AS assay FROM {sh}""", nm=NAMES, sh=SHARES)
def _(fx):
    named = genes(fx).withColumn("gene_key", F.col("id").cast("string"))
    extra = named.where("id % 2 = 0").select(F.col("gene_key").alias("gene"), F.col("id").cast("double").alias("assay"))
    keyed = C.feature_matrix(named.select("id", "gene", "gene_key"))
    full = keyed.join(extra.withColumnRenamed("gene", "gene_key"), "gene_key", "left").fillna(0)
    scores = [F.round(f"{c}_pattern_score", 6).alias(f"{c}_pattern_score") for c in C.PATTERNS]
    return full.select("id", "gene", "name_length", *scores, "sequence_length", "gc_content", "mean_expression", "degree_centrality", "assay")


@query("r6_batch_prediction", "SELECT id, gene, predicted_function, 'rule_based' AS method FROM {pred}", **CTES)
def _(fx):
    return C.predict(genes(fx)).select("id", "gene", "predicted_function", "method")


@query("a16_prediction_summary", """
SELECT predicted_function, count(*) AS n, any_value(t) AS total_genes, any_value(av) AS average_confidence, any_value(hi) AS high_confidence, any_value(un) AS unknown_function
FROM {pred}, (SELECT count(*) AS t, round(avg(confidence), 5) AS av, count(*) FILTER (WHERE confidence > 0.7) AS hi,
                     count(*) FILTER (WHERE predicted_function = 'unknown') AS un FROM {pred}) GROUP BY predicted_function""", **CTES)
def _(fx):
    return C.prediction_summary(C.predict(genes(fx))).withColumn("average_confidence", F.round("average_confidence", 5))
