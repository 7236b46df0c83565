"""Registered queries over expression tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import plotting as P
from ..operators import expression as X
from ..operators import filters, genesets, names, scan
from ..session import cut
from .registry import query
from .sequence_queries import contig_lengths

POINTS = "SELECT gene, log2fc AS x, p, row_no FROM {expression} WHERE p > 0"
CHOSEN = ["cat_1", "cat_2", "cat_3"]
IN_CHOSEN = "category IN ('cat_1', 'cat_2', 'cat_3')"
UPLOAD = """
SELECT trim(gene_text) AS gene, TRY_CAST(fc_text AS DOUBLE) AS log2fc, CASE WHEN p_text <> 'NA' THEN TRY_CAST(p_text AS DOUBLE) END AS p, row_no
FROM {upload} WHERE trim(gene_text) <> '' AND fc_text <> 'abc' AND p_text <> 'low'"""
RESOLVED = """
SELECT u.gene, log2fc, row_no, CASE WHEN k.name IS NULL AND s.name IS NOT NULL THEN s.name ELSE u.gene END AS primary_name, i.id AS gene_id
FROM {up} u LEFT JOIN {gene_ids} k ON k.name = u.gene LEFT JOIN {synonyms} s ON lower(s.synonym) = lower(u.gene)
LEFT JOIN {gene_ids} i ON i.name = CASE WHEN k.name IS NULL AND s.name IS NOT NULL THEN s.name ELSE u.gene END"""


def points(fx):
    return X.clean_volcano(fx.expression, "gene", "log2fc", "p")


def lower_points(fx):
    """Points under lower-case names, so that they meet the membership tables."""
    return points(fx).withColumn("gene", F.lower("gene"))


LOWER = "SELECT lower(gene) AS gene, x, p, row_no FROM {pts}"


def chosen(fx):
    return genesets.select_categories(fx.memberships, CHOSEN)


@query("p6_volcano_cleaning", "SELECT * FROM {pts}", pts=POINTS)
def _(fx):
    return points(fx)


@query("p7_upload_cleaning", "SELECT * FROM {up}", up=UPLOAD)
def _(fx):
    return X.clean_upload(fx.upload, "gene_text", "fc_text", "p_text")


@query("f9_plot_points", "SELECT gene, x, p, row_no, round(-log10(p), 6) AS y, round(-log10(0.01), 6) AS t, 2.0::DOUBLE AS fc_thresh FROM {pts}", pts=POINTS)
def _(fx):
    pts = X.plot_points(fx.expression, "gene", "log2fc", "p", "run", 0.01, 2.0)
    return pts.select("gene", "x", "p", "row_no", F.round("y", 6).alias("y"), F.round("p_thresh_log", 6).alias("t"), "fc_thresh")


@query("f10_threshold_hits", "SELECT gene, x, row_no FROM {pts} WHERE abs(x) >= 1.0 AND -log10(p) >= 1.3", pts=POINTS)
def _(fx):
    return points(fx).where(P.passes_threshold("x", P.neg_log10("p"))).select("gene", "x", "row_no")


@query("f17_diverging_scale", """
SELECT gene, value, concat('rgb(', CAST(floor(247 + abs(t) * (CASE WHEN t < 0 THEN 33 ELSE 178 END - 247) + 0.5) AS INT), ', ',
  CAST(floor(247 + abs(t) * (CASE WHEN t < 0 THEN 102 ELSE 24 END - 247) + 0.5) AS INT), ', ',
  CAST(floor(247 + abs(t) * (CASE WHEN t < 0 THEN 172 ELSE 43 END - 247) + 0.5) AS INT), ')') AS colour
FROM (SELECT gene, value, value / (SELECT max(abs(value)) FROM {gene_values}) AS t FROM {gene_values})""")
def _(fx):
    return P.diverging_colour(fx.gene_values.select("gene", "value"), "value")


@query("f18_track_opacity", """
SELECT gene, value, round(least(0.8, abs(value) / 5), 6) AS opacity, CASE WHEN value > 0 THEN 'up' ELSE 'down' END AS direction FROM {gene_values}""")
def _(fx):
    return fx.gene_values.select("gene", "value", F.round(P.track_opacity("value"), 6).alias("opacity"),
                                 P.regulation_class("value").alias("direction"))


@query("f20_category_kind", """
SELECT k AS key, CASE WHEN k LIKE 'individual%' THEN 'individual' WHEN split_part(k, '_', 1) IN ('group', 'regulation', 'regulon', 'reaction', 'material', 'pathway')
       THEN split_part(k, '_', 1) ELSE 'unknown' END AS kind
FROM (SELECT concat(CASE p_size % 4 WHEN 0 THEN 'group_' WHEN 1 THEN 'regulon_' WHEN 2 THEN 'individual' ELSE 'complex_' END, p_partkey) AS k FROM part)""")
def _(fx):
    keys = fx.sql("""SELECT concat(CASE p_size % 4 WHEN 0 THEN 'group_' WHEN 1 THEN 'regulon_' WHEN 2 THEN 'individual' ELSE 'complex_' END, p_partkey) AS key
                     FROM {part}""")
    return keys.select("key", P.category_kind("key").alias("kind"))


@query("f21_dataset_projection", """
SELECT 'fold' AS dataset, gene, log2fc FROM {expression} UNION ALL SELECT 'track', gene, value FROM {gene_values}""")
def _(fx):
    return X.dataset_projection({"fold": (fx.expression, "gene", "log2fc"), "track": (fx.gene_values, "gene", "value")})


def resolved_upload(fx):
    cleaned = X.clean_upload(fx.upload, "gene_text", "fc_text", "p_text")
    return names.resolve_upload(cleaned, fx.gene_ids, fx.synonyms)


@query("j23_upload_resolution", "SELECT gene, row_no, primary_name, gene_id FROM {res}", up=UPLOAD, res=RESOLVED)
def _(fx):
    return resolved_upload(fx).select("gene", "row_no", "primary_name", "gene_id")


@query("j23_not_found", "SELECT DISTINCT gene FROM {res} WHERE gene_id IS NULL", up=UPLOAD, res=RESOLVED)
def _(fx):
    return names.not_found(resolved_upload(fx))


@query("a19_gene_value_map", "SELECT primary_name, arg_max(log2fc, row_no) AS log2fc FROM {res} WHERE log2fc IS NOT NULL GROUP BY primary_name", up=UPLOAD, res=RESOLVED)
def _(fx):
    return X.last_values(resolved_upload(fx))


COLOURED = f"""
SELECT p.gene, x, row_no, CASE WHEN n IS NULL THEN 'background' WHEN n = 3 THEN 'Intersection' ELSE first END AS trace
FROM {{low}} p LEFT JOIN (SELECT gene, count(DISTINCT category) AS n, min(category) AS first FROM {{memberships}} WHERE {IN_CHOSEN} GROUP BY gene) m ON m.gene = p.gene"""


@query("j24_point_colouring", "SELECT * FROM {col}", pts=POINTS, low=LOWER, col=COLOURED)
def _(fx):
    return X.colour_points(lower_points(fx), chosen(fx)).select("gene", "x", "row_no", "trace")


@query("j30_highlighted_points", "SELECT gene, arg_max(x, row_no) AS x, max(row_no) AS row_no, arg_max(trace, row_no) AS trace FROM {col} WHERE trace <> 'background' GROUP BY gene",
       pts=POINTS, low=LOWER, col=COLOURED)
def _(fx):
    return X.highlighted(X.colour_points(lower_points(fx), chosen(fx)).select("gene", "x", "row_no", "trace"))


@query("j25_pathway_colouring", """
SELECT p.gene, x, row_no, CASE WHEN n IS NULL THEN 'background' WHEN n = 1 THEN a ELSE 'multi' END AS trace
FROM {low} p LEFT JOIN (SELECT gene, count(DISTINCT pathway_id) AS n, min(pathway_id) AS a FROM {pathway_members}
  WHERE pathway_id IN ('Brand#11', 'Brand#12', 'Brand#21', 'Brand#22') GROUP BY gene) m ON m.gene = p.gene""", pts=POINTS, low=LOWER)
def _(fx):
    return X.colour_by_pathway(lower_points(fx), fx.pathway_members, ["Brand#11", "Brand#12", "Brand#21", "Brand#22"]).select(
        "gene", "x", "row_no", "trace")


@query("j26_complex_overlay", "SELECT * FROM {pts} WHERE lower(gene) IN (SELECT lower(gene) FROM {memberships} WHERE category = 'cat_4')", pts=POINTS)
def _(fx):
    return X.overlay_points(points(fx), fx.memberships.where("category = 'cat_4'"))


@query("j26_neighbourhood_overlay", """
SELECT p.gene, row_no, layer FROM {pts} p LEFT JOIN (
  SELECT lower(gene) AS k, min(CAST(substr(category, 5) AS INT)) AS layer FROM {memberships} WHERE category IN ('cat_0', 'cat_1', 'cat_2') GROUP BY 1) l
ON l.k = lower(p.gene)""", pts=POINTS)
def _(fx):
    layers = fx.memberships.where("category IN ('cat_0', 'cat_1', 'cat_2')").select("gene", F.substring("category", 5, 2).cast("int").alias("layer"))
    return X.colour_by_layer(points(fx), layers).select("gene", "row_no", "layer")


BASES = """
SELECT contig_id, dataset, pos, arg_max(value, ordinal) AS v FROM (
  SELECT v.contig_id, dataset, value, ordinal, unnest(range(g_start, least(g_end, n) + 1)) AS pos
  FROM {vals} v JOIN (SELECT contig_id, length(seq) AS n FROM {contigs}) c ON c.contig_id = v.contig_id) GROUP BY contig_id, dataset, pos"""
BINS = """
SELECT contig_id, b AS bin_no, 1 + b * 100 AS bin_start, least(b * 100 + 100, n) AS bin_end
FROM (SELECT contig_id, n, unnest(range(0, (n + 99) // 100)) AS b FROM (SELECT contig_id, length(seq) AS n FROM {contigs}))"""


def _bins(fx):
    # Used twice, and a length costs the cleaning of a whole document.
    return scan.genome_bins(cut(contig_lengths(fx)), 100)


@query("a11_bin_means", """
SELECT b.*, round(coalesce(m.mean, 0), 6) AS mean FROM {bins} b LEFT JOIN (
  SELECT contig_id, (pos - 1) // 100 AS bin_no, avg(v) AS mean FROM {base} WHERE v <> 0 GROUP BY 1, 2) m
ON m.contig_id = b.contig_id AND m.bin_no = b.bin_no""", bins=BINS, base=BASES,
       vals="SELECT contig_id, 'all' AS dataset, g_start, g_end, value, ordinal FROM {gene_values}")
def _(fx):
    return X.bin_means(fx.gene_values, _bins(fx), 100).withColumn("mean", F.round("mean", 6))


@query("a12_gene_bins", """
SELECT contig_id, gene, unnest(range((g_start - 1) // 100, (g_end - 1) // 100 + 1)) AS bin_no FROM {genes}""")
def _(fx):
    return X.gene_bins(fx.genes, 100)


@query("a13_comparative_matrix", """
SELECT b.*, round(coalesce(max(mean) FILTER (WHERE dataset = 'A'), 0), 6) AS "A", round(coalesce(max(mean) FILTER (WHERE dataset = 'N'), 0), 6) AS "N",
       round(coalesce(max(mean) FILTER (WHERE dataset = 'R'), 0), 6) AS "R"
FROM {bins} b LEFT JOIN (SELECT contig_id, dataset, (pos - 1) // 100 AS bin_no, avg(v) AS mean FROM {base} WHERE v <> 0 GROUP BY 1, 2, 3) m
ON m.contig_id = b.contig_id AND m.bin_no = b.bin_no GROUP BY ALL""", bins=BINS, base=BASES,
       vals="SELECT contig_id, dataset, g_start, g_end, value, ordinal FROM {gene_values}")
def _(fx):
    wide = X.comparative_bins(fx.gene_values, _bins(fx), 100, ["A", "N", "R"])
    return wide.withColumns({c: F.round(c, 6) for c in ("A", "N", "R")})


@query("a14_track_statistics", """
SELECT count(*) AS rows, count(*) FILTER (WHERE raw NOT LIKE 'zz%' AND (lower(raw) NOT LIKE 'syn%' OR s.name IS NOT NULL)) AS with_coordinates,
       count(s.name) AS via_synonym, count(*) FILTER (WHERE raw NOT LIKE 'zz%' AND (lower(raw) NOT LIKE 'syn%' OR s.name IS NOT NULL)) AS valid_values
FROM {raw_names} r LEFT JOIN {synonyms} s ON lower(s.synonym) = lower(raw)""")
def _(fx):
    rows = fx.raw_names.withColumn("log2fc", F.lit(1.0))
    return X.track_statistics(names.gene_coordinates(rows, fx.genes, fx.synonyms, "raw"))


@query("a15_start_signal", """
SELECT * FROM (SELECT contig_id, g_start AS position, arg_max(value, ordinal) AS value FROM {gene_values} GROUP BY contig_id, g_start) WHERE value <> 0""")
def _(fx):
    return X.start_signal(fx.gene_values)


@query("w9_direction_split", """
SELECT contig_id, gene, g_start, value, ordinal, CASE WHEN value > 0 THEN 'up' ELSE 'down' END AS direction FROM {gene_values} WHERE value <> 0""")
def _(fx):
    return X.by_direction(fx.gene_values.select("contig_id", "gene", "g_start", "value", "ordinal"), "value")


@query("w9_label_thinning", """
SELECT contig_id, gene, g_start, no FROM (SELECT *, row_number() OVER (PARTITION BY contig_id ORDER BY g_start, ordinal) AS no FROM {genes}) WHERE (no - 1) % 10 = 0""")
def _(fx):
    rows = filters.numbered(fx.genes, ["contig_id"], ["g_start", "ordinal"], "match_no", 256)
    return filters.every_nth(rows).select("contig_id", "gene", "g_start", F.col("match_no").alias("no"))
