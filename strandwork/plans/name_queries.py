"""Registered queries over gene names and synonyms."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import names
from .registry import query

REV = "SELECT lower(synonym) AS k, arg_max(name, ordinal) AS canonical FROM {synonyms} GROUP BY 1"


@query("j15_gene_coordinates", """
SELECT raw, row_no, coalesce(e.contig_id, l.contig_id, s.contig_id) AS contig_id, coalesce(e.g_start, l.g_start, s.g_start) AS g_start,
       coalesce(e.g_end, l.g_end, s.g_end) AS g_end, coalesce(e.strand, l.strand, s.strand) AS strand,
       CASE WHEN e.gene IS NOT NULL THEN 'exact' WHEN l.gene IS NOT NULL THEN 'case' WHEN s.gene IS NOT NULL THEN 'synonym' END AS match_kind
FROM {raw_names} r LEFT JOIN {genes} e ON e.gene = raw LEFT JOIN {genes} l ON lower(l.gene) = lower(raw)
LEFT JOIN {rev} v ON v.k = lower(raw) LEFT JOIN {genes} s ON lower(s.gene) = lower(v.canonical)""", rev=REV)
def _(fx):
    return names.gene_coordinates(fx.raw_names, fx.genes, fx.synonyms, "raw")


@query("j16_canonical_names", """
SELECT raw, row_no, CASE WHEN k.name IS NULL AND v.canonical IS NOT NULL THEN v.canonical ELSE raw END AS primary_name,
       k.name IS NULL AND v.canonical IS NOT NULL AS is_synonym
FROM {raw_names} LEFT JOIN {gene_ids} k ON k.name = raw LEFT JOIN {rev} v ON v.k = lower(raw)""", rev=REV)
def _(fx):
    return names.canonical_names(fx.raw_names, fx.gene_ids, fx.synonyms)


def _records(fx):
    return fx.orders.select(
        F.concat(F.lit("G"), "o_orderkey").alias("gene_name"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey") + 1).alias("gene_id"),
        F.array(F.concat(F.lit("Syn"), F.col("o_custkey")), F.concat(F.lit("alt"), "o_orderkey"), F.lit("")).alias("synonyms"),
        F.col("o_orderkey").alias("ordinal"))


ENTRIES = """
SELECT lower(concat('G', o_orderkey)) AS key, o_orderkey + 1 AS gene_id, concat('G', o_orderkey) AS canonical, o_orderkey + 1 AS name_id, o_orderkey * 10 AS step
FROM orders WHERE o_orderstatus <> 'P'
UNION ALL
SELECT lower(concat('Syn', o_custkey)), CASE WHEN o_orderstatus <> 'P' THEN o_orderkey + 1 END, concat('G', o_orderkey), NULL, o_orderkey * 10 + 1 FROM orders
UNION ALL
SELECT concat('alt', o_orderkey), CASE WHEN o_orderstatus <> 'P' THEN o_orderkey + 1 END, concat('G', o_orderkey), NULL, o_orderkey * 10 + 2 FROM orders"""
INDEX = """
SELECT key, arg_max_null(gene_id, step) AS gene_id, arg_max(canonical, step) AS canonical, arg_max(name_id, step) AS name_id FROM {ent} GROUP BY key"""


@query("a18_synonym_index", "SELECT * FROM {idx}", ent=ENTRIES, idx=INDEX)
def _(fx):
    return names.synonym_index(_records(fx))


@query("j17_resolve_ids", """
SELECT raw, row_no, CASE WHEN name_id IS NOT NULL THEN name_id ELSE gene_id END AS gene_id,
       CASE WHEN name_id IS NOT NULL THEN key ELSE canonical END AS canonical, CASE WHEN name_id IS NULL THEN key END AS matched_synonym
FROM {raw_names} LEFT JOIN {idx} ON key = lower(raw)""", ent=ENTRIES, idx=INDEX)
def _(fx):
    return names.resolve_ids(fx.raw_names, names.synonym_index(_records(fx)))


@query("j18_id_to_name", """
SELECT src, dst, a.name AS src_name, b.name AS dst_name, ordinal FROM {regulations} LEFT JOIN {gene_ids} a ON a.id = src LEFT JOIN {gene_ids} b ON b.id = dst""")
def _(fx):
    rows = names.with_names(fx.regulations.select("src", "dst", "ordinal"), fx.gene_ids, "src", "src_name")
    return names.with_names(rows, fx.gene_ids, "dst", "dst_name")


RECON = """
SELECT g.name AS gene, CASE WHEN d.k IS NOT NULL THEN 'direct' WHEN f.up IS NOT NULL THEN 'synonym' ELSE 'missing' END AS status,
       CASE WHEN d.k IS NULL THEN f.up END AS uploaded_gene
FROM {gene_ids} g LEFT JOIN {upl} d ON d.k = lower(g.name) LEFT JOIN (
  SELECT name, arg_min(up, ordinal) AS up FROM {synonyms} JOIN {upl} ON k = lower(synonym) GROUP BY name) f ON f.name = g.name"""
UPL = "SELECT lower(raw) AS k, min(raw) AS up FROM {raw_names} GROUP BY 1"


def _reconciled(fx):
    return names.reconcile(fx.gene_ids.select(F.col("name").alias("gene")), fx.raw_names.select(F.col("raw").alias("gene")), fx.synonyms)


@query("j19_reconciliation", "SELECT * FROM {rec}", upl=UPL, rec=RECON)
def _(fx):
    return _reconciled(fx)


@query("j19_reconciliation_counts", """
SELECT count(*) AS total_expected, count(*) FILTER (WHERE status = 'direct') AS found_direct,
       count(*) FILTER (WHERE status = 'synonym') AS found_via_synonyms, count(*) FILTER (WHERE status = 'missing') AS still_missing FROM {rec}""",
       upl=UPL, rec=RECON)
def _(fx):
    return names.reconcile_counts(_reconciled(fx))


MAPPING = """
SELECT c.gene AS cluster_gene, coalesce(p.gene, r.name, f.synonym) AS plot_gene,
       CASE WHEN p.gene IS NOT NULL THEN 'direct' WHEN r.name IS NOT NULL THEN 'reverse' WHEN f.synonym IS NOT NULL THEN 'forward' END AS kind
FROM {cluster_names} c LEFT JOIN {plot_genes} p ON p.gene = c.gene
LEFT JOIN (SELECT name, arg_min(synonym, ordinal) AS synonym FROM {synonyms} WHERE synonym IN (SELECT gene FROM {plot_genes}) GROUP BY name) f ON f.name = c.gene
LEFT JOIN (SELECT synonym, arg_min(name, ordinal) AS name FROM {synonyms} WHERE name IN (SELECT gene FROM {plot_genes}) GROUP BY synonym) r ON r.synonym = c.gene"""


def _mapping(fx):
    return names.map_name_sets(fx.cluster_names, fx.plot_genes, fx.synonyms)


@query("j20_name_set_mapping", "SELECT * FROM {map}", map=MAPPING)
def _(fx):
    return _mapping(fx)


@query("u5_unmapped_plot_genes", "SELECT gene FROM {plot_genes} EXCEPT SELECT plot_gene FROM {map}", map=MAPPING)
def _(fx):
    return names.unmapped_plot_genes(fx.plot_genes, _mapping(fx))


@query("u5_set_algebra", """
SELECT gene, 'both' AS side FROM (SELECT gene FROM {cluster_names} INTERSECT SELECT gene FROM {plot_genes})
UNION ALL SELECT gene, 'cluster only' FROM (SELECT gene FROM {cluster_names} EXCEPT SELECT gene FROM {plot_genes})
UNION ALL SELECT gene, 'plot only' FROM (SELECT gene FROM {plot_genes} EXCEPT SELECT gene FROM {cluster_names})""")
def _(fx):
    return names.compared_names(fx.cluster_names, fx.plot_genes, "cluster only", "plot only")


def _aliases(fx):
    return names.aliases(fx.alias_rows.select("name", F.array("s1", "s1").alias("synonyms"), "subtilist",
                                              F.col("browser").alias("expression_browser"), "ordinal"))


ALIAS = """
SELECT name, s1 AS synonym, ordinal * 1000 AS ordinal FROM {alias_rows}
UNION ALL SELECT name, subtilist, ordinal * 1000 + 1 FROM {alias_rows}
UNION ALL SELECT name, split_part(browser, '_', 1), ordinal * 1000 + 2 FROM {alias_rows} WHERE browser IS NOT NULL"""


@query("j21_aliases", "SELECT name, synonym, ordinal // 1000 AS ordinal, CAST(ordinal % 1000 AS INT) AS position FROM {ali}", ali=ALIAS)
def _(fx):
    return _aliases(fx).select("name", "synonym", F.col("ordinal.ordinal").alias("ordinal"), F.col("ordinal.i").alias("position"))


@query("j21_extended_mapping", """
SELECT c.gene AS cluster_gene, coalesce(p.gene, r.plot_gene, f.synonym) AS plot_gene,
       CASE WHEN p.gene IS NOT NULL THEN 'direct' WHEN r.plot_gene IS NOT NULL THEN 'reverse' WHEN f.synonym IS NOT NULL THEN 'forward' END AS kind
FROM {cluster_names} c LEFT JOIN {plot_genes} p ON p.gene = c.gene
LEFT JOIN {fwd} f ON f.name = c.gene
LEFT JOIN (SELECT cluster_gene, min(plot_gene) AS plot_gene FROM (
    SELECT a.name AS plot_gene, min(x.gene) AS cluster_gene FROM {ali} a JOIN {plot_genes} q ON q.gene = a.name
    JOIN {cluster_names} x ON x.gene = a.synonym AND x.gene NOT IN (SELECT gene FROM {plot_genes})
    WHERE a.name NOT IN (SELECT gene FROM {cluster_names}) AND a.name NOT IN (SELECT synonym FROM {fwd} WHERE name NOT IN (SELECT gene FROM {plot_genes}))
    GROUP BY a.name) GROUP BY cluster_gene) r ON r.cluster_gene = c.gene""", ali=ALIAS,
       fwd="""SELECT name, arg_min(synonym, ordinal) AS synonym FROM {ali} WHERE synonym IN (SELECT gene FROM {plot_genes})
  AND name IN (SELECT gene FROM {cluster_names}) GROUP BY name""")
def _(fx):
    return names.map_name_sets_once(fx.cluster_names, fx.plot_genes, _aliases(fx)).select("cluster_gene", "plot_gene", "kind")


@query("j22_alias_enhancement", """
SELECT m.cluster_gene, coalesce(plot_gene, a.up) AS plot_gene, CASE WHEN plot_gene IS NULL AND a.up IS NOT NULL THEN 'alias' ELSE kind END AS kind
FROM {map} m LEFT JOIN (SELECT lower(name) AS n, arg_min(up, ordinal) AS up FROM {ali} JOIN (
    SELECT lower(gene) AS k, min(gene) AS up FROM {plot_genes} GROUP BY 1) ON k = lower(synonym) GROUP BY 1) a ON a.n = lower(m.cluster_gene)""",
       map=MAPPING, ali=ALIAS)
def _(fx):
    return names.enhance_mapping(_mapping(fx), fx.plot_genes, _aliases(fx))


@query("a17_synonym_statistics", """
SELECT total_genes, genes_with_synonyms, total_synonym_entries, concat(printf('%.1f', genes_with_synonyms / total_genes * 100), '%') AS coverage
FROM (SELECT (SELECT count(DISTINCT name) FROM {gene_ids}) AS total_genes, (SELECT count(DISTINCT name) FROM {synonyms}) AS genes_with_synonyms,
             (SELECT count(DISTINCT lower(synonym)) FROM {synonyms}) AS total_synonym_entries)""")
def _(fx):
    return names.synonym_statistics(fx.gene_ids, fx.synonyms)


@query("a17_mapping_coverage", """
SELECT count(plot_gene) AS mapped, count(*) - count(plot_gene) AS unmapped, round(count(plot_gene) / count(*) * 100, 1) AS coverage FROM {map}""", map=MAPPING)
def _(fx):
    return names.mapping_coverage(_mapping(fx))
