"""Registered queries over gene sets, categories, pathways and metabolites."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import genesets as G
from ..operators import hierarchy, names
from .registry import query

CHOSEN = ["cat_1", "cat_2", "cat_3"]
SEL = "SELECT DISTINCT category, gene FROM {memberships} WHERE category IN ('cat_1', 'cat_2', 'cat_3')"


def chosen(fx):
    return G.select_categories(fx.memberships, CHOSEN)


@query("p8_gene_search", "SELECT name FROM {gene_ids} WHERE lower(name) LIKE '%77%'")
def _(fx):
    return G.matching_names(G.name_grams(fx.gene_ids), "77").select("name")


@query("p8_trigram_search", "SELECT id, name FROM {gene_ids} WHERE lower(name) LIKE '%g123%'")
def _(fx):
    return G.matching_names(G.name_grams(fx.gene_ids), "G123")


@query("w4_trigram_ranking", """
SELECT name, row_number() OVER (ORDER BY CASE WHEN lower(name) LIKE '123%' THEN 0 ELSE 1 END, length(name), lower(name), name) AS place
FROM (SELECT DISTINCT name FROM {gene_ids} WHERE lower(name) LIKE '%123%') QUALIFY place <= 50""")
def _(fx):
    ranked = G.search_postings(G.name_grams(fx.gene_ids), "123", 50)
    # The place in the sorted result, so that its order is compared too: at most 50 rows in one partition.
    return ranked.coalesce(1).select("name", (F.monotonically_increasing_id() + 1).alias("place"))


@query("w4_search_ranking", """
SELECT name FROM (SELECT DISTINCT name FROM {gene_ids} WHERE lower(name) LIKE '%g1%')
ORDER BY CASE WHEN lower(name) LIKE 'g1%' THEN 0 ELSE 1 END, length(name), lower(name), name LIMIT 50""")
def _(fx):
    return G.search_genes(fx.gene_ids, "G1", 50)


@query("w4_search_limit_first", """
SELECT name FROM (SELECT name FROM {gene_ids} WHERE lower(name) LIKE '%g1%' ORDER BY id LIMIT 50)""")
def _(fx):
    return G.search_genes(fx.gene_ids.withColumn("ordinal", F.col("id")), "g1", 50, limit_before_rank=True)


@query("a20_gene_sources", """
SELECT gene, string_agg(category, '; ' ORDER BY category) AS sources, count(*) AS source_count FROM {sel} GROUP BY gene""", sel=SEL)
def _(fx):
    return G.gene_sources(chosen(fx))


@query("a20_single_selection_known_only", """
SELECT category, gene FROM {sel} UNION SELECT 'individual', name FROM {gene_ids} WHERE name IN ('g1', 'g2', 'nosuch')""", sel=SEL)
def _(fx):
    return G.select_categories(fx.memberships, CHOSEN, ["g1", "g2", "nosuch"], fx.gene_ids)


@query("a20_multi_selection_keeps_unknown", """
SELECT category, gene FROM {sel} UNION SELECT 'individual', x FROM (VALUES ('g1'), ('g2'), ('nosuch')) t(x)""", sel=SEL)
def _(fx):
    return G.select_categories(fx.memberships, CHOSEN, ["g1", "g2", "nosuch"])


@query("s16_selection_export", "SELECT gene, string_agg(category, '; ' ORDER BY category) AS sources FROM (SELECT DISTINCT gene, category FROM {memberships}) GROUP BY gene")
def _(fx):
    return G.gene_sources(fx.memberships).select("gene", "sources")


@query("u2_all_category_intersection", "SELECT gene, count(*) AS source_count FROM {sel} GROUP BY gene HAVING count(*) = 3", sel=SEL)
def _(fx):
    return G.in_every_category(chosen(fx))


@query("u2_empty_bucket_empties_intersection", "SELECT gene, count(*) AS source_count FROM {sel} GROUP BY gene HAVING count(*) = 4", sel=SEL)
def _(fx):
    return G.in_every_category(chosen(fx), total=4)


@query("u3_categories_minus_intersection", "SELECT * FROM {sel} WHERE gene NOT IN (SELECT gene FROM {sel} GROUP BY gene HAVING count(*) = 3)", sel=SEL)
def _(fx):
    return G.outside_intersection(chosen(fx)).select("category", "gene")


@query("u4_any_overlap", "SELECT gene, count(*) AS occurrences FROM {sel} GROUP BY gene HAVING count(*) > 1", sel=SEL)
def _(fx):
    return G.in_several(chosen(fx))


@query("a21_duplicate_ids", "SELECT gene AS gene, count(*) AS occurrences FROM {expression} GROUP BY gene HAVING count(*) > 1")
def _(fx):
    return G.duplicate_ids(fx.expression, "gene")


@query("u6_tagged_union", """
SELECT DISTINCT * FROM (
  SELECT concat('group_', category_id) AS category, 'group' AS kind, gene FROM {category_genes}
  UNION ALL SELECT concat('regulation_', src), 'regulation', name FROM {regulations} JOIN {gene_ids} ON id = dst
  UNION ALL SELECT concat('pathway_', pathway_id), 'pathway', gene FROM {pathway_members}
  UNION ALL SELECT concat('complex_', complex_id), 'complex', gene FROM {complexes}
  UNION ALL SELECT concat('expression_cluster_', cluster), 'expression_cluster', gene FROM {clusters}
  UNION ALL SELECT concat('metabolite_', metabolite_id), 'metabolite', concat('g', protein_id) FROM {metabolite_links}
  UNION ALL SELECT 'individual', 'individual', name FROM {synonyms})""")
def _(fx):
    reg = fx.regulations.join(fx.gene_ids, F.col("id") == F.col("dst")).select(F.col("src").alias("id"), F.col("name").alias("gene"))
    parts = {
        "group": fx.category_genes.select(F.col("category_id").alias("id"), "gene"), "regulation": reg,
        "pathway": fx.pathway_members.select(F.col("pathway_id").alias("id"), "gene"),
        "complex": fx.complexes.select(F.col("complex_id").alias("id"), "gene"),
        "expression_cluster": fx.clusters.select(F.col("cluster").alias("id"), "gene"),
        "metabolite": fx.metabolite_links.select(F.col("metabolite_id").alias("id"), F.concat(F.lit("g"), "protein_id").alias("gene")),
    }
    return G.tagged_union(parts, fx.synonyms.select(F.col("name").alias("gene")))


@query("u1_union_of_passes", """
SELECT gene, 'clusters' AS part FROM {clusters} UNION ALL SELECT gene, 'categories' FROM {category_genes}""")
def _(fx):
    return G.union_passes({"clusters": fx.clusters.select("gene"), "categories": fx.category_genes.select("gene")})


@query("a1_regulator_groups", """
SELECT src, count(DISTINCT dst) AS targets, count(dst) AS regulation_count FROM {regulations} GROUP BY src""")
def _(fx):
    return G.regulator_groups(fx.regulations)


@query("a2_regulator_targets", "SELECT DISTINCT name AS gene FROM {regulations} JOIN {gene_ids} ON id = dst WHERE src = 7")
def _(fx):
    return G.regulator_targets(fx.regulations, fx.gene_ids, 7)


def regulons(fx):
    """One nested regulon per part: two single genes (one null), and an operon of two."""
    gene = lambda c: F.struct(F.struct(c.cast("bigint").alias("id")).alias("gene"))
    k, n = F.col("p_partkey"), F.col("p_size")
    member = lambda c: F.struct(c.cast("bigint").alias("id"))
    text = fx.regulon_text.withColumnRenamed("id", "p_partkey")
    return fx.part.join(text, "p_partkey").select(
        k.alias("id"), F.when(n % 2 == 0, F.col("p_name")).otherwise("").alias("regulator_display_name"),
        F.struct(F.when(n % 5 != 0, F.col("p_brand")).alias("name")).alias("regulator_gene"), "description",
        F.array(gene(k), gene(k + n), gene(F.lit(None))).alias("gene_regulations"),
        F.array(F.struct(F.struct(F.array(member(k + 1), member(k)).alias("genes")).alias("operon"))).alias("operon_regulations"))


MEMBERS = """
SELECT DISTINCT regulon_id, gene_id FROM (
  SELECT p_partkey AS regulon_id, unnest([p_partkey, p_partkey + p_size, p_partkey + 1]) AS gene_id FROM part)"""
FUNCTION = """
SELECT id, CASE WHEN description = '' THEN '' WHEN strpos(description, 'Function:') > 0
  THEN trim(split_part(substr(description, strpos(description, 'Function:') + 9), ';', 1)) ELSE trim(split_part(description, ';', 1)) END AS function
FROM {regulon_text}"""


@query("f14_function_text", "SELECT * FROM {fun}", fun=FUNCTION)
def _(fx):
    return fx.regulon_text.select("id", G.function_text("description").alias("function"))


@query("a3_regulon_members", "SELECT * FROM {mem}", mem=MEMBERS)
def _(fx):
    return G.regulon_members(regulons(fx))


@query("a3_regulon_table", """
SELECT p_partkey AS regulon_id, CASE WHEN p_size % 2 = 0 THEN p_name WHEN p_size % 5 <> 0 THEN p_brand ELSE concat('Regulon_', p_partkey) END AS name,
       function, n AS gene_count
FROM part JOIN {fun} f ON f.id = p_partkey JOIN (SELECT regulon_id, count(*) AS n FROM {mem} GROUP BY regulon_id) ON regulon_id = p_partkey""", fun=FUNCTION, mem=MEMBERS)
def _(fx):
    return G.regulon_table(regulons(fx))


@query("a4_sigma_counts", """
SELECT CASE WHEN sigma = '?' THEN 'Unknown' ELSE replace(sigma, ';', '/') END AS sigma, count(*) AS n
FROM (SELECT CASE WHEN sigma = 'Unknown' THEN '?' WHEN sigma = 'C' THEN 'E;F' ELSE sigma END AS sigma FROM {tss}) GROUP BY 1""")
def _(fx):
    raw = fx.tss.withColumn("sigma", F.when(F.col("sigma") == "Unknown", "?").when(F.col("sigma") == "C", "E;F").otherwise(F.col("sigma")))
    return G.sigma_counts(raw)


@query("a5_coordinate_index", """
SELECT contig_id, coord, strand, sigma, ordinal, row_number() OVER (PARTITION BY contig_id, coord ORDER BY ordinal) AS entry_no FROM {tss}""")
def _(fx):
    return G.coordinate_index(fx.tss)


@query("a7_cluster_sizes", "SELECT cluster, count(DISTINCT gene) AS gene_count, substr(cluster, 1, 1) AS branch FROM {clusters} GROUP BY cluster")
def _(fx):
    return G.cluster_sizes(fx.clusters)


@query("a7_cluster_inversion", "SELECT DISTINCT substr(cluster, 1, 1) AS branch, cluster, gene FROM {clusters}")
def _(fx):
    return G.cluster_members(fx.clusters)


@query("a8_pathway_list", """
SELECT p.pathway_id, p.name, count(DISTINCT gene) AS gene_count FROM {pathways} p JOIN {pathway_members} m ON m.pathway_id = p.pathway_id GROUP BY ALL""")
def _(fx):
    return G.set_sizes(fx.pathways, fx.pathway_members, "pathway_id")


@query("a8_pathway_genes_for_ids", "SELECT DISTINCT pathway_id, gene FROM {pathway_members} WHERE pathway_id IN ('Brand#11', 'Brand#12')")
def _(fx):
    return G.set_members(fx.pathway_members, "pathway_id", ["Brand#11", "Brand#12"])


CX = """
SELECT DISTINCT name, gene FROM (SELECT name, unnest(regexp_extract_all(CASE WHEN value LIKE 'g%' THEN concat('"', value, '"') ELSE
  replace(replace(value, '"genes":', ''), '"members":', '') END, '"([^"]*)"', 1)) AS gene FROM {raw_complexes} WHERE value IS NOT NULL)"""


@query("a9_complex_members", "SELECT * FROM {cx}", cx=CX)
def _(fx):
    return G.complex_members(fx.raw_complexes)


@query("a9_complex_list", "SELECT name, count(cx.gene) AS gene_count FROM {raw_complexes} r LEFT JOIN {cx} cx USING (name) GROUP BY name", cx=CX)
def _(fx):
    per = G.complex_members(fx.raw_complexes).groupBy("name").agg(F.count(F.lit(1)).alias("gene_count"))
    return fx.raw_complexes.select("name").join(per, "name", "left").fillna(0)


@query("a10_complexes_from_interactions", """
SELECT DISTINCT concat('Complex: ', key) AS complex, gene FROM (
  SELECT interaction_id, string_agg(gene, ' & ' ORDER BY gene) AS key, count(*) AS n FROM {mem} GROUP BY interaction_id) k
JOIN {mem} m ON m.interaction_id = k.interaction_id WHERE n >= 2""",
       mem="SELECT DISTINCT interaction_id, name AS gene FROM {interactions} JOIN {molecules} ON id = molecule_id WHERE type = 'Protein'")
def _(fx):
    found = G.complexes_from_interactions(fx.interactions, fx.molecules)
    return found.join(G.complex_labels(found), "complex").select(F.col("label").alias("complex"), "gene")


RAW_MOLECULES = """
SELECT id, type, CASE WHEN id % 4 = 0 THEN concat('gn', id) ELSE '' END AS gene_name, CASE WHEN id % 4 = 1 THEN name END AS name,
       CASE WHEN id % 4 = 2 THEN concat('st', id) END AS inner_name FROM {molecules}"""
PROTEINS = "SELECT m.id AS protein_id, gene_id, concat('pr', m.id) AS name FROM {molecules} m LEFT JOIN {protein_genes} p ON p.protein_id = m.id"


@query("a10_name_fallback", """
SELECT DISTINCT concat('Complex: ', key) AS complex, gene FROM (
  SELECT interaction_id, string_agg(gene, ' & ' ORDER BY gene) AS key, count(*) AS n FROM {mem} GROUP BY interaction_id) k
JOIN {mem} m ON m.interaction_id = k.interaction_id WHERE n >= 2""", raw=RAW_MOLECULES, prot=PROTEINS,
       mem="""SELECT DISTINCT interaction_id, coalesce(nullif(gene_name, ''), r.name, inner_name, g.name, p.name) AS gene
FROM {interactions} JOIN {raw} r ON r.id = molecule_id JOIN {prot} p ON p.protein_id = r.id LEFT JOIN {gene_ids} g ON g.id = p.gene_id WHERE type = 'Protein'""")
def _(fx):
    raw = fx.sql(RAW_MOLECULES).withColumn("gene", F.struct(F.col("inner_name").alias("name"))).drop("inner_name")
    found = G.complexes_from_interactions(fx.interactions, raw, G.protein_names(fx.sql(PROTEINS), fx.gene_ids))
    return found.join(G.complex_labels(found), "complex").select(F.col("label").alias("complex"), "gene")


@query("j27_pathway_genes", "SELECT DISTINCT pathway_id, gene FROM {pathway_members}")
def _(fx):
    return G.pathway_genes(fx.pathway_members, fx.clusters.select(F.col("cluster").alias("pathway_id"), "gene"))


@query("j27_pathway_fallback", "SELECT DISTINCT cluster AS pathway_id, gene FROM {clusters}")
def _(fx):
    none = fx.pathway_members.where("via = 'no such kind'")
    return G.pathway_genes(none, fx.clusters.select(F.col("cluster").alias("pathway_id"), "gene"))


@query("j28_clusters_on_plot", """
SELECT DISTINCT cluster, coalesce(m.plot_gene, c.gene) AS gene FROM {clusters} c LEFT JOIN {map} m ON m.cluster_gene = c.gene
WHERE coalesce(m.plot_gene, c.gene) IN (SELECT gene FROM {plot_genes})""",
       map="SELECT name AS cluster_gene, synonym AS plot_gene FROM {synonyms}")
def _(fx):
    mapping = fx.synonyms.select(F.col("name").alias("cluster_gene"), F.col("synonym").alias("plot_gene"))
    return G.map_to_plot(fx.clusters, mapping, fx.plot_genes)


LINKS = """
SELECT i.name AS gene, metabolite_id, metabolite_name, type, CASE WHEN type = 'Transport' THEN transport_type END AS transport_type
FROM {metabolite_links} l LEFT JOIN {protein_genes} p ON p.protein_id = l.protein_id JOIN {gene_ids} i ON i.id = coalesce(l.gene_id, p.gene_id)"""


def entries(fx):
    return G.gene_metabolites(fx.metabolite_links, fx.gene_ids, fx.protein_genes)


@query("j29_gene_metabolites", "SELECT * FROM {ent}", ent=LINKS)
def _(fx):
    return entries(fx)


TYPES = ["Cofactor", "Transport:Import"]
TYPED = "(type IN ('Cofactor') OR (type = 'Transport' AND transport_type = 'Import'))"


@query("p10_interaction_types", f"SELECT * FROM {{ent}} WHERE {TYPED}", ent=LINKS)
def _(fx):
    return entries(fx).where(G.interaction_type_in(TYPES))


@query("a23_metabolites_by_category", """
SELECT DISTINCT c.category_id, c.metabolite_id, coalesce(n.name, concat('Metabolite ', c.metabolite_id)) AS name
FROM {metabolite_categories} c LEFT JOIN (SELECT metabolite_id, max(metabolite_name) AS name FROM {ent} GROUP BY 1) n ON n.metabolite_id = c.metabolite_id""", ent=LINKS)
def _(fx):
    return G.metabolites_by_category(fx.metabolite_categories, entries(fx))


@query("a24_metabolite_buckets", f"""
SELECT DISTINCT concat('metabolite_', metabolite_id) AS bucket, gene FROM {{ent}} WHERE {TYPED} AND (metabolite_id IN (3, 4)
  OR metabolite_id IN (SELECT metabolite_id FROM {{metabolite_categories}} WHERE category_id IN (2, 1001)))
UNION ALL
SELECT DISTINCT concat('metabolite_category_', category_id), gene FROM {{ent}} e JOIN {{metabolite_categories}} c ON c.metabolite_id = e.metabolite_id
WHERE category_id IN (2, 1001) AND {TYPED}""", ent=LINKS)
def _(fx):
    return G.metabolite_buckets(entries(fx), fx.metabolite_categories, [3, 4], [2, 1001], TYPES)


@query("f11_dot_notation", """
SELECT id, dot, len(string_split(dot, '.')) AS level,
  array_to_string(list_transform(string_split(dot, '.'), lambda x: lpad(x, 8, '0')), '.') AS sort_key FROM {categories}""")
def _(fx):
    key = F.array_join(F.transform(G.dot_key(), lambda x: F.lpad(x.cast("string"), 8, "0")), ".")
    return fx.categories.select("id", "dot", G.dot_level().alias("level"), key.alias("sort_key"))


EFF = """
SELECT DISTINCT category_id, gene FROM {category_genes}
UNION
SELECT n.id, g.gene FROM {categories} n JOIN {categories} c ON c.parent_id = n.id JOIN {category_genes} g ON g.category_id = c.id
WHERE n.id BETWEEN 100 AND 999 AND n.id NOT IN (SELECT category_id FROM {category_genes})
UNION
SELECT r.id, g.gene FROM {categories} r JOIN {categories} n ON n.parent_id = r.id JOIN {category_genes} g ON g.category_id = n.id
WHERE r.parent_id IS NULL
UNION
SELECT r.id, g.gene FROM {categories} r JOIN {categories} n ON n.parent_id = r.id JOIN {categories} c ON c.parent_id = n.id
JOIN {category_genes} g ON g.category_id = c.id
WHERE r.parent_id IS NULL AND n.id NOT IN (SELECT category_id FROM {category_genes})"""
TREE = """
SELECT c.id, c.parent_id, c.dot, c.name, len(string_split(c.dot, '.')) AS level, coalesce(n, 0) AS gene_count,
       c.id IN (SELECT parent_id FROM {categories} WHERE parent_id IS NOT NULL) AS has_children
FROM {categories} c LEFT JOIN (SELECT category_id, count(*) AS n FROM {eff} GROUP BY 1) x ON x.category_id = c.id"""


def tree(fx):
    return G.hierarchy_rows(fx.categories, G.category_genes(fx.categories, fx.category_genes))


@query("g12_category_genes", "SELECT * FROM {eff}", eff=EFF)
def _(fx):
    return G.category_genes(fx.categories, fx.category_genes)


@query("g13_hierarchy_tree", "SELECT * FROM {tree}", eff=EFF, tree=TREE)
def _(fx):
    return G.in_tree_order(tree(fx))


@query("g13_w8_children", "SELECT * FROM {tree} WHERE parent_id = 101", eff=EFF, tree=TREE)
def _(fx):
    return G.children_of(tree(fx), 101)


@query("w5_main_groups", "SELECT * FROM {tree} WHERE level <= 2 AND gene_count >= 10 ORDER BY gene_count DESC, id LIMIT 20", eff=EFF, tree=TREE)
def _(fx):
    return G.main_groups(tree(fx))


@query("g14_root_paths", """
SELECT c.id, len(string_split(a.dot, '.')) AS step, a.dot, a.name FROM {categories} c JOIN {categories} a ON c.dot = a.dot OR starts_with(c.dot, concat(a.dot, '.'))""")
def _(fx):
    return G.root_paths(fx.categories)


@query("g14_parent_chains", """
WITH RECURSIVE up(id, ancestor, d) AS (
  SELECT id, id, 0 FROM {categories} UNION ALL SELECT up.id, parent_id, d + 1 FROM up JOIN {categories} c ON c.id = up.ancestor WHERE parent_id IS NOT NULL)
SELECT up.id, max(d) OVER (PARTITION BY up.id) - d + 1 AS step, ancestor, name FROM up JOIN {categories} c ON c.id = up.ancestor""")
def _(fx):
    return hierarchy.root_paths_by_parent(fx.categories)


DEEP = "SELECT o_orderkey AS id, o_orderkey - 1 - o_orderkey % 97 AS parent_id, concat('n', o_orderkey) AS name FROM {orders}"


@query("g14_deep_roots", """
WITH RECURSIVE up(id, ancestor, d) AS (
  SELECT id, id, 1 FROM {deep} UNION ALL SELECT up.id, c.parent_id, d + 1 FROM up JOIN {deep} c ON c.id = up.ancestor JOIN {deep} p ON p.id = c.parent_id)
SELECT id, arg_max(ancestor, d) AS root, max(d) AS depth FROM up GROUP BY id""", deep=DEEP)
def _(fx):
    return hierarchy.roots(fx.sql(DEEP))


@query("a22_gene_categories", """
SELECT gene, id, name, dot, len(string_split(dot, '.')) AS level, row_number() OVER (PARTITION BY gene ORDER BY len(string_split(dot, '.')), name, id) AS position
FROM (SELECT DISTINCT category_id, gene FROM {category_genes}) JOIN {categories} ON id = category_id""")
def _(fx):
    return G.gene_categories(fx.category_genes, fx.categories)
