"""Gene-name resolution: synonyms, reconciliation and name-set mappings.

`synonyms` tables hold (name, synonym, ordinal). Lookups are equi-joins on lower-case
keys; the lookup side is reduced to one row per key first, so that a join never multiplies
the rows it resolves.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reverse_index(synonyms: DataFrame) -> DataFrame:
    """(key, canonical) from lower-case synonym to name; the last entry of a synonym wins."""
    return synonyms.groupBy(F.lower("synonym").alias("key")).agg(F.max_by("name", "ordinal").alias("canonical"))


# J16
def canonical_names(rows: DataFrame, primaries: DataFrame, synonyms: DataFrame, name: str = "raw") -> DataFrame:
    """Adds primary_name and is_synonym: known primaries stay, else the reverse synonym, else unchanged."""
    known = primaries.select(F.col("name").alias("_known")).distinct()
    rev = reverse_index(synonyms).withColumnRenamed("key", "_key")
    out = rows.join(known, F.col(name) == F.col("_known"), "left").join(rev, F.lower(name) == F.col("_key"), "left")
    by_synonym = F.col("_known").isNull() & F.col("canonical").isNotNull()
    return out.withColumn("primary_name", F.when(by_synonym, F.col("canonical")).otherwise(F.col(name))).withColumn(
        "is_synonym", by_synonym).drop("_known", "_key", "canonical")


# A18
def synonym_index(records: DataFrame) -> DataFrame:
    """(key, gene_id, canonical, is_name) from records (gene_name, gene_id, synonyms, ordinal).

    Keys are lower case. A later record overwrites an earlier one, and within a record the
    synonyms come after the name. Names without an id are not indexed as names.
    """
    named = records.where(F.col("gene_name").isNotNull() & F.col("gene_id").isNotNull()).select(
        F.lower("gene_name").alias("key"), "gene_id", F.col("gene_name").alias("canonical"), F.lit(True).alias("is_name"),
        "ordinal", F.lit(0).alias("step"))
    alias = records.select("gene_name", "gene_id", "ordinal", F.posexplode("synonyms").alias("i", "s")).where(
        F.coalesce(F.col("s"), F.lit("")) != "").select(
        F.lower("s").alias("key"), "gene_id", F.col("gene_name").alias("canonical"), F.lit(False).alias("is_name"),
        "ordinal", (F.col("i") + 1).alias("step"))
    both = named.unionByName(alias)
    latest = F.struct("ordinal", "step")
    return both.groupBy("key").agg(
        F.max_by("gene_id", latest).alias("gene_id"), F.max_by("canonical", latest).alias("canonical"),
        F.max_by(F.when(F.col("is_name"), F.col("gene_id")), F.when(F.col("is_name"), latest)).alias("name_id"))


# J17
def resolve_ids(rows: DataFrame, index: DataFrame, name: str = "raw") -> DataFrame:
    """Adds gene_id, canonical and matched_synonym from a synonym index; a name beats a synonym."""
    hit = index.select(F.col("key").alias("_key"), F.col("gene_id").alias("_sid"), "canonical", "name_id")
    out = rows.join(hit, F.lower(name) == F.col("_key"), "left")
    is_name = F.col("name_id").isNotNull()
    return out.select(
        *rows.columns, F.when(is_name, F.col("name_id")).otherwise(F.col("_sid")).alias("gene_id"),
        F.when(is_name, F.col("_key")).otherwise(F.col("canonical")).alias("canonical"),
        F.when(~is_name, F.col("_key")).alias("matched_synonym"))


# J18
def with_names(rows: DataFrame, gene_ids: DataFrame, id_col: str, out: str) -> DataFrame:
    """Name of an id column by lookup in (id, name)."""
    look = gene_ids.select(F.col("id").alias("_id"), F.col("name").alias(out))
    return rows.join(look, F.col(id_col) == F.col("_id"), "left").drop("_id")


# J15
def gene_coordinates(rows: DataFrame, genes: DataFrame, synonyms: DataFrame, name: str = "gene") -> DataFrame:
    """Coordinates of a gene name: exact, then ignoring case, then through a synonym.

    Adds contig_id, g_start, g_end, strand and match_kind (exact / case / synonym / null).
    Among equal lower-case names the first loaded counts.
    """
    place = ["contig_id", "g_start", "g_end", "strand"]
    spot = F.min_by(F.struct(*place), "ordinal")
    exact = genes.groupBy(F.col("gene").alias("_ek")).agg(spot.alias("_e"))
    loose = genes.groupBy(F.lower("gene").alias("_lk")).agg(spot.alias("_l"))
    rev = reverse_index(synonyms).select(F.col("key").alias("_sk"), F.lower("canonical").alias("_sc"))
    by_syn = rev.join(loose.select(F.col("_lk").alias("_sc"), F.col("_l").alias("_s")), "_sc").select("_sk", "_s")
    out = (
        rows.join(exact, F.col(name) == F.col("_ek"), "left")
        .join(loose, F.lower(name) == F.col("_lk"), "left")
        .join(by_syn, F.lower(name) == F.col("_sk"), "left")
    )
    at = F.coalesce("_e", "_l", "_s")
    kind = F.when(F.col("_e").isNotNull(), "exact").when(F.col("_l").isNotNull(), "case").when(F.col("_s").isNotNull(), "synonym")
    return out.select(*rows.columns, *[at[c].alias(c) for c in place], kind.alias("match_kind"))


# J19
def reconcile(expected: DataFrame, uploaded: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(gene, status, uploaded_gene) of each expected gene: direct, synonym or missing.

    A missing gene is looked up by its own synonyms first, in their order, then through the
    reverse index of the uploaded names.
    """
    up = uploaded.groupBy(F.lower("gene").alias("_k")).agg(F.min("gene").alias("_up"))
    want = expected.select("gene").distinct()
    direct = want.join(up.select("_k"), F.lower("gene") == F.col("_k"), "left").withColumn("_direct", F.col("_k").isNotNull()).drop("_k")
    forward = synonyms.join(up, F.lower("synonym") == F.col("_k")).groupBy(F.col("name").alias("_fn")).agg(
        F.min_by("_up", "ordinal").alias("_fwd"))
    backward = reverse_index(synonyms).join(up, F.col("key") == F.col("_k")).groupBy(F.col("canonical").alias("_bn")).agg(
        F.min("_up").alias("_bwd"))
    out = direct.join(forward, F.col("gene") == F.col("_fn"), "left").join(backward, F.col("gene") == F.col("_bn"), "left")
    via = F.when(~F.col("_direct"), F.coalesce("_fwd", "_bwd"))
    return out.select(
        "gene", F.when(F.col("_direct"), "direct").when(via.isNotNull(), "synonym").otherwise("missing").alias("status"),
        via.alias("uploaded_gene"))


def reconcile_counts(reconciled: DataFrame) -> DataFrame:
    return reconciled.agg(
        F.count(F.lit(1)).alias("total_expected"), *[
            F.count_if(F.col("status") == s).alias(n)
            for s, n in (("direct", "found_direct"), ("synonym", "found_via_synonyms"), ("missing", "still_missing"))])


# J20
def map_name_sets(clusters: DataFrame, plots: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(cluster_gene, plot_gene, kind): direct, forward synonym, or reverse synonym, which overrides forward.

    Forward: the cluster gene's first synonym (in order) that is a plot gene. Reverse: the first
    plot gene, in synonym-table order, that lists the cluster gene as a synonym. Cluster genes
    without any have a null plot gene.
    """
    c = clusters.select(F.col("gene").alias("cluster_gene")).distinct()
    p = plots.select(F.col("gene").alias("_p")).distinct()
    fwd = synonyms.join(p, F.col("synonym") == F.col("_p")).groupBy(F.col("name").alias("_fn")).agg(
        F.min_by("_p", "ordinal").alias("_fwd"))
    rev = synonyms.join(p, F.col("name") == F.col("_p")).groupBy(F.col("synonym").alias("_rn")).agg(
        F.min_by("_p", "ordinal").alias("_rev"))
    out = (
        c.join(p, F.col("cluster_gene") == F.col("_p"), "left")
        .join(fwd, F.col("cluster_gene") == F.col("_fn"), "left").join(rev, F.col("cluster_gene") == F.col("_rn"), "left")
    )
    kind = F.when(F.col("_p").isNotNull(), "direct").when(F.col("_rev").isNotNull(), "reverse").when(F.col("_fwd").isNotNull(), "forward")
    return out.select("cluster_gene", F.coalesce("_p", "_rev", "_fwd").alias("plot_gene"), kind.alias("kind"))


# U5
def unmapped_plot_genes(plots: DataFrame, mapping: DataFrame) -> DataFrame:
    used = mapping.where(F.col("plot_gene").isNotNull()).select(F.col("plot_gene").alias("gene"))
    return plots.select("gene").distinct().join(used, "gene", "left_anti")


def compared_names(ours: DataFrame, theirs: DataFrame, ours_only: str, theirs_only: str, both: str = "both", name: str = "gene") -> DataFrame:
    """(name, side): each different name of two tables with where it occurs, by one aggregate over both. Nulls count as a name."""
    rows = ours.select(name, F.lit(True).alias("_a"), F.lit(False).alias("_b")).union(theirs.select(name, F.lit(False), F.lit(True)))
    met = rows.groupBy(name).agg(F.bool_or("_a").alias("_a"), F.bool_or("_b").alias("_b"))
    return met.select(name, F.when(F.col("_a") & F.col("_b"), both).when(F.col("_a"), ours_only).otherwise(theirs_only).alias("side"))


# J21
def aliases(details: DataFrame) -> DataFrame:
    """(name, synonym, ordinal) from details (name, synonyms, subtilist, expression_browser, ordinal).

    The browser id contributes the part before its first underscore. Blank and repeated aliases go.
    `ordinal` becomes (ordinal, i), i being the place among the aliases of its row.
    """
    browser = F.when(F.contains("expression_browser", F.lit("_")), F.substring_index("expression_browser", "_", 1))
    every = F.array_distinct(F.array_compact(F.concat(
        F.coalesce("synonyms", F.array().cast("array<string>")), F.array("subtilist", browser))))
    return details.where(F.coalesce(F.col("name"), F.lit("")) != "").select(
        "name", F.posexplode(every).alias("i", "synonym"), "ordinal").where(F.trim("synonym") != "").select(
        "name", "synonym", F.struct("ordinal", "i").alias("ordinal"))


def map_name_sets_once(clusters: DataFrame, plots: DataFrame, alias_table: DataFrame) -> DataFrame:
    """J20 with each plot gene used by at most one cluster gene in the reverse step.

    The order in which the original visits cluster genes is a set order, so the rule is fixed here:
    when several cluster genes claim a plot gene the smallest name keeps it.
    """
    direct = clusters.select("gene").distinct().join(plots.select("gene").distinct(), "gene").select(
        F.col("gene").alias("cluster_gene"), F.col("gene").alias("plot_gene"), F.lit("direct").alias("kind"))
    rest = clusters.select(F.col("gene").alias("cluster_gene")).distinct().join(direct, "cluster_gene", "left_anti")
    p = plots.select(F.col("gene").alias("plot_gene")).distinct()
    fwd = rest.join(alias_table, F.col("cluster_gene") == F.col("name")).join(p, F.col("synonym") == F.col("plot_gene")).groupBy(
        "cluster_gene").agg(F.min_by("plot_gene", "ordinal").alias("plot_gene")).withColumn("kind", F.lit("forward"))
    # Plot genes that a direct or forward match took are not offered again.
    free = p.join(direct.select("plot_gene"), "plot_gene", "left_anti").join(fwd.select("plot_gene"), "plot_gene", "left_anti")
    claims = rest.join(alias_table, F.col("cluster_gene") == F.col("synonym")).join(free, F.col("name") == F.col("plot_gene"))
    held = claims.groupBy("plot_gene").agg(F.min("cluster_gene").alias("cluster_gene"))
    rev = held.groupBy("cluster_gene").agg(F.min("plot_gene").alias("plot_gene")).withColumn("kind", F.lit("reverse"))
    matched = direct.unionByName(rev).unionByName(fwd.join(rev.select("cluster_gene"), "cluster_gene", "left_anti"))
    none = clusters.select(F.col("gene").alias("cluster_gene")).distinct().join(matched.select("cluster_gene"), "cluster_gene", "left_anti")
    return matched.unionByName(none, allowMissingColumns=True)


# J22
def enhance_mapping(mapping: DataFrame, plots: DataFrame, alias_table: DataFrame) -> DataFrame:
    """Fills unmapped rows of a J20 mapping with an alias that is a plot gene, ignoring case."""
    p = plots.groupBy(F.lower("gene").alias("_k")).agg(F.min("gene").alias("_p"))
    found = alias_table.join(p, F.lower("synonym") == F.col("_k")).groupBy(F.lower("name").alias("_n")).agg(
        F.min_by("_p", "ordinal").alias("_alias"))
    out = mapping.join(found, F.lower("cluster_gene") == F.col("_n"), "left")
    open_row = F.col("plot_gene").isNull()
    return out.select(
        "cluster_gene", F.coalesce("plot_gene", "_alias").alias("plot_gene"),
        F.when(open_row & F.col("_alias").isNotNull(), "alias").otherwise(F.col("kind")).alias("kind"))


# J23
def resolve_upload(records: DataFrame, primaries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Upload records with primary_name and gene_id; a null id means not found."""
    named = canonical_names(records, primaries, synonyms, "gene")
    ids = primaries.groupBy(F.col("name").alias("_n")).agg(F.min("id").alias("gene_id"))
    return named.join(ids, F.col("primary_name") == F.col("_n"), "left").drop("_n")


def not_found(resolved: DataFrame) -> DataFrame:
    return resolved.where(F.col("gene_id").isNull()).select("gene").distinct()


# A17
def synonym_statistics(primaries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Totals and coverage of a synonym table over all genes, coverage in percent to one decimal."""
    having = synonyms.select(F.col("name").alias("_n")).distinct()
    genes = primaries.select("name").distinct().join(having, F.col("name") == F.col("_n"), "left").agg(
        F.count(F.lit(1)).alias("total_genes"), F.count("_n").alias("genes_with_synonyms"))
    entries = synonyms.select(F.lower("synonym").alias("k")).agg(F.count_distinct("k")).scalar()
    share = F.when(F.col("total_genes") > 0, F.col("genes_with_synonyms") / F.col("total_genes") * 100).otherwise(0.0)
    return genes.withColumns({"total_synonym_entries": entries, "coverage": F.concat(F.format_string("%.1f", share), F.lit("%"))})


def mapping_coverage(mapping: DataFrame) -> DataFrame:
    share = F.count("plot_gene") / F.count(F.lit(1)) * 100
    return mapping.agg(F.count("plot_gene").alias("mapped"), F.count_if(F.col("plot_gene").isNull()).alias("unmapped"),
                       F.round(share, 1).alias("coverage"))
