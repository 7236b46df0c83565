"""Gene sets: selections, intersections, categories, regulons, pathways, metabolites.

Sets are kept as long (set, gene) tables. A set may hold a large share of all rows, so members
are never collected into one value; names are joined into text only where the number
of parts is the size of a selection.
"""
from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import numbered
from .hierarchy import ancestors


# P8, W4
def _ranked(hits: DataFrame, q: str, limit: int, limit_before_rank: bool) -> DataFrame:
    if limit_before_rank:
        hits = hits.orderBy("ordinal").limit(limit)
    return hits.select("name").distinct().orderBy(
        F.when(F.lower("name").startswith(q), 0).otherwise(1), F.length("name"), F.lower("name"), "name").limit(limit)


def search_genes(genes: DataFrame, text: str, limit: int = 50, limit_before_rank: bool = False) -> DataFrame:
    """Names that contain `text`, ignoring case: prefix matches first, then shorter, then alphabetical.

    With `limit_before_rank` the first `limit` matches in table order are ranked.
    """
    if len(text) < 2:
        return genes.select("name").limit(0)
    q = text.lower()
    return _ranked(genes.where(F.lower("name").contains(q)), q, limit, limit_before_rank)


#: Folders of a stored name index.
GRAM_PARTS = 64


def name_grams(genes: DataFrame) -> DataFrame:
    """Postings of the names: the columns of `genes`, `gram` and `part`; one row for each different two- and three-letter gram of a name, in lower case."""
    low = F.lower("name")

    def grams(width: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.length(low) - (width - 1)), lambda i: F.substring(low, i, F.lit(width)))
        return F.when(F.length(low) >= width, every).otherwise(F.array().cast("array<string>"))

    listed = genes.where(F.col("name").isNotNull()).withColumn("gram", F.explode(F.array_distinct(F.concat(grams(2), grams(3)))))
    return listed.withColumn("part", (F.crc32("gram") % GRAM_PARTS).cast("int"))


def write_name_index(genes: DataFrame, path: str) -> None:
    """Store the postings in one folder per part, sorted by gram, so that a search reads the folders of its grams and skips row groups inside them."""
    name_grams(genes).repartition("part").sortWithinPartitions("part", "gram").write.mode("overwrite").partitionBy("part").parquet(path)


def matching_names(postings: DataFrame, text: str) -> DataFrame:
    """Rows whose name contains `text`, ignoring case, with the columns that `name_grams` was given.

    Texts of three letters and more look up their trigrams, shorter ones a bigram. Only the rows of the rarest gram are read for names, and each is verified;
    a gram without rows ends the search.
    """
    q, kept = text.lower(), [c for c in postings.columns if c not in ("gram", "part")]
    width = min(3, len(q))
    grams = sorted({q[i:i + width] for i in range(len(q) - width + 1)}) if width >= 2 else []
    part = {g: zlib.crc32(g.encode()) % GRAM_PARTS for g in grams}
    rows = lambda some: postings.where(F.col("part").isin([part[g] for g in some]) & F.col("gram").isin(some))
    sizes = {r["gram"]: r["count"] for r in rows(grams).groupBy("gram").count().collect()} if len(grams) > 1 else dict.fromkeys(grams, 1)
    if not grams or len(sizes) < len(grams):
        return postings.select(kept).limit(0)
    rarest = min(grams, key=lambda g: (sizes[g], g))
    return rows([rarest]).where(F.lower("name").contains(q)).select(kept)


def search_postings(postings: DataFrame, text: str, limit: int = 50, limit_before_rank: bool = False) -> DataFrame:
    """`search_genes` over stored postings."""
    return _ranked(matching_names(postings, text), text.lower(), limit, limit_before_rank)


# U1
def union_passes(passes: dict[str, DataFrame], tag: str = "part", names: dict[str, Column] | None = None) -> DataFrame:
    """All rows of several passes, with the name of the pass. A column that a pass lacks is null there; equal rows of two passes both stay.

    `names` names the rows of a pass one by one, so that parts which come from one scan are not scanned for apart.
    """
    out = None
    for name, rows in passes.items():
        rows = rows.withColumn(tag, (names or {}).get(name, F.lit(name)))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


# A20, S16
def gene_sources(membership: DataFrame) -> DataFrame:
    """Sources of each gene joined by `; `, and their number."""
    pairs = membership.select("gene", "category").distinct()
    return pairs.groupBy("gene").agg(
        F.concat_ws("; ", F.array_sort(F.collect_list("category"))).alias("sources"), F.count(F.lit(1)).alias("source_count"))


def select_categories(membership: DataFrame, categories: list[str], manual: list[str] | None = None,
                      known: DataFrame | None = None) -> DataFrame:
    """(category, gene) of chosen categories plus hand-picked genes as `individual`.

    With `known` (name) only known hand-picked genes are kept, the single-selection form.
    """
    rows = membership.where(F.col("category").isin(*categories)).select("category", "gene").distinct()
    if not manual:
        return rows
    spark = membership.sparkSession
    hand = spark.createDataFrame([(g,) for g in dict.fromkeys(manual)], "gene string")
    if known is not None:
        hand = hand.join(known.select(F.col("name").alias("gene")), "gene", "left_semi")
    return rows.unionByName(hand.select(F.lit("individual").alias("category"), "gene"))


# U2
def in_every_category(membership: DataFrame, total: Column | int | None = None) -> DataFrame:
    """Genes found in all selected categories, of which there must be more than one.

    `total` is the number of selected categories, empty ones included; it defaults to the
    categories present.
    """
    n = membership.agg(F.count_distinct("category")).scalar() if total is None else (
        F.lit(total) if isinstance(total, int) else total)
    per = membership.select("gene", "category").distinct().groupBy("gene").agg(F.count(F.lit(1)).alias("source_count"))
    return per.where((F.col("source_count") == n) & (n > 1))


# U3
def outside_intersection(membership: DataFrame, total: int | None = None) -> DataFrame:
    return membership.join(in_every_category(membership, total).select("gene"), "gene", "left_anti")


# U4, A21
def in_several(membership: DataFrame) -> DataFrame:
    per = membership.select("gene", "category").distinct().groupBy("gene").agg(F.count(F.lit(1)).alias("occurrences"))
    return per.where(F.col("occurrences") > 1)


def duplicate_ids(rows: DataFrame, id_col: str = "id") -> DataFrame:
    return rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("occurrences")).where(F.col("occurrences") > 1)


# U6
def tagged_union(parts: dict[str, DataFrame], manual: DataFrame | None = None) -> DataFrame:
    """(category, kind, gene) from {kind: (id, gene)} branches, category keys being `kind_id`."""
    out = None
    for kind, df in parts.items():
        rows = df.select(F.concat(F.lit(f"{kind}_"), F.col("id").cast("string")).alias("category"), F.lit(kind).alias("kind"), "gene")
        out = rows if out is None else out.unionByName(rows)
    if manual is not None:
        hand = manual.select(F.lit("individual").alias("category"), F.lit("individual").alias("kind"), "gene")
        out = hand if out is None else out.unionByName(hand)
    return out.distinct()


# A1
def regulator_groups(regulations: DataFrame) -> DataFrame:
    """Distinct targets and raw edge count of each regulator, by edge count."""
    seen = regulations.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("_n"))
    return seen.groupBy("src").agg(
        F.count("dst").alias("targets"), F.coalesce(F.sum(F.when(F.col("dst").isNotNull(), F.col("_n"))), F.lit(0)).alias("regulation_count"),
    ).orderBy(F.col("regulation_count").desc(), "src")


# A2
def regulator_targets(regulations: DataFrame, gene_ids: DataFrame, regulator: int) -> DataFrame:
    targets = regulations.where((F.col("src") == regulator) & F.col("dst").isNotNull()).select("dst").distinct()
    return targets.join(gene_ids, F.col("dst") == F.col("id")).select(F.col("name").alias("gene"))


# F14
def function_text(description: Column | str) -> Column:
    """Text after `Function:` up to `;`, else the first `;` segment."""
    d = F.col(description) if isinstance(description, str) else description
    tagged = F.trim(F.replace(F.regexp_extract(d, r"(?s)Function:([^;]*)", 1), F.lit("Function:"), F.lit("")))
    return F.when(F.coalesce(d, F.lit("")) == "", "").when(d.contains("Function:"), tagged).otherwise(
        F.trim(F.substring_index(d, ";", 1)))


# A3
def regulon_members(regulons: DataFrame) -> DataFrame:
    """(regulon_id, gene_id): distinct members from single genes and from operons.

    `regulons` is nested: id, gene_regulations[].gene.id and operon_regulations[].operon.genes[].id.
    """
    genes = regulons.select(F.col("id").alias("regulon_id"), F.explode("gene_regulations").alias("g")).select(
        "regulon_id", F.col("g.gene.id").alias("gene_id"))
    operons = regulons.select(F.col("id").alias("regulon_id"), F.explode("operon_regulations").alias("o")).select(
        "regulon_id", F.explode("o.operon.genes").alias("g")).select("regulon_id", F.col("g.id").alias("gene_id"))
    return genes.unionByName(operons).where(F.col("gene_id").isNotNull()).distinct()


def regulon_table(regulons: DataFrame) -> DataFrame:
    """Regulon name, member count and function text; the name falls back to the regulator gene, then to the id."""
    sizes = regulon_members(regulons).groupBy("regulon_id").agg(F.count(F.lit(1)).alias("gene_count"))
    named = F.coalesce(F.nullif(F.col("regulator_display_name"), F.lit("")), F.col("regulator_gene.name"),
                       F.concat(F.lit("Regulon_"), F.col("id").cast("string")))
    return regulons.select(F.col("id").alias("regulon_id"), named.alias("name"), function_text("description").alias("function")).join(
        sizes, "regulon_id", "left").withColumn("gene_count", F.coalesce("gene_count", F.lit(0)))


# A4
def sigma_counts(tss: DataFrame) -> DataFrame:
    cleaned = F.when(F.col("sigma") == "?", "Unknown").otherwise(F.translate("sigma", ";", "/"))
    return tss.groupBy(cleaned.alias("sigma")).agg(F.count(F.lit(1)).alias("n"))


# A5
def coordinate_index(tss: DataFrame) -> DataFrame:
    """Each coordinate's entries in load order, one row per entry with its place in the list."""
    return numbered(tss, ["contig_id", "coord"], ["ordinal"], "entry_no")


# A7
def cluster_sizes(clusters: DataFrame) -> DataFrame:
    """Distinct genes of each cluster, with the cluster's leading letter as its branch."""
    per = clusters.select("cluster", "gene").distinct().groupBy("cluster").agg(F.count(F.lit(1)).alias("gene_count"))
    return per.withColumn("branch", F.substring("cluster", 1, 1))


def cluster_members(clusters: DataFrame) -> DataFrame:
    """(branch, cluster, gene): the clusters of each gene turned into the genes of each cluster."""
    return clusters.select(F.substring("cluster", 1, 1).alias("branch"), "cluster", "gene").distinct()


# A8, A9
def set_sizes(names: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Name and distinct gene count of each set with at least one gene."""
    per = members.select(key, "gene").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("gene_count"))
    return names.join(per, key)


def set_members(members: DataFrame, key: str, chosen: list[str]) -> DataFrame:
    return members.where(F.col(key).isin(*chosen)).select(key, "gene").distinct()


def complex_members(raw: DataFrame) -> DataFrame:
    """(name, gene) from raw JSON values: a list, an object with genes or members, one name, or null."""
    as_list = F.from_json("value", "array<string>")
    as_map = F.from_json("value", "genes array<string>, members array<string>")
    text = F.trim("value")
    listed = (
        F.when(F.col("value").isNull() | (text == "null"), F.array().cast("array<string>"))
        .when(text.startswith("["), as_list)
        .when(text.startswith("{"), F.coalesce(
            F.when(F.size(as_map["genes"]) > 0, as_map["genes"]), as_map["members"]))
        .otherwise(F.array(F.regexp_replace(text, '^"|"$', "")))
    )
    return raw.select("name", F.explode(listed).alias("gene")).where(F.col("gene").isNotNull()).distinct()


# A10
def protein_names(proteins: DataFrame, genes: DataFrame) -> DataFrame:
    """(protein_id, gene) of (protein_id, gene_id, name): the name of the protein's gene, else the protein's own."""
    look = genes.select(F.col("id").alias("gene_id"), F.nullif("name", F.lit("")).alias("_gene"))
    return proteins.join(look, "gene_id", "left").select("protein_id", F.coalesce("_gene", F.nullif("name", F.lit(""))).alias("gene"))


def complexes_from_interactions(interactions: DataFrame, molecules: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(complex, gene) of interactions with at least two distinct genes.

    A protein's gene is its molecule's `gene_name`, `name` or `gene.name`, the first that is there and not empty, else the gene that `names`
    (`protein_names`) gives; proteins without any take no part. Interactions with the same members are one complex. Its key is the number of members and two
    hashes of the set, whatever its size; `complex_labels` spells out the names of chosen ones.
    """
    told = [F.nullif(c, F.lit("")) for c in ("gene_name", "name", "gene.name") if c.split(".")[0] in molecules.columns]
    proteins = molecules.where(F.col("type") == "Protein").select(F.col("id").alias("molecule_id"), F.coalesce(*told).alias("gene"))
    if names is not None:
        other = names.select(F.col("protein_id").alias("molecule_id"), F.col("gene").alias("_gene"))
        proteins = proteins.join(other, "molecule_id", "left").select("molecule_id", F.coalesce("gene", "_gene").alias("gene"))
    members = interactions.join(proteins.where("gene IS NOT NULL"), "molecule_id").select("interaction_id", "gene").distinct()
    keyed = members.groupBy("interaction_id").agg(
        F.count(F.lit(1)).alias("_n"), F.bit_xor(F.xxhash64("gene")).alias("_x"), F.bit_xor(F.xxhash64(F.lit(1), "gene")).alias("_y")).where("_n >= 2")
    key = F.format_string("%d-%016x%016x", "_n", "_x", "_y").alias("complex")
    return members.join(keyed.select("interaction_id", key), "interaction_id").select("complex", "gene").distinct()


def complex_labels(complexes: DataFrame) -> DataFrame:
    """(complex, label) of the complexes given, labelled `Complex: A & B`."""
    names = complexes.groupBy("complex").agg(F.array_sort(F.collect_list("gene")).alias("genes"))
    return names.select("complex", F.concat(F.lit("Complex: "), F.array_join("genes", " & ")).alias("label"))


# J27
def pathway_genes(direct: DataFrame, by_reaction: DataFrame | None = None) -> DataFrame:
    """(pathway_id, gene) from genes, enzymes and reactions; the reaction map counts only if they give nothing."""
    main = direct.where(F.col("gene").isNotNull()).select("pathway_id", "gene").distinct()
    if by_reaction is None:
        return main
    empty = main.agg(F.count(F.lit(1))).scalar() == 0
    return main.unionByName(by_reaction.where(empty).select("pathway_id", "gene").distinct())


def pathways_from_json(pathways: DataFrame) -> DataFrame:
    """Long (pathway_id, name, gene) rows of nested pathways: genes, enzymes and reactions' genes and enzymes."""
    base = pathways.where((F.coalesce(F.col("id"), F.lit("")) != "") & (F.coalesce(F.col("name"), F.lit("")) != ""))
    top = lambda field: base.select(F.col("id").alias("pathway_id"), "name", F.explode(field).alias("m"))
    rxn = base.select(F.col("id").alias("pathway_id"), "name", F.explode("reactions").alias("r"))
    deep = lambda field: rxn.select("pathway_id", "name", F.explode(f"r.{field}").alias("m"))
    gene = F.coalesce(F.col("m.gene_name"), F.col("m.name")).alias("gene")
    enzyme = F.coalesce(F.col("m.gene_name"), F.col("m.gene.name")).alias("gene")
    out = top("genes").select("pathway_id", "name", gene)
    for rows, which in ((top("enzymes"), enzyme), (deep("genes"), gene), (deep("enzymes"), enzyme)):
        out = out.unionByName(rows.select("pathway_id", "name", which))
    return out.where(F.coalesce(F.col("gene"), F.lit("")) != "").distinct()


# J28
def map_to_plot(cluster_genes: DataFrame, mapping: DataFrame, plots: DataFrame) -> DataFrame:
    """Cluster genes under their plot names: the mapped name must be plotted; unmapped names may match directly."""
    m = mapping.where(F.col("plot_gene").isNotNull()).select("cluster_gene", "plot_gene")
    named = cluster_genes.join(m, F.col("gene") == F.col("cluster_gene"), "left").select(
        "cluster", F.coalesce("plot_gene", "gene").alias("gene"))
    return named.join(plots.select("gene").distinct(), "gene", "left_semi").distinct()


# J29
def gene_metabolites(links: DataFrame, gene_ids: DataFrame, protein_genes: DataFrame) -> DataFrame:
    """(gene, metabolite_id, metabolite_name, type, transport_type) of interactions.

    The inline gene id is preferred; otherwise the protein's gene. All proteins are resolved.
    """
    look = protein_genes.select("protein_id", F.col("gene_id").alias("_pg"))
    ids = gene_ids.select(F.col("id").alias("_gid"), F.col("name").alias("gene"))
    keyed = links.where(F.coalesce(F.col("metabolite_name"), F.lit("")) != "").join(look, "protein_id", "left").withColumn(
        "_use", F.coalesce("gene_id", "_pg"))
    return keyed.join(ids, F.col("_use") == F.col("_gid")).select(
        "gene", "metabolite_id", "metabolite_name", "type",
        F.when(F.col("type") == "Transport", F.col("transport_type")).alias("transport_type"))


# P10
def interaction_type_in(types: list[str]) -> Column:
    """Interaction type is selected, `Transport:<direction>` included; no selection means all."""
    if not types:
        return F.lit(True)
    sub = F.concat(F.lit("Transport:"), F.col("transport_type"))
    return F.col("type").isin(*types) | F.coalesce((F.col("type") == "Transport") & sub.isin(*types), F.lit(False))


# A23
def metabolites_by_category(members: DataFrame, entries: DataFrame) -> DataFrame:
    """(category_id, metabolite_id, name): distinct metabolites with their names or `Metabolite id`."""
    names = entries.where(F.col("metabolite_id").isNotNull()).groupBy("metabolite_id").agg(F.max("metabolite_name").alias("_name"))
    return members.select("category_id", "metabolite_id").distinct().join(names, "metabolite_id", "left").select(
        "category_id", "metabolite_id",
        F.coalesce("_name", F.concat(F.lit("Metabolite "), F.col("metabolite_id").cast("string"))).alias("name"))


# A24
def metabolite_buckets(entries: DataFrame, members: DataFrame, ids: list[int], categories: list[int], types: list[str]) -> DataFrame:
    """(bucket, gene) per selected metabolite and per selected category; categories also select their members."""
    pairs = entries.where(interaction_type_in(types)).select("gene", "metabolite_id").distinct()
    of_cat = members.where(F.col("category_id").isin(*categories)).select("category_id", "metabolite_id").distinct()
    wanted = of_cat.select("metabolite_id")
    if ids:
        picked = entries.sparkSession.createDataFrame([(i,) for i in ids], "metabolite_id bigint")
        wanted = wanted.unionByName(picked)
    wanted = wanted.distinct()
    single = pairs.join(wanted, "metabolite_id").select(
        F.concat(F.lit("metabolite_"), F.col("metabolite_id").cast("string")).alias("bucket"), "gene")
    grouped = pairs.join(of_cat, "metabolite_id").select(
        F.concat(F.lit("metabolite_category_"), F.col("category_id").cast("string")).alias("bucket"), "gene").distinct()
    return single.unionByName(grouped)


# F11
def dot_level(dot: Column | str = "dot") -> Column:
    d = F.col(dot) if isinstance(dot, str) else dot
    return F.when(F.coalesce(d, F.lit("")) == "", 0).otherwise(F.size(F.split(d, r"\.")))


def dot_key(dot: Column | str = "dot") -> Column:
    d = F.col(dot) if isinstance(dot, str) else dot
    return F.transform(F.split(d, r"\."), lambda x: x.try_cast("int"))


# G12
def category_genes(categories: DataFrame, direct: DataFrame) -> DataFrame:
    """(category_id, gene) of every category: its own genes, else the union over its children.

    A category with genes of its own does not look at its children, so membership climbs
    from each category to its parent only while the parent has none. Pairs of category and ancestor come by
    pointer doubling, in log2(depth) rounds; a category that reaches itself is an error.
    """
    own = direct.select("category_id", "gene").distinct()
    full = own.select("category_id").distinct()
    # Where each category hands its genes: the parent, if that has none of its own.
    up = categories.where(F.col("parent_id").isNotNull()).select("id", F.col("parent_id").cast("bigint").alias("parent_id")).join(
        full.select(F.col("category_id").cast("bigint").alias("parent_id")), "parent_id", "left_anti")
    # Category-to-ancestor pairs are few next to the genes, so they are walked alone.
    pairs = ancestors(up, full.select(F.col("category_id").alias("id"))).select(F.col("id").alias("category_id"), F.col("ancestor").alias("root")).distinct()
    return own.join(pairs, "category_id").select(F.col("root").alias("category_id"), "gene").distinct()


# G13
def hierarchy_rows(categories: DataFrame, members: DataFrame) -> DataFrame:
    """Tree rows: id, parent_id, dot, name, level, gene_count, has_children."""
    counts = members.groupBy("category_id").agg(F.count(F.lit(1)).alias("gene_count"))
    parents = categories.where(F.col("parent_id").isNotNull()).select(F.col("parent_id").cast("bigint").alias("_p")).distinct()
    return categories.join(counts, F.col("id") == F.col("category_id"), "left").join(parents, F.col("id") == F.col("_p"), "left").select(
        "id", "parent_id", "dot", "name", dot_level().alias("level"), F.coalesce("gene_count", F.lit(0)).alias("gene_count"),
        F.col("_p").isNotNull().alias("has_children"))


# W8
def children_of(tree: DataFrame, category_id: int) -> DataFrame:
    return tree.where(F.col("parent_id") == category_id).orderBy("dot")


def in_tree_order(tree: DataFrame) -> DataFrame:
    return tree.orderBy(dot_key())


# W5
def main_groups(tree: DataFrame, n: int = 20, least: int = 10) -> DataFrame:
    return tree.where((F.col("level") <= 2) & (F.col("gene_count") >= least)).orderBy(
        F.col("gene_count").desc(), "id").limit(n)


# G14
def root_paths(categories: DataFrame) -> DataFrame:
    """(id, step, dot, name): every ancestor of every category, from the root, by dot prefix."""
    parts = F.split("dot", r"\.")
    steps = categories.select("id", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("step"), parts.alias("_parts"))
    keyed = steps.select("id", "step", F.array_join(F.slice("_parts", 1, F.col("step")), ".").alias("dot"))
    return keyed.join(categories.select("dot", "name"), "dot")


# A22
def gene_categories(direct: DataFrame, categories: DataFrame) -> DataFrame:
    """Categories of each gene with level, sorted by (level, name) inside a gene by `position`."""
    from pyspark.sql import Window

    rows = direct.select("category_id", "gene").distinct().join(categories, F.col("category_id") == F.col("id")).select(
        "gene", "id", "name", "dot", dot_level().alias("level"))
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("gene").orderBy("level", "name", "id")))
