"""Expression tables: cleaning, plot records, colouring and genome tracks."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import plotting as P
from ..session import cut as stored
from .cover import best_over

# The texts an upload may use for a missing p-value.
NULL_TOKENS = ("", "NA", "NaN", "nan", "null", "None")
BACKGROUND, INTERSECTION, MULTI = "background", "Intersection", "multi"


# P6
def clean_volcano(df: DataFrame, gene: str, x: str, p: str) -> DataFrame:
    """Rows with all three values and a positive numeric p, as gene, x, p (other columns kept)."""
    value = F.col(p).try_cast("double")
    ok = F.col(gene).isNotNull() & F.col(x).isNotNull() & value.isNotNull() & ~F.isnan(value) & (value > 0)
    rest = [c for c in df.columns if c not in (gene, x, p)]
    return df.where(ok).select(F.col(gene).alias("gene"), F.col(x).alias("x"), value.alias("p"), *rest)


# P6 + F9
def plot_points(
    df: DataFrame, gene: str, x: str, p: str, title: str = "", p_threshold: float = P.P_THRESHOLD,
    fc_threshold: float = P.FC_THRESHOLD,
) -> DataFrame:
    """One row per plotted point with its y value and thresholds."""
    return clean_volcano(df, gene, x, p).withColumns({
        "y": P.neg_log10("p"), "title": F.lit(title), "p_thresh_log": F.lit(P.neg_log10_threshold(p_threshold)),
        "fc_thresh": F.lit(float(fc_threshold)),
    })


# P7
def clean_upload(df: DataFrame, gene: str, log2fc: str, p: str | None = None) -> DataFrame:
    """Upload rows as gene, log2fc, p: blank genes and unreadable numbers are dropped."""
    g = F.trim(F.col(gene))
    fc_text = F.trim(F.col(log2fc))
    fc = F.nullif(fc_text, F.lit("")).try_cast("double")
    p_text = F.trim(F.col(p)) if p else F.lit(None).cast("string")
    pv = F.when(~p_text.isin(*NULL_TOKENS), p_text).try_cast("double")
    bad = (fc_text.isNotNull() & (fc_text != "") & fc.isNull()) | (
        p_text.isNotNull() & ~p_text.isin(*NULL_TOKENS) & pv.isNull())
    rest = [c for c in df.columns if c not in (gene, log2fc, p)]
    return df.where(F.coalesce(g, F.lit("")) != "").where(~F.coalesce(bad, F.lit(False))).select(
        g.alias("gene"), fc.alias("log2fc"), pv.alias("p"), *rest)


# A19
def last_values(rows: DataFrame, key: str = "primary_name", value: str = "log2fc", order: str = "row_no") -> DataFrame:
    """Last non-null value per name."""
    return rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.max_by(value, order).alias(value))


# F21
def dataset_projection(datasets: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(dataset, gene, log2fc) union of several tables with one fold-change column each."""
    parts = [
        df.select(F.lit(name).alias("dataset"), F.col(gene).alias("gene"), F.col(fc).cast("double").alias("log2fc"))
        for name, (df, gene, fc) in datasets.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# J24, U2 on points
def colour_points(points: DataFrame, membership: DataFrame, order: str = "category") -> DataFrame:
    """Each point's trace: Intersection, its first selected category, or background.

    `membership` holds (category, gene) of the selected categories, and `order` ranks them.
    An intersection gene is in every one of at least two categories.
    """
    total = membership.agg(F.count_distinct("category")).scalar()
    per_gene = membership.groupBy("gene").agg(
        F.count_distinct("category").alias("_n"), F.min_by("category", order).alias("_first"))
    everywhere = (F.col("_n") == total) & (total > 1)
    trace = F.when(F.col("_n").isNull(), BACKGROUND).when(everywhere, INTERSECTION).otherwise(F.col("_first"))
    return points.join(per_gene, "gene", "left").withColumn("trace", trace).drop("_n", "_first")


# J30
def highlighted(coloured: DataFrame, order: str = "row_no") -> DataFrame:
    """Last point of every gene in a visible, non-background trace."""
    shown = coloured.where(F.col("trace") != BACKGROUND)
    rest = [c for c in shown.columns if c != "gene"]
    return shown.groupBy("gene").agg(F.max_by(F.struct(*rest), order).alias("_p")).select("gene", "_p.*")


# J25
def colour_by_pathway(points: DataFrame, gene_pathways: DataFrame, selected: list[str]) -> DataFrame:
    """Background without a selected pathway, that pathway with one, `multi` with more."""
    chosen = gene_pathways.where(F.col("pathway_id").isin(*selected)).groupBy("gene").agg(
        F.min("pathway_id").alias("_a"), F.max("pathway_id").alias("_b"))
    trace = F.when(F.col("_a").isNull(), BACKGROUND).when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(MULTI)
    return points.join(chosen, "gene", "left").withColumn("trace", trace).drop("_a", "_b")


# J26
def overlay_points(points: DataFrame, genes: DataFrame) -> DataFrame:
    """Points whose gene is in `genes`, ignoring case."""
    keys = genes.select(F.lower("gene").alias("_k")).distinct()
    return points.withColumn("_k", F.lower("gene")).join(keys, "_k", "left_semi").drop("_k")


def colour_by_layer(points: DataFrame, layers: DataFrame) -> DataFrame:
    """Neighbourhood layer of each point (0 is the centre); null outside, ignoring case."""
    keys = layers.groupBy(F.lower("gene").alias("_k")).agg(F.min("layer").alias("layer"))
    return points.withColumn("_k", F.lower("gene")).join(keys, "_k", "left").drop("_k")


# A12
def gene_bins(genes: DataFrame, size: int) -> DataFrame:
    """(contig_id, bin_no, gene): a gene lands in every bin it touches."""
    bins = F.explode(F.sequence(F.floor((F.col("g_start") - 1) / size), F.floor((F.col("g_end") - 1) / size)))
    return genes.select("contig_id", bins.alias("bin_no"), "gene")


def _last_writer(spans: DataFrame, keys: list[str], window: int = 1 << 14) -> DataFrame:
    """Stretches of constant value where later spans overwrite earlier ones.

    Spans are cut at window edges, so every step works on one stretch of the axis. In it, the
    sorted edges form elementary stretches; each takes the value of the last span over it, found
    by dyadic blocks, so the work is linear however many spans pile up.
    """
    cut = spans.withColumn("_w", F.explode(F.sequence(F.floor(F.col("start") / window), F.floor(F.col("end") / window))))
    cut = cut.withColumns({
        "start": F.greatest("start", F.col("_w") * window), "end": F.least("end", (F.col("_w") + 1) * window - 1)})
    # Of equal spans only the last can show. Edges, blocks and their levels are read from here, and each would make the spans anew.
    cut = stored(cut.groupBy(*keys, "_w", "start", "end").agg(F.max(F.struct("ordinal", "value")).alias("_v")))
    # Edges per window are distinct positions, at most twice the window width.
    edges = cut.select(*keys, "_w", F.explode(F.array("start", F.col("end") + 1)).alias("at")).distinct()
    order = Window.partitionBy(*keys, "_w").orderBy("at")
    pieces = edges.withColumn("_until", F.lead("at").over(order) - 1).where(F.col("_until").isNotNull())
    found = best_over(pieces, cut, [*keys, "_w"], "at", "start", "end", most={"_v": F.col("_v")})
    return pieces.join(found, [*keys, "_w", "at"]).select(
        *keys, F.col("at").alias("start"), F.col("_until").alias("end"), F.col("_v.value").alias("value"))


# A11
def bin_means(values: DataFrame, bins: DataFrame, size: int, keys: list[str] | None = None) -> DataFrame:
    """Mean of the non-zero per-base values of each bin; 0 for a bin without any.

    `values` holds genes with coordinates (contig_id, g_start, g_end, value, ordinal, and `keys`);
    where genes overlap the later ordinal shows. Positions are 1-based and bins come
    from `genome_bins` (M18). The mean weighs each stretch by its length.
    """
    keys = keys or []
    lengths = bins.groupBy("contig_id").agg(F.max("bin_end").alias("_len"))
    spans = values.join(lengths, "contig_id").select(
        "contig_id", *keys, F.greatest("g_start", F.lit(1)).alias("start"), F.least("g_end", "_len").alias("end"),
        "value", "ordinal").where(F.col("start") <= F.col("end"))
    flat = _last_writer(spans, ["contig_id", *keys]).where(F.col("value") != 0)
    cut = flat.withColumn("bin_no", F.explode(F.sequence(
        F.floor((F.col("start") - 1) / size), F.floor((F.col("end") - 1) / size))))
    width = F.least("end", (F.col("bin_no") + 1) * size) - F.greatest("start", F.col("bin_no") * size + 1) + 1
    sums = cut.groupBy("contig_id", *keys, "bin_no").agg(
        (F.sum(F.col("value") * width) / F.sum(width)).alias("mean"))
    if keys:
        return sums
    return bins.join(sums, ["contig_id", "bin_no"], "left").withColumn("mean", F.coalesce("mean", F.lit(0.0)))


# A13
def comparative_bins(values: DataFrame, bins: DataFrame, size: int, datasets: list[str]) -> DataFrame:
    """A11 for several datasets side by side: one column per name in `datasets`, 0 where empty."""
    means = bin_means(values, bins, size, ["dataset"])
    wide = means.groupBy("contig_id", "bin_no").pivot("dataset", datasets).agg(F.first("mean"))
    return bins.join(wide, ["contig_id", "bin_no"], "left").fillna(0.0, datasets)


# A14
def track_statistics(resolved: DataFrame, value: str = "log2fc") -> DataFrame:
    """Counts of one run: rows, with coordinates, matched by synonym, with a value."""
    found = F.col("g_start").isNotNull()
    return resolved.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(found).alias("with_coordinates"),
        F.count_if(F.col("match_kind") == "synonym").alias("via_synonym"),
        F.count_if(found & F.col(value).isNotNull()).alias("valid_values"))


# A15
def start_signal(values: DataFrame) -> DataFrame:
    """Value at each gene start, last writer wins, zeros left out."""
    return values.groupBy("contig_id", F.col("g_start").alias("position")).agg(
        F.max_by("value", "ordinal").alias("value")).where(F.col("value") != 0)


# W9
def by_direction(values: DataFrame, value: str = "log2fc") -> DataFrame:
    """Up- and down-regulated genes in position order; a zero is in neither."""
    v = F.col(value)
    return values.where(v != 0).withColumn("direction", F.when(v > 0, "up").otherwise("down")).orderBy(
        "contig_id", "g_start", "gene")


def resolve_roles(columns: list[str], candidates: dict[str, list[str]], exact: bool = False, optional: tuple[str, ...] = ()) -> dict[str, str]:
    """The column of each role: first candidate, in priority order, found in a header."""
    out = {}
    for role, names in candidates.items():
        hit = next((c for n in names for c in columns if (c == n if exact else n in c.lower())), None)
        if hit is not None:
            out[role] = hit
        elif role not in optional:
            raise ValueError(f"no column for {role!r} among {columns}")
    return out


# Header texts searched for each role of an upload, in priority order.
UPLOAD_ROLES = {
    "gene": ["gene", "name", "id"],
    "log2fc": ["log2fc", "log2", "fold"],
    "p": ["pval", "p_value", "p-value", "padj", "fdr"],
}

