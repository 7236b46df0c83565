"""Registered queries over intervals: gene context, start sites, region annotation."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import duplex, intervals, scan
from ..streaming import enrich
from .registry import query
from .sequence_queries import HIT_CTES, LOCATED, LOC_CTES, _duplex_sql, _srna, contig_lengths, oriented, exact_hits  # noqa: F401

RADII = {"radius": 200, "strand_radius": 50, "radius_text": "200bp"}
BIG = 1_000_000_000


@query("j1_interval_overlap", """
SELECT h.contig_id, h.start, h."end", h.strand, g.gene, g.g_start, g.g_end
FROM {hits} h JOIN {genes} g ON g.contig_id = h.contig_id AND g.g_start <= h."end" AND g.g_end >= h.start""", **HIT_CTES)
def _(fx):
    genes = fx.genes.select("contig_id", "gene", "g_start", "g_end")
    return intervals.overlap_pairs(exact_hits(fx).select("contig_id", "start", "end", "strand"), genes, ["contig_id"])


@query("j2_stranded_location", "SELECT contig_id, start, strand, loc_class, location FROM {loc}", **LOC_CTES)
def _(fx):
    return intervals.located(exact_hits(fx), fx.genes).select("contig_id", "start", "strand", "loc_class", "location")


@query("j2_one_lookup", "SELECT contig_id, start, strand, loc_class, location FROM {loc}", **LOC_CTES)
def _(fx):
    return intervals.located(exact_hits(fx), fx.genes, widest=6, lengths=contig_lengths(fx)).select("contig_id", "start", "strand", "loc_class", "location")


@query("j3_intergenic_neighbours", """
SELECT h.contig_id, h.start, h.strand,
       arg_max(gene, g_start * 1000000000 + ordinal) FILTER (WHERE g_start < h.start) AS up_gene,
       arg_min(gene, g_start * 1000000000 + ordinal) FILTER (WHERE g_start > h.start) AS down_gene
FROM {hits} h LEFT JOIN {genes} g ON g.contig_id = h.contig_id AND g.strand = h.strand
GROUP BY h.contig_id, h.start, h.strand
HAVING count(CASE WHEN g_start <= h.start + 5 AND g_end >= h.start THEN 1 END) = 0""", **HIT_CTES)
def _(fx):
    alone = intervals.same_strand_overlap(exact_hits(fx), fx.genes).where("first_gene IS NULL")
    return intervals.intergenic_neighbours(alone, fx.genes).select("contig_id", "start", "strand", "up_gene", "down_gene")


_CONTEXT = """
SELECT h.contig_id, h.start, h.strand,
       arg_max(gene, g_start * 1000000000 + ordinal) FILTER (WHERE g_end < h.start) AS up_gene,
       arg_min(gene, g_start * 1000000000 + ordinal) FILTER (WHERE g_start > h."end") AS down_gene
FROM {{hits}} h LEFT JOIN {{genes}} g ON g.contig_id = h.contig_id{extra}
GROUP BY h.contig_id, h.start, h.strand"""
_ADD = "SELECT *, concat('[', coalesce(up_gene, 'start'), ']---[', coalesce(down_gene, 'end'), ']') AS context FROM {ctx}"


@query("j4_gene_context_stranded", _ADD, **HIT_CTES, ctx=_CONTEXT.format(extra=" AND g.strand = h.strand"))
def _(fx):
    return intervals.gene_context(exact_hits(fx), fx.genes).select("contig_id", "start", "strand", "up_gene", "down_gene", "context")


@query("j4_gene_context_any_strand", _ADD, **HIT_CTES, ctx=_CONTEXT.format(extra=""))
def _(fx):
    return intervals.gene_context(exact_hits(fx), fx.genes, stranded=False).select(
        "contig_id", "start", "strand", "up_gene", "down_gene", "context")


@query("j5_unstranded_location", """
SELECT c.contig_id, c.start, c.strand, CASE WHEN g1 IS NOT NULL THEN concat('[', g1, '](in)')
       ELSE concat('[', coalesce(up_gene, 'start'), ']---[', coalesce(down_gene, 'end'), ']') END AS location
FROM {ctx} c JOIN (SELECT h.contig_id, h.start, h.strand,
       arg_min(gene, ordinal) FILTER (WHERE g_start <= h."end" AND g_end >= h.start) AS g1
  FROM {hits} h LEFT JOIN {genes} g ON g.contig_id = h.contig_id GROUP BY h.contig_id, h.start, h.strand) o
ON o.contig_id = c.contig_id AND o.start = c.start AND o.strand = c.strand""", **HIT_CTES, ctx=_CONTEXT.format(extra=""))
def _(fx):
    return intervals.located_any_strand(exact_hits(fx), fx.genes, widest=6, lengths=contig_lengths(fx)).select("contig_id", "start", "strand", "location")


def _map_sql(running: bool) -> str:
    """Segments from a window over the genes, one pass per contig."""
    prev_end = ("max(g_end) OVER w" if running else "lag(g_end) OVER (PARTITION BY contig_id ORDER BY g_start, ordinal)")
    prev_gene = (f"arg_max(gene, g_end * {BIG} + ordinal) OVER w" if running
                 else "lag(gene) OVER (PARTITION BY contig_id ORDER BY g_start, ordinal)")
    frame = "WINDOW w AS (PARTITION BY contig_id ORDER BY g_start, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    last_key = f"g_end * {BIG} + ordinal" if running else f"g_start * {BIG} + ordinal"
    least = 1 if running else 2
    return f"""
SELECT contig_id, g_start AS s_start, g_end AS s_end, 'gene' AS type, gene AS name, CAST(NULL AS VARCHAR) AS upstream, CAST(NULL AS VARCHAR) AS downstream
FROM {{genes}}
UNION ALL
SELECT contig_id, coalesce(pe, 0) + 1, g_start - 1, 'intergenic', 'intergenic', coalesce(pg, 'start'), gene
FROM (SELECT *, {prev_end} AS pe, {prev_gene} AS pg FROM {{genes}} {frame})
WHERE g_start - 1 - coalesce(pe, 0) >= {least}
UNION ALL
SELECT c.contig_id, coalesce(le, 0) + 1, n, 'intergenic', 'intergenic', coalesce(lg, 'start'), 'end'
FROM (SELECT contig_id, length(seq) AS n FROM {{contigs}}) c LEFT JOIN (
  SELECT contig_id, arg_max(g_end, {last_key}) AS le, arg_max(gene, {last_key}) AS lg FROM {{genes}} GROUP BY contig_id) l
ON l.contig_id = c.contig_id WHERE n > coalesce(le, 0)"""


def _segments(fx, running):
    return intervals.partition_map(fx.genes, fx.contigs.select("contig_id", F.length("seq").alias("contig_len")), running)


@query("j6_partition_map", "SELECT * FROM {seg}", seg=_map_sql(True))
def _(fx):
    return _segments(fx, True)


@query("j6_partition_map_parity", "SELECT * FROM {seg}", seg=_map_sql(False))
def _(fx):
    return _segments(fx, False)


def _label_sql(parity: bool) -> str:
    meet = 's.s_start < h."end" AND s.s_end >= h.start' if parity else 's.s_start <= h."end" AND s.s_end >= h.start'
    order = ("s_start, s_end, name" if parity
             else 'least(h."end", s_end) - greatest(h.start, s_start) DESC, s_start, s_end, name')
    return f"""
SELECT contig_id, start, strand, CASE WHEN name IS NULL THEN '[unknown_region]'
  WHEN type = 'intergenic' THEN concat('[', upstream, '][-------][', downstream, ']')
  WHEN start >= s_start AND "end" <= s_end THEN concat('[', name, '][In]')
  ELSE concat(CASE WHEN start < s_start THEN concat('<', s_start - start, 'bp>[', name, ']') ELSE '' END,
              CASE WHEN "end" > s_end THEN concat('[', name, ']<', "end" - s_end, 'bp>') ELSE '' END) END AS location
FROM (SELECT h.contig_id, h.start, h."end", h.strand, s.* EXCLUDE (contig_id),
             row_number() OVER (PARTITION BY h.contig_id, h.start, h.strand ORDER BY {order}) AS r
      FROM {{hits}} h LEFT JOIN {{seg}} s ON s.contig_id = h.contig_id AND {meet}) WHERE r = 1"""


@query("j7_map_location", _label_sql(False), **HIT_CTES, seg=_map_sql(True))
def _(fx):
    return intervals.map_location(exact_hits(fx), _segments(fx, True)).select("contig_id", "start", "strand", "location")


@query("j7_map_location_parity", _label_sql(True), **HIT_CTES, seg=_map_sql(False))
def _(fx):
    return intervals.map_location(exact_hits(fx), _segments(fx, False), parity=True).select("contig_id", "start", "strand", "location")


@query("j8_map_context", """
SELECT contig_id, start, strand, concat('[', coalesce(up, 'start'), '][-------][', coalesce(down, 'end'), ']') AS context
FROM (SELECT h.contig_id, h.start, h.strand,
        arg_max(g.gene, g.g_start * 1000000000 + g.ordinal) FILTER (WHERE g.g_start * 1000000000 + g.ordinal < coalesce(s.k, 9000000000000000)) AS up,
        arg_min(g.gene, g.g_start * 1000000000 + g.ordinal) FILTER (WHERE g.g_start > h."end") AS down
      FROM {hits} h JOIN (SELECT h.contig_id, h.start, h.strand, min(CASE WHEN g_end >= h.start THEN g_start * 1000000000 + ordinal END) AS k
            FROM {hits} h LEFT JOIN {genes} g ON g.contig_id = h.contig_id GROUP BY h.contig_id, h.start, h.strand) s
        ON s.contig_id = h.contig_id AND s.start = h.start AND s.strand = h.strand
      LEFT JOIN {genes} g ON g.contig_id = h.contig_id
      GROUP BY h.contig_id, h.start, h.strand)""", **HIT_CTES)
def _(fx):
    return intervals.map_context(exact_hits(fx), fx.genes).select("contig_id", "start", "strand", "context")


_NEAR = """
SELECT h.contig_id, h.start, h."end", h.strand,
   arg_min(gene, (h.start - g_end) * 1000000000 + ordinal) FILTER (WHERE g_end < h.start) AS left_gene,
   min(h.start - g_end) FILTER (WHERE g_end < h.start) AS left_distance,
   arg_min(gene, (g_start - h."end") * 1000000000 + ordinal) FILTER (WHERE g_start > h."end") AS right_gene,
   min(g_start - h."end") FILTER (WHERE g_start > h."end") AS right_distance,
   string_agg(concat('[', gene, ']'), ',' ORDER BY ordinal) FILTER (WHERE g_start <= h."end" AND g_end >= h.start) AS names,
   count(gene) FILTER (WHERE g_start <= h."end" AND g_end >= h.start) AS n,
   min(g_start) FILTER (WHERE g_start <= h."end" AND g_end >= h.start) AS gs,
   min(g_end) FILTER (WHERE g_start <= h."end" AND g_end >= h.start) AS ge
FROM {hits} h LEFT JOIN {genes} g ON g.contig_id = h.contig_id GROUP BY h.contig_id, h.start, h."end", h.strand"""


@query("j9_overhang_location", """
SELECT contig_id, start, strand, CASE
  WHEN n > 1 THEN names
  WHEN n = 1 AND gs <= start AND "end" <= ge THEN concat(names, '(in)')
  WHEN n = 1 AND start <= gs AND ge <= "end" THEN concat('<', gs - start, '>', names, '<', "end" - ge, '>')
  WHEN n = 1 AND start < gs THEN concat('<', gs - start, '>', names)
  WHEN n = 1 THEN concat(names, '<', "end" - ge, '>')
  WHEN left_gene IS NULL OR right_gene IS NULL THEN 'Intergenic'
  ELSE concat('[', left_gene, ']------[', right_gene, ']') END AS location FROM {near}""", **HIT_CTES, near=_NEAR)
def _(fx):
    return intervals.overhang_location(exact_hits(fx), fx.genes).select("contig_id", "start", "strand", "location")


@query("j10_nearest_genes", "SELECT contig_id, start, strand, left_gene, left_distance, right_gene, right_distance FROM {near}", **HIT_CTES, near=_NEAR)
def _(fx):
    return intervals.nearest_genes(exact_hits(fx), fx.genes).select(
        "contig_id", "start", "strand", "left_gene", "left_distance", "right_gene", "right_distance")


_TSS = """
SELECT contig_id, start, "end", strand, found_seq, coord AS tss_coord, s AS tss_strand, sigma, d AS tss_distance FROM (
  SELECT h.*, t.coord, t.strand AS s, t.sigma, abs(t.coord - h.start) AS d,
    row_number() OVER (PARTITION BY h.contig_id, h.start, h.strand ORDER BY
      CASE WHEN t.strand = h.strand AND abs(t.coord - h.start) <= 50 THEN 0 ELSE 1 END, abs(t.coord - h.start), t.coord, t.ordinal) AS r
  FROM {hits} h LEFT JOIN {tss} t ON t.contig_id = h.contig_id AND abs(t.coord - h.start) <= 200) WHERE r = 1"""
_LABEL = """
CASE WHEN tss_coord IS NULL THEN 'No TSS within 200bp' ELSE concat(
  CASE WHEN (strand = '+' AND tss_coord < start) OR (strand = '-' AND tss_coord > start)
       THEN concat('TSS >>> ', tss_distance) ELSE concat(tss_distance, ' <<< TSS') END,
  CASE WHEN sigma <> 'Unknown' THEN concat(' (σ', sigma, ')') ELSE '' END,
  CASE WHEN tss_strand <> strand THEN concat('[', tss_strand, ']') ELSE '' END) END"""


def _near_tss(fx):
    return intervals.nearest_tss(exact_hits(fx), fx.tss, 200, 50)


@query("j11_nearest_tss", "SELECT contig_id, start, strand, tss_coord, tss_strand, sigma, tss_distance FROM {near}", **HIT_CTES, near=_TSS)
def _(fx):
    return _near_tss(fx).select("contig_id", "start", "strand", "tss_coord", "tss_strand", "sigma", "tss_distance")


@query("j12_tss_distance_label", f"""SELECT contig_id, start, strand, CASE WHEN tss_coord IS NULL THEN NULL
  WHEN (strand = '+' AND tss_coord < start) OR (strand = '-' AND tss_coord > start) THEN 'upstream' ELSE 'downstream' END AS direction,
  {_LABEL} AS label FROM {{near}}""", **HIT_CTES, near=_TSS)
def _(fx):
    return _near_tss(fx).select("contig_id", "start", "strand", intervals.tss_direction().alias("direction"),
                                intervals.tss_label("200bp").alias("label"))


def results_table(fx):
    """Located hits in the column names of the results file."""
    return intervals.located(exact_hits(fx), fx.genes).select(
        "contig_id", F.col("start").alias("Start"), F.col("end").alias("End"), F.col("strand").alias("Strand"),
        F.col("pattern").alias("Pattern"), F.col("found_seq").alias("Found_Sequence"),
        F.col("location").alias("Location"), F.col("mismatches").alias("Mismatches"))


@query("j13_result_enrichment", f"""
SELECT l.contig_id, l.start AS "Start", l."end" AS "End", l.strand AS "Strand", pattern AS "Pattern", l.found_seq AS "Found_Sequence",
       location AS "Location", {_LABEL.replace('start', 'n.start').replace('strand', 'n.strand').replace('tss_n.strand', 'tss_strand')} AS "Distance_from_TSS", mismatches AS "Mismatches"
FROM {{loc}} l JOIN {{near}} n ON n.contig_id = l.contig_id AND n.start = l.start AND n.strand = l.strand""", **LOC_CTES, near=_TSS)
def _(fx):
    return intervals.enrich_with_tss(results_table(fx), fx.tss, **RADII)


@query("t1_enriched_batch", """
SELECT concat('file_', l.start % 7) AS file, count(*) AS rows, count(*) FILTER (WHERE l.start % 11 = 0) AS failed,
       CASE WHEN count(*) FILTER (WHERE l.start % 11 = 0) = count(*) THEN 'failed' ELSE 'success' END AS status,
       count(*) FILTER (WHERE l.start % 11 <> 0 AND tss_coord IS NOT NULL) AS with_tss
FROM {loc} l JOIN {near} n ON n.contig_id = l.contig_id AND n.start = l.start AND n.strand = l.strand GROUP BY 1""", **LOC_CTES, near=_TSS)
def _(fx):
    """What the folder stream does with a batch: reject, enrich, sum up by file."""
    rows = results_table(fx).withColumns({
        "file": F.concat(F.lit("file_"), F.col("Start") % 7), "Location": F.when(F.col("Start") % 11 != 0, F.col("Location"))})
    done, rejected = enrich.enrich_batch(rows, lambda df: intervals.enrich_with_tss(df, fx.tss, **RADII))
    found = done.select("file", F.lit(False).alias("bad"), (~F.col("Distance_from_TSS").startswith("No TSS")).alias("tss"))
    every = found.union(rejected.select("file", F.lit(True), F.lit(False)))
    return enrich.folder_summary(every, "bad").join(every.groupBy("file").agg(F.count_if("tss").alias("with_tss")), "file")


@query("j13_enrichment_counts", """
SELECT count(*) AS results, count(tss_coord) AS with_tss FROM {near}""", **HIT_CTES, near=_TSS)
def _(fx):
    return _near_tss(fx).agg(F.count(F.lit(1)).alias("results"), F.count("tss_coord").alias("with_tss"))


_REGIONS = """
SELECT accession, CASE WHEN regexp_matches(accession, 'NC_0000[0-9]{2}') THEN ltrim(regexp_extract(accession, 'NC_0000([0-9]{2})', 1), '0') END AS chrom,
       least(s_start, s_end) AS start, greatest(s_start, s_end) AS "end" FROM {blast}"""
_ANNOTATED = """
SELECT r.accession, r.chrom, r.start, r."end", CASE WHEN r.chrom IS NULL THEN 'Non-standard Chromosome/Contig'
  WHEN a.chrom IS NULL THEN 'Intergenic' WHEN n = 0 THEN 'Unnamed Gene Region' WHEN n = 1 THEN concat('[', names[1], ']Overlap')
  ELSE concat('[', names[1], ']-------[', names[2], ']') END AS annotation, n, names, held
FROM {regions} r LEFT JOIN (
  SELECT p.chrom, p.start, p."end", count(DISTINCT gene) AS n, list_sort(list(DISTINCT gene) FILTER (WHERE gene IS NOT NULL)) AS names,
         bool_or(g_start <= p.start AND g_end >= p."end") FILTER (WHERE gene IS NOT NULL) AS held
  FROM (SELECT DISTINCT chrom, start, "end" FROM {regions} WHERE chrom IS NOT NULL) p
  JOIN {chrom_genes} g ON g.chrom = p.chrom AND g.g_start <= p."end" AND g.g_end >= p.start
  GROUP BY p.chrom, p.start, p."end") a ON a.chrom = r.chrom AND a.start = r.start AND a."end" = r."end\""""


def _regions(fx):
    return intervals.normalized_interval(fx.blast, "s_start", "s_end").select(
        "accession", F.col("s_start").alias("start"), F.col("s_end").alias("end"))


@query("j14_region_annotation", 'SELECT accession, chrom, start, "end", annotation FROM {ann}', regions=_REGIONS, ann=_ANNOTATED)
def _(fx):
    return intervals.annotate_regions(_regions(fx), fx.chrom_genes).select("accession", "chrom", "start", "end", "annotation")


@query("j14_region_annotation_containment", """
SELECT accession, chrom, start, "end", CASE WHEN n = 1 AND held THEN concat('[', names[1], '](in)') ELSE annotation END AS annotation FROM {ann}""",
       regions=_REGIONS, ann=_ANNOTATED)
def _(fx):
    return intervals.annotate_regions(_regions(fx), fx.chrom_genes, containment=True).select(
        "accession", "chrom", "start", "end", "annotation")


@query("a6_annotation_counts", "SELECT annotation, count(*) AS n FROM {ann} GROUP BY annotation", regions=_REGIONS, ann=_ANNOTATED)
def _(fx):
    return intervals.annotate_regions(_regions(fx), fx.chrom_genes).groupBy("annotation").agg(F.count(F.lit(1)).alias("n"))


@query("f12_chromosome_from_accession", "SELECT accession, count(*) AS n, min(chrom) AS chrom FROM {regions} GROUP BY accession", regions=_REGIONS)
def _(fx):
    return fx.blast.groupBy("accession").agg(F.count(F.lit(1)).alias("n")).withColumn("chrom", intervals.chromosome("accession"))


@query("f13_interval_normalisation", """
SELECT accession, TRY_CAST(a AS BIGINT) AS s_start, TRY_CAST(b AS BIGINT) AS s_end FROM (
  SELECT accession, least(s_start, s_end) AS a, greatest(s_start, s_end) AS b, s_start FROM {blast}) WHERE s_start <> 7""")
def _(fx):
    text = fx.blast.select("accession", F.when(F.col("s_start") == 7, "n/a").otherwise(F.col("s_start").cast("string")).alias("s_start"),
                           F.col("s_end").cast("string").alias("s_end"))
    return intervals.normalized_interval(text, "s_start", "s_end")


@query("m8_duplex_report", f"""
SELECT "window" AS "Window", srna_start AS "Start", srna_end AS "End", gu_reported AS "Wobble", min(strand) AS "Strand", srna_seq AS "sRNA Sequence",
       target_seq AS "Target Sequence", concat(location, ' [', start, ',', "end", ']') AS "Location"
FROM (SELECT d.*, CASE
  WHEN n > 1 THEN names
  WHEN n = 1 AND gs <= d.start AND d."end" <= ge THEN concat(names, '(in)')
  WHEN n = 1 AND d.start <= gs AND ge <= d."end" THEN concat('<', gs - d.start, '>', names, '<', d."end" - ge, '>')
  WHEN n = 1 AND d.start < gs THEN concat('<', gs - d.start, '>', names)
  WHEN n = 1 THEN concat(names, '<', d."end" - ge, '>')
  WHEN left_gene IS NULL OR right_gene IS NULL THEN 'Intergenic'
  ELSE concat('[', left_gene, ']------[', right_gene, ']') END AS location
  FROM {{dup}} d JOIN {{near}} n ON n.contig_id = d.contig_id AND n.start = d.start AND n."end" = d."end" AND n.strand = d.strand)
GROUP BY contig_id, "window", srna_start, srna_end, gu_reported, srna_seq, target_seq, location, start, "end\"""",
       dup=_duplex_sql([8], 2), oriented=oriented([8]), hits='SELECT DISTINCT contig_id, start, "end", strand FROM {dup}', near=_NEAR)
def _(fx):
    kept = duplex.dedupe_duplex(duplex.duplex_hits(fx.contigs, _srna(fx), [8], 2))
    return duplex.duplex_table(intervals.overhang_location(kept, fx.genes))
