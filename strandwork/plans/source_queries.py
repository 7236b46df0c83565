"""Registered queries over sources, fed with text that Spark derives from the tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import expression as X
from ..sources import fasta, gff, json_cache, tables
from ..streaming import enrich
from .registry import query

TAB = "chr(9)"


@query("s1_fasta_contigs", f"""
SELECT concat('contig', doc_id, ' source=', source) AS header, concat('contig', doc_id) AS contig_id, doc_id AS record_no,
       upper(concat(a, 'acgtu', b)) AS seq FROM {{clean}}""",
       clean="""SELECT *, regexp_replace(replace(substr(t, 1, 40), ' ', ''), '\\s', ''$g) AS a, regexp_replace(substr(t, 41), '\\s', ''$g) AS b
                FROM (SELECT doc_id, source, regexp_replace(text, '[^A-Za-z \\n]', ''$g) AS t FROM documents)""")
def _(fx):
    docs = fx.documents.withColumn("text", F.regexp_replace("text", r"[^A-Za-z \n]", ""))
    value = F.concat(F.lit("contig"), "doc_id", F.lit(" source="), "source", F.lit("\n"),
                     F.translate(F.substring("text", 1, 40), " \n", ""), F.lit("\nacgtu\n"), F.expr("substr(text, 41)"))
    return fasta.parse_contigs(docs.select(value.alias("value"), F.col("doc_id").alias("record_no")))


for _policy, _sql in {
    "first_header": "upper(regexp_replace(concat(t, '>h2 x', t), '\\s', '', 'g'))",
    "all_headers": "upper(regexp_replace(concat(t, t), '\\s', '', 'g'))",
    "bases_only": "regexp_replace(upper(concat(t, t)), '[^ACGTU]', '', 'g')",
}.items():
    @query(f"s1_genome_text_{_policy}", f"SELECT doc_id, {_sql} AS seq FROM {{t}}",
           t="SELECT doc_id, regexp_replace(text, '[^A-Za-z \\n]', ''$g) AS t FROM documents")
    def _(fx, policy=_policy):
        t = F.regexp_replace("text", r"[^A-Za-z \n]", "")
        value = F.concat(F.lit(">h1\n"), t, F.lit("\n>h2 x\n"), t)
        return fx.documents.select("doc_id", value.alias("value")).select("doc_id", fasta.genome_text(policy).alias("seq"))


@query("s2_fasta_queries", """
SELECT concat('>q', o_custkey) AS query, arg_max(upper(concat('tata', o_orderstatus, o_orderkey)), o_orderkey) AS pattern FROM orders GROUP BY o_custkey""")
def _(fx):
    rec = fx.orders.select(F.concat(F.lit("q"), "o_custkey", F.lit("\ntata\n"), "o_orderstatus", "o_orderkey").alias("value"),
                           F.col("o_orderkey").alias("record_no"))
    return fasta.parse_queries(rec)


def _headers(fx):
    return fx.sql("""
SELECT concat('>lcl|', o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '' ELSE concat(' [gene=g', o_custkey, ']') END,
   CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE concat(' [locus_tag=b', o_orderkey, ']') END,
   CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN ' [protein=x]' WHEN o_orderstatus = 'O' THEN concat(' [location=complement(join(', o_custkey, '..', o_custkey + 30, ',', o_custkey + 40, '..', o_custkey + 90, '))]')
   ELSE concat(' [location=', o_custkey, '..', o_custkey + 60, ']') END) AS value, o_orderkey AS ordinal FROM {orders}""")


ANNOTATED = """
SELECT CASE WHEN o_orderstatus = 'F' THEN 'unknown' ELSE concat('g', o_custkey) END AS name,
       CASE WHEN o_orderpriority = '5-LOW' THEN 'N/A' ELSE concat('b', o_orderkey) END AS locus_tag, o_custkey AS g_start,
       CASE WHEN o_orderstatus = 'O' THEN o_custkey + 90 ELSE o_custkey + 60 END AS g_end,
       CASE WHEN o_orderstatus = 'O' THEN '-' ELSE '+' END AS strand, o_orderkey AS ordinal FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED'"""


@query("s3_fasta_header_annotations", ANNOTATED)
def _(fx):
    return fasta.parse_annotations(_headers(fx))


@query("s3_annotations_by_locus", """
SELECT name, locus_tag, g_start, g_end, strand, ordinal FROM (
  SELECT *, row_number() OVER (PARTITION BY locus_tag ORDER BY g_start DESC, ordinal DESC) AS r FROM {ann}) WHERE r = 1""", ann=ANNOTATED)
def _(fx):
    return fasta.parse_annotations(_headers(fx), key_by_locus=True)


def _gff_lines(fx):
    return fx.sql(f"""
SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN concat('# note ', o_orderkey) WHEN o_orderpriority = '2-HIGH' THEN concat('short', {TAB}, 'line') ELSE
  concat_ws({TAB}, concat('chr', o_custkey % 5), 'src', CASE WHEN o_orderstatus = 'P' THEN 'CDS' ELSE 'gene' END, o_custkey, o_custkey + 50, '.',
    CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END, '.', concat('ID=x', o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE concat(';Name=g', o_orderkey, ';gbkey=Gene') END)) END AS value,
  o_orderkey AS ordinal FROM {{orders}}""")


@query("s4_gff_genes", """
SELECT concat('chr', o_custkey % 5) AS contig_id, concat('g', o_orderkey) AS gene, o_custkey AS g_start, o_custkey + 50 AS g_end,
       CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand, o_orderkey AS ordinal FROM orders
WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '5-LOW') AND o_orderstatus <> 'P'""")
def _(fx):
    return gff.parse_genes(_gff_lines(fx))


@query("s5_gff_tss", """
SELECT concat('t', event_id) AS tss_id, 'chr1' AS chromosome, event_id * 3 + 1 AS coordinate, CASE WHEN event_id % 3 = 0 THEN '-' ELSE '+' END AS strand,
       CASE event_type WHEN 'click' THEN 'A' WHEN 'view' THEN '?' ELSE 'E' END AS sigma_factor,
       CASE WHEN event_type <> 'view' THEN CAST(user_id AS INT) END AS resolution, 'array data' AS data_source, '123, 456' AS pubmed_references, event_id AS ordinal
FROM events WHERE event_type <> 'error'""")
def _(fx):
    lines = fx.sql(f"""
SELECT concat_ws({TAB}, 'chr1', 'db', 'TSS', event_id * 3 + 1, event_id * 3 + 1, '.', CASE WHEN event_id % 3 = 0 THEN '-' ELSE '+' END, '.',
  concat('ID=t', event_id, ';Note="', CASE event_type WHEN 'click' THEN 'Sigma: A, ' WHEN 'view' THEN 'Sigma: ?, ' WHEN 'error' THEN 'none ' ELSE 'Sigma: E;F, ' END,
    CASE WHEN event_type <> 'view' THEN concat('Resolution: ', user_id, ', ') ELSE '' END, 'Based on: array data, PubMed: 123, 456"')) AS value, event_id AS ordinal FROM {{events}}""")
    return gff.parse_tss(lines)


@query("s6_gene_json", """
SELECT doc, concat('g', o_orderkey) AS gene, o_custkey AS g_start, o_custkey + 9 AS g_end, '+' AS strand, 'ACGT' AS sequence, 0 AS ordinal
FROM (SELECT *, o_orderkey AS doc FROM orders) WHERE o_orderstatus <> 'P'
UNION ALL SELECT o_orderkey, concat('h', o_orderkey), o_custkey + 5, o_custkey + 20, '-', NULL, 1 FROM orders""")
def _(fx):
    start = F.when(F.col("o_orderstatus") != "P", F.format_string('"start":%d,', "o_custkey")).otherwise("")
    value = F.concat(F.lit("{"), F.format_string('"g%d":{', "o_orderkey"), start,
                     F.format_string('"end":%d,"strand":"+","sequence":"ACGT"},"h%d":{"start":%d,"end":%d,"strand":"-"}}',
                                     F.col("o_custkey") + 9, "o_orderkey", F.col("o_custkey") + 5, F.col("o_custkey") + 20))
    return json_cache.parse_gene_json(fx.orders.select(F.col("o_orderkey").alias("doc"), value.alias("value")))


@query("s8_blank_rows", "SELECT gene_text, fc_text FROM {upload} WHERE trim(gene_text) <> '' OR trim(fc_text) <> ''")
def _(fx):
    return tables.drop_blank_rows(fx.upload.select("gene_text", "fc_text"))


@query("s9_column_roles", "SELECT gene_text AS gene, fc_text AS log2fc, p_text AS p FROM {upload}")
def _(fx):
    df = fx.upload.select(F.col("gene_text").alias("Gene_Name"), F.col("fc_text").alias("my Log2FC"), F.col("p_text").alias("adj P_value"), "row_no")
    roles = X.resolve_roles(df.columns, X.UPLOAD_ROLES, optional=("p",))
    return df.select(*[F.col(f"`{c}`").alias(r) for r, c in roles.items()])


@query("s11_json_cache", """
SELECT o_orderkey AS doc, o_custkey AS id, concat('n', o_custkey) AS name FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT o_orderkey, k, concat('n', k) FROM (SELECT o_orderkey, unnest([o_custkey, o_custkey + 1]) AS k FROM orders WHERE o_orderstatus = 'F')""")
def _(fx):
    item = lambda c: F.format_string('{"id":%d,"name":"n%d"}', c, c)
    k = F.col("o_custkey")
    value = F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("﻿"), item(k))).when(
        F.col("o_orderstatus") == "F", F.concat(F.lit('{"data":['), item(k), F.lit(","), item(k + 1), F.lit("]}"))).otherwise('{"id": 3, "na')
    return json_cache.parse_cache(fx.orders.select(F.col("o_orderkey").alias("doc"), value.alias("value")), "id bigint, name string").where("id IS NOT NULL")


@query("s12_outline", """
SELECT dot, name, len(string_split(dot, '.')) AS level, CASE WHEN strpos(dot, '.') > 0 THEN regexp_replace(dot, '\\.[^.]+$', '') END AS parent_dot FROM {categories}""")
def _(fx):
    lines = fx.categories.select(F.concat("dot", F.lit(" "), "name", F.lit("  ")).alias("value"))
    noise = fx.region.select(F.concat(F.lit("see "), "r_name").alias("value"))
    return json_cache.parse_outline(lines.unionByName(noise))


@query("s13_gene_name_list", "SELECT raw AS gene FROM {raw_names}")
def _(fx):
    return tables.parse_name_list(fx.raw_names.select(F.concat(F.lit(" "), "raw", F.lit(" ")).alias("value")))


@query("s14_result_table", """
SELECT contig_id AS "Start", g_end AS "End", strand AS "Strand", gene AS "Pattern", 'ACGT' AS "Found_Sequence", concat('[', gene, '](in)') AS "Location", 0 AS "Mismatches" FROM {genes}""")
def _(fx):
    g = fx.genes
    rows = g.select(F.lit(0).alias("Mismatches"), F.col("contig_id").alias("Start"), F.col("g_end").alias("End"), F.col("strand").alias("Strand"),
                    F.col("gene").alias("Pattern"), F.lit("ACGT").alias("Found_Sequence"), F.concat(F.lit("["), "gene", F.lit("](in)")).alias("Location"), "ordinal")
    return tables.result_table(rows)


@query("s17_plot_tables", """
SELECT gene, log2fc AS x, p, round(-log10(p), 6) AS y, 'one' AS plot_id FROM {expression} WHERE p > 0
UNION ALL SELECT gene, value, g_end, round(-log10(g_end), 6), 'two' FROM {gene_values}""")
def _(fx):
    both = tables.plot_tables({
        "one": (fx.expression, {"gene_col": "gene", "x_col": "log2fc", "y_col": "p"}),
        "two": (fx.gene_values.withColumn("g_end", F.col("g_end").cast("double")), {"gene_col": "gene", "x_col": "value", "y_col": "g_end"}),
    })
    return both.select("gene", "x", "p", F.round("y", 6).alias("y"), "plot_id")


@query("s18_plot_gene_names", "SELECT gene FROM {plot_genes} UNION SELECT gene FROM {clusters}")
def _(fx):
    return tables.plot_gene_names([fx.plot_genes.withColumnRenamed("gene", "geneName"), fx.clusters.withColumnRenamed("gene", "geneName"),
                                   fx.region])


def _payload(fx):
    return fx.customer.select(
        (F.col("c_custkey") + 1000).alias("id"), F.col("c_name").alias("name"), F.concat(F.lit("1."), "c_custkey").alias("dot_notation"),
        (F.col("c_nationkey") + 100).cast("bigint").alias("parent_id"),
        F.array(F.struct(F.col("c_custkey").alias("id"), F.concat(F.lit("g"), "c_custkey").alias("name")),
                F.struct(F.lit(0).cast("bigint").alias("id"), F.lit(None).cast("string").alias("name"))).alias("genes"),
        F.array(F.struct((F.col("c_custkey") + 1).alias("id"))).alias("children"))


@query("a25_category_members", "SELECT c_name AS category, concat('g', c_custkey) AS gene FROM customer")
def _(fx):
    return json_cache.category_members(_payload(fx))


@query("a25_category_details", "SELECT 1000 + c_custkey AS id, c_name AS name, concat('1.', c_custkey) AS dot_notation, 100 + c_nationkey AS parent_id, 2 AS gene_count, c_custkey + 1 AS child FROM customer")
def _(fx):
    return json_cache.category_details(_payload(fx)).select("id", "name", "dot_notation", "parent_id", "gene_count", F.col("children_ids")[0].alias("child"))


@query("a26_folder_summary", """
SELECT concat('file_', user_id) AS file, count(*) AS rows, count(*) FILTER (WHERE event_type = 'error') AS failed,
       CASE WHEN count(*) FILTER (WHERE event_type = 'error') = count(*) THEN 'failed' ELSE 'success' END AS status FROM events GROUP BY user_id""")
def _(fx):
    rows = fx.events.select(F.concat(F.lit("file_"), "user_id").alias("file"), (F.col("event_type") == "error").alias("bad"))
    return enrich.folder_summary(rows, "bad")


@query("s7_gene_table", """
SELECT concat('g', o_orderkey) AS gene, o_custkey AS g_start, o_custkey + 50 AS g_end, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'ACGT' END AS sequence FROM orders WHERE o_orderkey % 10 <> 9""")
def _(fx):
    lines = fx.sql("""SELECT CASE WHEN o_orderkey % 10 = 9 THEN 'Gene,Start,End,Strand,Sequence' ELSE concat('g', o_orderkey, ',', o_custkey, ',', o_custkey + 50, ',',
        CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END, ',', CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '"ACGT"' END) END AS value FROM {orders}""")
    return tables.parse_gene_table(lines)


_SEPARATOR = "CASE o_orderkey % 5 WHEN 0 THEN ',' WHEN 1 THEN chr(9) WHEN 2 THEN ';' WHEN 3 THEN '|' ELSE '' END"


@query("s8_sniffed_delimiter", f"SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 5 = 4 THEN ',' ELSE {_SEPARATOR} END AS delimiter FROM orders")
def _(fx):
    lines = fx.sql(f"""SELECT o_orderkey, array(concat('gene', d, 'fc', d, 'p'), '  ', concat(o_custkey, d, '1.5', d, '0.1'),
        CASE WHEN o_orderkey % 7 = 0 THEN concat('x', d, 'y', d, 'z', d) ELSE '' END) AS lines FROM (SELECT *, {_SEPARATOR} AS d FROM {{orders}})""")
    return lines.select("o_orderkey", tables.delimiter_of(F.col("lines")).alias("delimiter"))


@query("s10_file_columns", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL WHEN 0 THEN concat('gene|c', o_custkey, chr(9), 'p') ELSE concat('gene,c', o_custkey, '|p') END AS columns FROM orders""")
def _(fx):
    files = fx.sql("""SELECT o_orderkey, concat('f', o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '.csv' WHEN 1 THEN '.TSV' WHEN 2 THEN '.txt' ELSE '.xls' END) AS file,
        concat('gene,c', o_custkey, chr(9), 'p') AS header FROM {orders}""")
    return files.select("o_orderkey", F.array_join(tables.header_columns(F.col("file"), F.col("header")), "|").alias("columns"))
