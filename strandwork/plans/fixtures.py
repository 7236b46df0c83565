"""Genomics-shaped views over the provided tables.

One SQL text per view serves Spark and DuckDB; only the regex-replace flag differs.
Placeholders such as {orders} are tables or earlier views. Lines of an order are not unique in
(order, line number), so row numbers carry the values that decide ties.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

VIEWS = {
    "contigs": """
SELECT doc_id AS contig_id, regexp_replace(upper(text), '[^ACGT]', ''$g) AS seq FROM {documents}""",
    "genes": """
SELECT o_orderkey % (SELECT count(*) FROM {documents}) AS contig_id, concat('g', o_orderkey) AS gene,
       1 + (o_custkey * 53) % 600 AS g_start, 1 + (o_custkey * 53) % 600 + 20 + o_custkey % 40 AS g_end,
       CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand, o_orderkey AS ordinal
FROM {orders}""",
    "tss": """
SELECT event_id % (SELECT count(*) FROM {documents}) AS contig_id, 1 + (user_id * 37 + event_id) % 600 AS coord,
       CASE WHEN event_id % 3 = 0 THEN '-' ELSE '+' END AS strand,
       CASE event_type WHEN 'error' THEN 'Unknown' ELSE upper(substr(event_type, 1, 1)) END AS sigma,
       event_id AS ordinal
FROM {events}""",
    "expression": """
SELECT concat(CASE WHEN l_linenumber = 1 THEN 'G' ELSE 'g' END, l_orderkey) AS gene,
       round((l_discount - 0.05) * 40, 6) AS log2fc, l_tax AS p,
       (((l_orderkey * 8 + l_linenumber) * 10000 + l_partkey % 10000) * 100 + CAST(round(l_discount * 100) AS BIGINT)) * 100 + CAST(round(l_tax * 100) AS BIGINT) AS row_no
FROM {lineitem}""",
    # Fold changes on coordinates; later rows overwrite earlier ones of the same gene.
    "gene_values": """
SELECT contig_id, g.gene, g_start, g_end, strand, round((l_discount - 0.05) * 40, 6) AS value, l_returnflag AS dataset,
       ((l_orderkey * 8 + l_linenumber) * 10000 + l_partkey % 10000) * 100 + CAST(round(l_discount * 100) AS BIGINT) AS ordinal
FROM {lineitem} JOIN {genes} g ON g.gene = concat('g', l_orderkey)""",
    # An upload before cleaning: blank genes, blank and unreadable numbers, null tokens.
    "upload": """
SELECT CASE WHEN l_linenumber = 7 THEN ' ' ELSE concat(' ', CASE l_returnflag WHEN 'A' THEN 'Syn' ELSE 'g' END, l_orderkey) END AS gene_text,
       CASE l_linenumber WHEN 6 THEN '' WHEN 5 THEN 'abc' ELSE CAST(l_quantity AS VARCHAR) END AS fc_text,
       CASE WHEN l_linestatus = 'O' THEN 'NA' WHEN l_linenumber = 4 THEN 'low' ELSE CAST(l_tax AS VARCHAR) END AS p_text,
       ((l_orderkey * 8 + l_linenumber) * 10000 + l_partkey % 10000) * 100 + CAST(l_quantity AS BIGINT) AS row_no
FROM {lineitem}""",
    "cluster_names": """
SELECT DISTINCT gene FROM {clusters} UNION SELECT concat('Syn', o_orderkey) FROM {orders} WHERE o_orderstatus = 'P'""",
    "alias_rows": """
SELECT concat('g', o_orderkey) AS name, concat('Syn', o_orderkey) AS s1, concat('BSU', o_orderkey) AS subtilist,
       CASE WHEN o_orderstatus = 'O' THEN concat('G', o_orderkey, '_x_1') END AS browser, o_orderkey AS ordinal FROM {orders}""",
    "raw_complexes": """
SELECT concat('cx', o_orderkey) AS name, CASE substr(o_orderpriority, 1, 1)
    WHEN '1' THEN concat('["g', o_orderkey, '","g', o_custkey, '","g', o_custkey, '"]')
    WHEN '2' THEN concat(chr(123), '"genes":["g', o_custkey, '"]', chr(125))
    WHEN '3' THEN concat(chr(123), '"members":["g', o_orderkey, '","m', o_custkey, '"]', chr(125))
    WHEN '4' THEN concat('g', o_custkey) END AS value FROM {orders}""",
    "regulon_text": """
SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN concat('Kind: ', p_type, '; Function: ', p_name, ' ; end')
       WHEN p_size % 3 = 1 THEN concat(p_name, '; second part') ELSE '' END AS description FROM {part}""",
    "memberships": """
SELECT DISTINCT concat('cat_', l_suppkey % 12) AS category, concat('g', l_orderkey) AS gene FROM {lineitem}""",
    "categories": """
SELECT r_regionkey + 1 AS id, CAST(NULL AS INT) AS parent_id, CAST(r_regionkey + 1 AS VARCHAR(20)) AS dot, r_name AS name
FROM {region}
UNION ALL
SELECT 100 + n_nationkey, n_regionkey + 1, concat(n_regionkey + 1, '.', n_nationkey + 1), n_name FROM {nation}
UNION ALL
SELECT 1000 + c_custkey, 100 + c_nationkey, concat(n_regionkey + 1, '.', n_nationkey + 1, '.', c_custkey + 1), c_name
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    # Genes filed under a category: every customer's orders, except that nations 0-2 also hold genes directly.
    "category_genes": """
SELECT 1000 + o_custkey AS category_id, concat('g', o_orderkey) AS gene, o_orderkey AS ordinal FROM {orders}
UNION ALL
SELECT 100 + c_nationkey, concat('g', o_orderkey), o_orderkey FROM {orders} JOIN {customer} ON o_custkey = c_custkey
WHERE c_nationkey <= 2""",
    "complexes": """
SELECT l_orderkey AS complex_id, concat('p', l_partkey) AS gene FROM {lineitem}""",
    "molecules": """
SELECT p_partkey AS id, concat('p', p_partkey) AS name,
       CASE WHEN p_size % 5 = 0 THEN 'Metabolite' ELSE 'Protein' END AS type FROM {part}""",
    "interactions": """
SELECT l_orderkey AS interaction_id, l_partkey AS molecule_id FROM {lineitem}""",
    "regulations": """
SELECT o_custkey AS src,
       CASE WHEN o_orderstatus = 'P' THEN NULL
            ELSE (o_orderkey * 31 + o_custkey * 7) % (SELECT count(*) FROM {customer}) END AS dst,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'positive' WHEN '2' THEN 'negative' END AS mode,
       CASE substr(o_orderpriority, 1, 1) WHEN '3' THEN 'sigma' ELSE NULL END AS effect,
       CASE WHEN o_orderstatus = 'F' THEN 'binding' END AS mechanism, o_orderkey AS ordinal
FROM {orders}""",
    "supplier_links": """
SELECT concat('s', s_suppkey) AS a, concat('s', (s_suppkey * 7 + 3) % (SELECT count(*) FROM {supplier})) AS b FROM {supplier}
UNION ALL
SELECT concat('s', s_suppkey), concat('s', (s_suppkey * 3 + s_nationkey) % (SELECT count(*) FROM {supplier})) FROM {supplier}""",
    "gene_ids": """
SELECT o_orderkey + 1 AS id, concat('g', o_orderkey) AS name FROM {orders}""",
    "synonyms": """
SELECT concat('g', o_orderkey) AS name, concat('Syn', o_orderkey) AS synonym, o_orderkey AS ordinal
FROM {orders} WHERE o_orderpriority = '1-URGENT'""",
    # Names as they come in uploads: primary, upper case, synonym or unknown.
    "raw_names": """
SELECT CASE event_type WHEN 'click' THEN concat('g', event_id) WHEN 'view' THEN concat('G', event_id)
            WHEN 'error' THEN concat('zz', event_id) ELSE concat('sYN', event_id) END AS raw, event_id AS row_no
FROM {events}""",
    "plot_genes": """
SELECT DISTINCT CASE WHEN p_size % 3 = 0 THEN concat('Syn', p_partkey) WHEN p_size % 3 = 1 THEN concat('g', p_partkey)
                     ELSE concat('G', p_partkey) END AS gene FROM {part}""",
    "clusters": """
SELECT concat('g', o_orderkey) AS gene, concat(substr('ABC', CAST(1 + o_custkey % 3 AS INT), 1), o_custkey % 20) AS cluster
FROM {orders}""",
    "cluster_genes": "SELECT DISTINCT gene FROM {clusters}",
    "pathways": """
SELECT DISTINCT p_brand AS pathway_id, concat('Pathway ', p_brand) AS name FROM {part}""",
    "pathway_members": """
SELECT p_brand AS pathway_id, concat('g', l_orderkey) AS gene,
       CASE l_returnflag WHEN 'A' THEN 'gene' WHEN 'R' THEN 'enzyme' ELSE 'reaction' END AS via
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "metabolite_links": """
SELECT l_suppkey AS metabolite_id, s_name AS metabolite_name,
       CASE l_returnflag WHEN 'A' THEN 'Transport' WHEN 'R' THEN 'Cofactor' ELSE 'Binding' END AS type,
       CASE WHEN l_returnflag = 'A' THEN CASE l_linestatus WHEN 'O' THEN 'Import' ELSE 'Export' END END AS transport_type,
       CASE WHEN l_linenumber <= 3 THEN l_orderkey + 1 END AS gene_id, l_orderkey AS protein_id
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey""",
    "protein_genes": """
SELECT o_orderkey AS protein_id, o_orderkey + 1 AS gene_id FROM {orders} WHERE o_orderstatus <> 'P'""",
    "metabolite_categories": """
SELECT s_suppkey AS metabolite_id, s_nationkey AS category_id FROM {supplier}
UNION ALL
SELECT s_suppkey, 1000 + n_regionkey FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    "blast": """
SELECT CASE WHEN l_orderkey % 11 = 0 THEN concat('NT_', l_orderkey)
            ELSE concat('NC_0000', lpad(CAST(1 + l_orderkey % 22 AS VARCHAR(2)), 2, '0'), '.1') END AS accession,
       CASE WHEN l_linenumber % 2 = 0 THEN l_partkey ELSE l_partkey + 30 END AS s_start,
       CASE WHEN l_linenumber % 2 = 0 THEN l_partkey + 30 ELSE l_partkey END AS s_end
FROM {lineitem}""",
    # Chromosome gene table for the blast view; every seventh gene has no name.
    "chrom_genes": """
SELECT CAST(1 + o_orderkey % 22 AS VARCHAR(5)) AS chrom,
       CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE concat('h', o_orderkey) END AS gene,
       o_custkey * 3 AS g_start, o_custkey * 3 + 5 + o_orderkey % 60 AS g_end FROM {orders}""",
}


def _refs(text: str) -> list[str]:
    return sorted(set(re.findall(r"\{([a-z]\w*)\}", text)))


class Fixtures:
    """Lazy DataFrames for the tables of one folder and the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in VIEWS and name not in TABLES):
            raise AttributeError(name)
        if name not in self._made:
            if name in TABLES:
                made = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name == "contigs":
                # A test table is one file; contigs of real genomes come in pieces (`fasta.read_pieces`), which every task reads.
                made = self.sql(VIEWS[name], documents=self.documents.repartition("doc_id"))
            else:
                made = self.sql(VIEWS[name])
            self._made[name] = made
        return self._made[name]

    def sql(self, text: str, **given: DataFrame) -> DataFrame:
        text = text.replace("$g", "").replace("VARCHAR(20)", "STRING").replace("VARCHAR(5)", "STRING") \
            .replace("VARCHAR(2)", "STRING").replace("VARCHAR", "STRING")
        return self.spark.sql(text, **{r: given.get(r) or getattr(self, r) for r in _refs(text)})


def duckdb(text: str, **ctes: str) -> str:
    """Oracle SQL: `text` with the views it names by {view} spelled out as CTEs.

    `ctes` are extra named queries that `text` may use in the same way.
    """
    known = VIEWS | ctes
    order: list[str] = []

    def visit(body: str) -> None:
        for ref in _refs(body):
            if ref in known and ref not in order:
                visit(known[ref])
                order.append(ref)

    visit(text)
    plain = lambda s: re.sub(r"\{([a-z]\w*)\}", r"\1", s.replace("$g", ", 'g'"))
    heads = [f"{n} AS MATERIALIZED ({plain(known[n]).strip()})" for n in order]
    body = plain(text).strip()
    if not heads:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ",\n".join(heads) + ",\n" + body[len("WITH RECURSIVE"):].lstrip()
    if body.upper().startswith("WITH"):
        return "WITH " + ",\n".join(heads) + ",\n" + body[len("WITH"):].lstrip()
    return "WITH " + ",\n".join(heads) + "\n" + body
