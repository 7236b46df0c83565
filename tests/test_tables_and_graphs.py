"""Sources and sinks on files, streaming, names, gene sets, tracks and graphs."""
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from strandwork.operators import classify, expression, genesets, graph, intervals, names, scan
from strandwork.sources import fasta, gff, json_cache, tables
from strandwork.streaming import enrich

RNG = random.Random(3)


def test_fasta_files(spark, tmp_path):
    p = tmp_path / "g.fa"
    p.write_text(">c1 first\nACGT\nacg\n>c2\nTTT\n>c1 first\nGG\n")
    assert [(r.contig_id, r.seq) for r in fasta.read_contigs(spark, str(p)).orderBy("record_no").collect()] == [
        ("c1", "ACGTACG"), ("c2", "TTT"), ("c1", "GG")]
    assert dict(fasta.read_queries(spark, str(p)).collect()) == {">c1 first": "GG", ">c2": "TTT"}
    seq = lambda policy: fasta.read_genomes(spark, str(p), policy).first().seq
    assert seq("all_headers") == "ACGTACGTTTGG" and seq("first_header") == "ACGTACG>C2TTT>C1FIRSTGG"
    q = tmp_path / "plain.txt"
    q.write_text("acgn\nTT\n")
    assert fasta.read_genomes(spark, str(q), "bases_only").first().seq == "ACGTT"
    h = tmp_path / "h.fa"
    h.write_text(">x [gene=dnaA] [locus_tag=b1] [location=complement(join(5..9,12..20))]\nACG\n>y [protein=z]\n>z [location=7..9]\n")
    got = {(r.name, r.locus_tag, r.g_start, r.g_end, r.strand) for r in fasta.read_annotations(spark, str(h)).collect()}
    assert got == {("dnaA", "b1", 5, 20, "-"), ("unknown", "N/A", 7, 9, "+")}


def test_gff_files(spark, tmp_path):
    p = tmp_path / "a.gff"
    p.write_text("##gff\n\nchr\tx\tgene\t5\t9\t.\t-\t.\tID=1;Name=abc;Alias=q\nchr\tx\tgene\t1\t2\t.\t+\t.\tID=2\nshort\tline\n"
                 'chr\tx\tTSS\t7\t7\t.\t+\t.\tID=t1;Note="Sigma: A;B, Resolution: 5, Based on: array, PubMed: 1, 2"\n')
    assert [(r.gene, r.g_start, r.g_end, r.strand) for r in gff.read_genes(spark, str(p)).collect()] == [("abc", 5, 9, "-")]
    t = gff.read_tss(spark, str(p)).first()
    assert (t.tss_id, t.coordinate, t.sigma_factor, t.resolution, t.data_source, t.pubmed_references) == ("t1", 7, "A", 5, "array", "1, 2")


def test_gene_tables_and_uploads(spark, tmp_path):
    genes = spark.createDataFrame([("a", 1, 9, "+", "ACG"), ("b,c", 4, 8, "-", None)], "gene string, g_start bigint, g_end bigint, strand string, sequence string")
    tables.write_gene_table(genes, str(tmp_path / "t"))
    assert sorted(map(tuple, tables.read_gene_table(spark, str(tmp_path / "t")).collect())) == sorted(map(tuple, genes.collect()))
    up = tmp_path / "up.csv"
    up.write_text("Gene ; log2FC;pval\na;1.5;0.1\n ; ; \nb;-2;NA\n")
    df = tables.read_upload(spark, str(up))
    roles = expression.resolve_roles(df.columns, expression.UPLOAD_ROLES, optional=("p",))
    assert roles == {"gene": "Gene", "log2fc": "log2FC", "p": "pval"} and df.count() == 2
    assert sorted(map(tuple, expression.clean_upload(df, "Gene", "log2FC", "pval").collect())) == [("a", 1.5, 0.1), ("b", -2.0, None)]
    with pytest.raises(ValueError):
        expression.resolve_roles(["x"], expression.UPLOAD_ROLES)
    assert tables.sniff_delimiter(["a|b", "c|d"]) == "|" and tables.sniff_delimiter(["abc", "d"]) == ","
    tsv = tmp_path / "e.tsv"
    tsv.write_text("geneName\tfc\tp\nx\t1\t0.01\n")
    assert tables.file_columns(spark, str(tsv)) == ["geneName", "fc", "p"] and tables.read_expression(spark, str(tsv)).count() == 1
    with pytest.raises(ValueError):
        tables.read_expression(spark, "book.xlsx")


def test_sinks(spark, tmp_path):
    hit = spark.createDataFrame([(1, 6, "+", "TAT", "TAT", "[a],[b]", 0)], "Start int, End int, Strand string, Pattern string, Found_Sequence string, Location string, Mismatches int")
    tables.write_results(hit, str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), header=True).first().Location == "[a],[b]"
    pred = classify.predict(spark.createDataFrame([("sigma",), ("yabC",)], "gene string"))
    tables.write_predictions(pred, str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p" / "json")).count() == 2 == spark.read.csv(str(tmp_path / "p" / "csv"), header=True).count()
    plots = tables.plot_tables({"one": (spark.createDataFrame([("a", 1.0, 0.01)], "g string, x double, p double"), {"gene_col": "g", "x_col": "x", "y_col": "p"})})
    tables.write_plots(plots, str(tmp_path / "plots"))
    back = tables.read_plots(spark, str(tmp_path / "plots")).first()
    assert back.plot_id == "one" and abs(back.y - 2) < 1e-9
    with pytest.raises(ValueError):
        tables.plot_tables({"one": (hit, {"gene_col": "g", "x_col": "x", "y_col": "p"})})


def test_json_files(spark, tmp_path):
    p = tmp_path / "genes.json"
    p.write_text(json.dumps({"zed": {"start": 5, "end": 9, "strand": "+", "sequence": "AC"}, "abc": {"start": 1, "end": 2}, "none": {"strand": "-"}}))
    assert [(r.gene, r.ordinal) for r in json_cache.read_gene_json(spark, str(p)).orderBy("ordinal").collect()] == [("zed", 0), ("abc", 1)]
    c = tmp_path / "cache.json"
    c.write_bytes(b"\xef\xbb\xbf" + json.dumps({"data": [{"id": 1, "name": "a"}, {"id": 2, "name": "b"}]}).encode())
    assert json_cache.read_cache(spark, str(c), "id bigint, name string").count() == 2
    assert json_cache.read_cache(spark, str(tmp_path / "missing.json"), "id bigint").count() == 0
    o = tmp_path / "o.txt"
    o.write_text("1 Metabolism\n1.2 Sugar use\n\nnote\n")
    assert [tuple(r) for r in json_cache.read_outline(spark, str(o)).orderBy("dot").collect()] == [("1", "Metabolism", 1, None), ("1.2", "Sugar use", 2, "1")]
    path = spark.createDataFrame([json.dumps({"id": "7", "name": "P", "genes": [{"name": "a"}], "enzymes": [{"gene": {"name": "b"}}],
                                              "reactions": [{"genes": [{"gene_name": "c"}], "enzymes": [{"gene_name": "a"}]}]})], "string")
    ref = "gene_name string, name string"
    gene, enz = f"array<struct<{ref}>>", f"array<struct<gene_name: string, gene: struct<name: string>>>"
    nested = json_cache.parse_cache(path, f"id string, name string, genes {gene}, enzymes {enz}, reactions array<struct<genes: {gene}, enzymes: {enz}>>")
    assert sorted(r.gene for r in genesets.pathways_from_json(nested).collect()) == ["a", "b", "c"]


def test_folder_stream(spark, tmp_path):
    folder, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    (tmp_path / "in").mkdir()
    head = "Start,End,Strand,Pattern,Found_Sequence,Location,Mismatches\n"
    (tmp_path / "in" / "a.csv").write_text(head + "100,105,+,P,ACG,[x](in),0\n")
    (tmp_path / "in" / "b.csv").write_text(head + "oops,105,+,P,ACG,[x](in),0\n")
    tss = spark.createDataFrame([(90, "+", "A", 0)], "coord bigint, strand string, sigma string, ordinal bigint")
    add = lambda df: intervals.enrich_with_tss(df, tss)
    enrich.enrich_folder(spark, folder, out, ck, add)
    (tmp_path / "in" / "c.csv").write_text(head + "50,55,-,P,ACG,[y](in),0\n")
    enrich.enrich_folder(spark, folder, out, ck, add)
    done = spark.read.parquet(out + "/enriched")
    assert {(r.Start, r.Distance_from_TSS) for r in done.collect()} == {(100, "TSS >>> 10 (σA)"), (50, "TSS >>> 40 (σA)[+]")}
    assert done.columns.index("Distance_from_TSS") == done.columns.index("Location") + 1
    rejected = spark.read.parquet(out + "/rejected").withColumn("bad", F.lit(True))
    assert rejected.count() == 1 and enrich.folder_summary(rejected, "bad").first().status == "failed"


def test_reconciliation_and_mapping(spark):
    syn = spark.createDataFrame([("a", "a1", 0), ("a", "a2", 1), ("b", "b1", 2), ("p", "c", 3)], "name string, synonym string, ordinal int")
    df = lambda *g: spark.createDataFrame([(x,) for x in g], "gene string")
    got = {r.gene: (r.status, r.uploaded_gene) for r in names.reconcile(df("a", "b", "c", "D"), df("A2", "x", "d"), syn).collect()}
    assert got == {"a": ("synonym", "A2"), "b": ("missing", None), "c": ("missing", None), "D": ("direct", None)}
    # The reverse match overrides the forward one.
    syn2 = syn.unionByName(spark.createDataFrame([("c", "f1", 4)], "name string, synonym string, ordinal int"))
    mapped = {r.cluster_gene: (r.plot_gene, r.kind) for r in names.map_name_sets(df("a", "c", "z", "x"), df("a2", "p", "f1", "x"), syn2).collect()}
    assert mapped == {"a": ("a2", "forward"), "c": ("p", "reverse"), "z": (None, None), "x": ("x", "direct")}


def test_track_overwrites(spark):
    spans = [(1, s, s + RNG.randint(0, 40), RNG.choice([-1.0, 0.0, 2.0, 3.5]), i) for i in range(60) for s in [RNG.randint(1, 280)]]
    vals = spark.createDataFrame(spans, "contig_id bigint, g_start bigint, g_end bigint, value double, ordinal bigint")
    base = {}
    for _, s, e, v, _ in spans:
        for x in range(s, min(e, 300) + 1):
            base[x] = v
    bins = scan.genome_bins(spark.createDataFrame([(1, 300)], "contig_id bigint, contig_len bigint"), 32)
    for r in expression.bin_means(vals, bins, 32).collect():
        v = [base[x] for x in range(r.bin_start, r.bin_end + 1) if base.get(x)]
        assert abs(r["mean"] - (sum(v) / len(v) if v else 0)) < 1e-9


def test_large_groups_stay_stars(spark):
    members = [(1, f"m{i}") for i in range(50)] + [(2, "m0"), (2, "x"), (3, "x"), (3, "y"), (3, "x")]
    df = spark.createDataFrame(members, "complex_id bigint, gene string")
    got = {tuple(r) for r in graph.clique_edges(df).collect()}
    assert ("m0", "group:2", "group:2") in got and ("group:3", "y", "group:3") in got and ("m0", "group:1", "group:1") in got and len(got) == 2 * 54
    pairs = {tuple(r) for r in graph.neighbours_of(df, spark.createDataFrame([("x",), ("m7",)], "gene string")).collect()}
    assert pairs == {("x", "m0"), ("x", "y")} | {("m7", f"m{i}") for i in range(50) if i != 7}
    centre = spark.createDataFrame([("y",), ("m7",)], "gene string")
    layers = {(r.centre, r.gene): r.layer for r in graph.neighbourhood(df, centre, 3).collect()}
    assert layers[("y", "m49")] == 3 and layers[("y", "m0")] == 2 and layers[("m7", "m8")] == 1 and layers[("m7", "y")] == 3
    mols = spark.createDataFrame([(i, f"p{i:03d}", "Protein") for i in range(60)], "id bigint, name string, type string")
    inter = spark.createDataFrame([(1, i) for i in range(30)] + [(2, i) for i in range(30)] + [(3, 1), (3, 2), (4, 5)], "interaction_id bigint, molecule_id bigint")
    cx = genesets.complexes_from_interactions(inter, mols)
    assert sorted(r["count"] for r in cx.groupBy("complex").count().collect()) == [2, 30]
    assert "Complex: p001 & p002" in {r.label for r in genesets.complex_labels(cx).collect()}


def test_paths_cycles_and_centrality(spark):
    edges = {(RNG.randint(0, 11), RNG.randint(0, 11)) for _ in range(26)} | {(3, 3)}
    e = spark.createDataFrame(sorted(edges), "src bigint, dst bigint")
    nbr = {n: [b for a, b in edges if a == n] for n in range(12)}

    def walks(path, depth):
        yield path
        if depth:
            for b in nbr[path[-1]]:
                if b not in path:
                    yield from walks(path + [b], depth - 1)

    nodes = [0, 3, 5, 9]
    every = {n: list(walks([n], 11)) for n in nodes}
    best = {}
    for a, b in itertools.combinations(nodes, 2):
        to = [w for w in every[a] if w[-1] == b]
        n = min(map(len, to), default=0)
        best[(a, b)] = [w for w in to if len(w) == n]
    for r in graph.shortest_paths(e, nodes).collect():
        want = best[(r.source, r.target)]
        assert r.n_paths == len(want) and r.direct == any(len(w) == 2 for w in want)
        assert (r.example_path or "") == (" -> ".join(map(str, min(want))) if want else "")
    inner = {}
    for w in itertools.chain(*best.values()):
        for v in w[1:-1]:
            inner[v] = inner.get(v, 0) + 1
    assert dict(graph.intermediate_counts(e, nodes).collect()) == inner
    assert {r.node for r in graph.path_nodes(e, nodes).collect()} == set(itertools.chain(*itertools.chain(*best.values())))
    loops = set()
    for n in nodes:
        for w in every[n]:
            if len(w) <= 5 and n in nbr[w[-1]]:
                k = w.index(min(w))
                loops.add(" -> ".join(map(str, w[k:] + w[:k])))
    assert {r.loop for r in graph.feedback_loops(e, nodes, 5).collect()} == loops
    line = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "a string, b string")
    got = {r.node: (r.betweenness, round(r.closeness, 4)) for r in graph.centrality(
        line, spark.createDataFrame([(x,) for x in "abcd"], "node string")).collect()}
    assert got == {"a": (0.0, 1.8333), "b": (4.0, 2.5), "c": (4.0, 2.5), "d": (0.0, 1.8333)}


def test_categories_stop_at_first_level_with_genes(spark):
    cats = spark.createDataFrame([(1, None, "1", "r"), (2, 1, "1.1", "m"), (3, 2, "1.1.1", "x"), (4, 1, "1.2", "n"), (5, 4, "1.2.10", "y"), (6, 4, "1.2.2", "z")],
                                 "id bigint, parent_id bigint, dot string, name string")
    own = spark.createDataFrame([(2, "a"), (3, "hidden"), (5, "b"), (6, "b"), (6, "c")], "category_id bigint, gene string")
    full = genesets.category_genes(cats, own)
    got = {(r.category_id, r.gene) for r in full.collect()}
    assert got == {(2, "a"), (3, "hidden"), (5, "b"), (6, "b"), (6, "c"), (4, "b"), (4, "c"), (1, "a"), (1, "b"), (1, "c")}
    tree = genesets.hierarchy_rows(cats, full)
    assert [r.dot for r in genesets.children_of(tree, 4).collect()] == ["1.2.10", "1.2.2"]
    assert [r.dot for r in genesets.in_tree_order(tree).collect()] == ["1", "1.1", "1.1.1", "1.2", "1.2.2", "1.2.10"]


def test_searches_end_by_themselves(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(20)], "src long, dst long")
    row = graph.shortest_paths(chain, [0, 20]).first()
    assert (row.dist, row.n_paths) == (20, 1)
    assert graph.path_nodes(chain, [0, 20]).count() == 21
    groups = spark.createDataFrame([(k, f"g{k + j}") for k in range(12) for j in (0, 1)], "complex_id long, gene string")
    centre = spark.createDataFrame([("g0",)], "gene string")
    assert graph.neighbourhood(groups, centre, 10).agg({"layer": "max"}).first()[0] == 10


def test_deep_and_cyclic_categories(spark):
    tree = spark.createDataFrame([(k, k - 1 if k else None) for k in range(20)], "id long, parent_id long")
    own = spark.createDataFrame([(19, "g")], "category_id long, gene string")
    assert genesets.category_genes(tree, own).count() == 20
    ring = spark.createDataFrame([(k, (k + 1) % 3) for k in range(3)] + [(9, 0)], "id long, parent_id long")
    with pytest.raises(ValueError):
        genesets.category_genes(ring, spark.createDataFrame([(9, "g")], own.schema))
