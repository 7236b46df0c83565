"""Pointer doubling, loops from half paths, closeness sketches, name postings, alignment of long pairs, repeated keys."""
import json
import os
import random
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from strandwork.operators import align, cover, duplex, genesets, graph, hierarchy, intervals, names, scan
from strandwork.sources import json_cache

RNG = random.Random(11)
CATEGORY = "id bigint, parent_id bigint, name string"


def test_parent_chains(spark):
    parents = {n: RNG.choice([None, 999, *range(max(1, n - 3), n)]) if n > 1 else None for n in range(1, 60)}
    rows = [(n, p, f"c{n}") for n, p in parents.items()]
    want = set()
    for n in parents:
        chain = [n]
        while parents[chain[-1]] in parents:
            chain.append(parents[chain[-1]])
        want |= {(n, i, a, f"c{a}") for i, a in enumerate(reversed(chain), 1)}
    cats = spark.createDataFrame(rows, CATEGORY)
    assert {tuple(r) for r in hierarchy.root_paths_by_parent(cats).collect()} == want
    assert {tuple(r) for r in hierarchy.roots(cats).collect()} == {
        (n, min(w for w in want if w[0] == n)[2], max(w[1] for w in want if w[0] == n)) for n in parents}
    assert hierarchy.root_paths_by_parent(cats.limit(0)).count() == 0


def test_long_chains_and_rings(spark):
    chain = spark.range(2, 201).select("id", (F.col("id") - 1).alias("parent_id"))
    assert len(hierarchy._jumps(chain)) == 8
    up = hierarchy.ancestors(chain, spark.createDataFrame([(200,)], "id bigint"))
    got = up.agg(F.count("*").alias("n"), F.countDistinct("ancestor").alias("k"), F.max("distance").alias("d")).first()
    assert tuple(got) == (200, 200, 199) and up.where(F.col("ancestor") + F.col("distance") != 200).isEmpty()
    ring = spark.createDataFrame([(1, 2, "a"), (2, 3, "b"), (3, 1, "c"), (4, 1, "d")], CATEGORY)
    with pytest.raises(ValueError, match="cyclic"):
        hierarchy.root_paths_by_parent(ring)


def plain_loops(edges, nodes, most):
    found = set()

    def walk(path):
        for s, d in edges:
            if s != path[-1]:
                continue
            if d == path[0]:
                low = path.index(min(path))
                found.add((len(path), " -> ".join(map(str, path[low:] + path[:low]))))
            elif d not in path and len(path) < most:
                walk([*path, d])

    for n in nodes:
        walk([n])
    return found


def test_loops_from_half_paths(spark):
    for most in (1, 5):
        edges = {(RNG.randrange(9), RNG.randrange(9)) for _ in range(24)} | {(1, 1), (20, 1), (21, 20)}
        df = spark.createDataFrame(sorted(edges), "src bigint, dst bigint")
        assert {tuple(r) for r in graph.feedback_loops(df, [1, 4, 77], most).collect()} == plain_loops(edges, [1, 4], most)
    tree = spark.createDataFrame([(n // 2, n) for n in range(2, 40)], "src bigint, dst bigint")
    assert graph.feedback_loops(tree, [1, 2], 12).count() == 0


def test_half_paths_stay_in_the_component(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), *[(2, 10 + n) for n in range(30)], *[(50 + n, 0) for n in range(30)]], "src bigint, dst bigint")
    made = []
    plain = graph._half_paths
    graph._half_paths = lambda *a: made.append(plain(*a)) or made[-1]
    try:
        assert [tuple(r) for r in graph.feedback_loops(edges, [0], 5).collect()] == [(3, "0 -> 1 -> 2")]
    finally:
        graph._half_paths = plain
    assert sum(level.count() for half in made for level in half) <= 8


def test_closeness_sketches(spark):
    small = spark.createDataFrame([(RNG.randrange(50), RNG.randrange(50)) for _ in range(70)], "a bigint, b bigint")
    nodes = small.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    exact = {r.node: r.closeness for r in graph.centrality(small, nodes).collect()}
    assert {r.node: pytest.approx(r.closeness) for r in graph.closeness_by_sketch(small).collect()} == exact
    shallow = {r.node: r.closeness for r in graph.closeness_by_sketch(small, max_depth=1).collect()}
    ends = {frozenset((r.a, r.b)) for r in small.collect() if r.a != r.b}
    assert shallow == {n: float(sum(n in e for e in ends)) for n in exact}
    # A hub with 6,000 leaves: each leaf has the hub at 1 and the others at 2.
    star = spark.range(1, 6001).select(F.lit(0).cast("bigint").alias("a"), F.col("id").alias("b"))
    got = graph.closeness_by_sketch(star)
    assert got.count() == 6001
    bad = got.where(F.abs(F.col("closeness") / F.when(F.col("node") == 0, 6000.0).otherwise(1 + 5999 / 2) - 1) > 0.05)
    assert bad.isEmpty()


def test_exact_closeness_by_bitmaps(spark):
    links = spark.createDataFrame([(RNG.randrange(16), RNG.randrange(16)) for _ in range(18)], "a bigint, b bigint")
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    for depth in (None, 2):
        want = {r.node: r.closeness for r in graph.centrality(links, nodes, depth).collect()}
        assert {r.node: pytest.approx(r.closeness) for r in graph.closeness(links, depth).collect()} == want


def test_centrality_in_batches_leaves_no_batch_behind(spark):
    links = spark.createDataFrame([(RNG.randrange(12), RNG.randrange(12)) for _ in range(20)], "a bigint, b bigint")
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    one = {r.node: (r.betweenness, r.closeness) for r in graph.centrality(links, nodes).collect()}
    made, plain = [], graph.Scratch

    class Seen(plain):
        def __init__(self, session):
            super().__init__(session)
            made.append(self)

        def keep(self, df):
            out = super().keep(df)
            self.most = max(getattr(self, "most", 0), out.count())
            return out

    graph.Scratch = Seen
    try:
        got = graph.centrality(links, nodes, pairs=50).collect()
    finally:
        graph.Scratch = plain
    assert {r.node: (pytest.approx(r.betweenness), pytest.approx(r.closeness)) for r in got} == one
    assert len(made) >= 2 and max(m.most for m in made) < len(one) ** 2
    assert not any(os.path.exists(m.folder.removeprefix("file:")) for m in made)


def plain_centrality(links, sources, depth=None):
    """Betweenness and closeness by one search from each source."""
    near = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    found = {n: [0.0, 0.0] for n in near}
    for s in sources:
        dist, paths, order = {s: 0}, {s: 1}, [s]
        for v in order:
            for w in near[v] if depth is None or dist[v] < depth else ():
                if w not in dist:
                    dist[w], paths[w] = dist[v] + 1, 0
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        share = dict.fromkeys(order, 0.0)
        for w in reversed(order[1:]):
            found[w][0] += share[w]
            found[w][1] += 1 / dist[w]
            for v in near[w]:
                if dist.get(v) == dist[w] - 1:
                    share[v] += paths[v] / paths[w] * (1 + share[w])
    return {n: tuple(map(pytest.approx, x)) for n, x in found.items()}


def test_centrality_keeps_no_pairs_where_tasks_hold_the_graph(spark, monkeypatch):
    links = [(0, n) for n in range(1, 91)] + [(RNG.randrange(1, 91), RNG.randrange(1, 91)) for _ in range(120)] + [(n, n + 1) for n in range(200, 500)] + [(600, 601), (600, 600)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    ends = sorted({n for a, b in links for n in (a, b)})
    monkeypatch.setattr(graph, "Scratch", None)
    for starts, depth in ((ends, None), (ends[::3], 2), ([7, 10_000], None)):
        got = graph.centrality(df, spark.createDataFrame([(n,) for n in starts], "node bigint"), depth).collect()
        assert {r.node: (r.betweenness, r.closeness) for r in got} == plain_centrality(links, [n for n in starts if n in ends], depth)


def test_closeness_keeps_no_sets_where_tasks_hold_the_graph(spark, monkeypatch):
    links = [(0, n) for n in range(1, 91)] + [(RNG.randrange(1, 91), RNG.randrange(1, 91)) for _ in range(120)] + [(n, n + 1) for n in range(200, 500)] + [(600, 601), (600, 600)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    kept, plain = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda table: kept.extend(table.columns) or plain(table))
    for depth in (3, None):
        want = {n: c for n, (_, c) in plain_centrality(links, {n for link in links for n in link}, depth).items()}
        assert {r.node: r.closeness for r in graph.closeness(df, depth).collect()} == want
        assert {r.node: r.closeness for r in graph.closeness_by_sketch(df, depth).collect()} == want
        assert kept and "ball" not in kept
    small = df.where("a < 95")
    assert {r.node: pytest.approx(r.closeness) for r in graph.closeness(small).collect()} == {r.node: r.closeness for r in graph.closeness(small, pairs=1).collect()}


def test_sketches_of_more_nodes_than_registers(spark):
    links = spark.range(5000).select(F.col("id").alias("a"), F.explode(F.array((F.col("id") * 7 + 3) % 5000, (F.col("id") * 3 + 1) % 5000)).alias("b"))
    exact = graph.closeness(links).withColumnRenamed("closeness", "exact")
    off = exact.join(graph.closeness_by_sketch(links, log_k=10), "node").select(F.abs(F.col("closeness") / F.col("exact") - 1).alias("off"))
    assert off.count() == 5000 and 0 < off.agg(F.max("off")).first()[0] < 4 * 1.04 / 32


def test_sampled_betweenness(spark):
    links = spark.createDataFrame([(RNG.randrange(20), RNG.randrange(20)) for _ in range(35)], "a bigint, b bigint")
    nodes = links.where("a <> b").select(F.explode(F.array("a", "b")).alias("node")).distinct()
    exact = {r.node: r.betweenness for r in graph.centrality(links, nodes).collect()}
    n = len(exact)
    assert {r.node: pytest.approx(r.betweenness) for r in graph.sampled_betweenness(links, 1000).collect()} == exact
    bound = n * (n - 2) * (5.3 / 20) ** 0.5
    assert all(abs(r.betweenness - exact[r.node]) <= bound for r in graph.sampled_betweenness(links, 10).collect())


def test_name_postings(spark, tmp_path):
    rows = [(i, "".join(RNG.choice("abAB1%") for _ in range(RNG.randrange(0, 7)))) for i in range(300)] + [(900, None), (901, "ab"), (902, "ab")]
    genes = spark.createDataFrame(rows, "ordinal int, name string")
    genesets.write_name_index(genes, str(tmp_path / "grams"))
    stored = spark.read.parquet(str(tmp_path / "grams"))
    for text in ("ab", "A1", "bab", "ABAB", "1%", "b1ab", "zz", "zzab", "a", ""):
        want = sorted(r for r in rows if r[1] and len(text) >= 2 and text.lower() in r[1].lower())
        for postings in (stored, genesets.name_grams(genes)):
            assert sorted((r.ordinal, r.name) for r in genesets.matching_names(postings, text).collect()) == want, text
        for first in (False, True):
            assert genesets.search_postings(stored, text, 20, first).collect() == genesets.search_genes(genes, text, 20, first).collect()
    plan = genesets.matching_names(stored, "bab")._jdf.queryExecution().toString()
    assert "PartitionFilters: [part" in plan.replace("isnotnull(part#", "part#") or "part#" in plan.split("PartitionFilters")[1][:80]


def test_many_alignments_hold_moves_not_scores():
    rng = random.Random(11)
    pairs = [("".join(rng.choice("ACGT") for _ in range(rng.randint(0, 60))), "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 22)))) for _ in range(8000)]
    tracemalloc.start()
    got = align._align_all(*map(list, zip(*pairs)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 24 << 20
    for k in rng.sample(range(len(pairs)), 100):
        assert got[k] == align._align_long(*pairs[k])


def test_long_alignments(monkeypatch):
    pairs = [("".join(RNG.choices("ACGT", k=RNG.randrange(0, 60))), "".join(RNG.choices("ACGT", k=RNG.randrange(0, 60)))) for _ in range(60)]
    pairs += [("", ""), ("A", ""), ("", "CC"), ("A" * 50, "A"), ("A", "A" * 50)]
    whole = [align._align_group([a], [b])[0] for a, b in pairs]
    for cells in (1, 40, 300):
        monkeypatch.setattr(align, "_CELLS", cells)
        assert [align._align_long(a, b) for a, b in pairs] == whole
        assert align._align_all([a for a, _ in pairs], [b for _, b in pairs]) == whole


def test_protein_names(spark):
    mols = spark.createDataFrame([(1, "Protein", "x", "no", ("no",)), (2, "Protein", "", "y", None), (3, "Protein", None, None, ("z",)), (4, "Protein", None, "", None), (5, "Protein", None, "", None),
                                  (6, "Protein", None, None, None), (7, "Metabolite", "m", "m", None)], "id int, type string, gene_name string, name string, gene struct<name:string>")
    inter = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (2, 4), (3, 5), (3, 1), (4, 6), (4, 1), (5, 7), (5, 2)], "interaction_id int, molecule_id int")
    table = genesets.protein_names(spark.createDataFrame([(4, 40, "no"), (5, 50, "own"), (6, None, "")], "protein_id int, gene_id int, name string"),
                                   spark.createDataFrame([(40, "g40")], "id int, name string"))
    found = genesets.complexes_from_interactions(inter, mols, table)
    got = {r.label for r in genesets.complex_labels(found).collect()}
    assert got == {"Complex: x & y", "Complex: g40 & z", "Complex: own & x"}


def test_repeated_json_keys(spark):
    text = '{"b":{"start":1,"end":2},"a":{"start":3,"end":4},"b":{"start":5,"end":6},"c":{"start":null,"end":1},"a":{"start":7,"end":8}}'
    docs = spark.createDataFrame([(1, text), (2, json.dumps({})), (3, None)], "doc int, value string")
    got = [(r.doc, r.gene, r.g_start, r.ordinal) for r in json_cache.parse_gene_json(docs).orderBy("ordinal").collect()]
    assert got == [(1, "b", 5, 0), (1, "a", 7, 1)]


def test_compared_and_united(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "gene string") for xs in (["p", "q", "q", None], ["q", "r", "r"]))
    assert {tuple(r) for r in names.compared_names(a, b, "a", "b").collect()} == {("p", "a"), ("q", "both"), ("r", "b"), (None, "a")}
    both = genesets.union_passes({"one": a, "two": b.withColumn("n", F.lit(1))})
    assert both.count() == 7 and both.where("part = 'one' AND n IS NULL").count() == 4


def test_roots_keep_one_row_for_each_category(spark, monkeypatch):
    sizes, cut = [], hierarchy.cut
    monkeypatch.setattr(hierarchy, "cut", lambda df: sizes.append((out := cut(df)).count()) or out)
    chain = spark.range(1, 301).select("id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent_id"), F.lit("n").alias("name"))
    assert {tuple(r) for r in hierarchy.roots(chain).collect()} == {(n, 1, n) for n in range(1, 301)}
    assert max(sizes) <= 300
    # Two parents, of which the farther root counts.
    rows = [(1, None, "a"), (2, 1, "b"), (3, 2, "c"), (9, None, "z"), (3, 9, "c"), (4, 3, "d"), (4, 3, "d"), (None, 1, "x"), (5, 77, "e")]
    assert {tuple(r) for r in hierarchy.roots(spark.createDataFrame(rows, CATEGORY)).collect()} == {(1, 1, 1), (2, 1, 2), (3, 1, 3), (9, 9, 1), (4, 1, 4), (5, 5, 1)}
    with pytest.raises(ValueError, match="cyclic"):
        hierarchy.roots(spark.createDataFrame([(1, 2, "a"), (2, 1, "b")], CATEGORY))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_probes_are_not_dealt_by_level(spark):
    """With few levels in many partitions AQE would undo a broadcast of its own choice."""
    genes = spark.createDataFrame([(1, "g", 5, 90, "+", 1)], "contig_id long, gene string, g_start long, g_end long, strand string, ordinal long")
    hits = spark.range(100).select(F.lit(1).cast("long").alias("contig_id"), F.col("id").alias("start"), F.col("id").alias("end"), F.lit("+").alias("strand"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = intervals.overlap_pairs(hits, genes, ["contig_id"], how="left")
        under = cover.best_over(hits, genes, ["contig_id"], "start", "g_start", "g_end", {"best": F.col("ordinal")})
        assert "BroadcastHashJoin [_s" in _plan(found) and "BroadcastHashJoin [level" in _plan(under)
        assert found.where("gene IS NOT NULL").count() == 86 and under.count() == 86
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_regions_do_not_pass_through_the_driver(spark):
    contigs = spark.createDataFrame([(1, "ACGT" * 300)], "contig_id long, seq string")
    rows = spark.range(50).select(F.lit(1).cast("long").alias("contig_id"), F.col("id").alias("at"))
    got = scan.fetch_region(rows, contigs, F.col("at") + 1, F.col("at") + 600, core=512)
    assert "BroadcastExchange" not in _plan(got)
    assert {(r["at"], r["region_seq"]) for r in got.collect()} == {(i, ("ACGT" * 300)[i:i + 600]) for i in range(50)}


def test_alternatives_read_each_pattern_once(spark, tmp_path):
    import __spark_entry__ as entry

    rows = [(i, f"part {i}", f"b{i}", f"t{i}", i % 50) for i in range(60)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    plan = entry.queries()["r2_alternatives"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("RLIKE") <= 36 and "RLIKE (?i).*" not in plan


def test_seeds_of_long_and_odd_sequences(spark):
    """Chunk borders, wide characters and other letters; a k-mer costs the same wherever it lies (300,000 bases took minutes as slices of a string)."""
    odd = "acgu" * 1100 + "é" + "ACGTAC" * 700 + "N" + "😀ACGUACGA" + "G" * 3
    rows = [("a", odd), ("b", "ACG"), ("c", None), ("d", "éACGTACGT"), ("d", "ACGTACGT"), ("e", "")]
    got = sorted((r.srna_id, r.s_start, r.seed_rc) for r in duplex.seed_index(spark.createDataFrame(rows, "srna_id string, srna string"), 7).collect())
    turned = str.maketrans("ACGT", "TGCA")
    want = [(i, p + 1, s.upper().replace("U", "T")[p:p + 7].translate(turned)[::-1]) for i, s in rows if s for p in range(len(s) - 6)
            if set(s.upper()[p:p + 7]) <= set("ACGTU")]
    assert got == sorted(want)
    long = spark.range(1).select(F.lit("l").alias("srna_id"), F.expr("repeat('ACGTTGCATT', 30000)").alias("srna"))
    began = time.monotonic()
    assert duplex.seed_index(long, 7).count() == 299_994
    assert duplex.seed_index(long, 7).agg(F.sum(F.hash("seed_rc"))).first()[0] is not None
    assert time.monotonic() - began < 20


def test_references_left_out_are_not_scored(spark):
    targets = spark.createDataFrame([("ACGTACGTTT",), ("AC",)], "target_seq string")
    scored = align.best_windows(targets, {"one": "TTT", "two": "ACGTNNACGTTTACGACGTACC"})
    assert {(r.target_seq, r.reference, r.best_mm, r.best_at, r.best_window) for r in scored.where("target_seq <> 'AC'").collect()} == {
        ("ACGTACGTTT", "one", 0, 8, "TTT"), ("ACGTACGTTT", "two", 3, 1, "ACGTACGTTT")}
    plan = scored.where("reference = 'one'")._jdf.queryExecution().optimizedPlan().toString()
    below = plan.split("Filter", 1)[1]
    assert "array_min" in plan and "array_min" not in below


def test_parts_of_one_pass_are_scanned_once(spark):
    import __spark_entry__ as entry
    plan = entry.queries()["u1_scan_passes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 3
    rows = spark.createDataFrame([(1, "+"), (2, "-")], "n int, strand string")
    both = genesets.union_passes({"a": rows, "b": rows}, names={"a": F.concat(F.lit("strand "), F.col("strand"))})
    assert sorted((r.n, r.part) for r in both.collect()) == [(1, "b"), (1, "strand +"), (2, "b"), (2, "strand -")]


def test_literal_patterns_are_counted_in_generated_code(spark):
    import __spark_entry__ as entry
    plan = entry.queries()["f3_mismatch_count"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and "lambda" not in plan


def test_tracks_make_their_spans_once(spark):
    import __spark_entry__ as entry
    plan = entry.queries()["a13_comparative_matrix"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_returnflag" not in plan and "regexp_replace" not in plan


def test_tasks_grow_with_rows_that_multiply(spark):
    regions = spark.createDataFrame([("NC_000001.11", 10 * i, 10 * i + 12) for i in range(90)], "accession string, start bigint, end bigint")
    genes = spark.createDataFrame([("1", f"g{i}", 7 * i, 7 * i + 20) for i in range(60)], "chrom string, gene string, g_start bigint, g_end bigint")
    members = spark.createDataFrame([(i // 3, f"p{i * 7 % 40}") for i in range(90)], "complex_id int, gene string")
    dealt = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    rows = lambda df: sorted(map(tuple, df.collect()))
    few, many = intervals.annotate_regions(regions, genes), intervals.annotate_regions(regions, genes, task_rows=10)
    assert "RepartitionByExpression [chrom" in dealt(many) and "], 10" in dealt(many) and rows(few) == rows(many)
    few, many = graph.neighbours_of(members, members), graph.neighbours_of(members, members, task_rows=10)
    assert dealt(many).count("], 10") == 2 and rows(few) == rows(many)
