"""Graph operators: neighbourhoods, shortest paths, cycles, centrality.

Iterative operators keep their state as (source, node, distance, ...) tables and advance all
sources by one level per round: a join with the edges, an aggregate that merges duplicate
arrivals, and an anti-join with what is known. Each round is checkpointed, so neither
the plan nor the recovery cost grows with the depth.

Groups of many members (complexes) are walked through their membership table, gene to group
to gene. Spelling a group out as pairs would square its size.
"""
from __future__ import annotations

from functools import reduce
from itertools import combinations, count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch, cut
from . import allpairs


# G1
def clique_edges(members: DataFrame, group: str = "complex_id", node: str = "gene") -> DataFrame:
    """Undirected adjacency of groups of two or more members as stars (a, b, via), both directions.

    A group is a hub: (gene, hub) and (hub, gene) rows with `via` naming the hub, whose two steps equal
    one step between any two of its members. Output is linear in the membership table for groups of any
    size; `neighbours_of` gives the pairs of chosen genes.
    """
    m = members.select(F.concat(F.lit("group:"), F.col(group).cast("string")).alias("b"), F.col(node).alias("a")).distinct()
    real = m.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("b")
    star = m.join(real, "b").select("a", "b")
    return star.select("a", "b", F.col("b").alias("via")).union(star.select("b", "a", "b"))


def neighbours_of(members: DataFrame, genes: DataFrame, group: str = "complex_id", node: str = "gene", task_rows: int = 250_000) -> DataFrame:
    """(a, b): the fellow members b of each gene a of `genes` (gene), over all its groups.

    Members make many pairs in the task that joins them, which the bytes it reads do not tell, so the number of tasks grows with the members: about one for `task_rows`.
    """
    tasks = 1 + members.count() // task_rows
    m = members.select(F.col(group).alias("g"), F.col(node).alias("b")).distinct()
    mine = genes.select(F.col("gene").alias("a")).distinct().join(m.select("g", F.col("b").alias("a")), "a")
    return mine.repartition(tasks, "g").join(m.repartition(tasks, "g"), "g").where(F.col("a") != F.col("b")).select("a", "b").distinct()


# G2
def canonical_members(members: DataFrame, synonyms: DataFrame, node: str = "gene") -> DataFrame:
    """Membership under canonical lower-case names; members that become equal merge."""
    from .names import reverse_index

    rev = reverse_index(synonyms).withColumnRenamed("key", "_k")
    named = members.join(rev, F.lower(node) == F.col("_k"), "left").withColumn(
        node, F.lower(F.coalesce("canonical", F.col(node))))
    return named.select(*members.columns).distinct()


# P9
def protein_edges(interactions: DataFrame, molecules: DataFrame) -> DataFrame:
    """Edges of interactions with exactly two members, both of them proteins."""
    m = interactions.select("interaction_id", "molecule_id")
    two = m.groupBy("interaction_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min("molecule_id").alias("a"), F.max("molecule_id").alias("b")).where("_n = 2").drop("_n")
    proteins = molecules.where(F.col("type") == "Protein").select("id")
    return two.join(proteins.withColumnRenamed("id", "a"), "a", "left_semi").join(
        proteins.withColumnRenamed("id", "b"), "b", "left_semi").select("interaction_id", "a", "b")


# A27
def graph_summary(molecules: DataFrame, interactions: DataFrame) -> DataFrame:
    n = interactions.agg(F.count_distinct("interaction_id")).scalar()
    return molecules.agg(F.count(F.lit(1)).alias("molecules"), F.count_if(F.col("type") == "Protein").alias("proteins")) \
        .withColumn("interactions", n)


# G4
def directed_graph(regulations: DataFrame) -> DataFrame:
    """One edge per (src, dst): null ends go, the last of parallel edges stays."""
    rest = [c for c in regulations.columns if c not in ("src", "dst")]
    return regulations.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).groupBy("src", "dst").agg(
        F.max_by(F.struct(*rest), "ordinal").alias("_e")).select("src", "dst", *[f"_e.{c}" for c in rest])


# G7
def edges_among(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Direct edges between chosen nodes with the label `effect-or-mode (mechanism)`."""
    c = chosen.select(F.col("node")).distinct()
    kept = edges.join(c.withColumnRenamed("node", "src"), "src", "left_semi").join(c.withColumnRenamed("node", "dst"), "dst", "left_semi")
    blank = F.lit("")
    return kept.withColumn("label", F.concat(
        F.coalesce("effect", "mode", blank), F.lit(" ("), F.coalesce("mechanism", blank), F.lit(")")))


# G10
def degree(edges: DataFrame) -> DataFrame:
    """Number of edge ends at each node; a self loop counts twice."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def _advance(state: DataFrame, reached: DataFrame) -> DataFrame:
    """Arrivals that are new to their source."""
    return reached.join(state.select("source", "node"), ["source", "node"], "left_anti")


# G3
def neighbourhood(members: DataFrame, centres: DataFrame, radius: int, group: str = "complex_id", node: str = "gene") -> DataFrame:
    """(centre, gene, layer) of genes within `radius` group steps of each centre.

    A step goes from gene to group to gene. A group already used by a centre cannot reach
    anyone new, so each is visited once per centre.
    """
    m = cut(members.select(F.col(group).alias("g"), F.col(node).alias("node")).distinct())
    state = cut(centres.select(F.col("gene").alias("source"), F.col("gene").alias("node"), F.lit(0).alias("layer")).distinct())
    frontier, seen = state, None
    for layer in range(1, radius + 1):
        groups = frontier.select("source", "node").join(m, "node").select("source", "g").distinct()
        if seen is not None:
            groups = groups.join(seen, ["source", "g"], "left_anti")
        groups = cut(groups)
        reached = groups.join(m, "g").select("source", "node").distinct()
        frontier = cut(_advance(state, reached).withColumn("layer", F.lit(layer)))
        if frontier.isEmpty():
            break
        seen = groups if seen is None else seen.unionByName(groups)
        state = state.unionByName(frontier)
    return state.select(F.col("source").alias("centre"), F.col("node").alias("gene"), "layer")


def path_state(edges: DataFrame, sources: DataFrame, max_len: int | None = None) -> DataFrame:
    """(source, node, dist, n_paths, example): shortest distances, path counts and a smallest path.

    Counts add up over predecessors, so paths are counted without being listed. The
    example holds the nodes of the path that is smallest in node order. The search ends by itself
    when no new node is met, or at `max_len` steps where that is given.
    """
    e = cut(edges.select("src", "dst").distinct())
    state = cut(sources.select(
        F.col("node").alias("source"), "node", F.lit(0).alias("dist"), F.lit(1).cast("bigint").alias("n_paths"),
        F.array("node").alias("example")).distinct())
    frontier = state
    for d in count(1) if max_len is None else range(1, max_len + 1):
        step = frontier.join(e, F.col("node") == F.col("src")).groupBy("source", "dst").agg(
            F.sum("n_paths").alias("n_paths"), F.min("example").alias("example")).select(
            "source", F.col("dst").alias("node"), F.lit(d).alias("dist"), "n_paths",
            F.concat("example", F.array("dst")).alias("example"))
        frontier = cut(_advance(state, step))
        if frontier.isEmpty():
            break
        state = state.unionByName(frontier)
    return state


def _reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _chosen(edges: DataFrame, nodes: list) -> DataFrame:
    kind = edges.schema["src"].dataType.simpleString()
    return edges.sparkSession.createDataFrame([(n,) for n in dict.fromkeys(nodes)], f"node {kind}")


def _pairs(edges: DataFrame, nodes: list) -> DataFrame:
    """Ordered pairs of the named nodes, earlier before later. The list is typed in by a user."""
    kind = edges.schema["src"].dataType.simpleString()
    pairs = list(combinations(dict.fromkeys(nodes), 2))
    return edges.sparkSession.createDataFrame(pairs, f"source {kind}, target {kind}")


# G5
def shortest_paths(edges: DataFrame, nodes: list, max_len: int | None = None) -> DataFrame:
    """(source, target, direct, n_paths, dist, example_path) for every two of `nodes`, in list order."""
    state = path_state(edges, _chosen(edges, nodes), max_len)
    hit = state.select("source", F.col("node").alias("target"), "dist", "n_paths", "example")
    return _pairs(edges, nodes).join(hit, ["source", "target"], "left").select(
        "source", "target", F.coalesce(F.col("dist") == 1, F.lit(False)).alias("direct"),
        F.coalesce("n_paths", F.lit(0)).alias("n_paths"), "dist",
        F.array_join(F.transform("example", lambda x: x.cast("string")), " -> ").alias("example_path"))


def _through(edges: DataFrame, nodes: list, max_len: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Forward state, backward state and the reachable pairs with their distance."""
    chosen = _chosen(edges, nodes)
    fwd = path_state(edges, chosen, max_len)
    back = path_state(_reverse(edges), chosen, max_len).select(
        F.col("source").alias("target"), "node", F.col("dist").alias("to_go"), F.col("n_paths").alias("n_back"))
    total = _pairs(edges, nodes).join(
        fwd.select("source", F.col("node").alias("target"), F.col("dist").alias("total")), ["source", "target"])
    return fwd, back, total


# G6
def intermediate_counts(edges: DataFrame, nodes: list, max_len: int | None = None) -> DataFrame:
    """How many shortest paths between chosen pairs pass through each inner node.

    Paths through v are the paths to v times the paths from v; none is listed.
    """
    fwd, back, total = _through(edges, nodes, max_len)
    on = total.join(back, "target").join(fwd.drop("example"), ["source", "node"]).where(
        (F.col("dist") + F.col("to_go") == F.col("total")) & (F.col("node") != F.col("source")) & (F.col("node") != F.col("target")))
    return on.groupBy("node").agg(F.sum(F.col("n_paths") * F.col("n_back")).alias("n_paths"))


# G9
def path_nodes(edges: DataFrame, nodes: list, max_len: int | None = None) -> DataFrame:
    """Nodes on any shortest path between chosen pairs, ends included."""
    fwd, back, total = _through(edges, nodes, max_len)
    return total.join(back, "target").join(fwd.drop("example"), ["source", "node"]).where(
        F.col("dist") + F.col("to_go") == F.col("total")).select("node").distinct()


def path_edges(edges: DataFrame, nodes: list, max_len: int | None = None) -> DataFrame:
    """Edges on any shortest path between chosen pairs."""
    fwd, back, total = _through(edges, nodes, max_len)
    f = fwd.select("source", F.col("node").alias("src"), "dist")
    b = back.select("target", F.col("node").alias("dst"), "to_go")
    return edges.select("src", "dst").distinct().join(f, "src").join(b, "dst").join(total, ["source", "target"]).where(
        F.col("dist") + 1 + F.col("to_go") == F.col("total")).select("src", "dst").distinct()


# G8
def _half_paths(steps: DataFrame, chosen: DataFrame, length: int, max_len: int, back: bool) -> list[DataFrame]:
    """Simple paths (start, node, path) of 0 to `length` steps away from each start, against the edges if `back`."""
    near, far, rest = ("dst", "src", "gone") if back else ("src", "dst", "to_go")
    moves = steps.select("start", F.col(near).alias("node"), F.col(far).alias("_far"), F.col(rest).alias("_rest"))
    levels = [chosen.select(F.col("node").alias("start"), "node", F.array("node").alias("path"))]
    for n in range(1, length + 1):
        grown = levels[-1].join(moves, ["start", "node"]).where(~F.array_contains("path", F.col("_far")) & (F.col("_rest") + n <= max_len))
        levels.append(cut(grown.select("start", F.col("_far").alias("node"), F.concat("path", F.array("_far")).alias("path"))))
        if levels[-1].isEmpty():
            break
    return levels


def feedback_loops(edges: DataFrame, nodes: list, max_len: int) -> DataFrame:
    """Simple cycles of up to `max_len` nodes through a chosen node, as (length, loop) text.

    A loop lies in the strongly connected component of its start: only edges whose ends the start reaches and that lead back to it, within `max_len` in all, are kept
    for that start. Paths then grow half of the way forward and half of the way back and are joined where they meet, so a loop of length n needs paths of
    n / 2 steps; a graph without loops has none. A cycle found from several nodes is reported once, from its smallest node.
    """
    e = cut(edges.select("src", "dst").distinct())
    chosen = _chosen(e, nodes)
    gone = path_state(e, chosen, max_len).select(F.col("source").alias("start"), "node", F.col("dist").alias("gone"))
    to_go = path_state(_reverse(e), chosen, max_len).select(F.col("source").alias("start"), "node", F.col("dist").alias("to_go"))
    core = cut(gone.join(to_go, ["start", "node"]).where(F.col("gone") + F.col("to_go") <= max_len))
    steps = cut(e.join(core.select("start", F.col("node").alias("src"), "gone"), "src").join(
        core.select("start", F.col("node").alias("dst"), "to_go"), ["start", "dst"]).where(F.col("gone") + 1 + F.col("to_go") <= max_len))
    heads, tails = ([], []) if steps.isEmpty() else (
        _half_paths(steps, chosen, (max_len + 1) // 2, max_len, False), _half_paths(steps, chosen, max_len // 2, max_len, True))
    loops = steps.where((F.col("src") == F.col("start")) & (F.col("dst") == F.col("start"))).select(F.array("start").alias("path"))
    for n in range(2, max_len + 1):
        h, t = (n + 1) // 2, n // 2
        if h >= len(heads) or t >= len(tails):
            break
        rest = F.slice("path", 2, t - 1)
        met = heads[h].join(tails[t].select("start", "node", rest.alias("_rest")), ["start", "node"]).where(~F.arrays_overlap("path", "_rest"))
        loops = loops.unionByName(met.select(F.concat("path", F.reverse("_rest")).alias("path")))
    low = F.array_position("path", F.array_min("path")).cast("int")
    turned = F.concat(F.slice("path", low, F.size("path") - low + 1), F.slice("path", F.lit(1), low - 1))
    return loops.select(F.size("path").alias("length"), F.array_join(
        F.transform(turned, lambda x: x.cast("string")), " -> ").alias("loop")).distinct()


# G11
#: Pairs of a source and a node that `centrality` holds at once. A task holds the whole graph if eight pairs for each node, and the edges, are a quarter of it.
PAIRS = 1 << 25


def _two_ways(edges: DataFrame) -> DataFrame:
    e = edges.where(F.col("a") != F.col("b"))
    return e.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(e.select(F.col("b").alias("src"), F.col("a").alias("dst"))).distinct()


def _numbered(both: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, no) with numbers from 0 without gaps, and the edges (src, dst) in these numbers. Rows are counted per partition and shifted."""
    place = F.monotonically_increasing_id()
    placed = cut(both.select(F.col("src").alias("node")).distinct()).select("node", F.shiftright(place, 33).alias("_part"), place.bitwiseAND((1 << 33) - 1).alias("_at"))
    placed = cut(placed)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    shifts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    nodes = cut(placed.join(shifts, "_part").select("node", (F.col("_before") + F.col("_at")).alias("no")))
    ends = both.join(nodes.select(F.col("node").alias("src"), F.col("no").alias("_s")), "src").join(nodes.select(F.col("node").alias("dst"), F.col("no").alias("_d")), "dst")
    return nodes, cut(ends.select(F.col("_s").alias("src"), F.col("_d").alias("dst")))


def _held(nodes: DataFrame, both: DataFrame, pairs: int) -> allpairs.Graph | None:
    """The graph in the driver's memory, 4 bytes an edge and 12 a node, if it is small enough to be held by every task."""
    size = nodes.count()
    return allpairs.hold(both, size) if size and 8 * size + both.count() <= pairs >> 2 else None


def _shares(both: DataFrame, sources: DataFrame, max_depth: int | None, room: Scratch) -> DataFrame:
    """(no, betweenness, closeness) as far as `sources` (no) give it, a node once for each level it lies on.

    Edges lead both ways, so the neighbours of a level lie on it, on the one before or are new.
    """
    levels = [room.keep(sources.select(F.col("no").alias("source"), F.col("no").alias("node"), F.lit(1).cast("bigint").alias("n_paths")))]
    for _ in count(1) if max_depth is None else range(max_depth):
        step = levels[-1].join(both, F.col("node") == F.col("src")).groupBy("source", F.col("dst").alias("node")).agg(F.sum("n_paths").alias("n_paths"))
        for known in levels[-2:]:
            step = step.join(known.select("source", "node"), ["source", "node"], "left_anti")
        step = room.keep(step)
        if step.isEmpty():
            break
        levels.append(step)
    # Shares flow back one level at a time: a node passes each predecessor its part.
    below, parts = None, []
    for d in range(len(levels) - 1, 0, -1):
        if below is None:
            below = levels[d].withColumn("delta", F.lit(0.0))
        else:
            give = below.select("source", F.col("node").alias("dst"), ((F.col("delta") + 1) / F.col("n_paths")).alias("unit"))
            got = give.join(both, "dst").groupBy("source", F.col("src").alias("node")).agg(F.sum("unit").alias("unit"))
            below = room.keep(levels[d].join(got, ["source", "node"], "left").select(
                "source", "node", "n_paths", (F.col("n_paths") * F.coalesce("unit", F.lit(0.0))).alias("delta")))
        parts.append(below.groupBy(F.col("node").alias("no")).agg(F.sum("delta").alias("betweenness"), (F.count(F.lit(1)) / d).alias("closeness")))
    return reduce(DataFrame.unionByName, parts) if parts else levels[0].select(F.col("node").alias("no"), F.lit(0.0).alias("betweenness"), F.lit(0.0).alias("closeness"))


def centrality(edges: DataFrame, sources: DataFrame, max_depth: int | None = None, pairs: int = PAIRS) -> DataFrame:
    """(node, betweenness, closeness) of an undirected graph given as (a, b) edges.

    Betweenness sums path shares over ordered pairs that start in `sources`; it is exact when
    these are all nodes. Closeness is the sum of 1/distance from the sources that reach a node; `closeness` gives it for less.
    The work is |sources| x |edges|. Where a task can hold the graph (`_held`), every task takes a share of the sources and sums up what they give, so nothing but one row for
    each task and node lies on disk. In larger graphs sources go in batches of about `pairs` rows of a source and a node, whose tables are deleted before the next batch.
    """
    both = cut(_two_ways(edges))
    nodes, both = _numbered(both)
    starts = cut(nodes.join(sources.select("node").distinct(), "node").select("no"))
    held = _held(nodes, both, pairs)
    if held is not None:
        found = allpairs.betweenness(edges.sparkSession, held, starts.toArrow()["no"].to_numpy(), max_depth)
        total = cut(found.groupBy("no").agg(F.sum("betweenness").alias("betweenness"), F.sum("closeness").alias("closeness")))
        return nodes.join(total, "no", "left").select("node", "betweenness", "closeness").fillna(0.0)
    batches = max(1, -(-starts.count() * nodes.count() // pairs))
    done = None
    for i in range(batches):
        room = Scratch(edges.sparkSession)
        part = _shares(both, starts.where(F.pmod(F.xxhash64("no"), F.lit(batches)) == i), max_depth, room)
        part = cut(part.groupBy("no").agg(F.sum("betweenness").alias("betweenness"), F.sum("closeness").alias("closeness")))
        room.clear()
        done = part if done is None else done.unionByName(part)
    total = done.groupBy("no").agg(F.sum("betweenness").alias("betweenness"), F.sum("closeness").alias("closeness"))
    return nodes.join(total, "no", "left").select("node", "betweenness", "closeness").fillna(0.0)


def closeness(edges: DataFrame, max_depth: int | None = None, pairs: int = PAIRS) -> DataFrame:
    """(node, closeness) of ALL nodes of an undirected graph, exactly: the sum of 1/distance to every other node.

    Where a task can hold the graph (`_held`), every task takes a share of the nodes as sources, a bit each, and one row for each task and node lies on disk. In larger graphs a
    node holds the set of nodes within d steps as bitmaps of 32,768 numbers each, and a round unites them with its neighbours' that grew in the round before. For n nodes that
    state is n * n / 8 bytes, in rows of 4 KB, and a node's closeness is the sum of (new members / d).
    """
    nodes, both = _numbered(cut(_two_ways(edges)))
    held = _held(nodes, both, pairs)
    if held is not None:
        total = cut(allpairs.closeness(edges.sparkSession, held, max_depth).groupBy("no").agg(F.sum("closeness").alias("closeness")))
        return nodes.join(total, "no").select("node", "closeness")
    state = cut(nodes.select(F.col("no").alias("node"), F.bitmap_bucket_number("no").alias("bucket"), F.bitmap_bit_position("no").alias("bit")).groupBy("node", "bucket").agg(
        F.bitmap_construct_agg("bit").alias("ball")).select("*", F.lit(1).cast("bigint").alias("size"), F.lit(0.0).alias("closeness"), F.lit(True).alias("grew")))
    for d in count(1) if max_depth is None else range(1, max_depth + 1):
        met = both.join(state.where("grew").select(F.col("node").alias("src"), "bucket", "ball"), "src").select(F.col("dst").alias("node"), "bucket", "ball")
        merged = state.drop("grew").unionByName(met, allowMissingColumns=True).groupBy("node", "bucket").agg(
            F.bitmap_or_agg("ball").alias("ball"), F.coalesce(F.max("size"), F.lit(0)).alias("old"), F.coalesce(F.max("closeness"), F.lit(0.0)).alias("closeness"))
        merged = merged.withColumn("size", F.bitmap_count("ball"))
        state = cut(merged.select("node", "bucket", "ball", "size", (F.col("closeness") + (F.col("size") - F.col("old")) / d).alias("closeness"), (F.col("size") > F.col("old")).alias("grew")))
        if state.where("grew").isEmpty():
            break
    total = state.groupBy(F.col("node").alias("no")).agg(F.sum("closeness").alias("closeness"))
    return nodes.join(total, "no").select("node", "closeness")


def closeness_by_sketch(edges: DataFrame, max_depth: int | None = None, log_k: int = 12, pairs: int = PAIRS) -> DataFrame:
    """(node, closeness) of ALL nodes of an undirected graph: the estimated sum of 1/distance to every other node.

    Each node holds one distinct-count sketch of the nodes within d steps, and a round merges it with its neighbours', so the state is one sketch of at most
    2^`log_k` bytes or so per node, whatever their number. The standard error of a count, and so of a node's closeness at most, is about 1.04 / sqrt(2^`log_k`): 1.6 % by default; up
    to some hundred nodes the sketches are exact. Ends when no count grows any more, or after `max_depth` rounds.

    Where a task can hold the graph (`_held`), tasks take slices of the registers, and only what a slice adds to each node's estimates lies on disk; graphs of up to 2^`log_k` nodes
    come out exact. In larger graphs the sketches of all nodes are joined with the edges in every round.
    """
    both = cut(_two_ways(edges))
    nodes, numbered = _numbered(both)
    held = _held(nodes, numbered, pairs)
    if held is not None:
        coded = nodes.select(F.col("no").cast("int").alias("no"), F.xxhash64("node").alias("h")).toArrow()
        hashes = coded["h"].to_numpy()[coded["no"].to_numpy().argsort()]
        return nodes.join(cut(allpairs.closeness_by_sketch(edges.sparkSession, held, hashes, max_depth, log_k)), "no").select("node", "closeness")
    state = cut(both.groupBy(F.col("src").alias("node")).agg(
        F.hll_sketch_agg(F.col("src").cast("string"), F.lit(log_k)).alias("ball"), F.lit(1).cast("bigint").alias("size"), F.lit(0.0).alias("closeness")))
    for d in count(1) if max_depth is None else range(1, max_depth + 1):
        here = state.select("node", "ball", "size", "closeness")
        met = both.join(state.select(F.col("node").alias("src"), "ball"), "src").select(F.col("dst").alias("node"), "ball")
        merged = here.unionByName(met, allowMissingColumns=True).groupBy("node").agg(
            F.hll_union_agg("ball").alias("ball"), F.max("size").alias("old"), F.max("closeness").alias("closeness"))
        size = F.greatest(F.hll_sketch_estimate("ball"), F.col("old"))
        state = cut(merged.select("node", "ball", size.alias("size"), (F.col("closeness") + (size - F.col("old")) / d).alias("closeness"), (size > F.col("old")).alias("_grew")))
        if state.where("_grew").isEmpty():
            break
    return state.select("node", "closeness")


def sampled_betweenness(edges: DataFrame, pivots: int) -> DataFrame:
    """(node, betweenness) estimated from the paths of `pivots` nodes, those of least hash, times nodes / pivots; exact if there are no more nodes than that.

    The work is pivots x nodes. With probability 1 - p a node's estimate is off by at most n (n - 2) sqrt(ln(2 / p) / (2 pivots)), n being the number of nodes.
    """
    nodes = cut(edges.where(F.col("a") != F.col("b")).select(F.explode(F.array("a", "b")).alias("node")).distinct())
    picked = cut(nodes.orderBy(F.xxhash64("node"), "node").limit(pivots))
    scale = nodes.count() / max(1, picked.count())
    return centrality(edges, picked).select("node", (F.col("betweenness") * scale).alias("betweenness"))


# S15
def sif_lines(edges: DataFrame, kind: str | None = None) -> DataFrame:
    """`source<TAB>type<TAB>target` lines; a missing type is `interacts_with`."""
    middle = F.coalesce(F.col(kind), F.lit("interacts_with")) if kind else F.lit("interacts_with")
    return edges.select(F.concat_ws("\t", F.col("a").cast("string"), middle, F.col("b").cast("string")).alias("value"))
