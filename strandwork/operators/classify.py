"""Rule-based gene classification by name patterns."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import every, sequence_features, total  # noqa: F401

# Name patterns of each function category, in priority order.
PATTERNS = {
    "stress_response": ["sig[A-Z]", "rsb[A-Z]", "ctc", "gsi[A-Z]", "dps", "katA", "sodA"],
    "metabolism": [".*[Kk]inase", ".*[Dd]ehydrogenase", ".*[Ss]ynthase", "glc[A-Z]", "pyk[A-Z]", "eno[A-Z]"],
    "transcription": ["rpo[A-Z]", "sig[A-Z]", ".*[Rr]egulator", ".*[Aa]ctivator", ".*[Rr]epressor"],
    "translation": ["rps[A-Z]", "rpl[A-Z]", "tuf[A-Z]", ".*[Tt]RNA", ".*[Rr]ibosom"],
    "cell_wall": ["mur[A-Z]", "pbp[A-Z]", ".*[Pp]eptidoglycan", ".*[Cc]ell[Ww]all", "dac[A-Z]"],
    "transport": [".*[Tt]ransport", ".*[Pp]ermease", ".*ABC", "mal[A-Z]", "ara[A-Z]", "xyl[A-Z]"],
}
# Genes of known function, for names no pattern matches.
KNOWN = {
    "stress_response": ["sigB", "rsbV", "rsbW", "rsbY", "ctc", "gsiB"],
    "metabolism": ["glcK", "pfkA", "fbaA", "tpiA", "gapA"],
    "transcription": ["rpoA", "rpoB", "rpoC", "sigA", "sigB"],
    "translation": ["rpsA", "rplA", "rpsB", "rplB", "tufA"],
    "cell_wall": ["murA", "murB", "murC", "murD", "pbpA"],
    "transport": ["malK", "malF", "malG", "araE", "xylE"],
}
# Confidences and defaults.
KNOWN_CONFIDENCE, UNKNOWN_CONFIDENCE, ALTERNATIVE_WEIGHT, ALTERNATIVE_LEAST = 0.9, 0.1, 0.8, 0.1
STRESS_EXPRESSION, PLAIN_EXPRESSION = (2.5, 1.0), (1.0, 0.0)
PLAIN_NETWORK = {
    "degree_centrality": 0.2, "betweenness_centrality": 0.1, "clustering_coefficient": 0.3, "has_interactions": 0.5,
}


def pattern_share(name: Column, category: str) -> Column:
    """Share of a category's patterns found in the name, ignoring case."""
    # A search finds the same names without a leading `.*`, which would try every rest of the name from each letter.
    rules = [r.removeprefix(".*") for r in PATTERNS[category]]
    return total([F.when(name.rlike(f"(?i){r}"), 1).otherwise(0) for r in rules]) / len(rules)


# F15
def name_features(name: Column | str) -> dict[str, Column]:
    n = F.col(name) if isinstance(name, str) else name
    out = {
        "name_length": F.length(n), "has_numbers": n.rlike(r"\d").cast("double"),
        "has_uppercase": (F.lower(n) != n).cast("double"), "starts_with_y": F.lower(n).startswith("y").cast("double"),
    }
    for category in PATTERNS:
        out[f"{category}_pattern_score"] = pattern_share(n, category)
    return out


# R1, R2, R6
def predict(genes: DataFrame, name: str = "gene") -> DataFrame:
    """Adds predicted_function, confidence, method and up to three alternatives.

    The first category in order with a pattern hit wins with its share of hits, then the known
    genes, then unknown. Alternatives are the other categories by weighted share.
    """
    shares = F.array(*[
        F.struct(F.lit(i).alias("rank"), F.lit(c).alias("function"), pattern_share(F.col(name), c).alias("share"))
        for i, c in enumerate(PATTERNS)])
    known = F.lit(None).cast("string")
    for category, names in reversed(KNOWN.items()):
        known = F.when(F.lower(name).isin(*[n.lower() for n in names]), category).otherwise(known)
    scored = genes.withColumns({"_shares": shares, "_known": known})
    first = F.get(F.filter("_shares", lambda s: s["share"] > 0), F.lit(0))
    scored = scored.withColumn("_first", first)
    picked = F.coalesce(F.col("_first.function"), F.col("_known"), F.lit("unknown"))
    sure = F.when(F.col("_first").isNotNull(), F.col("_first.share")).when(
        F.col("_known").isNotNull(), KNOWN_CONFIDENCE).otherwise(UNKNOWN_CONFIDENCE)
    scored = scored.withColumns({"predicted_function": picked, "confidence": sure, "method": F.lit("rule_based")})
    # Sorting on (-confidence, rank) keeps category order among equals.
    others = F.transform(
        F.filter("_shares", lambda s: (s["function"] != F.col("predicted_function")) & (s["share"] * ALTERNATIVE_WEIGHT > ALTERNATIVE_LEAST)),
        lambda s: F.struct((-s["share"] * ALTERNATIVE_WEIGHT).alias("k"), s["rank"].alias("rank"), s["function"].alias("function")))
    top = F.transform(F.slice(F.array_sort(others), 1, 3), lambda s: F.struct(
        s["function"].alias("function"), (-s["k"]).alias("confidence")))
    return scored.withColumn("alternatives", top).drop("_shares", "_known", "_first")


# R3
def expression_features(genes: DataFrame, measured: DataFrame | None = None, name: str = "gene") -> DataFrame:
    """Measured expression features, or defaults that depend on the stress patterns."""
    cols = ["mean_expression", "max_expression", "expression_variance", "stress_upregulated"]
    stress = pattern_share(F.col(name), "stress_response") > 0
    mean = F.when(stress, STRESS_EXPRESSION[0]).otherwise(PLAIN_EXPRESSION[0])
    default = dict(zip(cols, (mean, mean * 1.5, F.lit(0.5), F.when(stress, STRESS_EXPRESSION[1]).otherwise(PLAIN_EXPRESSION[1]))))
    if measured is None:
        return genes.withColumns(default)
    m = measured.select(F.col("gene").alias("_g"), *[F.col(c).alias(f"_{c}") for c in cols])
    has = F.col("_g").isNotNull()
    out = genes.join(m, F.col(name) == F.col("_g"), "left")
    return out.select(*genes.columns, *[
        F.when(has, F.coalesce(f"_{c}", F.lit(0.0))).otherwise(default[c]).alias(c) for c in cols])


# R4
def network_features(genes: DataFrame, measured: DataFrame | None = None, name: str = "gene") -> DataFrame:
    """Measured network features (gene, degree, betweenness, clustering), or fixed defaults."""
    if measured is None:
        return genes.withColumns({c: F.lit(v) for c, v in PLAIN_NETWORK.items()})
    m = measured.select(F.col("gene").alias("_g"), "degree", "betweenness", "clustering")
    out = genes.join(m, F.col(name) == F.col("_g"), "left")
    has = F.col("_g").isNotNull()
    value = {
        "degree_centrality": F.coalesce("degree", F.lit(0.0)), "betweenness_centrality": F.coalesce("betweenness", F.lit(0.0)),
        "clustering_coefficient": F.coalesce("clustering", F.lit(0.0)),
        "has_interactions": (F.coalesce("degree", F.lit(0.0)) > 0).cast("double"),
    }
    return out.select(*genes.columns, *[F.when(has, v).otherwise(PLAIN_NETWORK[c]).alias(c) for c, v in value.items()])


# R5
def feature_matrix(genes: DataFrame, extra: DataFrame | None = None, name: str = "gene", sequence: str | None = None) -> DataFrame:
    """All features of each gene; columns of `extra` (gene, ...) replace or extend them; nulls become 0."""
    seq = F.col(sequence) if sequence else F.lit(None).cast("string")
    base = genes.withColumns({**name_features(name), **sequence_features(seq)})
    base = network_features(expression_features(base, name=name), name=name)
    if extra is not None:
        over = [c for c in extra.columns if c != "gene"]
        e = extra.select(F.col("gene").alias("_g"), *[F.col(c).alias(f"_x_{c}") for c in over])
        base = base.join(e, F.col(name) == F.col("_g"), "left")
        base = base.withColumns({c: F.coalesce(f"_x_{c}", *([c] if c in base.columns else [])) for c in over}).drop(
            "_g", *[f"_x_{c}" for c in over])
    return base.fillna(0)


# A16
def prediction_summary(predictions: DataFrame) -> DataFrame:
    """One row per predicted function with the run's totals alongside."""
    per = predictions.groupBy("predicted_function").agg(
        F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("_sum"), F.count_if(F.col("confidence") > 0.7).alias("_high"))
    run = per.agg(F.sum("n").alias("total_genes"), (F.sum("_sum") / F.sum("n")).alias("average_confidence"),
                  F.sum("_high").alias("high_confidence"),
                  F.sum(F.when(F.col("predicted_function") == "unknown", F.col("n")).otherwise(0)).alias("unknown_function"))
    return per.select("predicted_function", "n").withColumns({
        c: run.select(c).scalar() for c in ("total_genes", "average_confidence", "high_confidence", "unknown_function")})
