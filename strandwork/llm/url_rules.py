"""URL filters: FP-growth mines token combinations of labelled URLs; pruned rules match through an inverted index.

Everything is DataFrame operations and Spark's FP-growth; no Python runs on the executors.
"""
from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BAD, GOOD = "=bad", "=good"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty if it is null or has no '://'."""
    rest = F.when(F.locate("://", url) > 0, F.expr("substring(url_, locate('://', url_) + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def url_tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens of a URL: host labels, the domain of two labels, path words, file ending, query keys and scheme.

    Numbers are one token, so that a rule speaks of kinds of URLs and not of one page.
    """
    labels = F.split(host, r"\.")
    words = F.filter(F.split(path, r"[/._-]"), lambda w: w != "")
    words = F.transform(words, lambda w: F.when(w.rlike("^[0-9]+$"), F.lit("/#")).otherwise(F.concat(F.lit("/"), F.translate(w, UPPER, LOWER))))
    keys = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)="), 1), lambda k: F.concat(F.lit("?"), k))
    parts = F.concat(
        F.transform(labels, lambda x: F.concat(F.lit("h:"), x)),
        F.array(F.concat(F.lit("d:"), F.regexp_extract(host, r"[^.]*\.?[^.]*$", 0)), F.concat(F.lit("s:"), F.regexp_extract(F.coalesce(url, F.lit("")), r"^([A-Za-z]*)://", 1))),
        words, keys)
    return F.array_distinct(F.filter(parts, lambda t: ~t.isin("h:", "d:", "s:")))


def mine(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.6, min_rows: int = 10) -> DataFrame:
    """Rules from rows of (tokens, bad): columns `terms`, `verdict`, `confidence` and `support`.

    A rule holds in at least `min_support` of the labelled rows and in `min_rows` of them, with `min_confidence` and more often than its verdict does over all (lift above 1). Of rules for one verdict, one whose terms contain those
    of another rule of no less confidence is dropped. FP-growth runs on all labelled rows; an empty table gives no rules.
    """
    rows = labelled.where(F.col("bad").isNotNull()).select(F.array_union("tokens", F.array(F.when(F.col("bad"), BAD).otherwise(GOOD))).alias("items"))
    support = min(1.0, max(min_support, min_rows / max(1, rows.count())))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(rows)
    classes = F.array(F.lit(BAD), F.lit(GOOD))
    rules = model.associationRules.where((F.col("lift") > 1) & F.col("consequent")[0].isin(BAD, GOOD) & ~F.arrays_overlap("antecedent", classes)).select(
        F.array_sort("antecedent").alias("terms"), F.when(F.col("consequent")[0] == BAD, "block").otherwise("allow").alias("verdict"), "confidence", "support", "lift")
    rules = stored(rules, "url-rules")
    # A general rule meets the rules that it makes needless under its first term.
    general = rules.select(F.col("terms").alias("g_terms"), F.col("verdict").alias("g_verdict"), F.col("confidence").alias("g_confidence"), F.col("terms")[0].alias("term"))
    special = rules.select("terms", "verdict", "confidence", F.explode("terms").alias("term"))
    needless = special.join(general, "term").where(
        (F.col("verdict") == F.col("g_verdict")) & (F.size("g_terms") < F.size("terms")) & (F.col("g_confidence") >= F.col("confidence"))
        & (F.size(F.array_except("g_terms", "terms")) == 0)).select("terms", "verdict").distinct()
    return rules.join(needless, ["terms", "verdict"], "left_anti")


def match(urls: DataFrame, rules: DataFrame, key: str = "key_") -> DataFrame:
    """The best rule for each key of rows (key, tokens): highest lift, then confidence, support, `block` and terms.

    Inverted index: a rule is listed under its rarest term only (ties: the smallest), a URL looks up its tokens, and the
    other terms are tested on the URL's own tokens. Keys without any rule have no row.
    """
    posted = urls.select(key, "tokens", F.explode("tokens").alias("term"))
    frequency = posted.groupBy("term").agg(F.count("*").alias("n"))
    listed = rules.select("*", F.explode("terms").alias("term")).join(frequency, "term").groupBy("terms", "verdict").agg(
        F.first("confidence").alias("confidence"), F.first("support").alias("support"), F.first("lift").alias("lift"), F.min(F.struct("n", "term")).getField("term").alias("term"))
    hits = posted.join(listed, "term").where(F.size(F.array_except("terms", "tokens")) == 0)
    rank = F.struct("lift", "confidence", "support", (F.col("verdict") == "block").alias("blocks"), "verdict", "terms")
    return hits.groupBy(key).agg(F.max(rank).alias("rule")).select(key, F.col("rule.verdict").alias("mined"), F.col("rule.terms").alias("mined_terms"), F.col("rule.confidence").alias("mined_confidence"))


def judge(pages: DataFrame, labelled: DataFrame, fixed: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow", **mining) -> DataFrame:
    """A verdict for every URL: the longest fixed rule that fits, else the best mined rule, else `default`.

    `labelled` has `url` and boolean `bad`; `fixed` is a list of (rule such as 'net/', verdict). Returns one row per input row:
    the id column, `host`, `path`, `rule`, `verdict` and the mined rule. A null URL, or one without '://', has an empty host and
    path and fits no rule. Ids may be null or repeat; equal URLs are matched once; other columns are not carried.
    """
    def parsed(df: DataFrame) -> DataFrame:
        host, path = host_and_path(F.col("url_"))
        return df.withColumn("host", host).withColumn("path", path).withColumn("tokens", url_tokens(F.col("host"), F.col("path"), F.col("url_")))

    rules = mine(parsed(labelled.select(F.col("url").cast("string").alias("url_"), "bad")), **mining)
    rows = parsed(pages.select(F.col(id_col).alias("id_"), F.col(url_col).cast("string").alias("url_")))
    # Tokens decide, so each distinct set of them is matched once.
    rows = rows.withColumn("key_", F.array_sort("tokens"))
    found = match(rows.groupBy("key_").agg(F.first("tokens").alias("tokens")), rules)
    rule = F.lit(None).cast("string")
    for text, _ in sorted(fixed, key=lambda r: (len(r[0]), r[0])):
        host, path = text.split("/", 1)
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
    verdict = F.coalesce(*(F.when(F.col("rule") == text, F.lit(v)) for text, v in fixed), F.col("mined"), F.lit(default))
    out = rows.join(found, "key_", "left").withColumn("rule", rule).withColumn("verdict", verdict)
    return out.select(F.col("id_").alias(id_col), "host", "path", "rule", "verdict", "mined_terms", "mined_confidence")
