"""Secret scans: base patterns, and multipart credentials linked by an interval join inside scopes.

Only DataFrame operations. A pattern gives its matches and the gaps between them; lengths of both, summed in order, give
positions in code points. Identifiers, secrets and endpoints then meet in an interval join: a weak part is reported only where its
complement lies within the scope.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


@dataclass(frozen=True)
class Part:
    """A kind of span: `group` of `pattern` needs `least` code points (and at most `most`); `quick` finds texts worth the work."""

    kind: str
    role: str
    strong: bool
    pattern: str
    group: int = 0
    least: int = 1
    most: int = 1 << 30
    quick: str = ""


_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The base patterns of the contract, in their order.
BASE = (
    Part("assign", "secret", True, _ASSIGN, 2, 12),
    Part("access", "identifier", True, r"AKIA[A-Z0-9]+", 0, 18, quick="AKIA"),
    Part("hex", "secret", True, r"[0-9a-f]{16,}", 0, 16),
)
#: Weak parts: alone they are common and harmless.
WEAK = (
    Part("short_secret", "secret", False, _ASSIGN, 2, 6, 11),
    Part("login", "identifier", False, r"""(?i)\b(?:user|username|user_?id|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+_.-]+)""", 1, 3),
    Part("endpoint", "endpoint", False, r"""(?i)\b(?:https?|ftp|ssh|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9][^\s"'<>]*""", 0, 10, quick="://"),
)
KINDS = [p.kind for p in BASE + WEAK]


def _found(text: Column, part: Part, order: int) -> Column:
    """Array of (kind, i, gap before the match, length of the match, length of its group)."""
    pattern = F.lit(part.pattern)
    gaps = F.transform(F.split(text, part.pattern, -1), F.char_length)
    whole = F.transform(F.regexp_extract_all(text, pattern, 0), F.char_length)
    value = F.transform(F.regexp_extract_all(text, pattern, part.group), F.char_length) if part.group else whole
    rows = F.zip_with(F.slice(gaps, F.lit(1), F.size(whole)), F.zip_with(whole, value, lambda w, v: F.struct(w.alias("w"), v.alias("v"))),
                      lambda g, m: F.struct(F.lit(order).alias("kind"), g.alias("gap"), m["w"].alias("width"), m["v"].alias("value")))
    rows = F.transform(rows, lambda x, i: F.struct(x["kind"].alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["width"].alias("width"), x["value"].alias("value")))
    seen = F.contains(text, F.lit(part.quick)) if part.quick else text.rlike(part.pattern)
    return F.when(seen, rows)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 200, base: tuple[Part, ...] = BASE, weak: tuple[Part, ...] = WEAK) -> DataFrame:
    """Rows (id_, hash_, kind, order, start, end) of all spans to report, in code points, end exclusive.

    Strong parts are reported always. A weak identifier or secret is reported if its complement, strong or weak, begins or ends within `scope`
    code points of it, an endpoint if both are there; a weak part that overlaps a strong one is part of it and not reported. Equal rows of
    the input are scanned as one; (id_, hash_) names a text, id_ being the id or, for null ids, the least long.
    """
    parts = base + weak
    texts = docs.select(*document_key(docs, id_col, text_col), F.col(text_col).cast("string").alias("text_"))
    none = F.expr("cast(array() as array<struct<kind:int,i:int,gap:int,width:int,value:int>>)")
    every = F.concat(*(F.coalesce(_found(F.col("text_"), p, k), none) for k, p in enumerate(parts)))
    rows = texts.where("text_ <> ''").select("id_", "hash_", F.explode(every).alias("m")).select("id_", "hash_", "m.*")
    rows = stored(rows.dropDuplicates(["id_", "hash_", "kind", "i"]), "secret-matches")
    run = Window.partitionBy("id_", "hash_", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("width")).over(run)).withColumn("start", F.col("end") - F.col("width"))
    pick = lambda f: F.element_at(F.array(*(F.lit(f(p)) for p in parts)), F.col("kind") + 1)
    rows = rows.where(F.col("value").between(pick(lambda p: p.least), pick(lambda p: p.most)))
    spans = stored(rows.select("id_", "hash_", F.col("kind").alias("order"), "start", "end", pick(lambda p: p.kind).alias("kind"), pick(lambda p: p.role).alias("role"), pick(lambda p: p.strong).alias("strong")), "secret-spans")
    # Interval join: both sides are spread over cells of one scope, so that equal cells bring near parts together.
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / scope), F.floor(b / scope)))
    left = spans.where("NOT strong").select("*", cells(F.col("start") - scope, F.col("end") + scope).alias("cell"))
    right = spans.select("id_", "hash_", F.col("order").alias("o2"), F.col("role").alias("r2"), F.col("strong").alias("s2"), F.col("start").alias("b2"), F.col("end").alias("e2"), cells(F.col("start"), F.col("end")).alias("cell"))
    near = (F.col("b2") <= F.col("end") + scope) & (F.col("e2") >= F.col("start") - scope) & ((F.col("o2") != F.col("order")) | (F.col("b2") != F.col("start")))
    overlaps = (F.col("b2") < F.col("end")) & (F.col("start") < F.col("e2"))
    sees = lambda role: F.max(F.when((F.col("r2") == role) & ~overlaps, 1).otherwise(0))
    met = left.join(right, ["id_", "hash_", "cell"]).where(near).groupBy("id_", "hash_", "order", "kind", "role", "start", "end").agg(
        sees("identifier").alias("ids"), sees("secret").alias("secrets"), F.max(F.when(overlaps & F.col("s2"), 1).otherwise(0)).alias("covered"))
    linked = met.where("covered = 0 AND ((role = 'identifier' AND secrets = 1) OR (role = 'secret' AND ids = 1) OR (role = 'endpoint' AND ids = 1 AND secrets = 1))")
    columns = ["id_", "hash_", "kind", "order", "start", "end"]
    return spans.where("strong").select(columns).union(linked.select(columns))


def document_key(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """The columns id_ and hash_ that name a text; they are never null."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id_"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("hash_")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: the id column and `spans`, an array of (start, order, kind, end), sorted.

    A null or empty text has an empty array. Ids may be null or repeat; other columns are not carried.
    """
    listed = secret_spans(docs, id_col, text_col, **options).groupBy("id_", "hash_").agg(
        F.array_sort(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), "order", "kind", F.col("end").cast("long").alias("end")))).alias("spans"))
    rows = docs.select(F.col(id_col).alias("own_"), *document_key(docs, id_col, text_col))
    none = F.expr("cast(array() as array<struct<start:bigint,order:int,kind:string,end:bigint>>)")
    return rows.join(listed, ["id_", "hash_"], "left").select(F.col("own_").alias(id_col), F.coalesce("spans", none).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]", length_col: str | None = None, **options) -> DataFrame:
    """The rows of `docs` with each reported span of the text replaced by `mark`; overlapping spans become one mark.

    With `length_col`, that column gets the new length of texts that changed.
    """
    names = docs.columns
    listed = secret_spans(docs, id_col, text_col, **options).groupBy("id_", "hash_").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans_"))
    # Spans that overlap or touch are merged into (start, end) in order.
    wide = "aggregate(spans_, cast(array() as array<struct<start:bigint,end:bigint>>), (acc, s) -> CASE WHEN size(acc) > 0 AND element_at(acc, -1).end >= s.start " \
           "THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, s.end)))) " \
           "ELSE concat(acc, array(named_struct('start', s.start, 'end', s.end))) END)"
    text = f"concat(array_join(transform(wide_, (s, i) -> concat(substring(text_, cast(CASE WHEN i = 0 THEN 0 ELSE wide_[i - 1].end END + 1 AS int), " \
           f"cast(s.start - CASE WHEN i = 0 THEN 0 ELSE wide_[i - 1].end END AS int)), '{mark}')), ''), substring(text_, cast(element_at(wide_, -1).end + 1 AS int)))"
    inner = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row_"), *document_key(docs, id_col, text_col), F.col(text_col).cast("string").alias("text_"))
    done = inner.join(listed, ["id_", "hash_"], "left").withColumn("wide_", F.expr(wide))
    changed = F.col("spans_").isNotNull()
    done = done.withColumn("new_", F.when(changed, F.expr(text)).otherwise(F.col("text_")))
    own = lambda c: F.col(f"row_.`{c}`")
    values = {text_col: F.col("new_")}
    if length_col:
        values[length_col] = F.when(changed, F.char_length("new_").cast(docs.schema[length_col].dataType)).otherwise(own(length_col))
    return done.select(*(values.get(c, own(c)).alias(c) for c in names))
