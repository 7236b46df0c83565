"""Oracle SQL of operators that SQL can express on whole tables."""
from __future__ import annotations

from .secret_scan import BASE, WEAK

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, unnest(CASE WHEN len(ws) >= 2 THEN [concat(ws[i], ' ', ws[i + 1]) FOR i IN range(1, len(ws))] ELSE ws END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN n m ON m.doc_id = a JOIN n o ON o.doc_id = b WHERE 100 * c >= 80 * (m.n + o.n - c)),
near AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM near UNION SELECT r.a, x.b FROM reach r JOIN near x ON x.a = r.b),
least_ AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id, d.doc_id <= coalesce(low, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least_ ON a = d.doc_id"""

REPEATED_SPANS = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
w AS MATERIALIZED (SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM d WHERE len(ws) >= 13)),
low AS (SELECT g, min(doc_id) AS lo FROM w GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p FROM w JOIN low USING (g) WHERE lo < doc_id),
every AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM every ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(removed.n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)"""


def _secrets() -> str:
    """Matches and gaps of each pattern give places; weak parts are joined by interval."""
    parts = []
    for k, p in enumerate(BASE + WEAK):
        pattern = p.pattern.replace("'", "''")
        parts.append(f"""SELECT doc_id, {k} AS o, '{p.kind}' AS kind, '{p.role}' AS role, {str(p.strong).lower()} AS strong, unnest(range(1, len(f) + 1)) AS i, unnest(f) AS m, unnest(v) AS v, unnest(g[1:len(f)]) AS gap
  FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS f, regexp_extract_all(t, '{pattern}', {p.group}) AS v, string_split_regex(t, '{pattern}') AS g FROM t)
  WHERE len(f) > 0""")
    least = " ".join(f"WHEN {k} THEN length(v) BETWEEN {p.least} AND {p.most}" for k, p in enumerate(BASE + WEAK))
    n_base = len(BASE)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{p.kind}') AS n_{p.kind}" for p in BASE)
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
placed AS (SELECT *, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, o ORDER BY i) AS BIGINT) AS e FROM m),
s AS MATERIALIZED (SELECT doc_id, o, kind, role, strong, e - length(m) AS b, e FROM placed WHERE CASE o {least} END),
met AS (SELECT x.doc_id, x.o, x.kind, x.role, x.b, x.e,
    bool_or(y.role = 'identifier' AND NOT (y.b < x.e AND x.b < y.e)) AS ids, bool_or(y.role = 'secret' AND NOT (y.b < x.e AND x.b < y.e)) AS secrets, bool_or(y.strong AND y.b < x.e AND x.b < y.e) AS covered
  FROM s x JOIN s y ON x.doc_id = y.doc_id AND (x.o <> y.o OR x.b <> y.b) AND y.b <= x.e + 200 AND y.e >= x.b - 200 WHERE NOT x.strong GROUP BY ALL),
spans AS (SELECT doc_id, o, kind, b, e FROM s WHERE strong UNION ALL
  SELECT doc_id, o, kind, b, e FROM met WHERE NOT covered AND ((role = 'identifier' AND secrets) OR (role = 'secret' AND ids) OR (role = 'endpoint' AND ids AND secrets))),
listed AS (SELECT doc_id, {counts}, string_agg(concat(kind, ':', b, ':', e), ',' ORDER BY b, o) FILTER (WHERE o < {n_base}) AS base, string_agg(concat(kind, ':', b, ':', e), ',' ORDER BY b, o) AS spans FROM spans GROUP BY doc_id)
SELECT t.doc_id, {", ".join(f"coalesce(n_{p.kind}, 0) AS n_{p.kind}" for p in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN listed USING (doc_id)"""


SECRETS = _secrets()


def _manifest(levels: int = 20, over: int = 8) -> str:
    """Trees of at most 2 ** levels documents in a language and 2 ** over languages, level by level."""
    def leaf(n_chars: str) -> str:
        fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", f"CAST({n_chars} AS VARCHAR)", "text"]
        return "sha256(concat(" + ", ".join(f"CASE WHEN {f} IS NULL THEN '-' ELSE concat(strlen({f}), ':', {f}) END" for f in fields) + "))"

    # CRC-32 bit by bit: a byte is xored in, eight marks shift one bit each.
    crc = ("xor(list_reduce([4294967295] || flatten([[CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]), "
           "lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)")
    parts = [f"""l AS MATERIALIZED (SELECT doc_id, coalesce('v' || lang, 'n') AS g, {leaf("n_chars")} AS leaf,
  CASE WHEN {crc} % 7 = 0 THEN {leaf("n_chars + 1")} END AS other FROM documents)""",
             """t0 AS MATERIALIZED (SELECT *, leaf AS h, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY g) AS n FROM l)"""]

    def tree(t: str, count: int) -> None:
        for j in range(count):
            parts.append(f"""{t}{j + 1} AS MATERIALIZED (SELECT g, p // 2 AS p, (min(n) + 1) // 2 AS n, CASE WHEN min(n) > 1 THEN sha256(string_agg(h, '' ORDER BY p)) ELSE min(h) END AS h
  FROM {t}{j} GROUP BY g, p // 2)""")

    def fold(t: str, f: str, count: int) -> None:
        for j in range(count):
            parts.append(f"""{f}{j + 1} AS MATERIALIZED (SELECT f.* REPLACE (f.p // 2 AS p, (f.n + 1) // 2 AS n,
    CASE WHEN f.n > 1 THEN concat(f.proof, s.h) ELSE f.proof END AS proof,
    CASE WHEN f.n > 1 THEN sha256(CASE WHEN f.p % 2 = 1 THEN concat(s.h, f.acc) ELSE concat(f.acc, s.h) END) ELSE f.acc END AS acc)
  FROM {f}{j} f LEFT JOIN {t}{j} s ON s.g = f.g AND s.p = xor(f.p, 1))""")

    tree("t", levels)
    parts.append(f"s0 AS MATERIALIZED (SELECT '' AS g, g AS lang, row_number() OVER (ORDER BY g) - 1 AS p, count(*) OVER () AS n, h FROM t{levels})")
    tree("s", over)
    parts.append("f0 AS (SELECT doc_id, g, leaf, coalesce(other, leaf) AS acc, '' AS proof, p, n FROM t0)")
    fold("t", "f", levels)
    parts.append(f"o0 AS (SELECT f.* REPLACE ('' AS g, s0.p AS p, s0.n AS n), s0.h AS subroot FROM f{levels} f JOIN s0 ON s0.lang = f.g)")
    fold("s", "o", over)
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = r.h AS verified FROM o{over} o CROSS JOIN s{over} r"""


MANIFEST = _manifest()

COLLOCATIONS = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex({_LOWER}, '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS ws FROM documents),
g AS ({" UNION ALL ".join(f"SELECT lang, {k} AS k, ws[i:i + {k - 1}] AS ph FROM (SELECT lang, ws, unnest(range(1, len(ws) - {k - 2})) AS i FROM p WHERE len(ws) >= {k})" for k in range(1, 6))}),
f AS MATERIALIZED (SELECT lang, k, ph, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM p GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, ph, f AS a FROM f WHERE k >= 2),
inner_ AS (SELECT lang, ph[i:i + m - 1] AS ph, max(a) AS most FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c)) GROUP BY ALL),
cuts AS (SELECT lang, ph, a, unnest(range(1, k)) AS j, k FROM c),
s AS (SELECT cuts.lang, cuts.ph, a, j, x.f AS l, y.f AS r, n, ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score FROM cuts JOIN n USING (lang)
  JOIN f x ON x.lang = cuts.lang AND x.ph = cuts.ph[1:j] JOIN f y ON y.lang = cuts.lang AND y.ph = cuts.ph[j + 1:cuts.k]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, j) = 1),
z AS (SELECT b.lang, array_to_string(b.ph, ' ') AS phrase, a, l, r, n, score FROM b LEFT JOIN inner_ i ON i.lang = b.lang AND i.ph = b.ph WHERE most IS NULL OR 100 * most < 100 * a)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS INTEGER) AS rank, phrase, a, l, r, n, score FROM z
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000"""

#: Holds for the markup of the given pages: an article element of headings and paragraphs, with these character references.
PAGE_TEXT = r"""
WITH b AS (SELECT page_id, url, unnest(bs) AS x, generate_subscripts(bs, 1) AS i
  FROM (SELECT page_id, url, string_split_regex(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>') AS bs FROM pages)),
plain AS (SELECT page_id, url, i, replace(regexp_replace(x, '</?b>', '', 'g'), '<br>', ' ') AS x FROM b),
said AS (SELECT page_id, url, i, regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g') AS x FROM plain),
one AS (SELECT page_id, url, i, trim(regexp_replace(x, '[\x09-\x0D\x20]+', ' ', 'g')) AS x FROM said),
t AS (SELECT page_id, url, coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE x <> ''), '') AS text FROM one GROUP BY page_id, url)
SELECT page_id, url, text, length(text) AS n_chars FROM t"""
