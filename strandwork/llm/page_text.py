"""Main text of HTML pages by wrapper induction over the pages of a host.

Each page becomes a tree of its block elements; runs of equal siblings (paragraphs, list items, cells) are one repeated node, so trees stay as small as the page's layout.
The commonest tree of a host is its wrapper. Every other tree of the host is aligned with it by simple tree matching: equal labels match, and children are matched in order
with the largest total. All texts of the pages, menus and articles alike, are then counted per wrapper node over the host's distinct pages. A text that stands in a node on
nearly all of them is template, texts that vary are its slot. A page's main text is the text of its slots, checked against markup afterwards: what it calls a menu, header,
footer, sidebar, notice, advert, form or reader comments goes, and inside an article element paragraphs, headings, lists and tables stay even where pages repeat them.

Trees are aligned once per host and distinct tree, never per page, and counts are partial sums, so a hot host does not gather in one task. Pages meet the template nodes of
their host by a join that is salted on both sides; a host without any adds no rows there.
"""
from __future__ import annotations

import html
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, stored

#: A text is template on this share of a host's distinct pages, of which there must be so many.
SHARE, PAGES = 0.9, 3
_SALTS = 32

# HTML elements by kind.
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li "
    "main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes svg math".split())
_NEVER = frozenset("nav footer aside form button select dialog menu search head option audio video canvas object fieldset".split())
_FIRM = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th caption pre blockquote figcaption summary".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
# Elements that an element of this name closes, up to one of the second set.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
#: Words in a class or id that mark what is not the article.
_COMMENTS = frozenset("comment comments commentlist disqus reply replies respond responses".split())
_MARKS = _COMMENTS | frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar footer masthead topbar toolbar "
    "cookie cookies consent gdpr notice notices popup modal overlay banner social share sharing related recommended newsletter subscribe subscription signup login pagination pager widget".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+)>?|<[!?/][^>]*+>?""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _words(attrs: dict[str, str]) -> set[str]:
    """Lower-case words of class and id; `no-sidebar` or `has-menu` say nothing of the element itself."""
    said = re.sub(r"([a-z])([A-Z])", r"\1-\2", attrs.get("class", "") + " " + attrs.get("id", "")).lower()
    return set(re.findall(r"[a-z]+", re.sub(r"\b(?:no|has|with|without)[-_][a-z]+", "", said)))


class _Node:
    __slots__ = ("tag", "label", "parent", "parts", "no", "main", "marked", "off")

    def __init__(self, tag: str, parent: _Node | None, attrs: dict[str, str]):
        self.tag, self.parent, self.parts, self.no = tag, parent, [], -1
        role = attrs.get("role", "").lower()
        words = _words(attrs)
        self.label = tag + "." + ".".join(sorted(attrs.get("class", "").split()))
        said = words & _COMMENTS
        self.main = (tag in ("article", "main") or role == "main" or attrs.get("itemprop", "").lower() == "articlebody") and not said
        self.off = tag in _NEVER or role in _ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN.search(attrs.get("style", "")))
        self.marked = bool(said if tag in ("article", "main", "body", "html") else words & _MARKS) or (tag == "header" and not any(n.main for n in _line(parent)))


def _line(node: _Node | None) -> Iterator[_Node]:
    while node is not None:
        yield node
        node = node.parent


def _attrs(text: str) -> dict[str, str]:
    if not text.strip(" /\t\r\n"):
        return {}
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)}


def _tree(source: str) -> _Node:
    """The tree of block elements; `parts` holds child nodes and, between them, lists of text pieces."""
    root = _Node("html", None, {})
    stack = [("html", root, False)]  # open elements: name, the block they belong to, whether their text is left out
    at, size = 0, len(source)

    def say(text: str) -> None:
        _, node, mute = stack[-1]
        if text and not mute:
            if not node.parts or not isinstance(node.parts[-1], list):
                node.parts.append([])
            node.parts[-1].append(text)

    while at < size:
        m = _TOKEN.search(source, at)
        if m is None:
            say(html.unescape(source[at:]))
            break
        if m.start() > at:
            say(html.unescape(source[at:m.start()]))
        at = max(m.end(), at + 1)
        name = m[2].lower() if m[2] else ""
        if not name:
            continue
        if m[1]:
            if any(e[0] == name for e in stack[1:]):
                while stack[-1][0] != name:
                    stack.pop()
                stack.pop()
            continue
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}(?![^\s/>])[^>]*>?", re.I).search(source, at)
            at = end.end() if end else size
            continue
        if name in _VOID and name != "hr":
            if name == "br":
                say(" ")
            continue
        attrs = _attrs(m[3])
        if name not in _BLOCK:
            mute = stack[-1][2] or name in _NEVER or bool(_words(attrs) & _MARKS) or "hidden" in attrs or bool(_HIDDEN.search(attrs.get("style", "")))
            if not m[3].endswith("/"):
                stack.append((name, stack[-1][1], mute))
            continue
        closes, until = _CLOSES.get(name, ((), ()))
        if closes:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in until:
                    break
                if stack[i][0] in closes:
                    del stack[i:]
                    if name != "tbody" and name != "tfoot" and name != "tr":
                        break
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == "p":
                del stack[i:]
                break
            if stack[i][0] in _BLOCK:
                break
        if name in ("html", "body"):
            parent = stack[-1][1]
            if parent.tag == name or any(e[0] == "body" for e in stack):
                continue
        node = _Node(name, stack[-1][1], attrs)
        stack[-1][1].parts.append(node)
        if name != "hr":
            stack.append((name, node, stack[-1][2]))
    return root


def parse(source: str) -> tuple[str, list[tuple[int, bool, str]], int, list[tuple[int, int, bool]]]:
    """Tree of a page as text (level and label of each node in page order), the blocks markup lets pass, a hash of them, and (node, hash, open) of every text.

    A block is (node, firm, text). The wrapper is learnt from every text of the page; markup only checks what it gives: blocks it rules out are not listed, and `firm`
    blocks are content wherever they repeat. A text is open if it stands in a listed block that is not firm.
    """
    root = _tree(source)
    holds, mains, every = set(), [], [root]
    for node in every:
        every.extend(p for p in node.parts if isinstance(p, _Node))
    for node in every:
        if node.main and not any(n.off for n in _line(node)):
            holds.update(id(n) for n in _line(node))
            mains.append(node)
    # A class such as `no-sidebar` around the article does not rule the article out.
    for node in every:
        node.off = node.off or (node.marked and id(node) not in holds)
    mains = [n for n in mains if not any(x.off for x in _line(n))]
    articles = [n for n in mains if n.tag == "article"]
    region = {id(n) for n in (articles or mains)}
    labels: list[str] = []
    blocks: list[tuple[int, bool, str]] = []
    texts: dict[tuple[int, int], bool] = {}

    def number(group: list[_Node], level: int) -> None:
        """Numbers nodes of equal label together and then their children, runs of equal ones as one node."""
        todo = [(group, level)]
        while todo:
            nodes, depth = todo.pop()
            labels.append(f"{depth} {nodes[0].label}")
            for n in nodes:
                n.no = len(labels) - 1
            runs: list[list[_Node]] = []
            for n in nodes:
                for child in n.parts:
                    if isinstance(child, _Node):
                        if runs and runs[-1][0].label == child.label:
                            runs[-1].append(child)
                        else:
                            runs.append([child])
            todo.extend((run, depth + 1) for run in reversed(runs))

    number([root], 0)
    walk = [(root, iter(root.parts), root.off, id(root) in region)]
    while walk:
        node, parts, off, inside = walk[-1]
        part = next(parts, None)
        if part is None:
            walk.pop()
        elif isinstance(part, list):
            text = " ".join("".join(part).split())
            passes = bool(text) and not off and (inside or not region)
            firm = node.tag == "h1" or (inside and (node.tag in _FIRM or id(node) in region))
            if text:
                said = (node.no, _hash(text))
                texts[said] = texts.get(said, False) or (passes and not firm)
            if passes:
                blocks.append((node.no, firm, text))
        else:
            walk.append((part, iter(part.parts), off or part.off, inside or id(part) in region))
    return "\n".join(labels), blocks, _hash("\n".join(b[2] for b in blocks)), [(n, h, o) for (n, h), o in texts.items()]


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("node", pa.int32()), ("hash", pa.int64()), ("text", pa.string())]))
    said = pa.list_(pa.struct([("node", pa.int32()), ("hash", pa.int64()), ("open", pa.bool_())]))
    for batch in batches:
        for part in pieces(batch, 2):
            done = [parse(t or "") for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(1), pa.array([d[0] for d in done], pa.string()),
                pa.array([[{"node": n, "hash": None if firm else _hash(t), "text": t} for n, firm, t in d[1]] for d in done], kind), pa.array([d[2] for d in done], pa.int64()),
                pa.array([[{"node": n, "hash": h, "open": o} for n, h, o in d[3]] for d in done], said)], names=["page_id", "url", "form", "blocks", "body", "texts"])


def _children(form: str) -> tuple[list[str], list[list[int]], list[int]]:
    """Labels, children and whole-subtree hashes of a tree given as text."""
    labels, children, last = [], [], {}
    for i, line in enumerate(form.split("\n")):
        depth, label = line.split(" ", 1)
        labels.append(label)
        children.append([])
        if i:
            children[last[int(depth) - 1]].append(i)
        last[int(depth)] = i
    whole = [0] * len(labels)
    for i in range(len(labels) - 1, -1, -1):
        whole[i] = hash((labels[i], tuple(whole[c] for c in children[i])))
    return labels, children, whole


def match(a: str, b: str) -> list[int]:
    """Simple tree matching of tree `b` with tree `a`: for each node of `b` its node in `a`, or -1.

    Equal subtrees at either end of two child lists are matched directly, which never lowers the total.
    """
    la, ca, wa = _children(a)
    lb, cb, wb = _children(b)
    memo: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def sides(x: int, y: int) -> tuple[list[tuple[int, int]], list[int], list[int]]:
        m, n = ca[x], cb[y]
        i = 0
        while i < min(len(m), len(n)) and wa[m[i]] == wb[n[i]]:
            i += 1
        j = 0
        while j < min(len(m), len(n)) - i and wa[m[-1 - j]] == wb[n[-1 - j]]:
            j += 1
        return [(m[k], n[k]) for k in range(i)] + [(m[-1 - k], n[-1 - k]) for k in range(j)], m[i:len(m) - j], n[i:len(n) - j]

    def solve(x: int, y: int) -> None:
        """Fills `memo` for a pair and the pairs below it, deepest first."""
        todo = [(x, y, False)]
        while todo:
            x, y, ready = todo.pop()
            if (x, y) in memo:
                continue
            ends, m, n = sides(x, y)
            below = [(p, q) for p in m for q in n if la[p] == lb[q]]
            if not ready:
                todo.append((x, y, True))
                todo.extend((p, q, False) for p, q in ends + below if (p, q) not in memo)
                continue
            rows = [[0] * (len(n) + 1)]
            for p in m:
                up, row = rows[-1], [0]
                for k, q in enumerate(n):
                    best = max(row[-1], up[k + 1])
                    if la[p] == lb[q]:
                        best = max(best, up[k] + memo[p, q][0])
                    row.append(best)
                rows.append(row)
            pairs, i, k = list(ends), len(m), len(n)
            while i and k:
                if rows[i][k] == rows[i - 1][k]:
                    i -= 1
                elif rows[i][k] == rows[i][k - 1]:
                    k -= 1
                else:
                    i, k = i - 1, k - 1
                    pairs.append((m[i], n[k]))
            memo[x, y] = (1 + rows[-1][-1] + sum(memo[e][0] for e in ends), pairs)

    out = [-1] * len(lb)
    if la[0] == lb[0]:
        solve(0, 0)
        todo = [(0, 0)]
        while todo:
            x, y = todo.pop()
            out[y] = x
            todo.extend(memo[x, y][1])
    return out


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, form_id, n, at): where the nodes of a tree lie in its host's wrapper."""
    for batch in batches:
        rows = [match(a, b) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(4), pa.array(rows, pa.list_(pa.int32()))], names=["host", "form_id", "n", "at"])


def _read(pages: DataFrame) -> DataFrame:
    """page_id, url, form, blocks, body, texts of each page (`parse`), with its host and a hash of its form."""
    parsed = pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(
        _parsed, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, form string, blocks array<struct<node:int,hash:long,text:string>>, body long, "
                 "texts array<struct<node:int,hash:long,open:boolean>>")
    host = F.translate(F.regexp_extract("url", r"^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return parsed.withColumns({"host": F.when(host != "", host), "form_id": F.xxhash64("form")})


def _wrappers(parsed: DataFrame, share: float, least: int) -> tuple[DataFrame, DataFrame]:
    """(host, form_id, node, at): the place of each tree's nodes in the wrapper; and (host, at, hash, open): the template texts there."""
    key = ["host", "form_id"]
    # Distinct pages, by all their candidate blocks.
    seen = parsed.where(F.col("host").isNotNull()).select(*key, "form", "body", "texts")
    seen = stored(seen.groupBy(*key, "body").agg(F.first("form").alias("form"), F.min("texts").alias("texts")), "page-forms")
    forms = seen.groupBy(*key).agg(F.first("form").alias("form"), F.count(F.lit(1)).alias("n"))
    hosts = forms.groupBy("host").agg(F.max_by("form", F.struct("n", "form_id")).alias("wrapper"), F.sum("n").alias("pages"))
    hosts = hosts.where(F.col("pages") >= least).select("host", "wrapper")
    aligned = stored(forms.join(hosts, "host").select(*key, "wrapper", "form", "n").mapInArrow(_matched, "host string, form_id long, n long, at array<int>"), "page-aligned")
    nodes = aligned.select(*key, "n", F.posexplode("at").alias("node", "at")).where("at >= 0")
    # Runs of equal siblings share a node, so texts are counted by the pages that hold them there.
    met = nodes.groupBy("host", "at").agg(F.sum("n").alias("of"))
    said = seen.select(*key, "texts").join(aligned.select(*key, F.col("at").alias("places")), key).select("host", "places", F.inline("texts"))
    # Two nodes of a tree never lie at one node of the wrapper, so a page counts once.
    said = said.select("host", F.get("places", "node").alias("at"), "hash", "open").where("at >= 0").groupBy("host", "at", "hash").agg(F.count(F.lit(1)).alias("c"), F.max("open").alias("open"))
    fixed = said.where(F.col("c") >= share * least).join(met, ["host", "at"]).where((F.col("of") >= least) & (F.col("c") >= share * F.col("of"))).select("host", "at", "hash", "open")
    return nodes.drop("n"), fixed


def extract(pages: DataFrame, share: float = SHARE, least: int = PAGES) -> DataFrame:
    """page_id, url, text and n_chars of every row of `pages` (page_id, url, html).

    Blocks are joined in page order by a line break, white space inside a block is one space, character references are decoded. A null or empty html has an empty text.
    Pages without a host (null url, no `://`) have no wrapper and keep all that markup leaves. A host with fewer than `least` distinct pages has no template texts; copies
    count once. Repeated rows and ids are kept, an empty table gives no rows, other columns are ignored.
    """
    parsed = _read(pages)
    key = ["host", "form_id"]
    nodes, fixed = _wrappers(parsed, share, least)
    # Template texts that markup rules out or keeps on every page need no lookup.
    template = nodes.join(fixed.where("open"), ["host", "at"]).groupBy(*key).agg(F.collect_set(F.struct("node", "hash")).alias("template"))
    template = template.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    salted = parsed.drop("texts").withColumn("salt", F.pmod(F.xxhash64("url", "body", F.col("page_id")), F.lit(_SALTS)).cast("int"))
    slots = F.filter("blocks", lambda b: b["hash"].isNull() | F.col("template").isNull() | ~F.array_contains(
        F.col("template"), F.struct(b["node"].alias("node"), b["hash"].alias("hash"))))
    text = F.array_join(F.transform(slots, lambda b: b["text"]), "\n")
    out = salted.join(template, [*key, "salt"], "left").select("page_id", "url", text.alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
