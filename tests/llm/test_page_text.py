"""Main text of generated pages whose articles are known, and tree matching against all order-keeping matchings."""
import html
import random

import pytest

from strandwork.llm import page_text

SCHEMA = "page_id long, url string, html string, text string, n_chars string, host string, form string, salt string, template string"


def words(rng, n):
    return " ".join(rng.choice(["one", "two & three", "naïve", "<four>", "\"five\"", "six", "seven"]) + str(rng.randrange(90)) for _ in range(n))


def page(rng, site, kind):
    """(html, main text). `kind` is how the page marks its article: by an element, by a role, or not at all."""
    title, paras = words(rng, 4), [words(rng, rng.randint(3, 30)) for _ in range(rng.randint(1, 6))]
    esc = lambda t: html.escape(t).replace(" ", rng.choice([" ", "\n  ", "&#32;"]))
    body = f"<h1>{esc(title)}</h1>" + "".join(rng.choice([f"<p>{esc(p)}</p>", f"<p>{esc(p)}", f"<p><b>{esc(p)}</b><br>", f"<p><i>{esc(p)}</p>"]) for p in paras)
    if rng.random() < 0.3:
        body += '<div class="share-buttons">Share <a href="#">this</a></div>'
    text = "\n".join(" ".join(t.split()) for t in [title, *paras])
    comments = f'<section id="comments"><h2>Comments</h2><div class="comment"><p>{esc(words(rng, 5))}</p></div></section>' if rng.random() < 0.5 else ""
    around = {
        "article": ("<article>", f"</article>{comments}"),
        "inside": ("<main><article>", f"<footer>by {esc(words(rng, 2))}</footer>{comments}</article></main>"),
        "role": ('<div role="main">', f"</div>{comments}"),
        "none": ('<div class="c">', f"</div>{comments}"),
    }[kind]
    menu = "".join(f'<li><a href="/{rng.random()}">{esc(words(rng, 1))}</a>' for _ in range(rng.randint(1, 6)))
    return (f'<!DOCTYPE html><html><head><title>{esc(title)}</title><style>p > a {{}}</style><script>var t="</p><article>";</script></head><body class="has-sidebar">'
            f'<header><div>{site}</div></header><nav><ul>{menu}</ul></nav><!-- <article> x --><div class="ad">{esc(words(rng, 6))}</div><div>Welcome to {site}</div>'
            f'<div class="no-sidebar">{around[0]}{body}{around[1]}</div><aside>{esc(words(rng, 9))}</aside><form><p>{esc(words(rng, 3))}</p><button>Go</button></form>'
            f'<div>All rights with {site}</div><footer>&copy; {site}</footer>' + rng.choice(["", "</body></html>"]), text)


@pytest.mark.parametrize("kind", ["article", "inside", "role", "none"])
def test_main_text_of_known_pages(spark, kind):
    rng, rows, want = random.Random(kind), [], {}
    for i in range(60):
        site = f"Site{i % 3}"
        source, text = page(rng, site, kind)
        if kind != "none":
            # Without a marked article only the wrapper can tell these two lines from content.
            source, text = source.replace(f"<div>Welcome to {site}</div>", ""), text
            source = source.replace(f"<div>All rights with {site}</div>", "")
        rows.append((i, f"https://{site}.EXAMPLE.com/{i}", source, "t", "n", "h", "f", "s", "x"))
        want[i] = text
    rows += [(100, rows[0][1], *rows[0][2:]), (101, rows[0][1], None, *rows[0][3:]), (102, None, "", *rows[0][3:]), (None, "x", "plain <b>text</b>\n&amp; more", *rows[0][3:])]
    want |= {100: want[0], 101: "", 102: "", None: "plain text & more"}
    got = page_text.extract(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert {r.page_id: r.text for r in got} == want and len(got) == len(rows)
    assert all(r.n_chars == len(r.text) for r in got)


def test_template_needs_several_distinct_pages(spark):
    rows = [(i, "http://a/", "<div>Same</div><div>Only</div>", *"123456") for i in range(9)] + [
        (10 + i, "http://b/", f"<div>Same</div><div>New {i}</div>", *"123456") for i in range(4)]
    got = {r.page_id: r.text for r in page_text.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: "Same\nOnly" for i in range(9)} | {10 + i: f"New {i}" for i in range(4)}
    assert page_text.extract(spark.createDataFrame([], SCHEMA)).collect() == []


def test_wrapper_is_learnt_from_every_text(spark):
    """Menus and paragraphs of a marked article are nodes of the wrapper like all others; markup checks its slots afterwards."""
    rows = [(i, "http://a/", f"<nav>Menu</nav><article><h1>Title {i}</h1><p>Always</p><div>Advice</div></article>", *"123456") for i in range(4)]
    pages = spark.createDataFrame(rows, SCHEMA)
    fixed = page_text._wrappers(page_text._read(pages), page_text.SHARE, page_text.PAGES)[1].collect()
    assert {(r.hash, r.open) for r in fixed} == {(page_text._hash("Menu"), False), (page_text._hash("Always"), False), (page_text._hash("Advice"), True)}
    assert {r.page_id: r.text for r in page_text.extract(pages).collect()} == {i: f"Title {i}\nAlways" for i in range(4)}


@pytest.mark.parametrize("source, text", [
    ("<p>a<p>b<table><tr><td>c<td>d<tr><td>e</table>f", "a\nb\nc\nd\ne\nf"), ("x<br>y&nbsp;z", "x y z"), ("<ul><li>a<ul><li>b</ul><li>c</ul>", "a\nb\nc"),
    ("<p title='>'>q</p><p title=\"<p>\">r", "q\nr"), ("a < b &amp;lt; &am &amp", "a < b &lt; &am &"), ("<div hidden>no</div><span class=ads>no</span>yes", "yes"),
    ("<article>a</article><article class=comment>b</article>", "a"), ("<div " * 5 + ">deep", "deep"), ("<div>" * 3000 + "deep", "deep"), ("</p></div>x<", "x<"), ("<script>never", ""), ("<p", "")])
def test_odd_markup(source, text):
    assert "\n".join(b[2] for b in page_text.parse(source)[1]) == text


def test_matching_is_the_largest_that_keeps_order():
    def size(a, b):
        (x, cs), (y, ds) = a, b
        if x != y:
            return 0
        best = [[0] * (len(ds) + 1) for _ in range(len(cs) + 1)]
        for i, c in enumerate(cs):
            for j, d in enumerate(ds):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + size(c, d))
        return 1 + best[-1][-1]

    def grow(rng, depth):
        return rng.choice("pq"), [grow(rng, depth - 1) for _ in range(rng.randint(0, 4))] if depth else []

    def text(t, depth=0):
        return "\n".join([f"{depth} {t[0]}", *[text(c, depth + 1) for c in t[1]]])

    rng = random.Random(3)
    for _ in range(300):
        a, b = grow(rng, 3), grow(rng, 3)
        found = page_text.match(text(a), text(b))
        used = [x for x in found if x >= 0]
        assert len(used) == len(set(used)) == size(a, b)
