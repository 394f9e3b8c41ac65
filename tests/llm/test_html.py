import html as entities
import random
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest

from tidelog.llm import html
from tidelog.llm.html import Reader, extract, frequent_tokens, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>x</article>";</script></head>
<body class="site"><header class="top"><h1>Site</h1></header><nav><ul><li>One<li>Two</ul></nav>
<div id="cookie-notice">We use cookies</div><div class="ad">Buy</div>
<main><article><header><h1>Head &amp; line</h1></header><p>First <b>bold</b>  text&nbsp;here<br>and more<p>Second <!-- no --> &lt;one&gt;
<aside class="sidebar">Side</aside><ul><li>a<li>b</ul><form><p>Mail</p><input></form><div class='share-buttons'>Share</div>
<section class="comments"><p>Nice!</p></section><blockquote>Said &#8220;so&#8221;</blockquote></article></main>
<footer>&copy; all</footer></body></html>"""
TEXT = "Head & line\nFirst bold text here and more\nSecond <one>\na\nb\nSaid “so”"


def test_main_text():
    assert main_text(PAGE) == TEXT
    assert main_text("") == "" and main_text("<") == "<" and main_text("<script>x") == "" and main_text("<p>a<!-- b") == "a"
    assert main_text("<article>" + "<div>" * 3000 + "deep") == "deep"
    assert main_text("<article><p>cut off &am") == "cut off &am"


def test_fullest_slot():
    page = "<div class=x><p>short</p></div><div class=y><p>a much longer text</p><p>and more</p></div>"
    assert main_text(page) == "a much longer text\nand more"


def test_slot_keeps_all_below():
    post = "<div class=post><p>Some text that is long</p><ul><li>item</li></ul><blockquote><p>quote</p></blockquote><section><h2>part</h2><p>nested</p></section><table><tr><td>cell</table><div class=in><p>inner</p></div></div>"
    assert main_text("<div class=x><p>aside</p></div>" + post) == "Some text that is long\nitem\nquote\npart\nnested\ncell\ninner"
    assert main_text("<div class=post><p>own</p><ul><li>a much longer item</li></ul><div class=in><p>the longest of all of them</p></div></div>") == "own\na much longer item\nthe longest of all of them"


def test_hidden_is_an_attribute():
    shown = ('class="overflow-hidden"', "aria-hidden=false", 'data-x="hidden"', "id='is hidden'", 'title="display: none"')
    assert all(main_text(f"<article><div {a}>text</div></article>") == "text" for a in shown)
    hidden = ("hidden", "class=a hidden", 'hidden=""', 'aria-hidden="true"', "style='color:red; display : none'")
    assert all(main_text(f"<article>a<div {a}>text</div></article>") == "a" for a in hidden)
    assert main_text("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be</p></article>") == "Let x=2 be"


def test_template(spark):
    shell = "<html><body><div class=c><div><p>Always here</p></div><div class=z><p>{}</p><p>Read on</p></div></div></body></html>"
    rows = [(i, f"http://h.example/{i}", shell.format(f"own words {i} " * (i + 1)), "x") for i in range(8)]
    rows += [(100, "http://small.example/", shell.format("alone"), "x"), (101, None, None, "x"), (102, "/relative", "", "x"), (3, rows[3][1], rows[3][2], "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    out = {(r.page_id, r.url): r for r in extract(pages).collect()}
    assert all(out[i, f"http://h.example/{i}"].text == " ".join(f"own words {i} " .split() * (i + 1)) for i in range(8))
    assert out[100, "http://small.example/"].text == "alone\nRead on"
    assert (out[101, None].text, out[101, None].n_chars, out[102, "/relative"].text) == ("", 0, "")
    assert extract(pages).count() == len(rows) and extract(pages.limit(0)).count() == 0


def test_types_of_pages_and_copies(spark):
    """Types of a third each have templates of their own; copies and shared lines of articles are no template."""
    rows = []
    for kind in ("news", "shop", "blog"):
        for i in range(8):
            rows.append((len(rows), f"http://types.example/{kind}{i}", f"<body class={kind}><div class=c><p>{kind} text {i}</p><p>Notice of {kind}</p></div></body>"))
    copy = "<article><h1>Heading</h1><p>Copied line</p></article>"
    rows += [(100 + i, f"http://copies.example/{i}", copy) for i in range(8)]
    similar = "<article><h1>Shared head</h1><p>Shared line</p><p>{}</p></article>"
    rows += [(200 + i, f"http://similar.example/{i}", similar.format(i) if i < 8 else f"<article><p>own {i}</p><h1>other {i}</h1></article>") for i in range(14)]
    out = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert all(out[i] == re.search("<p>(.*?)</p>", h)[1] for i, _, h in rows[:24])
    assert all(out[100 + i] == "Heading\nCopied line" for i in range(8))
    assert all(out[200 + i] == f"Shared head\nShared line\n{i}" for i in range(8))


@pytest.mark.parametrize("texts", [html.BROADCAST_ROWS, 0])
def test_long_and_many_texts(spark, monkeypatch, texts):
    """Template texts of any length and number are found, broadcast or joined by page."""
    monkeypatch.setattr(html, "BROADCAST_ROWS", texts)
    many = "".join(f"<p>notice {i}</p>" for i in range(4100))
    shell = "<article><section class=n>" + many + "</section><div class=legal>" + "All rights reserved. " * 20 + "</div><p>{}</p></article>"
    rows = [(i, f"http://h.example/{i}", shell.format(f"own {i}")) for i in range(6)]
    rows += [(100, None, "<p>alone</p>"), (3, *rows[3][1:])]
    out = extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.text) for r in out) == sorted([(i, f"own {i}") for i in (0, 1, 2, 3, 3, 4, 5)] + [(100, "alone")])


def test_classes(spark):
    """Vectors combined in parts equal vectors of the whole, and tokens of one class occur equally often on each page."""
    rows = [(i, "h", f"<div><p>same</p><p>own {i}</p></div>" + "<hr><ol></ol>" * (i % 2)) for i in range(10)]
    pages = spark.createDataFrame(rows + rows[:1], "key long, host string, h string")
    one, many = ({r.token: r for r in frequent_tokens(pages.repartition(n)).collect()} for n in (1, 4))
    signed = lambda t: t - (1 << 64) if t >= 1 << 63 else t
    found = [Reader(r[2]) for r in rows]
    counts = [Counter(map(signed, r.tokens)) + Counter({signed(g): n for g, n in r.groups.items()}) for r in found]
    often = {t for t in set().union(*counts) if sum(t in c for c in counts) >= 4}
    assert set(one) == set(many) == often and all(one[t].vector == many[t].vector for t in often)
    for t in often:
        for u in often:
            assert (one[t].vector == one[u].vector) == all(c[t] == c[u] for c in counts)


WORDS = "wind river stone light garden paper window table music winter summer road field bread silver cloud".split()


def unnamed(i, rng):
    """A page whose elements have no telling names: menu, notice, article, related lines and answers are all ``div``."""
    say = lambda a, b: " ".join(rng.choices(WORDS, k=rng.randint(a, b)))
    article = [f"{say(3, 6)} {i}"] + [say(20, 60) for _ in range(rng.randint(2, 5))]
    notice = "All of what is said here is meant for readers of this site alone and must not be given to others, in whole or in part, without leave."
    menu = "".join(f"<li>{w}</li>" for w in ("Home", "News", "Shop", say(1, 1)))
    body = f"<div><ul>{menu}</ul></div><div>{say(4, 8)}</div><div><h1>{article[0]}</h1>" + "".join(f"<p>{p}</p>" for p in article[1:])
    body += f"<p class=z>{notice}</p></div><div>" + "".join(f"<div>{say(3, 6)}</div>" for _ in range(rng.randint(1, 6))) + "</div><div>1999 Example Press</div>"
    return f"<html><head><title>x</title></head><body>{body}</body></html>", "\n".join(article)


def test_without_names(spark):
    """Only the template tells what the text is; without it the result is another. Repeated rows don't cancel."""
    rng = random.Random(5)
    made = [unnamed(i, rng) for i in range(12)]
    made.append((made[0][0].replace("".join(f"<p>{p}</p>" for p in made[0][1].split("\n")[1:]), "<p>short</p>"), made[0][1].split("\n")[0] + "\nshort"))
    rows = [(i, f"http://plain.example/{i}", h) for i, (h, _) in enumerate(made)]
    for times in (1, 2):
        out = {r.page_id: r.text for r in extract(spark.createDataFrame(rows * times, "page_id long, url string, html string").repartition(3)).collect()}
        assert out == {i: t for i, (_, t) in enumerate(made)}
    assert all(main_text(h) != t for h, t in made)


def test_order_and_nesting(spark):
    """Texts that all pages have, but not in one order or not in one gap, are no template."""
    moving = "<body><div class=c><div class=x>{}</div><div class=y>{}</div></div></body>"
    rows = []
    for i in range(8):
        a, b = f"<p>own {i} and so on</p>", "<blockquote class=q>Always said</blockquote><h2 class=r>Said too</h2>"
        rows.append((i, "http://order.example/", moving.format(a + b if i % 2 else a + "<h2 class=r>Said too</h2><blockquote class=q>Always said</blockquote>", "")))
    out = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {i: f"own {i} and so on\n" + ("Always said\nSaid too" if i % 2 else "Said too\nAlways said") for i in range(8)}


def plain(h):
    """A page without the names that tell what its elements are."""
    h = re.sub("<(/?)(article|nav|footer)>", r"<\1div>", h)
    return h.replace('<div class="ad">', "<div>")


def test_table_without_names(spark):
    """The template alone finds the articles of all hosts that have one; few pages have too little text to tell."""
    table = pq.read_table("/root/testdata/sf0.1/pages.parquet").to_pandas()
    host = table.url.str.extract("//([^/]*)")[0]
    table = table[host.map(host.value_counts()) >= 20]
    pages = spark.createDataFrame(table)
    want = {r.page_id: r.text for r in extract(pages).collect()}
    bare = table.assign(html=table.html.map(plain))
    out = {r.page_id: r.text for r in extract(spark.createDataFrame(bare)).collect()}
    right = sum(out[i] == want[i] for i in want)
    alone = sum(main_text(h) == want[i] for i, h in zip(bare.page_id, bare.html))
    print(len(want), right, alone)
    assert right >= 0.98 * len(want) > alone


def test_table(spark):
    t = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    out = {r.page_id: r.text for r in extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()}
    for r in t:
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        lines = (" ".join(entities.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article))
        assert out[r["page_id"]] == "\n".join(x for x in lines if x)
