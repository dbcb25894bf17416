"""HTML extraction and benchmark decontamination."""

import random

import pytest
from pyspark.sql import functions as F

from docmill.llm import decontaminate as D
from docmill.llm import html as H

PAGE = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/x">menu {n}</a></li></ul></nav><!-- ad --><div class="ad">buy {n}</div>
<div id="cookie-notice">We use cookies</div>{body}<aside>side</aside><form><p>Sign up</p></form>
<section class="comments"><p>first! {n}</p></section><footer>&copy; {n}</footer></body></html>"""


def page(n, body):
    return PAGE.format(n=n, body=body)


def extracted(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as host", "'x' as path", "'x' as text")
    return {r.page_id: r.text for r in H.extract_main(df).collect()}


def test_article_is_kept_whole(spark):
    body = "<article><header><h1>Title  one</h1><p>by me</p></header><p><b>A &lt; B<br>and\n C &copy;<p>Second&nbsp; one</p><ul><li>x<li>y</ul><table><tr><td>1</td><td>2</td></tr></table></article>"
    rows = [(k, f"https://h.example/en/{k}", page(k, body)) for k in range(4)]
    assert set(extracted(spark, rows).values()) == {"Title one\nA < B and C ©\nSecond one\nx\ny\n1 2"}


def test_differencing_drops_shared_lines(spark):
    rows = []
    for k in range(6):
        own = "".join(f"<p>own text {k} {i}</p>" for i in range(5))
        rows.append((k, f"https://h.example/a/{k}", f"<body><div>Welcome to us</div><div>All rights {k % 1}</div>{own}<div>Imprint</div></body>"))
    got = extracted(spark, rows)
    for k in range(6):
        assert got[k] == "\n".join(f"own text {k} {i}" for i in range(5))
    # a copy of a page is no template of it
    rows = [(0, "https://h.example/a/0", "<p>one</p><p>two</p><p>three</p>"), (1, "https://h.example/a/1", "<p>one</p><p>two</p><p>three</p>")]
    assert set(extracted(spark, rows).values()) == {"one\ntwo\nthree"}
    assert extracted(spark, [(0, "https://h.example/a/0", "<p>one</p>"), (1, "https://other.example/a/1", "<p>one</p><p>b</p><p>c</p>")])[1] == "one\nb\nc"


def test_pages_odd(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "https://h/", "<p"), (3, "https://h/", "<p"), (4, "https://h/", "plain <b>text"), (5, "https://h/", "<script>alert('<p>x</p>')"),
            (6, "https://h/z", "<article>" + "<p>x" * 20_000), (None, None, None), (7, "q", "<article><p></article></div></p>a")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = H.extract_main(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    text = {r.page_id: r.text for r in got}
    assert text[1] == text[2] == text[5] == text[None] == "" and text[4] == "plain text" and text[6].count("\n") == 19_999
    assert H.extract_main(df.limit(0)).count() == 0


def test_common_lines_are_a_longest_common_subsequence():
    rng = random.Random(7)
    for _ in range(300):
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        kept = [x for x, s in zip(a, H.common_lines(a, b)) if s]
        rest = iter(b)
        assert len(kept) == best[-1][-1] and all(x in rest for x in kept)


ITEM = "A train leaves at 40 km per hour from Berlin while 3 cars wait, then 40 people board and ride for 5 hours to Paris together."


def leaks(spark, texts, items=((1, ITEM),), **how):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = D.find_leaks(docs, spark.createDataFrame(list(items), "item_id long, text string"), **how).collect()
    return {r.doc_id: (r.item_ids, r.longest_run) for r in found}


def test_templates(spark):
    other = ITEM.replace("40", "65").replace("km", "miles").replace("Berlin", "Oslo").replace("Paris", "Rome").replace("5 hours", "7 days").replace("3 cars", "9 cars")
    crossed = other.replace("65 people", "9 people")  # one number of the item for two of the document's
    merged = ITEM.replace("40", "3").replace("5 hours", "3 hours")
    got = leaks(spark, [f"Intro words here. {ITEM} Outro", other, crossed, merged, "Clean text " * 30], run=18)
    assert got[0][0] == [1] and got[1][0] == [1] and got[4] == ([], 0)
    assert got[2] == ([], 0) and got[3] == ([], 0)


def test_leaks_against_brute_force(spark, sf_dir, documents):
    items = {r.item_id: r.text.split() for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    got = {r.doc_id: set(r.item_ids) for r in D.find_leaks(documents[1], spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    for i, text in documents[0]:
        w = (text or "").split()
        for item, own in items.items():
            n = min(12, len(own))
            runs = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)}
            if any(tuple(w[k : k + n]) in runs for k in range(len(w) - n + 1)):
                assert item in got[i]
    assert 0 < sum(bool(x) for x in got.values()) < len(got) / 4
    assert len(got) == len(documents[0])


@pytest.mark.parametrize("small", [0, 1 << 20])
def test_shuffle_path_gives_the_same(spark, sf_dir, documents, monkeypatch, small):
    monkeypatch.setattr(D, "SMALL_SIDE", small)
    got = {r.doc_id: tuple(r.item_ids) for r in D.find_leaks(documents[1].limit(60), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    monkeypatch.undo()
    want = {r.doc_id: tuple(r.item_ids) for r in D.find_leaks(documents[1].limit(60), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert got == want


def test_leaks_odd(spark, odd, odd_rows, none):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "ab"), (4, "one two three four"), (5, "w0 w2919 w838 w3757 w1676 w4595 w2514 w433 w3352 w1271 w4190 w2109"), (None, "x y z w"), (5, "another text of the same item id here")], "item_id long, text string")
    rows = odd.select("doc_id", "text", F.lit(1).alias("item_id"), F.lit(2).alias("h"), F.lit(3).alias("size"))
    got = D.find_leaks(rows, items).collect()
    assert len(got) == len(odd_rows) and {r.doc_id for r in got if r.contaminated} == {4, 13}
    assert D.find_leaks(none, items).count() == 0 and {r.contaminated for r in D.find_leaks(odd, items.limit(0)).collect()} == {False}


def test_repeated_rows_keep_their_leaks(spark):
    leaked, other = f"Some intro here. {ITEM} Some outro.", f"Longer words that stand before. {ITEM} More."
    second = "A quite different wording of the same benchmark item that has twelve words or more in it."
    docs = [(1, leaked), (1, leaked), (2, leaked), (2, other), (3, "Clean text " * 30), (4, second), (None, leaked)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    for items in ([(1, ITEM), (1, second)], [(1, ITEM), (1, ITEM), (1, second), (1, second)]):
        rows = D.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
        got = {(r.doc_id, tuple(r.item_ids)) for r in rows}
        assert len(rows) == 7 and got == {(1, (1,)), (2, (1,)), (3, ()), (4, (1,)), (None, ())}
        assert all(r.longest_run == len(ITEM.split()) for r in rows if r.doc_id in (1, 2))
    # two texts under one id do not lend each other the two halves of an item
    words = ITEM.split()
    halves = [(5, " ".join(words[:11])), (5, "x " * 11 + " ".join(words[11:22]))]
    got = D.find_leaks(spark.createDataFrame(halves, "doc_id long, text string"), spark.createDataFrame([(1, ITEM)], "item_id long, text string"), size=4).collect()
    assert not any(r.contaminated for r in got)


def test_layout_classes_do_not_drop_the_article():
    article = '<article class="post comments-open"><p>one</p><div class="ad">buy</div><p>two</p></article>'
    for tag in ('<body class="has-sidebar">', '<body class="menu-open">', '<html id="nav"><body>', '<body><div class="with-sidebar"><div id="menu-wrap">', '<body><main class="ads">'):
        lines, marked = H.page_lines(f'{tag}<div class="sidebar"><p>side</p></div>{article}')
        assert [x for x, m in zip(lines, marked, strict=True) if m] == ["one", "two"], tag
    assert H.page_lines('<body class="menu-open"><p>plain</p><div class="menu">m</div>')[0] == ["plain"]
    # a wrapper between main and article, and articles that are comments or teasers
    text = lambda page: [x for x, m in zip(*H.page_lines(page), strict=True) if m]
    comment = '<section class="comments"><article><p>first!</p></article></section>'
    assert text(f'<body><main><p>t</p><div class="has-sidebar">{article}</div></main></body>') == ["t", "one", "two"]
    assert text(f'<body><div class="has-sidebar">{article}{comment}</div><div class="sidebar"><article>tease</article></div>') == ["one", "two"]
    assert text(f'<body><main>{"<p>long</p>" * 20}{comment}</main>') == ["long"] * 20
    # name and role still count around an article
    assert H.page_lines(f'<body><aside>{article}</aside><div role="dialog">{article}</div><p>x</p>') == (["x"], [False])


def test_tags_like_a_pattern_would_find_them():
    """The scanner finds the tags of a plain pattern, on quotes of all kinds, and stays linear on quotes that never close."""
    import re
    import time

    tag = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/><\"']*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)>", re.S)
    rng = random.Random(4)
    for _ in range(4000):
        page = "".join(rng.choice(["<a ", "<b", "</p", ">", "'", '"', "x", " ", "<!--", "-->", "<!d", "<", "/>", "=", "<1"]) for _ in range(rng.randrange(25)))
        want, at = [], 0
        while m := tag.search(page, at):
            want.append((m.start(), m.end(), bool(m[1]), (m[2] or "").lower(), m[3] or ""))
            at = m.end()
        found, at, dead = [], 0, set()
        while t := H.next_tag(page, at, dead):
            found.append(tuple(t))
            at = t.end
        assert found == want, page
    begin = time.process_time()
    for piece in ("<a '", "<a", "<!", '<a "', "<a '>\""):
        page, at, dead = piece * (1_000_001 // len(piece)), 0, set()
        while t := H.next_tag(page, at, dead):
            at = t.end
    assert time.process_time() - begin < 5


def test_menus_that_are_most_of_a_page_go(spark):
    menu = "".join(f"<div>entry {i}</div>" for i in range(6))
    rows = [(k, f"https://h.example/a/{k}", f"{menu}<p>own {k} one</p><p>own {k} two</p>") for k in range(6)]
    assert extracted(spark, rows) == {k: f"own {k} one\nown {k} two" for k in range(6)}
    # a near copy shares its long lines and is no template
    prose = [f"This line is long enough to be taken for prose rather than for a menu entry, as it has number {i}." for i in range(4)]
    rows = [(k, f"https://h.example/a/{k}", "".join(f"<p>{x}</p>" for x in [*prose, f"copy {k}"])) for k in range(2)]
    assert extracted(spark, rows) == {k: "\n".join([*prose, f"copy {k}"]) for k in range(2)}
