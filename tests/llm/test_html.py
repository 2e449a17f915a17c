import random
import re

import pytest

from riskloom.llm.html import LABELLED, blocks, default_tree, extracted, grow, keeps, labelled_blocks, main_text, op6_html_extraction

PAGE = """<!DOCTYPE html><html><head><title>Title</title><style>p{}</style><script>var a="</p>";if(a<b){}</script></head>
<body class="has-sidebar"><div id="cookie-consent"><p>We use cookies to make this site work for you, please accept them all now.</p></div>
<header><h2>Site name</h2></header><nav><ul><li><a href=/a>Home</a><li><a href="/b>c">News</a></ul></nav><!-- <p>no</p> -->
<div class="ad">Buy our fine goods today, only for a short time and while they last.</div>
<main><article class="post"><h1>Head &amp; line</h1><p>First&nbsp;para <b>bold
text</b> caf&eacute; &#x41;&#66; goes on.<p>Yes.</p><ul><li>One item</li><li>Two</li></ul>
<div class="share-buttons"><a href="#">Share this</a></div><aside>Related reading of some length is here for you to see.</aside>
<form><label>Your mail</label><input><button>Send</button></form>
<section id="comments"><article class="comment"><p>I think this is a comment of a reader with many words in it.</p></article></section></article></main>
<aside class="sidebar"><p>Side text that is rather long and has no links at all in it, but stands aside.</p></aside>
<footer>&copy; 2020 All rights reserved.</footer></body></html>"""


def test_article_page():
    assert main_text(PAGE) == "Head & line\nFirst para bold text café AB goes on.\nYes.\nOne item\nTwo"


def test_page_without_article():
    long = "This is a sentence of the main text that goes on for a while so that it counts."
    page = f"<body><div><a href=x>Home</a> <a href=y>News</a></div><div class=content><h2>Short head</h2><p>{long}</p><p>{long}</p><p>Well.</p><p>{long}</p></div><div><a href=z>More</a></div></body>"
    assert main_text(page) == f"Short head\n{long}\n{long}\nWell.\n{long}"


@pytest.mark.parametrize("page", ["", "   ", "<", "<p", "<a href='", "</", "&", "<!--", "<script>x", "<p>" * 3000, "<div>" * 500 + "</div>" * 700, "<a \"" * 300, "\x00<b>퟿"])
def test_broken_pages(page):
    assert isinstance(main_text(page), str)


def test_blocks_and_links():
    found = blocks("<p>a <a href=1>b c</a> d<br>e<p>&lt;x&gt; 1 < 2")
    assert [(b.text, b.linked) for b in found] == [("a b c d e", 2), ("<x> 1 < 2", 0)]


def test_tree_fits_its_table_and_pages_it_has_not_seen():
    rows, labels = labelled_blocks()
    assert len(rows) > 250 and sum(keeps(default_tree(), r) != bool(y) for r, y in zip(rows, labels)) <= len(rows) // 40
    pages, wrong = [p for p in LABELLED.split("\n") if p], 0
    assert len(pages) >= 30
    for k, page in enumerate(pages):
        tree = grow(*labelled_blocks("\n".join(pages[:k] + pages[k + 1 :])), least=2)
        wrong += sum(keeps(tree, r) != bool(y) for r, y in zip(*labelled_blocks(page)))
    assert wrong <= len(rows) // 25
    assert grow([[1.0], [2.0]], [0, 1]) == (0, 1.5, 0.0, 1.0) and grow([[1.0], [1.0]], [0, 1]) == 0.5
    assert grow([[1.0], [2.0], [3.0]], [0, 1, 1], least=2) == 2 / 3


def test_the_tree_looks_at_neighbours():
    used = set()

    def walk(tree):
        if isinstance(tree, tuple):
            used.add(tree[0])
            walk(tree[2])
            walk(tree[3])

    walk(default_tree())
    assert used & {2, 3} and used & {4, 5}


LONG = "This is a sentence of the main text that goes on for a while so that it counts and is long."


@pytest.mark.parametrize("wrap", ['<div class="movie-review">%s</div>', '<div class="message">%s</div>', '<div class="search-results">%s</div>', '<article class="post alert">%s</article>', '<article class="post tag-ads">%s</article>', "<form>%s</form>", "<button>%s", "<svg>%s", "<div><select>%s</div>", "<body>%s", "%s", "<main>%s</main>"])
def test_telling_names_and_open_elements_do_not_lose_the_text(wrap):
    for around in ("%s", "<nav><a href=x>Home</a> <a href=y>News</a></nav>%s<footer>All rights reserved.</footer>"):
        assert main_text(around % (wrap % f"<p>{LONG}</p><p>{LONG}</p>")) == f"{LONG}\n{LONG}"


def test_embedded_content_is_no_text():
    for tag in ("script", "style", "button", "svg", "noscript", "select"):
        assert main_text(f"<p>{LONG}</p><{tag} a='>'>{LONG}</{tag.upper()} ><p>{LONG}</p>") == f"{LONG}\n{LONG}"
    assert main_text(f"<p>{LONG}</p><script>{LONG}<p>{LONG}</p>") == LONG


def test_rows(spark, tmp_path):
    rows = [(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (None, None, None, None), (4, "v", "", "x"), (5, "w", "<article><p>" + "word " * 200000 + "</article>", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extracted(pages).collect()
    assert len(got) == 5 and got[0]["text"] == got[1]["text"] == main_text(PAGE)
    pages.drop("text").write.parquet(str(tmp_path / "pages.parquet"))
    out = {r["page_id"]: r for r in op6_html_extraction(spark, str(tmp_path)).collect()}
    assert out[4]["text"] == out[None]["text"] == "" and out[5]["n_chars"] == 5 * 200000 - 1


def test_synthetic_pages_keep_the_article_only(spark):
    import os

    if not os.path.exists("/root/testdata/sf0.001/pages.parquet"):
        pytest.skip("no test tables")
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        article = re.search(r"<article>.*</article>", r["html"], re.S)[0]
        assert main_text(r["html"]) == "\n".join(b.text for b in blocks(article))


def test_clashing_columns(spark):
    pages = spark.createDataFrame([(1, f"<p>{LONG}</p>", "a", 2, "b", 3)], "page_id long, html string, __html string, n_chars int, Text string, k1 int")
    got = extracted(pages)
    assert got.columns == ["page_id", "__html", "n_chars", "k1", "text"] and got.collect()[0].asDict() == {"page_id": 1, "__html": "a", "n_chars": 2, "k1": 3, "text": LONG}


@pytest.mark.parametrize("linked", [0, 3, 6, 8, 10, 13])
def test_paragraphs_with_up_to_half_their_words_linked_stay(linked):
    text = " ".join(["word"] * (25 - linked)) + (f" <a href=x>{' '.join(['word'] * linked)}</a>" if linked else "")
    for page in ("<article><h1>Head</h1><p>%s.</p></article>", "<main><p>%s.</p><p>%s.</p></main>", "<nav><a href=x>Home</a></nav><article><p>%s.</p><p>%s.</p></article><footer>All rights reserved.</footer>"):
        assert main_text(page.replace("%s", text)).count("word") == 25 * page.count("%s")


def test_last_paragraphs_after_a_link_stay():
    page = "<article><h1>Head</h1><p>The first of some paragraphs.</p><p><a href=x>See the source</a></p><p>The final paragraph of it.</p></article>"
    assert main_text(page) == "Head\nThe first of some paragraphs.\nThe final paragraph of it."


def generated(rng):
    """A page that is not in the table, and which of its blocks (named b1, b2, ..) are main text."""
    truth = {}

    def text(words, main, link=0.0, end="."):
        name = f"b{len(truth) + 1}"
        truth[name] = main
        said, linked = [name, *(rng.choice("river stone window market garden letter summer".split()) for _ in range(words - 1))], round(link * words)
        at = rng.randint(0, words - linked)
        return " ".join([*said[:at], *["<a href=/x>"] * (linked > 0), *said[at : at + linked], *["</a>"] * (linked > 0), *said[at + linked :]]) + end

    def some(low, high, make):
        return "".join(make() for _ in range(rng.randint(low, high)))

    def body():
        draw = rng.random()
        if draw < 0.7:
            return f"<p>{text(rng.randint(12, 90), True, rng.choice([0, 0, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5]))}</p>"
        if draw < 0.8:
            return f"<h2>{text(rng.randint(2, 6), True, end='')}</h2><p>{text(rng.randint(15, 60), True, rng.choice([0, 0.1, 0.3]))}</p>"
        if draw < 0.9:
            return "<ul>" + some(2, 4, lambda: f"<li>{text(rng.randint(4, 14), True, rng.choice([0, 0.2, 0.4]))}") + "</ul>"
        return f"<p>{text(rng.randint(2, 6), False, 1, '')}</p>"

    def maybe(chance, make):
        return make() if rng.random() < chance else ""

    tags = rng.choice([["article"], ["main"], ["main", "article"], ["div"]])
    page = maybe(0.7, lambda: "<nav><ul>" + some(2, 6, lambda: f"<li>{text(rng.randint(1, 2), False, 1, '')}") + "</ul></nav>")
    page += maybe(0.3, lambda: "<div>" + some(2, 5, lambda: f"<div>{text(rng.randint(1, 3), False, 1, '')}</div>") + "</div>")
    page += maybe(0.4, lambda: f"<div class=ad>{text(rng.randint(5, 20), False, rng.choice([0, 0.2]))}</div>")
    page += maybe(0.3, lambda: f"<div id=cookie-notice><p>{text(rng.randint(12, 30), False, rng.choice([0, 0.1, 0.2]))}</div>")
    page += "".join(f"<{t}>" for t in tags) + f"<h1>{text(rng.randint(3, 9), True, end='')}</h1><p>{text(rng.randint(20, 60), True)}</p>" + some(1, 8, body)
    page += f"<p>{text(rng.randint(8, 60), True, rng.choice([0, 0.2, 0.5]))}</p>" + "".join(f"</{t}>" for t in reversed(tags))
    page += maybe(0.4, lambda: rng.choice(["<aside>", "<div class=sidebar>"]) + some(1, 3, lambda: f"<p>{text(rng.randint(5, 30), False, rng.choice([0, 0.3, 1]))}</p>"))
    page += maybe(0.4, lambda: "</aside></div><div class=comments>" + some(1, 4, lambda: f"<p>{text(rng.randint(5, 50), False, rng.choice([0, 0.1]))}</p>"))
    page += maybe(0.8, lambda: "</aside></div>" + rng.choice(["<footer>", "<div class=footer>"]) + text(rng.randint(3, 15), False, rng.choice([0, 0.3, 0.6])))
    return page, truth


def test_generated_pages_kept_out_of_training():
    rng, hits, found, wanted = random.Random(11), 0, 0, 0
    for _ in range(200):
        page, truth = generated(rng)
        kept = set(re.findall(r"\bb\d+", main_text(page)))
        main = {name for name, is_main in truth.items() if is_main}
        hits, found, wanted = hits + len(kept & main), found + len(kept), wanted + len(main)
    assert wanted > 1000 and hits / found >= 0.95 and hits / wanted >= 0.95, (hits, found, wanted)


def test_empty_table(spark):
    assert extracted(spark.createDataFrame([], "page_id long, html string")).collect() == []
