"""Main text of web pages: flat text blocks classified by a decision tree."""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.shared import sliced

TOKEN = re.compile(
    r"<!--(?:.*?--!?>|.*)"
    r"""|<(?P<close>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"|<(?P<close2>/?)(?P<tag2>[a-z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|$)"
    r"|<[!?/][^>]*+(?:>|$)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([a-z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORD = re.compile(r"[^\W_]+")

# Element names whose content is no text (the first four hold it to their end tag or the page's end, the others
# need an end tag), that end a block, that hold one, that stand for boilerplate or controls, and words that class, id and role use.
OPAQUE = frozenset("script style title textarea".split())
EMBEDDED = frozenset("audio button canvas iframe math noembed noframes noscript object select svg template video".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
HOLDERS = frozenset("address article aside blockquote details dialog div dl fieldset figure footer form header li main menu nav ol p search section span table td ul".split())
BOILERPLATE = frozenset("aside dialog footer menu nav search".split())
CONTROLS = frozenset("button label legend optgroup option summary".split())
CONTENT_ROLES = frozenset("main article".split())
HINTS = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising alert author authorbox banner banners bio breadcrumb breadcrumbs byline cmp comment commentlist comments complementary consent contentinfo cookie cookies copyright dialog discussion disclaimer disqus donate dropdown feedback footer footnav gdpr legal login menu menus message meta modal nav navbar navigation navlinks newsletter notice notices notification overlay pager pagination popup promo promoted promotion promotions rail recommendations recommended related replies reply respond review reviews search share sharing sidebar sidenav signup skip social sponsor sponsored sponsors subscribe subscription survey tabs tags teaser toc toolbar topbar tracking trending warning widget widgets".split()
)
COMMENTS = frozenset("comment commentlist comments disqus replies respond".split())
TEASERS = frozenset("ad promo promoted recommended related sponsored teaser".split())

#: Small labelled pages. A block is "+" (main text) or "-" (not) and how many words it has, then "/" and how many of these are
#: linked, "." if it ends a sentence and "a" if it is a link as a whole. The tree is grown from their blocks' features, so the
#: table is made by the code that reads pages.
LABELLED = """
<header><h2>-2</h2></header><nav><ul><li>-1a<li>-2a<li>-1a</ul></nav><div class=ad>-9.</div><article><h1>+8</h1><p>+30.<p>+55.<p>+4.<p>+70.</article><footer>-12.</footer>
<nav>-1a -1a -1a</nav><div class=advert>-22.</div><article><h1>+5</h1><p>+12.<p>+9.</article><aside class=sidebar><h3>-2</h3><p>-40.<p>-25.</aside><footer><p>-20.<p>-3a</footer>
<nav><ul><li>-1a<li>-1a</ul></nav><main><h1>+6</h1><p>+45.<ul><li>+2<li>+3<li>+12.</ul><p>+25.<div class=share><span>-2</span>-1a -1a</div><h2>+3</h2><p>+60.</main><footer>-6.</footer>
<div id=cookie-notice><p>-32.<p>-5a</div><header><div>-3</div></header><article><h1>+7</h1><p>+80.<p>+40.<blockquote>+18.</blockquote><p>+33.</article><section id=comments><h3>-2</h3><article class=comment><p>-14.</article><article class=comment><p>-60.<p>-25.</article></section><footer>-9.</footer>
<div class=top>-1a -1a -2a -1a</div><div class=content><h2>+4</h2><p>+40.<p>+65.<p>+3.<p>+28.<p>+90.</div><div class=links>-4a</div><div>-5a</div><div class=footer>-11.</div>
<div>-1a -1a</div><div class=movie-review><p>+70.<p>+85.<p>+20.</div><div>-2a -2a</div><div class=comments><p>-30.<p>-8.<p>-45.</div>
<div>-1a -1a -1a</div><div class=message><h2>+3</h2><p>+50.<p>+62.</div><div class=sidebar><p>-20.<p>-15.</div>
<ul><li>-1a<li>-2a</ul><div class=search-results><p>+44.<p>+58.<p>+39.</div><div id=newsletter><p>-16.<form><label>-3</label></form></div>
<form><div class=menu>-1a -1a -1a</div><div><h1>+5</h1><p>+48.<p>+66.<p>+31.</div><label>-2</label><div class=footer>-10.</div></form>
<nav>-2a -2a</nav><article class="post alert"><h1>+6</h1><p>+57.<p>+42.<p>+6.</article><div class=related><h4>-2</h4><p>-9a<p>-8a</div>
<nav>-1a</nav><main><article><header><h1>+9</h1><p>+14.</header><p>+64.<aside><p>-24.</aside><p>+52.<form><label>-4</label><p>-13.</form><p>+35.<div class=tags>-1a -1a -1a</div></article><article class=teaser><h3>-6a</h3><p>-18.</article></main>
<header>-2</header><div><div><h3>-3</h3><ul><li>-4a<li>-5a<li>-3a</ul></div><div><h1>+5</h1><p>+36.<table><tr><td>+6<td>+9<td>+4</table><p>+41.<p>+77.<h2>+2</h2><p>+22.</div></div><div>-4</div>
<div>-3</div><ul><li>-1a<li>-1a<li>-1a<li>-1a</ul><div>-2</div><footer>-7.<p>-3a</footer>
<nav>-1a -1a</nav><div class=banner><p>-26.</div><article><p>+16.</article><div class=promo><p>-19.<p>-12.</div><div class=social>-1a -1a</div><footer>-30.</footer>
<div>-6a</div><p>+33.</p><p>+47.</p><p>+8.</p><p>+59.</p><div class=ads>-13.</div><p>+24.</p><div>-12a</div><div>-4 -6a</div>
<nav>-1a -1a</nav><article><h1>+4</h1><p>+20.<p>-7a<p>+38.<p>-9a<h2>+3</h2><p>+71.<p>+1.<p>+2.<p>-3a</article><aside><p>-35.<p>-50.</aside>
<header><h1>-3</h1><p>-9.</header><div class=page><h2>+5</h2><p>+27.<p>+5.<p>+44.<h2>+2</h2><ol><li>+11.<li>+14.<li>+9.</ol><p>+38.</div><div class=author><p>-21.</div><footer><p>-15.</footer>
<div class=notice><p>-17.</div><div>-2a -2a -2a</div><div class=main><p>+88.<p>+95.<p>+13.<p>+61.</div><div class=widget><h4>-2</h4><p>-14.</div><div class=legal>-34.</div>
<nav>-1a</nav><article><h1>+6</h1><p>+5.<p>+7.<p>+3.</article><div class=comments><p>-40.<p>-55.<p>-62.<p>-48.</div><footer>-14.</footer>
<nav>-1a -1a</nav><article><h1>+3</h1><p>+1.<p>+1.<p>+40.<p>+1.<p>+1.</article><footer>-5.</footer>
<nav>-1a</nav><div class=ad>-4.</div><article><h1>+6</h1><p>+1.<p>+2.<p>+1.</article><footer>-8.</footer>
<div class=ad>-6.</div><article><p>+1.</article><footer>-1.</footer>
<header>-2</header><main><h1>+2</h1><p>+2.<p>+1.<ul><li>+1<li>+1<li>+2</ul><p>+3.</main><div>-2</div><footer>-1</footer>
<div>-1a -1a</div><h3>-2</h3><ul><li>-2a<li>-3a</ul><div><h1>+4</h1><p>+30.<p>+1.<p>+25.</div><h3>-3</h3><ul><li>-4a<li>-3a</ul><div>-1</div>
<div><h3>-3</h3><ul><li>-4a<li>-6a<li>-5a</ul><h2>+5</h2><p>+42.<h2>+3</h2><p>+18.<h3>-2</h3><ul><li>-3a<li>-7a</ul></div><div>-2</div>
<article><h1>+5</h1><p>+11.<p>+3.</article><h3>-3</h3><p>-14.<h3>-2</h3><p>-5a
<div>-4</div><div><h2>+3</h2><p>+36.<p>+1.<p>+29.<ul><li>+1<li>+1<li>+3</ul><p>+33.</div><div>-2a -1a</div><div>-3</div>
<article><h1>+4</h1><p>+26.<ul><li>+2<li>+3</ul><div class=share>-2a</div><p>+14.<ol><li>+4<li>+1</ol><div class=tags>-1a -1a</div></article><footer>-5.</footer>
<nav>-1a</nav><main><h2>+2</h2><p>+20.<table><tr><td>+1<td>+2</table><div class=pager>-1a -1a</div></main><footer>-4.</footer>
<nav>-1a</nav><article><p>+17.<ul><li>+2<li>+1<li>+1</ul><p>-2a</article><div>-3a</div>
<div>-1a</div><div><h1>+3</h1><p>+34.<p>+12.<p>+20.</div>
<p>+25.<p>+15.
<h2>+4</h2><p>+9.<p>+18.
<div>-2a -1a</div><div><p>+40.<p>+7.</div>
<div>-1a -1a -1a</div><p>+20.<p>+20.
<div>-3a</div><h1>+4</h1><p>+29.<p>+10.<ul><li>-4a<li>-3a</ul><p>-12.
<h1>+5</h1><p>+37.<p>+16.<div>-2a -2a -1a</div><div>-9.</div>
<p>+31.<p>+22.<div>-3a</div><div>-5</div>
<nav>-1a</nav><article><p>+20.<p>+2.</article>
<article><h1>+3</h1><p>+28.<p>+1.</article>
<nav>-2a</nav><main><p>+15.<p>+11.<p>+3.</main>
<p>+24.<p>+13.<div>-1a -1a</div><div>-2.</div>
<article><p>+50</article>
<div>-1a</div><div><p>+30.<p>+41</div>
<p>+21<p>+60
<nav>-1a</nav><article><h1>+4</h1><ul><li>+3<li>+2</ul></article>
<article><h1>+5</h1><p>+30.<p>+44.</article>
<article><p>+20.<p>+35.<p>+8.</article>
<p>+60.
<div>-1a -2a</div><div class=text><h1>+4</h1><p>+52.<p>+18.<p>+75.</div>
<main><p>+9.<ul><li>+3<li>+4</ul></main>
<div>-1a -1a</div><article><h2>+3</h2><p>+90.</article>
<h1>+6</h1><p>+48.<p>+33.
<nav>-1a -1a</nav><article><h1>+5</h1><p>+40/3.<p>+25/6.<p>+60/20.<p>+33/18.<p>+12/5.</article><footer>-12/4.</footer>
<div>-1a -2a -1a</div><div class=content><h2>+3</h2><p>+52/15.<p>+31/11.<p>+80/9.<p>+20/9.<ul><li>+8/3<li>+11/4.<li>+6/2</ul><p>+44/21.</div><div>-9/4</div>
<article><h1>+4</h1><p>+22.<p>-4a<p>+28.</article>
<article><h1>+6</h1><p>+35/8.<p>-3a<p>+15.</article><div class=related>-5a -6a</div>
<header>-2 -3a</header><main><h1>+2</h1><p>+71/30.<p>+48/22.<h2>+2</h2><p>+19/8.<ul><li>+7/4.<li>+9/5.<li>+12/6.</ul><p>+64/35.<h2>+1</h2><ul><li>-4a<li>-6a<li>-5a</ul></main><footer>-18/6.<p>-7/4.</footer>
<nav><ul><li>-1a<li>-2a</ul></nav><main><article><h1>+7</h1><p>+26/2.<p>+90/40.<p>-5a<p>+45/12.<p>+38/17.<div class=share>-3/2</div></article><aside><h3>-2</h3><p>-30/8.<p>-12/6.</aside></main><footer>-15/5.</footer>
<div class=top>-6/4</div><div class=body><h1>+6</h1><p>+57/25.<p>+16/7.<p>+34/14.<p>+29.</div><div>-14/7.</div><div class=footer>-10/6.</div>
<div class=cookie><p>-28/4.</div><article><p>+44/10.<p>+18/10.<p>+50.<p>-2a<p>+21/4.</article><section class=comments><p>-26/3.<p>-18/6.</section>
<p>+36/9.</p><p>+22/10.</p><p>+58/26.</p><p>+41.</p>
<div>-3a -2a</div><p>+47/20.</p><p>+15/6.</p><p>+66/8.</p><div>-8/5</div><div>-6/4</div>
<article><h1>+3</h1><p>+31.<p>+24.<div>-3a</div><p>+17.</article><footer>-9.</footer>
<article><h1>+4</h1><p>+19.<p>-6a<h2>+2</h2><p>+40.<p>-4a<p>+12.</article><div>-2a</div>
<nav>-1a</nav><main><h1>+5</h1><p>+27.<p>-2a<p>+33.</main><footer>-4/2.</footer>
<article><p>+14.<p>-3a<p>+9.</article>
<main><p>+52.<ul><li>-4a<li>-3a</ul><p>+20.</main>
<article><header><h1>+6</h1><p>-5/2</header><p>+43/13.<p>+37/16.<p>+28/3.</article><div class=author><p>-22/3.</div>
<nav>-2a -1a</nav><div><h1>+5</h1><p>+62/27.<p>+39/5.<p>+24/11.</div><div class=newsletter><p>-16/4.</div><div>-7/3</div>
<nav>-1a -1a</nav><article><h1>+4</h1><p>+30/15.<p>+45/22.<p>+11/5.<p>+6/3.</article><div class=ad>-14/5.</div>
<article><p>+25/12.<p>+60/33.</article>
<main><p>+20/4.<p>+10/5.<p>+34/19.</main><footer>-11/6.</footer>
<header>-4/2</header><article><h1>+5/2</h1><p>+32/7.<blockquote>+24/6.</blockquote><table><tr><td>+2/1<td>+5/2<td>+4</table><p>+51/24.</article>
<div class=header>-3 -2a</div><div class=story><p>+29.<p>+6.<p>+31.</div><div class=disqus><p>-33.</div><p>-5</p><p>-3</p>
"""


@dataclass
class Holder:
    """What an open element makes of the text in it."""

    tag: str
    inside: bool = False
    boiler: bool = False
    comments: bool = False
    hint: int = 0  # number of the outermost element around with a telling name; 0: none


@dataclass
class Block:
    text: str
    linked: int
    holder: Holder


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)} if text.strip(" /") else {}


def _held(tag: str, attributes: dict[str, str], outer: Holder, number: int) -> Holder:
    names = " ".join(attributes.get(k, "") for k in ("class", "id", "role", "aria-label") if k in attributes)
    words = {w.lower() for w in WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", names))}
    hidden = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
    comments = outer.comments or bool(words & COMMENTS)
    content = tag in CONTENT_ROLES or attributes.get("role", "").lower() in CONTENT_ROLES
    if content and not hidden and not comments and not (tag == "article" and words & TEASERS) and (tag == "main" or not outer.boiler):
        return Holder(tag, True, False, False, 0 if tag == "main" or not outer.inside else outer.hint)
    boiler = outer.boiler or hidden or tag in BOILERPLATE or tag == "header" and not outer.inside
    telling = tag in ("form", "fieldset") or bool(words & HINTS)
    return Holder(tag, outer.inside, boiler, comments, outer.hint or (number if telling else 0))


def blocks(page: str) -> list[Block]:
    """The text blocks of a page, in order: white space made single, character references decoded."""
    found: list[Block] = []
    stack = [Holder("")]
    parts: list[str] = []
    linked, links, controls, number = 0, False, 0, 0
    open_ended: set[str] = set()  # elements without an end tag from here on

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            found.append(Block(text, linked, stack[-1]))
        parts, linked = [], 0

    def add(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if links or controls:
            linked += len(text.split())

    at = 0
    while m := TOKEN.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        closes, attrs = bool(m["close"] or m["close2"]), m["attrs"] or m["attrs2"] or ""
        if tag in OPAQUE or tag in EMBEDDED:
            if not closes and not attrs.endswith("/") and tag not in open_ended:
                end = _end_tag(tag).search(page, at)
                if end:
                    at = end.end()
                else:
                    open_ended.add(tag)
                    at = len(page) if tag in OPAQUE else at
            continue
        if tag == "a":
            links = not closes
        elif tag == "br":
            parts.append(" ")
        if tag in BLOCKS:
            flush()
            links = links and tag not in ("p", "div", "article", "section", "main", "body")
            controls = 0 if tag in ("div", "p", "section", "article", "main", "form", "body") else controls
        if tag in CONTROLS:
            controls = max(0, controls + (-1 if closes else 1))
        if tag in HOLDERS and tag != "p":
            if closes:
                place = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
                if place:
                    if stack[-1] != stack[place - 1]:
                        flush()
                    del stack[place:]
            elif not attrs.rstrip().endswith("/"):
                number += 1
                held = _held(tag, _attributes(attrs), stack[-1], number)
                if tag != "span" or (held.boiler, held.comments, held.hint, held.inside) != (stack[-1].boiler, stack[-1].comments, stack[-1].hint, stack[-1].inside):
                    flush()
                stack.append(held)
    add(page[at:])
    flush()
    return found


@functools.cache
def _end_tag(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\b[^>]*>", re.I)


def features(found: list[Block]) -> list[list[float]]:
    """A row a block: its word count and link share, those of the blocks before and after, and where it stands.

    A class name or a form says little by itself: the last feature but one is how much of the page's own
    text (no links, no boilerplate) lies outside the element with the telling name, 0 where there is none.
    """
    words = [len(b.text.split()) for b in found]
    share = [min(1.0, b.linked / max(1, w)) for b, w in zip(found, words, strict=True)]
    own = [0 if b.holder.boiler or b.holder.comments else max(0, w - b.linked) for b, w in zip(found, words, strict=True)]
    within: dict[int, int] = {}
    for b, w in zip(found, own, strict=True):
        within[b.holder.hint] = within.get(b.holder.hint, 0) + w
    total = max(1, sum(own))
    whole = any(b.holder.inside and not b.holder.boiler for b in found)
    around = [(0, 0.0), *zip(words, share, strict=True), (0, 0.0)]
    rows = []
    for k, b in enumerate(found):
        hinted = 1 - within[b.holder.hint] / total if b.holder.hint else 0.0
        rows.append([*around[k + 1], *around[k], *around[k + 2], b.holder.inside, whole and not b.holder.inside, b.holder.boiler, b.holder.comments, hinted, b.text[-1] in ".!?:;\"'\u201d\u2026\u3002"])
    return rows


def labelled_blocks(pages: str = LABELLED) -> tuple[list[list[float]], list[int]]:
    """The features and labels of all blocks of the labelled pages."""
    rows, labels = [], []

    def spelled(m: re.Match) -> str:
        words = ["yes" if m[1] == "+" else "no", *["word"] * (int(m[2]) - 1)]
        linked = len(words) if m[5] else int(m[3] or 0)
        plain, link = " ".join(words[: len(words) - linked]), " ".join(words[len(words) - linked :])
        return f"{plain} <a href=x>{link}</a>{m[4]}" if linked else plain + m[4]

    for page in pages.split("\n"):
        found = blocks(re.sub(r"([+-])(\d+)(?:/(\d+))?(\.?)(a?)(?=[\s<]|$)", spelled, page))
        rows += features(found)
        labels += [int(b.text.startswith("yes")) for b in found]
    return rows, labels


def grow(rows: list[list[float]], labels: list[int], depth: int = 8, least: int = 1) -> tuple | float:
    """A decision tree (feature, threshold, low, high) that splits where the Gini impurity falls most; leaves: share of 1.

    No side of a split has fewer than ``least`` rows.
    """
    share = sum(labels) / len(labels)
    if depth == 0 or share in (0, 1):
        return share

    def impurity(part: list[int]) -> float:
        return len(part) * (p := sum(part) / len(part)) * (1 - p) if part else 0.0

    best = None
    for k in range(len(rows[0])):
        values = sorted({r[k] for r in rows})
        for low, high in zip(values, values[1:], strict=False):
            cut = (low + high) / 2
            under = [y for r, y in zip(rows, labels, strict=True) if r[k] <= cut]
            over = [y for r, y in zip(rows, labels, strict=True) if r[k] > cut]
            if min(len(under), len(over)) >= least and (best is None or impurity(under) + impurity(over) < best[0] - 1e-12):
                best = (impurity(under) + impurity(over), k, cut)
    if best is None or best[0] >= impurity(labels) - 1e-12:
        return share
    _, k, cut = best
    low, high = ([(r, y) for r, y in zip(rows, labels, strict=True) if (r[k] > cut) == side] for side in (False, True))
    return k, cut, *(grow([r for r, _ in part], [y for _, y in part], depth - 1, least) for part in (low, high))


@functools.cache
def default_tree() -> tuple:
    return grow(*labelled_blocks(), least=4)


def keeps(tree: tuple | float, row: list[float]) -> bool:
    while isinstance(tree, tuple):
        tree = tree[3] if row[tree[0]] > tree[1] else tree[2]
    return tree >= 0.5


def main_text(page: str, tree: tuple | float | None = None) -> str:
    """The blocks that the tree takes for main text, joined by line ends."""
    found = blocks(page)
    tree = default_tree() if tree is None else tree
    return "\n".join(b.text for b, row in zip(found, features(found), strict=True) if keeps(tree, row))


def extracted(pages: DataFrame, html_col: str = "html", tree: tuple | float | None = None) -> DataFrame:
    """``pages`` with ``text``, the main text of the whole page, in place of the html column.

    A null or empty page, or one without main text, gives an empty string. Rows are independent and pass
    through with their other columns (one named ``text`` is replaced); one pass, no shuffle. ``tree`` is
    what :func:`grow` makes of a labelled table; the default is grown from :data:`LABELLED`.
    """
    tree = default_tree() if tree is None else tree
    kept = [c for c in pages.columns if c.lower() not in ("text", html_col.lower())]
    hidden = "__html" + "_" * max((len(c) for c in kept if c.lower().startswith("__html")), default=0)
    pages = pages.select(*kept, F.col(html_col).cast("string").alias(hidden))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw in sliced(batches, hidden):
            texts = pa.array([main_text(x.decode(), tree) for x in raw], pa.string())
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], texts], names=[*kept, "text"])

    from pyspark.sql.types import StringType, StructType

    return pages.mapInArrow(run, StructType(pages.schema.fields[:-1]).add("text", StringType()))


def op6_html_extraction(spark, sf_dir: str) -> DataFrame:
    """The main text of every page, whole, and how many code points it has; null pages have none."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extracted(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
