"""Main text of HTML pages from flat text blocks.

A page is cut into flat text blocks at its block-level tags. Each block has its word count and link density, those of the blocks
before and after it, and marks of the elements it stands in. A decision tree, grown from the small labelled table below, keeps or
drops each block; the kept ones are joined in page order. Where no element and no name tells (plain divs and paragraphs), the tree
goes by words and link densities alone.

Null, empty and text-free pages give an empty text. Broken markup (tags never closed, quotes never closed, stray end tags, a page cut
short, an unclosed comment or script) never fails and is read in one pass: an end tag without its start is passed over, a quote that
never closes is a plain character, and what is open at the end is closed there. Repeated rows each get their own result, columns of
any name pass by, an empty table gives no rows, and pages of any length are read whole.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import as_bytes, per_batch, read_table

TAG = r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)"
#: A comment, a declaration, or a tag; quotes hold what they hold, or (second form) count for nothing. No part is tried twice.
TOKEN = re.compile(r"<!--|<[!?][^>]*+>|" + TAG + r"((?>[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
UNQUOTED = re.compile(r"<!--|<[!?][^>]*+>|" + TAG + r"([^>]*+)>")
MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
NAME = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr math mi mn mo mrow mtext msup msub mfrac msqrt semantics annotation".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page.
HIDDEN = set("script style noscript template svg iframe object canvas head title select option textarea button audio video datalist".split())
#: Of these, the ones that part no text around them.
QUIET = set("script style noscript template svg iframe object canvas audio video datalist".split())
RAW = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in ("script", "style", "textarea", "title", "noscript", "iframe")}
AROUND = set("nav footer header aside form menu dialog fieldset".split())
MAIN = set("article main".split())
#: Words in class, id or role that name parts around the main text (see names_around for where they stand in a name).
AROUND_WORDS = set(
    "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion related replies share sharing sidebar signup sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
#: Words that do so where no word of MAIN_WORDS stands beside them in the same name.
WEAK_WORDS = set("banner header reply search social".split())
MAIN_WORDS = set("article content entry main post story".split())
FEATURES = ("around", "named_around", "main", "heading", "item", "words", "links", "words_before", "links_before", "words_after", "links_after")


#: Words that say what a name's element is made of, not what it holds; before a name, words that only say what a page has.
BUILT = set("area articles bar block body bottom box buttons card col column container content count footer form global header holder inner item items left link links list main meta outer panel post posts primary right row secondary section site slot space sticky stories text thread title top unit wrap wrapper zone".split())
STATES = set("has have is no not with without".split())


def names_around(words: list[str]) -> bool:
    """Whether a name (its words in order) puts an element around the main text: its last word does, or its first before words of building alone."""
    if not words or words[0] in STATES:
        return False
    tells = AROUND_WORDS | (set() if MAIN_WORDS & set(words) else WEAK_WORDS)
    first = next((i for i, w in enumerate(words) if w in tells), len(words))
    return first < len(words) and all(w in tells or w in BUILT or len(w) < 3 for w in words[first:])


def named(attributes: str, tag: str = "div", within: bool = False) -> tuple[bool, bool]:
    """Whether an element's names put it around the main text, and whether they put it there.

    An article is around only by a name of one word, the main element never; a header within the main text is part of it."""
    around = main = False
    for found in MARKS.findall(attributes):
        for name in CAMEL.sub("-", "".join(found)).lower().split():
            words = NAME.findall(name)
            if names_around(words) and tag != "main" and (tag != "article" or len(words) == 1) and not (within and words == ["header"]):
                around = True
            elif set(words) & MAIN_WORDS:
                main = True
    return around, main and not around


def blocks(page: str) -> list[tuple[str, list[float]]]:
    """(text, own features) of each text block: words, link density, marks of the elements around it."""
    out: list[tuple[str, list[float]]] = []
    stack: list[tuple[str, int, int, int]] = []  # tag, and how many of the open elements are around, main, named as around
    open_tags: Counter[str] = Counter()
    parts: list[str] = []
    linked: list[str] = []
    at, depth_a, hidden, token = 0, 0, 0, TOKEN

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            words = entities.unescape("".join(parts)).split()
            if words:
                inside = sum(len(x) for x in entities.unescape(" ".join(linked)).split())
                _, around, main, called = stack[-1] if stack else ("", 0, 0, 0)
                tags = [t for t, *_ in stack[-4:]]
                out.append((" ".join(words), [len(words), min(1.0, inside / sum(map(len, words))), float(around > 0), float(called > 0), float(main > 0), float(any(re.fullmatch("h[1-6]", t) for t in tags)), float("li" in tags)]))
            parts, linked = [], []

    def keep(text: str) -> None:
        if text and not hidden:
            parts.append(text)
            if depth_a:
                linked.append(text)

    while at < len(page):
        less = page.find("<", at)
        if less < 0:
            keep(page[at:])
            break
        keep(page[at:less])
        m = token.match(page, less)
        if not m and token is TOKEN and page[less + 1 : less + 2].isalpha() | (page[less + 1 : less + 2] == "/"):
            m = UNQUOTED.match(page, less)
            if m or page.find(">", less) < 0:
                token = UNQUOTED  # a quote never closes: from here on none counts
        if not m:
            if page.startswith("<!", less) or re.match(TAG, page[less : less + 40]):  # cut short within a tag
                break
            keep("<")
            at = less + 1
            continue
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            if m[0] == "<!--":
                end = page.find("-->", at - 2)
                at = len(page) if end < 0 else end + 3
            continue
        if tag == "br" and not hidden:
            parts.append(" ")
        elif tag not in INLINE and tag not in QUIET and not hidden:
            flush()
        if tag == "a":
            depth_a = 0 if m[1] else 1
            continue
        if m[1]:
            if open_tags[tag]:
                while True:
                    gone = stack.pop()[0]
                    open_tags[gone] -= 1
                    hidden -= gone in HIDDEN
                    if gone == tag:
                        break
                if tag not in INLINE:
                    depth_a = 0
            continue
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag == "p" and any(t == "p" for t, *_ in stack[-3:]):  # a paragraph ends the one before
            while (gone := stack.pop()[0]) != "p":
                open_tags[gone] -= 1
                hidden -= gone in HIDDEN
            open_tags["p"] -= 1
        _, around, main, called = stack[-1] if stack else ("", 0, 0, 0)
        if tag != "html" and tag != "body":
            outside, inside = named(m[3], tag, main > 0) if m[3] else (False, False)
            called += outside
            main += tag in MAIN or inside
            around += tag in AROUND and not (tag == "header" and main)
        stack.append((tag, around, main, called))
        open_tags[tag] += 1
        if tag in HIDDEN:
            hidden += 1
            if tag in RAW:
                end = RAW[tag].search(page, at)
                at = end.start() if end else len(page)
    flush()
    return out


def features(found: list[tuple[str, list[float]]]) -> np.ndarray:
    """Own and neighbours' features of each block, in the order of FEATURES."""
    if not found:
        return np.zeros((0, len(FEATURES)))
    own = np.array([f for _, f in found])
    near = np.vstack([np.zeros((1, 2)), own[:, :2], np.zeros((1, 2))])
    return np.hstack([own[:, 2:], own[:, :2], near[:-2], near[2:]])


# The labelled table: small pages whose blocks begin with + (main text) or - (around it).
LABELLED = [
    '<nav><ul><li><a href=1>-Home</a></li><li><a href=2>-News</a></li><li><a href=3>-About us</a></li></ul></nav><div class="ad">-Buy the new kettle today and save on every cup.</div><article><h1>+A title of some words</h1><p>+The first paragraph says what happened, where and to whom, in a few sentences.</p><p>+Short.</p><p>+Another paragraph with <a href=4>one link</a> and many more words around it than in it.</p></article><footer>-Copyright by the makers of this page. All rights reserved in every land.</footer>',
    '<header>-The Daily Page</header><main><h2>+Heading</h2><p>+Text of the page that goes on for a good while and has no link.</p><ul><li>+An item of a list in the text</li><li>+Another</li></ul></main><aside><h3>-Read on</h3><p>-A story that has nothing to do with this one but is told at length here.</p></aside><footer><a href=5>-Imprint</a></footer>',
    '<div class="cookie-notice">-We use cookies to make this page better for you and everyone else.</div><div id="content"><h1>+Name</h1><p>+Words and words and more words follow here until the block is long.</p><p>+Yes.</p></div><div class="sidebar"><p>-Most read of the week and why people read it so much</p><a href=6>-More</a></div><div id="comments"><h3>-Comments</h3><p>-I read this and I think it is wrong, as I said before in a long comment.</p><p>-Me too</p></div>',
    '<article><h1>+Only a title</h1><form><label>-Your name</label><p>-Leave your address and we write to you each week about new things.</p></form><p>+And the text that follows the form.</p><div class="comments"><p>-First!</p><p>-A reader writes a whole paragraph below the text, and it is long.</p></div><div class="share"><a href=7>-Share this</a></div><div class="advert">-Cheap flights</div><p>+End.</p></article>',
    '<div class="header"><a href=1>-Logo</a></div><div class="menu"><a href=2>-One</a> <a href=3>-Two</a></div><p>+A page without any main element has its long text in plain paragraphs that nobody marked at all.</p><p>+A second long paragraph without marks follows the first one and tells more about the same.</p><p><a href=4>-Next page</a></p><p><a href=5>-Back to the list of all pages</a></p><div class="footer">-Page made by hand</div>',
    '<ul><li><a href=1>-Start</a></li><li><a href=2>-Shop</a></li><li><a href=3>-Contact</a></li></ul><h1>+Plain title</h1><p>+Plain text with enough words in it to be taken for the main text of a page.</p><p>+More plain text, again with enough words in it to be taken for the main text.</p><div>-<a href=9>Terms</a> <a href=8>Privacy</a> <a href=7>Help</a></div>',
    '<article><header><h1>+Title within the article</h1></header><p>+Text.</p><nav><a href=1>-Part one</a><a href=2>Part two</a></nav><p>+More text here.</p><aside class="notice">-Note to readers: this page moved and will move again before long.</aside><footer>-Filed under things</footer></article>',
    '<main><div class="post"><p>+One</p><p>+<a href=1>All of this paragraph is a link in the text</a></p><p>+A last one of middling length, say.</p></div><section class="related"><p>-You may also like this other story about a dog and its bone</p></section></main><div class="newsletter">-Subscribe now to get our letter</div>',
    '<nav>-Skip to the text, or choose one of the many parts of this page from the long list that stands right here below</nav><article><p>+Now a block of a dozen words or so, in the text.</p><p>+And one of four.</p></article><footer>-This page was written by many people over many years and is kept by a small group of them in a town by the sea.</footer>',
    '<div class="ad">-A long advert tells you at length of a thing you do not need, with many words and no link at all in any of them.</div><p>+Plain text of a page whose paragraphs have no marks, long enough to be told from a menu.</p><p>+Plain text again, long enough to be told from a menu by its words.</p><footer>-Long words of thanks to all the people who gave time and money to keep this page going for so long.</footer>',
    '<aside>-Aside the text stands this long remark on the state of things, which has no link in it and goes on for a while.</aside><main><p>+Text of the page.</p><p>+It goes on and on with many words so that the block is a long one, as blocks of text tend to be.</p></main><form>-Fill in this form with your name and the reason why you write, then press the button below to send it to us.</form>',
    '<header>-Welcome to the page of the town, with all its news, its people and its long tale of floods and fires through the years</header><article><h1>+News</h1><p>+Rain.</p><p>+More rain is to come, they say.</p></article><footer>-Made here</footer>',
    '<div class="banner">-Sale! Everything must go by Sunday night, so come early and bring friends.</div><article><p>+a</p><p>+b c</p><p>+d e f g h i j k l m n o p q r s t u v w x y z a b c d e f g h i j k l m n o p q r s t u v w x y z</p></article><footer>-x</footer>',
    '<p>+Short page.</p>',
    '<p>+A page of one paragraph that says little.</p><p>+Then a second one.</p>',
    '<h1>+Title</h1><p>+Hello there.</p>',
    '<div>+Text in a plain division without any paragraph, as old pages have it, going on for a line or two.</div>',
    '<div>-<a href=1>Start</a> <a href=2>News</a> <a href=3>Sport</a> <a href=4>Weather</a></div><div>+The town woke to a flood this morning, and the bridge was closed for hours while crews worked.</div><div>+Nobody was hurt.</div><div>+The mayor said that work on the dam begins in spring, when the river is low again.</div><div>-<a href=5>About us</a> | <a href=6>Privacy</a> | <a href=7>Contact</a></div>',
    '<table><tr><td>-<a href=1>Index</a></td><td>-<a href=2>Map</a></td></tr><tr><td>+A table lays this old page out, and its text stands in a cell of its own with many words in it.</td></tr><tr><td>+See <a href=3>the map</a>.</td></tr><tr><td>-<a href=4>Back</a> <a href=5>Top</a></td></tr></table>',
    '<p>+Long paragraphs come first on this page and tell what there is to tell in a good many words, line after line.</p><p>+Then one that <a href=1>links to a source</a> and <a href=2>to another</a> but has words of its own besides.</p><h3>-More to read</h3><ul><li>-<a href=3>A story about a dog that found its way home over the hills</a></li><li>-<a href=4>The price of bread is up again and nobody knows why that is</a></li><li>-<a href=5>Ten ways to mend a roof before the winter storms come in</a></li></ul>',
    '<h2>+First part</h2><p>+This part has text that goes on for a while, so that nobody would take it for a menu or for a list.</p><h2>+Second part</h2><p>+This one too has text, with words enough to be told from what stands around it on the page.</p><h2>-Elsewhere</h2><p>-<a href=1>Other site</a></p><p>-<a href=2>Yet another site</a></p>',
    '<p>-<a href=1>Home</a></p><p>-<a href=2>Shop</a></p><p>-<a href=3>Cart</a></p><h1>+Green kettle</h1><p>+A kettle of green enamel that holds two litres and whistles when the water boils.</p><p>+Made in one piece.</p><p>-<a href=4>Red kettle</a></p><p>-<a href=5>Blue kettle</a></p>',
    '<div><div>-<a href=1>One</a> <a href=2>Two</a></div></div><div><div>+Rain fell all day.</div><div>+It fell on the roofs and on the fields, and by the evening the lanes had turned to mud and the carts stood still.</div><div>+<a href=3>A whole sentence of this text is a link, and it is still text</a></div><div>+Then it stopped, and the moon came out over the wet slates of the village.</div></div><div>-<a href=4>Next</a></div>',
    '<ul><li>+Flour, two cups of it, sifted twice</li><li>+Water, one cup</li><li>+Salt</li></ul><p>+Mix all of it in a bowl and leave it to stand for an hour under a cloth before you bake it.</p><ul><li>-<a href=1>Cakes</a></li><li>-<a href=2>Breads</a></li></ul>',
    '<p>+One paragraph, then a quote from somebody who was there and saw all of it happen from the shore.</p><blockquote>+I saw it.</blockquote><p>+And a closing remark by the one who wrote it all down for the paper the next day.</p><div>-<a href=1>Mail</a> <a href=2>Print</a></div><div>-Copyright by the paper</div>',
    '<div>-<a href=1>Forum</a> &gt; <a href=2>Garden</a> &gt; <a href=3>Roses</a></div><div>+My roses have black spots on their leaves since May, although I water them in the morning only. What can I do?</div><div>-<a href=4>Older</a> <a href=5>Newer</a></div><div>-Powered by a board</div>',
    '<figure><figcaption>+The harbour at dawn</figcaption></figure><p>+Boats lay in the harbour at dawn, and the first gulls came over the wall to see what the night had left.</p><address>+Written at the harbour</address>',
    '<div>-<a href=1>Many stories stand here one beside the other in a long row of links</a> <a href=2>and it goes on and on for more than a line of them</a></div><article><p>+First.</p><p>+The second paragraph has more to say than the first one, and says it plainly.</p><p>+<a href=3>Read the report</a></p><p>+Third.</p></article><div>-<a href=4>Many more stories stand here one beside the other in a long row of links</a></div>',
    '<article><h1>+Sources</h1><p>+All that is told here was found in these.</p><ul><li>+<a href=1>The first book</a></li><li>+<a href=2>The second book</a></li><li>+<a href=3>A letter</a></li></ul><p>+<a href=4>All letters</a></p></article>',
    '<div>-<a href=1>A very long line of links leads the reader to all the other parts of this page and to its archive of old stories</a></div><main><p>+<a href=2>One</a></p><p>+Two</p></main>',
    '<div class="layout with-sidebar"><article class="post has-comments"><h1>+Names that mislead</h1><p>+Text.</p><div id="share-prices"><p>+Prices of shares fell all day.</p></div><section id="related-work"><p>+Others have written on this before.</p></section></article><div class="sidebar-left">-Remarks</div><div class="comments-area">-I think so too</div></div>',
    '<main class="widget-area"><p>+The main part of a page stays, whatever it is called.</p><div class="widget">-Weather: fair</div></main>',
    '<div id="content"><div class="header"><h1>+A title in a head of its own</h1></div><p>+And its text.</p></div><div class="site-footer">-Made here</div>',
    '<article id="notice-of-meeting"><h1>+Notice of meeting</h1><p>+We meet on Monday.</p></article><div class="cookie-notice">-We use cookies on this page</div>',
    '<article class="article no-sidebar"><p>+A page without a sidebar says so in its name.</p><article class="comment"><p>-I like it that way, and so do all of my friends.</p></article><div id="commentForm">-Say what you think</div></article>',
    '<div class="page has-footer"><div class="post is-promo-free"><h2>+Names again</h2><p>+Words of a state are none of a part.</p></div><div class="ad-slot-3">-Kettles, half price</div><div class="site-footer">-<a href=1>Imprint</a></div></div>',
]


# Parts of further pages, labelled likewise: what stands before the text, the text, and what stands after it.
BEFORE = [
    "",
    '<nav><ul><li><a href=1>-Home</a></li><li><a href=2>-News</a></li><li><a href=3>-All of our old stories in one long list</a></li></ul></nav>',
    '<header>-The page of the town and of all the people who live in it</header><nav>-<a href=1>Start</a> <a href=2>End</a></nav>',
    '<nav><a href=1>-Home</a></nav><div class="ad">-Buy a kettle now and pay for it in the spring, as all your friends do.</div>',
    '<div class="cookie-banner">-We use cookies. Read on to agree with all of it.</div><div class="top-menu">-<a href=1>One</a> <a href=2>Two</a></div>',
    '<div>-<a href=1>Start</a> <a href=2>News</a> <a href=3>Sport</a></div>',
    '<div>-<a href=1>A very long row of links leads the reader to all the other parts of this page</a> <a href=2>and to its archive of stories of many years</a></div>',
    '<p>-<a href=1>Home</a></p><p>-<a href=2>Shop</a></p><p>-<a href=3>Help and contact</a></p>',
    '<aside>-A remark stands aside here that goes on for a good many words without any link in it at all.</aside>',
    '<form>-Search and write your name here so that we can send you a letter each week</form>',
    '<ul><li>-<a href=1>Index</a></li><li>-<a href=2>Map</a></li></ul><div class="breadcrumbs">-<a href=3>Town</a> &gt; <a href=4>River</a></div>',
]
TEXTS = [
    '<h1>+The flood</h1><p>+The river rose in the night and stood in the lower streets by the morning, when the bells were rung.</p><p>+Nobody was hurt.</p><p>+By noon the water had gone down again, and people carried their chairs out into the sun.</p>',
    '<p>+A short text.</p>',
    '<p>+One paragraph holds all that this page has to say, and it says it in a good many words, one after the other, to its end.</p>',
    '<p>+It is a page of one paragraph only, which is neither long nor short but tells all there is to tell.</p>',
    '<div>+This text has a page of its own, and there is nothing else on that page but a few links that lead away from it.</div>',
    '<h2>+News</h2><p>+Rain.</p><p>+More rain is to come.</p>',
    '<p>+The book <a href=91>can be read here</a> in full, and it is worth the while of all who like long books about the sea.</p><p>+See also <a href=92>the other book</a> by the same hand.</p><h3>+On the sea</h3><p>+It is a book about ships.</p>',
    '<h1>+Bread</h1><ul><li>+Flour</li><li>+Two cups of water, warm but not hot, and a little salt</li></ul><p>+Mix it all and wait for an hour before you bake it in a hot oven.</p><ol><li>+Eat it.</li></ol>',
    '<div>+It was told in the town that the bell had been cast from the guns of a ship that went down off the cape in a storm.</div><div>+Few believed it.</div><div>+But the bell hung there, green and old, and rang for births and fires.</div>',
    '<table><tr><td>+Height</td><td>+Ten feet and some inches more</td></tr><tr><td>+Weight</td><td>+Not known</td></tr></table><p>+The table gives what we know of the beast.</p>',
    '<p>+He said it in a low voice, so that only those who stood near the door could hear what it was he said.</p><blockquote>+I was there.</blockquote><figure><figcaption>+The door</figcaption></figure><p>+Then he left.</p>',
]
#: Text that only an element around it tells from what it isn't.
MARKED_TEXTS = [
    '<h1>+Sources</h1><p>+All of it was found in these.</p><ul><li>+<a href=91>The first book</a></li><li>+<a href=92>The second book of the same row</a></li></ul><p>+<a href=93>All letters</a></p>',
    '<p>+<a href=91>One</a></p><p>+Two</p><p>+<a href=92>A line of this text that is a link from its first word to its last</a></p>',
    '<h1>+Page</h1><p>+Text of the page before the things that do not belong to it.</p><nav>-<a href=91>Part one</a> <a href=92>Part two</a></nav><div class="share-box">-<a href=93>Share this</a></div><div class="advert">-Fly to the sea for little money</div><p>+And text behind them.</p><aside class="notice">-This page has moved and will move again.</aside><form>-Leave your name</form><p>+End.</p><div class="comments"><h3>-Comments</h3><p>-First!</p><p>-I have read all of it and think that it is wrong from the first to the last line of it.</p></div>',
]
WRAPPED = ["%s", "<article>%s</article>", "<main>%s</main>", '<div class="post-content">%s</div>', '<div id="article"><section>%s</section></div>']
AFTER = [
    "",
    "<footer>-Made by hand in the town by the sea, for all who care to read it, year after year.</footer>",
    '<footer><a href=51>-Imprint</a> <a href=52>Privacy</a></footer>',
    '<div>-<a href=51>About</a> | <a href=52>Terms</a></div><div>-Copyright by the town</div>',
    '<h3>-More to read</h3><ul><li>-<a href=51>A story about a dog that found its way home over the hills</a></li><li>-<a href=52>Ten ways to mend a roof</a></li></ul>',
    '<div class="related"><h3>-Read on</h3><p>-A story told at length about a thing that has nothing to do with this one.</p></div><footer>-x</footer>',
    '<div id="comments"><p>-Me too</p><p>-A reader writes a long line below the text and says the same thing twice, the same thing twice.</p></div>',
    '<div class="newsletter">-Subscribe now to get our letter</div><p>-<a href=51>Next page</a></p>',
]


def labelled_pages() -> list[str]:
    """The labelled table: whole pages, and every text in every wrapping between parts that take turns."""
    out, n = list(LABELLED), 0
    for wrap in WRAPPED:
        for text in TEXTS + (MARKED_TEXTS if wrap != "%s" else []):
            for before in BEFORE:
                out.append(before + wrap % text + AFTER[n % len(AFTER)])
                n += 3 if n % 5 else 4
    return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 2) -> tuple:
    """A tree by Gini impurity: ("leaf", share) or (feature, threshold, left, right)."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return ("leaf", share)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            left = x[:, f] <= cut
            n, m = int(left.sum()), int((~left).sum())
            if min(n, m) >= least:
                gini = sum(k * 2 * q * (1 - q) for k, q in ((n, y[left].mean()), (m, y[~left].mean())))
                if best is None or gini < best[0] - 1e-12:
                    best = (gini, f, float(cut), left)
    if best is None:
        return ("leaf", share)
    _, f, cut, left = best
    return (f, cut, grow(x[left], y[left], depth - 1, least), grow(x[~left], y[~left], depth - 1, least))


def keeps(tree: tuple, x: np.ndarray) -> np.ndarray:
    """Whether the tree keeps each row of x."""
    if tree[0] == "leaf":
        return np.full(len(x), tree[1] >= 0.5)
    f, cut, left, right = tree
    go = x[:, f] <= cut
    out = np.empty(len(x), bool)
    out[go], out[~go] = keeps(left, x[go]), keeps(right, x[~go])
    return out


def labelled_rows(pages: list[str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the labelled table's blocks; the marks themselves are no text of the page."""
    xs, ys = [], []
    for page in labelled_pages() if pages is None else pages:
        xs.append(features(blocks(re.sub(r">[+-]", ">", page))))
        ys += [t.startswith("+") for t, _ in blocks(page)]
    return np.vstack(xs), np.array(ys, float)


@lru_cache(1)
def labelled_tree() -> tuple:
    """The tree grown from the labelled table."""
    return grow(*labelled_rows())


def main_text(page: str, tree: tuple) -> str:
    found = blocks(page)
    return " ".join(t for (t, _), keep in zip(found, keeps(tree, features(found)), strict=True) if keep)


def extract(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of each page."""
    kinds, tree = dict(df.dtypes), labelled_tree()

    def run(batch: pa.RecordBatch) -> dict:
        texts = [main_text(t.decode(), tree) for t in as_bytes(batch.column(2))]
        return {"key": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

    return per_batch(df, [key, url, html], run, f"`{key}` {kinds[key]}, `{url}` {kinds[url]}, text string, n_chars bigint")


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages."""
    return extract(read_table(spark, sf_dir, "pages"))
