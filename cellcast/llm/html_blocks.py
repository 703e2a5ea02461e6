"""Main-text extraction by classified text blocks.

A page is cut into flat text blocks at block-level tags. Each block has its number of
words, its link density, the same of the blocks beside it, how much plain text stands
around it, its place on the page, and marks of the elements around it. A decision tree,
trained on a small labelled table, tells main text from the rest; the blocks of main text
are joined in page order.

The labelled table is made of the pages written out below and of ``COMPOSED_PAGES`` pages
composed from their parts by a seeded rule: main text and boilerplate in several shapes,
with article and main elements or plain wrappers, with names that tell, names that say
nothing, and names that lie (a section of the article that is called a discussion). So no
name decides by itself: what a name is worth, the tree learns beside the other features.

Each page is read on its own, whole, in one pass without a shuffle. A null or empty page,
or one without main text, gives an empty text; pages that end in the middle of a tag, a
comment or a script are read as far as they go. Repeated rows are extracted each for
itself; columns other than ``page_id``, ``url`` and ``html`` are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellcast.llm.text import slices, small_batches

TREE_DEPTH = 12
COMPOSED_PAGES = 2000

# Elements whose text is no text, elements that end a block, void elements. All that
# a head may hold is among them or void; text ends a head, whose closing tag may be left out.
HIDDEN = "script|style|noscript|template|svg|iframe|object|textarea|select|button|title"
BLOCK_TAGS = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary
    table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements and words in class, id and role that mark what surrounds a text.
ASIDE_TAGS = frozenset("nav footer aside form menu dialog".split())
MAIN_TAGS = frozenset("article main".split())
# Words that seldom name a part of an article, and words that may.
ASIDE_WORDS = frozenset("""ad ads advert adverts advertisement advertising banner sponsor sponsored promo promoted
    promotion nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar
    sidebar widget related recommended recommendations trending teaser cookie cookies consent gdpr popup modal overlay
    newsletter subscribe subscription signup login share sharing comments commentlist comment disqus tagcloud
    complementary contentinfo""".split())
DOUBTFUL_WORDS = frozenset("""adv foot side aside notice notices alert search social follow respond reply replies
    discussion copyright legal disclaimer skip""".split())
# Elements that wrap others; the names of all others (a heading's anchor, a paragraph's style) are doubtful.
WRAPPERS = frozenset("div section ul ol dl table aside nav form header footer figure details fieldset center tbody article main".split())
# Phrases of legal lines, consent notes and invitations.
PHRASES = re.compile(r"©|\(c\) |copyright|all rights reserved|terms (?:of|and)|privacy|cookie|subscribe|newsletter|sign (?:up|in)"
                     r"|log ?in|follow us|powered by|tous droits|alle rechte|datenschutz|impressum|derechos reservados", re.I)
ENDS = frozenset(".!?…:;。！？")
CLOSERS = "\"'”’»)]"

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({HIDDEN})\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*(?<!/)>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?/a-z][^>]*(?:>|\Z)", re.S | re.I)
# Names that say what a page or wrapper has, not what an element is.
STATE = re.compile(r"(?:has|no|with|without)[-_].*|.*[-_]open")
STATE_TAGS = frozenset("div section".split())
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)


class Block(NamedTuple):
    text: str
    words: int
    link_words: int
    main: bool     # inside an article or main element
    aside: bool    # inside an element whose tag stands beside main text
    named: bool    # inside a wrapper with a name that seldom belongs to an article
    doubtful: bool  # inside an element with a name that may
    heading: int   # level, 0 for none
    item: bool     # list item or table cell


class Open:
    """An open element: its tag and what it passes on to what it holds."""

    def __init__(self, tag: str, main: bool, aside: bool, doubtful: bool, named: list[Open]):
        self.tag, self.main, self.aside, self.doubtful = tag, main, aside, doubtful
        self.named = named  # this and outer elements whose names mark them as no main text
        self.holds_main = self.holds_article = False


def _marks(tag: str, attributes: str, inside_main: bool) -> tuple[bool, bool, bool, bool]:
    """Whether an element starts main text, and whether its tag or its names, surely or perhaps,
    mark it as something beside it. The names of a body speak of the page."""
    names: set[str] = set()
    for m in NAMES.finditer(attributes) if attributes and tag != "body" else ():
        whole = m[1].lower().strip("\"'").split()
        names.update(w for x in whole if tag not in STATE_TAGS or not STATE.fullmatch(x) for w in re.split(r"[^a-z]+", x))
    aside = tag in ASIDE_TAGS or tag == "header" and not inside_main
    sure = bool(names & ASIDE_WORDS)
    named = sure and tag in WRAPPERS
    doubtful = bool(names & DOUBTFUL_WORDS) or sure and not named
    return tag in MAIN_TAGS or "main" in names and not aside and not named, aside, named, doubtful


def cut_blocks(page: str) -> list[Block]:
    """The text blocks of a page, in order."""
    blocks: list[Block] = []
    open_: list[Open] = []
    outside = Open("", False, False, False, [])
    named_around: list[list[Open]] = []  # for each block
    articles: list[list[Open]] = []  # named elements around each article
    parts: list[str] = []
    link_parts: list[str] = []
    in_link = 0
    heading = 0
    item = False

    def text(s: str) -> None:
        if s:
            parts.append(s)
            if in_link:
                link_parts.append(s)

    def end() -> None:
        whole = " ".join(entities.unescape("".join(parts)).split())
        if whole:
            last = open_[-1] if open_ else outside
            links = len(" ".join(link_parts).split())
            blocks.append(Block(whole, len(whole.split(" ")), links, last.main, last.aside, False, last.doubtful, heading, item))
            named_around.append(last.named)
        parts.clear()
        link_parts.clear()

    at = 0
    for m in TOKEN.finditer(page):
        text(page[at:m.start()])
        at = m.end()
        if m[3] is None:
            continue
        closing, tag = m[2] == "/", m[3].lower()
        if tag == "br":
            text(" ")
        elif tag == "a":
            in_link = 0 if closing else 1
        elif tag in BLOCK_TAGS:
            end()
            in_link = 0
            heading = int(tag[1]) if not closing and len(tag) == 2 and tag[0] == "h" and tag[1] in "123456" else 0
            item = not closing and tag in ("li", "td", "th", "dt", "dd")
            if closing:
                for k in range(len(open_) - 1, -1, -1):
                    if open_[k].tag == tag:
                        del open_[k:]
                        break
            elif tag not in VOID:
                if tag in ("p", "li", "td", "tr") and open_ and open_[-1].tag == tag:
                    open_.pop()  # ends by itself where the next one starts
                last = open_[-1] if open_ else outside
                starts, beside, named, doubtful = _marks(tag, m[4], last.main)
                # What starts main text says more than the doubtful name of what holds it.
                this = Open(tag, last.main or starts, last.aside or beside, doubtful or last.doubtful and not starts, last.named)
                if tag == "main":
                    for e in last.named:
                        e.holds_main = True
                elif tag == "article" and not beside and not named and not last.aside:
                    articles.append(last.named)
                if named:
                    this.named = [*last.named, this]
                open_.append(this)
    text(page[at:])
    end()
    # What holds the page's main text is nothing beside it, whatever its names say: an element with
    # a main in it or, on a page whose articles all lie in named elements, with an article.
    has_main = any(b.main and not b.aside and not [e for e in around if not e.holds_main]
                   for b, around in zip(blocks, named_around, strict=True))
    for around in () if has_main else articles:
        for e in around:
            e.holds_article = True
    return [b._replace(named=any(not e.holds_main and not e.holds_article for e in around))
            for b, around in zip(blocks, named_around, strict=True)]


def block_features(blocks: list[Block]) -> list[list[float]]:
    """Words and link density of each block and its neighbours, plain text around it, place and marks."""
    n = len(blocks)
    some_main = float(any(b.main and not b.aside and not b.named for b in blocks))
    flat = [(float(b.words), b.link_words / b.words, float(b.aside or b.named), float(b.words < 60 and bool(PHRASES.search(b.text))),
             float(b.text.rstrip(CLOSERS)[-1:] in ENDS)) for b in blocks]
    # Words of sentences that are no links, summed from the top of the page.
    plain = [0.0]
    for words, links, aside, phrase, sentence in flat:
        plain.append(plain[-1] + (words if links < 0.5 and not aside and not phrase and sentence else 0.0))
    titles = [0]
    for b in blocks:
        titles.append(titles[-1] + (b.heading in (1, 2)))
    none = (0.0, 0.0, 0.0, 0.0, 0.0)
    out = []
    for k, b in enumerate(blocks):
        before, after = flat[k - 1] if k else none, flat[k + 1] if k + 1 < n else none
        inside = float(b.main and not b.aside and not b.named)
        near = plain[min(k + 4, n)] - plain[max(k - 3, 0)] - (plain[k + 1] - plain[k])
        out.append([*flat[k], *before, *after, plain[k] - plain[max(k - 3, 0)], plain[min(k + 4, n)] - plain[k + 1], near,
                    inside, some_main - inside, float(b.doubtful), float(b.heading), float(b.item), float(titles[k] > 0), float(titles[-1] > 0),
                    k / n, (n - 1 - k) / n, plain[k] / max(plain[-1], 1.0)])
    return out


class Node(NamedTuple):
    feature: int
    limit: float
    left: object
    right: object


def decide(tree, x: list[float]) -> bool:
    while isinstance(tree, Node):
        tree = tree.left if x[tree.feature] <= tree.limit else tree.right
    return tree > 0.5


#: The labelled table: pages whose blocks of main text start with "+ ".
LABELLED_PAGES = [
    """<html><body><nav><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav><div class="ad">Buy the new kettle
    today and save.</div><article><h1>+ The river rises</h1><p>+ Water stood two metres above the usual mark on Monday,
    and the lower bridge was closed.</p><p>+ More rain is due.</p><p>+ Wait.</p></article><footer>(c) The Paper, all
    rights reserved. Printed in the old town by its owners.</footer></body></html>""",
    """<body><header><h1>The Daily Paper</h1><p>News since 1901 for everyone in town and far around it</p></header><main>
    <h2>+ A short note</h2><p>+ One line only.</p><blockquote>+ He said that the harvest would be late this year, and that
    nobody in the valley should sell their grain before the first frost.</blockquote><p>+ <a href=x>See the report</a> for
    the figures of the last ten years.</p></main><aside><h3>Most read</h3><p><a href=1>Ten ways to sleep well at
    night</a></p><p>Our editors pick the best stories of the week for you.</p></aside></body>""",
    """<div id="content"><p>+ The committee met on Tuesday and talked for three hours about the new road, which most of those
    who live near it don't want.</p><p>+ It will meet again in May, when the engineers have looked at the ground and the
    costs are known to all of its members.</p><p>+ No vote was taken that day.</p><p>+ Some members had already left the
    room by then, and others did not wish to be named in the minutes at all.</p></div><div class="comments"><h3>Comments</h3>
    <p>I have lived on this street for thirty years and nobody ever asked me about the road or the noise.</p><p>Well
    said!</p></div><div class="footer"><p><a href=a>About</a> <a href=b>Contact</a> <a href=c>Imprint</a></p></div>""",
    """<table><tr><td><a href=1>One</a></td><td><a href=2>Two</a></td></tr></table><p>+ This page has no marks at all, only
    paragraphs that follow one another, as pages were written long ago by hand and with little care.</p><p>+ The second
    paragraph goes on with the story and says a good deal more about it than the first one did.</p><p>+ It ends here, with
    a few more words than a menu would have, and no links at all.</p><p><a href=z>Back to the top</a></p>""",
    """<div class="cookie-notice"><p>We use cookies to make this site better. By staying here you agree to our use of
    them, as our policy explains in detail.</p><p><a href=ok>Agree</a></p></div><article><h1>+ Bread</h1><p>+ Mix flour,
    water and salt.</p><ul><li>+ Flour, one pound</li><li>+ Water</li></ul><div class="advert">The best mixers, now at
    half the price in all of our shops.</div><p>+ Bake it for an hour in a hot oven until the crust is brown.</p><form>
    <p>Get our letter every week and never miss a recipe again.</p></form><section id="comments"><p>My crust was too hard,
    what did I do wrong? I followed every step.</p><p>Lovely.</p></section></article>""",
    """<article><p>+ Yes.</p><p>+ <b>A bold line that opens the text of this page.</b></p><p>+ <a href=s>Source</a></p><pre>+
    print(1)</pre><nav class="share"><a href=f>Share</a> <a href=t>Send it to a friend</a></nav></article><p>Terms and
    conditions apply to everything on this site, see below for more.</p><p>Privacy</p><div>Theme by someone else</div>""",
    """<main><div class="sidebar"><p>Written by a friend of the house, who also paints and walks.</p></div><h1>+ Snow</h1><p>+
    It fell all night long.</p><p>+ In the morning the village was white, the road was gone, and the children ran out
    without their coats.</p><div class="related"><p><a href=q>Rain</a></p><p>Read more stories about the weather in our
    archive</p></div></main><div><p>Subscribe now for unlimited access to everything we write, every day.</p></div>""",
    """<body><div class="menu"><a href=a>A</a><a href=b>B</a></div><p>Login</p><div><h2>+ How bees find home</h2><p>+ They learn
    the way by flying small loops around the hive, looking back at it, before they go any further from it.</p><p>+ When they
    return they match what they see with what they remember of the trees, the walls and the light.</p></div><p>Copyright
    2020</p></body>""",
    """<html><body><nav><a href=/>Home</a></nav><article><h1>+ The mill</h1><p>+ It stood by the brook for three hundred
    years.</p><p>+ Then it burned""",
    """<article><h1>+ Months</h1><p>+ Snow.</p><p>+ Ice.</p><p>+ Thaw and mud.</p><p>+ Rain.</p><p>+ A long dry spell that
    lasts until the middle of June and ends with hail.</p><p>+ Heat.</p><p>+ Fog.</p></article><footer>Almanac.</footer>""",
    """<main><p>+ Names</p><p>+ Ann</p><p>+ Bo</p><p>+ Cy and Di</p><p>+ Ed</p></main><div>Top</div><div>Up</div>""",
    """<article><h1>+ Rope</h1><p>+ It is made of hemp.""",
    """<div><p><a href=1>All news from the region</a></p><p><a href=2>Sport and results of the week</a></p><p><a href=3>The
    weather where you live</a></p></div><div><p>+ The ferry stopped on Sunday after the wind had turned to the north and the
    waves came over the pier.</p><p>+ It runs again from Tuesday on, if the wind allows it, with the old times.</p><p>+ Nobody
    was hurt, the harbour master said in the evening.</p></div>""",
    """<div><h1>+ Clay</h1><p>+ Dig it in the autumn, leave it out in the frost, and knead it in the spring until no air is
    left in it.</p><p>+ Then wait a month.</p></div><ul><li><a href=1>How to build an oven in the garden</a></li><li><a
    href=2>Why pots crack when they dry too fast</a></li><li><a href=3>Where to buy good clay in winter</a></li></ul>""",
]


def _words(rng: random.Random, n: int) -> str:
    """Invented words: the tree sees their number only."""
    return " ".join("".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(n))


def _sentences(rng: random.Random, n: int, links: bool = False) -> str:
    """About ``n`` words in sentences."""
    parts = []
    while n > 0:
        k = min(n, rng.randint(4, 18))
        s = _words(rng, k)
        if links and rng.random() < 0.15:
            s = f"<a href=x>{s}</a>" if k < 5 else s.replace(" ", " <a href=x>", 1) + "</a>"
        parts.append(s.capitalize() + rng.choice("....!?"))
        n -= k
    return " ".join(parts)


def _article(rng: random.Random, quotes: bool) -> str:
    """Blocks of main text, each beginning with "+ "; an article that is marked as such may quote
    legal lines and notices."""
    out = [f"<h{rng.choice('112')}>+ {_words(rng, rng.randint(1, 10))}</h1>"] if rng.random() < 0.7 else []
    for _ in range(rng.randint(1, rng.choice([4, 12, 12, 40]))):
        kind = rng.random()
        if quotes and rng.random() < 0.15:
            line = rng.choice(["All rights reserved.", "© 2020 {}", "We use cookies {}", "Subscribe to {}", "Terms of {}", "{} privacy {}", "Log in {}"])
            out.append(f"<p>+ {line.replace('{}', _words(rng, rng.randint(1, 9)))}</p>")
        elif quotes and rng.random() < 0.1:
            out.append(f"<p>+ {_words(rng, rng.randint(1, 12))}</p>")
        elif kind < 0.66:
            out.append(f"<p>+ {_sentences(rng, rng.choice([2, 6, 15, 30, 50, 90]), True)}</p>")
        elif kind < 0.74:
            out.append(f"<h{rng.choice('23')}>+ {_words(rng, rng.randint(1, 6))}</h2><p>+ {_sentences(rng, 40)}</p>")
        elif kind < 0.82:
            out.append("<ul>" + "".join(f"<li>+ {_words(rng, rng.randint(2, 12))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
        elif kind < 0.88:
            out.append(f"<blockquote>+ {_sentences(rng, 25)}</blockquote>")
        else:  # names that lie
            name = rng.choice(["discussion", "legal", "alert", "search-results", "notice", "replies", "side-effects", "copyright-law", "follow-up"])
            out.append(rng.choice([
                f'<section id="{name}"><h2>+ {_words(rng, 2)}</h2><p>+ {_sentences(rng, 45)}</p></section>',
                f'<div class="{name}"><p>+ {_sentences(rng, 30)}</p></div>', f'<p class="{name}">+ {_sentences(rng, 20)}</p>',
                f'<h2 id="{rng.choice([name, "related", "comments", "menu", "login"])}">+ {_words(rng, 3)}</h2><p>+ {_sentences(rng, 30)}</p>']))
    return "".join(out)


def _boilerplate(rng: random.Random, kind: str) -> str:
    def item() -> str:
        return f"<a href=x>{_words(rng, rng.choice([1, 1, 2, 5, 8]))}</a>"

    legal = rng.choice(["© 2021 {}", "Copyright {}", "{}. All rights reserved.", "All rights reserved by {}", "Terms of use and {}", "Privacy {}",
                        "Powered by {}", "Tous droits réservés {}", "Alle Rechte vorbehalten {}", "(c) {}"])
    return {
        "menu": lambda: rng.choice(["<ul>" + "".join(f"<li>{item()}</li>" for _ in range(rng.randint(2, 8))) + "</ul>",
                                    " | ".join(item() for _ in range(rng.randint(2, 7))), f"<p>{item()}</p><p>{item()}</p>",
                                    "".join(f"<div>{_words(rng, rng.choice([1, 1, 1, 2]))}</div>" for _ in range(rng.randint(2, 6)))]),
        "tagline": lambda: f"<p>{_words(rng, rng.randint(2, 9))}</p>",
        "legal": lambda: f"<p>{legal.format(_words(rng, rng.randint(1, 12)))}</p>",
        "notice": lambda: f"<p>{rng.choice(['We use cookies', 'This site uses cookies', 'Our privacy rules have changed'])} {_sentences(rng, rng.randint(6, 30))}</p>"
                          + rng.choice(["", f"<p>{item()}</p>"]),
        "invite": lambda: f"<p>{rng.choice(['Subscribe', 'Sign up for our newsletter', 'Follow us', 'Log in'])} {_words(rng, rng.randint(0, 14))}</p>",
        "teasers": lambda: (f"<h3>{_words(rng, 2)}</h3>" if rng.random() < 0.6 else "") + "".join(f"<p>{item()}</p>" for _ in range(rng.randint(2, 6))),
        "advert": lambda: f"<p>{_sentences(rng, rng.randint(3, 25))}</p>",
        "comments": lambda: f"<h3>{_words(rng, rng.randint(1, 2))}</h3>" + "".join(f"<p>{_sentences(rng, rng.randint(2, 40))}</p>" for _ in range(rng.randint(1, 5))),
    }[kind]()


# What names the kinds of boilerplate have where pages name them.
_KIND_NAMES = {"menu": ["menu", "navbar", "breadcrumbs", "top-nav"], "tagline": ["masthead", "topbar"], "legal": ["footer", "copyright", "legal"],
               "notice": ["cookie-notice", "consent", "gdpr", "notice"], "invite": ["newsletter", "subscribe", "signup", "login"],
               "teasers": ["related", "sidebar", "recommended", "widget"], "advert": ["ad", "advert", "sponsored", "banner"], "comments": ["comments", "commentlist"]}
# Names that lie as well as tell; beside a marked article they tell.
_EITHER_NAMES = ["discussion", "replies", "legal-notice", "notice", "side", "follow"]
_KIND_TAGS = {"menu": "nav", "tagline": "header", "legal": "footer", "teasers": "aside", "invite": "form"}


def compose_page(rng: random.Random) -> str:
    """A labelled page. Adverts, comments and notices of whole sentences can be told apart by their
    wrappers only, or by the article's, so they have one there; the other kinds may stand without."""
    style = rng.choice(["elements", "names", "none", "none", "mixed"])
    wrap = rng.random()
    marked = style in ("elements", "mixed") and wrap < 0.8

    def part(kind: str, bare: bool = True) -> str:
        inner = _boilerplate(rng, kind)
        how = rng.choice(["elements", "names", "none"]) if style == "mixed" else style
        how = "names" if how == "none" and not bare else how
        if how == "elements" and kind in _KIND_TAGS:
            return f"<{_KIND_TAGS[kind]}>{inner}</{_KIND_TAGS[kind]}>"
        if how == "none" and (kind not in ("advert", "comments") or marked and bare):
            return rng.choice([f"<div>{inner}</div>", inner, f'<div class="{rng.choice(["row", "box", "x1"])}">{inner}</div>'])
        names = _KIND_NAMES[kind] + (_EITHER_NAMES if marked and bare else [])
        return f'<{rng.choice(["div", "section"])} {rng.choice(["class", "id"])}="{rng.choice(names)}">{inner}</div>'.replace("</div>", "</div></section>")

    body = _article(rng, marked)
    if rng.random() < 0.3:  # within the article, but told from it by a wrapper
        body += part(rng.choice(["advert", "teasers", "comments", "invite"]), bare=False) + (f"<p>+ {_sentences(rng, 30)}</p>" if rng.random() < 0.5 else "")
    if marked:
        body = rng.choice(["<article>{}</article>", "<main>{}</main>", '<div role="main">{}</div>']).format(body)
    elif wrap < 0.6:
        body = f'<div class="{rng.choice(["content", "post", "story", "row"])}">{body}</div>'
    some = [rng.choice([0.0, 0.4, 0.5]) for _ in range(2)]
    first = [part(k) for k in ("notice", "tagline", "menu", "advert", "invite") if rng.random() < some[0]]
    last = [part(k) for k in ("comments", "teasers", "invite", "notice", "menu", "legal", "legal") if rng.random() < some[1]]
    page = "".join([*first, body, *last])
    return page.replace("<p", "<div").replace("</p>", "</div>") if rng.random() < 0.2 else page


def labelled_blocks(seed: int = 7) -> list[tuple[float, list[float]]]:
    rng = random.Random(seed)
    out = []
    for page in [*LABELLED_PAGES * 3, *(compose_page(rng) for _ in range(COMPOSED_PAGES))]:
        blocks = cut_blocks(page)
        label = [float(b.text.startswith("+ ")) for b in blocks]
        plain = [b._replace(text=b.text[2:], words=max(b.words - 1, 1)) if y else b
                 for b, y in zip(blocks, label, strict=True)]
        out += zip(label, block_features(plain), strict=True)
    return out


def train_tree(spark: SparkSession, depth: int = TREE_DEPTH):
    """The tree as nested ``Node`` tuples with the prediction in the leaves."""
    rows = spark.createDataFrame(labelled_blocks(), "label double, x array<double>")
    model = DecisionTreeClassifier(maxDepth=depth, maxBins=64, minInstancesPerNode=3, seed=5).fit(
        rows.select("label", array_to_vector("x").alias("features")).coalesce(1))

    def read(node):
        if node.numDescendants() == 0:
            return float(node.prediction())
        return Node(node.split().featureIndex(), float(node.split().threshold()), read(node.leftChild()), read(node.rightChild()))

    return read(model._call_java("rootNode"))


def main_text(page: str, tree) -> str:
    blocks = cut_blocks(page)
    return "\n\n".join(b.text for b, x in zip(blocks, block_features(blocks), strict=True) if decide(tree, x))


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page."""
    spark = pages.sparkSession
    tree = spark.sparkContext.broadcast(train_tree(spark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            texts = [main_text(x or "", tree.value) for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return small_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
