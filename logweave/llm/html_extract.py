"""Main text of web pages: flat text blocks, classified by a decision tree on word counts and link densities."""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|sponsor(?:ed|s)?|promo(?:tion)?s?|banner|cookies?|consent|notices?|alert|sidebar|side-?bar|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|site-?header|page-?header|comments?|reply|replies|responses|share|sharing|social|related|recommended|newsletter|subscribe|popup|modal|overlay|widget|toc|pagination|pager|login|signup|search|contentinfo|complementary|dialog)(?:$|[\s_-])",
    re.I,
)

#: Elements whose text no reader sees as text.
UNSEEN = frozenset("script style noscript template svg math iframe object canvas audio video select textarea title head".split())
#: Elements that are furniture by their name.
FURNITURE = frozenset("nav footer aside form menu dialog button".split())
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = FURNITURE | MAIN | HEADINGS | frozenset(
    "html body header section div p ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption address fieldset legend details summary hr center optgroup option".split()
)
#: What a new paragraph does not close.
_SCOPES = BLOCKS - frozenset("p".split()) - HEADINGS


#: What may stand in a head besides text of its own elements; any other tag ends a head that isn't closed.
IN_HEAD = frozenset("head base basefont bgsound link meta noframes noscript script style template title".split())


def _seen_again(page: str, at: int, name: str) -> int:
    """Where the page goes on after an element of UNSEEN that begins before `at`.

    That is after its end tag. Without one, a head ends at the first tag that may not stand in it, and other elements
    but script and style end at the next block tag.
    """
    close = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
    # A head that isn't closed before the body begins ends there.
    if close and not (name == "head" and (body := re.compile(r"<body\b", re.I).search(page, at, close.start()))):
        return close.end()
    if close:
        return body.start()
    if name in ("script", "style"):
        return len(page)
    while tag := _TAG.search(page, at):
        inner = (tag[2] or "").lower()
        if name == "head":
            if inner and inner not in IN_HEAD and (not tag[1] or inner in ("body", "html")):
                return tag.start()
        elif inner in BLOCKS and not (name == "select" and inner in ("option", "optgroup", "hr")):
            return tag.start()
        at = tag.end()
        if name == "head" and inner in UNSEEN and inner != "head" and not tag[1] and not (tag[3] or "").endswith("/"):
            at = _seen_again(page, at, inner)
    return len(page)


@dataclass
class Block:
    text: str
    words: int
    link_words: int
    furniture: bool
    main: bool
    heading: bool


class _Open:
    """Open elements: name, and whether they or one around them are furniture, the main part, a heading, a link.

    Where each name was opened last and where the last scope began are kept, so that no tag has to search for them.
    """

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, bool, bool, bool]] = []
        self.at: dict[str, list[int]] = {}
        self.scopes: list[int] = []

    def push(self, name: str, *state: bool) -> None:
        self.at.setdefault(name, []).append(len(self.stack))
        if name in _SCOPES:
            self.scopes.append(len(self.stack))
        self.stack.append((name, *state))

    def close(self, name: str, within_scope: bool) -> None:
        """Closes the last open element of the name and what is open inside it, unless a scope bars the way."""
        place = self.at.get(name) or [-1]
        if place[-1] < 0 or (within_scope and self.scopes and self.scopes[-1] > place[-1]):
            return
        for _ in range(len(self.stack) - place[-1]):
            inner = self.stack.pop()[0]
            self.at[inner].pop()
            if inner in _SCOPES:
                self.scopes.pop()

    @property
    def state(self) -> tuple[bool, bool, bool, bool]:
        return self.stack[-1][1:] if self.stack else (False, False, False, False)


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order, each with white space as single spaces."""
    out: list[Block] = []
    opened = _Open()
    parts: list[str] = []
    linked: list[str] = []
    state: tuple[bool, bool, bool, bool] = (False, False, False, False)
    at, end, unseen = 0, len(page), ""

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                links = len(html.unescape(" ".join(linked)).split())
                out.append(Block(text, len(text.split()), links, state[0], state[1], state[2]))
            parts.clear()
            linked.clear()

    def add(text: str) -> None:
        parts.append(text)
        if state[3]:
            linked.append(text)

    while at < end:
        if unseen:
            at = _seen_again(page, at, unseen)
            unseen = ""
            continue
        tag = _TAG.search(page, at)
        if not tag:
            add(page[at:])
            break
        if tag.start() > at:
            add(page[at : tag.start()])
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if name in BLOCKS:
            flush()
        elif name == "br":
            add(" ")
        if tag[1]:
            opened.close(name, name not in BLOCKS)
            state = opened.state
            continue
        if name in UNSEEN:
            unseen = "" if (tag[3] or "").endswith("/") else name
            continue
        if name in VOID:
            continue
        if name in BLOCKS:
            opened.close("p", True)
            state = opened.state
        hinted = name not in MAIN and name not in ("html", "body") and any(_HINT.search(a[1] or a[2] or a[3]) for a in (m.group(0, 2, 3, 4) for m in _ATTRIBUTE.finditer(tag[3])) if a[1] or a[2] or a[3]) if tag[3] else False
        furniture = state[0] or name in FURNITURE or hinted or (name == "header" and not state[1])
        opened.push(name, furniture, state[1] or name in MAIN, state[2] or name in HEADINGS, state[3] or name == "a")
        state = opened.state
    flush()
    return out


def features(found: list[Block]) -> np.ndarray:
    """A row per block: furniture, main part, heading, words, link density, then words and link density of both neighbours."""
    own = np.array([(b.words, min(1.0, b.link_words / b.words)) for b in found], float).reshape(-1, 2)
    edge = np.zeros((1, 2))
    flags = np.array([(b.furniture, b.main, b.heading) for b in found], float).reshape(-1, 3)
    return np.hstack((flags, own, np.vstack((edge, own[:-1])), np.vstack((own[1:], edge))))


#: Labelled pages made by hand; their blocks begin with + (main text) or - (not main text).
BY_HAND = (
    "<header><div>- Daily Paper</div><div><a>- Sign in</a></div></header><nav><li><a>- Home</a><li><a>- World news</a><li><a>- Sport</a></nav><article><h1>+ A title of a few words</h1><p>+ A first paragraph that goes on for quite a number of words and tells what happened where and when.<p>+ Short.<p>+ No.<p>+ Another paragraph of running text with <a>one link</a> among its many other plain words.</article><aside><p>- More from this author in our weekly letter to all of our readers</aside><footer>- All rights reserved 2020</footer>",
    "<div id=menu><a>- Products</a><p><a>- Prices and plans</a></div><main><h2>+ Two words</h2><p>+ Yes.</p><p>+ This is how the story went on, as far as anybody who was there that night could tell us later.</p><li>+ one item</li><li>+ another item of a list</li><p><a>- Read more stories like this</a></p></main><div class=cookie-notice>- We use cookies to make this site better for you, please accept all of them to go on</div>",
    "<div>- Menu</div><div><a>- Start</a></div><div><a>- About us</a></div><h1>+ How to mend a bicycle tyre</h1><p>+ First take the wheel off the frame and lay it flat on the ground so that you can reach the valve with ease.</p><p>+ Then press.</p><p>+ Use the levers to lift one side of the tyre over the rim, then pull the tube out and look for the hole in it.</p><div><a>- Next page</a></div><div><a>- Contact</a></div><div>- Copyright</div>",
    "<article><p>+ The council met on Tuesday to talk about the bridge, and after some hours of debate it put the matter off again.</p><div class=ad>- Buy two of these wonderful shoes now and get a third one for free, only today and only here</div><p>+ Nobody was glad.</p><section id=comments><p>- I was there and it was nothing like what you have written here, you should all be ashamed</p><p>- Same</p></section><form>- Leave a reply with your name and your address <p>- Send</p></form></article>",
    "<div>- Chapter</div><article><p>+ So.</p><p>+ Of the many who came that evening only a few stayed until the lights went out.</p><p>+ To be.</p><p>+ Be</p><h2>+ End</h2><p>+ Was.</p><p>+ Then all of them walked home through the rain without a word to each other.</p><p>+ On.</p></article><p>- Print</p>",
    "<nav><a>- Front page</a></nav><article><h1>+ Rain</h1><p>+ It rained all day.</p><p>+ And it rained all night, too, so that in the morning the fields were lakes.</p><p>+ The end.</p></article>",
    "<main><p>+ Only a line.</p></main>",
    "<div class=banner>- Summer sale</div><main><p>+ One</p><p>+ Two</p><p>+ Three short paragraphs</p></main><div class=sidebar><p>- Most read stories of the week that our readers liked to share with their friends</p></div>",
    "<p>- Log in</p><p>+ It was a long way down to the harbour, and the road was wet, and no one had thought of bringing a lamp or a coat.</p><p>+ They went anyway.</p><p>+ When they came to the water the boat had left, and all that was there was an old dog that looked at them and yawned.</p><p><a>- Terms</a></p><p><a>- Privacy</a></p>",
)


def labelled_page(seed: int) -> str:
    """A labelled page made by a rule: with elements named for their part, with classes that name it, or with neither.

    In the last kind nothing but the lengths of texts and their links tells what is main text. Pages of the other
    kinds also have passages that read as main text does: readers' comments, notices and adverts.
    """
    rng = random.Random(seed)
    kind = ("named", "classed", "bare")[seed % 3]
    words = lambda low, high: " ".join("".join(rng.choice("aeioulnrstdm") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(low, high)))
    link = lambda low, high: f"<a href=x>- {words(low, high)}</a>"
    around = lambda element, cls, inner: f"<{element}>{inner}</{element}>" if kind == "named" else f'<div class="{cls}">{inner}</div>' if kind == "classed" else f"<div>{inner}</div>"

    def article() -> str:
        out = [f"<h1>+ {words(2, 14)}</h1>"]
        for _ in range(rng.randint(2, 9)):
            long = rng.random() < 0.75
            part = rng.choice(("p", "p", "p", "li", "blockquote")) if kind != "bare" else "p"
            text = words(12, 120) if long else words(1, 9) if kind != "bare" else words(5, 12)
            inner = f" <a href=y>{words(1, 3)}</a> {words(6, 12)}" if long and rng.random() < 0.3 else ""
            out.append(f"<{part}>+ {text}{inner}</{part}>")
            if kind != "bare" and rng.random() < 0.15:
                out.append(f'<div class="{rng.choice(("ad", "promo", "newsletter signup", "related"))}">- {words(4, 40)}</div>')
        return "".join(out)

    menu = "".join(f"<li>{link(1, 3)}</li>" for _ in range(rng.randint(2, 8)))
    out = [around("nav", rng.choice(("menu", "navbar", "breadcrumb")), f"<ul>{menu}</ul>")]
    if rng.random() < 0.5 and kind != "bare":
        out.append(f'<div class="{rng.choice(("cookie-notice", "banner", "alert"))}">- {words(5, 40)}</div>')
    body = article()
    if kind != "bare" and rng.random() < 0.4:
        body += f'<section class="comments">{"".join(f"<p>- {words(3, 60)}</p>" for _ in range(rng.randint(1, 4)))}</section>'
    out.append(f"<article>{body}</article>" if kind == "named" else f"<main>{body}</main>" if kind == "classed" and rng.random() < 0.5 else f"<div>{body}</div>")
    if rng.random() < 0.6:
        out.append(around("aside", "sidebar", "".join(f"<p>{link(3, 9)}</p>" for _ in range(rng.randint(2, 5)))))
    if rng.random() < 0.4 and kind != "bare":
        out.append(f"<form><p>- {words(2, 6)}</p><p>- {words(2, 30)}</p></form>")
    out.append(around("footer", "footer", f"<p>- {words(2, 12) if kind != 'bare' else words(2, 4)}</p>" + "".join(link(1, 2) for _ in range(rng.randint(0, 3)))))
    return "".join(out)


#: Pages made by the rule that the tree learns from; the next HELD_BACK seeds are for measuring it.
MADE, HELD_BACK = 400, 100


def labelled(pages: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of labelled pages."""
    rows, marks = [], []
    for page in pages:
        rows.append(features(blocks(re.sub(r">[+-] ", ">", page))))
        marks += [b.text.startswith("+") for b in blocks(page)]
    return np.vstack(rows), np.array(marks, float)


@dataclass
class Tree:
    """A binary decision tree; a leaf has no feature."""

    keep: bool
    feature: int | None = None
    most: float = 0.0
    low: Tree | None = None
    high: Tree | None = None

    def decide(self, rows: np.ndarray) -> np.ndarray:
        if self.feature is None:
            return np.full(len(rows), self.keep)
        return np.where(rows[:, self.feature] <= self.most, self.low.decide(rows), self.high.decide(rows)) if len(rows) else np.zeros(0, bool)


#: Blocks of the labelled table that a leaf rests on at least.
LEAF = 12


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 5) -> Tree:
    """Splits by the least Gini impurity; of equal splits the first feature and the lowest threshold win."""
    keep = bool(labels.mean() >= 0.5)
    best: tuple[float, int, float] | None = None
    if depth and 0 < labels.sum() < len(labels):
        for f in range(rows.shape[1]):
            values = np.unique(rows[:, f])
            for most in (values[1:] + values[:-1]) / 2:
                low = rows[:, f] <= most
                if min(low.sum(), len(low) - low.sum()) < LEAF:
                    continue
                impurity = sum(part.mean() * (1 - part.mean()) * len(part) for part in (labels[low], labels[~low]))
                if best is None or impurity < best[0] - 1e-9:
                    best = (impurity, f, float(most))
    if best is None:
        return Tree(keep)
    low = rows[:, best[1]] <= best[2]
    return Tree(keep, best[1], best[2], grow(rows[low], labels[low], depth - 1), grow(rows[~low], labels[~low], depth - 1))


def trained_tree() -> Tree:
    return grow(*labelled([*BY_HAND, *map(labelled_page, range(MADE))]))


def main_text(page: str, tree: Tree) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, keep in zip(found, tree.decide(features(found)), strict=True) if keep) if found else ""


def extract_main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages' page_id and url with `text`, the main text of the whole html, and `n_chars`, its code points.

    White space inside a block becomes one space; kept blocks are joined by line feeds in page order; character
    references are decoded. Null or empty html, and pages without main text, give an empty text. Markup that is cut
    off, badly nested or not closed is read as far as it goes. Each page is worked on alone, in memory in proportion
    to its length; repeated rows give repeated results, an empty table none, and other columns are not read.
    """
    tree = trained_tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                texts = [main_text(p, tree) if p else "" for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    read = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col(html_col).cast("string"))
    return read.mapInArrow(run, "page_id long, url string, text string, n_chars long")
