"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page."""

from __future__ import annotations

import html as entities
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyload.llm.common import per_text
from skyload.operators.staging import stage

#: Pages that the field is trained on, at most, chosen by a hash of the page; each is also rendered in so many other layouts.
TRAINING_PAGES, LAYOUTS = 160, 3
EPOCHS = 8

# Fixed values of HTML: elements inside a line of text, elements without content, elements whose content is no text of the page,
# and for some elements those whose start ends them.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var "
    "math semantics mrow mi mn mo ms mtext mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mspace mstyle mpadded object".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg canvas select annotation annotation-xml".split())
CLOSED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]),
    "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
}
SCOPES = frozenset("ul ol dl table article section div aside nav main body header footer form".split())

# Words that make of a class a state of the page ("page-with-comments", "menu-open") and not the name of a part.
STATES = frozenset("has with without no is are show hide shows hides open opened closed enabled disabled hidden visible active layout".split())

PARTS = frozenset("article main section nav aside header footer form div ul body".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    """A leaf block: its text, the letters inside links, the tags above it from the outside in, and words of the classes and ids of
    those that are parts of the page, see :func:`blocks_of`."""

    text: str
    linked: int
    tags: tuple[str, ...]
    names: frozenset[str]


def names_of(attributes: str) -> frozenset[str]:
    if "=" not in attributes:
        return frozenset()
    found = set()
    for match in ATTRIBUTE.finditer(attributes):
        for name in (match.group(1) or match.group(2) or match.group(3) or "").split():
            words = {part.lower() for part in PART.findall(name)}
            if not words & STATES:
                found |= words
    return frozenset(found)


class Element:
    """An open element: its tag, the words of its classes, the letters in it, and whether it holds an article, main part or first heading."""

    __slots__ = ("tag", "names", "size", "holds")

    def __init__(self, tag: str, names: frozenset[str]) -> None:
        self.tag, self.names, self.size, self.holds = tag, names, 0, False


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks of a page in order. Markup need not be well formed; text is decoded, its white space made single.

    Classes of an element say nothing of the blocks in it if it is a wrapper: the body, or one that holds the article, main part or first
    heading and at least half of the page's letters.
    """
    found: list[tuple[str, int, tuple[Element, ...]]] = []
    stack: list[Element] = []
    texts: list[str] = []
    linked = links = 0

    def close() -> None:
        nonlocal linked, links
        if texts:
            text = " ".join(entities.unescape("".join(texts)).split())
            if text:
                found.append((text, linked, tuple(stack)))
                for element in stack:
                    element.size += len(text)
            texts.clear()
        linked = links = 0

    def leave(tag: str) -> None:
        """End the nearest open element of this name, if there is one."""
        for at in range(len(stack) - 1, -1, -1):
            if stack[at].tag == tag:
                del stack[at:]
                return

    at, size = 0, len(page)
    while at < size:
        token = TOKEN.match(page, at)
        at = token.end()
        tag = token.group(2)
        if tag is None:
            piece = token.group()
            if piece[0] != "<" or piece == "<":
                texts.append(piece)
                if links:
                    linked += len(piece)
            continue
        tag = tag.lower()
        if token.group(1):
            if tag in INLINE:
                links -= tag == "a" and links > 0
            elif tag == "br":
                texts.append(" ")
            elif tag not in RAW:
                close()
                leave(tag)
            continue
        if tag in INLINE:
            links += tag == "a"
        elif tag in VOID:
            if tag == "hr":
                close()
            elif tag != "wbr":
                texts.append(" ")
        elif tag in RAW:
            if not token.group(3).endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else size
        else:
            close()
            if stack and stack[-1].tag == "p":
                stack.pop()
            if tag in CLOSED_BY:
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth].tag in CLOSED_BY[tag]:
                        del stack[depth:]
                        break
                    if stack[depth].tag in SCOPES:
                        break
            if tag in ("article", "main", "h1"):
                for element in stack:
                    element.holds = True
            if not token.group(3).endswith("/"):
                stack.append(Element(tag, names_of(token.group(3))))
    close()
    total = sum(len(text) for text, *_ in found)

    def wrapper(element: Element) -> bool:
        return element.tag in ("html", "body") or (element.holds and 2 * element.size >= total)

    return [
        Block(text, linked, tuple(element.tag for element in above), frozenset().union(*(element.names for element in above if not wrapper(element))))
        for text, linked, above in found
    ]


def features_of(blocks: list[Block]) -> list[list[str]]:
    """Names of the features of each block: tags and names above it, and what its text looks like."""
    out = []
    for block in blocks:
        text, words = block.text, block.text.count(" ") + 1
        share = block.linked / len(text)
        found = [f"tag {tag}" for tag in set(block.tags)]
        found += [f"name {name}" for name in block.names]
        parts = [tag for tag in block.tags if tag in PARTS] or [""]
        found += [f"inside {parts[-1]}", f"inside {parts[-1]} named {min(block.names, default='')}"]
        found.append(f"leaf {block.tags[-1] if block.tags else ''}")
        found.append(f"words {min(words, 64).bit_length()}")
        found.append(f"links {0 if share < 0.05 else 1 if share < 0.5 else 2}")
        if text[-1] in ".!?…\"”»":
            found.append("sentence")
        if ", " in text:
            found.append("comma")
        if "©" in text or "(c)" in text.lower():
            found.append("copyright")
        if any(mark in text for mark in ("|", "·", "»", "›")):
            found.append("separator")
        out.append([*found, "any"])
    return out


@dataclass
class Field:
    """Weights of features for a block to be main text, and of neighbours for being alike (rows: before, columns: after)."""

    weights: dict[str, float]
    moves: np.ndarray

    def emissions(self, features: list[list[str]]) -> list[float]:
        get = self.weights.get
        return [sum([get(name, 0.0) for name in names]) for names in features]

    def decode(self, features: list[list[str]]) -> list[int]:
        """The most probable labels of a page, by Viterbi; label 1 is main text."""
        (aa, ab), (ba, bb) = self.moves.tolist()
        other = main = 0.0
        back: list[tuple[int, int]] = []
        for nth, gain in enumerate(self.emissions(features)):
            if nth:
                back.append((int(main + ba > other + aa), int(main + bb >= other + ab)))
                other, main = max(other + aa, main + ba), max(other + ab, main + bb) + gain
            else:
                other, main = 0.0, gain
        labels = [int(main > other)]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1] if features else []


def train(pages: list[tuple[list[list[str]], list[int]]], epochs: int = EPOCHS, seed: int = 3) -> Field:
    """Maximum likelihood by stochastic gradients with adapted steps; sums over all labelings by forward and backward passes."""
    names = {name: at for at, name in enumerate(sorted({n for features, _ in pages for block in features for n in block}))}
    coded = [([np.array([names[n] for n in block]) for block in features], np.array(labels)) for features, labels in pages if labels]
    weights, moves = np.zeros(len(names)), np.zeros((2, 2))
    seen, seen_moves = np.full(len(names), 1e-2), np.full((2, 2), 1e-2)
    draw = random.Random(seed)
    for _ in range(epochs):
        draw.shuffle(coded)
        for blocks, labels in coded:
            size = len(blocks)
            gains = np.array([weights[block].sum() for block in blocks])
            scores = np.column_stack([np.zeros(size), gains])
            forward, backward = scores.copy(), np.zeros((size, 2))
            for i in range(1, size):
                forward[i] += np.logaddexp(forward[i - 1, 0] + moves[0], forward[i - 1, 1] + moves[1])
            for i in range(size - 2, -1, -1):
                after = moves + scores[i + 1] + backward[i + 1]
                backward[i] = np.logaddexp(after[:, 0], after[:, 1])
            total = np.logaddexp(forward[-1, 0], forward[-1, 1])
            main = np.exp(forward[:, 1] + backward[:, 1] - total)
            slope = np.zeros(len(names))
            for block, error in zip(blocks, labels - main):
                slope[block] += error
            slope -= 1e-3 * weights
            slope_moves = -1e-3 * moves
            if size > 1:
                pairs = forward[:-1, :, None] + moves[None] + (scores[1:] + backward[1:])[:, None, :] - total
                slope_moves -= np.exp(pairs).sum(axis=0)
                np.add.at(slope_moves, (labels[:-1], labels[1:]), 1.0)
            seen += slope**2
            seen_moves += slope_moves**2
            weights += 0.3 * slope / np.sqrt(seen)
            moves += 0.3 * slope_moves / np.sqrt(seen_moves)
    return Field({name: float(weights[at]) for name, at in names.items()}, moves)


# The labelled pages. ---------------------------------------------------------------------------------------------------

#: Words in classes and ids, and elements, of parts that are not the article, wherever they stand.
ASIDE_TAGS = frozenset("nav aside footer form header menu dialog button".split())
ASIDE_NAMES = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies footer form header login menu nav navigation newsletter "
    "notice popup promo promoted related reply replies search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
MAIN_NAMES = frozenset("article body content entry main post story text".split())


def label_of(block: Block) -> int | None:
    """The label that the markup of a page itself tells, None if it tells none: inside its article, but not in a part set aside."""
    within = "article" in block.tags or "main" in block.tags
    start = max((at for at, tag in enumerate(block.tags) if tag in ("article", "main")), default=-1)
    if ASIDE_TAGS & set(block.tags[start + 1 :]) or ASIDE_NAMES & block.names:
        return 0
    return int(within)


def render(title: str, paragraphs: list[str], others: list[str], draw: random.Random) -> tuple[str, list[int]]:
    """A page in another layout, with the label of each of its blocks; the texts of its frame come from other pages."""
    out: list[str] = []
    labels: list[int] = []

    def part(markup: str, pieces: list[str], label: int) -> None:
        """Markup with one place per piece, each of which becomes a block."""
        out.append(markup.format(*[entities.escape(piece) for piece in pieces]))
        labels.extend([label] * len(pieces))

    def short() -> str:
        return " ".join(draw.choice(others).split()[: draw.randint(1, 6)]) or "x"

    def sentence() -> str:
        return " ".join(draw.choice(others).split()[: draw.randint(6, 40)]) or "x"

    def menu(name: str) -> None:
        number = draw.randint(2, 7)
        tag = draw.choice(["nav", "div", "ul"])
        inner = "<li><a href='#'>{}</a></li>" * number
        part(f'<{tag} class="{name}">' + (inner if tag == "ul" else f"<ul>{inner}</ul>") + f"</{tag}>", [short() for _ in range(number)], 0)

    def frame(tag: str, name: str, number: int) -> None:
        part(f'<{tag} class="{name}">' + "<p>{}</p>" * number + f"</{tag}>", [sentence() for _ in range(number)], 0)

    if draw.random() < 0.6:
        part(draw.choice(['<header class="site-header"><div>{}</div></header>', '<header><h2>{}</h2></header>', '<div id="header">{}</div>']), [short()], 0)
    menu(draw.choice(["menu", "navigation", "main-nav", "navbar", "top-menu"]))
    if draw.random() < 0.5:
        frame("div", draw.choice(["cookie-notice", "cookie-consent", "notice", "banner notice"]), 1)
    if draw.random() < 0.5:
        part(f'<div class="{draw.choice(["breadcrumb", "breadcrumbs"])}">{{}}</div>', [short()], 0)
    if draw.random() < 0.5:
        frame("div", draw.choice(["ad", "ads", "advert", "advertisement", "sponsored", "promo"]), 1)
    sidebar = draw.choice(["sidebar", "related", "widget sidebar", "side"])
    first = draw.random() < 0.3
    if first:
        frame(draw.choice(["aside", "div"]), sidebar, draw.randint(1, 3))
    holder, name = draw.choice([("article", "post"), ("article", ""), ("main", ""), ("div", "content"), ("div", "post-content"), ("div", "entry-content"), ("div", "article-body"), ("section", "story"), ("div", "main-text")])
    out.append(f'<{holder} class="{name}">')
    if title:
        part(draw.choice(["<h1>{}</h1>", "<h1 class='title'>{}</h1>", "<h2>{}</h2>"]), [title], 1)
    middle = draw.randrange(len(paragraphs) + 1)
    for at, paragraph in enumerate(paragraphs):
        if at == middle and draw.random() < 0.5:
            frame(draw.choice(["div", "aside"]), draw.choice(["ad", "advert", "related", "newsletter", "promo"]), 1)
        part(draw.choice(["<p>{}</p>", "<p>{}", "<div>{}</div>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<h3>{}</h3>"][: draw.choice([1, 2, 6])]), [paragraph], 1)
    inside = draw.random() < 0.4
    if not inside:
        out.append(f"</{holder}>")
    if draw.random() < 0.6:
        number = draw.randint(1, 4)
        tag = draw.choice(["section", "div"])
        part(f'<{tag} class="{draw.choice(["comments", "comment-list", "reader-comments"])}">' + '<div class="comment"><p>{}</p></div>' * number + f"</{tag}>", [sentence() for _ in range(number)], 0)
    if inside:
        out.append(f"</{holder}>")
    if draw.random() < 0.5:
        part(draw.choice(['<form class="newsletter"><p>{}</p><input type="text"></form>', '<form action="/s"><div>{}</div><input></form>', '<div class="subscribe form">{}</div>']), [sentence()], 0)
    if not first and draw.random() < 0.6:
        frame(draw.choice(["aside", "div"]), sidebar, draw.randint(1, 3))
    if draw.random() < 0.5:
        menu(draw.choice(["share", "social", "related"]))
    part(draw.choice(["<footer>{}</footer>", '<div class="footer">{}</div>', '<footer class="site-footer"><p>{}</p></footer>']), [draw.choice(["© ", ""]) + sentence()], 0)
    return "<html><body>" + "".join(out) + "</body></html>", labels


def labelled_pages(pages: list[str], layouts: int = LAYOUTS, seed: int = 11) -> list[tuple[list[list[str]], list[int]]]:
    """Features and labels of the pages whose markup names their article, and of the same texts in other layouts."""
    draw = random.Random(seed)
    parsed = [blocks for blocks in map(blocks_of, pages) if blocks]
    others = [block.text for blocks in parsed for block in blocks] or ["x"]
    out = []
    for blocks in parsed:
        labels = [label_of(block) for block in blocks]
        if not any(labels):
            continue
        out.append((features_of(blocks), labels))
        main = [block.text for block, label in zip(blocks, labels) if label]
        for _ in range(layouts):
            page, known = render(main[0], main[1:], others, draw)
            found = blocks_of(page)
            if len(found) == len(known):
                out.append((features_of(found), known))
    return out


#: What the field is trained on if a table has no page whose markup names its article.
FALLBACK = ["<html><body><nav><ul><li><a href='#'>One</a></li><li><a href='#'>Two</a></li></ul></nav><article><h1>A title</h1>"
            "<p>Some words, and more of them, make a sentence. Another one follows here.</p><p>It ends, as all do.</p></article>"
            "<footer>© someone</footer></body></html>"] * 20  # fmt: skip


def learn_field(pages: DataFrame, html_column: str = "html") -> Field:
    """A field trained on at most ``TRAINING_PAGES`` pages, which are all that reaches the driver.

    Labels come from pages whose markup names the article, and from the same texts rendered in other layouts, where
    every block's part is known: so what a table's own layout does not have, such as comments or forms, is learned too.
    """
    rows = pages.select(F.col(html_column).alias("html")).where("html IS NOT NULL")
    named = rows.where(F.lower("html").contains("<article") | F.lower("html").contains("<main"))
    # The marks are chosen first, so that no whole page leaves its task but those of the chosen ones, each once.
    mark = F.xxhash64("html").alias("mark")
    marks = stage(named.select(mark).distinct().orderBy("mark").limit(TRAINING_PAGES))
    chosen = named.select("html", mark).join(F.broadcast(marks), "mark", "left_semi").dropDuplicates(["mark"])
    found = labelled_pages([row["html"] for row in chosen.orderBy("mark").select("html").collect()])
    return train(found or labelled_pages(FALLBACK))


def main_text(page: bytes, field: Field) -> str:
    blocks = blocks_of(page.decode())
    labels = field.decode(features_of(blocks))
    return " ".join(block.text for block, label in zip(blocks, labels) if label)


def extract_text(pages: DataFrame, html_column: str = "html", field: Field | None = None) -> DataFrame:
    """(row, text): the columns of ``pages`` without the HTML as a struct, and the main text, empty if there is none.

    The whole page is read whatever its size. Null and empty pages have an empty text, pages are judged one by one, so
    repeated rows and ties need no rule; null ids are allowed; an empty table gives an empty result.
    """
    known = field or learn_field(pages, html_column)
    extract = per_text(lambda page: main_text(page, known), "string", pa.string())
    row = F.struct(*[F.col(f"`{name}`") for name in pages.columns if name != html_column]).alias("row")
    return pages.select(row, extract(html_column).alias("text"))
