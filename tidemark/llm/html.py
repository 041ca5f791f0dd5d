"""Main text of web pages by a tree-structured graphical model.

Block elements and the text runs between their tags are the nodes of a tree; each is content or not. Node
potentials come from tag, class, id and the shape of a text, edge potentials tie a node to its parent. Sum-product messages
upward and downward give the exact marginal of every node. All potentials are counted on labelled pages.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import Batches, batch, map_batches, texts

# Elements of HTML by the way they are laid out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rp rt s samp small span strike "
    "strong sub sup time tt u var wbr img "
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle msub msup msubsup munder mover munderover mfenced semantics annotation".split()
)
RAW = "script|style|textarea|noframes|template|iframe|svg|title|canvas|audio|video|select"
CLOSES = {  # an opening tag ends these, if they are open below the nearest of the second set
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "body": (frozenset(["head"]), frozenset()),
}

_ATTRIBUTES = r"(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
_DROP = re.compile(rf"(?is)<!--.*?(?:-->|\Z)|<svg{_ATTRIBUTES}(?<=/)>|<({RAW}){_ATTRIBUTES}>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)")
_TOKEN = re.compile(
    r"(?s)<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*+>|([^<]+|<)"
)
_MARKS = re.compile(r"(?i)\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_LABEL = re.compile(r"\by=([01])")

# Elements that lay out content and other matter alike; their tags say nothing.
NEUTRAL = frozenset(
    "#root html body div span section p ul ol li dl dt dd table thead tbody tfoot tr td th h1 h2 h3 h4 h5 h6 pre blockquote figure "
    "figcaption center hr address details summary".split()
)

SMOOTHING = 0.5  # added to the counts of parent and child
FAINT = 0.02  # added to the counts of signs: one that only the other class shows says much
ROOT = (0.3, 0.7)  # before anything is seen; a page without marks is content
BARE = 0.28  # share of the labelled articles, and of what is outside, whose elements say nothing
LIKELY = 0.5  # least marginal of a text that is kept


class Tree:
    """Nodes of a page in document order: parents, features, texts of leaves, and labels where the page has them."""

    __slots__ = ("parent", "feature", "text", "label")

    def __init__(self):
        self.parent, self.feature, self.text, self.label = [-1], [("e", "#root", "")], [None], [None]

    def add(self, parent: int, feature: tuple, text: str | None, label: int | None) -> int:
        self.parent.append(parent)
        self.feature.append(feature)
        self.text.append(text)
        self.label.append(self.label[parent] if label is None else label)
        return len(self.parent) - 1


def parse(page: str, labelled: bool = False) -> Tree:
    """The tree of a page. Missing end tags are put in as browsers do for paragraphs, items and cells; stray ones are passed over."""
    tree = Tree()
    stack: list[tuple[str, int]] = [("#root", 0)]  # open elements with the node they belong to
    run: list[str] = []  # text since the last block boundary
    linked = links = 0  # open links, and characters of the run inside links

    def flush() -> None:
        nonlocal links
        if run:
            text = "".join(run)
            if "&" in text:
                text = entities.unescape(text)
            words = text.split()
            if words:
                share = links / max(1, sum(map(len, run)))
                length = min(4, len(words).bit_length() // 2)
                tree.add(stack[-1][1], ("t", length, 2 if share > 0.6 else int(share > 0.2)), " ".join(words), None)
            run.clear()
        links = 0

    cut = page.rfind(">") + 1  # no tag begins in the rest, which need not be searched for one
    for slash, tag, rest, slash2, tag2, rest2, text in [*_TOKEN.findall(_DROP.sub("", page[:cut])), ("",) * 6 + (page[cut:],)]:
        if text:
            run.append(text)
            if linked:
                links += len(text)
            continue
        tag, slash, rest = (tag or tag2).lower(), slash or slash2, rest or rest2
        if not tag:
            continue
        if tag in INLINE:
            if tag == "a":
                linked = 0 if slash else 1
            continue
        if tag == "br":
            run.append(" ")
            continue
        flush()
        linked = 0
        if slash:
            for at in range(len(stack) - 1, 0, -1):
                if stack[at][0] == tag:
                    del stack[at:]
                    break
            continue
        if tag in VOID:
            continue
        if stack[-1][0] == "p":  # any block ends a paragraph
            stack.pop()
        ends = CLOSES.get(tag)
        if ends:
            for at in range(len(stack) - 1, 0, -1):
                if stack[at][0] in ends[1]:
                    break
                if stack[at][0] in ends[0]:
                    del stack[at:]
                    break
        marks = " ".join("".join(m) for m in _MARKS.findall(rest)).lower() if rest and not rest.isspace() else ""
        label = None
        if labelled and (found := _LABEL.search(rest)):
            label = int(found[1])
        node = tree.add(stack[-1][1], ("e", tag, marks), None, label)
        if not rest.endswith("/") or tag in ("p", "div"):
            stack.append((tag, node))
    flush()
    return tree


def _signs(feature: tuple) -> list[tuple]:
    """What a node shows: its tag and the words of class, id and role, or length and links of a text."""
    if feature[0] == "t":
        return [("length", feature[1]), ("links", feature[2])]
    tag = [] if feature[1] in NEUTRAL else [("tag", feature[1])]
    return tag + [("mark", w) for w in sorted(set(re.findall(r"[a-z]+", feature[2])))]


class Model:
    """Potentials counted on labelled trees."""

    def __init__(self, pages: list[str]):
        edges = {kind: [[SMOOTHING] * 2 for _ in range(2)] for kind in "tem"}
        signs: tuple[Counter, Counter] = (Counter(), Counter())
        totals: tuple[Counter, Counter] = (Counter(), Counter())
        for page in pages:
            tree = parse(page, labelled=True)
            whole = int("y=0" not in page)  # nothing but content: the root is content too
            labels = [whole if y is None else y for y in tree.label]
            for parent, feature, y in zip(tree.parent[1:], tree.feature[1:], labels[1:]):
                shown = _signs(feature)
                kind = "t" if feature[0] == "t" else "m" if shown else "e"  # text, bare element, element with marks of its own
                edges[kind][labels[parent]][y] += 1
                for sign in shown:
                    signs[y][sign] += 1
                totals[y][feature[0]] += 1
        self.edge = {kind: tuple(tuple(x / sum(row) for x in row) for row in rows) for kind, rows in edges.items()}
        self.signs, self.totals = signs, totals
        self.potential = lru_cache(50_000)(self._potential)

    def _potential(self, feature: tuple) -> tuple[float, float, tuple]:
        """Likelihood of what a node shows, without and with content, the larger being 1, and its edge. Unknown marks say nothing."""
        odds, kind = 0.0, "t" if feature[0] == "t" else "e"
        for sign in _signs(feature):
            seen = [self.signs[y][sign] for y in (0, 1)]
            if sum(seen):
                kind = "t" if feature[0] == "t" else "m"
                rate = [(seen[y] + FAINT) / (self.totals[y][feature[0]] + 2 * FAINT) for y in (0, 1)]
                odds += math.log(rate[1] / rate[0])
        odds = max(-30.0, min(30.0, odds))
        return (1.0, math.exp(odds), self.edge[kind]) if odds < 0 else (math.exp(-odds), 1.0, self.edge[kind])

    def marginals(self, tree: Tree) -> list[float]:
        """Probability of content for every node: messages from the leaves to the root, then back."""
        parent = tree.parent
        n = len(parent)
        own = [self.potential(f) for f in tree.feature]
        inner = [(a, b) for a, b, _ in own]  # potential times the messages of the children
        up = [(1.0, 1.0)] * n
        for i in range(n - 1, 0, -1):
            a, b = inner[i]
            (s00, s01), (s10, s11) = own[i][2]
            m0, m1 = s00 * a + s01 * b, s10 * a + s11 * b
            up[i] = (m0, m1)
            p0, p1 = inner[parent[i]]
            p0, p1 = p0 * m0, p1 * m1
            top = p0 if p0 > p1 else p1
            inner[parent[i]] = (p0 / top, p1 / top)
        out = [ROOT] * n  # what the rest of the page says about a node
        found = [0.0] * n
        for i in range(n):
            if i:
                p = parent[i]
                r0, r1 = inner[p][0] * out[p][0] / up[i][0], inner[p][1] * out[p][1] / up[i][1]
                (s00, s01), (s10, s11) = own[i][2]
                o0, o1 = r0 * s00 + r1 * s10, r0 * s01 + r1 * s11
                top = o0 if o0 > o1 else o1
                out[i] = (max(o0 / top, 1e-200), max(o1 / top, 1e-200))
            a, b = inner[i][0] * out[i][0], inner[i][1] * out[i][1]
            inner[i] = (max(inner[i][0], 1e-200), max(inner[i][1], 1e-200))
            found[i] = b / (a + b)
        return found


# Class words and elements of the labelled pages.
OUTSIDE_MARKS = (
    "ad ads adbox advert advertisement advertising alert banner bottom breadcrumb breadcrumbs byline comment comments consent cookie "
    "cookies copyright disclaimer discussion disqus feedback footer gdpr header legal links login masthead menu meta modal nav "
    "navbar navigation newsletter notice notification pager pagination popup privacy promo promoted rail reader related replies "
    "reply respond responses search share sidebar side signup social sponsor sponsored subscribe tags toc toolbar top topbar warning widget"
).split()
INSIDE_MARKS = "article body content entry main post prose story text page".split()
OUTSIDE_TAGS = ["nav", "header", "footer", "aside", "form", "dialog", "fieldset"]
ROLES = ["navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog"]


def training_pages(count: int = 800) -> list[str]:
    """Labelled pages: the attribute ``y`` marks elements as content (1) or not (0), and holds for what they contain."""
    draw = random.Random(7)
    words = "one two three four five six seven eight nine ten".split()
    say = lambda low, high: " ".join(draw.choice(words) for _ in range(draw.randint(low, high))) + draw.choice([".", ".", ""])
    link = lambda: f"<a href=/x>{say(1, 3)}</a>"

    def prose() -> str:
        kind = draw.randrange(16)
        if kind < 8:
            return f"<p>{say(1, 60)}</p>"
        return [
            f"<p>{say(1, 9)} {link()} {say(5, 30)}</p>", f"<h{draw.randint(1, 4)}>{say(2, 7)}</h2>",
            "<ul>" + "".join(f"<li>{say(1, 20)}</li>" for _ in range(draw.randint(2, 5))) + "</ul>",
            "<ol>" + "".join(f"<li><p>{say(1, 20)}</p></li>" for _ in range(draw.randint(2, 5))) + "</ol>",
            f"<blockquote><p>{say(5, 30)}</p></blockquote>", f"<pre>{say(3, 20)}</pre><div>{say(3, 30)}</div>",
            "<table>" + "".join(f"<tr><th>{say(1, 3)}</th><td>{say(1, 5)}</td></tr>" for _ in range(3)) + "</table>",
            f"<figure><figcaption>{say(4, 12)}</figcaption></figure><section><h3>{say(2, 5)}</h3><p>{say(9, 40)}</p></section>",
        ][kind - 8]

    def filler() -> str:
        return [
            lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(draw.randint(2, 7))) + "</ul>",
            lambda: f"<p>{say(3, 40)}</p>", lambda: say(3, 30), lambda: f"<h{draw.randint(2, 4)}>{say(1, 4)}</h3><p>{say(3, 30)}</p>",
            lambda: f"<ol><li><p>{say(3, 30)}</p></li><li><div><p>{say(3, 30)}</p></div></li></ol>",
            lambda: f"<h1>{say(1, 4)}</h1>{link()}", lambda: f"<label>{say(1, 2)}</label><button>{say(1, 2)}</button>", lambda: f"<div>{link()} {link()}</div><div><p>{say(2, 20)}</p></div>",
        ][draw.randrange(8)]()

    unknown = lambda: "".join(draw.choice("bcdfgklmnprstvz") + draw.choice("aeiou") for _ in range(draw.randint(2, 4)))
    loose = lambda blocks: "".join(f"<p y=1>{say(8, 60)}</p>" if draw.random() < 0.6 else f"<div y=1>{b}</div>" for b in blocks)

    def outside(kind: int | None = None) -> str:
        kind = draw.randrange(5) if kind is None else kind
        if draw.random() < BARE:  # lists of links, whatever they lie in
            links = "".join(f"<li>{link()}</li>" for _ in range(draw.randint(2, 7)))
            return draw.choice([f"<ul y=0>{links}</ul>", f"<div y=0><ul>{links}</ul></div>", f"<div y=0 class={unknown()}><ul>{links}</ul></div>"])
        if kind == 0:
            tag = draw.choice(OUTSIDE_TAGS)
            return f"<{tag} y=0>{filler()}{filler()}</{tag}>"
        if kind == 1:
            return f"<div y=0 role={draw.choice(ROLES)}>{filler()}</div>"
        tag, mark = draw.choice(["div", "div", "section", "aside", "ul", "p"]), draw.choice(OUTSIDE_MARKS)
        inner = say(3, 30) if tag == "p" else filler()
        if tag == "ul":
            inner = "".join(f"<li class={mark}>{say(1, 20)}</li>" for _ in range(3))
        return f"<{tag} y=0 {draw.choice(['class', 'id'])}='{mark}{draw.choice(['', '-box', ' box'])}'>{inner}</{tag}>"

    def main() -> str:
        blocks = [prose() for _ in range(draw.randint(1, 9))]
        for _ in range(draw.choice([0, 0, 1, 2])):
            blocks.insert(draw.randint(1, len(blocks)), outside())
        body = draw.choice(["", f"<h1>{say(2, 9)}</h1>", f"<h1>{say(2, 9)}</h1>"]) + "".join(blocks)
        tag = draw.choice(["article", "article", "main", "div", "section"])
        if draw.random() < BARE:  # nothing tells what the article lies in, or a word that means nothing
            tag = draw.choice(["div", "div", "section", "td"])
            return draw.choice([f"<{tag} y=1>{body}</{tag}>", f"<{tag} y=1 class={unknown()}>{body}</{tag}>", loose(blocks)])
        if tag in ("article", "main") and draw.random() < 0.6:
            return f"<{tag} y=1>{body}</{tag}>"
        return f"<{tag} y=1 {draw.choice(['class', 'id'])}='{draw.choice(INSIDE_MARKS)}{draw.choice(['', '-body', ' wide'])}'>{body}</{tag}>"

    pages = []
    for i in range(count):
        if i % 12 == 0:
            pages.append(draw.choice(["<html><body>{}</body></html>", "{}", "<div>{}</div>"]).format("".join(prose() for _ in range(i % 5 + 1))))
            continue
        parts = [outside(0 if draw.random() < 0.5 else None) for _ in range(draw.randint(1, 3))] + [main()]
        parts += [outside() for _ in range(draw.randint(1, 3))]
        shell = draw.choice(["{}", "{}", "<div>{}</div>", "<div class='wrapper container'>{}</div>"])
        pages.append("<html><head><meta charset=utf-8></head><body>" + shell.format("".join(parts)) + "</body></html>")
    return pages


@lru_cache(1)
def trained() -> Model:
    """The model, once per worker process."""
    return Model(training_pages())


def main_text(page: str | None) -> str:
    """Text of the content blocks of a page: references decoded, white space as one blank, one line per block."""
    if not page:
        return ""
    tree = parse(page)
    likely = trained().marginals(tree)
    return "\n".join(t for t, p in zip(tree.text, likely) if t and p > LIKELY)


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` of every row of ``pages`` (``page_id, url, html``).

    A null or empty html, and a page without content, give an empty text. Broken markup is read as far as it goes.
    Rows are never merged: equal ids or pages give one row each. Other columns are not read. An empty table gives no
    rows. Nothing is shuffled, and pages are read whole.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])
    kind = dict(pages.dtypes)["page_id"]

    def run(batches: Batches) -> Batches:
        for rows in batches:
            yield batch(schema, [rows.column(0), rows.column(1), [main_text(t) for t in texts(rows.column(2))]])

    found = map_batches(pages.selectExpr("CAST(page_id AS bigint) AS page_id", "url", "html"), run, "page_id bigint, url string, text string")
    return found.withColumn("page_id", F.col("page_id").cast(kind))
