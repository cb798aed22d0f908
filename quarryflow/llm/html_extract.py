"""Operator 7: main text of web pages by tree scoring.

A forgiving parser builds the tree of block elements; inline tags leave no node, only the length of link text. Every
paragraph passes points for its length and its commas to its container, and every element half of its points to the one
around it; a container's points are discounted by its link density. The best container (the first in page order among
equals) and those of its siblings that look like text are kept.

Elements that never show main text go by their tag, their role or a hidden attribute, wherever they stand. Class and id
names only raise doubt: an element with a name like `comments` or `cookie-notice` goes unless it holds most of the page's
points and no paragraph outside such elements (but for those around it) is long; one with a mere mention, as in
`has-sidebar`, goes only if it does not hold most of the points. Forms, field sets and a `nav` that is never closed are
doubted like names, since some pages stand in one as a whole, and stay only with a long paragraph in them. A page is read
and scored in time proportional to its length.

Defined results: null or empty html and pages without text give the empty string; broken markup (unclosed tags,
comments, quotes) is read as far as it makes sense; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_limits, map_rows

TOKEN = re.compile(r"""<!--|<!\[CDATA\[|<[!?][^>]*>?|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>""", re.S)
COMMENT_END = re.compile("--!?>")
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
#: Fixed values of HTML: elements whose content is not markup, that hold nothing, that never show main text, that stand in a line.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
NEVER = {"footer", "aside", "head", "menu", "dialog", "button", "select", "object", "canvas", "svg", "math", "audio", "video", "datalist"} | RAW
#: Elements that hold a whole page at times.
DOUBTED = {"form", "fieldset", "nav"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
PARAGRAPHS = {"p", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "dt", "dd", "blockquote", "figcaption", "caption"}
#: Opening the key closes an open element of the value's kinds, up to the nearest list, table or container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "div", "article", "section", "main", "body"}
#: Words of names: of what is not main text, what such names may also hold, and what names of main text hold.
UNLIKELY = re.compile(r"ads?|advert\w*|adbox|banners?|sponsor\w*|promo\w*|sidebars?|side|menus?|nav\w*|breadcrumbs?|foot(?:er)?|header|masthead|cookies?|notices?|consent|gdpr|pop-?up|modal|newsletter|subscribe|shar(?:e|ing)|social|comments?|disqus|respond|responses?|repl(?:y|ies)|related|recommend\w*|widgets?|login|signup|search|pag(?:er|ination)|toolbar|hidden")
NEUTRAL = re.compile(r"\d+|site|page|top|bottom|left|right|global|block|box|bar|list|lists|section|wrapper|wrap|container|area|panel|slot|unit|inner|outer|reader|readers|user|users|form|links?|items?|buttons?|posts|articles|stories|region|group|row|col|thread|bottom|sticky|fixed|up|down|main|primary|secondary|js|id|the")
LIKELY = re.compile(r"article|body|content|entry|main|post|story|text")
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "form"}
#: A paragraph of so many characters, mostly not links, looks like an article's.
LONG = 80


class Node:
    """An element. gone: it never shows main text. doubt: 2 for the name of something else, 1 for a mention of it."""

    __slots__ = ("tag", "parent", "gone", "doubt", "hint", "chars", "link", "points", "score", "dropped", "closed", "long")

    def __init__(self, tag: str, parent: Node | None, gone: bool, doubt: int, hint: int):
        self.tag, self.parent, self.gone, self.doubt, self.hint = tag, parent, gone, doubt, hint
        self.chars = self.link = 0
        self.points = self.score = 0.0
        self.dropped = self.closed = self.long = False  # long: it holds a long paragraph

    def density(self) -> float:
        return self.link / self.chars if self.chars else 0.0

    def total(self) -> float:
        return (self.score + self.hint + 25 * (self.tag in ("article", "main"))) * (1 - self.density())


def name_doubt(names: str) -> int:
    """2 if a name consists of words for what is not main text, and no other name speaks of main text; 1 if a name has
    such a word at all."""
    doubt, likely = 0, False
    for name in names.lower().split():
        parts = re.split("[-_]+", name.replace("side-bar", "sidebar").replace("log-in", "login").replace("sign-up", "signup"))
        bad = [bool(UNLIKELY.fullmatch(x)) for x in parts]
        if any(bad):
            doubt = max(doubt, 2 if all(b or not x or NEUTRAL.fullmatch(x) for b, x in zip(bad, parts)) else 1)
        else:
            likely |= bool(LIKELY.search(name))
    return min(doubt, 1) if likely else doubt


def _kind(tag: str, attrs: str, inside: bool) -> tuple[bool, int, int]:
    """Whether an element never shows main text, the doubt and the hint from its names. inside: it stands in an article."""
    if tag in NEVER or tag == "header" and not inside:
        return True, 0, 0
    if tag in DOUBTED and not attrs:
        return False, 2, 0
    if not attrs or tag in ("html", "body"):
        return False, 0, 0
    found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attrs)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or found.get("role", "").lower() in ROLES:
        return True, 0, 0
    names = f"{found.get('class', '')} {found.get('id', '')}"
    doubt = 0 if tag in ("article", "main") else 2 if tag in DOUBTED else name_doubt(names)
    return False, doubt, 0 if doubt else 25 * bool(LIKELY.search(names.lower()))


class _Hidden:
    """Inline elements that are hidden, with those open inside them."""

    def __init__(self):
        self.tags, self.count = [], Counter()

    def push(self, tag: str) -> None:
        self.tags.append(tag)
        self.count[tag] += 1

    def close(self, tag: str) -> None:
        """Closes the innermost element of this tag, with all in it."""
        while self.count[tag]:
            last = self.tags.pop()
            self.count[last] -= 1
            if last == tag:
                break

    def clear(self) -> None:
        if self.tags:
            self.tags.clear()
            self.count.clear()


class _Open:
    """The open elements, and where each tag and each holder of lists or tables stands among them."""

    def __init__(self, root: Node):
        self.nodes, self.at, self.holders, self.articles = [root], defaultdict(list), [], 0

    def push(self, node: Node) -> None:
        self.at[node.tag].append(len(self.nodes))
        if node.tag in HOLDS:
            self.holders.append(len(self.nodes))
        self.articles += node.tag in ("article", "main")
        self.nodes.append(node)

    def cut(self, at: int) -> None:
        """Closes the elements from place `at` on; the root stays."""
        while len(self.nodes) > max(at, 1):
            node = self.nodes.pop()
            self.at[node.tag].pop()
            if node.tag in HOLDS:
                self.holders.pop()
            self.articles -= node.tag in ("article", "main")

    def close(self, tag: str) -> bool:
        if not self.at[tag]:
            return False
        self.nodes[self.at[tag][-1]].closed = True
        self.cut(self.at[tag][-1])
        return True

    def close_kinds(self, kinds: set[str]) -> None:
        """Closes the outermost element of these kinds within the nearest holder, with all in it."""
        holder = self.holders[-1] if self.holders else 0
        found = [at[k] for x in kinds if (at := self.at[x]) and (k := bisect_right(at, holder)) < len(at)]
        if found:
            self.cut(min(found))


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """The elements, each after the one around it, and in page order the text of each stretch without a block boundary:
    its element, text, characters of links."""
    nodes = [Node("html", None, False, 0, 0)]
    open_, at, link, words, linked = _Open(nodes[0]), 0, 0, [], 0
    runs: list[tuple[Node, str, int]] = []
    hidden = _Hidden()
    last, no_cdata = page.rfind(">") + 1, False

    def text(piece: str) -> None:
        nonlocal linked
        if piece and not open_.nodes[-1].gone and not hidden.tags:
            words.append(entities.unescape(piece) if "&" in piece else piece)
            if link:
                linked += len("".join(words[-1].split()))

    def flush() -> None:
        nonlocal linked
        if words:
            if whole := " ".join("".join(words).split()):
                runs.append((open_.nodes[-1], whole, linked))
            words.clear()
        linked = 0

    while m := TOKEN.search(page, at, last):  # what follows the last ">" has no tags
        text(page[at : m.start()])
        at, tag = m.end(), (m["tag"] or "").lower()
        if m[0] == "<!--":
            end = COMMENT_END.search(page, at)
            at = end.end() if end else page.startswith(">", at) and at + 1 or len(page)
        elif m[0] == "<![CDATA[":
            end = -1 if no_cdata else page.find("]]>", at)
            no_cdata = end < 0
            if no_cdata:
                at = page.index(">", at) + 1 if page.find(">", at) >= 0 else len(page)
            else:
                text(page[at:end])
                at = end + 3
        elif not tag:
            continue
        elif m["close"]:
            if tag in INLINE:
                link = max(0, link - (tag == "a"))
                hidden.close(tag)
            elif open_.at[tag]:
                flush()
                open_.close(tag)
                link = 0
                hidden.clear()
        elif tag in INLINE:
            link += tag == "a"
            if hidden.tags or m["attrs"] and ((kind := _kind(tag, m["attrs"], True))[0] or kind[1] > 1):
                hidden.push(tag)
        elif tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                text(" ")
        elif tag == "html" and len(open_.nodes) == 1:
            continue
        else:
            flush()
            link = 0
            hidden.clear()
            if tag not in RAW:
                if tag in CLOSES:
                    open_.close_kinds(CLOSES[tag])
                while open_.nodes[-1].tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                    open_.cut(len(open_.nodes) - 1)
                if tag == "body" and open_.nodes[-1].tag == "head":
                    open_.close("head")
            here = open_.nodes[-1]
            gone, doubt, hint = _kind(tag, m["attrs"], open_.articles > 0)
            nodes.append(Node(tag, here, here.gone or gone, doubt, hint))
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\s*>?", re.I).search(page, at)
                at = end.end() if end else len(page)
            else:
                open_.push(nodes[-1])
        if at >= len(page):
            break
    text(page[at:])
    flush()
    return nodes, runs


def _doubts(nodes: list[Node], runs: list[tuple[Node, str, int]], points: list[float]) -> None:
    """Marks the elements that are doubted and whose share of the points does not lift the doubt, and all in them."""
    nearest: dict[int, Node | None] = {}  # the nearest doubted element around what stands in an element
    for x in nodes:
        nearest[id(x)] = x if x.doubt else nearest[id(x.parent)] if x.parent is not None else None
    plain = set()  # doubted elements (and None for the page) with a long paragraph that no doubted element in them holds
    for (node, run, linked), p in zip(runs, points):
        node.points += p
        if len(run) >= LONG and 2 * linked < len(run):
            node.long = True
            around = nearest[id(node)]
            plain.add(None if around is None else id(around))
    for x in reversed(nodes):
        if x.parent is not None:
            x.parent.points += x.points
            x.parent.long |= x.long
    other: dict[int, bool] = {}  # whether there is such a paragraph outside an element, in the page or a doubted one around
    for x in nodes:
        up = x.parent
        other[id(x)] = None in plain if up is None else other[id(up)] or bool(up.doubt) and id(up) in plain
        lifted = 2 * x.points > nodes[0].points and (x.doubt == 1 or not other[id(x)])
        if x.tag in DOUBTED:
            lifted = lifted and x.long and not (x.tag == "nav" and x.closed)
        x.dropped = up is not None and up.dropped or x.doubt > 0 and not lifted


def run_points(runs: list[tuple[Node, str, int]]) -> list[float]:
    """Points of each stretch of text, for length and commas, discounted by its own link density."""
    return [(1 + run.count(",") + run.count("，") + run.count("、") + len(run) / 100) * (1 - min(1.0, linked / len(run))) for _, run, linked in runs]


def score(nodes: list[Node], runs: list[tuple[Node, str, int]], points: list[float]) -> set[int]:
    """Fills in the elements' characters, link characters and scores, from the leaves up; returns those with points."""
    holders = set()
    for (node, run, linked), p in zip(runs, points):
        node.chars, node.link = node.chars + len(run), node.link + min(len(run), linked)
        to = (node.parent or node) if node.tag in PARAGRAPHS else node
        to.score += p
        holders.add(id(to))
    for x in reversed(nodes):
        if x.parent is not None:
            x.parent.chars, x.parent.link, x.parent.score = x.parent.chars + x.chars, x.parent.link + x.link, x.parent.score + x.score / 2
            if id(x) in holders:
                holders.add(id(x.parent))
    return holders


def main_text(page: str | None) -> str:
    """Blocks of the main text in page order, one line each."""
    if not page:
        return ""
    nodes, runs = parse(page)
    points = run_points(runs)
    _doubts(nodes, runs, points)
    kept_runs = [(run, p) for run, p in zip(runs, points) if not run[0].dropped]
    if not kept_runs:
        return ""
    holders = score(nodes, *zip(*kept_runs))
    best = max((x for x in nodes if id(x) in holders), key=Node.total)
    up = best
    while up is not None:  # an article is kept whole
        if up.tag in ("article", "main"):
            best = up
            break
        up = up.parent
    kept, siblings = {id(best)}, [x for x in nodes if x.parent is best.parent and not x.gone and not x.dropped]
    if best.parent is not None and best.tag not in ("article", "main", "body"):
        for x in siblings:
            bare = x.chars > LONG and x.density() < 0.25 or x.chars > 0 and not x.link and x.tag in PARAGRAPHS
            worthy = x.total() >= 0.2 * best.total() and (x.total() >= 10 or x.long and x.density() < 0.25)
            if worthy or x.tag in PARAGRAPHS and bare:
                kept.add(id(x))
    elif best.tag == "article" and best.parent is not None:
        kept |= {id(x) for x in siblings if x.tag == "article" and x.total() >= 0.2 * best.total()}
    within, menu = {}, {}
    for x in nodes:
        above = x.parent is not None and within[id(x.parent)]
        within[id(x)] = id(x) in kept or above
        menu[id(x)] = id(x) not in kept and above and (menu[id(x.parent)] or x.tag in ("ul", "ol", "table") and x.density() > 0.7)
    return "\n".join(run for (node, run, _), _ in kept_runs if within[id(node)] and not menu[id(node)])


def extract(df: DataFrame, id_cols: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """The id columns, text, n_chars (code points) of every row."""
    arrow_limits(df.sparkSession)
    names = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    ids = [(f.name, f.dataType.simpleString()) for f in df.select(*id_cols).schema]

    def run(c: dict[str, list]) -> dict[str, list]:
        text = [main_text(x) for x in c["__html"]]
        return {n: c[n] for n, _ in ids} | {"text": text, "n_chars": [len(x) for x in text]}

    schema = pa.schema([*((n, names[k]) for n, k in ids), ("text", pa.string()), ("n_chars", pa.int64())])
    return map_rows(df.select(*id_cols, df[html_col].alias("__html")), run, ", ".join(f"`{n}` {k}" for n, k in ids) + ", text string, n_chars long", schema)
