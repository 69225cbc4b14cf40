"""HTML extraction: a tree-structured graphical model over the DOM's blocks.

Each block element is a node with a hidden label, content or not.  Potentials: a node's features given its
label, and a node's label given its parent's.  Both are counts from labelled pages, smoothed.  Messages pass
upward from the leaves and downward from the root (sum-product, exact on a tree), which gives each node's
content marginal; the text of nodes with a marginal of a half or more is the main text.

Labelled pages: the bundled ones (several layouts, written for this purpose and marked block by block), and those
pages of the input that mark their article themselves (article or main elements), up to a documented bound.

Defined results: a null or empty page, or one without content nodes, gives an empty text; broken markup is read
as browsers commonly do (unknown end tags are ignored, open elements end with their parent); equal rows give
equal texts; texts are never cut.  An article's own header (its title, by-line and the like) is part of it; a
page's header is not.  Text that stands in a block beside inner blocks shares that block's label.  An empty table gives
no rows; columns other than page_id, url and html are not read.  Reading takes time in proportion to a page's length:
open elements are found by kind, not by a walk over them (an attribute value whose quotes pair up across tags is read
again by each of those tags).
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# -- the DOM --------------------------------------------------------------------------------------

#: HTML's element kinds.
BLOCKS = frozenset("""html body div section article main aside nav header footer p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd menu table
thead tbody tfoot tr td th caption blockquote pre figure figcaption form fieldset legend address details summary dialog
center hgroup search button select option label noscript object video audio title head""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noframes noembed iframe xmp template svg".split())
CLOSES_P = BLOCKS - frozenset("html body td th tr thead tbody tfoot caption option button label noscript object video audio head title".split())
#: A start tag ends an open element of one of these kinds, unless the scope stands between.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
           "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
           "option": ({"option"}, {"select"}), "body": ({"head"}, set())}

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<""", re.S)
_PLAIN = re.compile(r"<!--.*|<|[^<]+", re.S)  # where no tag ends any more
_DECLARATION = re.compile(r"<![^>]*>")  # where no CDATA section ends any more
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:$|[\s=/])|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)

#: Words in class, id and role that speak for one side.
AWAY = re.compile(r"""(?:^|[^a-z])(nav\w*|menu\w*|head(?:er|bar)|foot(?:er|bar)?|side(?:bar)?|aside|ads?|advert\w*|sponsor\w*|promo\w*"""
                  r"""|banner\w*|cookies?|consent|notice\w*|alert|popup|modal|comment\w*|disqus|repl(?:y|ies)|respond|forms?|login|signup"""
                  r"""|subscribe|newsletter|share|social|related|recommend\w*|breadcrumbs?|pagination|pager|widget\w*|toolbar|tags?|meta"""
                  r"""|copyright|legal|search\w*|skip\w*|complementary|contentinfo|navigation)(?![a-z])""")
HERE = re.compile(r"""(?:^|[^a-z])(article\w*|content|main|post(?:body|content)?|entry|story\w*|body(?:text)?|text|prose)(?![a-z])""")


class Node:
    __slots__ = ("tag", "parent", "names", "hidden", "runs", "size", "links", "marks")

    def __init__(self, tag: str, parent: int, names: str, hidden: bool):
        self.tag, self.parent, self.names, self.hidden = tag, parent, names, hidden
        self.runs: list[tuple[int, list[str]]] = []  # (place in the page, text pieces)
        self.size = self.links = self.marks = 0  # code points of its own text, those within links, punctuation marks


_ENDED = re.compile(r"""(?:^|[\s"'])/$""")  # a slash that isn't the end of an unquoted value
_MARKS = re.compile(r"[.,;:!?\u2026\u3001\u3002](?=\s|\Z)")


def parse(page: str) -> list[Node]:
    """Block elements in page order (parents first); inline elements' text belongs to their block."""
    nodes = [Node("#root", -1, "", False)]
    stack: list[tuple[str, int]] = [("#root", 0)]  # open elements, and their block
    depths: dict[str, list[int]] = {}  # of each kind, the places in the stack of its open elements
    at, place, fresh_run, links = 0, 0, True, 0
    last_end = page.rfind(">")  # nothing after it is a tag
    last_section_end = page.rfind("]]>")

    def deepest(kinds) -> int:
        return max((depths[kind][-1] for kind in kinds if depths.get(kind)), default=0)

    def close(k: int) -> bool:
        """Close the elements from place ``k`` on; whether one of them is a block."""
        nonlocal links
        block = False
        while len(stack) > k:
            kind, _ = stack.pop()
            depths[kind].pop()
            links -= kind == "a"
            block = block or kind in BLOCKS
        return block

    while at < len(page):
        plain = _PLAIN if at > last_end else _DECLARATION if at > last_section_end and page.startswith("<![CDATA[", at) else None
        m = (plain or _TOKEN).match(page, at)
        at = m.end()
        tag = "" if plain else (m[2] or m[5] or "").lower()
        if not tag:
            piece = m[0]
            if piece.startswith("<") and len(piece) > 1:
                continue
            own = nodes[stack[-1][1]]
            text = html.unescape(piece)
            if fresh_run:
                if not text.strip():
                    continue
                own.runs.append((place, []))
                place, fresh_run = place + 1, False
            own.runs[-1][1].append(text)
            n = len(text.strip())
            own.size += n
            own.marks += len(_MARKS.findall(text))
            own.links += n if links else 0
            continue
        attributes = m[3] or m[6] or ""
        if m[1] or m[4]:
            if k := deepest((tag,)):
                fresh_run = close(k) or fresh_run
            continue
        ends, scope = IMPLIED.get(tag, ((), ()))
        if tag in CLOSES_P:
            ends, scope = {*ends, "p"}, {*scope, "td", "th", "button", "div", "article", "section", "blockquote", "li"} - {tag if tag in ends else ""}
        k = deepest(ends)
        if k and k >= deepest(scope):
            close(k)
            fresh_run = True
        ended = bool(_ENDED.search(attributes))
        if tag in RAW and not ended:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at)
            at = end.end()  # scripts, styles, titles and embedded documents have no main text
            continue
        if tag in VOID or (ended and tag not in BLOCKS):
            if tag in ("br", "hr", "img"):
                if tag == "hr":
                    fresh_run = True
                elif not fresh_run and nodes[stack[-1][1]].runs:
                    nodes[stack[-1][1]].runs[-1][1].append(" " if tag == "br" else "")
            continue
        block = stack[-1][1]
        if tag in BLOCKS:
            names = " ".join(x.strip("\"'") for x in _NAMES.findall(attributes)).lower()
            nodes.append(Node(tag, block, names, bool(_HIDDEN.search(attributes))))
            block, fresh_run = len(nodes) - 1, True
        elif tag == "a":
            links += 1
        depths.setdefault(tag, []).append(len(stack))
        stack.append((tag, block))
    return nodes


def features(nodes: list[Node]) -> list[tuple[str, ...]]:
    """Of each node: its kind and whether text stands in it directly, names, share of linked text and length below it,
    punctuation of its own text, and length of the siblings beside it."""
    size, links = [n.size for n in nodes], [n.links for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        size[nodes[i].parent] += size[i]
        links[nodes[i].parent] += links[i]
    length = [0 if not x else 1 if x < 40 else 2 if x < 160 else 3 for x in size]
    near = [0] * len(nodes)
    last: dict[int, int] = {}  # of each parent, the child before
    for i, n in enumerate(nodes):
        if (before := last.get(n.parent)) is not None:
            near[i], near[before] = length[before], max(near[before], length[i])
        last[n.parent] = i
    out = []
    for i, n in enumerate(nodes):
        away, here = AWAY.search(n.names), HERE.search(n.names)
        name = "hidden" if n.hidden else "away" if away else "here" if here else "none"
        share = 0 if not links[i] else 1 if 2 * links[i] < size[i] else 2
        own = 0 if not n.size else 1 if n.size < 160 else 2
        marks = "none" if not own else min(n.marks, 2)
        out.append((f"tag={n.tag},{own}", f"names={name}", f"links={share}", f"length={length[i]}", f"marks={marks}", f"near={near[i]}"))
    return out


def edge_kind(nodes: list[Node], i: int) -> str:
    """What the potential between a node and its parent may depend on: whether the parent is the page, and the node's sort."""
    above, tag = nodes[nodes[i].parent].tag, nodes[i].tag
    sort = "article" if tag in ("article", "main") else "part" if tag in ("div", "section") else "other"
    return ("page-" if above in ("#root", "html", "body") else "inner-") + sort


EDGES = tuple(a + b for a in ("page-", "inner-") for b in ("article", "part", "other"))


def blocks(nodes: list[Node], keep: list[bool]) -> str:
    runs = sorted((place, " ".join("".join(pieces).split())) for n, k in zip(nodes, keep) if k for place, pieces in n.runs)
    return "\n".join(t for _, t in runs if t)


# -- the model ------------------------------------------------------------------------------------

@dataclass
class TreeModel:
    """Counts of (feature, label), labels, and (edge kind, parent's label, label); ``prepare`` makes the log potentials."""

    emit: Counter = field(default_factory=Counter)
    label: Counter = field(default_factory=Counter)
    edge: Counter = field(default_factory=Counter)
    smooth: float = 0.01
    kinds: int = 60

    def learn(self, nodes: list[Node], labels: list[bool], weight: int = 1) -> None:
        for i, (n, fs, y) in enumerate(zip(nodes, features(nodes), labels)):
            self.label[y] += weight
            for f in fs:
                self.emit[f, y] += weight
            if n.parent >= 0:
                self.edge[edge_kind(nodes, i), labels[n.parent], y] += weight

    def prepare(self) -> "TreeModel":
        s = self.smooth
        names = {f for f, _ in self.emit}
        self.log_emit = {f: tuple(math.log((self.emit[f, y] + s) / (self.label[y] + s * self.kinds)) for y in (False, True)) for f in names}
        self.log_edge = {k: [[math.log((self.edge[k, a, b] + s) / (self.edge[k, a, False] + self.edge[k, a, True] + 2 * s))
                              for b in (False, True)] for a in (False, True)] for k in EDGES}
        return self

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(content) of each node, by one pass up and one down."""
        def both(x, y):
            m = max(x, y)
            return m + math.log(math.exp(x - m) + math.exp(y - m))

        unary = []
        for fs in features(nodes):
            e = [self.log_emit[f] for f in fs if f in self.log_emit]
            unary.append([sum(x[0] for x in e), sum(x[1] for x in e)])
        up = [u[:] for u in unary]
        edges = [None, *[self.log_edge[edge_kind(nodes, i)] for i in range(1, len(nodes))]]
        message = [[0.0, 0.0] for _ in nodes]
        for i in range(len(nodes) - 1, 0, -1):
            for a in (0, 1):
                message[i][a] = both(edges[i][a][0] + up[i][0], edges[i][a][1] + up[i][1])
            p = nodes[i].parent
            up[p][0] += message[i][0]
            up[p][1] += message[i][1]
        belief = [up[0][0], -1e9]  # the root holds the page, it isn't content
        beliefs = [belief]
        for i in range(1, len(nodes)):
            outer = [beliefs[nodes[i].parent][a] - message[i][a] for a in (0, 1)]
            beliefs.append([up[i][b] + both(outer[0] + edges[i][0][b], outer[1] + edges[i][1][b]) for b in (0, 1)])
            top = max(beliefs[i])
            beliefs[i] = [x - top for x in beliefs[i]]
        return [1 / (1 + math.exp(min(700, b[0] - b[1]))) for b in beliefs]

    def extract(self, page: str | None) -> str:
        if not page:
            return ""
        nodes = parse(page)
        return blocks(nodes, [p >= 0.5 for p in self.marginals(nodes)])


# -- labelled pages -------------------------------------------------------------------------------

NOT_CONTENT = frozenset("nav header footer aside form menu button select option label noscript dialog search head title".split())


def marked_labels(nodes: list[Node]) -> list[bool] | None:
    """Labels of a page that marks its article itself: what article or main holds, but for what is named otherwise."""
    inside, out = [], []
    for n in nodes:
        above = inside[n.parent] if n.parent >= 0 else None
        now = False if above is False else True if n.tag in ("article", "main") else above
        if now and (n.tag in NOT_CONTENT or n.hidden or AWAY.search(n.names)):
            now = False
        inside.append(now)
        out.append(bool(now))
    return out if any(out) else None


def bundled_pages() -> list[tuple[list[Node], list[bool]]]:
    """Pages in several layouts; elements with a ``y`` class token hold content, others don't."""
    long, short = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor. " * 4, "Lorem ipsum dolor."
    mid, plain = long[:82], "Lorem ipsum"
    links = "".join(f"<li><a href='/{i}'>Link {i}</a></li>" for i in range(5))
    inline = " | ".join(f"<a href='/{i}'>Link {i}</a>" for i in range(5))
    paras = f"<p class='y'>{long}</p><h2 class='y'>{short}</h2><p class='y'>{mid}</p><p class='y'>{short}</p><p class='y'>{plain}</p><dl class='y'><dt class='y'>{plain}</dt>" \
            f"<dd class='y'>{mid}</dd></dl><p class='y'>{mid}</p><p class='y'>{long}</p><p class='y'>{plain}</p><ul class='y'><li class='y'>{plain}</li><li class='y'>{short}</li>" \
            f"<li class='y'>{long}</li></ul><blockquote class='y'>{long}</blockquote><table class='y'><tr class='y'><td class='y'>{short}</td><td class='y'>{plain}</td>" \
            f"</tr></table><pre class='y'>{short}</pre><figure class='y'><figcaption class='y'>{short}</figcaption></figure>"
    comments = f"<section class='comments'><h3>Comments</h3><div class='comment'><p>{long}</p></div><div class='comment'><p>{short}</p></div>" \
               f"<div class='comment'><p>{mid}</p></div></section>"
    notice, advert = f"<div class='cookie-notice'><p>{mid}</p><button>OK</button></div>", f"<div class='ad'>{short}</div>"
    promo = f"<div class='advert'><p>{long}</p></div>"
    form = f"<form><label>Mail</label><p>Sign up for news</p><p>{short}</p><select><option>a</option></select><button>Go</button></form>"
    head = f"<header><div class='logo'>Site</div><nav><ul>{links}</ul></nav></header>"
    foot = f"<footer><p>&copy; Site</p><ul>{links}</ul></footer>"
    side = f"<aside><h3>More</h3><ul>{links}</ul><p>{long}</p></aside>"
    share, related = f"<div class='share'>{short}</div>", f"<div class='related'><h3>Related</h3><ul>{links}</ul></div>"
    layouts = [
        f"{notice}{head}<main class='y'><article class='y'><h1 class='y'>{short}</h1>{paras}{advert}{paras}{share}</article></main>{comments}{side}{foot}",
        f"{head}<article class='y'><h1 class='y'>{short}</h1>{promo}{paras}{comments}{form}</article>{foot}",
        f"<div class='nav'><ul>{links}</ul></div><div class='y content'><h1 class='y'>{short}</h1>{paras}{advert}</div>"
        f"<div class='sidebar'><p>{long}</p></div><div class='footer'><p>{short}</p></div>",
        f"<nav><ul>{links}</ul></nav>{advert}<article class='y'><h1 class='y'>{short}</h1>{paras}{related}</article><footer>{short}</footer>",
        f"{head}<div class='wrapper'><div class='y post'><h1 class='y'>{short}</h1><div class='y entry'>{paras}</div></div>{side}{comments}</div>{notice}{foot}",
        f"<menu>{links}</menu><div><section class='y story'><h2 class='y'>{short}</h2>{paras}{form}</section></div>{related}{promo}<noscript><p>{short}</p></noscript>{foot}",
        f"<h1 class='y'>{short}</h1>{paras}<div class='footer'>{short}</div>",
        f"<div class='y'><h1 class='y'>{short}</h1>{paras}</div><div class='links'><ul>{links}</ul></div>{foot}",
        f"{head}<main class='y'><h1 class='y'>{short}</h1><div class='y'>{paras}</div><aside><p>{short}</p></aside><nav><ul>{links}</ul></nav>{form}</main>{foot}",
        # nested blocks without telling names, which hold their text directly
        f"<div><div>{inline}</div><div><div class='y'>{long}</div><div class='y'>{short}</div><div class='y'>{long}<br><br>{long}</div></div>"
        f"<div><p>{short}</p>{inline}</div></div>",
        f"<div><ul>{links}</ul></div><div><div><div class='y'>{long}</div></div></div><div>&copy; Site</div>",
        f"<div>{inline}</div><div><div><h1 class='y'>{short}</h1><div class='y'>{short}</div><div class='y'>{long}</div>{promo}</div></div>{foot}",
        # tables as layout
        f"<table><tr><td>{inline}</td></tr><tr><td><ul>{links}</ul></td><td class='y'><h1 class='y'>{short}</h1>{paras}</td></tr>"
        f"<tr><td>&copy; Site</td></tr></table>",
        f"<table><tr><td>{inline}</td><td class='y'>{long}<br><br>{long}</td><td>{inline}<br>{inline}</td></tr></table>",
        f"<center><table><tr><td>{inline}</td></tr><tr><td class='y'>{long}<p class='y'>{long}</td></tr></table></center>{foot}",
    ]
    direct = [  # text directly in the body
        f"{long}<br><br>{long}",
        f"{head}{long}<br>{short}<p class='y'>{long}{foot}",
        f"<div>{inline}</div><h1 class='y'>{short}</h1>{long}<hr>{long}<div>{inline}</div>",
        f"{long}<ul class='y'><li class='y'>{short}</li></ul>{long}{advert}{comments}",
    ]
    out = []
    for start, body in [*[("<body>", x) for x in layouts], *[("<body class='y'>", x) for x in direct]]:
        nodes = parse(f"<html><head><title>t</title></head>{start}{body}</body></html>")
        labels = []
        for n in nodes:
            tokens = n.names.split()
            labels.append("y" in tokens)
            n.names = " ".join(t for t in tokens if t != "y")
        out.append((nodes, labels))
    return out


# -- Spark ----------------------------------------------------------------------------------------

@dataclass(frozen=True)
class HtmlConfig:
    labelled_pages: int = 2000  # at most so many pages of the input are labelled by their own markup
    bundled_weight: int = 200


def train(pages: DataFrame, config: HtmlConfig = HtmlConfig()) -> TreeModel:
    """The model from the bundled pages and a bounded draw of ``pages`` (html) that mark their article."""
    model = TreeModel()
    for nodes, labels in bundled_pages():
        model.learn(nodes, labels, config.bundled_weight)

    def count(batches):
        local = TreeModel()
        for b in batches:
            for page in b.column("html").to_pylist():
                nodes = parse(page)
                if (labels := marked_labels(nodes)) is not None:
                    local.learn(nodes, labels)
        rows = [("e", f, int(y), 0, n) for (f, y), n in local.emit.items()] + [("l", "", int(y), 0, n) for y, n in local.label.items()] \
            + [("t", k, int(a), int(b), n) for (k, a, b), n in local.edge.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(
            (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["kind", "feature", "a", "b", "n"])

    marked = pages.select("html").where(F.lower("html").rlike("<(article|main)[ />]")).withColumn("draw", F.xxhash64("html"))
    # the smallest hashes are found without their pages, then only the drawn pages move, one of equal ones
    last = marked.select("draw").distinct().orderBy("draw").limit(config.labelled_pages).agg(F.max("draw")).first()[0]
    draw = marked.where(F.lit(False) if last is None else F.col("draw") <= last).dropDuplicates(["draw"]).select("html")
    sums = draw.mapInArrow(count, "kind string, feature string, a long, b long, n long").groupBy("kind", "feature", "a", "b").agg(
        F.sum("n").alias("n")).collect()  # element kinds and a few buckets
    for r in sums:
        if r["kind"] == "e":
            model.emit[r["feature"], bool(r["a"])] += r["n"]
        elif r["kind"] == "l":
            model.label[bool(r["a"])] += r["n"]
        else:
            model.edge[r["feature"], bool(r["a"]), bool(r["b"])] += r["n"]
    return model.prepare()


def extract(pages: DataFrame, model: TreeModel) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of ``pages``."""
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                b = batch.slice(start, 500)
                texts = [model.extract(p) for p in b.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()),
                                                  pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    types = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(
        run, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")
