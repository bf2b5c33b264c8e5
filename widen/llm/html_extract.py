"""Main text of web pages: gradient-boosted trees over DOM nodes.

A page becomes a tree of block elements. Each node has features of its subtree
(text and link density, marks), its attribute tokens, depth, ancestors and
siblings. Boosted trees give the odds that a node holds or belongs to the
article, and decoding picks the set of nodes with the best sum of odds in which
no kept node lies under a dropped one, so that ancestors and descendants never
contradict each other.

The trees are trained here, on a bounded sample of the pages. There are no
labels of main text, so these are made: semantic elements of the sampled pages
(article, nav, footer ...), and new layouts built from the pieces of the sampled
pages (menus, notices, side bars, reader comments, forms around an article under
various element and class names), whose labels are known from the building.

What stands in scripts, forms' controls, players, drawings and formulas
(``DROPPED``: also svg and math inside an article) is no text. One of these that
is closed in its start tag, or that nothing closes before the page ends, holds
nothing, so the page behind it stays; a script or style without an end runs to
the end, as in browsers. A head without an end tag ends where its content does.

Defined results: a null or empty page and a page whose nodes all read as menus have the
empty text; repeated rows are extracted each; an empty table gives an empty
result (a model of the built-in layouts alone needs at least one page, so none is
fitted); only the id, url and html columns are read.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass, field
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from widen.llm.common import slices

# Classes of HTML elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = set("head title script style template noscript svg math iframe object canvas audio video button select option "
              "textarea datalist".split())
#: Start tags that do not end an open head.
IN_HEAD = set("base basefont bgsound head link meta noframes noscript script style template title".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby "
             "s samp small span strike strong sub sup td th time tt u var wbr".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: A start tag closes an open element of these names, up to a container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"},
          "tbody": {"thead", "tbody", "tfoot"}, "tfoot": {"thead", "tbody"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "tbody": {"table"},
         "tfoot": {"table"}}

GOOD = set("article content main post entry story body text prose maincontent pagecontent hentry".split())
BAD = set("nav navigation navbar menu menubar header masthead topbar footer bottom sidebar side aside rail ad ads advert "
          "adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
          "notice alert popup modal overlay comment comments reply replies respond disqus discussion form search share "
          "sharing social related recommended widget breadcrumb breadcrumbs login signup subscribe newsletter "
          "copyright legal tags pagination pager toolbar complementary contentinfo".split())
_TOKEN = re.compile(r"[a-z]+|[A-Z][a-z]*")
_SPACES = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "children", "tokens", "label", "parts", "chars", "links", "marks", "tags", "row")

    def __init__(self, tag, parent, tokens=(), label=None):
        self.tag, self.parent, self.tokens, self.label = tag, parent, tokens, label
        self.children: list[Node] = []
        self.parts: list = []  # text runs and child nodes in page order
        self.chars = self.links = self.marks = 0
        self.tags = 1


class _Builder(HTMLParser):
    """Tree of block elements; inline elements melt into their block.

    Dropped elements are counted from 0; those of the numbers in ``bare`` hold
    nothing.
    """

    def __init__(self, bare: set[int]):
        super().__init__(convert_charrefs=True)
        self.bare = bare
        self.count = 0
        self.root = self.at = Node("html", None)
        self.open: list[tuple[str, Node | None]] = []  # all open elements; None: inline
        self.dropped: list[int] = []  # numbers of the dropped ones, which are the last of the open ones
        self.linked = 0

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            return
        if tag not in IN_HEAD:
            self._end_head()
        if tag in DROPPED:
            if self.count not in self.bare:
                self._push(tag, None)
                self.dropped.append(self.count)
            self.count += 1
            return
        if self.dropped:
            return
        if tag in VOID:
            self.at.tags += 1
            if tag in ("br", "hr", "img"):
                self.at.parts.append(" ")
            return
        if tag in CLOSES:
            self._close(CLOSES[tag], STOPS.get(tag, set()))
        if tag in INLINE:
            if tag in ("td", "th"):
                self.at.parts.append(" ")
            self._push(tag, None)
            self.at.tags += 1
            self.linked += tag == "a"
            return
        self._close({"p"}, {"button", "table", "td", "th", "object"})  # a block ends an open paragraph
        if tag in HEADINGS:
            self._close(HEADINGS, {"div", "section", "article", "td"})
        self.at.tags += 1
        a = dict(attrs)
        tokens = {t.lower() for k in ("class", "id", "role") for t in _TOKEN.findall(a.get(k) or "")}
        tokens |= {t.lower() for k in ("class", "id") for t in (a.get(k) or "").split()}
        node = Node(tag, self.at, tokens, a.get("data-y"))
        self.at.children.append(node)
        self.at.parts.append(node)
        self._push(tag, node)
        self.at = node

    def handle_startendtag(self, tag, attrs):
        if tag not in DROPPED:
            self.handle_starttag(tag, attrs)
        elif tag not in IN_HEAD:
            self._end_head()

    def _end_head(self):
        if self.dropped and self.open[-1][0] == "head":
            self._pop()

    def unclosed(self) -> set[int]:
        """Numbers of the dropped elements that are open, but for scripts and
        styles, whose text has no tags."""
        held = self.open[len(self.open) - len(self.dropped):]
        return {n for n, (tag, _) in zip(self.dropped, held) if tag not in self.CDATA_CONTENT_ELEMENTS}

    def _push(self, tag, node):
        self.open.append((tag, node))

    def _pop(self):
        tag, node = self.open.pop()
        if node is not None:
            self.at = node.parent
        elif tag == "a" and not self.dropped:
            self.linked -= 1
        elif tag in DROPPED and self.dropped:
            self.dropped.pop()

    def _close(self, names, stops):
        for k in range(len(self.open) - 1, -1, -1):
            tag = self.open[k][0]
            if tag in names:
                while len(self.open) > k:
                    self._pop()
                return
            if tag in stops:
                return

    def handle_endtag(self, tag):
        if self.dropped and tag not in DROPPED:
            return
        if tag in VOID:
            return
        blocked = {"table"} if tag not in ("table", "body", "html", "article", "main") else set()
        self._close({tag}, blocked - {tag})

    def handle_data(self, data):
        if not data.isspace():
            self._end_head()
        if self.dropped:
            return
        at = self.at
        at.parts.append(data)
        n = len(data) if not data.isspace() else 0
        if n:
            at.chars += n
            if self.linked > 0:
                at.links += n
            at.marks += data.count(".") + data.count(",") + data.count("?") + data.count("!")


def parse(html: str) -> list[Node]:
    """Nodes of a page in page order (parents before children)."""
    bare: set[int] = set()
    while True:
        b = _Builder(bare)
        b.feed(html)
        b.close()
        if not (lost := b.unclosed()):
            break
        bare |= lost
    out, todo = [], [b.root]
    while todo:
        n = todo.pop()
        n.row = len(out)
        out.append(n)
        todo.extend(reversed(n.children))
    return out


FEATURES = ("html_body", "container", "article", "paragraph", "heading", "list", "table", "nav", "aside", "footer",
            "header", "form", "good", "bad", "good_above", "bad_above", "depth", "own_text", "subtree_text",
            "link_density", "text_per_tag", "marks", "index", "siblings", "like_siblings", "parent_share", "page_share",
            "place", "children", "own_links")

_GROUPS = [{"html", "body"}, {"div", "section", "center", "fieldset"}, {"article", "main"}, {"p", "pre", "blockquote"},
           HEADINGS, {"ul", "ol", "li", "dl", "dt", "dd", "menu"},
           {"table", "tr", "tbody", "thead", "tfoot", "caption"}, {"nav"}, {"aside", "dialog"}, {"footer"}, {"header"},
           {"form"}]


def node_features(nodes: list[Node]) -> np.ndarray:
    n = len(nodes)
    chars, links, marks, tags = ([getattr(x, k) for x in nodes] for k in ("chars", "links", "marks", "tags"))
    for i in range(n - 1, 0, -1):  # children come after their parents
        p = nodes[i].parent.row
        chars[p] += chars[i]
        links[p] += links[i]
        marks[p] += marks[i]
        tags[p] += tags[i]
    total = max(1, chars[0])
    x = np.zeros((n, len(FEATURES)))
    good, bad, depth = [0] * n, [0] * n, [0] * n
    seen = 0
    log = np.log1p
    for i, node in enumerate(nodes):
        p = node.parent
        own_good = len(GOOD & node.tokens) if node.tokens else 0
        own_bad = len(BAD & node.tokens) if node.tokens else 0
        if p is None:
            above = up = d = 0
            k, siblings, like = 0, 1, 1
        else:
            j = p.row
            above, up, d = good[j], bad[j], depth[j] + 1
            siblings = len(p.children)
            k = x[j, 28]  # so far seen children of the parent
            x[j, 28] += 1
            like = sum(c.tag == node.tag for c in p.children) if siblings < 50 else siblings
        good[i] = above + own_good + (node.tag in ("article", "main"))
        bad[i] = up + own_bad + (node.tag in ("nav", "aside", "footer", "form", "dialog"))
        depth[i] = d
        row = [node.tag in g for g in _GROUPS]
        row += [own_good, own_bad, above, up, d, node.chars, chars[i], links[i] / max(1, chars[i]),
                chars[i] / tags[i], marks[i] / max(1, chars[i]), k / siblings, siblings, like / siblings,
                chars[i] / max(1, chars[p.row]) if p else 1.0, chars[i] / total, seen / total, 0,
                node.links / max(1, node.chars)]
        x[i] = row
        seen += node.chars
    for c in (17, 18, 20, 23):
        x[:, c] = log(x[:, c])
    x[:, 28] = log(np.array([len(q.children) for q in nodes]))
    return x


# ---------------------------------------------------------------------------
# boosted trees
# ---------------------------------------------------------------------------

@dataclass
class Boosted:
    """Trees of one depth as arrays: features and thresholds by level order,
    values by leaf."""

    depth: int = 3
    base: float = 0.0
    features: list = field(default_factory=list)
    thresholds: list = field(default_factory=list)
    values: list = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, t, v in zip(self.features, self.thresholds, self.values):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - (2 ** self.depth - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32,
              ridge: float = 1.0) -> Boosted:
    """Newton boosting of the logistic loss on histograms of binned features."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    m = Boosted(depth, float(np.log(p / (1 - p))))
    margin = np.full(len(x), m.base)
    rows = np.arange(len(x))
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-margin))
        g, h = prob - y, prob * (1 - prob)
        feature = np.zeros(2 ** depth - 1, np.int64)
        threshold = np.full(2 ** depth - 1, np.inf)
        cut = np.full(2 ** depth - 1, bins)
        at = np.zeros(len(x), np.int64)
        for level in range(depth):
            first, count = 2 ** level - 1, 2 ** level
            best = np.full(count, 1e-6)
            for f, c in enumerate(cuts):
                cell = (at - first) * (bins + 1) + binned[:, f]
                gs = np.bincount(cell, g, count * (bins + 1)).reshape(count, -1).cumsum(1)
                hs = np.bincount(cell, h, count * (bins + 1)).reshape(count, -1).cumsum(1)
                gl, hl, gt, ht = gs[:, :len(c)], hs[:, :len(c)], gs[:, -1:], hs[:, -1:]
                if not len(c):
                    continue
                gain = gl ** 2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt ** 2 / (ht + ridge)
                b = gain.argmax(1)
                top = gain[np.arange(count), b]
                for k in np.flatnonzero(top > best):
                    best[k] = top[k]
                    feature[first + k], cut[first + k], threshold[first + k] = f, b[k], c[b[k]]
            at = 2 * at + 1 + (binned[rows, feature[at]] > cut[at])
        leaf = at - (2 ** depth - 1)
        value = -rate * np.bincount(leaf, g, 2 ** depth) / (np.bincount(leaf, h, 2 ** depth) + ridge)
        margin += value[leaf]
        m.features.append(feature)
        m.thresholds.append(threshold)
        m.values.append(value)
    return m


# ---------------------------------------------------------------------------
# training pages
# ---------------------------------------------------------------------------

def silver_labels(nodes: list[Node]) -> np.ndarray | None:
    """Labels from semantic elements; None if the page has no article."""
    y = np.zeros(len(nodes))
    for i, n in enumerate(nodes):
        inside = n.tag in ("article", "main") or (n.parent is not None and y[n.parent.row] == 2)
        out = n.tag in ("nav", "aside", "footer", "form", "dialog") or BAD & set(n.tokens)
        y[i] = 2 if inside and not out else 0
    if not y.any():
        return None
    for i in range(len(nodes) - 1, 0, -1):
        if y[i]:
            y[nodes[i].parent.row] = max(1, y[nodes[i].parent.row])
    return (y > 0).astype(float)


def built_labels(nodes: list[Node]) -> np.ndarray:
    """Labels of a built layout: the nearest data-y, and 1 above a 1."""
    y = np.zeros(len(nodes))
    for i, n in enumerate(nodes):
        y[i] = float(n.label) if n.label is not None else (y[n.parent.row] if n.parent is not None else 0)
    for i in range(len(nodes) - 1, 0, -1):
        if y[i]:
            y[nodes[i].parent.row] = 1
    return y


def build_layout(blocks: list[str], other: list[str], rnd: random.Random) -> str:
    """A page with an article of ``blocks`` and surroundings made of ``other``."""
    def words(n):
        return escape(" ".join(rnd.choice(other).split()[:n] or ["x"]))

    def links(n):
        return "".join(f'<li><a href="#">{words(rnd.randint(1, 4))}</a></li>' for _ in range(n))

    def paragraphs(n):
        return "".join(f"<p>{escape(rnd.choice(other))}</p>" for _ in range(n))

    def wrap(names, tokens, inner, y):
        tag = rnd.choice(names)
        attr = rnd.choice(["class", "id"]) if tag in ("div", "section", "ul") or rnd.random() < 0.5 else None
        named = f' {attr}="{rnd.choice(tokens)}"' if attr else ""
        return f'<{tag}{named} data-y="{y}">{inner}</{tag}>'

    title = f"<h1>{escape(blocks[0][:80])}</h1>"
    body = "".join(f"<h2>{escape(b)}</h2>" if len(b) < 40 and rnd.random() < 0.4 else
                   f"<ul><li>{escape(b)}</li></ul>" if rnd.random() < 0.05 else
                   f"<blockquote>{escape(b)}</blockquote>" if rnd.random() < 0.05 else f"<p>{escape(b)}</p>"
                   for b in blocks)
    if rnd.random() < 0.3:
        body += wrap(["aside", "div"], ["ad", "related", "share", "newsletter", "promo"], paragraphs(1), 0)
    if rnd.random() < 0.15:
        body += wrap(["form"], ["subscribe"], f"<p>{words(6)}</p>", 0)
    main = wrap(["article", "main", "div", "div", "section"], ["content", "post", "main", "entry", "article-body",
                                                               "story", "main-content"],
                (f"<header>{title}</header>" if rnd.random() < 0.2 else title) + body, 1)
    around = []
    if rnd.random() < 0.7:
        around.append(wrap(["nav", "div", "ul"], ["menu", "nav", "navbar", "topnav-menu"],
                           f"<ul>{links(rnd.randint(3, 9))}</ul>", 0))
    if rnd.random() < 0.5:
        around.append(wrap(["header", "div"], ["header", "masthead", "site-header", "banner"],
                           f"<p>{words(rnd.randint(2, 12))}</p>", 0))
    if rnd.random() < 0.5:
        around.append(wrap(["div", "section", "aside"], ["cookie-notice", "notice", "consent", "alert", "banner"],
                           paragraphs(1), 0))
    if rnd.random() < 0.5:
        around.append(wrap(["div"], ["ad", "ads", "advert", "sponsored", "promo"], words(rnd.randint(5, 30)), 0))
    after = []
    if rnd.random() < 0.5:
        after.append(wrap(["aside", "div"], ["sidebar", "side", "related", "widget"],
                          paragraphs(rnd.randint(1, 3)) + f"<ul>{links(3)}</ul>", 0))
    if rnd.random() < 0.6:
        after.append(wrap(["section", "div", "ol"], ["comments", "comment-list", "discussion", "replies", "respond"],
                          "".join(f'<div class="{rnd.choice(["comment", "reply"])}">{paragraphs(1)}</div>'
                                  for _ in range(rnd.randint(1, 5))), 0))
    if rnd.random() < 0.4:
        after.append(wrap(["form", "div"], ["search", "login", "newsletter", "comment-form"],
                          f"<label>{words(3)}</label><input>", 0))
    if rnd.random() < 0.8:
        after.append(wrap(["footer", "div"], ["footer", "site-footer", "copyright", "legal"],
                          rnd.choice([words(12), f"<p>{words(20)}</p>", f"&copy; {words(6)}"]), 0))
    rnd.shuffle(around)
    if rnd.random() < 0.3:
        main = f'<div class="{rnd.choice(["page", "wrapper", "container", "row"])}">{main}{"".join(after[:1])}</div>'
        after = after[1:]
    return f"<html><head><title>x</title></head><body>{''.join(around)}{main}{''.join(after)}</body></html>"


def train(pages: list[str], layouts: int = 4, seed: int = 7) -> Boosted:
    """Trees from sampled pages: their silver labels and built layouts."""
    rnd = random.Random(seed)
    parsed = [parse(h) for h in pages]
    texts = [[t for t in (_own_text(n) for n in nodes) if t] for nodes in parsed]
    pool = [t for own in texts for t in own] or ["text"]
    xs, ys = [], []
    for nodes, own in zip(parsed, texts):
        y = silver_labels(nodes)
        if y is not None:
            xs.append(node_features(nodes))
            ys.append(y)
        for _ in range(layouts):
            blocks = rnd.sample(pool, min(len(pool), rnd.randint(1, 14))) if rnd.random() < 0.5 else own or pool[:1]
            made = parse(build_layout(blocks[:60], pool, rnd))
            xs.append(node_features(made))
            ys.append(built_labels(made))
    return fit_trees(np.concatenate(xs), np.concatenate(ys))


# ---------------------------------------------------------------------------
# decoding
# ---------------------------------------------------------------------------

def _own_text(node: Node) -> str:
    return _SPACES.sub(" ", "".join(p for p in node.parts if isinstance(p, str))).strip()


def decode(nodes: list[Node], margin: np.ndarray) -> list[bool]:
    """The kept nodes: the best sum of odds among all choices that keep no node
    under a dropped one. Odds count more for nodes with more text of their own."""
    gain = [m * (1 + np.log1p(n.chars)) for m, n in zip(margin.tolist(), nodes)]
    for i in range(len(nodes) - 1, 0, -1):
        if gain[i] > 0:
            gain[nodes[i].parent.row] += gain[i]
    kept = [False] * len(nodes)
    for i, n in enumerate(nodes):
        kept[i] = gain[i] > 0 and (n.parent is None or kept[n.parent.row])
    return kept


def kept_text(nodes: list[Node], kept: list[bool]) -> str:
    """Blocks of kept nodes in page order, joined by two line ends."""
    blocks: list[str] = []
    todo: list = [(nodes[0], 0)]
    run: list[str] = []

    def end():
        t = _SPACES.sub(" ", "".join(run)).strip()
        if t:
            blocks.append(t)
        run.clear()

    while todo:  # a page may nest deeper than the call stack
        node, at = todo.pop()
        if not kept[node.row]:
            continue
        while at < len(node.parts):
            part = node.parts[at]
            at += 1
            if isinstance(part, str):
                run.append(part)
            else:
                end()
                todo.append((node, at))
                todo.append((part, 0))
                break
        else:
            end()
    return "\n\n".join(blocks)


def extract_pages(pages: list[str], model: Boosted) -> list[str]:
    parsed = [parse(h) for h in pages]
    if not parsed:
        return []
    x = [node_features(n) for n in parsed]
    margins = np.split(model.margin(np.concatenate(x)), np.cumsum([len(a) for a in x])[:-1])
    return [kept_text(n, decode(n, m)) for n, m in zip(parsed, margins)]


def extract(pages: DataFrame, sample: int = 300, id_col: str = "page_id", url: str = "url",
            html: str = "html") -> DataFrame:
    """id, url, text, n_chars of every page.

    ``sample`` bounds the training pages: about so many, drawn by a hash of the
    whole row.
    """
    rows = pages.select(F.col(id_col), F.col(url), F.coalesce(F.col(html), F.lit("")).alias("__html"))
    h = F.xxhash64(id_col, "__html")
    filled = rows.where(F.col("__html") != "")
    n = max(1, filled.count())
    # about ``sample`` hashes in n fall below it; equal rows are one, and tasks send only what is drawn
    drawn = (filled.select("__html", h.alias("__h")).where(F.pmod("__h", F.lit(n)) < sample)
             .groupBy("__h").agg(F.first("__html").alias("__html")).collect())
    drawn.sort(key=lambda r: r["__h"])
    model = train([r["__html"] for r in drawn]) if drawn else Boosted()

    def run(batches):
        for b in batches:
            texts = b.column(2).to_pylist()
            for start, stop in slices(texts, 4_000_000):
                out = extract_pages(texts[start:stop], model)
                own = b.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(out, pa.string())],
                                                 [id_col, url, "text"])

    schema = T.StructType([*rows.drop("__html").schema.fields, T.StructField("text", T.StringType())])
    return rows.mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op6_html_extraction": op6_html_extraction}
ORACLES: dict[str, str] = {}
