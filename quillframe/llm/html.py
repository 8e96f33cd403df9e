"""Main text of web pages: boosted trees over DOM-node features, decoded over the tree.

A page becomes a tree of block elements (inline marks only add to the counts
of the block that holds them). Every node gets features of its tag, attribute
words, depth, siblings and subtree densities; trees give the odds that it
holds main text. Decoding is hierarchical: over each tree, the choice of kept
nodes with the greatest likelihood among those where a dropped node's
descendants are dropped too, so an answer never contradicts itself.

There are no labelled pages, so the trees learn from teaching labels that mark-
up itself gives on a bounded sample: what lies in an article or main element is
text, what lies in navigation, notices, forms and the like is not. Each sampled
page also teaches in rewritten forms (containers renamed or without a name,
blocks of side matter put into the text), so that no single mark decides.

Defined results: a null or empty page gives an empty text with n_chars 0;
broken and cut-off mark-up is read as browsers do in outline (unknown closing
tags are ignored, open elements end with the page); repeated rows each get a
row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html as entities
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .common import sampled, table

#: Pages that the trees learn from, at most about.
MAX_TRAIN_PAGES = 400

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Never text, whatever the model says.
UNSEEN = frozenset("head script style noscript template svg math iframe object canvas audio video select textarea title".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
NOISE_TAGS = frozenset("nav header footer aside form button dialog menu fieldset".split())
TEXT_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol dl li dt dd table thead tbody tfoot tr td th".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal"
    " overlay sidebar side aside widget menu nav navbar navigation breadcrumb breadcrumbs toc share sharing social comment comments disqus reply replies respond"
    " related recommend recommended footer header masthead topbar subscribe subscription newsletter signup login search form pagination pager toolbar".split()
)
TEXT_WORDS = frozenset("article content main body post entry story text page paragraph".split())
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLING_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table body html".split())

MARKUP = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?:class|id|role|aria-label|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
TOKEN = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
SPACE = re.compile(r"\s+")
SENTENCE = re.compile(r"[.!?:;»…。]")
FEATURES = 26


class Node:
    __slots__ = ("tag", "parent", "children", "text", "words", "noise", "good", "links", "own", "depth", "index", "total", "link_total", "nodes", "stops", "paragraphs", "end", "begin", "tail")

    def __init__(self, tag: str, parent: Node | None, attributes: str):
        self.tag, self.parent, self.children, self.text = tag, parent, [], []
        words = {w.lower() for a in ATTRIBUTE.findall(attributes) for w in TOKEN.findall(a)} if attributes.strip() else ()
        self.noise = sum(w in NOISE_WORDS for w in words)
        self.good = sum(w in TEXT_WORDS for w in words)
        self.links = self.own = self.total = self.link_total = self.stops = self.paragraphs = 0
        self.nodes = 1
        self.depth = parent.depth + 1 if parent else 0
        self.index = len(parent.children) if parent else 0
        if parent:
            parent.children.append(self)


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """The page's block nodes in order, parents first, and its text blocks with the nodes that hold them."""
    root = Node("#page", None, "")
    nodes, blocks, pending = [root], [], []
    here, link, at, size = root, False, 0, len(page)

    def flush() -> None:
        if pending:
            text = SPACE.sub(" ", entities.unescape("".join(pending))).strip()
            pending.clear()
            if text:
                blocks.append((here, text))

    def opened(tag: str, attributes: str) -> None:
        nonlocal here
        here = Node(tag, here, attributes)
        nodes.append(here)

    def closed(tag: str, stop: frozenset = frozenset()) -> None:
        nonlocal here
        n = here
        while n.parent is not None and n.tag != tag:
            if n.tag in stop:
                return
            n = n.parent
        if n.parent is not None:
            here = n.parent

    for m in MARKUP.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            raw = page[at : m.start()]
            pending.append(raw)
            if link:
                here.links += len(raw)
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, ends, attributes = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag == "a":
            link = not ends
        if tag in INLINE:
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                flush()
            continue
        flush()
        if ends:
            closed(tag)
            continue
        if here.tag == "p" and tag in CLOSES_P:
            here = here.parent
        for other in SIBLING_ENDS.get(tag, ()):
            closed(other, SCOPE)
        opened(tag, attributes)
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else size
            here = here.parent
        elif attributes.rstrip().endswith("/") and tag not in ("p", "div", "article", "main", "section"):
            here = here.parent
    if at < size:
        rest = page[at:]
        pending.append(rest)
        if link:
            here.links += len(rest)
    flush()
    for node, text in blocks:
        node.own += len(text)
        node.stops += len(SENTENCE.findall(text[-3:])) + text.count(". ")
    for n in nodes:
        n.total, n.link_total, n.paragraphs = n.own, n.links, int(n.tag == "p" and n.own > 0)
    for n in reversed(nodes[1:]):
        p = n.parent
        p.total += n.total
        p.link_total += n.link_total
        p.nodes += n.nodes
        p.stops += n.stops
        p.paragraphs += n.paragraphs
    return nodes, blocks


def features(nodes: list[Node]) -> np.ndarray:
    out = np.zeros((len(nodes), FEATURES))
    above: dict[int, tuple[int, int, int]] = {}
    whole = max(1, nodes[0].total)
    seen = 0
    for i, n in enumerate(nodes):
        p = n.parent
        noise, good, words = above[id(p)] if p is not None else (0, 0, 0)
        own_noise, own_good = int(n.tag in NOISE_TAGS), int(n.tag in TEXT_TAGS)
        above[id(n)] = (noise + own_noise, good + own_good, words + n.noise)
        siblings = p.children if p is not None else [n]
        out[i] = (
            own_noise, own_good, n.noise, n.good, noise, good, words, n.depth, n.tag == "p", n.tag in HEADINGS, n.tag in LISTS, n.tag in ("div", "section", "#page", "body", "html"),
            math.log1p(n.total), math.log1p(n.own), n.total / whole, min(1.0, n.link_total / max(1, n.total)), math.log1p(n.total / n.nodes), n.stops / max(1, n.total / 100),
            n.paragraphs, math.log1p(n.nodes), len(siblings), (n.index + 1) / len(siblings), n.total / max(1, p.total if p is not None else n.total),
            seen / whole, own_noise + n.noise + noise + words > 0, own_good + good > 0,
        )
        seen += n.own
    return out


def teach(nodes: list[Node]) -> np.ndarray:
    """1 for nodes that mark-up shows to be main text (or to hold it), 0 for those it shows not to be."""
    inside, out = {}, np.zeros(len(nodes))
    for i, n in enumerate(nodes):
        noise, text = inside[id(n.parent)] if n.parent is not None else (False, False)
        noise = noise or n.tag in UNSEEN or n.tag in NOISE_TAGS and not (n.tag == "header" and text) or n.noise > 0
        text = text or n.tag in TEXT_TAGS or (n.good > 0 and not noise and n.tag not in ("body", "html"))
        inside[id(n)] = (noise, text)
        out[i] = text and not noise
    good = {id(n) for n, y in zip(nodes, out) if y}
    if not good:  # no article element: paragraphs outside of noise are the text
        for i, n in enumerate(nodes):
            out[i] = not inside[id(n)][0] and n.own > 0 and (n.tag == "p" or n.tag in HEADINGS or n.stops > 0)
    at = {id(n): i for i, n in enumerate(nodes)}
    for n in reversed(nodes[1:]):
        if out[at[id(n)]] and not inside[id(n.parent)][0]:
            out[at[id(n.parent)]] = 1
    return out


#: Side matter for rewritten pages, by tag and attributes.
SIDE = (
    "aside", "form", 'div class="sidebar"', 'section class="comments"', 'div id="comments"', 'div class="cookie-notice"', 'div class="ad-banner"', "nav",
    'div class="related"', 'ul class="menu"', 'div role="navigation"', 'div class="newsletter"', 'section id="respond"', "header", "footer", 'div class="share"',
)


def variants(page: str, number: int) -> list[str]:
    """page, and rewritten forms of it that keep what is text and what is not; number picks among them."""
    rest = SPACE.sub(" ", re.sub(r"<[^>]*>?", " ", page))[-400:]
    side = SIDE[number % len(SIDE)]
    other = SIDE[(number // len(SIDE)) % len(SIDE)]

    def block(kind: str) -> str:
        tag = kind.split()[0]
        words = rest.split()[: 5 + number % 40]
        inner = f"<p>{' '.join(words)}</p>" if number % 2 else f"<div>{' '.join(words)}</div><h3>{' '.join(words[:3])}</h3>"
        inner = "".join(f"<li>{w}</li>" for w in words[:6]) if tag == "ul" else inner
        return f"<{kind}>{inner}</{tag}>"

    renamed = page
    for tag, names in (("article", ('div class="content"', 'div id="main"', "div", 'div class="post-body"')), ("nav", ('div id="menu"', 'ul class="nav"')), ("footer", ('div class="footer"',)), ("header", ('div class="header"',))):
        name = names[number % len(names)]
        renamed = re.sub(rf"<{tag}(?=[\s>])", f"<{name}", renamed)
        renamed = re.sub(rf"</{tag}>", f"</{name.split()[0]}>", renamed)
    def richer(m: re.Match) -> str:
        words = m[1].split()
        half, form = len(words) // 2, (m.start() + number) % 6
        first, second = " ".join(words[:half]), " ".join(words[half:])
        lists = f"<ul><li>{first}</li><li>{second}</li></ul>", f"<ol><li>{' '.join(words[:4])}</li><li>{' '.join(words[4:8])}</li><li>{' '.join(words[8:])}</li></ol>"
        others = f"<blockquote>{m[1]}</blockquote>", f"<section><h2>{' '.join(words[:4])}</h2><p>{m[1]}</p></section>", f"<table><tr><td>{first}</td><td>{second}</td></tr></table>", m[0]
        return (*lists, *others)[form]

    out = [page, renamed, re.sub(r"<p>([^<]{0,4000})</p>", richer, page), re.sub(r"<p>([^<]{0,4000})</p>", richer, renamed)]
    for base, kind in ((page, side), (renamed, other), (out[2], other), (out[3], side)):
        ends = [m.end() for m in re.finditer(r"</p>", base)]
        if ends:
            at = ends[number % len(ends)]
            out.append(base[:at] + block(kind) + base[at:])
            out.append(base[: ends[-1]] + block(kind) + base[ends[-1] :])
    return out


def decode(nodes: list[Node], margin: np.ndarray) -> set[int]:
    """ids of the nodes kept by the likeliest consistent choice."""
    gain, keep = {}, {}
    for n, m in zip(reversed(nodes), margin[::-1]):
        if n.tag in UNSEEN:
            gain[id(n)], keep[id(n)] = 0.0, False
            continue
        # Log-odds of keeping n, and then the best of each child; dropping the subtree is 0.
        value = float(np.clip(m, -12, 12)) + sum(gain[id(c)] for c in n.children)
        if n.parent is None:
            keep[id(n)] = True
            continue
        keep[id(n)] = value > 0
        gain[id(n)] = max(0.0, value)
    kept: set[int] = set()
    for n in nodes:
        if keep[id(n)] and (n.parent is None or id(n.parent) in kept):
            kept.add(id(n))
    return kept


def extract(page: str | None, model: BoostedTrees) -> str:
    nodes, blocks = parse(page or "")
    if not blocks:
        return ""
    kept = decode(nodes, model.margin(features(nodes)))
    return " ".join(text for node, text in blocks if id(node) in kept)


def extract_all(pages: list[str | None], model: BoostedTrees) -> list[str]:
    """extract() for many pages, with one call of the model."""
    parsed = [parse(p or "") for p in pages]
    if not parsed:
        return []
    margin = model.margin(np.concatenate([features(nodes) for nodes, _ in parsed]))
    out, at = [], 0
    for nodes, blocks in parsed:
        kept = decode(nodes, margin[at : at + len(nodes)])
        at += len(nodes)
        out.append(" ".join(text for node, text in blocks if id(node) in kept))
    return out


def spark_slots(df: DataFrame) -> int:
    return max(2, min(64, df.sparkSession.sparkContext.defaultParallelism))


def fit(pages: DataFrame, max_pages: int = MAX_TRAIN_PAGES) -> BoostedTrees:
    """Trees from a bounded sample of pages (page_id, html), about max_pages of any number, dealt by a hash; repeats teach once."""
    n = pages.count()
    sample = pages.select("page_id", "html", F.xxhash64("page_id", "html").alias("at"), F.pmod(F.xxhash64("page_id", F.lit(3)), F.lit(1 << 30)).alias("number"))
    sample = sample.filter(sampled(F.col("at"), n, max_pages)).dropDuplicates(["at"])

    def run(batches):
        for batch in batches:
            for number, page in zip(batch.column("number").to_pylist(), batch.column("html").to_pylist()):
                rows = []
                for form in variants(page or "", number):
                    nodes, _ = parse(form)
                    one = np.column_stack([features(nodes), teach(nodes)])
                    # Of the many alike nodes of a page, a bounded share is enough.
                    rows.append(one[number % max(1, len(one) // 12) :: max(1, len(one) // 12)])
                rows = np.concatenate(rows)
                yield pa.RecordBatch.from_pydict({"row": pa.array(rows.tolist(), pa.list_(pa.float64()))})

    # The sample is small however large the table is, and each page is read in a dozen forms.
    sample = sample.repartition(spark_slots(pages))
    table_ = sample.mapInArrow(run, "row array<double>").toArrow()
    rows = np.asarray(table_.column("row").to_pylist(), float).reshape(-1, FEATURES + 1)
    rows = rows[np.lexsort(rows.T)]
    return BoostedTrees(trees=50, depth=4, rate=0.25).fit(rows[:, :-1], rows[:, -1])


def main_text(pages: DataFrame, model: BoostedTrees) -> DataFrame:
    def run(batches):
        for batch in batches:
            html = batch.column("html").to_pylist()
            texts = [t for i in range(0, len(html), 64) for t in extract_all(html[i : i + 64], model)]
            yield pa.RecordBatch.from_pydict({
                "page_id": batch.column("page_id"), "url": batch.column("url"),
                "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            })

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return main_text(pages, fit(pages))
