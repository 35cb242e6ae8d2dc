"""Main text of HTML pages: flat text blocks and a decision tree.

A page is cut into text blocks at block-level tags. A block is described by its own word
count and link density, by those of the blocks before and after it, and by the kind of
region it lies in. A decision tree, fitted with Spark ML on a small labelled table of
blocks, tells main text from the rest; the kept blocks, joined by spaces, are the text.

The fitted tree has a handful of nodes and travels in the task's closure. Pages are read
once, without a shuffle, one page at a time.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEPTH = 6

# HTML's elements by how they are rendered.
BLOCK_TAGS = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre "
    "section select summary table tbody td textarea tfoot th thead title tr ul".split())
RAW_TAGS = {"script", "style", "noscript", "template", "textarea", "title", "svg", "math", "iframe", "object", "select"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
VOID_TAGS = set("area base br col embed hr img input link meta param source track wbr".split())
REGION_TAGS = {
    "nav": "side", "header": "side", "footer": "side", "aside": "side", "menu": "side", "dialog": "side",
    "form": "side", "fieldset": "side", "button": "side", "figcaption": "side", "head": "side", "label": "side",
    "article": "main", "main": "main",
}
#: A paragraph, item or cell ends where the next one starts or its parent ends.
OPTIONAL_END = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"},
                "th": {"td", "th", "tr"}, "option": {"option"}}
#: A paragraph also ends at any of these.
ENDS_PARAGRAPH = BLOCK_TAGS - {"br", "body", "html", "head"}
SIDE_WORDS = set(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs byline cookie cookies comment comments consent "
    "copyright disclaimer disqus follow footer header login menu meta modal nav navbar navigation newsletter notice pager "
    "pagination popup promo promotion recommended related reply replies respond search share sharing sidebar signup skip "
    "social sponsor sponsored subscribe subscription tags toolbar widget discussion reactions banner notification "
    "privacy gdpr feedback".split())
MAIN_WORDS = set("article body content entry main post story text".split())
SIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "form"}

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
                 r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
NAME_PART = re.compile(r"[a-z]+")

FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after",
            "in_side", "in_main", "page_has_main", "heading")


@dataclass
class Block:
    text: str
    words: int
    link_words: int
    side: bool
    main: bool
    heading: bool

    @property
    def link_density(self) -> float:
        return self.link_words / self.words if self.words else 0.0


def _region(tag: str, attributes: str) -> str:
    """What an element says about its content: "side", "main", "hidden" or nothing."""
    kind = REGION_TAGS.get(tag, "")
    if not attributes.strip():
        return kind
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return "hidden"
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return "hidden"
        if name == "role":
            if value in SIDE_ROLES:
                return "side"
            if value in ("main", "article"):
                kind = kind or "main"
        if name in ("class", "id") and tag not in ("body", "html", "article", "main"):
            parts = set(NAME_PART.findall(value))
            if parts & SIDE_WORDS:
                return "side"
            if parts & MAIN_WORDS:
                kind = kind or "main"
    return kind


def blocks_of(page: str) -> list[Block]:
    """Text blocks of a page in page order; blocks without a word are left out."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []  # open elements and their regions
    pieces: list[tuple[str, bool]] = []  # text of the current block, and whether it is linked

    def close_block():
        words = "".join([p for p, _ in pieces]).split()
        if words:
            linked = sum(len(p.split()) for p, link in pieces if link)
            regions = {r for _, r in stack}
            out.append(Block(" ".join(words), len(words), min(linked, len(words)), "side" in regions, "main" in regions,
                             any(t in HEADINGS for t, _ in stack)))
        pieces.clear()

    def end(tag: str):
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == tag:
                if any(t in BLOCK_TAGS for t, _ in stack[i:]):
                    close_block()
                del stack[i:]
                return

    at = 0
    while at < len(page):
        match = TAG.search(page, at)
        text = page[at:match.start() if match else len(page)]
        if text and not any(r == "hidden" for _, r in stack):
            pieces.append((entities.unescape(text), any(t == "a" for t, _ in stack)))
        if not match:
            break
        at = match.end()
        closing, tag, attributes = match.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            if tag in BLOCK_TAGS and all(t != tag for t, _ in stack):
                close_block()
            end(tag)
            continue
        if tag in RAW_TAGS:
            if attributes.rstrip().endswith("/") and tag in ("svg", "math"):
                continue
            stop = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = stop.end() if stop else len(page)
            if tag in BLOCK_TAGS:
                close_block()
            continue
        if tag in BLOCK_TAGS:
            close_block()
            for i in range(len(stack) - 1, -1, -1):
                own = stack[i][0]
                if tag in OPTIONAL_END.get(own, ()) or own == "p" and tag in ENDS_PARAGRAPH:
                    del stack[i:]
                    break
                if own in BLOCK_TAGS:  # looks no further than the nearest block element
                    break
        if tag not in VOID_TAGS and not attributes.rstrip().endswith("/"):
            stack.append((tag, _region(tag, attributes)))
    close_block()
    return out


def features_of(blocks: list[Block]) -> list[list[float]]:
    """A row of ``FEATURES`` for each block; word counts end at 100, where more tells nothing."""
    has_main = float(any(b.main and not b.side for b in blocks))
    rows = []
    for i, b in enumerate(blocks):
        before = blocks[i - 1] if i else None
        after = blocks[i + 1] if i + 1 < len(blocks) else None
        row = []
        for x in (b, before, after):
            row += [float(min(x.words, 100)), x.link_density] if x else [0.0, 0.0]
        rows.append([*row, float(b.side), float(b.main and not b.side), has_main, float(b.heading)])
    return rows


# The labelled table: pages as pieces, each marked "+" for main text or "-" for the rest.
_LONG = "The harbour was quiet that morning and the boats lay still while two men mended a net by the wall."
_MID = "Nobody had seen the keeper since the storm."
_LINKS = "<a href=/a>Home</a> <a href=/b>Sport</a> <a href=/c>Weather</a>"
LABELLED_PAGES = [
    [("-", f"<nav><ul><li>{_LINKS}</li><li><a href=/d>Contact</a></li></ul></nav>"), ("-", "<div class=ad>Buy two lamps and pay for one.</div>"),
     ("+", "<article><h1>Quiet harbour</h1>"), ("+", f"<p>{_LONG}</p>"), ("+", f"<p>{_MID}</p>"), ("+", "<p>So it was.</p></article>"),
     ("-", f"<footer>All rights kept. {_LONG}</footer>")],
    [("-", f"<header><h2>The Daily Net</h2><p>{_MID}</p></header>"), ("+", f"<main><p>{_LONG}</p>"), ("+", "<ul><li>Nets</li>"),
     ("+", "<li>Ropes and oars</li></ul>"), ("+", f"<p>{_LONG} <a href=/x>More on nets</a></p>"),
     ("-", f"<aside><h3>Related</h3><p>{_LONG}</p></aside>"), ("+", f"<p>{_MID}</p></main>"), ("-", f"<div id=comments><p>{_LONG}</p><p>First!</p></div>")],
    [("-", f"<div class='cookie-notice'>{_LONG} <button>Accept</button></div>"), ("-", f"<div id=menu>{_LINKS}</div>"),
     ("+", f"<div class=story><h2>The storm</h2><p>{_LONG}</p>"), ("+", f"<p>{_LONG} {_LONG}</p>"), ("-", "<form><p>Name</p><p>Send us your view</p></form>"),
     ("+", "<blockquote>Wait and see.</blockquote></div>"), ("-", f"<section class='sidebar'><p>{_LONG}</p></section>")],
    [("-", f"<table><tr><td>{_LINKS}</td></tr></table>"), ("-", "<p>12 May</p>"), ("+", f"<p>{_LONG}</p>"), ("+", f"<p>{_LONG} {_MID}</p>"),
     ("+", f"<p>{_LONG}</p>"), ("-", f"<p>{_LINKS}</p>"), ("-", "<p>Legal <a href=/l>terms</a></p>")],
    [("-", f"<p>{_LINKS} <a href=/p>A very long list of places to go and things to see in town</a></p>"), ("+", f"<div><p>{_LONG}</p>"),
     ("+", f"<p>{_MID} {_MID}</p>"), ("+", f"<p>{_LONG} <a href=/m>map</a></p></div>"), ("-", "<p><a href=/n>Next</a></p>"), ("-", "<div>2031</div>")],
    [("-", "<div role=banner><p>Harbour News since 1901</p></div>"), ("+", f"<article><p>{_LONG}</p>"),
     ("-", "<div class=share><a href=/s>Share</a></div>"), ("+", "<p>Yes.</p>"), ("+", f"<h3>Later</h3><p>{_MID}</p></article>"),
     ("-", f"<section class=comments><p>{_LONG}</p><p>{_MID}</p></section>"), ("-", f"<div class='newsletter'><p>{_MID}</p></div>"),
     ("-", f"<p>{_MID}</p>")],
]


def labelled_blocks() -> list[tuple[float, list[float]]]:
    """(label, features) of the blocks of the labelled pages."""
    rows = []
    for page in LABELLED_PAGES:
        marks, counts = [], []
        for i in range(len(page)):  # a piece's blocks are those that it adds to the pieces before it
            counts.append(len(blocks_of("".join(p for _, p in page[:i + 1]))))
            marks += [page[i][0]] * (counts[-1] - (counts[-2] if i else 0))
        blocks = blocks_of("".join(p for _, p in page))
        rows += [(float(m == "+"), f) for m, f in zip(marks, features_of(blocks), strict=True)]
    return rows


Tree = tuple  # (feature, threshold, left, right) or (verdict,)


def fit_tree(spark: SparkSession, depth: int = DEPTH) -> Tree:
    """The decision tree for the labelled table, as nested tuples."""
    rows = [(label, Vectors.dense(f)) for label, f in labelled_blocks()]
    model = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=1, seed=1).fit(
        spark.createDataFrame(rows, ["label", "features"]).coalesce(1))

    def plain(node) -> Tree:
        if node.numDescendants() == 0:
            return (bool(node.prediction()),)
        split = node.split()
        return (split.featureIndex(), split.threshold(), plain(node.leftChild()), plain(node.rightChild()))

    return plain(model._call_java("rootNode"))


def verdict(tree: Tree, row: list[float]) -> bool:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def main_text(page: str, tree: Tree) -> tuple[str, int, int]:
    """(text, blocks, kept blocks) of a page."""
    blocks = blocks_of(page)
    kept = [b.text for b, row in zip(blocks, features_of(blocks)) if verdict(tree, row)]
    return " ".join(kept), len(blocks), len(kept)


def _extractor(tree: Tree):
    def extract(batches):
        for batch in batches:
            found = [main_text(p or "", tree) for p in batch.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([t for t, _, _ in found], pa.string()),
                 pa.array([b for _, b, _ in found], pa.int64()), pa.array([k for _, _, k in found], pa.int64())],
                names=[*batch.schema.names[:-1], "_found", "_blocks", "_kept"])

    return extract


def extract(pages: DataFrame, *, html: str = "html", tree: Tree | None = None) -> DataFrame:
    """``pages`` without ``html`` but with text, n_chars, n_blocks and n_kept.

    Columns of those names are replaced. Null, empty and tagless pages are handled like
    others: null and empty give an empty text, a page without tags is one block. Broken
    markup (open tags, attributes or comments that never end) runs to the end of the page.
    Every row is kept, repeated ones too; an empty table gives an empty result.
    """
    tree = tree or fit_tree(pages.sparkSession)
    new = ("text", "n_chars", "n_blocks", "n_kept")
    kept = [c for c in pages.columns if c not in new and c != html]
    inner = pages.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)), F.col(f"`{html}`").cast("string").alias("_html"))
    schema = ", ".join([*(f"c{i} {pages.schema[c].dataType.simpleString()}" for i, c in enumerate(kept)),
                        "_found string, _blocks long, _kept long"])
    return inner.mapInArrow(_extractor(tree), schema).select(
        *(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)), F.col("_found").alias("text"),
        F.length("_found").cast("long").alias("n_chars"), F.col("_blocks").alias("n_blocks"), F.col("_kept").alias("n_kept"))
