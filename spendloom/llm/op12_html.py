"""Main text of web pages by site style trees.

The element trees of a host's pages are merged: elements whose tags and classes agree from the
root down are one node. Two entropies over the host's different pages tell a node's importance:
that of its presentations (the sequences of its children) and that of its contents (a text that
stands on all pages tells nothing, one that stands on a single page tells all). Branches of low
importance leave each page.

Entropy alone keeps what differs on every page, as rotating adverts and menus do. So an
element's label (its tag, role, class and id) sets its importance where it names one: 0 for
menus, adverts, notices and the like, 1 for an article and what it holds. Where a page has an
article, what stands outside it is not its main text.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendloom.llm import tables
from spendloom.llm.op9_urls import parts

#: Weight of the contents against the presentations of a node that holds text.
GAMMA = 0.9
#: Less important branches go.
THRESHOLD = 0.35
#: A node on fewer different pages of its host is not judged by entropy.
LEAST_PAGES = 4

#: What HTML calls elements, and words by which authors label branches.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html"
    " legend li main menu nav ol option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
NOISE_TAGS = frozenset("applet aside audio button canvas dialog embed footer form head iframe input menu nav noscript object script search select style svg template textarea title video".split())
NOISE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NOISE_WORDS = frozenset(
    "ad adbox ads adsbygoogle adsense adslot advert adverts advertisement advertising aside breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer form gdpr login masthead menu modal"
    " nav navbar navigation newsletter notice notices notification notifications pager pagination popup promo promotion recommended related replies respond search share sharing sidebar signup skip social"
    " sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Words that make no noise of the word behind them: `has-sidebar`, `no-ads`.
ABOUT = frozenset("has with no without is".split())
ARTICLE_WORDS = frozenset("articlebody postcontent entrycontent articlecontent postbody storybody".split())
#: Elements inside which an open p is not closed from.
SCOPES = frozenset("button table td th caption object".split())
#: Elements that a start tag closes when they are open: tag -> (closed, where the search for them ends).
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}

_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SPACE = re.compile(r"\s+")
_MARKUP = re.compile("<(?=[a-zA-Z/!?])")
#: A tag up to its `>`; quotes hide one only behind `=`. Nothing here is tried twice.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])))*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++))""")
#: Elements whose text holds no tags.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: What a branch is: cut off, as entropy says, the page's main part, its article.
NOISE, OPEN, MAIN, ARTICLE = -1, 0, 1, 2
#: What a page shows of a node: the sequence of its children, a text, itself.
SHAPE, CONTENT, PRESENT = 0, 1, 2


def digest(*values: object) -> int:
    return int.from_bytes(hashlib.blake2b(repr(values).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


@functools.lru_cache(1 << 12)
def digest_path(parent: int, label: str) -> int:
    return digest(parent, label)


@functools.lru_cache(1 << 14)
def meaning(tag: str, role: str, prop: str, names: str, in_article: bool) -> int:
    """What an element's label says of its branch."""
    if tag in NOISE_TAGS or role in NOISE_ROLES or (tag == "header" and not in_article):
        return NOISE
    if tag not in ("html", "body", "main"):
        for name in names.split():
            words = [w.lower() for w in _WORD.findall(name)]
            if any(w in NOISE_WORDS and not (i and words[i - 1] in ABOUT) for i, w in enumerate(words)):
                return NOISE
    if tag == "article" or prop == "articleBody" or any("".join(w.lower() for w in _WORD.findall(n)) in ARTICLE_WORDS for n in names.split()):
        return ARTICLE
    return MAIN if tag == "main" or role == "main" else OPEN


class Page:
    """A page's blocks (node, what its branch is, text) and, of each open branch, what its nodes show.

    Markup that does not end is cut off: it goes up to the end of the page.
    """

    def __init__(self, html: str, features: bool = False):
        #: Open elements: tag, node, what, labels of its children, its innermost block, whether a p is open in it.
        self.open: list[tuple] = [("", 0, OPEN, [], (0, OPEN), False)]
        self.count: dict[str, int] = {}
        self.blocks: list[tuple[int, int, str]] = []
        self.shown: list[tuple[int, int, int]] | None = [] if features else None
        self.at, self.pieces = (0, OPEN), []
        self.labels = {}
        self.read(html)
        while len(self.open) > 1:
            self.pop()
        self.flush()

    def read(self, html: str) -> None:
        at = 0
        while found := _MARKUP.search(html, at):
            i = found.start()
            if i > at:
                self.data(html[at:i])
            sign = html[i + 1]
            if sign in "!?" or (sign == "/" and not html[i + 2 : i + 3].isalpha()):
                comment = html.startswith("<!--", i)
                # `<!-->` and `<!--->` are whole comments.
                end = i + 2 if comment and html.startswith((">", "->"), i + 4) else i + 4
                end, long = (html.find("-->", end), 3) if comment else (html.find(">", i + 2), 1)
                if end < 0:
                    return
                at = end + long
                continue
            tag = _TAG.match(html, i)
            if tag is None:
                return
            at, name = tag.end(), tag[2].lower()
            if tag[1]:
                self.end(name)
                continue
            self.start(name, tag[3])
            if name in RAW:
                close = re.compile(f"</{name}(?![^\\s/>])", re.IGNORECASE).search(html, at)
                if close is None:
                    return
                at = close.start()
        self.data(html[at:])

    def flush(self) -> None:
        if self.pieces:
            text = _SPACE.sub(" ", "".join(self.pieces)).strip()
            if text:
                self.blocks.append((*self.at, text))
            self.pieces = []

    def pop(self) -> None:
        tag, node, what, children, _, _ = self.open[-1]
        self.count[tag] -= 1
        if tag in BLOCKS:
            self.flush()
        if self.shown is not None and what != NOISE and children:
            self.shown.append((node, SHAPE, digest(*(c for i, c in enumerate(children) if not i or children[i - 1] != c))))
        self.open.pop()

    def close_to(self, tags: tuple[str, ...], stop: tuple[str, ...] = ()) -> None:
        if any(self.count.get(t) for t in tags):
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i][0] in tags:
                    while len(self.open) > i:
                        self.pop()
                    return
                if self.open[i][0] in stop:
                    return

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self.flush()
            if self.open[-1][5]:
                self.close_to(("p",))
        if tag in CLOSES:
            self.close_to(*CLOSES[tag])
        if tag == "br":
            self.data("\n")
        if tag in VOID:
            return
        given: dict[str, str] = {}
        for name, *values in _ATTRIBUTE.findall(attributes) if "=" in attributes else ():
            given.setdefault(name.lower(), unescape("".join(values)))
        names = f"{given.get('class', '')} {given.get('id', '')}".strip() if given else ""
        _, parent, around, siblings, block, in_p = self.open[-1]
        label = f"{tag}.{names}" if names else tag
        siblings.append(label)
        # Below a cut branch all is cut; an article's branches are its own unless a label cuts them.
        what = NOISE
        if around != NOISE:
            said = meaning(tag, given.get("role", "").lower(), given.get("itemprop", ""), names, around == ARTICLE)
            what = said if said == NOISE else max(around, said)
        node = digest_path(parent, label) if what != NOISE else 0
        if self.shown is not None and node:
            self.labels[node] = (parent, label)
        self.count[tag] = self.count.get(tag, 0) + 1
        self.open.append((tag, node, what, [], (node, what) if tag in BLOCKS else block, tag == "p" or (in_p and tag not in SCOPES)))

    def end(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        if tag == "br":
            self.data("\n")
        self.close_to((tag,))

    def data(self, text: str) -> None:
        if self.open[-1][2] != NOISE:
            if not self.pieces:
                self.at = self.open[-1][4]
            self.pieces.append(unescape(text) if "&" in text else text)


def main_text(html: str, low: frozenset[int] = frozenset()) -> str:
    """The blocks of the page's article, else of its main part, else of all branches; the low ones leave each."""
    blocks = Page(html).blocks
    kept = max((what for _, what, _ in blocks), default=OPEN)
    return "\n\n".join(text for node, what, text in blocks if what == kept and node not in low)


def style_tree(pages: DataFrame, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """The merged trees: a row per host and node with its label, parent, pages, both entropies and importance.

    Copies of a page count once. Branches that a label cuts are not descended into; pages
    without a host belong to no site.
    """
    host, _ = parts("url")
    asked = pages.select(F.col(url_column).alias("url"), F.col(html_column).alias("html")).where("html is not null")
    asked = asked.select(host.alias("host"), F.xxhash64("html").alias("page"), "html").where("host <> ''")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for host, key, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                page = Page(html, features=True)
                shown = page.shown + [(node, CONTENT, digest(text)) for node, what, text in page.blocks]
                shown += [(node, PRESENT, 0) for node in page.labels]
                found += {(host, key, node, *page.labels[node], kind, feature) for node, kind, feature in shown if node in page.labels}
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(kinds)], names)

    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int8(), pa.int64()]
    names = ["host", "page", "node", "parent", "label", "kind", "feature"]
    shown = asked.mapInArrow(read, "host string, page long, node long, parent long, label string, kind byte, feature long")
    met = shown.groupBy("host", "node", "kind", "feature").agg(F.count_distinct("page").alias("n"), F.min("parent").alias("parent"), F.min("label").alias("label"))
    # n pages show a feature: as a presentation it has a share of n / shows, as a content it is
    # spread evenly over n pages, which is an entropy of log n.
    of = lambda kind, c: F.when(F.col("kind") == kind, c)
    n, log = F.col("n"), F.log("n")
    nodes = met.groupBy("host", "node").agg(
        F.min("parent").alias("parent"), F.min("label").alias("label"), F.max(of(PRESENT, n)).alias("pages"),
        F.sum(of(SHAPE, n)).alias("shows"), F.sum(of(SHAPE, n * log)).alias("n_logs"), F.count(of(CONTENT, n)).alias("contents"), F.sum(of(CONTENT, log)).alias("logs"),
    )
    base = F.log(F.greatest("pages", F.lit(2)))
    # -sum p log p = log(shows) - sum(n log n) / shows
    shape = (F.log("shows") - F.col("n_logs") / F.col("shows")) / base
    nodes = nodes.select("host", "node", "parent", "label", "pages", shape.alias("presentation"), F.when(F.col("contents") > 0, 1 - F.col("logs") / F.col("contents") / base).alias("content"))
    presentation, content = F.coalesce("presentation", F.lit(0.0)), F.col("content")
    importance = F.when(F.col("pages") < LEAST_PAGES, F.lit(1.0)).when(content.isNull(), presentation).otherwise((1 - GAMMA) * presentation + GAMMA * content)
    return nodes.withColumn("importance", importance)


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Every page with the text of its article and its length in code points.

    Blocks are joined by two line ends; white space inside one becomes one space; character
    references are decoded, as far as they are whole. Null and empty pages have an empty text,
    as have pages that hold nothing but cut branches. Broken and cut-off markup is read as far as
    it goes; pages of any length are read whole, repeated pages are each returned, and copies of a
    page count once in its host's tree. Equal texts of one node are one content. An empty table gives no
    rows; extra columns are not read.
    """
    spark = pages.sparkSession
    tree = style_tree(pages, url_column, html_column)
    low = tree.where((F.col("importance") < THRESHOLD) & F.col("content").isNotNull()).groupBy("host").agg(F.collect_set("node").alias("low"))
    low = tables.stage(low, "low")
    host, _ = parts("url")
    asked = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), F.col(html_column).alias("html")).withColumn("host", host)
    # A host may hold a third of all pages: where the low nodes are too many to broadcast, its pages go by salts.
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = asked.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(salts)))
    low = low.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    asked = asked.join(low, ["host", "salt"], "left").select("id", "url", "html", "low")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html or "", frozenset(nodes or ())) for html, nodes in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["id", "url", "text", "n_chars"])

    kind = pages.schema[id_column].dataType.simpleString()
    found = asked.mapInArrow(read, f"id {kind}, url string, text string, n_chars long")
    return found.select(F.col("id").alias(id_column), F.col("url").alias(url_column), "text", "n_chars")


def op12_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(tables.read(spark, sf_dir, "pages"))
