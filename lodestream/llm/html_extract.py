"""Main text of web pages by a site style tree.

Each page is parsed once into text blocks and the elements above them; an element's place is the path of its
ancestors (tag and first class), known by a rolling hash, to ``TREE_DEPTH`` levels: deeper elements share the place
of their ancestor there. The pages of a host are merged by place into the site's style tree, pages of equal body
counting once:

1. A place's *presentation* styles are the sequences of child elements it shows. With shares p of its m pages,
   its presentation importance is the entropy -sum p log_m p: 0 where every page looks alike, near 1 where all differ.
2. Its *contents* are the texts it holds itself. One that stands on n of m pages has importance 1 - log_m n; the
   place's is the mean over its contents.
3. Composite importance goes from the leaves up: (1 - g) * presentation + g * (mean over the own contents and the
   child places), g = DECAY ** (number of styles). Written out, it is a sum over the places below, weighted by the
   product of the shares on the way, so one pass of aggregation does all levels.

Blocks go if their content, or any place on their path, lies below the importance threshold (inside an article or
main part importance counts ``ARTICLE_WEIGHT`` times), along with what is no article by its markup: menus, headers,
footers, asides, forms, scripts, styles, and elements whose class, id or role names an advert, notice, sidebar or
comments. Adverts and comments that differ from page to page have high importance, so the tree can't tell them; the
names can. The name list never takes out a main part, and of an article only one that names itself a comment or
teaser. If the tree would leave nothing of a page's article and nothing else stands on the page, the article stays.

Hot hosts are counted by partial aggregation over (host, place, style or content), and pages meet their host's short
list of noise places and contents over salted keys, so no host's pages are gathered in one task.

Defined results: null or empty html gives an empty text. A ``br`` is white space. Unclosed and stray tags are
tolerated: a block's start closes an open paragraph, an unclosed inline tag doesn't matter, an open comment,
script or tag at the end hides the rest. Repeated rows stay repeated. Other input columns are not carried. A host
with under ``min_pages`` different pages is judged by markup alone.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.session import written

MIN_PAGES = 4  # different pages of a host with a node before the tree decides about it
MIN_IMPORTANCE = 0.2
ARTICLE_WEIGHT = 2.0  # of importance inside an article
DECAY = 0.9  # what a presentation style leaves to the contents below
TREE_DEPTH = 16
SALTS = 32

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
NAMED = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements by role: fixed values of HTML.
RAW = {"script", "style", "textarea", "title", "xmp", "noscript", "iframe", "noembed", "noframes", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "label"}
NOISE = {"nav", "menu", "footer", "aside", "form", "button", "select", "option", "input", "fieldset", "dialog", "head", "svg", "canvas", "object", "audio", "video", "map", "math"}
CLOSES_P = {"address", "article", "aside", "blockquote", "center", "details", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
PROSE = {"article", "main", "p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "ul", "ol", "dl", "dt", "dd", "table", "tbody", "thead", "tfoot", "tr", "td", "th", "figure", "figcaption", "section", "div"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Parts of class and id names by what they say: fixed values.
NOISE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsbygoogle banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus disclaimer footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget widgets".split()
)
NEUTRAL_WORDS = set("and area article bar block bottom box container entry form global group header inner item items left link links list main outer page post posts primary right row secondary section site slot sticky top unit wrap wrapper".split())
SUB_ARTICLE = {"ad", "ads", "advert", "advertisement", "comment", "promo", "promoted", "related", "reply", "sponsored", "teaser"}
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert"}
BLOCK = "struct<node:long,text:string,article:boolean>"
PLACE = "struct<node:long,style:long,article:boolean,path:array<long>>"
PARSED = f"page_id long, url string, host string, body_hash long, blocks array<{BLOCK}>, places array<{PLACE}>"


@functools.lru_cache(1 << 14)
def _names(attributes: str) -> tuple[str, bool, bool]:
    """(first class, a noise name or role, a name of a small article) of an element's attributes."""
    first, noise, small = "", False, False
    for m in NAMED.finditer(attributes):
        kind, words = m[1].lower(), (m[2] or m[3] or m[4] or "").split()
        if kind == "class" and words and not first:
            first = words[0]
        for w in words:
            parts = [p for p in re.split(r"[_-]+", w.lower()) if p and not p.isdigit()]
            if kind == "role":
                noise |= w.lower() in NOISE_ROLES
            elif any(p in NOISE_WORDS for p in parts) and all(p in NOISE_WORDS or p in NEUTRAL_WORDS or p[0].isdigit() for p in parts):
                noise = True
                small |= any(p in SUB_ARTICLE for p in parts)
            elif w.lower() in SUB_ARTICLE:
                small = True
    return first, noise, small


class _Open:
    __slots__ = ("article", "children", "depth", "kind", "node", "noise", "path", "tag", "used")

    def __init__(self, tag: str, attributes: str, above: _Open | None) -> None:
        import xxhash

        self.tag = tag
        first, named, small = _names(attributes) if attributes else ("", False, False)
        self.kind = f"{tag}.{first}"
        self.depth = above.depth + 1 if above else 1
        self.article = bool(above and above.article) or tag in ("article", "main")
        if above and self.depth > TREE_DEPTH:
            self.node, self.path = above.node, above.path
        else:
            self.node = xxhash.xxh3_64_intdigest(self.kind.encode("utf-8", "surrogatepass"), above.node & (1 << 64) - 1 if above else 0) - (1 << 63)
            self.path = (*above.path, self.node) if above else (self.node,)
        if above:
            above.children = xxhash.xxh3_64_intdigest(self.kind.encode("utf-8", "surrogatepass"), above.children)
        self.children, self.used = 0, False
        own = tag in NOISE or (tag == "header" and not self.article)
        if tag == "article":
            own = own or small
        elif tag not in ("html", "body", "main"):
            own = own or named
        self.noise = bool(above and above.noise) or own or bool(above and above.tag == "header" and above.article and tag not in HEADINGS | INLINE | PROSE)


def parsed_page(html: str | None) -> tuple[list[tuple[int, str, bool]], list[tuple[int, int, bool, tuple[int, ...]]]]:
    """Blocks of text that aren't noise by their markup: (place, text, in an article); and the places above them:
    (place, style, in an article, path)."""
    if not html:
        return [], []
    out: list[tuple[int, str, bool]] = []
    places: dict[tuple[int, int], tuple[int, int, bool, tuple[int, ...]]] = {}
    stack: list[_Open] = []
    text: list[str] = []

    def flush() -> None:
        if text:
            if words := unescape("".join(text)).split():
                top = stack[-1] if stack else None
                if not (top and top.noise):
                    out.append((top.node if top else 0, " ".join(words), bool(top and top.article)))
                    for x in reversed(stack):
                        if x.used:
                            break
                        x.used = True
            text.clear()

    def close(upto: int) -> None:
        flush()
        for x in stack[upto:]:
            if x.used:
                places[x.node, x.children] = (x.node, x.children - (1 << 63), x.article, x.path)
        del stack[upto:]

    at = 0
    while at < len(html):
        m = TOKEN.search(html, at)
        if not m:
            text.append(html[at:])
            break
        if m.start() > at:
            text.append(html[at : m.start()])
        at = m.end()
        end, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
            continue
        if end:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
            else:
                flush()
            continue
        if tag in RAW:
            if not rest.rstrip().endswith("/"):
                found = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
                at = found.end() if found else len(html)
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in ("td", "th", "li", "article", "section", "div", "body"):
                    break
        if tag in SAME:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in SAME[tag]:
                    close(i)
                    break
                if stack[i].tag in ("ul", "ol", "dl", "table", "select", "tbody", "thead"):
                    break
        flush()
        if tag not in VOID:
            stack.append(_Open(tag, rest or "", stack[-1] if stack else None))
    close(0)
    return out, list(places.values())


def blocks_of(html: str | None) -> list[tuple[int, str, bool]]:
    return parsed_page(html)[0]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    def signed(s: str) -> int:
        return xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)

    block = pa.list_(pa.struct([("node", pa.int64()), ("text", pa.string()), ("article", pa.bool_())]))
    place = pa.list_(pa.struct([("node", pa.int64()), ("style", pa.int64()), ("article", pa.bool_()), ("path", pa.list_(pa.int64()))]))
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            hashes, lists, trees = [], [], []
            for html in part["html"].to_pylist():
                found, places = parsed_page(html)
                hashes.append(signed("\n".join(x[1] for x in [x for x in found if x[2]] or found)))
                lists.append([{"node": n, "text": t, "article": a} for n, t, a in found])
                trees.append([{"node": n, "style": st, "article": a, "path": p} for n, st, a, p in places])
            yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], part["host"], pa.array(hashes, pa.int64()), pa.array(lists, block), pa.array(trees, place)], ["page_id", "url", "host", "body_hash", "blocks", "places"])


def parse_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Blocks by page; the host is what follows ``://``, lower-cased, or empty."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))
    own = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), host.alias("host"), F.col(html).alias("html"))
    return own.mapInArrow(_parse, PARSED)


def style_tree(parsed: DataFrame, min_pages: int = MIN_PAGES, decay: float = DECAY) -> tuple[DataFrame, DataFrame]:
    """The site style tree: (places, contents). The host is given by its hash.

    Places: host, node, article, path, pages, presentation, content (null without texts), importance. Contents that
    stand on several pages: host, node, content, article, n, pages, importance. A place on under ``min_pages`` pages
    counts as important and isn't listed among the contents.
    """
    rows = parsed.select(F.xxhash64("host").alias("host"), "body_hash", "blocks", "places")
    # pages of equal body count once; each style and content of a page once
    styles = rows.select("host", "body_hash", F.explode("places").alias("p")).select("host", "body_hash", "p.node", "p.style", "p.article", "p.path")
    styles = styles.groupBy("host", "node", "style", "body_hash").agg(F.first("article").alias("article"), F.first("path").alias("path"))
    styles = styles.groupBy("host", "node", "style").agg(F.count("*").alias("n"), F.first("article").alias("article"), F.first("path").alias("path"))
    pages = rows.select("host", "body_hash", F.explode(F.array_distinct(F.transform("places", lambda p: p["node"]))).alias("node")).distinct().groupBy("host", "node").agg(F.count("*").alias("pages"))
    shown = styles.groupBy("host", "node").agg(F.count("*").alias("styles"), F.sum("n").alias("all"), F.sum(F.col("n") * F.log("n")).alias("n_log_n"), F.first("article").alias("article"), F.first("path").alias("path"))
    seen = rows.select("host", "body_hash", F.explode("blocks").alias("b")).select("host", F.col("b.node").alias("node"), F.xxhash64("b.text").alias("content"), F.col("b.article").alias("article"), "body_hash").distinct()
    contents = seen.groupBy("host", "node", "article", "content").agg(F.count("*").alias("n"))
    texts = contents.groupBy("host", "node").agg(F.avg(F.log("n")).alias("mean_log"))
    nodes = shown.join(pages, ["host", "node"]).join(texts, ["host", "node"], "left")

    known = F.col("pages") >= min_pages
    entropy = F.log("all") - F.col("n_log_n") / F.col("all")  # of the shares n / all
    nodes = nodes.withColumns({
        "presentation": F.when(known, F.least(F.lit(1.0), entropy / F.log("pages"))).otherwise(1.0),
        "content": F.when(F.col("mean_log").isNotNull(), F.when(known, 1 - F.col("mean_log") / F.log("pages")).otherwise(1.0)),
        "g": F.when(known, F.pow(F.lit(decay), F.col("styles"))).otherwise(0.0),
        "above": F.when(F.size("path") > 1, F.element_at("path", -2)),
    }).drop("mean_log", "all", "n_log_n", "styles")
    nodes = written(nodes, "places")

    # what a place passes on to each of its parts: g / (child places + own contents)
    below = nodes.where("above IS NOT NULL").groupBy("host", F.col("above").alias("node")).agg(F.count("*").alias("children"))
    nodes = nodes.join(below, ["host", "node"], "left").withColumn("parts", F.greatest(F.lit(1), F.coalesce("children", F.lit(0)) + F.when(F.col("content").isNotNull(), 1).otherwise(0)))
    own = (1 - F.col("g")) * F.col("presentation") + F.coalesce(F.col("g") / F.col("parts") * F.col("content"), F.lit(0.0))
    share = F.when(F.col("g") > 0, F.log(F.col("g") / F.col("parts")))  # null: nothing is passed on
    nodes = written(nodes.select("host", "node", "article", "path", "pages", "presentation", "content", own.alias("own"), share.alias("share")), "places")
    up = nodes.select("host", "node", "own", F.size("path").alias("depth"), F.posexplode("path").alias("pos", "at"))
    up = up.join(nodes.select("host", F.col("node").alias("at"), F.col("share").alias("step")), ["host", "at"])
    # log of the product of the shares from each place on the path down to the node; null steps end it
    path = F.array_sort(F.collect_list(F.struct("pos", "at", "step")))
    down = up.groupBy("host", "node", "own", "depth").agg(path.alias("up"))
    weight = "aggregate(slice(up, i + 1, size(up) - i - 1), 0D, (a, x) -> a + x.step)"
    parts = down.select("host", "own", F.explode(F.expr(f"transform(up, (u, i) -> named_struct('node', u.at, 'weight', exp({weight})))")).alias("e"))
    importance = parts.groupBy("host", F.col("e.node").alias("node")).agg(F.sum(F.coalesce(F.col("own") * F.col("e.weight"), F.lit(0.0))).alias("importance"))
    places = written(nodes.drop("own", "share").join(importance, ["host", "node"]), "tree")

    # a content on one page only has importance 1, and so goes only with its place
    leaves = contents.where("n > 1").join(pages.where(F.col("pages") >= min_pages), ["host", "node"])
    return places, leaves.withColumn("importance", 1 - F.log("n") / F.log("pages"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, min_importance: float = MIN_IMPORTANCE, salts: int = SALTS) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    parsed = written(parse_pages(pages, page_id, url, html), "blocks")
    least = F.when(F.col("article"), min_importance / ARTICLE_WEIGHT).otherwise(min_importance)
    places, leaves = style_tree(parsed, min_pages)
    # a place goes with any place above it
    low = places.where((F.col("importance") < least) & (F.col("pages") >= min_pages)).select("host", F.col("node").alias("at"))
    gone = places.where("content IS NOT NULL").select("host", "node", F.explode("path").alias("at")).join(low, ["host", "at"], "left_semi")
    gone = gone.groupBy("host").agg(F.collect_set("node").alias("nodes"))
    same = leaves.where(F.col("importance") < least).groupBy("host").agg(F.collect_set(F.struct("node", "content")).alias("contents"))
    noise = written(gone.join(same, "host", "full").select("host", F.coalesce("nodes", F.array().cast("array<long>")).alias("nodes"), F.coalesce("contents", F.array().cast("array<struct<node:long,content:long>>")).alias("contents")), "noise")
    lists = noise.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = parsed.drop("places").withColumns({"host": F.xxhash64("host"), "salt": F.pmod(F.xxhash64("page_id", "body_hash"), F.lit(salts)).cast("int")})
    judged = dealt.join(lists, ["host", "salt"], "left")
    keep = F.filter("blocks", lambda b: ~F.array_contains("nodes", b["node"]) & ~F.array_contains("contents", F.struct(b["node"].alias("node"), F.xxhash64(b["text"]).alias("content"))))
    kept = F.when(F.col("nodes").isNull(), F.col("blocks")).otherwise(keep)
    articles = F.filter("blocks", lambda b: b["article"])
    judged = judged.withColumn("kept", kept).select("page_id", "url", F.when(F.size("kept") > 0, F.col("kept")).otherwise(articles).alias("blocks"))
    text = F.array_join(F.transform("blocks", lambda b: b["text"]), "\n")
    return judged.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
