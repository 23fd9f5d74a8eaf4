"""HTML extraction with a site style tree.

The pages of a host are merged into one tree: a node is a path of elements (tag, class, id and role, digits as 0), and holds what all pages of the host show there.
A node's importance comes from entropy, to the base of the node's pages and DOUBT more, so that few pages say little and no number of pages turns the method on or off. Content: the more of its pages share a text, the less it says of a page; a node's content importance is 1 less the mean of log(pages with the text), by volume of text. Presentation: the entropy of the different sequences of children. A node with children takes half of its importance from its own presentation and half from the content of its whole branch; a leaf all from its content.
Names are one more input, which weighs the importance. A tag, role or whole class or id token on the way that names what is not the article (menus, headers outside it, footers, sidebars, notices, adverts, forms, comments) multiplies importance by NOISE, and an article or main element lifts it to its third root. On a host without any text in article or main elements, a named branch that holds over half of all text is less and less taken for its name, and one that holds all of it not at all: it is where the text is.
A branch goes, as a whole, if its importance and that of all nodes in it are low. Entropy decides on branches, not on one repeated heading, byline or caption among paragraphs that differ: a text element (TEXT) without a noise name goes only if the branch that it stands in, that of the nearest element around it of another kind, has low content importance as well; and nothing in an article or main element goes but by a name. An article or main element takes back what a class, an id or a form around it says, not what nav, aside, footer, a role or hidden says.
On hosts where each menu or advert has words of its own, as in the test tables, entropy can't tell them from an article, and their names decide; text that repeats over a host goes without any name.
Scripts, styles and other elements without text never enter the tree.

Pages are parsed once, into blocks of text and digests, in the shared folder; only digests and counts enter the tree. What goes is a list for each kind of page (host and set of paths), so it is no longer than a page, however many paths a host has.

Nulls: a null or empty page has the text ''; pages without a host are one site. Pages of a host that show the same blocks (repeated rows, mirrors, variants of a url) count as one page in the tree, and each gets its text; extra columns are ignored. Whole pages are parsed, in a time that grows with their length; unclosed and stray tags are tolerated, an unclosed comment, script or tag ends with the page. A quote in a tag that is not closed, or only behind other tags, does not hide these. Elements nested deeper than DEPTH belong to the one at that depth.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_pieces, saved

#: A branch goes below this weighed importance; a noise name multiplies importance by NOISE; entropy is to the base of a node's pages and DOUBT; paths end at DEPTH.
LEAST_IMPORTANCE, NOISE, DOUBT, DEPTH = 0.35, 0.2, 6, 100

RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "object", "textarea", "title", "xmp", "noembed", "noframes"}
TEXT = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "blockquote", "pre", "figure", "figcaption", "caption", "address", "hgroup", "summary"}
SILENT = {"script", "style", "noscript", "template", "svg", "math"}  #: these break no line of text
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "img"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "dialog", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
CLOSES_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
NOISE_TAGS = {"head", "nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "option", "fieldset", "canvas", "audio", "video", "input", "search"} | RAW
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"}
NOISE_NAME = re.compile(r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|sidebar|widget|footer|foot|header|masthead|topbar|toolbar|notices?|alert|cookies?|consent|gdpr|popup|modal|overlay|newsletter|subscri\w*|signup|login|share|sharing|social|related|recommend\w*|comments?|commentlist|replies|reply|respond|disqus|pagination|pager|copyright|legal|disclaimer|tags|toc|form|search", re.I)
#: Parts of a class or id that leave a noise name what it is (site-nav, comment-list); any other part makes it another name (has-sidebar, page-with-toc).
PLAIN_PARTS = {"site", "main", "page", "global", "top", "bottom", "left", "right", "primary", "secondary", "list", "item", "items", "box", "block", "wrap", "wrapper", "container", "inner", "outer", "area", "section", "bar", "links", "link", "posts", "buttons", "button", "body", "text", "icons", "message", "unit", "slot"}
PARTS = re.compile(r"[\s_-]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
PROTECT = {"article", "main"}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
UNQUOTED = re.compile(r"[^>\"']*")
#: In a quoted value, the end of a tag and another tag behind it: the quote was left open.
OPEN_QUOTE = re.compile(r">[^<]*</?[a-zA-Z]")
ATTR = re.compile(r"\b(class|id|role|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
DIGITS = re.compile(r"\d+")


def noise_names(value: str) -> list[str]:
    """The noise names among the whole tokens of a class or id."""
    out: list[str] = []
    for token in value.split():
        parts = [x.lower() for x in PARTS.split(CAMEL.sub("-", token)) if x and not x.isdigit()]
        found = [x for x in parts if NOISE_NAME.fullmatch(x)]
        if found and all(x in PLAIN_PARTS or NOISE_NAME.fullmatch(x) for x in parts):
            out += found
        elif parts == ["side"]:
            out += parts
    return out


def tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """The place of the > that ends a tag whose name ends at a place, -1 if there is none. last: the last place of each of > " ' in the page."""
    start = at
    while at <= last[">"]:
        at = UNQUOTED.match(page, at).end()
        if at > last[">"]:
            break
        c = page[at]
        if c == ">":
            return at
        end = page.find(c, at + 1) if at < last[c] else -1
        # where the value would hold a whole tag, its quote was left open
        if end < 0 or OPEN_QUOTE.search(page, at + 1, end):
            return page.find(">", at)
        at = end + 1
    return page.find(">", start) if start <= last[">"] else -1


def blocks(page: str) -> list[tuple[tuple[int, ...], int, bool, str]]:
    """The text blocks of a page in order: path (digests of the way to each element on it), the path's length up to the element whose name marks it as noise (0: none), whether it is in an article, text with its references decoded."""
    out: list[tuple[tuple[int, ...], int, bool, str]] = []
    # tag, path, noise (1 by a class, an id or a form, which an article or main element inside takes back; 2 by another tag, a role or hidden), length of the path where that began, protected, whether it is a block
    stack: list[tuple[str, tuple[int, ...], int, int, bool, bool]] = [("", (0,), 0, 0, False, True)]
    is_open: Counter[str] = Counter()
    held: list[str] = []
    at, n = 0, len(page)
    last = {c: page.rfind(c) for c in ">\"'"}

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                _, path, _, mark, kept, _ = next(s for s in reversed(stack) if s[5])
                out.append((path, mark, kept, text))

    def pop(to: int) -> None:
        if any(s[5] for s in stack[to:]):
            flush()
        is_open.subtract(s[0] for s in stack[to:])
        del stack[to:]

    def push(tag: str, name: str, noise: int, protected: bool, block: bool) -> None:
        _, path, _, mark, _, _ = stack[-1]
        if name and len(path) < DEPTH:
            path = (*path, digest(f"{path[-1]}>{name}") & ~1 | (tag in TEXT))  # an odd number for a text element
        is_open[tag] += 1
        stack.append((tag, path, noise, (mark or len(path)) if noise else 0, protected, block))

    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                held.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag, end = tag.lower(), tag_end(page, at, last)
        if end < 0:
            break
        given, at = page[at:end], end + 1
        if m[1]:
            for k in range(len(stack) - 1, 0, -1) if is_open[tag] else ():
                if stack[k][0] == tag:
                    pop(k)
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
            else:
                if tag == "p":
                    flush()
            continue
        if tag == "br" or tag == "wbr":
            held.append(" " if tag == "br" else "")
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1) if is_open["p"] else ():
                if stack[k][0] == "p":
                    pop(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        if tag in CLOSES_SAME:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag or tag in ("dt", "dd") and stack[k][0] in ("dt", "dd") or tag in ("td", "th") and stack[k][0] in ("td", "th"):
                    pop(k)
                    break
                if stack[k][0] in CLOSES_SAME[tag]:
                    break
        if tag not in INLINE and tag not in SILENT:
            flush()
        if tag in VOID or tag in ("svg", "math") and given.rstrip().endswith("/"):
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*[^>]*>", re.I).search(page, at)
            at = close.end() if close else n
            continue
        _, _, noise, _, protected, _ = stack[-1]
        if tag in INLINE and "=" not in given:
            push(tag, "", noise, protected, False)
            continue
        name = tag
        attrs = [(a[1].lower(), a[2] or a[3] or a[4] or "") for a in ATTR.finditer(given)]
        if noise == 1 and not protected and (tag in PROTECT or ("role", "main") in [(k, v.strip().lower()) for k, v in attrs]):
            noise = 0
        outer = noise
        for key, value in attrs:
            if key == "role":
                noise = max(noise, (1 if value.strip().lower() == "form" else 2) * (value.strip().lower() in NOISE_ROLES))
                protected |= value.strip().lower() == "main"
                name += f"[{value.strip().lower()}]"
            elif key == "hidden":
                noise = 2
                name += "[hidden]"
            else:
                if tag not in ("html", "body", "article", "main"):
                    noise = max(noise, int(any(not (protected and f in ("header", "footer", "head")) for f in noise_names(value))))  # an article has a header of its own
                name += ("." if key == "class" else "#") + DIGITS.sub("0", value.strip())
        if tag in INLINE:
            apart = noise > 0 and not outer  # a block of its own, so that it can go alone
            if apart:
                flush()
            push(tag, name if apart else "", noise, protected, apart)
            continue
        noise = max(noise, 1 if tag in ("form", "fieldset") else 2 if tag in NOISE_TAGS or tag == "header" and not protected else 0)
        push(tag, name, noise, protected or tag in PROTECT, True)
    flush()
    return out


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


#: What the parse leaves of a page: its blocks; the nodes on their ways (with the node of the noise name, 0 if none, and the nodes above); what is seen at each (kind 1 a text, with its length, 2 a sequence of children).
PARSED = "same long, kind long, ids array<long>, texts array<string>, nodes array<struct<node: long, shows: boolean, mark: long, kept: boolean, up: array<long>>>, seen array<struct<node: long, kind: int, what: long, volume: long>>"


def parsed(pages: DataFrame, host_of: str, html_col: str, keep: list[str]) -> DataFrame:
    """Each page's kept columns (row), host and PARSED, in the shared folder. Pages that show the same blocks have the same `same`; `kind` stands for the set of paths."""
    src = pages.select(F.struct(*keep).alias("row"), F.expr(host_of).alias("host"), F.col(html_col).alias("t"))
    row_kind = src.schema["row"].dataType.simpleString()
    names = ["same", "kind", "ids", "texts", "nodes", "seen"]

    def one(page: str | None) -> tuple:
        nodes: dict[int, dict] = {}
        children: dict[int, list[int]] = {}
        seen: dict[tuple[int, int], int] = {}
        above: dict[int, tuple[int, ...]] = {}
        shown = blocks(page or "")
        for path, mark, kept, text in shown:
            seen[path[-1], digest(text)] = len(text)
            nodes[path[-1]] = {"node": path[-1], "shows": True, "mark": path[mark - 1] if mark else 0, "kept": kept, "up": list(path[:-1])}
            for k in range(1, len(path)):
                kids = children.setdefault(path[k - 1], [])
                above.setdefault(path[k - 1], path[: k - 1])
                if not kids or kids[-1] != path[k]:
                    kids.append(path[k])
        for node, kids in children.items():
            if node not in nodes:
                nodes[node] = {"node": node, "shows": False, "mark": 0, "kept": False, "up": list(above[node])}
        rows = [{"node": node, "kind": 1, "what": what, "volume": n} for (node, what), n in seen.items()]
        rows += [{"node": node, "kind": 2, "what": digest(" ".join(map(str, kids))), "volume": 0} for node, kids in children.items()]
        return digest("\0".join(f"{p[-1]}\0{t}" for p, _, _, t in shown)), digest(" ".join(map(str, sorted({p[-1] for p, _, _, _ in shown})))), [p[-1] for p, _, _, _ in shown], [t for _, _, _, t in shown], list(nodes.values()), rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.struct([("node", pa.int64()), ("shows", pa.bool_()), ("mark", pa.int64()), ("kept", pa.bool_()), ("up", pa.list_(pa.int64()))])), pa.list_(pa.struct([("node", pa.int64()), ("kind", pa.int32()), ("what", pa.int64()), ("volume", pa.int64())]))]
        for b in in_pieces(batches, "t", 2 << 20):
            got = [one(page) for page in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(zip(*got, strict=True), kinds, strict=True))], ["row", "host", *names])

    return saved(src.mapInArrow(run, f"row {row_kind}, host string, {PARSED}"), "pages", codec="zstd")


def site_style_tree(pages: DataFrame) -> DataFrame:
    """(host, node, shows, n_pages, importance, weighed, spared, branch): the nodes of the merged trees of all hosts; branch is the highest weighed importance of the node and all below it, and a spared node stays whatever that is. pages: as parsed."""
    seen = pages.select("host", "same", F.explode("seen").alias("s")).select("host", "same", "s.*")
    counts = seen.groupBy("host", "node", "kind", "what", "volume").agg(F.count_distinct("same").alias("n"))
    share = F.col("n") * F.col("volume")
    own = counts.groupBy("host", "node").agg(
        F.sum(F.when(F.col("kind") == 1, share)).alias("volume"),
        F.sum(F.when(F.col("kind") == 1, share * F.ln("n"))).alias("content_log"),
        F.sum(F.when(F.col("kind") == 2, F.col("n"))).alias("styles"),
        F.sum(F.when(F.col("kind") == 2, F.col("n") * F.ln("n"))).alias("style_log"),
    )
    nodes = pages.select("host", "same", F.explode("nodes").alias("x")).select("host", "same", "x.*")
    nodes = nodes.groupBy("host", "node").agg(F.max("shows").alias("shows"), F.max(F.col("mark")).alias("mark"), F.max("kept").alias("kept"), F.first("up").alias("up"), F.count_distinct("same").alias("n_pages"))
    base = F.ln(F.col("n_pages") + F.lit(float(DOUBT)))
    style = (F.ln("styles") - F.col("style_log") / F.col("styles")) / base
    nodes = saved(nodes.join(own, ["host", "node"]).select("host", "node", "shows", "mark", "kept", "up", "n_pages", F.coalesce("volume", F.lit(0)).alias("volume"), (F.col("volume") * (1 - F.col("content_log") / F.col("volume") / base)).alias("content"), style.alias("style")), "nodes")

    # each node gives to all above it and to itself
    above = nodes.select("host", F.explode(F.concat("up", F.array("node"))).alias("node"), "volume", "content", F.when(F.col("kept"), F.col("volume")).alias("in_article"))
    whole = above.groupBy("host", "node").agg(F.sum("volume").alias("below"), F.sum("content").alias("content_below"), F.sum("in_article").alias("in_article"))
    site = whole.where("node = 0").select("host", F.col("below").alias("all"), F.coalesce("in_article", F.lit(0)).alias("articles"))
    whole = saved(whole.select("host", "node", "below", "content_below"), "branches")
    found = nodes.drop("volume", "content").join(whole, ["host", "node"]).join(site, "host")
    found = found.join(whole.select("host", F.col("node").alias("mark"), F.col("below").alias("marked")), ["host", "mark"], "left")
    content = F.col("content_below") / F.col("below")
    importance = F.when(F.col("style").isNull(), content).otherwise((content + F.col("style")) / 2)
    most = F.when(F.col("articles") > 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 2 * F.col("marked") / F.col("all") - 1))
    weighed = F.when(F.col("mark") != 0, F.col("importance") * F.pow(F.lit(NOISE), 1 - most)).when(F.col("kept"), F.pow(F.greatest("importance", F.lit(0.0)), F.lit(1 / 3))).otherwise(F.col("importance"))
    # a text element belongs to the branch of the nearest other element around it
    owner = F.when(F.col("node") % 2 != 0, F.element_at(F.filter("up", lambda n: n % 2 == 0), -1))
    found = found.withColumn("importance", importance).withColumn("weighed", weighed).withColumn("owner", owner)
    around = whole.select("host", F.col("node").alias("owner"), (F.col("content_below") / F.col("below")).alias("around"))
    spared = (F.col("mark") == 0) & (F.col("kept") | (F.coalesce("around", F.lit(0.0)) >= LEAST_IMPORTANCE))
    found = saved(found.join(around, ["host", "owner"], "left").select("host", "node", "shows", "up", "n_pages", "importance", "weighed", spared.alias("spared")), "tree")
    branch = found.select("host", F.explode(F.concat("up", F.array("node"))).alias("node"), "weighed").groupBy("host", "node").agg(F.max("weighed").alias("branch"))
    return found.drop("up").join(branch, ["host", "node"])


def host_sql(url_col: str) -> str:
    return f"lower(regexp_extract(coalesce(`{url_col}`, ''), '^[^:/?#]*://([^/?#]*)', 1))"


def extract_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of each page with text and n_chars."""
    keep = [c for c in pages.columns if c != html_col] if keep is None else keep
    table = parsed(pages, host_sql(url_col), html_col, keep)
    low = site_style_tree(table).where((F.col("branch") < LEAST_IMPORTANCE) & F.col("shows") & ~F.col("spared")).select("host", "node")
    kinds = table.groupBy("host", "kind").agg(F.first("ids").alias("ids")).select("host", "kind", F.explode(F.array_distinct("ids")).alias("node"))
    gone = saved(kinds.join(low, ["host", "node"]).groupBy("host", "kind").agg(F.collect_set("node").alias("gone")), "gone")
    out = table.select("row", "host", "kind", "ids", "texts").join(gone, ["host", "kind"], "left")
    left = F.when(F.col("gone").isNull(), F.col("texts")).otherwise(F.transform(F.filter(F.arrays_zip("ids", "texts"), lambda z: ~F.array_contains("gone", z["ids"])), lambda z: z["texts"]))
    text: Column = F.array_join(left, "\n")
    return out.select("row.*", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"), keep=["page_id", "url"])
