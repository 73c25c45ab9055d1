"""Main text of web pages by site style trees.

The pages of a host are merged into one tree: its nodes are the paths of block elements (tag and class or id names),
and each has the pages it occurs in, the kinds of children it was given (presentation) and the texts it held (content).
A node's importance mixes the entropy of its presentations with that of its texts: a text that every page repeats has
none, one that a single page holds has all. Copies of a page (equal blocks) count as one page. Branches whose best node is below a threshold are removed from every page
of the host, together with elements that say themselves that they are no content (navigation, scripts, adverts ...).
A page's own article or main element, where it has one, bounds its text; in it the style tree only judges containers.

Edge cases: null html counts as empty and gives an empty text; pages with a null or odd url share one nameless host; a
host with one page has no low branch; unclosed, crossed and stray tags are closed as browsers do for the common cases; repeated rows get
equal texts; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Work, arrow_map, batch, parts, pick

#: The share of the presentation in a node's importance; below LOW a branch goes; fewer pages than this judge nothing.
PRESENTATION, LOW, PAGES = 0.1, 0.2, 4

# Elements by how they are read, and the names by which elements say what they are.
RAW = {"script", "style", "template", "noscript", "iframe", "svg", "object", "canvas", "video", "audio", "head", "title", "textarea", "select", "xmp", "noembed", "noframes"}
NOISE = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "fieldset", "input", "option", "datalist"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
NAMES = {"ad", "ads", "adbox", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie", "cookies", "disqus", "discussion", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo", "promoted", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget", "alert", "disclaimer"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog", "toolbar"}
#: An opening of one of these ends an open one of those.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul", "li"}
SCOPES = {"table", "ul", "ol", "dl", "article", "section", "div", "main", "aside", "td", "th", "blockquote"}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_ROOT = re.compile(r"<(?:article|main)\b", re.I)
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}


class Element:
    __slots__ = ("tag", "path", "noise", "root", "inside", "hidden")

    def __init__(self, tag: str, path: str, noise: bool, root: bool, inside: bool, hidden: bool = False):
        self.tag, self.path, self.noise, self.root, self.inside, self.hidden = tag, path, noise, root, inside, hidden


def _hides(attributes: str) -> bool:
    said = {k.lower(): next((x for x in v if x), "").lower() for k, *v in _ATTRIBUTE.findall(attributes)}
    return "hidden" in said or said.get("aria-hidden") == "true" or bool(_HIDDEN.search(said.get("style", "")))


def _named(tag: str, attributes: str, within: bool) -> tuple[str, bool]:
    """An element's name in the style tree, and whether it says that it is no content: by its tag, its attributes, or a class or id word made of NAMES alone."""
    noise = tag in NOISE or (tag == "header" and not within)
    if not attributes or attributes.isspace():
        return tag, noise
    said, names, words = {}, [], []
    for key, *values in _ATTRIBUTE.findall(attributes):
        said.setdefault(key.lower(), next((v for v in values if v), ""))
    for key in ("class", "id"):
        for word in entities.unescape(said.get(key, "")).lower().split():
            parts = _NAME.findall(word)
            names += parts
            words += ["-".join(parts)] if not NAMES.issuperset(parts) else parts
    if not noise:
        noise = "hidden" in said or said.get("aria-hidden", "").lower() == "true" or said.get("role", "").lower() in ROLES or bool(_HIDDEN.search(said.get("style", "").lower()))
        noise = noise or (tag not in ("body", "html", "article", "main") and (not NAMES.isdisjoint(words) or not within and "header" in words)) or (tag == "article" and not {"comment", "comments", "reply", "ad", "ads", "promo", "sponsored", "related"}.isdisjoint(words))
    return ".".join([tag, *sorted(set(names))]), noise


def blocks(page: str) -> list[tuple[str, bool, str]]:
    """The blocks of text in page order that no element disowns: (path, whether in an article or main element, text). An element that holds the page's article or main is not disowned."""
    found = _blocks(page, False)
    if not any(inside for _, inside, _ in found) and _ROOT.search(page):
        # All articles are in disowned elements: the page's own, if there is more in them than outside; else only teasers.
        owned = [b for b in _blocks(page, True) if b[1]]
        if sum(len(t) for *_, t in owned) > sum(len(t) for *_, t in found):
            return owned
    return found


def _blocks(page: str, roots: bool) -> list[tuple[str, bool, str]]:
    """With roots, article and main elements that don't disown themselves are held whatever they are in, unless it is hidden."""
    out, stack, held = [], [Element("", "", False, False, False)], []

    def end_block() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((stack[-1].path, stack[-1].inside, text))

    def leave(n: int) -> None:
        end_block()
        del stack[n:]

    at = 0
    while True:
        m = _TAG.search(page, at)
        if not stack[-1].noise:
            part = page[at : m.start()] if m else page[at:]
            if part:
                held.append(part)
        if not m:
            break
        at = m.end()
        close, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if close:
            if tag in INLINE and not any(e.tag == tag for e in stack[-3:]):
                continue
            for n in range(len(stack) - 1, 0, -1):
                if stack[n].tag == tag:
                    leave(n)
                    break
            continue
        if tag == "body" and any(e.tag == "body" for e in stack):
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                if tag == "head":
                    ended = re.compile(r"</head\s*>|<body[\s>]", re.I).search(page, at)
                    at = (ended.end() if ended[0][1] == "/" else ended.start()) if ended else len(page)
                else:
                    ended = _RAW_END[tag].search(page, at)
                    at = ended.end() if ended else len(page)
            held.append(" " if held else "")
            continue
        if tag in VOID:
            if tag in ("br", "hr", "img", "embed"):
                held.append(" " if tag != "hr" else "")
                if tag == "hr":
                    end_block()
            continue
        name, noise = _named(tag, attributes.rstrip("/"), stack[-1].inside)
        if tag in INLINE and not noise and not stack[-1].noise:
            continue
        if tag in CLOSES_P:
            for n in range(len(stack) - 1, 0, -1):
                if stack[n].tag == "p":
                    leave(n)
                    break
                if stack[n].tag in SCOPES:
                    break
        if tag in ENDS:
            for n in range(len(stack) - 1, 0, -1):
                if stack[n].tag in ENDS[tag]:
                    leave(n)
                    break
                if stack[n].tag in SCOPES:
                    break
        end_block()
        up = stack[-1]
        root = tag in ("article", "main")
        if roots and root and not noise and up.noise and not any(e.hidden for e in stack):
            up = Element(up.tag, up.path, False, up.root, up.inside)
        stack.append(Element(tag, f"{up.path}/{name}", up.noise or noise, root, up.inside or (root and not noise), roots and _hides(attributes)))
    end_block()
    return out


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#\s]*)", url or "")
    return m[1].rpartition("@")[2].lower().partition(":")[0] if m else ""


def branches(path: str) -> list[str]:
    """The path and all above it, but for the root."""
    parts = path.split("/")[1:]
    return ["/" + "/".join(parts[: k + 1]) for k in range(len(parts))]


#: Containers that the style tree may judge inside an article; its paragraphs and headings are the article itself.
_JUDGED = re.compile(r"/(?:article|main)\b[^/]*.*/(?:div|section|ul|ol|table|dl|details|figure)\b")


def main_text(found: list[tuple[str, bool, str]], low: set[str]) -> str:
    """The text of a page from its blocks, without the branches in low."""
    if any(inside for _, inside, _ in found):
        found = [b for b in found if b[1]]
        return " ".join(t for p, _, t in found if p not in low or not _JUDGED.search(p))
    return " ".join(t for p, _, t in found if p not in low)


def _pages():
    """One row per page and kind of page that a task meets: its host, a digest of its blocks, and the blocks as paths and hashes of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[tuple[str, bytes]] = set()
        for b in parts(batches, 1000, 1):
            out = []
            for url, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                host, digest = host_of(url), xxhash.xxh3_128()
                paths, texts = [], []
                for path, _, text in blocks(page or ""):
                    code = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1
                    digest.update(f"{path}\x00{code}\x00".encode("utf-8", "surrogatepass"))
                    paths.append(path)
                    texts.append(code)
                key = (host, digest.digest())
                if paths and key not in known:
                    if len(known) > 100_000:
                        known.clear()
                    known.add(key)
                    out.append((*key, paths, texts))
            if out:
                host, code, paths, texts = zip(*out)
                yield batch(host=pa.array(host, pa.string()), page=pa.array(code, pa.binary()), paths=pa.array(paths, pa.list_(pa.string())), texts=pa.array(texts, pa.list_(pa.int64())))

    return run


def _features():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # how: the pages of a path (0), those with a presentation (1), those with a text (2)
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            host, path, how, what = zip(*seen)
            r = batch(host=pa.array(host, pa.string()), path=pa.array(path, pa.string()), how=pa.array(how, pa.int8()), what=pa.array(what, pa.int64()), pages=pa.array(seen.values(), pa.int64()))
            seen.clear()
            return r

        for b in batches:
            for host, paths, texts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                styles = Counter(paths)
                seen.update((host, p, 0, 0) for p in styles)
                seen.update((host, p, 1, n) for p, n in styles.items())
                seen.update((host, p, 2, t) for p, t in set(zip(paths, texts)))
                if len(seen) > 100_000:
                    yield out()
        if seen:
            yield out()

    return run


def low_branches(pages: DataFrame, work: Work) -> DataFrame:
    """pages: url, html. Per host with any: host, low (paths whose branch has no node of importance LOW or more)."""
    distinct = arrow_map(pages, _pages, "host string, page binary, paths array<string>, texts array<long>").dropDuplicates(["host", "page"]).select("host", "paths", "texts")
    counts = arrow_map(distinct, _features, "host string, path string, how byte, what long, pages long").groupBy("host", "path", "how", "what").agg(F.sum("pages").alias("c"))
    log = F.log(F.col("c").cast("double"))
    node = counts.groupBy("host", "path").agg(
        F.sum(F.when(F.col("how") == 0, F.col("c"))).alias("m"),
        F.sum(F.when(F.col("how") == 1, F.col("c") * log)).alias("style"),
        F.avg(F.when(F.col("how") == 2, log)).alias("text"),
    )
    base = F.log(F.col("m").cast("double"))
    presentation = (base - F.col("style") / F.col("m")) / base  # the entropy of the page counts, to the base m
    content = 1 - F.col("text") / base
    importance = F.lit(PRESENTATION) * presentation + F.lit(1 - PRESENTATION) * content
    # A node of too few pages judges nothing: it neither condemns nor is condemned, and keeps the branch it is in.
    judged = node.select("host", "path", F.coalesce((F.col("m") >= PAGES) & (importance < LOW), F.lit(False)).alias("is_low"))
    names = F.slice(F.split("path", "/"), 2, F.size(F.split("path", "/")))
    above = F.transform(F.sequence(F.lit(1), F.size(names)), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(names, 1, k), "/")))
    branch = judged.select("host", "path", "is_low", F.explode(above).alias("branch")).groupBy("host", "branch").agg(F.min("is_low").alias("all_low"))
    low = branch.where("all_low").select("host", F.col("branch").alias("path"))
    return work.table(low.groupBy("host").agg(F.collect_list("path").alias("low")), "low")


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars (code points)."""
    rows = pick(pages, page_id=id_col, url=url_col, html=html_col)
    kind = rows.schema["page_id"].dataType.simpleString()
    work = Work(pages.sparkSession, "pages")
    low = low_branches(rows.select("url", "html"), work)
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#\s]*@)?([^/?#\s:@]*)", 1)), F.lit(""))
    both = rows.withColumn("host", host).join(low, "host", "left").select("page_id", "url", "html", "low")

    def make():
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in parts(batches, 1000, 2):
                texts = [main_text(blocks(h or ""), set(x or ())) for h, x in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
                yield batch(page_id=b.column(0), url=b.column(1), text=pa.array(texts, pa.string()), n_chars=pa.array(map(len, texts), pa.int64()))

        return run

    return arrow_map(both, make, f"page_id {kind}, url string, text string, n_chars long")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
