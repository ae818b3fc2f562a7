"""Main text of web pages: structural rules, and subtrees that recur over a host's pages removed as its template."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom.llm.common import read, staged

#: Fixed values of HTML: elements without an end, with raw text, that stand inside a line, and whose start ends an open paragraph or item.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp noembed noframes svg math".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CELLS = {"td", "th"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "tbody": {"thead", "tbody", "tr"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "tbody": {"table"}, "option": {"select"}}

#: Elements that are never main text, roles that say so, and words of class or id that say so.
ASIDE = set("nav footer aside form dialog menu select button input textarea fieldset object canvas audio video map".split()) | RAW
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
WORDS = set(
    "ad ads advert adverts advertisement advertisements advertising adsense banner sponsor sponsored promo promotion "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager masthead header topbar footer bottombar colophon sidebar aside widget widgets rail "
    "cookie cookies consent gdpr notice alert popup modal overlay paywall newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations trending comment comments respond reply replies disqus "
    "form search toolbar copyright disclaimer skip hidden noprint".split()
)
#: Elements that their class doesn't take away, words before another that turn it around, words that count outside articles only, and those that take away an article or its header.
WHOLE, HEADINGS, TURNED, HEADER_WORDS = {"html", "body", "main"}, {"h1", "h2", "h3"}, {"has", "with", "no", "without"}, {"header", "masthead", "banner"}
OWN_WORDS = set("comment comments reply ad ads advert advertisement sponsored promo related recommended".split())

#: A template's subtree stands on so many different pages of its host at least, and on such a share of them; inside an article, which near copies share with each other, on a larger one.
LEAST_PAGES, SHARE, ARTICLE_SHARE = 5, 0.1, 0.5
#: Rows of templates that are broadcast, at most; more are joined by host.
BROADCAST_TEMPLATES = 100_000

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?][^>]*+>|</?[a-zA-Z][^>]*+(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SPACE = re.compile(r"\s+")
_HIDES = re.compile(r"""(?i)(?:^|\s)(?:hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""")
_UNSEEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")


class _Open:
    """An open element. level: 2 in an article, 1 in a main part. dropped: taken away by rules; lost: by rules within its innermost article or main part."""

    __slots__ = ("tag", "dropped", "lost", "level", "parts", "first", "said")

    def __init__(self, tag: str, dropped: bool, lost: bool, level: int, first: int):
        self.tag, self.dropped, self.lost, self.level, self.parts, self.first, self.said = tag, dropped, lost, level, [], first, False


def _flagged(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is no main text by its own tag, role, class, id or style. inside: within an article, where headers are the article's own."""
    if tag in ASIDE or tag == "header" and not inside:
        return True
    if not attributes or attributes.isspace() or tag in WHOLE:
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape(value.strip("\"'"))
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _UNSEEN.search(value) or name == "role" and value.strip().lower() in ROLES:
            return True
        if name in ("class", "id") and tag not in HEADINGS:
            asked = OWN_WORDS if tag in ("article", "header") else WORDS - HEADER_WORDS if inside else WORDS
            for item in value.split():
                words = set(re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", item).lower()))
                if words & asked and not words & TURNED:
                    return True
    return False


#: text, dropped, level and lost of a block, as in its element.
Block = tuple[str, bool, int, bool]


def parsed(page: str) -> tuple[list[Block], list[tuple[int, int, int, bool]], str]:
    """Blocks in page order, subtrees (hash, first block, block after the last, whether in an article) and the title.

    Unclosed and stray tags are met as browsers do in the main: a paragraph ends where a block begins, an item where the next one begins; an end
    without a beginning ends the block only. A comment that never ends takes the rest.
    """
    blocks: list[Block] = []
    subtrees: list[tuple[int, int, int, bool]] = []
    stack = [_Open("", False, False, 0, 0)]
    line: list[str] = []
    title, at, end = "", 0, len(page)

    def said(raw: str) -> None:
        line.append(html.unescape(raw) if "&" in raw else raw)

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(line)).strip()
        line.clear()
        if text:
            top = stack[-1]
            blocks.append((text, top.dropped, top.level, top.lost))
            top.parts.append(text)
            top.said = True

    def close() -> None:
        flush()
        node = stack.pop()
        if node.said:
            digest = xxhash.xxh3_64_intdigest("\x1f".join([node.tag, *node.parts])) - (1 << 63)
            if not node.dropped:
                subtrees.append((digest, node.first, len(blocks), node.level > 0))
            stack[-1].parts.append(str(digest))
            stack[-1].said = True

    while at < end:
        token = _TOKEN.search(page, at)
        if token is None:
            said(page[at:])
            break
        if token.start() > at:
            said(page[at : token.start()])
        at = token.end()
        tag = token[2]
        if tag is None or (tag := tag.lower()) in ("head", "html"):
            continue
        if token[1]:
            if tag in CELLS:
                line.append(" ")
            elif tag not in INLINE:
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
                flush()
                while depth and len(stack) > depth:
                    close()
        elif tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\s*+[^>]*+>", re.I).search(page, at)
            if tag == "title" and not title:
                title = _SPACE.sub(" ", html.unescape(page[at : stop.start() if stop else end])).strip()
            at = stop.end() if stop else end
        elif tag == "hr":
            flush()
        elif tag in VOID or tag in CELLS:
            line.append(" " if tag in ("br", "img") or tag in CELLS else "")
        elif tag in INLINE:
            if token[3] and not token[3].isspace() and _HIDES.search(token[3]):
                stop = re.compile(rf"</{re.escape(tag)}\s*+>", re.I).search(page, at)
                at = stop.end() if stop else at
        else:
            flush()
            while stack[-1].tag == "p":
                close()
            if tag in CLOSES:
                inside = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in HOLDS[tag]), 0)
                over = next((i for i in range(inside + 1, len(stack)) if stack[i].tag in CLOSES[tag]), 0)
                while over and len(stack) > over:
                    close()
            top = stack[-1]
            level = max(top.level, 2 if tag == "article" else tag == "main")
            flagged = _flagged(tag, token[3], top.level > 0)
            stack.append(_Open(tag, top.dropped or flagged, flagged or top.lost and level == top.level, level, len(blocks)))
    while len(stack) > 1:
        close()
    flush()
    return blocks, subtrees, title


def scope(blocks: list[Block]) -> set[int]:
    """Numbers of the blocks that rules leave: of articles if there are any, else of main parts, else of all.

    Where more text lies in articles that are themselves inside of what rules take away (a form around the page, an
    advert that was never closed) than is left outside, these articles stand.
    """
    kept = [i for i, (_, dropped, _, _) in enumerate(blocks) if not dropped]
    level = max((blocks[i][2] for i in kept), default=0)
    kept = [i for i in kept if blocks[i][2] == level]
    if not level:
        inside = [i for i, (_, _, of, lost) in enumerate(blocks) if of and not lost]
        if sum(len(blocks[i][0]) for i in inside) > sum(len(blocks[i][0]) for i in kept):
            kept = inside
    return set(kept)


def main_blocks(page: str, template: set[int]) -> list[str]:
    """The blocks of the main text, without what rules or the template take away."""
    blocks, subtrees, _ = parsed(page)
    kept = scope(blocks)
    for digest, first, after, _ in subtrees:
        if digest in template:
            kept.difference_update(range(first, after))
    return [blocks[i][0] for i in sorted(kept)]


def _subject(blocks: list[Block], title: str) -> int:
    """What a page is about, the same for most near copies: its title with the first words of its longest block."""
    longest = max((text for text, dropped, _, _ in blocks if not dropped), key=len, default="")
    return xxhash.xxh3_64_intdigest("\x1f".join([title, " ".join(longest.split()[:5])])) - (1 << 63)


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, subject, subtree (0: the page itself), inner for each different subtree with main text of each page."""
    for batch in batches:
        out: tuple[list, list, list, list] = ([], [], [], [])
        for host, page in zip(batch["host"].to_pylist(), batch["html"].to_pylist(), strict=True):
            blocks, subtrees, title = parsed(page)
            kept, subject = scope(blocks), _subject(blocks, title)
            rows = {0: False} | {digest: inner for digest, first, after, inner in subtrees if not kept.isdisjoint(range(first, after))}
            for digest, inner in rows.items():
                for column, value in zip(out, (host, subject, digest, inner), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["host", "subject", "subtree", "inner"])


def with_host(pages: DataFrame) -> DataFrame:
    """pages with host (of the url, lower case; empty without one) and html (null as empty)."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^/?#]*)", 1))
    return pages.withColumn("host", host).withColumn("html", F.coalesce("html", F.lit("")))


def site_templates(pages: DataFrame) -> DataFrame:
    """host, template: array of the hashes of subtrees that recur across the host's pages. pages: host, html.

    Pages count by what they are about, so that copies of one page don't make its text a template. Both counts are sums
    that Spark combines before it shuffles, by (host, subtree, subject) first, so a host with a third of all pages is spread over
    its subtrees. A host has at most (subtrees of its mean page) / SHARE templates. Pages without a host have none.
    """
    told = pages.where("host <> ''").select("host", "html").mapInArrow(_subtrees, "host string, subject long, subtree long, inner boolean")
    counted = told.groupBy("host", "subtree", "subject").agg(F.min("inner").alias("inner")).groupBy("host", "subtree").agg(F.count("*").alias("pages"), F.min("inner").alias("inner"))
    often = staged(counted.where(F.col("pages") >= LEAST_PAGES))
    hosts = often.where("subtree = 0").select("host", F.col("pages").alias("of"))
    share = F.when(F.col("inner"), ARTICLE_SHARE).otherwise(SHARE)
    found = often.where("subtree <> 0").join(hosts, "host").where(F.col("pages") >= share * F.col("of"))
    return staged(found.groupBy("host").agg(F.collect_list("subtree").alias("template")))


def _extracted(columns: list[str]):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = zip(batch["html"].to_pylist(), batch["template"].to_pylist(), strict=True)
            texts = ["\n\n".join(main_blocks(page, set(template or ()))) for page, template in held]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in columns], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*columns, "text", "n_chars"])

    return extract


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text (main text, blocks joined by an empty line; empty if there is none), n_chars for each row of pages (page_id, url, html).

    Each row is judged by itself, also repeated ones; a page without url or host is judged by rules alone. Null html is empty.
    """
    told = with_host(pages.select("page_id", "url", "html"))
    templates = site_templates(told)
    size = templates.agg(F.coalesce(F.sum(F.size("template")), F.lit(0))).first()[0]
    joined = told.join(F.broadcast(templates) if size <= BROADCAST_TEMPLATES else templates, "host", "left").select("page_id", "url", "html", "template")
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return joined.mapInArrow(_extracted(["page_id", "url"]), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_pages(read(spark, sf_dir, "pages"))


QUERIES = {"op13_html_extraction": op13_html_extraction}
#: HTML can't be parsed in SQL; tests/llm compares with pages whose main text is known, and counts templates by brute force.
ORACLES: dict[str, str] = {}
