"""Main text of web pages: site templates and page furniture are removed as whole elements."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from clicktide.llm.storage import stored

# An element is a site's template if it recurs on at least so many different pages of the host, and
# on the root of their number, and if it is on so large a share of the host's pages (in an article or
# main element, elsewhere). Outside these, it also is if so large a share (SHARE) of what stands at its
# place in pages recurs.
LEAST_PAGES = 5
SHARE = 0.5
ELSEWHERE = 0.1
# Lines that articles have in common (ingredients, openings) are no templates: in an article or main
# element, one has so many words, or is on so large a share of the host's pages.
LONG_WORDS = 8
EVERYWHERE = 0.9
# Templates (host and hash) that travel to every task, 8 bytes each; more come by a join.
MOST_SENT = 2_000_000
# Hashes are cut to positive 64-bit numbers.
HASH = (1 << 63) - 1
# Bits of the hash of a place that are flags.
OUTSIDE, LONG = 1 << 62, 1 << 61

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option "
    "p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
DROPPED = frozenset(
    "nav footer aside form script style noscript template iframe head title button select textarea input "
    "svg canvas object embed audio video dialog menu datalist".split()
)
# Start tags that end an open element of the same kind.
ENDS = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]), "p": frozenset(["p"]),
}
LISTS = frozenset("ul ol dl table select menu".split())
CLOSES_P = BLOCKS - frozenset("body html head option td th tr tbody thead tfoot li dt dd caption".split())
# Words in an element's class, id or role that mark page furniture.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie "
    "cookies consent gdpr notice notices alert nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar "
    "footer masthead topbar comment comments respond replies reply disqus share sharing social related recommended "
    "newsletter subscribe signup popup modal overlay widget pagination pager toolbar login search complementary "
    "contentinfo skip".split()
)
# Outside the article, these do too.
HEADS = frozenset(["header"])
# Words beside them in a compound name of furniture. Any other word makes it a name of something else
# (wine-menu, job-alert, has-comments).
NEUTRAL = frozenset(
    "area article bar block blog box btn button buttons container count desktop entry footer form global group header "
    "holder icon icons inline inner item items left link links list main mobile page post primary right secondary "
    "section site sticky title top bottom user widgets wrap wrapper zone".split()
)
# Comments of readers and adverts are not the page's text, however long they are.
NEVER = frozenset(
    "comment comments respond replies reply disqus ad ads advert adverts advertisement advertising sponsored".split()
)
MAIN = frozenset(["article", "main"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# A quote opens a value directly behind the equals sign only. Nothing here is tried twice.
_INSIDE = r"""(?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>])*+"""
_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript|iframe|noembed|noframes|xmp|template)\b"""
    rf"""{_INSIDE}>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({_INSIDE})>|<[!?][^>]*>""",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_WORD = re.compile(r"[a-z0-9]+")


@lru_cache(100_000)
def marks(name: str, furniture: frozenset[str]) -> bool:
    """Whether a class, id or role is one of `furniture`, or a compound of these and neutral words."""
    if name in furniture:
        return True
    words = _WORD.findall(name)
    if len(words) < 2 or not furniture.intersection(words):
        return False
    return all(w in furniture or w in NEUTRAL or w.isdigit() for w in words)


def attributes_of(text: str) -> dict[str, str]:
    """Attributes by name in lower case; the first of a name counts."""
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(text):
        value = "".join(values)
        found.setdefault(name.lower(), unescape(value) if "&" in value else value)
    return found


@dataclass
class Element:
    name: str
    dropped: bool
    main: bool
    first: int  # its first block
    last: int = 0  # the block after its last
    parts: list[str] = field(default_factory=list)
    hard: bool = False  # dropped by kind, or hidden
    number: int = 0  # of its start tag, if dropped by class alone
    never: bool = False  # by a name of NEVER
    digest: int = 0
    place: int = 0  # hash of the names and classes from the root to it


@dataclass
class Page:
    blocks: list[str]
    kept: list[bool]  # not in dropped elements
    in_main: list[bool]
    elements: list[Element]
    soft: list[bool] = field(default_factory=list)  # dropped by a class alone
    linked: list[int] = field(default_factory=list)  # words in links
    around: set[int] = field(default_factory=set)  # elements dropped by class that are or have an article or main element


def parse(html: str) -> Page:
    """Blocks of text in page order, and the elements with the range of blocks and hash of each.

    A class does not drop an article or main element, or one around it, unless the page has text in
    another article; nor an element that holds most of the page's words outside links, unless there is
    other text and it is outside the article that holds this, or named as comments or an advert.
    """
    spared: frozenset[int] = frozenset()
    while True:
        page = read(html, spared)
        more = set()
        if page.around and not any(e.name == "article" and any(page.kept[e.first : e.last]) for e in page.elements):
            more |= page.around
        if any(page.soft):
            sizes = [
                max(0, words(page, [i]) - page.linked[i]) if page.kept[i] or page.soft[i] else 0
                for i in range(len(page.blocks))
            ]
            total, left = sum(sizes), any(page.kept)
            in_main = any(k and m for k, m in zip(page.kept, page.in_main))
            for e in page.elements:
                sure = e.never and left or in_main and not e.main
                if e.number and not sure and 2 * sum(sizes[e.first : e.last]) > total:
                    more.add(e.number)
        if more <= spared:
            return page
        spared |= more


def read(html: str, spared: frozenset[int]) -> Page:
    """As `parse`; start tags with a number in `spared` are not dropped by class."""
    page = Page([], [], [], [])
    root = Element("", False, False, 0)
    stack, text, links = [root], [], []

    def flush() -> None:
        if text:
            block = " ".join("".join(text).split())
            text.clear()
            if block:
                page.blocks.append(block)
                page.kept.append(not stack[-1].dropped)
                page.in_main.append(stack[-1].main)
                page.soft.append(stack[-1].dropped and not stack[-1].hard)
                page.linked.append(sum(len(t.split()) for t in links))
                stack[-1].parts.append(block)
            links.clear()

    def close() -> None:
        if stack[-1].name in BLOCKS:
            flush()
        done = stack.pop()
        done.last = len(page.blocks) + bool(text)
        done.digest = xxhash.xxh64_intdigest("\x00".join([done.name, *done.parts])) >> 1
        stack[-1].parts.append(f"<{done.digest:x}>")
        page.elements.append(done)

    def end(names: frozenset[str], within: frozenset[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                while len(stack) > i:
                    close()
                return
            if stack[i].name in within:
                return

    at = 0
    for token in _TOKEN.finditer(html):
        if token.start() > at:
            piece = html[at : token.start()]
            text.append(unescape(piece) if "&" in piece else piece)
            if any(e.name == "a" for e in stack[-4:]):
                links.append(text[-1])
        at = token.end()
        name = token.group(3)
        if not name:
            continue
        name = name.lower()
        if token.group(2):
            if name in VOID:
                text.append(" ")
                continue
            if name in BLOCKS or any(e.name == name for e in stack[-3:]):
                end(frozenset([name]), frozenset() if name in BLOCKS else BLOCKS)
            continue
        if name in VOID:
            if name == "hr":
                flush()
            text.append(" ")
            continue
        if name in BLOCKS:
            flush()
            if name in CLOSES_P:
                end(ENDS["p"], frozenset(["button", "table", "article", "section", "td", "div"]))
            if name in ENDS and name != "p":
                end(ENDS[name], LISTS)
        attributes = token.group(4)
        known = attributes_of(attributes) if attributes and not attributes.isspace() else {}
        # Below an element that is dropped by class, one may still be so for another reason.
        hard = stack[-1].hard or name in DROPPED or name == "header" and not stack[-1].main
        if not hard and ("hidden" in known or _NO_DISPLAY.search(known.get("style", ""))):
            hard = True
        number, never = 0, False
        if not hard and known and token.start() + 1 not in spared and name not in ("html", "body"):
            names = {w for a in ("class", "id", "role") for w in known.get(a, "").lower().split()}
            if any(marks(w, FURNITURE) or not stack[-1].main and marks(w, HEADS) for w in names):
                number, never = token.start() + 1, any(marks(w, NEVER) for w in names)
        dropped = stack[-1].dropped or hard or number > 0
        if name in BLOCKS or dropped != stack[-1].dropped or name in MAIN:
            flush()
        element = Element(name, dropped, stack[-1].main or (name in MAIN and not dropped), len(page.blocks))
        element.place = xxhash.xxh64_intdigest(f"{stack[-1].place:x} {name} {known.get('class', '')}")
        element.hard, element.number, element.never = hard, number, never
        stack.append(element)
        if name in MAIN and dropped and not hard:
            page.around.update(e.number for e in stack if e.number)
        if attributes.endswith("/") and name not in BLOCKS:
            close()
    if at < len(html):
        text.append(unescape(html[at:]) if "&" in html[at:] else html[at:])
    flush()
    while len(stack) > 1:
        close()
    return page


def place_of(e: Element, long: bool) -> int:
    """Hash of an element's place, below OUTSIDE in an article or main element, with LONG set if its text is."""
    return (0 if e.main else OUTSIDE) | (LONG if long else 0) | e.place & (LONG - 1)


def furniture(page: Page) -> tuple[int, list[tuple[int, int, int]]]:
    """Hash of the page's kept blocks, and `(hash, context, place)` of the elements that may be a site's template.

    The context is the hash of all blocks that are kept outside the element: copies of a page give
    one context only, so that an article is not taken for a template because it was copied. Of
    several places of one element, the least is one in an article or main element if there is any.
    """
    # Sums over the blocks before each, so that any range and its outside are one difference.
    sums, counts = [0], [0]
    for block, kept in zip(page.blocks, page.kept):
        sums.append(sums[-1] + (xxhash.xxh64_intdigest(block) if kept else 0))
        counts.append(counts[-1] + kept)
    found = []
    for e in page.elements:
        if e.dropped or e.name not in BLOCKS or e.name in ("html", "body") or e.last <= e.first:
            continue
        if counts[e.last] - counts[e.first] < counts[-1]:
            outside = sums[-1] - sums[e.last] + sums[e.first]
            long = words(page, range(e.first, e.last)) >= LONG_WORDS
            found.append((e.digest, outside & HASH, place_of(e, long)))
    return sums[-1] & HASH, found


def main_text(page: Page, templates: frozenset[int]) -> str:
    """Kept blocks in page order, without templates.

    If at least half of their words are in article or main elements, only those, and the titles
    outside: every `h1`, and headings directly before the first of those blocks.
    """
    kept = list(page.kept)
    titles, headings = set(), set()
    for e in page.elements:
        if e.digest in templates:
            kept[e.first : e.last] = [False] * (e.last - e.first)
        elif e.name in HEADINGS:
            headings.update(range(e.first, e.last))
            if e.name == "h1":
                titles.update(range(e.first, e.last))
    left = [i for i, k in enumerate(kept) if k]
    inside = [i for i in left if page.in_main[i]]
    if inside:
        for i in reversed(left[: left.index(inside[0])]):
            if i not in headings:
                break
            titles.add(i)
        outside = [i for i in left if not page.in_main[i] and i not in titles]
        if words(page, inside) >= words(page, outside):
            left = [i for i in left if page.in_main[i] or i in titles]
    return "\n".join(page.blocks[i] for i in left)


def words(page: Page, blocks: Iterable[int]) -> int:
    """Words of the blocks; eight characters are at least one, for scripts without spaces."""
    return sum(max(len(b.split()), len(b) // 8) for b in (page.blocks[i] for i in blocks))


def host(url: Column) -> Column:
    """Host of a URL in lower case; null for a null or relative one."""
    found = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(found != "", F.lower(found))


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """`(host, hashes)`: elements that recur on many different pages of a host."""
    at_host, at_html = 0, 1

    def hash_elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts = batch.column(at_host).to_pylist()
            for i, html in enumerate(batch.column(at_html)):
                page = parse(html.as_py() or "")
                whole, elements = furniture(page)
                # Element 0 stands for the page, to count the different pages of the host.
                found = {(0, whole, 0), *elements}
                digests, contexts, places = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([hosts[i]] * len(found), pa.string()), *(pa.array(v, pa.int64()) for v in (digests, contexts, places))],
                    ["host", "digest", "context", "place"],
                )

    sites = pages.select(host(F.col("url")).alias("host"), "html").filter("host is not null")
    seen = sites.mapInArrow(hash_elements, "host string, digest long, context long, place long")
    counts = seen.groupBy("host", "digest", "context").agg(F.min("place").alias("place"))
    counts = stored(counts.groupBy("host", "digest").agg(F.count("*").alias("n"), F.min("place").alias("place")))
    recurs = F.col("n") >= least_pages
    totals = counts.filter("digest = 0").select(F.col("host").alias("_host"), F.col("n").alias("total"))
    at_place = counts.filter("digest <> 0").groupBy(F.col("host").alias("_at"), F.col("place").alias("_place"))
    at_place = at_place.agg(F.sum("n").alias("_all"), F.sum(F.when(recurs, F.col("n"))).alias("_recurring"))
    often = counts.filter(recurs & (F.col("digest") != 0)).join(totals, F.col("host") == F.col("_host"))
    often = often.filter(F.col("n") >= F.sqrt("total"))
    often = often.join(at_place.filter("_recurring > 0"), (F.col("host") == F.col("_at")) & (F.col("place") == F.col("_place")))
    inside = F.col("place") < OUTSIDE
    short = inside & (F.col("place").bitwiseAND(F.lit(LONG)) == 0)
    least_share = F.when(short, EVERYWHERE).when(inside, share).otherwise(min(share, ELSEWHERE))
    fixed_place = ~inside & (F.col("_recurring") >= share * F.col("_all"))
    often = often.filter(fixed_place | (F.col("n") >= least_share * F.col("total")))
    return often.groupBy("host").agg(F.collect_set("digest").alias("hashes"))


def extract(
    pages: DataFrame, least_pages: int = LEAST_PAGES, share: float = SHARE, most_sent: int = MOST_SENT
) -> DataFrame:
    """`pages` (url, html, ..) with `text`, without `html`.

    First the hashes of all element subtrees are counted per host; then each page is parsed again
    and loses the subtrees that recur beside different content, besides elements whose kind or
    class says that they are no content. Of a host with N different pages, each such subtree recurs on
    sqrt(N) at least, so there are sqrt(N) times as many of them as of elements on a page at most;
    they are sent to every task if there are at most `most_sent`, and else joined to the pages.

    Null and empty html give an empty text, a null url has no host and no template. Repeated
    pages count once for templates. An empty table gives an empty table. Columns `text`, `_host` and
    `_hashes` of `pages` are replaced.
    """
    known = stored(templates(pages, least_pages, share)).select(F.col("host").alias("_site"), F.col("hashes").alias("_hashes"))
    rows = pages.drop("text", "_host", "_hashes", "_site").withColumn("_host", host(F.col("url")))
    sent = None
    if (known.agg(F.sum(F.size("_hashes"))).first()[0] or 0) <= most_sent:
        sent = rows.sparkSession.sparkContext.broadcast({r[0]: frozenset(r[1]) for r in known.collect()})
        rows = rows.withColumn("_hashes", F.lit(None).cast("array<bigint>"))
    else:
        rows = rows.join(known, F.col("_host") == F.col("_site"), "left").drop("_site")
    keep = [f for f in rows.schema.fields if f.name.lower() not in ("html", "_hashes", "_host")]
    at = [rows.columns.index(f.name) for f in keep]
    at_html, at_hashes, at_host = (rows.columns.index(c) for c in ("html", "_hashes", "_host"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, none = (None, frozenset()), frozenset()
        for batch in batches:
            hashes, sites = batch.column(at_hashes), batch.column(at_host).to_pylist()
            texts = []
            for i, html in enumerate(batch.column(at_html)):
                if sent is not None:
                    gone = sent.value.get(sites[i], none)
                else:
                    # One set for the pages of a host that come together.
                    if last[0] != sites[i]:
                        last = (sites[i], frozenset(hashes[i].as_py() or ()))
                    gone = last[1]
                texts.append(main_text(parse(html.as_py() or ""), gone))
            columns = [*(batch.column(i) for i in at), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in keep), "text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    return rows.mapInArrow(cut, f"{fields}, text string")


def op8_html(spark, sf: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
