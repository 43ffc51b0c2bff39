"""Main text of web pages by template deduction over the pages of a host.

Pages of a host are made from one template: elements and texts that belong to it occur
the same number of times in the same pages. So the tokens of a page are the elements on
its paths from the root and its text blocks; tokens of a host with the same occurrence
vector (how often each page has them) are grouped. What is chosen depends on the number of
pages, the characters and the names of each token, not on the vector: unlike the published
method, groups neither decide nor nest. Groups that many pages have are valid:

* the region is the element that holds the article: the <article> or <main> that most pages
  have, or else the smallest element that holds most of the text and whatever has the name
  of content, titles and bodies side by side among them;
* text of a valid class is fixed: the template's, not the page's; where it is much of an
  <article> or <main> it stays, as an article that many pages repeat looks the same;
* the other text blocks of the region, menus, notices, adverts, forms, comments and the
  like apart, are the slots that are extracted.

Vectors are compared by a combinable hash, so no host is ever in one task.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.places import Scratch, quoted
from tablewright.llm.texts import slices, utf8

#: Share and number of a host's pages that a valid class has at least.
SHARE = 0.5
PAGES = 3
#: Share of a host's text that its region has where no element says it is the content.
MOST = 0.6
#: Share of a page's text from which an element is no menu, advert or the like whatever its
#: names are: where they also name content, and where they do not.
NAMED_CONTENT = 0.3
NAMED_OTHER = 0.9
#: Share of an article's text that its host's template may have in it.
TEMPLATE = 0.3
#: Hosts up to which templates are broadcast.
FEW_HOSTS = 50_000

# Elements of HTML by what they mean for text.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
_CLOSES_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr main menu nav ol p pre section table ul".split()
)
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_DROPPED = frozenset(
    "script style noscript template head title nav header footer aside form button select input textarea iframe object svg "
    "canvas audio video map dialog menu".split()
)
_CONTENT = frozenset(("article", "main"))
#: Words in classes, ids and roles of what is no main text, and of what is.
_OTHER_NAMES = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments cookie cookies consent "
    "disqus footer header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted "
    "related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets "
    "complementary contentinfo search".split()
)
_CONTENT_NAMES = frozenset("article main content entry post story".split())
_COMMENT_NAMES = frozenset("comment comments disqus replies reply respond".split())
# Names of layout that contain a word of the lists without meaning it.
_LAYOUT = frozenset(("html", "body"))

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title|noscript|iframe)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|</?[a-z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
    r"|</?[a-z][^>]*>"
    r"|<[!?/][^>]*>",
    re.I | re.S,
)
_NAME = re.compile(r"</?([a-z][^\s/>]*)", re.I)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""", re.I)
_HOST = "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


@dataclass(frozen=True)
class Block:
    """A block of text and the path to it: one name per element."""

    path: tuple[str, ...]
    text: str


def page_blocks(source: str) -> list[Block]:
    """The text blocks of a page in page order.

    A block is what stands between two tags that are not inline; its white space is one
    space and its character references are decoded. Unclosed and stray tags are taken as
    browsers take them, as far as text goes.
    """
    stack: list[tuple[str, str]] = []
    blocks: list[Block] = []
    run: list[str] = []

    def end() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            blocks.append(Block(tuple(name for tag, name in stack if tag not in _INLINE), text))

    at = 0
    for found in _TOKEN.finditer(source):
        if found.start() > at:
            run.append(html.unescape(source[at : found.start()]))
        at = found.end()
        token = found[0]
        match = _NAME.match(token)
        if not match or found["raw"]:
            continue
        tag = match[1].lower()
        if tag in _INLINE:
            if tag == "br":
                run.append(" ")
            continue
        end()
        if token[1] == "/":
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag in _CLOSES_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] in ("td", "th", "button", "object"):
                    break
        while stack and stack[-1][0] in _SIBLINGS.get(tag, ()):
            stack.pop()
        if tag not in _VOID and not token.endswith("/>"):
            stack.append((tag, _element(tag, token)))
    if at < len(source):
        run.append(html.unescape(source[at:]))
    end()
    return _judged(blocks)


def _judged(blocks: list[Block]) -> list[Block]:
    """The blocks, with names that are in doubt (``?``) decided by how much text of the page they hold.

    Names of layout contain such words as well (a page builder's ``widget``, a page's
    ``has-sidebar``), so an element that a page is little without is no menu or advert.
    """
    doubtful = [block for block in blocks if any(name[0] == "?" for name in block.path)]
    if not doubtful:
        return blocks
    total = sum(len(block.text) for block in blocks if not _dropped(block.path))
    held: dict[tuple[str, ...], int] = {}
    for block in doubtful:
        if not _dropped(block.path):
            for k, name in enumerate(block.path, 1):
                if name[0] == "?":
                    held[block.path[:k]] = held.get(block.path[:k], 0) + len(block.text)

    def decided(path: tuple[str, ...]) -> tuple[str, ...]:
        names = []
        for k, name in enumerate(path, 1):
            if name[0] == "?":
                content = name[1] == "+"
                kept = held.get(path[:k], 0) >= (NAMED_CONTENT if content else NAMED_OTHER) * total
                name = name[1:] if kept else "!" + name.lstrip("?+")
            names.append(name)
        return tuple(names)

    known: dict[tuple[str, ...], tuple[str, ...]] = {}
    return [Block(known.get(b.path) or known.setdefault(b.path, decided(b.path)), b.text) for b in blocks]


def _element(tag: str, token: str) -> str:
    """An element's name with its classes; ``!``, ``+`` and ``?`` mark what it says about its text."""
    words: list[str] = []
    heads: set[str] = set()  # last words: what the names before them belong to
    hidden = False
    for name, value in _ATTRIBUTE.findall(token[len(tag) + 1 :]):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id", "role"):
            for one in value.split():
                parts = re.findall("[a-z]+", one)
                words += parts
                heads.update(parts[-1:])
        else:
            hidden |= name == "hidden" or (name == "aria-hidden" and value == "true") or "display:none" in value.replace(" ", "")
    mark = ""
    if hidden or tag in _DROPPED:
        mark = "!"
    elif tag in _CONTENT:
        mark = "++"
    elif tag not in _LAYOUT and _OTHER_NAMES.intersection(words):
        mark = "?+" if _CONTENT_NAMES & heads else "!" if _COMMENT_NAMES.intersection(words) else "?"
    elif tag not in _LAYOUT and _CONTENT_NAMES.intersection(words):
        mark = "+"
    return ".".join([mark + tag, *sorted(set(words))])


def _dropped(path: tuple[str, ...]) -> bool:
    return any(name[0] == "!" for name in path)


def extract_text(pages: DataFrame, identity: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """``page_id url text`` per row of ``pages``: its blocks of main text, an empty line between.

    Null and empty pages, and those without main text, have an empty text. Pages whose URL
    is null or has no host share one host. Rows that repeat each have their text. Nothing
    else is dropped: a page whose host's template does not fit it keeps what lies in its
    own content elements, or all text that is not marked as something else.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark)
    rows = pages.select(
        quoted(identity).alias("page_id"),
        quoted(url).alias("url"),
        F.lower(F.regexp_extract(F.coalesce(quoted(url).cast("string"), F.lit("")), _HOST, 1)).alias("host"),
        utf8(quoted(source)).alias("html"),
    )
    template = scratch.keep(templates(rows, scratch), "templates").withColumnRenamed("host", "of")
    if template.count() <= FEW_HOSTS:
        template = F.broadcast(template)
    known = rows.join(template, F.col("host") == F.col("of"), "left").select("page_id", "url", "html", "region", "fixed")
    kind = T.StructType([*rows.select("page_id", "url").schema.fields, T.StructField("text", T.StringType())])
    return known.mapInArrow(_extract, kind)


def templates(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``host region fixed``: per host its region and the texts (by hash) that its template has.

    What a host's template holds is bounded by the pages' own length: a text of a valid
    class is in half of them.
    """
    keyed = rows.select("host", F.xxhash64("page_id", "url").alias("page"), "html")
    tokens = keyed.mapInArrow(_tokens, "host string, page long, path string, token long, n int, chars long")
    # A token's occurrence vector, hashed so that parts of it can be combined.
    vectors = tokens.groupBy("host", "token").agg(
        F.sum(F.xxhash64("page", "n").bitwiseAND(0xFFFFFFFF)).alias("vector"),
        F.count(F.lit(1)).alias("pages"),
        F.sum("n").alias("places"),
        F.max("path").alias("path"),
        F.sum("chars").alias("chars"),
    )
    # Kept, as pages are parsed for it; what one page alone has is no template's.
    vectors = scratch.keep(vectors.where("pages >= 2 OR path = ''"), "vectors")
    # The root is in every page, so its token counts them.
    root = vectors.where("path = ''").select(F.col("host").alias("root_host"), F.col("pages").alias("all_pages"), F.col("chars").alias("all_chars"))
    root = scratch.keep(root, "hosts")
    shared = vectors.where(F.col("pages") >= 2).join(root, F.col("host") == F.col("root_host")).where(F.col("pages") >= SHARE * F.col("all_pages"))
    shared = scratch.keep(shared.drop("root_host"), "tokens")
    # Tokens that occur alike are a class; it is valid if enough pages have it.
    classes = shared.groupBy("host", "vector", "pages", "places").agg(
        F.collect_list(F.when(F.col("path").isNotNull(), F.struct("path", "chars"))).alias("elements"),
        F.collect_list(F.when(F.col("path").isNull(), F.col("token"))).alias("texts"),
        F.first("all_pages").alias("all_pages"),
        F.first("all_chars").alias("all_chars"),
    )
    nested = classes.select("host", "pages", "all_pages", "all_chars", "texts", F.explode_outer("elements").alias("element"))
    names = F.split("element.path", "/")
    depth = F.size(names)
    last = F.element_at(names, -1)
    content = F.when(F.startswith(last, F.lit("++")), 2).when(F.startswith(last, F.lit("+")), 1).otherwise(0)
    fits = (F.col("element.path") != "") & ~F.contains("element.path", F.lit("!"))
    most = F.col("element.chars") >= MOST * F.col("all_chars")
    path = F.col("element.path")
    named, says = fits & (content == 1), fits & (content == 2)
    found = nested.groupBy("host").agg(
        F.max_by(F.when(says, path), F.when(says, F.struct(F.col("pages").alias("a"), (-depth).alias("b"), path.alias("c")))).alias("says"),
        F.max_by(F.when(fits & most, path), F.when(fits & most, F.struct(F.col("pages").alias("a"), depth.alias("b"), path.alias("c")))).alias("most"),
        F.min(F.when(named, names)).alias("first"),
        F.max(F.when(named, names)).alias("last"),
    )
    # <article> or <main>, the outermost that most pages have; else the innermost element with
    # most text, and if others are named as content, the smallest that holds it and all of them.
    # What all paths between two have in common, the two have.
    innermost = F.split("most", "/")
    covering = _common(F.least("first", "last", innermost), F.greatest("first", "last", innermost))
    widest = F.when(F.col("first").isNull() | F.col("most").isNull(), F.col("most")).otherwise(F.array_join(covering, "/"))
    regions = found.select("host", F.coalesce("says", F.when(widest != "", widest)).alias("region")).where("region IS NOT NULL")
    valid = classes.where(F.col("pages") >= PAGES).select("host", F.explode("texts").alias("text"))
    fixed = valid.groupBy("host").agg(F.collect_set("text").alias("fixed"))
    return regions.join(fixed, "host", "full")


def _common(first: Column, last: Column) -> Column:
    """The elements that two paths begin with alike."""
    differs = F.array_position(F.zip_with(first, last, lambda a, b: a.eqNullSafe(b)), False)
    return F.when(differs == 0, first).otherwise(F.slice(first, 1, (differs - 1).cast("int")))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page its elements' paths with the characters in them, and its texts, each with how often."""
    for batch in batches:
        for rows in slices(batch, 2):
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for host, page, data in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                found: dict[tuple[str | None, int], list[int]] = {(("", 0)): [1, 0]}
                for block in page_blocks(data.decode("utf-8", "replace")):
                    lost = _dropped(block.path)
                    for k in range(len(block.path) + 1):
                        path = "/".join(block.path[:k])
                        entry = found.setdefault((path, xxhash.xxh3_64_intdigest(path) >> 1), [0, 0]) if k else found[("", 0)]
                        entry[0] += k > 0
                        entry[1] += 0 if lost else len(block.text)
                    entry = found.setdefault((None, _text_hash(block)), [0, 0])
                    entry[0] += 1
                for (path, token), (n, chars) in found.items():
                    for column, value in zip(out, (host, page, path, token, n, chars), strict=True):
                        column.append(value)
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["host", "page", "path", "token", "n", "chars"]
            )


def _text_hash(block: Block) -> int:
    return xxhash.xxh3_64_intdigest("/".join(block.path) + "\n" + block.text) >> 1


def main_text(source: str, region: str | None, fixed: set[int]) -> str:
    """The slots of a page's region, as text."""
    blocks = page_blocks(source)
    kept = [block for block in blocks if not _dropped(block.path)]
    wanted = tuple(region.split("/")) if region else None
    own = [block for block in kept if wanted and block.path[: len(wanted)] == wanted]
    marked = [block for block in kept if any(name.startswith("++") for name in block.path)]
    if not own or (marked and not any(name.startswith("++") for name in wanted)):
        own = marked or kept
    free = [block for block in own if _text_hash(block) not in fixed]
    says = any(name.startswith("++") for block in own for name in block.path)
    # What says it is the article may hold notices and adverts of the template, but if much
    # of it is fixed, it is an article that many pages repeat.
    lost = sum(len(block.text) for block in own) - sum(len(block.text) for block in free)
    if not says or lost <= TEMPLATE * sum(len(block.text) for block in own):
        own = free
    return "\n\n".join(block.text for block in own)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in slices(batch, 2):
            texts = [
                main_text(data.decode("utf-8", "replace"), region, set(fixed or ()))
                for data, region, fixed in zip(*(rows.column(k).to_pylist() for k in (2, 3, 4)), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])
