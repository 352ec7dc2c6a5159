"""Main text of pages by a site style tree.

The pages of a host are merged into one tree of style nodes: an element's path of tags and classes.
A node's content importance is one minus the mean entropy of its texts over the pages that show them
(a text on every page tells nothing, a text on one page tells most); its presentation importance is
the entropy of its child sequences. A branch weighs the presentation of its root and the content of
all below it, and branches under ``LEAST`` are removed from every page of the host, with whatever
the element names themselves mark as a menu, header, footer, side bar, notice, advert, form, script
or comment section. Where article or main elements hold most of what is left of a page only they
are read; an article that holds little of it is no evidence against the rest.

Defined cases: null or empty html gives an empty text; a null url or one without ``://`` belongs to
the empty host; hosts of fewer than ``MIN_PAGES`` pages have no evidence and lose only what the
names mark; if every branch of a page would go, the evidence of the host is not used for that page;
missing end tags are implied; repeated pages are read alike; other columns stay as they are.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.llm.sieve import sifted
from labelwright.llm.store import save
from labelwright.llm.words import ascii_lower

MIN_PAGES = 5
#: Weight of a branch's content against its root's presentation, and the least importance kept,
#: outside and inside an article: inside, only what nearly every page of the host shows.
CONTENT_WEIGHT, LEAST, LEAST_INSIDE = 0.9, 0.2, 0.05

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|svg|iframe)\b(?:[^>\"'<]|\"[^\"<]*\"|'[^'<]*'|[\"'])*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/><]*)(?P<attr>(?:[^>\"'<]|\"[^\"]*\"|'[^']*'|[\"'])*+)>"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
NAMES = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Start tags that end an open paragraph, and open elements that a start tag of the same family ends.
CLOSES_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
FAMILY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}
#: Elements, roles and name words that mark what is not the article.
DROP = frozenset("head title nav footer aside form button select option dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
MARKS = frozenset(
    "ad ads advert advertisement adverts banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer cookie cookies consent gdpr notice popup modal overlay comment comments disqus replies respond share sharing social related recommended newsletter subscribe signup login masthead topbar pagination pager widget skip".split()
)
COMMENTS = frozenset(("comment", "comments", "reply"))
#: Parts of a name that say where or what a box is; a name is marked if it has no parts but these and marks.
NEUTRAL = frozenset(
    "site page main global primary secondary mobile desktop user reader blog entry post posts article articles story stories left right top bottom head header upper lower inner outer box bar wrap wrapper container content section area block item items list links link buttons button icon icons slot unit row col column module panel card cards feed thread form text title count more media holder strip zone group bottom floating sticky fixed".split()
)
#: Least part of a page's unmarked text that an article must hold for the rest to be left out.
SHARE_INSIDE = 0.5
#: Levels of a style node's path; elements below share the node of that depth.
DEEPEST = 64


def marked_name(value: str, marks: frozenset[str] = MARKS) -> bool:
    """Whether one of the names in a class or id says that the element is not the article.

    ``cookie-notice`` and ``main-menu`` do, ``social-science`` and ``share-prices`` do not.
    """
    for name in value.split():
        parts = [p for p in re.split("[_0-9-]+", name) if p]
        if not marks.isdisjoint(parts) and all(p in marks or p in NEUTRAL or not p.isalpha() for p in parts):
            return True
    return False


def blocks(page: str) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(path, text) of each block of a page outside marked elements, and (path, child tags) of its elements."""
    out: list[tuple[str, str, bool]] = []
    shapes: list[tuple[str, str]] = []
    # open elements: tag, path, whether it or an element around it is marked, in an article, child tags
    stack: list[tuple[str, str, bool, bool, list[str]]] = [("", "", False, False, [])]
    text: list[str] = []

    def flush() -> None:
        if text:
            _, path, marked, inside, _ = stack[-1]
            for k in range(len(stack) - 1, 0, -1):  # a block is its nearest element that is not inline
                if stack[k][0] not in INLINE:
                    _, path, _, inside, _ = stack[k]
                    break
            said = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if said and not marked:
                out.append((path, said, inside))

    def close(depth: int) -> None:
        while len(stack) > depth:
            _, path, marked, _, kids = stack.pop()
            if kids and not marked:
                shapes.append((path, " ".join(kids)))

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at and not stack[-1][2]:
            text.append(page[at : m.start()])
        at = m.end()
        tag = m.group("tag")
        if tag is None:
            continue
        tag = tag.lower()
        if m.group("end"):
            if tag not in INLINE:
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    if tag in INLINE and any(stack[j][0] not in INLINE for j in range(k + 1, len(stack))):
                        break  # an inline end tag does not close blocks
                    flush() if stack[k][2] != stack[k - 1][2] else None
                    close(k)
                    break
            continue
        if tag not in INLINE:
            flush()
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        elif tag in FAMILY:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in FAMILY[tag]:
                    close(k)
                    break
                if stack[k][0] in FENCE[tag]:
                    break
        stack[-1][4].append(tag)
        if tag in VOID or m.group("attr").endswith("/") and tag in INLINE:
            continue
        _, above, marked, inside, _ = stack[-1]
        named, hidden, style = [], False, ""
        for name, *values in NAMES.findall(m.group("attr")) if m.group("attr") else ():
            value = next((v for v in values if v), "").lower()
            name = name.lower()
            if name == "role":
                hidden = hidden or value in ROLES
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                hidden = True
            else:
                named.append(value)
                if name == "class":
                    # names with digits are often made up for a page
                    style = "." + " ".join(x for x in value.replace("/", "").split() if x.isascii() and not re.search("[0-9]", x))
        frame = tag in ("html", "body", "article", "main")
        said = " ".join(named)
        gone = hidden or tag in DROP or (tag == "header" and not inside) or (not frame and marked_name(said)) or (tag == "article" and marked_name(said, COMMENTS))
        if gone and not marked:
            flush()
        path = f"{above}/{tag}{style}" if len(stack) < DEEPEST else above
        stack.append((tag, path, marked or gone, inside or tag in ("article", "main"), []))
    if at < len(page) and not stack[-1][2]:
        text.append(page[at:])
    flush()
    close(1)
    if sum(len(t) for _, t, inside in out if inside) >= SHARE_INSIDE * sum(len(t) for _, t, _ in out):
        out = [b for b in out if b[2]] or out
    return [(p, t) for p, t, _ in out], shapes


def _parsed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [blocks(x or "") for x in batch]
        yield pd.DataFrame(
            {
                "blocks": [[{"path": p, "text": t} for p, t in b] for b, _ in rows],
                "shapes": [[{"path": p, "kids": k} for p, k in dict.fromkeys(s)] for _, s in rows],
            }
        )


def _paths_above(path: Column) -> Column:
    """The path itself and every path around it."""
    steps = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))


def importance(parsed: DataFrame) -> DataFrame:
    """(host, path, importance) of every style node on hosts with enough pages.

    Only (host, path, 64-bit text hash) counts are shuffled, combined before the shuffle.
    """
    texts = parsed.select("host", F.explode(F.array_distinct(F.transform("blocks", lambda b: F.struct(b["path"].alias("path"), F.xxhash64(b["text"]).alias("f"))))).alias("t"))
    texts = texts.groupBy("host", "t.path", "t.f").agg(F.count("*").alias("n"))
    seen = parsed.select("host", F.explode(F.array_distinct(F.flatten(F.transform("blocks", lambda b: _paths_above(b["path"]))))).alias("path"))
    pages = seen.groupBy("host", "path").agg(F.count("*").alias("m"))
    own = texts.groupBy("host", "path").agg(F.sum(F.log("n")).alias("logs"), F.count("*").alias("kinds"))
    own = own.join(pages, ["host", "path"]).where(F.col("m") >= MIN_PAGES)
    # sum over the kinds of text of 1 - log n / log m
    own = own.select("host", "path", "kinds", (F.col("kinds") - F.col("logs") / F.log("m")).alias("worth"))
    content = (
        own.select("host", F.explode(_paths_above(F.col("path"))).alias("path"), "kinds", "worth")
        .groupBy("host", "path")
        .agg((F.sum("worth") / F.sum("kinds")).alias("content"))
    )
    shapes = parsed.select("host", F.explode("shapes").alias("s")).groupBy("host", "s.path", F.xxhash64("s.kids").alias("k")).agg(F.count("*").alias("n"))
    total = shapes.groupBy("host", "path").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    shape = total.select("host", "path", F.when(F.col("all") > 1, 1 - F.col("nlogn") / (F.col("all") * F.log("all"))).otherwise(F.lit(1.0)).alias("shape"))
    joined = content.join(shape, ["host", "path"], "left")
    worth = CONTENT_WEIGHT * F.col("content") + (1 - CONTENT_WEIGHT) * F.coalesce("shape", "content")
    return joined.select("host", "path", worth.alias("importance"))


def extract(pages: DataFrame, keep: list[str]) -> DataFrame:
    """The named columns of each page as ``row`` and its main text as ``text``."""
    parse = F.pandas_udf("blocks array<struct<path:string,text:string>>, shapes array<struct<path:string,kids:string>>")(_parsed)
    host = ascii_lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), "(?s)^.*?://([^/?#]*)", 1))
    parsed = pages.select(F.struct(*keep).alias("row"), host.alias("host"), parse("html").alias("p"))
    parsed = save(parsed.select("row", "host", "p.*"), "pages")
    inside = F.col("path").rlike("/(article|main)\\b")
    low = importance(parsed).where(F.col("importance") < F.when(inside, LEAST_INSIDE).otherwise(LEAST)).groupBy(F.col("host").alias("site")).agg(F.collect_set("path").alias("low"))
    # style nodes of one host, not rows: the list is as long as the site's templates are varied
    low = save(low, "low")
    # pages of hosts that lose nothing, which are most, are not shuffled
    marked = sifted(parsed.drop("shapes"), low.select(F.col("site").alias("host")), "host")
    found = marked.where("maybe").join(low, F.col("host") == F.col("site"), "left").select("row", "blocks", "low")
    out = found.unionByName(marked.where("NOT maybe").select("row", "blocks", F.lit(None).cast("array<string>").alias("low")))
    stay = F.when(F.col("low").isNull(), F.col("blocks")).otherwise(F.filter("blocks", lambda b: ~F.arrays_overlap(F.col("low"), _paths_above(b["path"]))))
    out = out.withColumn("stay", stay)
    best = F.when(F.size("stay") == 0, F.col("blocks")).otherwise(F.col("stay"))
    return out.select("row", F.array_join(F.transform(best, lambda b: b["text"]), " ").alias("text"))

