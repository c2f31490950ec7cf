"""Main text of web pages: differencing against the nearest URLs of the same host, with structure as evidence beside it.

A page is cut into lines, one for each block of text, each marked as main text, doubtful text or page furniture by the elements around it
(menus, headers, footers, forms, scripts and the like, or elements whose class, id or role says so). Lines inside an
``article`` or ``main`` element are main text, others that are no furniture are doubtful. The lines of every page but furniture
are aligned by longest common subsequence with the lines of the pages before and after in the path order of their host, doubtful
lines with all lines of the neighbour and main text with its main text:

* Shared doubtful lines are deleted, and doubtful lines that no neighbour shares are kept.
* Shared main text is deleted only if it belongs to the template of the host: the line stands in the main text of at least half of the
  host's distinct pages, of which there are ten or more. Sentences that pages quote from each other stay.
* A neighbour that has all of a page's lines, or that leaves almost nothing unshared in either page, is a copy and deletes nothing. If both neighbours
  leave little, but something, on either side, what all three pages share outside main text is their template: short posts look like that.
* Main text is not compared with a neighbour that has so much of it that this is most of the page.
* Without a neighbour to compare with, structure decides: main text where there is any, else doubtful text.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.operators.order import with_bucket
from tracemill.session import broadcast_if_small, stored

# Pages of one host between two cuts of the path order, on average; at most so many cuts are made.
PAGES_AT_ONCE = 2000
MOST_CUTS = 1000
# A neighbour is a copy if at most this part of the characters of either page is left unshared.
COPY_REST = 0.05
# Main text is not compared with a neighbour whose share of it is more than this part of the page's characters.
COPY_SHARE = 0.5
# Main text is a host's template if it stands on so large a part of its pages, of which there are at least so many.
TEMPLATE_SHARE = 0.5
TEMPLATE_PAGES = 10
# Hosts with a template, and pages that differ from what structure alone says, are sent to all tasks up to this number.
BROADCAST_ROWS = 200_000

_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>|<[!?/][^>]*+>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PART = re.compile(r"[a-z]+|\d+")

_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_FURNITURE = frozenset(
    "head nav footer aside form script style noscript template button select textarea title iframe object svg canvas dialog menu".split()
)
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
# Elements that a start tag closes, and where the search for them ends.
_CLOSES = {
    **{t: (("li",), ("ul", "ol", "menu")) for t in ("li",)},
    **{t: (("dd", "dt"), ("dl",)) for t in ("dd", "dt")},
    **{t: (("td", "th"), ("table", "tr")) for t in ("td", "th")},
    "tr": (("tr",), ("table",)),
    "option": (("option",), ("select",)),
}
_P_SCOPE = frozenset("html table td th caption button object template".split())
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner breadcrumb breadcrumbs comment comments consent cookie cookies cookiebar "
    "discussion disqus footer form gdpr hidden login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay "
    "pager pagination popup promo promotion promoted recommended related replies respond search share sharing sidebar signup skyscraper social "
    "sponsor sponsored subscribe subscription toolbar widget".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
_ROOTS = frozenset(("html", "body"))
_OUTER_WORDS = _WORDS | {"header"}
# Names as has-sidebar or no-comments tell of other elements.
_SAYS_OTHERS_HAVE = frozenset(("has", "with", "no", "non", "not", "without"))
_REPLIES = frozenset(("comment", "comments", "reply", "replies", "respond"))


def _marked(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is page furniture by tag or attributes; ``inside``: within an article or main element."""
    if tag in _FURNITURE or (tag == "header" and not inside):
        return True
    if tag in _ROOTS or not attributes or attributes == "/":
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        value = "".join(values).lower()
        if name in ("class", "id"):
            for one in value.split():
                found = _PART.findall(one)
                if tag in ("article", "main"):
                    if found and found[0] in _REPLIES and found[-1] not in ("open", "closed"):
                        return True
                elif found and found[0] not in _SAYS_OTHERS_HAVE and not (_WORDS if inside else _OUTER_WORDS).isdisjoint(found):
                    return True
        elif name == "role" and value in _ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


MAIN, DOUBTFUL, FURNITURE = 2, 1, 0


def lines(page: str) -> list[tuple[str, int]]:
    """The blocks of a page in order, each with its text and kind; without an article or main element none is MAIN."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, furniture, main: of the element and those around it
    text: list[str] = []
    furniture = main = found = False

    def flush() -> None:
        nonlocal found
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if joined:
                out.append((joined, FURNITURE if furniture else MAIN if main else DOUBTFUL))
                found |= main and not furniture

    def pop_to(at: int) -> None:
        nonlocal furniture, main
        del stack[at:]
        _, furniture, main = stack[-1] if stack else ("", False, False)

    def innermost(tags: tuple[str, ...], stop) -> int:
        for at in range(len(stack) - 1, -1, -1):
            if stack[at][0] in tags:
                return at
            if stack[at][0] in stop:
                break
        return -1

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            # A tag that the page's end cuts off is no text.
            cut = re.search(r"<[a-zA-Z/!?]", page[at:])
            text.append(page[at : at + cut.start()] if cut else page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            text.append(" ")
            continue
        block = tag in _BLOCK
        if block:
            flush()
        if m[1]:
            if (where := innermost((tag,), () if block else _BLOCK)) >= 0:
                pop_to(where)
            continue
        if tag in _VOID:
            continue
        if tag in _CLOSES:
            tags, stop = _CLOSES[tag]
            if (where := innermost(tags, stop)) >= 0:
                pop_to(where)
        elif block and (where := innermost(("p",), _P_SCOPE)) >= 0:
            pop_to(where)
        if tag in _RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        furniture = furniture or _marked(tag, m[3], main)
        main = main or (not furniture and (tag in ("article", "main") or 'role="main"' in m[3]))
        stack.append((tag, furniture, main))
    flush()
    return out if found else [(t, min(kind, DOUBTFUL)) for t, kind in out]


def kept(page: str) -> list[tuple[str, int]]:
    """Lines that structure alone leaves: main text where there is any, else doubtful text."""
    every = lines(page)
    least = MAIN if any(kind == MAIN for _, kind in every) else DOUBTFUL
    return [x for x in every if x[1] >= least]


def shared(own: list[int], other: list[int]) -> set[int]:
    """Positions of ``own`` in a longest common subsequence with ``other``; the k-th copy of a line matches the k-th."""
    seen: Counter[int] = Counter()
    place = {}
    for at, line in enumerate(other):
        place[line, seen[line]] = at
        seen[line] += 1
    seen.clear()
    tops: list[int] = []  # smallest last place of a subsequence of each length
    ends: list[int] = []
    before: dict[int, int] = {}
    for at, line in enumerate(own):
        to = place.get((line, seen[line]))
        seen[line] += 1
        if to is None:
            continue
        k = bisect_left(tops, to)
        before[at] = ends[k - 1] if k else -1
        if k == len(tops):
            tops.append(to)
            ends.append(at)
        else:
            tops[k], ends[k] = to, at
    out, at = set(), ends[-1] if ends else -1
    while at >= 0:
        out.add(at)
        at = before[at]
    return out


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


_LINES = "key long, sort_key string, host string, page struct<lines: array<long>, kinds: array<int>, sizes: array<int>>"
_TEXTS = "key long, page_id long, url string, text array<string>, plain array<int>"


def _parsed(pages: DataFrame, schema: str) -> DataFrame:
    """_LINES: the hash, kind and characters of all lines of each page, or _TEXTS: the text of all but furniture."""
    texts = schema == _TEXTS
    names = ["key", "page_id", "url", "text", "plain"] if texts else ["key", "sort_key", "host", "page"]
    page_kind = pa.struct([("lines", pa.list_(pa.int64())), ("kinds", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32()))])

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                keys, made, alone = [], [], []
                for k, page in enumerate(part.column(4)):
                    page = page.as_py() or ""
                    every = lines(page)
                    keys.append(_hash(f"{part.column(0)[k]}\n{part.column(1)[k]}\n{page}"))
                    if texts:
                        made.append([t for t, kind in every if kind != FURNITURE])
                        alone.append(plain([kind for _, kind in every]))
                    else:
                        made.append({"lines": [_hash(t) for t, _ in every], "kinds": [kind for _, kind in every], "sizes": [len(t) for t, _ in every]})
                ends = (part.column(0), part.column(1)) if texts else (part.column(2), part.column(3))
                columns = [pa.array(made, pa.list_(pa.string())), pa.array(alone, pa.list_(pa.int32()))] if texts else [pa.array(made, page_kind)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *ends, *columns], names)

    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    rows = rows.select("page_id", "url", F.coalesce(F.concat_ws(" ", host, path), F.lit("")).alias("sort_key"), F.coalesce(host, F.lit("")).alias("host"), "html")
    return rows.mapInArrow(run, schema)


def compared(page: dict, others: list[dict | None], template: set[int] = frozenset()) -> tuple[list[int], int]:
    """Places of the main text among a page's lines that are no furniture, and how many of these neighbours deleted.

    ``template``: the main lines that stand on most pages of the host.
    """
    own = [k for k, kind in enumerate(page["kinds"]) if kind != FURNITURE]
    kinds, sizes = [page["kinds"][k] for k in own], [page["sizes"][k] for k in own]
    chars = lambda places: sum(sizes[k] for k in places)
    doubtful, main = [[k for k, kind in enumerate(kinds) if kind == one] for one in (DOUBTFUL, MAIN)]
    total = chars(range(len(own)))
    found: list[set[int]] = []  # by neighbours that are no copies
    alike: list[set[int]] = []  # by neighbours that are copies or share a template with little text
    quoted: list[set[int]] = []  # main text
    for other in filter(None, others):
        in_main, anywhere = [
            {places[k] for k in shared([page["lines"][own[k]] for k in places], [line for line, kind in zip(other["lines"], other["kinds"]) if kind >= least])}
            for places, least in ((main, MAIN), (doubtful, FURNITURE))
        ]
        if chars(in_main) <= COPY_SHARE * total:
            quoted.append(in_main)
        its_total = sum(size for size, kind in zip(other["sizes"], other["kinds"]) if kind != FURNITURE)
        both = chars(in_main | anywhere)
        left, its_left = total - both, its_total - both
        if left > 0 and (left > COPY_REST * total or its_left > COPY_REST * its_total):
            found.append(anywhere)
        elif left > 0 and its_left > 0:
            alike.append(anywhere)
    if not found and len(alike) > 1 and (same := set.intersection(*alike)):
        found = [same]
    gone = set.union(set(), *found)
    if main:
        gone |= {k for k in set.union(set(), *quoted) if page["lines"][own[k]] in template}
        if not found:
            return [k for k in main if k not in gone], len(gone)
    return [k for k in range(len(own)) if k not in gone], len(gone)


def plain(kinds: list[int]) -> list[int]:
    """Places that structure alone keeps, among those that are no furniture."""
    kinds = [kind for kind in kinds if kind != FURNITURE]
    least = MAIN if MAIN in kinds else DOUBTFUL
    return [k for k, kind in enumerate(kinds) if kind >= least]


def _templates(places: DataFrame) -> DataFrame:
    """(host, template array<long>): the lines in the main text of most pages of a host, of which each page has its own few."""
    of_main = F.array_distinct(F.transform(F.filter(F.arrays_zip("page.lines", "page.kinds"), lambda x: x["kinds"] == MAIN), lambda x: x["lines"]))
    pages = places.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= TEMPLATE_PAGES)
    lines = places.select("host", F.explode(of_main).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    often = lines.join(stored(pages), "host").where(F.col("n") >= F.col("pages") * TEMPLATE_SHARE)
    return often.groupBy("host").agg(F.collect_list("line").alias("template"))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_shared) for each row of ``pages`` (page_id, url, html; no others are read).

    ``text``: the blocks of the main text with single blanks, joined by two line feeds; ``n_shared``: blocks outside page
    furniture that a neighbour deleted. Null or empty html has the text '' of 0 blocks. Pages without a usable url are
    neighbours of each other. Repeated rows are one page for their neighbours and come back each. An empty table gives none.
    Pages are parsed twice, so that only hashes of their lines are stored and sorted.
    """
    parsed = stored(_parsed(pages, _LINES))
    places = parsed.dropDuplicates(["key"])
    cuts = min(MOST_CUTS, max(1, parsed.count() // PAGES_AT_ONCE))
    order = Window.partitionBy("host", "_bucket").orderBy("sort_key", "key")
    placed = with_bucket(places, "sort_key", cuts)
    near = placed.select("host", "_bucket", "key", "page", F.lag("page").over(order).alias("before"), F.lead("page").over(order).alias("after"))
    # The last and first page of each host in a bucket meet across the cut; only hosts that a cut parts have rows here.
    place = F.struct("sort_key", "key")
    ends = placed.groupBy("host", "_bucket").agg(F.min_by("page", place).alias("first"), F.max_by("page", place).alias("last"))
    buckets = Window.partitionBy("host").orderBy("_bucket")
    ends = ends.select("host", "_bucket", F.lag("last").over(buckets).alias("_last"), F.lead("first").over(buckets).alias("_first"))
    near = near.join(ends.where("_last IS NOT NULL OR _first IS NOT NULL"), ["host", "_bucket"], "left")
    near = near.join(broadcast_if_small(stored(_templates(places)), BROADCAST_ROWS), "host", "left")
    near = near.select("key", "page", F.coalesce("before", "_last").alias("before"), F.coalesce("after", "_first").alias("after"), "template")

    def run(batches):
        for batch in batches:
            keys, made = [], []
            for key, page, *others, template in zip(*(batch.column(c).to_pylist() for c in range(5))):
                places, deleted = compared(page, others, set(template or ()))
                if deleted or places != plain(page["kinds"]):
                    keys.append(key)
                    made.append((places, deleted))
            columns = [pa.array([m[c] for m in made], kind) for c, kind in enumerate((pa.list_(pa.int32()), pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *columns], ["key", "kept", "n_shared"])

    # Pages whose neighbours change what structure alone keeps; the texts of the others need not meet them.
    changed = stored(near.mapInArrow(run, "key long, kept array<int>, n_shared long"))
    found = _parsed(pages, _TEXTS).join(broadcast_if_small(changed, BROADCAST_ROWS), "key", "left")
    blocks = F.transform(F.coalesce("kept", "plain"), lambda k: F.get("text", k))
    found = found.select("page_id", "url", blocks.alias("blocks"), F.coalesce("n_shared", F.lit(0).cast("long")).alias("n_shared"))
    text = F.array_join("blocks", "\n\n")
    return found.select("page_id", "url", text.alias("text"), F.char_length(text).cast("long").alias("n_chars"), F.size("blocks").cast("long").alias("n_blocks"), "n_shared")
