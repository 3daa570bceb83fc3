"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text. A linear classifier gives each block a cost for being boilerplate and one for being
content; these are the capacities to the two terminals. Blocks that follow each other, and blocks that have the same
parent, are tied by edges whose capacity grows with the part of their ancestors that they share. The minimum cut
labels the page; blocks on the content side are the text, in page order, one line each. On a tie a block is
boilerplate.

Null and empty pages have the empty text. Markup may be unclosed or unbalanced. A row that repeats a page_id is a page
of its own. Nothing is cut off: a page is read whole.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetgrove.llm.common import slices, small_batches

CHUNK = 4 << 20

#: Elements of HTML by how they count here.
RAW = frozenset("script style iframe textarea title".split())
#: Elements that are no text of the page, if they are closed; the start tag of an unclosed one is passed over.
SKIPPED = frozenset("noscript template svg object canvas select button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html label legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that a new one of their kind closes.
CLOSES = {"p": frozenset({"p"}), "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"})}
#: Words in class, id and role that speak for boilerplate and for content.
NOISE_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright dialog disqus footer form gdpr header "
    "login masthead menu modal nav navbar navigation newsletter notice outbrain pager pagination paywall popup popover privacy promo promoted promotion recommended related replies reply "
    "respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola teaser toc toolbar topbar tracking warning widget widgets complementary "
    "contentinfo discussion responses adsense sidebox rail".split()
)
CONTENT_WORDS = frozenset("article articlebody content entry entrytext main maincontent post postbody posttext story storybody body text prose".split())
#: Costs of the classifier, in tenths.
WEIGHTS = {
    "noise_element": -400, "noise_word": -300, "outside_main": -120, "inside_main": 60, "content_word": 40, "heading": 15, "paragraph": 20, "links": -60, "long": 25, "short": -10, "sentence": 15, "bias": -5,
}
NOISE_ELEMENTS = frozenset("nav footer aside form menu dialog fieldset label legend option".split())
#: Capacities of the edges, in tenths: to the next block, to the next one of the same parent, and more for shared ancestors.
NEXT, SIBLING, SHARED = 6, 6, 12

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
SENTENCE = re.compile(r"[.!?…。]['\")\]]*$")


@dataclass
class Block:
    path: tuple[int, ...]  # numbers of the open elements
    tags: tuple[str, ...]
    words: frozenset[str]
    text: str
    linked: int  # characters inside links


@dataclass
class _Open:
    number: int
    tag: str
    words: frozenset[str] = field(default=frozenset())


def named(attributes: str) -> list[str]:
    """Words of class, id and role. What an element merely has or lacks, and the head of an article, are no boilerplate."""
    words: list[str] = []
    for _, *values in NAMED.findall(attributes):
        for token in "".join(values).split():
            own = WORD.findall(CAMEL.sub(" ", token).lower())
            if own and own[0] in ("has", "with", "no", "without", "is"):
                continue
            words += [x for x in own if x != "header"] if not CONTENT_WORDS.isdisjoint(own) else own
    return words


def closed(page: str, tag: str) -> dict[int, int]:
    """Where the content of each closed element of a kind begins, and where its own end tag ends; they may be nested."""
    begun: list[int] = []
    ends: dict[int, int] = {}
    for mark in TOKEN.finditer(page):
        if (mark[1] or "").lower() != tag:
            continue
        if mark[0][1] != "/":
            if not mark[2].rstrip().endswith("/"):
                begun.append(mark.end())
        elif begun:
            ends[begun.pop()] = mark.end()
    return ends


def blocks(page: str) -> list[Block]:
    """The blocks of text of a page, in order. A block ends where a block element begins or ends."""
    found: list[Block] = []
    stack: list[_Open] = []
    parts: list[tuple[str, bool]] = []
    links = count = 0
    at, end = 0, len(page)
    skips: dict[str, dict[int, int]] = {}

    def close() -> None:
        if parts:
            text = " ".join("".join(x for x, _ in parts).split())
            if text:
                linked = sum(len(x.strip()) for x, in_link in parts if in_link)
                holders = [o for o in stack if o.tag in BLOCK]
                words = frozenset().union(*(o.words for o in stack))
                found.append(Block(tuple(o.number for o in holders), tuple(o.tag for o in stack), words, text, linked))
            parts.clear()

    while at < end:
        mark = TOKEN.search(page, at)
        stop = mark.start() if mark else end
        if stop > at:
            parts.append((entities.unescape(page[at:stop]), links > 0))
        if mark is None:
            break
        at = mark.end()
        tag = (mark[1] or "").lower()
        if not tag:
            if mark[0].startswith("<![CDATA["):
                parts.append((mark[0][9:].removesuffix("]]>"), links > 0))
            continue
        if mark[0][1] == "/":
            if tag in BLOCK:
                close()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in BLOCK and tag not in BLOCK:
                    break
            links = sum(o.tag == "a" for o in stack)
            continue
        if tag in RAW and not mark[2].rstrip().endswith("/"):
            over = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|$)", re.IGNORECASE).search(page, at)
            at = over.end() if over else end
            continue
        if tag in SKIPPED:
            if tag not in skips:
                skips[tag] = closed(page, tag)
            at = skips[tag].get(at, at)
            continue
        if tag in BLOCK:
            close()
            for k in range(len(stack) - 1, -1, -1):
                # A block element ends an open paragraph; items end the item before them.
                if stack[k].tag in CLOSES.get(tag, ()) or stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in BLOCK:
                    break
            links = sum(o.tag == "a" for o in stack)
        elif tag == "br":
            parts.append((" ", links > 0))
        if tag in VOID or mark[2].rstrip().endswith("/"):
            continue
        words = [] if tag in ("html", "body") else named(mark[2])
        if re.search(r"\bhidden\b(?!\s*=\s*[\"']?false)|display\s*:\s*none", mark[2], re.IGNORECASE) and tag not in ("body", "html"):
            words.append("popup")
        count += 1
        stack.append(_Open(count, tag, frozenset(words)))
        links += tag == "a"
    close()
    return found


def evidence(block: Block, has_main: bool) -> int:
    """What the classifier says: over 0 for content."""
    w, tags = WEIGHTS, block.tags
    inside = "article" in tags or "main" in tags
    score = w["bias"]
    noise = not NOISE_ELEMENTS.isdisjoint(tags) or "header" in tags and not inside
    if noise:
        score += w["noise_element"]
    if block.words & NOISE_WORDS:
        score += w["noise_word"]
    if block.words & CONTENT_WORDS:
        score += w["content_word"]
    if has_main:
        score += w["inside_main"] if inside else w["outside_main"]
    if not HEADINGS.isdisjoint(tags):
        score += w["heading"]
    if tags and ("p" in tags or "blockquote" in tags or "pre" in tags):
        score += w["paragraph"]
    size = len(block.text)
    score += w["links"] * min(block.linked, size) // size
    score += w["long"] if size >= 80 else w["short"] if size < 25 else 0
    if SENTENCE.search(block.text):
        score += w["sentence"]
    return score


def ties(found: list[Block]) -> list[tuple[int, int, int]]:
    """(i, j, capacity) of blocks in a row and of the next block with the same parent."""
    edges: dict[tuple[int, int], int] = {}

    def near(i: int, j: int, base: int) -> None:
        a, b = found[i].path, found[j].path
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        edges[i, j] = edges.get((i, j), 0) + base + SHARED * n // max(len(a), len(b), 1)

    last: dict[int, int] = {}
    for j, block in enumerate(found):
        if j:
            near(j - 1, j, NEXT)
        parent = block.path[-2] if len(block.path) > 1 else -1
        if parent in last:
            near(last[parent], j, SIBLING)
        last[parent] = j
    return [(i, j, c) for (i, j), c in edges.items()]


def minimum_cut(costs: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Whether each node is on the source side of the smallest minimum cut.

    A node with cost c is tied to the source by c if c > 0, else to the sink by -c. A node whose own tie outweighs all
    its edges keeps its side in every minimum cut; it is taken out and its edges become ties of its neighbours. Shortest
    augmenting paths saturate what remains.
    """
    n = len(costs)
    around: list[dict[int, int]] = [{} for _ in range(n)]
    for i, j, c in edges:
        if i != j and c > 0:
            around[i][j] = around[i].get(j, 0) + c
            around[j][i] = around[j].get(i, 0) + c
    own, side = list(costs), [None] * n
    weight = [sum(a.values()) for a in around]
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if side[i] is not None:
            continue
        if own[i] > weight[i]:
            side[i] = True
        elif own[i] <= -weight[i]:
            side[i] = False
        else:
            continue
        for j, c in around[i].items():
            del around[j][i]
            weight[j] -= c
            own[j] += c if side[i] else -c
            queue.append(j)
        around[i] = {}
    rest = [i for i in range(n) if side[i] is None]
    # Residual capacities: between nodes, from the source, to the sink.
    flow = {i: dict(around[i]) for i in rest}
    source = {i: own[i] for i in rest if own[i] > 0}
    sink = {i: -own[i] for i in rest if own[i] < 0}
    while True:
        came: dict[int, int | None] = {i: None for i, c in source.items() if c > 0}
        queue = deque(came)
        goal = None
        while queue:
            i = queue.popleft()
            if sink.get(i, 0) > 0:
                goal = i
                break
            for j, c in flow[i].items():
                if c > 0 and j not in came:
                    came[j] = i
                    queue.append(j)
        if goal is None:
            for i in rest:
                side[i] = i in came
            return side
        path = [goal]
        while came[path[-1]] is not None:
            path.append(came[path[-1]])
        amount = min([sink[goal], source[path[-1]], *(flow[b][a] for a, b in zip(path, path[1:], strict=False))])
        sink[goal] -= amount
        source[path[-1]] -= amount
        for a, b in zip(path, path[1:], strict=False):
            flow[b][a] -= amount
            flow[a][b] += amount


def main_text(page: str) -> str:
    found = blocks(page)
    has_main = any("article" in b.tags or "main" in b.tags for b in found)
    keep = minimum_cut([evidence(b, has_main) for b in found], ties(found))
    return "\n".join(b.text for b, kept in zip(found, keep, strict=True) if kept)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each whole page; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", CHUNK):
            found = [main_text(x) for x in batch.column("html").to_pylist()]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
