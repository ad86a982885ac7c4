"""Main text by template deduction: tokens of equal occurrence vectors form classes, nested classes a host's template, its slots the text.

A token is a tag or a run of text between two tags, each in its place (the path of open elements with their class names,
numbers left out). Over the pages of a host, a token's occurrence vector is its count on each page; it's kept as a sum of
page hash times count, so tokens of one class are those of equal sums, and sums are reduced before any shuffle, whatever
the number of the host's pages. A class is valid if it's on enough pages, not a lone run, and its tokens lie in one order;
valid classes nest from the pages' common class down into the template. What the template's tokens leave on a page are
its slots: blocks whose every run is a token of the template, in the template's order, are constant and go, the other
blocks are extracted. Element semantics (nav, footer, forms, ...) hold beside the template; class names are weak evidence.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrion.llm.common import dropped, written

#: Elements by what they mean for the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object canvas".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
FURNITURE = frozenset("head nav menu footer aside form button select option label fieldset dialog script style textarea title noscript template iframe svg math object canvas".split())
MAIN = ("article", "main")
CLOSES = {"p": frozenset(("p",)), "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "tr": frozenset(("tr", "td", "th")), "option": frozenset(("option",))}
_LIMITS = frozenset("html body article main section div nav aside footer header form table ul ol dl td th blockquote li dd".split())
#: Words of a class, id or role that name furniture.
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar aside footer header masthead topbar toolbar cookie cookies consent gdpr notice notices alert disclaimer popup modal overlay newsletter subscribe signup login comment comments reply replies disqus discussion respond share sharing social related recommended widget pagination pager copyright skip hidden complementary contentinfo search".split()
)
#: A name that starts so says what the page has or lacks, not what the element is.
STATES = frozenset("has with without no not".split())
#: Those of them that name what readers wrote; an element so named is furniture however much it holds.
READERS = frozenset("comment comments reply replies disqus discussion respond".split())
#: Elements that hold a page's text whatever their class; elements of prose, of which only a whole name counts; and the text beside main elements, as a share of theirs, up to which elements around them hold a page's text as well.
WRAPPERS, REST = frozenset(("html", "body", *MAIN)), 0.25
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote dd dt td th figure".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>", re.S)
_NAMING = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")
#: A class belongs to the template if it's on so large a share of a host's pages, and on so many different ones at least.
SUPPORT, LEAST_PAGES = 0.5, 5
#: Sums a worker holds before it passes them on, and names and paths it remembers; they bound its memory, not the pages.
HELD = 200_000


def furniture_words(name: str, attributes: str) -> frozenset[str]:
    """The words of a class, id or role that name furniture. Of prose elements a whole name must be such a word, so `search-algorithms` is none."""
    found: set[str] = set()
    for m in _NAMING.finditer(attributes):
        for own in m[1].strip("\"'").split():
            words = _WORD.findall(_CAMEL.sub(" ", own).lower())
            if words and words[0] not in STATES and (len(words) == 1 or name not in PROSE):
                found.update(w for w in words if w in FURNITURE_WORDS)
    return frozenset(found)


def hidden(attributes: str) -> bool:
    return "hidden" in attributes and re.search(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true", attributes, re.I) is not None


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, attributes or text) with kind open, close or text. Contents of raw elements are text of that element; comments go."""
    at, end, low = 0, len(page), None
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            yield "text", "", page[at:]
            return
        if m.start() > at:
            yield "text", "", page[at : m.start()]
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            yield "close", name, ""
            continue
        yield "open", name, m[3]
        if name in RAW and not m[3].endswith("/"):
            low = page.lower() if low is None else low
            close = low.find(f"</{name}", at) if len(low) == len(page) else -1
            if close < 0 and (c := re.compile(f"</{name}", re.I).search(page, at)):
                close = c.start()
            yield "text", name, page[at : close if close >= 0 else end]
            at = close if close >= 0 else end


_LABEL = re.compile(r"class\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)

#: A number in a class name that counts things and doesn't name a place.
_NUMBERED = re.compile(r"(?<=[-_])[0-9]+|[0-9]{3,}")


class _Tags(dict):
    """(label, furniture words, hidden) by (name, attributes), and path hashes by (parent path, label); emptied when full."""

    def __missing__(self, key: tuple) -> tuple | int:
        if len(self) > HELD:
            self.clear()
        if isinstance(key[0], int):
            value = xxhash.xxh3_64_intdigest(key[1].encode("utf-8", "replace"), key[0])
        else:
            name, attributes = key
            classes = _LABEL.search(attributes) if attributes else None
            label = name if classes is None else f"{name}.{_NUMBERED.sub('', classes[1].strip(chr(34) + chr(39)))}"
            value = (label, furniture_words(name, attributes) if attributes else frozenset(), hidden(attributes))
        self[key] = value
        return value


_TAGS = _Tags()


class Element:
    __slots__ = ("name", "parent", "path", "fixed", "main", "words", "off", "holds")

    def __init__(self, name: str, parent: Element | None, attributes: str = "") -> None:
        self.name, self.parent, self.holds = name, parent, False
        if parent is None:
            self.path, self.main, self.words, self.fixed = 0, False, frozenset(), False
        else:
            label, words, unseen = _TAGS[name, attributes]
            self.path = _TAGS[parent.path, label]
            self.main = parent.main or name in MAIN
            # a header within an article heads the article
            self.words = frozenset() if name in WRAPPERS else words - {"header"} if self.main else words
            self.fixed = parent.fixed or unseen or name in FURNITURE or name == "header" and not self.main
        self.resolve()

    def resolve(self) -> None:
        self.off = self.fixed or bool(self.words) and not self.holds or bool(self.parent and self.parent.off)


Event = tuple[str, Element, str]


def walk(page: str) -> list[Event]:
    """The page's events. Names don't put off what holds the page's main slot.

    Where names alone put all main elements off, and little text is left besides, the elements around these hold it; on a
    page without a main element, an element with most of the text does, but for readers' comments.
    """
    events = list(_events(page))
    opened = [e for kind, e, _ in events if kind == "open"]
    if not any(e.words for e in opened):
        return events
    mains = [e for e in opened if e.name in MAIN and not e.fixed]
    if mains and not all(e.off for e in mains):
        return events
    sizes: dict[Element, int] = {}
    beside = inside = 0
    for kind, element, text in events:
        if kind == "text" and not element.fixed and (n := len(text.strip())):
            if element.main:
                inside += n
            elif not element.off:
                beside += n
            above: Element | None = element
            while above is not None:
                sizes[above] = sizes.get(above, 0) + n
                above = above.parent
    holding: list[Element] = []
    if mains:
        if beside < REST * inside:
            holding = mains
    else:
        total = max(sizes.values(), default=0)
        holding = [e for e in opened if e.words and not e.words & READERS and sizes.get(e, 0) * (1 + REST) > total]
    for e in holding:
        above = e
        while above is not None and not above.holds:
            above.holds = True
            above = above.parent
    if holding:
        for e in opened:
            e.resolve()
    return events


def _events(page: str) -> Iterator[Event]:
    """(kind, element, text): open and close for every element in page order, closes made up where the page has none, and texts."""
    stack = [Element("", None)]
    for kind, name, value in tokens(page):
        if kind == "text":
            yield "text", stack[-1], value
        elif kind == "open":
            if name in CLOSES:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name in CLOSES[name]:
                        while len(stack) > k:
                            yield "close", stack.pop(), ""
                        break
                    if stack[k].name in _LIMITS:
                        break
            elif name in BLOCKS:
                # a block ends an open paragraph and what is open in it
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name == "p":
                        while len(stack) > k:
                            yield "close", stack.pop(), ""
                        break
                    if stack[k].name in BLOCKS:
                        break
            element = Element(name, stack[-1], value)
            yield "open", element, value
            if name in VOID or value.endswith("/"):
                yield "close", element, ""
            else:
                stack.append(element)
        elif any(e.name == name for e in reversed(stack)):
            while True:
                element = stack.pop()
                yield "close", element, ""
                if element.name == name:
                    break
    while len(stack) > 1:
        yield "close", stack.pop(), ""


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL, empty where there is none; one rule for both sides of the join."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1)
    return F.lower(F.coalesce(host, F.lit("")))


def run_token(path: int, text: str) -> int:
    """The token of a run of text in the element of a path, or 0 if it's blank. White space counts as one space."""
    text = " ".join(text.split())
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace"), path ^ 0x9E3779B97F4A7C15) or 1 if text else 0


TAG, RUN = 1, 2


def page_tokens(page: str) -> dict[int, list[int]]:
    """A page's tokens: [kind, path of the element around it, count, sum of first places, sum of last places]. What is in fixed furniture is no token, but its outermost element is."""
    found: dict[int, list[int]] = {}
    for place, (kind, element, text) in enumerate(walk(page)):
        if kind == "text":
            token = 0 if element.fixed else run_token(element.path, text)
            if token:
                own = found.setdefault(token, [RUN, element.path, 0, 0, 0])
                own[2] += 1
                own[3] += place
                own[4] += place
        elif element.parent is not None and not element.parent.fixed:
            own = found.setdefault(element.path, [TAG, element.parent.path, 0, 0, 0])
            if kind == "open":
                own[2] += 1
                own[3] += place
            else:
                own[4] += place
    return found


_SUMS = ("kind", "parent", "mask", "high", "low", "pages", "times", "first", "last")


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def passed(sums):
        columns = list(zip(*sums.values(), strict=True)) or [[]] * 8
        vector = [v & (2**64 - 1) for v in columns[3]]
        signed = lambda values: pa.array([v - 2**64 if v >= 2**63 else v for v in values], pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in sums], pa.string()), signed(k[1] for k in sums), pa.array(columns[0], pa.int32()), signed(columns[1]), signed(columns[2]),
                pa.array([v >> 32 for v in vector], pa.int64()), pa.array([v & (2**32 - 1) for v in vector], pa.int64()), *(pa.array(c, pa.int64()) for c in columns[4:]),
            ],
            names=["host", "token", *_SUMS],
        )

    for batch in batches:
        sums: dict[tuple[str, int], list[int]] = {}
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not page:
                continue
            vector = xxhash.xxh3_64_intdigest(page.encode("utf-8", "replace"))
            bit = 1 << (vector >> 58)
            for token, (kind, parent, n, first, last) in [(0, (0, 0, 1, 0, 0)), *page_tokens(page).items()]:
                s = sums.get((host, token))
                if s is None:
                    sums[host, token] = [kind, parent, bit, vector * n, 1, n, first, last]
                else:
                    s[2] |= bit
                    s[3] += vector * n
                    s[4] += 1
                    s[5] += n
                    s[6] += first
                    s[7] += last
            if len(sums) > HELD:
                yield passed(sums)
                sums = {}
        if sums:
            yield passed(sums)


def occurrences(pages: DataFrame) -> DataFrame:
    """(host, token, kind, parent, mask, high, low, pages, times, first, last) over all pages (host, html) of a host: sums, reduced in the worker and before the shuffle.

    Token 0 stands for the page itself. high and low are sums of the halves of the vector; bits of mask tell how many
    different pages there are at least, so copies of one page make no template.
    """
    rows = pages.mapInArrow(_occurrences, "host string, token bigint, kind int, parent bigint, mask bigint, high bigint, low bigint, pages bigint, times bigint, first bigint, last bigint")
    return rows.groupBy("host", "token").agg(F.first("kind").alias("kind"), F.first("parent").alias("parent"), F.bit_or("mask").alias("mask"), *(F.sum(c).alias(c) for c in _SUMS[3:]))


def in_order(tokens: list[dict]) -> list[dict]:
    """Tokens of one class, sorted by place, without those that cut across another: over all pages of the class, the places of an element's tags enclose or avoid those of any other token."""
    kept: list[dict] = []
    open_ends: list[int] = []
    for t in sorted(tokens, key=lambda t: (t["first"], -t["last"])):
        while open_ends and open_ends[-1] <= t["first"]:
            open_ends.pop()
        if open_ends and t["last"] > open_ends[-1]:
            continue
        if t["last"] > t["first"]:
            open_ends.append(t["last"])
        kept.append(t)
    return kept


def deduce(rows: list[dict]) -> list[int]:
    """The template's runs of a host in page order, from the sums of its frequent tokens.

    Tokens of equal vector, pages and times are a class. A class of one run alone is none. From the root down, a class's
    tokens enter the template where the element around them is in it.
    """
    whole = next((r for r in rows if r["token"] == 0), None)
    if whole is None:
        return []
    classes: dict[tuple, list[dict]] = {}
    for r in rows:
        if r["token"] and r["pages"] >= SUPPORT * whole["pages"] and (r["mask"] & (2**64 - 1)).bit_count() >= LEAST_PAGES:
            classes.setdefault(((r["high"] << 32) + r["low"] & 2**64 - 1, r["pages"], r["times"]), []).append(r)
    valid = [in_order(c) for c in classes.values() if len(c) > 1 or c[0]["kind"] == TAG]
    within: dict[int, list[dict]] = {}
    for t in (t for c in valid for t in c):
        within.setdefault(t["parent"], []).append(t)
    nested, template = [0], []
    while nested:
        now = within.get(nested.pop(), [])
        template += now
        nested += [t["token"] for t in now if t["kind"] == TAG]
    runs = [t for t in template if t["kind"] == RUN]
    return [t["token"] for t in sorted(runs, key=lambda t: (t["first"] / t["times"], t["token"]))]


def _templates(group: pd.DataFrame) -> pd.DataFrame:
    rows = [{k: int(v) for k, v in r.items()} for r in group.drop(columns="host").to_dict("records")]
    return pd.DataFrame({"host": [group["host"].iloc[0]], "runs": [deduce(rows)]})


def templates(pages: DataFrame) -> DataFrame:
    """(host, runs): the runs of each host's template, from pages (host, html). Only tokens on enough of a host's pages reach its task, so a task's size is that of a page."""
    seen = written(occurrences(pages), "tokens")
    whole = seen.where("token = 0").where(F.bit_count("mask") >= LEAST_PAGES).select("host", F.col("pages").alias("of"))
    often = seen.where(F.bit_count("mask") >= LEAST_PAGES).join(whole, "host").where(F.col("pages") >= SUPPORT * F.col("of")).drop("of")
    found = written(often.groupBy("host").applyInPandas(_templates, "host string, runs array<bigint>").where(F.size("runs") > 0), "templates")
    dropped(seen)
    return found


def _blocks(events: list[Event]) -> list[list[tuple[Element | None, str]]]:
    blocks: list[list[tuple[Element | None, str]]] = [[]]
    for kind, element, text in events:
        if kind == "text":
            if not element.off:
                blocks[-1].append((element, text))
        elif element.name in BLOCKS:
            if blocks[-1]:
                blocks.append([])
        elif element.name in ("br", "img") and kind == "open":
            blocks[-1].append((None, " "))
    return blocks


def _slots(blocks: list[list[tuple[Element | None, str]]], runs: dict[int, int]) -> list[list[tuple[Element | None, str]]]:
    """The blocks but the constant ones: those of template runs only, as long as they follow the template's order."""
    kept, last = [], -1
    for block in blocks:
        at = [runs.get(t - 2**64 if t >= 2**63 else t) for e, text in block if e is not None and (t := run_token(e.path, text))]
        if at and None not in at and at == sorted(at) and at[0] >= last:
            last = at[-1]
        else:
            kept.append(block)
    return kept


def _lines(blocks: list[list[tuple[Element | None, str]]]) -> list[str]:
    return [line for b in blocks if b and (line := _SPACE.sub(" ", html_lib.unescape("".join(text for _, text in b))).strip())]


def extract(page: str | None, runs: list[int] | None) -> str:
    """The text of a page's slots, block by block: those of its main elements where it has any, else all that aren't furniture. A page of which the template leaves nothing (a copy of others) is read without it."""
    if not page:
        return ""
    blocks = _blocks(walk(page))
    mains = [b for b in ([x for x in block if x[0] is None or x[0].main] for block in blocks) if any(e is not None for e, _ in b)]
    if _lines(mains):
        blocks = mains
    if runs:
        left = _lines(_slots(blocks, {r: i for i, r in enumerate(runs)}))
        if left:
            return "\n".join(left)
    return "\n".join(_lines(blocks))


#: Templates up to so many bytes in all are broadcast; beyond, pages are joined to them in a shuffle.
BROADCAST_BYTES = 8 * 2**20


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row.

    Null or empty html: empty text. Pages with a null or odd URL form a host of their own. A host with few different pages
    has no template and is read by the elements' meaning and names, as is a page that its host's template leaves nothing
    of. Exact copies of a page count once for each copy, with one vector, and as one page. Repeated rows and null ids
    return as they are; an empty table gives no rows; other columns are not read. Long pages are read whole.
    """
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).withColumn("host", host_of(F.col("url")))
    found = templates(source.select("host", "html"))
    size = found.agg(F.sum(F.length("host") + 8 * F.size("runs"))).first()[0] or 0
    joined = source.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p, r) for p, r in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "runs").mapInArrow(run, f"page_id {source.schema[0].dataType.simpleString()}, url string, text string, n_chars bigint")
