"""Main text of web pages by block rules in two passes.

A page is cut into blocks at block-level tags. Blocks inside elements that are never the article (menus, footers, forms,
elements whose class or id says so) are left out at once. In the first pass the other blocks are classed by link density, by
stop-word density and by length: good, bad, or undecided when short or without stop words. In the second pass an undecided
block takes the label of the nearest decided one of its region, and that of the region if there is none. Regions are the
article or main elements; where they hold as much good text as the rest of the page, nothing outside of them is kept. A form that holds one
of them, or most of the page's stop words, is not left out.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: Share of linked characters from which on a block is bad, and share of stop words that a good block has.
LINK_DENSITY, STOP_DENSITY = 0.5, 0.2
#: Share of link characters that a long block may have to stand without stop words.
FEW_LINKS = 0.2
#: Characters of a block long enough to be decided.
LONG = 70

# fixed lists: stop words of English, French, German and Spanish
STOP_WORDS = frozenset(
    "the of and to in is that it for was on are as with be by this from at or an a "
    "le la les de des du un une et en que qui est pas pour dans sur au avec "
    "der die das und von den mit ist im nicht ein eine zu sich auf für als auch "
    "el los las y una por con para del se lo su como más no al".split()
)
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section select summary table tbody td "
    "tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp template".split())
_CHROME = frozenset("head nav footer aside form button select menu dialog svg object template noscript".split())
_REGIONS = frozenset("article main".split())
_CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog menu menubar alert form".split())
_CHROME_NAMES = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent "
    "cookie cookies disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices "
    "notification overlay pagination pager paywall popup promo promoted promotion recommended related replies search share sharing "
    "sidebar signup social sponsor sponsored subscribe subscription teaser toc toolbar topbar widget".split()
)
#: What an opening tag closes that was left open, up to the nearest element of the second set.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
_HOLDS_P = frozenset("article aside blockquote body button caption dd details dialog div fieldset figure footer form header html li main nav section table td th".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|[="'])*+)(?:>|\Z)""", re.S)
_NAMES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Marks what a page has or lacks, not what an element is: "with-sidebar", "no-sidebar".
_PREFIXES = ("with-", "with_", "no-", "no_", "has-", "has_")
#: Page builders set these on elements of any content; what else such an element is called decides.
_WHOLE = frozenset("widget search".split())
_FORM_END, _HAS_REGION = re.compile("</form", re.I), re.compile(r"<(?:article|main)\b", re.I)
_SPACE = re.compile(r"\s+")
_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    linked: int
    region: int


@dataclass
class _Place:
    tag: str
    chrome: bool
    region: int
    linked: bool


def _named_chrome(value: str) -> bool:
    """Whether a class or id has a chrome name as a token, or at an end of one (site-footer, cookie-notice)."""
    for token in value.split():
        parts = re.split(r"[^a-z]+", token)
        if token in _CHROME_NAMES - _WHOLE or not token.startswith(_PREFIXES) and not _CHROME_NAMES.isdisjoint({parts[0], parts[-1]} - _WHOLE):
            return True
    return False


class _Outline:
    """Where a page has stop words, ends of forms, and article or main elements; each is looked for once."""

    def __init__(self, page: str):
        plain = _TOKEN.sub(lambda m: " " * len(m[0]), page)
        self.stops = [m.start() for m in _LETTERS.finditer(plain) if m[0].lower() in STOP_WORDS]
        self.ends = [m.start() for m in _FORM_END.finditer(page)]
        self.regions = [m.start() for m in _HAS_REGION.finditer(page)]
        self.size = len(page)

    def frames_page(self, at: int) -> bool:
        """Whether the form that opens before `at` is the frame of the page."""
        after = bisect_left(self.ends, at)
        end = self.ends[after] if after < len(self.ends) else self.size
        held = bisect_left(self.stops, end) - bisect_left(self.stops, at)
        return bisect_left(self.regions, end) > bisect_left(self.regions, at) or 2 * held > len(self.stops) > 0


def _is_chrome(tag: str, attributes: str, inside: _Place) -> bool:
    if tag in _CHROME or (tag == "header" and not inside.region):
        return True
    for name, *values in _NAMES.findall(attributes):
        value = "".join(values).lower()
        if name.lower() == "role":
            if value.strip() in _CHROME_ROLES:
                return True
        elif tag not in ("body", "html", *_REGIONS) and _named_chrome(value):
            return not (inside.region and "header" in value)
        elif tag == "article" and "comment" in value:
            return True
    return False


def blocks(page: str) -> list[Block]:
    """Blocks with text that stand outside of chrome; region 0 is the page, others number its article and main elements."""
    stack = [_Place("", False, 0, False)]
    out: list[Block] = []
    pieces: list[str] = []
    linked = regions = 0
    outline: _Outline | None = None

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = _SPACE.sub(" ", "".join(pieces)).strip()
            if text:
                out.append(Block(text, linked, stack[-1].region))
            pieces.clear()
        linked = 0

    def close(tags: set[str] | frozenset[str], border: set[str] | frozenset[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in border:
                return

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not stack[-1].chrome:
            text = entities.unescape(raw)
            pieces.append(text)
            if stack[-1].linked:
                linked += len(_SPACE.sub("", text))

    at, lower = 0, None
    for token in iter(lambda: _TOKEN.search(page, at), None):
        add(page[at : token.start()])
        at = max(token.end(), token.start() + 1)
        tag = (token[2] or "").lower()
        if not tag:
            continue
        if tag in _BLOCKS:
            flush()
        elif tag in ("br", "img", "wbr"):
            pieces.append(" " if tag != "wbr" else "")
        if token[1]:
            close({tag}, set())
            continue
        if tag in _RAW:
            lower = page.lower() if lower is None else lower
            end = lower.find(f"</{tag}", at) if len(lower) == len(page) else -1
            if end < 0:
                found = re.compile(f"</{tag}", re.I).search(page, at)
                end = found.start() if found else len(page)
            at = end
            continue
        if tag in _VOID or token[3].rstrip().endswith("/") and tag not in _BLOCKS:
            continue
        if tag in _BLOCKS:
            close({"p"}, _HOLDS_P)
        if tag in _CLOSES:
            close(*_CLOSES[tag])
        inside = stack[-1]
        region = inside.region
        if tag in _REGIONS and not (tag == "article" and region and inside.chrome):
            regions += 1
            region = regions
        chrome = inside.chrome or _is_chrome(tag, token[3], inside)
        if tag == "form" and chrome and not inside.chrome:
            outline = outline or _Outline(page)
            chrome = not outline.frames_page(at)
        stack.append(_Place(tag, chrome, region, inside.linked or tag == "a"))
    add(page[at:])
    flush()
    return out


def first_pass(block: Block) -> bool | None:
    """True: good, False: bad, None: undecided."""
    solid = len(block.text) - block.text.count(" ")
    if block.linked >= LINK_DENSITY * max(solid, 1):
        return False
    if len(block.text) < LONG:
        return None
    words = _LETTERS.findall(block.text.lower())
    stops = sum(w in STOP_WORDS for w in words)
    return True if words and stops >= STOP_DENSITY * len(words) else None


def _long(block: Block) -> bool:
    return len(block.text) >= LONG and block.linked < FEW_LINKS * len(block.text)


def second_pass(found: list[Block]) -> list[bool]:
    """Labels of all blocks. Undecided short ones take the label of the nearest decided block of their region, the good one of two as
    near; long ones with few links are only bad between bad ones on both sides.

    Stop words may say nothing about a page (another language, code, lists): in a region where they make no block good, its long
    blocks with few links are good, and without any of those all undecided ones are, as chrome is out already.
    """
    labels = [first_pass(b) for b in found]
    members: dict[int, list[int]] = {}
    for i, b in enumerate(found):
        members.setdefault(b.region, []).append(i)
    for places in members.values():
        if not any(labels[i] for i in places):
            long = [i for i in places if labels[i] is None and _long(found[i])]
            for i in long or [i for i in places if labels[i] is None]:
                labels[i] = True
    out = [bool(x) for x in labels]
    for places in members.values():
        near: list[list[tuple[int, bool]]] = [[] for _ in places]
        for order in (range(len(places)), range(len(places) - 1, -1, -1)):
            last = None
            for k in order:
                if labels[places[k]] is not None:
                    last = k
                elif last is not None:
                    near[k].append((abs(k - last), not labels[places[last]]))
        for k, i in enumerate(places):
            if labels[i] is None:
                both_bad = len(near[k]) == 2 and all(bad for _, bad in near[k])
                out[i] = not both_bad if _long(found[i]) else not min(near[k])[1] if near[k] else True
    return out


def main_text(page: str) -> str:
    """The blocks labelled good, joined by an empty line; those of article or main elements only, if they hold as much good text as the rest."""
    found = blocks(page)
    kept = [b for b, good in zip(found, second_pass(found), strict=True) if good]
    inner = [b for b in kept if b.region]
    decided = [b for b in kept if first_pass(b)] or kept
    good = [sum(len(b.text) for b in decided if bool(b.region) == inside) for inside in (True, False)]
    return "\n\n".join(b.text for b in (inner if inner and good[0] >= good[1] else kept))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h or "") for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row; a null or empty page has an empty text. Pages don't meet each other, so
    repeated rows and ids give rows of their own and very long pages only weigh on their task. Other columns are not read."""
    prepare(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
