"""Main text of web pages by two-pass block rules.

Markup is cut into blocks at block-level tags. The first pass scores each block by stop-word
density, length and link density; what the markup says of the elements around it is a
weight in that score, for or against. A block is content, boilerplate, or ambiguous. The
second pass gives ambiguous blocks the label of their nearest decided neighbours.

A wrapper is no evidence: an element that holds every block of the page that reads like
prose (two at least, or one of long prose) counts for nothing, whatever its class says, so
that a name on a layout division, or a form around the whole page, can't empty it. Where
no article or main reads like prose, no name outvotes long prose of many stop words, but
those of readers' comments and of teasers, which are prose themselves. Where no list of stop words fits a page's language,
sentence marks stand in for them.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.llm.common import small_batches

# Frequent function words of eight languages.
STOP_WORDS = frozenset(
    "a about after all also an and are as at be been but by can could for from had has have he her his if in into is it its more not of on "
    "one or other our out she so some than that the their them then there these they this to up was we were what when which who will with would you "
    "aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer es für hat ich im in ist mit nach nicht "
    "noch nur oder sein sich sie sind über um und von war wie wird zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ont ou par pas plus pour qu que qui sa se ses "
    "son sont sur un une vous "
    "al como con de del el en entre era es esta este fue ha hay la las lo los más me no o para pero por que se ser si sin sobre su sus también "
    "un una y ya "
    "che con da dal della di e gli il in la le nel non per più sono un una "
    "com da das do dos e em mais não na no os para por que se uma "
    "в на и с по не что как это из для от но к у за он она они его же бы был была было все так о или мы вы "
    "και το η ο να του της την των με για από που στο στη είναι δεν θα ένα μια".split()
)
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that stay open over the blocks inside them; the others end where the next block begins.
HELD_TAGS = BLOCK_TAGS - frozenset("p li dt dd td th tr option hr h1 h2 h3 h4 h5 h6".split())
#: Their content is no markup, up to their end tag.
RAW_TAGS = frozenset("script style title textarea xmp iframe noembed noframes".split())
#: Left out where they are closed; an unclosed one is no reason to lose what follows.
SHUT_TAGS = frozenset("noscript template svg object canvas audio video select button".split())
#: What no reader sees as text of the page.
CONTROLS = frozenset("option optgroup legend".split())

# Weights of the elements around a block.
TAG_WEIGHT = {"nav": -5, "footer": -5, "aside": -5, "form": -5, "menu": -5, "dialog": -5, "fieldset": -5, "header": -4, "article": 2, "main": 1}
ROLE_WEIGHT = {r: -5 for r in "navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split()} | {"main": 1, "article": 2}
# Names that authors give to parts of a page.
AGAINST = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion banner sidebar cookie cookies consent gdpr notice notices "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social menu nav navbar navigation breadcrumb breadcrumbs footer masthead pagination pager toolbar widget".split()
)
# Of those, the names of parts that are prose themselves.
PROSE_AGAINST = frozenset("related recommended recommendations comment comments commentlist disqus respond replies".split())
IN_FAVOUR = frozenset("article content entry post story maintext bodytext".split())
DENIED = frozenset("no has with without is not hide show".split())
PROSE_NAME_AGAINST, NAME_AGAINST, NAME_IN_FAVOUR = -5, -4, 1
OUTSIDE = -2  # what it says against a block that it stands beside an article
BOUNDED = -1  # what a name that is not of prose can say against long prose

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORD = re.compile(r"[^\W\d_]+")
_PIECES = re.compile(r"[^a-z0-9]+")
_MARKS = re.compile(r"[.!?;:,…。！？；，、।۔؟،]")
_ENDS = re.compile(r"[.!?…。！？।۔؟](?:[\"'»”’)\]]*)(?:\s|$)|[。！？।۔؟]")
_WIDE = re.compile(r"[⺀-鿿가-힯฀-๿]")

LONG, SHORT = 200, 70
STOP_LOW, STOP_HIGH = 0.15, 0.25
LINKS, ALL_LINKS = 0.3, 0.8
GOOD, BAD, MOST = 2, -2, 3


@dataclass
class Element:
    tag: str
    weight: int
    hidden: bool = False
    soft: bool = False  # nothing but a name that is not of prose speaks against it
    may_wrap: bool = False  # a name or a form is no evidence where it holds all that reads like prose


@dataclass
class Block:
    text: str
    links: int
    tag: str
    around: list[Element] = field(default_factory=list)  # outermost first, the block's own element last

    @property
    def inside(self) -> bool:
        return any(e.tag in ("article", "main") for e in self.around)


def _name_weight(names: str) -> int:
    """What class and id names say: by their first or last piece, unless the first denies it."""
    found = 0
    for name in names.lower().split():
        pieces = [p for p in _PIECES.split(name) if p]
        if not pieces or (len(pieces) > 1 and DENIED & set(pieces[:-1])):
            continue
        ends = {pieces[0], pieces[-1]}
        if ends & PROSE_AGAINST:
            found = PROSE_NAME_AGAINST
        elif ends & AGAINST:
            found = min(found, NAME_AGAINST)
        elif ends & IN_FAVOUR and not found:
            found = NAME_IN_FAVOUR
    return found


def _element(tag: str, attributes: str, inside: bool) -> Element:
    weight = TAG_WEIGHT.get(tag, 0)
    if tag == "header" and inside:
        weight = 0
    if not attributes or attributes == "/" or tag in ("html", "body"):
        return Element(tag, weight, may_wrap=tag == "form")
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attributes)}
    bare = _ATTR.sub(" ", attributes).lower().split()
    hidden = "hidden" in bare or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none", found.get("style", ""), re.I))
    role = ROLE_WEIGHT.get(found.get("role", "").lower(), 0)
    name = _name_weight(found.get("class", "") + " " + found.get("id", "")) if tag not in ("article", "main") else 0
    low = min(weight, role, name)
    named = min(weight, role) >= 0
    return Element(tag, low if low < 0 else max(weight, role, name), hidden, named and name == NAME_AGAINST, tag == "form" or named)


def blocks_of(html: str | None) -> list[Block]:
    """The page's blocks in order, blank ones left out."""
    page = html or ""
    out: list[Block] = []
    open_: list[Element] = []
    own: Element | None = None
    parts: list[str] = []
    links, in_link, at = 0, False, 0

    def flush():
        nonlocal links
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                last = own or (open_[-1] if open_ else None)
                out.append(Block(text, links, last.tag if last else "", [*open_, *([own] if own else [])]))
            parts.clear()
        links = 0

    def add(text: str):
        nonlocal links
        parts.append(text)
        if in_link:
            links += len(text.strip())

    while at < len(page):
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        if lt > at:
            add(page[at:lt])
        after = page[lt + 1 : lt + 2]
        if after in ("!", "?"):
            end = page.find("-->", lt + 4) + 3 if page.startswith("<!--", lt) else page.find(">", lt) + 1
            at = end if end > 2 or (end and not page.startswith("<!--", lt)) else len(page)
            continue
        m = _TAG.match(page, lt)
        if m is None:
            end = page.find(">", lt)
            if not (after.isalpha() or after == "/") or end < 0:
                add("<")  # no tag: a bare sign
                at = lt + 1
            else:
                at = end + 1  # quotes that don't close
            continue
        at = m.end()
        closing, tag = m[1] == "/", m[2].lower()
        if tag in RAW_TAGS or tag in SHUT_TAGS:
            if not closing and not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                if end:
                    at = end.end()
                elif tag in RAW_TAGS:
                    at = len(page)
            add(" ")
            continue
        if tag == "a":
            in_link = not closing
            continue
        if tag in ("br", "img", "input"):
            add(" ")
            continue
        if tag not in BLOCK_TAGS:
            continue
        if tag in ("td", "th"):  # cells of one row are one block
            add(" ")
            continue
        flush()
        in_link, own = False, None
        if closing:
            if any(e.tag == tag for e in open_):
                while open_.pop().tag != tag:
                    pass
            continue
        element = _element(tag, m[3], any(e.tag in ("article", "main") for e in open_))
        if tag in HELD_TAGS:
            open_.append(element)
        else:
            own = element
    flush()
    return out


def stop_density(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def sentence_density(text: str) -> float:
    """Stands in for stop words: prose has a mark for every few dozen letters and ends sentences."""
    letters = sum(3 if _WIDE.match(c) else 1 for c in text if not c.isspace())
    if not letters or not _ENDS.search(text):
        return 0.0
    return min(1.0, 18 * len(_MARKS.findall(text)) / letters)


def prose_score(block: Block, density: float) -> int:
    """What the text alone says: from -4 (links) to 3 (long prose)."""
    size = sum(2 if _WIDE.match(c) else 1 for c in block.text) if _WIDE.search(block.text) else len(block.text)
    linked = block.links / max(1, len(block.text))
    if linked > ALL_LINKS:
        return -3 if not block.inside else -1
    if linked > LINKS and not block.inside:
        return -3
    if size < SHORT:
        return 0
    if density >= STOP_HIGH or (size >= LONG and density >= STOP_LOW):
        return MOST if size >= LONG else 2
    if block.inside or size < LONG:
        return 0
    return -2 if density < STOP_LOW else 0


def first_pass(blocks: list[Block]) -> list[bool | None]:
    """For each block True: content; False: boilerplate; None: ambiguous."""
    stops = [stop_density(b.text) for b in blocks]
    long = [i for i, b in enumerate(blocks) if len(b.text) >= SHORT]
    if long and max(stops[i] for i in long) < STOP_LOW:  # a language that the list doesn't know
        stops = [sentence_density(b.text) for b in blocks]
    prose = [prose_score(b, d) for b, d in zip(blocks, stops, strict=True)]
    reads = [i for i, p in enumerate(prose) if p >= GOOD]
    held: dict[int, int] = {}
    for i in reads:
        for e in blocks[i].around:
            held[id(e)] = held.get(id(e), 0) + 1

    article = any(region(blocks[i]) for i in reads)

    def wraps(e: Element) -> bool:
        return held.get(id(e), 0) == len(reads) and (len(reads) > 1 or (e.soft and not article and prose[reads[0]] == MOST))

    def weight(b: Block, p: int) -> int:
        """The heaviest evidence against the block, or else the strongest for it, of the elements that are no
        wrappers. Against long prose a name counts little."""
        bounded = p == MOST and not article
        found = [BOUNDED if bounded and e.soft else e.weight for e in b.around if not (e.may_wrap and reads and wraps(e))]
        if article and not region(b):  # the page has an article, and the block is not in it
            found.append(BOUNDED if p == MOST else OUTSIDE)
        low = min(found, default=0)
        return low if low < 0 else max(found, default=0)

    label: list[bool | None] = []
    for b, p in zip(blocks, prose, strict=True):
        w = weight(b, p)
        score = p + w
        hidden = b.tag in CONTROLS or any(e.hidden and not (reads and wraps(e)) for e in b.around)
        ambiguous = p <= 0 and not b.links > LINKS * len(b.text) and w >= 0
        label.append(False if hidden or score <= BAD else None if ambiguous and score < GOOD + 1 else score >= GOOD if abs(score) >= GOOD else False if score < 0 else None)
    return label


def region(block: Block) -> int:
    """The innermost article or main that holds the block: neighbours are looked for in there."""
    return next((id(e) for e in reversed(block.around) if e.tag in ("article", "main")), 0)


def second_pass(blocks: list[Block], label: list[bool | None]) -> list[bool]:
    """Ambiguous blocks take the label of the nearest decided block of their region; of two as near,
    content wins. Where a region has none, its blocks count if it is an article or main, or the page has neither."""
    label = list(label)
    regions = [region(b) for b in blocks]
    for r in set(regions):
        own = [i for i, x in enumerate(regions) if x == r]
        decided = [i for i in own if label[i] is not None and not (label[i] is False and _apart(blocks[i]))]
        k = 0
        for i in [i for i in own if label[i] is None]:
            while k < len(decided) and decided[k] < i:
                k += 1
            near = [(abs(decided[j] - i), not label[decided[j]]) for j in (k - 1, k) if 0 <= j < len(decided)]
            label[i] = not min(near)[1] if near else bool(r) or not any(regions)
    return [bool(x) for x in label]


def _apart(block: Block) -> bool:
    """Boilerplate by its markup says nothing of the block next to it."""
    return any(e.weight < 0 or e.hidden for e in block.around)


def kept(blocks: list[Block]) -> list[str]:
    """Texts of the blocks that count as content, in page order."""
    return [b.text for b, x in zip(blocks, second_pass(blocks, first_pass(blocks)), strict=True) if x]


def main_text(html: str | None) -> str:
    """The page's content blocks, joined by blank lines."""
    return "\n\n".join(kept(blocks_of(html)))


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages(page_id, url, html)``.

    Null or empty html has empty text; nothing is capped; repeated rows and null ids keep
    their rows; an empty table gives none. Other columns are ignored.
    """
    small_batches(pages.sparkSession, 500)

    def run(batches):
        for batch in batches:
            text = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
