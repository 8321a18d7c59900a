"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks at block-level tags. Pass 1 scores each block by itself:

    score = 2 * length * stop words - 3 * link density + prior

length grows to 1 at `LONG` code points; stop words run from below 0 (none) to 1 (a share of `STOP_HIGH`);
the prior comes from the element, role and class names around the block: `SURE`, which no score makes up for,
in menus, footers, sidebars, notices, adverts, forms and comments, `LIKELY` under weaker words, a little above 0 in an article. Where
nothing but headings is left outside marked places, marked blocks that would be good by their words are good. A
score of `GOOD` makes a block good, one of `BAD` or less bad, and what lies between, as short blocks do,
is ambiguous. On pages without the stop words known here length and links decide.

Pass 2 lets ambiguous blocks inherit the label of the nearest decided neighbour (the one before, at
equal distance): a heading that of the next block that isn't marked; others that of a like block, of the same
element in the same parent; failing that, a block of an article is good, and any other takes the
label of the nearest decided block at all. On a page without a good block, those from the first heading on are
good; with no decided block, those without links.

An anchor without href is no link, and a block that ends closes the links opened in it. Character
references are decoded, formulas are text, white space in a block becomes one space, blocks are trimmed and joined in page
order by one space.

Defined results: a null or empty page gives the empty text; broken markup is read as far as
it goes, an unfinished tag or comment ends the page, as does a script or the like that isn't closed; other elements without text, as pictures or lists of choices, end where they are
closed or closed at once, and are passed over if they never are; an unmatched closing tag is passed over; repeated rows
give equal rows; an empty table gives an empty result; pages of any length are read whole, in time that grows
with their length; columns named text or n_chars give way to the new ones.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.common import table, with_results

#: Block-level elements, elements whose content is no markup (to the end of the page, if they aren't closed), others whose content is no text (if they are closed), and those that never hold main text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style title textarea iframe noframes noembed xmp".split())
SKIPPED = frozenset("template svg canvas object audio video select noscript head annotation annotation-xml".split())
BOILER = frozenset("nav footer aside form button dialog menu fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Words in a class or id that mark what isn't main text, and those that often do.
MARKED = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup register replies reply respond search share sharing sidebar signup skip sponsor sponsored subscribe subscription toolbar topbar".split()
)
OFTEN = frozenset("banner byline copyright disclaimer feedback header legal masthead promo promotion recommended related social tags teaser widget widgets".split())
#: Frequent words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "the of and to in is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may long little very after words called just where most know "
    "der die das und in zu den mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei ich wenn "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son lui nous comme mais on si leur y dont elle deux aux était cette fait être même sans ces "
    "el los y del se las por con no una su para al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso".split()
)
#: Priors of blocks that are marked, that are often no main text, and of an article; scores that decide.
SURE, LIKELY, ARTICLE, GOOD, BAD = -4.0, -1.5, 0.3, 1.2, -0.5
#: Code points that count as long, shares of stop words that count as none and as full, and what counts on pages without any.
LONG, STOP_LOW, STOP_HIGH, STOP_UNKNOWN = 140, 0.08, 0.3, 0.7

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*+(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?)*+)(>|\Z)|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    #: element, the number of its parent element, prior
    tag: str = ""
    parent: int = 0
    prior: float = 0.0
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    #: True good, False bad, None ambiguous; and the rule that said so
    good: bool | None = None
    by: str = ""

    @property
    def heading(self) -> bool:
        return self.tag[:1] == "h" and self.tag[1:].isdigit()


def _mark(tag: str, attributes: str, in_article: bool) -> float:
    """The prior that an element brings: SURE, LIKELY or 0."""
    found = SURE if tag in BOILER else LIKELY if tag == "header" and not in_article else 0.0
    if not attributes or tag in ("html", "body", "main"):
        return found
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return SURE
        if name == "style" and _HIDDEN.search(value):
            return SURE
        if name in ("class", "id"):
            words = _NAME.findall(_CAMEL.sub("-", value).lower())
            if tag == "header" or in_article and tag in ("h1", "h2", "h3"):
                words = [w for w in words if w != "header"]
            if not MARKED.isdisjoint(words):
                return SURE
            if not OFTEN.isdisjoint(words):
                found = min(found, LIKELY)
    return found


@dataclass
class _Open:
    tag: str
    number: int
    mark: float
    article: bool
    linked: bool


def blocks(html: str) -> list[Block]:
    """The page's blocks of text, in order."""
    found: list[Block] = []
    opened: list[_Open] = []
    names: Counter[str] = Counter()
    sure = likely = article = 0
    linked = False
    unclosed: dict[str, bool] = {}
    number = at = 0
    block = Block()

    def text(part: str) -> None:
        if part:
            block.parts.append(part)
            if linked:
                block.linked += len("".join(unescape(part).split()))

    def cut() -> None:
        nonlocal block
        if block.parts:
            block.text = " ".join(unescape("".join(block.parts)).split())
            if block.text:
                found.append(block)
        prior = SURE if sure else LIKELY if likely else ARTICLE if article else 0.0
        block = Block(opened[-1].tag if opened else "", opened[-2].number if len(opened) > 1 else 0, prior)

    def close() -> None:
        nonlocal sure, likely, article, linked
        gone = opened.pop()
        names[gone.tag] -= 1
        sure, likely, article, linked = sure - (gone.mark == SURE), likely - (gone.mark == LIKELY), article - gone.article, gone.linked

    while at < len(html):
        m = _TOKEN.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        closing = bool(m[1])
        if tag in RAW or tag in SKIPPED:
            if closing or unclosed.get(tag) or tag in SKIPPED and m[3].endswith("/"):
                continue
            # head is skipped to its end, or to the body where that is missing
            end = re.compile(r"</head(?=[\s/>])[^>]*>|(?=<body\b)" if tag == "head" else rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            if end is not None:
                at = end.end()
            elif tag in RAW:
                at = len(html)
            else:
                unclosed[tag] = True  # nor does a later one end: it isn't sought again
            continue
        if tag == "br":
            block.parts.append(" ")
            continue
        if tag == "a":
            linked = not closing and any(name.lower() == "href" for name, *_ in _ATTRIBUTE.findall(m[3]))
            continue
        if tag not in BLOCKS and tag != "button":
            continue
        if closing:
            if names[tag]:
                while opened[-1].tag != tag:
                    close()
                close()
            cut()
            continue
        if tag == "hr":
            cut()
            continue
        if tag in ("p", "li", "dt", "dd", "td", "th", "tr") and opened and opened[-1].tag == tag:
            close()  # these end without a closing tag where the next begins
        mark = _mark(tag, m[3], article > 0)
        is_article = tag in ("article", "main") and not mark
        number += 1
        opened.append(_Open(tag, number, mark, is_article, linked))
        names[tag] += 1
        sure, likely, article = sure + (mark == SURE), likely + (mark == LIKELY), article + is_article
        cut()
    cut()
    return found


def _stop_words(text: str) -> tuple[int, int]:
    words = text.lower().split()
    return sum(w.strip(".,;:!?") in STOP_WORDS for w in words), len(words)


def _label(score: float) -> bool | None:
    return True if score >= GOOD else False if score <= BAD else None


def _judge(page: list[Block]) -> None:
    """Pass 1: each block by its stop words, length and links, and the prior of its place."""
    counts = [_stop_words(b.text) for b in page]
    plain = [c for b, c in zip(page, counts, strict=True) if b.prior != SURE]
    known = sum(s for s, _ in plain) >= 0.05 * sum(n for _, n in plain)
    scores = []
    for b, (stop, n) in zip(page, counts, strict=True):
        dense = (min(stop / n, STOP_HIGH) - STOP_LOW) / (STOP_HIGH - STOP_LOW) if known else STOP_UNKNOWN
        link = b.linked / len(b.text.replace(" ", ""))
        own = 2 * min(1.0, len(b.text) / LONG) * dense - 3 * link
        scores.append(own)
        b.good = _label(own + b.prior)
        if b.good is not None:
            b.by = "prior" if _label(own) != b.good else "links" if link > 0.2 else "words"
    if not any(b.prior != SURE and not b.heading and b.good is not False for b in page):
        for b, own in zip(page, scores, strict=True):
            if b.prior == SURE and b.tag not in BOILER and _label(own):
                b.good, b.by = True, "only"


def _nearest(at: list[int], i: int, page: list[Block]) -> bool:
    """The label of the block among the rising places `at` that is nearest to place i."""
    k = bisect(at, i)
    before, after = (at[k - 1] if k else None), (at[k] if k < len(at) else None)
    return bool(page[after if before is None or after is not None and after - i < i - before else before].good)


def _inherit(page: list[Block]) -> None:
    """Pass 2: ambiguous blocks take the label of a decided neighbour."""
    decided = [i for i, b in enumerate(page) if b.good is not None]
    unmarked = [i for i in decided if page[i].prior != SURE]
    like: dict[tuple[str, int], list[int]] = {}
    for i in unmarked:
        like.setdefault((page[i].tag, page[i].parent), []).append(i)
    some = any(page[i].good for i in decided)
    first = None if some else next((i for i, b in enumerate(page) if b.good is None and b.heading), None)
    labels: list[tuple[int, bool, str]] = []
    for i, b in enumerate(page):
        if b.good is not None:
            continue
        follows = bisect(unmarked, i)
        alike = like.get((b.tag, b.parent))
        if b.heading and follows < len(unmarked):
            labels.append((i, bool(page[unmarked[follows]].good), "follows"))
        elif alike:
            labels.append((i, _nearest(alike, i, page), "alike"))
        elif b.prior == ARTICLE:
            labels.append((i, True, "article"))
        elif first is not None and i >= first:
            labels.append((i, b.linked == 0, "heading"))
        elif decided:
            labels.append((i, _nearest(decided, i, page), "near"))
        else:
            labels.append((i, b.linked == 0, "alone"))
    for i, good, by in labels:
        page[i].good, page[i].by = good, by


def judged(html: str | None) -> list[Block]:
    """The page's blocks, each good or bad and by which rule."""
    page = blocks(html or "")
    _judge(page)
    _inherit(page)
    return page


def main_text(html: str | None) -> str:
    return " ".join(b.text for b in judged(html) if b.good)


def extract(pages: DataFrame) -> DataFrame:
    """pages with text and n_chars instead of html."""
    def made(html: list[str | None]) -> list[pa.Array]:
        texts = [main_text(h) for h in html]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return with_results(pages, made, "text string, n_chars long", "html")


def op6_block_rules(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
