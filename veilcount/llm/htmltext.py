"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags.  First pass: a block is bad when it
stands in a container of boilerplate (navigation, header or footer of the page,
aside, form, or an element, paragraphs included, whose class, id or role says advert,
notice, menu, comment, ...) or is mostly links; good when it is long enough and dense
in stop words; undecided otherwise.  On pages in languages whose stop words are not
known (under ``KNOWN`` of the words) a block's sentence ends and length are the
measure in place of its density.  Where the page marks its article (article, main,
itemprop articleBody), blocks outside it are bad and its borders count as good
neighbours.  Second pass: undecided blocks inherit from the nearest decided neighbours
of their section; if the two disagree the nearer one wins, and bad wins a tie.

Text is what a browser's parser would see: comments are dropped, character references
decoded, tags need no end.  Raw text (script, style, ...) and elements that are not text
(svg, buttons, selections, players, ...) are skipped with all that nests in them, as are
inline elements that say advert or share buttons.  An end tag that is missing costs no
text: a skipped element without one ends at the next block-level tag, only script and
style run on to the end of the page as in browsers; a link without one ends with its
block.  White space within a block becomes one space; blocks are joined by one line feed.

Defined cases: null or empty html gives empty text; malformed markup never fails; a very
long page is read in one pass, without a limit; a tie between neighbours is bad;
repeated rows are repeated; an empty table gives an empty result; extra columns are
ignored, whatever their names, unless named in ``keep``.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_CHARS, LONG_CHARS, STOP_LOW, STOP_HIGH, LINK_SHARE, KNOWN = 40, 140, 0.15, 0.3, 0.5, 0.05

# Element names of HTML, words that name boilerplate in class and id, and stop words.
RAW = "script style title textarea iframe noscript noembed noframes xmp".split()
SKIP = "svg math button select object canvas audio video template datalist map".split()
BLOCK = "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
BAD = "nav aside form footer menu dialog option optgroup".split()
NAMES = "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget alert".split()
INLINE = "ad ads advert adverts advertisement advertising promo promoted share sharing social sponsor sponsored".split()
STOP = set(
    "the of and to in is that it for on with as are was be by this at or from an not but which have had his they you were all their has there been if more when will would who so no a "
    "de la le les et des en un une du que est pour dans qui sur pas au par plus ce il ne se avec son ou mais aux sont elle été cette ces nous vous leur on être fait "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über "
    "el los las y del se por con una su para como más pero sus al lo esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos".split()
)

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.S)
_NAMED = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_LETTERS = re.compile(r"[^\W\d_]+")
_ANCHOR = re.compile(r"<(/?)a(?=[\s>/])", re.I)
_SENTENCE = re.compile(r"[.!?\u2026\u061f\u06d4\u0964\u0589][\"'\u201d\u2019\u00bb)\]]*(?=\s|$)|[\u3002\uff01\uff1f]")
_WIDE = re.compile(r"[\u2e80-\u9fff\uac00-\ud7af\uff00-\uffef]")
_RAW, _SKIP, _BLOCK, _VOID, _BAD, _NAMES, _INLINE = map(frozenset, (RAW, SKIP, BLOCK, VOID, BAD, NAMES, INLINE))
_EDGE = re.compile(rf"</?(?:{'|'.join(BLOCK)})(?=[\s>/])", re.I)
_OWN = frozenset("body html article main".split())
#: What a start tag ends if that is open.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _ends(page: str, name: str) -> dict[int, int]:
    """Of each start tag of an element that is skipped and has an end tag: where it begins, and where the end tag ends."""
    out: dict[int, int] = {}
    open_: list[int] = []
    for m in re.compile(rf"<(/?){name}(?=[\s>/])[^>]*>", re.I).finditer(page):
        if not m[1] and not m[0].endswith("/>"):
            open_.append(m.start())
        elif m[1] and open_:
            if name in _RAW:  # nothing nests
                out |= dict.fromkeys(open_, m.end())
                open_.clear()
            else:
                out[open_.pop()] = m.end()
    return out


class Block(NamedTuple):
    text: str
    linked: int  # characters in links
    bad: bool  # by its container
    section: int  # 0 outside an article, else the article's number


def _words_of(attributes: str) -> set[str]:
    found = " ".join(a or b or c for a, b, c in _NAMED.findall(attributes))
    return set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", found).lower()))


class _Reader:
    """What is open while a page is read, and the blocks so far."""

    def __init__(self) -> None:
        self.out: list[Block] = []
        self.stack: list[tuple[str, bool, int]] = []  # element, whether bad, section
        self.parts: list[str] = []
        self.linked = self.sections = self.deep = 0
        self.link = self.loose = False
        self.mute = ""
        self.ends: dict[str, dict[int, int]] = {}

    def past(self, page: str, name: str, start: int, at: int) -> int:
        """Where to go on after the start tag, from start to at, of an element that is skipped."""
        if name not in self.ends:
            self.ends[name] = _ends(page, name)
        if start in self.ends[name]:
            return self.ends[name][start]
        if name in ("script", "style"):
            return len(page)
        if name in _RAW:
            return at
        edge = _EDGE.search(page, at)
        return edge.start() if edge else len(page)

    def close(self) -> None:
        """A border of blocks."""
        if self.parts:
            text = " ".join(entities.unescape("".join(self.parts)).split())
            if text:
                bad, section = self.stack[-1][1:] if self.stack else (False, 0)
                self.out.append(Block(text, min(self.linked, len(text)), bad, section))
            self.parts = []
        self.linked = 0
        self.mute = ""
        if self.loose:
            self.link = self.loose = False

    def say(self, raw: str) -> None:
        if raw and not self.mute:
            self.parts.append(raw)
            if self.link:
                self.linked += len(raw.strip())

    def pop(self, name: str) -> None:
        if any(x[0] == name for x in self.stack):
            while self.stack.pop()[0] != name:
                pass

    def push(self, name: str, attributes: str) -> None:
        """A block-level element begins."""
        self.close()
        while self.stack and self.stack[-1][0] in ("p", "option", "optgroup") and (name, self.stack[-1][0]) != ("option", "optgroup"):
            self.stack.pop()
        ends = _ENDS.get(name, ())
        while self.stack and self.stack[-1][0] in ends:
            self.stack.pop()
        if name in _VOID:
            return
        bad, section = self.stack[-1][1:] if self.stack else (False, 0)
        words = _words_of(attributes) if "=" in attributes else set()
        named = bool(words & _NAMES) and name not in _OWN
        bad = bad or name in _BAD or named or (name == "header" and not section) or (name == "article" and bool(words & {"comment", "comments", "reply", "replies", "related", "promo", "ad"}))
        if not section and not bad and (name in ("article", "main") or "articlebody" in words or {"article", "body"} <= words):
            self.sections += 1
            section = self.sections
        self.stack.append((name, bad, section))


def blocks(page: str) -> list[Block]:
    r = _Reader()
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            r.say(page[at:])
            break
        r.say(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name == r.mute:
                r.deep -= 1
                if not r.deep:
                    r.mute = ""
            if name == "a":
                r.link = r.loose = False
            if name in _BLOCK:
                r.close()
                r.pop(name)
            continue
        if name in _RAW or name in _SKIP:
            if not m[3].rstrip().endswith("/"):
                at = r.past(page, name, m.start(), at)
        elif name in ("br", "wbr"):
            r.say(" " if name == "br" else "")
        elif name in _BLOCK:
            r.push(name, m[3])
        else:
            if name == "a":
                following = _ANCHOR.search(page, at)
                r.link, r.loose = True, not (following and following[1])
            if name == r.mute:
                r.deep += 1
            elif not r.mute and "=" in m[3] and name not in _VOID and _words_of(m[3]) & _INLINE:
                r.mute, r.deep = name, 1
    r.close()
    return r.out


def _density(text: str) -> tuple[int, int]:
    words = _LETTERS.findall(text.lower())
    return sum(w in STOP for w in words), len(words)


def judge(found: list[Block]) -> list[bool]:
    """Whether each block belongs to the main text."""
    marked = any(b.section and not b.bad for b in found)
    outside = [b.bad or (marked and not b.section) or (b.linked > LINK_SHARE * len(b.text) and not b.section) for b in found]
    counts = [(0, 0) if out else _density(b.text) for b, out in zip(found, outside, strict=True)]
    known = sum(x for x, _ in counts) >= KNOWN * sum(n for _, n in counts)
    decided: list[bool | None] = []
    for b, out, (stops, n) in zip(found, outside, counts, strict=True):
        wide = 0 if known else len(_WIDE.findall(b.text))
        if out:
            decided.append(False)
        elif len(b.text) + 2 * wide < MIN_CHARS:
            decided.append(None)
        elif not known:
            ends = len(_SENTENCE.findall(b.text))
            decided.append(True if ends > 1 or (ends and len(b.text) + 2 * wide >= LONG_CHARS) else None if b.section or ends else False if b.linked else None)
        else:
            density = stops / max(1, n)
            if density >= STOP_HIGH or (density >= STOP_LOW and len(b.text) >= LONG_CHARS):
                decided.append(True)
            elif b.section or density >= STOP_LOW:
                decided.append(None)
            else:
                decided.append(False if b.linked else None)
    n = len(found)
    before: list[tuple[int, bool | None]] = []
    near: tuple[int, bool | None] = (n + 1, None)
    section = 0
    for i, d in enumerate(decided):
        if found[i].section != section:  # a border of an article counts as a good neighbour
            section = found[i].section
            near = (0, True) if section else (n + 1, None)
        if d is not None and (not section or d or not found[i].bad):
            near = (0, d)
        before.append(near)
        near = (near[0] + 1, near[1])
    out = [bool(d) for d in decided]
    near, section = (n + 1, None), 0
    for i in range(n - 1, -1, -1):
        if found[i].section != section:
            section = found[i].section
            near = (0, True) if section else (n + 1, None)
        d = decided[i]
        if d is not None and (not section or d or not found[i].bad):
            near = (0, d)
        if d is None:
            (p, left), (q, right) = before[i], near
            good = left if p < q else right if q < p else bool(left and right)
            out[i] = bool(left if right is None else right if left is None else good)
        near = (near[0] + 1, near[1])
    if not any(out) and not marked:  # nothing decided anywhere: what is not bad by its container or links is the text
        out = [d is None for d in decided]
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    return "\n".join(b.text for b, good in zip(found, judge(found), strict=True) if good)


def extract(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per page: page_id, url (or the columns of ``keep``), text, n_chars."""
    keep = keep or ["page_id", "url"]
    fields = pages.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*keep, "text", "n_chars"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "text string, n_chars bigint"])
    return pages.select(*keep, F.col("html").cast("string")).mapInArrow(run, schema)
