"""Sentence units of documents in any language, as offsets into the text.

Two automata run over a text. The first goes line by line and cuts it into blocks: fenced code, headings, quoted lines,
trailers, list items, paragraphs; its stack holds the indentations of the list levels that are open. The second is a
pushdown automaton over a block: its stack holds the quotations and brackets that are open, code spans and numbers are
passed over, and an end mark ends a sentence only with an empty stack, or where it closes the last open quotation. Whether
a full stop is one is decided by a trie of abbreviations, read backwards from it, and by what stands on both sides; scripts
with their own end marks need no white space behind them, and scripts without any are cut at their spaces.

Every step moves on through the text or takes from a stack what was put there once, so the time grows with the length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space of Unicode, as code points.
SPACES = "\t\n\v\f\r \x85\xa0                　"

# Abbreviations that are followed by more of their sentence, lower case, without the last full stop.
ALWAYS_GO_ON = """
mr mrs ms dr prof e.g i.e vs cf viz ca approx fig figs sec eq ch pp v rel ver messrs st mt gen col sgt capt rev hon
nr abschn buchst hr vgl bspw evtl ggf inkl z d u sog zzgl abs bd hrsg dipl ing
env c.-à-d p art chap éd mme mlle mm
sr sra srta dra d.ª pág págs cap aprox ej núm vol
см рис разд напр ок гл им ул т ср табл тов проф
π.χ περ κα κ δηλ βλ αρ σελ
د أ ص
डॉ श्री प्रो श्रीमती
""".split()

# Abbreviations that can also stand at the end of a sentence; what follows decides.
MAY_END = """
etc inc ltd co corp jr ave blvd rd a.m p.m u.s u.k e.u ph.d al ret no est dept
jan feb mar apr jun jul aug sep sept oct nov dec mon tue tues wed thu thurs fri sat sun
usw bzw ff fr m
janv févr avr juil déc ex
ee uu
г гг стр с др д пр е
κ.λπ κ.ά μ.μ π.μ
""".split()

# What a quoted sentence is continued with where case tells nothing.
GO_ON_WORDS = frozenset("and or but was is are were said says asked wrote replied then which that when as in on for with from to who it".split())
NUMBER_FOLLOWS = frozenset("no nr nos fig sec jan feb mar apr jun jul aug sep sept oct nov dec p v".split())
NAME_FOLLOWS = frozenset("inc ltd co corp ave blvd rd u.s u.k e.u al jr".split())
SENTENCE_OPENERS = frozenset(
    "the a an this that these those it its we i you they he she there here if when while after before as at by for from in on to with "
    "why what who how where does do did is are was can both see use read call write wait keep ask prefer please no nobody some since".split()
)
GERMAN_BEFORE_ORDINAL = frozenset("der die das dem den des am im vom zum zur bis und ab seit beim jeder jede jedes jeden".split())

FENCE = re.compile(r"[ \t]{0,3}(`{3,}|~{3,})")
HEADING = re.compile(r"\s{0,4}#{1,6}(?=\s)")
QUOTED = re.compile(r"\s{0,4}>")
ITEM = re.compile(r"([^\S\n]*)(?:[-+*•‣◦·–]|\d{1,4}[.)]|[a-zA-Z][)])\s+(?=\S)")
TRAILER = re.compile(r"(?:([A-Za-z][A-Za-z0-9]*(?:-[A-Za-z0-9]+)+)|[A-Z][A-Za-z0-9]*):[ \t]+\S")
ENDED = re.compile(r"[.!?…]\s*\Z")
UNDERLINE = re.compile(r"\s{0,3}(?:=+|-{3,})\s*$")
LINES = re.compile(r"[^\n]*(?:\n|$)")

#: End marks that need no white space behind them, and those of Unicode's Sentence_Terminal that do.
WIDE_ENDS = frozenset("。！？｡．။។៕።፧᙮᠃᠉༎།")
SPACED_ENDS = ".!?…؟۔։܀܁।॥‼⁇⁈⁉⸮"
END_CLASS = re.escape("".join(sorted(WIDE_ENDS)))
MARKS = re.compile(
    r"(?<!`)(`++)(?:(?!\1).)+?\1|https?://[^\s<>　-鿿＀-￯]*[^\s<>　-鿿＀-￯.,;:!?…)\]\"'»”]|"
    + rf"[{END_CLASS}][{END_CLASS}!?…]*|[{re.escape(SPACED_ENDS)};]+|[\"'“”„‘’«»‹›「」『』（）()\[\]{{}}《》〈〉【】]", re.DOTALL
)
PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "「": "」", "『": "』", "《": "》", "〈": "〉", "【": "】"}
CLOSERS = {v: k for k, v in PAIRS.items()}
QUOTES = {"“": "”", "„": "“", "‘": "’", "«": "»", "»": "«", "‹": "›", "›": "‹"}
THAI = re.compile(r"(?<=[฀-ๅ็-๎])[ \t\r\n ]+(?=[฀-๎])")
CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯＀-￯]")
SAYS = re.compile(r"[^。！？]{0,12}?(?:问|问道|说|写道|答|喊|道|表示)")
BREAKS = frozenset("\"“”„‘«»‹›「」『』（）()[]{}《》〈〉【】")
SPACE = re.compile(r"\s")


def _trie(words: list[str], verdict: str, root: dict | None = None) -> dict:
    """Abbreviations by their letters from the end, as they are read backwards from a full stop."""
    root = {} if root is None else root
    for word in words:
        node = root
        for letter in reversed(word):
            node = node.setdefault(letter, {})
        node.setdefault("", verdict)
    return root


ABBREVIATIONS = _trie(MAY_END, "maybe", _trie(ALWAYS_GO_ON, "never"))


def _abbreviation(word: str) -> str | None:
    node = ABBREVIATIONS
    for letter in reversed(word):
        if (node := node.get(letter)) is None:
            return None
    return node.get("")


def _trailers(lines: list[str]) -> set[int]:
    """Numbers of the lines ``Key: value`` that are trailers.

    They close a paragraph. A key of several words with hyphens makes one there in any case, another only where the whole
    paragraph is of such lines, as in prose a line can begin like that too, and not all of them end like sentences.
    """
    out: set[int] = set()
    run: list[int] = []  # the lines of this form that the paragraph ends with so far
    paragraph = 0

    def close() -> None:
        whole = len(run) == paragraph and not all(ENDED.search(lines[k]) for k in run)
        out.update(k for k in run if whole or TRAILER.match(lines[k]).group(1))

    for k, line in enumerate(lines):
        if not line.strip(SPACES):
            close()
            run, paragraph = [], 0
            continue
        paragraph += 1
        if TRAILER.match(line):
            run.append(k)
        else:
            run = []
    close()
    return out


def _blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, divisible) of the blocks of a text."""
    fence, fence_start = "", 0
    start = end = -1  # of the running paragraph or list item
    n_lines = 0  # of the running block
    levels: list[int] = []  # indentations of the open list levels
    spans = [m.span() for m in LINES.finditer(text) if m.end() > m.start()]
    lines = [text[a:b] for a, b in spans]
    trailers = _trailers(lines)
    for k, (a, b) in enumerate(spans):
        line = lines[k].lstrip("﻿") if a == 0 else lines[k]
        if fence:
            bare = line.strip(SPACES)
            if bare and not bare.strip(fence[0]) and len(bare) >= len(fence):
                yield fence_start, b, False
                fence = ""
            continue
        bare = line.strip(SPACES)
        item = ITEM.match(line) if bare else None
        indent = len(item.group(1)) if item else 0
        if item and indent > (levels[-1] if levels else 0) + LEVEL:
            item = None
        if not bare:
            kind = "blank"
        elif (m := FENCE.match(line)) and not (m.group(1)[0] == "`" and "`" in line[m.end() :]):
            kind = "fence"
        elif HEADING.match(line) or QUOTED.match(line):
            kind = "whole"
        elif item:
            kind = "item"
            while levels and levels[-1] >= indent:
                levels.pop()
            levels.append(indent)
        elif k in trailers:
            kind = "whole"
        elif UNDERLINE.match(line) and start >= 0 and n_lines == 1 and not ITEM.match(text, start):
            yield start, b, False  # a heading that is underlined
            start = -1
            continue
        else:
            kind = "text"
            if not line[0].isspace():
                levels.clear()
        if kind == "text":
            if start < 0:
                start, n_lines = a, 0
            end = b
            n_lines += 1
            continue
        if start >= 0:
            yield start, end, True
            start = -1
        if kind == "fence":
            fence, fence_start = m.group(1), a
        elif kind == "whole":
            yield a, b, False
        elif kind == "item":
            start, end, n_lines = a, b, 1
    if fence:
        yield fence_start, len(text), False
    elif start >= 0:
        yield start, end, True


#: Columns by which an item may be indented more than the level it opens in.
LEVEL = 8


class _Stack:
    """Open marks in order, found by what closes them; what lies above a closed one is dropped with it."""

    def __init__(self) -> None:
        self.held: list[tuple] = []
        self.places: dict[str | int, list[int]] = {}

    def push(self, key: str | int, value: int) -> None:
        self.places.setdefault(key, []).append(len(self.held))
        self.held.append((key, value))

    def has(self, key: str | int) -> bool:
        return bool(self.places.get(key))

    def close(self, key: str | int) -> int:
        """The value of the topmost ``key``, which goes with all above it."""
        at = self.places[key][-1]
        value = self.held[at][1]
        while len(self.held) > at:
            self.places[self.held.pop()[0]].pop()
        return value


def _pairs(block: str, marks: list[tuple[int, int, str]]) -> dict[int, int]:
    """Partner of every quotation mark or bracket of a block that has one: {mark's place: partner's place}."""
    stack = _Stack()
    partner: dict[int, int] = {}
    for a, _, mark in marks:
        if mark in PAIRS:
            stack.push(PAIRS[mark], a)
            continue
        closes = stack.has(mark)
        if mark in "\"'’”“»«›‹„‘":
            before, after = block[a - 1 : a], block[a + 1 : a + 2]
            if mark in "'’" and before.isalnum() and after.isalnum():
                continue
            if mark == "'" and not before.strip():
                closes = False
            if not closes:
                opener = QUOTES.get(mark) or (mark if mark in "\"'" else None)
                if opener and (mark in "“„‘«»‹›" or not before.strip() or before in PAIRS or not before.isalnum()) and after.strip(SPACES if mark not in "«»‹›" else ""):
                    stack.push(opener, a)
                continue
        elif mark not in CLOSERS:
            continue
        if closes:
            opened = stack.close(mark)
            partner[opened] = a
            partner[a] = opened
    return partner


def _word_before(block: str, start: int, at: int) -> tuple[int, str]:
    """(place, word) of what stands right before ``at``, read backwards."""
    k = at
    while k > start and not block[k - 1].isspace() and block[k - 1] not in BREAKS:
        k -= 1
    return k, block[k:at]


def _full_stop_ends(block: str, start: int, at: int, after: str, lower: bool) -> bool:
    """Whether the single full stop at ``at`` ends the sentence begun at ``start``; ``after`` is the text behind it."""
    begins, word = _word_before(block, start, at)
    if not word:
        return block[at - 1 : at] != "" and not block[at - 1].isspace()
    first = after.lstrip("\"'“‘„«»‹「([{")[:1]
    low = word.lower().strip(",;:'’")
    verdict = _abbreviation(low)
    next_word = re.match(r"[\w'’-]+", after)
    follows = next_word.group().lower() if next_word else ""
    if verdict is None and "." in low and (tail := low.rsplit(".", 1)[1]) and len(tail) == 1 and re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", low):
        verdict = "maybe"  # letters with full stops
    if len(low) == 1 and low.isalpha() and not CJK.match(low):
        if not after:
            return True
        if word.isupper() or lower:  # an initial
            return False
        return verdict != "never" and first.isupper()
    if verdict is None and low.isdigit() and len(low) <= 3:
        while begins > start and block[begins - 1] in SPACES:
            begins -= 1
        if _word_before(block, start, begins)[1].lower() in GERMAN_BEFORE_ORDINAL:
            return not after
    if verdict is None:
        return True
    if not after:
        return True
    if low == "no" and not first.isdigit():
        return True
    if low in NUMBER_FOLLOWS and first.isdigit():
        return False
    if verdict == "never":
        return False
    if low in NAME_FOLLOWS:
        return follows in SENTENCE_OPENERS if not lower else low == "jr" and follows in SENTENCE_OPENERS
    if lower:
        if low == "p.m":
            return True
        if low == "a.m":
            return False
        return low in ("etc", "usw") or first in "\"“[(«'"
    if first.islower() or first.isdigit():
        return False
    if low in ("ee", "m", "fr") or (low in ("т", "z", "d", "u")):
        return False
    return True


def _sentences(block: str, lower: bool) -> Iterator[tuple[int, int]]:
    """(start, end) of the sentences of a divisible block."""
    marks = [(m.start(), m.end(), m.group()) for m in MARKS.finditer(block)]
    if block == block.lower():
        lower = lower or len(block) > 40
    elif lower:
        lower = (prose := NOT_PROSE_SPANS.sub("", block)) == prose.lower()
    partner = _pairs(block, [m for m in marks if len(m[2]) == 1])
    length = len(block)
    item = ITEM.match(block)
    start = 0
    head = item.end() if item else 0
    opened = _Stack()
    begun, begun_of = 0, -1  # first place of the sentence that is no space
    k = 0
    cuts: list[int] = []
    while k < len(marks):
        a, b, mark = marks[k]
        k += 1
        if a < head:
            continue
        if a in partner:
            if partner[a] > a:
                opened.push(a, a)
            elif opened.has(partner[a]):
                opened.close(partner[a])
            continue
        lead = mark[0]
        if lead in "`h" or mark in QUOTES or mark in PAIRS or mark in CLOSERS or lead in "\"'’‘”":
            continue
        if ";" in mark and not (mark == ";" and "Ͱ" <= block[a - 1 : a] <= "Ͽ"):
            continue
        wide = lead in WIDE_ENDS
        closed, end = [], b
        while True:  # closing marks right behind, or behind one space inside guillemets
            gap = end
            if block[gap : gap + 1] in ("\xa0", " ", " ") and block[gap + 1 : gap + 2] in ("»", "«", "›", "‹"):
                gap += 1
            if gap in partner and partner[gap] < gap and opened.has(partner[gap]):
                closed.append(opened.close(partner[gap]))
                end = gap + 1
            else:
                break
        while k < len(marks) and marks[k][0] < end:
            k += 1
        if opened.held:
            continue
        rest = block[end : end + 40]
        after = rest.lstrip(SPACES)
        spaced = len(after) < len(rest) or not rest
        if begun_of != start:
            begun = begun_of = start
            while begun < length and block[begun] in SPACES:
                begun += 1
            first_space = None
        at_start = max(begun, head)
        if closed:
            outer = closed[-1]
            alone = outer <= at_start
            opener = block[outer]
            if opener in "([（{《〈【" and not alone:
                continue
            if not after:
                cuts.append(end)
                start = end
                continue
            if (wide or CJK.match(after)) and not spaced:
                if "가" <= after[0] <= "힣":
                    goes_on = True
                elif opener in "「『":
                    goes_on = not alone or after[0] in "とっではがをにのもだやへか"
                elif opener in "“\"":
                    goes_on = bool(SAYS.match(after)) if alone else block[outer - 1 : outer] not in "：:，,"
                else:
                    goes_on = not alone or after[0] in "とではがをにのも的"
                if goes_on:
                    continue
            elif not spaced:
                continue
            elif opener in "([（{":
                pass
            elif after[0] in ",;:،，–—-":
                continue
            else:
                word = re.match(r"[^\W\d_][\w'’-]*", after)
                if lower:
                    if word and word.group() in GO_ON_WORDS:
                        continue
                elif word and word.group()[0].islower() and re.search(r"[aeiouyаеёиоуыэюяαεηιουωàâäéèêëîïôöûüáíóúñç]", word.group(), re.I):
                    continue
        else:
            if not after:
                cuts.append(end)
                start = end
                continue
            if lead == "…" or mark.startswith("..") or mark == "……":
                if set(mark) <= {".", "…"}:
                    if not spaced:
                        continue
                    if begun >= a or block[a - 1 : a].isspace():
                        continue
                    if after[0].islower() and not lower:
                        continue
                    if not after[0].isupper():
                        if first_space is None:
                            first_space = m.start() if (m := SPACE.search(block, at_start)) else length
                        if first_space >= a:  # a single word
                            continue
            elif mark == ".":
                if not spaced:
                    continue
                if not _full_stop_ends(block, at_start, a, after, lower):
                    continue
            elif not wide and not spaced and not (mark[-1] in "!?؟।۔" and CJK.match(after)):
                continue
            elif wide and mark[-1] == "．" and after[:1].isdigit():
                continue
        cuts.append(end)
        start = end
    if "฀" <= max(block[head:], default="") and re.search(r"[฀-๎]", block):
        cuts += [m.start() for m in THAI.finditer(block)]
        cuts.sort()
    at = 0
    for cut in [*cuts, length]:
        if cut > at:
            yield at, cut
            at = cut


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """0-based code-point offsets (start, end) of the sentence units of a text, end exclusive, without outer white space.

    Null, empty and blank texts have none. Texts are cut whole, whatever their length.
    """
    if not text:
        return []
    lower = _without_capitals(text)
    spans: list[tuple[int, int]] = []
    for start, end, divisible in _blocks(text):
        pieces = _sentences(text[start:end], lower) if divisible else ((0, end - start),)
        for a, b in pieces:
            piece = text[start + a : start + b]
            left = len(piece) - len(piece.lstrip(SPACES))
            bare = piece.strip(SPACES)
            if bare:
                spans.append((start + a + left, start + a + left + len(bare)))
    return spans


#: Left out when a text is asked for capitals: code, links, headings, trailers, the first line.
NOT_PROSE = re.compile(r"(?<!`)(`++)(?:(?!\1).)+?\1|https?://\S+|^[A-Za-z][\w-]*: .*$|^\s*#{1,6} .*$|\A.*$", re.MULTILINE)


NOT_PROSE_SPANS = re.compile(r"(?<!`)(`++)(?:(?!\1).)+?\1|https?://\S+", re.DOTALL)


def _without_capitals(text: str) -> bool:
    """Whether the author of a text writes it all in lower case, as is told by its prose."""
    prose = NOT_PROSE.sub("", text)
    if prose == prose.upper():  # nothing to tell it by
        prose = text
    return prose == prose.lower()


SPAN = T.StructType([T.StructField("start_pos", T.LongType()), T.StructField("end_pos", T.LongType())])


@F.arrow_udf(T.ArrayType(SPAN))
def _spans(texts: pa.Array) -> pa.Array:
    each = [sentence_spans(t) for t in texts.to_pylist()]
    ends = np.cumsum([0, *map(len, each)])
    flat = np.fromiter(chain.from_iterable(chain.from_iterable(each)), np.int64, 2 * ends[-1]).reshape(-1, 2)
    pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["start_pos", "end_pos"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)


def sentence_units(text: Column) -> Column:
    """Array of (start_pos, end_pos) of a text column's sentence units."""
    return _spans(text)


def split_sentences(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, start_pos, end_pos): one row for each sentence unit."""
    units = documents.select(id_column, F.explode(sentence_units(F.col(text_column))).alias("unit"))
    return units.select(id_column, "unit.start_pos", "unit.end_pos")
