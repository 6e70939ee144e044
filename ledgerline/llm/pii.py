"""Personal data with offsets: disguises are undone first, then found spans map back to the source.

Two transducers rewrite a text and keep the place of every rewrite. The first
folds characters: full-width, mathematical and other compatibility forms,
digits of any script, look-alike letters of Cyrillic and Greek, unusual spaces,
dashes and dots; invisible characters go. The second undoes words: ``at`` and
``dot`` (bracketed or bare, in four languages), runs of spelled digits, ``plus``
before a spelled number, and ``O`` / ``l`` inside digit groups. The detectors of
the plain kinds then run over the rewritten text, and a span that touches a
rewrite is mapped to the code points it came from.

Plain (base) spans are found in the source itself and always stay. An added span
is dropped if it only crosses a base span of its kind or lies in one; it may
enlarge one, which takes two rewritten words for numbers, so that a word beside a
number isn't drawn into it. Bare ``at`` needs a well-known top domain and a
disguised dot, or a local part with a digit or punctuation, since plain prose
says "at" too.

Every scan is linear in the text, and rewrites are kept as a sparse list, so
a very long text takes a few times its own size.

Defined results: null and empty texts have no span; rows with equal or null
doc_ids each get a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import map_arrow

#: Kinds of personal data, in the order of spans (fixed by the contract).
KINDS = ("email", "ip", "card", "phone")

# --- detectors of the plain kinds (patterns fixed by the contract, written so that no scan backtracks) ---

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
ADDRESS = re.compile(r"([0-9]++)(?:\.([0-9]++)\.([0-9]++)\.([0-9]++))?+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def emails(text: str):
    """Each match holds one @; its local part is the run of local characters before it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def addresses(text: str):
    for m in ADDRESS.finditer(text):
        if m[2] is not None and all(len(p) <= 3 and int(p) <= 255 for p in (
                g.lstrip("0") or "0" for g in m.groups())):
            yield m.span()


def luhn(digits: str) -> bool:
    double = sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return (double + sum(map(int, digits[-1::-2]))) % 10 == 0


def cards(text: str):
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str):
    for m in PHONE.finditer(text):
        if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            yield m.span()


FINDERS = (emails, addresses, cards, phones)


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind, then start."""
    return [(k, *span) for k, find in enumerate(FINDERS) for span in find(text)]


# --- rewriting with offsets ---

class Edits(NamedTuple):
    """Rewrites of a text: in the new text [new[i], new_end[i]) stands for [old[i], old_end[i])."""

    new: list
    new_end: list
    old: list
    old_end: list

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The old span of a new one; a border inside a rewrite takes in all of it."""
        i = bisect_right(self.new, start) - 1
        while i >= 0 and self.new[i] == self.new_end[i] == start:  # removed before the span
            i -= 1
        if i < 0:
            first = start
        else:
            first = self.old[i] if start < self.new_end[i] else start - self.new_end[i] + self.old_end[i]
        while i + 1 < len(self.new) and self.new[i + 1] == self.new_end[i + 1] == start:
            i += 1
            first = self.old_end[i]
        j = bisect_right(self.new, end - 1) - 1
        if j < 0:
            return first, end
        return first, self.old_end[j] if end <= self.new_end[j] else end - self.new_end[j] + self.old_end[j]

    def touched(self, start: int, end: int) -> int:
        """Number of rewrites inside a new span."""
        i = bisect_right(self.new_end, start)
        n = 0
        while i < len(self.new) and self.new[i] < end:
            n += 1
            i += 1
        return n


def rewrite(text: str, changes: list[tuple[int, int, str]]) -> tuple[str, Edits]:
    """Applies (start, end, replacement) in order; of overlapping ones the first stays."""
    parts, edits, at, size = [], Edits([], [], [], []), 0, 0
    for start, end, new in changes:
        if start < at:
            continue
        parts += (text[at:start], new)
        size += start - at
        for column, value in zip(edits, (size, size + len(new), start, end)):
            column.append(value)
        size += len(new)
        at = end
    parts.append(text[at:])
    return "".join(parts), edits


# --- first transducer: characters ---

# Look-alike letters (fixed values): each stands over the Latin letter it looks like.
LOOK_ALIKES = dict(zip(
    "авекмнорстухіјѕһԁԛԝӏАВЕКМНОРСТУХІЈЅԌαοριυνκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
    "abekmhopctyxijshdqwlABEKMHOPCTYXIJSGaopiuvkABEZHIKMNOPTYX"))
# Invisible characters, and marks that stand for a space, a dash or a dot (fixed code points).
SAME_AS = {"": (0x00AD, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0xFEFF),
           " ": (0x00A0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000),
           "-": (*range(0x2010, 0x2016), 0x2212), ".": (0x00B7, 0x2022, 0x3002, 0xFF61)}


def _single_forms() -> dict[str, str]:
    """Characters with one printable ASCII character as their compatibility form or digit value."""
    forms = {}
    for point in (*range(0xA1, 0xD800), *range(0xF900, 0x10000), *range(0x104A0, 0x104AA),
                  *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F1B0)):
        c = chr(point)
        digit = unicodedata.decimal(c, None)
        form = unicodedata.normalize("NFKC", c) if digit is None else str(digit)
        if len(form) == 1 and "!" <= form <= "~":
            forms[c] = form
    return forms


FOLDED = _single_forms() | {chr(c): to for to, points in SAME_AS.items() for c in points}
GREEK_OR_CYRILLIC = f"{chr(0x370)}-{chr(0x52F)}"
#: Runs of Greek or Cyrillic letters, or of other characters that aren't Latin letters.
FOLD = re.compile(f"[{GREEK_OR_CYRILLIC}]+|[{chr(0xA0)}-{chr(0xBF)}{chr(0x250)}-{chr(0x36F)}{chr(0x530)}-{chr(0x10FFFF)}]+")


def fold(text: str) -> tuple[str, Edits]:
    changes = []
    if not text.isascii():
        for m in FOLD.finditer(text):
            if 0x370 <= ord(m[0][0]) <= 0x52F:  # words with other letters of the script are real words
                forms = LOOK_ALIKES if all(c in LOOK_ALIKES for c in m[0]) else {}
            else:
                forms = FOLDED
            changes += [(i, i + 1, forms[c]) for i, c in enumerate(m[0], m.start()) if c in forms]
    return rewrite(text, changes)


# --- second transducer: words ---

# Names of the digits 0 to 9 (fixed values), one line a language.
DIGIT_NAMES = [
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve"]
# Top domains that a bare "at" may lead to (fixed values); those that are common words are left out.
TOP_DOMAINS = frozenset(
    "com org net edu gov mil int info biz name dev app cloud tech online site shop store xyz io ai eu de fr es uk us ca "
    "mx ar br cl pe ch be nl lu pt dk se fi pl cz sk hu ro bg gr ie au nz jp cn kr tw hk sg ru ua tr il za".split())
DIGITS = {name: str(i) for line in DIGIT_NAMES for i, name in enumerate(line.split())}
_DIGIT = "(?:" + "|".join(sorted(DIGITS, key=lambda n: (-len(n), n))) + r")(?!\w)"
_GAP = r"(?:[ \t-]+|, ?)"
_SPOKEN = rf"{_DIGIT}(?:{_GAP}{_DIGIT})*+"
_DOT = "(?:dot|punkt|punto|point)"
_AT = "(?:at|arroba|arobase)"
_MARKED_DOT = rf"[ \t]*[\[({{<] ?(?:{_DOT}|\.) ?[\])}}>][ \t]*"
_ANY_DOT = rf"(?:{_MARKED_DOT}|[\s_-]{{1,3}}{_DOT}[\s_-]{{1,3}}|\.)"

# starts at a mark, which is rare, rather than at any letter
SPOKEN_PAIR = re.compile(rf"[\s!-/:-@\[-`{{-~]{_DIGIT}{_GAP}{_DIGIT}")
SPOKEN = re.compile(rf"\b{_SPOKEN}")
SPOKEN_PLUS = re.compile(rf"\bplus[ \t-]+(?={_DIGIT})")
PART = rf"(?:[0-9]++|{_SPOKEN})"
DOTTED = re.compile(rf"\b{PART}(?:{_ANY_DOT}{PART}){{3}}(?![0-9])")
NUMBER_PIECE = re.compile(rf"({_SPOKEN})|({_ANY_DOT})")
AT = re.compile(rf"[\[({{<] ?(?:{_AT}|@) ?[\])}}>]|[\s_-]{_AT}[\s_-]|@")
LABELS = re.compile(rf"[a-z0-9-]*[a-z0-9](?:{_ANY_DOT}[a-z0-9][a-z0-9-]*)+")
DOT = re.compile(_ANY_DOT)
DOT_BEFORE = re.compile(rf"(?:{_MARKED_DOT}|[\s_-]{{1,3}}{_DOT}[\s_-]{{1,3}})\Z")
MIXED_GROUP = re.compile(r"(?<![a-z0-9])[0-9oli]{4,}+(?![a-z0-9])")
#: How far the rule for a bare "at" looks back at the local part.
LOCAL_LOOK = 256
LIKE_DIGITS = {"o": "0", "l": "1", "i": "1"}
DOT_HINTS = ("dot", "punkt", "punto", "point", "[.]", "(.)", "{.}", "<.>", "[ . ]", "( . )")
AT_HINTS = (" at ", "[at", "(at", "{at", "<at", "arroba", "arobase", "[ at", "( at", "@", "_at_", "-at-", "\tat", "\nat")


def lowered(text: str) -> str:
    """Lower case with one character for one character."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def widened(low: str, start: int, end: int, gap: str) -> tuple[int, int]:
    """The span with up to 8 characters of ``gap`` on either side."""
    left, right = max(0, start - 8), min(len(low), end + 8)
    while start > left and low[start - 1] in gap:
        start -= 1
    while end < right and low[end] in gap:
        end += 1
    return start, end


def email_changes(low: str, dots: bool) -> list[tuple[int, int, str]]:
    """Rewrites of the at and dot signs of disguised addresses."""
    out = []
    for m in AT.finditer(low):
        sign = m[0].strip()
        bare = sign[0] in "_-a"
        start, end = widened(low, *m.span(), " \t\r\n_-" if bare else " \t")
        if sign == "@" and (start == m.start() or end == m.end()):
            start, end = m.span()
        right = LABELS.match(low, end)
        if not right or low[start - 1:start] not in LOCAL:
            continue
        labels = [d.span() for d in DOT.finditer(low, *right.span()) if d[0] != "."]
        if bare:
            if low[last_label(low, *right.span()):right.end()] not in TOP_DOMAINS:
                continue
        elif sign == "@" and end - start == 1 and not labels:
            continue
        at, left = start, []
        while True:
            word = at
            while word > max(0, at - LOCAL_LOOK) and low[word - 1] in LOCAL:
                word -= 1
            before = DOT_BEFORE.search(low, max(0, word - 16), word) if dots and word < at else None
            if not before or low[before.start() - 1:before.start()] not in LOCAL:
                break
            left.append((*before.span(), "."))
            at = before.start()
        if bare and not labels and not left and not re.search(r"[0-9._%+]", low[word:start]):
            continue
        out += left[::-1]
        if end - start > 1:
            out.append((start, end, "@"))
        out += [(*span, ".") for span in labels]
    return out


def last_label(low: str, start: int, end: int) -> int:
    """Where the last label of the domain in ``low[start:end]`` begins."""
    at = start
    for d in DOT.finditer(low, start, end):
        at = d.end()
    return at


def number_changes(low: str, dots: bool) -> list[tuple[int, int, str]]:
    """Rewrites of spelled digits, of dots between numbers and of letters that look like digits."""
    out = []
    pair = SPOKEN_PAIR.search(" " + low)
    if dots:
        for m in DOTTED.finditer(low):
            for piece in NUMBER_PIECE.finditer(low, *m.span()):
                if piece[1]:
                    out.append((*piece.span(), said(piece[1])))
                elif piece[2] != ".":
                    out.append((*piece.span(), "."))
    if pair:
        for m in SPOKEN.finditer(low, max(0, pair.start() - 1)):
            digits = said(m[0])
            if len(digits) > 1:
                out.append((*m.span(), digits))
        out += [(*m.span(), "+") for m in SPOKEN_PLUS.finditer(low)]
    for m in MIXED_GROUP.finditer(low):
        letters = [i for i, c in enumerate(m[0]) if c in LIKE_DIGITS]
        if letters and 2 * len(letters) < len(m[0]):
            out += [(m.start() + i, m.start() + i + 1, LIKE_DIGITS[m[0][i]]) for i in letters]
    return out


def said(words: str) -> str:
    return "".join(DIGITS[w] for w in re.findall(r"\w+", words))


def added_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans that only the rewritten text shows, in code points of ``text``."""
    plain, folds = fold(text)
    low = lowered(plain)
    dots = any(h in low for h in DOT_HINTS)
    changes = number_changes(low, dots)
    if any(h in low for h in AT_HINTS):
        changes += email_changes(low, dots)
    if not changes and not folds.new:
        return []
    clear, words = rewrite(plain, sorted(changes, key=lambda c: (c[0], -c[1])))
    out = []
    for kind, start, end in plain_spans(clear):
        middle = words.source(start, end)
        letters, said_ = folds.touched(*middle), words.touched(start, end)
        if letters or said_:
            first, last = folds.source(*middle)
            met = [b for b in base if b[0] == kind and b[1] < last and first < b[2]]
            if all(first <= b[1] and b[2] <= last and (first, last) != b[1:] for b in met) and (
                    not met or kind == 0 or letters or said_ > 1):
                out.append((kind, first, last))
    return out


def spans(text: str | None) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, added) of a text, by kind, then start."""
    if not text:
        return []
    base = plain_spans(text)
    more = added_spans(text, base)
    return sorted([(*s, False) for s in base] + [(*s, True) for s in more])


# --- over a table ---

SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.bool_())])
SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,end:long,added:boolean>>"


def _find(batches):
    for batch in batches:
        found, edges = [], [0]
        for value in batch.column(1):
            found += spans(value.as_py())
            edges.append(len(found))
        kind, start, end, added = zip(*found) if found else ((),) * 4
        items = pa.StructArray.from_arrays(
            [pa.array([KINDS[k] for k in kind], pa.string()), pa.array(start, pa.int64()),
             pa.array(end, pa.int64()), pa.array(added, pa.bool_())], fields=list(SPAN))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), items)],
            names=["doc_id", "spans"])


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, spans), a row per document; start and end count code points, end exclusive."""
    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _find, SCHEMA)


def redacted(text: str | None) -> str | None:
    """The text with every span (overlapping ones as one) replaced by the kind that starts it."""
    parts, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e, _ in spans(text)):
        if start >= at:
            parts += (text[at:start], f"[{KINDS[kind]}]")
        at = max(at, end)
    return None if text is None else "".join(parts) + text[at:]
