"""Personal data, plain and disguised, with spans of the source text."""

import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame

from tablesmith.llm.arrow import map_texts
from tablesmith.llm.base import texts

KINDS = ("email", "ip", "card", "phone")

# An e-mail address is looked for from its @, and a run of digits from its first digit, so
# that a long run of letters or digits is read once only.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]++(\.[0-9]++\.[0-9]++\.[0-9]++)?")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
MAY_HOLD = re.compile(r"[0-9@]")


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def identifiers(text: str) -> list[tuple[int, int, int]]:
    """``rank of the kind, start, end`` of the plain identifiers of a text."""
    if not MAY_HOLD.search(text):
        return []
    found, free = [], 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            free = m.end()
            found.append((0, start, free))
    for m in IP.finditer(text):
        if m[1] and all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((1, *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            found.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            found.append((3, *m.span()))
    return found


# Letters of other scripts that look like Latin ones, and signs that do not show.
HOMOGLYPHS = dict(zip("аеорсхуіјѕкмтвнАВЕКМНОРСТХІЈЅ", "aeopcxyijskmtbhABEKMHOPCTXIJS"))
HOMOGLYPHS |= dict(zip("οανρτυικεΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oavptuikeABEZHIKMNOPTYX"))
HOMOGLYPHS |= {"。": ".", "｡": ".", "․": ".", "‐": "-", "‑": "-", "–": "-", "﹢": "+"}
HIDDEN = "­​‌‍⁠﻿"
# Full-width and mathematical forms, and digits of other scripts, by their Unicode properties.
FORMS = "！-～\U0001d400-\U0001d7ff٠-٩۰-۹०-९"
GLYPH = re.compile(f"[{''.join(HOMOGLYPHS)}{HIDDEN}{FORMS}]")

# Digits as words (English, German, French, Spanish).
SPELLED = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
SIGNS = {"plus": "+", "dot": ".", "point": ".", "punkt": ".", "dash": "-"}
_DIGIT = "|".join(sorted(SPELLED, key=len, reverse=True))
_SIGN = "|".join(SIGNS)
# Four digits in a row, the first of them spoken; others may be in figures.
RUN = re.compile(
    rf"(?i)(?:\bplus[ ,-]+)?\b(?:{_DIGIT})\b(?:[ ,-]+(?:(?:{_SIGN})[ ,-]+)?(?:(?:{_DIGIT})\b|[0-9]+\b)){{3,}}"
)
# Letters that the pattern takes for an "i" or "s" although they are none in lower case.
FOLDED = re.compile("[ıİſ]")
TOKEN = re.compile(r"\w+")
WORD = re.compile(r"(?i)[^\W_]+")
# A bracketed sign stands for itself; bare words only where "at" and "dot" come together.
BRACKET = re.compile(r"(?i)[\[({<]\s?(?:at|@|arroba|ät|dot|\.|punkt|punto|point)\s?[\])}>]")
AT = re.compile(r"(?i)\s?[\[({<]\s?(?:at|@|arroba|ät)\s?[\])}>]\s?")
DOT = re.compile(r"(?i)\s?[\[({<]\s?(?:dot|\.|punkt|punto|point)\s?[\])}>]\s?")
BARE = re.compile(
    r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]+(?: (?:dot|punkt|punto|point) [A-Za-z0-9_%+-]+)*(?P<at> (?:at|arroba|ät) )"
    r"[A-Za-z0-9-]+(?:(?: (?:dot|punkt|punto|point) )[A-Za-z0-9-]+)+"
)
BARE_DOT = re.compile(r"(?i) (?:dot|punkt|punto|point) ")
BARE_HINT = re.compile(r"(?i) (?:at|arroba|ät) [A-Za-z0-9-]+ (?:dot|punkt|punto|point) ")


class Mapped:
    """A text with the source span of each of its characters."""

    def __init__(self, text: str):
        # Pieces: where a piece starts here and in the source, and whether it is a copy.
        self.text, self.here, self.there, self.same = text, [0], [0], [True]
        self.size = len(text)

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self._edge(start, False), self._edge(end - 1, True)

    def _edge(self, at: int, last: bool) -> int:
        i = bisect_right(self.here, at) - 1
        if self.same[i]:
            return self.there[i] + at - self.here[i] + last
        if not last:
            return self.there[i]
        return self.there[i + 1] if i + 1 < len(self.there) else self.size

    def rewritten(self, edits: list[tuple[int, int, str]]) -> "Mapped":
        """The text after replacing ascending, disjoint spans of it."""
        out, parts, at, length = Mapped(""), [], 0, 0
        out.size, out.here, out.there, out.same = self.size, [], [], []

        def piece(text: str, there: int, same: bool):
            nonlocal length
            if text:
                out.here.append(length)
                out.there.append(there)
                out.same.append(same)
                parts.append(text)
                length += len(text)

        def copied(start: int, end: int):
            while start < end:
                i = bisect_right(self.here, start) - 1
                stop = min(end, self.here[i + 1] if i + 1 < len(self.here) else len(self.text))
                offset = start - self.here[i] if self.same[i] else 0
                piece(self.text[start:stop], self.there[i] + offset, self.same[i])
                start = stop

        for start, end, text in edits:
            copied(at, start)
            piece(text, self.source(start, end)[0], False)
            at = end
            # What follows a replacement starts a piece, also if it is replaced itself.
        copied(at, len(self.text))
        out.text = "".join(parts)
        return out


def _glyph(sign: str) -> str:
    if sign in HOMOGLYPHS:
        return HOMOGLYPHS[sign]
    if sign in HIDDEN:
        return ""
    digit = unicodedata.digit(sign, None)
    return unicodedata.normalize("NFKC", sign) if digit is None else str(digit)


def _spoken(match: re.Match) -> str:
    out = ""
    for word in WORD.findall(match[0].lower()):
        out += SIGNS[word] if word in SIGNS else str(SPELLED.get(word, word))
    return out


def _may_hold_run(text: str) -> bool:
    """Whether a spoken digit stands before a digit or a sign, as in each match of RUN; cheaper."""
    if FOLDED.search(text):
        return True
    words = TOKEN.findall(text.lower())
    if SPELLED.keys().isdisjoint(words):
        return False
    return any(w in SPELLED and (n in SPELLED or n in SIGNS or n.isdigit()) for w, n in zip(words, words[1:]))


def _runs(text: str) -> list[tuple[int, int, str]]:
    if not _may_hold_run(text):
        return []
    return [(m.start(), m.end(), _spoken(m)) for m in RUN.finditer(text)]


def _bracketed(text: str, sign: re.Pattern, plain: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), plain) for m in sign.finditer(text)] if BRACKET.search(text) else []


def _bare(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in BARE.finditer(text):
        dots = [(d.start(), d.end(), ".") for d in BARE_DOT.finditer(text, *m.span())]
        edits += [(*m.span("at"), "@"), *dots]
    return sorted(edits)


def disguised(text: str) -> list[tuple[int, int, int]]:
    """``rank, start, end`` of identifiers that show only once the text is normalized."""
    steps = (
        lambda t: [(m.start(), m.end(), _glyph(m[0])) for m in GLYPH.finditer(t)],
        _runs,
        lambda t: _bracketed(t, AT, "@"),
        lambda t: _bracketed(t, DOT, "."),
        lambda t: _bare(t) if BARE_HINT.search(t) else [],
    )
    mapped, changed = Mapped(text), False
    for step in steps:
        if edits := step(mapped.text):
            mapped, changed = mapped.rewritten(edits), True
    return [(k, *mapped.source(s, e)) for k, s, e in identifiers(mapped.text)] if changed else []


def personal_spans(text: str) -> list[dict]:
    base = identifiers(text)
    more = []
    for kind, start, end in disguised(text):
        if not any(k == kind and s < end and start < e for k, s, e in base):
            more.append((kind, start, end))
    return [
        {"rank": k, "kind": KINDS[k], "start": s, "end": e, "base": b}
        for b, found in ((True, base), (False, more))
        for k, s, e in found
    ]


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, spans``: personal data of every row of ``docs (doc_id, text)``.

    A span has ``rank, kind, start, end, base``: code points of the original text, end
    exclusive; ``base`` marks identifiers written plainly. The others were found in the
    normalized text (look-alike letters and hidden signs, spoken digits, "at" and "dot") and
    mapped back, and overlap no plain one of their kind. Null and empty texts have no spans;
    repeated rows are handled one by one; other columns are ignored.
    """

    def scan(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch["doc_id"], "spans": [personal_spans(t) for t in batch["text"].to_pylist()]}

    span = "struct<rank: int, kind: string, start: int, end: int, base: boolean>"
    return map_texts(texts(docs), scan, f"doc_id bigint, spans array<{span}>")
