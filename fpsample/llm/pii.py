"""Offset-preserving detection of personal data: plain identifiers, and disguised ones found in a normalised text and mapped back.

The plain ("base") patterns are read off the text itself. For the rest a transducer rewrites homoglyphs, spelled digits and
at/dot disguises and keeps, for every piece it copies or rewrites, where the piece came from; identifiers of the rewritten
text that touch a rewritten piece are mapped back to the code points of the source.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fpsample.llm.common import boxed, prepare, unboxed

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A run of digits that fails from its start fails from inside it too, so runs are entered at their start alone: no quadratic scans.
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """Luhn's check: from the right every second digit doubled, digit sums added, a multiple of ten."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def plain_spans(text: str) -> list[Span]:
    """The base matches, leftmost and non-overlapping within each kind; matches that fail their check are dropped without retry."""
    out = [("email", *x) for x in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p) < 4 and int(p) < 256 or int(p.lstrip("0")[:4] or 0) < 256 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return in_order(out)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


#: Letters of other scripts that look like ASCII ones (fixed values): look-alike, then the ASCII letter.
HOMOGLYPHS = dict(x.split("=") for x in """
а=a е=e о=o р=p с=c у=y х=x і=i ј=j ѕ=s ԁ=d һ=h ԛ=q ԝ=w А=A В=B Е=E К=K М=M Н=H О=O Р=P С=C Т=T Х=X І=I Ј=J Ѕ=S
ο=o α=a ν=v ι=i κ=k ρ=p υ=u Α=A Β=B Ε=E Ζ=Z Η=H Ι=I Κ=K Μ=M Ν=N Ο=O Ρ=P Τ=T Υ=Y Χ=X ﹫=@ 。=. ․=. ‐=- ‑=- ‒=- –=- −=-
""".split())  # fmt: skip
#: Code points that show nothing and are left out.
INVISIBLE = "­​‌‍⁠﻿"
SPELLED = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_DIGIT_WORD = "(?:" + "|".join(SPELLED) + ")"


def _glyphs() -> dict[str, str]:
    """Every single code point that is rewritten, by rule: look-alikes, full-width ASCII, decimal digits of any script, invisible ones."""
    out = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {"　": " ", " ": " ", " ": " "}
    out |= {chr(c): str(unicodedata.decimal(chr(c))) for c in range(0x80, 0x1FBFA) if unicodedata.decimal(chr(c), -1) >= 0}
    return out | HOMOGLYPHS | dict.fromkeys(INVISIBLE, "")


GLYPHS = _glyphs()
_GLYPH = re.compile("[" + "".join(map(re.escape, GLYPHS)) + "]")
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
# White space is entered at the start of its run alone and taken whole, so long runs cost no more than their length.
_BEFORE, _AFTER = r"(?:(?<!\s)\s++)", r"\s*+"
_DOT_SIGN = rf"{_BEFORE}?{_OPEN}{_AFTER}(?:dot|\.){_AFTER}{_CLOSE}{_AFTER}"
_DOT_WORD = rf"(?:{_DOT_SIGN}|{_BEFORE}dot\s++)"
#: Endings that pass after a bare "at ... dot ..." whatever stands before them (fixed values).
_TOP = "(?:com|org|net|edu|gov|info|biz|io|dev|uk|de|fr|es|it|nl|be|ch|at|eu|us|ca|au|jp|in|br|example|test)"
#: Prose, where "at" and the dots are all bare: words that begin no domain of two parts there, words that end none (no top-level domain is
#: among them), and words before "at" a site's name, which are nobody's local part (fixed values).
_BEGINS = "(?:the|a|an|this|that|these|those|each|every|any|some|no|its|his|her|their|our|your|my)"
_ENDS = "(?:of|on|or|if|up|he|we|an|the|and|for|with|from|that|this|these|those|was|were|are|but|not|than|then|when|where|which|who|over|under|into|onto|its|his|her|their|our|your|she|they|you|there|here|has|have|had|will|would|can|could|may|might|between|after|before|near|above|below)"
_BEFORE_SITES = frozenset("""
available is are was were be been being it us me him them you look looks looked looking see seen visit found find hosted host site
website page pages blog shop store online located work works worked working read more published posted download downloaded live
lives stay details information here there buy bought sold start started begin stop end ends arrive arrived meet met only also
directly listed documentation docs source code repository project join register registered sign out up in or and but not both
""".split())  # fmt: skip
_LABEL = "[a-z0-9-]++"
_LAST = r"(?:xn--[a-z0-9-]++|[a-z]{2,63}\b(?!-\w))"
_MORE = rf"(?:{_LABEL}(?:\.|{_DOT_WORD})){{0,126}}?"
#: A domain with a disguised dot, plain ones between its labels as may be: ending in _TOP; with a dot in brackets; in words that are no prose.
_DISGUISED_DOMAIN = rf"(?:{_LABEL}(?:\.{_LABEL})*+{_DOT_WORD}{_MORE}{_TOP}\b|{_MORE}{_LABEL}{_DOT_SIGN}{_MORE}{_LAST}|(?!{_BEGINS}{_DOT_WORD}{_LABEL}(?!{_DOT_WORD}|\.\w)){_LABEL}(?:\.{_LABEL})*+{_DOT_WORD}{_MORE}(?!{_ENDS}\b){_LAST})"
#: A domain of plain dots alone, its last label in one case: no start of a sentence, no address of the web.
_PLAIN_DOMAIN = rf"(?:(?!www\.){_LABEL}(?:\.{_LABEL}){{0,126}}?\.(?!{_ENDS}\b)(?-i:xn--[a-z0-9-]++|[a-z]{{2,63}}|[A-Z]{{2,63}})(?![\w/:@-]|\.\w))"
#: One pass over a text without look-alikes: at and dot in brackets; bare "at" only before a domain; bare "dot" between parts; two or more digits in words.
_DISGUISE = re.compile(
    rf"(?P<at>{_BEFORE}?{_OPEN}{_AFTER}(?:at|@){_AFTER}{_CLOSE}{_AFTER}|(?<=[a-z0-9_%+.-])\s++at\s++(?={_DISGUISED_DOMAIN})|{_BEFORE}[-_]at[-_]\s++|{_BEFORE}@{_AFTER}(?=[a-z0-9])|@\s++(?={_DISGUISED_DOMAIN}|{_PLAIN_DOMAIN}))"
    rf"|(?P<bare>(?<=[a-z0-9_%+.-])\s++at\s++(?={_PLAIN_DOMAIN}))"
    rf"|(?P<dot>(?:{_DOT_WORD}|{_BEFORE}[-_]dot[-_]\s++)(?=[a-z0-9])|(?<=[a-z0-9])\s++\.\s*+(?=(?-i:[a-z])))"
    rf"|(?P<digits>\b{_DIGIT_WORD}(?:(?:\s++dot\s++|{_AFTER}{_OPEN}{_AFTER}(?:dot|\.){_AFTER}{_CLOSE}{_AFTER}|[\s.-]++)(?:{_DIGIT_WORD}|[0-9])\b)+)",
    re.IGNORECASE,
)
#: What a text without any disguise lacks; most texts are done after this.
_HINT = re.compile(rf"@{_LABEL}\s++\.|\s[-_](?:at|dot)[-_]\s|\b{_DIGIT_WORD}\s++dot\s|{_OPEN}{_AFTER}(?:at|@|dot|\.){_AFTER}{_CLOSE}|\sdot\s|\sat\s++{_LABEL}\.[a-z0-9]|\s@|@\s|\b{_DIGIT_WORD}[\s.-]++(?:{_DIGIT_WORD}|[0-9])\b", re.IGNORECASE)
_DOT_GAP = re.compile(rf"dot|{_OPEN}", re.IGNORECASE)
_PART = re.compile(rf"{_DIGIT_WORD}|[0-9]", re.IGNORECASE)


class Normalised:
    """A text after the transducers, as pieces (start in it, start and end in the source, rewritten or copied)."""

    def __init__(self, source: str):
        self.text = source
        self.pieces: list[tuple[int, int, int, bool]] = [(0, 0, len(source), False)]

    def rewrite(self, edits: Iterator[tuple[int, int, str]]) -> None:
        """Replaces [start, end) of the present text by a string, edits in order and disjoint; maps stay relative to the source."""
        out: list[str] = []
        pieces: list[tuple[int, int, int, bool]] = []
        at = length = 0

        def copy(upto: int) -> None:
            nonlocal length
            k = bisect_right(self.starts, at) - 1
            while k < len(self.pieces) and self.pieces[k][0] < upto:
                start, a, b, new = self.pieces[k]
                end = self.pieces[k + 1][0] if k + 1 < len(self.pieces) else len(self.text)
                lo, hi = max(start, at), min(end, upto)
                if hi > lo:
                    pieces.append((length, a, b, True) if new else (length, a + lo - start, a + hi - start, False))
                    length += hi - lo
                k += 1
            out.append(self.text[at:upto])

        self.starts = [p[0] for p in self.pieces]
        for start, end, new in edits:
            copy(start)
            if new:
                pieces.append((length, self.source(start)[0], self.source(end - 1)[1], True))
                out.append(new)
                length += len(new)
            at = end
        copy(len(self.text))
        self.text, self.pieces = "".join(out), pieces

    def source(self, i: int) -> tuple[int, int]:
        """Where code point i came from, start and end."""
        start, a, b, new = self.pieces[bisect_right(self.starts, i) - 1]
        return (a, b) if new else (a + i - start, a + i - start + 1)

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """Span of the source, and whether anything in it was rewritten."""
        k = bisect_right(self.starts, start) - 1
        changed = False
        first = self.source(start)[0]
        last = self.source(end - 1)[1]
        while k < len(self.pieces) and self.pieces[k][0] < end:
            changed |= self.pieces[k][3]
            k += 1
        return first, last, changed or last - first != end - start


def _is_prose(text: str, at: int) -> bool:
    """Whether the word that ends here is one of prose before "at" and a site's name."""
    found = re.search(r"[A-Za-z0-9_%+.-]{1,24}\Z", text[max(0, at - 24) : at])
    return found is None or found[0].lower() in _BEFORE_SITES


def normalise(text: str) -> Normalised | None:
    """The text with disguises undone; None if it has none."""
    out = Normalised(text)
    glyphs = not text.isascii() and _GLYPH.search(text)
    if glyphs:
        out.rewrite((m.start(), m.end(), GLYPHS[m[0]]) for m in _GLYPH.finditer(out.text))
    if _HINT.search(out.text):

        def edits() -> Iterator[tuple[int, int, str]]:
            for m in _DISGUISE.finditer(out.text):
                if m.lastgroup == "bare" and _is_prose(out.text, m.start()):
                    continue
                if m.lastgroup != "digits":
                    yield m.start(), m.end(), "." if m.lastgroup == "dot" else "@"
                else:  # each word by itself, what stands between goes, so that a span may end inside
                    parts = list(_PART.finditer(out.text, m.start(), m.end()))
                    for p, q in zip(parts, [*parts[1:], None], strict=True):
                        yield p.start(), p.end(), SPELLED.get(p[0].lower(), p[0])
                        if q:  # a dot in words stays one
                            yield p.end(), q.start(), "." if _DOT_GAP.search(out.text, p.end(), q.start()) else ""

        out.rewrite(edits())
    elif not glyphs:
        return None
    out.starts = [p[0] for p in out.pieces]
    return out


def disguised_spans(text: str, plain: list[Span]) -> list[Span]:
    """Spans of the normalised text that have something rewritten, in the source's code points, without those that overlap a plain span of their kind."""
    if not text or (n := normalise(text)) is None:
        return []
    out: list[Span] = []
    for kind, start, end in plain_spans(n.text):
        a, b, changed = n.back(start, end)
        if changed and all(k != kind or y <= a or b <= x for k, x, y in plain + out):
            out.append((kind, a, b))
    return in_order(out)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("disguised", pa.bool_())])
    for b in batches:
        rows = []
        for text in b.column("text").to_pylist():
            plain = plain_spans(text or "")
            found = [(*s, False) for s in plain] + [(*s, True) for s in disguised_spans(text or "", plain)]
            rows.append([dict(zip(("kind", "start", "end", "disguised"), s, strict=True)) for s in sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, pa.list_(item))], [*b.schema.names, "_spans"])


def find_pii(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with ``spans``: an array of (kind, start, end, disguised) in code points, end exclusive, by start.

    One pass without a shuffle over whole texts, each row by itself. Null and empty texts have no spans; other columns are
    kept as they are, an input column ``spans`` is replaced; repeated rows are each scanned.
    """
    body, names = boxed(docs, ("spans",))
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("disguised", T.BooleanType())]))
    out = prepare(spark) and body.mapInArrow(_find, T.StructType([*body.schema, T.StructField("_spans", span)]))
    return unboxed(out, names, {"spans": F.col("_spans")})


def span_digests(found: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of find_pii's rows."""
    base = F.filter("spans", lambda s: ~s["disguised"])
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda k: F.filter("spans", lambda s: (s["kind"] == k) & ~s["disguised"])
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
