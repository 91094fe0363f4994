"""Personal data, plain and disguised, at its places in the source text.

Plain identifiers are found as they stand.  For disguised ones a text passes
through transducers, each of which rewrites some spans and leaves the rest:
characters that look like others (homoglyphs, full-width forms, digits of other
scripts, marks without width), character references, at and dot in brackets or
in words, and spelled digits.  A transducer's output is the list of its edits, so
that plain stretches are not touched and a place in the output maps to a place in
its input by bisection; the maps of all transducers are followed back in turn.
Identifiers found in the rewritten text that hold at least one edit are added at
their source places.

What keeps clean text clean: an at between plain words counts only if the domain
has its dots in words too or stands after a word such as mail, or if what is before it is no plain
word; digits count only in runs that make a whole identifier; nothing is added
inside a word, or over a plain identifier of its kind unless an address extends it.

Defined cases: a null text is empty; texts are read whole; places are code points,
ends exclusive; rows without an id and repeated rows have rows of their own.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rangeledger.llm.common import add_columns, in_small_batches
from rangeledger.llm.text import slices

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, kind, end

# Plain identifiers.  Each pattern begins where no match could have begun earlier, so that long
# runs of one kind of character cost no more than their length.

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_BEFORE_AT = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for n, d in enumerate(map(int, reversed(digits))):
        total += d if n % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def plain_spans(text: str) -> list[Span]:
    """Identifiers as they stand, by start and then kind."""
    out: list[Span] = []
    last = 0
    if "@" in text:
        for found in _DOMAIN.finditer(text):
            start = found.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < found.start():
                out.append((start, 0, found.end()))
                last = found.end()
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NO_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NO_DIGIT.sub("", m.group())) <= 15] if "+" in text else []
    return sorted(out)


# Transducers

Edit = tuple[int, int, str]  # start and end in the input, what stands there in the output


class Rewritten:
    """Output of a transducer and the way back."""

    def __init__(self, text: str, edits: list[Edit]) -> None:
        pieces, at, size = [], 0, 0
        self.out: list[tuple[int, int]] = []  # of each edit, its start and end in the output
        for start, end, new in edits:
            pieces += [text[at:start], new]
            size += start - at
            self.out.append((size, size + len(new)))
            size, at = size + len(new), end
        pieces.append(text[at:])
        self.text, self.edits, self.starts = "".join(pieces), edits, [o[0] for o in self.out]

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """Input places of a span of the output, and whether an edit made part of it."""
        first, last = self._place(start, False), self._place(end - 1, True)
        n = bisect_right(self.starts, start)
        touched = (n > 0 and self.out[n - 1][1] > start) or (n < len(self.starts) and self.starts[n] < end)
        return first, last, touched

    def _place(self, at: int, end: bool) -> int:
        n = bisect_right(self.starts, at) - 1
        if n < 0:
            return at + end
        start, stop, _ = self.edits[n]
        if at < self.out[n][1]:
            return stop if end else start
        return stop + (at - self.out[n][1]) + end


# Letters of other scripts that look like Latin ones, and the Latin ones.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "в": "b", "к": "k", "м": "m", "н": "h", "т": "t",
    "А": "A", "В": "B", "Е": "E", "З": "3", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "օ": "o", "ս": "u", "ց": "g", "հ": "h", "ո": "n",
}
# Marks that look like those of identifiers.
MARKS = {
    "․": ".", "‧": ".", "∙": ".", "·": ".", "。": ".", "｡": ".", "﹒": ".", "﹫": "@", "﹢": "+", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "﹣": "-",
    " ": " ", " ": " ", " ": " ", "　": " ",
}
# Characters without width.
WIDTHLESS = "­᠎​‌‍‎‏⁠⁡⁢⁣⁤﻿︎️"
_RANGES = " - ؀-ۿऀ-ෳ๐-๙၀-၉០-៩①-⑨Ⓐ-⓪！-～\U0001d400-\U0001d7ff"
_ODD = re.compile("[" + re.escape("".join([*LOOK_ALIKES, *MARKS])) + WIDTHLESS + _RANGES + "]+")


def plain_letter(c: str) -> str:
    """What a character stands for in an identifier; itself if for nothing else."""
    if c in LOOK_ALIKES:
        return LOOK_ALIKES[c]
    if c in MARKS:
        return MARKS[c]
    if c in WIDTHLESS:
        return ""
    digit = unicodedata.decimal(c, None)
    if digit is not None:
        return str(digit)
    wide = unicodedata.normalize("NFKC", c)
    return wide if len(wide) == 1 and wide.isascii() else c


_PLAIN: dict[str, str] = {}


def letters(text: str) -> list[Edit]:
    """Homoglyphs, full-width forms, digits of other scripts, marks without width."""
    if text.isascii():
        return []
    out: list[Edit] = []
    for run in _ODD.finditer(text):
        for at, c in enumerate(run.group(), run.start()):
            new = _PLAIN.get(c)
            if new is None:
                new = _PLAIN[c] = plain_letter(c)  # at most one entry for each character there is
            if new != c:
                out.append((at, at + 1, new))
    return out


_REFERENCE = re.compile(r"&(?:#(?P<ten>0{0,4}[0-9]{2,3})|#[xX](?P<hex>0{0,4}[0-9A-Fa-f]{2})|(?P<name>commat|period|plus|lowbar|hyphen|nbsp));|%(?P<url>40|2[eEbB])")
# Names of character references.
_NAMES = {"commat": "@", "period": ".", "plus": "+", "lowbar": "_", "hyphen": "-", "nbsp": " "}


def references(text: str) -> list[Edit]:
    """Character references of printable ASCII, and %40, %2e, %2b."""
    if "&" not in text and "%" not in text:
        return []
    out: list[Edit] = []
    for m in _REFERENCE.finditer(text):
        code = int(m["ten"]) if m["ten"] else int(m["hex"] or m["url"] or "0", 16)
        new = _NAMES[m["name"]] if m["name"] else chr(code)
        if len(new) == 1 and " " <= new <= "~":
            out.append((m.start(), m.end(), new))
    return out


# Words for the marks of an address in the four languages.
_AT, _DOT = r"at|arroba|arobase|ät", r"dot|d0t|punto|punkt|point|period"
_FENCED = re.compile(rf"[\[({{<][ \t]*(?P<word>{_AT}|{_DOT}|[@.]|underscore|dash|hyphen|plus)[ \t]*[\])}}>][ \t]*", re.IGNORECASE)
_OPEN = re.compile(r"[\[({<]")
_MARK_OF = {"underscore": "_", "dash": "-", "hyphen": "-", "plus": "+", "@": "@", ".": "."} | dict.fromkeys(_AT.split("|"), "@") | dict.fromkeys(_DOT.split("|"), ".")


def fenced(text: str) -> list[Edit]:
    """[at], (dot) and the like, with the space around them."""
    if not _OPEN.search(text):
        return []
    out: list[Edit] = []
    last = 0
    for m in _FENCED.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in " \t":
            start -= 1
        if start > 0 and m.end() < len(text) and text[start - 1].isalnum() and text[m.end()].isalnum():
            out.append((start, m.end(), _MARK_OF[m["word"].lower()]))
            last = m.end()
    return out


_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_WORD_DOT = rf"[ \t]+(?:{_DOT}|\.)[ \t]+|[_*|~-](?:{_DOT})[_*|~-]"
_HOST = re.compile(rf"(?P<at>[ \t]+(?:{_AT}|@)[ \t]+|[ \t]+@|@[ \t]*|[_*|~-](?:{_AT})[_*|~-])(?P<host>{_LABEL}(?:(?:{_WORD_DOT}|\.){_LABEL})+)", re.IGNORECASE)
# Begins with a set of characters, which the engine seeks fast; letters before it are looked for after its first one.
_HINT = re.compile(r"@|[aA](?<![^\W_].)(?:[tT]|[rR][rR][oO][bB][aA]|[rR][oO][bB][aA][sS][eE])(?![^\W_])|[äÄ](?<![^\W_].)[tT](?![^\W_])")
_NAME = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9%+-][A-Za-z0-9._%+-]*(?:(?:{_WORD_DOT}|[ \t]+(?:underscore|dash|hyphen|plus)[ \t]+)[A-Za-z0-9][A-Za-z0-9._%+-]*)*\Z", re.IGNORECASE)
_MARK_WORD = re.compile(rf"(?:{_WORD_DOT})|[ \t]+(?P<mark>underscore|dash|hyphen|plus)[ \t]+", re.IGNORECASE)
_CUE = re.compile(r"(?:e-?mail|mail|mailto|contact|reach|write|address|correo|courriel|adresse|kontakt|escribe|escriba|schreib\w*)\b[^\n.!?]{0,24}\Z", re.IGNORECASE)
#: Longest part before the at that is looked at: four times what an address may have, for marks in words.
NAME_REACH = 256


def addresses(text: str) -> list[Edit]:
    """At and dots in words, where they make an address."""
    out: list[Edit] = []
    at = 0
    while hint := _HINT.search(text, at):
        at = hint.end()
        begin = hint.start()
        if begin > 0 and text[begin - 1] in "_*|~-":
            begin -= 1
        while begin > 0 and text[begin - 1] in " \t":
            begin -= 1
        host = _HOST.match(text, begin)
        low = max(0, begin - NAME_REACH, out[-1][1] if out else 0)
        name = _NAME.search(text[low:begin]) if host else None
        if host is None or name is None:
            continue
        in_words = bool(_MARK_WORD.search(host["host"]))
        if host["at"] == "@" and not in_words:  # stands as it is; what is before it may be a sentence
            continue
        real_at, start = host["at"] == "@", low + name.start()
        simple = name.group().isalpha()
        cued = bool(_CUE.search(text[max(0, start - 40) : start])) or text[max(0, start - 7) : start].lower() == "mailto:"
        rare = "arroba" in host["at"].lower() or "arobase" in host["at"].lower()
        last = _MARK_WORD.sub(".", host["host"]).rpartition(".")[2]
        if not (2 <= len(last) <= 24 and last.isalpha()) or not (real_at or in_words or cued or rare or not simple):
            continue
        for m in _MARK_WORD.finditer(text, start, begin):
            out.append((m.start(), m.end(), _MARK_OF[m["mark"].lower()] if m["mark"] else "."))
        if not real_at:
            out.append((host.start("at"), host.end("at"), "@"))
        out += [(m.start(), m.end(), ".") for m in _MARK_WORD.finditer(text, host.start("host"), host.end())]
        at = max(at, host.end())
    return out


# Digits in words in the four languages.
DIGIT_WORDS = {
    "zero": 0, "oh": 0, "nought": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "null": 0, "eins": 1, "zwei": 2, "zwo": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
}
# Numbers in words above nine, and what repeats a digit.
TEENS = {"ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19}
TENS = {"twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
REPEATS = {"double": 2, "triple": 3}
_NUMBER = "|".join(sorted([*DIGIT_WORDS, *TEENS, *TENS, *REPEATS, "hundred"], key=len, reverse=True))
_TOKEN = rf"(?:(?:{_NUMBER})\b|[0-9]+)"
_BETWEEN = rf"(?:[ \t]*(?:,|-|\.)[ \t]*|[ \t]+(?:(?:{_DOT}|dash|hyphen|minus|and)[ \t]+)?)"
_NO_LETTER = re.compile(r"[^A-Za-z]*")
_RUN = re.compile(rf"(?:(?<!\w)plus[ \t]+|(?<!\w)más[ \t]+|\+[ \t]*|(?<![\w.])){_TOKEN}(?:{_BETWEEN}{_TOKEN})+(?!\w)", re.IGNORECASE)
_DIGITS_DOT = re.compile(rf"[0-9][ \t]+(?:{_DOT})[ \t]+[0-9]", re.IGNORECASE)
_NUMBERS = frozenset(_NUMBER.split("|"))
_STEP = re.compile(rf"(?P<plus>plus|más|\+)|(?P<number>{_TOKEN})|(?P<dot>(?:{_DOT})\b|\.)|(?P<rest>[^\W\d]+|.)", re.IGNORECASE | re.DOTALL)


def digits_of(run: str) -> str:
    """The digits, dots and leading plus that a run of number words stands for."""
    out, value, repeat = "", None, 1  # value: a number above nine that may go on
    for m in _STEP.finditer(run):
        word = m.group().lower()
        if m["plus"]:
            out += "+"
        elif m["dot"]:
            out, value = out + ("" if value is None else str(value)) + ".", None
        elif not m["number"]:
            continue
        elif word == "hundred":
            last = out[-1:] if value is None else ""
            if last.isdigit():
                out, value = out[:-1], int(last) * 100
        elif word in REPEATS:
            repeat = REPEATS[word]
        else:
            number = DIGIT_WORDS.get(word, TEENS.get(word, TENS.get(word)))
            if number is not None and value is not None and (value % 100 == 0 if number > 9 else value % 10 == 0 and number > 0):
                value += number
                if value % 10 or number < 20 and number > 9:
                    out, value = out + str(value), None
                continue
            if value is not None:
                out, value = out + str(value), None
            if number is not None and number in TENS.values():
                value = number
            else:
                out, repeat = out + (word if number is None else str(number)) * repeat, 1
    return out + ("" if value is None else str(value))


def _may_spell(text: str) -> bool:
    """Whether number words stand side by side or one word apart."""
    words = text.lower().replace(",", " ").replace("-", " ").replace(".", " ").split()
    if _NUMBERS.isdisjoint(words):
        return False
    at = [n for n, w in enumerate(words) if w in _NUMBERS]
    return any(b - a <= 2 for a, b in zip(at[:-1], at[1:], strict=True))


def spelled(text: str) -> list[Edit]:
    """Runs of digits in words that stand for ten digits or more, or for dotted numbers."""
    if not _may_spell(text) and not _DIGITS_DOT.search(text):
        return []
    out: list[Edit] = []
    for m in _RUN.finditer(text):
        if not m.group().isascii() or not _NO_LETTER.fullmatch(m.group()):
            new = digits_of(m.group())
            if sum(c.isdigit() for c in new) >= 10 or new.count(".") == 3:
                out.append((m.start(), m.end(), new))
    return out


_MIXED = re.compile(r"(?<![A-Za-z0-9])[0-9OoIl](?:[ .()-]{0,2}[0-9OoIl])+(?![A-Za-z0-9])")
_NEXT_TO = re.compile(r"[0-9][OoIl]|[OoIl][0-9]")
_AS_DIGIT = {"O": "0", "o": "0", "I": "1", "l": "1"}


def letters_as_digits(text: str) -> list[Edit]:
    """O and l among digits."""
    if not _NEXT_TO.search(text):
        return []
    out: list[Edit] = []
    for m in _MIXED.finditer(text):
        run = m.group()
        odd = [n for n, c in enumerate(run) if c in _AS_DIGIT]
        if odd and _NEXT_TO.search(run) and len(odd) <= sum(c.isdigit() for c in run):
            out += [(m.start() + n, m.start() + n + 1, _AS_DIGIT[run[n]]) for n in odd]
    return out


TRANSDUCERS: tuple[Callable[[str], list[Edit]], ...] = (letters, references, fenced, addresses, spelled, letters_as_digits)


def rewritten(text: str) -> list[Rewritten]:
    """The transducers that change the text, in turn."""
    chain: list[Rewritten] = []
    for edits_of in TRANSDUCERS:
        edits = edits_of(text)
        if edits:
            chain.append(Rewritten(text, edits))
            text = chain[-1].text
    return chain


def added_spans(text: str, plain: list[Span]) -> list[Span]:
    """Disguised identifiers at their source places."""
    chain = rewritten(text)
    if not chain:
        return []
    by_kind: list[list[Span]] = [[s for s in plain if s[1] == k] for k in range(len(KINDS))]
    starts = [[s[0] for s in own] for own in by_kind]
    out: list[Span] = []
    for start, kind, end in plain_spans(chain[-1].text):
        made = False
        for step in reversed(chain):
            start, end, touched = step.back(start, end)
            made |= touched
        inside = (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
        if not made or inside:
            continue
        n = max(0, bisect_right(starts[kind], start) - 1)
        over = []
        while n < len(by_kind[kind]) and by_kind[kind][n][0] < end:
            if by_kind[kind][n][2] > start:
                over.append(by_kind[kind][n])
            n += 1
        extends = kind == 0 and all(start <= s[0] and s[2] <= end and (start, end) != (s[0], s[2]) for s in over)
        if not over or extends:
            out.append((start, kind, end))
    return out


def find_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Plain and added spans of a text, each by start, kind and end."""
    plain = plain_spans(text)
    return plain, sorted(set(added_spans(text, plain)) - set(plain))


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span (of overlapping ones, their union) as [KIND]."""
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


# Over documents

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("added", T.BooleanType())]))
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("added", pa.bool_())]))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: bool = False) -> DataFrame:
    """Per document its id, ``pii`` (start, kind, end, added of each span, in that
    order; kind is a place in KINDS) and, if asked for, ``masked_text``."""
    light = in_small_batches(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")))
    extra = [("pii", SPANS)] + ([("masked_text", T.StringType())] if mask else [])
    schema = add_columns(T.StructType([light.schema[id_col]]), *extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, texts = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                plain, added = find_spans(text)
                found.append([{"start": s, "kind": k, "end": e, "added": new} for s, k, e, new in sorted([(*p, False) for p in plain] + [(*a, True) for a in added])])
                if mask:
                    texts.append(masked(text, plain + added))
            columns = [batch.column(0), pa.array(found, _SPANS)] + ([pa.array(texts, pa.string())] if mask else [])
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return light.mapInArrow(run, schema)


def written(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digest of plain spans, and all spans written out."""
    plain = F.filter("pii", lambda s: ~s["added"])
    count = lambda n: F.size(F.filter("pii", lambda s: ~s["added"] & (s["kind"] == n))).cast("long")
    counts = [count(n).alias(f"n_{k}") for n, k in enumerate(KINDS)]
    added = F.size(F.filter("pii", lambda s: s["added"])).cast("long")
    return found.select(id_col, *counts, F.sha2(written(plain), 256).alias("base_sha256"), written(F.col("pii")).alias("spans"), added.alias("n_added"))


def digest_of(spans: list[Span]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans)).encode()).hexdigest()
