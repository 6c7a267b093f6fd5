"""Personal data in plain and disguised form, with spans in the source's own characters."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

# plain forms

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# possessive: a run of digits is read once, however long it is
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def _emails(text: str) -> list[Span]:
    """Found from the @: the part before it is the longest run of its letters that the last address left over."""
    found, last = [], 0
    for match in _DOMAIN.finditer(text):
        begin = at = match.start()
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at:
            last = match.end()
            found.append((begin, last))
    return found


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def plain_spans(text: str) -> dict[str, list[Span]]:
    """Spans by kind, leftmost and not overlapping within a kind."""
    found: dict[str, list[Span]] = {kind: [] for kind in KINDS}
    if "@" in text:
        found["email"] = _emails(text)
    if not _DIGIT.search(text):
        return found
    for match in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in match[0].split(".")):
            found["ip"].append(match.span())
    for match in _CARD.finditer(text):
        if match.end() - match.start() >= 16 and 16 <= len(digits := re.sub("[ -]", "", match[0])) <= 19 and _luhn(digits):
            found["card"].append(match.span())
    if "+" in text:
        for match in _PHONE.finditer(text):
            if 8 <= len(re.sub("[^0-9]", "", match[0])) <= 15:
                found["phone"].append(match.span())
    return found


# transducers: each rewrites parts of a text and remembers where they came from


class Rewritten:
    """A text made from another by edits (begin, end, replacement), in order and apart from each other."""

    def __init__(self, source: str, edits: list[tuple[int, int, str]]):
        pieces, self._at, self._from = [], [], []
        place = done = 0

        def add(piece: str, begin: int, end: int, copied: bool) -> None:
            nonlocal place
            if piece:
                pieces.append(piece)
                self._at.append(place)
                self._from.append((begin, end, copied))
                place += len(piece)

        for begin, end, new in edits:
            add(source[done:begin], done, begin, True)
            add(new, begin, end, False)
            done = end
        add(source[done:], done, len(source), True)
        self.text = "".join(pieces)

    def back(self, span: Span) -> tuple[Span, bool]:
        """The source span of a span of ``text``, and whether an edit is in it or at its inner edges."""
        first, last = bisect_right(self._at, span[0]) - 1, bisect_right(self._at, span[1] - 1) - 1
        begin, _, copied = self._from[first]
        if copied:
            begin += span[0] - self._at[first]
        end_begin, end, end_copied = self._from[last]
        if end_copied:
            end = end_begin + span[1] - self._at[last]
        return (begin, end), first != last or not copied


# fixed values: Cyrillic and Greek letters that look like Latin ones
_ALIKE = dict(zip("АВЕКМНОРСТХаеорсухіјѕԁԛԝһ", "ABEKMHOPCTXaeopcyxijsdqwh", strict=True)) | dict(
    zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοιν", "ABEZHIKMNOPTYXoiv", strict=True)
)
# fixed values: how digits and signs are spelled in the languages of the corpora
_SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
# fixed values: other writings of the two signs
_ESCAPED = {"%40": "@", "&#64;": "@", "&#x40;": "@", "&commat;": "@", "%2e": ".", "&#46;": ".", "&#x2e;": ".", "&period;": "."}
_STOPS = {"。": ".", "｡": "."}
_SPELLED_RUN = 7  # digits that a spelled run has at least, if it has not the four parts of an IP address
_IP_DOTS = 3


def _look_alikes() -> dict[str, str]:
    """Letters, digits, dashes and spaces beyond Latin-1 that stand for an ASCII character, and invisible ones."""
    table = _ALIKE | _STOPS
    for point in [0xA0, 0xAD, *range(0x180, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800)]:
        letter = chr(point)
        category = unicodedata.category(letter)
        plain = unicodedata.normalize("NFKC", letter)
        if category == "Cf":
            table[letter] = ""
        elif category == "Zs":
            table[letter] = " "
        elif category == "Pd":
            table[letter] = "-"
        elif category == "Nd":
            table[letter] = str(unicodedata.decimal(letter))
        elif len(plain) == 1 and " " < plain < "\x7f":
            table[letter] = plain
    return table


_LOOKS = _look_alikes()
_LOOK = re.compile("[" + "".join(map(re.escape, sorted(_LOOKS))) + "]")
_NUMBER = "|".join(sorted(_SPELLED, key=len, reverse=True))
_DOT = r"dot|punkt|punto|point"
_DOT_WORDS = frozenset(_DOT.split("|"))
_RUN = re.compile(rf"(?<!\w)(?:plus[ \t]+)?(?:(?:{_NUMBER})(?!\w)|[0-9]+(?=[ \t]+(?:{_DOT})(?!\w)))(?:[ \t,.-]{{1,3}}(?:(?:{_NUMBER}|{_DOT})(?!\w)|[0-9]+))*", re.I)
_TOKEN = re.compile(rf"(plus)|({_NUMBER})(?!\w)|({_DOT}|\.)|([0-9]+)", re.I)
_PLUS = re.compile(r"(?<!\w)plus[ \t]*(?=[0-9])", re.I)
_BRACKETS = re.compile(rf"[\[({{<][ \t]*(?:(at|arroba|@)|{_DOT}|\.)[ \t]*[\])}}>]", re.I)
# without brackets only "dot" counts: the other words for it are too common in prose
_BARE = re.compile(r"(?<=[A-Za-z0-9])(?:[ \t]+(?:at|arroba)[ \t]+|@)[A-Za-z0-9-]+(?:(?:[ \t]+dot[ \t]+|\.)[A-Za-z0-9-]+)+", re.I)
_BARE_SIGN = re.compile(r"[ \t]+(?:(at|arroba)|dot)[ \t]+", re.I)
_ESCAPE = re.compile("|".join(map(re.escape, _ESCAPED)), re.I)
_UNDERSCORED = re.compile(r"[A-Za-z0-9]_(?:at|arroba)_[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?:_dot_[A-Za-z0-9-]+)+", re.I)
_UNDERSCORED_SIGN = re.compile(r"_(?:(at|arroba)|dot)_", re.I)
_DOTTED = re.compile(rf"(?<=[0-9])[ \t]+(?:{_DOT})[ \t]+(?=[0-9])", re.I)


def _unlike(text: str) -> list[tuple[int, int, str]]:
    return [] if text.isascii() or _LOOKS.keys().isdisjoint(set(text)) else [(m.start(), m.end(), _LOOKS[m[0]]) for m in _LOOK.finditer(text)]


def _may_spell(lower: str) -> bool:
    """Whether three digits follow each other as words, at least two of them spelled; a word for the dot may stand between."""
    words = lower.replace("-", " ").replace(",", " ").replace(".", " ").split()
    if sum(map(_SPELLED.__contains__, words)) < 3:
        return False
    in_row = spelled = 0
    for word in words:
        if word in _SPELLED:
            in_row, spelled = in_row + 1, spelled + 1
        elif word.isdigit():
            in_row += 1
        elif word not in _DOT_WORDS:
            in_row = spelled = 0
        if in_row >= 3 and spelled >= 2:
            return True
    return False


def _in_four_parts(tokens: list[tuple[re.Match[str], str]]) -> bool:
    """Whether three words for the dot stand between digits; signs are left to prose such as "one. Two. Three"."""
    digit = [bool(m[2] or m[4]) for m, _ in tokens]
    return sum(bool(m[3]) and m[3] != "." and all(digit[i - 1 : i + 2 : 2]) for i, (m, _) in enumerate(tokens[1:-1], 1)) == _IP_DOTS


def _unspelled(text: str, lower: str) -> list[tuple[int, int, str]]:
    edits: list[tuple[int, int, str]] = []
    if _may_spell(lower):
        for run in _RUN.finditer(text):
            tokens = [(m, "+" if m[1] else _SPELLED[m[2].lower()] if m[2] else "." if m[3] else m[4]) for m in _TOKEN.finditer(text, *run.span())]
            if sum(bool(m[2]) for m, _ in tokens) >= 3 and sum(len(new) for m, new in tokens if m[2] or m[4]) >= (0 if _in_four_parts(tokens) else _SPELLED_RUN):
                begin = run.start()
                for m, new in tokens:  # what stands between two tokens goes to the second
                    edits.append((begin, m.end(), new))
                    begin = m.end()
    return edits


def _undisguised(text: str, lower: str) -> list[tuple[int, int, str]]:
    edits: list[tuple[int, int, str]] = []
    if "plus" in lower:
        edits += [(m.start(), m.end(), "+") for m in _PLUS.finditer(text)]
    if any(sign in text for sign in "[({<"):
        for m in _BRACKETS.finditer(text):
            begin, end = m.span()
            while begin and text[begin - 1] in " \t":
                begin -= 1
            while end < len(text) and text[end] in " \t":
                end += 1
            edits.append((begin, end, "@" if m[1] else "."))
    if "%" in text or "&" in text:
        edits += [(m.start(), m.end(), _ESCAPED[m[0].lower()]) for m in _ESCAPE.finditer(text)]
    if "_at_" in lower or "_arroba_" in lower:
        for m in _UNDERSCORED.finditer(text):
            edits += [(s.start(), s.end(), "@" if s[1] else ".") for s in _UNDERSCORED_SIGN.finditer(text, *m.span())]
    if any(word in lower for word in _DOT_WORDS):
        edits += [(m.start(), m.end(), ".") for m in _DOTTED.finditer(text)]
        for m in _BARE.finditer(text):
            signs = list(_BARE_SIGN.finditer(text, *m.span()))
            if any(not s[1] for s in signs):  # the word for @ alone is ordinary prose
                edits += [(s.start(), s.end(), "@" if s[1] else ".") for s in signs]
    edits.sort()
    apart: list[tuple[int, int, str]] = []
    for edit in edits:
        if not apart or edit[0] >= apart[-1][1]:
            apart.append(edit)
    return apart


def all_spans(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Plain spans, and all spans: the plain ones and those that only the normalised text shows.

    Three transducers run one after another: look-alikes, spelled digits, signs in words or brackets. An added span
    covers the source from the first character of the disguise to its last, holds at least one rewritten place, and
    touches no plain span of its kind.
    """
    base = plain_spans(text)
    steps: list[Rewritten] = []
    now = text
    if edits := _unlike(now):
        steps.append(Rewritten(now, edits))
        now = steps[-1].text
    lower = now.lower()
    for step in (_unspelled, _undisguised):
        if edits := step(now, lower):
            steps.append(Rewritten(now, edits))
            now = steps[-1].text
            lower = now.lower()
    if not steps:
        return base, base
    every = {}
    for kind, spans in plain_spans(now).items():
        known = list(base[kind])
        for span in spans:
            changed = False
            for step in reversed(steps):
                span, here = step.back(span)
                changed |= here
            if changed and all(span[1] <= a or b <= span[0] for a, b in base[kind]):
                known.append(span)
        every[kind] = sorted(known)
    return base, every


# tables


def _listed(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in spans[kind])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data of every row: id, n_email, n_ip, n_card, n_phone and base (plain spans), spans (all), base_sha256, n_added.

    Spans stand as kind:start:end by kind (email, ip, card, phone) and start, in code points of the source text, end
    exclusive, joined by commas. A null text counts as empty: no spans, "" for base and spans. Repeated rows stay
    repeated, a null id stays null, other columns are ignored, and no rows give no rows.
    """
    source = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    schema = ", ".join(f"n_{kind} bigint" for kind in KINDS) + ", base_sha256 string, spans string, base string, n_added bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {kind: [] for kind in KINDS}
            digests, spans, bases, added = [], [], [], []
            for value in batch.column(1):
                base, every = all_spans(value.as_py() or "")
                for kind in KINDS:
                    counts[kind].append(len(base[kind]))
                bases.append(_listed(base))
                digests.append(hashlib.sha256(bases[-1].encode()).hexdigest())
                spans.append(_listed(every))
                added.append(sum(map(len, every.values())) - sum(map(len, base.values())))
            columns = [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(digests, pa.string())]
            columns += [pa.array(spans, pa.string()), pa.array(bases, pa.string()), pa.array(added, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "base", "n_added"])

    return source.mapInArrow(run, f"`{id_col}` {source.schema['_id'].dataType.simpleString()}, {schema}")
