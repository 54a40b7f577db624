"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits,
schemes and identifier cues. Deterministic local parsers expand each anchor to
the borders of an email, internet address, card, phone, web address, account
or secret, and validate it. An anchor inside an earlier span of its kind is passed
over, so spans of one kind are leftmost and do not overlap. Positions are code
points, the end exclusive.

Null and empty texts have no span. Rows are independent: repeated rows have one
result each; extra columns are ignored.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.llm.texts import add_columns, as_text, map_texts

#: in the order that ties of position follow; the first four are the base kinds
KINDS = ("email", "ip", "card", "phone", "url", "account", "secret")
BASE = 4

# fixed values: cue words, in lower case; capital and upper-case forms count too
SECRET_CUES = ("api_key", "api-key", "apikey", "passwd", "password", "secret", "token")
ACCOUNT_CUES = ("account", "acct", "iban", "passport", "ssn")

_LOCAL_BACK = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME_BACK = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_REST_OF_URL = re.compile(r"[^\s\"'<>|]+")
_HOST = re.compile(r"(?:[^/@\s]+@)?(?:[A-Za-z0-9-]+\.)+[A-Za-z0-9-]+|(?:[^/@\s]+@)?localhost")
_SECRET = re.compile(r"\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9_./+~-]{8,})")
_ACCOUNT = re.compile(r"(?:\s{0,3}(?:number|no\.?|nr\.?|id|#))?\s{0,3}[:=#]?\s{0,3}([A-Za-z]{0,2}[0-9](?:[ -]?[A-Za-z0-9]){4,40})", re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if c in _DIGITS)


def iban_is_valid(text: str) -> bool:
    """Check digits of an international account number."""
    code = re.sub(r"[ -]", "", text).upper()
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", code):
        return False
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


class Finder:
    def __init__(self):
        import ahocorasick

        self.anchors = ahocorasick.Automaton()
        for sign, parser in (("@", self.email), ("+", self.phone), ("://", self.url), *((d, self.number) for d in "0123456789")):
            self.anchors.add_word(sign, (len(sign), parser))
        for cues, parser in ((SECRET_CUES, self.secret), (ACCOUNT_CUES, self.account)):
            for cue in cues:
                for form in {cue, cue.capitalize(), cue.upper()}:
                    self.anchors.add_word(form, (len(form), parser))
        self.anchors.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, place of the kind in KINDS, end), in this order."""
        found: list[tuple[int, int, int]] = []
        #: where the next match of each kind may start
        free = dict.fromkeys(KINDS, 0)
        for last, (size, parser) in self.anchors.iter(text):
            parser(text, last + 1 - size, last + 1, free, found)
        return sorted(found)

    def email(self, text, at, end, free, found):
        start = at
        while start > free["email"] and text[start - 1] in _LOCAL_BACK:
            start -= 1
        domain = _DOMAIN.match(text, end)
        if start < at and domain:
            free["email"] = domain.end()
            found.append((start, 0, domain.end()))

    def number(self, text, at, end, free, found):
        """A digit starts a number if it is the first of its run, or of what is left."""
        if at >= free["ip"] and (at == free["ip"] or text[at - 1] not in _DIGITS):
            match = _IP.match(text, at)
            if match:
                free["ip"] = match.end()
                if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in match.groups()):
                    found.append((at, 1, match.end()))
        if at >= free["card"]:
            match = _CARD.match(text, at)
            if match:
                free["card"] = match.end()
                digits = only_digits(match.group())
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((at, 2, match.end()))

    def phone(self, text, at, end, free, found):
        match = _PHONE.match(text, at)
        if match and at >= free["phone"]:
            free["phone"] = match.end()
            if 10 <= len(only_digits(match.group())) <= 15:
                found.append((at, 3, match.end()))

    def url(self, text, at, end, free, found):
        start = at
        while start > free["url"] and text[start - 1] in _SCHEME_BACK:
            start -= 1
        while start < at and not text[start].isalpha():
            start += 1
        rest = _REST_OF_URL.match(text, end) if start < at else None
        if rest and _HOST.match(text, end):
            stop = end + len(rest.group().rstrip(".,;:!?)]}"))
            free["url"] = stop
            found.append((start, 4, stop))

    def account(self, text, at, end, free, found):
        match = _ACCOUNT.match(text, end)
        if match and at >= free["account"] and not (at and text[at - 1].isalnum()):
            start, stop = match.span(1)
            value = match.group(1)
            digits = only_digits(value)
            if not iban_is_valid(value):  # else the number alone, up to the first letter
                value = re.match(r"[A-Za-z]{0,2}[0-9]+(?:[ -][0-9]+)*", value).group()
                stop, digits = start + len(value), only_digits(value)
            if 6 <= len(digits) <= 34:
                free["account"] = stop
                found.append((start, 5, stop))

    def secret(self, text, at, end, free, found):
        match = _SECRET.match(text, end)
        if match and at >= free["secret"] and any(c in _DIGITS for c in match.group(1)):
            free["secret"] = match.end(1)
            found.append((match.start(1), 6, match.end(1)))


@functools.lru_cache(maxsize=1)
def finder() -> Finder:
    return Finder()


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; spans that overlap become one."""
    out, last = [], 0
    for a, kind, b in spans:
        if a >= last:
            out += [text[last:a], "[", KINDS[kind], "]"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def with_masked(docs: DataFrame) -> DataFrame:
    """All columns of `docs` and tl_masked, the text with each span replaced by its kind."""

    def work(piece: pa.RecordBatch) -> dict:
        find = finder()
        return {"tl_masked": [masked(t, find.spans(t)) for t in as_text(piece.column("text"))]}

    return add_columns(docs, "tl_masked string", work)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, a count for each base kind, base and all spans as text, and the masked text."""
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, masked string"

    def work(piece: pa.RecordBatch) -> dict:
        find = finder()
        made: dict[str, list] = {part.split()[0]: [] for part in schema.split(", ")}
        made["doc_id"] = piece.column("doc_id")
        for text in as_text(piece.column("text")):
            spans = find.spans(text)
            base = [s for s in spans if s[1] < BASE]
            for kind in range(BASE):
                made[f"n_{KINDS[kind]}"].append(sum(s[1] == kind for s in base))
            made["base"].append(written(base))
            made["spans"].append(written(spans))
            made["masked"].append(masked(text, spans))
        return made

    return map_texts(docs, schema, work)
