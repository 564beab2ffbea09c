"""Personal data: patterns propose spans, checksums confirm or reject them, nearby words adjust the score.

Base kinds (email, ip, card, phone) have fixed patterns and checks. Further kinds need a checksum or a word nearby that
says what the digits are. Every scan runs in time proportional to the text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Order of kinds in results; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "iban", "short_card", "local_phone", "ssn")
BASE = KINDS[:4]
#: Score of a confirmed proposal, and from which score on a span is kept.
START = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.7, "iban": 0.9, "short_card": 0.4, "local_phone": 0.4, "ssn": 0.3}
KEEP, NEAR, BONUS = 0.6, 48, 0.4
#: Words that raise the score of their kinds when they stand within NEAR characters.
CONTEXT = {
    "email": r"e-?mail|mail|courriel|correo", "ip": r"ip|host|server|address|adresse", "card": r"card|visa|credit|carte|karte|tarjeta|amex",
    "phone": r"phone|tel|call|mobile|fax|telefon|téléphone|teléfono", "iban": r"iban|account|bank|konto|compte|cuenta",
    "short_card": r"card|visa|credit|carte|karte|tarjeta|amex|diners", "local_phone": r"phone|tel|call|mobile|fax|telefon|téléphone|teléfono",
    "ssn": r"ssn|social security|sozialversicherung",
}
_context = {k: re.compile(rf"(?i)\b(?:{p})\b") for k, p in CONTEXT.items()}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Starting inside a run of digits meets the same dot as starting at its first digit, so only the first one is tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
#: Characters of an account number by country.
IBAN_LENGTHS = {c: int(n) for n, cs in (x.split(":") for x in (
    "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA "
    "23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM "
    "28:AL,AZ,BY,CY,DO,GT,HN,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU").split()) for c in cs.split(",")}
_LOCAL_PHONE = re.compile(r"(?<![0-9+.(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NOT_DIGIT = re.compile(r"[^0-9]+")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """Whether the check digit at the end is right."""
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def mod97(account: str) -> bool:
    """Whether an account number with country and check digits in front leaves 1 when divided by 97."""
    turned, rest = account[4:] + account[:4], 0
    for c in turned:
        rest = (rest * (100 if c.isalpha() else 10) + int(c, 36)) % 97
    return rest == 1


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _ibans(text: str):
    """Account numbers that mod 97 confirms, also if a space and further capitals or digits follow: of the country's length,
    else (a country without a fixed one) the longest that ends where a word does."""
    m = _IBAN.search(text)
    while m:
        start, end, found = m.start(), m.end(), None
        length = IBAN_LENGTHS.get(m[0][:2])
        account = m[0].replace(" ", "")
        while found is None and len(account) >= (length or 15):
            whole = not text[end : end + 1].isascii() or not text[end : end + 1].isalnum()
            if whole and len(account) == (length or len(account)) and mod97(account):
                found = end
            end -= 2 if text[end - 2] == " " else 1
            account = account[:-1]
        if found is not None:
            yield start, found
        m = _IBAN.search(text, found if found is not None else start + 4)


def _proposals(text: str):
    """Confirmed proposals, base kinds first: kind, start, end."""
    for start, end in _emails(text):
        yield "email", start, end
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield "ip", m.start(), m.end()
    cards = [(m.start(), m.end(), _NOT_DIGIT.sub("", m[0])) for m in _CARD.finditer(text)]
    for start, end, digits in cards:
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield "card", start, end
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            yield "phone", m.start(), m.end()
    for start, end in _ibans(text):
        yield "iban", start, end
    for start, end, digits in cards:
        if 13 <= len(digits) <= 15 and len(set(digits)) > 1 and luhn(digits):
            yield "short_card", start, end
    for m in _LOCAL_PHONE.finditer(text):
        yield "local_phone", m.start(), m.end()
    for m in _SSN.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield "ssn", m.start(), m.end()


class _Taken:
    """Spans by kind, each kind's in order and apart, so that one look per kind tells whether a place is free."""

    def __init__(self):
        self.starts: dict[str, list[int]] = {}
        self.ends: dict[str, list[int]] = {}

    def add(self, kind: str, start: int, end: int) -> None:
        self.starts.setdefault(kind, []).append(start)
        self.ends.setdefault(kind, []).append(end)

    def meets(self, start: int, end: int) -> bool:
        for kind, starts in self.starts.items():
            at = bisect_left(starts, end) - 1
            if at >= 0 and self.ends[kind][at] > start:
                return True
        return False


def spans_of(text: str) -> list[Span]:
    """All spans of a text in code points, by kind and start. Base spans stay whatever their score; others need it, and
    give way to a span of an earlier kind that they overlap."""
    kept, taken = [], _Taken()
    for kind, start, end in _proposals(text):
        near = _context[kind].search(text[max(0, start - NEAR) : start]) or _context[kind].search(text[end : end + NEAR])
        score = min(1.0, START[kind] + (BONUS if near else 0.0))
        if kind in BASE or score >= KEEP and not taken.meets(start, end):
            kept.append(Span(kind, start, end, score))
            taken.add(kind, start, end)
    return kept


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
_arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def _found(texts: pa.Array) -> list[list[Span] | tuple]:
    """Spans of each text. A text without digit and @ holds none of any kind."""
    some = pc.match_substring_regex(texts, "[0-9@]").to_pylist()
    return [spans_of(texts[i].as_py()) if hit else () for i, hit in enumerate(some)]


def spans(docs: DataFrame, keep: list[str], text: str = "text", name: str = "spans") -> DataFrame:
    """The columns `keep` and the spans of the whole text, for every row. Null and empty texts have none. No shuffle."""
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def find(batches):
        for batch in batches:
            found = [[s._asdict() for s in f] for f in _found(batch.column(batch.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, _arrow)], names=[*keep, name])

    return docs.select(*keep, F.col(text).cast("string").alias("_text")).mapInArrow(find, f"{kinds}, `{name}` {SPANS}")


def redacted_text(text: str, found) -> str:
    """The text with each span replaced by its kind in angle brackets. Of spans that overlap, the first kind is replaced."""
    free, parts, at, taken = [], [], 0, _Taken()
    for s in found:
        if not taken.meets(s.start, s.end):
            free.append(s)
            taken.add(s.kind, s.start, s.end)
    for s in sorted(free, key=lambda s: s.start):
        parts += [text[at : s.start], f"<{s.kind.upper()}>"]
        at = s.end
    return "".join([*parts, text[at:]])


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns, spans in the text replaced. Texts without spans, nulls among them, stay as they are."""
    at = docs.columns.index(text)

    def replace(batches):
        for batch in batches:
            texts = batch.column(at)
            found = _found(texts)
            if any(found):
                whole = texts.to_pylist()
                texts = pa.array([redacted_text(t, f) if f else t for t, f in zip(whole, found)], texts.type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], texts, *batch.columns[at + 1 :]], names=batch.schema.names)

    return docs.mapInArrow(replace, docs.schema)


def listed(found: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of each span of these kinds, comma-joined."""
    own = F.filter(found, lambda s: s["kind"].isin(*kinds))
    return F.concat_ws(",", F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def count(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")
