"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Base kinds are reported wherever pattern and check agree: email, ip (parts up to 255), card (16 to 19 digits,
Luhn) and phone (8 to 15 digits after a plus). Further kinds need more evidence, so that plain numbers are
left alone: iban (mod-97), account (13 to 15 digits, Luhn) and telephone (ten digits in groups, no plus). A
span has a score from its pattern, its checksum and the words up to CONTEXT characters before it; a further
kind is reported from THRESHOLD on, and only where it doesn't overlap a base span.

Offsets are code points, the end is exclusive. Defined cases: a null text is empty and has no span; a text of
any length is searched whole, each pattern in one linear pass. Extra columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

CONTEXT = 40
THRESHOLD = 0.7
BASE_KINDS = ("email", "ip", "card", "phone")
FURTHER_KINDS = ("iban", "account", "telephone")

# A run of the local part is entered at its start only: were a match possible from its middle, it would be
# possible from its start. The one exception, a run that the match before has cut, is tried by itself.
_LOCAL = r"[A-Za-z0-9._%+-]"
_ADDRESS = _LOCAL + r"++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_EMAIL = re.compile(rf"(?<!{_LOCAL}){_ADDRESS}")
_EMAIL_HERE = re.compile(_ADDRESS)
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_TELEPHONE = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_NOT_DIGIT = re.compile(r"[^0-9]+")

# Words that make a reading more (or less) likely.
_NEAR = {
    "email": re.compile(r"mail|contact|write", re.I),
    "ip": re.compile(r"\bip\b|address|host|server", re.I),
    "card": re.compile(r"card|visa|credit|payment", re.I),
    "phone": re.compile(r"phone|tel\b|call|mobile|fax", re.I),
    "iban": re.compile(r"iban|bank|account", re.I),
    "account": re.compile(r"card|visa|amex|credit|payment", re.I),
    "telephone": re.compile(r"phone|tel\b|call|mobile|fax", re.I),
}
_AGAINST = re.compile(r"isbn|order|version|invoice|serial|sku", re.I)
_PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "account": 0.5, "telephone": 0.5}


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if place & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _score(kind: str, text: str, start: int) -> float:
    before = text[max(0, start - CONTEXT) : start]
    return round(min(1.0, _PRIOR[kind] + 0.25 * bool(_NEAR[kind].search(before)) - 0.25 * bool(_AGAINST.search(before))), 2)


def emails(text: str) -> list[tuple[int, int]]:
    found, at = [], 0
    while at < len(text):
        match = (found and _EMAIL_HERE.match(text, at)) or _EMAIL.search(text, at)
        if not match:
            break
        found.append(match.span())
        at = match.end()
    return found


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind, then by start."""
    spans: list[tuple[str, int, int, float]] = []

    def add(kind: str, start: int, end: int) -> None:
        spans.append((kind, start, end, _score(kind, text, start)))

    if "@" in text:
        for start, end in emails(text):
            add("email", start, end)
    numbers = _CARD.search(text) is not None  # two digits together or one sign apart
    if numbers or "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.group().split(".")):
                add("ip", *m.span())
    runs = []
    if numbers:
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                if len(digits) >= 16:
                    add("card", *m.span())
                else:
                    runs.append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                add("phone", *m.span())
    if numbers:
        further = [("iban", m.span()) for m in _IBAN.finditer(text) if mod97(m.group().replace(" ", ""))]
        further += [("account", s) for s in runs] + [("telephone", m.span()) for m in _TELEPHONE.finditer(text)]
        if further:
            taken = sorted((s, e) for _, s, e, _ in spans)
            for kind, (start, end) in further:
                score = _score(kind, text, start)
                if score >= THRESHOLD and not any(s < end and start < e for s, e in taken):
                    spans.append((kind, start, end, score))
    return spans


def redacted(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """Every span gives way to ``<KIND>``; overlapping spans are replaced together, under the first's kind."""
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e, _ in spans):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


_SPANS = "array<struct<kind:string,start:long,end:long,score:double>>"
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its spans (kind, start, end, score) for every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("spans", _ARROW_SPANS)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ("kind", "start", "end", "score")
            spans = [[dict(zip(names, s)) for s in find_spans(t or "")] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _ARROW_SPANS)], schema=schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, f"doc_id long, spans {_SPANS}")


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns; spans in the text become ``<KIND>``, ``length_col`` the new length.

    Null texts stay null.
    """

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: redacted(t, find_spans(t)) if t is not None else None)

    out = docs.withColumn(text_col, clean(F.col(text_col)))
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.char_length(F.col(text_col)).cast(docs.schema[length_col].dataType))
    return out
