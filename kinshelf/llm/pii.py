"""Personal data, found by anchors and expanded by small parsers.

One pass of an Aho-Corasick automaton over a text stops at at-signs, plus signs, digits,
URL schemes and words that announce an identifier. Each stop starts the parser of its
kind, which reads the boundaries off the text around and validates what it has read.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order that ties are put in; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = KINDS[:4]
SCHEMES = ("http://", "https://", "ftp://")
#: Words before an account or document number.
CUES = (
    "account", "acct", "iban", "ssn", "passport", "routing", "konto", "kontonummer",
    "compte", "cuenta", "tax id", "customer id",
)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"[^\s<>\"'`{}|\\^]++")
_ACCOUNT = re.compile(
    r"[\s:#.=-]{0,4}(?:(?i:number|no|nr|num|id|is)\b[\s:#.=-]{0,4})?"
    r"(?P<id>[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])|[0-9](?:[ -]?[0-9]){5,33}(?![A-Za-z0-9]))"
)
_HELD: dict[str, ahocorasick.Automaton] = {}


def _automaton() -> ahocorasick.Automaton:
    if "anchors" not in _HELD:
        found = ahocorasick.Automaton()
        for x in ("@", "+", *"0123456789"):
            found.add_word(x, x)
        for x in SCHEMES:
            for form in {x, x.upper(), x.capitalize()}:
                found.add_word(form, ("url", len(x)))
        for x in CUES:
            for form in {x, x.upper(), x.capitalize(), x.title()}:
                found.add_word(form, ("account", len(x)))
        found.make_automaton()
        _HELD["anchors"] = found
    return _HELD["anchors"]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) << (i & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _iban(value: str) -> bool:
    turned = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _account(text: str, anchor: int, end: int) -> tuple[int, int] | None:
    if (anchor and text[anchor - 1].isalnum()) or (end < len(text) and text[end].isalpha()):
        return None
    found = _ACCOUNT.match(text, end)
    if not found:
        return None
    plain = found["id"].replace(" ", "").replace("-", "")
    if plain[0].isalpha() and not _iban(plain):
        return None
    return found.span("id")


def _url(text: str, anchor: int, end: int) -> tuple[int, int] | None:
    if anchor and text[anchor - 1].isalnum():
        return None
    found = _URL.match(text, end)
    if not found:
        return None
    rest = found.group().rstrip(".,;:!?)]*")
    host = re.split(r"[/?#]", rest, maxsplit=1)[0].rpartition("@")[2]
    return (anchor, end + len(rest)) if "." in host.strip(".") else None


def spans_of(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points, by start and then in the order of ``KINDS``."""
    out: list[tuple[str, int, int]] = []
    done = dict.fromkeys(KINDS, 0)
    for last, anchor in _automaton().iter(text):
        if anchor == "@":
            start, least = last, done["email"]
            while start > least and text[start - 1] in _LOCAL:
                start -= 1
            found = _DOMAIN.match(text, last + 1) if start < last else None
            if found:
                out.append(("email", start, found.end()))
                done["email"] = found.end()
        elif anchor == "+":
            found = _PHONE.match(text, last) if last >= done["phone"] else None
            if found:
                done["phone"] = found.end()
                if 9 <= sum(c in _DIGITS for c in found.group()) <= 15:
                    out.append(("phone", last, found.end()))
        elif isinstance(anchor, str):
            if last >= done["ip"] and not (last and text[last - 1] in _DIGITS):
                found = _IP.match(text, last)
                if found:
                    done["ip"] = found.end()
                    parts = [x.lstrip("0") for x in found.group().split(".")]
                    if all(len(x) <= 3 and int(x or 0) <= 255 for x in parts):
                        out.append(("ip", last, found.end()))
            if last >= done["card"]:
                found = _CARD.match(text, last)
                if found:
                    done["card"] = found.end()
                    digits = [c for c in found.group() if c in _DIGITS]
                    if 12 <= len(digits) <= 19 and luhn("".join(digits)):
                        out.append(("card", last, found.end()))
        else:
            kind, length = anchor
            first = last + 1 - length
            found = (_url if kind == "url" else _account)(text, first, last + 1)
            if found and found[0] >= done[kind]:
                done[kind] = found[1]
                out.append((kind, *found))
    out.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return out


SPANS = "array<struct<kind: string, start: int, end: int>>"


def with_spans(docs: DataFrame, text: str = "text", name: str = "spans") -> DataFrame:
    """``docs`` and an array of ``(kind, start, end)``, in code points of the whole text, end exclusive.

    Base kinds are e-mail addresses, IPv4 addresses, card numbers that pass Luhn and
    international phone numbers; within each the leftmost match wins, matches do not
    overlap, and one that fails its validation is dropped whole. URLs with a host and
    numbers after an identifier cue (an IBAN must pass its check digits) are added. Null
    and empty texts have none. An existing column of that name gives way.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    @F.arrow_udf(SPANS)
    def found(column: pa.Array) -> pa.Array:
        names = ("kind", "start", "end")
        return pa.array([[dict(zip(names, s)) for s in spans_of(t or "")] for t in column.to_pylist()], kind)

    return docs.withColumn(name, found(F.col(text)))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _cut(text: str, spans: list[tuple[str, int, int]]) -> str:
    at, parts = 0, []
    for kind, start, end in spans:
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]]) if parts else text


def without_personal_data(text: Column) -> Column:
    """The text with every span that ``with_spans`` finds replaced by its kind in brackets, in one pass."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array) -> pa.Array:
        return pa.array([t if t is None else _cut(t, spans_of(t)) for t in texts.to_pylist()], pa.string())

    return cut(text)


def redacted(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping ones are cut whole, under the kind of the first."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, found: pa.Array) -> pa.Array:
        pairs = zip(texts.to_pylist(), found.to_pylist())
        cut_ = [t and _cut(t, [(s["kind"], s["start"], s["end"]) for s in own or ()]) for t, own in pairs]
        return pa.array(cut_, pa.string())

    return docs.withColumn(text, cut(F.col(text), F.col(spans)))


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op10_anchors(spark, sf_dir: str) -> DataFrame:
    docs = with_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return docs.select(
        "doc_id", *map(_count, BASE), F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans")
    )
