"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

``find`` adds the confirmed spans of every text, ``redact`` replaces them. Spans of
the base kinds count whatever their score; account numbers and secrets count from
``THRESHOLD`` on, so one that only a word such as "example" stands near is left alone.

Edge cases: a null text has no spans (``redact`` leaves it null); an empty text
has none; repeated rows are treated row by row; texts of any length are read
whole, in time linear in their length. Input columns are kept; only the names
``spans`` (of ``find``) and ``text`` matter, and a clash with ``spans`` is refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import slices, without

KINDS = ("email", "ip", "card", "phone", "iban", "secret")
BASE = KINDS[:4]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match never ends inside a run of digits, so starts within a run need no trial.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
#: Characters of an account number by country, as the registry lists them.
IBAN_LENGTHS = {
    n: int(x)
    for n, x in (
        y.split(":")
        for y in "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BI:27 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DJ:27 DK:18 DO:28 EE:20 EG:29 ES:24 FI:18 FK:18 FO:18 FR:27 GB:22 GE:22 GI:23 GL:18 GR:27 GT:28 HN:28 HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 IT:27 JO:30 KW:30 KZ:20 LB:28 LC:32 LI:21 LT:20 LU:20 LV:21 LY:25 MC:27 MD:24 ME:22 MK:19 MN:20 MR:27 MT:31 MU:30 NI:28 NL:18 NO:15 OM:23 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 RU:33 SA:24 SC:31 SD:18 SE:24 SI:19 SK:24 SM:27 SO:23 ST:25 SV:28 TL:23 TN:24 TR:26 UA:29 VA:22 VG:24 XK:20 YE:30".split()
    )
}
_IBAN_REST = {n: re.compile(rf"(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in set(IBAN_LENGTHS.values())}
_SECRET = re.compile(r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?:[Pp][Aa][Ss][Ss](?:[Ww][Oo][Rr][Dd]|[Ww][Dd])|[Tt][Oo][Kk][Ee][Nn]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Aa][Pp][Ii][_-]?[Kk][Ee][Yy])[\"']? ?[=:] ?[\"']?([A-Za-z0-9_\-+/]{12,})")
#: Words of the context; parts of addresses, paths and compounds are none.
_NEAR = re.compile(r"(?<![\w@./-])[^\W\d_]+(?![\w@/-]|\.\w)")

#: Words that support a kind when they stand near a span, in the languages of the corpus.
CONTEXT = {
    "email": frozenset("email mail contact correo contacto courriel kontakt write".split()),
    "ip": frozenset("ip address host server adresse direccion login".split()),
    "card": frozenset("card credit visa mastercard karte tarjeta carte payment debit".split()),
    "phone": frozenset("phone call tel mobile telefon telefono telephone fax".split()),
    "iban": frozenset("iban bank account konto cuenta compte transfer".split()),
    "secret": frozenset("password token secret key aws credentials".split()),
}
#: Words that speak against personal data.
AGAINST = frozenset("example sample test dummy version placeholder beispiel muster ejemplo exemple".split())
#: Score of a confirmed span without context, and what a supporting or opposing word adds.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.85, "phone": 0.7, "iban": 0.8, "secret": 0.8}
SUPPORT, OPPOSE, WINDOW = 0.1, -0.2, 60
#: Account numbers and secrets from this score on are found: an opposing word outweighs the prior, unless another supports it.
THRESHOLD = 0.65


def luhn(digits: str) -> bool:
    """Whether the last digit checks the others by Luhn's rule."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """Whether an account number without spaces passes the mod-97 check."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # The part before "@" is the whole run of its characters since the last match:
    # looking back from each "@" visits every character once.
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        else:
            end = max(end, at)
        at = text.find("@", max(at + 1, end))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.groups()):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    for m in _IBAN.finditer(text):
        length = IBAN_LENGTHS.get(m[0][:2])
        rest = _IBAN_REST[length].match(text, m.end()) if length and m.start() >= end else None
        if rest and mod97((m[0] + rest[0]).replace(" ", "")):
            end = rest.end()
            yield m.start(), end


def _secrets(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, where the name before it starts): the name of a secret is no context of it."""
    for m in _SECRET.finditer(text):
        value = m[1]
        if value is None:
            yield *m.span(), m.start()
        elif any(c.isdigit() for c in value) and any(c.isalpha() for c in value):
            yield *m.span(1), m.start()


def _score(text: str, kind: str, start: int, end: int, named: int | None = None) -> float:
    start = start if named is None else named
    near = set(_NEAR.findall(text[max(0, start - WINDOW) : start].lower()))
    near.update(_NEAR.findall(text[end : end + WINDOW].lower()))
    score = PRIOR[kind] + SUPPORT * bool(near & CONTEXT[kind]) + OPPOSE * bool(near & AGAINST)
    return min(1.0, max(0.0, score))


def spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind as listed, then start; offsets in code points, end exclusive."""
    if not text:
        return []
    found: list[tuple] = []
    digits = any(d in text for d in "0123456789")
    if "@" in text:
        found += [("email", *s) for s in _emails(text)]
    if digits:
        found += [("ip", *s) for s in _ips(text)]
        found += [("card", *s) for s in _cards(text)]
        if "+" in text:
            found += [("phone", *s) for s in _phones(text)]
        found += [("iban", *s) for s in _ibans(text)]
        found += [("secret", *s) for s in _secrets(text)]
    return [(k, a, b, _score(text, k, a, b, *more)) for k, a, b, *more in found]


_SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def find(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``spans``: those of the base kinds, and others whose score reaches ``threshold``."""
    without(docs, "spans")

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                rows.append([{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in spans(text) if k in BASE or s >= threshold])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=[*batch.schema.names, "spans"])

    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string(f"spans {_SPAN}").fields])
    return docs.mapInArrow(run, schema)


def redacted(text: str | None, threshold: float = THRESHOLD) -> str | None:
    """The text with each span replaced by its kind in angle brackets; overlapping spans merge into the first."""
    if not text:
        return text
    found = sorted((a, b, k) for k, a, b, s in spans(text) if k in BASE or s >= threshold)
    if not found:
        return text
    out, end = [], 0
    for a, b, k in found:
        if a >= end:
            out += [text[end:a], f"<{k.upper()}>"]
        end = max(end, b)
    return "".join(out) + text[end:]


def redact(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every span in ``text`` replaced that ``find`` gives."""
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            new = [redacted(t, threshold) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at).name, pa.array(new, pa.string()))

    return docs.mapInArrow(run, docs.schema)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans, all spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find(docs).select("doc_id", "spans")

    def line(keep):
        return F.array_join(F.transform(keep, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), F.transform("spans", lambda s: s["score"]).alias("scores"))
