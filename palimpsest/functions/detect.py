"""Entity detection: every detector over a text, in order, with claimed ranges."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import checks as K
from . import patterns as P
from .binding import let

#: claims: takes its range whatever lies there. gated: only where no earlier range overlaps, and takes it. passive: the same, but takes nothing.
CLAIMS, GATED, PASSIVE = 0, 1, 2


@dataclass(frozen=True)
class Detector:
    """What one detector looks for. `guard` is a cheap pattern that any text with a match has."""

    type: str
    pattern: str
    gate: int
    guard: str
    valid: Callable[[Column], Column] | None = None
    confidence: Callable[[Column], Column] | None = None


def _d(name: str, gate: int, guard: str, valid=None, confidence=None) -> Detector:
    return Detector(name, P.java(P.PATTERNS[name]), gate, P.java(guard), valid, confidence)


DETECTORS = [
    _d("EMAIL", CLAIMS, "@"),
    _d("CARD", CLAIMS, r"(?:\d[ -]?){13}", lambda m: F.length(K.digits(m)).between(13, 19) & K.luhn(K.digits(m))),
    _d("IP_ADDRESS", CLAIMS, r"\d\.\d{1,3}\.\d{1,3}\.\d"),
    _d("AADHAAR", CLAIMS, r"\d{4}[ -]?\d{4}[ -]?\d{4}", lambda m: K.verhoeff(K.digits(m))),
    _d("PAN", CLAIMS, r"[A-Za-z]{5}\d{4}"),
    _d("SECRET_TOKEN", CLAIMS, r"[A-Za-z0-9_\-./+=]{20}", K.secret),
    _d("IBAN", CLAIMS, r"[A-Z]{2}\d{2}[A-Z0-9]{11}", K.iban),
    _d("MRZ_PASSPORT", CLAIMS, "[A-Z0-9<]{44}", K.mrz_line2),
    _d("MRZ_PASSPORT_NAME", GATED, "[A-Z<]{44}", K.mrz_line1),
    _d("SSN", CLAIMS, r"\d{3}[- ]\d{2}[- ]\d{4}", K.ssn),
    _d("UK_NINO", GATED, r"[A-Z]{2}\d{6}[A-D]", lambda m: ~F.substring(m, 1, 2).isin(P.NINO_EXCLUDED)),
    _d("EU_VAT", GATED, "[A-Z]{2}[A-Z0-9]{8}", K.eu_vat, lambda m: F.when(m.startswith("DE"), P.CHECKED_VAT).otherwise(P.CONFIDENCE["EU_VAT"])),
    _d("CHINA_ID", GATED, r"\d{17}", K.china_id),
    _d("JAPAN_MYNUMBER", GATED, r"\d{12}", K.japan_number),
    _d("BRAZIL_CPF", GATED, r"\d{3}[.\s]?\d{3}[.\s]?\d{3}[-\s]?\d{2}", K.brazil_cpf),
    _d("MEXICO_CURP", GATED, r"[A-Z]{4}\d{6}[HM]"),
    _d("MEXICO_RFC", GATED, r"\d{6}[A-Z0-9]{3}"),
    _d("CANADA_SIN", GATED, r"\d{3}[- ]?\d{3}[- ]?\d{3}", lambda m: K.luhn(K.digits(m))),
    _d("AU_TFN", GATED, r"\d{3}[- ]?\d{3}[- ]?\d{3}", K.tax_file_number),
    _d("AU_ABN", GATED, r"\d{2}[- ]?\d{3}[- ]?\d{3}[- ]?\d{3}", K.business_number),
    _d("PHONE", PASSIVE, r"\d{3}[\s.-]?\d{3}", K.phone),
]
BY_TYPE = {d.type: d for d in DETECTORS}

ENTITY = "struct<type:string,start:int,end:int,text:string,confidence:double>"
CANDIDATE = "struct<type:string,start:int,end:int,text:string,confidence:double,gate:int>"


def matches(text: Column, pattern: str) -> Column:
    """array<struct<text, start, end>> of the leftmost matches that don't overlap; ends are exclusive, in code points."""
    gaps = F.split(text, pattern, -1)
    sized = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(m.alias("m"), g.alias("g"))))
    start = F.struct(F.array().cast("array<struct<text:string,start:int,end:int>>").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["g"])
        b = a + F.length(x["m"])
        return F.struct(F.concat(acc["out"], F.array(F.struct(x["m"].alias("text"), a.alias("start"), b.alias("end")))).alias("out"), b.alias("at"))

    return F.aggregate(sized, start, step, lambda acc: acc["out"])


def candidates(text: Column, d: Detector) -> Column:
    """Valid matches of one detector, before claims."""
    found = matches(text, d.pattern)
    if d.valid:
        found = F.filter(found, lambda m: d.valid(m["text"]))
    sure = d.confidence or (lambda _: F.lit(P.CONFIDENCE[d.type]))
    rows = F.transform(found, lambda m: F.struct(F.lit(d.type).alias("type"), m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), sure(m["text"]).cast("double").alias("confidence"), F.lit(d.gate).alias("gate")))
    return F.when(text.rlike(d.guard), rows).otherwise(F.array().cast(f"array<{CANDIDATE}>"))


def claimed(rows: Column) -> Column:
    """Candidates in detector order -> entities, by each one's gate."""
    start = F.struct(F.array().cast(f"array<{CANDIDATE}>").alias("kept"), F.array().cast("array<struct<a:int,b:int>>").alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        blocked = (x["gate"] != CLAIMS) & F.exists(acc["taken"], lambda t: (x["start"] < t["b"]) & (t["a"] < x["end"]))
        kept = F.when(blocked, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(x)))
        taken = F.when(blocked | (x["gate"] == PASSIVE), acc["taken"]).otherwise(F.concat(acc["taken"], F.array(F.struct(x["start"].alias("a"), x["end"].alias("b")))))
        return F.struct(kept.alias("kept"), taken.alias("taken"))

    return F.aggregate(rows, start, step, lambda acc: acc["kept"])


def entities(text: Column, label: Column | None = None, detectors: list[Detector] = DETECTORS) -> Column:
    """array<struct<type, start, end, text, confidence>>; null text has none.

    With a field label that speaks of a name, a text of two or three capitalised words is a NAME.
    """
    text = F.coalesce(text, F.lit(""))
    found = F.transform(claimed(F.concat(*(candidates(text, d) for d in detectors))), lambda c: F.struct(*(c[k].alias(k) for k in ("type", "start", "end", "text", "confidence"))))
    if label is None:
        return found
    named = F.lower(label).rlike(P.java(r"\b(name|passenger|patient|customer|guest)\b")) & F.trim(text).rlike(r"^[A-Z][a-z]+(\s[A-Z][a-z]+){1,2}$")
    whole = F.array(F.struct(F.lit("NAME").alias("type"), F.lit(0).alias("start"), F.length(text).alias("end"), F.trim(text).alias("text"), F.lit(0.6).alias("confidence")))
    return F.concat(found, F.when(F.coalesce(named, F.lit(False)), whole).otherwise(F.array().cast(f"array<{ENTITY}>")))


# Registry -----------------------------------------------------------------------------------------

GATES = {"claims": CLAIMS, "gated": GATED, "passive": PASSIVE}
#: Checks that a detector's row may name: those of the built-in detectors by type, and some of their parts.
VALIDATORS: dict[str, Callable[[Column], Column]] = {d.type.lower(): d.valid for d in DETECTORS if d.valid} | {"luhn": lambda m: K.luhn(K.digits(m)), "verhoeff": lambda m: K.verhoeff(K.digits(m))}
ROW = "order double, type string, pattern string, guard string, gate string, validator string, confidence double"


def detector_rows() -> list[tuple]:
    """The built-in detectors as rows of ROW, orders 1, 2, 3 ...; others go between them by orders like 2.5."""
    gates = {v: k for k, v in GATES.items()}
    return [(float(n), d.type, d.pattern, d.guard, gates[d.gate], d.type.lower() if d.valid else None, P.CONFIDENCE[d.type]) for n, d in enumerate(DETECTORS, 1)]


def registered(rows: list) -> list[Detector]:
    """Detectors of rows (as ROW, dicts or Rows), in their order, for `entities`.

    A null guard is the pattern itself, a null gate claims, a null confidence 0.5. A row of a built-in type
    without a pattern stands for that detector. Null types, and gates or validators of no known name, are errors.
    """
    out = []
    for r in sorted((r.asDict() if hasattr(r, "asDict") else dict(r) for r in rows), key=lambda r: (r["order"], r["type"] or "")):
        if not r["type"] or not (r.get("pattern") or r["type"] in BY_TYPE):
            raise ValueError(f"a detector needs a type and a pattern: {r}")
        gate, validator = r.get("gate") or "claims", r.get("validator")
        if gate not in GATES or (validator and validator not in VALIDATORS):
            raise ValueError(f"no such gate or validator: {r}")
        own = BY_TYPE.get(r["type"])
        if not r.get("pattern"):
            out.append(own)
            continue
        sure = float(r["confidence"]) if r.get("confidence") is not None else 0.5
        same = own is not None and own.pattern == r["pattern"] and sure == P.CONFIDENCE[own.type]
        out.append(Detector(r["type"], r["pattern"], GATES[gate], r.get("guard") or r["pattern"], VALIDATORS[validator] if validator else None, own.confidence if same else lambda _, s=sure: F.lit(s)))
    return out
