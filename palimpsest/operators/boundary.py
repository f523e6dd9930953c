"""The outbound boundary: allow-lists, defanged injections, payload scan, redaction of lines and URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.detect import entities
from ..functions.patterns import java
from .fields import has

# Keys that may leave.
ALLOWED_ELEMENT = ["id", "tag", "type", "selector", "box", "sensitive", "redactionTag", "hasValue", "text", "ariaLabel", "placeholder", "enabled", "visible", "isSearch", "isPagination", "inModal", "inNav", "isSticky", "formId", "options", "radioGroup", "accept", "multiple", "isUntrustedPromptInjection", "inferredLabel", "visuallyPainted"]
ALLOWED_HISTORY = ["action", "targetSelector", "elementId", "fieldName", "value", "result", "outcome", "matchedKey", "authorizedByUser", "plan", "extractedData"]
ALLOWED_REQUEST = ["sessionId", "taskInstruction", "capturedAt", "screenshot", "domSkeleton", "redactionMap", "actionHistory", "stateDiff", "userInteractions", "formSummary", "pageContext", "taskPlan", "taskMemory", "visualState"]
PERMITTED_VALUES = ["", "[REDACTED]", "[FILLED_FROM_LOCAL]", "[ALREADY_POPULATED]"]
# What never leaves; weaker than the detectors on purpose, and without checksums.
PAYLOAD = {
    "CREDIT_CARD": r"\b(?:4[0-9]{3}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,4}|5[1-5][0-9]{2}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5})\b",
    "PAN_CARD": r"\b[A-Z]{5}[0-9]{4}[A-Z]\b",
    "AADHAAR": r"(?<!\d)\b\d{4}[ -]\d{4}[ -]\d{4}\b(?!\s*[-]?\s*\d{4})",
    "PASSWORD_FIELD": "(?i)\\b(?:password|passwd|pwd|passcode|secret|api[_-]?key)\\s*[:=]\\s*[\"']?[^\\s,\"']{4,}",
}
# Phrases by which content gives orders to a reader.
INJECTIONS = [
    r"\bignore\s+(?:all\s+)?(?:previous|prior|above)\s+instructions\b",
    r"\byou\s+are\s+now\s+(?:an?\s+)?(?:unrestricted|developer|jailbroken|dan)\b",
    r"\bsystem\s+message\s*:",
    r"\breveal\s+(?:the\s+)?(?:user'?s?\s+)?(?:private|credentials|password|data)\b",
    r"\bsend\s+(?:user\s+)?credentials\s+to\b",
    r"\bdisregard\s+(?:all\s+)?(?:safety|system|agent)\s+guidelines\b",
    r"\bclick\s+this\s+button\s+immediately\b",
]
DEFANGED = "[UNTRUSTED_CONTENT_DEFANGED: Prompt Injection Blocked]"
# Parts of parameter names whose values are kept out of URLs.
SENSITIVE_QUERY = ["token", "auth", "key", "secret", "password", "session", "email", "phone", "name", "code", "jwt", "access", "id_token"]


def injected(text: Column) -> Column:
    found = F.lit(False)
    for p in INJECTIONS:
        found = found | has(text, p)
    return found


def payload_hits(text: Column) -> Column:
    """Names of the payload patterns in a text, in order."""
    return F.array_compact(F.array(*(F.when(F.coalesce(text, F.lit("")).rlike(java(p)), n) for n, p in PAYLOAD.items())))


def defang(text: Column) -> Column:
    """A text as it may leave: personal data or injected orders replace it by a marker; null stays null."""
    return F.when(text.isNotNull(), F.when(injected(text), DEFANGED).when(F.size(payload_hits(text)) > 0, "[REDACTED_PII]").otherwise(text))


def allowed(entries: Column, keys: list[str]) -> Column:
    """The entries of a map whose keys may leave."""
    return F.map_filter(entries, lambda k, _: k.isin(keys))


def history_value(value: Column) -> Column:
    return F.when(value.isNull() | value.isin(PERMITTED_VALUES), value).otherwise("[REDACTED]")


def split_payloads(rows: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows that may leave, and those blocked with the pattern that blocked them."""
    marked = rows.withColumn("blocked_by", F.get(payload_hits(F.col(text)), F.lit(0)))
    return marked.filter("blocked_by is null").drop("blocked_by"), marked.filter("blocked_by is not null")


def params(url: Column) -> Column:
    """array<struct<name, value>> of a URL's query, in order."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    return F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("name"), F.regexp_extract(p, "=(.*)$", 1).alias("value")))


def sensitive_params(url: Column) -> Column:
    return F.filter(F.transform(params(url), lambda p: F.lower(p["name"])), lambda n: n.isin(P.SENSITIVE_PARAMS))


def sanitized_url(url: Column) -> Column:
    """The URL with values of sensitive parameters replaced and others cut at 50 characters."""
    kept = F.transform(params(url), lambda p: F.concat(p["name"], F.lit("="), F.when(p["name"].rlike("(?i)" + "|".join(SENSITIVE_QUERY)), "[REDACTED]").otherwise(F.substring(p["value"], 1, 50))))
    base, hash_ = F.regexp_extract(url, "^([^?#]*)", 1), F.regexp_extract(url, "(#.*)$", 1)
    return F.concat(base, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.concat_ws("&", kept))).otherwise(""), hash_)


def lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no from 0, line) of each line of a text; null texts have none."""
    return rows.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def redacted_lines(rows: DataFrame, line: str) -> DataFrame:
    """Adds entities and the line as it may be shown: a marker where anything was found, else 300 characters."""
    return rows.withColumn("entities", entities(F.col(line))).withColumn("shown", F.when(F.size("entities") > 0, "[REDACTED LINE]").otherwise(F.substring(line, 1, 300)))
