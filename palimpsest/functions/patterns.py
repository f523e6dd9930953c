"""Fixed values of the entity detectors: patterns, prefixes, exclusions and confidences."""

from __future__ import annotations

#: A word boundary between ASCII characters, whatever the regex engine takes for a word.
WORD = "[A-Za-z0-9_]"
BOUNDARY = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"

# What each detector looks for, with \b for an ASCII boundary.
PATTERNS = {
    "EMAIL": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "CARD": r"\b(?:\d[ -]?){13,19}\b",
    "IP_ADDRESS": r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b",
    "AADHAAR": r"\b[2-9]\d{3}[ -]?\d{4}[ -]?\d{4}\b",
    "PAN": r"\b[A-Za-z]{3}[ABCFGHLJPTabcfghljpt][A-Za-z]\d{4}[A-Za-z]\b",
    "SECRET_TOKEN": r"\b[A-Za-z0-9_\-./+=]{20,100}\b",
    "IBAN": r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b",
    "MRZ_PASSPORT": r"\b[A-Z0-9<]{44}\b",
    "MRZ_PASSPORT_NAME": r"(?<![A-Z0-9<])[A-Z][A-Z<][A-Z]{3}[A-Z<]{39}(?![A-Z0-9<])",
    "SSN": r"\b\d{3}[- ]\d{2}[- ]\d{4}\b",
    "UK_NINO": r"\b[A-CEGHJ-PR-TW-Z]{1}[A-CEGHJ-NPR-TW-Z]{1}\d{6}[A-D]\b",
    "EU_VAT": r"\b(?:AT|BE|BG|CY|CZ|DE|DK|EE|EL|ES|FI|FR|HR|HU|IE|IT|LT|LU|LV|MT|NL|PL|PT|RO|SE|SI|SK)[A-Z0-9]{8,12}\b",
    "CHINA_ID": r"\b[1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx]\b",
    "JAPAN_MYNUMBER": r"\b\d{12}\b",
    "BRAZIL_CPF": r"\b\d{3}[.\s]?\d{3}[.\s]?\d{3}[-\s]?\d{2}\b",
    "MEXICO_CURP": r"\b[A-Z]{4}\d{6}[HM][A-Z]{5}[A-Z0-9]\d\b",
    "MEXICO_RFC": "\\b[A-Z\u00d1&]{4}\\d{6}[A-Z0-9]{3}\\b",
    "CANADA_SIN": r"\b\d{3}[- ]?\d{3}[- ]?\d{3}\b",
    "AU_TFN": r"\b\d{3}[- ]?\d{3}[- ]?\d{3}\b",
    "AU_ABN": r"\b\d{2}[- ]?\d{3}[- ]?\d{3}[- ]?\d{3}\b",
    "PHONE": r"(?:\+\d{1,3}[\s.-]?)?(?:\(?\d{2,5}\)?[\s.-]?)?\d{3,5}[\s.-]?\d{3,5}(?!\d)",
}
# How sure a detector is.
CONFIDENCE = {
    "EMAIL": 0.98, "CARD": 0.95, "IP_ADDRESS": 0.90, "AADHAAR": 0.97, "PAN": 0.90, "SECRET_TOKEN": 0.75, "IBAN": 0.96,
    "MRZ_PASSPORT": 0.97, "MRZ_PASSPORT_NAME": 0.95, "SSN": 0.90, "UK_NINO": 0.80, "EU_VAT": 0.70, "CHINA_ID": 0.95,
    "JAPAN_MYNUMBER": 0.95, "BRAZIL_CPF": 0.95, "MEXICO_CURP": 0.70, "MEXICO_RFC": 0.65, "CANADA_SIN": 0.85, "AU_TFN": 0.85,
    "AU_ABN": 0.90, "PHONE": 0.80,
}
#: A German VAT number has a check digit, which makes it surer than the others.
CHECKED_VAT = 0.93
# Prefixes of known secrets; the longest and shortest candidate; entropy bars.
SECRET_PREFIX = r"^(sk-|pk_live_|pk_test_|rk_live_|ghp_|gho_|ghu_|ghs_|github_pat_|AKIA|ASIA|AIza|xox[baprs]-|eyJ[A-Za-z0-9_-]*\.|Bearer\s)"
SECRET_BAR, SECRET_HEX_BAR = 4.0, 3.0
# Prefixes that no National Insurance number has.
NINO_EXCLUDED = ["BG", "GB", "NK", "KN", "TN", "NT", "ZZ"]
# Names of URL parameters that carry secrets or identities.
SENSITIVE_PARAMS = ["token", "access_token", "auth", "password", "pwd", "email", "ssn", "api_key", "apikey", "key", "session", "sid"]
# Entity types whose loss is grave, as the scorer and as the compliance rules list them.
HIGH_STAKES = ["AADHAAR", "PAN", "CARD", "SSN", "IBAN", "MRZ_PASSPORT", "MRZ_PASSPORT_NAME", "SECRET_TOKEN", "UK_NINO", "EU_VAT", "CHINA_ID", "JAPAN_MYNUMBER", "BRAZIL_CPF", "MEXICO_CURP", "MEXICO_RFC", "CANADA_SIN", "AU_TFN", "AU_ABN"]
HIGH_STAKES_COMPLIANCE = ["AADHAAR", "PAN", "CARD", "SSN", "IBAN", "MRZ_PASSPORT", "UK_NINO", "EU_VAT", "CHINA_ID", "JAPAN_MYNUMBER", "BRAZIL_CPF", "CANADA_SIN", "AU_TFN", "AU_ABN"]


#: White space as patterns of the web mean it; Java's own class is ASCII only.
SPACE = " \\t\\n\\x0B\\f\\r\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"


def java(pattern: str) -> str:
    """A pattern with ASCII boundaries, and white space of all scripts, for Java's regex."""
    out, inside, at = [], False, 0
    while at < len(pattern):
        two = pattern[at : at + 2]
        if two == r"\s":
            out.append(SPACE if inside else f"[{SPACE}]")
        elif two == r"\S" and not inside:
            out.append(f"[^{SPACE}]")
        elif two == r"\b" and not inside:
            out.append(BOUNDARY)
        elif two[0] == "\\":
            out.append(two)
        else:
            inside = two[0] == "[" or inside and two[0] != "]"
            out.append(two[0])
            two = two[0]
        at += len(two)
    return "".join(out)
