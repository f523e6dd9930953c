"""Small labelled tables that the rule operators are held against.

Numbers are made here: digits chosen at will, check digits worked out by the rule of each kind,
and spoilt by one for the invalid ones. Public examples are used only where named: the card
4111 1111 1111 1111, and the specimen passport of the International Civil Aviation Organization.
Labels, field hints and buttons are our own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CARD = "4111111111111111"
MRZ_NAME, MRZ_DATA = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<", "L898902C36UTO7408122F1204159ZE184226B<<<<<10"


def luhn(body: str) -> str:
    """body with its check digit."""
    total = sum(sum(divmod(int(d) * (2 if i % 2 == 0 else 1), 10)) for i, d in enumerate(reversed(body)))
    return body + str(-total % 10)


def permuted(digit: int, times: int) -> int:
    """A digit after so many steps of the permutation of the Verhoeff scheme."""
    # Fixed value: the permutation of the scheme
    first = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    for _ in range(times):
        digit = first[digit]
    return digit


def verhoeff(body: str) -> str:
    """body with its check digit, by the group of a pentagon's symmetries: turns 0 to 4, and 5 to 9 those after a flip."""

    def times(a: int, b: int) -> int:
        return (a + b if a < 5 else a - b) % 5 + 5 * ((a >= 5) != (b >= 5))

    c = 0
    for i, d in enumerate(reversed(body), 1):
        x = permuted(int(d), i % 8)
        c = times(c, x)
    return body + str(next(d for d in range(10) if times(c, d) == 0))


def iban(country: str, account: str) -> str:
    digits = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{country}{98 - int(digits) % 97:02d}{account}"


def weighted(body: str, weights: list[int]) -> int:
    return sum(int(d) * w for d, w in zip(body, weights, strict=True))


def china(body: str) -> str:
    return body + "10X98765432"[weighted(body, [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2]) % 11]


def japan(body: str) -> str:
    """Weights run from the left, as the detector has them."""
    r = weighted(body, [2, 3, 4, 5, 6, 7, 2, 3, 4, 5, 6]) % 11
    return body + str(0 if r <= 1 else 11 - r)


def brazil(body: str) -> str:
    for n in (10, 11):
        r = weighted(body, list(range(n, 1, -1))) * 10 % 11
        body += str(r % 10)
    return body


def australian_tax(start: int) -> str:
    return next(str(n) for n in range(start, start + 100) if weighted(str(n), [10, 7, 8, 4, 6, 3, 5, 2, 1]) % 11 == 0)


def australian_business(start: int) -> str:
    return next(str(n) for n in range(start, start + 100) if weighted(str(n - 10**10), [10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19]) % 89 == 0)


def german_vat(body: str) -> str:
    product = 10
    for d in body:
        total = (int(d) + product) % 10 or 10
        product = 2 * total % 11
    return "DE" + body + str((11 - product) % 10)


def spoilt(number: str) -> str:
    """The number with another last digit."""
    return number[:-1] + str((int(number[-1]) + 1) % 10)


def grouped(number: str, *sizes: int, by: str = " ") -> str:
    out, at = [], 0
    for n in sizes:
        out.append(number[at : at + n])
        at += n
    return by.join(out)


AADHAAR, FRENCH = verhoeff("57310462891"), iban("FR", "20041010050500013M02606")
BUSINESS, TAX = australian_business(73_184_205_900), australian_tax(431_207_800)

# (id, text, field label, expected types)
PII_VECTORS = [
    ("resident-number", AADHAAR, "Resident number", "AADHAAR"),
    ("resident-number-spoilt", spoilt(AADHAAR), "Resident number", "PHONE"),
    ("resident-number-grouped", grouped(AADHAAR, 4, 4, 4), "Resident number", "AADHAAR"),
    ("tax-account", "QWEPK4821Z", "Tax account", "PAN"),
    ("tax-account-class", "QWEZK4821Z", "Tax account", ""),
    ("bank-account", FRENCH, "Bank", "IBAN"),
    ("bank-account-spoilt", spoilt(FRENCH), "Bank", "PHONE"),
    ("passport-data", MRZ_DATA, "Second line", "MRZ_PASSPORT"),
    ("passport-data-spoilt", spoilt(MRZ_DATA), "Second line", ""),
    ("passport-name", MRZ_NAME, "First line", "MRZ_PASSPORT_NAME"),
    ("card", CARD, "Card", "CARD"),
    ("card-spoilt", spoilt(CARD), "Card", "PHONE"),
    ("card-grouped", grouped(CARD, 4, 4, 4, 4), "Card", "CARD"),
    ("mailbox", "write to lena.fisk@example.net today", "Contact", "EMAIL"),
    ("line-ten", "7012345690", "Call", "PHONE"),
    ("line-abroad", "+49 30 901820", "Call", "PHONE"),
    ("line-halves", "70123 45690", "Call", "PHONE"),
    ("line-narrow-space", "70123\u00a045690", "Call", "PHONE"),
    ("year", "1987", "Founded", ""),
    ("parcel", "PRC-77-1042", "Parcel", ""),
    ("key-known", "ghp_" + "Zx81" * 9, "Key", "SECRET_TOKEN"),
    ("key-mixed", "Tq7Lw2Xv9Bn4Rk6Jd8Hs3Gf5Mc1Pz0Yy", "Key", "SECRET_TOKEN"),
    ("words", "a-long-path-of-plain-words-without-any-digits", "Path", ""),
    ("goods", "Garden chair, folding", "Goods", ""),
    ("social", "219-09-9999", "Social security", "SSN"),
    ("social-area", "666-09-9999", "Social security", ""),
    ("insurance", "JK482913B", "Insurance", "UK_NINO"),
    ("insurance-prefix", "ZZ482913B", "Insurance", ""),
    ("vat", german_vat("28471930"), "VAT", "EU_VAT"),
    ("resident-china", china("32010219770315462"), "Resident", "CHINA_ID"),
    ("number-japan", japan("40718253961"), "Number", "JAPAN_MYNUMBER"),
    ("person-brazil", grouped(brazil("284915067"), 3, 3, 3, by=".") + "-" + brazil("284915067")[9:], "Person", "BRAZIL_CPF"),
    ("person-brazil-same", "222.222.222-22", "Person", ""),
    ("insurance-canada", grouped(luhn("19384726"), 3, 3, 3, by="-"), "Insurance", "CANADA_SIN"),
    ("tax-australia", grouped(TAX, 3, 3, 3), "Tax", "AU_TFN"),
    ("business-australia", grouped(BUSINESS, 2, 3, 3, 3), "Business", "AU_ABN"),
    ("person-mexico", "ROLM851130MJCDPN07", "Person", "MEXICO_CURP"),
    ("company-mexico", "GOLM851130QX4", "Company", "MEXICO_RFC"),
    ("passenger", "Ines Carla Duarte", "Passenger name", "NAME"),
    ("address", "from 10.44.7.219 at night", "Log", "IP_ADDRESS"),
    ("two-kinds", f"ask o.t@example.com about {grouped(CARD, 4, 4, 4, 4)}", "Note", "CARD,EMAIL"),
]

# (id, type, aria label, placeholder, selector, expected key)
FIELDS = [
    ("label", "input:text", "E-mail", None, None, "email"),
    ("type", "input:email", None, None, None, "email"),
    ("hint", "input:text", None, "Type your PAN number", None, "pan"),
    ("hint-only", "input:text", None, "Please enter aadhaar number here", None, "aadhaar"),
    ("precedence", "input:tel", "Emergency phone", None, None, "emergency_phone"),
    ("specific", "input:text", "Permanent address", None, None, "home_address"),
    ("date", "input:date", None, None, None, "dob"),
    ("work", "input:text", "Workplace", None, None, "company"),
    ("codes", "input:text", "Postcode", None, None, "zip"),
    ("by-id", "input:text", None, None, "#zip", "zip"),
    ("by-name", "input:text", None, None, 'input[name="title"]', "occupation"),
    ("by-id-words", "input:text", None, None, "#last-name", "last_name"),
    ("secret", "input:password", "Your password", None, None, None),
    ("code", "input:text", "Verification code", None, None, None),
    ("finder", "input:text", "Find a train", None, None, None),
    ("robot", "input:text", None, "Solve the captcha", None, None),
    ("finder-id-exact", "input:text", "City", None, "#search-city", "city"),
    ("nothing", "input:text", "Shoe size", None, None, None),
]

# (id, text, selector, page url, expected class)
ACTIONS = [
    ("buy", "Buy now", "#b1", "", "PAYMENT"),
    ("send", "Submit response", "#b2", "", "SUBMIT"),
    ("erase", "Erase all notes", "#b3", "", "DELETE"),
    ("stop", "Cancel membership", "#b4", "", "CANCEL"),
    ("deploy", "Deploy to production", "#b5", "", "PUBLISH"),
    ("seat", "Reserve seat", "#b6", "", "BOOK"),
    ("till", "Checkout", "#b7", "", "PAYMENT"),
    ("accept", "Accept quote", "#b8", "", "APPROVE"),
    ("by-page", "Place it", "#b9", "https://shop.example.org/billing", "PAYMENT"),
    ("onward", "Next step", "#b10", "", "WORKFLOW_CONTINUE"),
    ("by-selector", "Go", 'button[type="submit"]', "", "SUBMIT"),
    ("return", "Previous", "#b11", "", None),
    ("dismiss", "Cancel", "#b12", "", None),
    ("read", "Read the story", "#b13", "", None),
    ("on", "Continue", "#b14", "", None),
    ("fold", "Collapse", "#b15", "", None),
    ("wins", "Purge and view", "#b16", "", None),
]

# (id, local action, target, confidence, cloud action, target, confidence, expected resolution, winner's side)
DEBATES = [
    ("same", "click", "#go", 0.71, "click", "#go", 0.52, "AGREE", "local"),
    ("same-idle", "wait", None, 0.40, "wait", None, 0.45, "AGREE", "cloud"),
    ("close", "fill", "#m", 0.62, "fill", "#n", 0.66, "DISAGREE_AUTO_RESOLVE", "cloud"),
    ("apart", "click", "#m", 0.81, "click", "#n", 0.70, "DISAGREE_SHOW_BOTH", "local"),
    ("far", "click", "#m", 0.30, "click", "#n", 0.72, "DISAGREE_ASK_USER_RECOMMENDED", "cloud"),
    ("no-cloud", "scroll", None, 0.5, None, None, None, "LOCAL_ONLY_DEGRADED", "local"),
    ("no-local", None, None, None, "fill", "#m", 0.5, "CLOUD_ONLY_DEGRADED", "cloud"),
    ("nobody", None, None, None, None, None, None, "ERROR", None),
]


def pii_vectors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([r[:3] for r in PII_VECTORS], "id string, text string, label string")


def fields(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([r[:5] for r in FIELDS], "id string, type string, aria_label string, placeholder string, selector string")


def actions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([r[:4] for r in ACTIONS], "id string, text string, selector string, page_url string")


def debates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([r[:7] for r in DEBATES], "id string, local_action string, local_target string, local_confidence double, cloud_action string, cloud_target string, cloud_confidence double")
