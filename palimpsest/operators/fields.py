"""Form fields: which stored key a field asks for, and whether an element's action has consequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.patterns import java

# Words that say nothing about a field.
NOISE = ["please", "enter", "your", "type", "input", "here", "provide", "fill", "select", "choose", "required", "optional", "valid", "e.g", "eg", "the", "a", "an", "of", "for", "in", "to"]
# Fields that are never filled from a store.
EXCLUDED = [
    r"\b(password|passwd|pwd|passcode|secret)\b",
    r"\b(otp|one time password|pin(?![-_\s]?code)|verification code|security code|2fa|mfa)\b",
    r"\b(captcha|recaptcha|hcaptcha|turnstile)\b",
    r"\b(search|query|find|filter)\b",
    r"\b(comment|feedback|message|review|description|notes|remarks)\b",
    r"\b(terms|conditions|agree|privacy policy|consent)\b",
    r"\b(coupon|promo|discount|voucher|referral code)\b",
]
# Fixed values: (key, input types, exact labels, pattern), in order of precedence.
FIELD_RULES = [
    ("email", ["input:email", "email"], ["email", "e-mail", "email address", "e-mail address", "email id", "contact email", "work email", "personal email", "electronic mail"], r"\b(email|e-mail|email_id|emailaddress|mail_address)\b"),
    ("emergency_phone", [], ["emergency phone", "emergency contact", "emergency number", "emergency telephone"], r"\b(emergency[-_\s]?(phone|contact|number|mobile))\b"),
    ("work_phone", [], ["work phone", "office phone", "business phone", "work telephone", "office telephone"], r"\b(work|office|business)[-_\s]?(phone|telephone|number|mobile)\b"),
    ("home_phone", [], ["home phone", "landline", "home telephone", "residential phone"], r"\b(home|landline|residential)[-_\s]?(phone|telephone|number)\b"),
    ("phone", ["input:tel", "tel"], ["phone", "phone number", "telephone", "telephone number", "mobile", "mobile number", "cell phone", "cell number", "contact number", "phone no", "mobile no", "contact no", "cell", "phone #"], r"\b(phone|mobile|telephone|cellphone|contact_number|phonenumber|mobilenumber)\b"),
    ("first_name", [], ["first name", "given name", "forename", "fname", "first_name", "firstname"], r"\b(first[-_\s]?name|given[-_\s]?name|forename|fname)\b"),
    ("last_name", [], ["last name", "surname", "family name", "lname", "last_name", "lastname"], r"\b(last[-_\s]?name|surname|family[-_\s]?name|lname)\b"),
    ("middle_name", [], ["middle name", "mname", "middle_name", "middlename", "middle initial"], r"\b(middle[-_\s]?name|mname|middle[-_\s]?initial)\b"),
    ("name", [], ["full name", "name", "your name", "applicant name", "candidate name", "user name", "customer name", "legal name", "student name", "employee name", "contact name", "person name", "complete name"], r"\b(full[-_\s]?name|applicant[-_\s]?name|legal[-_\s]?name|candidate[-_\s]?name|customer[-_\s]?name)\b"),
    ("username", [], ["username", "user id", "user name", "login id", "handle", "screen name", "account name"], r"\b(username|user[-_\s]?id|login[-_\s]?id|account[-_\s]?name|handle)\b"),
    ("billing_address", [], ["billing address", "billing street", "bill address", "billing address line 1"], r"\bbilling[-_\s]?(address|street|addr)\b"),
    ("shipping_address", [], ["shipping address", "delivery address", "shipping street", "ship address"], r"\b(shipping|delivery)[-_\s]?(address|street|addr)\b"),
    ("home_address", [], ["home address", "residential address", "permanent address"], r"\b(home|residential|permanent)[-_\s]?(address|addr)\b"),
    ("street_address", [], ["street address", "address line 1", "address line 2", "street", "street name", "house number"], r"\b(street[-_\s]?address|address[-_\s]?line|street)\b"),
    ("address", [], ["address", "postal address", "mailing address", "physical address", "residence address"], r"\b(address|postal[-_\s]?address|mailing[-_\s]?address)\b"),
    ("city", [], ["city", "town", "district", "municipality", "city / town"], r"\b(city|town|district|municipality)\b"),
    ("state", [], ["state", "province", "region", "state / province", "county"], r"\b(state|province|region|county)\b"),
    ("zip", [], ["zip", "zip code", "postal code", "postcode", "pincode", "pin code", "zip / postal code", "postal / zip code", "pin"], r"\b(zip[-_\s]?code|postal[-_\s]?code|postcode|pincode|pin[-_\s]?code)\b"),
    ("country", [], ["country", "nation", "country / region", "country of residence"], r"\b(country|nation)\b"),
    ("college", [], ["college", "college name", "institution", "institute", "school", "school name", "academy"], r"\b(college|institution|institute|school)[-_\s]?(name)?\b"),
    ("university", [], ["university", "university name", "campus"], r"\b(university|campus)[-_\s]?(name)?\b"),
    ("company", [], ["company", "company name", "organization", "organisation", "employer", "workplace", "business name"], r"\b(company|organization|organisation|employer|workplace)[-_\s]?(name)?\b"),
    ("occupation", [], ["occupation", "job title", "profession", "designation", "role", "title", "position"], r"\b(occupation|job[-_\s]?title|profession|designation|position)\b"),
    ("dob", ["input:date", "date"], ["date of birth", "dob", "birth date", "birthdate", "born on", "d.o.b."], r"\b(date[-_\s]?of[-_\s]?birth|birth[-_\s]?date|birthdate|dob)\b"),
    ("gender", [], ["gender", "sex"], r"\b(gender|sex)\b"),
    ("ssn", [], ["ssn", "social security number", "social security #", "social security no"], r"\b(ssn|social[-_\s]?security[-_\s]?(number|no|#)?)\b"),
    ("pan", [], ["pan", "pan number", "pan card", "pan no"], r"\b(pan[-_\s]?(number|card|no)?)\b"),
    ("aadhaar", [], ["aadhaar", "aadhaar number", "aadhaar card", "uidai", "aadhar"], r"\b(aadhaar|aadhar)[-_\s]?(number|card|no)?\b"),
]
# What is tried when nothing else matched.
LAST_RESORT = ("name", r"^name$|\b(your|full)?[-_\s]?name\b")


def has(text: Column, pattern: str) -> Column:
    """Case-insensitive search with ASCII word boundaries; null text has nothing."""
    return F.coalesce(text.rlike("(?i)" + java(pattern)), F.lit(False))


def label_words(label: Column) -> Column:
    """Lower case, punctuation and noise words gone, single spaces."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(label), r"[:*#_\-/\\]", " "), java(r"[^a-z0-9\s]"), "")
    return F.concat_ws(" ", F.filter(F.split(plain, java(r"\s+")), lambda w: (w != "") & ~w.isin(NOISE)))


def normal(alias: str) -> str:
    import re

    plain = re.sub(r"[^a-z0-9\s]", "", re.sub(r"[:*#_\-/\\]", " ", alias.lower()))
    return " ".join(w for w in plain.split() if w not in NOISE)


def aliases(names: list[str]) -> list[str]:
    return sorted({x for a in names for x in (a, normal(a)) if x})


def selector_names(selector: Column) -> list[Column]:
    """The id and the name that a selector holds, hyphens and underscores as spaces; null where it holds none."""
    found = (F.regexp_extract(selector, p, 1) for p in (r"#([a-zA-Z0-9_\-]+)", r"""\[name=["']?([^"'\]]+)["']?\]"""))
    return [F.nullif(F.regexp_replace(x, "[-_]", " "), F.lit("")) for x in found]


def matched_field(kind: Column, *labels: Column, selector: Column | None = None) -> Column:
    """struct<key, confidence, reason> of what a field asks for; key is null where nothing fits.

    An exact label, id or name decides, then a pattern anywhere, then the input type, then the
    last resort, which is of medium confidence; rules are tried in order. Excluded fields have no
    key, unless only the selector excludes them and a label is exact. Null labels are skipped.
    """
    kind = F.lower(F.coalesce(kind, F.lit("")))
    said = [F.when(F.trim(x) != "", x) for x in labels]
    hints = [] if selector is None else selector_names(selector)
    kept = lambda xs: F.filter(F.array(*map(label_words, xs)), lambda w: w.isNotNull() & (w != ""))
    seen = F.struct(kept(said).alias("words"), kept([*said, *hints]).alias("names"), F.concat_ws(" ", *said, *hints).alias("text"), kind.alias("kind"))
    return let(seen, rule_of)


def rule_of(seen: Column) -> Column:
    """matched_field of a struct of a field's label words, all its names, all its text and its kind."""
    words, names, every, kind = (seen[n] for n in ("words", "names", "text", "kind"))
    known = F.array(*map(F.lit, sorted({a for r in FIELD_RULES for a in aliases(r[2])})))
    label_text, exact_label = F.concat_ws(" ", words), F.arrays_overlap(words, known)
    row = lambda key, sure, why: F.struct(F.lit(key).cast("string").alias("key"), F.lit(sure).alias("confidence"), F.lit(why).alias("reason"))
    excluded = F.lit(False)
    for p in EXCLUDED:
        excluded = excluded | has(label_text, p) | (has(every, p) & ~exact_label) | has(kind, p)
    return F.coalesce(
        F.when(excluded, row(None, "none", "excluded")), F.when(kind.isin("password", "input:password"), row(None, "none", "password")),
        *(F.when(F.arrays_overlap(names, F.array(*map(F.lit, aliases(r[2])))), row(r[0], "high", "label")) for r in FIELD_RULES), *(F.when(has(every, r[3]), row(r[0], "high", "pattern")) for r in FIELD_RULES),
        *(F.when(kind.isin(r[1]), row(r[0], "high", "type")) for r in FIELD_RULES if r[1]), F.when(has(every, LAST_RESORT[1]), row(LAST_RESORT[0], "medium", "fallback")), row(None, "none", "no match"),
    )


def field_key(kind: Column, *labels: Column, selector: Column | None = None) -> Column:
    """The key a field asks for, or null."""
    return matched_field(kind, *labels, selector=selector)["key"]


# Labels that only move about the page.
DISMISSAL = ["back", "close", "reset", "clear", "edit", "previous", "prev", "help", "expand", "collapse", "toggle", "menu", "settings", "details", "preview", "view"]
# What the classes of actions are recognised by, in order of precedence; risk and whether it can be undone.
ACTION_RULES = [
    ("DELETE", r"\b(delete|delete account|remove account|destroy|purge|wipe|terminate|deactivate|uninstall|erase|permanently delete|delete my data)\b", "HIGH"),
    ("CANCEL", r"\b(cancel\s+(?:order|subscription|booking|membership|flight|ticket|service|reservation|policy|plan|account)|cancel\s+my\s+(?:subscription|account))\b", "HIGH"),
    ("PAYMENT", "\\b(pay|pay now|make payment|confirm payment|pay\\s+[₹$€£\\d]|transfer|transfer funds|checkout|buy|buy now|purchase|place order|order now|subscribe|deposit|withdraw|complete payment)\\b", "HIGH"),
    ("BOOK", r"\b(book|book now|reserve|reserve seat|confirm booking|book flight|book hotel|confirm reservation|book ticket)\b", "MEDIUM"),
    ("PUBLISH", r"\b(publish|publish now|deploy|post publicly|broadcast|release|broadcast message|send tweet|publish post)\b", "MEDIUM"),
    ("APPROVE", r"\b(approve|approve request|approve expense|accept quote|accept offer|agree & continue|accept terms|authorize transfer|accept contract)\b", "HIGH"),
    ("SUBMIT", r"\b(submit|submit application|submit form|submit kyc|submit quiz|submit exam|submit response|send message|send enquiry|send email|complete registration|confirm transaction|confirm order)\b", "MEDIUM"),
    ("WORKFLOW_CONTINUE", r"\b(continue to payment|proceed to checkout|proceed to payment|next step|finish|place request)\b", "MEDIUM"),
]
FINANCIAL_PAGE, FINANCIAL_TEXT, FINANCIAL_LABEL = "checkout|payment|billing|subscribe|cart", "[₹$€£]\\s*\\d+|total|subtotal|amount due", "pay|place|confirm|complete"


def action_class(text: Column, aria: Column, selector: Column, kind: Column, page_url: Column, surrounding: Column, task: Column) -> Column:
    """struct<type, risk, reversible> of an action with consequences, or null. Null arguments count as empty."""
    text, aria, selector, kind, page_url, surrounding, task = (F.trim(F.coalesce(x, F.lit(""))) for x in (text, aria, selector, kind, page_url, surrounding, task))
    joined = F.lower(F.concat_ws(" ", text, aria, selector, kind))
    away = r"\b(" + "|".join(DISMISSAL) + r")\b"
    cancels = (has(text, "^cancel$") | has(aria, "^cancel$")) & ~joined.contains("subscription") & ~joined.contains("order")
    dismissed = has(text, away) | has(aria, away) | cancels
    agreed = {"DELETE": text.contains("confirm") | text.contains("yes"), "CANCEL": text.contains("confirm")}
    found = []
    for name, pattern, risk in ACTION_RULES:
        hit = has(joined, pattern)
        if name in agreed:
            hit = hit | (has(task, pattern) & agreed[name])
        if name == "SUBMIT":
            hit = hit | F.lower(kind).contains("submit") | selector.contains('type="submit"')
        row = F.struct(F.lit(name).alias("type"), F.lit(risk).alias("risk"), F.lit(name == "WORKFLOW_CONTINUE").alias("reversible"))
        found.append(F.when(hit, row))
        if name == "PAYMENT":
            found.append(F.when(has(page_url, FINANCIAL_PAGE) & (has(surrounding, FINANCIAL_TEXT) | has(text, FINANCIAL_LABEL)), row))
    return F.when(~dismissed, F.coalesce(*found))
