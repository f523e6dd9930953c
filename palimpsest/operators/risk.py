"""Risk rules for pages and decisions: trust gate, compliance signals, confidence, debate and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.binding import let
from ..functions.patterns import java
from .fields import has

# Domains that look-alikes imitate, in order of precedence.
TRUSTED = ["uidai.gov.in", "incometax.gov.in", "digilocker.gov.in", "india.gov.in", "nsdl.co.in", "protean-tinpan.com", "utiitsl.com", "epfindia.gov.in", "passportindia.gov.in", "irctc.co.in", "onlinesbi.sbi", "sbi.co.in", "hdfcbank.com", "icicibank.com", "axisbank.com", "pnbindia.in"]
# Hosts of ill repute.
SUSPICIOUS_HOST = [r"(?i)^xn--", r"\d{1,3}(\.\d{1,3}){3}$", r"(?i)-(login|secure|verify|update|account)-", r"(?i)\.(zip|mov|tk|top|xyz)$"]
# Kinds of sensitive fields.
SENSITIVE_FIELDS = {
    "aadhaar": r"aadhaar|aadhar|uidai", "pan": r"\bpan\b|permanent account number", "card": r"card\s*number|credit\s*card|debit\s*card|\bcvv\b|card\s*expiry",
    "otp": r"\botp\b|one[-\s]?time\s*password", "bank_account": r"account\s*number|ifsc",
}
# What compliance signals are recognised by.
SIGNALS = {
    "cookie_banner": r"\b(we use cookies|this (site|website) uses cookies|cookie (consent|policy|preferences|settings)|accept (all )?cookies|manage (cookie|your) preferences|by continuing to (browse|use) this (site|website)|consent to (the use of )?cookies)\b",
    "privacy_policy": r"\b(privacy policy|privacy notice|privacy statement)\b",
    "cross_border": r"\b(cross-border|international transfer|transferred? (outside|to countries outside)|standard contractual clauses|third[- ]?countr(y|ies)|adequacy decision)\b",
    "do_not_sell": r"\b(do not sell (or share )?my (personal )?(information|data)|your privacy choices|opt[- ]?out of (the )?sale|do not sell my info)\b",
    "opt_out": r"\b(unsubscribe|opt[- ]?out of marketing|marketing preferences|email preferences)\b",
    "health": r"\b(diagnos(is|es)|medical (history|condition|record)|prescription|patient (name|id|information)|physician|treatment plan|health insurance|medication|therapy session|mental health|hiv status|blood type|allergies|immunization|surgery history|clinical trial)\b",
}
DEDUCTION = {"HIGH": 25, "MEDIUM": 15, "LOW": 5}


def host(url: Column) -> Column:
    """Host in lower case without www., empty where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"^www\.", "")


def impersonated(domain: Column, trusted: list[str] = TRUSTED) -> Column:
    """The first trusted domain that `domain` is close to (two edits), or whose brand it holds; null for the trusted themselves."""
    own = F.lit(False)
    tests = []
    for t in trusted:
        own = own | (domain == t) | domain.endswith("." + t)
        brand = t.split(".")[0]
        near = F.levenshtein(domain, F.lit(t)).between(1, 2) & (F.abs(F.length(domain) - len(t)) <= 3)
        held = domain.contains(brand) & ~domain.endswith(t) if len(brand) >= 3 else F.lit(False)
        tests.append(F.when(near | held, t))
    return F.when((domain != "") & ~own, F.coalesce(*tests))


def sensitive_kinds(texts: Column, has_password: Column) -> Column:
    """Kinds of sensitive data that a form's texts ask for, in fixed order."""
    kinds = [F.when(has_password, "password"), *(F.when(has(texts, p), k) for k, p in SENSITIVE_FIELDS.items())]
    return F.array_compact(F.array(*kinds))


def trust_level(url: Column, form_action: Column, kinds: Column) -> Column:
    """struct<level, reasons>: allow, warn or block, with codes of what was found."""
    domain, form = host(url), host(form_action)
    foreign = (form != "") & (domain != "") & (form != domain) & ~F.endswith(form, F.concat(F.lit("."), domain)) & ~F.endswith(domain, F.concat(F.lit("."), form))
    plain = ~F.coalesce(url.rlike("(?i)^https:"), F.lit(False)) & (domain != "")
    alike = impersonated(domain).isNotNull()
    held = lambda *names: F.arrays_overlap(kinds, F.array(*map(F.lit, names)))
    many = F.size(kinds) >= 2
    grave = many & ((F.size(kinds) >= 3) | (held("password", "otp") & held("aadhaar", "pan", "card", "bank_account")))
    level = F.when(foreign | alike | grave, "block").when(plain | many, "warn").otherwise("allow")
    reasons = F.array_compact(F.array(F.when(plain, "NOT_HTTPS"), F.when(foreign, "FOREIGN_FORM"), F.when(alike, "LOOKALIKE"), F.when(many, "SENSITIVE_COMBINATION")))
    return F.struct(level.alias("level"), reasons.alias("reasons"))


def linked(links: Column, pattern: str) -> Column:
    """Whether a link's text or target has the pattern."""
    return F.coalesce(F.exists(links, lambda x: has(x["text"], pattern) | has(x["href"], pattern)), F.lit(False))


def compliance(text: Column, url: Column, types: Column, links: Column | None = None) -> Column:
    """struct<score, findings, signals>: 100 less what each finding costs, and what was seen.

    `types` are the entity types found on the page; links, an array of struct<text, href>, are
    searched for policies and opt-outs beside the text.
    """
    def seen(text: Column) -> Column:
        said = {k: has(text, p) for k, p in SIGNALS.items()}
        if links is not None:
            for k in ("privacy_policy", "do_not_sell", "opt_out"):
                said[k] = said[k] | linked(links, SIGNALS[k])
        grave = F.size(F.array_intersect(types, F.array(*map(F.lit, P.HIGH_STAKES_COMPLIANCE))))
        insecure = F.coalesce(F.lower(F.trim(url)).startswith("http://"), F.lit(False))
        return F.struct(*(v.alias(k) for k, v in said.items()), insecure.alias("insecure"), (F.size(types) > 0).alias("collects"), grave.alias("high_stakes"))

    def judged(s: Column) -> Column:
        findings = [
            ("GDPR_NO_CONSENT_BANNER", "MEDIUM", s["collects"] & ~s["cookie_banner"]),
            ("GDPR_NO_PRIVACY_POLICY_LINK", "MEDIUM", s["collects"] & ~s["privacy_policy"]),
            ("GDPR_POSSIBLE_EXCESSIVE_COLLECTION", "LOW", s["high_stakes"] >= 3),
            ("CCPA_NO_DO_NOT_SELL_LINK", "LOW", s["collects"] & ~s["do_not_sell"]),
            ("CCPA_NO_OPT_OUT_MECHANISM", "LOW", s["collects"] & ~s["opt_out"] & ~s["do_not_sell"]),
            ("HIPAA_HEALTH_INFO_ON_INSECURE_FORM", "HIGH", s["health"] & s["insecure"]),
            ("HIPAA_HEALTH_INFO_WITH_IDENTIFIER", "MEDIUM", s["health"] & (s["high_stakes"] > 0)),
            ("HIPAA_HEALTH_INFO_FORM_DETECTED", "LOW", s["health"] & (s["high_stakes"] == 0)),
        ]
        lost = sum((F.when(hit, DEDUCTION[n]).otherwise(0) for _, n, hit in findings), F.lit(0))
        return F.struct(F.greatest(F.lit(0), 100 - lost).alias("score"), F.array_compact(F.array(*(F.when(hit, name) for name, _, hit in findings))).alias("findings"), s.alias("signals"))

    # each signal is looked for once, not for each finding that names it
    return let(let(F.lower(F.coalesce(text, F.lit(""))), seen), judged)


def https_score(url: Column) -> Column:
    return F.when(url.startswith("https://"), 0.9).when(url.startswith("http://"), 0.4).when(url != "", 0.6)


def reputation(url: Column) -> Column:
    name = host(url)
    bad = F.lit(False)
    for p in SUSPICIOUS_HOST:
        bad = bad | name.rlike(p)
    return F.when(name != "", F.when(bad, 0.25).otherwise(0.85))


def destination_safety(action_type: Column, known: Column) -> Column:
    """0.9 for an action without consequences, less for payments than for others; null where unknown."""
    return F.when(known, F.when(action_type.isNull(), 0.9).when(action_type == "PAYMENT", 0.35).otherwise(0.55))


def rarity(types: Column) -> Column:
    return F.when(F.size(types) > 0, F.when(F.arrays_overlap(types, F.array(*map(F.lit, P.HIGH_STAKES))), 0.55).otherwise(0.85))


def context_match(task: Column, label: Column) -> Column:
    """A half, and a fifth for each task word in the label, one at most."""
    words = F.filter(F.split(F.regexp_replace(F.lower(task), r"[^\w\s]", " "), r"\s+"), lambda w: F.length(w) > 2)
    hits = F.size(F.filter(words, lambda w: F.lower(label).contains(w)))
    return F.when(F.size(words) > 0, F.when(F.trim(label) == "", 0.6).otherwise(0.5 + F.least(F.lit(0.5), hits * 0.2)))


def confidence(*factors: Column) -> Column:
    """Geometric mean of the factors that aren't null, each 0.0001 at least; a half without any."""
    logs = F.transform(F.array_compact(F.array(*(F.when(~F.isnan(f), f) for f in factors))), lambda f: F.ln(F.greatest(F.lit(1e-4), F.least(F.lit(1.0), f))))
    return F.when(F.size(logs) == 0, 0.5).otherwise(F.round(F.exp(F.aggregate(logs, F.lit(0.0), lambda s, v: s + v) / F.size(logs)), 3))


def debate(pairs: DataFrame) -> DataFrame:
    """Rows with a local and a cloud decision -> id, resolution, winner. Both missing: ERROR."""
    same_target = F.when(F.col("local_target").isNotNull() & F.col("cloud_target").isNotNull(), F.col("local_target") == F.col("cloud_target")).otherwise(F.col("local_target").isNull() & F.col("cloud_target").isNull())
    agree = (F.col("local_action") == F.col("cloud_action")) & same_target
    mine, theirs = F.coalesce("local_confidence", F.lit(0.6)), F.coalesce("cloud_confidence", F.lit(0.7))
    gap = F.round(F.abs(mine - theirs), 3)
    resolution = (
        F.when(F.col("local_action").isNull() & F.col("cloud_action").isNull(), "ERROR")
        .when(F.col("local_action").isNull(), "CLOUD_ONLY_DEGRADED")
        .when(F.col("cloud_action").isNull(), "LOCAL_ONLY_DEGRADED")
        .when(agree, "AGREE").when(gap < 0.05, "DISAGREE_AUTO_RESOLVE").when(gap < 0.15, "DISAGREE_SHOW_BOTH").otherwise("DISAGREE_ASK_USER_RECOMMENDED")
    )
    winner = F.when(resolution == "ERROR", F.lit(None)).when(F.col("cloud_action").isNull() | (F.col("local_action").isNotNull() & (mine >= theirs)), "local").otherwise("cloud")
    return pairs.select("id", resolution.alias("resolution"), winner.alias("winner"))


def route(tiers: list[tuple[str, Column, Column]], floor: float = 0.5) -> Column:
    """struct<layer, confidence>: the first tier with a decision at `floor` or surer, else ASK_USER. tiers: (name, decision, confidence)."""
    found = [F.when(d.isNotNull() & (c >= floor), F.struct(F.lit(n).alias("layer"), c.cast("double").alias("confidence"))) for n, d, c in tiers]
    return F.coalesce(*found, F.struct(F.lit("ASK_USER").alias("layer"), F.lit(None).cast("double").alias("confidence")))
