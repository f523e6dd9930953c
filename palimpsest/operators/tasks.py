"""Tasks and pages in words: intent, constraints, navigation targets, confirmations, page types, relevance, budgets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.patterns import java
from .fields import has

# What intents, constraints and confirmations are recognised by.
INTENTS = [
    ("gather", r"(find|search|look for|compare|check price|show me|cheapest|lowest|what is|who is|how much|look up)"),
    ("form", r"(complete|fill).*(form|application|kyc|profile|registration)|sign up|register|checkout|\bapply\b"),
    ("navigate", r"(go to|navigate|open|click|toggle|switch)"),
]
CONSTRAINTS = [
    ("Price: ", "(under|below|less than|max(?:imum)?|cheaper than)\\s*([₹$€£]?\\s*\\d+(?:,\\d+)?)"),
    ("Date/Timing: ", r"\b(today|tomorrow|yesterday|next week|this weekend|monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b"),
    ("Preference: ", r"\b(cheapest|lowest price|fastest|highest rated|best rated|nearest|shortest)\b"),
]
ROUTE = r"from\s+([a-zA-Z\s]+?)\s+to\s+([a-zA-Z\s]+?)(?:\s+(?:on|tomorrow|today|under|below)|$)"
CONFIRMATIONS = [
    r"\bthank you\b", r"\bsuccess(?:fully)?\b", r"\border\s+(?:placed|confirmed|received)\b", r"\bapplication\s+(?:received|submitted)\b", r"\bsubmitted\s+successfully\b",
    r"\bregistration\s+(?:complete|successful)\b", r"\bpayment\s+(?:successful|received|confirmed)\b", r"\bbooking\s+confirmed\b", r"\bconfirmation\s+(?:number|code|email)\b",
    r"\byou'?re\s+all\s+set\b", r"\ball\s+done\b", r"\bwe'?ve\s+received\b", r"\bwelcome\s+aboard\b", r"\bcongratulations\b",
]
# Subgoals of the four kinds of tasks.
SUBGOALS = {
    "gather": ["Locate Search", "Enter Query & Criteria", "Execute Search", "Evaluate Results", "Verify & Present"],
    "form": ["Inspect Form", "Populate Information", "Review Entries", "Authorize Submission"],
    "navigate": ["Navigate / Locate", "Interact", "Verify Progress"],
    "general": ["Understand Page", "Perform Actions", "Verify Goal"],
}


def intent(task: Column) -> Column:
    return F.coalesce(*(F.when(has(task, p), n) for n, p in INTENTS), F.lit("general"))


def subgoals(task: Column) -> Column:
    """array<struct<id, title, status>>; the first is in progress."""
    kind = intent(task)
    rows = {k: F.array(*(F.struct(F.lit(f"sg_{i}").alias("id"), F.lit(t).alias("title"), F.lit("PENDING" if i > 1 else "IN_PROGRESS").alias("status")) for i, t in enumerate(v, 1))) for k, v in SUBGOALS.items()}
    out = rows["general"]
    for k in ("navigate", "form", "gather"):
        out = F.when(kind == k, rows[k]).otherwise(out)
    return out


def constraints(task: Column) -> Column:
    task = F.coalesce(task, F.lit(""))
    found = []
    for label, p in CONSTRAINTS:
        hit = F.regexp_extract(task, "(?i)" + java(p), 0)
        found.append(F.when(hit != "", F.concat(F.lit(label), hit)))
    a, b = (F.trim(F.regexp_extract(task, "(?i)" + ROUTE, i)) for i in (1, 2))
    found.append(F.when(a != "", F.concat(F.lit("Route: from "), a, F.lit(" to "), b)))
    return F.array_compact(F.array(*found))


def confirms(text: Column) -> Column:
    """Whether a line says that something was done. Redacted lines say nothing."""
    said = F.lit(False)
    for p in CONFIRMATIONS:
        said = said | has(text, p)
    return said & ~F.coalesce(text.startswith("[REDACTED"), F.lit(False))


def navigation_url(task: Column) -> Column:
    """A URL or domain that the task names, or null."""
    url = F.regexp_extract(task, "(?i)https?://[^\\s\"'<>]+", 0)
    domain = F.regexp_extract(task, "(?i)" + java("\\b(?:www\\.)?([a-zA-Z0-9-]+\\.(?:com|org|net|in|io|dev|edu|gov|co|ai|app|tech)(?:/[^\\s\"'<>]*)?)"), 0)
    return F.when(url != "", url).when(domain != "", F.concat(F.lit("https://"), domain))


# Fixed values: (name, what names it, address) of known sites, in order.
SITES = [
    ("leetcode", r"\bleetcode\b", "https://leetcode.com"),
    ("google", r"\bgoogle\b", "https://www.google.com"),
    ("amazon", r"\bamazon\b", "https://www.amazon.com"),
    ("github", r"\bgithub\b", "https://github.com"),
    ("wikipedia", r"\bwikipedia\b", "https://www.wikipedia.org"),
    ("youtube", r"\byoutube\b", "https://www.youtube.com"),
    ("reddit", r"\breddit\b", "https://www.reddit.com"),
    ("twitter", r"\btwitter\b|\bx\.com\b", "https://x.com"),
    ("hackernews", r"\bhacker\s*news\b", "https://news.ycombinator.com"),
    ("stackoverflow", r"\bstack\s*overflow\b", "https://stackoverflow.com"),
    ("coursera", r"\bcoursera\b", "https://www.coursera.org"),
    ("nptel", r"\bnptel\b", "https://nptel.ac.in"),
    ("zerodha", r"\bzerodha\b", "https://zerodha.com"),
    ("linkedin", r"\blinkedin\b", "https://www.linkedin.com"),
    ("mdn", r"\bmdn\b|\bmozilla\s*docs\b", "https://developer.mozilla.org"),
]
# Searches on two of them, and what asks for a page to be opened.
SEARCHES = [(r"(?:search|look)\s+(?:for\s+)?(.+?)\s+on\s+google", "https://www.google.com/search?q="), (r"(?:search|look|find)\s+(?:for\s+)?(.+?)\s+on\s+amazon", "https://www.amazon.com/s?k=")]
GOING = r"(open|go to|navigate to|visit|launch|check|access|load)"


def encoded(text: Column) -> Column:
    """Text as a part of a URL: all but letters, digits and - _ . ! ~ * ' ( ) escaped."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def destination(task: Column) -> Column:
    """Where a task goes first: a URL or domain it names, a search on a known site, a known site it opens, begins with or works on; null without one."""
    task = F.trim(task)
    found = [navigation_url(task)]
    for pattern, base in SEARCHES:
        words = F.regexp_extract(task, "(?i)" + java(pattern), 1)
        found.append(F.when(words != "", F.concat(F.lit(base), encoded(F.trim(words)))))
    low = F.lower(task)
    for name, pattern, url in SITES:
        found.append(F.when(has(task, pattern) & (has(task, GOING) | low.startswith(name) | low.contains(f"on {name}")), url))
    return F.coalesce(*found)


def tokens_needed(text: Column, images: Column | None = None) -> Column:
    """Estimated prompt tokens: a token for each 3.6 characters, 1600 for an image."""
    n = F.ceil(F.length(F.coalesce(text, F.lit(""))) / 3.6)
    return n if images is None else n + images * 1600


def relevance(label: Column, task: Column) -> Column:
    """Twenty for each word of the task, three letters and more, that the label holds."""
    words = F.filter(F.split(F.lower(task), r"[^a-z0-9]+"), lambda w: F.length(w) > 2)
    return F.size(F.filter(F.array_distinct(words), lambda w: F.lower(label).contains(w))) * 20

