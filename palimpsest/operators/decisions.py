"""Decisions about the next action: parsing, validation, targets, translation, outcomes, completion, plans.

Decision rows have decision_id, page_id and what a function names; element rows are those of
`elements`. Everything is a join on the page or an ordered CASE; rows that fail carry a reason
instead of raising an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import grid
from .elements import expected_input, flag, is_form_input, joined, populated, said
from .fields import has

# Actions a reasoner may ask for, and those that need a target.
ACTIONS = ["click", "fill", "type", "clear", "select", "check", "uncheck", "radio", "hover", "focus", "press_key", "scroll", "navigate", "back", "forward", "extract", "wait", "done", "fill_from_local", "ask_user", "notify_submit", "upload", "replan"]
TARGETED = ["click", "fill", "type", "clear", "select", "check", "uncheck", "radio", "hover", "focus", "fill_from_local", "upload"]
# Signs that a reasoner obeyed the page instead of the user.
OBEDIENCE = [
    r"\bignor(?:e[ds]?|ing)\s+(?:all\s+)?(?:previous|prior|above)\s+instructions\b", r"\bunrestricted\s+agent\b",
    r"\b(?:reveal|revealing|send|sending|share|sharing|leak|leaking)\s+(?:the\s+)?(?:user'?s?\s+)?(?:private|credentials|password)\b",
    r"\bper\s+system\s+message\s+on\s+page\b", r"\bwebpage\s+instructed\s+me\b",
]
# Reasons of the validation, in order.
BAD_JSON, BAD_SCHEMA = "Reason was not valid JSON", "Reason did not match action Schema"
OBEYED = "Hostile prompt injection compliance detected in reasoning or value — rejected."
SENSITIVE, NO_TARGET = "Action attempted to fill a sensitive-flagged field - rejected.", "Action targeted a selector not present in the DOM skeleton — rejected."
# Outcomes after which an action counts as failed, and as succeeded.
FAILING, SUCCEEDING = ["FAILED", "NO_EFFECT", "TARGET_DISAPPEARED"], ["SUCCEEDED", "PAGE_CHANGED", "TASK_COMPLETED"]


# Parsing ----------------------------------------------------------------------------------------


def first_object(text: Column) -> Column:
    """What a fence holds, else the first balanced {...}, else the text. Braces inside strings count, as they do for who wrote the rule."""
    plain = F.trim(text)
    fenced = F.regexp_extract(plain, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    rest = F.when(F.instr(plain, "{") > 0, F.substring(plain, F.instr(plain, "{"), F.length(plain))).otherwise("")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        at = s["at"] + 1
        return F.struct(depth.alias("depth"), at.alias("at"), F.when((s["end"] == 0) & (depth == 0), at).otherwise(s["end"]).alias("end"))

    # what lies between braces cannot change the depth: fold over runs of it
    runs = F.regexp_extract_all(rest, F.lit(r"(?s)[{}]|[^{}]++"), F.lit(0))
    end = F.aggregate(runs, start, step)["end"]
    return F.when(fenced != "", fenced).when(end > 0, F.array_join(F.slice(runs, 1, end), "")).otherwise(plain)


def repaired(json: Column) -> Column:
    """JSON with raw line ends and tabs inside strings written as escapes."""
    parts = F.regexp_extract_all(json, F.lit(r'(?s)"(?:[^"\\]++|\\.)*+"?|(?:[^"\\]++|\\.)++|\\'), F.lit(0))
    escaped = lambda x: F.replace(F.replace(F.replace(x, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    return F.array_join(F.transform(parts, lambda x: F.when(x.startswith('"'), escaped(x)).otherwise(x)), "")


def parsed(raw: Column) -> Column:
    """struct<valid, typed, action, target, value, reasoning> of a reasoner's answer."""
    v = F.try_parse_json(repaired(first_object(F.coalesce(raw, F.lit("")))))
    part = lambda n: F.try_variant_get(v, f"$.{n}", "string")
    kind = lambda n: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{n}", "variant")), F.lit("VOID"))
    typed = part("action").isin(ACTIONS) & (kind("reasoning") == "STRING") & kind("targetSelector").isin("STRING", "VOID") & kind("value").isin("STRING", "VOID") & (kind("action") == "STRING")
    return F.struct(v.isNotNull().alias("valid"), F.coalesce(typed, F.lit(False)).alias("typed"), part("action").alias("action"), part("targetSelector").alias("target"), part("value").alias("value"), part("reasoning").alias("reasoning"))


def obeys_page(reasoning: Column, value: Column) -> Column:
    words = F.concat_ws(" ", said(reasoning), said(value))
    hit = F.lit(False)
    for p in OBEDIENCE:
        hit = hit | has(words, p)
    return hit


# Targets ----------------------------------------------------------------------------------------


def element_keys(elements: DataFrame, *columns: str) -> DataFrame:
    """(page_id, key, ord, columns): every way to name an element exactly, by selector, #id or id; the first element of a name counts."""
    keys = F.array_distinct(F.array_compact(F.array(F.nullif(F.trim("selector"), F.lit("")), F.concat(F.lit("#"), F.col("id").cast("string")), F.col("id").cast("string"))))
    rows = elements.select("page_id", F.explode(keys).alias("key"), F.struct("ord", *columns).alias("e"))
    return rows.groupBy("page_id", "key").agg(F.min_by("e", "e.ord").alias("e")).select("page_id", "key", *(f"e.{c}" for c in columns))


def validated(decisions: DataFrame, elements: DataFrame) -> DataFrame:
    """decisions (decision_id, page_id, raw) -> adds ok, reason and the parsed action, target, value and reasoning.

    In this order: JSON, schema, obedience to the page, filling of a sensitive field, a target
    that the page doesn't have.
    """
    rows = decisions.withColumn("p", parsed(F.col("raw"))).withColumn("key", F.nullif(F.trim("p.target"), F.lit("")))
    known = element_keys(elements.withColumn("risky", flag(F.col("sensitive")).cast("int")), "id", "risky")
    rows = rows.join(known.select("page_id", "key", "id", "risky"), ["page_id", "key"], "left")
    fills = F.col("p.action").isin("fill", "type") & F.col("p.value").isNotNull() & (F.coalesce("risky", F.lit(0)) == 1)
    missing = F.when(F.coalesce(F.col("p.target"), F.lit("")) == "", F.col("p.action").isin(TARGETED)).otherwise(F.col("id").isNull())
    reason = F.when(~F.col("p.valid"), BAD_JSON).when(~F.col("p.typed"), BAD_SCHEMA).when(obeys_page(F.col("p.reasoning"), F.col("p.value")), OBEYED).when(fills, SENSITIVE).when(missing, NO_TARGET)
    return rows.withColumn("reason", reason).select(*decisions.columns, F.col("reason").isNull().alias("ok"), "reason", "p.action", "p.target", "p.value", "p.reasoning", F.col("id").alias("element_id"))


def resolved(decisions: DataFrame, elements: DataFrame) -> DataFrame:
    """Adds element_id and tier: what `target` names, by selector (1), #id (2), id (3), a selector that holds #id (4), one that ends in it or the other way round, in any case (5).

    Names that match exactly are looked up. The others are looked up too: by what stands at each
    # of a selector, and by the endings of selectors and names, in the lengths that their page
    has. Of what shares such a key only the best element counts.
    """
    c = F.col
    target = F.trim("target")
    rows = decisions.withColumn("t", F.nullif(target, F.lit("")))
    own = elements.select("page_id", c("id").cast("string").alias("e_id"), F.nullif(F.trim("selector"), F.lit("")).alias("s"), "ord")
    keys = own.select("page_id", "ord", "e_id", F.explode(F.array(F.struct(c("s").alias("t"), F.lit(1).alias("tier")), F.struct(F.concat(F.lit("#"), "e_id").alias("t"), F.lit(2).alias("tier")), F.struct(c("e_id").alias("t"), F.lit(3).alias("tier")))).alias("k"))
    exact = keys.filter("k.t is not null").groupBy("page_id", c("k.t").alias("t")).agg(F.min(F.struct("k.tier", "ord", "e_id")).alias("m"))
    rows = rows.join(exact, ["page_id", "t"], "left")
    others = rows.filter("m is null and t is not null").select("page_id", "t").distinct().withColumn("low", F.lower("t"))
    named = own.filter("s is not null").withColumn("sel", F.lower("s"))
    best = lambda tier: F.min(F.struct(F.lit(tier).alias("tier"), "ord", "e_id")).alias("n")
    ids = others.filter(c("t").startswith("#"))
    holding = ids.join(grid.beginnings(named, "s", "#", ids, "t", "page_id").groupBy("page_id", c("begin").alias("t")).agg(best(4)), ["page_id", "t"])
    ending = others.join(grid.endings(named, "sel", others, "low", "page_id").groupBy("page_id", c("end").alias("low")).agg(best(5)), ["page_id", "low"])
    whole = named.groupBy("page_id", c("sel").alias("end")).agg(best(5))
    ended = grid.endings(others, "low", named, "sel", "page_id").join(whole, ["page_id", "end"])
    found = [x.select("page_id", "t", "n") for x in (holding, ending, ended)]
    near = found[0].unionByName(found[1]).unionByName(found[2]).groupBy("page_id", "t").agg(F.min("n").alias("n"))
    out = rows.join(near, ["page_id", "t"], "left").withColumn("m", F.coalesce("m", "n"))
    return out.select(*decisions.columns, c("m.e_id").alias("element_id"), c("m.tier").alias("tier"))


def stale_targets(history: DataFrame, elements: DataFrame) -> DataFrame:
    """Targets of a page's history that no element of it has as selector any more: (page_id, target)."""
    live = elements.filter(said(F.col("selector")) != "").select("page_id", F.col("selector").alias("target"))
    return history.filter(F.col("target").isNotNull()).select("page_id", "target").distinct().join(live, ["page_id", "target"], "left_anti")


def filled_by_user(elements: DataFrame, history: DataFrame) -> DataFrame:
    """Filled form fields that no fill of the page's history accounts for, by id, by selector, or by a target its selector ends in."""
    filled = elements.filter(is_form_input(F.col("tag"), F.col("type")) & populated(F.col("value"), F.col("has_value")))
    fills = history.filter(F.col("action").isin("fill", "fill_from_local")).select("page_id", F.col("element_id").cast("string").alias("h_id"), F.col("target").alias("h_target")).distinct()
    by_id = filled.join(fills.select("page_id", F.col("h_id").alias("id")).dropna().distinct(), ["page_id", "id"], "left_anti")
    targets = fills.filter("h_target <> ''").select("page_id", F.col("h_target").alias("end")).distinct()
    accounted = grid.endings(by_id.select("page_id", "selector").distinct(), "selector", targets, "end", "page_id").join(targets, ["page_id", "end"], "left_semi").select("page_id", "selector").distinct()
    return by_id.join(accounted, ["page_id", "selector"], "left_anti").withColumn("field_name", F.coalesce(F.nullif("text", F.lit("")), F.nullif("aria_label", F.lit("")), F.nullif("placeholder", F.lit("")), F.concat(F.lit("field_"), F.col("id"))))


# Translation --------------------------------------------------------------------------------------


def ask_user(label_columns: tuple[Column, Column, Column], selector: Column, type_: Column) -> Column:
    """struct<key, label, expected, kind> of a field to ask the user for."""
    text, aria, placeholder = label_columns
    none = lambda x: F.nullif(x, F.lit(""))
    label = F.coalesce(none(placeholder), none(aria), none(text), none(selector), F.lit("Required Field"))
    help_ = expected_input(label, said(selector), said(type_))
    secret = joined(type_, selector, placeholder, aria).contains("password")
    return F.struct(F.coalesce(none(selector), F.lit("field_0")).alias("key"), F.coalesce(none(text), none(aria), help_["field_name"]).alias("label"), help_["expected"].alias("expected"), F.when(secret, "password").otherwise("text").alias("kind"))


def translated(decisions: DataFrame, elements: DataFrame, submits: Column, mode: str = "hitl") -> DataFrame:
    """What is to be done about each decision: adds element_id, does, does_value.

    submits says whether an element (columns e_text, e_aria_label, e_type, e_selector, target)
    has consequences. A click on one becomes notify_submit, filling a filled field skip_filled,
    a sensitive field ask_user; local fills ask the user unless mode is complete.
    """
    found = resolved(decisions, elements)
    own = elements.select("page_id", F.col("id").cast("string").alias("element_id"), "ord", *(F.col(c).alias(f"e_{c}") for c in ("text", "aria_label", "type", "selector", "value", "has_value", "sensitive")))
    own = own.groupBy("page_id", "element_id").agg(F.min_by(F.struct(*[c for c in own.columns if c.startswith("e_")]), "ord").alias("e")).select("page_id", "element_id", "e.*")
    rows = found.join(own, ["page_id", "element_id"], "left")
    a, value = F.col("action"), F.nullif("value", F.lit(""))
    filled = populated(F.col("e_value"), F.col("e_has_value"))
    nowhere = F.col("element_id").isNull() & F.col("target").isNull()
    fill = F.when(filled, "skip_filled").when(flag(F.col("e_sensitive")), "ask_user").otherwise("fill")
    local = F.when(filled, "skip_filled").when(F.lit(mode == "complete"), "fill_from_local").otherwise("ask_user")
    does = (
        F.when(a == "click", F.when(submits, "notify_submit").when(nowhere, "wait").otherwise("click")).when(a.isin("fill", "type"), fill).when(a == "fill_from_local", local)
        .when((a == "select") & (F.col("e_value") == F.col("value")), "wait").when(a.isin("check", "uncheck"), "check").when(a == "radio", "click").when(a.isin("upload", "file"), "ask_user").when(a == "failed", "replan")
        .when(a.isin("clear", "select", "hover", "focus", "press_key", "navigate", "back", "forward", "extract", "scroll", "wait", "done", "ask_user", "notify_submit", "replan"), a).otherwise("wait")
    )
    said_ = F.col("reasoning") if "reasoning" in decisions.columns else F.lit(None).cast("string")
    does_value = (
        F.when(a == "check", "true").when(a == "uncheck", "false").when(a == "press_key", F.coalesce(value, F.lit("Enter"))).when(a == "scroll", F.coalesce(value, F.lit("down"))).when(a.isin("navigate", "select"), F.coalesce(value, F.lit("")))
        .when(a == "extract", F.coalesce(value, F.nullif(said_, F.lit("")), F.lit(""))).when(a.isin("replan", "failed"), F.coalesce(value, F.nullif(said_, F.lit("")))).when(a.isin("fill", "type"), F.col("value")).when(a == "fill_from_local", value)
    )
    kept = does.isin("fill", "fill_from_local", "check", "press_key", "scroll", "navigate", "select", "extract", "replan")
    untargeted = a.isin("navigate", "back", "forward", "wait", "done")
    return rows.select(*decisions.columns, F.when(~untargeted & (does != "wait"), F.col("element_id")).alias("element_id"), does.alias("does"), F.when(kept, does_value).alias("does_value"))


def local_decision(elements: DataFrame, key: Column) -> DataFrame:
    """(page_id, action, element_id): fill or ask for the first empty field of each page that has one; wait on the others."""
    open_ = is_form_input(F.col("tag"), F.col("type")) & ~populated(F.col("value"), F.col("has_value"))
    rows = elements.withColumn("k", key).groupBy("page_id").agg(F.min_by(F.when(open_, F.struct("id", "k")), F.when(open_, F.col("ord"))).alias("f"))
    return rows.select("page_id", F.when(F.col("f").isNull(), "wait").when(F.col("f.k").isNotNull(), "fill_from_local").otherwise("ask_user").alias("action"), F.col("f.id").alias("element_id"))


def described(action: Column, label: Column, value: Column) -> Column:
    """An action in words for the user."""
    quoted = F.concat(F.lit('"'), F.coalesce(F.nullif(label, F.lit("")), F.lit("element")), F.lit('"'))
    say = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts), F.lit("…"))
    v = said(value)
    return (
        F.when(action == "click", say("Clicking ", quoted)).when(action.isin("type", "fill"), say("Typing into ", quoted)).when(action == "fill_from_local", say("Filling ", quoted, " from local private store"))
        .when(action == "clear", say("Clearing input ", quoted)).when(action == "select", say('Selecting option "', v, '" in dropdown ', quoted)).when(action == "check", say(F.when(v == "false", "Unchecking ").otherwise("Checking "), quoted))
        .when(action == "hover", say("Hovering over ", quoted)).when(action == "focus", say("Focusing ", quoted)).when(action == "press_key", say('Pressing key "', F.coalesce(F.nullif(v, F.lit("")), F.lit("Enter")), '" on ', quoted))
        .when(action == "scroll", say("Scrolling ", F.coalesce(F.nullif(v, F.lit("")), F.lit("down")))).when(action == "navigate", say("Navigating to ", v)).when(action == "back", say("Navigating back in history")).when(action == "forward", say("Navigating forward in history"))
        .when(action == "extract", say("Extracting content from page")).when(action == "wait", say("Waiting for the page to settle")).otherwise(say("Performing ", said(action)))
    )


def action_arguments(action: Column, element_id: Column, target: Column, value: Column) -> Column:
    """array<string> of what an action is called with; missing ones are null."""
    v, text = said(value), lambda x: x.cast("string")
    e, t = text(element_id), text(target)
    array = lambda *xs: F.array(*xs).cast("array<string>")
    return (
        F.when(action.isin("click", "clear", "hover", "focus", "extract"), array(e, t)).when(action.isin("type", "fill", "select"), array(e, v, t)).when(action == "check", array(e, F.when(v == "false", "false").otherwise("true"), t))
        .when(action == "press_key", array(e, F.coalesce(F.nullif(v, F.lit("")), F.lit("Enter")), t)).when(action == "scroll", array(F.when(v == "up", "up").otherwise("down"), F.lit("400"), t)).when(action == "navigate", array(v))
        .when(action.isin("back", "forward"), array()).otherwise(array(e, value))
    )


def annotated(decisions: DataFrame, elements: DataFrame, action: Column) -> DataFrame:
    """Adds consequence (struct<type, risk, reversible> or null) of each decision's element; action is worked out on the elements."""
    found = elements.withColumn("consequence", action).groupBy("page_id", F.col("id").cast("string").alias("element_id")).agg(F.min_by("consequence", "ord").alias("consequence"))
    return decisions.join(found, ["page_id", "element_id"], "left")


def completion_gate(elements: DataFrame, action_type: Column) -> DataFrame:
    """(page_id, next, element_id): notify_submit for the first visible element with consequences on a page, done where there is none."""
    kind = F.when(flag(F.col("visible"), True), action_type)
    rows = elements.withColumn("kind", kind).groupBy("page_id").agg(F.min_by(F.when(F.col("kind").isNotNull(), F.col("id")), F.when(F.col("kind").isNotNull(), F.col("ord"))).alias("element_id"))
    return rows.select("page_id", F.when(F.col("element_id").isNull(), "done").otherwise("notify_submit").alias("next"), "element_id")


def fast_path(elements: DataFrame, key: Column, store: DataFrame) -> DataFrame:
    """(page_id, ord, id, key, found_key): empty form fields that a store (owner = page_id, key, value) can fill, by the keys' other names."""
    from .stores import looked_up

    open_ = elements.filter(is_form_input(F.col("tag"), F.col("type")) & ~populated(F.col("value"), F.col("has_value"))).withColumn("key", key).filter("key is not null")
    asked = open_.select(F.concat_ws("/", F.col("page_id").cast("string"), F.col("ord").cast("string")).alias("ask_id"), F.col("page_id").alias("owner"), "page_id", "ord", "id", "key")
    return looked_up(asked, store).filter("found_key is not null").select("page_id", "ord", "id", "key", "found_key")


# Outcomes -----------------------------------------------------------------------------------------


def outcome(action: Column, ok: Column, reason: Column, url_changed: Column, verified: Column, has_value: Column, did_scroll: Column) -> Column:
    """struct<outcome, replan, verified> of an action that was carried out. Null flags count as not seen; an action of null failed."""
    row = lambda name, replan=False, sure=True: F.struct(F.lit(name).alias("outcome"), F.lit(replan).alias("replan"), F.lit(sure).alias("verified"))
    done, lost = row("SUCCEEDED"), row("NO_EFFECT", True, False)
    checked = flag(verified)
    return (
        F.when(action.isNull(), row("FAILED", True, False)).when(action == "done", row("TASK_COMPLETED")).when(action.isin("ask_user", "notify_submit"), row("USER_INTERVENTION_REQUIRED")).when(action.isin("skip_filled", "wait"), done)
        .when(~flag(ok), F.when(reason == "element_not_found", row("TARGET_DISAPPEARED", True, False)).otherwise(row("FAILED", True, False))).when(flag(url_changed), row("PAGE_CHANGED"))
        .when(action.isin("type", "fill", "fill_from_local"), F.when(flag(has_value) | checked, done).otherwise(lost)).when(action.isin("select", "clear", "check", "focus"), F.when(checked, done).otherwise(lost))
        .when(action.isin("navigate", "back", "forward"), row("PAGE_CHANGED")).when((action == "scroll") & (did_scroll == F.lit(False)), lost).otherwise(done)
    )


def productive(action: Column, success: Column, result: Column) -> Column:
    """Whether an entry of a history did something: neither waiting nor replanning, with a result that didn't fail."""
    return ~F.coalesce(action.isin("wait", "replan"), F.lit(False)) & F.coalesce(success, F.lit(True)) & ~F.coalesce(result.isin(FAILING), F.lit(False)) & (success.isNotNull() | result.isNotNull())


def completion(intent: Column, did: Column, form_detected: Column, total: Column, empty: Column, gathered: Column, verdict: Column, confirmed: Column) -> Column:
    """struct<verified, confidence, passed> of a declared completion: productive_action, structural and, unless information is gathered, visual_change must hold; confirmation_text is advice."""
    structural = F.when(intent == "form", flag(form_detected) & (F.coalesce(total, F.lit(0)) > 0) & (F.coalesce(empty, F.lit(1)) == 0)).when(intent == "gather", F.coalesce(gathered, F.lit(0)) > 0).otherwise(True)
    visual = (intent == "gather") | verdict.isNull() | (verdict != "no_change")
    names = [(flag(did), "productive_action"), (structural, "structural"), (visual, "visual_change")]
    gates = [flag(did), structural, F.when(intent != "gather", visual).otherwise(True)]
    n = F.when(intent == "gather", 2).otherwise(3)
    counted = gates[0].cast("int") + gates[1].cast("int") + F.when(intent == "gather", 0).otherwise(visual.cast("int"))
    passed = F.array_compact(F.array(*(F.when(c, name) for c, name in names), F.when(flag(confirmed), "confirmation_text")))
    return F.struct((gates[0] & gates[1] & gates[2]).alias("verified"), (counted / n).alias("confidence"), passed.alias("passed"))


def suggestion(url_changed: Column, user_input: Column, newly_filled: Column, mode: Column, step: Column, total: Column, done: Column, empty: Column, matchable: Column, needs_user: Column) -> Column:
    """What to tell the user about a form, or null; the first of its rules that holds."""
    form = total > 0
    first = form & (step == 0)
    auto = first & (mode == "complete") & (matchable > 0)
    return (
        F.when(flag(url_changed), "NAVIGATION_PROGRESS").when(flag(user_input) | (step > 0) & flag(newly_filled) & (mode == "complete"), "USER_ATTENTION").when(form & (empty == 0), "COMPLETION")
        .when(auto, "AUTOMATION_AVAILABLE").when(first & (empty > 0), "FORM_PROGRESS").when(form & (empty > 0) & (step > 0) & flag(newly_filled), "FORM_PROGRESS")
    )


def highlights(history: DataFrame, elements: DataFrame, items: DataFrame) -> DataFrame:
    """(page_id, kind, label, x, y, width, height): safe for the first success on each element, danger for each item still to be seen."""
    good = F.coalesce(F.col("success"), F.lit(False)) & ~F.coalesce(F.col("outcome").isin(FAILING), F.lit(False))
    first = history.filter(good & F.col("element_id").isNotNull()).groupBy("page_id", F.col("element_id").cast("string").alias("id")).agg(F.min_by("action", "seq").alias("action"))
    box = ["x", "y", "width", "height"]
    own = elements.filter(F.col("x").isNotNull()).groupBy("page_id", F.col("id").cast("string").alias("id")).agg(F.min_by(F.struct(*box), "ord").alias("b")).select("page_id", "id", "b.*")
    safe = first.join(own, ["page_id", "id"]).select("page_id", F.lit("safe").alias("kind"), F.concat("action", F.lit(": succeeded")).alias("label"), *box)
    label = F.coalesce(F.concat(F.lit("PII still visible: "), F.nullif("type", F.lit(""))), F.lit("Sensitive item still visible"))
    return safe.unionByName(items.filter(F.col("x").isNotNull()).select("page_id", F.lit("danger").alias("kind"), label.alias("label"), *box))


def authorization(targets: DataFrame, items: DataFrame) -> DataFrame:
    """Highlights before an action with consequences: the target (ambiguous if it can be undone, else danger) and each item on its page."""
    box = ["x", "y", "width", "height"]
    can = flag(F.col("reversible"))
    name = F.concat(F.coalesce("type", F.lit("Consequential")), F.when(can, " (reversible)").otherwise(" (irreversible)"))
    at = targets.filter(F.col("x").isNotNull()).select("page_id", F.when(can, "ambiguous").otherwise("danger").alias("kind"), name.alias("label"), *box)
    label = F.coalesce(F.concat(F.lit("PII: "), F.nullif("type", F.lit(""))), F.lit("Sensitive item"))
    shown = items.join(targets.select("page_id").distinct(), "page_id", "left_semi").filter(F.col("x").isNotNull())
    return at.unionByName(shown.select("page_id", F.lit("danger").alias("kind"), label.alias("label"), *box))


# Plans ----------------------------------------------------------------------------------------------


def plan_states(events: DataFrame, session: str, order: list[str], size: Column) -> DataFrame:
    """Adds the state of the plan after each event: at (subgoals done), status (of the subgoal in hand), complete.

    events has event: advance, done, replan and others; size is how many subgoals the plan has.
    An advance beyond the last subgoal changes nothing; done completes all.
    """
    w = Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    steps = F.sum((F.col("event") == "advance").cast("int")).over(w)
    over = F.max((F.col("event") == "done").cast("int")).over(w) == 1
    replans = F.sum((F.col("event") == "replan").cast("int")).over(w)
    at = F.least(steps, size)
    return events.withColumn("at", at).withColumn("complete", over | (at >= size)).withColumn("status", F.when(over | (at >= size), "COMPLETED").otherwise("IN_PROGRESS")).withColumn("replans", replans)
