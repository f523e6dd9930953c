"""Elements of pages: types, labels, predicates, projections for sending, forms, relevance, regions.

An element row has page_id, ord (place on the page), id, tag, type, selector, text, aria_label,
placeholder, value, has_value, enabled, visible, is_search, is_pagination, in_modal, in_nav,
is_sticky, form_id, sensitive, and a box x, y, width, height. Functions take the columns they
need; null texts count as empty, null flags as not set (enabled and visible: as set).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import grid
from .fields import has

# Words that say nothing about a task.
TASK_NOISE = ["the", "a", "an", "of", "for", "in", "to", "and", "or", "is", "it", "this", "that", "with", "from", "on", "at", "by", "my", "me", "i", "please", "can", "you", "do", "using", "use", "complete", "fill"]
# Marks that stand for a value.
MARKS = ["[REDACTED]", "[FILLED_FROM_LOCAL]", "[ALREADY_POPULATED]"]
# Points of a semantic role in the relevance for a task.
ROLE_POINTS = {"form_field": 15, "submit_button": 15, "search_input": 15, "dropdown": 12, "checkbox": 10, "radio_button": 10, "pagination_control": 10, "tab_control": 8, "action_button": 8}
# E-mail addresses and numbers like telephone numbers in labels.
LABEL_EMAIL, LABEL_NUMBER = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", r"\+?\d[\d\s\-()]{8,}\d"
# What identity documents and uploads are recognised by.
ID_WORDS = r"(aadhaar|aadhar|uidai|\bpan\s*card\b|\bpan\s*number\b|passport|driving\s*licen[cs]e|\bdl\s*number\b|voter\s*id|voter\s*card|identity\s*proof|\bid\s*proof\b|\bkyc\b|identity\s*card|government[-\s]?id|national\s*id|proof\s*of\s*identity|proof\s*of\s*address)"
UPLOAD_WORDS = r"(upload|uploaded|scan|scanned|attach|attachment|choose\s*file|browse|preview|selected\s*file)"
# Sizes of icons, and types that may be one.
ICON_LEAST, ICON_MOST, ICON_NARROW, ICON_WIDE = 16, 64, 0.6, 1.67
ICON_TYPES = ["button", "link", "role:button", "role:tab", "role:menuitem"]
# Fixed values: (words, name, what is expected), in order of precedence.
EXPECTED = [
    (["pan"], "PAN Card Number", "10-character alphanumeric PAN identifier (e.g., ABCDE1234F)"),
    (["aadhaar", "aadhar"], "Aadhaar Card Number", "12-digit Aadhaar identification number"),
    (["email"], "Email Address", "Valid email address (e.g., user@example.com)"),
    (["phone", "mobile", "tel"], "Mobile / Phone Number", "10-digit primary phone number"),
    (["pass"], "Password", "Your account password"),
    (["dob", "birth", "date"], "Date of Birth", "Date in DD/MM/YYYY format"),
    (["name"], "Full Name", "Full legal name as specified on official documents"),
]
# Submit words where no classifier is at hand.
SUBMIT_WORDS = ["submit", "confirm", "place order", "finish", "checkout", "pay now", "pay", "purchase", "buy now", "book now", "make payment", "proceed", "continue", "next step", "register", "apply now", "send message", "send enquiry", "delete", "remove", "publish"]


def said(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def flag(x: Column, otherwise: bool = False) -> Column:
    return F.coalesce(x, F.lit(otherwise))


def collapsed(text: Column, most: int = 300) -> Column:
    """White space collapsed and trimmed, then cut."""
    return F.substring(F.trim(F.regexp_replace(said(text), r"\s+", " ")), 1, most)


def joined(*texts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *map(said, texts)))


# Scalars ---------------------------------------------------------------------------------------


def readable(url: Column) -> Column:
    """Whether a page of this address may be read: http, https and file only."""
    return F.coalesce(url.rlike("^(https?|file):"), F.lit(False))


def element_type(tag: Column, kind: Column, role: Column) -> Column:
    """input:<type>, link, button, select, textarea, role:<role>, or the tag."""
    tag = F.lower(tag)
    named = F.when(role != "", F.concat(F.lit("role:"), role))
    return F.when(tag == "input", F.concat(F.lit("input:"), F.lower(F.coalesce(F.nullif(kind, F.lit("")), F.lit("text"))))).when(tag == "a", "link").when(tag.isin("button", "select", "textarea"), tag).otherwise(F.coalesce(named, tag))


def safe_value(type_: Column, value: Column, checked: Column) -> Column:
    """What may be kept of a value: nothing of passwords, whether boxes are checked, no placeholder options."""
    held = F.nullif(value, F.lit(""))
    box = F.when(flag(checked), "checked").otherwise("unchecked")
    return F.when(type_ == "input:password", None).when(type_.isin("input:checkbox", "input:radio"), box).when(type_.startswith("input:") | type_.isin("select", "textarea"), held)


def accessible_label(type_: Column, aria: Column, labels: Column, labelled_by: Column, title: Column, text: Column, value: Column) -> Column:
    """A field's name from aria, its labels, what labels it, or its title; of other elements aria, caption or text; 200 characters."""
    first = lambda *xs: F.coalesce(*(F.nullif(F.trim(F.regexp_replace(said(x), r"\s+", " ")), F.lit("")) for x in xs), F.lit(""))
    caption = type_.isin("input:submit", "input:button", "input:reset")
    field = (type_.startswith("input:") & ~caption) | type_.isin("textarea", "select")
    return F.substring(F.when(field, first(aria, labels, labelled_by, title)).when(caption, first(aria, value, text)).otherwise(first(aria, text)), 1, 200)


def field_label(aria: Column, labelled_by: Column, label_for: Column, wrapping: Column, placeholder: Column, name: Column) -> Column:
    """The first of six sources that says something, white space collapsed, 80 characters."""
    spaced = F.regexp_replace(said(name), "[_-]+", " ")
    return F.coalesce(*(F.nullif(collapsed(x, 80), F.lit("")) for x in (aria, labelled_by, label_for, wrapping, placeholder, spaced)), F.lit(""))


def clean_label(text: Column) -> Column:
    """A label of 100 characters at most without e-mail addresses and long numbers."""
    cut = F.substring(text, 1, 100)
    return F.when(text != "", F.regexp_replace(F.regexp_replace(cut, LABEL_EMAIL, "[REDACTED]"), LABEL_NUMBER, "[REDACTED]"))


def semantic_label(aria: Column, placeholder: Column, text: Column) -> Column:
    return clean_label(F.coalesce(*(F.nullif(F.trim(x), F.lit("")) for x in (aria, placeholder, text))))


def populated(value: Column, has_value: Column) -> Column:
    """Whether a field is filled: an unchecked box or a redaction mark is no value."""
    return flag(has_value) | (said(value) != "") & ~said(value).isin("unchecked", "[REDACTED]")


def raw_value_present(value: Column) -> Column:
    """The privacy audit of an element: a value that is neither a mark nor a box's state."""
    return (said(value) != "") & ~said(value).isin(*MARKS, "checked", "unchecked")


def expected_input(label: Column, selector: Column, type_: Column) -> Column:
    """struct<field_name, expected>: help for who is asked to fill a field."""
    words = joined(label, selector, type_)
    out = F.struct(F.coalesce(F.nullif(label, F.lit("")), F.nullif(selector, F.lit("")), F.lit("Required Input Field")).alias("field_name"), F.concat(F.lit("Enter the required "), F.coalesce(F.nullif(label, F.lit("")), F.lit("information")), F.lit(" for this field.")).alias("expected"))
    for found, name, expected in reversed(EXPECTED):
        hit = F.lit(False)
        for w in found:
            hit = hit | words.contains(w)
        out = F.when(hit, F.struct(F.lit(name).alias("field_name"), F.lit(expected).alias("expected"))).otherwise(out)
    return out


def is_search(type_: Column, role: Column, name: Column, placeholder: Column, aria: Column, id_: Column) -> Column:
    found = F.lit(False)
    for x in (name, placeholder, aria, id_):
        found = found | F.lower(said(x)).contains("search")
    return (said(type_) == "input:search") | (said(role) == "searchbox") | found


def is_pagination(nav_label: Column, text: Column, aria: Column) -> Column:
    """A control of a paging navigation, or one that says a page number, next, previous, first or last."""
    word = F.lower(F.trim(said(text))).rlike(r"^(next|prev|previous|first|last|\d+)$")
    return has(nav_label, "pagination|paging") | word | F.lower(said(aria)).contains("page") | F.lower(said(aria)).contains("pagination")


def is_form_input(tag: Column, type_: Column) -> Column:
    tag, type_ = F.lower(said(tag)), F.lower(said(type_))
    no = (tag == "button") | type_.isin("submit", "button", "reset", "hidden")
    typed = type_.startswith("input:") & ~type_.contains("submit") & ~type_.contains("button")
    return ~no & (tag.isin("input", "textarea", "select") | type_.isin("textarea", "select") | typed)


def is_submit(text: Column, aria: Column, placeholder: Column, type_: Column, selector: Column) -> Column:
    """Whether an element submits something, by words alone."""
    words = joined(text, aria, placeholder, type_, selector)
    hit = F.lit(False)
    for w in SUBMIT_WORDS:
        hit = hit | words.contains(w)
    return hit


def worth_naming(text: Column) -> Column:
    """Whether a text may hold names: 4 to 2000 characters, two letters in a row."""
    plain = F.trim(said(text))
    return F.length(plain).between(4, 2000) & plain.rlike("[A-Za-zÀ-ɏऀ-ॿ]{2,}")


# What asks for an action, and what asks about a page.
DOING = r"\b(fill|complete|submit|click|type|enter|select|choose|go to|navigate|open|sign up|register|apply|pay|buy|checkout|log ?in|upload|download)\b"
ASKING = [r"\?\s*$", r"^(what|what's|whats|why|how|who|which|where|when|is|are|does|do|can|explain|summari[sz]e|describe|tell me|give me)\b", r"\b(about|summary|overview|purpose)\b"]
# What asks for a form to be filled.
FILLING = [r"(complete|fill|finish|submit)\b.*\b(form|application|kyc|profile|registration|details|fields|signup|sign-up)", r"\b(fill (it|this|everything|out|in)|autofill|auto-fill)\b"]
# Words of tasks that ask for a look at the page.
LOOKS = ["color", "colour", "image", "picture", "photo", "chart", "graph", "canvas", "map", "visual", "layout", "draw", "spatial", "logo", "screenshot", "diagram", "icon", "look at", "appearance", "red button", "blue button", "green button", "top right", "bottom left", "middle of"]


def any_of(text: Column, patterns: list[str]) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | has(text, p)
    return hit


def page_question(task: Column) -> Column:
    """Whether a task asks about the page and for no action on it."""
    task = F.trim(said(task))
    return (task != "") & ~has(task, DOING) & any_of(task, ASKING)


def form_filling(task: Column) -> Column:
    return any_of(said(task), FILLING)


def id_document(nearby: Column, width: Column, height: Column) -> Column:
    """Why an image may show an identity document: id_keyword_match, upload_preview_aspect_match, or null. Images under 40 pixels show none."""
    ratio = width / height
    card = ((ratio > 1.2) & (ratio < 2.0)) | ((ratio > 0.5) & (ratio < 0.85))
    reason = F.when(has(nearby, ID_WORDS), "id_keyword_match").when(has(nearby, UPLOAD_WORDS) & card, "upload_preview_aspect_match")
    return F.when((width >= 40) & (height >= 40), reason)


def task_words(task: Column) -> Column:
    """Words of a task, three letters and more, without noise; repeats stay."""
    words = F.split(F.regexp_replace(F.lower(said(task)), r"[^\w\s]", " "), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(TASK_NOISE))


def label_match(task: Column, text: Column, aria: Column, placeholder: Column) -> Column:
    """0.5 and a fifth for each word of the task in the label, 1 at most; 0.6 without a label; null without words."""
    words = F.filter(F.split(F.regexp_replace(F.lower(said(task)), r"[^\w\s]", " "), r"\s+"), lambda w: F.length(w) > 2)
    label = joined(text, aria, placeholder)
    hits = F.size(F.filter(words, lambda w: label.contains(w)))
    return F.when(F.size(words) == 0, None).when(F.trim(label) == "", 0.6).otherwise(F.least(F.lit(1.0), 0.5 + F.least(F.lit(0.5), hits * 0.2)))


# Tables of elements -----------------------------------------------------------------------------


def icon_candidates(elements: DataFrame, most: int = 16) -> DataFrame:
    """The first elements of each page that look like icons without a name."""
    blank = lambda c: F.trim(said(F.col(c))) == ""
    ratio = F.col("width") / F.col("height")
    sized = F.col("width").between(ICON_LEAST, ICON_MOST) & F.col("height").between(ICON_LEAST, ICON_MOST) & ratio.between(ICON_NARROW, ICON_WIDE)
    found = elements.filter(flag(F.col("visible"), True) & flag(F.col("enabled"), True) & blank("text") & blank("aria_label") & blank("placeholder") & F.col("type").isin(ICON_TYPES) & sized)
    return found.withColumn("k", F.row_number().over(Window.partitionBy("page_id").orderBy("ord"))).filter(F.col("k") <= most).drop("k")


def skeleton(elements: DataFrame, sensitive: DataFrame, task: Column | None = None) -> DataFrame:
    """What of elements may be sent: no values, only whether there is one, whether it is sensitive, and a relevance score.

    sensitive has (page_id, element_id), each found item; an element counts as sensitive if it is
    in there, or says so itself. All elements stay; score and is_core are for who wants to prune.
    """
    marked = sensitive.select("page_id", F.col("element_id").alias("id")).distinct().withColumn("found", F.lit(True))
    filled = flag(F.col("has_value")) | (said(F.col("value")) != "")
    rows = elements.join(marked, ["page_id", "id"], "left").withColumn("sensitive", flag(F.col("found")) | flag(F.col("sensitive"))).withColumn("has_value", filled)
    tag = F.nullif(F.substring_index(said(F.col("type")), ":", 1), F.lit(""))
    modal = F.max(flag(F.col("in_modal")).cast("int")).over(Window.partitionBy("page_id")) > 0
    score = skeleton_score(tag, modal, F.lit(None).cast("string") if task is None else task)
    core = F.col("form_id").isNotNull() | flag(F.col("is_search")) | flag(F.col("in_modal")) | F.col("has_value") | F.col("sensitive")
    columns = ["page_id", "ord", "id", F.coalesce(tag, F.lit("unknown")).alias("tag"), "type", "selector", "x", "y", "width", "height", "sensitive", "has_value", "text", "aria_label", "placeholder", flag(F.col("enabled"), True).alias("enabled"), flag(F.col("visible"), True).alias("visible")]
    return rows.select(*columns, "is_search", "is_pagination", "in_modal", "in_nav", "is_sticky", "form_id", score.alias("score"), core.alias("is_core"))


def skeleton_score(tag: Column, modal: Column, task: Column) -> Column:
    noise = ["the", "and", "for", "with", "from", "this", "that"]
    words = F.filter(F.split(F.regexp_replace(F.lower(said(task)), r"[^\w\s]", " "), r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(noise))
    label = joined(F.col("text"), F.col("aria_label"), F.col("placeholder"), F.col("selector"))
    on = lambda c, n: F.when(c, n).otherwise(0)
    inside, search = flag(F.col("in_modal")), flag(F.col("is_search"))
    return (
        F.when(modal & inside, 100).when(modal, -40).otherwise(0) + F.size(F.filter(words, lambda w: label.contains(w))) * 20 + on(search, 15) + on(F.col("form_id").isNotNull(), 10)
        + on(flag(tag.isin("input", "button", "select")), 10) + on(flag(F.col("is_pagination")), 10) + on(flag(F.col("is_sticky")), 5) + on(flag(F.col("in_nav")) & ~search, -10) + on(~flag(F.col("enabled"), True), -15)
    )


def redaction_map(items: DataFrame) -> DataFrame:
    """Each found item that belongs to an element: (page_id, element_id, type, method)."""
    return items.filter(F.col("element_id").isNotNull()).select("page_id", F.col("element_id").cast("string").alias("element_id"), F.coalesce(F.nullif("type", F.lit("")), F.lit("UNKNOWN")).alias("type"), F.lit("blackout").alias("method"))


def compact_json(elements: DataFrame, *columns: str) -> DataFrame:
    """(page_id, ord, json): elements as JSON without empty fields."""
    return elements.select("page_id", "ord", F.to_json(F.struct(*(F.nullif(F.col(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in elements.select(*columns).dtypes)), {"ignoreNullFields": "true"}).alias("json"))


def relevance(elements: DataFrame, task: Column, role: Column, modal: Column) -> Column:
    """How much an element matters to a task."""
    label = joined(F.col("text"), F.col("aria_label"), F.col("placeholder"))
    points = F.lit(0)
    for name, n in ROLE_POINTS.items():
        points = points + F.when(role == name, n).otherwise(0)
    on = lambda c, n: F.when(c, n).otherwise(0)
    return (
        F.when(modal & flag(F.col("in_modal")), 100).when(modal, -30).otherwise(0) + F.size(F.filter(task_words(task), lambda w: label.contains(w))) * 20 + points
        + on(F.col("has_value") == F.lit(False), 10) + on(F.col("has_value"), -5) + on(F.col("form_id").isNotNull(), 8) + on(~flag(F.col("enabled"), True), -20) + on(~flag(F.col("visible"), True), -50)
        + on(flag(F.col("in_nav")) & ~flag(F.col("is_search")) & (role == "navigation_link"), -10)
    )


def top_elements(scored: DataFrame, near: int = 40, far: int = 20) -> DataFrame:
    """The elements of each page by falling score (then ord): tier task for the first, context for the next; the others go."""
    k = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "ord"))
    return scored.withColumn("k", k).filter(F.col("k") <= near + far).withColumn("tier", F.when(F.col("k") <= near, "task").otherwise("context"))


def regions(elements: DataFrame, landmarks: DataFrame) -> DataFrame:
    """Adds region: modal, the role of the first landmark around the element (2 pixels of slack), else what its flags say.

    Elements meet the landmarks of their page that their first corner lies in, by a grid.
    """
    c = F.col
    corners = elements.select("page_id", c("ord").alias("e_ord"), c("x").alias("px"), c("y").alias("py"), (c("x") + c("width")).alias("e_right"), (c("y") + c("height")).alias("e_bottom"))
    # slack belongs to the landmark: a corner in it lies inside the widened box
    wide = landmarks.select("page_id", c("ord").alias("l_ord"), c("role").alias("l_role"), "x", "y", (c("width") + 2).alias("width"), (c("height") + 2).alias("height"))
    close = (c("e_right") <= c("x") + c("width")) & (c("e_bottom") <= c("y") + c("height"))
    found = grid.containing(corners, wide, "page_id").filter(close).groupBy("page_id", c("e_ord").alias("ord")).agg(F.min_by("l_role", "l_ord").alias("l_role"))
    flags = F.when(flag(F.col("in_nav")), "navigation").when(flag(F.col("is_sticky")), "sticky").when(F.col("form_id").isNotNull(), "form").otherwise("content")
    region = F.when(F.col("x").isNull(), "unknown").when(flag(F.col("in_modal")), "modal").otherwise(F.coalesce("l_role", flags))
    return elements.join(found, ["page_id", "ord"], "left").withColumn("region", region).drop("l_role")


def form_summary(elements: DataFrame) -> DataFrame:
    """(page_id, form_id, n_fields, n_populated, has_submit)."""
    return elements.filter(F.col("form_id").isNotNull()).groupBy("page_id", "form_id").agg(F.count(F.lit(1)).alias("n_fields"), F.count_if(flag(F.col("has_value"))).alias("n_populated"), F.max(F.coalesce(F.col("type").isin("button", "input:submit"), F.lit(False))).alias("has_submit"))


def form_relationships(elements: DataFrame, role: Column) -> DataFrame:
    """(page_id, form_id, field_ids, submit_ids), in the order of the page. A form's list is no longer than its page."""
    rows = elements.filter(F.col("form_id").isNotNull()).withColumn("submits", role.isin("submit_button", "form_button"))
    ids = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("ord", "id")))), lambda s: s["id"])
    return rows.groupBy("page_id", "form_id").agg(ids(~F.col("submits")).alias("field_ids"), ids(F.col("submits")).alias("submit_ids"))


def completion(elements: DataFrame, key: Column, store: DataFrame) -> DataFrame:
    """(page_id, total_fields, completed, empty, matchable, needs_user) of each page; key is what a field asks for, store has (key)."""
    held = store.select(F.col("key").alias("k")).distinct().withColumn("held", F.lit(True))
    rows = elements.withColumn("k", key).join(held, "k", "left")
    ours = is_form_input(F.col("tag"), F.col("type"))
    done = ours & (flag(F.col("has_value")) | (said(F.col("value")) != "") & (said(F.col("value")) != "[REDACTED]"))
    n = rows.groupBy("page_id").agg(F.count_if(ours).alias("total_fields"), F.count_if(done).alias("completed"), F.count_if(ours & ~done & flag(F.col("held"))).alias("matchable"))
    empty = F.col("total_fields") - F.col("completed")
    return n.select("page_id", "total_fields", "completed", empty.alias("empty"), "matchable", F.greatest(F.lit(0), empty - F.col("matchable")).alias("needs_user"))


def distinct_buttons(elements: DataFrame, most: int = 40) -> DataFrame:
    """(page_id, label, ord): each page's first buttons with a label of their own."""
    label = F.substring(F.trim(F.regexp_replace(F.coalesce(F.nullif("aria_label", F.lit("")), F.nullif("text", F.lit("")), "value", F.lit("")), r"\s+", " ")), 1, 60)
    rows = elements.filter(F.col("type").isin("button", "input:submit", "input:button", "role:button")).withColumn("label", label).filter("label <> ''")
    first = rows.groupBy("page_id", "label").agg(F.min("ord").alias("ord"))
    return first.withColumn("k", F.row_number().over(Window.partitionBy("page_id").orderBy("ord"))).filter(F.col("k") <= most).drop("k")


def label_for(fields: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds label: the text of the label elements that name a field's id, in page order, joined by a space."""
    words = labels.groupBy("page_id", F.col("target").alias("id")).agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda s: s["text"])).alias("label"))
    return fields.join(words, ["page_id", "id"], "left")


def radio_groups(elements: DataFrame) -> DataFrame:
    """(page_id, name, options): radio buttons of one name with their values, labels and states."""
    rows = elements.filter((F.col("type") == "input:radio") & F.col("name").isNotNull())
    return rows.groupBy("page_id", "name").agg(F.array_sort(F.collect_list(F.struct("ord", "value", F.coalesce("aria_label", "value").alias("label"), "checked"))).alias("options"))


def merged_frames(elements: DataFrame, frames: DataFrame) -> DataFrame:
    """Elements of child frames in the page's coordinates, ids after their frame's number; frames without a place are left out.

    elements has frame_id (0: the page itself); frames (page_id, frame_id, dx, dy).
    """
    moved = elements.join(frames.select("page_id", "frame_id", "dx", "dy"), ["page_id", "frame_id"], "left")
    own = F.col("frame_id") == 0
    shift = lambda c, d: F.when(own, F.col(c)).otherwise(F.col(c) + F.col(d))
    named = F.when(own, F.col("id")).otherwise(F.concat(F.lit("f"), F.col("frame_id"), F.lit("_"), F.col("id")))
    return moved.filter(own | F.col("dx").isNotNull()).withColumn("x", shift("x", "dx")).withColumn("y", shift("y", "dy")).withColumn("id", named).drop("dx", "dy")


def hidden_frames(items: DataFrame, frames: DataFrame) -> DataFrame:
    """Findings in frames whose place nobody knows: one CROSS_ORIGIN_FRAME_CONTENT item for each such frame, 0.6 sure."""
    lost = items.join(frames.filter(F.col("dx").isNotNull()).select("page_id", "frame_id"), ["page_id", "frame_id"], "left_anti").filter("frame_id <> 0")
    return lost.groupBy("page_id", "frame_id").agg(F.count(F.lit(1)).alias("n_items")).select("page_id", "frame_id", F.lit("CROSS_ORIGIN_FRAME_CONTENT").alias("type"), F.lit(0.6).alias("confidence"), "n_items")


def across_screens(boxes: DataFrame, grain: int = 6) -> DataFrame:
    """Boxes of a page met on several screens, once for each rounded place: the one of the first screen."""
    at = [F.round(F.col(c) / grain).cast("long") for c in ("x", "y", "width", "height")]
    w = Window.partitionBy("page_id", "type", *at).orderBy("screen", "ord")
    return boxes.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")


def context_sentence(kind: Column, fields: Column, filled: Column, regions_: Column, modal: Column, alerts: Column) -> Column:
    """A page in a sentence. regions_: array of strings such as main(4)."""
    # Names of the page types.
    names = {"form": "Form page", "search": "Search page", "data": "Data/table page", "article": "Article page", "navigation": "Navigation page", "dialog": "Active dialog", "mixed": "Mixed content page"}
    name = F.lit("Page")
    for k, v in names.items():
        name = F.when(kind == k, v).otherwise(name)
    parts = [
        name,
        F.when(fields > 0, F.format_string("with %d form fields (%d filled, %d empty)", fields, filled, fields - filled)),
        F.when(F.size(regions_) > 0, F.concat(F.lit("Regions: "), F.concat_ws(", ", regions_))),
        F.when(modal.isNotNull(), F.concat(F.lit('Modal open: "'), F.coalesce(F.nullif(modal, F.lit("")), F.lit("Dialog")), F.lit('"'))),
        F.when(alerts > 0, F.format_string("%d alert(s) visible", alerts)),
    ]
    return F.concat(F.concat_ws(". ", *parts), F.lit("."))


def payload_size(json: Column) -> Column:
    """struct<chars, tokens>: length and parts between white space and JSON's punctuation."""
    return F.struct(F.length(json).alias("chars"), F.size(F.filter(F.split(json, r'[\s,{}\[\]:"]+'), lambda t: t != "")).alias("tokens"))


def grounding_needed(elements: DataFrame, task: Column) -> DataFrame:
    """(page_id, reason): why a page needs a picture beside its elements: task, canvas, alike (three controls that read the same), or default."""
    looks = F.lit(False)
    for w in LOOKS:
        looks = looks | F.lower(said(task)).contains(w)
    drawn = (F.col("tag") == "canvas") | (F.col("type") == "canvas") | (F.col("tag") == "svg") & (said(F.col("text")) == "") & (said(F.col("aria_label")) == "")
    shown = flag(F.col("visible"), True) & flag(F.col("enabled"), True)
    alike = elements.groupBy("page_id", "tag", *(said(F.col(c)).alias(c) for c in ("text", "aria_label", "placeholder"))).agg(F.count_if(shown).alias("n"), F.max(flag(drawn)).alias("drawn"))
    page = alike.groupBy("page_id").agg(F.max(F.when(F.col("tag").isin("button", "input", "a"), F.col("n"))).alias("n"), F.max("drawn").alias("drawn"))
    return page.select("page_id", F.when(looks, "task").when(F.col("drawn"), "canvas").when(F.col("n") >= 3, "alike").otherwise("default").alias("reason"))


def with_icons(elements: DataFrame, icons: DataFrame, least: float = 0.6) -> DataFrame:
    """Adds inferred_label to nameless elements: what a model says of their icon (page_id, id, label, confidence, looks) if it is sure enough, else `icon` where it looks like one."""
    said_ = F.when(F.col("confidence") >= least, F.col("label")).when(F.col("looks"), "icon")
    first = icons.groupBy("page_id", "id").agg(F.max_by(F.struct("label", "confidence", "looks"), "confidence").alias("i")).select("page_id", "id", "i.*").select("page_id", "id", said_.alias("inferred"))
    nameless = F.concat_ws("", *(F.trim(said(F.col(c))) for c in ("text", "aria_label", "placeholder"))) == ""
    return elements.join(first, ["page_id", "id"], "left").withColumn("inferred_label", F.when(nameless, F.col("inferred"))).drop("inferred")


def without_unpainted(elements: DataFrame, unpainted: DataFrame) -> DataFrame:
    """Adds painted: false for the elements (page_id, id) whose place on the screen shows nothing."""
    gone = unpainted.select("page_id", "id").distinct().withColumn("__gone", F.lit(True))
    return elements.join(gone, ["page_id", "id"], "left").withColumn("painted", F.col("__gone").isNull()).drop("__gone")


def semantic_view(elements: DataFrame, landmarks: DataFrame, task: Column, role: Column, near: int = 40, far: int = 20) -> DataFrame:
    """(page_id, ord, id, role, label, region, has_value, enabled, visible, score, tier): the elements of each page that matter to a task, without selectors and values; marks for a value are no label."""
    modal = F.max(flag(F.col("in_modal")).cast("int")).over(Window.partitionBy("page_id")) == 1
    rows = regions(elements, landmarks).withColumn("role", role).withColumn("modal", modal)
    scored = rows.withColumn("score", relevance(rows, task, F.col("role"), F.col("modal")))
    label = semantic_label(F.col("aria_label"), F.col("placeholder"), F.col("text"))
    return top_elements(scored, near, far).select("page_id", "ord", "id", "role", F.when(~label.isin(MARKS), label).alias("label"), "region", "has_value", "enabled", "visible", "score", "tier")


def match_box(length: Column, start: Column, end: Column) -> Column:
    """struct<x, y, width, height> of a match in a line of text whose box is x, y, width and height, letters taken as equally wide."""
    x, w = F.col("x"), F.col("width")
    return F.when(length > 0, F.struct((x + w * start / length).alias("x"), F.col("y").alias("y"), (w * (end - start) / length).alias("width"), F.col("height").alias("height")))
