"""Queries about page elements: labels, predicates, skeletons, relevance, forms, regions, grounding, highlights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boxes, decisions, steps
from ..operators import elements as E
from ..sources import elements as parsed
from .made import ELEMENTS, HISTORY, ITEMS, elements, history, items
from .registry import query, table, text

C = F.col
WITH = f"WITH {ELEMENTS}"
TASK = "Please search the order number and pay with email 500"
TASK_SQL = "['search', 'order', 'number', 'pay', 'email', '500']"
LOW = "lower(concat_ws(' ', coalesce(text, ''), coalesce(aria_label, ''), coalesce(placeholder, '')))"
HITS = f"len(list_filter({TASK_SQL}, lambda w: contains({LOW}, w)))"
ROLE_SQL = (
    "CASE WHEN type = 'input:submit' THEN 'submit_button' WHEN type = 'input:checkbox' THEN 'checkbox' WHEN type = 'input:radio' THEN 'radio_button' WHEN type = 'select' THEN 'dropdown' WHEN type = 'role:tab' THEN 'tab_control' WHEN type = 'role:menuitem' THEN 'menu_item' "
    "WHEN type LIKE 'input:%' OR type = 'textarea' THEN CASE WHEN is_search THEN 'search_input' ELSE 'form_field' END WHEN type IN ('button', 'role:button') THEN CASE WHEN is_search THEN 'search_button' WHEN form_id IS NOT NULL THEN 'form_button' ELSE 'action_button' END "
    "WHEN type = 'link' THEN CASE WHEN is_pagination THEN 'pagination_control' WHEN in_nav THEN 'navigation_link' ELSE 'content_link' END ELSE 'interactive_element' END"
)
FORM_INPUT = "(tag <> 'button' AND type NOT IN ('submit', 'button', 'reset', 'hidden') AND (tag IN ('input', 'textarea', 'select') OR type IN ('textarea', 'select') OR (type LIKE 'input:%' AND NOT contains(type, 'submit') AND NOT contains(type, 'button'))))"
POPULATED = "(coalesce(has_value, false) OR coalesce(value, '') NOT IN ('', 'unchecked', '[REDACTED]'))"


def role():
    return steps.role(C("type"), C("is_search"), C("form_id").isNotNull(), C("is_pagination"), C("in_nav"))


CLEAN = "regexp_replace(regexp_replace(left({0}, 100), '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+[.][a-zA-Z]{{2,}}', '[REDACTED]', 'g'), '[+]?\\d[\\d\\s\\-()]{{8,}}\\d', '[REDACTED]', 'g')"
FIRST = "coalesce(nullif(trim(aria_label), ''), nullif(trim(placeholder), ''), nullif(trim(text), ''))"


@query(f"{WITH} SELECT page_id, ord, {CLEAN.format(FIRST)} AS label, {POPULATED} AS filled, coalesce(value, '') <> '' AND value NOT IN ('[REDACTED]', '[FILLED_FROM_LOCAL]', '[ALREADY_POPULATED]', 'checked', 'unchecked') AS raw_value, {FORM_INPUT} AS form_input FROM el")
def element_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sanitised semantic labels, filled-ness, privacy audit, form inputs."""
    return elements(spark, sf_dir).select("page_id", "ord", E.semantic_label(C("aria_label"), C("placeholder"), C("text")).alias("label"), E.populated(C("value"), C("has_value")).alias("filled"), E.raw_value_present(C("value")).alias("raw_value"), E.is_form_input(C("tag"), C("type")).alias("form_input"))


@query(
    f"{WITH} SELECT page_id, ord, width > 0 AND height > 0 AND y + height > 0 AND x + width > 0 AND y < 768 AND x < 1024 AS in_view, CASE WHEN y + height <= 0 THEN 'above the fold' WHEN y >= 768 THEN 'below the fold' ELSE 'on screen' END AS fold, "
    "type = 'input:search' OR contains(lower(coalesce(placeholder, '')), 'search') OR contains(lower(coalesce(aria_label, '')), 'search') AS search, "
    "regexp_matches(lower(trim(coalesce(text, ''))), '^(next|prev|previous|first|last|[0-9]+)$') OR contains(lower(coalesce(aria_label, '')), 'page') AS paging, "
    f"{ROLE_SQL} AS role, "
    "length(trim(coalesce(text, ''))) BETWEEN 4 AND 2000 AND regexp_matches(trim(coalesce(text, '')), '[A-Za-zÀ-ɏऀ-ॿ]{2,}') AS worth_naming FROM el"
)
def element_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Viewport, fold, search, pagination, role and name eligibility."""
    none = F.lit(None).cast("string")
    size = (C("x"), C("y"), C("width"), C("height"))
    return elements(spark, sf_dir).select(
        "page_id", "ord", boxes.in_view(*size, F.lit(1024), F.lit(768)).alias("in_view"), boxes.fold(C("y"), C("height"), F.lit(768)).alias("fold"), E.is_search(C("type"), none, none, C("placeholder"), C("aria_label"), none).alias("search"),
        E.is_pagination(none, C("text"), C("aria_label")).alias("paging"), role().alias("role"), E.worth_naming(C("text")).alias("worth_naming"),
    )


_HELP = [(["pan"], "PAN Card Number"), (["aadhaar", "aadhar"], "Aadhaar Card Number"), (["email"], "Email Address"), (["phone", "mobile", "tel"], "Mobile / Phone Number"), (["pass"], "Password"), (["dob", "birth", "date"], "Date of Birth"), (["name"], "Full Name")]
_WORDS = "lower(concat_ws(' ', coalesce(placeholder, ''), coalesce(selector, ''), type))"
HELP_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains({_WORDS}, '{w}')" for w in ws) + f" THEN '{n}'" for ws, n in _HELP) + " ELSE coalesce(nullif(placeholder, ''), nullif(selector, ''), 'Required Input Field') END"


@query(f"{WITH} SELECT field_name, count(*) AS n FROM (SELECT {HELP_SQL} AS field_name FROM el WHERE {FORM_INPUT}) GROUP BY 1")
def expected_input_help(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = elements(spark, sf_dir).filter(E.is_form_input(C("tag"), C("type")))
    return fields.groupBy(E.expected_input(C("placeholder"), C("selector"), C("type"))["field_name"].alias("field_name")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"{WITH} SELECT page_id, ord FROM el WHERE coalesce(enabled, true) AND visible AND trim(coalesce(text, '')) = '' AND trim(coalesce(aria_label, '')) = '' AND trim(coalesce(placeholder, '')) = '' AND type IN ('button', 'link', 'role:button', 'role:tab', 'role:menuitem') "
    "AND width BETWEEN 16 AND 64 AND height BETWEEN 16 AND 64 AND width / height BETWEEN 0.6 AND 1.67 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY ord) <= 16"
)
def icon_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.icon_candidates(elements(spark, sf_dir)).select("page_id", "ord")


_SKELETON_HITS = "len(list_filter(['please', 'search', 'order', 'number', 'pay', 'email', '500'], lambda w: contains(lower(concat_ws(' ', coalesce(text, ''), coalesce(aria_label, ''), coalesce(placeholder, ''), coalesce(selector, ''))), w)))"


@query(
    f"{WITH}, {ITEMS}, s AS (SELECT *, coalesce(has_value, false) OR coalesce(value, '') <> '' AS filled, EXISTS (SELECT 1 FROM it WHERE it.page_id = el.page_id AND it.element_id = el.id) OR coalesce(sensitive, false) AS risky, split_part(type, ':', 1) AS t, max(in_modal) OVER (PARTITION BY page_id) AS modal FROM el) "
    "SELECT page_id, ord, t AS tag, risky AS sensitive, filled AS has_value, coalesce(enabled, true) AS enabled, form_id IS NOT NULL OR is_search OR in_modal OR filled OR risky AS is_core, "
    f"(CASE WHEN modal AND in_modal THEN 100 WHEN modal THEN -40 ELSE 0 END + {_SKELETON_HITS} * 20 + CASE WHEN is_search THEN 15 ELSE 0 END + CASE WHEN form_id IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN t IN ('input', 'button', 'select') THEN 10 ELSE 0 END "
    "+ CASE WHEN is_pagination THEN 10 ELSE 0 END + CASE WHEN is_sticky THEN 5 ELSE 0 END - CASE WHEN in_nav AND NOT is_search THEN 10 ELSE 0 END - CASE WHEN NOT coalesce(enabled, true) THEN 15 ELSE 0 END)::INTEGER AS score FROM s"
)
def skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements as they may be sent: sensitive by a semi join with the findings, no values, a score."""
    found = items(spark, sf_dir).filter("element_id is not null")
    return E.skeleton(elements(spark, sf_dir), found, F.lit(TASK)).select("page_id", "ord", "tag", "sensitive", "has_value", "enabled", "is_core", C("score").cast("int").alias("score"))


@query(f"WITH {ITEMS} SELECT type, method, count(*) AS n FROM (SELECT coalesce(type, 'UNKNOWN') AS type, 'blackout' AS method FROM it WHERE element_id IS NOT NULL) GROUP BY ALL")
def redaction_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.redaction_map(items(spark, sf_dir)).groupBy("type", "method").agg(F.count(F.lit(1)).alias("n"))


_POINTS = " + ".join(f"CASE WHEN role = '{n}' THEN {p} ELSE 0 END" for n, p in E.ROLE_POINTS.items())


@query(
    f"{WITH}, r AS (SELECT *, {ROLE_SQL} AS role, max(in_modal) OVER (PARTITION BY page_id) AS modal FROM el), s AS (SELECT page_id, ord, role, (CASE WHEN modal AND in_modal THEN 100 WHEN modal THEN -30 ELSE 0 END + {HITS} * 20 + {_POINTS} "
    "+ CASE WHEN has_value = false THEN 10 ELSE 0 END - CASE WHEN has_value THEN 5 ELSE 0 END + CASE WHEN form_id IS NOT NULL THEN 8 ELSE 0 END - CASE WHEN NOT coalesce(enabled, true) THEN 20 ELSE 0 END - CASE WHEN NOT visible THEN 50 ELSE 0 END "
    "- CASE WHEN in_nav AND NOT is_search AND role = 'navigation_link' THEN 10 ELSE 0 END)::INTEGER AS score FROM r) SELECT page_id, ord, score, CASE WHEN k <= 40 THEN 'task' ELSE 'context' END AS tier FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, ord) AS k FROM s) WHERE k <= 60"
)
def relevance_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 elements of each page that matter most to a task, and the next 20."""
    from pyspark.sql import Window

    rows = elements(spark, sf_dir).withColumn("modal", F.max(C("in_modal").cast("int")).over(Window.partitionBy("page_id")) == 1).withColumn("role", role())
    scored = rows.withColumn("score", E.relevance(rows, F.lit(TASK), C("role"), C("modal")).cast("int"))
    return E.top_elements(scored).select("page_id", "ord", "score", "tier")


@query(f"{WITH} SELECT page_id, form_id, count(*) AS n_fields, count(*) FILTER (has_value) AS n_populated, bool_or(type IN ('button', 'input:submit')) AS has_submit FROM el WHERE form_id IS NOT NULL GROUP BY ALL")
def form_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.form_summary(elements(spark, sf_dir))


@query(f"{WITH}, r AS (SELECT *, {ROLE_SQL} AS role FROM el WHERE form_id IS NOT NULL) SELECT page_id, form_id, coalesce(string_agg(id, ',' ORDER BY ord) FILTER (role NOT IN ('submit_button', 'form_button')), '') AS fields, coalesce(string_agg(id, ',' ORDER BY ord) FILTER (role IN ('submit_button', 'form_button')), '') AS submits FROM r GROUP BY ALL")
def form_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.form_relationships(elements(spark, sf_dir), role()).select("page_id", "form_id", F.concat_ws(",", "field_ids").alias("fields"), F.concat_ws(",", "submit_ids").alias("submits"))


@query(
    f"{WITH}, d AS (SELECT page_id, {FORM_INPUT} AS f, {FORM_INPUT} AND (coalesce(has_value, false) OR coalesce(value, '') NOT IN ('', '[REDACTED]')) AS done, lower(placeholder) IN ('city', 'phone number') AS held FROM el) "
    "SELECT page_id, count(*) FILTER (f) AS total_fields, count(*) FILTER (done) AS completed, count(*) FILTER (f AND NOT done) AS empty, count(*) FILTER (f AND NOT done AND held) AS matchable, greatest(0, count(*) FILTER (f AND NOT done) - count(*) FILTER (f AND NOT done AND held)) AS needs_user FROM d GROUP BY page_id"
)
def form_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields in all, filled, empty, fillable from a store and left for the user. The key is the hint in lower case."""
    store = spark.createDataFrame([("city",), ("phone number",), ("city",)], "key string")
    return E.completion(elements(spark, sf_dir), F.lower("placeholder"), store)


_BUTTON = "left(trim(regexp_replace(coalesce(nullif(aria_label, ''), nullif(text, ''), value, ''), '\\s+', ' ', 'g')), 60)"


@query(f"{WITH}, b AS (SELECT page_id, {_BUTTON} AS label, min(ord) AS ord FROM el WHERE type IN ('button', 'input:submit', 'input:button', 'role:button') GROUP BY ALL) SELECT page_id, label, ord FROM b WHERE label <> '' QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY ord) <= 40")
def distinct_buttons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.distinct_buttons(elements(spark, sf_dir))


MARKS = [(0, "banner", 0.0, -100.0, 1300.0, 250.0), (1, "main", 0.0, 100.0, 900.0, 900.0), (2, "complementary", 800.0, 0.0, 500.0, 1700.0)]


@query(
    f"{WITH}, lm(o, role, lx, ly, lw, lh) AS (VALUES {', '.join(map(str, MARKS))}), f AS (SELECT el.*, (SELECT role FROM lm WHERE el.x >= lx AND el.y >= ly AND el.x + el.width <= lx + lw + 2 AND el.y + el.height <= ly + lh + 2 ORDER BY o LIMIT 1) AS mark FROM el) "
    "SELECT page_id, ord, CASE WHEN in_modal THEN 'modal' ELSE coalesce(mark, CASE WHEN in_nav THEN 'navigation' WHEN is_sticky THEN 'sticky' WHEN form_id IS NOT NULL THEN 'form' ELSE 'content' END) END AS region FROM f"
)
def element_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each element's landmark by containment; every page has the same three."""
    own = elements(spark, sf_dir)
    marks = spark.createDataFrame(MARKS, "ord int, role string, x double, y double, width double, height double")
    return E.regions(own, own.select("page_id").distinct().join(F.broadcast(marks))).select("page_id", "ord", "region")


_GROUND = "CASE WHEN tag IN ('button', 'input', 'select', 'textarea', 'a') THEN 500 ELSE 0 END + CASE WHEN type IN ('button', 'submit') THEN 200 ELSE 0 END + CASE WHEN trim(coalesce(text, '')) <> '' THEN 50 ELSE 0 END + CASE WHEN coalesce(aria_label, '') <> '' THEN 50 ELSE 0 END + CASE WHEN in_modal THEN 300 ELSE 0 END - CASE WHEN tag IN ('div', 'li') AND coalesce(text, '') = '' AND coalesce(aria_label, '') = '' THEN 200 ELSE 0 END"


@query(
    f"{WITH}, p AS (SELECT user_id AS page_id, event_id AS point_id, (event_id * 31 % 1200)::DOUBLE AS px, (event_id * 47 % 1500)::DOUBLE AS py FROM events WHERE user_id IS NOT NULL), "
    f"j AS (SELECT p.*, el.id, el.ord, px BETWEEN x AND x + width AND py BETWEEN y AND y + height AS inside, {_GROUND} AS score, width * height AS area, sqrt((px - x - width / 2) * (px - x - width / 2) + (py - y - height / 2) * (py - y - height / 2)) * CASE WHEN tag IN ('button', 'input', 'select', 'textarea', 'a') OR type = 'button' THEN 0.8 ELSE 1 END AS far FROM p JOIN el USING (page_id) WHERE coalesce(enabled, true) AND visible) "
    "SELECT page_id, point_id, id AS element_id, CASE WHEN inside THEN 'EXACT_CONTAINMENT' ELSE 'APPROXIMATE_PROXIMITY' END AS method, CASE WHEN inside THEN 0 ELSE floor(far + 0.5)::BIGINT END AS distance, round(CASE WHEN inside THEN 1 ELSE greatest(0.2, (45 - far) / 45) END, 6)::DOUBLE AS confidence FROM j WHERE inside OR far <= 45 "
    "QUALIFY row_number() OVER (PARTITION BY page_id, point_id ORDER BY inside DESC, CASE WHEN inside THEN -score ELSE far END, CASE WHEN inside THEN area ELSE 0 END, ord) = 1"
)
def ground_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event a point; its element by specificity, or by nearness."""
    e = C("event_id")
    points = table(spark, sf_dir, "events").filter("user_id is not null").select(C("user_id").alias("page_id"), e.alias("point_id"), (e * 31 % 1200).alias("px"), (e * 47 % 1500).alias("py"))
    return boxes.grounded(points, elements(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


@query(
    f"{WITH}, {HISTORY}, {ITEMS}, g AS (SELECT page_id, element_id, action FROM hi WHERE success AND coalesce(outcome, '') NOT IN ('FAILED', 'NO_EFFECT', 'TARGET_DISAPPEARED') QUALIFY row_number() OVER (PARTITION BY page_id, element_id ORDER BY seq) = 1), "
    "f AS (SELECT page_id, id FROM el GROUP BY ALL) SELECT page_id, kind, label, count(*) AS n FROM (SELECT g.page_id, 'safe' AS kind, g.action || ': succeeded' AS label FROM g JOIN f ON f.page_id = g.page_id AND f.id = g.element_id "
    "UNION ALL SELECT page_id, 'danger', coalesce('PII still visible: ' || type, 'Sensitive item still visible') FROM it WHERE x IS NOT NULL) GROUP BY ALL"
)
def completion_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is shown as done, and what is still to be seen, counted."""
    return decisions.highlights(history(spark, sf_dir), elements(spark, sf_dir), items(spark, sf_dir)).groupBy("page_id", "kind", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH {ITEMS} SELECT page_id, kind, floor(x)::BIGINT AS x, floor(y)::BIGINT AS y, floor(w)::BIGINT AS width, floor(h)::BIGINT AS height FROM (SELECT page_id, kind, least(2048, greatest(0, l)) AS x, least(1536, greatest(0, t)) AS y, greatest(0, least(2048, r) - greatest(0, l)) AS w, greatest(0, least(1536, b) - greatest(0, t)) AS h FROM "
    "(SELECT page_id, k AS kind, CASE k WHEN 'face' THEN floor(x - 10) ELSE x * 2 - p END AS l, CASE k WHEN 'face' THEN floor(y - 10) ELSE y * 2 - p END AS t, CASE k WHEN 'face' THEN ceil(x + width + 10) ELSE (x + width) * 2 + p END AS r, CASE k WHEN 'face' THEN ceil(y + height + 10) ELSE (y + height) * 2 + p END AS b FROM "
    "(SELECT *, CASE ord % 7 WHEN 0 THEN 'face' WHEN 1 THEN 'id' ELSE 'text' END AS k, CASE ord % 7 WHEN 1 THEN 16 ELSE 8 END AS p FROM it WHERE x IS NOT NULL))) WHERE w > 0 AND h > 0"
)
def redaction_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes to black out in a picture of twice the page's size."""
    k = C("ord") % 7
    found = items(spark, sf_dir).filter("x is not null").withColumn("kind", F.when(k == 0, "face").when(k == 1, "id").otherwise("text"))
    sized = found.withColumns({"view_w": F.lit(1024), "view_h": F.lit(768), "image_w": F.lit(2048), "image_h": F.lit(1536)})
    return boxes.redaction_boxes(sized).select("page_id", "kind", *(F.floor(c).cast("long").alias(c) for c in ("x", "y", "width", "height")))


@query(
    f"{WITH}, g AS (SELECT page_id, tag, coalesce(text, '') AS t, coalesce(aria_label, '') AS a, coalesce(placeholder, '') AS p, count(*) FILTER (coalesce(enabled, true) AND visible) AS n FROM el GROUP BY ALL) SELECT page_id, CASE WHEN max(CASE WHEN tag IN ('button', 'input', 'a') THEN n END) >= 3 THEN 'alike' ELSE 'default' END AS reason FROM g GROUP BY page_id"
)
def grounding_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.grounding_needed(elements(spark, sf_dir), F.lit("fill the form"))


@query(
    f"{WITH}, fr AS (SELECT *, ord % 4 AS frame_id FROM el) SELECT page_id, ord, CASE WHEN frame_id = 0 THEN id ELSE 'f' || frame_id || '_' || id END AS id, CASE WHEN frame_id = 0 THEN x ELSE x + frame_id * 100 END AS x, CASE WHEN frame_id = 0 THEN y ELSE y + 50 END AS y FROM fr WHERE frame_id < 3"
)
def merged_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of three frames, the last of which has no known place."""
    own = elements(spark, sf_dir).withColumn("frame_id", C("ord") % 4)
    places = own.select("page_id").distinct().select("page_id", F.explode(F.array(*(F.lit(n).cast("long") for n in (1, 2, 3)))).alias("frame_id"))
    places = places.withColumn("dx", F.when(C("frame_id") < 3, (C("frame_id") * 100).cast("double"))).withColumn("dy", F.when(C("frame_id") < 3, F.lit(50.0)))
    return E.merged_frames(own, places).select("page_id", "ord", "id", "x", "y")


@query(f"WITH {ITEMS} SELECT page_id, ord % 4 AS frame_id, 'CROSS_ORIGIN_FRAME_CONTENT' AS type, 0.6::DOUBLE AS confidence, count(*) AS n_items FROM it WHERE ord % 4 = 3 GROUP BY ALL")
def hidden_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = items(spark, sf_dir).withColumn("frame_id", C("ord") % 4)
    places = found.select("page_id", "frame_id").distinct().withColumn("dx", F.when(C("frame_id") < 3, 0.0))
    return E.hidden_frames(found, places)


@query(f"{WITH}, s AS (SELECT *, ord // 50 AS screen FROM el) SELECT count(*) AS kept FROM (SELECT 1 FROM s GROUP BY page_id, type, round(x / 60), round(y / 60), round(width / 60), round(height / 60))")
def across_screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = elements(spark, sf_dir).withColumn("screen", F.floor(C("ord") / 50))
    return E.across_screens(rows, 60).agg(F.count(F.lit(1)).alias("kept"))


@query(f"{WITH} SELECT page_id, ord, strlen(j) AS chars, len(list_filter(regexp_split_to_array(j, '[\\s,{{}}\\[\\]:\"]+'), lambda t: t <> '')) AS tokens FROM (SELECT page_id, ord, '{{\"id\":\"' || id || '\",\"type\":\"' || type || '\"' || CASE WHEN form_id IS NOT NULL THEN ',\"form_id\":\"' || form_id || '\"' ELSE '' END || '}}' AS j FROM el)")
def compact_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements as JSON without empty fields, and how long that is."""
    rows = E.compact_json(elements(spark, sf_dir), "id", "type", "form_id").withColumn("s", E.payload_size(C("json")))
    return rows.select("page_id", "ord", "s.chars", "s.tokens")


QUESTIONS = "(SELECT conv_id, turn, trim(coalesce(text, '')) AS t FROM conversations)"


@query(
    "SELECT conv_id, turn, t <> '' AND NOT regexp_matches(t, " + text("(?i)" + E.DOING) + ") AND (" + " OR ".join(f"regexp_matches(t, {text('(?i)' + p)})" for p in E.ASKING) + ") AS question, (" + " OR ".join(f"regexp_matches(t, {text('(?i)' + p)})" for p in E.FILLING) + f") AS filling FROM {QUESTIONS}"
)
def task_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which turns ask about a page, and which for a form to be filled."""
    t = C("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", E.page_question(t).alias("question"), E.form_filling(t).alias("filling"))


# Parsed pages ------------------------------------------------------------------------------------


@query(
    "SELECT page_id, CAST(len(regexp_extract_all(h, '(?is)<a\\s[^>]*href')) AS BIGINT) AS links, CAST(len(regexp_extract_all(h, '(?i)<(nav|article|header|main|aside|footer|section|form)\\b')) AS BIGINT) AS landmarks, CAST(len(regexp_extract_all(h, '(?i)<table\\b')) AS BIGINT) AS tables, CAST(len(regexp_extract_all(h, '(?i)<(pre|code)\\b')) AS BIGINT) AS code, CAST(len(regexp_extract_all(h, '(?i)<i?frame\\b')) AS BIGINT) AS frames, CAST(len(regexp_extract_all(h, '(?i)<(img|canvas)\\b')) AS BIGINT) AS images "
    "FROM (SELECT page_id, regexp_replace(coalesce(html, ''), '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', ' ', 'g') AS h FROM pages)"
)
def page_item_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page parsed into links, landmarks, tables, code, frames and images, counted."""
    p = table(spark, sf_dir, "pages")
    n = parsed.page_items(p).groupBy("page_id").agg(*(F.count_if(c).alias(name) for name, c in (("links", (C("kind") == "element") & (C("tag") == "a")), *((f"{k}s" if k != "code" else k, C("kind") == k) for k in ("landmark", "table", "code", "frame", "image")))))
    return p.select("page_id").join(n, "page_id", "left").fillna(0)


@query()
def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interactive elements of every page with types, labels, selectors and roles."""
    return parsed.interactive(parsed.page_items(table(spark, sf_dir, "pages"))).withColumn("semantic_role", role())


_TABLES = "html || '<table><tr><th>a</th></tr>' || repeat('<tr><td>x</td></tr>', (page_id % 4)::INTEGER) || '</table>' || CASE WHEN page_id % 3 = 0 THEN '<TABLE></TABLE>' ELSE '' END"


@query(f"SELECT page_id, k - 1 AS ord, CAST(greatest(0, len(regexp_extract_all(t, '(?i)<tr\\b')) - 1) AS INTEGER) AS n_rows FROM (SELECT page_id, unnest(l) AS t, generate_subscripts(l, 1) AS k FROM (SELECT page_id, regexp_extract_all({_TABLES}, '(?is)<table\\b.*?</table>') AS l FROM pages)) WHERE k <= 5")
def page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five tables of every page, one or two of them added, with their rows less the head."""
    from pyspark.sql import Window

    more = F.concat(F.lit("<table><tr><th>a</th></tr>"), F.repeat(F.lit("<tr><td>x</td></tr>"), (C("page_id") % 4).cast("int")), F.lit("</table>"), F.when(C("page_id") % 3 == 0, "<TABLE></TABLE>").otherwise(""))
    p = table(spark, sf_dir, "pages").withColumn("html", F.concat("html", more))
    rows = parsed.of_kind(parsed.page_items(p), "table", "n", most=5)
    return rows.select("page_id", (F.row_number().over(Window.partitionBy("page_id").orderBy("ord")) - 1).cast("long").alias("ord"), C("n").alias("n_rows"))


@query(
    f"{WITH}, r AS (SELECT page_id * 3 + ord % 3 AS p, ord, {ROLE_SQL} AS natural_role FROM el), k AS (SELECT p, CASE p % 6 WHEN 1 THEN CASE WHEN ord % 9 = 0 THEN 'search_input' ELSE 'content_link' END WHEN 2 THEN 'content_link' WHEN 3 THEN 'action_button' ELSE natural_role END AS role FROM r), "
    "n AS (SELECT p, count(*) FILTER (role IN ('form_field', 'dropdown', 'checkbox', 'radio_button')) AS f, count(*) FILTER (role IN ('search_input', 'search_button')) AS s, count(*) FILTER (role IN ('content_link', 'navigation_link')) AS l FROM k GROUP BY p) "
    "SELECT p AS page, CASE WHEN p % 11 = 0 THEN 'dialog' WHEN f >= 3 THEN 'form' WHEN s > 0 AND l > 5 THEN 'search' WHEN p % 5 = 0 THEN 'data' WHEN p % 4 = 0 THEN 'article' WHEN l > 15 THEN 'navigation' ELSE 'mixed' END AS page_type FROM n"
)
def page_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven types of pages, from the roles of a third of each user's elements; some pages hold links or buttons only."""
    p = C("page_id") * 3 + C("ord") % 3
    r = F.when(C("page") % 6 == 1, F.when(C("ord") % 9 == 0, "search_input").otherwise("content_link")).when(C("page") % 6 == 2, "content_link").when(C("page") % 6 == 3, "action_button").otherwise(role())
    rows = elements(spark, sf_dir).withColumn("page", p).withColumn("r", r)
    facts = rows.select("page").distinct().select("page", (C("page") % 5 == 0).alias("has_table"), (C("page") % 4 == 0).alias("has_article"), (C("page") % 11 == 0).alias("modal_open"))
    return steps.page_types(rows, "page", "r", facts)


@query("SELECT page_id, url, regexp_matches(url, '^(https?|file):') AS readable FROM pages")
def readable_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", E.readable(C("url")).alias("readable"))


@query()
def page_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page in a sentence: its kind, its fields, its regions."""
    p = table(spark, sf_dir, "pages")
    found = parsed.page_items(p)
    facts = found.groupBy("page_id").agg(
        F.max((C("kind") == "table").cast("int")).alias("t"), F.max(((C("kind") == "landmark") & (C("type") == "article")).cast("int")).alias("a"), F.max(F.when(C("kind") == "modal", F.coalesce("text", F.lit("")))).alias("modal"),
        F.count_if(C("kind") == "alert").cast("int").alias("alerts"), F.array_sort(F.collect_set(F.when(C("kind") == "landmark", C("type")))).alias("regions"),
    )
    own = parsed.interactive(found).withColumn("r", role())
    kinds = steps.page_types(own, "page_id", "r", p.select("page_id").join(facts, "page_id", "left").select("page_id", (C("t") == 1).alias("has_table"), (C("a") == 1).alias("has_article"), C("modal").isNotNull().alias("modal_open")))
    n = own.groupBy("page_id").agg(F.count_if(C("r").isin("form_field", "dropdown")).cast("int").alias("fields"), F.count_if(C("r").isin("form_field", "dropdown") & C("has_value")).cast("int").alias("filled"))
    rows = kinds.join(facts, "page_id", "left").join(n, "page_id", "left").fillna(0, ["fields", "filled", "alerts"])
    return rows.select("page_id", "page_type", E.context_sentence(C("page_type"), C("fields"), C("filled"), C("regions"), C("modal"), C("alerts")).alias("summary"))
