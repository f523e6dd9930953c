"""Queries about what is said of pages and steps: confidence, coverage, differences, prompts, targets, packs, requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import detect
from ..operators import boxes, decisions, fields, stores
from ..operators import elements as E
from ..operators import reports as R
from ..operators import tasks
from .agents import _STORE, ORDER, writes
from .made import ELEMENTS, HISTORY, ITEMS, elements, history, items
from .registry import query, table
from .screens import CLEAN, FIRST, FORM_INPUT, MARKS, POPULATED, ROLE_SQL, TASK, role

C = F.col
URL = "CASE seq % 4 WHEN 0 THEN 'https://shop.example.org/a' WHEN 1 THEN 'http://my-login-page.example.xyz/b' WHEN 2 THEN 'file:///x' END"


@query(
    f"WITH {HISTORY}, {ITEMS}, ev AS (SELECT page_id, element_id, avg(confidence) AS s, bool_or(type IN ('CARD', 'PAN')) AS grave, count(type) AS n FROM it WHERE element_id IS NOT NULL GROUP BY ALL), "
    "f AS (SELECT seq, least(1, (seq % 13) / 10) AS f1, s AS f2, [0.9, 0.4, 0.6, NULL][1 + seq % 4] AS f3, [0.85, 0.25, NULL, NULL][1 + seq % 4] AS f4, CASE seq % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.35 END AS f5, CASE WHEN n > 0 THEN CASE WHEN grave THEN 0.55 ELSE 0.85 END END AS f6, CASE WHEN seq % 5 > 0 THEN 0.5 + (seq % 5) / 10 END AS f7 FROM hi LEFT JOIN ev USING (page_id, element_id)), "
    "l AS (SELECT seq, list_filter([f1, f2, f3, f4, f5, f6, f7]::DOUBLE[], lambda x: x IS NOT NULL) AS v, list_filter([CASE WHEN f1 < 0.5 THEN 'modelSelfConfidence' END, CASE WHEN f3 < 0.5 THEN 'httpsScore' END, CASE WHEN f4 < 0.5 THEN 'domainReputation' END, CASE WHEN f5 < 0.5 THEN 'destinationSafety' END], lambda x: x IS NOT NULL) AS weak FROM f) "
    "SELECT seq, round(exp(list_sum(list_transform(v, lambda x: ln(greatest(0.0001, x)))) / len(v)), 3) AS confidence, array_to_string(weak, ',') AS vulnerabilities FROM l"
)
def confidence_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven factors of every step, their mean, and the weak ones."""
    s = C("seq")
    steps = history(spark, sf_dir).select("seq", "page_id", "element_id", F.expr(URL).alias("url"))
    out = R.scored(steps, items(spark, sf_dir), F.when(s % 5 > 0, 0.5 + (s % 5) / 10), (s % 13) / 10, C("url"), F.when(s % 3 == 1, "PAYMENT"), s % 3 < 2)
    return out.select("seq", "confidence", F.concat_ws(",", "vulnerabilities").alias("vulnerabilities"))


@query("SELECT event_type, count(*) AS n, count(a) AS answered, count(*) FILTER (a = event_type) AS right, round(count(a) / count(*), 6) AS coverage, round(CASE WHEN count(a) > 0 THEN count(*) FILTER (a = event_type) / count(a) ELSE 1 END, 6)::DOUBLE AS precision FROM (SELECT event_type, CASE WHEN value < 5 THEN 'click' WHEN value < 20 THEN event_type END AS a FROM events) GROUP BY event_type")
def answer_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a guess by value answers, and how often rightly, by type of event."""
    rows = table(spark, sf_dir, "events").withColumn("a", F.when(C("value") < 5, "click").when(C("value") < 20, C("event_type")))
    out = R.coverage(rows, "event_type", "a", "event_type")
    return out.withColumn("coverage", F.round("coverage", 6)).withColumn("precision", F.round("precision", 6))


@query("SELECT count(*) AS total, count(*) FILTER (l <> 'CLOUD') AS without_cloud, CAST(floor(count(*) FILTER (l <> 'CLOUD') / count(*) * 100 + 0.5) AS BIGINT) AS percent FROM (SELECT CASE event_id % 3 WHEN 0 THEN 'CLOUD' WHEN 1 THEN 'TREE' ELSE 'HEURISTIC' END AS l FROM events)")
def routing_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = C("event_id") % 3
    return R.routing_share(table(spark, sf_dir, "events").withColumn("layer", F.when(e == 0, "CLOUD").when(e == 1, "TREE").otherwise("HEURISTIC")), "layer")


_SIDE = "(SELECT page_id, id, arg_min(type, ord) AS type, arg_min({{'t': text}}, ord).t AS text, arg_min(coalesce(has_value, false), ord) AS hv, arg_min(coalesce(enabled, true), ord) AS en, arg_min(visible, ord) AS vi FROM el WHERE {} GROUP BY ALL)"
_NAME = "coalesce(nullif({0}.text, ''), {0}.type)"


@query(
    f"WITH {ELEMENTS}, d AS (SELECT coalesce(a.page_id, b.page_id) AS page_id, coalesce(a.id, b.id) AS id, a.id IS NULL AS added, b.id IS NULL AS removed, CASE WHEN a.id IS NULL THEN {_NAME.format('b')} WHEN b.id IS NULL THEN {_NAME.format('a')} END AS name, "
    "concat_ws(', ', CASE WHEN a.hv <> b.hv THEN CASE WHEN b.hv THEN 'populated' ELSE 'emptied' END END, CASE WHEN a.en <> b.en THEN CASE WHEN b.en THEN 'enabled' ELSE 'disabled' END END, CASE WHEN a.vi <> b.vi THEN CASE WHEN b.vi THEN 'visible' ELSE 'hidden' END END) AS moved "
    f"FROM {_SIDE.format('ord % 2 = 0')} a FULL JOIN {_SIDE.format('ord % 2 = 1')} b ON a.page_id = b.page_id AND a.id = b.id), "
    "k AS (SELECT page_id, id, CASE WHEN added THEN 'added' WHEN removed THEN 'removed' ELSE 'changed' END AS kind, CASE WHEN added OR removed THEN name ELSE id || ' became ' || moved END AS said FROM d WHERE added OR removed OR moved <> '' QUALIFY row_number() OVER (PARTITION BY page_id, kind ORDER BY id) <= CASE WHEN kind = 'changed' THEN 15 ELSE 10 END) "
    "SELECT page_id, coalesce(string_agg(said, '|' ORDER BY id) FILTER (kind = 'added'), '') AS added, coalesce(string_agg(said, '|' ORDER BY id) FILTER (kind = 'removed'), '') AS removed, coalesce(string_agg(said, '|' ORDER BY id) FILTER (kind = 'changed'), '') AS changed FROM k GROUP BY page_id"
)
def state_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's even elements against its odd ones: what appeared, went and changed, with the limits."""
    e = elements(spark, sf_dir)
    out = R.state_diff(e.filter("ord % 2 = 0"), e.filter("ord % 2 = 1"))
    return out.filter("has_changes").select("page_id", *(F.concat_ws("|", c).alias(c) for c in ("added", "removed", "changed")))


_LABEL = "coalesce(nullif(left(trim(regexp_replace(coalesce({0}, ''), '\\s+', ' ', 'g')), 60), ''), {1})"


@query(
    f"WITH {ELEMENTS}, r AS (SELECT *, CASE WHEN {FORM_INPUT} AND type NOT IN ('input:submit', 'input:checkbox', 'input:radio') AND NOT {POPULATED} THEN 'empty-field' WHEN type = 'input:submit' OR (type IN ('button', 'role:button') AND regexp_matches(coalesce(nullif(aria_label, ''), text), '(?i)\\b(submit|pay|apply|continue|next|finish|finali[sz]e|register|sign ?up|confirm|place order|send)\\b')) THEN 'submit' END AS kind "
    "FROM el WHERE id <> 'e5' AND coalesce(enabled, true) AND visible AND NOT (y >= 0 AND y + height <= 768)) "
    f"SELECT page_id, kind, arg_min(id, ord) AS id, arg_min({_LABEL.format('aria_label', _LABEL.format('text', _LABEL.format('placeholder', 'id')))}, ord) AS label, count(*) AS remaining FROM r WHERE kind IS NOT NULL GROUP BY ALL"
)
def next_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first empty field below the fold and the first button that sends; e5 was there before."""
    e = elements(spark, sf_dir)
    return R.next_targets(e, e.filter("id = 'e5'"), 768.0)


@query(f"WITH {ELEMENTS} SELECT page_id, arg_min(id, ord) AS id FROM el WHERE visible AND type = 'input:submit' GROUP BY page_id")
def visible_submit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.submit_of(elements(spark, sf_dir), F.when(C("type") == "input:submit", "SUBMIT"))


@query("SELECT user_id AS page_id, s AS screen, greatest(0, least(s * 600, h - 600))::DOUBLE AS y FROM (SELECT user_id, h, unnest(range(0, greatest(1, ceil(h / 600)::BIGINT)))::INTEGER AS s FROM (SELECT user_id, max(value) * 40 AS h FROM events WHERE user_id IS NOT NULL GROUP BY user_id))")
def page_screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "events").filter("user_id is not null").groupBy(C("user_id").alias("page_id")).agg((F.max("value") * 40).alias("h"))
    return R.screens(p, C("h"), F.lit(600))


@query(
    f"WITH {ELEMENTS} SELECT page_id, ord, '- selector=\"' || coalesce(selector, '') || '\" tag=' || tag || ' label=\"' || coalesce(nullif(text, ''), nullif(aria_label, ''), nullif(placeholder, ''), '(unlabeled)') || '\"' || CASE WHEN m <> '' THEN ' [' || m || ']' ELSE '' END AS line FROM "
    "(SELECT *, concat_ws(',', CASE WHEN sensitive THEN 'SENSITIVE' END, CASE WHEN has_value THEN 'FILLED' END, CASE WHEN NOT enabled THEN 'DISABLED' END) AS m FROM el)"
)
def prompt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every element as a line of a prompt."""
    e = elements(spark, sf_dir)
    return e.select("page_id", "ord", R.element_line(F.struct("selector", "tag", "type", "text", "aria_label", "placeholder", "sensitive", "has_value", "enabled")).alias("line"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'not JSON' WHEN 1 THEN 'missing author' WHEN 2 THEN 'missing entries.city' WHEN 3 THEN 'missing entries.name.label,odd langTag' ELSE '' END AS errors FROM events")
def language_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs of five kinds, four of them with faults."""
    k = C("event_id") % 5
    lang = F.when(k == 3, "english").otherwise("en-GB")
    name = F.when(k == 3, '{"label": " "}').otherwise('{"label": "Name"}')
    author = F.when(k == 1, "").otherwise('"author": "x", ')
    city = F.when(k == 2, "").otherwise(', "city": {"label": "City"}')
    pack = F.when(k == 0, "{").otherwise(F.concat(F.lit('{"langTag": "'), lang, F.lit('", '), author, F.lit('"entries": {"name": '), name, city, F.lit("}}")))
    return table(spark, sf_dir, "events").select("event_id", F.concat_ws(",", R.pack_errors(pack, ["langTag", "author"], ["name", "city"], ["label"])).alias("errors"))


@query("SELECT reason, count(*) AS n FROM (SELECT CASE event_id % 4 WHEN 0 THEN 'not JSON' WHEN 1 THEN 'taskInstruction' WHEN 2 THEN 'domSkeleton.elements' ELSE 'ok ' || event_id % 3 END AS reason FROM events) GROUP BY reason")
def request_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests accepted, by their elements, and rejected, by reason."""
    e = C("event_id")
    task = F.when(e % 4 == 1, "").otherwise('"taskInstruction": "x", ')
    own = F.when(e % 3 == 0, "").when(e % 3 == 1, "{}").otherwise("{}, {}")
    skeleton = F.when(e % 4 == 2, '"domSkeleton": {}').otherwise(F.concat(F.lit('"domSkeleton": {"elements": ['), own, F.lit("]}")))
    body = F.when(e % 4 == 0, "{oops").otherwise(F.concat(F.lit('{"sessionId": "s", '), task, skeleton, F.lit("}")))
    good, bad = R.requests(table(spark, sf_dir, "events").withColumn("body", body), "body")
    said = good.select(F.concat(F.lit("ok "), C("n_elements").cast("string")).alias("reason")).unionByName(bad.select("reason"))
    return said.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ELEMENTS}, {ITEMS} SELECT e.page_id, e.ord, i.type, i.confidence FROM (SELECT * FROM el QUALIFY row_number() OVER (PARTITION BY page_id, id ORDER BY ord) = 1) e JOIN it i ON i.page_id = e.page_id AND i.element_id = e.id")
def items_on_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings joined to the elements they are on, the first of an id."""
    first = elements(spark, sf_dir).groupBy("page_id", C("id").alias("element_id")).agg(F.min("ord").alias("ord"))
    return items(spark, sf_dir).drop("ord").join(first, ["page_id", "element_id"]).select("page_id", "ord", "type", "confidence")


@query(f"WITH {ELEMENTS} SELECT label, count(*) AS n FROM (SELECT coalesce(nullif(trim({CLEAN.format(chr(123) + '0' + chr(125))}), ''), 'this element') AS label FROM (SELECT coalesce(nullif(trim(text), ''), nullif(trim(aria_label), ''), nullif(trim(placeholder), '')) AS first FROM el)) GROUP BY label".replace("{0}", "first"))
def shown_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every element is called where a user reads it, addresses and long numbers masked."""
    return elements(spark, sf_dir).groupBy(R.shown_label(C("text"), C("aria_label"), C("placeholder")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


_CLASS = "CASE WHEN text IN ('Delete account') THEN 'DELETE' WHEN text = 'Submit order' OR type = 'input:submit' THEN 'SUBMIT' END"


def _action(name: str = "type"):
    """The class by text and type alone; words that only move about the page, such as view or previous, make it harmless."""
    e = F.lit("")
    return fields.action_class(C("text"), e, e, C("type"), e, e, e)[name]


@query(f"WITH {ELEMENTS} SELECT page_id, CASE WHEN id IS NULL THEN 'done' ELSE 'notify_submit' END AS next, id AS element_id FROM (SELECT DISTINCT page_id FROM el) p LEFT JOIN (SELECT page_id, id FROM (SELECT *, {_CLASS} AS k FROM el) WHERE visible AND k IS NOT NULL AND NOT regexp_matches(coalesce(text, ''), '(?i)\\b(view|details|previous)\\b') QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY ord) = 1) USING (page_id)")
def completion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first visible element of each page with consequences."""
    return decisions.completion_gate(elements(spark, sf_dir), _action())


@query(f"WITH {ELEMENTS}, {HISTORY}, a AS (SELECT page_id, id, arg_min({{'k': CASE WHEN regexp_matches(coalesce(text, ''), '(?i)\\b(view|details|previous)\\b') THEN NULL ELSE {_CLASS} END}}, ord).k AS k FROM el GROUP BY ALL) SELECT coalesce(k, 'none') AS consequence, count(*) AS n FROM hi LEFT JOIN a ON a.page_id = hi.page_id AND a.id = hi.element_id GROUP BY 1")
def consequence_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the steps' elements would set off, counted."""
    rows = decisions.annotated(history(spark, sf_dir), elements(spark, sf_dir), _action())
    return rows.groupBy(F.coalesce("consequence", F.lit("none")).alias("consequence")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH {ELEMENTS}, {_STORE}, n(key, cand, k) AS (VALUES ('phone', 'phone', 0), ('phone', 'mobile', 1), ('city', 'city', 0), ('email', 'email', 0)), o AS (SELECT *, CASE placeholder WHEN 'City' THEN 'city' WHEN 'Phone number' THEN 'phone' WHEN 'Enter your email' THEN 'email' END AS key FROM el WHERE {FORM_INPUT} AND NOT {POPULATED}) "
    "SELECT o.page_id, o.ord, o.key, arg_min(n.cand, n.k) AS found_key FROM o JOIN n ON n.key = o.key JOIN st ON st.owner = o.page_id AND st.key = n.cand AND trim(st.value) <> '' GROUP BY ALL"
)
def fast_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty fields that each user's store can fill without asking anybody."""
    key = F.when(C("placeholder") == "City", "city").when(C("placeholder") == "Phone number", "phone").when(C("placeholder") == "Enter your email", "email")
    return decisions.fast_path(elements(spark, sf_dir), key, stores.store_state(writes(spark, sf_dir), F.struct(*ORDER))).select("page_id", "ord", "key", "found_key")


@query(
    f"WITH {ELEMENTS} SELECT page_id, ord, s - 1 AS start, round(x + width * (s - 1) / length(text), 6) AS x, round(width * 15 / length(text), 6) AS width FROM (SELECT *, instr(text, 'joe@example.org') AS s FROM el) WHERE s > 0 AND y + height > 0 AND y < 768 AND x + width * (s - 1) / length(text) < 1024"
)
def positioned_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail addresses in the elements' texts with their own boxes, as far as they lie in view."""
    rows = elements(spark, sf_dir).withColumn("e", F.explode(detect.candidates(E.said(C("text")), detect.BY_TYPE["EMAIL"])))
    boxed = rows.withColumn("b", E.match_box(F.length("text"), C("e.start"), C("e.end"))).filter(boxes.in_view(C("b.x"), C("b.y"), C("b.width"), C("b.height"), F.lit(1024), F.lit(768)))
    return boxed.select("page_id", "ord", C("e.start").cast("long").alias("start"), F.round("b.x", 6).alias("x"), F.round("b.width", 6).alias("width"))


@query(f"WITH {ELEMENTS}, v AS (SELECT {CLEAN.format(FIRST)} AS label, {ROLE_SQL} AS role FROM el) SELECT role, count(*) AS n, count(label) AS labelled FROM v GROUP BY role")
def semantic_roles_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The semantic view with room for all elements, counted by role."""
    own = elements(spark, sf_dir)
    marks = spark.createDataFrame(MARKS, "ord int, role string, x double, y double, width double, height double")
    view = E.semantic_view(own, own.select("page_id").distinct().join(F.broadcast(marks)), F.lit(TASK), role(), 10**9, 0)
    return view.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("labelled"))


@query(f"WITH {ELEMENTS} SELECT inferred_label, painted, count(*) AS n FROM (SELECT CASE WHEN trim(coalesce(text, '')) || trim(coalesce(aria_label, '')) || trim(coalesce(placeholder, '')) = '' THEN CASE id[-1] WHEN '1' THEN 'menu' WHEN '2' THEN 'icon' END END AS inferred_label, id[-1] <> '7' AS painted FROM el) GROUP BY ALL")
def icon_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of nameless elements from what their icons show, and what isn't painted."""
    own = elements(spark, sf_dir)
    last = F.right(C("id"), F.lit(1))
    icons = own.select("page_id", "id", F.lit("menu").alias("label"), F.when(last == "1", 0.9).otherwise(0.3).alias("confidence"), last.isin("1", "2").alias("looks"))
    out = E.without_unpainted(E.with_icons(own, icons), own.filter(last == "7"))
    return out.groupBy("inferred_label", "painted").agg(F.count(F.lit(1)).alias("n"))


VERBS = ["open", "search for red & blue shoes on", "look for", "visit", "tell me about", "find cheap pens on", "go to", "read"]
PLACES = ["GitHub", "google", "Amazon", "hacker news", "stack  overflow", "mdn", "x.com", "https://a.example/p?q=1", "example.dev/x now", "nowhere", "wikipedia please", "YouTube"]
_TASK = "[" + ", ".join(f"'{v}'" for v in VERBS) + f"][1 + event_id % {len(VERBS)}] || ' ' || [" + ", ".join(f"'{p}'" for p in PLACES) + f"][1 + event_id // {len(VERBS)} % {len(PLACES)}]"


@query(
    "SELECT task, url, count(*) AS n FROM (SELECT task, CASE WHEN contains(task, 'https://') THEN 'https://a.example/p?q=1' WHEN contains(task, 'example.dev') THEN 'https://example.dev/x' WHEN contains(task, 'x.com') THEN 'https://x.com' "
    "WHEN regexp_matches(task, '(?i)(search|look) +(for +)?.+ on +google') THEN 'https://www.google.com/search?q=' || url_encode(trim(regexp_extract(task, '(?i)(?:search|look) +(?:for +)?(.+?) +on +google', 1))) "
    "WHEN regexp_matches(task, '(?i)(search|look|find) +(for +)?.+ on +amazon') THEN 'https://www.amazon.com/s?k=' || url_encode(trim(regexp_extract(task, '(?i)(?:search|look|find) +(?:for +)?(.+?) +on +amazon', 1))) "
    "WHEN NOT (regexp_matches(task, '^(open|visit|go to) ') OR contains(task, ' on ')) THEN NULL WHEN contains(lower(task), 'google') THEN 'https://www.google.com' WHEN contains(lower(task), 'amazon') THEN 'https://www.amazon.com' WHEN contains(lower(task), 'github') AND (NOT contains(task, ' on ') OR contains(lower(task), 'on github')) THEN 'https://github.com' "
    "WHEN contains(task, 'wikipedia') THEN 'https://www.wikipedia.org' WHEN contains(task, 'YouTube') THEN 'https://www.youtube.com' WHEN contains(task, 'hacker') AND NOT contains(task, ' on ') THEN 'https://news.ycombinator.com' WHEN contains(task, 'stack') AND NOT contains(task, ' on ') THEN 'https://stackoverflow.com' WHEN contains(task, 'mdn') THEN 'https://developer.mozilla.org' END AS url "
    f"FROM (SELECT {_TASK} AS task FROM events)) GROUP BY ALL"
)
def task_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where tasks of eight verbs and twelve places go."""
    e = C("event_id")
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i % len(xs)).cast("int") + 1)
    task = F.concat(pick(VERBS, e), F.lit(" "), pick(PLACES, F.floor(e / len(VERBS))))
    return table(spark, sf_dir, "events").select(task.alias("task")).groupBy("task", tasks.destination(C("task")).alias("url")).agg(F.count(F.lit(1)).alias("n"))
