"""Queries about decisions, sessions and stores: validation, targets, translation, outcomes, memory, checkpoints, receipts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import decisions as D
from ..operators import fields, memory, sequences, steps, stores
from ..operators import elements as E
from .made import ELEMENTS, HISTORY, elements, history
from .registry import query, table, text, values
from .screens import FORM_INPUT, POPULATED

C = F.col
EVENTS = "(SELECT * FROM events WHERE user_id IS NOT NULL AND event_id IS NOT NULL AND ts IS NOT NULL)"
ORDER = ["ts", "event_id"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("user_id is not null and event_id is not null and ts is not null")


# Decisions -------------------------------------------------------------------------------------


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reasoner's answer for each step: fenced, with words around, with raw line ends, broken, without reasoning, obedient to the page."""
    q = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    kind = C("seq") % 7
    reason = F.when(kind == 5, "As the webpage instructed me").when(kind == 2, "first line\nsecond\tline").otherwise("It is the next step")
    target = F.when(C("target").isNull(), F.lit("null")).otherwise(q(C("target")))
    value = F.when(C("value").isNull(), F.lit("null")).otherwise(q(C("value")))
    rest = F.when(kind == 4, F.lit("")).otherwise(F.concat(F.lit(', "reasoning": '), q(reason)))
    body = F.concat(F.lit('{"action": '), q(C("action")), F.lit(', "targetSelector": '), target, F.lit(', "value": '), value, rest, F.lit(', "plan": {"a": {"b": 1}}}'))
    raw = F.when(kind == 0, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone."))).when(kind == 1, F.concat(F.lit("I think "), body, F.lit(" is right {really}."))).when(kind == 3, F.lit("I cannot say")).otherwise(body)
    return history(spark, sf_dir).select(C("seq").alias("decision_id"), "page_id", raw.alias("raw"))


_KEYS = "k AS (SELECT page_id, key, arg_min(sensitive, ord) AS risky, arg_min(id, ord) AS id FROM (SELECT page_id, unnest([nullif(trim(selector), ''), '#' || id, id]) AS key, ord, id, coalesce(sensitive, false) AS sensitive FROM el) WHERE key IS NOT NULL GROUP BY ALL)"
_KNOWN = ", ".join(text(a) for a in D.ACTIONS)
_TARGETED = ", ".join(text(a) for a in D.TARGETED)


@query(
    f"WITH {ELEMENTS}, {HISTORY}, {_KEYS} SELECT h.seq AS decision_id, CASE WHEN seq % 7 = 3 THEN {text(D.BAD_JSON)} WHEN seq % 7 = 4 OR action NOT IN ({_KNOWN}) THEN {text(D.BAD_SCHEMA)} WHEN seq % 7 = 5 THEN {text(D.OBEYED)} "
    f"WHEN action IN ('fill', 'type') AND value IS NOT NULL AND coalesce(k.risky, false) THEN {text(D.SENSITIVE)} WHEN CASE WHEN coalesce(target, '') = '' THEN action IN ({_TARGETED}) ELSE k.id IS NULL END THEN {text(D.NO_TARGET)} END AS reason FROM hi h LEFT JOIN k ON k.page_id = h.page_id AND k.key = trim(h.target)"
)
def action_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON extraction and repair, schema, obedience, sensitive fields and targets, for every step."""
    return D.validated(answers(spark, sf_dir), elements(spark, sf_dir)).select("decision_id", "reason")


@query(
    f"WITH {ELEMENTS}, {HISTORY}, t AS (SELECT seq, h.page_id, trim(h.target) AS t FROM hi h), c AS (SELECT seq, el.id, el.ord, CASE WHEN trim(selector) = t THEN 1 WHEN '#' || id = t THEN 2 WHEN id = t THEN 3 WHEN t LIKE '#%' AND contains(selector, t) THEN 4 WHEN ends_with(lower(trim(selector)), lower(t)) OR ends_with(lower(t), lower(trim(selector))) THEN 5 END AS tier FROM t JOIN el ON el.page_id = t.page_id AND t.t <> '') "
    "SELECT h.seq AS decision_id, b.id AS element_id, b.tier FROM hi h LEFT JOIN (SELECT seq, id, tier FROM c WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY seq ORDER BY tier, ord) = 1) b ON b.seq = h.seq"
)
def target_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selectors to elements in five tiers."""
    asked = history(spark, sf_dir).select(C("seq").alias("decision_id"), "page_id", "target")
    return D.resolved(asked, elements(spark, sf_dir)).select("decision_id", "element_id", "tier")


@query(f"WITH {ELEMENTS}, {HISTORY} SELECT DISTINCT page_id, target FROM hi WHERE target IS NOT NULL AND NOT EXISTS (SELECT 1 FROM el WHERE el.page_id = hi.page_id AND el.selector = hi.target)")
def stale_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.stale_targets(history(spark, sf_dir), elements(spark, sf_dir))


@query(
    f"WITH {ELEMENTS}, {HISTORY} SELECT page_id, ord, coalesce(nullif(text, ''), nullif(aria_label, ''), nullif(placeholder, ''), 'field_' || id) AS field_name FROM el WHERE {FORM_INPUT} AND {POPULATED} AND NOT EXISTS (SELECT 1 FROM hi WHERE hi.page_id = el.page_id AND action IN ('fill', 'fill_from_local') AND (hi.element_id = el.id OR (hi.target <> '' AND ends_with(el.selector, hi.target))))"
)
def filled_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.filled_by_user(elements(spark, sf_dir), history(spark, sf_dir)).select("page_id", "ord", "field_name")


_EXACT = "x AS (SELECT page_id, t, arg_min(id, (tier, ord)) AS id FROM (SELECT page_id, ord, id, unnest([{'t': nullif(trim(selector), ''), 'tier': 1}, {'t': '#' || id, 'tier': 2}, {'t': id, 'tier': 3}], recursive := true) FROM el) WHERE t IS NOT NULL GROUP BY ALL)"


@query(
    f"WITH {ELEMENTS}, {HISTORY}, {_EXACT}, f AS (SELECT page_id, id, arg_min({{'has_value': has_value, 'value': value, 'sensitive': sensitive, 'type': type}}, ord) AS e FROM el GROUP BY ALL), "
    "d AS (SELECT h.seq, h.action, h.target, h.value, x.id, f.e FROM hi h JOIN x ON x.page_id = h.page_id AND x.t = trim(h.target) LEFT JOIN f ON f.page_id = h.page_id AND f.id = x.id), "
    "s AS (SELECT *, coalesce(e.has_value, false) OR coalesce(e.value, '') NOT IN ('', 'unchecked', '[REDACTED]') AS filled, e.type = 'input:submit' AS submits FROM d) "
    "SELECT seq AS decision_id, CASE WHEN action = 'click' THEN CASE WHEN submits THEN 'notify_submit' ELSE 'click' END WHEN action IN ('fill', 'type') THEN CASE WHEN filled THEN 'skip_filled' WHEN e.sensitive THEN 'ask_user' ELSE 'fill' END WHEN action = 'fill_from_local' THEN CASE WHEN filled THEN 'skip_filled' ELSE 'ask_user' END "
    "WHEN action = 'select' AND e.value = value THEN 'wait' WHEN action IN ('check', 'uncheck') THEN 'check' WHEN action = 'radio' THEN 'click' WHEN action = 'upload' THEN 'ask_user' WHEN action = 'dance' THEN 'wait' ELSE action END AS does FROM s"
)
def action_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is done about each step whose target matches exactly; submits are recognised by type."""
    asked = history(spark, sf_dir).select(C("seq").alias("decision_id"), "page_id", "target", "action", "value")
    done = D.translated(asked, elements(spark, sf_dir), F.coalesce(C("e_type") == "input:submit", F.lit(False)))
    exact = D.resolved(asked, elements(spark, sf_dir)).filter("tier <= 3").select("decision_id")
    return done.join(exact, "decision_id", "left_semi").select("decision_id", "does")


@query(
    f"WITH {ELEMENTS} SELECT page_id, CASE WHEN id IS NULL THEN 'wait' WHEN held THEN 'fill_from_local' ELSE 'ask_user' END AS action, id AS element_id FROM (SELECT DISTINCT page_id FROM el) p LEFT JOIN (SELECT page_id, id, lower(placeholder) = 'city' AS held FROM el WHERE {FORM_INPUT} AND NOT {POPULATED} QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY ord) = 1) USING (page_id)"
)
def local_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.local_decision(elements(spark, sf_dir), F.when(F.lower("placeholder") == "city", "city"))


@query(
    f"WITH {HISTORY}, o AS (SELECT *, seq % 8 <> 0 AS ok, seq % 13 = 0 AS moved, seq % 3 = 0 AS sure, seq % 4 = 1 AS held, seq % 5 <> 0 AS scrolled FROM hi) SELECT found AS outcome, count(*) AS n, count(*) FILTER (found IN ('FAILED', 'NO_EFFECT', 'TARGET_DISAPPEARED')) AS replans FROM (SELECT "
    "CASE WHEN action = 'done' THEN 'TASK_COMPLETED' WHEN action IN ('ask_user', 'notify_submit') THEN 'USER_INTERVENTION_REQUIRED' WHEN action IN ('skip_filled', 'wait') THEN 'SUCCEEDED' WHEN NOT ok THEN CASE WHEN seq % 16 = 0 THEN 'TARGET_DISAPPEARED' ELSE 'FAILED' END WHEN moved THEN 'PAGE_CHANGED' "
    "WHEN action IN ('type', 'fill', 'fill_from_local') THEN CASE WHEN held OR sure THEN 'SUCCEEDED' ELSE 'NO_EFFECT' END WHEN action IN ('select', 'clear', 'check', 'focus') THEN CASE WHEN sure THEN 'SUCCEEDED' ELSE 'NO_EFFECT' END WHEN action IN ('navigate', 'back', 'forward') THEN 'PAGE_CHANGED' WHEN action = 'scroll' AND NOT scrolled THEN 'NO_EFFECT' ELSE 'SUCCEEDED' END AS found FROM o) GROUP BY found"
)
def action_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven outcomes of actions, from what was seen after them."""
    s = C("seq")
    o = D.outcome(C("action"), s % 8 != 0, F.when(s % 16 == 0, "element_not_found").otherwise("error"), s % 13 == 0, s % 3 == 0, s % 4 == 1, s % 5 != 0)
    return history(spark, sf_dir).select(o.alias("o")).groupBy("o.outcome").agg(F.count(F.lit(1)).alias("n"), F.count_if(C("o.replan")).alias("replans"))


@query(
    f"WITH {HISTORY}, p AS (SELECT page_id, bool_or(action NOT IN ('wait', 'replan') AND coalesce(success, true) AND coalesce(outcome, '') NOT IN ('FAILED', 'NO_EFFECT', 'TARGET_DISAPPEARED') AND (success IS NOT NULL OR outcome IS NOT NULL)) AS did, count(*) AS n FROM hi GROUP BY page_id), "
    "k AS (SELECT *, ['form', 'gather', 'navigate', 'general'][1 + page_id % 4] AS intent, n % 3 AS total, n % 2 AS empty, n % 5 AS gathered, CASE page_id % 3 WHEN 0 THEN 'no_change' WHEN 1 THEN 'partial_change' END AS verdict FROM p), "
    "g AS (SELECT *, CASE intent WHEN 'form' THEN total > 0 AND empty = 0 WHEN 'gather' THEN gathered > 0 ELSE true END AS s, intent = 'gather' OR verdict IS NULL OR verdict <> 'no_change' AS v FROM k) "
    "SELECT page_id, did AND s AND (intent = 'gather' OR v) AS verified, round((did::INT + s::INT + CASE WHEN intent = 'gather' THEN 0 ELSE v::INT END) / CASE WHEN intent = 'gather' THEN 2 ELSE 3 END, 6) AS confidence FROM g"
)
def task_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a session's declared completion holds."""
    did = D.productive(C("action"), C("success"), C("outcome"))
    p = history(spark, sf_dir).groupBy("page_id").agg(F.max(did).alias("did"), F.count(F.lit(1)).alias("n"))
    intent = F.element_at(F.array(*map(F.lit, ["form", "gather", "navigate", "general"])), (C("page_id") % 4).cast("int") + 1)
    verdict = F.when(C("page_id") % 3 == 0, "no_change").when(C("page_id") % 3 == 1, "partial_change")
    c = D.completion(intent, C("did"), F.lit(True), C("n") % 3, C("n") % 2, C("n") % 5, verdict, F.lit(False))
    return p.select("page_id", c["verified"].alias("verified"), F.round(c["confidence"], 6).alias("confidence"))


@query(
    "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN event_id % 11 = 0 THEN 'NAVIGATION_PROGRESS' WHEN event_id % 7 = 0 OR (s > 0 AND f AND m = 'complete') THEN 'USER_ATTENTION' WHEN t > 0 AND e = 0 THEN 'COMPLETION' WHEN t > 0 AND s = 0 AND m = 'complete' AND k > 0 THEN 'AUTOMATION_AVAILABLE' WHEN t > 0 AND s = 0 AND e > 0 THEN 'FORM_PROGRESS' WHEN t > 0 AND e > 0 AND s > 0 AND f THEN 'FORM_PROGRESS' END AS kind "
    "FROM (SELECT *, event_id % 3 AS s, event_id % 5 = 0 AS f, CASE WHEN event_id % 2 = 0 THEN 'complete' ELSE 'hitl' END AS m, event_id % 4 AS t, event_id % 4 // 2 AS e, event_id % 9 // 4 AS k FROM events)) GROUP BY kind"
)
def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = C("event_id")
    kind = D.suggestion(e % 11 == 0, e % 7 == 0, e % 5 == 0, F.when(e % 2 == 0, "complete").otherwise("hitl"), e % 3, e % 4, F.lit(0), F.floor(e % 4 / 2), F.floor(e % 9 / 4), F.lit(0))
    return table(spark, sf_dir, "events").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"SELECT event_id, CAST(least(steps, 4) AS BIGINT) AS at, d OR steps >= 4 AS complete FROM (SELECT event_id, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER w AS steps, max(event_type = 'signup' AND event_id % 50 = 0) OVER w AS d FROM {EVENTS} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"
)
def plan_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan of four subgoals: purchases advance it, some sign-ups end it."""
    event = F.when(C("event_type") == "purchase", "advance").when((C("event_type") == "signup") & (C("event_id") % 50 == 0), "done").otherwise("other")
    return D.plan_states(events(spark, sf_dir).withColumn("event", event), "user_id", ORDER, F.lit(4)).select("event_id", C("at").cast("long").alias("at"), "complete")


_WORDS = {
    "click": "'Clicking \"x\"'", "fill": "'Typing into \"x\"'", "type": "'Typing into \"x\"'", "fill_from_local": "'Filling \"x\" from local private store'", "clear": "'Clearing input \"x\"'",
    "select": "'Selecting option \"' || v || '\" in dropdown \"x\"'", "check": "CASE WHEN v = 'false' THEN 'Unchecking \"x\"' ELSE 'Checking \"x\"' END", "press_key": "'Pressing key \"' || coalesce(nullif(v, ''), 'Enter') || '\" on \"x\"'",
    "scroll": "'Scrolling ' || coalesce(nullif(v, ''), 'down')", "navigate": "'Navigating to ' || v", "extract": "'Extracting content from page'", "wait": "'Waiting for the page to settle'",
}


@query(f"WITH {HISTORY} SELECT action, words, count(*) AS n FROM (SELECT action, CASE action {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {w}' for k, w in _WORDS.items())} ELSE 'Performing ' || action END || '…' AS words FROM (SELECT action, coalesce(value, '') AS v FROM hi)) GROUP BY ALL")
def action_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of the histories in words."""
    return history(spark, sf_dir).groupBy("action", D.described(C("action"), F.lit("x"), C("value")).alias("words")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ELEMENTS} SELECT page_id, ord, CASE WHEN w = '' THEN 0.6 ELSE least(1, 0.5 + least(0.5, 0.2 * len(list_filter(['please', 'pay', 'order', 'email'], lambda t: contains(w, t))))) END::DOUBLE AS score FROM (SELECT page_id, ord, trim(lower(concat_ws(' ', coalesce(text, ''), coalesce(aria_label, ''), coalesce(placeholder, '')))) AS w FROM el)")
def label_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements(spark, sf_dir).select("page_id", "ord", E.label_match(F.lit("Please pay my order by email"), C("text"), C("aria_label"), C("placeholder")).cast("double").alias("score"))


@query(
    f"WITH {ELEMENTS} SELECT key, count(*) AS n FROM (SELECT CASE WHEN type IN ('input:password', 'input:search') THEN NULL WHEN name = 'email' THEN 'email' WHEN name = 'zip' THEN 'zip' WHEN name = 'title' THEN 'occupation' WHEN type = 'input:email' THEN 'email' END AS key FROM (SELECT type, ['email', 'zip', 'title', 'q9'][1 + ord % 4] AS name FROM el)) GROUP BY key"
)
def field_by_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What fields ask for that only their selector names."""
    name = F.element_at(F.array(*map(F.lit, ["email", "zip", "title", "q9"])), (C("ord") % 4).cast("int") + 1)
    selector = F.when(C("ord") % 2 == 0, F.concat(F.lit("#"), name)).otherwise(F.concat(F.lit('input[name="'), name, F.lit('"]')))
    none = F.lit(None).cast("string")
    return elements(spark, sf_dir).groupBy(fields.field_key(C("type"), none, none, selector=selector).alias("key")).agg(F.count(F.lit(1)).alias("n"))


# Sessions ----------------------------------------------------------------------------------------

LOOP_CHANGED = "event_id % 3 = 0"


@query(
    "SELECT event_id, CASE WHEN act = 'navigate' AND starts_with(here, there) THEN 'NAVIGATION' WHEN still AND act = 'scroll' AND l1a = 'scroll' THEN 'STAGNANT_SCROLL' WHEN still AND sig = l1 AND sig = l2 THEN 'REPEAT' WHEN still AND sig = l2 AND l1 = l3 AND sig <> l1 THEN 'OSCILLATION' END AS loop FROM "
    "(SELECT *, lag(act) OVER w AS l1a, lag(sig) OVER w AS l1, lag(sig, 2) OVER w AS l2, lag(sig, 3) OVER w AS l3 FROM (SELECT *, act || ':' || (event_id % 2) AS sig, event_id % 3 <> 0 AS still, 'https://x.org/' || (event_id % 4) AS here, 'https://x.org/' || (event_id % 3) AS there FROM (SELECT *, CASE event_type WHEN 'view' THEN 'scroll' WHEN 'signup' THEN 'navigate' WHEN 'purchase' THEN 'wait' ELSE 'click' END AS act FROM "
    f"{EVENTS}) WHERE act <> 'wait') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"
)
def loop_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four loop rules over every event, with page changes and navigation targets."""
    e = C("event_id")
    act = F.when(C("event_type") == "view", "scroll").when(C("event_type") == "signup", "navigate").when(C("event_type") == "purchase", "wait").otherwise("click")
    rows = events(spark, sf_dir).withColumn("act", act)
    page = lambda n: F.concat(F.lit("https://x.org/"), (e % n).cast("string"))
    return sequences.loops(rows, "user_id", ORDER, "act", F.concat_ws(":", "act", (e % 2).cast("string")), e % 3 == 0, page(3), page(4)).select("event_id", "loop")


@query(
    f"WITH {HISTORY}, g AS (SELECT *, coalesce(outcome IN ('SUCCEEDED', 'PAGE_CHANGED', 'TASK_COMPLETED'), false) AS good FROM hi), r AS (SELECT *, sum(good::INT) OVER (PARTITION BY page_id ORDER BY seq) AS run FROM g) "
    "SELECT seq, count(*) OVER w AS attempted, CAST(sum(good::INT) OVER w AS BIGINT) AS succeeded, array_to_string(CASE WHEN good THEN [] ELSE list_slice(list(action || ':' || coalesce(outcome, 'UNKNOWN')) FILTER (NOT good) OVER (PARTITION BY page_id, run ORDER BY seq), -3, -1) END, ',') AS blockers FROM r WINDOW w AS (PARTITION BY page_id ORDER BY seq)"
)
def task_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts, successes and the last three blockers since a success."""
    rows = memory.counts(history(spark, sf_dir), "page_id", ["seq"], C("outcome"))
    out = memory.blockers(rows, "page_id", ["seq"], C("outcome"), F.concat_ws(":", "action", F.coalesce("outcome", F.lit("UNKNOWN"))))
    return out.select("seq", "attempted", "succeeded", F.concat_ws(",", "blockers").alias("blockers"))


@query(
    f"WITH {HISTORY}, l AS (SELECT seq, page_id, CASE WHEN seq % 3 = 0 THEN action || ':' || CASE WHEN seq % 2 = 0 THEN 'GRANTED' ELSE 'DENIED' END END AS line FROM hi) SELECT seq, coalesce(array_to_string(list_slice(list(line) FILTER (line IS NOT NULL) OVER (PARTITION BY page_id ORDER BY seq), -5, -1), ','), '') AS confirmations FROM l"
)
def confirmations_last5(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(C("seq") % 3 == 0, F.concat_ws(":", "action", F.when(C("seq") % 2 == 0, "GRANTED").otherwise("DENIED")))
    return memory.confirmations(history(spark, sf_dir), "page_id", ["seq"], line).select("seq", F.concat_ws(",", "confirmations").alias("confirmations"))


@query(f"SELECT event_id, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS latency_ms FROM {EVENTS}")
def step_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.step_latency(events(spark, sf_dir), "user_id", ORDER, "ts").select("event_id", "latency_ms")


@query(f"SELECT event_id, CAST(sum(b) OVER (PARTITION BY user_id, i ORDER BY ts, event_id) AS BIGINT) AS waits, sum(b) OVER (PARTITION BY user_id, i ORDER BY ts, event_id) > 3 AS gives_up FROM (SELECT *, sum(1 - b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM (SELECT *, CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END AS b FROM {EVENTS}))")
def visual_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.waits(events(spark, sf_dir), "user_id", ORDER, C("event_type").isin("view", "click")).select("event_id", "waits", "gives_up")


@query(f"SELECT event_id, CAST(n AS BIGINT) AS retries, event_type <> 'error' OR n > 2 AS accepted FROM (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM {EVENTS})")
def verification_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.retries(events(spark, sf_dir), "user_id", ORDER, C("event_type") == "error").select("event_id", "retries", "accepted")


@query(f"SELECT event_id FROM (SELECT event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM {EVENTS}) WHERE n IS NULL OR epoch_us(n) // 1000 - epoch_us(ts) // 1000 >= 3600000")
def debounced_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each burst of a user, an hour of quiet after it."""
    return memory.debounced(events(spark, sf_dir), "user_id", "ts", ["event_id"], 3_600_000).select("event_id")


_THROTTLE = "WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000 AS t, min(event_id) AS event_id FROM {0} WHERE {1} GROUP BY ALL), k AS (SELECT user_id, min(t) AS t FROM e GROUP BY user_id UNION ALL SELECT k.user_id, (SELECT min(e.t) FROM e WHERE e.user_id = k.user_id AND e.t - k.t > {2}) AS t FROM k WHERE k.t IS NOT NULL)"


@query(_THROTTLE.format(EVENTS, "event_type = 'view'", 86_400_000) + " SELECT e.event_id FROM k JOIN e USING (user_id, t)")
def throttled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of a user, one a day at most; of several in one millisecond the one of the least id."""
    return memory.throttled(events(spark, sf_dir).filter("event_type = 'view'"), "user_id", "ts", ["event_id"], 86_400_000).select("event_id")


@query(_THROTTLE.format(EVENTS, "event_type = 'error'", 86_400_000 - 1) + f" SELECT v.event_id, EXISTS (SELECT 1 FROM k WHERE k.user_id = v.user_id AND epoch_us(v.ts) // 1000 > k.t AND epoch_us(v.ts) // 1000 - k.t < 86400000) AS open FROM {EVENTS} v")
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that come within a day after an error that started a cooldown."""
    return memory.cooled_down(events(spark, sf_dir), "user_id", "ts", ["event_id"], C("event_type") == "error", 86_400_000).select("event_id", "open")


@query(f"SELECT event_id, CASE WHEN value < lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 'up' ELSE 'down' END AS direction FROM {EVENTS}")
def scroll_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.scroll_direction(events(spark, sf_dir), "user_id", ORDER, "value").select("event_id", "direction")


@query("WITH " + values("m", "event, state", list(steps.LIFECYCLE.items())) + " SELECT state, count(*) AS n FROM (SELECT list_sort((SELECT list(event) FROM m))[1 + event_id % 22] AS event FROM events) JOIN m USING (event) GROUP BY state")
def lifecycle_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, sorted(steps.LIFECYCLE))), (C("event_id") % len(steps.LIFECYCLE)).cast("int") + 1)
    return table(spark, sf_dir, "events").groupBy(steps.state_of(name).alias("state")).agg(F.count(F.lit(1)).alias("n"))


# Stores --------------------------------------------------------------------------------------------

KEYS = [" Full Name ", "PINCODE", "email", "mobile", "address", "dob", "", "city"]
_KEY_SQL = "['full name', 'pincode', 'email', 'mobile', 'address', 'dob', NULL, 'city'][1 + event_id % 8]"


def writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = C("event_id")
    op = F.when(e % 101 == 0, "clear").when(e % 5 == 0, "remove").otherwise("put")
    return events(spark, sf_dir).select(C("user_id").alias("owner"), op.alias("op"), F.element_at(F.array(*map(F.lit, KEYS)), (e % 8).cast("int") + 1).alias("key"), F.when(e % 9 == 0, "  ").otherwise(F.concat(F.lit("v"), e.cast("string"))).alias("value"), "ts", "event_id")


_STORE = f"w AS (SELECT user_id AS owner, CASE WHEN event_id % 101 = 0 THEN 'clear' WHEN event_id % 5 = 0 THEN 'remove' ELSE 'put' END AS op, {_KEY_SQL} AS key, CASE WHEN event_id % 9 = 0 THEN '  ' ELSE 'v' || event_id END AS value, ts, event_id FROM {EVENTS}), st AS (SELECT owner, key, value FROM (SELECT * FROM w WHERE op <> 'clear' AND key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY owner, key ORDER BY ts DESC, event_id DESC) = 1) l WHERE op = 'put' AND NOT EXISTS (SELECT 1 FROM w c WHERE c.owner = l.owner AND c.op = 'clear' AND (c.ts, c.event_id) >= (l.ts, l.event_id)))"


@query(f"WITH {_STORE} SELECT owner, key, value FROM st")
def key_value_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puts, removes and clears of every owner, the last winning."""
    return stores.store_state(writes(spark, sf_dir), F.struct("ts", "event_id"))


_ASKED = {"zip": ["zip", "pincode", "pin_code", "pin code", "postal_code", "postal code", "postcode", "zipcode", "zip_code", "zip code"], "name": ["name", "full_name", "full name", "fullname"], "home_address": ["home_address", "home address", "address", "residential_address", "residential address", "street_address", "street address"], "phone": ["phone", "mobile", "mobile_number", "mobile number", "phone_number", "phone number", "mobile_phone", "mobile phone"], "city": ["city"]}


@query(
    f"WITH {_STORE}, " + values("a", "key, cand, k", [(a, c, i) for a, cs in _ASKED.items() for i, c in enumerate(cs)]) + ", o AS (SELECT DISTINCT owner FROM w) SELECT o.owner, q.key, f.cand AS found_key, f.value FROM o CROSS JOIN (SELECT DISTINCT key FROM a) q LEFT JOIN (SELECT st.owner, a.key, a.cand, st.value FROM a JOIN st ON st.key = a.cand AND trim(st.value) <> '' QUALIFY row_number() OVER (PARTITION BY st.owner, a.key ORDER BY k) = 1) f ON f.owner = o.owner AND f.key = q.key"
)
def alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five keys of every owner by their aliases."""
    log = writes(spark, sf_dir)
    keys = F.explode(F.array(*map(F.lit, sorted(_ASKED)))).alias("key")
    asked = log.select("owner").distinct().select("owner", keys).withColumn("ask_id", F.concat_ws("/", C("owner").cast("string"), "key"))
    return stores.looked_up(asked, stores.store_state(log, F.struct("ts", "event_id"))).select("owner", "key", "found_key", "value")


_LOG = f"g AS (SELECT user_id AS task_id, CASE WHEN event_id % 40 = 0 THEN 'delete' ELSE 'save' END AS op, CASE WHEN event_id % 3 = 0 THEN 'task ' || event_id END AS label, ts, 's' || event_id AS snapshot, event_id FROM {EVENTS}), sv AS (SELECT g.* FROM g WHERE op = 'save' AND NOT EXISTS (SELECT 1 FROM g d WHERE d.task_id = g.task_id AND d.op = 'delete' AND (d.ts, d.event_id) >= (g.ts, g.event_id)))"


@query(f"WITH {_LOG} SELECT task_id, coalesce(arg_max(label, (ts, event_id)) FILTER (label IS NOT NULL), task_id::VARCHAR) AS label, min(ts) AS saved_at, max(ts) AS updated_at, arg_max(snapshot, (ts, event_id)) AS snapshot FROM sv GROUP BY task_id")
def checkpoint_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoints after saves and deletes."""
    e = C("event_id")
    log = events(spark, sf_dir).select(C("user_id").alias("task_id"), F.when(e % 40 == 0, "delete").otherwise("save").alias("op"), F.when(e % 3 == 0, F.concat(F.lit("task "), e.cast("string"))).alias("label"), "ts", F.concat(F.lit("s"), e.cast("string")).alias("snapshot"), "event_id")
    return stores.checkpoints(log, F.struct("ts", "event_id"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS place FROM events WHERE user_id IS NOT NULL")
def checkpoint_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as checkpoints, newest first."""
    saved = table(spark, sf_dir, "events").filter("user_id is not null").select("user_id", C("event_id").alias("task_id"), C("ts").alias("updated_at"), F.lit("x").alias("snapshot"))
    return stores.listed(saved, "user_id").select("user_id", C("task_id").alias("event_id"), C("place").cast("long").alias("place"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id % 7 END::INTEGER AS attempted, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS task, event_id % 5 <> 0 AND event_id % 2 = 0 AS complete, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 2 END::INTEGER AS pages FROM events")
def snapshot_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots written and read back, every fifth of them broken."""
    e = C("event_id")
    json = stores.snapshot(C("event_type").alias("task"), (e % 7).cast("int").alias("attemptedCount"), F.when(e % 2 == 0, True).alias("isVerifiedComplete"), F.array(F.lit("a"), F.lit("b")).alias("pagesVisited"))
    r = stores.restored(F.when(e % 5 == 0, "{broken").otherwise(json))
    return table(spark, sf_dir, "events").select("event_id", r["attemptedCount"].alias("attempted"), r["task"].alias("task"), r["isVerifiedComplete"].alias("complete"), F.size(r["pagesVisited"]).alias("pages"))


_TOTALS = {"stepsSent": "event_id % 2", "totalPiiMasked": "event_id % 5", "totalFaces": "event_id % 3", "totalIdImages": "event_id % 7", "zeroCloudSteps": "CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END", "localOnlySteps": "CASE WHEN event_id % 6 = 0 THEN 1 ELSE 0 END", "latencySumMs": "event_id % 1000", "latencyCount": "CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END"}
_ZERO = ["totalIdImagesOcrConfirmed", "totalBytes", "scanFailures", "zeroCloudFieldsFilled", "routerLocalSteps"]


def sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("owner", C("user_id"))
    return e.withColumns({n: F.expr(x) for n, x in _TOTALS.items()} | {n: F.lit(None).cast("long") for n in _ZERO})


@query("SELECT user_id AS owner, " + ", ".join(f"CAST(sum({x}) AS BIGINT) AS {n}" for n, x in _TOTALS.items()) + ", " + ", ".join(f"0::BIGINT AS {n}" for n in _ZERO) + " FROM events GROUP BY user_id")
def receipt_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirteen totals of a receipt by user."""
    return stores.receipts(sent(spark, sf_dir))


_R = ", ".join(f"sum({x})::DOUBLE AS {n}" for n, x in _TOTALS.items())


@query(f"SELECT owner, CAST(totalPiiMasked + totalFaces + totalIdImages AS BIGINT) AS detections, CAST(floor((zeroCloudSteps + localOnlySteps) / (stepsSent + zeroCloudSteps + localOnlySteps) * 100 + 0.5) AS BIGINT) AS zero_cloud_percent, round(latencySumMs / latencyCount / 1000, 2) AS mean_latency_s FROM (SELECT user_id AS owner, {_R} FROM events GROUP BY user_id)")
def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.dashboard(stores.receipts(sent(spark, sf_dir)))


@query("SELECT event_id, '{\"user\":{\"name\":\"[omitted-by-logger]\",\"id\":' || event_id || '},\"text\":\"[omitted-by-logger]\",\"ok\":true}' AS line FROM events")
def scrubbed_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log records without what dangerous keys hold, at any depth."""
    record = F.concat(F.lit('{"user":{"name":"'), C("event_type"), F.lit('","id":'), C("event_id").cast("string"), F.lit('},"text":"say \\"hi\\" to '), C("user_id").cast("string"), F.lit('","ok":true}'))
    return table(spark, sf_dir, "events").select("event_id", stores.scrubbed_json(record).alias("line"))


@query("SELECT conv_id, turn, coalesce(nullif(regexp_replace(left(regexp_replace(lower(trim(coalesce(text, ''))), '[^a-z0-9]+', '-', 'g'), 60), '^-+|-+$', '', 'g'), ''), 'task') AS slug FROM conversations")
def task_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", stores.task_slug(C("text")).alias("slug"))


@query(f"SELECT event_id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || 'm ago' WHEN h < 24 THEN h || 'h ago' ELSE floor(h / 24 + 0.5)::BIGINT || 'd ago' END AS ago FROM (SELECT event_id, m, floor(m / 60 + 0.5)::BIGINT AS h FROM (SELECT event_id, floor((epoch_ms((SELECT max(ts) FROM events)) - epoch_us(ts) // 1000) / 60000 + 0.5)::BIGINT AS m FROM {EVENTS}))")
def relative_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.join(F.broadcast(e.agg(F.max("ts").alias("now")))).select("event_id", stores.ago(C("ts"), C("now")).alias("ago"))


@query("SELECT mode, count(*) AS n FROM (SELECT CASE WHEN event_type IN ('cloud', 'local', 'debate') THEN event_type ELSE 'hybrid' END AS mode FROM events) GROUP BY mode")
def privacy_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(stores.mode(C("event_type")).alias("mode")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH {HISTORY}, l AS (SELECT seq, page_id, list({{'a': action, 'r': coalesce(outcome, 'success')}}) OVER (PARTITION BY page_id ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS h FROM hi) SELECT seq, array_to_string(list_transform(range(greatest(0, len(h) - 3), len(h)), lambda i: (i + 1) || ':' || h[i + 1].a || ':' || h[i + 1].r), ',') AS state FROM l"
)
def execution_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three of up to five entries, with their numbers."""
    from pyspark.sql import Window

    w = Window.partitionBy("page_id").orderBy("seq").rowsBetween(-4, 0)
    rows = history(spark, sf_dir).select("seq", F.collect_list(F.struct("action", "target", C("outcome").alias("result"))).over(w).alias("h"))
    last = F.transform(stores.execution_state(C("h")), lambda s: F.concat_ws(":", s["step"].cast("string"), s["action"], s["result"]))
    return rows.select("seq", F.concat_ws(",", last).alias("state"))


@query(f"WITH {HISTORY} SELECT action, CASE WHEN value IS NULL OR value IN ('', '[REDACTED]', '[FILLED_FROM_LOCAL]', '[ALREADY_POPULATED]') THEN value ELSE '[REDACTED]' END AS value, count(*) AS n FROM hi GROUP BY ALL")
def outbound_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories as they may be sent: values neutralised inside the payload's list."""
    items = stores.outbound_history(F.array(F.struct("action", "target", "value")))
    return history(spark, sf_dir).select(F.explode(items).alias("h")).groupBy("h.action", "h.value").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, round(1 / (1 + exp(-value / 10)), 9) AS p, list_transform([1.0, value / 100, 0.5], lambda x: round(exp(x) / (exp(1.0) + exp(value / 100) + exp(0.5)), 9))[2] AS q, CASE WHEN value / 2 - floor(value / 2) > 0.5 THEN floor(value / 2) + 1 WHEN value / 2 - floor(value / 2) < 0.5 THEN floor(value / 2) WHEN floor(value / 2) % 2 = 0 THEN floor(value / 2) ELSE floor(value / 2) + 1 END AS even FROM events WHERE value IS NOT NULL")
def scores_and_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sigmoid, softmax and rounding of halves to even."""
    v = C("value")
    return table(spark, sf_dir, "events").filter("value is not null").select("event_id", F.round(N.sigmoid(v / 10), 9).alias("p"), F.round(F.get(N.softmax(F.array(F.lit(1.0), v / 100, F.lit(0.5))), F.lit(1)), 9).alias("q"), N.half_even(v / 2).alias("even"))
