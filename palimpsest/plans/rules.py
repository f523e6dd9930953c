"""Rules over whole tables: check digits of numbers worked out for every document, states, causes of failure, debates, payloads, constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import detect as D
from ..functions import patterns as P
from ..operators import boundary, fields, risk, sequences, steps, stores, tasks
from ..sources import elements as parsed
from ..sources import fixtures
from ..sources.fixtures import permuted
from ..storage import spread
from .made import ACTIONS, ELEMENTS, HISTORY, elements, history, picked, picked_sql
from .registry import QUERIES, SQL, query, table, text, values
from .screens import ROLE_SQL, role

C = F.col

# Numbers -----------------------------------------------------------------------------------------

#: How a number of each kind follows from a document's id, in SQL that Spark and DuckDB both read; some are valid by chance.
_N = "lpad(CAST((doc_id * {a} + {b}) % {m} AS {s}), {k}, '0')"


def _digits(k: int, a: int, b: int, s: str) -> str:
    return _N.format(a=a, b=b, m=10**k, k=k, s=s)


def number_of(kind: str, s: str) -> str:
    """SQL of a document's number; s is the dialect's name of strings."""
    n = lambda k, a, b: _digits(k, a, b, s)
    return {
        "AADHAAR": f"concat('2', {n(11, 7_919_31, 234_123_41)})", "JAPAN_MYNUMBER": n(12, 104_729_77, 123_456_789),
        "EU_VAT": f"CASE WHEN doc_id % 3 = 0 THEN concat('FR', {n(9, 7_907, 11)}) ELSE concat('DE', {n(9, 101_273, 136_695)}) END",
        "CHINA_ID": f"concat({_N.format(a=37, b=0, m=8, k=1, s=s).replace('(doc_id', '1 + (doc_id')}, {n(5, 911, 10_105)}, '19', {_N.format(a=7, b=49, m=90, k=2, s=s)}, '1', substr('012', CAST(1 + doc_id % 3 AS INT), 1), {_N.format(a=13, b=0, m=19, k=2, s=s).replace('(doc_id', '10 + (doc_id')}, {n(3, 77, 2)}, substr('0123456789X', CAST(1 + doc_id * 5 % 11 AS INT), 1))",
        "BRAZIL_CPF": f"concat({n(3, 17, 111)}, '.', {n(3, 31, 444)}, '.', {n(3, 7, 777)}, '-', {n(2, 3, 35)})",
        "AU_TFN": f"concat({n(3, 77, 876)}, ' ', {n(3, 13, 543)}, ' ', {n(3, 19, 210)})", "AU_ABN": f"concat({n(2, 3, 51)}, ' ', {n(3, 31, 824)}, ' ', {n(3, 41, 753)}, ' ', {n(3, 59, 556)})",
        "MEXICO_RFC": f"concat('GOMC', {n(6, 4_211, 850_101)}, 'AB', substr('0123456789', CAST(1 + doc_id % 10 AS INT), 1))",
    }[kind]


_D = "list_transform(string_split(regexp_replace(m, '[^0-9]', '', 'g'), ''), lambda c: CAST(c AS INTEGER))"


def _sum(weights: list[int], of: str = _D) -> str:
    return f"CAST(list_inner_product(({of})[1:{len(weights)}]::DOUBLE[], {weights}::DOUBLE[]) AS BIGINT)"


def _eleven(weights: list[int], place: int) -> str:
    rest = f"{_sum(weights)} % 11"
    return f"({_D})[{place}] = CASE WHEN {rest} < 2 THEN 0 ELSE 11 - {rest} END"


_MOVED = [permuted(d, i) for i in range(8) for d in range(10)]
_TIMES = "CASE WHEN c < 5 THEN CASE WHEN x < 5 THEN (c + x) % 5 ELSE 5 + (c + x) % 5 END ELSE CASE WHEN x < 5 THEN 5 + (c - x + 10) % 5 ELSE (c - x + 10) % 5 END END"
_VAT = f"(11 - list_reduce(list_prepend(10, ({_D})[1:8]), lambda p, v: (2 * CASE WHEN (v + p) % 10 = 0 THEN 10 ELSE (v + p) % 10 END) % 11)) % 10 = ({_D})[9]"
_CHINA = f"(12 - {_sum([7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2])} % 11) % 11"
VALID = {
    "AADHAAR": f"list_reduce(list_prepend(0, list_transform(list_reverse({_D}), lambda d, i: {_MOVED}[((i - 1) % 8) * 10 + d + 1])), lambda c, x: {_TIMES}) = 0",
    "EU_VAT": f"CASE WHEN left(m, 2) = 'DE' THEN regexp_matches(m, '^DE[0-9]{{9}}$') AND {_VAT} ELSE true END",
    "CHINA_ID": f"upper(right(m, 1)) = CASE WHEN {_CHINA} = 10 THEN 'X' ELSE CAST({_CHINA} AS VARCHAR) END",
    "JAPAN_MYNUMBER": _eleven([2, 3, 4, 5, 6, 7, 2, 3, 4, 5, 6], 12).replace("[12] =", "[12] ="),
    "BRAZIL_CPF": f"len(list_distinct({_D})) > 1 AND {_eleven([10, 9, 8, 7, 6, 5, 4, 3, 2], 10)} AND {_eleven([11, 10, 9, 8, 7, 6, 5, 4, 3, 2], 11)}",
    "AU_TFN": f"{_sum([10, 7, 8, 4, 6, 3, 5, 2, 1])} % 11 = 0", "AU_ABN": f"({_sum([10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19])} - 10) % 89 = 0", "MEXICO_RFC": "true",
}


def _found(kind: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.expr(number_of(kind, "STRING")))
    rows = table(spark, sf_dir, "documents").select("lang", F.explode(D.candidates(body, D.BY_TYPE[kind])).alias("e"))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("e.text").alias("n_distinct"), F.min("e.text").alias("first"))


for _kind, _valid in VALID.items():
    _name = f"pii_{_kind.lower()}_by_lang"
    QUERIES[_name] = lambda spark, sf_dir, kind=_kind: _found(kind, spark, sf_dir)
    _pattern = P.PATTERNS[_kind].replace("'", "''")
    SQL[_name] = f"SELECT lang, count(*) AS n, count(DISTINCT m) AS n_distinct, min(m) AS first FROM (SELECT lang, unnest(regexp_extract_all(coalesce(text, '') || ' ' || {number_of(_kind, 'VARCHAR')}, '{_pattern}')) AS m FROM documents) WHERE {_valid} GROUP BY lang"

# Steps -------------------------------------------------------------------------------------------

_STATES = list(steps.NEXT_STATES)
_EDGES = ", ".join(f"('{a}', '{b}')" for a, after in steps.NEXT_STATES.items() for b in after)


@query(
    f"WITH e(a, b) AS (VALUES {_EDGES}), s AS (SELECT event_id, user_id, ts, {picked_sql(_STATES, 'event_id * 7 + event_id // 3')} AS state FROM events WHERE user_id IS NOT NULL), p AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM s) "
    "SELECT event_id, state, before, before IS NULL OR before = state OR state IN ('FAILED', 'STOPPED', 'ERROR') OR EXISTS (SELECT 1 FROM e WHERE e.a = before AND e.b = state) AS is_valid FROM p"
)
def state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event a change of its user's state, one of fifteen: whether it may follow the one before."""
    e = C("event_id")
    rows = table(spark, sf_dir, "events").filter("user_id is not null").withColumn("state", picked(_STATES, e * 7 + F.floor(e / 3)))
    return steps.state_log(rows, "user_id", ["ts", "event_id"], "state").select("event_id", "state", "before", "is_valid")


_FLAGS = {"checked": (5, 1), "found": (4, 2), "enabled": (7, 3), "modal": (11, 0), "cookie": (13, 5), "login": (17, 4), "alert": (19, 6), "loading": (23, 7), "has_target": (3, 1)}
_FAULTS = (
    "(found AND ((action = 'check' AND coalesce(checked, false)) OR (action = 'uncheck' AND NOT coalesce(checked, true)) OR (action IN ('fill', 'type') AND wanted <> '' AND wanted = held)))",
    [("modal", "MODAL_OVERLAY", "RESOLVE_MODAL"), ("cookie", "COOKIE_BANNER", "ACCEPT_COOKIES"), ("login", "LOGIN_REQUIRED", "WAIT_FOR_USER"), ("alert", "VALIDATION_ERROR", "REPLAN_DIFFERENT_ACTION"), ("loading", "PAGE_LOADING", "WAIT_ONCE"),
     ("NOT coalesce(found, false) AND has_target", "TARGET_DISAPPEARED", "REPLAN_FRESH_DOM"), ("found AND NOT coalesce(enabled, true)", "DISABLED_ELEMENT", "REPLAN_DIFFERENT_ACTION")],
)


def _faulty(of: int) -> str:
    rows = [(_FAULTS[0], "INTENDED_CHANGE_ALREADY_DONE", "SKIP"), *_FAULTS[1]]
    return "CASE " + " ".join(f"WHEN coalesce({r[0]}, false) THEN '{r[of]}'" for r in rows) + (" ELSE 'NO_EFFECT' END" if of == 1 else " ELSE 'REPLAN_DIFFERENT_ACTION' END")


@query(
    f"WITH h AS (SELECT event_id AS seq, {picked_sql(ACTIONS, 'event_id * 5')} AS action, {picked_sql(['a', 'b', '', None], 'event_id')} AS wanted, {picked_sql(['a', 'a', '', 'b'], 'event_id * 3 + 1')} AS held, "
    + ", ".join(f"CASE WHEN event_id % 29 <> {i} THEN event_id % {n} = {at} END AS {name}" for i, (name, (n, at)) in enumerate(_FLAGS.items()))
    + f" FROM events) SELECT seq, {_faulty(1)} AS cause, {_faulty(2)} AS strategy FROM h"
)
def failure_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each event's action would have failed, and what follows."""
    e = C("event_id")
    flags = {name: F.when(e % 29 != i, e % n == at) for i, (name, (n, at)) in enumerate(_FLAGS.items())}
    rows = table(spark, sf_dir, "events").select(e.alias("seq"), picked(ACTIONS, e * 5).alias("action"), picked(["a", "b", "", None], e).alias("wanted"), picked(["a", "a", "", "b"], e * 3 + 1).alias("held"), *(c.alias(n) for n, c in flags.items()))
    return rows.select("seq", steps.cause(*map(C, ("action", "wanted", "held", *_FLAGS))).alias("c")).select("seq", "c.cause", "c.strategy")


_SIDES = [None, "click", "fill", "wait"]
_AT = [None, "e1", "e2"]


@query(
    f"WITH d AS (SELECT event_id AS id, {picked_sql(_SIDES, 'event_id')} AS la, {picked_sql(_SIDES, 'event_id * 3 + event_id // 4')} AS ca, {picked_sql(_AT, 'event_id')} AS lt, {picked_sql(_AT, 'event_id * 2')} AS ct, CASE WHEN event_id % 9 <> 0 THEN (event_id * 7 % 41) / 40 ELSE 0.6 END AS l, CASE WHEN event_id % 8 <> 0 THEN (event_id * 11 % 43) / 42 ELSE 0.7 END AS c FROM events), "
    "r AS (SELECT *, CASE WHEN la IS NULL AND ca IS NULL THEN 'ERROR' WHEN la IS NULL THEN 'CLOUD_ONLY_DEGRADED' WHEN ca IS NULL THEN 'LOCAL_ONLY_DEGRADED' WHEN la = ca AND lt IS NOT DISTINCT FROM ct THEN 'AGREE' WHEN round(abs(l - c), 3) < 0.05 THEN 'DISAGREE_AUTO_RESOLVE' WHEN round(abs(l - c), 3) < 0.15 THEN 'DISAGREE_SHOW_BOTH' ELSE 'DISAGREE_ASK_USER_RECOMMENDED' END AS resolution FROM d) "
    "SELECT id, resolution, CASE WHEN resolution = 'ERROR' THEN NULL WHEN ca IS NULL THEN 'local' WHEN la IS NULL THEN 'cloud' WHEN l >= c THEN 'local' ELSE 'cloud' END AS winner FROM r"
)
def debate_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A local and a cloud decision for every event, one of them missing at times, and which is taken."""
    e = C("event_id")
    rows = table(spark, sf_dir, "events").select(
        e.alias("id"), picked(_SIDES, e).alias("local_action"), picked(_SIDES, e * 3 + F.floor(e / 4)).alias("cloud_action"), picked(_AT, e).alias("local_target"), picked(_AT, e * 2).alias("cloud_target"),
        F.when(e % 9 != 0, (e * 7 % 41) / 40).alias("local_confidence"), F.when(e % 8 != 0, (e * 11 % 43) / 42).alias("cloud_confidence"),
    )
    return risk.debate(rows)


@query(f"WITH {ELEMENTS} SELECT type, {ROLE_SQL} AS role, count(*) AS n FROM el GROUP BY ALL")
def semantic_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of every page's elements, counted by type."""
    return elements(spark, sf_dir).groupBy("type", role().alias("role")).agg(F.count(F.lit(1)).alias("n"))


# Texts -------------------------------------------------------------------------------------------

#: What stands in no conversation: put after the turns, one after another.
_LOOSE = ["card 4111 1111 1111 1111", "id 1234 5678 9012 here", "password: hunter22", "plain words", "PAN ABCDE1234F", "1234-5678-9012-3456", "Find the cheapest flight from Pune to Delhi under ₹5,000 tomorrow", "from A to B on monday, max 20", "pay less than $ 40 for the nearest"]
_SAID = f"coalesce(text, '') || ' ' || {picked_sql(_LOOSE, 'conv_id * 5 + turn')}"


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), picked(_LOOSE, C("conv_id") * 5 + C("turn"))).alias("t"))


# of more than three groups in a row the last three are a match, so what follows three needs no look
_AADHAAR = "regexp_matches(t, '(^|[^0-9])[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}([^0-9A-Za-z_]|$)')"
_HITS = "[" + ", ".join(f"CASE WHEN {_AADHAAR if n == 'AADHAAR' else 'regexp_matches(t, ' + text(p) + ')'} THEN '{n}' END" for n, p in boundary.PAYLOAD.items()) + "]"


@query(f"SELECT conv_id, turn, array_to_string(list_filter({_HITS}, lambda x: x IS NOT NULL), ',') AS hits, (list_filter({_HITS}, lambda x: x IS NOT NULL))[1] AS blocked_by FROM (SELECT conv_id, turn, {_SAID} AS t FROM conversations)")
def payload_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of every turn, with a made end, may not leave, and which pattern blocks it."""
    rows = _said(spark, sf_dir).withColumn("hits", F.concat_ws(",", boundary.payload_hits(C("t"))))
    free, blocked = boundary.split_payloads(rows, "t")
    return blocked.select("conv_id", "turn", "hits", "blocked_by").unionByName(free.select("conv_id", "turn", "hits", F.lit(None).cast("string").alias("blocked_by")))


_CONSTRAINTS = ", ".join(f"CASE WHEN regexp_extract(t, {text('(?i)' + p)}, 0) <> '' THEN {text(label)} || regexp_extract(t, {text('(?i)' + p)}, 0) END" for label, p in tasks.CONSTRAINTS)
_ROUTE = f"CASE WHEN trim(regexp_extract(t, {text('(?i)' + tasks.ROUTE)}, 1)) <> '' THEN 'Route: from ' || trim(regexp_extract(t, {text('(?i)' + tasks.ROUTE)}, 1)) || ' to ' || trim(regexp_extract(t, {text('(?i)' + tasks.ROUTE)}, 2)) END"
_INTENT = "CASE " + " ".join(f"WHEN regexp_matches(t, {text('(?i)' + p)}) THEN '{n}'" for n, p in tasks.INTENTS) + " ELSE 'general' END"
_TITLES = "CASE intent " + " ".join(f"WHEN '{k}' THEN {text('|'.join(v))}" for k, v in tasks.SUBGOALS.items()) + " END"


@query(f"SELECT conv_id, turn, intent, found, {_TITLES} AS steps FROM (SELECT conv_id, turn, {_INTENT} AS intent, array_to_string(list_filter([{_CONSTRAINTS}, {_ROUTE}], lambda x: x IS NOT NULL), '|') AS found FROM (SELECT conv_id, turn, {_SAID} AS t FROM conversations))")
def task_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every turn, with a made end, asks for: its intent, its constraints, all its subgoals."""
    t = C("t")
    return _said(spark, sf_dir).select("conv_id", "turn", tasks.intent(t).alias("intent"), F.concat_ws("|", tasks.constraints(t)).alias("found"), F.concat_ws("|", F.transform(tasks.subgoals(t), lambda s: s["title"])).alias("steps"))


_KEPT = sorted({"action", "target", "value", "cookie", "__proto"} & set(boundary.ALLOWED_HISTORY))
_PERMITTED = ", ".join(text(v) for v in boundary.PERMITTED_VALUES)


@query(
    f"WITH {HISTORY} SELECT seq, array_to_string(list_filter([{', '.join('CASE WHEN target IS NOT NULL THEN ' + text(k) + ' END' if k == 'target' else text(k) for k in _KEPT)}], lambda x: x IS NOT NULL), ',') AS kept, CASE WHEN value IS NULL OR value IN ({_PERMITTED}) THEN value ELSE '[REDACTED]' END AS value FROM hi"
)
def boundary_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of the histories as a map with more keys than may leave: those that do, and its value neutralised."""
    entries = F.map_filter(F.create_map(*(x for k, v in (("action", C("action")), ("cookie", F.lit("x")), ("target", C("target")), ("value", C("value")), ("__proto", F.lit("y"))) for x in (F.lit(k), v))), lambda k, v: (k != "target") | v.isNotNull())
    kept = boundary.allowed(entries, boundary.ALLOWED_HISTORY)
    return history(spark, sf_dir).select("seq", F.concat_ws(",", F.array_sort(F.map_keys(kept))).alias("kept"), boundary.history_value(kept["value"]).alias("value"))


# Buttons and fields ------------------------------------------------------------------------------

_BUTTONS = [r[1] for r in fixtures.ACTIONS] + ["Confirm and cancel my account", "Pay ₹500", "See the map", "Confirm"]
_URLS = ["", "https://shop.example.org/billing", "https://news.example.org/a", None]
_AROUND = ["", "subtotal $ 12", None]
_MADE_BUTTONS = f"SELECT event_id, {picked_sql(_BUTTONS, 'event_id')} AS t, {picked_sql(_URLS, 'event_id // 7')} AS url, {picked_sql(_AROUND, 'event_id // 5')} AS around FROM events"


def _class_sql() -> str:
    match = lambda x, p: f"regexp_matches(coalesce({x}, ''), {text('(?i)' + p)})"
    out = [f"WHEN {match('t', chr(92) + 'b(' + '|'.join(fields.DISMISSAL) + ')' + chr(92) + 'b')} OR lower(t) = 'cancel' THEN NULL"]
    for name, p, _ in fields.ACTION_RULES:
        out.append(f"WHEN {match('t', p)} THEN '{name}'")
        if name == "PAYMENT":
            out.append(f"WHEN {match('url', fields.FINANCIAL_PAGE)} AND ({match('around', fields.FINANCIAL_TEXT)} OR {match('t', fields.FINANCIAL_LABEL)}) THEN 'PAYMENT'")
    return "CASE " + " ".join(out) + " END"


def _pressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = C("event_id")
    rows = table(spark, sf_dir, "events").select(e, picked(_BUTTONS, e).alias("t"), picked(_URLS, F.floor(e / 7)).alias("url"), picked(_AROUND, F.floor(e / 5)).alias("around"))
    none = F.lit("")
    return rows.withColumn("k", fields.action_class(C("t"), none, none, none, C("url"), C("around"), none)["type"])


@query(f"SELECT event_id, {_class_sql()} AS action_class FROM ({_MADE_BUTTONS})")
def consequential_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each event's button would set off, by its label, its page and what stands around it."""
    return _pressed(spark, sf_dir).select("event_id", C("k").alias("action_class"))


def _ratios(keys: str, source: str) -> str:
    return (
        f"SELECT {keys}, tp, fp, fn, tn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1 END, 6)::DOUBLE AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1 END, 6)::DOUBLE AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE CASE WHEN fp > 0 AND fn > 0 THEN 1 ELSE 0 END END ELSE 1 END, 6)::DOUBLE AS f1 FROM "
        f"(SELECT {keys}, count(*) FILTER (e AND f) AS tp, count(*) FILTER (NOT e AND f) AS fp, count(*) FILTER (e AND NOT f) AS fn, count(*) FILTER (NOT e AND NOT f) AS tn FROM ({source}) GROUP BY ALL)"
    )


def _scored(rows: DataFrame, expected, found, key: str) -> DataFrame:
    return sequences.scores(rows, expected, found, key).select(key, "tp", "fp", "fn", "tn", *(F.round(n, 6).alias(n) for n in ("precision", "recall", "f1")))


@query(_ratios("day", f"SELECT event_id % 7 AS day, event_id % 20 < 14 OR event_id % 20 = 16 AS e, {_class_sql()} IS NOT NULL AS f FROM ({_MADE_BUTTONS})"))
def consequence_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the classes of buttons tell those with consequences, against labels of our own, some of them wrong."""
    e = C("event_id")
    rows = _pressed(spark, sf_dir).withColumn("day", e % 7)
    return _scored(rows, (e % 20 < 14) | (e % 20 == 16), C("k").isNotNull(), "day")


_FIELDS = values("fx", "i, key", [(i, r[5]) for i, r in enumerate(fixtures.FIELDS)])


@query(f"WITH {_FIELDS}, " + "r AS " + f"({_ratios('kind', f'SELECT event_id // 3 % 4 AS kind, event_id % 5 <> 0 AS e, key IS NOT NULL AS f FROM events JOIN fx ON i = event_id % {len(fixtures.FIELDS)}')}) SELECT * FROM r")
def field_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the matcher tells fields that ask for something known: every event a labelled field, every fifth label wrong."""
    e = C("event_id")
    own = [picked([r[i] for r in fixtures.FIELDS], e) for i in range(1, 5)]
    rows = table(spark, sf_dir, "events").select(e, (F.floor(e / 3) % 4).alias("kind"), fields.field_key(own[0], own[1], own[2], selector=own[3]).alias("key"))
    return _scored(rows, e % 5 != 0, C("key").isNotNull(), "kind")


# Payloads, options, visits, loading --------------------------------------------------------------


@query(
    "SELECT event_id, '{\"sessionId\":\"s' || user_id || '\",\"domSkeleton\":[{\"id\":\"e' || event_id % 97 || '\",\"box\":{\"x\":' || event_id % 50 || '.5,\"y\":2.0,\"width\":3.0,\"height\":4.0},\"enabled\":' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || '}],"
    "\"actionHistory\":[{\"action\":\"fill\",\"value\":\"' || CASE WHEN event_id % 3 = 0 THEN '[FILLED_FROM_LOCAL]' ELSE '[REDACTED]' END || '\"},{\"action\":\"click\"}],\"visualState\":{\"isLoading\":' || CASE WHEN event_id % 5 = 0 THEN 'true' ELSE 'false' END || CASE WHEN event_id % 4 > 0 THEN ',\"dialogRegion\":{\"x\":1.0,\"y\":2.0,\"width\":3.0,\"height\":4.0}' ELSE '' END || '}}' AS sent FROM events WHERE user_id IS NOT NULL"
)
def outbound_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event a payload with keys that may not leave at each level, as it is sent."""
    e, lit = C("event_id"), F.lit
    flag = lambda c: F.when(c, "true").otherwise("false")
    json = F.concat(
        lit('{"cookie":"c=1","sessionId":"s'), C("user_id"), lit('","domSkeleton":[{"id":"e'), e % 97, lit('","innerHTML":"<b>","value":"secret","box":{"x":'), e % 50, lit('.5,"y":2,"width":3,"height":4,"z":9},"enabled":'), flag(e % 2 == 0),
        lit(',"more":{"a":[1,{"b":2}]}}],"actionHistory":[{"action":"fill","value":"'), F.when(e % 3 == 0, "[FILLED_FROM_LOCAL]").otherwise("my secret"), lit('","token":"t"},{"action":"click","password":{"p":1}}],"visualState":{"isLoading":'), flag(e % 5 == 0),
        lit(',"pixels":[1,2],"dialogRegion":{"x":1,"y":2,"width":3'), F.when(e % 4 > 0, ',"height":4').otherwise(""), lit('}},"__proto__":{"x":1}}'),
    )
    rows = spread(table(spark, sf_dir, "events").filter("user_id is not null").select(e, "user_id"), "event_id")
    return rows.select(e, stores.outbound_payload(json).alias("sent"))


@query(
    "SELECT page_id, CAST(n + 1 AS BIGINT) AS n_options, array_to_string(list_transform(range(0, least(n, 4) + 1), lambda i: 'o' || i || ':' || CASE WHEN i = 0 THEN '' ELSE 'v' || i END || ':' || CASE WHEN i = 0 THEN '-' WHEN i <= 2 THEN 'near' ELSE 'far' END || ':' || CASE WHEN i = page_id % 5 THEN 'x' ELSE '' END || ':' || CASE WHEN i > 2 THEN 'off' ELSE 'on' END), ',') AS shown FROM (SELECT page_id, page_id % 9 AS n FROM pages)"
)
def page_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five options of a list with groups that is put before every page."""
    p, n = C("page_id"), C("page_id") % 9
    one = lambda i: F.concat(F.lit('<option value="v'), i.cast("string"), F.lit('"'), F.when(i == p % 5, " selected").otherwise(""), F.lit(">o"), i.cast("string"), F.lit("</option>"))
    some = lambda a, b: F.array_join(F.transform(F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>")), one), "")
    at = lambda x: F.lit(x).cast("bigint")
    first = F.concat(F.lit('<select><option value=""'), F.when(p % 5 == 0, " selected").otherwise(""), F.lit(">o0</option>"))
    html = F.concat(first, F.lit('<optgroup label="near">'), some(at(1), F.least(n, at(2))), F.lit('</optgroup><optgroup label="far" disabled>'), some(at(3), n), F.lit("</optgroup></select>"), F.coalesce("html", F.lit("")))
    items = parsed.page_items(table(spark, sf_dir, "pages").select(p, html.alias("html")))
    said = F.transform("options", lambda o: F.concat_ws(":", o["label"], o["value"], F.coalesce(o["group"], F.lit("-")), F.when(o["selected"], "x").otherwise(""), F.when(o["enabled"], "on").otherwise("off")))
    return parsed.select_options(items, 5).filter("ord = 1").select("page_id", "n_options", F.array_join(said, ",").alias("shown"))


_VISITED = "SELECT e.event_id, e.user_id, e.ts, p.url || CASE WHEN e.event_id % 3 = 0 THEN '#part' || e.event_id % 7 ELSE '' END AS url FROM events e JOIN pages p ON p.page_id = e.event_id % 20"


@query(f"WITH v AS (SELECT *, split_part(url, '#', 1) AS page FROM ({_VISITED})), f AS (SELECT * FROM v WHERE page IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, page ORDER BY ts, event_id) = 1) SELECT event_id, user_id, page, lag(page) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_page FROM f")
def page_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event a look at one of the pages, at times at a part of it: the first look of each user at each address."""
    e, pages = C("event_id"), table(spark, sf_dir, "pages").select("page_id", "url")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts").withColumn("page_id", e % 20).join(pages, "page_id")
    seen = rows.withColumn("url", F.concat("url", F.when(e % 3 == 0, F.concat(F.lit("#part"), (e % 7).cast("string"))).otherwise("")))
    return sequences.first_visits(seen, "user_id", ["ts", "event_id"], "url").select("event_id", "user_id", "page", "from_page")
