"""Stored things: keys and values with aliases, checkpoints and snapshots, receipts, payloads for sending, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import let
from .boundary import ALLOWED_ELEMENT, ALLOWED_HISTORY, ALLOWED_REQUEST, history_value
from .elements import said

# Other names that a key may be stored under, in order.
ALIASES = {
    "home_address": ["address", "residential_address", "street_address"],
    "address": ["home_address", "residential_address", "street_address"],
    "street_address": ["address", "home_address"],
    "zip": ["pincode", "pin_code", "postal_code", "postcode", "zipcode", "zip_code"],
    "name": ["full_name", "fullname", "full name"],
    "phone": ["mobile", "mobile_number", "phone_number", "mobile_phone"],
    "dob": ["date_of_birth", "birthdate", "birth_date"],
    "email": ["email_address", "e-mail"],
    "emergency_phone": ["emergency_contact", "emergency_contact_number", "emergency_number"],
}
# Keys that never reach a log, and what stands for them.
SCRUBBED, OMITTED = ["value", "text", "password", "email", "phone", "card", "cardNumber", "ssn", "name", "dob", "screenshot", "dataUrl", "raw"], "[omitted-by-logger]"
# What of the visual state may be sent.
VISUAL_FLAGS, VISUAL_BOXES = ["isLoading", "hasBlockingOverlay", "overlayConfidence", "analyzed"], ["loadingRegion", "dialogRegion"]
# Modes of privacy and the default; bounds of a preview.
MODES, DEFAULT_MODE, PREVIEW_ELEMENTS, PREVIEW_CHARS = ["cloud", "hybrid", "local", "debate"], "hybrid", 6, 4000


def key_name(key: Column) -> Column:
    """Trimmed and in lower case; null where nothing is left."""
    return F.nullif(F.lower(F.trim(key)), F.lit(""))


def available(value: Column) -> Column:
    return F.coalesce(F.length(F.trim(value.cast("string"))) > 0, F.lit(False))


def store_state(writes: DataFrame, order: Column, owner: str = "owner") -> DataFrame:
    """(owner, key, value) after writes of (owner, op, key, value): put, remove and clear, the last in order winning. Keys without a name are ignored."""
    rows = writes.withColumn("__o", order).withColumn("key", key_name(F.col("key")))
    cleared = rows.filter("op = 'clear'").groupBy(owner).agg(F.max("__o").alias("__cleared"))
    last = rows.filter("op <> 'clear' and key is not null").groupBy(owner, "key").agg(F.max_by(F.struct("op", "value"), "__o").alias("w"), F.max("__o").alias("__at"))
    kept = last.join(cleared, owner, "left").filter("__cleared is null or __at > __cleared").filter("w.op = 'put'")
    return kept.select(owner, "key", F.coalesce("w.value", F.lit("")).alias("value"))


def key_candidates(key: Column) -> Column:
    """array<string>: names to look for, in order: the key, its aliases, each also with underscores for spaces and the other way round."""
    k = key_name(key)
    others = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in ALIASES.items() for x in kv))
    names = F.concat(F.array(k), F.coalesce(F.try_element_at(others, k), F.array().cast("array<string>")))
    return F.array_distinct(F.flatten(F.transform(names, lambda n: F.array(n, F.regexp_replace(n, r"\s+", "_"), F.regexp_replace(n, "_+", " ")))))


def looked_up(asked: DataFrame, store: DataFrame, owner: str = "owner") -> DataFrame:
    """asked (ask_id, owner, key) -> adds found_key and value: the first candidate that the owner's store has a value for."""
    wanted = asked.select("ask_id", owner, F.posexplode(key_candidates(F.col("key"))).alias("k", "found_key"))
    held = store.filter(available(F.col("value"))).select(owner, F.col("key").alias("found_key"), "value")
    hit = wanted.join(held, [owner, "found_key"]).groupBy("ask_id").agg(F.min_by(F.struct("found_key", "value"), "k").alias("h"))
    return asked.join(hit, "ask_id", "left").select(*asked.columns, "h.found_key", "h.value")


# Checkpoints ------------------------------------------------------------------------------------


def checkpoints(log: DataFrame, order: Column) -> DataFrame:
    """(task_id, label, saved_at, updated_at, snapshot) after a log of (task_id, op, label, ts, snapshot).

    The first save after a delete, or of all, gives saved_at; the last gives the snapshot and,
    if it has none itself, keeps the label before. A deleted task is left out until saved again.
    """
    rows = log.withColumn("__o", order)
    gone = rows.filter("op = 'delete'").groupBy("task_id").agg(F.max("__o").alias("__gone"))
    saves = rows.filter("op = 'save'").join(gone, "task_id", "left").filter("__gone is null or __o > __gone")
    out = saves.groupBy("task_id").agg(F.min_by("ts", "__o").alias("saved_at"), F.max_by("ts", "__o").alias("updated_at"), F.max_by("snapshot", "__o").alias("snapshot"), F.max_by(F.col("label"), F.when(F.col("label").isNotNull(), F.col("__o"))).alias("label"))
    return out.select("task_id", F.coalesce("label", F.col("task_id").cast("string")).alias("label"), "saved_at", "updated_at", "snapshot")


def listed(saved: DataFrame, owner: str) -> DataFrame:
    """Checkpoints without snapshots, the newest of each owner first (place 1)."""
    return saved.drop("snapshot").withColumn("place", F.row_number().over(Window.partitionBy(owner).orderBy(F.desc("updated_at"), "task_id")))


# Fields of a snapshot and what they are without one.
SNAPSHOT = "struct<task:string,objective:string,constraints:array<string>,currentSubgoalIndex:int,attemptedCount:int,succeededCount:int,failedCount:int,pagesVisited:array<string>,isVerifiedComplete:boolean,currentSubgoal:string>"


def snapshot(*fields: Column) -> Column:
    """A snapshot as JSON; nulls are left out."""
    return F.to_json(F.struct(*fields))


def restored(json: Column) -> Column:
    """The fields of a snapshot; missing counts are 0, missing lists empty, a missing flag false. Broken JSON restores nothing but these."""
    s = F.from_json(json, SNAPSHOT)
    none = F.array().cast("array<string>")
    return F.struct(
        s["task"].alias("task"), s["objective"].alias("objective"), F.coalesce(s["constraints"], none).alias("constraints"), F.coalesce(s["currentSubgoalIndex"], F.lit(0)).alias("currentSubgoalIndex"),
        *(F.coalesce(s[c], F.lit(0)).alias(c) for c in ("attemptedCount", "succeededCount", "failedCount")), F.coalesce(s["pagesVisited"], none).alias("pagesVisited"), F.coalesce(s["isVerifiedComplete"], F.lit(False)).alias("isVerifiedComplete"), s["currentSubgoal"].alias("currentSubgoal"),
    )


def task_slug(task: Column) -> Column:
    """Words of a task in lower case joined by hyphens, 60 characters at most; `task` where nothing is left."""
    cut = F.substring(F.regexp_replace(F.lower(F.trim(said(task))), "[^a-z0-9]+", "-"), 1, 60)
    return F.coalesce(F.nullif(F.regexp_replace(cut, "^-+|-+$", ""), F.lit("")), F.lit("task"))


def mode(value: Column) -> Column:
    """A mode of privacy, hybrid where it is none."""
    return F.when(value.isin(MODES), value).otherwise(DEFAULT_MODE)


# Sending ------------------------------------------------------------------------------------------


def request_fields(payload: Column) -> Column:
    """Of a map, the keys that may be sent."""
    return F.map_filter(payload, lambda k, v: k.isin(ALLOWED_REQUEST))


#: A payload that may leave, as a schema: what it does not name is not even read. Numbers and flags keep their kinds.
_BOX = "struct<x:double,y:double,width:double,height:double>"
_KINDS = {"box": _BOX, "sensitive": "boolean", "hasValue": "boolean", "enabled": "boolean", "visible": "boolean", "isSearch": "boolean", "isPagination": "boolean", "inModal": "boolean", "inNav": "boolean", "isSticky": "boolean", "multiple": "boolean", "isUntrustedPromptInjection": "boolean", "visuallyPainted": "boolean", "options": "array<string>", "authorizedByUser": "boolean", "isLoading": "boolean", "hasBlockingOverlay": "boolean", "analyzed": "boolean"}


def _schema(names: list[str], kinds: dict[str, str]) -> str:
    return "struct<" + ",".join(f"`{n}`:{kinds.get(n, 'string')}" for n in names) + ">"


PAYLOAD_SCHEMA = _schema(ALLOWED_REQUEST, {"domSkeleton": f"array<{_schema(ALLOWED_ELEMENT, _KINDS)}>", "actionHistory": f"array<{_schema(ALLOWED_HISTORY, _KINDS)}>", "visualState": _schema(VISUAL_FLAGS + VISUAL_BOXES, _KINDS | dict.fromkeys(VISUAL_BOXES, _BOX))})


def outbound_payload(json: Column) -> Column:
    """JSON of a payload as it may leave: listed keys only, in it and in its elements, history and visual state, in the order of the lists.

    Values of the history are neutralised, boxes of the visual state that lack a number are left out, and so are null
    fields. What is no JSON object, and null, becomes null. Other listed parts that are objects stay as their JSON text.
    """
    def safe(payload: Column) -> Column:
        state = payload["visualState"]
        for box in VISUAL_BOXES:
            state = state.withField(box, visual_box(payload["visualState"][box]))
        return payload.withField("actionHistory", outbound_history(payload["actionHistory"])).withField("visualState", F.when(payload["visualState"].isNotNull(), state))

    # a payload is parsed once, not for each part that names it
    return F.when(F.trim(json).startswith("{"), let(F.from_json(json, PAYLOAD_SCHEMA), lambda payload: F.to_json(safe(payload))))


def outbound_history(items: Column) -> Column:
    """Of an array of structs (action, target, value, ...), the last ones with their values neutralised, recursively as part of a payload."""
    return F.transform(items, lambda s: s.withField("value", history_value(s["value"])))


def visual_state(state: Column) -> Column:
    """Of a map<string,string>, the flags that may be sent."""
    return F.map_filter(state, lambda k, v: k.isin(VISUAL_FLAGS))


def visual_box(box: Column) -> Column:
    """A box of the visual state, null unless all four numbers are finite."""
    finite = F.lit(True)
    for c in ("x", "y", "width", "height"):
        finite = finite & box[c].isNotNull() & ~F.isnan(box[c].cast("double")) & (F.abs(box[c].cast("double")) < float("inf"))
    return F.when(F.coalesce(finite, F.lit(False)), box)


def execution_state(items: Column, most: int = 3) -> Column:
    """The last entries of a history (structs action, target, result) with their step numbers from 1."""
    n = F.size(items)
    last = F.slice(items, F.greatest(F.lit(1), n - most + 1), most)
    return F.transform(last, lambda s, i: F.struct((F.greatest(F.lit(0), n - most) + i + 1).alias("step"), s["action"].alias("action"), s["target"].alias("target"), F.coalesce(s["result"], F.lit("success")).alias("result")))


def receipts(sent: DataFrame) -> DataFrame:
    """(owner, the thirteen totals) of rows that each add to some of them."""
    # The totals of a receipt.
    names = ["stepsSent", "totalPiiMasked", "totalFaces", "totalIdImages", "totalIdImagesOcrConfirmed", "totalBytes", "scanFailures", "zeroCloudSteps", "zeroCloudFieldsFilled", "localOnlySteps", "routerLocalSteps", "latencySumMs", "latencyCount"]
    return sent.groupBy("owner").agg(*(F.sum(F.coalesce(F.col(n), F.lit(0))).alias(n) for n in names))


def dashboard(totals: DataFrame) -> DataFrame:
    """(owner, detections, zero_cloud_percent, mean_latency_s) of receipts; halves round up."""
    local = F.col("zeroCloudSteps") + F.col("localOnlySteps") + F.col("routerLocalSteps")
    steps = F.col("stepsSent") + local
    return totals.select("owner", (F.col("totalPiiMasked") + F.col("totalFaces") + F.col("totalIdImages")).alias("detections"), F.when(steps > 0, F.floor(local / steps * 100 + 0.5)).otherwise(0).cast("long").alias("zero_cloud_percent"), F.when(F.col("latencyCount") > 0, F.round(F.col("latencySumMs") / F.col("latencyCount") / 1000, 2)).alias("mean_latency_s"))


def preview(elements: Column, json: Column) -> Column:
    """struct<shown, omitted, text>: the first elements of a payload, how many are left out, and its JSON cut."""
    return F.struct(F.slice(elements, 1, PREVIEW_ELEMENTS).alias("shown"), F.greatest(F.lit(0), F.size(elements) - PREVIEW_ELEMENTS).alias("omitted"), F.when(F.length(json) > PREVIEW_CHARS, F.concat(F.substring(json, 1, PREVIEW_CHARS), F.lit("\n… (truncated)"))).otherwise(json).alias("text"))


def scrubbed(record: Column) -> Column:
    """A map<string,string> for a log: what dangerous keys hold is left out."""
    return F.transform_values(record, lambda k, v: F.when(k.isin(SCRUBBED), OMITTED).otherwise(v))


#: A string, and what else JSON text is made of: braces, brackets, commas, colons, words and numbers.
TOKEN = r'"(?:[^"\\]++|\\.)*+"|[{}\[\],:]|[^\s{}\[\],:"]++'


def scrubbed_json(json: Column) -> Column:
    """JSON text for a log, without spaces: what dangerous keys hold, whatever it is and however deep, is left out.

    A fold over the text's tokens; depth counts the brackets that are open inside what is left out.
    """
    tokens = F.regexp_extract_all(json, F.lit(TOKEN), F.lit(0))
    bare = F.array().cast("array<string>")
    state = lambda out, depth, named: F.struct(out.alias("out"), depth.alias("depth"), named.alias("named"))
    #: named: 1 after a dangerous key, 2 after its colon, 3 inside what it holds
    zero, one = F.lit(0), F.lit(1)

    def step(acc: Column, t: Column) -> Column:
        opens, closes = t.isin("{", "["), t.isin("}", "]")
        dangerous = F.substring(t, 2, 2**31 - 1).isin([f'{k}"' for k in SCRUBBED]) & t.startswith('"')
        depth = acc["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        more = lambda x: F.concat(acc["out"], F.array(x))
        inside = state(acc["out"], depth, F.when(depth > 0, 3).otherwise(zero))
        held = F.when(opens, state(more(F.lit(f'"{OMITTED}"')), one, F.lit(3))).otherwise(state(more(F.lit(f'"{OMITTED}"')), zero, zero))
        # a dangerous word that no colon follows is a value
        key = F.when(t == ":", state(more(t), zero, F.lit(2))).otherwise(state(more(t), zero, F.when(dangerous, one).otherwise(zero)))
        plain = state(more(t), zero, F.when(dangerous, one).otherwise(zero))
        return F.when(acc["named"] == 3, inside).when(acc["named"] == 2, held).when(acc["named"] == 1, key).otherwise(plain)

    done = F.aggregate(tokens, state(bare, zero, zero), step, lambda acc: F.array_join(acc["out"], ""))
    return F.when(json.isNotNull(), done)


def canonical_json(**fields: Column) -> Column:
    """JSON of the fields in the order of their names, nulls included, without spaces."""
    return F.to_json(F.struct(*(fields[n].alias(n) for n in sorted(fields))), {"ignoreNullFields": "false"})


def merged(first: Column, second: Column) -> Column:
    """Both maps; where both have a key, the second's value."""
    none = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(first, none), F.coalesce(second, none)
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def chosen_history(client: Column, server: Column) -> Column:
    """The client's history unless it has none."""
    return F.when(F.coalesce(F.size(client), F.lit(0)) > 0, client).otherwise(server)


def ago(then: Column, now: Column) -> Column:
    """How long ago in words: just now, minutes, hours, days; nothing for null. Halves round up, here as there at each step."""
    up = lambda x: F.floor(x + 0.5).cast("long")
    minutes = up((F.unix_millis(now.cast("timestamp")) - F.unix_millis(then.cast("timestamp"))) / 60000)
    hours = up(minutes / 60)
    text = lambda n, unit: F.concat(n.cast("string"), F.lit(unit + " ago"))
    return F.when(then.isNull(), "").when(minutes < 1, "just now").when(minutes < 60, text(minutes, "m")).when(hours < 24, text(hours, "h")).otherwise(text(up(hours / 24), "d"))
