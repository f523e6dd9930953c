"""Queries over the driver's tables, each with the SQL that DuckDB runs on the same tables where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import detect as D
from ..functions import mask as M
from ..functions import patterns as P
from ..operators import boundary, proofs, risk, sequences, tasks
from ..sources import fixtures, pages
from ..storage import spread
from .registry import QUERIES, SQL, query, table, text, values

# Entities ------------------------------------------------------------------------------------

ENTITY_LISTS = {
    "luhn": "list_sum(list_transform(list_reverse(string_split(regexp_replace(m, '[^0-9]', '', 'g'), '')), lambda d, i: CASE WHEN i % 2 = 1 THEN CAST(d AS INTEGER) ELSE CAST(d AS INTEGER) * 2 - CASE WHEN CAST(d AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0",
    "entropy": "list_sum(list_transform(list_distinct(string_split(m, '')), lambda c: -(length(m) - length(replace(m, c, ''))) / length(m)::DOUBLE * log2((length(m) - length(replace(m, c, ''))) / length(m)::DOUBLE)))",
}


#: What the documents hold none of: numbers of these kinds, right and wrong ones, put after the texts in turn.
MADE = {
    "PAN": ["QWEPK4821Z", "QWEZK4821Z", "qwepk4821z"], "MEXICO_CURP": ["ROLM851130MJCDPN07", "ROLM851130XJCDPN07"], "SSN": ["219-09-9999", "666-09-9999", "900-10-1234", "123-00-1234", "219 09 9998"],
    "IBAN": [fixtures.FRENCH, fixtures.spoilt(fixtures.FRENCH), "DE89370400440532013000"], "UK_NINO": ["JK482913B", "GB482913B", "DK482913B"], "CANADA_SIN": ["193-847-262", fixtures.grouped(fixtures.luhn("19384726"), 3, 3, 3, by="-"), fixtures.luhn("70518264")],
}


def _matched(kind: str, valid: str = "true") -> str:
    pattern = P.PATTERNS[kind].replace("'", "''")
    body = "coalesce(text, '') || ' ' || [" + ", ".join(map(text, MADE[kind])) + f"][1 + doc_id % {len(MADE[kind])}]" if kind in MADE else "text"
    return f"SELECT lang, count(*) AS n, count(DISTINCT m) AS n_distinct, min(m) AS first FROM (SELECT lang, unnest(regexp_extract_all({body}, '{pattern}')) AS m FROM documents) WHERE {valid} GROUP BY lang"


def _found(kind: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, body = table(spark, sf_dir, "documents"), F.coalesce("text", F.lit(""))
    if kind in MADE:
        body = F.concat(body, F.lit(" "), F.element_at(F.array(*map(F.lit, MADE[kind])), (F.col("doc_id") % len(MADE[kind])).cast("int") + 1))
    rows = docs.select("lang", F.explode(D.candidates(body, D.BY_TYPE[kind])).alias("e"))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("e.text").alias("n_distinct"), F.min("e.text").alias("first"))


SECRET_VALID = f"(regexp_matches(m, '{P.SECRET_PREFIX}') OR (CAST(regexp_matches(m, '[A-Z]') AS INT) + CAST(regexp_matches(m, '[a-z]') AS INT) + CAST(regexp_matches(m, '[0-9]') AS INT) >= 2 AND {ENTITY_LISTS['entropy']} >= CASE WHEN regexp_matches(m, '^[A-Fa-f0-9]+$') THEN 3.0 ELSE 4.0 END))"
SSN_VALID = "substr(m, 1, 3) NOT IN ('000', '666') AND substr(m, 1, 1) <> '9' AND substr(m, 5, 2) <> '00' AND right(m, 4) <> '0000'"
TURNED = "list_reduce(list_prepend(0, list_transform(string_split(substr(m, 5) || substr(m, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN CAST(c AS INT) ELSE 90 + ascii(c) END)), lambda r, v: CASE WHEN v < 90 THEN (r * 10 + v) % 97 ELSE (r * 100 + v - 145) % 97 END)"
for _kind, _valid in {
    "EMAIL": "true", "IP_ADDRESS": "true", "PAN": "true", "MEXICO_CURP": "true",
    "CARD": "length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 13 AND 19 AND " + ENTITY_LISTS["luhn"],
    "CANADA_SIN": ENTITY_LISTS["luhn"], "SECRET_TOKEN": SECRET_VALID, "SSN": SSN_VALID,
    "IBAN": f"length(m) BETWEEN 15 AND 34 AND {TURNED} = 1",
    "UK_NINO": "left(m, 2) NOT IN ('BG', 'GB', 'NK', 'KN', 'TN', 'NT', 'ZZ')",
}.items():
    _name = f"pii_{_kind.lower()}_by_lang"
    QUERIES[_name] = lambda spark, sf_dir, kind=_kind: _found(kind, spark, sf_dir)
    SQL[_name] = _matched(_kind, _valid)


@query()
def entities_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: all detectors with claims over every document, counted by language and type, with a masked sample."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("lang", F.explode(D.entities(F.col("text"))).alias("e"))
    return rows.groupBy("lang", "e.type").agg(F.count(F.lit(1)).alias("n"), F.min("e.text").alias("x"), F.max("e.confidence").alias("confidence")).select("lang", "type", "n", "confidence", M.masked(F.col("type"), F.col("x")).alias("sample"))


@query()
def distinct_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (type, masked) of each document, with the place first met."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(D.entities(F.col("text"))).alias("e"))
    return rows.groupBy("doc_id", F.col("e.type").alias("type"), M.masked(F.col("e.type"), F.col("e.text")).alias("masked")).agg(F.min("e.start").alias("first_at"), F.count(F.lit(1)).alias("n"))


@query(
    "SELECT doc_id, m AS email, CASE WHEN length(u) <= 2 THEN repeat('*', length(u)) ELSE u[1] || repeat('*', length(u) - 2) || u[-1] END || '@' || d AS masked FROM (SELECT DISTINCT doc_id, m, split_part(m, '@', 1) AS u, split_part(m, '@', 2) AS d FROM (SELECT doc_id, unnest(regexp_extract_all(text, '"
    + P.PATTERNS["EMAIL"]
    + "')) AS m FROM documents))"
)
def mask_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(D.candidates(F.coalesce("text", F.lit("")), D.BY_TYPE["EMAIL"])).alias("e"))
    return rows.select("doc_id", F.col("e.text").alias("email"), M.masked(F.lit("EMAIL"), F.col("e.text")).alias("masked")).distinct()


@query(
    "SELECT DISTINCT doc_id, m AS ip, repeat('*', length(split_part(m, '.', 1))) || '.' || repeat('*', length(split_part(m, '.', 2))) || '.' || split_part(m, '.', 3) || '.' || split_part(m, '.', 4) AS masked FROM (SELECT doc_id, unnest(regexp_extract_all(text, '"
    + P.PATTERNS["IP_ADDRESS"]
    + "')) AS m FROM documents)"
)
def mask_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(D.candidates(F.coalesce("text", F.lit("")), D.BY_TYPE["IP_ADDRESS"])).alias("e"))
    return rows.select("doc_id", F.col("e.text").alias("ip"), M.masked(F.lit("IP_ADDRESS"), F.col("e.text")).alias("masked")).distinct()


@query(
    "SELECT DISTINCT doc_id, '**** **** **** ' || right(regexp_replace(m, '[^0-9]', '', 'g'), 4) AS masked FROM (SELECT doc_id, unnest(regexp_extract_all(text, '"
    + P.PATTERNS["CARD"]
    + "')) AS m FROM documents) WHERE length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 13 AND 19 AND "
    + ENTITY_LISTS["luhn"]
)
def mask_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(D.candidates(F.coalesce("text", F.lit("")), D.BY_TYPE["CARD"])).alias("e"))
    return rows.select("doc_id", M.masked(F.lit("CARD"), F.col("e.text")).alias("masked")).distinct()


@query(
    "SELECT doc_id, line_no - 1 AS line_no, CASE WHEN regexp_matches(line, '" + P.PATTERNS["EMAIL"] + "') OR regexp_matches(line, '" + P.PATTERNS["IP_ADDRESS"] + "') THEN '[REDACTED LINE]' ELSE left(line, 300) END AS shown "
    "FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)"
)
def redact_contact_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with an e-mail or network address replaced by a marker, others cut at 300 characters."""
    some = [D.BY_TYPE["EMAIL"], D.BY_TYPE["IP_ADDRESS"]]
    rows = boundary.lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    dirty = F.col("line").rlike(some[0].pattern) | F.col("line").rlike(some[1].pattern)
    return rows.select("doc_id", "line_no", F.when(dirty, "[REDACTED LINE]").otherwise(F.substring("line", 1, 300)).alias("shown"))


@query()
def redacted_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, lines and those that any detector redacts."""
    rows = boundary.redacted_lines(boundary.lines(table(spark, sf_dir, "documents"), "doc_id", "text"), "line")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.size("entities") > 0).alias("n_redacted"))


@query("SELECT doc_id, count(*) AS kept FROM (SELECT doc_id, line, lag(line) OVER (PARTITION BY doc_id ORDER BY k) AS p FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents)) WHERE p IS NULL OR p <> line GROUP BY doc_id")
def consecutive_duplicate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boundary.lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    return sequences.consecutive_distinct(rows, "doc_id", ["line_no"], "line").groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"))


@query()
def detector_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well 'holds a secret' agrees with the label of poor quality."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.size(D.candidates(F.coalesce("text", F.lit("")), D.BY_TYPE["SECRET_TOKEN"])) > 0).alias("found"))
    rows = docs.join(table(spark, sf_dir, "labels"), "doc_id").withColumn("task", F.lit("secret"))
    return sequences.scores(rows, F.col("quality") == 0, F.col("found"), "task")


# URLs and pages --------------------------------------------------------------------------------

HOST_SQL = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\\.', '')"


@query(f"SELECT {HOST_SQL} AS host, count(*) AS n, sum(CASE WHEN url LIKE 'https://%' THEN 1 ELSE 0 END) AS n_https FROM pages GROUP BY 1")
def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.groupBy(risk.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("url").startswith("https://"), 1).otherwise(0)).alias("n_https"))


@query("SELECT page_id, CASE WHEN url LIKE 'https://%' THEN 0.9 WHEN url LIKE 'http://%' THEN 0.4 ELSE 0.6 END::DOUBLE AS https_score, CASE WHEN regexp_matches(" + HOST_SQL + ", '(?i)^xn--|-(login|secure|verify|update|account)-|[.](zip|mov|tk|top|xyz)$|[0-9]{1,3}([.][0-9]{1,3}){3}$') THEN 0.25 ELSE 0.85 END::DOUBLE AS reputation FROM pages")
def page_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", risk.https_score(F.col("url")).alias("https_score"), risk.reputation(F.col("url")).alias("reputation"))


@query(
    "SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) || coalesce(CASE WHEN q <> '' THEN '?' || (SELECT string_agg(split_part(p, '=', 1) || '=' || CASE WHEN regexp_matches(split_part(p, '=', 1), '(?i)token|auth|key|secret|password|session|email|phone|name|code|jwt|access|id_token') THEN '[REDACTED]' ELSE left(regexp_extract(p, '=(.*)$', 1), 50) END, '&' ORDER BY k) FROM (SELECT unnest(string_split(q, '&')) AS p, generate_subscripts(string_split(q, '&'), 1) AS k) WHERE p <> '') END, '') || regexp_extract(url, '(#.*)$', 1) AS url FROM (SELECT page_id, url, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS q FROM pages)"
)
def page_sanitized_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", boundary.sanitized_url(F.col("url")).alias("url"))


URLS = [("a", "https://x.example.com/a?token=abc&ref=1"), ("b", "https://x.example.com/?Email=a%40b.c&sid=9#top"), ("c", "https://x.example.com/"), ("d", "http://hdfcbank.com.evil.example/login"), ("e", "https://www.sbi.co.in/"), ("f", "https://hdfcbnk.com/"), ("g", "https://pay.icicibank.com/x"), ("h", "https://192.168.0.1/x"), ("i", "not a url"), ("j", None)]


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its address or, two of three, one of URLS."""
    odd = F.element_at(F.array(*(F.lit(u).cast("string") for _, u in URLS)), (F.col("page_id") % len(URLS)).cast("int") + 1)
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(odd).alias("url"))


_U = "u AS (SELECT page_id AS id, CASE WHEN page_id % 3 = 0 THEN url ELSE [" + ", ".join(text(u) for _, u in URLS) + f"][1 + page_id % {len(URLS)}] END AS url FROM pages)"


@query(
    f"WITH {_U} SELECT id, coalesce(array_to_string(list_filter(list_transform(list_filter(string_split(regexp_extract(coalesce(url, ''), '^[^?#]*[?]([^#]*)', 1), '&'), lambda p: p <> ''), lambda p: lower(split_part(p, '=', 1))), lambda n: n IN ("
    + ", ".join(map(text, P.SENSITIVE_PARAMS))
    + ")), ','), '') AS params FROM u"
)
def sensitive_url_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).select("id", F.concat_ws(",", boundary.sensitive_params(F.col("url"))).alias("params"))


_IMITATED = (
    values("t", "k, trusted", list(enumerate(risk.TRUSTED))) + f", {_U}, d AS (SELECT id, url, {HOST_SQL} AS domain FROM u), "
    "c AS (SELECT d.id, t.k, t.trusted FROM d JOIN t ON (levenshtein(d.domain, t.trusted) BETWEEN 1 AND 2 AND abs(length(d.domain) - length(t.trusted)) <= 3) OR (length(split_part(t.trusted, '.', 1)) >= 3 AND contains(d.domain, split_part(t.trusted, '.', 1)) AND NOT ends_with(d.domain, t.trusted)) "
    "WHERE NOT EXISTS (SELECT 1 FROM t o WHERE d.domain = o.trusted OR ends_with(d.domain, '.' || o.trusted))), i AS (SELECT d.id, d.url, d.domain, (SELECT c.trusted FROM c WHERE c.id = d.id ORDER BY k LIMIT 1) AS imitates FROM d)"
)


@query(f"WITH {_IMITATED} SELECT id, domain, imitates FROM i")
def domain_impersonation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _urls(spark, sf_dir).withColumn("domain", F.when(F.col("url").isNotNull(), risk.host(F.col("url"))))
    return rows.select("id", "domain", risk.impersonated(F.col("domain")).alias("imitates"))


@query("SELECT page_id, len(regexp_extract_all(html, '(?i)<a\\b')) AS n_links, len(regexp_extract_all(html, '(?i)<tr\\b')) AS n_rows, len(regexp_extract_all(html, '(?i)<(input|select|textarea)\\b')) AS n_inputs, len(regexp_extract_all(html, '(?i)<h[1-6]\\b')) AS n_headings FROM pages")
def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_counts(table(spark, sf_dir, "pages"))


@query("SELECT page_id, k - 1 AS ord, regexp_extract(a, '(?i)href=\"([^\"]*)\"', 1) AS href FROM (SELECT page_id, unnest(l) AS a, generate_subscripts(l, 1) AS k FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\\b[^>]*?href=\"([^\"]*)\"[^>]*>.*?</a>') AS l FROM pages))")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_links(table(spark, sf_dir, "pages")).select("page_id", "ord", "href")


@query("SELECT page_id, k - 1 AS ord, CAST(h[3] AS INTEGER) AS level FROM (SELECT page_id, unnest(l) AS h, generate_subscripts(l, 1) AS k FROM (SELECT page_id, regexp_extract_all(html, '(?is)<h[1-6]\\b[^>]*>.*?</h[1-6]>')[1:10] AS l FROM pages))")
def page_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_headings(table(spark, sf_dir, "pages")).select("page_id", "ord", "level")


_SKIP = "(?is)" + "|".join(f"<{t}\\b.*?</{t}\\s*>" for t in ("script", "style", "noscript", "template")) + "|<!--.*?-->"
_PLAIN = "regexp_replace(x, '<[^>]*>', ' ', 'g')"
for _name, _char in pages.NAMED:
    _PLAIN = f"replace({_PLAIN}, {text(_name)}, {text(_char)})"


@query(
    f"WITH l AS (SELECT page_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(html, ''), {text(_SKIP)}, ' ', 'g'), {text(pages.BREAKS)}, chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace({_PLAIN}, '\\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM pages), "
    "f AS (SELECT page_id, list_filter(l, lambda x, i: i = 1 OR l[i - 1] <> x) AS f FROM l) SELECT page_id, k - 1 AS line_no, f[k] AS line FROM (SELECT page_id, f, unnest(range(1, len(f) + 1)) AS k FROM f)"
)
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_lines(table(spark, sf_dir, "pages"))


@query()
def page_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole-page privacy scan: lines, entities, redaction, and counts by type."""
    rows = boundary.redacted_lines(pages.page_lines(table(spark, sf_dir, "pages")), "line")
    return rows.select("page_id", F.explode_outer("entities").alias("e")).groupBy("page_id").agg(F.count("e").alias("n_entities"), F.concat_ws(",", F.array_sort(F.collect_set("e.type"))).alias("types"))


@query()
def compliance_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spread(table(spark, sf_dir, "pages").select("page_id", "url", "html"), "page_id")
    p = own.select("page_id", "url", pages.visible_text(F.col("html")).alias("text"))
    found = p.withColumn("types", F.array_distinct(F.transform(D.entities(F.col("text")), lambda e: e["type"])))
    links = pages.page_links(own).groupBy("page_id").agg(F.collect_list(F.struct("text", "href")).alias("links"))
    judged = found.join(links, "page_id", "left").withColumn("c", risk.compliance(F.col("text"), F.col("url"), F.col("types"), F.col("links")))
    return judged.select("page_id", F.col("c.score").alias("score"), F.concat_ws(",", "c.findings").alias("findings"))


ASKED = ["enter card number and otp", "your otp", "find a train", "pan and account number"]


@query(
    f"WITH {_IMITATED}, f AS (SELECT id, coalesce(domain, '') NOT IN ('', 'x.example.com') AND NOT ends_with('x.example.com', '.' || domain) AND NOT ends_with(domain, '.x.example.com') AS away, NOT coalesce(regexp_matches(url, '(?i)^https:'), false) AND coalesce(domain, '') <> '' AS open, imitates IS NOT NULL AS alike, id % 4 IN (0, 3) AS many, id % 4 = 0 AS grave FROM i) "
    "SELECT id, CASE WHEN away OR alike OR grave THEN 'block' WHEN open OR many THEN 'warn' ELSE 'allow' END AS level, array_to_string(list_filter([CASE WHEN open THEN 'NOT_HTTPS' END, CASE WHEN away THEN 'FOREIGN_FORM' END, CASE WHEN alike THEN 'LOOKALIKE' END, CASE WHEN many THEN 'SENSITIVE_COMBINATION' END], lambda x: x IS NOT NULL), ',') AS reasons FROM f"
)
def trust_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with a form to x.example.com and fields of four kinds."""
    asked = F.element_at(F.array(*map(F.lit, ASKED)), (F.col("id") % 4).cast("int") + 1)
    rows = _urls(spark, sf_dir).withColumn("kinds", risk.sensitive_kinds(asked, F.lit(False)))
    return rows.select("id", risk.trust_level(F.col("url"), F.lit("https://x.example.com/submit"), F.col("kinds")).alias("t")).select("id", "t.level", F.concat_ws(",", "t.reasons").alias("reasons"))


# Rules -----------------------------------------------------------------------------------------


INTENT_SQL = "CASE " + " ".join(f"WHEN regexp_matches(text, {text('(?i)' + p)}) THEN '{n}'" for n, p in tasks.INTENTS) + " ELSE 'general' END"


@query(f"SELECT role, {INTENT_SQL} AS intent, count(*) AS n FROM conversations GROUP BY 1, 2")
def task_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("role", tasks.intent(F.col("text")).alias("intent")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, count(*) AS turns, sum(ceil(length(coalesce(text, '')) / 3.6))::BIGINT AS tokens FROM conversations GROUP BY conv_id")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum(tasks.tokens_needed(F.col("text"))).alias("tokens"))


DEFANG_SQL = "CASE WHEN " + " OR ".join(f"regexp_matches(text, {text('(?i)' + p)})" for p in boundary.INJECTIONS) + f" THEN {text(boundary.DEFANGED)} WHEN " + " OR ".join(f"regexp_matches(text, {text(p)})" for n, p in boundary.PAYLOAD.items() if n != "AADHAAR") + r" OR regexp_matches(text, '\b\d{4}[ -]\d{4}[ -]\d{4}\b') THEN '[REDACTED_PII]' ELSE text END"


@query(f"SELECT conv_id, turn, {DEFANG_SQL} AS shown FROM conversations")
def injection_defang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", boundary.defang(F.col("text")).alias("shown"))


@query("SELECT page_id, round(exp((ln(CASE WHEN url LIKE 'https://%' THEN 0.9 WHEN url LIKE 'http://%' THEN 0.4 ELSE 0.6 END) + ln(CASE WHEN regexp_matches(" + HOST_SQL + ", '(?i)^xn--|-(login|secure|verify|update|account)-|[.](zip|mov|tk|top|xyz)$|[0-9]{1,3}([.][0-9]{1,3}){3}$') THEN 0.25 ELSE 0.85 END)) / 2), 3) AS confidence FROM pages")
def confidence_geomean(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("double")
    return table(spark, sf_dir, "pages").select("page_id", risk.confidence(none, risk.https_score(F.col("url")), risk.reputation(F.col("url"))).alias("confidence"))


@query("SELECT layer, count(*) AS n FROM (SELECT CASE WHEN value >= 60 THEN 'TREE' WHEN event_type IN ('click', 'view') THEN 'HEURISTIC' WHEN value >= 10 THEN 'CLOUD' ELSE 'ASK_USER' END AS layer FROM events) GROUP BY layer")
def router_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    sure = lambda c: F.when(c, 0.9).otherwise(0.1)
    tiers = [("TREE", F.col("event_id"), sure(F.col("value") >= 60)), ("HEURISTIC", F.when(F.col("event_type").isin("click", "view"), F.col("event_id")), F.lit(0.7)), ("CLOUD", F.col("event_id"), sure(F.col("value") >= 10))]
    return e.select(risk.route(tiers).alias("r")).groupBy(F.col("r.layer").alias("layer")).agg(F.count(F.lit(1)).alias("n"))


# Sequences -------------------------------------------------------------------------------------


@query("SELECT event_id, user_id, array_to_string(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), ',') AS recent FROM events")
def recent_actions_last6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.recent(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "user_id", F.concat_ws(",", "recent").alias("recent"))


@query("SELECT event_id, CASE WHEN event_type = l1 AND event_type = l2 THEN 'REPEAT' WHEN event_type = l2 AND l1 = l3 AND event_type <> l1 THEN 'OSCILLATION' END AS loop FROM (SELECT event_id, event_type, lag(event_type, 1) OVER w AS l1, lag(event_type, 2) OVER w AS l2, lag(event_type, 3) OVER w AS l3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))")
def action_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.loops(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "loop")


@query("SELECT event_id, CAST(sum(bad) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS BIGINT) AS failures FROM (SELECT *, sum(1 - bad) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM (SELECT *, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS bad FROM events))")
def failure_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.failure_runs(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "failures")


@query("SELECT event_id, user_id, event_type AS page, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_page FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def first_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.first_visits(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "user_id", "page", "from_page")


EDGES = [("view", "click"), ("click", "view"), ("click", "purchase"), ("view", "view"), ("purchase", "view"), ("click", "error"), ("error", "view")]


@query("WITH " + values("e", "src, dst", EDGES) + " SELECT is_valid, count(*) AS n FROM (SELECT p IS NULL OR EXISTS (SELECT 1 FROM e WHERE e.src = p AND e.dst = event_type) AS is_valid FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY is_valid")
def transition_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = spark.createDataFrame(EDGES, "src string, dst string")
    return sequences.transitions(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", edges).groupBy("is_valid").agg(F.count(F.lit(1)).alias("n"))


_DAYS = "SELECT user_id, event_type, CAST(ts AS DATE) AS day, count(*) AS n, max(value) AS top FROM events WHERE ts IS NOT NULL GROUP BY 1, 2, 3"


@query(
    f"WITH s AS ({_DAYS}), a AS (SELECT user_id, event_type, day + 1 AS day, n, top FROM s WHERE day < (SELECT max(day) FROM s)), b AS (SELECT * FROM s WHERE day > (SELECT min(day) FROM s)) "
    "SELECT CAST(CAST(coalesce(a.day, b.day) AS DATE) AS VARCHAR) AS day, coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, CASE WHEN a.day IS NULL THEN 'added' WHEN b.day IS NULL THEN 'removed' WHEN a.n IS DISTINCT FROM b.n OR a.top IS DISTINCT FROM b.top THEN 'changed' ELSE 'same' END AS status "
    "FROM a FULL JOIN b ON a.day = b.day AND a.user_id = b.user_id AND a.event_type = b.event_type"
)
def event_diff_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day of events against the day before, from the second day to the last."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")).filter("day is not null")
    days = e.groupBy("user_id", "event_type", "day").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    ends = F.broadcast(e.agg(F.min("day").alias("first"), F.max("day").alias("last")))
    before = days.join(ends, F.col("day") < F.col("last")).withColumn("day", F.date_add("day", 1))
    after = days.join(ends, F.col("day") > F.col("first"))
    return sequences.diff(before, after, ["day", "user_id", "event_type"], ["n", "top"]).select(F.col("day").cast("string").alias("day"), "user_id", "event_type", "status")


@query("SELECT user_id, count(*) AS steps, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS failed, round(avg(CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END), 6) AS success FROM events GROUP BY user_id")
def receipt_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("steps"), F.sum(F.when(bad, 1).otherwise(0)).alias("failed"), F.round(F.avg(F.when(bad, 0.0).otherwise(1.0)), 6).alias("success"))


@query("SELECT event_type, len(v) AS n, v[1] AS least, v[CAST(floor(0.5 * (len(v) - 1)) AS BIGINT) + 1] AS median, v[CAST(floor(0.95 * (len(v) - 1)) AS BIGINT) + 1] AS p95, v[-1] AS most, round(list_avg(v), 6) AS mean FROM (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type)")
def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.latency(table(spark, sf_dir, "events"), "event_type", "value").withColumn("mean", F.round("mean", 6))


@query("SELECT user_id, min(ts) AS saved_at, max(ts) AS updated_at, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def checkpoint_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("o", F.struct("ts", "event_id"))
    last = sequences.latest(e, "user_id", "o", "event_id")
    return last.select("user_id", F.col("saved_at.ts").alias("saved_at"), F.col("updated_at.ts").alias("updated_at"), "event_id")


# Proofs, boxes, frames ---------------------------------------------------------------------------

_CHUNKS = "SELECT doc_id, k - 1 AS index, sha256(substr(coalesce(text, ''), (k - 1) * 4096 + 1, 4096)) AS h FROM (SELECT doc_id, text, unnest(range(1, greatest(1, ceil(length(coalesce(text, '')) / 4096)::BIGINT) + 1)) AS k FROM documents)"
_PAIR = "sha256(unhex({}) || unhex({}))"


def _tree(depth: int) -> str:
    """Levels of padded trees in SQL: each pairs the one below; p is the hash of padding only."""
    out = [f"l0 AS (SELECT doc_id, list(h ORDER BY index) AS h, arg_max(h, index) AS p FROM ({_CHUNKS}) GROUP BY doc_id)"]
    for n in range(1, depth + 1):
        even = f"(SELECT doc_id, p, CASE WHEN len(h) > 1 AND len(h) % 2 = 1 THEN list_append(h, p) ELSE h END AS h FROM l{n - 1})"
        out.append(f"l{n} AS (SELECT doc_id, {_PAIR.format('p', 'p')} AS p, CASE WHEN len(h) = 1 THEN h ELSE list_transform(range(1, len(h), 2), lambda i: {_PAIR.format('h[i]', 'h[i + 1]')}) END AS h FROM {even})")
    return ", ".join(out)


def _leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = proofs.chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 4096)
    return parts.select("doc_id", "index", proofs.leaf(F.col("chunk")).alias("hash"))


@query(f"WITH {_tree(6)} SELECT doc_id, h[1] AS root FROM l6")
def merkle_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root over the chunks of every document."""
    return proofs.roots(proofs.levels(_leaves(spark, sf_dir), "doc_id"), "doc_id").select("doc_id", "root")


@query(f"SELECT doc_id, index, true AS verified, false AS forged FROM ({_CHUNKS})")
def merkle_inclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each chunk's proof leads to its document's root, and whether it would for another chunk."""
    leaves = _leaves(spark, sf_dir)
    tree = proofs.levels(leaves, "doc_id")
    found = proofs.proofs(tree, leaves.select("doc_id", "index"), "doc_id").join(leaves, ["doc_id", "index"]).join(proofs.roots(tree, "doc_id"), "doc_id")
    leads = lambda h: proofs.recomputed(h, F.col("path")) == F.col("root")
    return found.select("doc_id", "index", leads(F.col("hash")).alias("verified"), leads(proofs.leaf(F.lit("forged"))).alias("forged"))


@query("SELECT event_type AS label, name, n FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1) JOIN (VALUES ('click', 'Clic'), ('generic', 'Autre')) t(k, name) ON k = CASE WHEN event_type = 'click' THEN 'click' ELSE 'generic' END")
def translated_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup in a language pack, the generic entry where a key is missing."""
    pack = {"click": "Clic", "generic": "Autre"}
    names = F.create_map(*(F.lit(x) for kv in pack.items() for x in kv))
    n = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.col("event_type").alias("label"), F.coalesce(F.try_element_at(names, "event_type"), names["generic"]).alias("name"), "n")
