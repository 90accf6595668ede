"""Queries of operations: incremental sync, caches, ledgers, limits, logs and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import ledger, sync
from loomspark.operators.rows import latest
from loomspark.plans.catalog import ANSWERS, CHUNKS, HITS, ITEMS, query
from loomspark.plans.search import _RANKED, ranked_hits
from loomspark.session import table

_OLD = f"(SELECT sha256(text) AS key, row_number() OVER (ORDER BY sha256(text)) AS id FROM {CHUNKS} WHERE version IN ('1.41', '1.42') AND text IS NOT NULL GROUP BY sha256(text))"
_NEW = f"(SELECT DISTINCT sha256(text) AS key FROM {CHUNKS} WHERE version IN ('1.42', '1.43') AND text IS NOT NULL)"
_PLAN = f"""P AS (SELECT key, o.id, CASE WHEN n.key IS NOT NULL THEN 'keep' ELSE 'delete' END AS action FROM {_OLD} o LEFT JOIN {_NEW} n USING (key) UNION ALL
SELECT key, (SELECT max(id) FROM {_OLD}) + row_number() OVER (ORDER BY substr(md5(key), 1, 2), key) AS id, 'insert' FROM {_NEW} n WHERE NOT EXISTS (SELECT 1 FROM {_OLD} o WHERE o.key = n.key))"""


def _old_and_new(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The index of versions 1.41 and 1.42, and the contents of 1.42 and 1.43 that replace it. Old ids are the key order by ranges of the key's first digits."""
    c = latest(table(spark, d, "chunks"), "chunk_id", keep=("version", "text")).where("text is not null").select("version", F.sha2("text", 256).alias("key"))
    old = c.where("version in ('1.41', '1.42')").select("key").distinct().withColumn("_r", F.substring("key", 1, 2))
    before = old.groupBy("_r").agg(F.count("*").alias("c")).withColumn("before", F.sum("c").over(Window.orderBy("_r")) - F.col("c")).select("_r", "before")
    numbered = old.join(F.broadcast(before), "_r").select("key", (F.col("before") + F.row_number().over(Window.partitionBy("_r").orderBy("key"))).alias("id"))
    return numbered, c.where("version in ('1.42', '1.43')").select("key")


@query("sync_plan", f"WITH {_PLAN} SELECT key, CAST(id AS BIGINT) AS id, action FROM P")
def sync_plan(spark: SparkSession, d: str) -> DataFrame:
    return sync.sync_plan(*_old_and_new(spark, d))


@query("sync_stats", f"WITH {_PLAN} SELECT action, count(*) AS contents, CAST(sum(coalesce(o.n, 0)) AS BIGINT) AS occurrences FROM P LEFT JOIN (SELECT sha256(text) AS key, count(*) AS n FROM {CHUNKS} WHERE version IN ('1.42', '1.43') AND text IS NOT NULL GROUP BY 1) o USING (key) GROUP BY action")
def sync_stats(spark: SparkSession, d: str) -> DataFrame:
    """Contents by action, and their occurrences in the new versions."""
    old, new = _old_and_new(spark, d)
    return sync.sync_stats(sync.sync_plan(old, new), new)


@query("cascade_survivors", f"WITH {_PLAN} SELECT v.content_id, v.model FROM (SELECT DISTINCT content_id, model FROM content_vectors) v WHERE v.content_id IN (SELECT id FROM P WHERE action <> 'delete')")
def cascade_survivors(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "content_vectors").select("content_id", "model").distinct()
    return sync.surviving(v, sync.sync_plan(*_old_and_new(spark, d)), "content_id")


@query("cache_latest", "SELECT user_id, event_type, arg_max(value, event_id) AS value, count(*) AS writes FROM events GROUP BY 1, 2")
def cache_latest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("value"), F.count("*").alias("writes"))


_BALANCE = "(SELECT event_id, user_id, ts, sum(CAST(value AS DECIMAL(18,6))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS balance FROM events)"


@query("ledger_running_balance", f"SELECT event_id, user_id, CAST(balance AS DOUBLE) AS balance FROM {_BALANCE}")
def ledger_running_balance(spark: SparkSession, d: str) -> DataFrame:
    b = ledger.running_balance(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("value"))
    return b.select("event_id", "user_id", F.col("balance").cast("double").alias("balance"))


@query("budget_refusals", f"SELECT user_id, count(*) AS refused, min(event_id) AS one FROM {_BALANCE} WHERE balance > 500 GROUP BY user_id")
def budget_refusals(spark: SparkSession, d: str) -> DataFrame:
    b = ledger.running_balance(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("value"))
    return ledger.over_budget(b, 500.0).groupBy("user_id").agg(F.count("*").alias("refused"), F.min("event_id").alias("one"))


_PRICES = "(VALUES ('baseline', 1.0, 5.0, 1.25), ('default', 1.0, 5.0, 1.25), ('e5-rerank', 3.0, 15.0, 3.75), ('e7-hyde', 3.0, 15.0, 3.75), ('e8-small', 0.25, 1.25, 0.3)) p(run, i, o, c)"


@query(
    "usage_cost",
    f"SELECT a.row_id, round(CASE WHEN a.row_id % 2 = 0 THEN (usage.input_tokens * i::DOUBLE + usage.output_tokens * o::DOUBLE) / 1000000 * 0.5 ELSE (usage.input_tokens * i::DOUBLE + usage.output_tokens * o::DOUBLE) / 1000000 END, 9) AS cost, round((usage.input_tokens * greatest(i, c)::DOUBLE + 1024 * o::DOUBLE) / 1000000, 9) AS worst FROM {ANSWERS} a LEFT JOIN {_PRICES} ON p.run = a.run",
)
def usage_cost(spark: SparkSession, d: str) -> DataFrame:
    """Costs from a price table of a few rows; every second answer came in a batch. A run without a price has null costs."""
    prices = spark.createDataFrame([("baseline", 1.0, 5.0, 1.25), ("default", 1.0, 5.0, 1.25), ("e5-rerank", 3.0, 15.0, 3.75), ("e7-hyde", 3.0, 15.0, 3.75), ("e8-small", 0.25, 1.25, 0.3)], "run string, i double, o double, c double")
    a = latest(table(spark, d, "generation_rows"), "row_id", keep=("run", "usage")).join(F.broadcast(prices), "run", "left")
    tokens = (F.col("usage.input_tokens"), F.col("usage.output_tokens"))
    return a.select("row_id", ledger.usage_cost(*tokens, F.col("i"), F.col("o"), F.col("row_id") % 2 == 0).alias("cost"), ledger.worst_case(tokens[0], F.lit(1024), F.col("i"), F.col("c"), F.col("o")).alias("worst"))


@query(
    "order_revenue",
    """SELECT n_name, date_trunc('month', o_orderdate) AS month, count(DISTINCT o_orderkey) AS orders, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""",
)
def order_revenue(spark: SparkSession, d: str) -> DataFrame:
    """Facts joined with their dimensions, reduced per order before the distinct count."""
    line, orders, customer, nation = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    per_order = line.groupBy("l_orderkey").agg(F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")).alias("r"))
    joined = per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name", F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")).agg(F.count("*").alias("orders"), F.sum("r").cast("double").alias("revenue"))


@query("rate_window_counts", "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS n FROM events")
def rate_window_counts(spark: SparkSession, d: str) -> DataFrame:
    return ledger.requests_in_window(table(spark, d, "events"), "user_id", "ts", 60).select("event_id", "user_id", "n")


@query(
    "rate_limiter",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL), r AS (
    SELECT user_id, event_id, n, true AS admitted, [t] AS recent FROM e WHERE n = 1 UNION ALL
    SELECT e.user_id, e.event_id, e.n, len(list_filter(r.recent, lambda x: x > e.t - 3600000000)) < 5, CASE WHEN len(list_filter(r.recent, lambda x: x > e.t - 3600000000)) < 5 THEN list_append(list_filter(r.recent, lambda x: x > e.t - 3600000000), e.t) ELSE list_filter(r.recent, lambda x: x > e.t - 3600000000) END
    FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1) SELECT user_id, event_id, admitted FROM r""",
)
def rate_limiter(spark: SparkSession, d: str) -> DataFrame:
    """Admitted requests only count against the limit, so each decision hangs on those before it."""
    return ledger.admitted(table(spark, d, "events"), "user_id", "ts", "event_id", 5, 3600)


@query("tumbling_event_counts", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS events, round(CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_event_counts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum(F.col("value").cast("decimal(18,6)")).cast("double"), 4).alias("total"))


@query(
    "session_counts",
    """WITH e AS (SELECT user_id, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) <= 1800 THEN 0 ELSE 1 END AS s FROM events), n AS (SELECT *, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM e)
    SELECT user_id, session, count(*) AS events, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_s, CAST(floor(epoch(max(ts))) AS BIGINT) AS end_s FROM n GROUP BY 1, 2""",
)
def session_counts(spark: SparkSession, d: str) -> DataFrame:
    s = ledger.sessions(table(spark, d, "events"), "user_id", "ts", 1800)
    return s.select("user_id", "session", "events", F.col("start").cast("long").alias("start_s"), F.col("end").cast("long").alias("end_s"))


_MENTIONS = "(SELECT id, version, list_filter(list_transform(list_filter(string_split_regex(question, '[^0-9A-Za-z_.]+'), lambda w: regexp_matches(w, '^v?1\\.\\d\\d(\\.\\d+)?\\.?$')), lambda w: regexp_extract(w, '^v?(1\\.\\d\\d)', 1)), lambda m: m <> '') AS mentions FROM " + ITEMS + ")"


@query("version_mentions", f"SELECT id, array_to_string(mentions, ',') AS mentions FROM {_MENTIONS} WHERE len(mentions) > 0")
def version_mentions(spark: SparkSession, d: str) -> DataFrame:
    i = latest(table(spark, d, "golden_items"), "id", keep=("version", "question")).select("id", T.version_mentions(F.col("question")).alias("m"))
    return i.where(F.size("m") > 0).select("id", F.array_join("m", ",").alias("mentions"))


@query(
    "version_choice",
    f"""WITH k AS (SELECT list_sort(list(DISTINCT version)) AS vs FROM chunks), w AS (SELECT id, coalesce(version, mentions[1]) AS wanted, (SELECT vs FROM k) AS vs FROM {_MENTIONS})
    SELECT id, CASE WHEN list_contains(vs, wanted) THEN wanted ELSE vs[len(vs)] END AS version, CASE WHEN wanted IS NULL THEN '' WHEN list_contains(vs, wanted) THEN '' ELSE 'version ' || wanted || ' is not indexed' END AS note FROM w""",
)
def version_choice(spark: SparkSession, d: str) -> DataFrame:
    """The version asked for, else the first one named in the question, else the newest; one that isn't indexed gives the newest and a note."""
    known = table(spark, d, "chunks").groupBy().agg(F.array_sort(F.transform(F.collect_set("version"), lambda v: F.struct(T.version_key(v).alias("k"), v.alias("v")))).alias("vs"))  # one row
    i = latest(table(spark, d, "golden_items"), "id", keep=("version", "question")).select("id", F.coalesce("version", F.try_element_at(T.version_mentions(F.col("question")), F.lit(1))).alias("wanted")).crossJoin(F.broadcast(known))
    names = F.transform("vs", lambda s: s["v"])
    indexed = F.coalesce(F.array_contains(names, F.col("wanted")), F.lit(False))
    note = F.when(F.col("wanted").isNull() | indexed, "").otherwise(F.concat(F.lit("version "), "wanted", F.lit(" is not indexed")))
    return i.select("id", F.when(indexed, F.col("wanted")).otherwise(F.element_at(names, -1)).alias("version"), note.alias("note"))


@query("response_cache_keys", "SELECT md5(trim(regexp_replace(lower(question), '\\s+', ' ', 'g'), ' ') || '|' || coalesce(version, '')) AS key, count(*) AS items, min(id) AS first_id FROM " + ITEMS + " WHERE question IS NOT NULL GROUP BY 1")
def response_cache_keys(spark: SparkSession, d: str) -> DataFrame:
    i = latest(table(spark, d, "golden_items"), "id", keep=("question", "version")).where("question is not null")
    key = F.md5(F.concat(T.normalised(F.lower("question")), F.lit("|"), F.coalesce("version", F.lit(""))))
    return i.groupBy(key.alias("key")).agg(F.count("*").alias("items"), F.min("id").alias("first_id"))


@query("embed_estimate", "SELECT index_name, count(*) AS texts, CAST(floor(sum(CAST(coalesce(n_tokens, 0) AS BIGINT)) * 11 / 10) + count(*) AS BIGINT) AS tokens FROM contents GROUP BY index_name")
def embed_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "contents").groupBy("index_name").agg(F.count("*").alias("texts"), (F.floor(F.sum(F.coalesce(F.col("n_tokens").cast("long"), F.lit(0))) * 11 / 10) + F.count("*")).alias("tokens"))


@query("query_log", f"SELECT row_id, concat('{{\"id\":\"', id, '\",\"version\":\"', version, '\",\"hits\":', len(retrieved), ',\"cited\":', len(list_distinct(list_transform(sources, lambda s: s.url))), '}}') AS line FROM {ANSWERS}")
def query_log(spark: SparkSession, d: str) -> DataFrame:
    """One JSON line per answer, as the log sink appends it."""
    a = latest(table(spark, d, "generation_rows"), "row_id", keep=("id", "version", "retrieved", "sources"))
    line = F.to_json(F.struct("id", "version", F.size("retrieved").alias("hits"), F.size(F.array_distinct(F.transform("sources", lambda s: s["url"]))).alias("cited")))
    return a.select("row_id", line.alias("line"))


@query(
    "sse_events",
    f"SELECT row_id, CAST(u.o - 1 AS INT) AS pos, concat('event: ', u.e, chr(10), 'data: ', row_id, chr(10), chr(10)) AS frame FROM (SELECT row_id, CASE WHEN coalesce(found, false) THEN ['version', 'hits', 'answer'] ELSE ['version', 'hits', 'error'] END AS es FROM {ANSWERS}) a, unnest(a.es) WITH ORDINALITY u(e, o)",
)
def sse_events(spark: SparkSession, d: str) -> DataFrame:
    a = latest(table(spark, d, "generation_rows"), "row_id", keep=("found",))
    names = F.array(F.lit("version"), F.lit("hits"), F.when(F.coalesce("found", F.lit(False)), "answer").otherwise("error"))
    return a.select("row_id", F.posexplode(names).alias("pos", "e")).select("row_id", "pos", F.concat(F.lit("event: "), "e", F.lit("\ndata: "), F.col("row_id").cast("string"), F.lit("\n\n")).alias("frame"))


@query(
    "example_export",
    f"""SELECT a.row_id, string_agg(left(coalesce(c.text, '(missing)'), 700), chr(10) || '---' || chr(10) ORDER BY u.o) AS passages, count(*) FILTER (c.chunk_id IS NULL) AS missing
    FROM {ANSWERS} a, unnest(a.retrieved) WITH ORDINALITY u(chunk, o) LEFT JOIN {CHUNKS} c ON c.chunk_id = u.chunk GROUP BY a.row_id""",
)
def example_export(spark: SparkSession, d: str) -> DataFrame:
    """The texts of an answer's retrieved chunks, cut at 700 characters, in their order; lists are as short as a config's k."""
    a = latest(table(spark, d, "generation_rows"), "row_id", keep=("retrieved",)).select("row_id", F.posexplode("retrieved").alias("pos", "chunk_id"))
    c = latest(table(spark, d, "chunks"), "chunk_id", keep=("text",)).select("chunk_id", F.left("text", F.lit(700)).alias("t"), F.lit(True).alias("known"))
    joined = a.join(c, "chunk_id", "left")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("t", F.lit("(missing)")).alias("t")))), lambda s: s["t"])
    return joined.groupBy("row_id").agg(F.array_join(ordered, "\n---\n").alias("passages"), F.count_if(F.col("known").isNull()).alias("missing"))


@query("hits_per_page", f"SELECT config_id, regexp_replace(url, '#.*$', '') AS page, count(*) AS hits, count(DISTINCT question_id) AS questions, min(rank) AS best_rank FROM {_RANKED} GROUP BY 1, 2")
def hits_per_page(spark: SparkSession, d: str) -> DataFrame:
    """One page holds a tenth of all hits: partial aggregation reduces it before the shuffle, also for the distinct questions."""
    return ranked_hits(spark, d).groupBy("config_id", F.regexp_replace("url", "#.*$", "").alias("page")).agg(F.count("*").alias("hits"), F.countDistinct("question_id").alias("questions"), F.min("rank").alias("best_rank"))


@query("late_rows", f"SELECT config_id, count(*) AS hits, CAST(count(*) FILTER (epoch(loaded_at) - epoch(retrieved_at) > 86400) AS BIGINT) AS late FROM {HITS} GROUP BY config_id")
def late_rows(spark: SparkSession, d: str) -> DataFrame:
    h = latest(table(spark, d, "hits").where("score is not null and not isnan(score)"), "question_id", "config_id", "content_id", keep=("loaded_at", "retrieved_at"))
    return h.groupBy("config_id").agg(F.count("*").alias("hits"), F.count_if(F.col("loaded_at").cast("double") - F.col("retrieved_at").cast("double") > 86400).alias("late"))
