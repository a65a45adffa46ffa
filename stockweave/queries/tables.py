"""Config, status and job tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockweave.operators.tables import (
    job_progress,
    latest_completed,
    latest_status,
    list_page,
    lookup,
    merge_status,
    queue_view,
    status_domain_check,
    status_with_fallback,
    success_summary,
    unknown_updates,
)
from stockweave.queries.views import (
    SQL_CONFIGS,
    SQL_JOBS,
    SQL_LATEST,
    SQL_STATUS_EVENTS,
    bare_configs,
    configs,
    job_queue,
    status_events,
    table,
)
from stockweave.sources.records import parse_jobs

QUERIES = {}
ORACLE = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def c1_list_page(spark, d):
    return list_page(table(spark, d, "orders"), {"o_orderstatus": "F"}, sort="o_orderdate",
                     key="o_orderkey", page=3, size=10)


ORACLE["c1_list_page"] = """
SELECT *, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total, 3 AS page
FROM orders WHERE o_orderstatus = 'F'
ORDER BY o_orderdate DESC, o_orderkey ASC LIMIT 10 OFFSET 20"""


@query
def c1_list_configs(spark, d):
    kept = configs(spark, d).select("config_id", "name", "mode", "status", "created_at")
    return list_page(kept, {"mode": "append", "status": ""}).drop("created_at")


ORACLE["c1_list_configs"] = f"""
WITH {SQL_CONFIGS}
SELECT config_id, name, mode, status, total, page FROM (
  SELECT *, count(*) OVER () AS total, 1 AS page FROM configs WHERE mode = 'append')
ORDER BY created_at DESC, config_id ASC LIMIT 10"""


@query
def c2_lookup(spark, d):
    """Every customer asked for in orders; configs exist only for users."""
    asked = table(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("config_id")
    ).distinct()
    return lookup(bare_configs(spark, d).select("config_id", "name", "mode"), asked)


ORACLE["c2_lookup"] = """
WITH c AS (SELECT user_id, CASE WHEN user_id % 3 = 0 AND user_id >= 3 THEN 'append'
                                ELSE 'replace' END AS mode
           FROM events GROUP BY user_id)
SELECT cast(o_custkey AS varchar) AS config_id, 'cfg-' || user_id AS name, mode,
       user_id IS NOT NULL AS found
FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN c ON user_id = o_custkey"""


@query
def c3_latest_completed(spark, d):
    return latest_completed(configs(spark, d)).select(
        "config_id", "name", "model_path", "mode", "status", "n_rows"
    )


ORACLE["c3_latest_completed"] = f"""
WITH {SQL_CONFIGS}
SELECT config_id, name, model_path, mode, status, n_rows FROM configs
WHERE status = 'completed' ORDER BY created_at DESC, config_id DESC LIMIT 1"""


def with_micros(df):
    return df.withColumn("updated_at", F.unix_micros("updated_at"))


@query
def c4_latest_status(spark, d):
    return with_micros(latest_status(status_events(spark, d)))


SQL_STATE = "status, error, progress, epoch_us(updated_at) AS updated_at"
ORACLE["c4_latest_status"] = f"WITH {SQL_LATEST} SELECT config_id, {SQL_STATE} FROM latest"


@query
def c5_merge_status(spark, d):
    merged = merge_status(bare_configs(spark, d), latest_status(status_events(spark, d)))
    return with_micros(merged).drop("created_at")


ORACLE["c5_merge_status"] = f"""
WITH {SQL_CONFIGS}
SELECT config_id, name, model_path, mode, previous_version, n_rows, {SQL_STATE} FROM configs"""


@query
def c5_unknown_updates(spark, d):
    """Only the configs that replace are known here."""
    known = bare_configs(spark, d).where("mode = 'replace'")
    return with_micros(unknown_updates(known, latest_status(status_events(spark, d))))


ORACLE["c5_unknown_updates"] = f"""
WITH {SQL_CONFIGS}
SELECT config_id, {SQL_STATE}, 'config not found' AS reason FROM configs WHERE mode = 'append'"""


@query
def c6_status_with_fallback(spark, d):
    """Status at the time of the last event, for users and for customers."""
    latest = latest_status(status_events(spark, d))
    asked = table(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("config_id")
    ).union(latest.select("config_id")).distinct()
    now = table(spark, d, "events").agg(F.max("ts").alias("now")).scalar()
    return status_with_fallback(asked, latest, bare_configs(spark, d), now)


ORACLE["c6_status_with_fallback"] = f"""
WITH {SQL_LATEST},
asked AS (SELECT cast(o_custkey AS varchar) AS config_id FROM orders
          UNION SELECT config_id FROM latest),
fresh AS (SELECT * FROM latest WHERE updated_at > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR)
SELECT a.config_id,
  CASE WHEN f.config_id IS NOT NULL THEN f.status
       WHEN l.config_id IS NOT NULL THEN 'pending' ELSE 'not_found' END AS status,
  coalesce(f.error, '') AS error, coalesce(f.progress, 0.0) AS progress,
  CASE WHEN f.config_id IS NOT NULL THEN 'fresh'
       WHEN l.config_id IS NOT NULL THEN 'stored' ELSE 'none' END AS source
FROM asked a LEFT JOIN fresh f USING (config_id) LEFT JOIN latest l USING (config_id)"""


@query
def c7_queue_view(spark, d):
    """All well-formed jobs in one queue; those with a purchase are done."""
    jobs = parse_jobs(job_queue(spark, d), "message")[0].withColumn("queue", F.lit("training"))
    done = table(spark, d, "events").where("event_type = 'purchase'").select(
        F.concat(F.lit("job-"), F.col("event_id").cast("string")).alias("config_id")
    )
    return queue_view(jobs, done)


ORACLE["c7_queue_view"] = f"""
WITH {SQL_JOBS},
waiting AS (SELECT j.* FROM jobs j JOIN events e USING (event_id) WHERE event_type <> 'purchase')
SELECT config_id, "timestamp", name, model_path, mode, 'training' AS queue,
  row_number() OVER (ORDER BY "timestamp", config_id) AS position,
  row_number() OVER (ORDER BY "timestamp" DESC, config_id DESC) AS newest,
  count(*) OVER () AS queue_length
FROM waiting"""


@query
def c8_job_progress(spark, d):
    return job_progress(status_events(spark, d))


ORACLE["c8_job_progress"] = f"""
WITH {SQL_STATUS_EVENTS}
SELECT config_id, cast(max(percent) AS integer) AS progress FROM status_events GROUP BY config_id"""


@query
def c9_status_domain_check(spark, d):
    """Raw event types checked as if they were statuses, next to mapped ones."""
    mapped = status_events(spark, d).select("event_id", F.coalesce("status", F.lit("?")).alias("status"))
    raw = table(spark, d, "events").select("event_id", F.col("event_type").alias("status"))
    return status_domain_check(mapped.unionAll(raw))


ORACLE["c9_status_domain_check"] = f"""
WITH {SQL_STATUS_EVENTS}
SELECT event_id, status, in_domain, NOT status IN ('pending', 'queued', 'processing') AS is_terminal
FROM (SELECT event_id, status, true AS in_domain FROM status_events
      UNION ALL SELECT event_id, event_type, false FROM events)"""


@query
def c10_success_summary(spark, d):
    calls = table(spark, d, "events").withColumn("ok", F.col("event_type") != "error")
    return success_summary(calls, ["user_id"])


ORACLE["c10_success_summary"] = """
SELECT user_id, count(*) FILTER (event_type <> 'error') AS n_ok, count(*) AS n_total,
       round(count(*) FILTER (event_type <> 'error') * 100 / count(*), 2) AS success_rate,
       round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000, 2) AS elapsed_seconds
FROM events GROUP BY user_id"""
