"""Event-time windows over the events table, as a table (see ``tessera.streaming`` for streams)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import ingest
from .registry import Tables, query


@query("v01_event_windows", "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def v01(v: Tables):
    return ingest.window_counts(v.events).select(F.unix_timestamp("window_start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("v02_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS session_start, count(*) AS n FROM s GROUP BY user_id, s.s")
def v02(v: Tables):
    return ingest.sessions(v.events).select("user_id", F.unix_timestamp("session_start").alias("session_start"), "n")
