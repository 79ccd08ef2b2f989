"""Queries X1 to X3 over events as streams, and the counter of the nearest-reference search."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import SHIFT_FEATURES, SHIFT_HISTOGRAMS
from ..operators import chain as ch
from ..operators import nearest as ne
from ..session import cut_lineage, shared_folder, shuffle_partitions
from ..streaming import chain_state, drain, replays, shift_windows
from . import inputs
from .catalog import Tables, query, with_sql
from .dataset import r6
from .records import _PREVIOUS, _recursive, _shift_sql


def _folder(t: Tables) -> str:
    return f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"


def _arriving(t: Tables, rows: DataFrame, folder: str, files: int, **options) -> DataFrame:
    """The rows as a stream of files in the shared folder, dealt out by hash: order of arrival says nothing."""
    rows.repartition(files, F.xxhash64(*rows.columns)).write.parquet(f"{folder}/in")
    return t.spark.readStream.schema(rows.schema).options(**options).parquet(f"{folder}/in")


@query("x1_stream_chain_issues", _recursive(inputs.TAMPERED, _PREVIOUS, "SELECT * FROM issues"))
def x1_stream_chain_issues(t: Tables):
    """The issues of all chains when their records arrive shuffled over several batches."""
    folder = _folder(t)
    half = max(2, shuffle_partitions(t.spark))  # files of each of two batches
    stream = _arriving(t, inputs.tampered(t), folder, 2 * half, maxFilesPerTrigger=half)
    return drain.drained(chain_state.stream_chain_issues(stream, ch.PROVENANCE), folder, "issues").drop("message")


_KEYS = {"record_hash": "sha256(event_type || CAST(value AS VARCHAR))", "nonce": "props", "sequence": "user_id"}


@query("x2_stream_replays", " UNION ALL ".join(
    f"SELECT '{k}' AS kind, count(*) AS repeated_values, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS replays FROM (SELECT {key} AS v, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1)"
    for k, key in _KEYS.items()))
def x2_stream_replays(t: Tables):
    """Values that come again within a watermark longer than the data: all uses but the first are replays."""
    folder = _folder(t)
    text = F.concat("event_type", F.col("value").cast("string")).cast("binary")
    rows = t.events.select(F.col("event_id").alias("record_id"), F.sha2(text, 256).alias("record_hash"), F.col("props").alias("nonce"),
                           F.col("user_id").alias("sequence"), F.col("ts").cast("timestamp").alias("ts"))
    stream = _arriving(t, rows, folder, 4, maxFilesPerTrigger=2)
    for running in replays.start_replay_streams(stream, folder, "400 days"):
        running.awaitTermination()
    arrivals = t.spark.read.schema(rows.schema).parquet(f"{folder}/arrivals")
    kept = lambda kind: t.spark.read.schema(f"record_id {rows.schema['record_id'].dataType.simpleString()}, kind string, value string, ts timestamp").parquet(f"{folder}/kept_{kind}")
    audits = [replays.replay_audit(arrivals, kept(kind), kind).where("outcome = 'replay'") for kind in replays.KINDS]
    return audits[0].unionByName(audits[1]).unionByName(audits[2]).groupBy("kind").agg(
        F.countDistinct("value").alias("repeated_values"), F.count(F.lit(1)).alias("replays"))


_WINDOWS = ("""candidates AS (SELECT s.*, e.ts FROM shift_rows s JOIN events e ON e.event_id = s.file WHERE population = 'candidate'),
windowed AS (SELECT unnest([date_trunc('day', ts) - INTERVAL 1 DAY, date_trunc('day', ts)]) AS start, * FROM candidates),
closed AS (SELECT * FROM windowed WHERE start + INTERVAL 2 DAY <= (SELECT max(ts) FROM candidates) - INTERVAL 1 HOUR)""",
            "window_means AS (" + " UNION ALL ".join(f"SELECT start, '{f}' AS feature, avg({f}) AS mean FROM closed GROUP BY start" for f in SHIFT_FEATURES) + ")",
            "window_bins AS (" + " UNION ALL ".join(
                f"SELECT start, '{h}' AS histogram, CAST(least(floor({f} * 16), 15) AS INTEGER) AS bin, count(*) AS n FROM closed WHERE {f} BETWEEN 0 AND 1 GROUP BY ALL"
                for f, h in zip(SHIFT_FEATURES, SHIFT_HISTOGRAMS)) + ")",
            "window_shares AS (SELECT *, n / sum(n) OVER (PARTITION BY start, histogram) AS share FROM window_bins)",
            """grid AS (SELECT start, histogram, bin FROM (SELECT DISTINCT start, histogram FROM window_bins), (SELECT unnest(range(16)) AS bin)),
window_variations AS (SELECT g.start, g.histogram, 0.5 * sum(abs(coalesce(w.share, 0) - coalesce(r.share, 0))) AS distance FROM grid g LEFT JOIN window_shares w USING (start, histogram, bin)
  LEFT JOIN (SELECT * FROM hist_shares WHERE population = 'reference') r USING (histogram, bin) GROUP BY ALL),
window_distances AS (SELECT start, avg(abs(w.mean - r.mean)) AS s, count(*) FILTER (abs(w.mean - r.mean) >= 0.08) AS n FROM window_means w JOIN summary r USING (feature) WHERE r.population = 'reference' GROUP BY start),
scored AS (SELECT start, n, 0.6 * s + 0.4 * (SELECT avg(distance) FROM window_variations v WHERE v.start = d.start) AS overall FROM window_distances d)""")


@query("x3_stream_shift_windows", with_sql(*_shift_sql("1.5"), *_WINDOWS, """
SELECT strftime(start, '%Y-%m-%d') AS first_day, (SELECT count(*) FROM closed c WHERE c.start = x.start) AS rows, round(overall, 6) AS overall_shift, n AS shifted_feature_count,
  CASE WHEN overall >= 0.2 THEN 'high' WHEN n >= 2 THEN 'medium' WHEN n = 1 THEN 'low' ELSE 'none' END AS severity FROM scored x"""))
def x3_stream_shift_windows(t: Tables):
    """Shift of every window of two days, sliding by one, against the first half of the month."""
    folder = _folder(t)
    rows = inputs.shift_rows(t, 1.5)
    means, shares = shift_windows.reference_profile(rows)
    late = rows.where("population = 'candidate'").join(t.events.select(F.col("event_id").alias("file"), F.col("ts").cast("timestamp").alias("ts")), "file")
    stream = _arriving(t, late, folder, 2)
    found = drain.drained(shift_windows.stream_overall_shift(stream, means, shares, size="2 days", slide="1 day", delay="1 hour"), folder, "windows", timers=False)
    return found.select(F.date_format("start", "yyyy-MM-dd").alias("first_day"), "rows", r6("overall_shift"), "shifted_feature_count", "severity")


_POINT = "CAST([o_totalprice / 500000 - 0.3, month(o_orderdate) / 12.0 - 0.5, CAST(o_orderpriority[1] AS INTEGER) / 5.0 - 0.5] AS DOUBLE[])"
_DISTANCE = "round(1 - greatest(-1, least(1, list_cosine_similarity(c.f, r.f))), 12)"


@query("a4_order_neighbours", f"""
WITH r AS (SELECT DISTINCT {_POINT} AS f FROM orders WHERE o_orderstatus <> 'P'),
c AS (SELECT o_orderkey, {_POINT} AS f FROM orders WHERE o_orderstatus = 'P')
SELECT o_orderkey, round(min({_DISTANCE}), 6) AS distance, true AS few_compared FROM c CROSS JOIN r GROUP BY ALL""")
def a4_order_neighbours(t: Tables):
    """Orders in progress against the settled and the open ones: the distance to the nearest one, and whether an order met less than a quarter
    of the reference vectors on average. Three features, so the bounds of the balls tell."""
    part = lambda c, by, minus: F.col(c).cast("double") / by - minus
    rows = t.orders.select("o_orderkey", "o_orderstatus", F.array(
        part("o_totalprice", 500000, 0.3), F.month("o_orderdate").cast("double") / 12.0 - 0.5,
        F.substring("o_orderpriority", 1, 1).cast("double") / 5.0 - 0.5).alias("features"))
    reference = rows.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("ref_index"), "features")
    candidates = rows.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"), "features")
    found = cut_lineage(ne.nearest_reference(candidates, reference, ball_rows=64))
    few = ne.visited_share(found, reference).select((F.col("share") < 0.25).alias("few")).scalar()
    return found.select(F.col("id").alias("o_orderkey"), r6("distance"), few.alias("few_compared"))
