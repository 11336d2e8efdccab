"""Kernels over series, each group's rows aggregated or bounded before they reach a task."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamill.operators import kernels
from stratamill.operators.landscape import landscape, offset_costs, quartile_cells
from stratamill.plans.catalog import catalog
from stratamill.plans.paths import events
from stratamill.session import table

query, QUERIES, ORACLE_SQL = catalog()

#: Hours of an atlas cell, and the widths of which the median counts; vector ids of a loop.
WIDTH, WIDTHS, LOOP = 4.0, (4.0, 6.0, 8.0), 160
#: Path: width of a state, states on either side of the anchor, scale of a step.
STEP, HALF, STEP_SCALE = 2.0, 40, 4.0

_TAPS = [math.exp(-0.5 * d * d) for d in range(-4, 5)]


def _smooth_sql(c: str) -> str:
    parts = [f"{w / sum(_TAPS)!r} * coalesce({'lag' if d < 0 else 'lead'}({c}, {abs(d)}) OVER o, {'first_value' if d < 0 else 'last_value'}({c}) OVER f)" for d, w in zip(range(-4, 5), _TAPS)]
    return " + ".join(parts)


def landscape_sql(width: float) -> str:
    """best to at_edge by event_type."""
    return f"""
WITH r0 AS (SELECT event_type, event_id % 2 AS side, round_even(epoch_us(ts) / 3.6e9 / {width}, 0)::BIGINT AS cell, value FROM events WHERE value IS NOT NULL AND NOT isnan(value)),
q AS (SELECT event_type, side, cell, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM r0 GROUP BY ALL),
e AS (SELECT event_type, cell, a, b, c, lag(cell) OVER w AS p, lag(a) OVER w AS pa, lag(b) OVER w AS pb, lag(c) OVER w AS pc FROM q WHERE side = 0 WINDOW w AS (PARTITION BY event_type ORDER BY cell)),
s AS (SELECT event_type, coalesce(p, cell) AS f, cell AS t, coalesce(pa, a) AS a0, coalesce(pb, b) AS b0, coalesce(pc, c) AS c0, a AS a1, b AS b1, c AS c1 FROM e WHERE cell - coalesce(p, cell) <= 2),
sc AS (SELECT event_type, CASE WHEN count(*) < 4 THEN 1.0 ELSE greatest(quantile_cont(b, 0.75) - quantile_cont(b, 0.25), 1.0) END AS scale FROM q WHERE side = 0 GROUP BY 1),
tr AS (SELECT event_type, cell, a, b, c, half, cell + half / 2.0::DOUBLE / {width} AS p FROM q, (SELECT unnest(range(-60, 61)) AS half) WHERE side = 1),
m AS (SELECT tr.event_type, half, cell, scale, b AS x, CASE WHEN t > f THEN (p - f) / (t - f) ELSE 0.0 END AS g, * EXCLUDE (event_type, half, cell, scale) FROM tr JOIN s ON tr.event_type = s.event_type AND ((f < t AND p > f AND p <= t) OR (f = t AND p = f)) JOIN sc ON sc.event_type = tr.event_type),
v AS (SELECT event_type, half, cell, scale, x, b0 + (b1 - b0) * g AS y, (abs(a - (a0 + (a1 - a0) * g)) + abs(b - (b0 + (b1 - b0) * g)) + abs(c - (c0 + (c1 - c0) * g))) / 3 AS away FROM m),
sm AS (SELECT *, {_smooth_sql("x")} AS sx, {_smooth_sql("y")} AS sy FROM v WINDOW o AS (PARTITION BY event_type, half ORDER BY cell), f AS (PARTITION BY event_type, half ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
st AS (SELECT *, cell - lag(cell) OVER o AS step, sx - lag(sx) OVER o AS dx, sy - lag(sy) OVER o AS dy FROM sm WINDOW o AS (PARTITION BY event_type, half ORDER BY cell)),
g AS (SELECT event_type, half, scale, count(*) AS cells, quantile_cont(away, 0.5) AS away, corr(sx, sy) AS r, least(stddev_pop(sx), stddev_pop(sy)) AS flat,
      quantile_cont(abs(dx - dy) / (step * {width}), 0.5) FILTER (WHERE step <= 2) AS steep, count(*) FILTER (WHERE step <= 2) AS near FROM st GROUP BY 1, 2, 3),
k AS (SELECT event_type, half / 2.0::DOUBLE AS o, cells, away / scale + 0.3 * CASE WHEN flat > 1e-8 THEN 1 - least(greatest(r, -1), 1) ELSE 1.0 END
      + 0.2 * CASE WHEN flat > 1e-8 AND near >= 3 THEN steep / greatest(scale / {width}, 1e-6) ELSE 1.0 END AS cost FROM g WHERE cells >= 6),
mi AS (SELECT event_type, quantile_cont(cost, 0.5) AS mid, arg_min(cost, (round(cost, 9), o)) AS low, arg_min(o, (round(cost, 9), o)) AS best, arg_min(cells, (round(cost, 9), o)) AS atc FROM k GROUP BY 1 HAVING count(*) >= 5),
ma AS (SELECT event_type, quantile_cont(abs(cost - mid), 0.5) AS mad FROM k JOIN mi USING (event_type) GROUP BY 1),
fo AS (SELECT event_type, best, atc, mid, low, mad, sum(exp(-least((cost - low) / greatest(mad, 0.05), 50)) * o) / sum(exp(-least((cost - low) / greatest(mad, 0.05), 50))) AS soft,
       max(o) FILTER (WHERE cost <= low + greatest(0.25 * mad, 0.03)) - min(o) FILTER (WHERE cost <= low + greatest(0.25 * mad, 0.03)) AS width FROM k JOIN mi USING (event_type) JOIN ma USING (event_type) GROUP BY 1, 2, 3, 4, 5, 6)
SELECT event_type, best, round(soft, 5) AS soft, round(CASE WHEN best IS NULL THEN 0 ELSE (mid - low) / greatest(mad, 1e-6) END, 5) AS sharpness, CASE WHEN best IS NULL THEN 60.0 ELSE width END AS width,
       coalesce(atc, 0)::BIGINT AS cells, CASE WHEN best IS NULL OR abs(best) >= 29.99 THEN 1.0 ELSE 0.0 END AS at_edge FROM (SELECT DISTINCT event_type FROM q) LEFT JOIN fo USING (event_type)"""


def lags(spark: SparkSession, sf_dir: str, width: float) -> DataFrame:
    rows = events(spark, sf_dir).filter("value IS NOT NULL AND NOT isnan(value)").withColumn("side", F.col("event_id") % 2)
    cells = quartile_cells(rows, "event_type", width)
    side = lambda k: cells.filter(F.col("side") == k).drop("side")
    found = landscape(offset_costs(side(1), side(0), "event_type", width), cells.select("event_type").distinct(), "event_type")
    return found.withColumns({c: F.round(c, 5) for c in ("soft", "sharpness")})


@query(landscape_sql(WIDTH))
def w15_offset_landscape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By how many hours the odd events of a type lag the even ones."""
    return lags(spark, sf_dir, WIDTH)


@query("SELECT event_type, round(quantile_cont(soft, 0.5), 3) AS offset FROM (" + " UNION ALL ".join(f"SELECT event_type, soft FROM ({landscape_sql(w)})" for w in WIDTHS) + ") GROUP BY 1")
def g6_offset_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median of the softened offsets of three cell widths."""
    parts = [lags(spark, sf_dir, w).select("event_type", "soft") for w in WIDTHS]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("event_type").agg(F.round(F.percentile("soft", 0.5), 3).alias("offset"))


@query()
def w14_cheapest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smooth path through each user's daily medians: Huber costs of the distance, quadratic costs of the steps."""
    daily = events(spark, sf_dir).groupBy("user_id", F.floor(F.col("x") / 24).alias("day")).agg(F.percentile("value", 0.5).alias("value")).filter("value IS NOT NULL AND NOT isnan(value)")

    def path(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("day")
        seen = frame["value"].to_numpy()
        states = seen[0] + STEP * np.arange(-HALF, HALF + 1)
        z = np.abs(states[None, :] - seen[:, None]) / 10.0
        unary = np.where(z <= 1, 0.5 * z * z, z - 0.5)
        steps = STEP * np.arange(-kernels.REACH, kernels.REACH + 1) / STEP_SCALE
        found, _ = kernels.cheapest_path(unary, np.tile(steps**2, (len(seen), 1)), np.abs(states - seen[0]) / STEP)
        return pd.DataFrame({"user_id": frame["user_id"], "day": frame["day"], "path": states[found].round(6)})

    return daily.groupBy("user_id").applyInPandas(path, "user_id long, day long, path double")


@query()
def w19_loop_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holonomy of loops through vectors of a label whose ids lie in one range of LOOP, and what it is in each step."""
    rows = table(spark, sf_dir, "embeddings").filter("embedding IS NOT NULL").select("label", F.floor(F.col("vec_id") / LOOP).alias("loop"), "vec_id", "embedding")

    def angle(frame: pd.DataFrame) -> pd.DataFrame:
        points = np.array(frame.sort_values("vec_id")["embedding"].tolist(), float)
        theta = kernels.loop_angle(points) if len(points) >= 3 else float("nan")
        lam = 2 - 2 * np.cos(theta / len(points))
        return pd.DataFrame({"label": frame["label"].iloc[:1], "loop": frame["loop"].iloc[:1], "n": [len(points)], "theta": [round(theta, 6)], "lambda": [round(float(lam), 8)]})

    return rows.groupBy("label", "loop").applyInPandas(angle, "label int, loop long, n long, theta double, lambda double")
