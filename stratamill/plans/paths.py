"""Ordered series, surveys and state machines over events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratamill.operators.interpolate import interpolate
from stratamill.plans.catalog import catalog
from stratamill.session import table

query, QUERIES, ORACLE_SQL = catalog()

# The edges of the law graph and the nodes that can always be entered.
EDGES = (
    "META_META>META META>RESTRICT RESTRICT>RESEARCH RESTRICT>PLAN RESEARCH>PLAN PLAN>GRAPH GRAPH>PROJECT GRAPH>LM_SCOUT GRAPH>CODE GRAPH>MEASURE "
    "PROJECT>ALIGN ALIGN>MEASURE ALIGN>PLAN ALIGN>CODE ALIGN>STOP LM_SCOUT>PROJECT LM_SCOUT>PLAN LM_SCOUT>CODE LM_SCOUT>MEASURE CODE>MEASURE "
    "CODE>CONDITION CODE>PROJECT MEASURE>CONDITION MEASURE>AUDIT MEASURE>ALIGN CONDITION>AUDIT CONDITION>GUARDIAN GUARDIAN>AUDIT GUARDIAN>ROTATE "
    "AUDIT>OPEN AUDIT>STOP OPEN>CLAIM OPEN>CERT STOP>ROTATE STOP>CLAIM ROTATE>RESTRICT ROTATE>PLAN ROTATE>GRAPH ROTATE>PROJECT CLAIM>CERT "
    "CERT>HALT OPEN>HALT STOP>HALT HALT>META_META OPEN>META STOP>META"
).split()
ALWAYS = ("META_META", "META", "HALT")
#: Nodes that the roles of a conversation and the types of an event stand for.
ROLES = {"system": "META", "user": "RESTRICT", "assistant": "RESEARCH"}
KINDS = {"signup": "META", "view": "MEASURE", "click": "AUDIT", "purchase": "OPEN", "error": "STOP"}

BY = "PARTITION BY user_id ORDER BY ts, event_id"
E = "(SELECT *, epoch_us(ts) / 3.6e9 AS x FROM events)"


def by_time():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their time in hours as x."""
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return rows.withColumn("x", F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9)


@query(f"""SELECT user_id, min(rn) FILTER (WHERE event_type = 'purchase') AS first_missing, coalesce(max(rn) FILTER (WHERE event_type <> 'purchase') < min(rn) FILTER (WHERE event_type = 'purchase'), true) AS contiguous
FROM (SELECT *, row_number() OVER ({BY}) AS rn FROM events) GROUP BY 1""")
def w1_prefix_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First missing row of each series, and whether what is known is one prefix; purchases count as missing."""
    rows = events(spark, sf_dir).withColumn("rn", F.row_number().over(by_time()).cast("long"))
    missing = F.min(F.when(F.col("event_type") == "purchase", F.col("rn")))
    known = F.max(F.when(F.col("event_type") != "purchase", F.col("rn")))
    return rows.groupBy("user_id").agg(missing.alias("first_missing"), F.coalesce(known < missing, F.lit(True)).alias("contiguous"))


@query(f"""SELECT event_id, round(CASE WHEN hs IS NULL THEN up WHEN hd IS NULL THEN down ELSE (hs * up + hd * down) / nullif(hs + hd, 0) END, 3) AS gradient FROM (
SELECT event_id, hs, hd, (after - value) / nullif(hd, 0) AS up, (value - before) / nullif(hs, 0) AS down FROM (
SELECT event_id, value, x - lag(x) OVER w AS hs, lead(x) OVER w - x AS hd, lag(value) OVER w AS before, lead(value) OVER w AS after FROM {E} WINDOW w AS ({BY})))""")
def w3_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second-order gradient on uneven spacing: the slopes on both sides, each weighted by the other side's step."""
    side = lambda c, f: f(c).over(by_time())
    rows = events(spark, sf_dir).withColumns({"hs": F.col("x") - side("x", F.lag), "hd": side("x", F.lead) - F.col("x"), "before": side("value", F.lag), "after": side("value", F.lead)})
    zero = F.lit(0.0)
    rows = rows.withColumns({"up": (F.col("after") - F.col("value")) / F.nullif("hd", zero), "down": (F.col("value") - F.col("before")) / F.nullif("hs", zero)})
    inner = (F.col("hs") * F.col("up") + F.col("hd") * F.col("down")) / F.nullif(F.col("hs") + F.col("hd"), zero)
    g = F.when(F.col("hs").isNull(), F.col("up")).when(F.col("hd").isNull(), F.col("down")).otherwise(inner)
    return rows.select("event_id", F.round(g, 3).alias("gradient"))


@query(f"SELECT event_id, round(lead(value, 5) OVER ({BY}) - value, 6) AS chord FROM events")
def w4_fixed_lag_chord(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference to the value five rows on."""
    return events(spark, sf_dir).select("event_id", F.round(F.lead("value", 5).over(by_time()) - F.col("value"), 6).alias("chord"))


@query(f"""SELECT event_id, round(list_sort(list_concat(list_concat(near, list_transform(range(greatest(0, 4 - rn)), lambda i: head)), list_transform(range(greatest(0, 3 - (n - rn))), lambda i: tail)))[4], 6) AS smooth FROM (
SELECT event_id, list(value) OVER ({BY} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near, row_number() OVER ({BY}) AS rn, count(*) OVER (PARTITION BY user_id) AS n,
first_value(value) OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS head, last_value(value) OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS tail FROM events)""")
def w5_median_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centred median of seven, the ends repeated."""
    whole = by_time().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = events(spark, sf_dir).select(
        "event_id",
        F.collect_list("value").over(by_time().rowsBetween(-3, 3)).alias("near"),
        F.row_number().over(by_time()).alias("rn"),
        F.count("*").over(Window.partitionBy("user_id")).alias("n"),
        F.first("value").over(whole).alias("head"),
        F.last("value").over(whole).alias("tail"),
    )
    left = F.array_repeat("head", F.greatest(F.lit(0), 4 - F.col("rn")))
    right = F.array_repeat("tail", F.greatest(F.lit(0), 3 - (F.col("n") - F.col("rn"))).cast("int"))
    return rows.select("event_id", F.round(F.sort_array(F.concat("near", left, right))[3], 6).alias("smooth"))


@query(f"""SELECT user_id, round(quantile_cont(abs(dv / gap), 0.5), 5) AS slope FROM (SELECT user_id, x - lag(x) OVER w AS gap, value - lag(value) OVER w AS dv FROM {E} WINDOW w AS ({BY})) WHERE gap > 0 AND gap <= 48 GROUP BY 1 HAVING count(*) >= 3""")
def w7_gap_aware_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median steepness over gaps of two days at most; series with three such gaps at least."""
    step = lambda c: F.col(c) - F.lag(c).over(by_time())
    rows = events(spark, sf_dir).withColumns({"gap": step("x"), "dv": step("value")}).filter("gap > 0 AND gap <= 48")
    return rows.groupBy("user_id").agg(F.round(F.percentile(F.abs(F.col("dv") / F.col("gap")), 0.5), 5).alias("slope"), F.count("*").alias("_n")).filter("_n >= 3").drop("_n")


@query(f"""WITH p AS (SELECT user_id, x, min(value) AS y FROM {E} GROUP BY 1, 2), g AS (SELECT user_id, unnest(range(ceil(min(x) / 24)::BIGINT, floor(max(x) / 24)::BIGINT + 1)) * 24.0::DOUBLE AS x FROM p GROUP BY 1),
f AS (SELECT g.user_id, g.x, a.x AS ax, a.y AS ay FROM g ASOF LEFT JOIN p a ON g.user_id = a.user_id AND g.x >= a.x),
h AS (SELECT f.*, b.x AS bx, b.y AS b_y FROM f ASOF LEFT JOIN p b ON f.user_id = b.user_id AND f.x <= b.x)
SELECT user_id, x, round(coalesce(ay + (b_y - ay) * (x - ax) / nullif(bx - ax, 0), ay, b_y), 5) AS value, round(CASE WHEN bx - ax <= 96 THEN coalesce(ay + (b_y - ay) * (x - ax) / nullif(bx - ax, 0), ay, b_y) END, 5) AS bounded FROM h""")
def j4_interpolated_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each series on a daily lattice (w10), interpolated, and only where points are within four days (j5)."""
    points = events(spark, sf_dir).select("user_id", "x", "value")
    span = points.groupBy("user_id").agg(F.ceil(F.min("x") / 24).alias("a"), F.floor(F.max("x") / 24).alias("b")).filter("a <= b")
    grid = span.select("user_id", F.explode(F.sequence("a", "b")).alias("d")).select("user_id", (F.col("d") * 24.0).alias("x"))
    found = interpolate(points, grid, "user_id", "x", "value", 96)
    return found.withColumns({c: F.round(c, 5) for c in ("value", "bounded")})


@query(f"""SELECT event_id, round(inc, 4) AS inclination, round(az, 4) AS azimuth, round(az + coalesce(sum(turn) OVER ({BY} ROWS UNBOUNDED PRECEDING), 0), 3) AS unwrapped FROM (
SELECT *, -360 * round_even((az - lag(az) OVER ({BY})) / 360, 0) AS turn FROM (
SELECT event_id, ts, user_id, degrees(acos(10 / sqrt(dx * dx + dy * dy + 100))) AS inc, CASE WHEN degrees(atan2(dx, dy)) < 0 THEN degrees(atan2(dx, dy)) + 360 ELSE degrees(atan2(dx, dy)) END AS az FROM (
SELECT *, value - lag(value) OVER ({BY}) AS dx, x - lag(x) OVER ({BY}) AS dy FROM {E}) WHERE dx IS NOT NULL))""")
def p9_survey_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inclination and azimuth of each step of a path (value east, hours north, 10 down), and the azimuth without jumps (p10)."""
    step = lambda c: F.col(c) - F.lag(c).over(by_time())
    rows = events(spark, sf_dir).withColumns({"dx": step("value"), "dy": step("x")}).filter("dx IS NOT NULL")
    length = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + 100)
    a = F.degrees(F.atan2("dx", "dy"))
    rows = rows.withColumns({"inc": F.degrees(F.acos(10 / length)), "az": F.when(a < 0, a + 360).otherwise(a)})
    rows = rows.withColumn("turn", -360 * F.rint(step("az") / 360))
    run = F.coalesce(F.sum("turn").over(by_time().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
    return rows.select("event_id", F.round("inc", 4).alias("inclination"), F.round("az", 4).alias("azimuth"), F.round(F.col("az") + run, 3).alias("unwrapped"))


@query(f"""SELECT user_id, count(*) AS n, round(avg(value) FILTER (WHERE r = 1) - avg(value), 6) AS deviation, round(stddev_pop(value), 6) AS spread, round(max(value) - min(value), 6) AS extent, round(coalesce(regr_slope(value, -r), 0), 6) AS slope
FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 30 GROUP BY 1""")
def a16_trailing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last thirty values of each series: deviation of the last, spread, extent and slope."""
    back = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = events(spark, sf_dir).withColumn("r", F.row_number().over(back)).filter("r <= 30")
    out = {"deviation": F.avg(F.when(F.col("r") == 1, F.col("value"))) - F.avg("value"), "spread": F.stddev_pop("value"), "extent": F.max("value") - F.min("value"), "slope": F.coalesce(F.regr_slope("value", -F.col("r")), F.lit(0.0))}
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), *(F.round(c, 6).alias(k) for k, c in out.items()))


@query("""SELECT user_id, round(coalesce(corr(a, b), 0), 6) AS spearman FROM (SELECT user_id, rank() OVER (PARTITION BY user_id ORDER BY ts) + (count(*) OVER (PARTITION BY user_id, ts) - 1) / 2 AS a,
rank() OVER (PARTITION BY user_id ORDER BY value) + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2 AS b FROM events) GROUP BY 1 HAVING count(*) >= 3""")
def a33_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of time and value, ties at their mean rank."""
    rank = lambda c: F.rank().over(Window.partitionBy("user_id").orderBy(c)) + (F.count("*").over(Window.partitionBy("user_id", c)) - 1) / 2
    rows = events(spark, sf_dir).select("user_id", rank("ts").alias("a"), rank("value").alias("b"))
    found = rows.groupBy("user_id").agg(F.count("*").alias("n"), F.corr("a", "b").alias("c")).filter("n >= 3")
    return found.select("user_id", F.round(F.coalesce(F.nanvl("c", F.lit(0.0)), F.lit(0.0)), 6).alias("spearman"))


@query("""SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY max((ts, event_id)) DESC) AS r FROM events GROUP BY 1, 2) WHERE r <= 3""")
def w17_recent_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three latest different event types of each user."""
    last = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id")).alias("at"))
    return last.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("at")))).filter("r <= 3").select("user_id", "event_type")


def legal(before, now):
    """Whether a step stays, follows an edge or enters a node that is always open; the first step is legal."""
    return before.isNull() | (before == now) | now.isin(*ALWAYS) | F.concat(before, F.lit(">"), now).isin(*EDGES)


def named(names: dict[str, str], column: str):
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.create_map(*pairs)[F.col(column)]


def legal_sql(b: str, c: str) -> str:
    return f"{b} IS NULL OR {b} = {c} OR {c} IN {ALWAYS} OR {b} || '>' || {c} IN {tuple(EDGES)}"


def named_sql(names: dict[str, str], column: str) -> str:
    return f"CASE {column} {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in names.items())} END"


@query(f"""SELECT conv_id, count(*) FILTER (WHERE NOT ({legal_sql("b", "c")})) AS illegal FROM (SELECT conv_id, c, lag(c) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM (SELECT conv_id, turn, {named_sql(ROLES, "role")} AS c FROM conversations)) GROUP BY 1""")
def w18_path_legality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Illegal steps of each conversation's path through the law graph."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", named(ROLES, "role").alias("c"))
    rows = rows.withColumn("b", F.lag("c").over(Window.partitionBy("conv_id").orderBy("turn")))
    return rows.groupBy("conv_id").agg(F.count_if(~legal(F.col("b"), F.col("c"))).alias("illegal"))


@query(f"""SELECT event_id, CASE WHEN measures >= 1 AND restricts >= 1 THEN 'OPEN' ELSE 'STOP' END AS state FROM (
SELECT event_id, event_type, count(*) FILTER (WHERE event_type = 'view') OVER w AS measures, count(*) FILTER (WHERE event_type = 'signup') OVER w AS restricts FROM events WINDOW w AS ({BY} ROWS UNBOUNDED PRECEDING)) WHERE event_type = 'purchase'""")
def st2_audit_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases are open after a view and a signup, else stopped."""
    run = by_time().rowsBetween(Window.unboundedPreceding, 0)
    seen = lambda k: F.count_if(F.col("event_type") == k).over(run)
    rows = events(spark, sf_dir).withColumns({"m": seen("view"), "r": seen("signup")}).filter("event_type = 'purchase'")
    return rows.select("event_id", F.when((F.col("m") >= 1) & (F.col("r") >= 1), "OPEN").otherwise("STOP").alias("state"))


@query("""SELECT user_id, array_to_string(list_filter(['click', 'purchase', 'view'], lambda x: NOT list_contains(seen, x)), ',') AS missing, len(list_filter(['click', 'purchase', 'view'], lambda x: NOT list_contains(seen, x))) = 0 AS open
FROM (SELECT user_id, list(DISTINCT event_type) AS seen FROM events GROUP BY 1)""")
def a40_purpose_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the required event types each user lacks."""
    need = F.array(F.lit("click"), F.lit("purchase"), F.lit("view"))
    rows = events(spark, sf_dir).groupBy("user_id").agg(F.array_except(need, F.collect_set("event_type")).alias("m"))
    return rows.select("user_id", F.array_join("m", ",").alias("missing"), (F.size("m") == 0).alias("open"))


@query("""SELECT event_type, count(*) AS n, round(max(value), 6) AS high, round(avg(value), 6) AS mean, count(*) FILTER (WHERE value > 90) AS over FROM events GROUP BY 1""")
def s15_log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, greatest and mean value of each kind of event."""
    return events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.max("value"), 6).alias("high"), F.round(F.avg("value"), 6).alias("mean"), F.count_if(F.col("value") > 90).alias("over"))


@query("""WITH p AS (SELECT l_orderkey, count(*) AS planes, count(*) FILTER (WHERE l_returnflag = 'R') AS dead, count(*) FILTER (WHERE l_linestatus = 'O' OR l_returnflag <> 'N') AS known FROM lineitem GROUP BY 1)
SELECT o_orderkey, (o_orderstatus = 'P')::INT + (coalesce(planes, 0) = 0)::INT + (CASE WHEN o_orderpriority <> '1-URGENT' THEN coalesce(dead, 0) ELSE 0 END) + (coalesce(planes, 0) > 1 AND coalesce(known, 0) = 0)::INT AS failed,
CASE WHEN o_orderstatus <> 'P' AND coalesce(planes, 0) > 0 AND (o_orderpriority = '1-URGENT' OR coalesce(dead, 0) = 0) AND NOT (coalesce(planes, 0) > 1 AND coalesce(known, 0) = 0) THEN 'OPEN' ELSE 'STOP' END AS verdict
FROM orders LEFT JOIN p ON o_orderkey = l_orderkey""")
def a39_certify_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on each claim (order) by its planes (lines, j13): no draft, a plane at least, no dead plane unless urgent, not all unknown."""
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    planes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("planes"), F.count_if(flag == "R").alias("dead"), F.count_if((status == "O") | (flag != "N")).alias("known"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority").join(planes, "o_orderkey", "left").na.fill(0, ["planes", "dead", "known"])
    dead = F.when(F.col("o_orderpriority") != "1-URGENT", F.col("dead")).otherwise(0)
    unknown = (F.col("planes") > 1) & (F.col("known") == 0)
    failed = (F.col("o_orderstatus") == "P").cast("int") + (F.col("planes") == 0).cast("int") + dead + unknown.cast("int")
    return rows.select("o_orderkey", failed.cast("long").alias("failed"), F.when(failed == 0, "OPEN").otherwise("STOP").alias("verdict"))


@query("""SELECT (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) AS unknown_ids, (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS unused_ids""")
def o4_id_set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that only one of two tables has."""
    left = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).distinct().withColumn("l", F.lit(1))
    right = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).distinct().withColumn("r", F.lit(1))
    return left.join(right, "id", "full").agg(F.count_if(F.col("r").isNull()).alias("unknown_ids"), F.count_if(F.col("l").isNull()).alias("unused_ids"))


@query("SELECT count(*) AS requests, count(DISTINCT sha256(text)) AS misses, count(*) - count(DISTINCT sha256(text)) AS hits FROM documents WHERE text IS NOT NULL")
def st6_content_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and misses of a cache by content."""
    seen = table(spark, sf_dir, "documents").filter("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("k")).agg(F.count("*").alias("n"))
    return seen.agg(F.sum("n").alias("requests"), F.count("*").alias("misses"), (F.sum("n") - F.count("*")).alias("hits"))
