"""Masks, lattices, feature blocks, selection over cells, and folds of session events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratamill.functions import text as X
from stratamill.operators.interpolate import interpolate
from stratamill.operators.spatial import components, cut
from stratamill.plans.catalog import catalog
from stratamill.plans.paths import BY, KINDS, E, by_time, events, legal, legal_sql, named, named_sql
from stratamill.plans.scores import PER, per_entity
from stratamill.plans.texts import LEXICAL, TURNS, turns
from stratamill.plans.vectors import cosine, vectors
from stratamill.session import table

query, QUERIES, ORACLE_SQL = catalog()

FINITE = "coalesce(isfinite(value), false)"


@query(f"SELECT event_id, event_type <> 'purchase' AND {FINITE} AS known, event_type = 'purchase' AND {FINITE} AS tail FROM events")
def p1_known_tail_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a row is known or is to be predicted; rows without a finite value are neither. Purchases count as unknown."""
    whole = F.coalesce(~F.isnan("value") & (F.abs("value") < float("inf")), F.lit(False))
    given = F.col("event_type") != "purchase"
    return table(spark, sf_dir, "events").select("event_id", (given & whole).alias("known"), (~given & whole).alias("tail"))


@query(f"""SELECT event_id, round(az - 360 * coalesce(sum(turn) OVER ({BY} ROWS UNBOUNDED PRECEDING), 0), 4) AS azimuth FROM (
SELECT event_id, ts, user_id, az, round_even((az - lag(az) OVER ({BY})) / 360, 0) AS turn FROM (SELECT *, (value * 7.3::DOUBLE) % 360 AS az FROM events))""")
def p10_unwrap_azimuth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angles of a full circle without their jumps of 360 degrees."""
    rows = events(spark, sf_dir).withColumn("az", (F.col("value") * 7.3) % 360)
    rows = rows.withColumn("turn", F.rint((F.col("az") - F.lag("az").over(by_time())) / 360))
    run = F.coalesce(F.sum("turn").over(by_time().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
    return rows.select("event_id", F.round(F.col("az") - 360 * run, 4).alias("azimuth"))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
SELECT vec_id, CASE WHEN len(e) <> len(f) OR list_dot_product(e, e) * list_dot_product(f, f) = 0 THEN 0.0 ELSE round(list_dot_product(e, f) / sqrt(list_dot_product(e, e) * list_dot_product(f, f)), 6) END AS similarity FROM (
SELECT a.vec_id, a.e, CASE a.vec_id % 10 WHEN 0 THEN b.e[1:32] WHEN 1 THEN list_transform(b.e, lambda x: 0.0::DOUBLE) ELSE b.e END AS f FROM v a JOIN v b ON b.vec_id = a.vec_id + 1)""")
def p14_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each vector and the next one, some of which are cut or set to zero first: those have a cosine of 0."""
    v = vectors(spark, sf_dir).select("vec_id", "e")
    at = F.col("vec_id") % 10
    other = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f")).withColumn("f", F.when(at == 0, F.slice("f", 1, 32)).when(at == 1, F.transform("f", lambda x: F.lit(0.0))).otherwise(F.col("f")))
    return v.join(other, "vec_id").select("vec_id", F.round(cosine(F.col("e"), F.col("f")), 6).alias("similarity"))


@query("""WITH r AS (SELECT l_orderkey AS k, count(*) AS roles, count(*) FILTER (WHERE l_returnflag <> 'R') AS good, coalesce(bool_or(l_linenumber = 2 AND l_returnflag = 'A'), false) AS fatal FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1),
a AS (SELECT o_orderkey, o_orderstatus, coalesce(roles, 0) AS roles, coalesce(good, 0) AS good, coalesce(fatal, false) AS fatal, CASE o_orderpriority WHEN '1-URGENT' THEN 'OPEN_CANDIDATE' WHEN '2-HIGH' THEN 'OPEN_CANDIDATE' WHEN '3-MEDIUM' THEN 'STOP' ELSE 'NEED_INFO' END AS v FROM orders LEFT JOIN r ON o_orderkey = k),
b AS (SELECT *, CASE WHEN roles > 0 AND good = 0 THEN 'ops_failed' WHEN good < roles THEN 'partial_ops' ELSE 'structured_ops' END AS regime FROM a),
c AS (SELECT *, CASE WHEN regime = 'ops_failed' OR (fatal AND v = 'OPEN_CANDIDATE') THEN 'STOP' WHEN v = 'OPEN_CANDIDATE' AND regime = 'partial_ops' THEN 'NEED_INFO' WHEN v = 'OPEN_CANDIDATE' AND o_orderstatus = 'P' THEN 'STOP' WHEN v = 'OPEN_CANDIDATE' AND o_orderstatus = 'O' THEN 'NEED_INFO' ELSE v END AS verdict FROM b)
SELECT o_orderkey, verdict, regime, CASE WHEN verdict = 'STOP' OR fatal THEN 'STOP' WHEN verdict = 'NEED_INFO' THEN 'NEED_INFO' ELSE 'PASS' END AS gate FROM c""")
def p18_policy_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict, regime and gate of each order, as if its first four lines were roles, its priority a proposed verdict and
    its status what a judge says: F agrees, O is neutral, P contradicts.

    Only a candidate is ever demoted: by a fatal falsifier or a contradiction to a stop, by a role that failed or a
    neutral judge to a request for information. With no role left it stops whatever was proposed.
    """
    line, flag = F.col("l_linenumber"), F.col("l_returnflag")
    roles = table(spark, sf_dir, "lineitem").filter(line <= 4).groupBy(F.col("l_orderkey").alias("o_orderkey"))
    roles = roles.agg(F.count("*").alias("roles"), F.count_if(flag != "R").alias("good"), F.coalesce(F.bool_or((line == 2) & (flag == "A")), F.lit(False)).alias("fatal"))
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus").join(roles, "o_orderkey", "left").na.fill(0, ["roles", "good"]).na.fill(False, ["fatal"])
    rows = rows.withColumn("v", F.when(priority.isin("1-URGENT", "2-HIGH"), "OPEN_CANDIDATE").when(priority == "3-MEDIUM", "STOP").otherwise("NEED_INFO"))
    rows = rows.withColumn("regime", F.when((F.col("roles") > 0) & (F.col("good") == 0), "ops_failed").when(F.col("good") < F.col("roles"), "partial_ops").otherwise("structured_ops"))
    demoted = F.when(F.col("fatal"), "STOP").when(F.col("regime") == "partial_ops", "NEED_INFO").when(status == "P", "STOP").when(status == "O", "NEED_INFO").otherwise(F.col("v"))
    rows = rows.withColumn("verdict", F.when(F.col("regime") == "ops_failed", "STOP").when(F.col("v") == "OPEN_CANDIDATE", demoted).otherwise(F.col("v")))
    gate = F.when((F.col("verdict") == "STOP") | F.col("fatal"), "STOP").when(F.col("verdict") == "NEED_INFO", "NEED_INFO").otherwise("PASS")
    return rows.select("o_orderkey", "verdict", "regime", gate.alias("gate"))


AUDITED = {"tax_mean": "avg(l_tax)", "price_spread": "max(l_extendedprice) - min(l_extendedprice)", "label_mean": "avg(l_quantity)"}
BLOCK_SQL = lambda label: "SELECT l_suppkey, " + ", ".join(f"{e} AS {k}" for k, e in AUDITED.items()) + f" FROM (SELECT * REPLACE ({label} AS l_quantity) FROM lineitem) GROUP BY 1"


@query("WITH a AS (" + BLOCK_SQL("l_quantity") + "), b AS (" + BLOCK_SQL("1000 - l_quantity") + ") " + " UNION ALL ".join(f"SELECT '{k}' AS feature, count(*) FILTER (WHERE abs(a.{k} - b.{k}) > 1e-9) > 0 AS leaks FROM a JOIN b USING (l_suppkey)" for k in AUDITED))
def p21_mutation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which features of a block change when the label column is altered, and so leak it."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_tax", "l_extendedprice", "l_quantity")
    block = lambda df, tag: df.groupBy("l_suppkey").agg(*(F.expr(e).alias(f"{tag}_{k}") for k, e in AUDITED.items()))
    both = block(rows, "a").join(block(rows.withColumn("l_quantity", 1000 - F.col("l_quantity")), "b"), "l_suppkey")
    counts = both.agg(*((F.count_if(F.abs(F.col(f"a_{k}") - F.col(f"b_{k}")) > 1e-9) > 0).alias(k) for k in AUDITED))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), F.col(k).alias("leaks")) for k in AUDITED))).alias("f")).select("f.*")


#: Width of a cell in hours, and how many of them a neighbour or a bracket may be away.
CELL, REACH = 24.0, 2.01
CELLS = f"(SELECT user_id, (floor(x / 24) + 0.5::DOUBLE) * 24 AS cx, round(avg(value), 6) AS cy FROM {E} WHERE event_type <> 'purchase' GROUP BY 1, 2)"


@query(f"""WITH c AS {CELLS}, q AS (SELECT event_id, user_id, x FROM {E} WHERE event_type = 'purchase'),
f AS (SELECT q.*, c.cx AS ax, c.cy AS ay FROM q ASOF LEFT JOIN c ON q.user_id = c.user_id AND q.x >= c.cx),
h AS (SELECT f.*, c.cx AS bx, c.cy AS b_y FROM f ASOF LEFT JOIN c ON f.user_id = c.user_id AND f.x <= c.cx)
SELECT event_id, round(CASE WHEN least(coalesce(x - ax, 1e9), coalesce(bx - x, 1e9)) > {CELL * REACH} OR coalesce(bx - ax, 0) > {CELL * REACH} THEN NULL WHEN ax IS NULL THEN b_y WHEN bx IS NULL OR bx = ax THEN ay ELSE ay + (b_y - ay) * (x - ax) / (bx - ax) END, 5) AS value FROM h""")
def j5_gap_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase on the daily means of its user's other events: linear, held at the ends, null where the nearest cell
    or the bracket is wider than REACH cells.

    One window by user over cells and purchases; no range join.
    """
    rows = events(spark, sf_dir)
    centre = (F.floor(F.col("x") / CELL) + 0.5) * CELL
    cells = rows.filter("event_type <> 'purchase'").groupBy("user_id", centre.alias("x")).agg(F.round(F.avg("value"), 6).alias("y"))
    asked = rows.filter("event_type = 'purchase'").select("user_id", "x", F.lit(None).cast("struct<x:double,y:double>").alias("p"), "event_id")
    both = cells.select("user_id", "x", F.struct("x", "y").alias("p"), F.lit(None).cast("long").alias("event_id")).unionByName(asked)
    by = Window.partitionBy("user_id").orderBy("x")
    both = both.withColumns({"a": F.last("p", True).over(by.rangeBetween(Window.unboundedPreceding, 0)), "b": F.first("p", True).over(by.rangeBetween(0, Window.unboundedFollowing))}).filter("event_id IS NOT NULL")
    gap = F.coalesce(F.col("b.x") - F.col("a.x"), F.lit(0.0))
    near = F.least(F.col("x") - F.col("a.x"), F.col("b.x") - F.col("x"))
    line = F.col("a.y") + (F.col("b.y") - F.col("a.y")) * (F.col("x") - F.col("a.x")) / F.nullif(gap, F.lit(0.0))
    found = F.when((near <= CELL * REACH) & (gap <= CELL * REACH), F.coalesce(line, "a.y", "b.y"))
    return both.select("event_id", F.round(found, 5).alias("value"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber % 3 AS plane, arg_max(l_returnflag, (l_linenumber, l_returnflag)) AS state FROM lineitem GROUP BY 1, 2)
SELECT o_orderkey, need AS plane, coalesce(state, 'MISSING') AS state FROM (SELECT o_orderkey, unnest(range(o_orderkey % 3 + 1)) AS need FROM orders) LEFT JOIN p ON l_orderkey = o_orderkey AND plane = need""")
def j13_required_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each plane that a claim (order) requires; of several rows of a plane the last counts, none is MISSING."""
    planes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_linenumber") % 3).cast("long").alias("plane")).agg(F.max_by("l_returnflag", F.struct("l_linenumber", "l_returnflag")).alias("state"))
    need = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.sequence(F.lit(0).cast("long"), F.col("o_orderkey") % 3)).alias("plane"))
    return need.join(planes, ["o_orderkey", "plane"], "left").select("o_orderkey", "plane", F.coalesce("state", F.lit("MISSING")).alias("state"))


@query(f"SELECT entity % 5 AS fold, round(quantile_cont(cand, 0.9) - quantile_cont(base, 0.9), 6) AS worsening FROM {PER} GROUP BY 1")
def a10_p90_worsening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By how much the 90th percentile of errors grows in each fold: a difference of quantiles, not a quantile of differences."""
    per = per_entity(spark, sf_dir).groupBy((F.col("entity") % 5).alias("fold"))
    return per.agg(F.round(F.percentile("cand", 0.9) - F.percentile("base", 0.9), 6).alias("worsening"))


@query("""SELECT l_suppkey, CASE WHEN count(e) < 20 OR sum(e * e) < 1e-8 THEN 0.0 ELSE round(greatest(0, least(1.5, sum(e * y) / sum(e * e))), 5) END AS shrink FROM (
SELECT l_suppkey, l_quantity - 25 AS y, CASE WHEN l_returnflag <> 'R' THEN 40 * (l_discount - 0.05) + 0.1 * (l_quantity - 25) END AS e FROM lineitem) GROUP BY 1""")
def a18_scalar_shrink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least-squares factor of an estimate, kept within 0 and 1.5; 0 with fewer than 20 estimates or with none that differs from 0."""
    y = F.col("l_quantity") - 25
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", y.alias("y"), F.when(F.col("l_returnflag") != "R", 40 * (F.col("l_discount") - 0.05) + 0.1 * y).alias("e"))
    sums = rows.groupBy("l_suppkey").agg(F.count("e").alias("n"), F.sum(F.col("e") * F.col("e")).alias("ee"), F.sum(F.col("e") * F.col("y")).alias("ey"))
    factor = F.greatest(F.lit(0.0), F.least(F.lit(1.5), F.col("ey") / F.col("ee")))
    return sums.select("l_suppkey", F.when((F.col("n") < 20) | (F.col("ee") < 1e-8), 0.0).otherwise(F.round(factor, 5)).alias("shrink"))


@query("""WITH f AS (SELECT l_linenumber, l_orderkey % 5 AS fold, count(*) AS n, sum(l_extendedprice) AS s, sum(l_extendedprice * l_extendedprice) AS ss FROM lineitem GROUP BY 1, 2),
g AS (SELECT *, (sum(s) OVER w - s) / nullif(sum(n) OVER w - n, 0) AS m FROM f WINDOW w AS (PARTITION BY l_linenumber))
SELECT round(1 - sum(ss - 2 * m * s + n * m * m) / (sum(ss) - sum(s) * sum(s) / sum(n)), 8) AS r2 FROM g WHERE m IS NOT NULL""")
def a20_oof_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the variance that a prediction made without a row's fold explains: the mean of its group in the other folds."""
    y = F.col("l_extendedprice")
    f = table(spark, sf_dir, "lineitem").groupBy("l_linenumber", (F.col("l_orderkey") % 5).alias("fold")).agg(F.count("*").alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("ss"))
    by = Window.partitionBy("l_linenumber")
    f = f.withColumn("m", (F.sum("s").over(by) - F.col("s")) / F.nullif(F.sum("n").over(by) - F.col("n"), F.lit(0).cast("long"))).filter("m IS NOT NULL")
    return f.agg(F.round(F.expr("1 - sum(ss - 2 * m * s + n * m * m) / (sum(ss) - sum(s) * sum(s) / sum(n))"), 8).alias("r2"))


@query("""WITH d AS (SELECT list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]{3,}')) AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d)
SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf, round(avgdl, 6) AS avgdl FROM (SELECT term, count(*) AS df FROM (SELECT unnest(t) AS term FROM d) GROUP BY 1), s""")
def a34_bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold each term, its inverse document frequency and the mean number of a document's terms.

    Texts are tokenised once: the documents' numbers of terms add up to the terms' numbers of documents.
    """
    docs = table(spark, sf_dir, "documents")
    n = docs.count()
    df = cut(docs.select(F.explode(X.retrieval_tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df")))
    mean = (df.agg(F.sum("df")).first()[0] or 0) / max(n, 1)
    return df.select("term", "df", F.round(F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"), F.round(F.lit(mean), 6).alias("avgdl"))


#: Weights of a Gaussian of one row's width, four rows to either side.
TAPS = {i: 2.718281828459045 ** (-i * i / 2) for i in range(-4, 5)}
TAPS = {i: w / sum(TAPS.values()) for i, w in TAPS.items()}


def near_sql(i: int) -> str:
    if i == 0:
        return "value"
    f, end = ("lag", "first_value") if i < 0 else ("lead", "last_value")
    return f"coalesce({f}(value, {abs(i)}) OVER ({BY}), {end}(value) OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"


@query("SELECT event_id, round(" + " + ".join(f"{w!r}::DOUBLE * {near_sql(i)}" for i, w in TAPS.items()) + ", 6) AS smooth FROM events")
def w6_gaussian_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each series smoothed by a Gaussian of nine rows, the ends repeated."""
    whole = by_time().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = events(spark, sf_dir).withColumns({"head": F.first("value").over(whole), "last": F.last("value").over(whole)})
    near = {i: F.coalesce(F.lag("value", -i).over(by_time()), F.col("head" if i < 0 else "last")) for i in TAPS if i}
    smooth = sum((w * near[i] if i else w * F.col("value") for i, w in TAPS.items()), F.lit(0.0))
    return rows.select("event_id", F.round(smooth, 6).alias("smooth"))


SPAN = f"(SELECT user_id, min(x) AS a, max(x) AS b FROM {E} GROUP BY 1)"
LATTICE = f"(SELECT user_id, unnest(range(ceil(a / 24)::BIGINT, floor(b / 24)::BIGINT + 1)) * 24.0::DOUBLE AS x FROM {SPAN} UNION SELECT user_id, a FROM {SPAN} UNION SELECT user_id, b FROM {SPAN})"


def lattice(points: DataFrame) -> DataFrame:
    """user_id, x: the multiples of a cell's width within each series, and its ends."""
    span = points.groupBy("user_id").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    low, high = F.ceil(F.col("a") / CELL), F.floor(F.col("b") / CELL)
    inner = F.when(low <= high, F.transform(F.sequence(low, high), lambda d: d * CELL)).otherwise(F.array().cast("array<double>"))
    return span.select("user_id", F.explode(F.array_distinct(F.concat(F.array("a", "b"), inner))).alias("x"))


@query(f"SELECT user_id, round(x, 5) AS x FROM {LATTICE}")
def w10_endpoint_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days within each series and the series' own ends."""
    return lattice(events(spark, sf_dir)).select("user_id", F.round("x", 5).alias("x"))


@query(f"""WITH p AS (SELECT user_id, x, min(value) AS y FROM {E} GROUP BY 1, 2), f AS (SELECT g.user_id, g.x, a.x AS ax, a.y AS ay FROM {LATTICE} g ASOF LEFT JOIN p a ON g.user_id = a.user_id AND g.x >= a.x),
h AS (SELECT f.*, b.x AS bx, b.y AS b_y FROM f ASOF LEFT JOIN p b ON f.user_id = b.user_id AND f.x <= b.x)
SELECT user_id, round(x, 5) AS x, round(coalesce(ay + (b_y - ay) * (x - ax) / nullif(bx - ax, 0), ay, b_y), 5) AS value FROM h""")
def s8_polyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each series, one point for each time, on the lattice that keeps its ends."""
    points = events(spark, sf_dir).select("user_id", "x", "value")
    found = interpolate(points, lattice(points), "user_id", "x", "value", CELL)
    return found.select("user_id", F.round("x", 5).alias("x"), F.round("value", 5).alias("value"))


@query(f"""SELECT user_id, count(*) AS points, count(*) FILTER (WHERE event_type <> 'purchase') AS known, round(avg(x), 4) AS centre_x, round(avg(value), 5) AS centre_y, sha256(string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id)) AS digest FROM {E} GROUP BY 1""")
def s7_geometries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, centroid and a digest of the points of each path, in order; a path's ids are gathered, as its polyline is."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda p: p["event_id"].cast("string"))
    digest = F.sha2(F.array_join(ids, ","), 256)
    means = {"centre_x": F.round(F.avg("x"), 4), "centre_y": F.round(F.avg("value"), 5)}
    return events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("points"), F.count_if(F.col("event_type") != "purchase").alias("known"), *(c.alias(k) for k, c in means.items()), digest.alias("digest"))


@query("""WITH a AS (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 60), b AS (SELECT * FROM a ORDER BY p_size DESC, p_partkey LIMIT 30)
SELECT p_partkey, row_number() OVER (ORDER BY round(p_retailprice / 1000 + p_size / 10, 6) DESC, p_partkey) AS rank FROM b QUALIFY rank <= 10""")
def t2_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten of thirty by a blend of scores; thirty of sixty by the second score; sixty of all by the first. Each stage is a top-k."""
    k = 10
    coarse = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size").orderBy(F.desc("p_retailprice"), "p_partkey").limit(max(6 * k, 16))
    fine = coarse.orderBy(F.desc("p_size"), "p_partkey").limit(max(3 * k, 8))
    blend = F.round(F.col("p_retailprice") / 1000 + F.col("p_size") / 10, 6)
    rank = F.row_number().over(Window.orderBy(F.desc(blend), "p_partkey")).cast("long")  # of thirty rows at most
    return fine.select("p_partkey", rank.alias("rank")).filter(F.col("rank") <= k)


@query(f"""SELECT conv_id, turn, len(list_distinct(list_concat(a, b))) AS n_union, len(list_intersect(a, b)) AS n_both, len(a) - len(list_intersect(a, b)) AS n_gained, len(b) - len(list_intersect(a, b)) AS n_lost, len(a) + len(b) - 2 * len(list_intersect(a, b)) AS n_either
FROM (SELECT conv_id, turn, {LEXICAL.format("text")} AS a, {LEXICAL.format("before")} AS b FROM ({TURNS}))""")
def o3_token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, intersection, both differences and symmetric difference of the words of consecutive turns."""
    rows = turns(spark, sf_dir).select("conv_id", "turn", X.lexical_tokens(F.col("text")).alias("a"), X.lexical_tokens(F.col("before")).alias("b"))
    sets = {"n_union": F.array_union("a", "b"), "n_both": F.array_intersect("a", "b"), "n_gained": F.array_except("a", "b"), "n_lost": F.array_except("b", "a")}
    rows = rows.select("conv_id", "turn", *(F.size(s).cast("long").alias(k) for k, s in sets.items()))
    return rows.withColumn("n_either", F.col("n_gained") + F.col("n_lost"))


@query("""WITH RECURSIVE o AS (SELECT c_custkey AS a, c_custkey + 5 AS b FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey + 5 IN (SELECT c_custkey FROM customer)), e AS (SELECT a, b FROM o UNION ALL SELECT b, a FROM o),
r AS (SELECT c_custkey AS id, c_custkey AS c FROM customer UNION SELECT e.b, r.c FROM r JOIN e ON r.id = e.a) SELECT id, min(c) AS component FROM r GROUP BY 1""")
def o7_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of a graph of customers, named by their least member; a customer without an edge is its own."""
    nodes = cut(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")))
    edges = nodes.filter("id % 4 <> 0").select(F.col("id").alias("a"), (F.col("id") + 5).alias("b"))
    return components(nodes, edges.join(nodes.select(F.col("id").alias("b")), "b", "left_semi"))


@query(f"SELECT doc_id, len(t) AS n_words, md5(array_to_string(list_sort(t), ' ')) AS words_md5 FROM (SELECT doc_id, {LEXICAL.format('coalesce(text, chr(32))')} AS t FROM documents)")
def f3_lexical_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words of each text, punctuation as space, without stop words."""
    rows = table(spark, sf_dir, "documents").select("doc_id", X.lexical_tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_words"), F.md5(F.array_join(F.array_sort("t"), " ")).alias("words_md5"))


@query(f"""SELECT user_id, round((a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b), 3) AS major, round((a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b * b), 3) AS minor, round(degrees(0.5 * atan2(2 * b, a - c)), 3) AS axis FROM (
SELECT user_id, var_pop(value) AS a, var_pop(before) AS c, covar_pop(value, before) AS b FROM (SELECT user_id, value, lag(value) OVER ({BY}) AS before FROM events) WHERE before IS NOT NULL GROUP BY 1)""")
def f29_principal_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eigenvalues and direction of the greater one of each series' 2 x 2 covariance with its own last value, in closed form."""
    rows = events(spark, sf_dir).withColumn("before", F.lag("value").over(by_time())).filter("before IS NOT NULL")
    c = rows.groupBy("user_id").agg(F.var_pop("value").alias("a"), F.var_pop("before").alias("c"), F.covar_pop("value", "before").alias("b"))
    half, away = F.expr("(a + c) / 2"), F.expr("sqrt((a - c) / 2 * (a - c) / 2 + b * b)")
    axis = F.degrees(F.expr("0.5D * atan2(2 * b, a - c)"))
    return c.select("user_id", F.round(half + away, 3).alias("major"), F.round(half - away, 3).alias("minor"), F.round(axis, 3).alias("axis"))


#: A score this many scales above the middle, and no less than the floor, cuts an edge; nodes need so many distinct orders.
CUT_SCALES, CUT_FLOOR, CUT_ORDERS = 1.5, 0.5, 50
NODES = "(SELECT l_suppkey AS k, regr_slope(l_extendedprice, l_quantity) AS g, count(DISTINCT l_orderkey) AS w FROM lineitem GROUP BY 1)"


@query(f"""WITH e AS (SELECT p.k, abs(q.g - p.g) AS score, p.w >= {CUT_ORDERS} AND q.w >= {CUT_ORDERS} AS fit FROM {NODES} p JOIN {NODES} q ON q.k = p.k + 1),
m AS (SELECT quantile_cont(score, 0.5) AS middle FROM e WHERE fit), s AS (SELECT 1.4826 * quantile_cont(abs(score - middle), 0.5) AS scale FROM e, m WHERE fit)
SELECT k, round(score, 4) AS score, coalesce(fit AND score > greatest({CUT_FLOOR}, middle + {CUT_SCALES} * scale), false) AS cut FROM e, m, s""")
def g11_cut_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between neighbouring nodes (suppliers) whose gradients differ by far more than is usual.

    Nodes with too few distinct trajectories (orders) can't establish a cut; the two numbers that decide come from
    aggregates.
    """
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.regr_slope("l_extendedprice", "l_quantity").alias("g"), F.countDistinct("l_orderkey").alias("w"))
    n = cut(n)
    other = n.select((F.col("k") - 1).alias("k"), F.col("g").alias("g2"), F.col("w").alias("w2"))
    e = n.join(other, "k").select("k", F.abs(F.col("g2") - F.col("g")).alias("score"), ((F.col("w") >= CUT_ORDERS) & (F.col("w2") >= CUT_ORDERS)).alias("fit"))
    middle = e.filter("fit").agg(F.percentile("score", 0.5)).first()[0]
    if middle is None:
        return e.select("k", F.round("score", 4).alias("score"), F.lit(False).alias("cut"))
    scale = 1.4826 * e.filter("fit").agg(F.percentile(F.abs(F.col("score") - middle), 0.5)).first()[0]
    far = F.col("fit") & (F.col("score") > max(CUT_FLOOR, middle + CUT_SCALES * scale))
    return e.select("k", F.round("score", 4).alias("score"), F.coalesce(far, F.lit(False)).alias("cut"))


CELLS_G15 = [0.25, 0.5, 0.75, 1.0, 1.25, 1.5]
E15, Y15 = "(40 * (l_discount - 0.05) + 0.1 * (l_quantity - 25))", "(l_quantity - 25)"


@query(f"""WITH s AS (SELECT l_suppkey % 5 AS outer_fold, l_partkey % 10 AS inner_fold, count(*) AS n, sum({E15} * {E15}) AS ee, sum({E15} * {Y15}) AS ey, sum({Y15} * {Y15}) AS yy FROM lineitem GROUP BY 1, 2),
c AS (SELECT outer_fold, cell, round(avg(sqrt(greatest(yy - 2 * cell * ey + cell * cell * ee, 0) / n)), 6) AS cost FROM s, (SELECT unnest({CELLS_G15})::DOUBLE AS cell) GROUP BY 1, 2)
SELECT outer_fold, arg_min(cell, (cost, cell)) AS cell, min(cost) AS cost FROM c GROUP BY 1""")
def g15_grid_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell of six with the least mean error over ten inner folds, for each outer fold; the least cell of equals."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).alias("outer_fold"), (F.col("l_partkey") % 10).alias("inner_fold"), F.expr(E15.replace("0.05", "0.05D").replace("0.1 ", "0.1D ")).alias("e"), F.expr(Y15).alias("y"))
    s = rows.groupBy("outer_fold", "inner_fold").agg(F.count("*").alias("n"), F.expr("sum(e * e)").alias("ee"), F.expr("sum(e * y)").alias("ey"), F.expr("sum(y * y)").alias("yy"))
    c = s.withColumn("cell", F.explode(F.array(*map(F.lit, CELLS_G15))))
    error = F.sqrt(F.greatest(F.expr("yy - 2 * cell * ey + cell * cell * ee"), F.lit(0.0)) / F.col("n"))
    c = c.groupBy("outer_fold", "cell").agg(F.round(F.avg(error), 6).alias("cost"))
    best = F.min(F.struct("cost", "cell"))
    return c.groupBy("outer_fold").agg(best.alias("b")).select("outer_fold", "b.cell", "b.cost")


@query("""SELECT fold, rows, cells, rows + 4 * cells AS work, row_number() OVER (ORDER BY rows + 4 * cells DESC, fold) = 1 AS worst FROM (
SELECT l_suppkey % 5 AS fold, count(*) AS rows, count(DISTINCT (l_partkey % 100, floor(l_extendedprice / 5000)::BIGINT)) AS cells FROM lineitem GROUP BY 1)""")
def g20_work_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and distinct cells of each fold, their weighted sum, and the fold with most of it; folds are few."""
    cells = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 5).alias("fold"), (F.col("l_partkey") % 100).alias("p"), F.floor(F.col("l_extendedprice") / 5000).alias("c")).agg(F.count("*").alias("n"))
    per = cells.groupBy("fold").agg(F.sum("n").alias("rows"), F.count("*").alias("cells")).withColumn("work", F.col("rows") + 4 * F.col("cells"))
    return per.withColumn("worst", F.row_number().over(Window.orderBy(F.desc("work"), "fold")) == 1)


@query(f"""WITH s AS (SELECT event_id, ts, user_id, event_type, x, degrees(acos(10 / sqrt(dx * dx + dy * dy + 100))) AS inc, degrees(atan2(dx, dy)) AS az FROM (SELECT *, value - lag(value) OVER ({BY}) AS dx, x - lag(x) OVER ({BY}) AS dy FROM {E}) WHERE dx IS NOT NULL),
a AS (SELECT *, first_value(inc) OVER ({BY}) AS inc0, lag(inc) OVER ({BY}) AS inc1, lag(az) OVER ({BY}) AS az1, x - lag(x) OVER ({BY}) AS step FROM s)
SELECT event_id, round(inc - 90, 3) AS inc_dev, round(inc - inc0, 3) AS inc_drift, round(((az - 30 + 90) % 180 + 180) % 180 - 90, 3) AS az_rel, round((inc - inc1) / nullif(step, 0), 3) AS build,
CASE WHEN inc1 IS NOT NULL THEN round(degrees(2 * asin(least(1, sqrt(sin(radians(inc - inc1) / 2) ** 2 + sin(radians(inc)) * sin(radians(inc1)) * sin(radians(az - az1) / 2) ** 2)))), 3) END AS dogleg FROM a""")
def g21_geometry_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each step of a path (value east, hours north, 10 down): deviation from level, drift since the first step,
    azimuth against a section of 30 degrees folded to a quarter turn, build for each hour, and the angle to the last step."""
    lag = lambda c: F.lag(c).over(by_time())
    rows = events(spark, sf_dir).withColumns({"dx": F.col("value") - lag("value"), "dy": F.col("x") - lag("x")}).filter("dx IS NOT NULL")
    rows = rows.withColumns({"inc": F.degrees(F.acos(10 / F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + 100))), "az": F.degrees(F.atan2("dx", "dy"))})
    rows = rows.withColumns({"inc0": F.first("inc").over(by_time()), "inc1": lag("inc"), "az1": lag("az"), "step": F.col("x") - lag("x")})
    half = lambda a, b: F.pow(F.sin(F.radians(F.col(a) - F.col(b)) / 2), 2)
    bend = half("inc", "inc1") + F.sin(F.radians("inc")) * F.sin(F.radians("inc1")) * half("az", "az1")
    dogleg = F.when(bend.isNotNull(), F.degrees(2 * F.asin(F.least(F.lit(1.0), F.sqrt(bend)))))
    out = {"inc_dev": F.col("inc") - 90, "inc_drift": F.col("inc") - F.col("inc0"), "az_rel": F.pmod(F.col("az") + 60, F.lit(180.0)) - 90, "build": (F.col("inc") - F.col("inc1")) / F.nullif("step", F.lit(0.0)), "dogleg": dogleg}
    return rows.select("event_id", *(F.round(c, 3).alias(k) for k, c in out.items()))


@query(f"""SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS measures, count(*) FILTER (WHERE event_type = 'click') AS audits, count(*) FILTER (WHERE claim AND m > 0 AND a > 0) AS accepted, count(*) FILTER (WHERE claim AND NOT (m > 0 AND a > 0)) AS refused, arg_max(event_type, (ts, event_id)) AS last
FROM (SELECT *, event_type = 'purchase' AS claim, count(*) FILTER (WHERE event_type = 'view') OVER w AS m, count(*) FILTER (WHERE event_type = 'click') OVER w AS a FROM events WINDOW w AS ({BY} ROWS UNBOUNDED PRECEDING)) GROUP BY 1""")
def st1_session_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session (user) folded from its appended events: measures (views), audits (clicks), and claims (purchases), which
    are refused before the session has one of both."""
    run = by_time().rowsBetween(Window.unboundedPreceding, 0)
    kind = lambda k: F.col("event_type") == k
    rows = events(spark, sf_dir).withColumns({"m": F.count_if(kind("view")).over(run), "a": F.count_if(kind("click")).over(run)})
    able = (F.col("m") > 0) & (F.col("a") > 0)
    out = {"measures": F.count_if(kind("view")), "audits": F.count_if(kind("click")), "accepted": F.count_if(kind("purchase") & able), "refused": F.count_if(kind("purchase") & ~able), "last": F.max_by("event_type", F.struct("ts", "event_id"))}
    return rows.groupBy("user_id").agg(*(c.alias(k) for k, c in out.items()))


@query(f"""SELECT event_id, b AS source, c AS target, ({legal_sql("b", "c")}) AS legal FROM (SELECT event_id, c, lag(c) OVER ({BY}) AS b FROM (SELECT *, {named_sql(KINDS, "event_type")} AS c FROM events))""")
def st3_law_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a step through the law graph, and whether the graph allows it."""
    rows = events(spark, sf_dir).withColumn("c", named(KINDS, "event_type"))
    rows = rows.withColumn("b", F.lag("c").over(by_time()))
    return rows.select("event_id", F.col("b").alias("source"), F.col("c").alias("target"), legal(F.col("b"), F.col("c")).alias("legal"))


@query(f"""SELECT user_id, least(3, count(*) FILTER (WHERE event_type = 'error' AND rn < coalesce(won, 1e18))) AS failures, CASE WHEN count(*) FILTER (WHERE event_type = 'error' AND rn < coalesce(won, 1e18)) >= 3 THEN 'FAILED' WHEN any_value(won) IS NOT NULL THEN 'DONE' ELSE 'PENDING' END AS status
FROM (SELECT *, min(rn) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id) AS won FROM (SELECT *, row_number() OVER ({BY}) AS rn FROM events)) GROUP BY 1""")
def st4_work_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terminal status of each item (user): done at its first purchase unless three errors came before it."""
    rows = events(spark, sf_dir).withColumn("rn", F.row_number().over(by_time()))
    rows = rows.withColumn("won", F.min(F.when(F.col("event_type") == "purchase", F.col("rn"))).over(Window.partitionBy("user_id")))
    failed = F.count_if((F.col("event_type") == "error") & (F.col("won").isNull() | (F.col("rn") < F.col("won"))))
    per = rows.groupBy("user_id").agg(failed.alias("f"), F.max("won").alias("won"))
    status = F.when(F.col("f") >= 3, "FAILED").when(F.col("won").isNotNull(), "DONE").otherwise("PENDING")
    return per.select("user_id", F.least(F.lit(3).cast("long"), F.col("f")).alias("failures"), status.alias("status"))


#: Most rounds of a loop that measures again until nothing changes.
ROUNDS = 8


@query(f"""WITH r AS (SELECT user_id, event_type, row_number() OVER ({BY}) AS rn, lag(event_type) OVER ({BY}) AS before FROM events), s AS (SELECT user_id, count(*) AS n, min(rn) FILTER (WHERE event_type = before) AS settled FROM r WHERE rn <= {ROUNDS} GROUP BY 1)
SELECT user_id, coalesce(settled, n) AS rounds, CASE WHEN n < 2 THEN NULL ELSE settled IS NOT NULL END AS stable FROM s""")
def st5_truth_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds until a claim (user) is judged twice alike, eight at most, and whether it was; unknown with fewer than two rounds."""
    rows = events(spark, sf_dir).withColumns({"rn": F.row_number().over(by_time()).cast("long"), "before": F.lag("event_type").over(by_time())}).filter(F.col("rn") <= ROUNDS)
    per = rows.groupBy("user_id").agg(F.count("*").alias("n"), F.min(F.when(F.col("event_type") == F.col("before"), F.col("rn"))).alias("settled"))
    return per.select("user_id", F.coalesce("settled", "n").alias("rounds"), F.when(F.col("n") >= 2, F.col("settled").isNotNull()).alias("stable"))


#: Least views of a reference, least known rows and least rows to predict of a series that can be used.
LEAST_VIEWS, LEAST_KNOWN, LEAST_TAIL = 12, 45, 8


@query(f"""SELECT user_id, known, tail, CASE WHEN views < {LEAST_VIEWS} THEN 'reference' WHEN NOT coalesce(head < rest, true) THEN 'prefix' WHEN known < {LEAST_KNOWN} THEN 'known' WHEN tail < {LEAST_TAIL} THEN 'tail' END AS reason FROM (
SELECT user_id, count(*) FILTER (WHERE given) AS known, count(*) FILTER (WHERE NOT given) AS tail, count(*) FILTER (WHERE event_type = 'view') AS views, max(rn) FILTER (WHERE given) AS head, min(rn) FILTER (WHERE NOT given) AS rest FROM (
SELECT user_id, event_type, rn, rn <= n - 8 OR (user_id % 3 = 0 AND event_type = 'signup') AS given FROM (SELECT *, row_number() OVER ({BY}) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events)) GROUP BY 1)""")
def s4_usable_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known rows and rows to predict of each series, and why it can't be used: a short reference, known values that are no
    prefix, too few of them, or too few rows to predict. Null where it can."""
    rows = events(spark, sf_dir).withColumns({"rn": F.row_number().over(by_time()), "n": F.count("*").over(Window.partitionBy("user_id"))})
    given = (F.col("rn") <= F.col("n") - 8) | ((F.col("user_id") % 3 == 0) & (F.col("event_type") == "signup"))
    per = rows.withColumn("given", given).groupBy("user_id").agg(
        F.count_if("given").alias("known"),
        F.count_if(~F.col("given")).alias("tail"),
        F.count_if(F.col("event_type") == "view").alias("views"),
        F.coalesce(F.max(F.when(F.col("given"), F.col("rn"))) < F.min(F.when(~F.col("given"), F.col("rn"))), F.lit(True)).alias("prefix"),
    )
    reason = F.when(F.col("views") < LEAST_VIEWS, "reference").when(~F.col("prefix"), "prefix").when(F.col("known") < LEAST_KNOWN, "known").when(F.col("tail") < LEAST_TAIL, "tail")
    return per.select("user_id", "known", "tail", reason.alias("reason"))


# The labels that a verdict may have.
VERDICTS = ("OPEN_CANDIDATE", "STOP", "NEED_INFO", "OPEN")


def fault_sql(key: str, value: str, least: int) -> str:
    t = rf"regexp_replace(coalesce({value}, ''), '^\s+|\s+$', '', 'g')"
    return f"CASE WHEN {PLACEHOLDER_SQL.format(t=t)} THEN 'placeholder:{key}' WHEN {FILLER_SQL.format(t=t)} THEN 'filler:{key}' WHEN length({t}) < {least} THEN 'too_short:{key}' END"


def fault(key: str, value, least: int):
    """What is wrong with a field of a payload, or null."""
    short = F.length(F.regexp_replace(X.empty_text(value), r"^\s+|\s+$", "")) < least
    return F.when(X.is_placeholder(value), f"placeholder:{key}").when(X.is_filler(value), f"filler:{key}").when(short, f"too_short:{key}")


PLACEHOLDER_SQL = "(length({t}) < 2 OR regexp_matches({t}, '" + X.PLACEHOLDER.replace("{", "{{").replace("}", "}}") + "'))"
FILLER_SQL = "(length({t}) < 12 OR (regexp_matches({t}, '" + X.FILLER + "') AND length({t}) < 120) OR ((contains({t}, '...') OR contains({t}, '…')) AND length({t}) < 40))"
REASON, LABEL = "substr(text, 1, 60)", "CASE turn % 3 WHEN 0 THEN 'stop' WHEN 1 THEN 'maybe' ELSE 'open' END"


@query(rf"""SELECT conv_id, turn, errors = '' AS ok, errors FROM (SELECT conv_id, turn, CASE WHEN role = 'user' THEN concat_ws(',', {fault_sql("what", "substr(text, 1, 30)", 6)}, {fault_sql("domain", "role", 6)}, {fault_sql("success", "substr(text, 31, 30)", 6)})
ELSE concat_ws(',', {fault_sql("reason", REASON, 12)}, CASE WHEN {FILLER_SQL.format(t=rf"regexp_replace(coalesce({REASON}, ''), '^\s+|\s+$', '', 'g')")} THEN 'filler:reason' END, CASE WHEN upper({LABEL}) NOT IN {VERDICTS} THEN 'bad_verdict_label' END) END AS errors FROM conversations)""")
def f16_role_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with payloads made of turns: a user's as a scout's (what, domain, success), others as verdicts (reason, label)."""
    reason, label = F.substring("text", 1, 60), F.when(F.col("turn") % 3 == 0, "STOP").when(F.col("turn") % 3 == 1, "MAYBE").otherwise("OPEN")
    scout = [fault("what", F.substring("text", 1, 30), 6), fault("domain", F.col("role"), 6), fault("success", F.substring("text", 31, 30), 6)]
    verdict = [fault("reason", reason, 12), F.when(X.is_filler(reason), "filler:reason"), F.when(~label.isin(*VERDICTS), "bad_verdict_label")]
    errors = F.when(F.col("role") == "user", F.concat_ws(",", *scout)).otherwise(F.concat_ws(",", *verdict))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", errors.alias("errors"))
    return rows.select("conv_id", "turn", (F.col("errors") == "").alias("ok"), "errors")


#: Hours before the last row that count, hours that a step may take, and the share and the most of a bias that is used.
BIAS_HOURS, STEP_HOURS, BIAS_SHARE, BIAS_MOST = 400.0, (0.5, 48.0), 0.5, 3.0
VALID = f"step >= {STEP_HOURS[0]} AND step <= {STEP_HOURS[1]} AND x >= anchor - {BIAS_HOURS}"
BIAS_SQL = f"""v AS (SELECT user_id, value FROM (SELECT user_id, dv / step AS value, bool_and(coalesce({VALID}, false)) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS kept FROM (
SELECT *, x - lag(x) OVER ({BY}) AS step, value - lag(value) OVER ({BY}) AS dv, max(x) OVER (PARTITION BY user_id) AS anchor FROM {E})) WHERE kept),
l0 AS (SELECT user_id, value, m AS loc, greatest(1.4826 * quantile_cont(abs(value - m), 0.5) OVER (PARTITION BY user_id), 0.001) AS s FROM (SELECT user_id, value, quantile_cont(value, 0.5) OVER (PARTITION BY user_id) AS m FROM v))"""
for _k in range(5):
    BIAS_SQL += f", l{_k + 1} AS (SELECT user_id, value, s, sum(w * value) OVER (PARTITION BY user_id) / sum(w) OVER (PARTITION BY user_id) AS loc FROM (SELECT *, CASE WHEN abs(value - loc) > 1.5 * s THEN 1.5 * s / abs(value - loc) ELSE 1.0 END AS w FROM l{_k}))"


@query(f"""WITH {BIAS_SQL}, b AS (SELECT user_id, any_value(loc) AS loc, count(*) AS n FROM l5 GROUP BY 1)
SELECT user_id, round(greatest(-{BIAS_MOST}, least({BIAS_MOST}, {BIAS_SHARE} * coalesce(loc, 0))), 4) AS bias, coalesce(n, 0) AS steps FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN b USING (user_id)""")
def g13_prefix_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shrunk and clipped location of the slopes that lead up to each series' last row without a step that isn't valid; 0 without any."""
    last = Window.partitionBy("user_id")
    rows = events(spark, sf_dir).withColumns({"step": F.col("x") - F.lag("x").over(by_time()), "dv": F.col("value") - F.lag("value").over(by_time()), "anchor": F.max("x").over(last)})
    valid = F.coalesce(F.col("step").between(*STEP_HOURS) & (F.col("x") >= F.col("anchor") - BIAS_HOURS), F.lit(False))
    back = last.orderBy(F.desc("ts"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, 0)
    users = rows.select("user_id").distinct()
    v = cut(rows.withColumn("kept", F.bool_and(valid).over(back)).filter("kept").select("user_id", (F.col("dv") / F.col("step")).alias("value")))
    middle = v.groupBy("user_id").agg(F.percentile("value", 0.5).alias("loc"), F.count("*").alias("steps"))
    now = v.join(middle, "user_id").groupBy("user_id", "loc", "steps").agg(F.greatest(1.4826 * F.percentile(F.abs(F.col("value") - F.col("loc")), 0.5), F.lit(0.001)).alias("s"))
    for _ in range(5):
        away = F.abs(F.col("value") - F.col("loc"))
        w = F.when(away > 1.5 * F.col("s"), 1.5 * F.col("s") / away).otherwise(1.0)
        now = v.join(now, "user_id").groupBy("user_id", "s", "steps").agg((F.sum(w * F.col("value")) / F.sum(w)).alias("loc"))
    bias = F.greatest(F.lit(-BIAS_MOST), F.least(F.lit(BIAS_MOST), BIAS_SHARE * F.coalesce("loc", F.lit(0.0))))
    return users.join(now, "user_id", "left").select("user_id", F.round(bias, 4).alias("bias"), F.coalesce("steps", F.lit(0).cast("long")).alias("steps"))


@query("SELECT event_id, user_id, value, CASE WHEN user_id % 5 <> 0 THEN 'training' ELSE 'benchmark' END AS role, CASE WHEN user_id % 5 <> 0 THEN props END AS target FROM events")
def s6_role_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by the role of their series: a benchmark's are read without the target column, so nothing can leak from it."""
    rows = table(spark, sf_dir, "events")
    shown = ["event_id", "user_id", "value"]
    seen = rows.filter("user_id % 5 <> 0").select(*shown, F.lit("training").alias("role"), F.col("props").alias("target"))
    blind = rows.select(*shown).filter("user_id % 5 = 0 OR user_id IS NULL").select("*", F.lit("benchmark").alias("role"), F.lit(None).cast("string").alias("target"))
    return seen.unionByName(blind)


STRIP_SQL = r"regexp_replace(coalesce({t}, ''), '^\s+|\s+$', '', 'g')"


def given_sql(words: str) -> str:
    return f"list_filter(list_transform({words}, lambda x: {STRIP_SQL.format(t='x')}), lambda x: NOT {PLACEHOLDER_SQL.format(t='x')})"


@query(rf"""SELECT conv_id, turn, length(p) AS n_chars, md5(p) AS payload_md5 FROM (SELECT conv_id, turn, concat_ws(' ', CASE WHEN NOT {PLACEHOLDER_SQL.format(t="r")} THEN r END, CASE WHEN NOT {PLACEHOLDER_SQL.format(t="n")} THEN n END,
CASE WHEN len(list_filter(s, lambda x: NOT list_contains({list(X.LAW_CORE)}, lower(x)))) > 0 THEN 'shared: ' || array_to_string(s, ', ') END, CASE WHEN len(m) > 0 THEN 'missing: ' || array_to_string(m, ', ') END) AS p FROM (
SELECT conv_id, turn, {STRIP_SQL.format(t="substr(text, 1, 40)")} AS r, {STRIP_SQL.format(t="role")} AS n, {given_sql("CASE turn % 3 WHEN 0 THEN ['open', 'Audit'] WHEN 1 THEN ['stop', role, '...'] ELSE []::VARCHAR[] END")} AS s, {given_sql("string_split(coalesce(text, ''), ' ')[1:3]")} AS m FROM conversations))""")
def f14_payload_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a JSON envelope says without its keys: reason and note, then lists of what is shared and missing.

    Placeholders are left out, and shared words that are all of the law's core, which any answer echoes. The envelopes
    are written from turns first and parsed again.
    """
    text = X.empty_text(F.col("text"))
    shared = F.when(F.col("turn") % 3 == 0, F.array(F.lit("open"), F.lit("Audit"))).when(F.col("turn") % 3 == 1, F.array(F.lit("stop"), F.col("role"), F.lit("..."))).otherwise(F.array().cast("array<string>"))
    sent = F.struct(F.substring(text, 1, 40).alias("reason"), F.col("role").alias("note"), shared.alias("shared"), F.slice(F.split(text, " "), 1, 3).alias("missing"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(sent).alias("envelope"))
    rows = rows.select("conv_id", "turn", F.from_json("envelope", "reason string, note string, shared array<string>, missing array<string>").alias("e")).select("conv_id", "turn", "e.*")
    strip = lambda t: F.regexp_replace(X.empty_text(t), r"^\s+|\s+$", "")
    said = lambda c: F.when(~X.is_placeholder(F.col(c)), strip(F.col(c)))
    listed = lambda c: F.filter(F.transform(c, strip), lambda t: ~X.is_placeholder(t))
    rows = rows.withColumns({"s": listed("shared"), "m": listed("missing")})
    beyond = F.exists("s", lambda t: ~F.lower(t).isin(X.LAW_CORE))
    parts = [said("reason"), said("note"), F.when(beyond, F.concat(F.lit("shared: "), F.array_join("s", ", "))), F.when(F.size("m") > 0, F.concat(F.lit("missing: "), F.array_join("m", ", ")))]
    return rows.select("conv_id", "turn", F.concat_ws(" ", *parts).alias("p")).select("conv_id", "turn", F.length("p").cast("long").alias("n_chars"), F.md5("p").alias("payload_md5"))
