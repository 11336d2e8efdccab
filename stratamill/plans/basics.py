"""Scalar maps, joins, sets, votes and gates, one query for each operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratamill.plans.catalog import catalog
from stratamill.plans.paths import events
from stratamill.plans.vectors import COSINE, PAIRS, cosine, pairs
from stratamill.session import table

query, QUERIES, ORACLE_SQL = catalog()

# Prefixes of texts by task, other names of purposes, and where work items begin.
PREFIXES = {"search_query": "search_query: ", "search_document": "search_document: ", "query": "Query: ", "document": "Document: "}
ALIASES = {
    "RETRIEVAL": "RETRIEVE", "ABOUTNESS": "TOPICALITY", "TOPIC": "TOPICALITY", "COSINE": "TOPICALITY", "EMBED": "TOPICALITY", "NLI": "AGREEMENT", "ENTAILMENT": "AGREEMENT", "GLUE": "AGREEMENT",
    "JACCARD": "IDENTITY", "SYMBOL": "IDENTITY", "CODE": "IDENTITY", "SMOKE": "EXISTENCE", "TEST": "EXISTENCE", "FS": "EXISTENCE", "FILE": "EXISTENCE",
}
X = "(SELECT *, epoch_us(ts) / 3.6e9 AS x FROM events)"
IN_ORDER = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"


def in_order():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


@query(f"SELECT event_id FROM (SELECT event_id, row_number() {IN_ORDER} AS r FROM events) WHERE (r - 1) % 8 = 0")
def p2_stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eighth event of a user."""
    rows = events(spark, sf_dir).select("event_id", "user_id", "ts").withColumn("r", F.row_number().over(in_order()))
    return rows.filter((F.col("r") - 1) % 8 == 0).select("event_id")


@query("""WITH g AS (SELECT c_custkey, md5(c_mktsegment || '|' || c_nationkey) AS h FROM customer)
SELECT c_custkey, ('0x' || substr(h, 1, 8))::BIGINT % 100 < 35 AS held_out FROM g WHERE c_custkey NOT IN (3, 7, 11)""")
def p4_profile_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hold-out by the digest of the customer's profile, so that equal profiles stay together; known overlaps go."""
    digits = F.conv(F.substring(F.md5(F.concat_ws("|", "c_mktsegment", "c_nationkey")), 1, 8), 16, 10).cast("long")
    return table(spark, sf_dir, "customer").filter(~F.col("c_custkey").isin(3, 7, 11)).select("c_custkey", (digits % 100 < 35).alias("held_out"))


@query("SELECT event_id, round(CASE WHEN value IS NULL OR value <= 0 THEN 0 ELSE ln(value) END, 6) AS filled FROM events")
def p5_fill_not_finite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logarithms of the values; what isn't finite is 0."""
    x = F.when(F.col("value") > 0, F.log("value")).when(F.col("value") == 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return table(spark, sf_dir, "events").select("event_id", F.round(F.when(finite, x).otherwise(0.0), 6).alias("filled"))


WENDLAND = "CASE WHEN d < 1 THEN (1 - d) ** 4 * (4 * d + 1) ELSE 0.0 END"


@query(f"""WITH k AS (SELECT l_suppkey, l_orderkey, l_linenumber, {WENDLAND} AS w FROM (SELECT *, abs(l_quantity - 25) / 20 AS d FROM lineitem))
SELECT l_suppkey, count(*) FILTER (WHERE w > 0) AS n, round(sum(w), 5) AS mass, round(max(w) / max(t), 6) AS top FROM (SELECT *, sum(w) OVER (PARTITION BY l_suppkey) AS t FROM k) GROUP BY 1 HAVING sum(w) > 0""")
def p7_wendland_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compact kernel weights of a supplier's lines by their distance from 25 items: how many, their sum, the greatest share."""
    d = F.abs(F.col("l_quantity") - 25) / 20
    w = F.when(d < 1, F.pow(1 - d, F.lit(4)) * (4 * d + 1)).otherwise(0.0)
    found = table(spark, sf_dir, "lineitem").select("l_suppkey", w.alias("w")).groupBy("l_suppkey").agg(F.count_if(F.col("w") > 0).alias("n"), F.sum("w").alias("s"), F.max("w").alias("m"))
    return found.filter("s > 0").select("l_suppkey", "n", F.round("s", 5).alias("mass"), F.round(F.col("m") / F.col("s"), 6).alias("top"))


@query("""SELECT l_orderkey, l_linenumber, round(greatest(0, least(1, 1 - l_quantity / 40)) * greatest(0, least(1, l_extendedprice / 20000)) * greatest(0, least(1, l_tax * 12.5)), 6) AS confidence,
l_quantity < 40 AND l_extendedprice >= 20000 AND l_tax >= 0.02 AS supported FROM lineitem""")
def p8_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product of three clipped factors, and whether each is at its bound."""
    c = clip(1 - F.col("l_quantity") / 40, 0, 1) * clip(F.col("l_extendedprice") / 20000, 0, 1) * clip(F.col("l_tax") * 12.5, 0, 1)
    held = (F.col("l_quantity") < 40) & (F.col("l_extendedprice") >= 20000) & (F.col("l_tax") >= 0.02)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(c, 6).alias("confidence"), held.alias("supported"))


@query("SELECT vec_id, round(embedding[1]::DOUBLE * cos(radians(35.0)) + embedding[2]::DOUBLE * sin(radians(35.0)), 6) AS section FROM embeddings")
def p11_vertical_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """North and east, the first two components, on a section at 35 degrees."""
    e = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(e[0] * F.cos(F.radians(F.lit(35.0))) + e[1] * F.sin(F.radians(F.lit(35.0))), 6).alias("section"))


@query("""SELECT vec_id, round(abs(sin(radians((degrees(atan2(e[2], e[1])) + 360 - 4.5) % 360)) * sin(acos(greatest(-1, least(1, e[3] / sqrt(e[1] * e[1] + e[2] * e[2] + e[3] * e[3])))))), 6) AS multiplier
FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""")
def p12_azimuth_multiplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sensitive a direction, the first three components, is to interference along it: sines of magnetic azimuth and inclination."""
    e = F.col("e")
    azimuth = (F.degrees(F.atan2(e[1], e[0])) + 360 - 4.5) % 360
    steep = F.acos(clip(e[2] / F.sqrt(e[0] * e[0] + e[1] * e[1] + e[2] * e[2]), -1, 1))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return rows.select("vec_id", F.round(F.abs(F.sin(F.radians(azimuth)) * F.sin(steep)), 6).alias("multiplier"))


@query(f"""SELECT conv_id, turn, CASE WHEN t = '' OR {' OR '.join(f"starts_with(t, '{p}')" for p in PREFIXES.values())} THEN md5(t) ELSE md5(CASE role WHEN 'user' THEN 'search_query: ' ELSE 'search_document: ' END || t) END AS text_md5
FROM (SELECT *, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM conversations)""")
def p16_apply_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with the prefix of their task, unless one is there already."""
    t = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    has = F.col("t") == ""
    for p in PREFIXES.values():
        has = has | F.col("t").startswith(p)
    task = F.when(F.col("role") == "user", PREFIXES["search_query"]).otherwise(PREFIXES["search_document"])
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", t.alias("t"))
    return rows.select("conv_id", "turn", F.md5(F.when(has, F.col("t")).otherwise(F.concat(task, "t"))).alias("text_md5"))


FACE_SQL = """SELECT o_orderkey, face, face IN ('OPEN_CANDIDATE', 'STOP') AS closed FROM (SELECT o_orderkey,
CASE WHEN fatal OR label = 'contradiction' THEN 'STOP' WHEN verdict = 'OPEN' AND label = 'entailment' AND regime = 'structured_ops' THEN 'OPEN_CANDIDATE' WHEN verdict = 'STOP' THEN 'STOP' ELSE 'NEED_INFO' END AS face
FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'STOP' WHEN 'O' THEN 'OPEN' ELSE 'NEED_INFO' END AS verdict, ['entailment', 'neutral', 'contradiction'][o_custkey % 3 + 1] AS label,
o_totalprice > 300000 AS fatal, CASE WHEN o_orderkey % 2 = 0 THEN 'structured_ops' ELSE 'free_text' END AS regime FROM orders))"""


@query(FACE_SQL)
def p17_certificate_face(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an order's certificate says: contradiction and fatal faults stop, process and reference together open."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", "STOP").when(F.col("o_orderstatus") == "O", "OPEN").otherwise("NEED_INFO").alias("verdict"),
        F.element_at(F.array(F.lit("entailment"), F.lit("neutral"), F.lit("contradiction")), (F.col("o_custkey") % 3 + 1).cast("int")).alias("label"), (F.col("o_totalprice") > 300000).alias("fatal"), (F.col("o_orderkey") % 2 == 0).alias("structured"),
    )
    opens = (F.col("verdict") == "OPEN") & (F.col("label") == "entailment") & F.col("structured")
    face = F.when(F.col("fatal") | (F.col("label") == "contradiction"), "STOP").when(opens, "OPEN_CANDIDATE").when(F.col("verdict") == "STOP", "STOP").otherwise("NEED_INFO")
    return o.select("o_orderkey", face.alias("face")).withColumn("closed", F.col("face").isin("OPEN_CANDIDATE", "STOP"))


@query(f"SELECT o_orderkey, CASE u {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in ALIASES.items())} END AS purpose FROM (SELECT o_orderkey, upper([{', '.join(f'{chr(39)}{k.lower()}{chr(39)}' for k in ALIASES)}, 'other'][o_orderkey % 16 + 1]) AS u FROM orders)")
def p19_purpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purposes by their other names, null where there is none."""
    names = F.array(*(F.lit(k.lower()) for k in ALIASES), F.lit("other"))
    u = F.upper(F.element_at(names, (F.col("o_orderkey") % 16 + 1).cast("int")))
    known = F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.try_element_at(known, u).alias("purpose"))


@query("SELECT l_orderkey, l_linenumber, greatest(-25, least(25, l_quantity - 25 + 10)) AS correction, greatest(-1, least(2, l_discount * 40 - 1)) AS coefficient FROM lineitem")
def p22_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections and coefficients within their bounds."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", clip(F.col("l_quantity") - 25 + 10, -25.0, 25.0).alias("correction"), clip(F.col("l_discount") * 40 - 1, -1.0, 2.0).alias("coefficient"))


@query("SELECT o_orderkey, c_nationkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE (SELECT count(*) - count(DISTINCT c_custkey) FROM customer) = 0")
def j1_validated_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customers; a customer key that occurs twice is an error."""
    right = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    if not right.groupBy("c_custkey").count().filter("count > 1").isEmpty():
        raise ValueError("c_custkey is not unique")
    return table(spark, sf_dir, "orders").join(right, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, coalesce(p, 25.0) AS prediction, p IS NULL AS missed FROM lineitem LEFT JOIN (SELECT o_orderkey, (o_custkey % 50)::DOUBLE AS p FROM orders WHERE o_orderstatus <> 'P') ON o_orderkey = l_orderkey")
def j2_lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions looked up by key; rows without one say so."""
    p = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 50).cast("double").alias("p"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(p, "l_orderkey", "left")
    return rows.select("l_orderkey", "l_linenumber", F.coalesce("p", F.lit(25.0)).alias("prediction"), F.col("p").isNull().alias("missed"))


SEGMENTS = "(SELECT vec_id, embedding[1]::DOUBLE AS ax, embedding[2]::DOUBLE AS ay, embedding[3]::DOUBLE AS bx, embedding[4]::DOUBLE AS by_, embedding[5]::DOUBLE AS cx, embedding[6]::DOUBLE AS cy, embedding[7]::DOUBLE AS dx, embedding[8]::DOUBLE AS dy FROM embeddings)"


@query(f"""SELECT vec_id, ((ab_c <= 0 AND ab_d >= 0) OR (ab_d <= 0 AND ab_c >= 0)) AND ((cd_a <= 0 AND cd_b >= 0) OR (cd_b <= 0 AND cd_a >= 0)) AS crosses, round(sqrt((cx - ax - f * (bx - ax)) ** 2 + (cy - ay - f * (by_ - ay)) ** 2), 6) AS distance FROM (
SELECT *, (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) AS ab_c, (bx - ax) * (dy - ay) - (by_ - ay) * (dx - ax) AS ab_d, (dx - cx) * (ay - cy) - (dy - cy) * (ax - cx) AS cd_a, (dx - cx) * (by_ - cy) - (dy - cy) * (bx - cx) AS cd_b,
CASE WHEN (bx - ax) ** 2 + (by_ - ay) ** 2 = 0 THEN 0 ELSE greatest(0, least(1, ((cx - ax) * (bx - ax) + (cy - ay) * (by_ - ay)) / ((bx - ax) ** 2 + (by_ - ay) ** 2))) END AS f FROM {SEGMENTS})""")
def j16_segment_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two segments, of eight components, cross, and how far the second one's start is from the first one."""
    e = F.col("embedding").cast("array<double>")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", *(e[i].alias(n) for i, n in enumerate("ax ay bx by cx cy dx dy".split())))
    turn = lambda p, q, r: (F.col(q + "x") - F.col(p + "x")) * (F.col(r + "y") - F.col(p + "y")) - (F.col(q + "y") - F.col(p + "y")) * (F.col(r + "x") - F.col(p + "x"))
    size = F.greatest(F.lit(1.0), *(F.abs(F.col(c)) for c in rows.columns[1:]))
    eps = 1e-10 * size * size
    sides = lambda p, q, r, s: ((turn(p, q, r) <= eps) & (turn(p, q, s) >= -eps)) | ((turn(p, q, s) <= eps) & (turn(p, q, r) >= -eps))
    ux, uy, vx, vy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("cx") - F.col("ax"), F.col("cy") - F.col("ay")
    long = ux * ux + uy * uy
    f = F.when(long == 0, 0.0).otherwise(clip((vx * ux + vy * uy) / F.nullif(long, F.lit(0.0)), 0, 1))
    away = F.sqrt(F.pow(vx - f * ux, F.lit(2)) + F.pow(vy - f * uy, F.lit(2)))
    return rows.select("vec_id", (sides("a", "b", "c", "d") & sides("c", "d", "a", "b")).alias("crosses"), F.round(away, 6).alias("distance"))


@query("SELECT l_orderkey, l_linenumber, round(avg(l_quantity) OVER (PARTITION BY l_suppkey), 6) AS constant FROM lineitem")
def a2_group_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line with the mean quantity of its supplier, aggregated first and joined back."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    mean = rows.groupBy("l_suppkey").agg(F.round(F.avg("l_quantity"), 6).alias("constant"))
    return rows.join(mean, "l_suppkey").select("l_orderkey", "l_linenumber", "constant")


HUBER = "l0 AS (SELECT user_id, value, m AS loc, greatest(1.4826 * quantile_cont(abs(value - m), 0.5) OVER (PARTITION BY user_id), 0.001) AS s FROM (SELECT user_id, value, quantile_cont(value, 0.5) OVER (PARTITION BY user_id) AS m FROM events WHERE value IS NOT NULL))"
for _k in range(5):
    HUBER += f", l{_k + 1} AS (SELECT user_id, value, s, sum(w * value) OVER (PARTITION BY user_id) / sum(w) OVER (PARTITION BY user_id) AS loc FROM (SELECT *, CASE WHEN abs(value - loc) > 1.5 * s THEN 1.5 * s / abs(value - loc) ELSE 1.0 END AS w FROM l{_k}))"


@query(f"WITH {HUBER} SELECT DISTINCT user_id, round(loc, 4) AS location FROM l5")
def a14_huber_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Location of each user's values by five reweighted means from the median; each step is an aggregate of a row a user."""
    rows = table(spark, sf_dir, "events").filter("value IS NOT NULL").select("user_id", "value")
    middle = rows.groupBy("user_id").agg(F.percentile("value", 0.5).alias("loc"))
    spread = rows.join(middle, "user_id").groupBy("user_id", "loc").agg(F.greatest(1.4826 * F.percentile(F.abs(F.col("value") - F.col("loc")), 0.5), F.lit(0.001)).alias("s"))
    now = spread
    for _ in range(5):
        away = F.abs(F.col("value") - F.col("loc"))
        w = F.when(away > 1.5 * F.col("s"), 1.5 * F.col("s") / away).otherwise(1.0)
        now = rows.join(now, "user_id").groupBy("user_id", "s").agg((F.sum(w * F.col("value")) / F.sum(w)).alias("loc"))
    return now.select("user_id", F.round("loc", 4).alias("location"))


@query("""SELECT con_high, ent_low, never, invalid, con_high >= 0.7 AND ent_low >= 0.7 AND never = 0 AND invalid <= 0.05 * n AS earned FROM (
SELECT count(*) AS n, round(avg(CASE WHEN gold = 0 AND odd THEN (pred = gold)::INT END), 6) AS con_high, round(avg(CASE WHEN gold = 1 AND NOT odd THEN (pred = gold)::INT END), 6) AS ent_low,
2 - count(DISTINCT pred) FILTER (WHERE pred IN (0, 1)) AS never, count(*) FILTER (WHERE pred NOT IN (0, 1)) AS invalid FROM (
SELECT quality AS gold, l.doc_id % 2 = 1 AS odd, CASE WHEN text IS NULL THEN -1 WHEN n_chars > 400 THEN 1 ELSE 0 END AS pred FROM labels l JOIN documents d USING (doc_id)))""")
def a28_earned_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether predictions of quality by length earn trust: both cells, all labels emitted, few invalid ones."""
    pred = F.when(F.col("text").isNull(), -1).when(F.col("n_chars") > 400, 1).otherwise(0)
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", pred.alias("pred")), "doc_id").select("pred", F.col("quality").alias("gold"), (F.col("doc_id") % 2 == 1).alias("odd"))
    hit = (F.col("pred") == F.col("gold")).cast("int")
    cell = lambda gold, odd: F.round(F.avg(F.when((F.col("gold") == gold) & (F.col("odd") == odd), hit)), 6)
    good = F.col("pred").isin(0, 1)
    found = rows.agg(F.count("*").alias("n"), cell(0, True).alias("con_high"), cell(1, False).alias("ent_low"), (2 - F.countDistinct(F.when(good, F.col("pred")))).alias("never"), F.count_if(~good).alias("invalid"))
    earned = (F.col("con_high") >= 0.7) & (F.col("ent_low") >= 0.7) & (F.col("never") == 0) & (F.col("invalid") <= 0.05 * F.col("n"))
    return found.select("con_high", "ent_low", "never", "invalid", earned.alias("earned"))


@query(f"""SELECT round(avg(c) FILTER (WHERE same) - avg(c) FILTER (WHERE NOT same), 6) AS range, round(min(c), 6) AS floor, round(max(c), 6) AS ceiling, count(*) AS n FROM (SELECT la = lb AS same, {COSINE.format("x", "y")} AS c FROM ({PAIRS}))""")
def a29_pair_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the cosines of pairs of one label lie above those of two."""
    rows = pairs(spark, sf_dir).select((F.col("a.label") == F.col("b.label")).alias("same"), cosine(F.col("a.e"), F.col("b.e")).alias("c"))
    mean = lambda x: F.avg(F.when(x, F.col("c")))
    return rows.agg(F.round(mean(F.col("same")) - mean(~F.col("same")), 6).alias("range"), F.round(F.min("c"), 6).alias("floor"), F.round(F.max("c"), 6).alias("ceiling"), F.count("*").alias("n"))


@query("SELECT l_returnflag, round(CASE WHEN stddev_pop(l_quantity) = 0 OR stddev_pop(l_extendedprice) = 0 THEN 0 ELSE corr(l_quantity, l_extendedprice) END, 6) AS r FROM lineitem GROUP BY 1")
def a32_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of quantity and price, 0 where one doesn't vary."""
    r = F.corr("l_quantity", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.when(r.isNull() | F.isnan(r), 0.0).otherwise(r), 6).alias("r"))


@query("""SELECT l_suppkey, round(min(w), 6) AS low, round(max(w), 6) AS high FROM (SELECT l_suppkey, (SELECT count(*) FROM lineitem) * l_quantity / ((SELECT count(DISTINCT l_suppkey) FROM lineitem) * sum(l_quantity) OVER (PARTITION BY l_suppkey)) AS w FROM lineitem) GROUP BY 1""")
def a35_equal_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range of the weights that give each supplier the same mass, lines weighing by quantity."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), F.sum("l_quantity").alias("s"), F.count("*").alias("n"))
    whole = per.agg(F.sum("n").alias("rows"), F.count("*").alias("wells")).first()
    share = (whole["rows"] or 0) / max(1, whole["wells"])
    return per.select("l_suppkey", F.round(share * F.col("lo") / F.col("s"), 6).alias("low"), F.round(share * F.col("hi") / F.col("s"), 6).alias("high"))


@query("""SELECT cell, count(DISTINCT label) AS wells, round(sum(x * x), 6) AS xx, round(sum(x * y), 6) AS xy, round(sum(y * y), 6) AS yy FROM (
SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, floor(embedding[1]::DOUBLE / 0.1)::BIGINT * 1000 + floor(embedding[2]::DOUBLE / 0.1)::BIGINT AS cell FROM embeddings) GROUP BY 1""")
def a37_node_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two by two moments and distinct labels of each cell of the plane of the first two components."""
    e = F.col("embedding").cast("array<double>")
    rows = table(spark, sf_dir, "embeddings").select("label", e[0].alias("x"), e[1].alias("y"))
    cell = (F.floor(F.col("x") / 0.1) * 1000 + F.floor(F.col("y") / 0.1)).alias("cell")
    sums = [F.round(F.sum(F.col(a) * F.col(b)), 6).alias(a + b) for a, b in ("xx", "xy", "yy")]
    return rows.groupBy(cell).agg(F.countDistinct("label").alias("wells"), *sums)


@query("SELECT l_suppkey, round(sum(l_quantity) ** 2 / sum(l_quantity ** 2), 5) AS effective FROM lineitem GROUP BY 1")
def a38_effective_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many equal lines a supplier's lines are worth."""
    s = F.sum("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(s * s / F.sum(F.col("l_quantity") * F.col("l_quantity")), 5).alias("effective"))


@query("SELECT event_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY 1")
def a44_status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type."""
    rows = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    total = rows.agg(F.sum("n")).first()[0] or 1
    return rows.select("event_type", "n", F.round(F.col("n") / total, 6).alias("share"))


@query("""SELECT l_suppkey % 5 AS fold, count(DISTINCT l_suppkey) AS entities, count(*) AS n, round(quantile_cont(l_quantity, 0.5), 4) AS mid, count(DISTINCT l_suppkey) >= 2 AND count(*) >= 50 AS enough FROM lineitem GROUP BY 1""")
def a45_fold_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities, rows and the median of each fold, and whether it has the least support."""
    rows = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 5).alias("fold")).agg(F.countDistinct("l_suppkey").alias("entities"), F.count("*").alias("n"), F.round(F.percentile("l_quantity", 0.5), 4).alias("mid"))
    return rows.withColumn("enough", (F.col("entities") >= 2) & (F.col("n") >= 50))


@query("SELECT user_id, round((count(*) - 1) / (max(x) - min(x)), 6) AS per_hour, round(quantile_cont(gap, 0.5), 6) AS mid_gap FROM (SELECT user_id, x, x - lag(x) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM " + X + ") GROUP BY 1 HAVING max(x) > min(x)")
def a46_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events an hour and the median gap of each user."""
    rows = events(spark, sf_dir).select("user_id", "x", (F.col("x") - F.lag("x").over(in_order())).alias("gap"))
    found = rows.groupBy("user_id").agg(F.count("*").alias("n"), (F.max("x") - F.min("x")).alias("span"), F.percentile("gap", 0.5).alias("mid")).filter("span > 0")
    return found.select("user_id", F.round((F.col("n") - 1) / F.col("span"), 6).alias("per_hour"), F.round("mid", 6).alias("mid_gap"))


@query(f"""SELECT DISTINCT user_id, node FROM (SELECT user_id, unnest([first, last, nxt]) AS node FROM (SELECT user_id, min(event_id) OVER (PARTITION BY user_id) AS first, max(event_id) OVER (PARTITION BY user_id) AS last,
CASE WHEN floor(x / 24) <> floor(lag(x) {IN_ORDER} / 24) THEN event_id END AS nxt FROM {X})) WHERE node IS NOT NULL""")
def w11_node_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each day of a user, and the ends of the series."""
    by_user = Window.partitionBy("user_id")
    day = F.floor(F.col("x") / 24)
    rows = events(spark, sf_dir).select("user_id", "event_id", (day != F.lag(day).over(in_order())).alias("new"), F.min("event_id").over(by_user).alias("a"), F.max("event_id").over(by_user).alias("b"))
    return rows.filter(F.col("new") | F.col("event_id").isin(F.col("a"), F.col("b"))).select("user_id", F.col("event_id").alias("node"))


@query(f"SELECT event_id, least(value, coalesce(lead(value) {IN_ORDER}, value)) AS low FROM events")
def w13_least_of_knots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lower end of each gap between two events of a user."""
    return events(spark, sf_dir).select("event_id", F.least("value", F.coalesce(F.lead("value").over(in_order()), "value")).alias("low"))


@query("""SELECT day, round(CASE WHEN count(*) >= 3 THEN 1 / (1 + (1.4826 * quantile_cont(abs(v - m), 0.5) / 5) ** 2) ELSE 0 END, 6) AS confidence FROM (
SELECT day, v, quantile_cont(v, 0.5) OVER (PARTITION BY day) AS m FROM (SELECT event_type, floor(x / 24)::BIGINT AS day, avg(value) AS v FROM """ + X + """ WHERE value IS NOT NULL GROUP BY ALL)) GROUP BY 1""")
def w16_jackknife_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the types' daily means agree: 1 over 1 plus the squared ratio of their spread, where three have one."""
    v = events(spark, sf_dir).filter("value IS NOT NULL").groupBy("event_type", F.floor(F.col("x") / 24).alias("day")).agg(F.avg("value").alias("v"))
    both = v.join(v.groupBy("day").agg(F.percentile("v", 0.5).alias("m"), F.count("*").alias("n")), "day")
    tau = both.groupBy("day", "n").agg((1.4826 * F.percentile(F.abs(F.col("v") - F.col("m")), 0.5) / 5).alias("t"))
    return tau.select("day", F.round(F.when(F.col("n") >= 3, 1 / (1 + F.col("t") * F.col("t"))).otherwise(0.0), 6).alias("confidence"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber) = 1")
def t4_least_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's cheapest line, of ties the first."""
    least = F.min(F.struct("l_extendedprice", "l_orderkey", "l_linenumber")).alias("k")
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(least).select("l_suppkey", "k.l_orderkey", "k.l_linenumber")


@query("SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) <= CASE event_type WHEN 'error' THEN 8 WHEN 'view' THEN 6 ELSE 12 END")
def t7_first_of_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first events of each type, as many as its class keeps."""
    r = F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id"))
    most = F.when(F.col("event_type") == "error", 8).when(F.col("event_type") == "view", 6).otherwise(12)
    return table(spark, sf_dir, "events").withColumn("r", r).filter(F.col("r") <= most).select("event_type", "event_id")


@query("SELECT o_custkey AS k, 'order' AS kind, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT user_id, 'event', count(*) FROM events GROUP BY 1")
def o1_concat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of two tables under each other, by name."""
    one = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("order"))
    two = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("k")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("event"))
    return one.unionByName(two).select("k", "kind", "n")


@query("SELECT doc_id, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)")
def o2_concat_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of two tables beside each other, by key and never by place."""
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "n_chars", "quality", "toxic")


@query("""SELECT verdict, round(spread, 6) AS spread, round(real_, 6) AS real_drift FROM (SELECT *, CASE WHEN spread < 0.08 THEN 'MIRROR_NOISE' WHEN structure THEN 'EARNED_TOPICALITY_HOLONOMY' ELSE 'WEAK_SEPARATION' END AS verdict FROM (
SELECT *, greatest(real_, para, pasta) - least(real_, para, pasta) AS spread, abs(real_ - para) < abs(real_ - pasta) AND abs(real_ - pasta) >= 0.1 AS structure FROM (
SELECT avg(1 - c) FILTER (WHERE la = lb) AS real_, avg(1 - c) FILTER (WHERE abs(la - lb) = 1) AS para, avg(1 - c) FILTER (WHERE abs(la - lb) > 1) AS pasta FROM (SELECT la, lb, """ + COSINE.format("x", "y") + " AS c FROM (" + PAIRS + ")))))")
def f22_drift_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the drift of like pairs stands out from that of neighbours and of strangers."""
    rows = pairs(spark, sf_dir).select(F.abs(F.col("a.label") - F.col("b.label")).alias("d"), (1 - cosine(F.col("a.e"), F.col("b.e"))).alias("c"))
    found = rows.agg(F.avg(F.when(F.col("d") == 0, F.col("c"))).alias("real"), F.avg(F.when(F.col("d") == 1, F.col("c"))).alias("para"), F.avg(F.when(F.col("d") > 1, F.col("c"))).alias("pasta"))
    spread = F.greatest("real", "para", "pasta") - F.least("real", "para", "pasta")
    near, far = F.abs(F.col("real") - F.col("para")), F.abs(F.col("real") - F.col("pasta"))
    verdict = F.when(spread < 0.08, "MIRROR_NOISE").when((near < far) & (far >= 0.1), "EARNED_TOPICALITY_HOLONOMY").otherwise("WEAK_SEPARATION")
    return found.select(verdict.alias("verdict"), F.round(spread, 6).alias("spread"), F.round("real", 6).alias("real_drift"))


@query("""SELECT round(a - c, 6) AS dynamic_range, round(a - b, 6) AS gap, c < 0.3 AS low_floor, CASE WHEN a - c < 0.15 THEN 'MIRROR' ELSE 'HAS_RANGE' END AS verdict FROM (
SELECT avg(s) FILTER (WHERE la = lb) AS a, avg(s) FILTER (WHERE abs(la - lb) = 1) AS b, avg(s) FILTER (WHERE abs(la - lb) > 1) AS c FROM (SELECT la, lb, """ + COSINE.format("x", "y") + " AS s FROM (" + PAIRS + ")))")
def f23_null_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dynamic range of the cosines from like pairs to strangers, and what it says of the instrument."""
    rows = pairs(spark, sf_dir).select(F.abs(F.col("a.label") - F.col("b.label")).alias("d"), cosine(F.col("a.e"), F.col("b.e")).alias("s"))
    a, b, c = (F.avg(F.when(x, F.col("s"))) for x in (F.col("d") == 0, F.col("d") == 1, F.col("d") > 1))
    found = rows.agg(a.alias("a"), b.alias("b"), c.alias("c"))
    wide = F.col("a") - F.col("c")
    return found.select(F.round(wide, 6).alias("dynamic_range"), F.round(F.col("a") - F.col("b"), 6).alias("gap"), (F.col("c") < 0.3).alias("low_floor"), F.when(wide < 0.15, "MIRROR").otherwise("HAS_RANGE").alias("verdict"))


@query("""SELECT source, count(*) AS n, sum(('0x' || substr(md5(doc_id || ':' || coalesce(md5(text), '')), 1, 15))::HUGEINT)::VARCHAR AS digest FROM documents GROUP BY 1""")
def f25_table_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each source's rows: the sum of their digests' leading digits, which needs no order and no list of rows."""
    row = F.md5(F.concat_ws(":", "doc_id", F.coalesce(F.md5("text"), F.lit(""))))
    number = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(20,0)")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum(number).cast("string").alias("digest"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace('C:/Users/x' || page_id || '/home/y/' || url, 'C:/Users/[^/\s"]+/', '<user>/', 'g'), '/Users/[^/\s"]+/', '<user>/', 'g'), '/home/[^/\s"]+/', '<user>/', 'g') AS clean FROM pages""")
def f28_scrub_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths without the names of users."""
    p = F.concat(F.lit("C:/Users/x"), "page_id", F.lit("/home/y/"), "url")
    for pattern in (r"C:/Users/[^/\s\"]+/", r"/Users/[^/\s\"]+/", r"/home/[^/\s\"]+/"):
        p = F.regexp_replace(p, pattern, "<user>/")
    return table(spark, sf_dir, "pages").select("page_id", p.alias("clean"))


@query("""SELECT l_returnflag, round(-regr_intercept(z, x) / regr_slope(z, x), 4) AS midpoint, round(regr_slope(z, x), 6) AS slope FROM (SELECT l_returnflag, x, ln(y / (1 - y)) AS z FROM (
SELECT l_returnflag, floor(l_quantity / 5) AS x, avg((l_extendedprice > 30000)::INT) AS y FROM lineitem GROUP BY 1, 2) WHERE y > 1e-4 AND y < 1 - 1e-4) GROUP BY 1 HAVING count(*) >= 3""")
def f30_logit_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the share of dear lines passes a half as quantity grows: a line through the logits of shares that aren't saturated."""
    y = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.floor(F.col("l_quantity") / 5).cast("double").alias("x")).agg(F.avg((F.col("l_extendedprice") > 30000).cast("int")).alias("y"))
    z = y.filter("y > 1e-4 AND y < 1 - 1e-4").withColumn("z", F.log(F.col("y") / (1 - F.col("y"))))
    found = z.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.regr_slope("z", "x").alias("k"), F.regr_intercept("z", "x").alias("b")).filter("n >= 3")
    return found.select("l_returnflag", F.round(-F.col("b") / F.col("k"), 4).alias("midpoint"), F.round("k", 6).alias("slope"))


@query("""WITH c AS (SELECT event_type, event_id % 2 AS side, round_even(epoch_us(ts) / 3.6e9 / 12, 0) AS cell, quantile_cont(value, 0.5) AS m FROM events WHERE value IS NOT NULL GROUP BY ALL),
p AS (SELECT a.event_type, a.m AS x, b.m AS y FROM c a JOIN c b ON a.event_type = b.event_type AND a.cell = b.cell AND a.side = 0 AND b.side = 1)
SELECT event_type, round(gain, 5) AS gain, round(my - gain * mx, 4) AS bias FROM (SELECT event_type, greatest(0.25, least(4, greatest(quantile_cont(y, 0.75) - quantile_cont(y, 0.25), 1.0) / greatest(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 1.0))) AS gain,
quantile_cont(x, 0.5) AS mx, quantile_cont(y, 0.5) AS my FROM p GROUP BY 1 HAVING count(*) >= 6)""")
def g7_curve_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain and bias that bring the even events' medians to the scale of the odd ones', by the spread of both."""
    rows = events(spark, sf_dir).filter("value IS NOT NULL").groupBy("event_type", (F.col("event_id") % 2).alias("side"), F.rint(F.col("x") / 12).alias("cell")).agg(F.percentile("value", 0.5).alias("m"))
    both = rows.groupBy("event_type", "cell").agg(F.max(F.when(F.col("side") == 0, F.col("m"))).alias("x"), F.max(F.when(F.col("side") == 1, F.col("m"))).alias("y")).dropna()
    wide = lambda c: F.greatest(F.percentile(c, 0.75) - F.percentile(c, 0.25), F.lit(1.0))
    found = both.groupBy("event_type").agg(F.count("*").alias("n"), clip(wide("y") / wide("x"), 0.25, 4.0).alias("g"), F.percentile("x", 0.5).alias("mx"), F.percentile("y", 0.5).alias("my")).filter("n >= 6")
    return found.select("event_type", F.round("g", 5).alias("gain"), F.round(F.col("my") - F.col("g") * F.col("mx"), 4).alias("bias"))


@query("""SELECT count(*) FILTER (WHERE roles > 1) AS split_groups, count(*) FILTER (WHERE embargoed > 0 AND held > 0) AS leaks FROM (
SELECT c_nationkey, c_mktsegment, count(DISTINCT c_nationkey % 5) AS roles, count(*) FILTER (WHERE c_custkey % 7 = 0) AS embargoed, count(*) FILTER (WHERE c_custkey % 7 = 1) AS held FROM customer GROUP BY 1, 2)""")
def g18_leak_validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups in more than one fold, and groups with both embargoed and held-out members."""
    k = F.col("c_custkey") % 7
    per = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.countDistinct(F.col("c_nationkey") % 5).alias("roles"), F.count_if(k == 0).alias("e"), F.count_if(k == 1).alias("h"))
    return per.agg(F.count_if(F.col("roles") > 1).alias("split_groups"), F.count_if((F.col("e") > 0) & (F.col("h") > 0)).alias("leaks"))


@query("""WITH d AS (SELECT l_suppkey, avg(abs(l_quantity - 25)) - avg(abs(l_quantity - 25 - 40 * (l_discount - 0.05))) AS g FROM lineitem GROUP BY 1),
r AS (SELECT g, avg(k) OVER (PARTITION BY round(abs(g), 9)) AS r FROM (SELECT g, row_number() OVER (ORDER BY round(abs(g), 9)) AS k FROM d WHERE round(g, 9) <> 0))
SELECT count(*) AS n, sum(r) FILTER (WHERE g > 0) AS w_plus, round((sum(r) FILTER (WHERE g > 0) - count(*) * (count(*) + 1) / 4) / sqrt(count(*) * (count(*) + 1) * (2 * count(*) + 1) / 24), 5) AS z FROM r""")
def g19_paired_signed_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed ranks of the suppliers' gains and their normal score; equal sizes share the mean of their ranks.

    Ranks come from counts of distinct sizes, one row each.
    """
    base = F.abs(F.col("l_quantity") - 25)
    cand = F.abs(F.col("l_quantity") - 25 - 40 * (F.col("l_discount") - 0.05))
    d = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg((F.avg(base) - F.avg(cand)).alias("g")).withColumn("a", F.round(F.abs("g"), 9)).filter("a <> 0")
    sizes = d.groupBy("a").agg(F.count("*").alias("n"), F.count_if(F.col("g") > 0).alias("up"))
    upto = F.sum("n").over(Window.orderBy("a").rowsBetween(Window.unboundedPreceding, 0))
    ranked = sizes.select("n", "up", (upto - (F.col("n") - 1) / 2).alias("r"))
    found = ranked.agg(F.sum("n").alias("n"), F.sum(F.col("up") * F.col("r")).alias("w_plus"))
    n = F.col("n")
    return found.select("n", "w_plus", F.round((F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24), 5).alias("z"))
