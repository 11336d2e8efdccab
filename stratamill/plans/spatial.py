"""Points in the plane: the first two components of the vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratamill.operators import spatial
from stratamill.plans.catalog import catalog
from stratamill.session import table

query, QUERIES, ORACLE_SQL = catalog()

P = "(SELECT vec_id AS id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)"
D2 = "((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))"
#: Radius of partners, of the embargo and of equality classes.
RADIUS, CLASS_RADIUS = 0.01, 0.005


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.col("embedding")[i].cast("double")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", at(0).alias("x"), at(1).alias("y"))


@query(f"SELECT id AS vec_id, q_id AS nearest, round(sqrt(d2), 8) AS distance FROM (SELECT p.id, q.id AS q_id, {D2} AS d2, row_number() OVER (PARTITION BY p.id ORDER BY {D2}, q.id) AS rn FROM {P} p JOIN {P} q ON p.id <> q.id) WHERE rn = 1")
def j6_nearest_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest other point of each."""
    all_ = points(spark, sf_dir)
    return spatial.nearest(all_, all_, RADIUS).select(F.col("a").alias("vec_id"), F.col("b").alias("nearest"), F.round(F.sqrt("d2"), 8).alias("distance"))


@query(f"SELECT p.id AS a, q.id AS b, round(sqrt({D2}), 8) AS distance FROM {P} p JOIN {P} q ON p.id < q.id AND {D2} <= {RADIUS * RADIUS!r}::DOUBLE")
def j7_radius_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs within a radius."""
    all_ = points(spark, sf_dir)
    return spatial.radius_join(all_, all_, RADIUS).filter("a < b").select("a", "b", F.round(F.sqrt("d2"), 8).alias("distance"))


@query(f"""WITH p AS {P}, hit AS (SELECT DISTINCT p.id % 97 AS g FROM p JOIN p q ON p.id % 5 <> 0 AND q.id % 5 = 0 AND {D2} <= {RADIUS * RADIUS!r}::DOUBLE)
SELECT id AS vec_id FROM p WHERE id % 5 <> 0 AND id % 97 NOT IN (SELECT g FROM hit)""")
def j8_radius_embargo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training points of which no point of their group is within a radius of a validation point."""
    all_ = points(spark, sf_dir).withColumn("g", F.col("id") % 97)
    train, held = all_.filter("id % 5 <> 0"), all_.filter("id % 5 = 0")
    hit = spatial.radius_join(held, train, RADIUS).select((F.col("b") % 97).alias("g"))
    return train.join(hit, "g", "left_anti").select(F.col("id").alias("vec_id"))


@query(f"""SELECT vec_id, rank, other FROM (SELECT p.id AS vec_id, q.id AS other, row_number() OVER (PARTITION BY p.id ORDER BY {D2}, q.id) AS rank
FROM {P} p JOIN {P} q ON p.id <> q.id AND p.label <> q.label) WHERE rank <= 3""")
def j9_adaptive_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest points of another label: radius by radius, k grows until three of the partners found qualify."""
    all_, k = points(spark, sf_dir), 3
    labels = all_.select("id", "label")
    out, todo, r = None, all_, RADIUS
    by = Window.partitionBy("a").orderBy("d2", "b")
    while True:
        near = spatial.radius_join(todo, all_, r).filter("a <> b")
        near = near.join(labels.toDF("a", "la"), "a").join(labels.toDF("b", "lb"), "b").filter("la <> lb").withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
        near = spatial.cut(near.withColumn("n", F.count("*").over(Window.partitionBy("a"))))
        last = r > 4  # unit vectors: nothing is further apart
        done = (near if last else near.filter(F.col("n") == k)).select(F.col("a").alias("vec_id"), "rank", F.col("b").alias("other"))
        out = done if out is None else out.union(done)
        todo = spatial.cut(todo.join(done.select(F.col("vec_id").alias("id")), "id", "left_anti"))
        if last or todo.isEmpty():
            return out
        r *= 2


@query(f"""WITH RECURSIVE p AS {P}, e AS (SELECT p.id AS a, q.id AS b FROM p JOIN p q ON p.id <> q.id AND {D2} <= {CLASS_RADIUS * CLASS_RADIUS!r}::DOUBLE),
reach(id, c) AS (SELECT id, id FROM p UNION SELECT e.b, reach.c FROM reach JOIN e ON e.a = reach.id)
SELECT id AS vec_id, min(c) AS component FROM reach GROUP BY 1""")
def o6_equality_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of points that chains of close partners join."""
    return spatial.classes(points(spark, sf_dir), CLASS_RADIUS).select(F.col("id").alias("vec_id"), "component")


@query(f"SELECT floor(x / 0.1)::BIGINT AS cx, floor(y / 0.1)::BIGINT AS cy, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM {P} GROUP BY 1, 2")
def a36_occupied_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean point of each occupied cell."""
    cell = lambda c: F.floor(F.col(c) / 0.1)
    return points(spark, sf_dir).groupBy(cell("x").alias("cx"), cell("y").alias("cy")).agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"))


@query("""SELECT coalesce(a.o_custkey, b.o_custkey) AS custkey, coalesce(a.n, -1) AS n_open, coalesce(b.n, -1) AS n_final FROM
(SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) a FULL JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) b
ON a.o_custkey = b.o_custkey WHERE a.n IS DISTINCT FROM b.n""")
def j14_manifest_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys on which two manifests don't agree; -1 where one of them lacks the key."""
    side = lambda s, name: table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("custkey")).agg(F.count("*").alias(name))
    return side("O", "n_open").join(side("F", "n_final"), "custkey", "full").filter(~F.col("n_open").eqNullSafe(F.col("n_final"))).fillna(-1, ["n_open", "n_final"])
