"""Regressions and components of hundreds of columns, and of predictors that nearly coincide."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isotrend.operators import linear, wide
from isotrend.plans.tables import registrar, rounded, table

QUERIES, ORACLES, register = registrar()
BUCKETS = 250
# Size of the embeddings, and how many of the 200 columns are products of neighbours.
SIZE, PRODUCTS = 64, 8
COLUMNS = 3 * SIZE + PRODUCTS
# Leaves the second predictor about 1e-12 of its variance beside the first.
NEARLY = 4.5e-4


@register("ols_wide", f"""WITH g AS (SELECT l_partkey % {BUCKETS + 1} AS b, count(*) AS n, avg(l_extendedprice) AS m,
 var_pop(l_extendedprice) * count(*) AS ss FROM lineitem GROUP BY 1),
e AS (SELECT sum(n) AS n, sum(ss) / (sum(n) - count(*)) AS mse FROM g),
z AS (SELECT n AS n0, m AS m0 FROM g WHERE b = 0),
t AS (SELECT CAST(b AS INTEGER) AS position, CASE WHEN b = 0 THEN '(Intercept)' ELSE 'bucket_' || b END AS term, e.n,
 CASE WHEN b = 0 THEN m ELSE m - m0 END AS estimate, sqrt(mse * CASE WHEN b = 0 THEN 1 / g.n ELSE 1 / g.n + 1 / n0 END) AS se
 FROM g, e, z)
SELECT position, term, CAST(n AS BIGINT) AS n, round(estimate, 4) AS estimate, round(se, 4) AS std_error, round(estimate / se, 4) AS t
FROM t""")
def ols_wide(spark: SparkSession, folder: str) -> DataFrame:
    """Price on 250 indicators of the part: with one column per part group the fit is known in closed form."""
    bucket = F.col("l_partkey") % (BUCKETS + 1)
    indicators = F.transform(F.sequence(F.lit(1), F.lit(BUCKETS)), lambda i: (bucket == i).cast("double"))
    vector = F.concat(F.array(F.col("l_extendedprice")), indicators)
    models = wide.ols_wide(table(spark, folder, "lineitem"), vector, [f"bucket_{i}" for i in range(1, BUCKETS + 1)])
    return rounded(linear.coefficients(models).select("position", "term", "n", "estimate", "std_error", "t"),
                   ["estimate", "std_error", "t"], 4)


@register("pca_wide", f"""WITH w AS (SELECT vec_id, list_concat(e, list_transform(e, lambda x: x * x), list_transform(e, lambda x: x * x * x),
  [{', '.join(f"e[{i}] * e[{i + 1}]" for i in range(1, PRODUCTS + 1))}]) AS v
 FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)),
l AS (SELECT vec_id, unnest(range(1, {COLUMNS + 1})) AS i, unnest(v) AS x FROM w),
s AS (SELECT i, avg(x) AS m, stddev_pop(x) AS sd FROM l GROUP BY i),
z AS (SELECT vec_id, l.i, (x - m) / sd AS z FROM l JOIN s ON l.i = s.i),
r AS (SELECT a.i, b.i AS j, avg(a.z * b.z) AS r FROM z a JOIN z b ON a.vec_id = b.vec_id GROUP BY ALL),
n AS (SELECT (count(*) - 1) / count(*) AS f FROM embeddings),
q AS (SELECT sum(r * r) AS s2 FROM r),
c AS (SELECT sum(a.r * b.r * c.r) AS s3 FROM r a JOIN r b ON a.j = b.i JOIN r c ON b.j = c.i AND c.j = a.i)
SELECT {COLUMNS} AS components, round({COLUMNS} * f, 6) AS total, round(s2 * f * f, 5) AS squares, round(s3 * f * f * f, 4) AS cubes FROM n, q, c""")
def pca_wide(spark: SparkSession, folder: str) -> DataFrame:
    """Eigenvalues of 200 columns; their power sums are traces of powers of the correlation matrix."""
    e = F.col("embedding").cast("array<double>")
    products = F.zip_with(F.slice(e, 1, PRODUCTS), F.slice(e, 2, PRODUCTS), lambda a, b: a * b)
    vector = F.concat(e, F.transform(e, lambda x: x * x), F.transform(e, lambda x: x * x * x), products)
    found = wide.pca_wide(table(spark, folder, "embeddings"), vector, COLUMNS)
    power = F.col("eigenvalue")
    sums = found.agg(F.count(power).cast("int").alias("components"), F.sum(power).alias("total"),
                     F.sum(power * power).alias("squares"), F.sum(power * power * power).alias("cubes"))
    return rounded(rounded(rounded(sums, ["total"]), ["squares"], 5), ["cubes"], 4)


@register("ols_nearly_redundant", f"""WITH m AS (SELECT l_returnflag, count(*) AS n, avg(l_extendedprice) AS my, avg(l_quantity) AS mq,
 avg(l_discount) AS md, var_pop(l_quantity) * count(*) AS qq, var_pop(l_discount) * count(*) AS dd,
 covar_pop(l_quantity, l_discount) * count(*) AS qd, covar_pop(l_extendedprice, l_quantity) * count(*) AS yq,
 covar_pop(l_extendedprice, l_discount) * count(*) AS yd, var_pop(l_extendedprice) * count(*) AS yy FROM lineitem GROUP BY 1),
b AS (SELECT *, qq * dd - qd * qd AS det, (yq * dd - yd * qd) / (qq * dd - qd * qd) AS bq, (yd * qq - yq * qd) / (qq * dd - qd * qd) AS bd FROM m),
f AS (SELECT *, (yy - bq * yq - bd * yd) / (n - 3) AS mse FROM b),
t AS (SELECT l_returnflag, n, 0 AS position, '(Intercept)' AS term, my - bq * mq - bd * md AS estimate, NULL AS se FROM f
 UNION ALL SELECT l_returnflag, n, 1, 'quantity', bq - bd / {NEARLY}, sqrt(mse * (dd + 2 * qd / {NEARLY} + qq / {NEARLY} / {NEARLY}) / det) FROM f
 UNION ALL SELECT l_returnflag, n, 2, 'nearly', bd / {NEARLY}, sqrt(mse * qq / det) / {NEARLY} FROM f)
SELECT l_returnflag, position, term, CAST(n AS BIGINT) AS n, round(estimate, -1) AS estimate, round(se, -2) AS std_error FROM t""")
def ols_nearly_redundant(spark: SparkSession, folder: str) -> DataFrame:
    """Two predictors that differ by a millionth of their deviation: a change of variables of a harmless fit."""
    vector = F.array("l_extendedprice", "l_quantity", F.col("l_quantity") + F.lit(NEARLY) * F.col("l_discount"))
    models = wide.ols_qr(table(spark, folder, "lineitem"), vector, ["quantity", "nearly"], ["l_returnflag"])
    terms = linear.coefficients(models, ["l_returnflag"]).select("l_returnflag", "position", "term", "n", "estimate", "std_error")
    shown = terms.withColumn("std_error", F.when(F.col("position") > 0, F.col("std_error")))
    return rounded(rounded(shown, ["estimate"], -1), ["std_error"], -2)
