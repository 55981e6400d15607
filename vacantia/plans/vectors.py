"""Plans over embeddings and cluster labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.operators import clustering
from vacantia.operators import vectors as V
from vacantia.plans import standins as S
from vacantia.plans.registry import register

_DOT = "list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"


def _base(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "embeddings")


@register(f"""WITH p AS (SELECT q.vec_id AS query, b.vec_id AS neighbor, {_DOT.format(a='q.embedding', b='b.embedding')} AS score FROM embeddings q JOIN embeddings b ON q.vec_id <> b.vec_id WHERE q.vec_id % 20 = 0)
SELECT query, neighbor, round(score, 6) AS score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, neighbor) AS r FROM p) WHERE r <= 5""")
def knn_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Queries are the rows whose id is divisible by 20, against all rows."""
    rows = _base(spark, d)
    return V.knn(rows.where("vec_id % 20 = 0"), rows, 5).withColumn("score", F.round("score", 6))


@register("""WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) SELECT label, CAST(i - 1 AS INT) AS dim, round(avg(x), 6) AS mean FROM x GROUP BY 1, 2""")
def centroid_by_label(spark: SparkSession, d: str) -> DataFrame:
    c = V.centroids(_base(spark, d))
    return c.select("label", F.posexplode("centroid").alias("dim", "mean")).withColumn("mean", F.round("mean", 6))


@register("""WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM x GROUP BY 1, 2), c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY 1),
s AS (SELECT label, avg(list_distance(embedding::DOUBLE[], c)) AS s, any_value(c) AS c FROM embeddings JOIN c USING (label) GROUP BY 1)
SELECT round(avg(r), 6) AS davies_bouldin FROM (SELECT a.label, max((a.s + b.s) / list_distance(a.c, b.c)) AS r FROM s a JOIN s b ON a.label <> b.label GROUP BY 1)""")
def davies_bouldin(spark: SparkSession, d: str) -> DataFrame:
    return V.davies_bouldin(_base(spark, d)).withColumn("davies_bouldin", F.round("davies_bouldin", 6))


@register("""WITH p AS (SELECT a.vec_id AS id, a.label, b.label AS other, sum(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS t, count(*) AS n FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
s AS (SELECT id, label, max(CASE WHEN label = other THEN t / n END) AS a, min(CASE WHEN label <> other THEN t / n END) AS b FROM p GROUP BY 1, 2)
SELECT CAST(label AS BIGINT) AS label, count(*) AS n, round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 5) AS silhouette FROM s GROUP BY 1""")
def silhouette(spark: SparkSession, d: str) -> DataFrame:
    return V.silhouette(_base(spark, d)).withColumn("silhouette", F.round("silhouette", 5))


@register("""WITH n AS (SELECT len(embedding) AS k, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)
SELECT count(*) AS vectors, CAST(min(k) AS INT) AS min_dims, CAST(max(k) AS INT) AS max_dims, CAST(0 AS BIGINT) AS bad, round(avg(n), 5) AS mean_norm, round(stddev_pop(n), 5) AS std_norm, count(*) FILTER (abs(n - 1) > 0.01) AS off_unit FROM n""")
def embedding_qa(spark: SparkSession, d: str) -> DataFrame:
    return V.embedding_qa(_base(spark, d))


_POINTS = "p AS (SELECT label AS skill, CASE WHEN skill_id % 6 = 5 THEN -1 ELSE skill_id % 6 END AS cluster, n AS frequency FROM esco_skills JOIN (SELECT skill_text AS label, count(*) AS n FROM extracted_skills GROUP BY 1) USING (label))"


def _points(spark: SparkSession, d: str) -> DataFrame:
    per = S.extracted_skills(spark, d).groupBy(F.col("skill_text").alias("label")).agg(F.count(F.lit(1)).alias("frequency"))
    cluster = F.when(F.col("skill_id") % 6 == 5, -1).otherwise(F.col("skill_id") % 6)
    return S.esco_skills(spark, d).join(per, "label").select(F.col("label").alias("skill"), cluster.alias("cluster"), "frequency")


@register(f"""WITH {_POINTS}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY frequency DESC, skill) AS r FROM p), t AS (SELECT cluster, list(skill ORDER BY r) FILTER (r <= 5) AS top FROM r GROUP BY 1)
SELECT cluster, count(*) AS size, CAST(sum(frequency) AS BIGINT) AS total, round(avg(frequency), 4) AS mean, any_value(top) AS top, CASE WHEN cluster = -1 THEN 'Noise' ELSE array_to_string(any_value(top)[1:3], ', ') END AS name FROM p JOIN t USING (cluster) GROUP BY 1""")
def cluster_summary(spark: SparkSession, d: str) -> DataFrame:
    return V.cluster_summary(_points(spark, d))


@register(f"""WITH {_POINTS}, c AS (SELECT cluster, count(*) AS n FROM p GROUP BY 1)
SELECT count(*) FILTER (cluster <> -1) AS n_clusters, round(coalesce(sum(n) FILTER (cluster = -1), 0) * 100.0 / sum(n), 2) AS noise_percent, max(n) FILTER (cluster <> -1) AS largest, min(n) FILTER (cluster <> -1) AS smallest, round(avg(n) FILTER (cluster <> -1), 4) AS mean_size FROM c""")
def cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    return V.cluster_sizes(_points(spark, d))


@register()
def density_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Density clusters of the embeddings in their first principal components."""
    return clustering.density_clusters(clustering.project(_base(spark, d), 8), radius=0.35, least=5)


@register()
def meta_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Centroids of the labels clustered once more."""
    c = V.centroids(_base(spark, d), normalise=True).select(F.col("label").cast("long").alias("vec_id"), F.col("centroid").alias("embedding"))
    return clustering.kmeans(c, 3).select(F.col("vec_id").alias("label"), "cluster")


@register()
def cluster_run(spark: SparkSession, d: str) -> DataFrame:
    """A run driven by a configuration: skills by SQL, clusters, then the quarterly matrix."""
    S.esco_skills(spark, d).createOrReplaceTempView("esco_skills")
    config = {"sql_query": "SELECT skill_id AS vec_id, label AS skill_text FROM esco_skills", "clusters": 4}
    return clustering.run(spark, config, _base(spark, d))
