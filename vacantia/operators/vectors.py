"""Vector operators: similarity search, centroids, cluster measures and quality checks of embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector over its length; a null vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: (x / n).cast("float"))).otherwise(a)


def knn(queries: DataFrame, base: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", block: int = 4096, others: bool = True) -> DataFrame:
    """``query``, ``neighbor``, ``score``, ``rank``: exact inner products, the ``k`` largest, ties by id.

    Base rows are dealt to blocks and queries to blocks of a stated size; each pair of blocks is one matrix
    product whose best ``k`` per query go on, so neither side is broadcast or held as a whole.
    """
    n_base, n_query = (max(1, -(-df.count() // block)) for df in (base, queries))
    q = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), F.pmod(F.xxhash64(id_col), F.lit(n_query)).cast("int").alias("qb")).withColumn("bb", F.explode(F.sequence(F.lit(0), F.lit(n_base - 1))))
    b = base.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), F.pmod(F.xxhash64(id_col), F.lit(n_base)).cast("int").alias("bb")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": [], "neighbor": [], "score": []})
        x, y = (np.stack(df["vec"].to_numpy()).astype(np.float64) for df in (left, right))
        score = x @ y.T
        ids = right["id"].to_numpy()
        if others:
            score[left["id"].to_numpy()[:, None] == ids[None, :]] = -np.inf
        out = []
        for i, query in enumerate(left["id"]):
            order = np.lexsort((ids, -score[i]))[:k]
            out += [(query, ids[j], score[i, j]) for j in order if np.isfinite(score[i, j])]
        return pd.DataFrame(out, columns=["query", "neighbor", "score"])

    pairs = q.groupBy("qb", "bb").cogroup(b.groupBy("qb", "bb")).applyInPandas(best, "query long, neighbor long, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "neighbor"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def _positions(df: DataFrame, vec: str, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode(vec).alias("i", "x"))


def centroids(df: DataFrame, label: str = "label", vec: str = "embedding", normalise: bool = False) -> DataFrame:
    """``label``, ``n``, ``centroid``: the mean vector, of unit length if asked. Sums combine on the map side."""
    mean = _positions(df, vec, label).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    out = mean.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))
    if normalise:
        n = norm(F.col("centroid"))
        out = out.withColumn("centroid", F.transform("centroid", lambda x: x / n))
    return out.join(df.groupBy(label).agg(F.count(F.lit(1)).alias("n")), label).select(label, "n", "centroid")


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def davies_bouldin(df: DataFrame, label: str = "label", vec: str = "embedding") -> DataFrame:
    """``davies_bouldin``: mean over clusters of the worst ratio of scatter to centroid distance. Noise (-1) is left out."""
    rows = df.where(F.col(label) != -1)
    c = centroids(rows, label, vec)
    scatter = rows.join(F.broadcast(c), label).groupBy(label).agg(F.avg(distance(F.col(vec), F.col("centroid"))).alias("s")).join(c, label)
    a = scatter.select(F.col(label).alias("a"), F.col("s").alias("sa"), F.col("centroid").alias("ca"))
    b = scatter.select(F.col(label).alias("b"), F.col("s").alias("sb"), F.col("centroid").alias("cb"))
    worst = a.join(b, F.col("a") != F.col("b")).groupBy("a").agg(F.max((F.col("sa") + F.col("sb")) / distance(F.col("ca"), F.col("cb"))).alias("r"))
    return worst.agg(F.avg("r").alias("davies_bouldin"))


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once: under the checkpoint folder if the session has one."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.cache()


def slabs(rows: DataFrame, size: int, least: int = 8, columns: tuple[str, ...] = ()) -> DataFrame:
    """``slab``, ``id``, ``vec`` (binary, 64-bit numbers and 32 or 64-bit floats) and further 64-bit ``columns``: about ``size``
    rows (``id``, ``vec``) in a row, and at least ``least`` slabs if there are rows enough. Written once."""
    n = max(1, -(-rows.count() // size), min(least, rows.count() // 1024))
    kind = np.float32 if rows.schema["vec"].dataType.elementType.simpleString() == "float" else np.float64

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = {c: [] for c in ("id", "vec", *columns)}
        for pdf in batches:
            for c in got if len(pdf) else ():
                got[c].append((np.stack(pdf[c].to_numpy()).astype(kind) if c == "vec" else pdf[c].to_numpy(np.int64)).tobytes())
        if got["id"]:
            yield pd.DataFrame({c: [b"".join(x)] for c, x in got.items()})

    packed = rows.select("id", "vec", *columns).repartition(n).mapInPandas(pack, ", ".join(f"{c} binary" for c in ("id", "vec", *columns)))
    return cut(packed.withColumn("slab", F.monotonically_increasing_id()).withColumn("wide", F.lit(kind is np.float64)))


def slab_pairs(a: DataFrame, b: DataFrame, both: bool = False) -> DataFrame:
    """Each slab with itself and those after it, or with all if ``both``: columns end in 1 and 2. A pair is a task; nothing is shuffled."""
    one, two = (df.select([F.col(c).alias(c + k) for c in df.columns]) for df, k in ((a, "1"), (b, "2")))
    return one.hint("shuffle_replicate_nl").join(two, F.lit(True) if both else F.col("slab1") <= F.col("slab2"))


def unpack(row, side: str, *columns: str) -> tuple:  # noqa: ANN001
    """Ids, vectors in 64 bits and further columns of one side of a pair."""
    ids = np.frombuffer(row[f"id{side}"], np.int64)
    vec = np.frombuffer(row[f"vec{side}"], np.float64 if row[f"wide{side}"] else np.float32).astype(np.float64).reshape(len(ids), -1)
    return ids, vec, *[np.frombuffer(row[c + side], np.int64) for c in columns]


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` and ``y``."""
    d = x @ (-2 * y.T)
    d += (x * x).sum(1)[:, None]
    d += (y * y).sum(1)
    return d


def silhouette(df: DataFrame, label: str = "label", vec: str = "embedding", id_col: str = "vec_id", block: int = 65536, tile: int = 512) -> DataFrame:
    """``label``, ``n``, ``silhouette``: mean over points of (b - a) / max(a, b) with euclidean distances, noise left out.

    Exact, so the time grows with the square of the points. A task is a pair of slabs, of which one point in turn
    meets the other in tiles of products; it yields the distance sums of its points by cluster. What is kept grows with
    points times clusters times slabs, memory with ``block``; a point alone in its cluster counts as 0.
    """
    rows = df.where(F.col(label) != -1).select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vec).alias("vec"))
    clusters = max(1, rows.select("label").distinct().count())
    size = max(min(block, 2048), min(block, (1 << 23) // clusters))
    part = max(1, min(size, (1 << 23) // clusters))
    points = slabs(rows, size, columns=("label",))

    def told(ids: np.ndarray, slab: int, label: np.ndarray, total: np.ndarray, names: np.ndarray, n: np.ndarray) -> Iterator[pd.DataFrame]:
        for at in range(0, len(ids), part):
            yield pd.DataFrame({"slab": [slab], "part": [at], "label": [label[at : at + part].tobytes()], "names": [names.tobytes()], "n": [n.tobytes()], "total": [np.ascontiguousarray(total[at : at + part]).tobytes()]})

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in (r for pdf in batches for r in pdf.to_dict("records")):
            (ia, x, la), (ib, y, lb) = unpack(row, "1", "label"), unpack(row, "2", "label")
            same, order = row["slab1"] == row["slab2"], np.argsort(lb, kind="stable")
            names, first, n = np.unique(lb[order], return_index=True, return_counts=True)
            y, sorted_ids = y[order], ib[order]
            mine, code, m = np.unique(la, return_inverse=True, return_counts=True)
            left, right = np.zeros((len(ia), len(names))), np.zeros((len(mine), len(ib)))
            for i in range(0, len(ia), tile):
                at = slice(i, i + tile)
                hot = np.eye(len(mine))[code[at]].T if not same and len(mine) <= 64 else None
                for lo in range(0, len(ib), 4096):
                    hi = min(lo + 4096, len(ib))
                    d = squared(x[at], y[lo:hi])
                    if same:
                        d[ia[at, None] == sorted_ids[None, lo:hi]] = 0
                    np.sqrt(np.maximum(d, 0, out=d), out=d)
                    k = np.unique(np.searchsorted(first, np.arange(lo, hi), "right") - 1) if len(first) > 1 else np.zeros(1, int)
                    left[at, k] += np.add.reduceat(d, np.maximum(first[k] - lo, 0), axis=1)
                    if hot is not None:
                        right[:, lo:hi] += hot @ d
                    elif not same:
                        np.add.at(right[:, lo:hi], code[at], d)
            yield from told(ia, row["slab1"], la, left, names, n)
            if not same:
                back = np.empty((len(ib), len(mine)))
                back[order] = right.T
                yield from told(ib, row["slab2"], lb, back, mine, m)

    def point(pdf: pd.DataFrame) -> pd.DataFrame:
        label = np.frombuffer(pdf["label"].iloc[0], np.int64)
        every = [np.frombuffer(x, np.int64) for x in pdf["names"]]
        names = np.unique(np.concatenate(every))
        total, n = np.zeros((len(label), len(names))), np.zeros(len(names))
        for here, sizes, sums in zip(every, pdf["n"], pdf["total"], strict=True):
            at = np.searchsorted(names, here)
            n[at] += np.frombuffer(sizes, np.int64)
            total[:, at] += np.frombuffer(sums, np.float64).reshape(len(label), -1)
        row, own = np.arange(len(label)), np.searchsorted(names, label)
        mean = total / n
        mean[row, own] = np.inf
        b = mean.min(1)
        alone = (n[own] < 2) | ~np.isfinite(b)
        a = total[row, own] / np.maximum(n[own] - 1, 1)
        with np.errstate(invalid="ignore"):
            s = np.where(alone, 0.0, (b - a) / np.maximum(a, b))
        got, where, count = np.unique(label, return_inverse=True, return_counts=True)
        return pd.DataFrame({"label": got, "n": count, "s": np.bincount(where, s)})

    pairs = slab_pairs(points, points).mapInPandas(sums, "slab long, part long, label binary, names binary, n binary, total binary")
    per = pairs.groupBy("slab", "part").applyInPandas(point, "label long, n long, s double")
    return per.groupBy("label").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("silhouette"))


def cluster_summary(points: DataFrame, top: int = 5, cluster: str = "cluster", skill: str = "skill", frequency: str = "frequency") -> DataFrame:
    """``cluster``, ``size``, ``total``, ``mean``, ``top`` (most frequent skills), ``name`` (its first three, or Noise)."""
    w = Window.partitionBy(cluster).orderBy(F.desc(frequency), skill)
    best = points.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", skill))), lambda s: s[skill]).alias("top"))
    sizes = points.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"), F.sum(frequency).alias("total"), F.round(F.avg(frequency), 4).alias("mean"))
    name = F.when(F.col(cluster) == -1, "Noise").otherwise(F.array_join(F.slice("top", 1, 3), ", "))
    return sizes.join(best, cluster).withColumn("name", name)


def cluster_sizes(points: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Number of clusters, noise in percent, largest, smallest and mean size (noise left out)."""
    per = points.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    real = F.col(cluster) != -1
    size = F.when(real, F.col("n"))
    return per.agg(F.count_if(real).alias("n_clusters"), F.round(F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0)) * 100.0 / F.sum("n"), 2).alias("noise_percent"), F.max(size).alias("largest"), F.min(size).alias("smallest"), F.round(F.avg(size), 4).alias("mean_size"))


def embedding_qa(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """Vectors, dimensions, rows with NaN or infinite values, mean and deviation of lengths, vectors off unit length."""
    n = norm(F.col(vec))
    bad = F.exists(vec, lambda x: F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull())
    return df.agg(F.count(F.lit(1)).alias("vectors"), F.min(F.size(vec)).alias("min_dims"), F.max(F.size(vec)).alias("max_dims"), F.count_if(bad).alias("bad"), F.round(F.avg(n), 5).alias("mean_norm"), F.round(F.stddev_pop(n), 5).alias("std_norm"), F.count_if(F.abs(n - 1) > 0.01).alias("off_unit"))


def embed(texts: DataFrame, model, text_col: str = "skill_text", batch: int = 256) -> DataFrame:  # noqa: ANN001
    """``skill_text``, ``embedding`` from an injected ``model`` (list of texts to list of vectors), in batches, unit length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                names = pdf["skill_text"].iloc[at : at + batch].tolist()
                x = np.asarray(model(names), dtype=np.float64)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                yield pd.DataFrame({"skill_text": names, "embedding": list(x.astype(np.float32))})

    return texts.select(F.col(text_col).alias("skill_text")).distinct().mapInPandas(run, "skill_text string, embedding array<float>")
