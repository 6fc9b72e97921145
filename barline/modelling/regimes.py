"""Clusters and regime states: sweeps, profiles, principal components, mixtures, forward filtering."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.grid import Grid, Roll, over_series
from barline.operators.rules import order_states

VECTOR = "_features"


def assembled(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=VECTOR).transform(df.na.drop("any", subset=columns))


def davies_bouldin(df: DataFrame, cluster: str, columns: list[str], centers: list[list[float]]) -> float:
    """Mean over clusters of the worst (s_i + s_j) / d_ij; only k mean distances leave the cluster."""
    array = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centers])
    own = array[F.col(cluster)]
    dist = F.sqrt(reduce(lambda a, b: a + b, [(F.col(c) - own[i]) ** 2 for i, c in enumerate(columns)]))
    s = {r[cluster]: r["d"] for r in df.groupBy(cluster).agg(F.avg(dist).alias("d")).collect()}
    worst = [max((s[i] + s[j]) / math.dist(centers[i], centers[j]) for j in s if j != i) for i in s]
    return sum(worst) / len(worst) if worst else float("nan")


SWEEP = T.StructType(
    [T.StructField("k", T.IntegerType())]
    + [T.StructField(c, T.DoubleType()) for c in ("inertia", "silhouette", "davies_bouldin", "log_likelihood", "aic", "bic")]
)


def cluster_sweep(df: DataFrame, columns: list[str], ks: list[int], seed: int = 42, threads: int = 4) -> DataFrame:
    """Quality of k-means and Gaussian mixtures for every k; one result row per k."""
    rows = assembled(df, columns).persist()

    def one(k: int) -> tuple:
        km = KMeans(featuresCol=VECTOR, predictionCol="_c", k=k, seed=seed, maxIter=50).fit(rows)
        assigned = km.transform(rows)
        centers = [[float(v) for v in c] for c in km.clusterCenters()]
        sil = ClusteringEvaluator(featuresCol=VECTOR, predictionCol="_c").evaluate(assigned)
        db = davies_bouldin(assigned, "_c", columns, centers)
        ll = float(GaussianMixture(featuresCol=VECTOR, k=k, seed=seed, maxIter=50).fit(rows).summary.logLikelihood)
        p = k - 1 + k * d + k * d * (d + 1) // 2
        return k, float(km.summary.trainingCost), float(sil), float(db), ll, 2 * p - 2 * ll, p * math.log(n) - 2 * ll

    try:
        n, d = rows.count(), len(columns)
        with ThreadPoolExecutor(threads) as pool:
            out = list(pool.map(one, ks))
    finally:
        rows.unpersist()
    return df.sparkSession.createDataFrame(out, SWEEP)


def consensus_k(sweep: DataFrame) -> DataFrame:
    """Best k by silhouette, Davies-Bouldin, AIC and BIC; BIC decides."""
    return sweep.agg(
        F.max_by("k", "silhouette").alias("k_silhouette"),
        F.min_by("k", "davies_bouldin").alias("k_davies_bouldin"),
        F.min_by("k", "aic").alias("k_aic"),
        F.min_by("k", "bic").alias("k"),
    )


def profiles(df: DataFrame, cluster: str, columns: list[str], fwd: str, by: list[str]) -> DataFrame:
    """Column means, size and forward return per cluster, with its rank by forward return (0 lowest)."""
    out = df.groupBy(*by, cluster).agg(
        F.count(F.lit(1)).alias("n"), F.avg(fwd).alias("fwd_mean"), *[F.avg(c).alias(f"mean_{c}") for c in columns]
    )
    order = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("fwd_mean", cluster)
    return out.withColumn("label", F.row_number().over(order) - 1)


def temporal_stability(df: DataFrame, cluster: str, columns: list[str], time: str, by: list[str]) -> DataFrame:
    """Share of years in which each column mean of a cluster has its overall sign."""
    long = df.select(*by, cluster, F.year(time).alias("_y"), *columns).unpivot([*by, cluster, "_y"], columns, "feature", "_v")
    whole = long.groupBy(*by, cluster, "feature").agg(F.signum(F.avg("_v")).alias("_sign"))
    yearly = long.groupBy(*by, cluster, "feature", "_y").agg(F.signum(F.avg("_v")).alias("_ys"))
    both = yearly.join(whole, [*by, cluster, "feature"])
    return both.groupBy(*by, cluster, "feature").agg(
        F.count(F.lit(1)).alias("years"), F.avg((F.col("_ys") == F.col("_sign")).cast("double")).alias("stability")
    )


PCA_ROWS = T.StructType(
    [
        T.StructField("component", T.IntegerType()),
        T.StructField("explained", T.DoubleType()),
        T.StructField("feature", T.StringType()),
        T.StructField("loading", T.DoubleType()),
        T.StructField("driver_rank", T.IntegerType()),
    ]
)


def pca(df: DataFrame, columns: list[str], n: int = 2) -> DataFrame:
    """Explained variance and loadings; the three largest |loading| of a component are its drivers."""
    model = PCA(k=n, inputCol=VECTOR, outputCol="_pc").fit(assembled(df, columns))
    weights, share = model.pc.toArray(), model.explainedVariance.toArray()
    out = []
    for j in range(n):
        ranked = sorted(range(len(columns)), key=lambda i: -abs(weights[i][j]))
        for i, c in enumerate(columns):
            out.append((j + 1, float(share[j]), c, float(weights[i][j]), ranked.index(i) + 1))
    return df.sparkSession.createDataFrame(out, PCA_ROWS)


def fit_regimes(
    df: DataFrame, columns: list[str], n: int = 2, order_by: str = "drawdown", seed: int = 42, train: str = "true"
) -> DataFrame:
    """Mixture states on standardised features, ordered so that the deepest mean drawdown is state 0.

    Adds ``state`` and ``p_bull`` (probability of the highest state). The EM runs on the cluster,
    on the rows that fulfil ``train`` only; all rows are scored.
    """
    rows = assembled(df, columns)
    model = GaussianMixture(featuresCol=VECTOR, predictionCol="_raw", probabilityCol="_prob", k=n, seed=seed, maxIter=100).fit(rows.filter(train))
    at = columns.index(order_by) if order_by in columns else 0
    means = [float(g.mean[at]) for g in model.gaussians]
    ordered = sorted(range(n), key=lambda s: (means[s], s))
    label = F.array(*[F.lit(ordered.index(s)) for s in range(n)])
    out = model.transform(rows)
    return out.withColumns(
        {"state": label[F.col("_raw")], "p_bull": vector_to_array("_prob")[ordered[-1]]}
    ).drop(VECTOR, "_raw", "_prob")


def walk_forward_regimes(rows: DataFrame, columns: list[str], splits: list[str], keep: list[str], n: int = 2) -> DataFrame:
    """States of the test rows of each split, from a mixture fitted on its training rows only."""
    parts = []
    for s in splits:
        states = fit_regimes(rows.filter(F.col("split") == s), columns, n, train="role = 'train'")
        parts.append(states.filter("role = 'test'").select(*keep, "split", "state", "p_bull"))
    return reduce(DataFrame.unionByName, parts)


def emissions(columns: list[str], params: dict) -> Column:
    """Log density of the standardised features under each state's diagonal normal; null if a feature is."""
    out = []
    for mean, var in zip(params["means"], params["variances"]):
        terms = []
        for c, m, v, center, width in zip(columns, mean, var, params["center"], params["scale"]):
            z = (F.col(c) - center) / width
            terms.append(-0.5 * (math.log(2 * math.pi * v) + (z - m) ** 2 / v))
        out.append(reduce(lambda a, b: a + b, terms))
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return F.when(known, F.array(*out))


def score_regimes(df: DataFrame, grid: Grid, columns: list[str], params: dict, n: int = 10) -> DataFrame:
    """State and probabilities of each row from the rows in its n-row context, given model parameters.

    ``posterior`` is the forward-filtered distribution at the row, ``state`` the last state of the
    best path. Rows with a missing feature give null and are left out of other rows' contexts.
    """
    k = len(params["means"])
    a = params["transition"]

    def normal(v: Column) -> Column:
        total = reduce(lambda x, y: x + y, [v[i] for i in range(k)])
        return F.transform(v, lambda x: x / total)

    def likelihood(ll: Column) -> list[Column]:
        top = F.array_max(ll)
        return [F.exp(ll[j] - top) for j in range(k)]

    def forward_start(ll: Column) -> Column:
        e = likelihood(ll)
        return normal(F.array(*[F.lit(float(params["start"][j])) * e[j] for j in range(k)]))

    def forward(acc: Column, ll: Column) -> Column:
        e = likelihood(ll)
        return normal(
            F.array(*[reduce(lambda x, y: x + y, [acc[i] * float(a[i][j]) for i in range(k)]) * e[j] for j in range(k)])
        )

    def best_start(ll: Column) -> Column:
        return F.array(*[F.lit(math.log(max(params["start"][j], 1e-300))) + ll[j] for j in range(k)])

    def best(acc: Column, ll: Column) -> Column:
        return F.array(*[F.greatest(*[acc[i] + math.log(max(a[i][j], 1e-300)) for i in range(k)]) + ll[j] for j in range(k)])

    def folded(w, start, step) -> Column:
        seq = w.agg(F.collect_list("_ll"), 1 - n)
        first = start(F.element_at(seq, 1))
        return F.when(F.col("_ll").isNotNull(), F.aggregate(F.slice(seq, 2, n), first, step))

    out = over_series(
        df.withColumn("_ll", emissions(columns, params)),
        grid,
        {
            "posterior": Roll(lambda w: folded(w, forward_start, forward), back=n - 1),
            "_path": Roll(lambda w: folded(w, best_start, best), back=n - 1),
        },
    )
    state = F.array_position("_path", F.array_max("_path")).cast("int") - 1
    return out.withColumn("state", F.when(F.col("_path").isNotNull(), state)).drop("_ll", "_path")


__all__ = ["assembled", "cluster_sweep", "consensus_k", "davies_bouldin", "emissions", "fit_regimes", "order_states", "pca", "profiles", "score_regimes", "temporal_stability", "walk_forward_regimes"]
