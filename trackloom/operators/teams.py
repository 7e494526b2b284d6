"""Two teams from player colours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def team_votes(labels: DataFrame, key: str = "clip_id") -> DataFrame:
    """(clip, track_id, team): the majority label of a track, 0 if tied."""
    return labels.groupBy(key, "track_id").agg((F.avg("label") > 0.5).cast("int").alias("team"))


def cluster_labels(features: DataFrame, cols: list[str], seed: int = 0, starts: int = 5) -> DataFrame:
    """features with label: k-means into two, the best of some starts; the cluster that is lower in the first column
    is 0; fewer than two rows are 0. The fits run when this is called, as the label needs their centres."""
    if features.limit(2).count() < 2:
        return features.withColumn("label", F.lit(0))
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=cols, outputCol="_v").transform(features)
    fits = [KMeans(k=2, seed=seed + k, featuresCol="_v", predictionCol="_c", maxIter=50).fit(data) for k in range(starts)]
    model = min(fits, key=lambda m: m.summary.trainingCost)
    centres = model.clusterCenters()
    low = min(range(len(centres)), key=lambda i: centres[i][0])
    return model.transform(data).withColumn("label", (F.col("_c") != low).cast("int")).drop("_v", "_c")
