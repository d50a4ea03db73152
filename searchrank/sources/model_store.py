"""Saving and loading fitted models (M5).

Models are folders written by executors and MLlib writers: the ALS factors with
``ALSModel.save``, bias and id-map tables as Parquet, a ranker's forest as a Parquet
node table, and one JSON metadata row (parameters, creation time).  Names carry a
timestamp (``<prefix>_YYYYmmdd_HHMM``) so the newest model is the greatest name; the
folder listing uses the Hadoop FileSystem API, so local, HDFS and object-store
paths behave alike.
"""

from __future__ import annotations

import datetime
import json

from pyspark.ml.recommendation import ALSModel
from pyspark.sql import SparkSession

from ..operators.histtree import Bins, Forest, Tree
from ..operators.ltr import LTRModel
from ..operators.mf import BiasModel, MFModel


def model_name(prefix: str, now: datetime.datetime | None = None) -> str:
    return f"{prefix}_{(now or datetime.datetime.now()).strftime('%Y%m%d_%H%M')}"


def _write_meta(spark: SparkSession, path: str, meta: dict) -> None:
    meta = dict(meta, created=datetime.datetime.now().isoformat(timespec="seconds"))
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(
        f"{path}/meta")


def _read_meta(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/meta").first()[0])


def save_mf_model(model: MFModel, path: str) -> str:
    spark = model.bias.item_bias.sparkSession
    model.als.write().overwrite().save(f"{path}/als")
    model.bias.item_bias.write.mode("overwrite").parquet(f"{path}/item_bias")
    model.bias.user_bias.write.mode("overwrite").parquet(f"{path}/user_bias")
    model.user_index.write.mode("overwrite").parquet(f"{path}/user_index")
    model.item_index.write.mode("overwrite").parquet(f"{path}/item_index")
    _write_meta(spark, path, {"kind": "mf", "mu": model.bias.mu, "rank": model.als.rank})
    return path


def load_mf_model(spark: SparkSession, path: str) -> MFModel:
    meta = _read_meta(spark, path)
    bias = BiasModel(meta["mu"], spark.read.parquet(f"{path}/item_bias"), spark.read.parquet(f"{path}/user_bias"))
    return MFModel(bias, ALSModel.load(f"{path}/als"), spark.read.parquet(f"{path}/user_index"),
                   spark.read.parquet(f"{path}/item_index"))


NODES = ["feature", "cut", "nulls_left", "left", "right", "value", "gain", "rows"]


def save_ltr_model(spark: SparkSession, model: LTRModel, path: str) -> str:
    """The forest as one node table and one table of bin edges, with the fit's history in the metadata."""
    forest = model.forest
    nodes = [(t, k, *(getattr(tree, c)[k].item() for c in NODES)) for t, tree in enumerate(forest.trees) for k in range(len(tree.feature))]
    spark.createDataFrame(nodes, "tree int, node int, feature int, cut int, nulls_left boolean, left int, right int, value double, gain double, rows long"
                          ).write.mode("overwrite").parquet(f"{path}/nodes")
    edges = [(f, k, float(x)) for f, edge in enumerate(forest.bins.edges) for k, x in enumerate(edge)]
    spark.createDataFrame(edges, "feature int, k int, edge double").write.mode("overwrite").parquet(f"{path}/edges")
    _write_meta(spark, path, {"kind": "ltr", "features": model.features, "learning_rate": forest.learning_rate, "n_trees": len(forest.trees),
                              "best_iteration": model.best_iteration, "history": model.history, "columns": model.columns})
    return path


def load_ltr_model(spark: SparkSession, path: str) -> LTRModel:
    meta = _read_meta(spark, path)
    edges = spark.read.parquet(f"{path}/edges").orderBy("feature", "k").toPandas()
    bins = Bins(meta["features"], [edges.loc[edges["feature"] == f, "edge"].to_numpy(float) for f in range(len(meta["features"]))])
    nodes = spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").toPandas()  # the model itself
    types = {"cut": "uint8", "nulls_left": bool, "value": float, "gain": float, "rows": "int64"}
    trees = [Tree(*(one[c].to_numpy(types.get(c, "int32")) for c in NODES)) for _, one in nodes.groupby("tree", sort=True)]
    return LTRModel(Forest(bins, meta["learning_rate"], trees), meta["history"], meta["best_iteration"], meta["columns"])


def newest_model(spark: SparkSession, folder: str, prefix: str) -> str | None:
    """Path of the model with the greatest timestamped name under ``folder``."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return None
    names = [st.getPath().getName() for st in fs.listStatus(root) if st.isDirectory()]
    names = sorted(n for n in names if n.startswith(prefix + "_"))
    return f"{folder.rstrip('/')}/{names[-1]}" if names else None
