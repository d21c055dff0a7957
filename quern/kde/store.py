"""Persisting models: one Parquet row for the model, a table for its sample, by version."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quern.kde.model import Model, scott

MODEL = "table string, columns array<string>, rowcount_table long, rowcount_sample long, scale_mean array<double>, scale_sd array<double>, bandwidth array<double>, kernel string, representation string, version int, batches map<string,int>"


def save(spark: SparkSession, model: Model, path: str) -> None:
    model.version += 1
    row = (model.table, model.columns, model.rows, len(model.points), *(list(map(float, x)) for x in (model.mean, model.sd, model.bandwidth)), model.kernel, model.representation, model.version, model.batches)
    dump_sample(spark, model).write.mode("overwrite").parquet(f"{path}/sample/version={model.version}")
    spark.createDataFrame([row], MODEL).coalesce(1).write.mode("append").parquet(f"{path}/model")


def load(spark: SparkSession, path: str) -> Model:
    r = spark.read.schema(MODEL).parquet(f"{path}/model").orderBy(F.desc("version")).first()
    s = spark.read.parquet(f"{path}/sample/version={r['version']}").orderBy("slot").collect()  # kde_samplesize rows
    raw = np.array([[x[c] for c in r["columns"]] for x in s], float)
    mean, sd = np.array(r["scale_mean"]), np.array(r["scale_sd"])
    return Model(r["table"], r["columns"], (raw - mean) / sd, mean, sd, np.array(r["bandwidth"]), r["rowcount_table"], r["kernel"], r["representation"], np.array([x["karma"] for x in s]), r["version"], dict(r["batches"] or {}))


def dump_sample(spark: SparkSession, model: Model) -> DataFrame:
    schema = T.StructType([T.StructField("slot", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in model.columns), T.StructField("karma", T.DoubleType())])
    raw = model.points * model.sd + model.mean
    return spark.createDataFrame([(i, *map(float, p), float(k)) for i, (p, k) in enumerate(zip(raw, model.karma, strict=True))], schema)


def import_sample(model: Model, sample: DataFrame) -> None:
    raw = np.array([[float(r[c]) for c in model.columns] for r in sample.collect()], float)
    model.points, model.karma = (raw - model.mean) / model.sd, np.zeros(len(raw))


def reset_bandwidth(model: Model) -> None:
    h = np.full(len(model.columns), scott(len(model.columns), len(model.points)))
    model.bandwidth = np.log(h) if model.representation == "log" else h


def set_bandwidth(model: Model, values: list[float]) -> None:
    h = np.array(values, float)
    model.bandwidth = np.log(h) if model.representation == "log" else h


def stats(model: Model) -> dict:
    return {"table": model.table, "rows": model.rows, "sample": len(model.points), "bandwidth": json.dumps(model.h().tolist()), "version": model.version, "mean_karma": float(model.karma.mean()) if len(model.karma) else 0.0}


def error_log_line(relation: str, metrics: list[float], estimate: float, truth: float, tuples: int) -> str:
    return " ; ".join([relation, *(f"{m:.8f}" for m in metrics), f"{estimate:.8f}", f"{truth:.8f}", str(tuples)])
