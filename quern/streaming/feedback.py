"""Streams: the query-feedback loop and sample maintenance from a change stream."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.kde import maintenance, optimise, ranges as R, store
from quern.kde.config import Config, Online
from quern.kde.model import Model, random_sample


def learn_from(feedback: DataFrame, model: Model, path: str, checkpoint: str, config: Config | None = None) -> StreamingQuery:
    """Each micro-batch of feedback rows steps the bandwidth and the karma; the model is saved after it.

    The model keeps the number of the last batch that it holds of each stream, so a batch that is replayed after a failure
    changes nothing, however often the model was saved before.
    """
    config = config or Config()
    o = optimise.RmsProp(len(model.columns)) if config.kde_online_optimization_algorithm == Online.RMSPROP else optimise.VSgd(len(model.columns), config.kde_minibatch_size)

    def step(batch: DataFrame, n: int) -> None:
        if n <= model.batches.get(checkpoint, -1):
            return
        seen = [(R.decode(r["ranges"]), r["qualifiedtuples"] / r["alltuples"]) for r in batch.orderBy("ts").toLocalIterator() if r["alltuples"]]
        optimise.learn_online(model, seen, o, config.kde_error_metric, config.kde_minibatch_size)
        for ranges, truth in seen:
            maintenance.update_karma(model, ranges, truth, config.kde_sample_maintenance_karma_limit)
        model.batches[checkpoint] = n
        store.save(batch.sparkSession, model, path)

    return feedback.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deleted_slots(batch: DataFrame, model: Model) -> np.ndarray:
    """Slots whose row is among the batch's deleted ones. The sample (kde_samplesize rows) is broadcast; its slots come back."""
    spark = batch.sparkSession
    raw = model.points * model.sd + model.mean
    rows = [(i, *map(float, p)) for i, p in enumerate(raw)]
    names = [f"__p{i}" for i in range(len(model.columns))]
    sample = spark.createDataFrame(rows, "__slot int, " + ", ".join(f"{n} double" for n in names))
    close = [F.abs(F.col(c).cast("double") - F.col(n)) <= float(1e-9 * s) for c, n, s in zip(model.columns, names, model.sd, strict=True)]
    on = F.lit(True)
    for x in close:
        on = on & x
    # equal keys first, so that a deleted row meets the points of its value only
    key = lambda c: F.round(F.col(c).cast("double"), 4)
    near = F.broadcast(sample.withColumn("__k", key(names[0])))
    hit = batch.where("op = 'delete'").withColumn("__j", key(model.columns[0])).join(near, (F.col("__j") == F.col("__k")) & on)
    return np.array(sorted(r[0] for r in hit.select("__slot").distinct().collect()), np.int64)


def maintain(changes: DataFrame, model: Model, table: DataFrame, checkpoint: str, seed: int = 1, path: str | None = None) -> StreamingQuery:
    """changes (seq, op, the model's columns): inserts and deletes keep the sample representative (CAR).

    A micro-batch is counted, one Binomial says how many sample rows its inserts take, and these are drawn from it; sample rows
    that were deleted are found by a join and drawn anew from table, which is the table after the changes. With a
    path the model is saved with the batch's number, and a replayed batch changes nothing.
    """

    def step(batch: DataFrame, n: int) -> None:
        if n <= model.batches.get(checkpoint, -1):
            return
        rng = np.random.default_rng([seed, n])
        raw = lambda rows: np.array([[float(x) for x in r] for r in rows], float).reshape(-1, len(model.columns))
        draw = lambda df: lambda k: raw(random_sample(df, model.columns, k, int(rng.integers(1 << 30))).collect())  # noqa: E731  the sample's size at most
        counts = batch.agg(F.count_if(F.col("op") == "insert").alias("i"), F.count_if(F.col("op") == "delete").alias("d")).first()
        hit = deleted_slots(batch, model) if counts["d"] else np.empty(0, np.int64)
        maintenance.car_batch(model, counts["i"], counts["d"], hit, rng, draw(batch.where("op = 'insert'")), draw(table))
        model.batches[checkpoint] = n
        if path:
            store.save(batch.sparkSession, model, path)

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
