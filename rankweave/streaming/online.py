"""Online learners over a stream: updates in event order, the model as a table of its states."""

from __future__ import annotations

import copy
import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.learners import AttentionWeights, LearnableWeights, MultiHead, Transform


class Online:
    """Feeds rows of a stream to a learner, a micro-batch at a time.

    Updates depend on their order, so a batch's rows are sorted by ``event_time`` (equal ones by their
    values) and applied one by one on the driver, in bounded pieces; ``sink`` gets the state
    after each batch. With ``store``, a path, each batch leaves the model there with its number; a
    learner that starts again goes on from the last one and passes over batches that it holds.
    """

    columns: tuple[str, ...] = ()
    #: Columns of a state, as :func:`online_by_key` returns them.
    schema = ""

    def __init__(self, model: Any, sink: Callable[[int, dict], None] | None = None, store: str | None = None, **rates: float):
        self.model, self.sink, self.store, self.rates, self.last = model, sink, store, rates, -1

    def learn(self, row) -> None:
        raise NotImplementedError

    def state(self) -> dict:
        raise NotImplementedError

    def batch(self, rows: DataFrame, batch_id: int) -> None:
        if batch_id <= self.last:
            return
        for r in rows.orderBy("event_time", *self.columns).select(*self.columns).toLocalIterator():
            self.learn(r)
        self.last = batch_id
        if self.store:
            held = rows.sparkSession.createDataFrame([(batch_id, bytearray(pickle.dumps(self.model)))], "batch_id long, model binary")
            held.coalesce(1).write.mode("append").parquet(self.store)
        if self.sink:
            self.sink(batch_id, self.state())

    def resume(self, spark: SparkSession) -> None:
        """Take the last stored model, if there is one."""
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.store)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            row = spark.read.schema("batch_id long, model binary").parquet(self.store).agg(F.max("batch_id").alias("last"), F.max_by("model", "batch_id").alias("model")).first()
            if row.last is not None:
                self.last, self.model = row.last, pickle.loads(bytes(row.model))

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        if self.store:
            self.resume(stream.sparkSession)
        out = stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint)
        return (out.trigger(**trigger) if trigger else out).start()


class OnlineTransform(Online):
    """A transform, with a half-life or without, by (event_time, score, label)."""

    columns = ("score", "label")
    schema = "alpha double, beta double, alpha_mean double, beta_mean double, updates long"

    def __init__(self, model: Transform | None = None, sink: Callable[[int, dict], None] | None = None, store: str | None = None, **rates: float):
        super().__init__(model or Transform(), sink, store, **rates)

    def learn(self, row) -> None:
        self.model.update([row.score], [row.label], **self.rates)

    def state(self) -> dict:
        s = self.model.state
        return {"alpha": self.model.alpha, "beta": self.model.beta, "alpha_mean": float(s.mean[0]), "beta_mean": float(s.mean[1]), "updates": s.n}


class OnlineWeights(Online):
    """Fusion weights by (event_time, probs, label), probs an array of signals."""

    columns = ("probs", "label")
    schema = "weights array<double>, weights_mean array<double>, updates long"

    def __init__(self, model: LearnableWeights, sink: Callable[[int, dict], None] | None = None, store: str | None = None, **rates: float):
        super().__init__(model, sink, store, **rates)

    def learn(self, row) -> None:
        self.model.update(row.probs, row.label, **self.rates)

    def state(self) -> dict:
        return {"weights": self.model.weights.tolist(), "weights_mean": self.model.mean.tolist(), "updates": self.model.state.n}


class OnlineAttention(Online):
    """Attention weights, of one head or several, by (event_time, probs, features, label)."""

    columns = ("probs", "features", "label")
    schema = "theta array<array<double>>, theta_mean array<array<double>>, updates long"

    def __init__(self, model: AttentionWeights | MultiHead, sink: Callable[[int, dict], None] | None = None, store: str | None = None, **rates: float):
        super().__init__(model, sink, store, **rates)

    def learn(self, row) -> None:
        self.model.update([row.probs], [row.label], row.features, **self.rates)

    def state(self) -> dict:
        heads = self.model.models if isinstance(self.model, MultiHead) else [self.model]
        return {"theta": [h.state.theta.tolist() for h in heads], "theta_mean": [h.state.mean.tolist() for h in heads], "updates": heads[0].state.n}


def _plain(value):
    """A value that compares: arrays as tuples."""
    return tuple(value.tolist()) if isinstance(value, np.ndarray) else value


def online_by_key(stream: DataFrame, learner: Online, key: str = "model_id") -> DataFrame:
    """One model for each ``key``, all learning at once: its state after each micro-batch that has rows for it.

    ``learner`` says how a model begins and learns; every key starts from a copy of its model. The
    models lie in Spark's state store, dealt by key, so none passes through the driver and a restart or a lost
    executor goes on from the checkpoint. Updates of one model depend on their order and so are made by one task:
    a micro-batch's rows of a key are held there, sorted by ``event_time`` and then by value as
    :class:`Online` sorts them, so the source's rows a trigger bound its memory. Rows with a null among
    key, time and values are passed over; other columns are not read.
    """
    columns = ["event_time", *learner.columns]
    blank = copy.copy(learner)
    blank.sink = blank.store = None
    kind = stream.select(key).schema[0].dataType.simpleString()
    names = [c.split()[0] for c in learner.schema.split(", ")]

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        one = copy.copy(blank)
        one.model = pickle.loads(bytes(state.get[0])) if state.exists else copy.deepcopy(blank.model)
        rows = [r for f in frames for r in f[columns].itertuples(index=False)]
        for r in sorted(rows, key=lambda r: tuple(_plain(v) for v in r)):
            one.learn(r)
        state.update((pickle.dumps(one.model),))
        now = one.state()
        yield pd.DataFrame([[k[0], *(now[n] for n in names)]], columns=[key, *names])

    rows = stream.select(key, *columns).na.drop("any")
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {learner.schema}", "model binary", "update", "NoTimeout")
