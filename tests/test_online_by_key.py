"""Models by key in the state store against the same learners fed one by one."""

import numpy as np
import pytest


def _drain(out, path, checkpoint):
    write = lambda rows, _: rows.write.mode("append").parquet(path)
    out.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination(120)


def _learners():
    from rankweave.operators.learners import AttentionWeights, LearnableWeights, Transform
    from rankweave.streaming.online import OnlineAttention, OnlineTransform, OnlineWeights

    return {"transform": lambda: OnlineTransform(Transform()), "weights": lambda: OnlineWeights(LearnableWeights(2)), "attention": lambda: OnlineAttention(AttentionWeights(2, 3))}


@pytest.mark.parametrize("kind", ["transform", "weights", "attention"])
def test_each_key_learns_alone(spark, tmp_path, kind):
    from rankweave.streaming.online import online_by_key

    rng = np.random.default_rng(7)
    schema = "model_id string, event_time long, score double, probs array<double>, features array<double>, label double, extra string"
    batches = []
    for _ in range(2):
        keys = rng.choice(["hot", "b", "c"], 45, p=[0.7, 0.2, 0.1])
        rows = [(str(k), int(rng.integers(0, 6)), float(rng.normal()), [float(x) for x in rng.uniform(0.05, 0.95, 2)], [float(x) for x in rng.normal(size=3)], float(rng.integers(0, 2)), "x") for k in keys]
        batches.append(rows + rows[:3] + [("b", 2, None, None, None, 1.0, None), (None, 2, 0.1, [0.5, 0.5], [0.0] * 3, 1.0, None), ("d", 1, 0.3, [0.4, 0.6], [1.0] * 3, None, None)])
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    want = {}
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).repartition(2).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        path = str(tmp_path / f"out{i}")
        _drain(online_by_key(stream, _learners()[kind]()), path, checkpoint)  # each run starts again from the checkpoint
        got = {r.model_id: r for r in spark.read.parquet(path).collect()}
        for k in ("hot", "b", "c"):
            one = want.setdefault(k, _learners()[kind]())
            one.batch(spark.createDataFrame([r for r in rows if r[0] == k and r[2] is not None], schema), i)
            for column, value in one.state().items():
                assert np.allclose(got[k][column], value, rtol=1e-12, atol=0), (k, column)
        assert set(got) == {"hot", "b", "c"}
