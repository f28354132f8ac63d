"""A task has one Python worker, as each that was started stays and holds memory."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from turnmill.llm import jaccard


def test_counted_weights_need_one_worker_a_task(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [(i, " ".join(f"w{k}" for k in rng.integers(0, 1000, 40)), 0) for i in range(30)]
    plans = []
    real = type(spark.range(0)).toArrow
    monkeypatch.setattr(type(spark.range(0)), "toArrow", lambda self: plans.append(self._jdf.queryExecution().sparkPlan().toString()) or real(self))
    join = jaccard.Join(spark.createDataFrame(texts, "doc_id long, text string, x int"))
    made = join.keep(join.texts.mapInArrow(jaccard._names, jaccard.NAMES))
    total = made.agg(F.sum("n")).first()[0]
    table, shift = join.weights(made, total).value
    (plan,) = plans
    # Between two exchanges runs one Python node.
    nodes = [x.strip(" +-:*()0123456789").split()[0] for x in plan.splitlines()]
    kinds = [x for x in nodes if x in ("Exchange", "MapInArrow")]
    assert kinds.count("MapInArrow") == 2 and kinds[:4] == ["MapInArrow", "Exchange", "MapInArrow", "Exchange"], plan
    # Each slot's weight is its number of different sets with a shingle there, from plain counts.
    sets = {}
    for own in jaccard.shingle_sets(pa.array([t for _, t, _ in texts])):
        sets[jaccard.digest(own)] = own
    want = np.bincount((np.concatenate(list(sets.values())) >> np.uint64(shift)).astype(np.int64), minlength=len(table))
    assert want.max() < 16 and (table == want).all()
