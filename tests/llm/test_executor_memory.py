"""Executors give free heap back between stages."""

from turnmill.llm import blocks


def test_tasks_collect_garbage(spark):
    beans = lambda: spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    ran = lambda: sum(b.getCollectionCount() for b in beans())
    before = ran()
    blocks.executors_collect(spark, 2)
    assert ran() > before


def test_stored_collects_now_and_then(spark, monkeypatch):
    called = []
    monkeypatch.setattr(blocks, "collect", lambda session: called.append(session))
    for _ in range(2 * blocks.COLLECT):
        blocks.drop(blocks.stored(spark, spark.range(1)))
    assert called == [spark] * 2
