import time

import pytest

from webloom.functions.guards import ExecutionTimeout, InterruptType, MemoryLimitExceeded, exc_loop, guarded, mem_guard, progress, progress_loop, retrying, time_guard


def spin(seconds):
    end = time.monotonic() + seconds
    while time.monotonic() < end:
        sum(range(100))
    return "done"


def test_time_guard():
    with pytest.raises(ExecutionTimeout), time_guard(timeout_ms=100, interrupt_type=InterruptType.exception, check_interval=20):
        spin(5)
    assert time_guard(timeout=5)(spin)(0.05) == "done"
    guard = time_guard(timeout_ms=300, interrupt_type=InterruptType.exception, check_interval=20)
    with guard:
        for _ in range(5):
            spin(0.1)
            progress(guard)
        assert list(progress_loop(range(3), guard)) == [0, 1, 2]


def test_signal():
    with pytest.raises(KeyboardInterrupt), time_guard(timeout_ms=100, interrupt_type=InterruptType.signal, check_interval=20):
        spin(5)


def test_mem_guard():
    with pytest.raises(MemoryLimitExceeded), mem_guard(20_000, absolute=False, interrupt_type=InterruptType.exception, check_interval=20):
        keep = [bytes(1) * 1_000_000 for _ in range(100)]
        spin(5)
        assert keep


def test_exc_loop():
    class Failing:
        def __init__(self):
            self.n = -1

        def __iter__(self):
            return self

        def __next__(self):
            self.n += 1
            if self.n >= 10:
                raise StopIteration
            if self.n in (0, 3, 4, 8, 9):
                raise OSError(self.n)
            return self.n

    got = list(exc_loop(Failing()))
    assert [x for x, e in got if e is None] == [1, 2, 5, 6, 7] and sum(e is not None for _, e in got) == 5


def test_retrying():
    fails = {2: 2, 5: 1}

    def open_at(pos):
        for i in range(pos, 8):
            if fails.get(i, 0) > 0:
                fails[i] -= 1
                raise OSError(i)
            yield i

    assert list(retrying(open_at, lambda x: x)) == list(range(8))
    fails.update({3: 9})
    with pytest.raises(OSError):
        list(retrying(open_at, lambda x: x))


def test_guarded_column(spark):
    def slow(x):
        if x == 1:
            raise ValueError("one")
        return spin(3) if x == 2 else str(x)

    got = spark.createDataFrame([(0,), (1,), (2,)], "x int").coalesce(1).select(guarded(slow, "string", timeout=0.3)("x").alias("r")).collect()
    assert [(r.r.value, r.r.error) for r in got] == [("0", None), (None, "ValueError: one"), (None, "ExecutionTimeout")]


def test_slow_rows_are_dealt_out(spark):
    from pyspark.sql import functions as F

    from webloom.plans import details
    from webloom.session import dealt

    cores = spark.sparkContext.defaultParallelism
    assert details.guard_limits(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 8 * cores
    slow = dealt(spark.range(0, 400_000, 1, 3), "id").where("id % 100 = 7").groupBy(F.spark_partition_id()).count().collect()
    assert len(slow) == 8 * cores and max(r["count"] for r in slow) < 1.5 * 4000 / len(slow)
