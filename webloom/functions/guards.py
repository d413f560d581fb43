"""Guards for long-running functions: time and memory limits, error capture, retries.

In Spark a guard works per row inside the Python worker: ``guarded`` turns a function into one
that returns struct(value, error) and gives every row its own time budget, so one bad page
costs one row, not the job.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os
import signal
import threading
import time
from collections.abc import Callable, Iterable, Iterator
from enum import Enum

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ExecutionTimeout(BaseException):
    """The time is up; not an Exception, so that broad handlers don't swallow it."""


class MemoryLimitExceeded(BaseException):
    """More memory is in use than allowed."""


class InterruptType(Enum):
    exception = 0
    signal = 1
    exception_then_signal = 2


def _raise_in(thread: int, kind: type[BaseException]) -> None:
    ctypes.pythonapi.PyThreadState_SetAsyncExc(ctypes.c_ulong(thread), ctypes.py_object(kind))


def rss_kib(pid: int | None = None) -> int:
    """Resident memory of a process."""
    with open(f"/proc/{pid or os.getpid()}/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") // 1024


class _Guard:
    """Watches from a thread and interrupts the guarded one, harder each time its grace period passes."""

    kind: type[BaseException] = ExecutionTimeout

    def __init__(self, interrupt_type: InterruptType, send_kill: bool, grace: float, every: float):
        self.how, self.kill, self.grace, self.every = interrupt_type, send_kill, grace, every
        self.thread, self.stop, self.watcher, self.level = 0, threading.Event(), None, 0

    def due(self) -> bool:
        raise NotImplementedError

    def _watch(self) -> None:
        since = None
        while not self.stop.wait(self.every):
            if not self.due():
                since, self.level = None, 0
                continue
            if since is None or time.monotonic() - since >= self.grace:
                since = time.monotonic()
                self._interrupt()

    def _interrupt(self) -> None:
        level, self.level = self.level, self.level + 1
        by_signal = self.how is InterruptType.signal or (self.how is InterruptType.exception_then_signal and level > 0)
        if level >= 2 and by_signal:
            os.kill(os.getpid(), signal.SIGKILL if self.kill else signal.SIGTERM)
        elif by_signal:
            signal.pthread_kill(self.thread, signal.SIGINT)
        else:
            _raise_in(self.thread, self.kind)

    def __enter__(self):
        self.thread = threading.get_ident()
        self.stop.clear()
        self.watcher = threading.Thread(target=self._watch, daemon=True)
        self.watcher.start()
        return self

    def __exit__(self, *exc):
        self.stop.set()
        self.watcher.join()
        return False

    def __call__(self, f: Callable):
        @functools.wraps(f)
        def run(*args, **kwargs):
            with self:
                return f(*args, **kwargs)

        return run


class TimeGuard(_Guard):
    def __init__(self, timeout: float, grace: float, interrupt_type: InterruptType, send_kill: bool, every: float):
        super().__init__(interrupt_type, send_kill, grace, every)
        self.timeout, self.began = timeout, time.monotonic()

    def __enter__(self):
        self.progress()
        return super().__enter__()

    def progress(self) -> None:
        """The time starts anew."""
        self.began, self.level = time.monotonic(), 0

    def due(self) -> bool:
        return time.monotonic() - self.began >= self.timeout


class MemGuard(_Guard):
    kind = MemoryLimitExceeded

    def __init__(self, limit: int, absolute: bool, patience: float, grace: float, interrupt_type: InterruptType, send_kill: bool, every: float):
        super().__init__(interrupt_type, send_kill, grace, every)
        self.limit, self.absolute, self.patience, self.base, self.over = limit, absolute, patience, 0, None

    def __enter__(self):
        self.base, self.over = (0 if self.absolute else rss_kib()), None
        return super().__enter__()

    def due(self) -> bool:
        if rss_kib() - self.base <= self.limit:
            self.over = None
            return False
        self.over = self.over or time.monotonic()
        return time.monotonic() - self.over >= self.patience


def time_guard(timeout: float = 60, timeout_ms: int | None = None, grace_period: float = 15, interrupt_type: InterruptType = InterruptType.exception_then_signal, send_kill: bool = False, check_interval: int = 500) -> TimeGuard:
    """A context or decorator that interrupts what takes longer than ``timeout`` seconds."""
    seconds = timeout if timeout_ms is None else timeout_ms / 1000
    return TimeGuard(seconds, grace_period, interrupt_type, send_kill, min(check_interval / 1000, max(seconds / 4, 0.001)))


def mem_guard(max_memory: int, absolute: bool = True, grace_period: float = 0, secondary_grace_period: float = 5, interrupt_type: InterruptType = InterruptType.exception_then_signal, send_kill: bool = False, check_interval: int = 500) -> MemGuard:
    """A context or decorator that interrupts what holds more than ``max_memory`` KiB, in all or beyond what there was at its start."""
    return MemGuard(max_memory, absolute, grace_period, secondary_grace_period, interrupt_type, send_kill, check_interval / 1000)


def progress(guard: TimeGuard) -> None:
    guard.progress()


def progress_loop(items: Iterable, guard: TimeGuard) -> Iterator:
    """The items; the guard's time starts anew with each."""
    for x in items:
        guard.progress()
        yield x


def exc_loop(items: Iterable) -> Iterator[tuple[object, BaseException | None]]:
    """(item, None), or (None, error) where getting an item raised; generators end with their error."""
    it = iter(items)
    while True:
        try:
            yield next(it), None
        except StopIteration:
            return
        except Exception as e:  # noqa: BLE001 - reporting errors is the purpose
            yield None, e


def retrying(open_at: Callable[[int], Iterator], position: Callable[[object], int], retry_count: int = 3, start: int = 0) -> Iterator:
    """Items of a stream that is opened again at the last item's position when reading fails.

    Items that were given aren't repeated, also where several share a position.
    """
    last, seen, failures, it, skip = start, 0, 0, None, 0
    while True:
        try:
            if it is None:
                it, skip = open_at(last), seen
            item = next(it)
            at = position(item)
            if skip and at == last:
                skip -= 1
                continue
        except StopIteration:
            return
        except Exception:  # noqa: BLE001 - any read error counts
            failures += 1
            if failures > retry_count:
                raise
            it = None
            continue
        failures, skip = 0, 0
        last, seen = at, seen + 1 if at == last else 1
        yield item


def guarded(f: Callable, value_type: str | T.DataType, timeout: float | None = None, max_memory: int | None = None) -> Callable[..., Column]:
    """A column function from a plain one: struct(value, error), with limits of seconds and KiB of growth for each row."""
    kind = T._parse_datatype_string(value_type) if isinstance(value_type, str) else value_type
    result = T.StructType([T.StructField("value", kind), T.StructField("error", T.StringType())])

    def one(args: tuple) -> dict:
        try:
            with contextlib.ExitStack() as limits:
                if timeout is not None:
                    limits.enter_context(time_guard(timeout, interrupt_type=InterruptType.exception, check_interval=50))
                if max_memory is not None:
                    limits.enter_context(mem_guard(max_memory, absolute=False, interrupt_type=InterruptType.exception, check_interval=50))
                return {"value": f(*args), "error": None}
        except (Exception, ExecutionTimeout, MemoryLimitExceeded) as e:  # noqa: BLE001
            return {"value": None, "error": f"{type(e).__name__}: {e}".rstrip(": ")}

    @F.arrow_udf(result)
    def run(*cols: pa.Array) -> pa.Array:
        from pyspark.sql.pandas.types import to_arrow_type

        return pa.array([one(args) for args in zip(*(c.to_pylist() for c in cols), strict=True)], to_arrow_type(result))

    return run
