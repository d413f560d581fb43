"""Arrow functions with bound arguments, in the form that Spark wants."""

from collections.abc import Callable

import pyarrow as pa


def grouped(f: Callable, **bound) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        return f(table, **bound)

    return run


def cogrouped(f: Callable, **bound) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return f(left, right, **bound)

    return run
