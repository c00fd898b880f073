"""Arrow column functions whose SQL type is given as text, made when they are first called (a session must exist then)."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow_udf(returns: str) -> Callable[[Callable], Callable[..., Column]]:
    def lift(function: Callable) -> Callable[..., Column]:
        @wraps(function)
        def call(*columns: Column | str) -> Column:
            return F.pandas_udf(function, returns)(*columns)

        return call

    return lift
