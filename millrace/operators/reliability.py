"""Retries and errors: delays and predicates as columns, and a driver-side wrapper for actions."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column
from pyspark.sql import functions as F

R = TypeVar("R")
MOST_ATTEMPTS = 100


def delay_ms(attempt: Column, backoff: str = "exponential", initial: int = 100, multiplier: float = 2.0, most: int = 60_000) -> Column:
    """The wait after attempt 0, 1, ..."""
    if backoff == "fixed":
        return F.least(F.lit(initial), F.lit(most)).cast("long")
    return F.least(initial * F.pow(F.lit(multiplier), attempt), F.lit(float(most))).cast("long")


def retryable(kind: Column, recoverable: Column, on_timeout: bool = True) -> Column:
    """Recoverable failures, adapter errors, and timeouts unless switched off."""
    return F.coalesce((kind == "failed") & recoverable | (kind == "adapter") | ((kind == "timeout") & F.lit(on_timeout)), F.lit(False))


def retry_status(status: Column, listed: list[int], server_errors: bool = True) -> Column:
    """Whether an HTTP status is to be tried again."""
    hit = status.isin(*listed) if listed else F.lit(False)
    return hit | status.between(500, 599) if server_errors else hit


def caught(value: Column, source: Column, message: str, error_type: str = "failed", recoverable: bool = True) -> dict[str, Column]:
    """Columns for a fallible value (a try_ expression of source): the value, and what is known of its failure. A null source is no failure."""
    failed = value.isNull() & source.isNotNull()
    say = lambda x: F.when(failed, F.lit(x))
    return {"value": value, "_caught_error": failed, "error": say(message), "error_type": say(error_type), "recoverable": say(recoverable)}


def fallback(primary: Column, *others: Column) -> Column:
    """The first of several fallible values that came out."""
    return F.coalesce(primary, *others)


def on_failure(action: Callable[[], R], hook: Callable[[Exception], None]) -> R:
    """Runs a Spark action; if it fails, the hook (a second plan) runs with the error, which is then raised."""
    try:
        return action()
    except Exception as e:
        hook(e)
        raise


def with_retry(action: Callable[[], R], attempts: int = 3, wait_ms: Callable[[int], int] = lambda n: min(100 * 2**n, 60_000), retry_on: tuple = (Exception,)) -> R:
    """Runs a Spark action up to so many times (100 at most)."""
    attempts = min(max(attempts, 1), MOST_ATTEMPTS)
    for n in range(attempts):
        try:
            return action()
        except retry_on:
            if n + 1 == attempts:
                raise
            time.sleep(wait_ms(n) / 1000)
    raise AssertionError
