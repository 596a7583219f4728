"""Predicates on samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionscope.functions.scalars import instant, query_tokens, utc_day
from sessionscope.functions.stemmer import english_stem, stemmed
from sessionscope.schema import is_host_row, is_session, keys_of

# The sampler's own sessions and the server's background workers are left out.
# A null application name is left out too, by three-valued logic.
DEFAULT_REPORT_FILTER = (
    "application_name <> 'sampler' and backend_type <> 'autovacuum worker' and backend_type <> 'walsender'"
)


def window_scan(samples: DataFrame, start, end) -> DataFrame:
    """Samples with ``start <= dtcol <= end``.

    On a table with ``day`` (the UTC date) the days are bounded too, so only their folders
    are read; the bounds on ``dtcol`` reach the Parquet scan.
    """
    low, high = instant(start), instant(end)
    result = samples.filter(F.col("dtcol").between(low, high))
    if "day" in samples.columns:
        result = result.filter(F.col("day").between(utc_day(low), utc_day(high)))
    return result


def active_sessions(samples: DataFrame, own_pid: int | None = None) -> DataFrame:
    """Sessions running a query, except the sampler's own."""
    result = samples.filter("state = 'active' and pid is not null")
    return result if own_pid is None else result.filter(F.col("pid") != own_pid)


def pid_filter(samples: DataFrame, pids) -> DataFrame:
    """Samples of the given pids: a list, or a DataFrame with (dtcol, pid) or (pid)."""
    if isinstance(pids, DataFrame):
        keys = [name for name in keys_of(samples, "dtcol", "pid") if name in pids.columns]
        return samples.join(pids.select(keys), keys, "left_semi")
    return samples.filter(F.col("pid").isin(list(pids)))


def not_idle(samples: DataFrame) -> DataFrame:
    """Sessions of pids with a sample, at that instant, that is not in an idle kind of wait.

    A pid is one session at an instant, so the predicate is on the row itself.
    """
    waiting = F.coalesce("wait_event_type", F.lit(""))
    return samples.filter(F.col("pid").isNotNull() & ~waiting.isin("Activity", "Timeout"))


def report_filter(samples: DataFrame, predicate: str | Column = DEFAULT_REPORT_FILTER) -> DataFrame:
    """Session rows that satisfy the user's predicate."""
    return samples.filter(is_session()).filter(predicate)


def host_rows(samples: DataFrame) -> DataFrame:
    return samples.filter(is_host_row())


def session_rows(samples: DataFrame) -> DataFrame:
    return samples.filter(is_session())


def text_filter(
    samples: DataFrame, words: list[str], every: bool = True, tokens: str = "dquery", stem: bool = False
) -> DataFrame:
    """Samples whose query text has every (or any) of the words; in any form of the word if ``stem``.

    With ``stem`` a ``tokens`` column has to hold stems; without such a column they are made here.
    """
    wanted = [F.lit(word.lower()) for word in words]
    if stem:
        wanted = [english_stem(word) for word in wanted]
    columns = samples.columns
    if tokens not in columns and stem:
        samples = stemmed(samples, "query", query_tokens, tokens)
    found = F.col(tokens) if tokens in samples.columns else query_tokens(F.col("query"))
    if every:
        for word in wanted:
            samples = samples.filter(F.array_contains(found, word))
    else:
        samples = samples.filter(F.arrays_overlap(found, F.array(*wanted)))
    return samples.select(*columns)


def same_reset(samples: DataFrame, first: str = "first_reset", last: str = "last_reset") -> DataFrame:
    """Counter pairs whose statistics were not reset in between."""
    return samples.filter(F.col(first) == F.col(last))
