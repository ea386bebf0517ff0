"""The outcome of a query: its rows up to an answer cap, and a named terminal state."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Literal

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row

#: Largest answer cap.
MOST = 100_000


@dataclass(frozen=True)
class Outcome:
    """answers, failure (no row), limit (there are more rows than the cap) or error, with the rows that came before it."""

    kind: Literal["answers", "failure", "limit", "error"]
    rows: list[Row] = field(default_factory=list)
    limit: str | None = None
    error: str | None = None


def run(df: DataFrame, answer_cap: int = 50) -> Outcome:
    """Take at most answer_cap rows of df. The cap bounds what reaches the driver; one row more tells a limit from an end."""
    if not 0 < answer_cap <= MOST:
        raise ValueError(f"answer cap out of range: {answer_cap}")
    try:
        rows = df.limit(answer_cap + 1).collect()
    except PySparkException as e:
        return Outcome("error", error=e.getCondition() or type(e).__name__)
    if len(rows) > answer_cap:
        return Outcome("limit", rows[:answer_cap], limit="answer-cap")
    return Outcome("answers", rows) if rows else Outcome("failure")
