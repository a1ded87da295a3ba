"""Custom per-key state on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def running_balance(events: DataFrame, key: str, time: str, amount: str) -> DataFrame:
    """Per key the number of events and the sum of amounts so far, after each batch; state outlives batches."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for b in batches:
            n, total = n + len(b), total + float(b[amount].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [k[0]], "n_events": [n], "balance": [total]})

    kind = dict(events.dtypes)[key]
    return events.select(key, time, amount).groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, n_events long, balance double", "n long, total double", "update", GroupStateTimeout.NoTimeout
    )
