"""Transitions from a stream of account months: each account's last state is kept until it exits or falls silent."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from creditloom.config import Settings
from creditloom.functions import columns as C


def transitions(rows: DataFrame, s: Settings, silence: str = "400 days") -> DataFrame:
    """(loan_id, as_of_month, delinquency_state, next_delinquency_state) of a stream (loan_id, as_of_month, zero_balance_code, delinquency_status).

    Prompt: a move is there as soon as its second month is. A month that comes before one already seen is left out; months
    in any order are what streaming.panel is for.
    """
    states = rows.withColumn("event_time", F.col("as_of_month").cast("timestamp")).withWatermark("event_time", silence)
    states = states.select("loan_id", "as_of_month", "event_time", C.delinquency_state("zero_balance_code", "delinquency_status", s).alias("state"))
    final = set(s.absorbing)

    def step(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        if kept.hasTimedOut:
            kept.remove()
            return
        last = kept.get if kept.exists else None
        out = []
        for row in pd.concat(batches).sort_values("as_of_month").itertuples():
            if last and str(row.as_of_month) <= last[0]:
                continue
            if last and last[1] not in final:
                out.append((key[0], pd.Timestamp(last[0]).date(), last[1], row.state))
            last = (str(row.as_of_month), row.state)
        if last and last[1] in final:
            if kept.exists:
                kept.remove()
        elif last:
            kept.update(last)
            kept.setTimeoutTimestamp(int(pd.Timestamp(last[0]).timestamp() * 1000) + 400 * 86_400_000)
        yield pd.DataFrame(out, columns=["loan_id", "as_of_month", "delinquency_state", "next_delinquency_state"])

    kind = rows.schema["loan_id"].dataType.simpleString()
    return states.groupBy("loan_id").applyInPandasWithState(
        step, f"loan_id {kind}, as_of_month date, delinquency_state string, next_delinquency_state string", "month string, state string", "append", GroupStateTimeout.EventTimeTimeout
    )


def monthly_states(rows: DataFrame, s: Settings, late: str = "40 days") -> DataFrame:
    """(month, state, n) of the same stream by calendar month, final once the watermark has passed the month's first day."""
    month = F.date_trunc("month", F.col("as_of_month").cast("timestamp"))
    timed = rows.withColumn("month", month).withWatermark("month", late)
    state = C.delinquency_state("zero_balance_code", "delinquency_status", s).alias("state")
    return timed.groupBy("month", state).agg(F.count("*").alias("n"))
