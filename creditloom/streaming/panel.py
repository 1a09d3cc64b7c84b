"""The account-month panel from a stream: months wait until the watermark tells that none can come before or between them.

A month of an account is final once its successor is known and nothing can come between the two: it then has its previous
and next state and the balance at its end, whatever order months came in. A month without a successor is final when the
account has been silent for so long; it ends the account as the last row of a batch does. State per account: the months not
yet final, and the last final one's state. Event-time timers, one a month held, wake an account; so silent accounts cost
nothing, and an account whose months are all final holds one small value until it has been silent.

Months that come after the watermark has passed them are dropped, as by any stateful operator of a stream; the watermark's
delay says how late a month may be.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from creditloom.config import Settings
from creditloom.functions import columns as C
from creditloom.operators import macro as M

PROVIDER, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EPOCH = dt.date(1970, 1, 1)


def _ms(day: dt.date) -> int:
    return (day - _EPOCH).days * 86_400_000


def _next_month(day: dt.date) -> dt.date:
    return dt.date(day.year + day.month // 12, day.month % 12 + 1, 1)


class Months(StatefulProcessor):
    """Turns an account's months (month, state, upb, exit, censors, and the other columns of the schema) into final ones."""

    def __init__(self, schema: T.StructType, silence_days: int) -> None:
        self.schema, self.silence = schema, silence_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.schema)
        self.before = handle.getValueState("before", "month date, state string")

    def handleInputRows(self, key: tuple, rows: Iterable[Row], timerValues: TimerValues) -> Iterator[Row]:
        new = [tuple(r[name] for name in self.schema.names) for r in rows]
        self.held.appendList(new)
        for month in {r[0] for r in new}:
            self.handle.registerTimer(_ms(month))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        return iter(self.final(key[0], timerValues.getCurrentWatermarkInMs()))

    def final(self, loan, watermark: int) -> list[Row]:
        rows = sorted((Row(*self.schema.names)(*r) for r in self.held.get()), key=lambda r: (r.month, r.state))
        previous = self.before.get()[1] if self.before.exists() else None
        made, out, done = Row("loan_id", *self.schema.names, "previous", "next", "end", "eom"), [], 0
        for k, row in enumerate(rows):
            if _ms(row.month) > watermark:
                break
            follows = rows[k + 1] if k + 1 < len(rows) else None
            if follows is None:
                if row.exit is None and _ms(row.month) + self.silence > watermark:
                    break
            elif _ms(follows.month) > watermark and follows.month != _next_month(row.month):
                break
            end = row.exit or ("Censored" if follows is None and row.censors else None)
            eom = 0 if row.exit else None if end else follows.upb if follows else None
            out.append(made(loan, *row, previous, follows.state if follows and end is None else None, end, None if eom is None else type(row.upb)(eom)))
            previous, done = row.state, k + 1
        if done:
            left = rows[done:]
            self.held.clear()
            if left:
                self.held.put([tuple(r) for r in left])
            self.before.update((rows[done - 1].month, previous))
        if rows:
            # The last month may be the account's last; or, where all are final, what is kept of them goes then.
            self.handle.registerTimer(max(_ms(rows[-1].month) + self.silence, watermark + 1))
        elif self.before.exists() and _ms(self.before.get()[0]) + self.silence <= watermark:
            self.before.clear()
        return out


def final_months(rows: DataFrame, s: Settings, late: str = "95 days", silence_days: int = 400) -> DataFrame:
    """Rows (loan_id, as_of_month, loan_age, upb_bom, proceeds and costs, states, exit_reason, upb_eom) of a stream of performance rows.

    late: how much later than the latest month of all accounts a month may come. Accounts whose last month is silence_days
    behind the watermark end there, censored where they have no code.
    """
    rows.sparkSession.conf.set(PROVIDER, ROCKSDB)  # the state store that timers and lists need
    mapped = C.lookup("zero_balance_code", s.codes)
    exit_ = F.when(mapped.isNotNull(), mapped).when(F.col("delinquency_status") >= s.dpd_floors["ChargeOff"], F.lit("ChargeOff"))
    timed = rows.withColumn("event_time", F.col("as_of_month").cast("timestamp")).withWatermark("event_time", late)
    timed = timed.select(
        "loan_id", "event_time", F.col("as_of_month").alias("month"), C.delinquency_state("zero_balance_code", "delinquency_status", s).alias("state"), F.col("current_upb").alias("upb"), exit_.alias("exit"),
        (C.is_blank("zero_balance_code") & F.col("disposition_date").isNull()).alias("censors"), "loan_age", "net_sales_proceeds", "foreclosure_costs",
    )
    kept = T.StructType([T.StructField(f.name, f.dataType) for f in timed.schema if f.name not in ("loan_id", "event_time")])
    found = T.StructType([T.StructField("loan_id", timed.schema["loan_id"].dataType), *kept, *[T.StructField(n, T.StringType()) for n in ("previous", "next", "end")], T.StructField("eom", kept["upb"].dataType)])
    final = timed.groupBy("loan_id").transformWithState(Months(kept, silence_days), found, "append", "eventTime")
    return final.select(
        "loan_id", F.col("month").alias("as_of_month"), "loan_age", F.col("state").alias("delinquency_state"), F.col("previous").alias("previous_delinquency_state"), F.col("next").alias("next_delinquency_state"),
        F.col("upb").alias("upb_bom"), F.col("eom").alias("upb_eom"), "net_sales_proceeds", "foreclosure_costs", F.col("end").alias("exit_reason"),
    )


def append(rows: DataFrame, acquisition: DataFrame, macro: DataFrame, s: Settings, late: str = "95 days", silence_days: int = 400) -> DataFrame:
    """The panel's rows, as panel.public(panel.build()) has them, from a stream of performance rows and tables of loans and macro months."""
    loans = acquisition.select("loan_id", "origination_month", "orig_score", "orig_ltv", "property_state", "vintage_year")
    joined = final_months(rows, s, late, silence_days).join(loans, "loan_id").withColumn("months_on_book", C.months_apart("as_of_month", "origination_month"))
    shaped = joined.select(
        "loan_id", "as_of_month", F.date_format("origination_month", "yyyy-MM").alias("vintage"), "vintage_year", "months_on_book", F.col("loan_age").alias("vendor_loan_age"), C.mob_band("months_on_book", s).alias("mob_band"),
        "delinquency_state", "previous_delinquency_state", "next_delinquency_state", "upb_bom", "upb_eom", "orig_score", C.score_band("orig_score", s).alias("score_band"), "orig_ltv", "property_state",
        "net_sales_proceeds", "foreclosure_costs", "exit_reason", F.coalesce(F.col("exit_reason") == "Censored", F.lit(False)).alias("is_censored"),
    )
    return M.join(shaped, macro)
