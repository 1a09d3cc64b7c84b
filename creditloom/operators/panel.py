"""The account-month panel: states, exits, neighbours in time, macro values; its integrity and its counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from creditloom.config import Settings
from creditloom.functions import columns as C
from creditloom.operators import macro as M


class PanelError(RuntimeError):
    pass


CHECKS = ("_vendor_mob_mismatch", "_unknown_zero_balance_code", "_gap", "_terminal_not_last", "_terminals", "_duplicate_key", "_last")


def build(acquisition: DataFrame, performance: DataFrame, macro: DataFrame, s: Settings, carried: tuple[str, ...] = ()) -> DataFrame:
    """One row an account and month, with the columns to be carried over from the acquisition.

    current_upb is the balance at the month's begin and the state that at its end. One sort by loan and month serves
    all windows: the last row is the one without a next, and a repeated month equals its neighbour. The windows come
    before the join, as rows that lie by loan and month already (layout.colocated) then need no shuffle and no sort.
    """
    order = Window.partitionBy("loan_id").orderBy("as_of_month")
    mapped = C.lookup("zero_balance_code", s.codes)
    rows = performance.drop("vintage_year").select(
        "*",
        C.delinquency_state("zero_balance_code", "delinquency_status", s).alias("delinquency_state"),
        F.lead("as_of_month").over(order).isNull().alias("_last"),
        F.lag("as_of_month").over(order).alias("_previous_month"),
        F.lead("current_upb").over(order).alias("_next_upb"),
    )
    exit_ = (
        F.when(mapped.isNotNull(), mapped)
        .when(F.col("delinquency_status") >= s.dpd_floors["ChargeOff"], F.lit("ChargeOff"))
        .when(F.col("_last") & C.is_blank("zero_balance_code") & F.col("disposition_date").isNull(), F.lit("Censored"))
    )
    rows = rows.withColumn("exit_reason", exit_)
    whole = Window.partitionBy("loan_id")
    rows = rows.select(
        "*",
        F.lag("delinquency_state").over(order).alias("previous_delinquency_state"),
        F.when(F.col("exit_reason").isNull(), F.lead("delinquency_state").over(order)).alias("next_delinquency_state"),
        F.count("exit_reason").over(whole).alias("_terminals"),
    )
    loans = acquisition.select("loan_id", "origination_month", F.date_format("origination_month", "yyyy-MM").alias("_vintage"), "orig_score", "orig_ltv", "property_state", "vintage_year", *carried)
    rows = rows.join(loans, "loan_id").withColumn("months_on_book", C.months_apart("as_of_month", "origination_month"))
    rows = rows.select(
        "loan_id", "as_of_month", F.col("_vintage").alias("vintage"), "vintage_year", "months_on_book", F.col("loan_age").alias("vendor_loan_age"),
        C.mob_band("months_on_book", s).alias("mob_band"), "delinquency_state", "previous_delinquency_state", "next_delinquency_state", F.col("current_upb").alias("upb_bom"),
        F.when(F.col("exit_reason").isin(*s.absorbing), F.lit(0).cast(rows.schema["current_upb"].dataType)).when(F.col("exit_reason").isNull(), F.col("_next_upb")).alias("upb_eom"),
        "orig_score", C.score_band("orig_score", s).alias("score_band"), "orig_ltv", "property_state", "net_sales_proceeds", "foreclosure_costs", "exit_reason",
        F.coalesce(F.col("exit_reason") == "Censored", F.lit(False)).alias("is_censored"),
        (~F.col("loan_age").eqNullSafe(F.col("months_on_book"))).alias("_vendor_mob_mismatch"),
        (~C.is_blank("zero_balance_code") & C.lookup("zero_balance_code", s.codes).isNull()).alias("_unknown_zero_balance_code"),
        F.coalesce(F.months_between("as_of_month", "_previous_month") != 1, F.lit(False)).alias("_gap"),
        F.coalesce(F.col("as_of_month") == F.col("_previous_month"), F.lit(False)).alias("_duplicate_key"),
        (F.col("exit_reason").isNotNull() & ~F.col("_last")).alias("_terminal_not_last"), "_terminals", "_last", *carried,
    )
    return M.join(rows, macro)


def public(panel: DataFrame) -> DataFrame:
    return panel.drop(*CHECKS)


def counts(s: Settings) -> list[Column]:
    """Aggregates for the gate, all from one pass."""
    live = F.col("exit_reason").isNull()
    known = F.col("delinquency_state").isin(*s.states)
    return [
        F.count("*").alias("row_count"),
        F.count_if(F.col("_gap")).alias("gap_rows"),
        F.count_if(F.col("_duplicate_key")).alias("duplicate_rows"),
        F.count_if(F.col("_last") & (F.col("_terminals") != 1)).alias("loans_without_one_terminal"),
        F.count_if(F.col("_terminal_not_last")).alias("terminal_not_last_rows"),
        F.count_if(F.col("_unknown_zero_balance_code")).alias("unknown_code_rows"),
        F.count_if(F.col("mob_band").isNull()).alias("unbanded_mob_rows"),
        F.count_if(F.col("score_band").isNull()).alias("unbanded_score_rows"),
        F.count_if(~F.coalesce(known, F.lit(False))).alias("unknown_state_rows"),
        F.count_if(F.col("is_censored").isNull()).alias("null_censor_rows"),
        F.count_if(live & F.col("next_delinquency_state").isNull()).alias("missing_next_state_rows"),
        F.count_if(~live & F.col("next_delinquency_state").isNotNull()).alias("terminal_next_state_rows"),
        F.count_if(F.col("exit_reason").isin(*s.absorbing) & (F.col("upb_eom") != 0)).alias("exit_balance_rows"),
        F.count_if(F.col("is_censored") & F.col("upb_eom").isNotNull()).alias("censored_balance_rows"),
        F.count_if(F.greatest(*[F.col(c).isNull() for c in M.VALUES])).alias("missing_macro_rows"),
        F.count_if(F.col("_vendor_mob_mismatch")).alias("vendor_mob_mismatch_rows"),
    ]


def exits(s: Settings) -> dict[str, Column]:
    """Aggregates for the loans of each exit."""
    return {x: F.count_if(F.col("exit_reason") == x) for x in (*s.absorbing, "Censored")}


def integrity(panel: DataFrame, s: Settings) -> DataFrame:
    """One row of counts from one pass."""
    return panel.agg(*counts(s))


def enforce(panel: DataFrame, s: Settings) -> dict[str, int]:
    """enforce_counts() of a pass over the panel."""
    return enforce_counts(integrity(panel, s).first().asDict(), s)


def enforce_counts(row: dict[str, int], s: Settings) -> dict[str, int]:
    """The integrity counts; raises PanelError for any violation, and for vendor ages off in more rows than a rule may fail."""
    bad = {k: v for k, v in row.items() if k not in ("row_count", "vendor_mob_mismatch_rows") and v}
    if row["vendor_mob_mismatch_rows"] > s.max_rate_per_reason * row["row_count"]:
        bad["vendor_mob_mismatch_rows"] = row["vendor_mob_mismatch_rows"]
    if bad:
        raise PanelError(f"panel violations: {bad}")
    return row


def state_by_band(panel: DataFrame) -> DataFrame:
    return panel.groupBy("mob_band", "delinquency_state").agg(F.count("*").alias("rows"))


def exit_counts(panel: DataFrame, s: Settings) -> DataFrame:
    """Loans by exit, with 0 for exits that do not occur."""
    kinds = panel.sparkSession.createDataFrame([(x,) for x in (*s.absorbing, "Censored")], "exit_reason string")
    counts = panel.where("exit_reason is not null").groupBy("exit_reason").agg(F.count("*").alias("n"))
    return kinds.join(counts, "exit_reason", "left").select("exit_reason", F.coalesce("n", F.lit(0)).alias("loans"))


def reconcile(panel: DataFrame, expected: DataFrame, *columns: str) -> DataFrame:
    """One row: rows of both, rows in one alone, and rows that differ in a column, by loan and month; nulls equal nulls."""
    keys = ["loan_id", "as_of_month"]
    a, b = (df.select(*keys, *[F.col(c).alias(f"{c}_{side}") for c in columns], F.lit(True).alias(side)) for df, side in ((panel, "in_panel"), (expected, "in_expected")))
    both = a.join(b, keys, "full")
    same = C.all_of([F.col(f"{c}_in_panel").eqNullSafe(F.col(f"{c}_in_expected")) for c in columns])
    here, there = F.col("in_panel").isNotNull(), F.col("in_expected").isNotNull()
    return both.agg(F.count_if(here).alias("panel_rows"), F.count_if(there).alias("expected_rows"), F.count_if(here & ~there).alias("only_in_panel"), F.count_if(there & ~here).alias("only_in_expected"), F.count_if(here & there & ~same).alias("differing_rows"))


def enforce_reconciled(table: DataFrame) -> None:
    row = table.first()
    if row.only_in_panel or row.only_in_expected or row.differing_rows:
        raise PanelError(f"the panel does not reconcile: {row.asDict()}")
