"""A synthetic portfolio for tests, as a Spark source: loans are drawn per loan number, so more loans keep the first ones as they were."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from creditloom.config import Settings


def macro_series(s: Settings, months: int | None = None) -> pd.DataFrame:
    """Monthly unemployment, its three-month change and house-price growth: a slow cycle with two recessions."""
    months = months or (s.last_vintage - s.first_vintage + 1) * 12 + s.max_months + 12
    rng = np.random.default_rng(s.seed)
    u, h = [s.long_run_unemployment], []
    for t in range(months + 3):
        shock = 0.35 if 96 <= t % 220 < 112 else 0.15 if 10 <= t % 220 < 20 else 0.0
        u.append(np.clip(u[-1] + 0.03 * (s.long_run_unemployment - u[-1]) + shock + rng.normal(0, 0.06), 3.0, 12.0))
    u = np.array(u[1:])
    for t in range(months + 3):
        h.append(0.035 - 0.018 * (u[t] - s.long_run_unemployment) + rng.normal(0, 0.004))
    start = np.datetime64(f"{s.first_vintage}-01")
    return pd.DataFrame({"as_of_month": (start + np.arange(months)).astype("datetime64[D]").astype(object), "unemployment_rate": u[3:], "unemployment_change_3m": u[3:] - u[:-3], "hpi_change_yoy": np.array(h[3:])})


COLUMNS = (
    "loan_id string, origination_month date, original_upb double, original_term int, orig_interest_rate double, orig_score int, orig_ltv double, property_state string, as_of_month date, current_upb double, delinquency_status int, "
    "loan_age int, remaining_months int, zero_balance_code string, zero_balance_date date, modification_flag string, foreclosure_date date, disposition_date date, net_sales_proceeds double, foreclosure_costs double"
)
NAMES = [x.split()[0] for x in COLUMNS.split(", ")]
LOANS_PER_TASK, LOANS_PER_BATCH = 2_000, 200


def loan_months(number: int, s: Settings, macro: dict[str, np.ndarray]) -> list[tuple]:
    """One loan's months, max_months at most, from the seed and its number alone."""
    states = [x for x in s.states if x not in s.absorbing]
    u, du, h = (macro[c] for c in ("unemployment_rate", "unemployment_change_3m", "hpi_change_yoy"))
    origin = np.datetime64(f"{s.first_vintage}-01")
    rng = np.random.default_rng([s.seed, number])
    start = number % (s.last_vintage - s.first_vintage + 1) * 12 + int(rng.integers(12))
    score = int(np.clip(rng.normal(720, 55), 500, 850))
    ltv = float(np.clip(rng.normal(78, 10), 40, 97))
    term, rate, upb = int(rng.choice([180, 240, 360])), float(np.round(rng.uniform(0.03, 0.07), 4)), float(np.round(rng.uniform(80_000, 400_000), 2))
    loan = (f"L{number:09d}", (origin + start).astype("datetime64[D]").astype(object), upb, term, rate, score, ltv, ["TX", "CA", "FL", "NY"][number % 4])
    risk = np.clip((700 - score) / 100, -0.8, 1.8)
    buyback = int(rng.integers(1, 25)) if rng.random() < 0.0075 else None
    state, rows = 0, []
    for age in range(s.max_months):
        month, left = start + age, max(term - age, 0)
        balance = upb * ((1 + rate / 12) ** term - (1 + rate / 12) ** min(age, term)) / ((1 + rate / 12) ** term - 1)
        code = proceeds = costs = done = None
        if age:
            excess = max(u[month] - s.unemployment_hinge, 0)
            worse = 0.006 * np.exp(0.9 * risk + 0.28 * excess + 0.3 * du[month] - 3 * h[month]) if state == 0 else 0.38 + 0.04 * min(excess, 4)
            better = 0.0 if state == 0 else 0.35 - 0.03 * state
            x = rng.random()
            if x < worse:
                state += 1
            elif x > 1 - better:
                state -= 1
            elif state == 0 and rng.random() < 0.012 * np.exp(-0.15 * excess):
                code = "01"
        if buyback == age:
            code = "06"
        if state == len(states):
            code, state = "03", len(states) - 1
            share = float(np.clip(0.72 + 0.6 * h[month] - 0.004 * (ltv - 78) + rng.normal(0, 0.05), 0, 1))
            proceeds, costs, done = balance * (share + 0.05), balance * 0.05, True
        day = (origin + month).astype("datetime64[D]").astype(object)
        rows.append((*loan, day, balance, 30 * state, age, left, code, day if code else None, "N", None, day if done else None, proceeds, costs))
        if code:
            break
    return rows


@dataclass
class Loans(InputPartition):
    """So many loans of one vintage from a number on, every step of them."""

    first: int
    count: int
    step: int


class PortfolioReader(DataSourceReader):
    def __init__(self, s: Settings, schema: StructType | None = None) -> None:
        self.settings, self.schema = s, schema

    def partitions(self) -> list[Loans]:
        """Loans of a vintage are the numbers a vintage apart; a vintage of many loans is several partitions."""
        s = self.settings
        spread = s.last_vintage - s.first_vintage + 1
        parts = []
        for v in range(min(spread, s.loans)):
            of_vintage = -(-(s.loans - v) // spread)
            parts += [Loans(v + k * spread, min(LOANS_PER_TASK, of_vintage - k), spread) for k in range(0, of_vintage, LOANS_PER_TASK)]
        return parts

    def read(self, partition: Loans) -> Iterator[pa.RecordBatch]:
        s = self.settings
        macro = {c: x.to_numpy() for c, x in macro_series(s).items() if c != "as_of_month"}
        schema = to_arrow_schema(self.schema)
        for k in range(0, partition.count, LOANS_PER_BATCH):
            numbers = (partition.first + i * partition.step for i in range(k, min(k + LOANS_PER_BATCH, partition.count)))
            rows = [row for number in numbers for row in loan_months(number, s, macro)]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class PortfolioSource(DataSource):
    """spark.read.format("synthetic_portfolio"): account months of drawn loans; options are settings, as text."""

    @classmethod
    def name(cls) -> str:
        return "synthetic_portfolio"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: StructType) -> PortfolioReader:
        return PortfolioReader(from_options(dict(self.options)), schema)


OPTIONS = ("seed", "loans", "first_vintage", "last_vintage", "max_months", "unemployment_hinge", "long_run_unemployment")


def from_options(options: dict[str, str]) -> Settings:
    """Settings of a source's options (whose names come in any case); an unknown one is an error."""
    lower = {k.lower(): v for k, v in options.items() if k.lower() != "path"}
    if unknown := set(lower) - set(OPTIONS):
        raise ValueError(f"unknown options: {sorted(unknown)}")
    default = Settings()
    return dataclasses.replace(default, **{k: type(getattr(default, k))(v) for k, v in lower.items()}).validate()


def portfolio(spark: SparkSession, s: Settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(acquisition, performance, macro), by the source."""
    spark.dataSource.register(PortfolioSource)
    rows = spark.read.format("synthetic_portfolio").options(**{k: str(getattr(s, k)) for k in OPTIONS}).load()
    loans = rows.where("loan_age = 0").select(*NAMES[:8], F.lit("P").alias("occupancy_status"), F.lit("R").alias("channel"), F.year("origination_month").alias("vintage_year"))
    return loans, rows.select("loan_id", *NAMES[8:]), spark.createDataFrame(macro_series(s), "as_of_month date, unemployment_rate double, unemployment_change_3m double, hpi_change_yoy double")
