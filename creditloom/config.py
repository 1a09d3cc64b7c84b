"""Settings: defaults, layered YAML files, ${NAME} from the environment, and validation."""

from __future__ import annotations

import dataclasses
import os
import re
from dataclasses import dataclass, field
from pathlib import Path

import yaml


class ConfigError(ValueError):
    pass


# The states, codes, edges and limits of the published model.
STATES = ("Current", "DPD30", "DPD60", "DPD90", "DPD120", "DPD150", "ChargeOff", "Prepaid", "Repurchased")
ABSORBING = ("ChargeOff", "Prepaid", "Repurchased")
DPD_FLOORS = {"DPD30": 30, "DPD60": 60, "DPD90": 90, "DPD120": 120, "DPD150": 150, "ChargeOff": 180}
CODES = {"01": "Prepaid", "02": "ChargeOff", "03": "ChargeOff", "06": "Repurchased", "09": "ChargeOff", "15": "ChargeOff", "16": "Prepaid"}
MOB_EDGES = (0, 12, 24, 36, 60, 120, 360)
SCORE_EDGES = (0, 620, 660, 700, 740, 780, 851)
FATAL = ("acquisition_missing_loan_id", "acquisition_duplicate_loan_id", "performance_missing_loan_id", "performance_duplicate_loan_month", "performance_orphan_loan_id")


@dataclass(frozen=True)
class Settings:
    env: str = "local"
    seed: int = 1729
    states: tuple[str, ...] = STATES
    absorbing: tuple[str, ...] = ABSORBING
    dpd_floors: dict[str, int] = field(default_factory=lambda: dict(DPD_FLOORS))
    codes: dict[str, str] = field(default_factory=lambda: dict(CODES))
    mob_edges: tuple[int, ...] = MOB_EDGES
    score_edges: tuple[int, ...] = SCORE_EDGES
    macro_lags: tuple[int, ...] = (1, 3, 6)
    discount_rate: float = 0.05
    fallback_lgd: float = 0.45
    cutoff: str = "2018-12-01"
    maturity_mob: int = 119
    cohort_grain: str = "quarterly"
    denominator: str = "original_balance"
    c: float = 10.0
    c_dpd150: float = 0.002
    fit_end: str | None = None
    backtest_fit_end: str = "2018-12-01"
    delimiter: str = "|"
    header: bool = True
    date_format: str = "yyyy-MM-dd"
    parse_mode: str = "FAILFAST"
    hash_buckets: int = 1_000_000
    sample_fraction: float = 1.0
    max_records_per_file: int = 5_000_000
    fatal_reasons: tuple[str, ...] = FATAL
    max_rate_per_reason: float = 0.01
    max_rate_overall: float = 0.02
    unemployment_hinge: float = 4.8
    scenario_vintage: int = 2019
    horizon_quarters: int = 13
    half_life_quarters: int = 8
    long_run_unemployment: float = 4.8
    long_run_hpi: float = 0.03
    support_before_cutoff: float = 7.25
    support_full_history: float = 9.86
    loans: int = 25_000
    first_vintage: int = 2000
    last_vintage: int = 2018
    max_months: int = 120
    data_root: str = "data"
    crisis_gate: bool = True
    sign_gate: bool = True
    backtest_gate: bool = True

    def section(self, name: str) -> dict:
        """The settings of one section of the files."""
        return {key: getattr(self, key) for key in SECTIONS[name]}

    def nested(self) -> dict[str, dict]:
        """All settings by section, as a file may hold them."""
        return {name: self.section(name) for name in SECTIONS}

    def validate(self) -> Settings:
        """Raises ConfigError for settings that no run could use."""
        if not 0 < self.sample_fraction <= 1:
            raise ConfigError("sample_fraction must be above 0 and at most 1")
        if self.first_vintage > self.last_vintage:
            raise ConfigError("first_vintage comes after last_vintage")
        if self.cohort_grain not in ("monthly", "quarterly", "annual"):
            raise ConfigError(f"unknown cohort grain {self.cohort_grain!r}")
        if self.denominator not in ("original_balance", "average_outstanding"):
            raise ConfigError(f"unknown denominator {self.denominator!r}")
        if self.discount_rate < 0 or not 0 <= self.fallback_lgd <= 1:
            raise ConfigError("discount_rate must be 0 or more and fallback_lgd between 0 and 1")
        unknown = {*self.codes.values(), *self.absorbing, *self.dpd_floors} - {*self.states}
        if unknown:
            raise ConfigError(f"states that are not listed: {sorted(unknown)}")
        return self


#: Files may group settings by these sections, and must put each under its own.
SECTIONS = {
    "project": ("env", "seed", "data_root"),
    "states": ("states", "absorbing", "dpd_floors", "codes"),
    "ingest": ("delimiter", "header", "date_format", "parse_mode", "hash_buckets", "sample_fraction", "max_records_per_file", "fatal_reasons", "max_rate_per_reason", "max_rate_overall"),
    "model": ("mob_edges", "score_edges", "macro_lags", "discount_rate", "fallback_lgd", "cutoff", "maturity_mob", "cohort_grain", "denominator", "c", "c_dpd150", "fit_end", "backtest_fit_end", "crisis_gate", "sign_gate", "backtest_gate"),
    "scenarios": ("unemployment_hinge", "scenario_vintage", "horizon_quarters", "half_life_quarters", "long_run_unemployment", "long_run_hpi", "support_before_cutoff", "support_full_history"),
    "synthetic": ("loans", "first_vintage", "last_vintage", "max_months"),
}


_KINDS = {"str": (str,), "int": (int,), "float": (int, float), "bool": (bool,), "str | None": (str, type(None))}


def check_type(name: str, kind: str, value) -> None:
    """Raises ConfigError for a value of another type than the setting's: a truth value is no number, a list holds its elements' type."""
    if kind.startswith("tuple["):
        right = isinstance(value, list | tuple)
        for x in value if right else ():
            check_type(name, kind.removeprefix("tuple[").split(",")[0], x)
    elif kind.startswith("dict["):
        right = isinstance(value, dict)
        of_key, of_value = kind.removeprefix("dict[").removesuffix("]").split(", ")
        for k, v in value.items() if right else ():
            check_type(name, of_key, k)
            check_type(name, of_value, v)
    else:
        right = isinstance(value, _KINDS[kind]) and (kind == "bool" or not isinstance(value, bool))
    if not right:
        raise ConfigError(f"{name} must be of type {kind}, not {value!r}")


def flatten(values: dict) -> dict:
    """Settings out of their sections; one under another section's name is an error."""
    out = {}
    for key, value in values.items():
        if key in SECTIONS and isinstance(value, dict):
            if wrong := sorted(set(value) - set(SECTIONS[key])):
                raise ConfigError(f"section {key} has no {wrong}")
            out |= value
        else:
            out[key] = value
    return out


def merge(base: dict, over: dict) -> dict:
    """base with over's values; mappings are merged at any depth."""
    out = dict(base)
    for key, value in over.items():
        out[key] = merge(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def expand(value):
    """The value with ${NAME} in any string replaced from the environment; a missing name is an error."""
    if isinstance(value, dict):
        return {k: expand(v) for k, v in value.items()}
    if isinstance(value, list):
        return [expand(v) for v in value]
    if not isinstance(value, str):
        return value

    def name(m: re.Match) -> str:
        if m[1] not in os.environ:
            raise ConfigError(f"environment variable {m[1]} is not set")
        return os.environ[m[1]]

    return re.sub(r"\$\{(\w+)\}", name, value)


def load_settings(env: str = "local", config_dir: str | Path | None = None, **over) -> Settings:
    """Defaults, then base.yaml, then <env>.yaml, then keyword values."""
    values: dict = {"env": env}
    if config_dir is not None:
        for name in ("base.yaml", f"{env}.yaml"):
            path = Path(config_dir) / name
            if path.exists():
                values = merge(values, flatten(yaml.safe_load(path.read_text()) or {}))
            elif name != "base.yaml":
                raise ConfigError(f"no settings for environment {env!r} in {config_dir}")
    values = expand(merge(values, over))
    known = {f.name: f for f in dataclasses.fields(Settings)}
    if unknown := set(values) - set(known):
        raise ConfigError(f"unknown settings: {sorted(unknown)}")
    for k, v in values.items():
        check_type(k, known[k].type, v)
    return Settings(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()}).validate()
