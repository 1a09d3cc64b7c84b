"""python -m creditloom.cli VERB [--env NAME] [--config-dir DIR] [--sample-fraction F] [--data-root DIR] [--scenarios CSV] [--vintages YEAR ...] [--by-loan]"""

from __future__ import annotations

import argparse
import json

from creditloom.config import load_settings
from creditloom.plans import stages
from creditloom.session import build_session

VERBS = ("config", *stages.STAGES, "scenarios")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("verb", choices=VERBS)
    parser.add_argument("--env", default="local")
    parser.add_argument("--config-dir")
    parser.add_argument("--sample-fraction", type=float)
    parser.add_argument("--data-root")
    parser.add_argument("--scenarios", help="published scenario CSV, for the verb scenarios")
    parser.add_argument("--vintages", type=int, nargs="+", help="replace these vintages alone, for the verbs ingest and panel")
    parser.add_argument("--by-loan", action="store_true", help="read the co-located tables, for the verb panel")
    a = parser.parse_args(argv)
    if (a.vintages and a.verb not in ("ingest", "panel")) or (a.by_loan and a.verb != "panel"):
        parser.error(f"{a.verb} takes neither --vintages nor --by-loan" if a.verb not in ("ingest", "panel") else "ingest does not take --by-loan")
    over = {"data_root": a.data_root} if a.data_root else {}
    s = stages.sampled(load_settings(a.env, a.config_dir, **over), a.sample_fraction)
    if a.verb == "config":
        print(json.dumps(s.nested(), indent=2))
        return 0
    spark = build_session(f"creditloom-{a.verb}")
    more = {"vintages": a.vintages} if a.vintages else {}
    more |= {"by_loan": True} if a.by_loan else {}
    report = stages.scenario_stage(spark, s, a.scenarios) if a.verb == "scenarios" else stages.STAGES[a.verb](spark, s, **more)
    print(json.dumps(report, indent=2, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
