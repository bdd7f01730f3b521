"""List plan features that do not scale: nested-loop joins, products, single-partition windows.

    python tools/plans.py [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from panelspark.session import local_session  # noqa: E402


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def findings(text: str) -> list[str]:
    out = [n for n in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "BatchEvalPython") if n in text]
    lines = text.splitlines()
    depth = [len(re.match(r"[\s:|+*()\d-]*", line).group(0)) for line in lines]
    for i, line in enumerate(lines):
        if re.search(r"\bWindow \[", line):
            for j in range(i + 1, min(i + 4, len(lines))):
                if depth[j] > depth[i] and "Exchange SinglePartition" in lines[j]:
                    out.append("single-partition window")
                    break
    return out


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="/root/testdata/sf0.001")
    args = parser.parse_args()
    from panelspark.queries import QUERIES

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    skip = ("fit_", "cv_", "param_", "predict_clip", "coefficients", "tree_importance")
    for name, fn in QUERIES.items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        if not args.names and (name.startswith(skip) and name != "fit_schedule"):
            continue
        try:
            found = findings(plan_text(fn(spark, args.sf)))
        except Exception as exc:  # noqa: BLE001
            found = [f"{type(exc).__name__}: {str(exc)[:160]}"]
        if found:
            print(name, sorted(set(found)), flush=True)
    print("checked")
    return 0


if __name__ == "__main__":
    sys.exit(main())
