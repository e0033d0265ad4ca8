"""``python -m treeflow -config run.json``: reconcile two trees and print the report; ``-inspect`` shows the state, ``-sweep`` lists
failed folders (or the source folders given) again."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .lifecycle import Config, Run, VerificationError, migrate


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="treeflow")
    parser.add_argument("-config", "--config", required=True)
    parser.add_argument("-inspect", "--inspect", action="store_true")
    parser.add_argument("-sweep", "--sweep", nargs="*", metavar="PATH")
    asked = parser.parse_args(args)
    config = Config.from_json(Path(asked.config).read_text(), command_line=True)
    spark = SparkSession.builder.appName("treeflow").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run = Run(spark, config)
        done = run.inspect() if asked.inspect else migrate(spark, config) if asked.sweep is None else run.sweep(asked.sweep or None)
        for name, value in done.items():
            print(f"{name}: {value}")
    except VerificationError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
