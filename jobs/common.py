"""What the jobs' command lines share."""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import SparkSession


def config_of(name: str, path: str | None = None) -> dict:
    """The settings of a job: those of its own file, and over them those of the given one."""
    own = json.loads(Path(__file__).with_name(f"{name}.json").read_text())
    given = json.loads(Path(path).read_text()) if path else {}
    if unknown := set(given) - set(own):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return own | given


def main(name: str, run, places: dict[str, str], argv: list[str] | None = None) -> None:
    """Parses the command line, runs the job in a session of its own and stops it. places: the arguments that name folders, with their help."""
    p = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=run.__doc__)
    for place, text in places.items():
        p.add_argument(place, help=text)
    p.add_argument("--config", help=f"a JSON file with settings that replace those of jobs/{name}.json")
    a = vars(p.parse_args(argv))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, *(a[place] for place in places), config_of(name, a["config"]))
    finally:
        spark.stop()
