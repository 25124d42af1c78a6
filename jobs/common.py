"""What the jobs share: their log, config files and command lines."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from symgrain.shipping import ship

LOG = logging.getLogger("symgrain.jobs")


def config_of(spark: SparkSession, path: str) -> dict:
    """A JSON config file, from wherever Spark can read it."""
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def default_config(name: str) -> dict:
    """The config file that comes with a job."""
    return json.loads((Path(__file__).parent / f"{name}.json").read_text())


def read_back(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What an earlier run wrote there, or no rows if none has."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def command_line(name: str, doc: str | None, paths: dict[str, str], run: Callable[..., dict], arguments: list[str] | None = None) -> int:
    """Reads the arguments, opens a session, runs and closes it. paths: the function's path arguments and what they are."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=doc, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--config", help="JSON file; the one beside the job by default")
    for argument, what in paths.items():
        parser.add_argument(f"--{argument}", required=True, help=what)
    given = parser.parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        ship(spark)
        config = config_of(spark, given.config) if given.config else default_config(name)
        run(spark, config, **{p: getattr(given, p) for p in paths})
    finally:
        spark.stop()
    return 0
