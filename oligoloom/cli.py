"""Command line: ``python -m oligoloom`` locally, or this file under spark-submit."""

from __future__ import annotations

import argparse
import logging
from dataclasses import fields

from pyspark.sql import SparkSession

from oligoloom.config import CalibrationSection, load_config, with_calibration
from oligoloom.plans.calibrate import run_calibration
from oligoloom.plans.generate import run_generation
from oligoloom.session import local_session

OVERRIDES = [f.name for f in fields(CalibrationSection) if f.name != "random_seed_offset"]


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="oligoloom", description="Design pools of non-interfering DNA oligos on Spark")
    parser.add_argument("--config", default="config.yaml", help="YAML configuration")
    parser.add_argument("--resume", action="store_true", help="go on with the latest run")
    parser.add_argument("--calibrate", action="store_true", help="estimate the search instead of running it")
    for name in OVERRIDES:
        parser.add_argument(f"--{name.replace('_', '-')}", type=int, help=f"replaces calibration.{name}")
    parser.add_argument("--local", metavar="CORES", help="start a local session instead of joining the submitted one")
    return parser


def main(argv: list[str] | None = None) -> int:
    parser = build_parser()
    args = parser.parse_args(argv)
    if args.calibrate and args.resume:
        parser.error("--calibrate starts from scratch and cannot be combined with --resume")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    config = load_config(args.config)
    spark = local_session(args.local) if args.local else SparkSession.builder.appName("oligoloom").getOrCreate()
    if args.calibrate:
        run_calibration(with_calibration(config, {name: getattr(args, name) for name in OVERRIDES}), spark)
    else:
        run_generation(config, spark, resume=args.resume)
    return 0
