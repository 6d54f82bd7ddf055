"""Estimate the cost of a search from a sample of candidates and of pairs."""

from __future__ import annotations

import logging
import math
import time
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from oligoloom.config import ConfigError, RunConfig
from oligoloom.operators.calibrate import (
    conflict_rates,
    gc_space,
    pair_metrics,
    run_histogram,
    sample_pairs,
    search_size,
)
from oligoloom.operators.funnel import FUNNEL_ORDER, totals_of_verdicts
from oligoloom.plans.gather import Source, next_batch, proposal_source
from oligoloom.sources.files import new_run_dir, write_csv, write_json, write_yaml
from oligoloom.storage import materialize, scratch_scope

log = logging.getLogger("oligoloom")

MODEL = "thermo_only_3prime_rc"


def run_calibration(config: RunConfig, spark: SparkSession, source: Source | None = None) -> dict[str, Any]:
    with scratch_scope(spark):
        return _calibrate(config, spark, source)


def _calibrate(config: RunConfig, spark: SparkSession, source: Source | None) -> dict[str, Any]:
    options, generator = config.calibration, config.generator
    run_dir = new_run_dir(spark, config, suffix="_calibration", remember=False)
    base_seed = int(generator.random_seed or 0)
    source = source or proposal_source(config, base_seed + options.random_seed_offset)

    started = time.perf_counter()
    nothing = spark.createDataFrame([], "sequence string")
    batch = next_batch(
        spark, source, config.funnel(), nothing, 1, options.max_filter_attempts, options.filtered_sample_size
    )
    found, attempts = batch.count, batch.reached
    if found < 2:
        raise ConfigError(f"only {found} usable sequences in {attempts} attempts")
    sample = materialize(batch.rows, "sample")
    totals = totals_of_verdicts(batch.verdicts).first().asDict()
    seconds_per_attempt = (time.perf_counter() - started) / max(attempts, 1)

    # Lengths of all runs are wanted here, so the sample is scored without a gate.
    started = time.perf_counter()
    rules = config.pair_rules(config.configured_gate("reverse_complement"))
    pairs = sample_pairs(sample, options.pair_sample_size, base_seed + options.random_seed_offset)
    metrics = materialize(pair_metrics(pairs, rules), "pair-metrics")
    rates = conflict_rates(metrics).first()
    seconds_per_pair = (time.perf_counter() - started) / rates.pair_count

    pass_rate = found / attempts
    size = search_size(generator.target_size, rates.conflict_probability)
    degree = rates.conflict_probability * (size - 1) if rates.conflict_probability else 0.0
    kept = generator.target_size / size
    space = gc_space(generator.primer_length, *config.gc_range)
    # Each accepted oligo takes 1 / pass_rate attempts on average.
    expected = size / pass_rate
    validation_pairs = size * (size - 1) / 2
    runtime = math.inf
    if math.isfinite(expected):
        runtime = expected * seconds_per_attempt + validation_pairs * seconds_per_pair
    estimate = {
        "model": MODEL,
        "local_pass_rate": pass_rate,
        "conflict_probability": rates.conflict_probability,
        "predicted_search_size": float(size),
        "predicted_retained_fraction": kept,
        "predicted_mean_conflict_degree": degree,
        "predicted_raw_attempts": float(expected),
        "predicted_validation_pairs": validation_pairs,
        "estimated_runtime_seconds": runtime,
        "filtered_space_estimate": space * pass_rate,
        "space_feasible": size <= space * pass_rate,
        "pair_support": rates.pair_count,
    }
    histogram = run_histogram(metrics)
    inputs = {
        "filtered_sample_size": options.filtered_sample_size,
        "pair_sample_size": options.pair_sample_size,
        "graph_trials": options.graph_trials,
        "graph_size_cap": options.graph_size_cap,
        "seconds_per_attempt": seconds_per_attempt,
        "seconds_per_tm_eval": seconds_per_pair,
        "gc_constrained_sequence_space": space,
        "filtered_space_estimate": space * pass_rate,
        "raw_sampling_attempts": attempts,
        "filtered_sequences_collected": found,
        "pair_samples_collected": rates.pair_count,
        "rejection_counts": {name: totals[name] for name in FUNNEL_ORDER if totals[name]},
    }
    write_json(
        spark,
        f"{run_dir}/calibration_summary.json",
        {"recommended": estimate, "calibration_inputs": inputs, "search_estimate": [estimate]},
    )
    row = spark.createDataFrame([tuple(estimate.values())], list(estimate)).withColumn("place", F.lit(0))
    write_csv(row, f"{run_dir}/thermo_search_estimate.csv", "place", 1)
    bins = histogram.withColumn("place", F.col("anchored_run_length"))
    write_csv(bins, f"{run_dir}/pair_3prime_run_histogram.csv", "place", 1)
    write_yaml(spark, f"{run_dir}/calibration_resolved_config.yaml", config.merged)
    log.info("calibration in %s: search size %d, %.0f attempts", run_dir, size, expected)
    return {
        "recommended": estimate,
        "run_dir": run_dir,
        "search_estimate": [estimate],
        "pair_3prime_run_histogram": [r.asDict() for r in histogram.orderBy("anchored_run_length").collect()],
    }
