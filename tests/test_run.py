import csv
import json
import random
import time
from pathlib import Path

import pytest
from plain import conflicts, greedy_set, random_pool, rc
from pyspark import InheritableThread

from oligoloom import cli
from oligoloom.config import ConfigError, build_config, load_config, parse_config, read_motifs
from oligoloom.operators.conflicts import PairRules, conflict_edges
from oligoloom.operators.funnel import FunnelSettings, funnel_totals
from oligoloom.plans.calibrate import run_calibration
from oligoloom.plans.gather import batch_size
from oligoloom.plans.generate import run_generation
from oligoloom.sources.files import read_candidates
from oligoloom.storage import materialize, scratch_dir
from oligoloom.streaming.feed import grow_pool, judge, read_pool

OPEN = {
    "composition": {"gc_min_fraction": 0.0, "gc_max_fraction": 1.0},
    "filters": {"intrinsic_tm_min_c": -1000.0, "intrinsic_tm_max_c": 1000.0, "max_homopolymer": 20,
                "max_dinucleotide_repeats": 20, "max_trinucleotide_repeats": 20, "near_palindrome_min_match": 99,
                "self_complementarity_run_threshold": 99},
}


def config(tmp_path, length, target, attempts, **sections):
    given = {"generator": {"primer_length": length, "target_size": target, "random_seed": 7, "max_attempts": attempts}, **OPEN}
    for name, values in sections.items():
        given[name] = {**given.get(name, {}), **values}
    return build_config(given, tmp_path)


def supplied(texts):
    """A candidate source that replays a list, one text per attempt."""

    def source(spark, first, last):
        rows = [(i, texts[i - 1]) for i in range(first, min(last, len(texts)) + 1)]
        return spark.createDataFrame(rows, "attempt_id long, sequence string")

    return source


def rows_of(path):
    lines = []
    for part in sorted(Path(path).glob("part-*")):
        with part.open(newline="") as handle:
            lines += list(csv.DictReader(handle))
    return lines


# ---- configuration -------------------------------------------------------------------------


def test_defaults_and_yaml(tmp_path):
    c = parse_config("generator:\n  primer_length: 20\n  target_size: 5\n  extra: 1\n")
    assert (c.filters.intrinsic_tm_max_c, c.pairing.enabled, c.sense_limit_c) == (70.0, False, 40.0)
    assert c.merged["generator"]["extra"] == 1
    assert c.digest == parse_config("{generator: {target_size: 5, primer_length: 20, extra: 1}}").digest
    (tmp_path / "m.txt").write_text("ggatcc # site\n\n# nothing\nAAAC\n")
    (tmp_path / "c.yaml").write_text(
        "generator: {primer_length: 20, target_size: 5}\nforbidden_motifs: {motifs: [gaattc], motif_file: m.txt}\n"
    )
    c = load_config(tmp_path / "c.yaml")
    assert c.forbidden_motifs.motifs == ["AAAC", "GAATTC", "GGATCC"]
    assert c.motifs() == ("AAAC", "GAATTC", "GGATCC", "GTTT")
    assert read_motifs(tmp_path / "m.txt") == ["GGATCC", "AAAC"]


@pytest.mark.parametrize(
    "text",
    [
        "",
        "[1, 2]",
        "a: [",
        "generator: {primer_length: 20}",
        "generator: {primer_length: 0, target_size: 1}",
        "{generator: {primer_length: 9, target_size: 1}, filters: {intrinsic_tm_min_c: 80}}",
        "{generator: {primer_length: 9, target_size: 1, force_target_cycle_oversample_multiplier: 0.5}}",
        "{generator: {primer_length: 9, target_size: 1}, composition: {gc_min_fraction: 0.9}}",
        "{generator: {primer_length: 9, target_size: 1}, thermodynamics: {three_prime_window_nt: 0}}",
        "{generator: {primer_length: 9, target_size: 1}, pairing: {rejection_window: 0}}",
        "{generator: {primer_length: 9, target_size: 1}, calibration: {graph_size_cap: 7}}",
        "{generator: {primer_length: 9, target_size: 1}, forbidden_motifs: {motif_file: nowhere.txt}}",
    ],
)
def test_bad_configurations(text):
    with pytest.raises(ConfigError):
        parse_config(text)


def test_gates_given_by_hand():
    base = "generator: {primer_length: 9, target_size: 1}\nthermodynamics: {min_tm_calculation_run_length: 5%s}"
    c = parse_config(base % "")
    assert c.configured_gate("sense") == c.configured_gate("reverse_complement") == 5
    assert parse_config(base % ", min_tm_calculation_run_length_sense: 7").configured_gate("sense") == 7


def test_batches():
    assert batch_size(1_000_000, 0, 0) == 20_000_000 and batch_size(100, 1000, 100) == 10_000
    assert batch_size(1_000_000, 1000, 100) == pytest.approx(11_000_000, rel=1e-6)


def test_command_line_rejects_resume_with_calibrate():
    with pytest.raises(SystemExit):
        cli.main(["--resume", "--calibrate"])
    assert cli.build_parser().parse_args(["--graph-trials", "3"]).graph_trials == 3


# ---- runs ----------------------------------------------------------------------------------


def test_run_matches_the_plain_rules(spark, tmp_path):
    texts = random_pool(90, 12, 11)
    texts = texts[:40] + texts[:10] + texts[40:]
    c = config(tmp_path, 12, 70, 1000, thermodynamics={"pair_tm_max_c": 5.0})
    summary = run_generation(c, spark, source=supplied(texts))
    pool = list(dict.fromkeys(texts))[:70]
    edges = conflicts(pool, 3, 4, 0, 5.0)
    assert summary["attempted_candidates"] == 80 and summary["accepted_before_pruning"] == 70
    assert summary["rejection_counts"] == {"duplicate": 10, "accepted": 70}
    table = spark.read.json(summary["conflicts"]["table"])
    assert {(e.left_index, e.right_index) for e in table.collect()} == set(edges)
    assert summary["conflicts"]["count"] == len(edges)
    kept = [pool[i] for i in sorted(greedy_set(pool, edges))]
    out = rows_of(summary["outputs"]["final_csv"])
    assert [r["sequence"] for r in out] == kept and len(kept) < 70
    assert list(out[0]) == ["sequence", "reverse_complement", "gc_fraction", "intrinsic_tm_c"]
    slots = 70 * 69 // 2
    buckets = ("num_pairs_below_min_alignment_run", "num_Tms_shortcircuited", "num_TmNN_evaluations_performed")
    assert sum(summary[b] for b in buckets) == slots
    saved = json.loads(Path(summary["outputs"]["summary_json"]).read_text())
    assert saved["final_validated_size"] == len(kept) == summary["final_delivered_size"]
    assert saved["generation_diagnostics"]["target_reached"]


def test_resume_equals_one_run(spark, tmp_path):
    part = config(tmp_path / "a", 12, 60, 40, filters={"max_homopolymer": 2})
    first = run_generation(part, spark)
    assert first["attempted_candidates"] == 40 and first["accepted_before_pruning"] < 60
    # The same settings again: nothing is left to try, and nothing changes.
    again = run_generation(part, spark, resume=True)
    assert again["outputs"]["run_dir"] == first["outputs"]["run_dir"]
    assert again["accepted_before_pruning"] == first["accepted_before_pruning"]
    assert again["rejection_counts"] == first["rejection_counts"]
    with pytest.raises(ConfigError):
        run_generation(config(tmp_path / "a", 12, 61, 40), spark, resume=True)
    with pytest.raises(ConfigError):
        run_generation(config(tmp_path / "nothing", 12, 61, 40), spark, resume=True)


def test_resume_on_a_uri(spark, tmp_path):
    """The run directory is a URI, and resuming finds its tables there."""
    rest = supplied(random_pool(40, 10, 5))
    c = config(tmp_path, 10, 20, 100, output={"root_dir": (tmp_path / "shared").as_uri()})
    first = run_generation(c, spark, source=rest)
    assert first["outputs"]["run_dir"].startswith("file:") and (tmp_path / "shared" / "latest_run.txt").exists()
    again = run_generation(c, spark, resume=True, source=rest)
    for name in ("attempted_candidates", "accepted_before_pruning", "final_validated_size", "rejection_counts"):
        assert again[name] == first[name]


def test_force_target_runs_more_cycles(spark, tmp_path):
    texts = random_pool(60, 10, 21)
    for i in (0, 3, 6, 12, 15):
        texts[i + 1] = rc(texts[i])
    c = config(
        tmp_path, 10, 12, 60, thermodynamics={"pair_tm_max_c": -20.0},
        generator={"force_target_size": True, "force_target_cycle_oversample_multiplier": 1.0, "force_target_post_target_seconds": 0.0},
    )
    summary = run_generation(c, spark, source=supplied(texts))
    # The same cycles in plain Python.
    pool, taken, cycles = [], 0, 0
    while True:
        cycles += 1
        fresh = texts[taken : taken + 12 - len(pool)]
        taken, pool = taken + len(fresh), pool + fresh
        survivors = [pool[i] for i in sorted(greedy_set(pool, conflicts(pool, 3, 4, 0, -20.0)))]
        if len(survivors) >= 12 or taken >= 60:
            break
        pool = survivors
    assert cycles > 1 and summary["cycle_count"] == cycles
    assert [r["sequence"] for r in rows_of(summary["outputs"]["final_csv"])] == survivors


def test_interrupt_goes_on_with_what_there_is(spark, tmp_path):
    replay = supplied(random_pool(30, 10, 5))

    def source(spark_, first, last):
        if first == 1 and last > 15:
            return replay(spark_, 1, 15)
        if first > 15:
            raise KeyboardInterrupt
        return replay(spark_, first, last)

    c = config(tmp_path, 10, 20, 100_000, generator={"force_target_size": True})
    summary = run_generation(c, spark, source=source)
    assert summary["cycle_count"] == 1 and summary["accepted_before_pruning"] == 15


def test_every_attempt_is_judged_once(spark, tmp_path):
    """Counters come from the verdicts that were stored, also after resuming."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("ACGT") for _ in range(5)) for _ in range(400)]
    calls, replay = [], supplied(texts)

    def source(spark_, first, last):
        calls.append((first, last))
        return replay(spark_, first, last)

    parts = dict(filters={"max_homopolymer": 2}, thermodynamics={"pair_tm_max_c": 999.0})
    for attempts, resume in ((150, False), (400, True)):
        c = config(tmp_path, 5, 4000, attempts, **parts)
        if resume:
            # The same run, continued with a larger budget.
            found = sorted(tmp_path.glob("**/manifest-*.json"))[-1]
            found.write_text(json.dumps(json.loads(found.read_text()) | {"config_digest": c.digest}))
            (found.parent / f".{found.name}.crc").unlink(missing_ok=True)
        summary = run_generation(c, spark, resume=resume, source=source)
        want = funnel_totals(replay(spark, 1, attempts), c.funnel()).first().asDict()
        counts = summary["generation_diagnostics"]["rejection_counts"]
        assert counts == {name: want[name] for name in counts} and summary["attempted_candidates"] == attempts
    assert calls == [(1, 150), (151, 400)]


def test_an_interrupt_ends_the_jobs_of_the_batch(spark, tmp_path):
    replay = supplied(["AAAACCCC", "CCCCAAAA", "AACCAACC"] + ["GGGGGGGG"] * 12)
    ended = []

    def long_job():
        try:
            slow = spark.range(0, 1 << 40, 1, 2).selectExpr("sum(hash(id, id + 1))")
            slow.collect()
            ended.append("finished")
        except Exception as error:
            ended.append(str(error))

    workers = []

    def source(spark_, first, last):
        if first == 1:
            return replay(spark_, 1, 15)
        workers.append(InheritableThread(target=long_job))
        workers[0].start()
        time.sleep(3)
        raise KeyboardInterrupt

    c = config(tmp_path, 8, 20, 100_000, generator={"force_target_size": True})
    summary = run_generation(c, spark, source=source)
    workers[0].join(60)
    assert not workers[0].is_alive() and "cancel" in ended[0].lower()
    assert summary["accepted_before_pruning"] == 4 and not spark.sparkContext.getJobTags()


def test_pairing_outputs(spark, tmp_path):
    c = config(tmp_path, 4, 4, 20, pairing={"enabled": True, "sense_tm_max_c": 5.0}, thermodynamics={"pair_tm_max_c": 999.0})
    summary = run_generation(c, spark, source=supplied(["AAAA", "CCCC", "GGGG", "TTTT"]))
    pairing = summary["pairing"]
    assert pairing["completed"] and pairing["accepted_pairs"] == 2 and pairing["unpaired_count"] == 0
    pairs, final = rows_of(summary["outputs"]["pairings_csv"]), rows_of(summary["outputs"]["final_csv"])
    assert [r["pair_index"] for r in pairs] == ["1", "2"] and pairs[0]["pair_tm_c"] == "-inf"
    assert [r["sequence"] for r in final] == [s for r in pairs for s in (r["left_sequence"], r["right_sequence"])]
    assert not Path(summary["outputs"]["unpaired_csv"]).exists()


def test_nothing_accepted(spark, tmp_path):
    c = config(tmp_path, 20, 5, 5, filters={"intrinsic_tm_min_c": 200.0, "intrinsic_tm_max_c": 250.0})
    summary = run_generation(c, spark)
    report = summary["generation_diagnostics"]
    assert summary["final_delivered_size"] == 0 and not report["target_reached"]
    assert sum(report["rejection_counts"].values()) == 5
    assert "".join(p.read_text() for p in Path(summary["outputs"]["final_csv"]).glob("part-*")) == ""


def test_calibration(spark, tmp_path):
    c = config(
        tmp_path, 8, 6, 1000, thermodynamics={"pair_tm_max_c": -40.0},
        calibration={"filtered_sample_size": 18, "max_filter_attempts": 200, "pair_sample_size": 40, "graph_trials": 2, "graph_size_cap": 30},
    )
    out = run_calibration(c, spark)
    best = out["recommended"]
    assert best["pair_support"] == 40 and best["predicted_search_size"] >= 6 and best["local_pass_rate"] > 0
    bins = out["pair_3prime_run_histogram"]
    assert [b["anchored_run_length"] for b in bins] == list(range(len(bins))) and sum(b["pair_count"] for b in bins) == 40
    assert sum(b["conflict_count"] for b in bins) / 40 == best["conflict_probability"]
    names = {p.name for p in Path(out["run_dir"]).iterdir() if not p.name.startswith(".")}
    assert names == {"calibration_summary.json", "thermo_search_estimate.csv", "pair_3prime_run_histogram.csv", "calibration_resolved_config.yaml"}
    impossible = config(tmp_path, 8, 6, 10, filters={"intrinsic_tm_min_c": 900.0}, calibration={"max_filter_attempts": 50})
    with pytest.raises(ConfigError):
        run_calibration(impossible, spark)


def test_external_candidates_are_checked(spark, tmp_path):
    spark.createDataFrame([(1, "acgt"), (2, "ACGA")], "attempt_id long, sequence string").write.parquet(str(tmp_path / "ok"))
    assert {r.sequence for r in read_candidates(spark, str(tmp_path / "ok"), 4).collect()} == {"ACGT", "ACGA"}
    spark.createDataFrame([(1, "ACGN")], "attempt_id long, sequence string").write.csv(str(tmp_path / "bad"), header=True)
    with pytest.raises(Exception, match="not a 4-base sequence"):
        read_candidates(spark, str(tmp_path / "bad"), 4, format="csv", header=True).collect()


class _Session:
    """Just enough of a session to ask for its scratch folder."""

    def __init__(self, master, folder=None):
        self.master, self.folder, self.applicationId = master, folder, f"app-{master}"
        self.conf = self.sparkContext = self

    def get(self, key, default):
        return self.folder or default


def test_tables_go_to_the_shared_folder(spark):
    assert scratch_dir(_Session("yarn", "hdfs:/shared/")) == "hdfs:/shared"
    assert scratch_dir(_Session("local[2]")) == scratch_dir(_Session("local[2]"))
    with pytest.raises(RuntimeError):
        scratch_dir(_Session("yarn"))
    table = materialize(spark.range(3), "three")
    assert table.count() == 3 and scratch_dir(spark) in table.inputFiles()[0]


# ---- streaming -----------------------------------------------------------------------------


def test_growing_pool(spark, tmp_path):
    texts = random_pool(40, 12, 31)
    texts = texts[:20] + texts[:5] + texts[20:]
    schema = "attempt_id long, sequence string"
    for number, begin in enumerate(range(0, 45, 15)):
        rows = [(i + 1, texts[i]) for i in range(begin, begin + 15)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{number}"))
    settings = FunnelSettings(12, -1000.0, 1000.0, 3, 99, 99, 99, 99)
    rules = PairRules(12, -30.0)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    query = grow_pool(stream, settings, rules, str(tmp_path / "out")).trigger(availableNow=True).start()
    query.awaitTermination()
    pool = read_pool(spark.range(1), str(tmp_path / "out"))
    rows = pool.orderBy("idx").collect()
    good = {t for t in texts if not any(b * 4 in t for b in "ACGT")}
    assert {r.sequence for r in rows} == good and [r.idx for r in rows] == list(range(len(good)))
    edges = spark.read.parquet(str(tmp_path / "out/edges"))
    whole = conflict_edges(pool, rules)
    columns = ["left_index", "right_index", "tm_c"]
    assert edges.count() == whole.count() > 0
    assert edges.select(columns).exceptAll(whole.select(columns)).count() == 0


def test_streaming_verdicts(spark, tmp_path):
    rows = [(1, "AAAACCGT"), (2, "ACGTACGA"), (3, "ACGTACGA")]
    spark.createDataFrame(rows, "attempt_id long, sequence string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("attempt_id long, sequence string").parquet(str(tmp_path / "in"))
    verdicts = judge(stream, FunnelSettings(8, -1000.0, 1000.0, 3, 99, 99, 99, 99))
    query = verdicts.writeStream.format("memory").queryName("verdicts").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.sequence: r.reason for r in spark.table("verdicts").collect()}
    assert got == {"AAAACCGT": "homopolymer", "ACGTACGA": None}
