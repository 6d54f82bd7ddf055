import math
import random

import pytest
from plain import best_run, greedy_set, pair_in_turn, random_pool, rc, tm
from pyspark.sql import functions as F

from oligoloom.functions.melting import Chemistry
from oligoloom import storage
from oligoloom.operators import accept
from oligoloom.operators import calibrate as cal
from oligoloom.operators import pairing, prune
from oligoloom.operators.accept import accept_first, first_rows, nth_smallest, with_position
from oligoloom.operators.conflicts import PairRules
from oligoloom.operators.funnel import (
    FUNNEL_ORDER,
    FunnelSettings,
    first_occurrences,
    funnel_table,
    funnel_totals,
    reason_counts,
    survivors,
    with_reason,
)
from oligoloom.operators.gate import admissible, gate_lengths
from oligoloom.operators.pairing import PairingOptions, pair_oligos
from oligoloom.operators.prefix import accept_to_cut
from oligoloom.operators.rolling import rolling_share
from oligoloom.operators.prune import (
    both_directions,
    greedy_removals,
    head_victims,
    independent_set,
    round_victims,
    settle,
    trim_newest,
)
from oligoloom.sources.proposals import enumerate_sequences

OPEN = dict(tm_min_c=-1000.0, tm_max_c=1000.0, max_homopolymer=99, max_dinucleotide_repeats=99,
            max_trinucleotide_repeats=99, near_palindrome_min_match=99, self_complementarity_threshold=99)


def candidates(spark, texts):
    return spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "attempt_id long, sequence string")


def reason_of(spark, text, **changes):
    settings = FunnelSettings(length=len(text), **{**OPEN, **changes})
    return with_reason(candidates(spark, [text]), settings).first().reason


def test_each_stage(spark):
    assert reason_of(spark, "ACGAATTCTG", motifs=("GAATTC",)) == "forbidden_motif"
    assert reason_of(spark, "ACGAATTCTG", motifs=("", "GGG")) is None
    assert reason_of(spark, "AAAATCGC", max_homopolymer=3) == "homopolymer"
    assert reason_of(spark, "AAATCGCC", max_homopolymer=3) is None
    assert reason_of(spark, "ATATATATGC", max_dinucleotide_repeats=3) == "dinucleotide_repeat"
    assert reason_of(spark, "ATATATATGC", max_dinucleotide_repeats=0) is None
    assert reason_of(spark, "ATGCATGCATGCATGCAT", near_palindrome_min_match=8) == "near_palindrome"
    assert reason_of(spark, "GCGTTAAACGCG", self_complementarity_threshold=4) == "self_complementarity"


def test_order_of_the_funnel(spark):
    defaults = dict(tm_min_c=40.0, tm_max_c=120.0, max_homopolymer=3, max_dinucleotide_repeats=3,
                    max_trinucleotide_repeats=2, near_palindrome_min_match=16, self_complementarity_threshold=6)
    assert reason_of(spark, "GCGCGATATATATATATATA", **defaults) == "dinucleotide_repeat"
    assert reason_of(spark, "GC" * 10, **{**defaults, "tm_min_c": 0.0, "tm_max_c": 30.0}) == "intrinsic_tm"


def test_bounds_are_inclusive(spark):
    text = "ACGTTGCATGCCATGACTGA"
    exact = with_reason(candidates(spark, [text]), FunnelSettings(length=20, **OPEN)).first().intrinsic_tm_c
    assert math.isclose(exact, tm(text))
    assert reason_of(spark, text, tm_min_c=exact, tm_max_c=exact) is None
    assert reason_of(spark, text, tm_max_c=math.nextafter(exact, -math.inf)) == "intrinsic_tm"


def test_totals_and_table(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ACGT") for _ in range(6)) for _ in range(3000)]
    settings = FunnelSettings(length=6, **{**OPEN, "max_homopolymer": 2, "tm_min_c": -30.0, "motifs": ("GAG",)})
    frame = candidates(spark, texts)
    totals = funnel_totals(frame, settings)
    verdicts = {r.sequence: r.reason for r in with_reason(frame, settings).collect()}
    want = dict.fromkeys((*FUNNEL_ORDER, "accepted"), 0)
    for text in set(texts):
        want[verdicts[text] or "accepted"] += 1
    want["duplicate"] = len(texts) - len(set(texts))
    row = totals.first().asDict()
    assert row.pop("attempts") == 3000 and row == want
    assert {r.reason: r.n for r in reason_counts(totals).collect()} == {k: v for k, v in want.items() if v}
    remaining = 3000
    for line, name in zip(funnel_table(totals).orderBy("stage").collect(), FUNNEL_ORDER):
        assert (line["filter"], line["count"], line.attempts_reaching_filter) == (name, want[name], remaining)
        assert line.fraction_of_attempts == want[name] / 3000
        remaining -= want[name]


def test_totals_without_rows(spark):
    totals = funnel_totals(candidates(spark, ["A"]).limit(0), FunnelSettings(length=20))
    assert set(totals.first()) == {0}
    assert {r.fraction_of_attempts for r in funnel_table(totals).collect()} == {0.0}


def test_hot_sequence_is_combined_before_the_shuffle(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("attempt_id"),
        F.when(F.col("id") % 3 == 0, "ACGT").otherwise(F.concat(F.lit("A"), F.col("id"))).alias("sequence"),
    )
    out = first_occurrences(rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "Window" not in plan
    hot = out.where("sequence = 'ACGT'").first()
    assert (hot.attempt_id, hot.proposals) == (0, 1000)


@pytest.mark.parametrize("n", [0, 1, 300])
def test_positions(spark, n):
    keys = sorted(random.Random(1).sample(range(-500, 5000), n))
    rows = spark.createDataFrame([(k,) for k in keys], "key long").repartition(7)
    got = {r.key: r.idx for r in with_position(rows, "key").collect()}
    assert got == {k: i for i, k in enumerate(keys)}


def test_numbering_reads_its_input_once(spark):
    """The result depends on one stored table, whatever it took to make the rows."""
    rows = spark.range(100).where("id % 3 = 0").withColumn("key", F.col("id") * 7)
    plan = with_position(rows, "key")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "SinglePartition" not in plan and "Range (" not in plan


def test_accept_first(spark):
    texts = ["AAAA", "CCCC", "CCCC", "GATC", "AAAA", "GGGG", "TCTA"]
    settings = FunnelSettings(length=4, **{**OPEN, "motifs": ("GATC",)})
    got = accept_first(survivors(candidates(spark, texts), settings), 3).orderBy("idx").collect()
    assert [(r.idx, r.attempt_id, r.sequence) for r in got] == [(0, 1, "AAAA"), (1, 2, "CCCC"), (2, 6, "GGGG")]


@pytest.mark.parametrize("size", [0, 1, 3, 50, 400, 5000])
def test_prefix_and_its_counters(spark, size):
    """Against going through the attempts one by one; several stretches, sparse attempt numbers, repeats."""
    rng = random.Random(8)
    rows = [(7 * i - 900, "".join(rng.choice("ACGT") for _ in range(5))) for i in range(1500)]
    frame = spark.createDataFrame(rows, "attempt_id long, sequence string").repartition(5)
    settings = FunnelSettings(length=5, **{**OPEN, "max_homopolymer": 2, "motifs": ("GAG",)})
    verdicts = {r.sequence: r.reason for r in with_reason(frame, settings).distinct().collect()}
    seen, taken, counts, last = set(), [], {}, None
    for attempt, text in rows:
        if len(taken) == size:
            break
        reason = "duplicate" if text in seen else verdicts[text] or "accepted"
        seen.add(text)
        counts[reason] = counts.get(reason, 0) + 1
        last = attempt
        if reason == "accepted":
            taken.append((len(taken), attempt, text))
    got = accept_to_cut(frame, settings, size, least_attempts=40)
    assert [(r.idx, r.attempt_id, r.sequence) for r in got.rows.orderBy("idx").collect()] == taken
    assert {r.reason: r.n for r in reason_counts(got.totals).collect()} == counts
    assert got.cut == last and (size != 3 or got.judged < 200)
    assert accept_to_cut(frame.limit(0), settings, size).rows.count() == 0


@pytest.mark.parametrize("values", [[5], [3, 1, 2], [-(2**62), 0, 2**62, 7], list(range(0, 9000, 3))])
def test_selection_without_sorting(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "key long").repartition(3)
    for n in {1, 2, len(values) // 2, len(values)} - {0}:
        assert nth_smallest(rows, "key", n) == (sorted(values)[n - 1] if n <= len(values) else None)
    assert nth_smallest(rows, "key", len(values) + 1) is None
    assert sorted(r.key for r in first_rows(rows, 2, "key").collect()) == sorted(values)[:2]
    assert first_rows(rows, 0, "key").count() == 0


@pytest.mark.parametrize("window", [1, 4, 10, 33])
def test_rolling_share(spark, window):
    rng = random.Random(2)
    flags = [rng.choice([True, False, None]) for _ in range(100)]
    rows = spark.createDataFrame([(3 * i, f) for i, f in enumerate(flags)], "key long, failed boolean").repartition(7)
    got = {r.key: r.share for r in rolling_share(rows, "key", F.col("failed"), window, block_rows=10).collect()}
    for i in range(100):
        last = flags[max(0, i - window + 1) : i + 1]
        assert math.isclose(got[3 * i], sum(f is True for f in last) / len(last))


def edge_frame(spark, texts, edges):
    rows = [(i, j, texts[i], texts[j]) for i, j in edges]
    return spark.createDataFrame(rows, "left_index long, right_index long, left_sequence string, right_sequence string")


@pytest.mark.parametrize("strongest", [1, 3, 12, 1000])
def test_round_victims_by_the_strongest_first(spark, strongest):
    """Few or many oligos told to every task: the same victims as by definition, also where strengths are equal."""
    rng = random.Random(strongest)
    texts = random_pool(30, 20, 5)
    texts[7], texts[8], texts[20] = texts[3], texts[3], texts[21]
    edges = [(i, j) for i in range(30) for j in range(i + 1, 30) if rng.random() < 0.12]
    edges += [(3, 8)] * ((3, 8) not in edges)
    near = {i: [j for e in edges if i in e for j in e if j != i] for i in range(30)}
    power = {i: (len(near[i]), texts[i]) for i in near}
    # Of equal ends the left one counts as beaten.
    beats = {i: all(power[i] > power[j] or (power[i] == power[j] and i > j) for j in near[i]) for i in near}
    want = {(i, len(near[i]), texts[i]) for i in near if near[i] and beats[i]}
    pool = spark.createDataFrame(list(enumerate(texts)), "idx long, sequence string")
    rows = edge_frame(spark, texts, edges)
    plain = rows.select("left_index", "right_index")
    for got in (round_victims(rows, strongest=strongest), round_victims(plain, pool, strongest=strongest)):
        assert {tuple(r) for r in got.select("idx", "degree", "sequence").collect()} == want


def test_a_stored_table_is_numbered_without_another_copy(spark, monkeypatch):
    labels = []
    keep = accept.materialize
    monkeypatch.setattr(accept, "materialize", lambda rows, label: labels.append(label) or keep(rows, label))
    pairs = [(5, 2), (1, 9), (5, 1), (1, 3)]
    rows = storage.materialize(spark.createDataFrame(pairs, "a long, b long"), "pairs")
    placed = {(r.a, r.b): r.place for r in accept.with_position(rows, ("a", "b"), "place").collect()}
    assert placed == {pair: place for place, pair in enumerate(sorted(pairs))}
    assert labels == ["numbered"]


def test_path_keeps_its_ends(spark):
    texts = ["AAA", "CCC", "GGG"]
    edges = edge_frame(spark, texts, [(0, 1), (1, 2)])
    assert [r.idx for r in greedy_removals(edges).collect()] == [1]
    assert [r.idx for r in round_victims(edges).collect()] == [1]
    pool = spark.createDataFrame(list(enumerate(texts)), "idx long, sequence string")
    kept = independent_set(pool, edges)
    assert sorted(r.idx for r in kept.collect()) == [0, 2]
    assert [r.idx for r in trim_newest(kept, 1).collect()] == [0]


@pytest.mark.parametrize("seed", range(4))
def test_pruning_matches_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    n = 30 + 20 * seed
    texts = random_pool(n, 6, seed)
    edges = [(i, j) for j in range(n) for i in range(j) if rng.random() < 0.08]
    want = set(range(n)) - greedy_set(texts, edges)
    frame = edge_frame(spark, texts, edges)
    for head_size, rounds in ((1, 3), (n // 3, 1), (1500, 2)):
        removed = [r.idx for r in greedy_removals(frame, head_size, rounds).collect()]
        assert len(removed) == len(set(removed)) and set(removed) == want


@pytest.mark.parametrize("head_size", [3, 25, 200])
def test_dense_conflicts_of_one_shared_text(spark, head_size):
    """Every older oligo conflicts with all newer ones of the other half: hardly any local maxima."""
    n = 60
    texts = random_pool(n, 8, 77)
    edges = [(i, j) for j in range(1, n, 2) for i in range(0, j, 2)]
    want = set(range(n)) - greedy_set(texts, edges)
    frame = edge_frame(spark, texts, edges)
    removed = [r.idx for r in greedy_removals(frame, head_size).collect()]
    assert len(removed) == len(set(removed)) and set(removed) == want
    head = [r.idx for r in head_victims(both_directions(frame), head_size).collect()]
    assert head and set(head) <= want and (head_size < n or set(head) == want)


def test_equal_degrees_fall_by_sequence(spark):
    assert [r.idx for r in greedy_removals(edge_frame(spark, ["CCC", "AAA"], [(0, 1)])).collect()] == [0]
    assert [r.idx for r in greedy_removals(edge_frame(spark, ["AAA", "CCC"], [(0, 1)]), 1).collect()] == [1]
    assert [r.node for r in settle(both_directions(edge_frame(spark, ["AAA", "CCC"], [(0, 1)]))).collect()] == [1]
    assert greedy_removals(edge_frame(spark, [], [])).count() == 0


def test_gate_against_enumeration(spark):
    settings = FunnelSettings(length=12, max_homopolymer=2, max_dinucleotide_repeats=1, max_trinucleotide_repeats=1)
    hottest = {}
    for length in range(2, 9):
        rows = enumerate_sequences(spark, length).where(admissible(F.col("sequence"), length, settings, 0.3, 0.5))
        hottest[length] = max(tm(r.sequence) for r in rows.collect())
    thresholds = {f"t{length}": hottest[length] - 0.01 for length in (3, 6, 7, 8)}
    gate = gate_lengths(spark, settings, 0.3, 0.5, thresholds)
    want = {label: min(n for n, t in hottest.items() if t > limit) for label, limit in thresholds.items()}
    assert gate.lengths == want
    for label, (sequence, tm_c) in gate.examples.items():
        assert len(sequence) == want[label] and tm_c > thresholds[label] and math.isclose(tm_c, tm(sequence))


def test_gate_of_the_shipped_settings_and_out_of_reach(spark):
    settings = FunnelSettings(length=20, max_dinucleotide_repeats=2, max_trinucleotide_repeats=1, chemistry=Chemistry(500.0))
    gate = gate_lengths(spark, settings, 0.45, 0.55, {"reverse_complement": 40.0, "sense": 30.0})
    assert gate.lengths == {"reverse_complement": 8, "sense": 7}
    short = FunnelSettings(length=6, max_homopolymer=2)
    assert gate_lengths(spark, short, 0.45, 0.55, {"x": 90.0}).lengths == {"x": 7}


def pair_up(spark, texts, limit, **options):
    pool = spark.createDataFrame([(t,) for t in texts], "sequence string")
    return pair_oligos(pool, PairRules(len(texts[0]), limit).anywhere(), PairingOptions(**options))


def test_pairing_reaches_its_target(spark):
    done = pair_up(spark, ["AAAA", "CCCC", "GGGG", "TTTT"], 5.0, target_pairs=2, seed=7)
    assert (done.accepted, done.unpaired, done.completed, done.target_reached) == (2, 0, True, True)
    short = pair_up(spark, ["AAAA", "CCCC", "GGGG", "TTTT"], 5.0, target_pairs=1, seed=7)
    assert (short.accepted, short.unpaired, short.target_reached) == (1, 2, True)


def test_pairing_of_incompatible_oligos_gives_up(spark):
    texts = ["GCGCGCGCGCAA", "GCGCGCGCGCAT", "GCGCGCGCGCTT"]
    stuck = pair_up(spark, texts, -50.0, target_pairs=1)
    assert stuck.accepted == 0 and stuck.unpaired == 3 and not stuck.completed
    assert stuck.recent_rejection_rate == 1.0 and stuck.rejected == stuck.attempts > 0


def test_pairing_invariants(spark):
    texts = random_pool(120, 12, 8)
    limit = -40.0
    out = pair_up(spark, texts, limit, target_pairs=60, seed=3)
    rows = out.pairs.collect()
    used = [s for r in rows for s in (r.left_sequence, r.right_sequence)]
    free = [r.sequence for r in out.free.collect()]
    assert sorted(used + free) == sorted(texts)
    assert len(rows) == out.accepted and len(free) == out.unpaired
    assert all(r.pair_tm_c <= limit for r in rows)
    assert all(r.pair_tm_c == max(r.left_vs_right_sense_tm_c, r.right_vs_left_sense_tm_c) for r in rows)
    assert out.rejected > 0
    assert out.attempts == out.rejected + out.held[-1] + out.recycled and out.accepted == max(out.held)


@pytest.mark.parametrize(
    "options",
    [
        dict(target_pairs=30, stagnation_attempts=40),
        dict(target_pairs=17, stagnation_attempts=40),
        dict(target_pairs=30, stagnation_attempts=40, attempts_multiplier=1),
        dict(target_pairs=30, stagnation_attempts=7, requeue_scale=0.0),
        dict(target_pairs=30, stagnation_attempts=300, requeue_scale=2.5),
    ],
)
def test_pairing_is_what_drawing_in_turn_gives(spark, options):
    """Half of the oligos share a hot core, so they only fit the others, which first find each other."""
    rng = random.Random(6)
    texts = ["GCGCGGCC" + "".join(rng.choice("ACGT") for _ in range(4)) for _ in range(31)]
    texts = sorted(set(texts + random_pool(30, 12, 9)))
    limit = -20.0

    def score(a, b):
        size, start, _ = best_run(a, b, len(a))
        return tm(a[start : start + size]) if size >= 4 else -math.inf

    fits = lambda a, b: max(score(a, b), score(b, a)) <= limit
    out = pair_up(spark, texts, limit, seed=5, **options)
    named = dict(target=options["target_pairs"], stagnation=options["stagnation_attempts"])
    named |= dict(multiplier=options.get("attempts_multiplier", 50), scale=options.get("requeue_scale", 1.0))
    pairs, free, attempts, rejected, recycled = pair_in_turn(texts, fits, seed=5, **named)
    assert {(r.left_sequence, r.right_sequence) for r in out.pairs.collect()} == pairs
    assert {r.sequence for r in out.free.collect()} == free
    assert (out.attempts, out.rejected, out.recycled) == (attempts, rejected, recycled)
    assert out.held == sorted(out.held) and out.accepted == len(pairs)


def test_pairing_keeps_the_most_pairs_it_held(spark):
    """Three quarters share a hot core and fit only the others: rejections dissolve pairs in every round."""
    rng = random.Random(4)
    hot = ["GCGCGGCCGC" + "".join(rng.choice("ACGT") for _ in range(6)) for _ in range(300)]
    cool = ["".join(rng.choice("AT") for _ in range(16)) for _ in range(100)]
    out = pair_up(spark, sorted(set(hot + cool)), 30.0, target_pairs=200, seed=2)
    assert out.accepted == max(out.held) == out.pairs.count() and len(out.held) > 2
    assert out.accepted >= 85 and min(out.held) < out.accepted
    assert out.unpaired == out.free.count() == len(set(hot + cool)) - 2 * out.accepted


def test_pair_sample(spark):
    texts = random_pool(40, 10, 1)
    pool = spark.createDataFrame(list(enumerate(texts)), "idx long, sequence string")
    for size in (50, 500, 780, 10_000):
        rows = cal.sample_pairs(pool, size, 5).collect()
        pairs = {(r.left_index, r.right_index) for r in rows}
        assert len(rows) == len(pairs) == min(size, 780)
        assert all(0 <= i < j < 40 for i, j in pairs)
        assert all(texts[r.left_index] == r.left_sequence and rc(texts[r.right_index]) == r.partner for r in rows)


def test_histogram_fills_gaps(spark):
    rows = [(0, 1, 3, 5.0, True), (0, 2, 3, -1.0, False), (1, 2, 1, -1.0, False)]
    metrics = spark.createDataFrame(rows, "l long, r long, anchored_run_length int, tm double, is_conflict boolean")
    got = [tuple(r) for r in cal.run_histogram(metrics).orderBy("anchored_run_length").collect()]
    assert got == [(0, 0, 0, None), (1, 1, 0, 0.0), (2, 0, 0, None), (3, 2, 1, 0.5)]
    assert cal.conflict_rates(metrics).first().conflict_probability == 1 / 3


def test_retained_share_is_what_random_graphs_keep_at_least():
    rng = random.Random(0)
    for degree, size in ((1.5, 60), (6.0, 80)):
        kept = 0
        for _ in range(20):
            edges = [(i, j) for i in range(size) for j in range(i + 1, size) if rng.random() < degree / (size - 1)]
            kept += len(greedy_set([f"{i:06d}" for i in range(size)], edges)) / size / 20
        assert 0.4 * kept < cal.retained_share(degree) <= kept
    assert cal.retained_share(0.0) == 1.0


def test_search_size():
    assert cal.search_size(50, 0.0) == 50
    size = cal.search_size(20, 0.01)
    assert size * cal.retained_share(0.01 * (size - 1)) >= 20
    assert (size - 1) * cal.retained_share(0.01 * (size - 2)) < 20
    assert cal.search_size(100, 0.01) == math.inf
    assert cal.gc_space(4, 0.5, 0.5) == 6 * 16


@pytest.mark.parametrize("head_size", [1, 5])
def test_pruning_keeps_only_the_last_table_of_numbers(spark, monkeypatch, tmp_path, head_size):
    """What is left of the conflicts is stored as two numbers, and the tables before it go."""
    monkeypatch.setattr("oligoloom.storage.scratch_dir", lambda _: str(tmp_path))
    rng, texts = random.Random(5), random_pool(40, 6, 5)
    edges = [(i, j) for j in range(40) for i in range(j) if rng.random() < 0.3]
    removed = {r.idx for r in greedy_removals(edge_frame(spark, texts, edges), head_size).collect()}
    assert removed == set(range(40)) - greedy_set(texts, edges)
    tables = [p for kind in ("conflicts", "settled") for p in tmp_path.glob(f"{kind}-*")]
    assert len(tables) <= 1
    assert all(spark.read.parquet(str(p)).dtypes == [("node", "bigint"), ("other", "bigint")] for p in tables)


def tables_of(monkeypatch, module=prune):
    labels, keep = [], module.materialize
    monkeypatch.setattr(module, "materialize", lambda rows, label: labels.append(label) or keep(rows, label))
    return labels


@pytest.mark.parametrize("limit", [30, 150])
def test_steps_are_bounded_by_conflicts_and_take_pairs_of_indexes(spark, monkeypatch, limit):
    """No sequences travel with the conflicts, and a step never has more of these than its bound; equal sequences too."""
    monkeypatch.setattr(prune, "SAFE_HEAD_SIZE", 3)
    monkeypatch.setattr(prune, "HEAD_CONFLICTS", limit)
    rng, texts = random.Random(limit), random_pool(60, 6, 8)
    texts[7], texts[20] = texts[3], texts[30]
    edges = [(i, j) for j in range(60) for i in range(j) if rng.random() < 0.25]
    # In order of sequences, then indexes, equal ones differ.
    want = set(range(60)) - greedy_set([f"{t}{i:02d}" for i, t in enumerate(texts)], edges)
    pool = spark.createDataFrame(list(enumerate(texts)), "idx long, sequence string")
    pairs = storage.materialize(spark.createDataFrame(edges, "left_index long, right_index long"), "pairs")
    inside, keep = [], prune._turn_victims
    monkeypatch.setattr(prune, "_turn_victims", lambda *a: inside.append(a[2].count()) or keep(*a))
    removed = [r.idx for r in greedy_removals(pairs, rounds=0, pool=pool).collect()]
    assert len(removed) == len(set(removed)) and set(removed) == want
    assert len(inside) > 2 and max(inside) <= limit
    assert pairs.count() == len(edges)


def test_rounds_that_wait_for_each_other_take_few_tables(spark, monkeypatch):
    """A star at every place of a path, one leaf more than the star before it: one oligo falls after the other."""
    labels = tables_of(monkeypatch)
    edges, leaf = [(i, i + 1) for i in range(19)], 20
    for centre in range(20):
        edges += [(centre, leaf + n) for n in range(centre)]
        leaf += centre
    texts = random_pool(leaf, 8, 4)
    want = set(range(leaf)) - greedy_set(texts, edges)
    assert {r.idx for r in greedy_removals(edge_frame(spark, texts, edges), 1).collect()} == want
    assert len(labels) < 8 and "settled" not in labels


@pytest.mark.parametrize("rows,conflicts", [(40, 4_000_000), (100, 60)])
def test_rounds_over_several_tasks(spark, monkeypatch, rows, conflicts):
    """Every task decides what it can by the degrees that it was told."""
    monkeypatch.setattr(prune, "ROUND_ROWS", rows)
    monkeypatch.setattr(prune, "ROUND_CONFLICTS", conflicts)
    monkeypatch.setattr(prune, "SAFE_HEAD_SIZE", 10)
    rng, texts = random.Random(rows), random_pool(50, 6, rows)
    edges = [(i, j) for j in range(50) for i in range(j) if rng.random() < 0.15]
    removed = [r.idx for r in greedy_removals(edge_frame(spark, texts, edges), 1).collect()]
    assert len(removed) == len(set(removed)) and set(removed) == set(range(50)) - greedy_set(texts, edges)


def test_a_head_with_too_many_conflicts_is_taken_smaller(spark, monkeypatch):
    monkeypatch.setattr("oligoloom.operators.prune.SAFE_HEAD_SIZE", 4)
    monkeypatch.setattr("oligoloom.operators.prune.HEAD_CONFLICTS", 10)
    texts = random_pool(12, 6, 3)
    edges = [(i, j) for j in range(12) for i in range(j)]
    frame = edge_frame(spark, texts, edges)
    assert head_victims(both_directions(frame), 11).count() <= 4
    assert {r.idx for r in greedy_removals(frame, 11).collect()} == set(range(12)) - greedy_set(texts, edges)


def test_pairing_scores_what_can_still_be_made(spark, monkeypatch):
    """Draws of oligos that an earlier layer took, and swaps of couples that are settled, are not scored; the pairs are those
    of drawing in turn, with stretches of a few swaps, ranges of a few hashes and joins of either kind."""
    for name, value in dict(LEAST_SWAPS=6, SWAPS_PER_COUPLE=1, RANKED_ROWS=4).items():
        monkeypatch.setattr(pairing, name, value, raising=False)
    rng = random.Random(11)
    texts = ["GCGCGGCC" + "".join(rng.choice("ACGT") for _ in range(4)) for _ in range(40)]
    texts = sorted(set(texts + random_pool(60, 12, 10)))
    limit = -20.0

    def score(a, b):
        size, start, _ = best_run(a, b, len(a))
        return tm(a[start : start + size]) if size >= 4 else -math.inf

    fits = lambda a, b: max(score(a, b), score(b, a)) <= limit
    rules = PairRules(12, limit).anywhere()
    pool = spark.createDataFrame([(t,) for t in texts], "sequence string")
    for keys, target in ((0, len(texts) // 2), (100, 44)):
        monkeypatch.setattr(pairing, "BROADCAST_KEYS", keys, raising=False)
        scored = []

        def spy(rows, *rest, score=pairing.sense_pair_scores):
            out = score(rows, *rest)
            scored.append(out.where("left_sequence is not null").count())
            return out

        with monkeypatch.context() as during:
            during.setattr(pairing, "sense_pair_scores", spy)
            out = pair_oligos(pool, rules, PairingOptions(target, seed=5, stagnation_attempts=20, requeue_scale=0.0))
        pairs, free, attempts, _, _ = pair_in_turn(texts, fits, seed=5, target=target, stagnation=20, multiplier=50, scale=0.0)
        assert {(r.left_sequence, r.right_sequence) for r in out.pairs.collect()} == pairs
        assert out.attempts == attempts and out.free.count() == len(free)
        assert scored[0] == len(texts) // 2 and sum(scored[:4]) < len(texts)

        out = pair_oligos(pool, rules, PairingOptions(target, seed=5, stagnation_attempts=20))
        pairs, free, *counts = pair_in_turn(texts, fits, seed=5, target=target, stagnation=20, multiplier=50, scale=1.0)
        assert {(r.left_sequence, r.right_sequence) for r in out.pairs.collect()} == pairs
        assert {r.sequence for r in out.free.collect()} == free
        assert [out.attempts, out.rejected, out.recycled] == counts


def test_swaps_are_scored_in_one_step(spark):
    texts = random_pool(24, 12, 3)
    rules = PairRules(12, -20.0, min_run=3, gate=5).anywhere()
    rows = [(i, i, i, *texts[4 * i : 4 * i + 4]) for i in range(6)]
    tries = spark.createDataFrame(rows, "order long, couple long, pair long, u string, v string, a string, b string")
    got = {r.order: r for r in pairing.score_swaps(tries, rules).collect()}

    def scores(x, y):
        size = [best_run(a, b, 12)[:2] for a, b in ((x, y), (y, x))]
        temps = [tm(a[start : start + n]) if n >= 5 else -math.inf for (n, start), a in zip(size, (x, y))]
        return temps, sum(3 <= n < 5 for n, _ in size)

    for order, _, _, u, v, a, b in rows:
        sides = {side: scores(*side) for side in ((u, a), (v, b), (u, b), (v, a))}
        ways = [w for w in (((u, a), (v, b)), ((u, b), (v, a))) if all(max(sides[x][0]) <= -20.0 for x in w)]
        want = [(*x, *sides[x][0], max(sides[x][0])) for x in ways[0]] if ways else None
        found = got[order].pairs
        assert got[order].fits == bool(ways) and got[order].shortcircuited == sum(n for _, n in sides.values())
        assert (found and [(p.left_sequence, p.right_sequence) for p in found]) == (want and [w[:2] for w in want])
        assert not want or all(tuple(p)[2:] == pytest.approx(w[2:]) for p, w in zip(found, want))
