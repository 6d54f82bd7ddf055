import math

import pytest
from plain import best_run, conflicts, random_pool, rc, tm
from pyspark.sql import functions as F

from oligoloom.functions.melting import Chemistry, with_tm
from oligoloom.functions.runs import with_best_run
from oligoloom.operators.conflicts import (
    PairRules,
    candidate_pairs,
    conflict_degrees,
    conflict_edges,
    conflict_pairs,
    score_pairs,
    sense_conflicts,
    sense_pair_scores,
)
from oligoloom.operators import pair_counts
from oligoloom.operators.pair_counts import candidate_pair_count, pair_accounting, pair_slots
from oligoloom.functions.runs import best_meetings
from oligoloom.operators.pairing import propose_pairs, score_proposals
from oligoloom.operators import skew
from oligoloom.operators.skew import grid_join, heavy_keys


def pool_frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "idx long, sequence string")


def pair_frame(spark, pairs):
    return spark.createDataFrame([(a, rc(b)) for a, b in pairs], "left_sequence string, partner string")


@pytest.mark.parametrize("length,window,alphabet", [(8, 3, "ACGT"), (20, 3, "ACGT"), (20, 20, "AC"), (7, 1, "AC"), (33, 5, "ACGT")])
def test_best_run(spark, length, window, alphabet):
    texts = random_pool(60, length, length + window, alphabet)
    rows = [(a, b) for a, b in zip(texts, texts[1:] + texts[:1])] + [(texts[0], rc(texts[0]))]
    pairs = spark.createDataFrame(rows, "a string, b string")
    for row in with_best_run(pairs, "a", "b", length, window).collect():
        assert (row.run_length, row.run_start, row.run_offset) == best_run(row.a, row.b, window)


def test_ties_take_the_smallest_offset_then_start(spark):
    # Two runs of three; the one further left in the partner wins.
    row = with_best_run(spark.createDataFrame([("AAACCC", "CCCAAA")], "a string, b string"), "a", "b", 6, 6).first()
    assert (row.run_length, row.run_start, row.run_offset) == (3, 3, -3)


def test_score_records(spark):
    pairs = [("AAAACCCC", "GGGGTTTT"), ("CCCCGGGG", "GGGGTTTT")]
    first, second = score_pairs(pair_frame(spark, pairs), PairRules(8)).collect()
    assert first.run_length == 8 and math.isclose(first.run_tm_c, tm("AAAACCCC"))
    assert second.run_tm_c == -math.inf and second.run_below_min
    gated = score_pairs(pair_frame(spark, pairs[:1]), PairRules(8, gate=9)).first()
    assert (gated.run_length, gated.run_tm_c, gated.run_shortcircuited, gated.run_evaluated) == (8, -math.inf, True, False)


def vector_steps(rows):
    return rows._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")


def test_given_pairs_are_scored_a_block_at_a_time(spark):
    """No search in the row: one vector step finds the run and its temperature, for every window and length."""
    for length, window in ((20, 3), (20, 20), (300, 40)):
        texts = random_pool(12, length, length)
        pairs = [(a, b) for a in texts[:4] for b in texts] + [(texts[0], rc(texts[0]))]
        rows = score_pairs(pair_frame(spark, pairs), PairRules(length, window=window, gate=5))
        assert vector_steps(rows) == 1
        for row in rows.collect():
            size, start, offset = best_run(row.left_sequence, row.partner, window)
            assert (row.run_length, row.run_start, row.run_offset) == (size, start, offset)
            text = row.left_sequence[start : start + size]
            assert row.run_sequence == text and row.run_evaluated == (size >= 5)
            assert math.isclose(row.run_tm_c, tm(text) if size >= 5 else -math.inf, rel_tol=1e-12)


def test_pairs_without_a_text_have_no_run(spark):
    rows = spark.createDataFrame([("ACGTACGT", None), (None, "ACGTACGT"), (None, None)], "left_sequence string, partner string")
    for row in score_pairs(rows, PairRules(8)).collect():
        assert (row.run_length, row.run_start, row.run_offset, row.run_tm_c) == (0, 0, None, -math.inf)
        assert row.run_below_min and not row.run_evaluated


def test_temperatures_of_runs_are_those_of_the_column_expression(spark):
    texts = random_pool(40, 20, 77)
    pairs = spark.createDataFrame([(a, b) for a in texts for b in texts], "left_sequence string, partner string")
    rows = with_tm(score_pairs(pairs, PairRules(20, window=20)), "run_sequence", "want", 20, Chemistry())
    assert rows.where("run_evaluated").count() > 500 and rows.where("run_evaluated and run_tm_c <> want").isEmpty()


def test_draws_are_scored_in_one_step(spark):
    """Rounds of pairing score what they draw by the search over batches, both directions at once."""
    texts = random_pool(40, 20, 13)
    rules = PairRules(20).anywhere(limit_c=-30.0)
    drawn = propose_pairs(pool_frame(spark, texts), 40, 1, 1)
    assert vector_steps(score_proposals(drawn, rules)) == 1
    rows = score_proposals(drawn, rules).collect()
    assert len(rows) == 20
    for row in rows:
        for a, b, got in (
            (row.left_sequence, row.right_sequence, row.left_vs_right_sense_tm_c),
            (row.right_sequence, row.left_sequence, row.right_vs_left_sense_tm_c),
        ):
            size, start, _ = best_run(a, b, 20)
            assert math.isclose(got, tm(a[start : start + size]) if size >= 4 else -math.inf, rel_tol=1e-12)


def test_sense_scores(spark):
    rows = spark.createDataFrame([("CCCCGGGG", "GGGGTTTT")], "left_sequence string, right_sequence string")
    row = sense_pair_scores(rows, PairRules(8)).first()
    assert row.fwd_length == 4 and row.fwd_tm_c > -math.inf
    assert row.pair_tm_c == max(row.fwd_tm_c, row.rev_tm_c)


def test_both_sense_directions_come_from_one_step(spark):
    texts = random_pool(12, 20, 3)
    rows = spark.createDataFrame([(a, b) for a in texts for b in texts], "left_sequence string, right_sequence string")
    scored = sense_pair_scores(rows, PairRules(20))
    assert vector_steps(scored) == 1
    for row in scored.collect():
        a, b = row.left_sequence, row.right_sequence
        assert (row.fwd_length, row.fwd_start, row.fwd_offset) == best_run(a, b, 20)
        assert (row.rev_length, row.rev_start, row.rev_offset) == best_run(b, a, 20)


CASES = [
    (20, 3, 4, 0, 20.0),
    (20, 3, 4, 8, 20.0),
    (20, 1, 3, 0, 10.0),
    (12, 12, 4, 0, 5.0),
    (36, 4, 6, 0, 25.0),
    (40, 3, 4, 0, 70.0),
    (10, 3, 2, 0, -200.0),
]


def related_pool(count, length, seed):
    """A random pool in which some oligos hold long pieces of others' reverse complements."""
    texts = random_pool(count, length, seed)
    for i in range(0, count - 1, 4):
        cut = length // 2 + i % (length // 2)
        texts[i + 1] = (rc(texts[i])[:cut] + texts[i + 1])[:length]
    return list(dict.fromkeys(texts))


@pytest.mark.parametrize("length,window,min_run,gate,limit", CASES)
def test_conflict_edges_against_all_pairs(spark, length, window, min_run, gate, limit):
    texts = related_pool(60, length, length + window)
    want = conflicts(texts, window, min_run, gate, limit)
    rules = PairRules(length, limit, window, min_run, gate)
    for cell in (4_000_000, 1):
        got = conflict_edges(pool_frame(spark, texts), rules, cell_matches=cell).collect()
        assert {(r.left_index, r.right_index) for r in got} == set(want) and len(got) == len(want)
        for r in got:
            assert math.isclose(r.tm_c, want[r.left_index, r.right_index], rel_tol=1e-9)
            assert (r.left_sequence, r.right_sequence) == (texts[r.left_index], texts[r.right_index])
    assert want, "the case should have conflicts"


@pytest.mark.parametrize("length,window,min_run,gate,limit", CASES)
def test_conflict_pairs_are_those_of_the_edges(spark, length, window, min_run, gate, limit):
    texts = related_pool(60, length, length + window)
    want = conflicts(texts, window, min_run, gate, limit)
    for cell in (4_000_000, 1):
        rows = conflict_pairs(pool_frame(spark, texts), PairRules(length, limit, window, min_run, gate), cell_matches=cell)
        assert rows.columns == ["left_index", "right_index"]
        assert sorted(tuple(r) for r in rows.collect()) == sorted(want)


def test_conflicts_depend_on_direction(spark):
    texts = related_pool(80, 20, 5)
    rules = PairRules(20, 20.0)
    forward = {(r.left_index, r.right_index) for r in conflict_edges(pool_frame(spark, texts), rules).collect()}
    backward = conflict_edges(pool_frame(spark, texts[::-1]), rules).collect()
    mirrored = {(len(texts) - 1 - r.right_index, len(texts) - 1 - r.left_index) for r in backward}
    assert forward != mirrored


def test_only_pairs_with_a_new_member(spark):
    texts = related_pool(60, 20, 9)
    rules, pool = PairRules(20, 15.0), pool_frame(spark, texts)
    everything = {(r.left_index, r.right_index) for r in conflict_edges(pool, rules).collect()}
    some = {(r.left_index, r.right_index) for r in conflict_edges(pool, rules, first_new=30).collect()}
    assert some == {(i, j) for i, j in everything if j >= 30} and some != everything
    four = pool_frame(spark, ["AAAA", "AAAT", "AATA", "TTTT"])
    assert pair_slots(four, first_new=2).first().pair_slots == 5


def test_sense_conflicts(spark):
    texts = related_pool(40, 20, 2)
    want = set()
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            size, start, _ = best_run(a, b, 20)
            if i != j and size >= 4 and tm(a[start : start + size]) > -5.0:
                want.add((i, j))
    got = sense_conflicts(pool_frame(spark, texts), PairRules(20, -5.0)).collect()
    assert {(r.left_index, r.right_index) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("length,window,k", [(20, 3, 4), (20, 3, 8), (20, 1, 3), (12, 5, 4), (12, 12, 4), (9, 3, 2), (8, 3, 8), (8, 3, 9)])
def test_candidates_and_their_count(spark, length, window, k):
    texts = related_pool(50, length, k)
    want = {
        (i, j) for j, b in enumerate(texts) for i, a in enumerate(texts[:j]) if k <= length and best_run(a, rc(b), window)[0] >= k
    }
    rules, pool = PairRules(length, window=window), pool_frame(spark, texts)
    for cell in (4_000_000, 1):
        got = [(r.left_index, r.right_index) for r in candidate_pairs(pool, k, rules, cell_matches=cell).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    newer = sum(j >= 20 for _, j in want)
    for bits in (16, 2):
        assert candidate_pair_count(pool, k, rules, range_bits=bits).first().pairs == len(want)
        assert candidate_pair_count(pool, k, rules, first_new=20, range_bits=bits).first().pairs == newer


@pytest.mark.parametrize("first_new", [None, 0, 30, 59])
def test_pairs_counted_in_cells(spark, monkeypatch, first_new):
    """Sparse positions, several blocks, one very common word."""
    monkeypatch.setattr(pair_counts, "BLOCK_OLIGOS", 16)
    monkeypatch.setattr(pair_counts, "_MARKS", 50)
    texts = [t if n % 3 else "ACGTACGT" + t[8:] for n, t in enumerate(related_pool(60, 12, 4))]
    rules = PairRules(12, window=9)
    pool = spark.createDataFrame([(7 * i, t) for i, t in enumerate(texts)], "idx long, sequence string")
    new = 0 if first_new is None else first_new
    want = sum(
        best_run(a, rc(b), 9)[0] >= 4 for j, b in enumerate(texts) if j >= new for a in texts[:j]
    )
    bound = None if first_new is None else 7 * first_new
    found = candidate_pair_count(pool, 4, rules, first_new=bound)
    assert found.first().pairs == want
    assert candidate_pair_count(pool.limit(0), 4, rules).first().pairs == 0


def test_repetitive_words_count_once(spark):
    texts = ["AAAAAAAA", "TTTTTTTT", "AAAATTTT", "TTTTAAAA", "ATATATAT", "TATATATA"]
    pool, rules = pool_frame(spark, texts), PairRules(8)
    for k in (2, 3, 4):
        want = sum(best_run(a, rc(b), 3)[0] >= k for j, b in enumerate(texts) for a in texts[:j])
        assert candidate_pair_count(pool, k, rules).first().pairs == want


def test_accounting(spark):
    row = pair_accounting(pool_frame(spark, ["AAAA", "CCCC"]), PairRules(4)).first()
    assert tuple(row) == (1, 1, 0, 0)
    row = pair_accounting(pool_frame(spark, ["AAAACCCC", "GGGGAAAA"]), PairRules(8, gate=6)).first()
    assert tuple(row) == (1, 0, 1, 0)


def test_heavy_key_grid(spark):
    """One key holds a third of the rows on both sides."""
    left = spark.range(900).select(F.col("id").alias("a"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("key"))
    right = spark.range(600).select(F.col("id").alias("b"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("key"))
    heavy = heavy_keys(left, right, "key", 100)
    assert [tuple(r) for r in heavy.collect()] == [(0, 30, 20)]
    split = grid_join(left, right, "key", "a", "b", cell_matches=100)
    assert split.count() == 300 * 200 + sum(i % 3 != 0 for i in range(600))
    assert split.exceptAll(left.join(right, "key").select(split.columns)).count() == 0


def test_degrees(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2)], "left_index long, right_index long")
    assert {(r.idx, r.degree) for r in conflict_degrees(edges).collect()} == {(0, 1), (1, 2), (2, 1)}


def test_minimum_run_has_to_be_positive():
    with pytest.raises(ValueError):
        PairRules(20, min_run=0)
    assert PairRules(20, chemistry=Chemistry()).anywhere(30.0, 7).window == 20


@pytest.mark.parametrize("k,window", [(4, 9), (8, 9), (33, 40)])
def test_cells_get_bases_not_words(spark, monkeypatch, tmp_path, k, window):
    """Both scopes in one pass, short, long and unpackable words; an oligo takes no more than its bases on the way."""
    monkeypatch.setattr(pair_counts, "BLOCK_OLIGOS", 16)
    monkeypatch.setattr(pair_counts, "STRIPES", 2)
    length = 20 if k < 20 else 48
    texts = [t if n % 5 else rc(related_pool(60, length, 4)[n // 2]) for n, t in enumerate(related_pool(60, length, 4))]
    rules, pool = PairRules(length, window=window), pool_frame(spark, texts)
    want = [(i, j) for j, b in enumerate(texts) for i, a in enumerate(texts[:j]) if best_run(a, rc(b), window)[0] >= k]
    counts = pair_counts.candidate_pair_counts(pool, k, rules, first_new=41)
    assert tuple(counts.first()) == (len(want), sum(j >= 41 for _, j in want)) and want
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(words" not in plan and "bases" in plan


def test_tasks_of_a_join_follow_its_matches(spark, monkeypatch):
    """Few rows, many matches: more tasks than the usual number, each with its share."""
    monkeypatch.setattr("oligoloom.operators.skew.MATCHES_PER_TASK", 1000)
    left = spark.range(2000).select(F.col("id").alias("a"), (F.col("id") % 50).alias("key"))
    right = spark.range(2000).select(F.col("id").alias("b"), (F.col("id") % 50).alias("key"))
    joined = grid_join(left, right, "key", "a", "b", cell_matches=500)
    assert joined.rdd.getNumPartitions() == 80
    shares = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(shares) == 80_000 and max(shares) < 8_000


def test_cells_are_no_smaller_than_a_share_of_the_matches(spark, monkeypatch):
    """Rows of a heavy key are copied along its grid, and no more often than there are tasks that can use it."""
    sides, keep = [], skew._heavy
    monkeypatch.setattr(skew, "_heavy", lambda *a: sides.append(keep(*a)) or sides[-1])
    left = spark.range(2000).select(F.col("id").alias("a"), (F.col("id") % 2).alias("key"))
    right = left.withColumnRenamed("a", "b")
    joined = grid_join(left, right, "key", "a", "b", cell_matches=100)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert all(r["__lp"] * r["__rp"] <= 2 * tasks for r in sides[-1].collect()) and sides[-1].count() == 2
    assert joined.count() == joined.select("a", "b").distinct().count() == 2_000_000


@pytest.mark.parametrize("window", [3, 12])
def test_best_meetings(spark, window):
    """A meeting stays, with the length of its run, if no admissible run of the pair is longer."""
    texts = related_pool(24, 12, 4)
    ends = [
        (a, b, i, j) for a in texts for b in texts[:8] for i in range(12 - window, 12) for j in range(12) if a[i] == b[j]
    ]
    met = spark.createDataFrame(ends, "a string, b string, i int, j int")
    want = set()
    for a, b, i, j in ends:
        run = next((n for n in range(min(i, j) + 1) if a[i - n] != b[j - n]), min(i, j) + 1)
        if run == best_run(a, b, window)[0]:
            want.add((a, b, i, j, run))
    got = best_meetings(met, "a", "b", "i", "j", 12, window, "run")
    assert {tuple(r) for r in got.select("a", "b", "i", "j", "run").collect()} == want
