import math

import pytest
from plain import has_tandem, longest_stem, random_pool, rc, tm
from pyspark.sql import functions as F

from oligoloom.functions import motifs as mo
from oligoloom.functions import sequence as sq
from oligoloom.operators.motif_list import motif_table, with_listed_motif
from oligoloom.functions.melting import Chemistry, with_intrinsic_tm, with_tm
from oligoloom.sources.proposals import attempts, enumerate_sequences, propose


def frame(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "s string")


def test_reverse_complement_and_codes(spark):
    texts = ["AAGC", "ACGT", "TTTT", "A", "GATTACA", "T" * 31, "C" + "A" * 30]
    rows = frame(spark, texts).withColumn("code", sq.pack(F.col("s")))
    out = rows.select(
        "s",
        "code",
        sq.reverse_complement(F.col("s")).alias("rc"),
        sq.decode(F.col("code"), F.length("s")).alias("back"),
    ).collect()
    for row in out:
        assert row.rc == rc(row.s)
        assert row.back == row.s
        assert row.code == int("".join("0123"["ACGT".index(b)] for b in row.s), 4)
    assert {r.s: r.rc for r in out}["AAGC"] == "GCTT"


def test_gc_rules(spark):
    texts = ["GCGCATATA", "GCGCGATAT", "GCGCGGATA", "ATATATATA"]
    at_nine = frame(spark, texts).select("s", sq.gc_fraction(F.col("s")).alias("f"),
        sq.gc_embeddable(sq.gc_count(F.col("s")), 9, 9, 0.45, 0.55).alias("ok")).collect()
    # Nine bases: 4 to 5 GC.
    assert {r.s: r.ok for r in at_nine} == {"GCGCATATA": True, "GCGCGATAT": True, "GCGCGGATA": False, "ATATATATA": False}
    assert at_nine[0].f == 4 / 9
    texts = ["ACGCACGCG", "CGCACGCGA", "GCCGCACGT", "GCGCGCGCGCGCG"]
    in_twenty = frame(spark, texts).select(
        "s", sq.gc_embeddable(sq.gc_count(F.col("s")), F.length("s"), 20, 0.45, 0.55).alias("ok")).collect()
    assert [r.ok for r in in_twenty] == [True, True, True, False]
    assert sq.gc_bounds(10, 0.45, 0.55) == (4, 6)


def test_three_prime_starts_and_kmers(spark):
    assert list(sq.three_prime_starts(20, 8, 3)) == [10, 11, 12]
    assert list(sq.three_prime_starts(8, 8, 3)) == [0]
    assert not sq.three_prime_starts(8, 9, 3) and not sq.three_prime_starts(8, 0, 3)
    words = frame(spark, ["AAAAC"]).select(sq.kmers("s", 3, 5).alias("w"), sq.kmers("s", 6, 5).alias("none")).first()
    assert words.w == ["AAA", "AAC"] and words.none == []


def test_input_guard(spark):
    out = frame(spark, ["ACGT", "ACGN", "acgt", ""]).select(sq.is_dna(F.col("s")), sq.is_dna(F.col("s"), 4)).collect()
    assert [tuple(r) for r in out] == [(True, True), (False, False), (False, False), (False, False)]


@pytest.mark.parametrize("length", [2, 7, 20, 31, 32, 45, 70])
@pytest.mark.parametrize("magnesium", [0.0, 1.5])
def test_melting_temperature(spark, length, magnesium):
    texts = random_pool(10, length, length)
    rows = frame(spark, texts).withColumn("code", sq.pack(F.substring("s", 1, 31)))
    chemistry = Chemistry(300.0, 60.0, magnesium)
    layout = {"packed": "code"} if length <= 31 else {}
    rows = with_tm(rows, "s", "fixed", length, chemistry, fixed=True, **layout)
    rows = with_tm(rows, "s", "free", 75, chemistry)
    for row in rows.collect():
        want = tm(row.s, 300.0, 60.0, magnesium)
        assert math.isclose(row.fixed, want, rel_tol=1e-9) and math.isclose(row.free, want, rel_tol=1e-9)


def test_known_temperatures(spark):
    rows = frame(spark, ["AAAACCCC", "GGGG", "GC" * 10, "GCGCGATATATATATATATA", "A"])
    got = {r.s: r.t for r in with_intrinsic_tm(rows, "s", "t", 20, Chemistry()).collect()}
    want = {"AAAACCCC": 14.4768, "GGGG": -35.6027, "GC" * 10: 80.0948, "GCGCGATATATATATATATA": 41.4514}
    assert got.pop("A") == -math.inf
    assert {k: round(v, 4) for k, v in got.items()} == want
    rows = frame(spark, ["CGTTCCAAAGATGTGGGCATGAGCTTAC"])
    assert round(with_intrinsic_tm(rows, "s", "t", 28, Chemistry(25.0)).first().t, 2) == 60.32


@pytest.mark.parametrize("length", [10, 20, 40])
def test_repeats(spark, length):
    texts = random_pool(400, length, 3, "ACG")
    rows = frame(spark, texts)
    packed = None
    if length <= 31:
        rows, packed = rows.withColumn("p", sq.pack(F.col("s"))), F.col("p")
    cases = [(u, c) for u in (1, 2, 3) for c in (2, 3, 4)]
    tests = [mo.tandem_repeat(F.col("s"), length, u, c, packed).alias(f"t{u}{c}") for u, c in cases]
    for row in rows.select("s", *tests).collect():
        for u, c in cases:
            assert row[f"t{u}{c}"] == has_tandem(row.s, u, c)


@pytest.mark.parametrize("length", [9, 12, 20])
def test_self_stems(spark, length):
    texts = random_pool(400, length, 4)
    rows = frame(spark, texts).withColumn("r", sq.reverse_complement(F.col("s")))
    cases = [(stem, gap) for stem in (2, 3, 4, 5, 8) for gap in (0, 1, 2, 3)]
    tests = [mo.self_stem("s", "r", length, stem, gap).alias(f"t{stem}_{gap}") for stem, gap in cases]
    for row in rows.select("s", *tests).collect():
        for stem, gap in cases:
            assert row[f"t{stem}_{gap}"] == (longest_stem(row.s, gap) >= stem), (row.s, stem, gap)


def test_palindrome_counts_through_its_centre_only_without_gap(spark):
    rows = frame(spark, ["ACCGTTAACGGT"]).withColumn("r", sq.reverse_complement(F.col("s")))
    row = rows.select(
        mo.self_stem("s", "r", 12, 12, 0).alias("whole"),
        mo.self_stem("s", "r", 12, 5, 2).alias("five"),
        mo.self_stem("s", "r", 12, 6, 2).alias("six"),
    ).first()
    assert (row.whole, row.five, row.six) == (True, True, False)


def test_enumeration(spark):
    rows = enumerate_sequences(spark, 3).orderBy("id").collect()
    assert [r.sequence for r in rows] == [a + b + c for a in "ACGT" for b in "ACGT" for c in "ACGT"]
    assert enumerate_sequences(spark, 4).select(sq.pack(F.col("sequence")).alias("p"), "id").where("p <> id").count() == 0


def test_proposals(spark):
    one = propose(attempts(spark, 1, 3000), 7, 20, 0.45, 0.55)
    rows = one.collect()
    assert [r.attempt_id for r in rows] == list(range(1, 3001))
    gc = [sum(b in "GC" for b in r.sequence) for r in rows]
    assert {len(r.sequence) for r in rows} == {20} and set(gc) == {9, 10, 11}
    assert all(900 < gc.count(v) < 1100 for v in (9, 10, 11))
    for place in range(20):
        share = [sum(r.sequence[place] == b for r in rows) / 3000 for b in "ACGT"]
        assert all(0.21 < s < 0.29 for s in share), (place, share)
    # Any range gives the same rows again, another seed gives others.
    again = {r.attempt_id: r.sequence for r in propose(attempts(spark, 1000, 1010), 7, 20, 0.45, 0.55).collect()}
    assert all(rows[a - 1].sequence == s for a, s in again.items()) and len(again) == 11
    other = propose(attempts(spark, 1, 50), 8, 20, 0.45, 0.55).collect()
    assert sum(a.sequence == b.sequence for a, b in zip(rows, other)) == 0


@pytest.mark.parametrize("length", [1, 2, 7, 12, 31])
@pytest.mark.parametrize("gap", [0, 2])
def test_longest_self_run(spark, length, gap):
    texts = ["ACCGTTAACGGT"[:length].ljust(length, "A"), "GC" * (length // 2) + "G" * (length % 2), "A" * length]
    texts = sorted(set(texts + random_pool(min(30, 2**length), length, 7, "AT" if length < 7 else "ACGT")))
    rows = frame(spark, texts).select(
        "s", sq.pack(F.col("s")).alias("code"), sq.pack(sq.reverse_complement(F.col("s"))).alias("rc")
    )
    for row in rows.withColumn("run", mo.longest_self_run("code", "rc", length, gap)).collect():
        assert row.run == longest_stem(row.s, gap), row.s


def test_motifs_from_a_table(spark):
    texts = random_pool(60, 12, 4)
    candidates = spark.createDataFrame(list(enumerate(texts)), "attempt_id long, sequence string")
    given = [("gat",), ("ACGTA",), (None,), ("",), ("CC",), ("A" * 13,), ("GAT",)]
    table = motif_table(spark.createDataFrame(given, "motif string"), "motif")
    motifs = {w for m, in given if m for w in (m.upper(), rc(m.upper()))}
    assert sorted(r.motif for r in table.collect()) == sorted(motifs)
    got = with_listed_motif(candidates, table, 12).collect()
    want = [(i, t) for i, t in enumerate(texts) if any(m in t for m in motifs)]
    assert sorted(map(tuple, got)) == want
    assert with_listed_motif(candidates, table.limit(0), 12).count() == 0


def test_the_plan_does_not_grow_with_the_motifs(spark):
    candidates = spark.createDataFrame([(0, "ACGTACGTACGT")], "attempt_id long, sequence string")
    sizes = []
    for count in (5, 500):
        motifs = spark.range(count).selectExpr("translate(substr(md5(string(id)), 1, 6), '0123456789abcdef', 'ACGTACGTACGTACGT') as m")
        plan = with_listed_motif(candidates, motif_table(motifs, "m"), 12)._jdf.queryExecution().optimizedPlan()
        sizes.append(plan.toString().count("\n"))
    assert sizes[0] == sizes[1]
