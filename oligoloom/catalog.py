"""Named queries over the keyed tables; each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oligoloom.functions import motifs as mo
from oligoloom.functions import sequence as sq
from oligoloom.functions.melting import Chemistry, with_intrinsic_tm
from oligoloom.functions.staging import stage
from oligoloom.operators import calibrate as cal
from oligoloom.operators import conflicts as co
from oligoloom.operators import funnel as fu
from oligoloom.operators import pair_counts as pc
from oligoloom.operators import prune as pr
from oligoloom.operators.accept import oligo_records, output_rows, with_position
from oligoloom.operators.gate import gate_lengths
from oligoloom.operators.key_index import KeyIndex
from oligoloom.operators.motif_list import motif_table, with_listed_motif
from oligoloom.operators.pairing import PairingOptions, pair_oligos, propose_pairs, score_proposals
from oligoloom.operators.prefix import accept_to_cut
from oligoloom.operators.rolling import rolling_share
from oligoloom.plans.gather import next_batch
from oligoloom.sources.proposals import enumerate_sequences, propose
from oligoloom.sources.tables import customer_candidates, dna_from_key, line_candidates, order_candidates, table
from oligoloom.storage import materialize, scratch_dir

# The settings of the demonstration run: 20-mers, 60-65 C, conflicts above 40 C, 500 nM.
LENGTH = 20
GC_BOUNDS = (0.45, 0.55)
CHEMISTRY = Chemistry(strand_nm=500.0, monovalent_mm=50.0, magnesium_mm=0.0)
FUNNEL = fu.FunnelSettings(
    length=LENGTH,
    tm_min_c=60.0,
    tm_max_c=65.0,
    max_homopolymer=3,
    max_dinucleotide_repeats=2,
    max_trinucleotide_repeats=1,
    near_palindrome_min_match=14,
    self_complementarity_threshold=6,
    motifs=("AAGCTT", "GAATTC", "GGATCC"),
    chemistry=CHEMISTRY,
)
RULES = co.PairRules(length=LENGTH, limit_c=40.0, window=3, min_run=4, gate=8, chemistry=CHEMISTRY)
DENSE_RULES = co.PairRules(length=LENGTH, limit_c=30.0, window=3, min_run=4, chemistry=CHEMISTRY)
SENSE_RULES = RULES.anywhere(limit_c=30.0, gate=7)
PAIR_SAMPLE = 4000
SAMPLE_SEED = 12345

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


_tables: dict[tuple[str, str, str], DataFrame] = {}


def forget() -> None:
    """Drop the intermediate tables, after their inputs have changed or to time a query from the start."""
    _tables.clear()


def _once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Intermediate tables several queries start from are written once per application."""
    slot = (spark.sparkContext.applicationId, sf_dir, name)
    if slot not in _tables:
        _tables[slot] = materialize(build(), name)
    return _tables[slot]


def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All accepted order candidates, numbered in attempt order."""
    return _once(
        spark,
        sf_dir,
        "accepted",
        lambda: with_position(fu.survivors(order_candidates(spark, sf_dir), FUNNEL), "attempt_id"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "edges", lambda: co.conflict_edges(accepted(spark, sf_dir), RULES))


def dense_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "dense_edges", lambda: co.conflict_edges(accepted(spark, sf_dir), DENSE_RULES))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The indexes of the conflicts, for queries that need no more of them."""
    if (spark.sparkContext.applicationId, sf_dir, "edges") in _tables:
        return edges(spark, sf_dir).select("left_index", "right_index")
    return _once(spark, sf_dir, "pairs", lambda: co.conflict_pairs(accepted(spark, sf_dir), RULES))


def dense_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The indexes of the dense conflicts, as ``pairs``."""
    if (spark.sparkContext.applicationId, sf_dir, "dense_edges") in _tables:
        return dense_edges(spark, sf_dir).select("left_index", "right_index")
    return _once(spark, sf_dir, "dense_pairs", lambda: co.conflict_pairs(accepted(spark, sf_dir), DENSE_RULES))


def _half(spark: SparkSession, sf_dir: str) -> int:
    """Size of the already validated part in the incremental queries: the older half."""
    return accepted(spark, sf_dir).count() // 2


# ---- sequences -----------------------------------------------------------------------------


@query
def dna_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_candidates(spark, sf_dir)


@query
def reverse_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("sequence")
    return order_candidates(spark, sf_dir).select(
        "attempt_id",
        sq.complement(text).alias("complement"),
        sq.reverse_complement(text).alias("reverse_complement"),
    )


@query
def gc_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("sequence")
    return order_candidates(spark, sf_dir).select(
        "attempt_id",
        sq.gc_count(text).cast("long").alias("gc_count"),
        F.round(sq.gc_fraction(text), 4).alias("gc_fraction"),
    )


@query
def encode_2bit(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("sequence")
    rows = order_candidates(spark, sf_dir).withColumn("code", sq.pack(text))
    return rows.select(
        "attempt_id",
        "code",
        sq.decode(F.col("code"), LENGTH).alias("decoded"),
        sq.pack(sq.reverse_complement(text)).alias("reverse_complement_code"),
    )


@query
def intrinsic_tm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_intrinsic_tm(order_candidates(spark, sf_dir), "sequence", "tm", LENGTH, CHEMISTRY, fixed=True)
    return rows.select("attempt_id", F.round("tm", 4).alias("tm_c"))


@query
def intrinsic_tm_magnesium(spark: SparkSession, sf_dir: str) -> DataFrame:
    chemistry = Chemistry(strand_nm=250.0, monovalent_mm=50.0, magnesium_mm=1.5)
    rows = with_intrinsic_tm(order_candidates(spark, sf_dir), "sequence", "tm", LENGTH, chemistry, fixed=True)
    return rows.select("attempt_id", F.round("tm", 4).alias("tm_c"))


@query
def max_tm_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hottest word of each length inside the accepted oligos."""
    spans = [f"substring(sequence, {s + 1}, {n})" for n in range(2, LENGTH + 1) for s in range(LENGTH - n + 1)]
    words = accepted(spark, sf_dir).select(F.explode(F.expr(f"array({', '.join(spans)})")).alias("word"))
    rows = with_intrinsic_tm(words, "word", "tm", LENGTH, CHEMISTRY)
    return rows.groupBy(F.length("word").alias("length")).agg(F.round(F.max("tm"), 4).alias("max_tm_c"))


@query
def gc_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many 9-base fragments of the candidates could sit in an admissible oligo, by GC count."""
    spans = F.expr(sq.words_sql("sequence", 9, range(LENGTH - 8)))
    fragments = order_candidates(spark, sf_dir).select(F.explode(spans).alias("fragment"))
    gc = sq.gc_count(F.col("fragment"))
    return (
        fragments.groupBy(gc.cast("long").alias("gc"))
        .agg(F.count(F.lit(1)).alias("fragments"))
        .withColumn("embeddable", sq.gc_embeddable(F.col("gc"), 9, LENGTH, *GC_BOUNDS))
    )


@query
def alphabet_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which three-letter texts, cut from digests of the order keys, are DNA."""
    digest = F.upper(F.md5(F.col("o_orderkey").cast("string").cast("binary")))
    texts = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("attempt_id"), F.substring(digest, 1, 3).alias("text")
    )
    return texts.where(sq.is_dna(F.col("text"), 3))


@query
def word_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many order candidates begin with each of all five-base sequences."""
    begun = order_candidates(spark, sf_dir).groupBy(F.substring("sequence", 1, 5).alias("sequence"))
    rows = enumerate_sequences(spark, 5).join(begun.agg(F.count(F.lit(1)).alias("n")), "sequence", "left")
    return rows.select("id", "sequence", F.coalesce("n", F.lit(0)).cast("long").alias("candidates"))


# ---- filters -------------------------------------------------------------------------------


def _rejected(spark: SparkSession, sf_dir: str, condition) -> DataFrame:
    rows = order_candidates(spark, sf_dir).withColumn("packed", sq.pack(F.col("sequence")))
    rows = rows.withColumn("rc", sq.reverse_complement(F.col("sequence")))
    return stage(rows, {"rejected": condition}).where("rejected").select("attempt_id", "sequence")


@query
def flt_homopolymer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rejected(spark, sf_dir, mo.homopolymer_exceeds(F.col("sequence"), LENGTH, 3, F.col("packed")))


@query
def flt_dinuc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rejected(spark, sf_dir, mo.repeat_exceeds(F.col("sequence"), LENGTH, 2, 2, F.col("packed")))


@query
def flt_trinuc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rejected(spark, sf_dir, mo.repeat_exceeds(F.col("sequence"), LENGTH, 3, 1, F.col("packed")))


@query
def flt_motif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rejected(spark, sf_dir, mo.contains_motif(F.col("sequence"), FUNNEL.motifs))


@query
def flt_motif_both_strands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motifs that are not their own reverse complement, looked for on both strands."""
    motifs = mo.both_strands(["GAAGA", "CTGCA"])
    return _rejected(spark, sf_dir, mo.contains_motif(F.col("sequence"), motifs))


@query
def flt_tm_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_intrinsic_tm(order_candidates(spark, sf_dir), "sequence", "tm", LENGTH, CHEMISTRY, fixed=True)
    rows = stage(rows.withColumnRenamed("tm", "raw"), {"tm": F.col("raw")})
    return rows.where((F.col("tm") < 60.0) | (F.col("tm") > 65.0)).select("attempt_id", "sequence")


@query
def flt_self_comp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rejected(spark, sf_dir, mo.self_complementary("sequence", "rc", LENGTH, 6))


@query
def flt_near_palindrome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lower match length than the demonstration run's 14, which nothing here reaches."""
    return _rejected(spark, sf_dir, mo.near_palindrome("sequence", "rc", LENGTH, 7))


@query
def self_run_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long each candidate can pair with itself, with and without the bases around the turn."""
    rows = order_candidates(spark, sf_dir).select(
        "attempt_id",
        sq.pack(F.col("sequence")).alias("code"),
        sq.pack(sq.reverse_complement(F.col("sequence"))).alias("rc"),
    )
    runs = {f"run_gap_{gap}": mo.longest_self_run("code", "rc", LENGTH, gap) for gap in (0, 2)}
    return stage(rows, runs).select("attempt_id", *runs)


@query
def flt_motif_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motifs of seven to nine bases drawn from all parts, both strands."""
    size = F.lit(7) + (F.col("p_partkey") % 3).cast("int")
    drawn = table(spark, sf_dir, "part").select(
        dna_from_key(F.col("p_partkey").cast("string"), LENGTH).substr(F.lit(1), size).alias("motif")
    )
    return with_listed_motif(order_candidates(spark, sf_dir), motif_table(drawn, "motif"), LENGTH)


@query
def gate_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest run that melts above the limit of both directions, and how many pool oligos hold the hottest one."""
    limits = {"reverse_complement": RULES.limit_c, "sense": SENSE_RULES.limit_c}
    gate = gate_lengths(spark, FUNNEL, *GC_BOUNDS, limits)
    rows = [(label, n, gate.examples[label][1]) for label, n in gate.lengths.items()]
    found = spark.createDataFrame(rows, "label string, length int, max_tm_c double")
    sizes = {n: F.expr(sq.words_sql("sequence", n, range(LENGTH - n + 1))) for n in set(gate.lengths.values())}
    words = F.explode(F.concat(*sizes.values())).alias("word")
    hot = with_intrinsic_tm(accepted(spark, sf_dir).select("idx", words), "word", "tm", LENGTH, CHEMISTRY)
    hot = hot.select("idx", F.length("word").alias("length"), "tm")
    held = hot.join(F.broadcast(found), "length").where("tm > max_tm_c - 1e-6").groupBy("label")
    return found.join(held.agg(F.count_distinct("idx").alias("oligos")), "label", "left").select(
        "label", "length", F.round("max_tm_c", 4).alias("max_tm_c"), F.coalesce("oligos", F.lit(0)).alias("oligos")
    )


@query
def funnel_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fu.with_reason(order_candidates(spark, sf_dir), FUNNEL)
    return rows.select("attempt_id", F.coalesce("reason", F.lit("accepted")).alias("reason"))


@query
def funnel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejections per reason over all line items, four in ten of which repeat a sequence."""
    return fu.reason_counts(fu.funnel_totals(line_candidates(spark, sf_dir), FUNNEL))


@query
def funnel_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fu.funnel_table(fu.funnel_totals(line_candidates(spark, sf_dir), FUNNEL))
    return rows.select(
        "stage",
        "filter",
        "count",
        F.round("fraction_of_attempts", 6).alias("fraction_of_attempts"),
        "attempts_reaching_filter",
        F.round("fraction_of_reaching_filter", 6).alias("fraction_of_reaching_filter"),
    )


@query
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fu.first_occurrences(line_candidates(spark, sf_dir))


def _first_accepted(candidates: DataFrame, size: int) -> DataFrame:
    first = oligo_records(accept_to_cut(candidates, FUNNEL, size).rows)
    return first.select(
        "idx",
        "attempt_id",
        "sequence",
        "reverse_complement",
        F.round("gc_fraction", 4).alias("gc_fraction"),
        F.round("intrinsic_tm_c", 4).alias("intrinsic_tm_c"),
    )


@query
def accept_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 1000 accepted order sequences in attempt order, as output rows."""
    return _first_accepted(order_candidates(spark, sf_dir), 1000)


@query
def accept_prefix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 accepted customer sequences; most attempts repeat an earlier one."""
    return _first_accepted(customer_candidates(spark, sf_dir), 100)


@query
def funnel_counts_to_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejections per reason up to the 100th accepted customer sequence, and the attempt that brings it."""
    prefix = accept_to_cut(customer_candidates(spark, sf_dir), FUNNEL, 100)
    return fu.reason_counts(prefix.totals).withColumn("last_attempt", F.lit(prefix.cut).cast("long"))


@query
def rejection_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of rejections among the last 50 order candidates, attempt by attempt."""
    judged = fu.with_reason(order_candidates(spark, sf_dir), FUNNEL).select("attempt_id", "reason")
    rows = rolling_share(judged, "attempt_id", F.col("reason").isNotNull(), 50, "rate")
    return rows.select("attempt_id", F.round("rate", 6).alias("rate"))


@query
def accept_second_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next 200 acceptances when the older half of the pool has been accepted before."""
    half = _half(spark, sf_dir)
    seen = accepted(spark, sf_dir).where(F.col("idx") < half).select("sequence")
    ends = order_candidates(spark, sf_dir).agg(F.min("attempt_id"), F.max("attempt_id")).first()

    def source(session: SparkSession, first: int, last: int) -> DataFrame:
        return order_candidates(session, sf_dir).where(F.col("attempt_id").between(first, last))

    rows = next_batch(spark, source, FUNNEL, seen, ends[0], ends[1], 200).rows
    return rows.select((F.col("idx") + half).alias("idx"), "attempt_id", "sequence")


# ---- k-mers and pairs ----------------------------------------------------------------------


@query
def kmers_3prime(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = sq.three_prime_starts(LENGTH, 8, RULES.window)
    words = F.array_distinct(F.array(*[F.substring("sequence", s + 1, 8) for s in starts]))
    return accepted(spark, sf_dir).select("idx", F.explode(words).alias("kmer"))


@query
def kmers_rc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = accepted(spark, sf_dir).select("idx", sq.reverse_complement(F.col("sequence")).alias("rc"))
    return rows.select("idx", F.explode(sq.kmers("rc", 8, LENGTH)).alias("kmer"))


@query
def candidate_pairs_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs at the run length the gate search finds for 40 C."""
    gate = gate_lengths(spark, FUNNEL, *GC_BOUNDS, {"reverse_complement": RULES.limit_c})
    k = gate.lengths["reverse_complement"]
    return co.candidate_pairs(accepted(spark, sf_dir), k, RULES).select("left_index", "right_index")


@query
def candidate_pairs_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs with at least one member in the newer half of the pool."""
    pairs = co.candidate_pairs(accepted(spark, sf_dir), 8, RULES, first_new=_half(spark, sf_dir))
    return pairs.select("left_index", "right_index")


def _by_scope(counts: DataFrame, name: str, value: int) -> DataFrame:
    scopes = [
        F.struct(F.lit(value).alias(name), F.lit(scope).alias("scope"), F.col(column).alias("pairs"))
        for scope, column in (("all", "pairs"), ("with_new", "new_pairs"))
    ]
    return counts.select(F.inline(F.array(*scopes)))


@query
def candidate_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool, half = accepted(spark, sf_dir), _half(spark, sf_dir)
    parts = [_by_scope(pc.candidate_pair_counts(pool, k, RULES, first_new=half), "k", k) for k in (4, 8)]
    return reduce(DataFrame.unionAll, parts)


@query
def candidate_pair_counts_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs share a 6-mer that ends in the last 3, 8 and 20 positions."""
    pool, half = accepted(spark, sf_dir), _half(spark, sf_dir)
    parts = [
        _by_scope(pc.candidate_pair_counts(pool, 6, replace(RULES, window=window), first_new=half), "window", window)
        for window in (3, 8, 20)
    ]
    return reduce(DataFrame.unionAll, parts)


@query
def pair_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = accepted(spark, sf_dir)
    everything = pc.pair_slots(pool).withColumn("scope", F.lit("all"))
    with_new = pc.pair_slots(pool, first_new=_half(spark, sf_dir)).withColumn("scope", F.lit("with_new"))
    return everything.unionAll(with_new)


@query
def pair_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pc.pair_accounting(accepted(spark, sf_dir), RULES)


@query
def best_run_anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score records of all pairs that share an anchored 7-mer, gated at 8."""
    pairs = co.candidate_pairs(accepted(spark, sf_dir), 7, RULES)
    scored = co.score_pairs(pairs, RULES)
    return scored.select(
        "left_index",
        "right_index",
        "run_length",
        "run_start",
        "run_offset",
        "run_sequence",
        F.round("run_tm_c", 4).alias("tm_c"),
        F.col("run_below_min").alias("below_min_alignment_run"),
        F.col("run_shortcircuited").alias("tm_shortcircuited"),
        F.col("run_evaluated").alias("tm_evaluated"),
    )


@query
def conflict_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).select(
        "left_index", "right_index", "run_length", "run_sequence", F.round("tm_c", 4).alias("tm_c")
    )


@query
def conflict_edges_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_edges(spark, sf_dir).select(
        "left_index", "right_index", "run_length", "run_sequence", F.round("tm_c", 4).alias("tm_c")
    )


@query
def conflict_edges_shared_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the pool ends in one text that binds to itself: its key is split over a grid of tasks."""
    shared = F.concat(F.substring("sequence", 1, 12), F.lit("GCGCGCGC"))
    pool = accepted(spark, sf_dir).select(
        "idx", F.when(F.col("idx") % 3 == 0, shared).otherwise(F.col("sequence")).alias("sequence")
    )
    rows = co.conflict_edges(pool, DENSE_RULES, cell_matches=50_000)
    return rows.select("left_index", "right_index", F.round("tm_c", 4).alias("tm_c"))


def _index(spark: SparkSession) -> KeyIndex:
    return KeyIndex(spark, f"{scratch_dir(spark)}/key-index-{uuid.uuid4().hex}", DENSE_RULES)


@query
def conflict_edges_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newer half of the pool against an index of the older half, to which it is appended."""
    pool, half = accepted(spark, sf_dir), _half(spark, sf_dir)
    index, newer = _index(spark), pool.where(F.col("idx") >= half)
    index.append(pool.where(F.col("idx") < half), 0)
    index.append(newer, 1)
    return index.conflicts(newer).select("left_index", "right_index", F.round("tm_c", 4).alias("tm_c"))


@query
def index_after_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posting lists of the pool in two batches, a third of the older one removed, compacted in between."""
    pool, half = accepted(spark, sf_dir), _half(spark, sf_dir)
    index, older = _index(spark), pool.where(F.col("idx") < half)
    index.append(older, 0)
    index.remove(older.where(F.col("idx") % 3 == 0), 0)
    index.compact()
    index.append(pool.where(F.col("idx") >= half), 1)
    index.remove(pool.where(F.col("sequence").startswith("A")), 1)
    digits = F.expr("substring(conv(key, 10, 4), 2)")
    return index.postings().select(
        F.translate(digits, "0123", sq.ALPHABET).alias("suffix"),
        F.col("left_index").alias("idx"),
        F.col("left_last").alias("last"),
    )


@query
def sense_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed sense scores above 30 C, the pairs that may not share a reaction."""
    rows = co.sense_conflicts(accepted(spark, sf_dir), SENSE_RULES)
    return rows.select(
        "left_index", "right_index", "run_length", "run_sequence", F.round("tm_c", 4).alias("tm_c")
    )


@query
def sense_pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sense directions and the pair temperature of every conflicting pair of the pool."""
    pairs = dense_edges(spark, sf_dir).select("left_index", "right_index", "left_sequence", "right_sequence")
    scored = co.sense_pair_scores(pairs, SENSE_RULES)
    return scored.select(
        "left_index",
        "right_index",
        "fwd_length",
        "fwd_sequence",
        "rev_length",
        "rev_sequence",
        F.round("pair_tm_c", 4).alias("pair_tm_c"),
    )


# ---- pruning and delivery ------------------------------------------------------------------


@query
def conflict_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.conflict_degrees(dense_pairs(spark, sf_dir))


@query
def conflict_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    degrees = co.conflict_degrees(dense_pairs(spark, sf_dir))
    # Every edge adds one to the degree of both of its ends.
    return degrees.agg(
        F.expr("coalesce(sum(degree), 0L) div 2").alias("conflict_edges"),
        F.count(F.lit(1)).alias("conflicted_oligos"),
        F.max("degree").alias("max_degree"),
    )


@query
def mis_round1_victims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.round_victims(dense_pairs(spark, sf_dir), accepted(spark, sf_dir)).select("idx", "degree")


@query
def mis_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = pr.independent_set(accepted(spark, sf_dir), dense_pairs(spark, sf_dir))
    return kept.select("idx", "sequence")


@query
def mis_survivors_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same survivors by rounds alone, without working off the strongest in turn."""
    pool = accepted(spark, sf_dir)
    removed = pr.greedy_removals(dense_pairs(spark, sf_dir), head_size=1, pool=pool)
    return pool.join(removed, "idx", "left_anti").select("idx", "sequence")


@query
def final_oligos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates to delivered pool: funnel, conflicts, pruning, output rows."""
    kept = pr.independent_set(accepted(spark, sf_dir), pairs(spark, sf_dir))
    return output_rows(oligo_records(kept))


@query
def trimmed_oligos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 500 oldest survivors of the denser graph."""
    kept = pr.independent_set(accepted(spark, sf_dir), dense_pairs(spark, sf_dir))
    return pr.trim_newest(kept, 500).select("idx", "sequence")


@query
def delivery_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The survivors of the denser graph, numbered in pool order."""
    kept = pr.independent_set(accepted(spark, sf_dir), dense_pairs(spark, sf_dir))
    return with_position(kept.select("idx", "sequence"), "idx", "place")


@query
def conflict_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conflicts numbered by left, then right oligo."""
    return with_position(dense_pairs(spark, sf_dir), ("left_index", "right_index"), "place")


@query
def pairing_first_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first round of draws: who meets whom, both sense scores, and whether the pair fits."""
    pool = accepted(spark, sf_dir)
    drawn = score_proposals(propose_pairs(pool, pool.count(), SAMPLE_SEED, 1), SENSE_RULES)
    return drawn.select(
        "order",
        "left_sequence",
        "right_sequence",
        F.round("left_vs_right_sense_tm_c", 4).alias("left_vs_right_sense_tm_c"),
        F.round("right_vs_left_sense_tm_c", 4).alias("right_vs_left_sense_tm_c"),
        "fits",
    )


@query
def pairing_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pool paired to the end under a limit that more than four in ten draws exceed."""
    pool = accepted(spark, sf_dir)
    rules = SENSE_RULES.anywhere(limit_c=-30.0, gate=0)
    options = PairingOptions(pool.count() // 2, SAMPLE_SEED, stagnation_attempts=200)
    rows = pair_oligos(pool, rules, options).pairs
    return rows.select(
        "left_sequence",
        "right_sequence",
        F.round("left_vs_right_sense_tm_c", 4).alias("left_vs_right_sense_tm_c"),
        F.round("right_vs_left_sense_tm_c", 4).alias("right_vs_left_sense_tm_c"),
    )


@query
def gc_balanced_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One random proposal per order key."""
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("attempt_id"))
    return propose(keys, SAMPLE_SEED, LENGTH, *GC_BOUNDS)


# ---- calibration ---------------------------------------------------------------------------


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        pairs = cal.sample_pairs(accepted(spark, sf_dir), PAIR_SAMPLE, SAMPLE_SEED)
        return cal.pair_metrics(pairs, co.PairRules(LENGTH, 10.0, chemistry=CHEMISTRY))

    return _once(spark, sf_dir, "pair_metrics", build)


@query
def calib_pair_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).select(
        "left_index",
        "right_index",
        "anchored_run_length",
        F.round("heterodimer_tm_c", 4).alias("heterodimer_tm_c"),
        "is_conflict",
    )


@query
def calib_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cal.run_histogram(_metrics(spark, sf_dir))
    return rows.withColumn("conflict_rate", F.round("conflict_rate", 6))


@query
def calib_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cal.conflict_rates(_metrics(spark, sf_dir))
    return rows.withColumn("conflict_probability", F.round("conflict_probability", 6))


@query
def calib_search_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pruning should leave of pools of the accepted size, half of it and a tenth of it."""
    pool = accepted(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))
    sizes = pool.select(F.explode(F.expr("array(n, n div 2, n div 10)")).alias("oligos"))
    chance = cal.conflict_rates(_metrics(spark, sf_dir)).first()["conflict_probability"]
    rows = sizes.withColumn("degree", F.lit(chance) * (F.col("oligos") - 1))
    share = F.when(F.col("degree") > 0, -F.expm1(-F.col("degree")) / F.col("degree")).otherwise(1.0)
    return rows.select(
        "oligos",
        F.round("degree", 4).alias("mean_conflict_degree"),
        F.round(share, 6).alias("retained_share"),
    )


def _score_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cal.sample_pairs(accepted(spark, sf_dir), PAIR_SAMPLE, SAMPLE_SEED)
    return co.score_pairs(pairs, RULES)


@query
def pair_score_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields of the score records of sampled pairs, whatever came of them."""
    return _score_records(spark, sf_dir).select(
        "left_index",
        "right_index",
        F.coalesce("run_length", F.lit(0)).alias("anchored_run_length"),
        F.coalesce("run_sequence", F.lit("")).alias("anchored_run_sequence"),
        F.round("run_tm_c", 4).alias("tm_c"),
        F.col("run_below_min").alias("below_min_alignment_run"),
        F.col("run_shortcircuited").alias("tm_shortcircuited"),
        F.col("run_evaluated").alias("tm_evaluated"),
    )


@query
def pair_score_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _score_records(spark, sf_dir).agg(
        F.count_if("run_below_min").alias("below_min_alignment_run"),
        F.count_if("run_shortcircuited").alias("tm_shortcircuited"),
        F.count_if("run_evaluated").alias("tm_evaluated"),
    )
