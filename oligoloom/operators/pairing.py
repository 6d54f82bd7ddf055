"""Pairing of validated oligos by random proposals, taken in order, and by augmenting swaps.

Drawing two free oligos at a time and keeping the pair if its two sense scores stay within the limit is a sequential
process. Here many draws are laid out and scored at once: in each layer all free oligos are shuffled by a hash into
buckets and neighbours are proposed to each other. The draws of all layers are then taken in their order, each one if
both oligos are still free: what the sequential process would keep, found in parallel as the draws that come first at
both their ends. The oligos that stay free are put two by two and matched with pairs held so far: (u, v) and (a, b)
become (u, a) and (v, b), or (u, b) and (v, a), so a pair is only given up for two others and the number of pairs never
falls. Both kinds of rounds alternate until the target is reached, at most one oligo is free, the draws are used
up, or as many draws in a row as the stagnation window asks for, and all of a round, have brought nothing.

The draws of a layer share no oligo, so a few layers of a pool are settled one by one in a job each: the oligos carry whether
they are still free, and only draws of free ones are scored. In a round of swaps in which no pair comes twice the
couples do not hinder each other: each takes the first of its swaps that fits. The swaps are scored a stretch at a time, and later
stretches for the couples that are still open. What is in neither form, many layers of few oligos, pools with equal sequences and
pairs that come again, is scored at once and settled by ``first_come``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from oligoloom.functions.draws import DIGEST_BITS, digest_number
from oligoloom.functions.runs import found_run
from oligoloom.functions.staging import stage
from oligoloom.operators.accept import nth_smallest, with_position
from oligoloom.operators.conflicts import PairRules, sense_pair_scores
from oligoloom.operators.skew import BROADCAST_KEYS
from oligoloom.storage import materialize

# Free oligos per shuffle bucket, which one task sorts.
BUCKET_ROWS = 50_000
_PLACE_BITS, _LAYER_BITS = 20, 40
# Draws for each free oligo in a round, half of which would be used if all of them fitted.
DRAWS_PER_OLIGO = 2
# Layers of a round that are settled one by one; more of them are only laid out for a few oligos.
MOST_LAYERS = 8
# Swaps of the first stretch: for each couple, and at least. Every stretch is twice as long as the one before.
SWAPS_PER_COUPLE, LEAST_SWAPS = 4, 200_000
# Rows that a task ranks by hash, and the most ranges of hashes (as a power of two).
RANKED_ROWS, _MOST_RANGE_BITS = 20_000, 12

PAIR_COLUMNS = ("left_sequence", "right_sequence", "left_vs_right_sense_tm_c", "right_vs_left_sense_tm_c", "pair_tm_c")


@dataclass(frozen=True)
class PairingOptions:
    target_pairs: int
    seed: int = 0
    rejection_window: int = 50
    requeue_scale: float = 1.0
    attempts_multiplier: int = 50
    stagnation_attempts: int = 500


@dataclass
class Pairing:
    pairs: DataFrame
    free: DataFrame
    attempts: int = 0
    rejected: int = 0
    recycled: int = 0
    shortcircuited: int = 0
    recent_rejection_rate: float = 0.0
    accepted: int = 0
    unpaired: int = 0
    target_reached: bool = False
    # Pairs held after each round of draws or swaps; never falling.
    held: list[int] = field(default_factory=list)

    @property
    def completed(self) -> bool:
        return self.target_reached or self.unpaired <= 1


def propose_pairs(free: DataFrame, count: int, seed: int, layer: int, layers: int = 1) -> DataFrame:
    """The ``count`` free oligos in disjoint random pairs, once for each of ``layers`` layers from ``layer`` on.

    ``order`` is unique and rises from layer to layer; the last oligo of a bucket may have no partner.
    """
    rows = free.select("sequence", F.explode(F.sequence(F.lit(layer), F.lit(layer + layers - 1))).alias("layer"))
    rows = _neighbours(rows, count, seed, layer, {"right_sequence": "sequence"})
    return rows.where(F.col("right_sequence").isNotNull()).select(
        "order", F.col("sequence").alias("left_sequence"), "right_sequence"
    )


def _neighbours(rows: DataFrame, count: int, seed: int, first: int, after: dict[str, str]) -> DataFrame:
    """Every other one of the shuffled oligos (sequence, layer) with columns of the next one, null where there is none."""
    buckets = max(1, -(-count // BUCKET_ROWS))
    rows = rows.withColumn("hash", digest_number(seed, F.col("layer"), F.col("sequence")))
    rows = rows.withColumn("bucket", F.pmod("hash", F.lit(buckets)))
    shuffled = Window.partitionBy("layer", "bucket").orderBy("hash", "sequence")
    rows = rows.withColumns(
        {"place": F.row_number().over(shuffled)} | {out: F.lead(name).over(shuffled) for out, name in after.items()}
    )
    layer_no = (F.col("layer") - first).cast("long")
    order = F.shiftleft(layer_no, _LAYER_BITS) + F.shiftleft("bucket", _PLACE_BITS) + F.col("place")
    return rows.where(F.col("place") % 2 == 1).withColumn("order", order)


def score_proposals(proposals: DataFrame, rules: PairRules) -> DataFrame:
    """Proposals with both sense scores, and whether they fit; other columns are kept."""
    scored = sense_pair_scores(proposals, rules)
    return scored.select(
        *proposals.columns,
        F.col("fwd_tm_c").alias("left_vs_right_sense_tm_c"),
        F.col("rev_tm_c").alias("right_vs_left_sense_tm_c"),
        "pair_tm_c",
        (F.col("pair_tm_c") <= rules.limit_c).alias("fits"),
        (F.col("fwd_shortcircuited").cast("long") + F.col("rev_shortcircuited").cast("long")).alias("shortcircuited"),
    )


# The two ways to swap a couple (u, v) into a pair (a, b); the first is preferred.
_WAYS = ((("u", "a"), ("v", "b")), (("u", "b"), ("v", "a")))


def score_swaps(tries: DataFrame, rules: PairRules) -> DataFrame:
    """Swaps of (u, v) into (a, b): whether they fit, and the two pairs (null: they do not). One step scores all sides."""
    n = rules.length
    ends = [end for way in _WAYS for side in way for end in (side, side[::-1])]
    found = {f"{x}{y}": found_run(x, y, n, n, rules.active_run, rules.chemistry) for x, y in ends}
    rows = stage(tries, found)

    def pair(x: str, y: str) -> Column:
        fwd, rev = F.col(f"{x}{y}.tm"), F.col(f"{y}{x}.tm")
        values = (F.col(x), F.col(y), fwd, rev, F.greatest(fwd, rev))
        return F.struct(*[value.alias(name) for name, value in zip(PAIR_COLUMNS, values)])

    def way_fits(way: tuple[tuple[str, str], ...]) -> Column:
        return F.greatest(*[F.col(f"{x}{y}.tm") for side in way for x, y in (side, side[::-1])]) <= rules.limit_c

    chosen = F.when(way_fits(_WAYS[0]), F.array(*[pair(*side) for side in _WAYS[0]])).when(
        way_fits(_WAYS[1]), F.array(*[pair(*side) for side in _WAYS[1]])
    )
    size = [F.col(f"{name}.length") for name in found]
    short = [((s >= rules.min_run) & (s < rules.active_run)).cast("long") for s in size]
    rows = rows.withColumn("pairs", chosen).withColumn("shortcircuited", reduce(Column.__add__, short))
    return rows.select("order", "couple", "pair", "pairs", F.col("pairs").isNotNull().alias("fits"), "shortcircuited")


def ranked(rows: DataFrame, count: int, key: str, seed: int, layer: int, out: str) -> DataFrame:
    """Some ``count`` rows, numbered 0, 1, 2, ... by the hash of ``key``. Hashes are even, so equal ranges of them are too."""
    bits = min(_MOST_RANGE_BITS, max(0, math.ceil(math.log2(max(1, count) / RANKED_ROWS))))
    rows = rows.withColumn("__hash", digest_number(seed, layer, F.col(key)))
    rows = rows.withColumn("__range", F.shiftright("__hash", DIGEST_BITS - bits).cast("int"))
    sizes = {r["__range"]: r["count"] for r in rows.groupBy("__range").count().collect()}
    before = accumulate((sizes.get(part, 0) for part in range((1 << bits) - 1)), initial=0)
    start = F.expr(f"get(array({', '.join(f'{b}L' for b in before)}), __range)")
    inside = Window.partitionBy("__range").orderBy("__hash", key)
    return rows.withColumn(out, start + F.row_number().over(inside) - 1).drop("__hash", "__range")


def _nothing(spark: SparkSession, schema: str) -> DataFrame:
    names = [column.split() for column in schema.split(", ")]
    return spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in names])


def first_come(edges: DataFrame) -> DataFrame:
    """(order, node, other) of the edges (order, left, right) that are taken if they come in rising order and need
    both ends free.

    An edge that comes first at both its ends is taken whatever happens elsewhere, and what shares an end with it is
    not. All such edges are taken at once, until none is left. Minima combine before the shuffle.
    """
    left = materialize(edges.select("order", "left", "right"), "edges")
    node_type = left.schema["left"].dataType.simpleString()
    taken = _nothing(left.sparkSession, f"order long, node {node_type}, other {node_type}")
    while not left.isEmpty():
        ends = left.select("order", F.explode(F.array("left", "right")).alias("node"))
        first = ends.groupBy("node").agg(F.min("order").alias("order"))
        both = first.groupBy("order").agg(
            F.count(F.lit(1)).alias("ends"), F.min("node").alias("node"), F.max("node").alias("other")
        )
        chosen = materialize(both.where("ends = 2").drop("ends"), "taken")
        gone = chosen.select(F.explode(F.array("node", "other")).alias("node"))
        for side in ("left", "right"):
            left = left.join(gone.withColumnRenamed("node", side), side, "left_anti")
        left = materialize(left.select("order", "left", "right"), "edges")
        taken = taken.unionAll(chosen)
    return taken


@dataclass
class _Tally:
    made: int
    gained: int
    shortcircuited: int
    # Whether the last draws of the round failed, oldest first.
    last_failed: list[bool]


@dataclass
class _Counted:
    rows: DataFrame
    made: int
    gained: int
    shortcircuited: int


class _Rounds:
    """Pairs and free oligos as tables, counters on the driver."""

    def __init__(self, pool: DataFrame, rules: PairRules, options: PairingOptions):
        self.rules, self.options = rules, options
        self.free = materialize(pool.select("sequence"), "free")
        self.count = self.unpaired = self.free.count()
        nothing = ", ".join(f"{c} {'string' if c.endswith('sequence') else 'double'}" for c in PAIR_COLUMNS)
        self.pairs = _nothing(pool.sparkSession, nothing)
        self.repeats = not self.free.groupBy("sequence").count().where("count > 1").isEmpty()
        self.accepted = 0
        self.layer = 1

    def _taken(self, draws: DataFrame) -> tuple[DataFrame, int]:
        """The draws (order, left, right, fits) that are taken, up to the target, and their number."""
        taken = materialize(first_come(draws.where("fits")), "taken-draws")
        gained, allowed = taken.count(), self.options.target_pairs - self.accepted
        if gained > allowed:
            numbered = with_position(taken, "order", "nth")
            taken = materialize(numbered.where(F.col("nth") < allowed).drop("nth"), "taken-draws")
        return taken, min(gained, allowed)

    def _tally(self, draws: DataFrame, taken: DataFrame, gained: int) -> _Tally:
        """A draw was made if both its ends were free at its turn, and the target was not reached before it."""
        at = taken.select(F.explode(F.array("node", "other")).alias("node"), F.col("order").alias("at"))
        rows = draws.select("order", "left", "right", "fits", "shortcircuited")
        for side in ("left", "right"):
            turn = at.select(F.col("node").alias(side), F.col("at").alias(f"{side}_at"))
            rows = rows.join(turn, side, "left")
        made = (F.coalesce("left_at", "order") >= F.col("order")) & (F.coalesce("right_at", "order") >= F.col("order"))
        if self.accepted + gained >= self.options.target_pairs:
            made = made & (F.col("order") <= (taken.agg(F.max("order")).first()[0] or -1))
        rows = materialize(rows.where(made).select("order", "fits", "shortcircuited"), "made")
        sums = rows.agg(F.count(F.lit(1)).alias("made"), F.sum("shortcircuited").alias("short")).first()
        last = rows.orderBy(F.desc("order")).limit(self.options.rejection_window).collect()
        return _Tally(sums.made, gained, sums.short or 0, [not r.fits for r in reversed(last)])

    def _last_failed(self, made: list[tuple[DataFrame, int]]) -> list[bool]:
        """Of draws (order, fits) that were made, in tables of rising order with their counts."""
        window, last, found = self.options.rejection_window, [], 0
        for rows, count in reversed(made):
            if found < window and count:
                last.append(rows.select("order", "fits"))
                found += count
        if not last:
            return []
        rows = reduce(DataFrame.unionAll, last).orderBy(F.desc("order")).limit(window).collect()
        return [not r.fits for r in reversed(rows)]

    def draw(self, budget: int) -> _Tally:
        """Layers of disjoint draws among the free oligos."""
        couples = self.unpaired // 2
        wanted = max(self.options.stagnation_attempts, DRAWS_PER_OLIGO * self.unpaired)
        layers = min(-(-wanted // couples), budget // couples)
        first = self.layer
        self.layer += layers
        if self.repeats or layers > MOST_LAYERS:
            return self._draw_at_once(first, layers)
        return self._draw_by_layer(first, layers)

    def _draw_at_once(self, first: int, layers: int) -> _Tally:
        proposals = propose_pairs(self.free, self.unpaired, self.options.seed, first, layers)
        scored = materialize(score_proposals(proposals, self.rules), "draws")
        ends = scored.withColumn("left", F.col("left_sequence")).withColumn("right", F.col("right_sequence"))
        taken, gained = self._taken(ends)
        tally = self._tally(ends, taken, gained)
        made = scored.join(taken.select("order"), "order").select(*PAIR_COLUMNS)
        self.pairs = materialize(self.pairs.unionAll(made), "pairs")
        self._leave(taken.select(F.explode(F.array("node", "other")).alias("sequence")), gained)
        return tally

    def _draw_by_layer(self, first: int, layers: int) -> _Tally:
        """All oligos of the round are shuffled for every layer; a draw is made if both are still free."""
        rows = self.free.withColumn("free", F.lit(True))
        total = _Tally(0, 0, 0, [])
        made, drawn = [], []
        after = {"right": "sequence", "right_free": "free", "after": "place"}
        for layer in range(first, first + layers):
            placed = rows.withColumn("layer", F.lit(layer)).withColumn("place", F.lit(0))
            placed = _neighbours(placed, self.unpaired, self.options.seed, first, after)
            both = F.col("free") & F.coalesce("right_free", F.lit(False)) & F.col("right").isNotNull()
            placed = placed.withColumn("drawn", both).select(
                "order", F.col("sequence").alias("left"), "free", "right", "right_free", "after", "drawn",
                F.when(F.col("drawn"), F.col("sequence")).alias("left_sequence"),
                F.when(F.col("drawn"), F.col("right")).alias("right_sequence"),
            )
            scored = score_proposals(placed, self.rules).withColumn("fits", F.col("drawn") & F.col("fits"))
            scored = self._counted(scored, "drawn")
            allowed = self.options.target_pairs - self.accepted - total.gained
            if scored.gained >= allowed:
                # No draw comes after the one that reaches the target.
                cut = nth_smallest(scored.rows.where("fits"), "order", allowed)
                early = {name: F.col(name) & (F.col("order") <= cut) for name in ("drawn", "fits")}
                scored = self._counted(scored.rows.withColumns(early), "drawn")
            total.made += scored.made
            total.gained += scored.gained
            total.shortcircuited += scored.shortcircuited
            made.append((scored.rows.where("drawn"), scored.made))
            drawn.append(scored.rows.where("fits").select(*PAIR_COLUMNS))
            sides = (("left", "free", F.lit(True)), ("right", "right_free", F.col("after").isNotNull()))
            ends = [
                F.struct(F.col(name).alias("sequence"), (F.col(free) & ~F.col("fits")).alias("free"), there.alias("there"))
                for name, free, there in sides
            ]
            rows = scored.rows.select(F.inline(F.array(*ends))).where("there").drop("there")
            if scored.gained >= allowed or self.unpaired - 2 * total.gained < 2:
                break
        total.last_failed = self._last_failed(made)
        self.pairs = materialize(reduce(DataFrame.unionAll, drawn, self.pairs), "pairs")
        self.free = materialize(rows.where("free").select("sequence"), "free")
        self.accepted += total.gained
        self.unpaired -= 2 * total.gained
        return total

    @staticmethod
    def _counted(rows: DataFrame, made: str, label: str = "layer") -> _Counted:
        """The stored rows, counted as they are written; ``fits`` only holds for rows that were ``made``."""
        seen = Observation()
        short = F.sum(F.when(F.col(made), F.col("shortcircuited")))
        counts = (F.count_if(made).alias("made"), F.count_if("fits").alias("gained"), short.alias("short"))
        stored = materialize(rows.observe(seen, *counts), label)
        found = seen.get
        return _Counted(stored, found["made"] or 0, found["gained"] or 0, found["short"] or 0)

    def swap(self, budget: int) -> _Tally:
        """Free oligos two by two against the pairs held: pair t mod P for couple t mod C."""
        couples, held = self.unpaired // 2, self.accepted
        wanted = math.ceil(self.options.requeue_scale * max(self.options.stagnation_attempts, held))
        turns = min(wanted, budget // 2)
        seed, layer = self.options.seed, self.layer
        self.layer += 1
        free = ranked(self.free, self.unpaired, "sequence", seed, layer, "place")
        couple = free.where(F.col("place") < 2 * couples).groupBy(F.expr("place div 2").alias("couple"))
        couple = couple.agg(
            F.max(F.when(F.col("place") % 2 == 0, F.col("sequence"))).alias("u"),
            F.max(F.when(F.col("place") % 2 == 1, F.col("sequence"))).alias("v"),
        )
        couple = materialize(couple, "couples")
        pairs = materialize(ranked(self.pairs, held, "left_sequence", seed, layer, "pair"), "numbered-pairs")
        draws = pairs.select("pair", F.col("left_sequence").alias("a"), F.col("right_sequence").alias("b"))
        if turns > held:
            again = F.explode(F.sequence(F.lit(0), F.lit((turns - 1) // held)))
            draws = draws.withColumn("again", again)
            draws = draws.withColumn("order", F.col("pair") + F.col("again").cast("long") * held).drop("again")
        else:
            draws = draws.withColumn("order", F.col("pair"))
        draws = draws.withColumn("couple", F.col("order") % couples)
        total = _Tally(0, 0, 0, [])
        made, swapped = [], []
        start, step, left = 0, max(LEAST_SWAPS, SWAPS_PER_COUPLE * couples), couples
        while start < turns and left and self.accepted + total.gained < self.options.target_pairs:
            end = turns if turns > held else min(turns, start + step)
            now = draws.where((F.col("order") >= start) & (F.col("order") < end))
            met = now.join(F.broadcast(couple) if left <= BROADCAST_KEYS else couple, "couple")
            scored = materialize(score_swaps(met, self.rules), "swaps")
            if turns > held:
                # Couples are the even nodes, pairs the odd ones.
                sides = {"left": F.col("couple") * 2, "right": F.col("pair") * 2 + 1}
                ends = scored.withColumns(sides)
                taken, gained = self._taken(ends)
                total = self._tally(ends, taken, gained)
                swapped.append(scored.join(taken.select("order"), "order"))
                break
            first, tally, rows = self._first_fits(scored, left, total.gained)
            total.made += tally.made
            total.gained += tally.gained
            total.shortcircuited += tally.shortcircuited
            made.append((rows, tally.made))
            swapped.append(rows.where(F.col("order") == F.col("at")))
            start, step, left = end, 2 * step, left - tally.gained
            if start < turns and left and tally.gained:
                couple = materialize(couple.join(first, "couple", "left_anti"), "couples")
        if made:
            total.last_failed = self._last_failed(made)
        chosen = materialize(reduce(DataFrame.unionAll, [x.select("pair", "pairs") for x in swapped]), "chosen-swaps")
        fresh = chosen.select(F.inline("pairs"))
        kept = pairs.join(chosen.select("pair"), "pair", "left_anti").select(*PAIR_COLUMNS)
        self.pairs = materialize(kept.unionAll(fresh), "pairs")
        now = fresh.select(F.explode(F.array("left_sequence", "right_sequence")).alias("sequence"))
        self._leave(now, total.gained)
        # A swap makes two draws, and gives up a pair that an earlier one had made.
        return _Tally(2 * total.made, total.gained, total.shortcircuited, [x for x in total.last_failed for _ in "ab"])

    def _first_fits(self, scored: DataFrame, couples: int, gained: int) -> tuple[DataFrame, _Tally, DataFrame]:
        """For swaps in which no pair comes twice: (couple, at) of the first that fits each couple, up to the target,
        the counts, and the swaps that were made with ``at``."""
        seen = Observation()
        first = scored.where("fits").groupBy("couple").agg(F.min("order").alias("at"))
        first = materialize(first.observe(seen, F.count(F.lit(1)).alias("n")), "first-fits")
        found, allowed = seen.get["n"], self.options.target_pairs - self.accepted - gained
        cut = nth_smallest(first, "at", allowed) if found >= allowed else None
        if cut is not None:
            first = first.where(F.col("at") <= cut)
        rows = scored.join(F.broadcast(first) if couples <= BROADCAST_KEYS else first, "couple", "left")
        rows = rows.where(F.coalesce("at", "order") >= F.col("order"))
        if cut is not None:
            rows = rows.where(F.col("order") <= cut)
        sums = rows.agg(F.count(F.lit(1)).alias("made"), F.sum("shortcircuited").alias("short")).first()
        return first, _Tally(sums.made, min(found, allowed), sums.short or 0, []), rows

    def _leave(self, paired: DataFrame, gained: int) -> None:
        self.free = materialize(self.free.join(paired, "sequence", "left_anti"), "free")
        self.accepted += gained
        self.unpaired -= 2 * gained


def pair_oligos(pool: DataFrame, rules: PairRules, options: PairingOptions) -> Pairing:
    """``rules`` are sense rules (see ``PairRules.anywhere``); ``pool`` needs unique sequences.

    ``requeue_scale`` times the pairs held are tried for swaps in a round (0: no pair is ever given up). Draws are laid
    out in whole layers, so drawing ends when the budget does not pay for a draw of all free oligos.
    """
    state = _Rounds(pool, rules, options)
    budget = max(1, state.count * options.attempts_multiplier)
    result = Pairing(pairs=state.pairs, free=state.free)
    since_best = 0
    recent: list[bool] = []

    def take_in(tally: _Tally, recycled: int) -> None:
        nonlocal since_best, recent
        result.attempts += tally.made
        result.recycled += recycled
        result.rejected += tally.made - tally.gained - recycled
        result.shortcircuited += tally.shortcircuited
        recent = (recent + tally.last_failed)[-max(1, options.rejection_window) :]
        since_best = 0 if tally.gained else since_best + tally.made
        result.held.append(state.accepted)

    def open_ends() -> bool:
        return state.unpaired >= 2 and state.accepted < options.target_pairs

    while (
        open_ends()
        and since_best < options.stagnation_attempts
        and budget - result.attempts >= state.unpaired // 2
    ):
        take_in(state.draw(budget - result.attempts), 0)
        if open_ends() and state.accepted and options.requeue_scale > 0 and budget - result.attempts >= 2:
            tally = state.swap(budget - result.attempts)
            take_in(tally, tally.gained)
    result.pairs, result.free = state.pairs, state.free
    result.accepted, result.unpaired = state.accepted, state.unpaired
    result.recent_rejection_rate = sum(recent) / len(recent) if recent else 0.0
    result.target_reached = state.accepted >= options.target_pairs
    return result
