"""The registered queries as plain SQL for DuckDB.

Written independently of the Spark operators: repeats by enumerated alternatives, self-pairing
by walking all diagonals, best runs by gaps and islands, pruning as the sequential rule.
"""

from __future__ import annotations

import math
from itertools import product

BASES = "ACGT"

# Published nearest-neighbour parameters, tenths of kcal/mol and cal/mol/K.
ENTHALPY = {
    "AA": -79, "AC": -84, "AG": -78, "AT": -72, "CA": -85, "CC": -80, "CG": -106, "CT": -78,
    "GA": -82, "GC": -98, "GG": -80, "GT": -84, "TA": -72, "TC": -82, "TG": -85, "TT": -79,
}
ENTROPY = {
    "AA": -222, "AC": -224, "AG": -210, "AT": -204, "CA": -227, "CC": -199, "CG": -272, "CT": -210,
    "GA": -222, "GC": -244, "GG": -199, "GT": -224, "TA": -213, "TC": -222, "TG": -227, "TT": -222,
}


def _dna(key: str, length: int = 20) -> str:
    digest = f"translate(md5(cast({key} AS varchar)), '0123456789abcdef', 'ACGTACGTACGTACGT')"
    return f"substr({digest}, 1, {length})"


ORDERS = f"cand AS (SELECT o_orderkey AS attempt_id, {_dna('o_orderkey')} AS sequence FROM orders)"
LINES = (
    "cand AS (SELECT l_orderkey * 8 + l_linenumber AS attempt_id,"
    f" {_dna(chr(39).join(['l_partkey || ', '-', ' || l_suppkey']))} AS sequence FROM lineitem)"
)


def _rc(seq: str) -> str:
    return f"reverse(translate({seq}, 'ACGT', 'TGCA'))"


def _case(table: dict[str, int], text: str) -> str:
    whens = " ".join(f"WHEN '{pair}' THEN {value}" for pair, value in table.items())
    return f"CASE {text} {whens} END"


def _tm(seq: str, strand: float = 500.0, sodium: float = 50.0, magnesium: float = 0.0) -> str:
    if magnesium:
        sodium += 120.0 * math.sqrt(magnesium)
    salt = 0.368 * math.log(sodium / 1000.0)
    strands = 1.987 * math.log((strand - strand / 2.0) * 1e-9)

    def total(table: dict[str, int], at: int, gc: int) -> str:
        ends = " + ".join(f"CASE WHEN {side}({seq}, 1) IN ('A', 'T') THEN {at} ELSE {gc} END" for side in ("left", "right"))
        pairs = f"coalesce(list_sum([{_case(table, f'substr({seq}, p, 2)')} for p in range(1, length({seq}))]), 0)"
        return f"({pairs} + {ends})"

    return (
        f"(1000.0::double * ({total(ENTHALPY, 23, 1)} / 10.0::double) / ({total(ENTROPY, 41, -28)} / 10.0::double"
        f" + (length({seq}) - 1) * ({salt!r})::double + ({strands!r})::double) - 273.15::double)"
    )


def _tandem(seq: str, unit: int, copies: int) -> str:
    words = "|".join("".join(letters) * copies for letters in product(BASES, repeat=unit))
    return f"regexp_matches({seq}, '{words}')"


def _longest_stem(seq: str, gap: int, length: int = 20) -> str:
    """Longest diagonal run of a sequence against its own reverse complement.

    Per diagonal, cells become 0/1 text (excluded cells 0); the longest block of 1s counts.
    """
    last = length - 1
    rows = (
        f"[array_to_string([CASE WHEN i + o < 0 OR i + o > {last} OR abs(({last} - (i + o)) - i) <= {gap}"
        f" OR substr({seq}, (i + 1)::int, 1) <> substr({_rc(seq)}, (i + o + 1)::int, 1) THEN '0' ELSE '1' END"
        f" for i in range(0, {length})], '') for o in range({-last}, {length})]"
    )
    return f"list_max([list_max([length(part) for part in string_split(row, '0')]) for row in {rows}])"


def _stem_at_least(seq: str, gap: int, run: int, length: int = 20) -> str:
    return f"{_longest_stem(seq, gap, length)} >= {run}"


_MOTIFS = "(contains(sequence, 'GAATTC') OR contains(sequence, 'GGATCC') OR contains(sequence, 'AAGCTT'))"

REASON = f"""CASE
 WHEN {_tandem('sequence', 1, 4)} THEN 'homopolymer'
 WHEN {_tandem('sequence', 3, 2)} THEN 'trinucleotide_repeat'
 WHEN NOT (tm BETWEEN 60 AND 65) THEN 'intrinsic_tm'
 WHEN {_tandem('sequence', 2, 3)} THEN 'dinucleotide_repeat'
 WHEN {_MOTIFS} THEN 'forbidden_motif'
 WHEN {_stem_at_least('sequence', 2, 6)} THEN 'self_complementarity'
 WHEN {_stem_at_least('sequence', 0, 14)} THEN 'near_palindrome'
 ELSE 'accepted' END"""

JUDGED = f"""melted AS (SELECT *, {_tm('sequence')} AS tm FROM cand),
judged AS (SELECT *, {REASON} AS reason FROM melted)"""

POOL = f"""{ORDERS},
{JUDGED},
pool AS MATERIALIZED (SELECT row_number() OVER (ORDER BY attempt_id) - 1 AS idx, sequence, {_rc('sequence')} AS rc, tm
 FROM judged WHERE reason = 'accepted'),
half AS (SELECT count(*) // 2 AS first_new FROM pool)"""


def _words(name: str, column: str, k: int, first: int, last: int) -> str:
    return (
        f"{name} AS (SELECT idx, {column} AS text, p - 1 AS pos, substr({column}, p::int, {k}) AS kmer"
        f" FROM pool, unnest(range({first}, {last + 1})) AS u(p))"
    )


def _candidates(k: int, window: int = 3) -> str:
    """CTE ``cand_pairs``: pairs left < right that share an anchored k-mer."""
    last = 20 - k + 1
    anchored = _words("anchored", "sequence", k, max(1, last - window + 1), last)
    partner = _words("partner", "rc", k, 1, last)
    return f"""{anchored}, {partner},
cand_pairs AS (SELECT DISTINCT a.idx AS left_index, p.idx AS right_index
 FROM anchored a JOIN partner p ON a.kmer = p.kmer WHERE a.idx < p.idx)"""


def _runs(k: int, anchored: bool, sense: bool, among: str | None = None, prefix: str = "") -> str:
    """CTE ``best``: best run of every (directed) pair that shares a k-mer, by gaps and islands."""
    last = 20 - k + 1
    column = "sequence" if sense else "rc"
    order = "a.idx <> p.idx" if sense else "a.idx < p.idx"
    if among:
        order = f"(a.idx, p.idx) IN (SELECT left_index, right_index FROM {among})"
    window = "AND start + len - 1 >= 17" if anchored else ""
    n = prefix
    return f"""{_words(f'{n}all_left', 'sequence', k, 1, last)}, {_words(f'{n}all_right', column, k, 1, last)},
{n}hits AS (SELECT a.idx AS left_index, p.idx AS right_index, a.text AS left_text, a.pos AS i, p.pos - a.pos AS run_offset
 FROM {n}all_left a JOIN {n}all_right p ON a.kmer = p.kmer WHERE {order}),
{n}islands AS (SELECT *, i - row_number() OVER (PARTITION BY left_index, right_index, run_offset ORDER BY i) AS island FROM {n}hits),
{n}runs AS (SELECT left_index, right_index, any_value(left_text) AS left_text, run_offset, min(i) AS start, count(*) + {k - 1} AS len
 FROM {n}islands GROUP BY left_index, right_index, run_offset, island),
{n}ranked AS (SELECT *, row_number() OVER (PARTITION BY left_index, right_index ORDER BY len DESC, run_offset, start) AS place
 FROM {n}runs WHERE true {window}),
{n}best AS (SELECT left_index, right_index, run_offset::int AS run_offset, start::int AS run_start, len::int AS run_length,
 substr(left_text, (start + 1)::int, len::int) AS run_sequence FROM {n}ranked WHERE place = 1)"""


def _edges(limit: float, k: int) -> str:
    return f"""{_runs(k, anchored=True, sense=False)},
scored AS (SELECT *, {_tm('run_sequence')} AS tm_c FROM best),
edges AS MATERIALIZED (SELECT * FROM scored WHERE tm_c > {limit})"""


_sense_runs = _runs(1, anchored=False, sense=True, among="both_ways", prefix="sense_")
_EDGE_COLUMNS = "left_index, right_index, run_length, run_sequence, round(tm_c, 4) AS tm_c"
# Runs above 30 C have at least seven bases; islands of shorter words would only cost time.
_EDGES_40 = f"WITH {POOL}, {_edges(40, 4)}"
_EDGES_30 = f"WITH RECURSIVE {POOL}, {_edges(30, 4)}"

_DEGREES = """ends AS (SELECT left_index AS idx FROM edges UNION ALL SELECT right_index FROM edges),
degrees AS (SELECT e.idx, any_value(p.sequence) AS sequence, count(*) AS degree
 FROM ends e JOIN pool p ON p.idx = e.idx GROUP BY e.idx)"""

# One removal per step: the conflicted oligo with the highest (degree, sequence).
_GREEDY = """graph AS (SELECT list({'l': e.left_index, 'r': e.right_index, 'ls': a.sequence, 'rs': b.sequence}) AS edge_list
 FROM edges e JOIN pool a ON a.idx = e.left_index JOIN pool b ON b.idx = e.right_index),
steps AS (
 SELECT 0 AS step, edge_list, NULL::BIGINT AS victim FROM graph
 UNION ALL
 SELECT step + 1, list_filter(edge_list, lambda e: e.l <> worst AND e.r <> worst), worst
 FROM (SELECT step, edge_list, list_aggregate(list_transform(list_distinct(ends), lambda v: {
   'degree': len(list_filter(ends, lambda w: w = v)), 'sequence': v.s, 'idx': v.i}), 'max').idx AS worst
  FROM (SELECT step, edge_list, list_concat([{'s': e.ls, 'i': e.l} for e in edge_list], [{'s': e.rs, 'i': e.r} for e in edge_list]) AS ends
   FROM steps WHERE len(edge_list) > 0)))"""

_SURVIVORS = f"""{_EDGES_30}, {_GREEDY}
SELECT idx, sequence FROM pool WHERE idx NOT IN (SELECT victim FROM steps WHERE victim IS NOT NULL)"""


def _digest(*parts: str) -> str:
    text = " || '-' || ".join(f"cast({p} AS varchar)" for p in parts)
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


def _sampled(size: int, seed: int) -> str:
    """More draws than needed do no harm: the first ``size`` different numbers count."""
    return f"""size AS (SELECT count(*) * (count(*) - 1) // 2 AS total FROM pool),
numbered AS (SELECT t AS draw, {_digest(seed, 't')} % total AS rank FROM size, unnest(range(0, {10 * size})) AS u(t)),
ranks AS (SELECT rank, min(draw) AS draw FROM numbered GROUP BY rank ORDER BY draw, rank LIMIT {size}),
sampled AS (SELECT r.rank - j * (j - 1) // 2 AS left_index, j AS right_index
 FROM ranks r, size, LATERAL (SELECT max(x) AS j FROM unnest([floor((1 + sqrt(1 + 8.0 * r.rank)) / 2)::BIGINT + d for d in [-1, 0, 1]]) AS v(x)
  WHERE x * (x - 1) // 2 <= r.rank)),
{_runs(1, anchored=True, sense=False, among='sampled')},
records AS (SELECT s.left_index, s.right_index, coalesce(b.run_length, 0) AS anchored_run_length,
 coalesce(b.run_sequence, '') AS anchored_run_sequence
 FROM sampled s LEFT JOIN best b USING (left_index, right_index)),
metrics AS (SELECT *, CASE WHEN anchored_run_length >= 4 THEN {_tm('anchored_run_sequence')} ELSE '-infinity'::double END AS tm
 FROM records)"""


def _best_text(x: str, y: str) -> str:
    """The longest common run of two 20-mers; of equally long ones that of the smallest offset, then start."""
    cells = (
        f"array_to_string([CASE WHEN i + o BETWEEN 0 AND 19 AND substr({x}, i + 1, 1) = substr({y}, i + o + 1, 1)"
        f" THEN substr({x}, i + 1, 1) ELSE ' ' END for i in range(0, 20)], '')"
    )
    texts = f"flatten([string_split({cells}, ' ') for o in range(-19, 20)])"
    return f"list_reduce({texts}, lambda p, q: CASE WHEN length(q) > length(p) THEN q ELSE p END)"


def _sense_tm(x: str, y: str, least: int) -> str:
    hot = f"CASE WHEN length(s) >= {least} THEN {_tm('s')} ELSE '-infinity'::double END"
    return f"list_max([{hot} for s in [{_best_text(x, y)}]])"


def _fits(x: str, y: str, limit: float, least: int) -> str:
    """Whether both sense scores of two oligos stay within the limit."""
    return f"({_sense_tm(x, y, least)} <= {limit} AND {_sense_tm(y, x, least)} <= {limit})"


def _pairing(limit: float, least: int, seed: int, window: int, draws: int = 50) -> str:
    """The sequential process, one layer of disjoint draws or one block of swaps a step.

    ``tries``: {u, v} to be paired, or to be swapped into the pair {l, r}; a block has no couple and no pair twice.
    """

    def shuffled(items: str, key: str, layer: str) -> str:
        keyed = f"[{{'h': {_digest(str(seed), layer, f'x{key}')}, 'x': x}} for x in {items}]"
        return f"[y.x for y in list_sort({keyed})]"

    pair, couple = "STRUCT(l VARCHAR, r VARCHAR)", "STRUCT(u VARCHAR, v VARCHAR)"
    budget, open_ends = f"{draws} * n - attempts", "len(free) >= 2 AND len(pairs) < n // 2"
    straight = f"{_fits('t.u', 't.l', limit, least)} AND {_fits('t.v', 't.r', limit, least)}"
    crossed = f"{_fits('t.u', 't.r', limit, least)} AND {_fits('t.v', 't.l', limit, least)}"
    listed = "list_contains(free, t.u) AND list_contains(free, t.v)"
    return f"""steps AS (
 SELECT 0 AS step, 'swap' AS phase, 1 AS layer, 0 AS k, 0 AS blocks, 0 AS turns, []::VARCHAR[] AS start, list(sequence) AS free,
  []::{pair}[] AS pairs, []::{couple}[] AS couples, []::{pair}[] AS old, true AS gained, 0 AS made, 0 AS attempts, 0 AS since,
  count(*) AS n FROM pool
 UNION ALL
 SELECT step + 1, phase, layer, k + 1, blocks, turns, start, list_filter(free, lambda s: NOT list_contains(used, s)),
  list_concat(list_filter(pairs, lambda q: NOT list_contains(given, q)), fresh), couples, old, gained OR len(fresh) > 0,
  made + len(live) * CASE phase WHEN 'draw' THEN 1 ELSE 2 END, attempts, since, n
 FROM (SELECT *,
   CASE phase WHEN 'draw' THEN [{{'l': t.u, 'r': t.v}} for t in ok] ELSE list_concat(
    flatten([[{{'l': t.u, 'r': t.l}}, {{'l': t.v, 'r': t.r}}] for t in ok]),
    flatten([[{{'l': t.u, 'r': t.r}}, {{'l': t.v, 'r': t.l}}] for t in ok_crossed])) END AS fresh,
   flatten([[t.u, t.v] for t in list_concat(ok, ok_crossed)]) AS used,
   CASE phase WHEN 'draw' THEN [] ELSE [{{'l': t.l, 'r': t.r}} for t in list_concat(ok, ok_crossed)] END AS given
  FROM (SELECT *, CASE phase WHEN 'draw' THEN [] ELSE list_filter(live, lambda t: NOT list_contains(ok, t) AND {crossed}) END AS ok_crossed
   FROM (SELECT *, CASE phase WHEN 'draw' THEN list_filter(live, lambda t: {_fits('t.u', 't.v', limit, least)})
     ELSE list_filter(live, lambda t: {straight}) END AS ok
    FROM (SELECT *, CASE phase WHEN 'draw' THEN list_filter(tries, lambda t: {listed})
      ELSE list_filter(tries, lambda t: {listed} AND list_contains(pairs, {{'l': t.l, 'r': t.r}})) END AS live
     FROM (SELECT *, CASE phase
       WHEN 'draw' THEN [{{'u': sorted[2 * i - 1], 'v': sorted[2 * i], 'l': '', 'r': ''}} for i in range(1, len(sorted) // 2 + 1)]
       ELSE [{{'u': couples[t % len(couples) + 1].u, 'v': couples[t % len(couples) + 1].v,
              'l': old[t % len(old) + 1].l, 'r': old[t % len(old) + 1].r}}
             for t in range(k * least(len(couples), len(old)), least(turns, (k + 1) * least(len(couples), len(old))))] END AS tries
      FROM (SELECT *, CASE phase WHEN 'draw' THEN {shuffled('start', '', 'layer + k')} ELSE [] END AS sorted
       FROM (
 -- A round goes on, or the next one begins: swaps after draws, draws while the last ones brought something.
 SELECT step, phase, layer, k, blocks, turns, start, free, pairs, couples, old, gained, made, attempts, since, n FROM steps
 WHERE k < blocks
 UNION ALL
 SELECT step, 'swap', layer, 0, (turns + least(len(couples), len(pairs)) - 1) // least(len(couples), len(pairs)), turns,
  start, free, pairs, couples, old, false, 0, attempts, since, n
 FROM (SELECT *, least(greatest({window}, len(pairs)), ({budget}) // 2) AS turns,
   [{{'u': h[2 * i - 1], 'v': h[2 * i]}} for i in range(1, len(h) // 2 + 1)] AS couples
  FROM (SELECT step, layer, start, free, pairs, attempts, since, n, {shuffled('free', '', 'layer')} AS h,
    {shuffled('pairs', '.l', 'layer')} AS old
   FROM (SELECT step, layer + blocks AS layer, start, free, pairs, attempts + made AS attempts,
     CASE WHEN gained THEN 0 ELSE since + made END AS since, n FROM steps WHERE k = blocks AND phase = 'draw')
   WHERE {open_ends} AND len(pairs) > 0 AND {budget} >= 2))
 UNION ALL
 SELECT step, 'draw', layer, 0, least((greatest({window}, 2 * len(free)) + len(free) // 2 - 1) // (len(free) // 2), ({budget}) // (len(free) // 2)),
  0, free, free, pairs, [], [], false, 0, attempts, since, n
 FROM (SELECT step, layer + CASE phase WHEN 'draw' THEN blocks ELSE least(step, 1) END AS layer, free, pairs, attempts + made AS attempts,
   CASE WHEN gained THEN 0 ELSE since + made END AS since, phase, n FROM steps WHERE k = blocks)
 WHERE {open_ends} AND since < {window} AND {budget} >= len(free) // 2
  AND (phase = 'swap' OR len(pairs) = 0 OR {budget} < 2)))))))))"""


_SAMPLE = f"WITH {POOL}, {_sampled(4000, 12345)}"

FUNNEL_ORDER = (
    "duplicate", "homopolymer", "trinucleotide_repeat", "intrinsic_tm",
    "dinucleotide_repeat", "forbidden_motif", "self_complementarity", "near_palindrome",
)

# A repeated sequence is a duplicate from its second proposal on.
_LINE_REASONS = f"""WITH {LINES},
numbered AS (SELECT *, row_number() OVER (PARTITION BY sequence ORDER BY attempt_id) AS nth FROM cand),
firsts AS (SELECT attempt_id, sequence, {_tm('sequence')} AS tm FROM numbered WHERE nth = 1),
reasons AS (SELECT {REASON} AS reason FROM firsts UNION ALL SELECT 'duplicate' FROM numbered WHERE nth > 1)"""

_STAGES = ", ".join(f"({i}, '{name}')" for i, name in enumerate(FUNNEL_ORDER))


def _orders(select: str) -> str:
    return f"WITH {ORDERS} {select}"


def _rejected(condition: str) -> str:
    return _orders(f"SELECT attempt_id, sequence FROM cand WHERE {condition}")


def _code(seq: str) -> str:
    return (
        f"list_sum([(strpos('ACGT', substr({seq}, p::int, 1)) - 1)::BIGINT * (1::BIGINT << (2 * (20 - p))::int)"
        " for p in range(1, 21)])::BIGINT"
    )


def _first_accepted(key: str, size: int) -> str:
    return f"""WITH proposed AS (SELECT o_orderkey AS attempt_id, {_dna(key)} AS sequence FROM orders),
cand AS (SELECT sequence, min(attempt_id) AS attempt_id FROM proposed GROUP BY sequence),
{JUDGED}
SELECT row_number() OVER (ORDER BY attempt_id) - 1 AS idx, attempt_id, sequence, {_rc('sequence')} AS reverse_complement,
 round(length(regexp_replace(sequence, '[AT]', '', 'g')) / 20.0::double, 4) AS gc_fraction, round(tm, 4) AS intrinsic_tm_c
FROM judged WHERE reason = 'accepted' ORDER BY attempt_id LIMIT {size}"""


def _draw(slot: str) -> str:
    """Six hexadecimal digits of the digest of the slot's block of ten."""
    digest = f"sha256('12345-' || cast(o_orderkey AS varchar) || '-' || cast({slot} // 10 AS varchar))"
    return f"('0x' || substr({digest}, ({slot} % 10) * 6 + 1, 6))::BIGINT"


# GC counts of 9, 10 or 11; the first of the slots become C or G, the others A or T, and their draws shuffle them.
_PROPOSALS = f"""WITH counted AS (SELECT o_orderkey,
 ('0x' || substr(sha256('12345-' || cast(o_orderkey AS varchar) || '-0'), 61, 4))::BIGINT % 3 + 9 AS gc FROM orders),
slots AS (SELECT o_orderkey, gc, s, {_draw('s')} AS draw FROM counted, unnest(range(0, 20)) AS u(s))
SELECT o_orderkey AS attempt_id, string_agg(CASE WHEN s < gc THEN CASE WHEN draw % 2 = 0 THEN 'C' ELSE 'G' END
 WHEN draw % 2 = 0 THEN 'A' ELSE 'T' END, '' ORDER BY draw, s) AS sequence FROM slots GROUP BY o_orderkey"""


ORACLE_SQL: dict[str, str] = {
    "dna_bridge": _orders("SELECT attempt_id, sequence FROM cand"),
    "reverse_complement": _orders(
        "SELECT attempt_id, translate(sequence, 'ACGT', 'TGCA') AS complement,"
        f" {_rc('sequence')} AS reverse_complement FROM cand"
    ),
    "gc_fraction": _orders(
        "SELECT attempt_id, length(regexp_replace(sequence, '[AT]', '', 'g')) AS gc_count,"
        " round(length(regexp_replace(sequence, '[AT]', '', 'g')) / length(sequence)::double, 4) AS gc_fraction FROM cand"
    ),
    "encode_2bit": _orders(
        f"SELECT attempt_id, {_code('sequence')} AS code, sequence AS decoded,"
        f" {_code(_rc('sequence'))} AS reverse_complement_code FROM cand"
    ),
    "intrinsic_tm": _orders(f"SELECT attempt_id, round({_tm('sequence')}, 4) AS tm_c FROM cand"),
    "intrinsic_tm_magnesium": _orders(
        f"SELECT attempt_id, round({_tm('sequence', 250.0, 50.0, 1.5)}, 4) AS tm_c FROM cand"
    ),
    "max_tm_by_length": f"""WITH {POOL},
words AS (SELECT substr(sequence, p::int, n::int) AS word FROM pool, unnest(range(2, 21)) AS a(n), unnest(range(1, 20)) AS b(p)
 WHERE p + n <= 21)
SELECT length(word)::int AS length, round(max({_tm('word')}), 4) AS max_tm_c FROM words GROUP BY 1""",
    "gc_embedding": _orders(
        """, counted AS (SELECT length(regexp_replace(substr(sequence, p::int, 9), '[AT]', '', 'g')) AS gc
 FROM cand, unnest(range(1, 13)) AS u(p))
SELECT gc, count(*) AS fragments, gc + 11 >= 9 AND gc <= 11 AS embeddable FROM counted GROUP BY gc"""
    ),
    "alphabet_guard": """SELECT o_orderkey AS attempt_id, upper(substr(md5(cast(o_orderkey AS varchar)), 1, 3)) AS text
FROM orders WHERE regexp_full_match(upper(substr(md5(cast(o_orderkey AS varchar)), 1, 3)), '[ACGT]+')""",
    "word_coverage": f"""WITH {ORDERS},
bases AS (SELECT unnest(['A', 'C', 'G', 'T']) AS base),
words AS (SELECT a.base || b.base || c.base || d.base || e.base AS sequence FROM bases a, bases b, bases c, bases d, bases e),
begun AS (SELECT substr(sequence, 1, 5) AS sequence, count(*) AS n FROM cand GROUP BY 1)
SELECT row_number() OVER (ORDER BY sequence) - 1 AS id, sequence, coalesce(n, 0) AS candidates
FROM words LEFT JOIN begun USING (sequence)""",
    "flt_homopolymer": _rejected(_tandem("sequence", 1, 4)),
    "flt_dinuc": _rejected(_tandem("sequence", 2, 3)),
    "flt_trinuc": _rejected(_tandem("sequence", 3, 2)),
    "flt_motif": _rejected(_MOTIFS),
    "flt_motif_both_strands": _rejected("regexp_matches(sequence, 'GAAGA|TCTTC|CTGCA|TGCAG')"),
    "flt_tm_window": _rejected(f"NOT ({_tm('sequence')} BETWEEN 60 AND 65)"),
    "flt_self_comp": _rejected(_stem_at_least("sequence", 2, 6)),
    "self_run_length": _orders(
        f"SELECT attempt_id, {_longest_stem('sequence', 0)}::int AS run_gap_0, {_longest_stem('sequence', 2)}::int AS run_gap_2 FROM cand"
    ),
    "flt_motif_list": f"""WITH {ORDERS},
drawn AS (SELECT substr({_dna('p_partkey')}, 1, 7 + p_partkey % 3) AS motif FROM part),
banned AS (SELECT motif FROM drawn UNION SELECT {_rc('motif')} FROM drawn),
words AS (SELECT attempt_id, sequence, substr(sequence, p::int, n::int) AS word
 FROM cand, unnest(range(1, 21)) AS a(p), unnest([7, 8, 9]) AS b(n) WHERE p + n <= 21)
SELECT DISTINCT attempt_id, sequence FROM words JOIN banned ON word = motif""",
    "gate_search": f"""WITH {POOL},
letters AS (SELECT unnest(range(2, 9)) AS n),
codes AS (SELECT n, unnest(range(0, 1::BIGINT << (2 * n)::int))::BIGINT AS code FROM letters),
texts AS (SELECT n, array_to_string([substr('ACGT', 1 + ((code >> (2 * p)) & 3)::int, 1) for p in range(0, n)], '') AS sequence FROM codes),
counted AS (SELECT n, sequence, length(regexp_replace(sequence, '[AT]', '', 'g')) AS gc FROM texts),
allowed AS (SELECT n, max({_tm('sequence')}) AS tm FROM counted
 WHERE greatest(9, gc) <= least(11, gc + 20 - n) AND NOT {_tandem('sequence', 1, 4)} AND NOT {_tandem('sequence', 2, 3)}
  AND NOT {_tandem('sequence', 3, 2)} GROUP BY n),
limits(label, threshold) AS (VALUES ('reverse_complement', 40.0), ('sense', 30.0)),
gates AS (SELECT label, min(n)::int AS length, arg_min(tm, n) AS max_tm_c FROM limits JOIN allowed ON tm > threshold GROUP BY label),
held AS (SELECT label, count(DISTINCT idx) AS oligos FROM gates, pool, unnest(range(1, 20)) AS u(w)
 WHERE w + length <= 21 AND {_tm("substr(sequence, w::int, length)")} > max_tm_c - 1e-6 GROUP BY label)
SELECT label, length, round(max_tm_c, 4) AS max_tm_c, coalesce(oligos, 0) AS oligos FROM gates LEFT JOIN held USING (label)""",
    "flt_near_palindrome": _rejected(_stem_at_least("sequence", 0, 7)),
    "funnel_reason": f"WITH {ORDERS}, {JUDGED} SELECT attempt_id, reason FROM judged",
    "funnel_counts": f"{_LINE_REASONS} SELECT reason, count(*) AS n FROM reasons GROUP BY reason",
    "funnel_table": f"""{_LINE_REASONS},
stages(stage, filter) AS (VALUES {_STAGES}),
counted AS (SELECT stage::int AS stage, filter, count(reason) AS n, (SELECT count(*) FROM reasons) AS attempts
 FROM stages LEFT JOIN reasons ON filter = reason GROUP BY stage, filter),
flow AS (SELECT *, (attempts - coalesce(sum(n) OVER (ORDER BY stage ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS reaching FROM counted)
SELECT stage, filter, n AS "count", round(n / attempts::double, 6) AS fraction_of_attempts, reaching AS attempts_reaching_filter,
 round(CASE WHEN reaching = 0 THEN 0 ELSE n / reaching::double END, 6) AS fraction_of_reaching_filter FROM flow""",
    "dedup_first": f"WITH {LINES} SELECT sequence, min(attempt_id) AS attempt_id, count(*) AS proposals FROM cand GROUP BY sequence",
    "accept_prefix": _first_accepted("o_orderkey", 1000),
    "accept_prefix_repeats": _first_accepted("o_custkey", 100),
    "funnel_counts_to_cut": f"""WITH cand AS (SELECT o_orderkey AS attempt_id, {_dna('o_custkey')} AS sequence FROM orders),
numbered AS (SELECT *, row_number() OVER (PARTITION BY sequence ORDER BY attempt_id) AS nth FROM cand),
firsts AS (SELECT attempt_id, sequence, {_tm('sequence')} AS tm FROM numbered WHERE nth = 1),
verdicts AS (SELECT attempt_id, {REASON} AS reason FROM firsts),
cut AS (SELECT coalesce((SELECT attempt_id FROM verdicts WHERE reason = 'accepted' ORDER BY attempt_id LIMIT 1 OFFSET 99),
 (SELECT max(attempt_id) FROM cand)) AS last_attempt),
reasons AS (SELECT reason FROM verdicts, cut WHERE attempt_id <= last_attempt
 UNION ALL SELECT 'duplicate' FROM numbered, cut WHERE nth > 1 AND attempt_id <= last_attempt)
SELECT reason, count(*) AS n, any_value(last_attempt) AS last_attempt FROM reasons, cut GROUP BY reason""",
    "rejection_rolling": f"""WITH {ORDERS}, {JUDGED}
SELECT attempt_id, round(avg((reason <> 'accepted')::int) OVER (ORDER BY attempt_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 6) AS rate
FROM judged""",
    "kmers_3prime": f"WITH {POOL}, {_words('w', 'sequence', 8, 11, 13)} SELECT DISTINCT idx, kmer FROM w",
    "kmers_rc": f"WITH {POOL}, {_words('w', 'rc', 8, 1, 13)} SELECT DISTINCT idx, kmer FROM w",
    "candidate_pairs_gate": f"WITH {POOL}, {_candidates(8)} SELECT left_index, right_index FROM cand_pairs",
    "candidate_pairs_delta": f"""WITH {POOL}, {_candidates(8)}
SELECT left_index, right_index FROM cand_pairs WHERE right_index >= (SELECT first_new FROM half)""",
    "candidate_pair_counts": " UNION ALL ".join(
        f"""(WITH {POOL}, {_candidates(k)}
SELECT {k} AS k, '{scope}' AS scope, count(*) AS pairs FROM cand_pairs{where})"""
        for k in (4, 8)
        for scope, where in (("all", ""), ("with_new", " WHERE right_index >= (SELECT first_new FROM half)"))
    ),
    "candidate_pair_counts_windows": " UNION ALL ".join(
        f"""(WITH {POOL}, {_candidates(6, window)}
SELECT {window} AS "window", '{scope}' AS scope, count(*) AS pairs FROM cand_pairs{where})"""
        for window in (3, 8, 20)
        for scope, where in (("all", ""), ("with_new", " WHERE right_index >= (SELECT first_new FROM half)"))
    ),
    "pair_slots": f"""WITH {POOL},
n AS (SELECT count(*) AS oligos, (SELECT first_new FROM half) AS old FROM pool)
SELECT oligos, oligos AS new_oligos, oligos * (oligos - 1) // 2 AS pair_slots, 'all' AS scope FROM n
UNION ALL SELECT oligos, oligos - old, oligos * (oligos - 1) // 2 - old * (old - 1) // 2, 'with_new' FROM n""",
    "pair_accounting": f"""WITH {POOL}, {_candidates(4)},
n AS (SELECT count(*) * (count(*) - 1) // 2 AS slots FROM pool),
m AS (SELECT count(*) AS min_pairs FROM cand_pairs),
g AS (SELECT count(*) AS active_pairs FROM (SELECT DISTINCT a.idx, p.idx FROM
 (SELECT idx, unnest([substr(sequence, p::int, 8) for p in range(11, 14)]) AS w FROM pool) a
 JOIN (SELECT idx, unnest([substr(rc, p::int, 8) for p in range(1, 14)]) AS w FROM pool) p ON a.w = p.w AND a.idx < p.idx))
SELECT slots AS pair_slots, slots - min_pairs AS below_min_alignment_run, min_pairs - active_pairs AS tms_shortcircuited,
 active_pairs AS tm_evaluations FROM n, m, g""",
    "best_run_anchored": f"""WITH {POOL}, {_runs(7, anchored=True, sense=False)}
SELECT left_index, right_index, run_length, run_start, run_offset, run_sequence,
 CASE WHEN run_length >= 8 THEN round({_tm('run_sequence')}, 4) ELSE '-infinity'::double END AS tm_c,
 run_length < 4 AS below_min_alignment_run, run_length < 8 AS tm_shortcircuited, run_length >= 8 AS tm_evaluated FROM best""",
    "conflict_edges": f"{_EDGES_40} SELECT {_EDGE_COLUMNS} FROM edges",
    "conflict_edges_dense": f"{_EDGES_30} SELECT {_EDGE_COLUMNS} FROM edges",
    "conflict_edges_shared_text": f"""WITH {POOL.replace("pool AS MATERIALIZED", "plain_pool AS MATERIALIZED").split(",\nhalf AS")[0]},
pool AS MATERIALIZED (SELECT idx, sequence, {_rc('sequence')} AS rc FROM (
 SELECT idx, CASE WHEN idx % 3 = 0 THEN substr(sequence, 1, 12) || 'GCGCGCGC' ELSE sequence END AS sequence FROM plain_pool)),
{_edges(30, 4)}
SELECT left_index, right_index, round(tm_c, 4) AS tm_c FROM edges""",
    "conflict_edges_delta": f"""{_EDGES_30} SELECT left_index, right_index, round(tm_c, 4) AS tm_c FROM edges
WHERE right_index >= (SELECT first_new FROM half)""",
    "index_after_removal": f"""WITH {POOL},
live AS (SELECT idx, sequence FROM pool, half WHERE NOT (idx < first_new AND idx % 3 = 0) AND NOT starts_with(sequence, 'A')),
suffixes AS (SELECT idx, e::int AS last, n, substr(sequence, (e + 2 - n)::int, n::int) AS suffix
 FROM live, unnest([17, 18, 19]) AS a(e), unnest(range(4, 21)) AS b(n) WHERE n <= e + 1),
hot AS (SELECT *, row_number() OVER (PARTITION BY idx, last ORDER BY n) AS nth FROM suffixes WHERE {_tm('suffix')} > 30)
SELECT idx, last, suffix FROM hot WHERE nth = 1""",
    "sense_conflicts": f"""WITH {POOL}, {_runs(7, anchored=False, sense=True)},
scored AS (SELECT *, {_tm('run_sequence')} AS tm_c FROM best)
SELECT {_EDGE_COLUMNS} FROM scored WHERE tm_c > 30""",
    "sense_pair_scores": f"""WITH {POOL}, {_edges(30, 4)},
both_ways AS (SELECT left_index, right_index FROM edges UNION ALL SELECT right_index, left_index FROM edges),
{_sense_runs}
SELECT e.left_index, e.right_index, f.run_length AS fwd_length, f.run_sequence AS fwd_sequence, r.run_length AS rev_length,
 r.run_sequence AS rev_sequence, greatest(CASE WHEN f.run_length >= 7 THEN round({_tm('f.run_sequence')}, 4) ELSE '-infinity'::double END,
 CASE WHEN r.run_length >= 7 THEN round({_tm('r.run_sequence')}, 4) ELSE '-infinity'::double END) AS pair_tm_c
FROM edges e JOIN sense_best f ON f.left_index = e.left_index AND f.right_index = e.right_index
JOIN sense_best r ON r.left_index = e.right_index AND r.right_index = e.left_index""",
    "conflict_degree": f"{_EDGES_30}, {_DEGREES} SELECT idx, degree FROM degrees",
    "conflict_summary": f"""{_EDGES_30}, {_DEGREES}
SELECT (SELECT count(*) FROM edges) AS conflict_edges, count(*) AS conflicted_oligos, max(degree) AS max_degree FROM degrees""",
    "mis_round1_victims": f"""{_EDGES_30}, {_DEGREES},
both_ways AS (SELECT left_index AS a, right_index AS b FROM edges UNION ALL SELECT right_index, left_index FROM edges)
SELECT idx, degree FROM degrees d WHERE NOT EXISTS (SELECT 1 FROM both_ways w JOIN degrees o ON o.idx = w.b
 WHERE w.a = d.idx AND (o.degree > d.degree OR (o.degree = d.degree AND o.sequence > d.sequence)))""",
    "mis_survivors": _SURVIVORS,
    "mis_survivors_rounds": _SURVIVORS,
    "final_oligos": f"""{_EDGES_40.replace('WITH ', 'WITH RECURSIVE ', 1)}, {_GREEDY}
SELECT sequence, rc AS reverse_complement, round(length(regexp_replace(sequence, '[AT]', '', 'g')) / 20.0::double, 4) AS gc_fraction,
 round(tm, 4) AS intrinsic_tm_c
FROM pool WHERE idx NOT IN (SELECT victim FROM steps WHERE victim IS NOT NULL)""",
    "trimmed_oligos": f"SELECT idx, sequence FROM ({_SURVIVORS}) ORDER BY idx LIMIT 500",
    "calib_pair_sample": f"""{_SAMPLE} SELECT left_index, right_index, anchored_run_length::int AS anchored_run_length,
 CASE WHEN isinf(tm) THEN tm ELSE round(tm, 4) END AS heterodimer_tm_c, tm > 10 AS is_conflict FROM metrics""",
    "calib_histogram": f"""{_SAMPLE},
bins AS (SELECT unnest(range(0, max(anchored_run_length) + 1))::int AS anchored_run_length FROM metrics)
SELECT b.anchored_run_length, count(m.tm) AS pair_count, count(*) FILTER (WHERE m.tm > 10) AS conflict_count,
 CASE WHEN count(m.tm) > 0 THEN round(count(*) FILTER (WHERE m.tm > 10) / count(m.tm)::double, 6) END AS conflict_rate
FROM bins b LEFT JOIN metrics m ON m.anchored_run_length = b.anchored_run_length GROUP BY b.anchored_run_length""",
    "calib_rates": f"""{_SAMPLE} SELECT count(*) AS pair_count, count(*) FILTER (WHERE tm > 10) AS conflict_count,
 round(avg((tm > 10)::int), 6) AS conflict_probability FROM metrics""",
    "accept_second_cycle": f"""WITH {POOL}
SELECT p.idx, c.attempt_id, p.sequence FROM pool p JOIN cand c USING (sequence), half
WHERE idx >= first_new AND idx < first_new + 200""",
    "delivery_order": f"""SELECT idx, sequence, row_number() OVER (ORDER BY idx) - 1 AS place FROM ({_SURVIVORS})""",
    "conflict_order": f"""{_EDGES_30}
SELECT left_index, right_index, row_number() OVER (ORDER BY left_index, right_index) - 1 AS place FROM edges""",
    "gc_balanced_proposals": _PROPOSALS,
    "pairing_first_round": f"""WITH {POOL},
shuffled AS (SELECT idx, sequence, {_digest(12345, 1, 'sequence')} AS h, {_digest(12345, 1, 'sequence')}
  % greatest(1, (count(*) OVER () + 49999) // 50000) AS bucket FROM pool),
placed AS (SELECT *, row_number() OVER w AS place, lead(sequence) OVER w AS right_sequence, lead(idx) OVER w AS right_idx
 FROM shuffled WINDOW w AS (PARTITION BY bucket ORDER BY h, sequence)),
drawn AS (SELECT bucket * 1048576 + place AS draw, idx AS l, right_idx AS r, sequence AS left_sequence, right_sequence
 FROM placed WHERE place % 2 = 1 AND right_sequence IS NOT NULL),
both_ways AS (SELECT l AS left_index, r AS right_index FROM drawn UNION ALL SELECT r, l FROM drawn),
{_sense_runs},
melted_runs AS (SELECT left_index, right_index, CASE WHEN run_length >= 7 THEN {_tm('run_sequence')} ELSE '-infinity'::double END AS tm
 FROM sense_best),
scores AS (SELECT draw AS "order", left_sequence, right_sequence, coalesce(f.tm, '-infinity'::double) AS fwd,
 coalesce(b.tm, '-infinity'::double) AS rev
 FROM drawn LEFT JOIN melted_runs f ON f.left_index = l AND f.right_index = r
 LEFT JOIN melted_runs b ON b.left_index = r AND b.right_index = l)
SELECT "order", left_sequence, right_sequence, CASE WHEN isinf(fwd) THEN fwd ELSE round(fwd, 4) END AS left_vs_right_sense_tm_c,
 CASE WHEN isinf(rev) THEN rev ELSE round(rev, 4) END AS right_vs_left_sense_tm_c, greatest(fwd, rev) <= 30 AS fits FROM scores""",
    "pairing_complete": f"""WITH RECURSIVE {POOL},
{_pairing(-30.0, 4, 12345, 200)},
final AS (SELECT unnest(arg_max(pairs, step)) AS p FROM steps),
scores AS (SELECT p.l AS left_sequence, p.r AS right_sequence, {_sense_tm('p.l', 'p.r', 4)} AS fwd, {_sense_tm('p.r', 'p.l', 4)} AS rev
 FROM final)
SELECT left_sequence, right_sequence, CASE WHEN isinf(fwd) THEN fwd ELSE round(fwd, 4) END AS left_vs_right_sense_tm_c,
 CASE WHEN isinf(rev) THEN rev ELSE round(rev, 4) END AS right_vs_left_sense_tm_c FROM scores""",
    "calib_search_estimate": f"""{_SAMPLE},
chance AS (SELECT avg((tm > 10)::int) AS p FROM metrics),
sizes AS (SELECT unnest([count(*), count(*) // 2, count(*) // 10]) AS oligos FROM pool),
degrees AS (SELECT oligos, p * (oligos - 1) AS degree FROM sizes, chance)
SELECT oligos, round(degree, 4) AS mean_conflict_degree,
 round(CASE WHEN degree > 0 THEN (1 - exp(-degree)) / degree ELSE 1.0 END, 6) AS retained_share FROM degrees""",
    "pair_score_records": f"""{_SAMPLE} SELECT left_index, right_index, anchored_run_length::int AS anchored_run_length,
 anchored_run_sequence, CASE WHEN anchored_run_length >= 8 THEN round({_tm('anchored_run_sequence')}, 4) ELSE '-infinity'::double END AS tm_c,
 anchored_run_length < 4 AS below_min_alignment_run, anchored_run_length BETWEEN 4 AND 7 AS tm_shortcircuited,
 anchored_run_length >= 8 AS tm_evaluated FROM records""",
    "pair_score_totals": f"""{_SAMPLE} SELECT count(*) FILTER (WHERE anchored_run_length < 4) AS below_min_alignment_run,
 count(*) FILTER (WHERE anchored_run_length BETWEEN 4 AND 7) AS tm_shortcircuited,
 count(*) FILTER (WHERE anchored_run_length >= 8) AS tm_evaluated FROM records""",
}
