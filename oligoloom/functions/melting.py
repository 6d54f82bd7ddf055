"""Nearest-neighbour melting temperature as column expressions.

The duplex is perfect, so enthalpy and entropy are a sum over neighbouring bases plus one
term per end (unified parameters of Allawi & SantaLucia 1997 with the entropy salt
correction of SantaLucia 1998; magnesium enters as a sodium equivalent after von Ahsen et
al. 2001). The published tables have one decimal, so the sums are kept as exact integers
in tenths and only the closing formula is floating point: the result does not depend on
the order of summation or on how the work is partitioned.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oligoloom.functions.sequence import ALPHABET, MAX_PACKED, pack

# Published nearest-neighbour parameters (kcal/mol and cal/mol/K).
NEIGHBOUR_PARAMETERS = {
    "AA": (-7.9, -22.2),
    "AC": (-8.4, -22.4),
    "AG": (-7.8, -21.0),
    "AT": (-7.2, -20.4),
    "CA": (-8.5, -22.7),
    "CC": (-8.0, -19.9),
    "CG": (-10.6, -27.2),
    "CT": (-7.8, -21.0),
    "GA": (-8.2, -22.2),
    "GC": (-9.8, -24.4),
    "GG": (-8.0, -19.9),
    "GT": (-8.4, -22.4),
    "TA": (-7.2, -21.3),
    "TC": (-8.2, -22.2),
    "TG": (-8.5, -22.7),
    "TT": (-7.9, -22.2),
}
TERMINAL_AT = (2.3, 4.1)
TERMINAL_GC = (0.1, -2.8)
GAS_CONSTANT = 1.987
KELVIN = 273.15
SALT_FACTOR = 0.368
MAGNESIUM_FACTOR = 120.0

# Enthalpy and entropy travel through one sum: tenths of -dH above bit 20, of -dS below.
_SHIFT = 20
_LOW = (1 << _SHIFT) - 1


def _tenths(value: float) -> int:
    return round(-value * 10)


_PAIR_SUMS = [
    (_tenths(NEIGHBOUR_PARAMETERS[a + b][0]) << _SHIFT) + _tenths(NEIGHBOUR_PARAMETERS[a + b][1])
    for a in ALPHABET
    for b in ALPHABET
]


@dataclass(frozen=True)
class Chemistry:
    """Reaction conditions; concentrations in nM (strands) and mM (ions)."""

    strand_nm: float = 250.0
    monovalent_mm: float = 50.0
    magnesium_mm: float = 0.0

    @property
    def salt_entropy(self) -> float:
        """Entropy added per neighbouring pair."""
        sodium = self.monovalent_mm
        if self.magnesium_mm > 0:
            sodium += MAGNESIUM_FACTOR * math.sqrt(self.magnesium_mm)
        return SALT_FACTOR * math.log(sodium / 1000.0)

    @property
    def strand_entropy(self) -> float:
        """R ln k with both strands at the same concentration."""
        return GAS_CONSTANT * math.log((self.strand_nm - self.strand_nm / 2.0) * 1e-9)


# The expressions below are long and regular, so they are spelled as SQL text and parsed once:
# building them call by call from Python takes seconds.
_PAIR_TABLE = f"array({', '.join(f'{v}L' for v in _PAIR_SUMS)})"


def double_sql(value: float) -> str:
    return f"double('{value!r}')"


def pair_sum_sql(packed: str, from_end: int) -> str:
    """Table entry of the neighbouring pair that ends ``from_end`` bases before the last."""
    return f"get({_PAIR_TABLE}, int(shiftright({packed}, {2 * from_end}) & 15))"


def is_at_sql(packed: str, from_end: int) -> str:
    """1 if the packed base ``from_end`` positions before the last is an A or a T, else 0."""
    return f"int((shiftright({packed}, {2 * from_end}) & 3) in (0, 3))"


def tm_sql(sums: str, at_ends: str, length: str | int, chemistry: Chemistry) -> str:
    """Closing formula from the pair sum, the number of A/T ends (0..2) and the length."""

    def ends(which: int) -> str:
        return f"({at_ends}) * ({_tenths(TERMINAL_AT[which])}) + (2 - ({at_ends})) * ({_tenths(TERMINAL_GC[which])})"

    enthalpy = f"double(shiftright({sums}, {_SHIFT}) + {ends(0)}) / -10D"
    entropy = (
        f"double(({sums} & {_LOW}) + {ends(1)}) / -10D"
        f" + double({length} - 1) * {double_sql(chemistry.salt_entropy)} + {double_sql(chemistry.strand_entropy)}"
    )
    return f"(1000D * ({enthalpy}) / ({entropy}) - {double_sql(KELVIN)})"


# Code and "is A or T" of a byte, for arrays of bases.
_CODES, _IS_AT = np.zeros(256, np.uint8), np.zeros(256, np.int64)
for _code, _base in enumerate(ALPHABET.encode()):
    _CODES[_base], _IS_AT[_base] = _code, _code in (0, 3)


def run_tm(bases: np.ndarray, start: np.ndarray, size: np.ndarray, chemistry: Chemistry) -> np.ndarray:
    """Melting temperatures of stretches of texts, given as bytes (a row for each position): the terms of
    :func:`tm_sql` in their order, so that the results are the same to the last bit."""
    length, n = bases.shape
    codes, row, last = _CODES[bases], np.arange(n), start + size - 1
    sums = np.zeros((length, n), np.int64)
    if length > 1:
        np.cumsum(np.array(_PAIR_SUMS)[codes[:-1] * 4 + codes[1:]], axis=0, out=sums[1:])
    sums = sums[last, row] - sums[start, row]
    at_ends = _IS_AT[bases[start, row]] + _IS_AT[bases[last, row]]
    ends = [at_ends * _tenths(TERMINAL_AT[which]) + (2 - at_ends) * _tenths(TERMINAL_GC[which]) for which in (0, 1)]
    enthalpy = ((sums >> _SHIFT) + ends[0]).astype(np.float64) / -10.0
    entropy = ((sums & _LOW) + ends[1]).astype(np.float64) / -10.0
    entropy = entropy + (size - 1).astype(np.float64) * chemistry.salt_entropy + chemistry.strand_entropy
    return 1000.0 * enthalpy / entropy - KELVIN


def _blocks(length: int) -> list[tuple[int, int]]:
    """(bases behind the block, bases in it) from the 3' end; neighbours share one base."""
    blocks = [(0, min(MAX_PACKED, length))]
    while sum(blocks[-1]) < length:
        behind = sum(blocks[-1]) - 1
        blocks.append((behind, min(MAX_PACKED, length - behind)))
    return blocks


def with_tm(
    rows: DataFrame,
    seq: str,
    out: str,
    max_length: int,
    chemistry: Chemistry,
    packed: str | None = None,
    fixed: bool = False,
) -> DataFrame:
    """Add the melting temperature of ``seq``, strings of 1 to ``max_length`` bases.

    ``fixed`` says that all strings have exactly ``max_length`` bases; ``packed`` names a
    column that already holds their code. A single base has no neighbouring pair, only end
    terms; callers that need the "too short" sentinel apply it themselves.
    """
    terms, staged = ["0L"], []
    for behind, size in _blocks(max_length):
        if packed is not None and size == max_length:
            code = packed
        else:
            code = f"__{out}_{behind}"
            staged.append(code)
            text = seq
            if size < max_length:
                start = f"greatest(length({seq}) - {behind + size - 1}, 1)"
                count = f"least(greatest(length({seq}) - {behind}, 0), {size})"
                text = f"substring({seq}, {start}, {count})"
            rows = rows.withColumn(code, pack(F.expr(text)))
        for offset in range(size - 1):
            term = pair_sum_sql(code, offset)
            if not fixed:
                term = f"if(length({seq}) > {behind + offset + 1}, {term}, 0L)"
            terms.append(term)
    if packed is not None and fixed and max_length <= MAX_PACKED:
        ends = f"{is_at_sql(packed, max_length - 1)} + {is_at_sql(packed, 0)}"
    else:
        ends = f"int(left({seq}, 1) in ('A', 'T')) + int(right({seq}, 1) in ('A', 'T'))"
    rows = rows.withColumn(f"__{out}_sum", F.expr(" + ".join(terms))).withColumn(f"__{out}_ends", F.expr(ends))
    length = max_length if fixed else f"length({seq})"
    tm = tm_sql(f"__{out}_sum", f"__{out}_ends", length, chemistry)
    return rows.withColumn(out, F.expr(tm)).drop(*staged, f"__{out}_sum", f"__{out}_ends")


def with_intrinsic_tm(
    rows: DataFrame, seq: str, out: str, max_length: int, chemistry: Chemistry, **layout
) -> DataFrame:
    """As :func:`with_tm`, with the -inf sentinel for strings shorter than two bases."""
    rows = with_tm(rows, seq, out, max_length, chemistry, **layout)
    return rows.withColumn(out, F.when(F.length(seq) < 2, F.lit(float("-inf"))).otherwise(F.col(out)))
