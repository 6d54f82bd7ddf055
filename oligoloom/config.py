"""Run configuration: YAML on the driver, typed sections for the jobs."""

from __future__ import annotations

import hashlib
import json
from dataclasses import MISSING, asdict, dataclass, field, fields
from pathlib import Path
from typing import Any

import yaml

from oligoloom.functions.motifs import both_strands
from oligoloom.functions.melting import Chemistry
from oligoloom.operators.conflicts import PairRules
from oligoloom.operators.funnel import FunnelSettings


class ConfigError(ValueError):
    """The configuration cannot be used."""


@dataclass(frozen=True)
class GeneratorSection:
    primer_length: int
    target_size: int
    random_seed: int | None = None
    max_attempts: int = 100000
    checkpoint_interval: int = 1000
    force_target_size: bool = False
    force_target_cycle_oversample_multiplier: float = 10.0
    force_target_post_target_seconds: float = 30.0


@dataclass(frozen=True)
class CompositionSection:
    gc_min_fraction: float = 0.45
    gc_max_fraction: float = 0.55


@dataclass(frozen=True)
class FiltersSection:
    intrinsic_tm_min_c: float = 60.0
    intrinsic_tm_max_c: float = 70.0
    max_homopolymer: int = 3
    max_dinucleotide_repeats: int = 3
    max_trinucleotide_repeats: int = 2
    near_palindrome_min_match: int = 16
    self_complementarity_run_threshold: int = 6


@dataclass(frozen=True)
class MotifsSection:
    motifs: list[str] = field(default_factory=list)
    motif_file: str | None = None
    include_reverse_complements: bool = True


@dataclass(frozen=True)
class ThermodynamicsSection:
    pair_tm_max_c: float = 40.0
    strand_concentration_nM: float = 250.0
    monovalent_mM: float = 50.0
    magnesium_mM: float = 0.0
    temperature_unit: str = "C"
    min_alignment_run: int = 4
    three_prime_window_nt: int = 3
    precompute_shortest_threshold_seq: bool = False


@dataclass(frozen=True)
class PairingSection:
    enabled: bool = False
    sense_tm_max_c: float | None = None
    rejection_window: int = 50
    requeue_probability_scale: float = 1.0
    max_attempts_multiplier: int = 50
    stagnation_attempt_window: int = 500


@dataclass(frozen=True)
class OutputSection:
    root_dir: str = "outputs"
    final_csv: str = "final_primers.csv"
    pairings_csv: str = "primer_pairs.csv"
    unpaired_csv: str = "unpaired_primers.csv"
    conflicts_json: str = "conflicts.json"
    summary_json: str = "run_summary.json"
    checkpoint_file: str = "checkpoint"
    resolved_config_yaml: str = "resolved_config.yaml"


@dataclass(frozen=True)
class CalibrationSection:
    filtered_sample_size: int = 400
    max_filter_attempts: int = 50000
    pair_sample_size: int = 4000
    graph_trials: int = 8
    graph_size_cap: int = 300
    random_seed_offset: int = 1000003


SECTIONS = {
    "generator": GeneratorSection,
    "composition": CompositionSection,
    "filters": FiltersSection,
    "forbidden_motifs": MotifsSection,
    "thermodynamics": ThermodynamicsSection,
    "pairing": PairingSection,
    "output": OutputSection,
    "calibration": CalibrationSection,
}


@dataclass(frozen=True)
class RunConfig:
    generator: GeneratorSection
    composition: CompositionSection
    filters: FiltersSection
    forbidden_motifs: MotifsSection
    thermodynamics: ThermodynamicsSection
    pairing: PairingSection
    output: OutputSection
    calibration: CalibrationSection
    # Everything as merged, unknown keys included: what is written out and compared on resume.
    merged: dict[str, Any]
    base_dir: Path

    @property
    def digest(self) -> str:
        text = json.dumps(self.merged, sort_keys=True, default=str)
        return hashlib.sha256(text.encode()).hexdigest()

    @property
    def chemistry(self) -> Chemistry:
        t = self.thermodynamics
        return Chemistry(float(t.strand_concentration_nM), float(t.monovalent_mM), float(t.magnesium_mM))

    @property
    def gc_range(self) -> tuple[float, float]:
        return self.composition.gc_min_fraction, self.composition.gc_max_fraction

    @property
    def sense_limit_c(self) -> float:
        own = self.pairing.sense_tm_max_c
        return float(self.thermodynamics.pair_tm_max_c if own is None else own)

    def motifs(self) -> tuple[str, ...]:
        words = self.forbidden_motifs.motifs
        return both_strands(words) if self.forbidden_motifs.include_reverse_complements else tuple(sorted(set(words)))

    def funnel(self) -> FunnelSettings:
        f = self.filters
        return FunnelSettings(
            length=self.generator.primer_length,
            tm_min_c=float(f.intrinsic_tm_min_c),
            tm_max_c=float(f.intrinsic_tm_max_c),
            max_homopolymer=f.max_homopolymer,
            max_dinucleotide_repeats=f.max_dinucleotide_repeats,
            max_trinucleotide_repeats=f.max_trinucleotide_repeats,
            near_palindrome_min_match=f.near_palindrome_min_match,
            self_complementarity_threshold=f.self_complementarity_run_threshold,
            motifs=self.motifs(),
            chemistry=self.chemistry,
        )

    def configured_gate(self, label: str) -> int:
        """Run-length gate given by hand, per direction or for both."""
        section = self.merged["thermodynamics"]
        either = section.get("min_tm_calculation_run_length", 0)
        return max(0, int(section.get(f"min_tm_calculation_run_length_{label}", either)))

    def pair_rules(self, gate: int = 0) -> PairRules:
        t = self.thermodynamics
        return PairRules(
            length=self.generator.primer_length,
            limit_c=float(t.pair_tm_max_c),
            window=t.three_prime_window_nt,
            min_run=t.min_alignment_run,
            gate=gate,
            chemistry=self.chemistry,
        )


def _merge(base: dict[str, Any], given: dict[str, Any]) -> dict[str, Any]:
    both_maps = {k for k in given if isinstance(given[k], dict) and isinstance(base.get(k), dict)}
    return {**base, **{k: _merge(base[k], v) if k in both_maps else v for k, v in given.items()}}


def _defaults() -> dict[str, Any]:
    def section(cls) -> dict[str, Any]:
        values = {}
        for f in fields(cls):
            if f.default is not MISSING:
                values[f.name] = f.default
            elif f.default_factory is not MISSING:
                values[f.name] = f.default_factory()
        return values

    return {name: section(cls) for name, cls in SECTIONS.items()}


def read_motifs(path: Path) -> list[str]:
    """One motif per line; anything after an unquoted # is a comment."""
    words = []
    for line in path.read_text(encoding="utf-8").splitlines():
        quote = ""
        for position, char in enumerate(line):
            if char == "#" and not quote:
                line = line[:position]
                break
            if char in "'\"":
                quote = "" if quote == char else quote or char
        if line.strip():
            words.append(line.strip().upper())
    return words


def _check(config: RunConfig) -> None:
    g, c, f, t, p, k = (
        config.generator,
        config.composition,
        config.filters,
        config.thermodynamics,
        config.pairing,
        config.calibration,
    )
    rules = [
        (g.primer_length > 0, "generator.primer_length has to be positive"),
        (g.target_size > 0, "generator.target_size has to be positive"),
        (g.force_target_cycle_oversample_multiplier >= 1.0, "the oversample multiplier has to be 1.0 or more"),
        (g.force_target_post_target_seconds >= 0.0, "generator.force_target_post_target_seconds is negative"),
        (0 <= c.gc_min_fraction <= c.gc_max_fraction <= 1, "composition: need 0 <= GC minimum <= GC maximum <= 1"),
        (f.max_homopolymer >= 1, "filters.max_homopolymer has to be 1 or more"),
        (f.intrinsic_tm_min_c <= f.intrinsic_tm_max_c, "filters: the Tm minimum exceeds the maximum"),
        (t.three_prime_window_nt >= 1, "thermodynamics.three_prime_window_nt has to be 1 or more"),
        (t.min_alignment_run >= 1, "thermodynamics.min_alignment_run has to be 1 or more"),
        (p.rejection_window >= 1, "pairing.rejection_window has to be 1 or more"),
        (p.max_attempts_multiplier >= 1, "pairing.max_attempts_multiplier has to be 1 or more"),
        (p.stagnation_attempt_window >= 1, "pairing.stagnation_attempt_window has to be 1 or more"),
        (k.filtered_sample_size >= 2, "calibration.filtered_sample_size has to be 2 or more"),
        (k.pair_sample_size >= 1, "calibration.pair_sample_size has to be 1 or more"),
        (k.graph_trials >= 1, "calibration.graph_trials has to be 1 or more"),
        (k.graph_size_cap >= 8, "calibration.graph_size_cap has to be 8 or more"),
    ]
    broken = [message for fine, message in rules if not fine]
    if broken:
        raise ConfigError("; ".join(broken))


def build_config(given: dict[str, Any], base_dir: Path = Path(".")) -> RunConfig:
    if not isinstance(given, dict):
        raise ConfigError("the configuration has to be a mapping")
    for name in ("primer_length", "target_size"):
        if not isinstance(given.get("generator"), dict) or name not in given["generator"]:
            raise ConfigError(f"generator.{name} is required")
    merged = _merge(_defaults(), given)
    motifs = [str(word).upper() for word in merged["forbidden_motifs"].get("motifs") or []]
    if merged["forbidden_motifs"].get("motif_file"):
        path = (base_dir / str(merged["forbidden_motifs"]["motif_file"])).resolve()
        if not path.exists():
            raise ConfigError(f"no motif file at {path}")
        motifs += read_motifs(path)
    merged["forbidden_motifs"]["motifs"] = sorted(set(motifs))
    sections = {}
    for name, cls in SECTIONS.items():
        known = {f.name for f in fields(cls)}
        sections[name] = cls(**{key: value for key, value in merged[name].items() if key in known})
    config = RunConfig(**sections, merged=merged, base_dir=base_dir)
    _check(config)
    return config


def parse_config(text: str, base_dir: Path = Path(".")) -> RunConfig:
    if not text.strip():
        raise ConfigError("the configuration is empty")
    try:
        given = yaml.safe_load(text)
    except yaml.YAMLError as error:
        raise ConfigError(f"not valid YAML: {error}") from error
    return build_config(given, base_dir)


def load_config(path: Path | str) -> RunConfig:
    path = Path(path)
    if not path.exists():
        raise ConfigError(f"no configuration file at {path}")
    return parse_config(path.read_text(encoding="utf-8"), path.resolve().parent)


def with_calibration(config: RunConfig, overrides: dict[str, Any]) -> RunConfig:
    """The same configuration with some calibration values replaced (None: keep)."""
    changed = {**asdict(config.calibration), **{k: v for k, v in overrides.items() if v is not None}}
    return build_config(_merge(config.merged, {"calibration": changed}), config.base_dir)
