"""Parameters of the stages, one frozen dataclass each."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from pathlib import Path

#: The order of bases in every count array.
BASES = ("A", "C", "G", "T")


@dataclass(frozen=True)
class SnvFilter:
    min_base_quality: int = 22
    min_coverage: int = 7
    min_alt_reads: int = 2
    min_mapq: int = 10
    max_normal_af: float = 0.05
    min_tumor_af: float = 0.035


@dataclass(frozen=True)
class IndelFilter:
    min_reads: int = 2
    min_mapq: int = 35
    min_mean_quality: float = 0.0
    margin: int = 3


@dataclass(frozen=True)
class Calling:
    cutoff: float = 0.3
    pass_score: float = 0.5
    min_indel_af: float = 0.03
    germline_af: float = 0.1
    germline_window: int = 10
    default_base_quality: int = 15
    batches: int = 100


@dataclass(frozen=True)
class Goldset:
    min_end_distance: float = 10
    min_end_mad: float = 3
    max_low_mapq: float = 0.10
    max_mapq_gap: float = 5
    min_tumor_mapq: float = 40
    min_base_quality: float = 30
    min_tumor_reads: int = 4
    max_normal_reads: int = 1
    min_strand: float = 0.02


@dataclass(frozen=True)
class SnvTensor:
    flank: int = 15
    repeats: int = 5
    rows: int = 100
    missing_quality: int = 45
    seed: int = 1
    falling: bool = False  # each base falls to the next free row of its column, instead of a row a read
    allele_fractions: bool = False  # four channels more: each base's share of the depth

    @property
    def width(self) -> int:
        return 2 * self.flank + self.repeats

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.rows, 2 * self.width, 9 if self.allele_fractions else 5


@dataclass(frozen=True)
class IndelTensor:
    before: int = 36
    length: int = 75
    rows: int = 140
    missing_quality: int = 45
    seed: int = 1
    strict_positions: bool = False

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.rows, 2 * self.length, 5


def load(kind: type, path: str):
    """Parameters of a stage from a JSON object; names that it lacks keep their defaults, unknown ones are an error."""
    return kind(**json.loads(Path(path).read_text()))


STAGES = {k.__name__: k for k in (SnvFilter, IndelFilter, Calling, Goldset, SnvTensor, IndelTensor)}


def settings(path: str | None) -> dict:
    """Parameters of all stages by name, from one JSON object with an object for some of them, such as {"SnvFilter": {"min_coverage": 5}}."""
    given = json.loads(Path(path).read_text()) if path else {}
    if unknown := set(given) - set(STAGES):
        raise ValueError(f"no stages of these names: {sorted(unknown)}")
    return {name: kind(**given.get(name, {})) for name, kind in STAGES.items()}


def as_json(cfg) -> str:
    return json.dumps(asdict(cfg), sort_keys=True)
