"""Options of the stages, checked when made."""

from __future__ import annotations

from dataclasses import dataclass, fields


def between(low, high):
    return lambda x: low <= x <= high


def one_of(*values):
    return lambda x: x in values


class _Checked:
    LIMITS: dict = {}

    def __post_init__(self):
        for name, test in self.LIMITS.items():
            if not test(getattr(self, name)):
                raise ValueError(f"{name}={getattr(self, name)!r} is out of range")


@dataclass(frozen=True)
class MapOptions(_Checked):
    """Seeds and candidates of read mapping."""

    kmer_size: int = 15
    kmer_window: int = 10
    max_kmer_occ: int = 200
    min_seeds: int = 3
    max_subjects: int = 3
    max_hsps: int = 5
    task: str = "rm"

    LIMITS = {"kmer_size": between(10, 31), "kmer_window": between(1, 1 << 20), "max_kmer_occ": between(1, 1 << 30), "min_seeds": between(1, 1 << 20), "task": one_of("rm", "pm")}


@dataclass(frozen=True)
class SvOptions(_Checked):
    """SV reads, signatures and groups."""

    min_seq_size: int = 3000
    identity: float = 70.0
    end_tolerance: int = 300
    max_dual_gap: int = 30_000
    min_unmasked: int = 2000
    min_indel: int = 40
    strict_window: int = 10
    strict_distance: int = 20
    strict_members: int = 4
    relaxed_window: int = 50
    relaxed_followers: int = 4

    LIMITS = {"identity": between(0, 100), "min_indel": between(1, 1 << 30), "strict_members": between(1, 1 << 20)}


@dataclass(frozen=True)
class ConsensusOptions(_Checked):
    """Pileup consensus of a group."""

    min_cov: int = 3
    min_size: int = 2000
    min_overlap: int = 1000
    identity_first: float = 65.0
    identity_second: float = 85.0
    coverage_factor: float = 0.4

    LIMITS = {"min_cov": between(1, 1 << 20), "identity_first": between(0, 100), "identity_second": between(0, 100)}


def from_lines(kind, lines: list[str]):
    """Options from KEY=VALUE lines; blank lines and # comments don't count, unknown keys are an error."""
    types = {f.name: type(f.default) for f in fields(kind)}
    given = {}
    for line in lines:
        line = line.split("#")[0].strip()
        if line:
            key, _, value = (x.strip() for x in line.partition("="))
            if key.lower() not in types:
                raise ValueError(f"unknown option {key}")
            given[key.lower()] = types[key.lower()](value)
    return kind(**given)


def data_size(text: str) -> int:
    """Bytes of a size like 8g, 500m or 20k."""
    units = {"k": 10, "m": 20, "g": 30, "t": 40}
    t = text.strip().lower().removesuffix("b")
    return int(float(t[:-1]) * (1 << units[t[-1]])) if t and t[-1] in units else int(t)
