"""Parameters, and their TOML form."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class OscillatorParams:
    alpha: float = -0.1
    beta1: float = -1.0
    beta2: float = -1.0
    delta1: float = 0.0
    delta2: float = 0.0
    epsilon: float = 1.0
    input_gain: float = 1.0

    @property
    def limit(self) -> float:
        """The amplitude at which the state is cut."""
        return 0.98 / max(self.epsilon, 1e-9) ** 0.5


@dataclass(frozen=True)
class BankConfig:
    params: OscillatorParams = field(default_factory=OscillatorParams)
    dt: float = 1 / 24
    learn_rate: float = 0.0
    weight_decay: float = 0.0
    delay: float = 0.0
    delay_gain: float = 0.0
    noise: float = 0.0
    noise_seed: int = 0
    batch: int = 1  # samples between plasticity steps


@dataclass(frozen=True)
class VoiceConfig:
    noise_floor: float = 0.02
    active_fraction: float = 0.08
    correlation: float = 0.6
    harmonic_boost: float = 0.15
    harmonic_tolerance: float = 0.5  # semitones
    least_size: int = 1
    most_silent: int = 40
    cost_cap: float = 5.0
    weight_pitch: float = 1.0
    weight_amp: float = 0.3
    weight_overlap: float = 2.0


@dataclass(frozen=True)
class Rule:
    source: str
    output: str
    scale: str = "passthrough"


def _filled(kind: type, given: dict):
    known = {f.name for f in fields(kind)}
    unknown = set(given) - known
    if unknown:
        raise ValueError(f"{kind.__name__} has no {', '.join(sorted(unknown))}")
    return kind(**given)


def bank_from_toml(text: str, layer: str) -> BankConfig:
    """The table [layer], its oscillator parameters in [layer.params]."""
    given = dict(tomllib.loads(text)[layer])
    params = _filled(OscillatorParams, given.pop("params", {}))
    return _filled(BankConfig, given | {"params": params})


def rules_from_toml(text: str) -> list[Rule]:
    """The array of tables [[mapping]]."""
    return [_filled(Rule, m) for m in tomllib.loads(text).get("mapping", [])]
