"""Thresholds of the detectors, parameters of the DNS model, and job settings."""

from __future__ import annotations

import argparse
import json
import os
import re
from dataclasses import asdict, dataclass, field, fields

# The defaults that the detectors have.


@dataclass(frozen=True)
class LoginRule:
    threshold: int = 10
    window_ms: int = 300_000
    allowed_lateness_ms: int = 30_000


@dataclass(frozen=True)
class BeaconRule:
    max_samples: int = 20
    min_samples: int = 5
    max_cv: float = 0.15
    min_interval_ms: int = 5_000
    max_interval_ms: int = 3_600_000
    idle_expiry_ms: int = 900_000
    out_of_orderness_ms: int = 30_000
    cooldown_intervals: int = 3

    @property
    def session_gap_ms(self) -> int:
        """A longer gap begins a new session: the idle timer, seen through the watermark's delay."""
        return self.idle_expiry_ms + self.out_of_orderness_ms


@dataclass(frozen=True)
class DnsModel:
    baseline_mean: float = 2.0
    baseline_std: float = 0.48
    z_threshold: float = 2.0
    min_queries: int = 8
    window_ms: int = 60_000

    #: The names of the five fields in a model file.
    JSON = {"baselineMeanEntropy": "baseline_mean", "baselineStdEntropy": "baseline_std", "zScoreThreshold": "z_threshold", "minQueriesPerWindow": "min_queries", "windowSizeMillis": "window_ms"}  # noqa: RUF012

    @classmethod
    def load(cls, path: str | None) -> DnsModel:
        """The model in a JSON file that has all five fields and no other; the defaults without a path."""
        if not path:
            return cls()
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        if set(said) != set(cls.JSON):
            raise ValueError(f"a model file has the fields {sorted(cls.JSON)}, not {sorted(said)}")
        return cls(**{cls.JSON[k]: v for k, v in said.items()})

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump({k: round(v, 4) if isinstance(v := getattr(self, name), float) else v for k, name in self.JSON.items()}, f, indent=2)


@dataclass(frozen=True)
class Job:
    """Settings of the streaming job: from arguments, else the environment, else the defaults."""

    source: str = ""
    events_out: str = ""
    alerts_out: str = ""
    rollup_out: str = ""
    dead_letters_out: str = ""
    checkpoint: str = ""
    model: str = ""
    watermark: str = "30 seconds"
    trigger: str = "2 seconds"
    max_files_per_trigger: int = 100
    login: LoginRule = field(default_factory=LoginRule)
    beacon: BeaconRule = field(default_factory=BeaconRule)

    @classmethod
    def parse(cls, args: list[str] | None = None) -> Job:
        parser = argparse.ArgumentParser()
        plain = [f for f in fields(cls) if f.name not in ("login", "beacon")]
        for f in plain:
            kind = int if f.type == "int" else str
            parser.add_argument("--" + f.name.replace("_", "-"), type=kind, default=kind(os.environ.get("PALISADE_" + f.name.upper(), f.default)))
        for name, rule in (("login", LoginRule()), ("beacon", BeaconRule())):
            for k, v in asdict(rule).items():
                parser.add_argument(f"--{name}-{k.replace('_', '-')}", type=type(v), default=v)
        got = vars(parser.parse_args(args))
        rules = {n: c(**{k: got.pop(f"{n}_{k}") for k in asdict(c())}) for n, c in (("login", LoginRule), ("beacon", BeaconRule))}
        return cls(**got, **rules)


_UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000}


def duration_ms(text: str) -> int:
    """'200ms', '1.5s', '1m30s' in milliseconds."""
    parts = re.findall(r"(\d+(?:\.\d+)?)(ms|s|m|h)", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise ValueError(f"not a duration: {text!r}")
    return round(sum(float(n) * _UNITS[u] for n, u in parts))


@dataclass(frozen=True)
class ShipperConfig:
    """What a log shipper reads and how it batches; sources are {type: tail or syslog, source_type, path or address}."""

    sources: list[dict]
    topic: str = "raw-events"
    batch_size: int = 500
    batch_timeout: str = "1s"
    queue_size: int = 10_000
    required_acks: int = -1
    max_retries: int = 5
    retry_backoff: str = "200ms"
    max_backoff: str = "10s"

    @classmethod
    def from_dict(cls, said: dict) -> ShipperConfig:
        """Checked settings. Unlike settings that are left out, zeros are kept."""
        unknown = set(said) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        out = cls(**said)
        if not out.sources:
            raise ValueError("at least one source is needed")
        for s in out.sources:
            if s.get("type") not in ("tail", "syslog"):
                raise ValueError(f"unknown source type: {s.get('type')!r}")
            if s.get("source_type") not in ("auth", "dns", "firewall"):
                raise ValueError(f"unknown source_type: {s.get('source_type')!r}")
            if not s.get("path" if s["type"] == "tail" else "address"):
                raise ValueError(f"a {s['type']} source needs a {'path' if s['type'] == 'tail' else 'address'}")
        for text in (out.batch_timeout, out.retry_backoff, out.max_backoff):
            duration_ms(text)
        if out.batch_size <= 0 or out.queue_size <= 0 or out.max_retries < 0:
            raise ValueError("sizes must be positive")
        return out

    @classmethod
    def load(cls, path: str) -> ShipperConfig:
        """From JSON, or YAML if a parser for it is installed."""
        with open(path, encoding="utf-8") as f:
            text = f.read()
        if path.endswith(".json"):
            return cls.from_dict(json.loads(text))
        try:
            import yaml
        except ImportError as e:
            raise ValueError("no YAML parser is installed; give JSON") from e
        return cls.from_dict(yaml.safe_load(text))
