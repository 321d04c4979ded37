"""Settings of an analysis: defaults, then the environment, then arguments; a value that can't be read is an error."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

PREFIX = "MAILSTRATA_"


@dataclass(frozen=True)
class Config:
    max_packets: int = 1 << 40
    max_captures: int = 10_000
    session_budget: int = 16 << 20
    max_timeline: int = 10_000
    minimum_version: int = 0x0303
    minimum_coverage: float = 0.5
    disabled: tuple[str, ...] = ()

    def __post_init__(self):
        for f in fields(self):
            v = getattr(self, f.name)
            if isinstance(v, (int, float)) and v <= 0:
                raise ValueError(f"{f.name} must be positive, not {v}")

    def with_values(self, values: dict[str, str]) -> Config:
        """The settings named in values, given as text."""
        new = {}
        for f in fields(self):
            if f.name in values:
                kind, raw = type(getattr(self, f.name)), values[f.name]
                new[f.name] = tuple(x for x in raw.split(",") if x) if kind is tuple else int(raw, 0) if kind is int else kind(raw)
        return replace(self, **new)

    @classmethod
    def from_env(cls, environ: dict[str, str]) -> Config:
        return cls().with_values({k.removeprefix(PREFIX).lower(): v for k, v in environ.items() if k.startswith(PREFIX)})
