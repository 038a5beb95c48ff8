"""Encoding options, checked the same way at every entry point."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class EncodeOptions:
    """What an encoder may do; ``from_names`` takes names in any case and refuses unknown or doubled ones."""

    instance_mode: str = "reference"
    structure_cache: bool = True
    columnar: bool = True
    correlate: bool = False
    precision: float | None = None
    bit_pack: bool = True
    guard_diff: bool = True
    max_depth: int = 512
    max_nodes: int = 100_000

    def __post_init__(self) -> None:
        if self.instance_mode not in ("reference", "full"):
            raise ValueError(f"instance_mode is reference or full, not {self.instance_mode!r}")
        if self.precision is not None and not 0 < self.precision <= 1000:
            raise ValueError("precision lies in (0, 1000]")
        if self.correlate and not self.columnar:
            raise ValueError("correlate needs columnar")

    @classmethod
    def from_names(cls, given: dict) -> EncodeOptions:
        known = {f.name.replace("_", ""): f.name for f in fields(cls)}
        found: dict = {}
        for name, value in given.items():
            if not isinstance(name, str):
                raise TypeError(f"option names are strings, not {name!r}")
            own = known.get(name.replace("_", "").lower())
            if own is None:
                raise ValueError(f"unknown option {name!r}")
            if own in found:
                raise ValueError(f"option {name!r} is given twice")
            found[own] = value
        return cls(**found)
