"""Caps and policies. They travel with each call, as executors share no process."""

from __future__ import annotations

from dataclasses import dataclass, replace

GIB = 1 << 30


@dataclass(frozen=True)
class Options:
    """A cap of None is off. ``unknown``: what cleaning an archive does with members of unknown type."""

    input_cap: int | None = 10 * GIB
    stream_cap: int | None = GIB
    member_cap: int | None = GIB
    total_cap: int | None = 10 * GIB
    timeout_s: float | None = 600.0
    unknown: str = "keep"
    #: Further items (PNG text chunks, nested XMP) that the plain readers leave out.
    extended: bool = False

    def __post_init__(self) -> None:
        if self.unknown not in ("keep", "omit", "abort"):
            raise ValueError(f"unknown policy: {self.unknown}")

    def unlimited(self) -> Options:
        return replace(self, input_cap=None, stream_cap=None, member_cap=None, total_cap=None, timeout_s=None)
