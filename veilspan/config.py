"""Scan settings."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

STYLES = ("marker", "drop", "typed", "placeholder")

# Sensitivity dial -> (entropy threshold, minimum token bytes).
SENSITIVITY = {1: (5.0, 32), 2: (4.5, 24), 3: (3.8, 20), 4: (3.2, 14), 5: (2.5, 8)}
ENTROPY_MAX_LEN = 256
SIZE_LIMIT = 1024 * 1024


@dataclass(frozen=True)
class ScanConfig:
    """What to scan for and how to write the redacted copy."""

    marker: str = "[REDACTED]"
    style: str = "marker"
    sensitivity: int = 3
    entropy_threshold: float | None = None
    entropy_min_len: int | None = None
    enable_deep_scan: bool = False
    enable_entropy: bool = False
    disabled_categories: tuple[str, ...] = ()
    allowlist_regex: tuple[str, ...] = ()
    size_limit: int = SIZE_LIMIT
    wordlist: tuple[str, ...] = field(default=(), repr=False)

    def __post_init__(self) -> None:
        if self.style not in STYLES:
            raise ValueError(f"unknown style {self.style!r}")

    def with_(self, **changes) -> "ScanConfig":
        return replace(self, **changes)

    @property
    def entropy_limits(self) -> tuple[float, int, int]:
        """(threshold, min bytes, max bytes) after the user's overrides.

        A user threshold applies where it is below the dial, but never below 2.
        """
        dial, min_len = SENSITIVITY.get(self.sensitivity, SENSITIVITY[3])
        threshold = dial
        if self.entropy_threshold is not None:
            threshold = max(2.0, min(self.entropy_threshold, dial))
        if self.entropy_min_len is not None:
            min_len = self.entropy_min_len
        return threshold, min_len, ENTROPY_MAX_LEN
