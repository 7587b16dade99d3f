"""Matching configuration with its named presets."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np


@dataclass(frozen=True)
class MatchConfig:
    """Settings of a scan; the defaults are the tool's documented defaults."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    include_subdirectories: bool = True
    include_images: bool = True
    scan_against_all: bool = False
    include_missing: bool = False
    ignore_reparse_points: bool = False
    exclude_hardlinks: bool = False
    min_size_mb: int | None = None
    max_size_mb: int | None = None
    path_contains: tuple[str, ...] = ()
    path_not_contains: tuple[str, ...] = ()

    percent: float = 96.0
    use_phash: bool = False
    combine_gray_and_phash: bool = False
    quorum_ratio: float = 0.6
    ignore_black: bool = False
    ignore_white: bool = False
    compare_flipped: bool = False
    positions: int = 1
    max_sampling_s: float = 0.0
    duration_percent: float = 20.0
    duration_min_s: float = 0.0
    duration_max_s: float = 0.0
    folder_mode: str = "none"  # none | same | different
    folder_depth: int = 1

    partial_min_ratio: float = 0.10
    partial_max_ratio: float = 0.95
    partial_similarity: float = 0.80
    partial_mode: str = "fast"  # fast | exact
    #: Caps of the audio index; off unless set, as each of them can lose a clip's source.
    partial_max_candidates: int | None = None
    partial_max_anchors: int | None = None
    partial_visual_threshold: float = 0.85
    partial_require_visual: bool = True

    use_ai: bool = False
    ai_percent: float = 94.0
    ai_partial_hit_percent: float = 89.0
    partial_audio: bool = False
    partial_visual: bool = False
    extra: dict = field(default_factory=dict, compare=False, hash=False)

    # Limits are derived in 32-bit arithmetic, as the stored percentages are 32-bit floats:
    # 96 % allows 2 of 64 bits, 95 % allows 3.

    @property
    def gray_fraction(self) -> float:
        one = np.float32(1.0)
        return float(one - np.float32(self.percent) / np.float32(100))

    def gray_limit(self, pixels: int, positions: int | None = None) -> int:
        """Largest sum of absolute pixel differences over all positions that still matches."""
        k = self.positions if positions is None else positions
        return int(math.floor(self.gray_fraction * k * pixels * 256))

    @property
    def max_bits(self) -> int:
        share = float(np.float32(self.percent) / np.float32(100))
        return int(math.floor((1.0 - share) * 64.0))

    def required_positions(self, k: int) -> int:
        ratio = np.float32(min(max(self.quorum_ratio, 0.01), 1.0))
        return max(1, int(math.ceil(float(np.float32(k) * ratio))))

    def ai_required(self, k: int) -> int:
        return max(1, (k + 1) // 2)

    @property
    def ai_threshold(self) -> float:
        return float(np.float32(self.ai_percent) / np.float32(100))

    @property
    def ai_hit_threshold(self) -> float:
        return float(np.float32(self.ai_partial_hit_percent) / np.float32(100))

    def tolerance(self, seconds: float) -> float:
        lo, hi = self.duration_min_s, self.duration_max_s
        if self.duration_percent <= 0:
            return max(0.0, lo, hi)
        tol = seconds * self.duration_percent / 100.0
        if lo > 0:
            tol = max(tol, lo)
        if hi > 0:
            tol = min(tol, hi)
        return max(0.0, tol)

    def with_(self, **changes) -> "MatchConfig":
        return replace(self, **changes)


def exact_and_near(base: MatchConfig = MatchConfig()) -> MatchConfig:
    return base.with_(percent=98.0, compare_flipped=False, ignore_black=False, ignore_white=False,
                      partial_audio=False, use_ai=False, partial_visual=False)


def edited_and_altered(base: MatchConfig = MatchConfig()) -> MatchConfig:
    return base.with_(percent=92.0, compare_flipped=True, ignore_black=True, ignore_white=True,
                      partial_audio=False, use_ai=False, partial_visual=False)


def ai_scan(base: MatchConfig = MatchConfig()) -> MatchConfig:
    return edited_and_altered(base).with_(use_ai=True, partial_visual=True)


def deep_clean(base: MatchConfig = MatchConfig()) -> MatchConfig:
    return ai_scan(base).with_(partial_audio=True)
