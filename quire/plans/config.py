"""Recognition options and the thresholds that go with a profile."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

PROFILES = ("fast", "balanced", "accurate")
MAX_EXTRA = 8

# Fixed values of the profiles: detection threshold, retry threshold, tiles, extra recognitions.
DETECTION = {"fast": 0.30, "balanced": 0.24, "accurate": 0.18}
RETRY = {"fast": 0.50, "balanced": 0.58, "accurate": 0.66}
TILES = {"fast": 0, "balanced": 2, "accurate": 4}
EXTRA = {"fast": 0, "balanced": 2, "accurate": 6}


@dataclass(frozen=True)
class Options:
    profile: str = "balanced"
    paper_filter: str = "off"
    high_resolution_retry: bool = True
    adaptive_tiling: bool = False
    deskew_retry: bool = False
    long_line_segmentation: bool = False
    max_extra_recognitions: int = 2
    writing_mode: str = "auto"
    scattered: bool = False

    @classmethod
    def of(cls, **given) -> Options:
        """Options from what is given: unknown profiles are balanced, unset switches follow the profile, the budget is 0 to 8."""
        profile = given.get("profile")
        profile = profile if profile in PROFILES else "balanced"
        budget = given.get("max_extra_recognitions")
        numeric = isinstance(budget, (int, float)) and math.isfinite(budget)
        accurate = profile == "accurate"
        switch = lambda name, default: default if given.get(name) is None else bool(given[name])
        mode = given.get("writing_mode")
        return cls(
            profile=profile,
            paper_filter=given.get("paper_filter") or "off",
            high_resolution_retry=switch("high_resolution_retry", profile != "fast"),
            adaptive_tiling=switch("adaptive_tiling", accurate),
            deskew_retry=switch("deskew_retry", accurate),
            long_line_segmentation=switch("long_line_segmentation", accurate),
            max_extra_recognitions=min(MAX_EXTRA, max(0, math.floor(budget))) if numeric else EXTRA[profile],
            writing_mode=mode if mode in ("vertical", "horizontal") else "auto",
            scattered=bool(given.get("scattered")),
        )

    def stable_json(self) -> str:
        """JSON with sorted keys: equal for equal options, whatever their order."""
        import json

        return json.dumps(asdict(self), sort_keys=True, separators=(",", ":"))

    def but(self, **changes) -> Options:
        return replace(self, **changes)


def by_profile(profile: Column, table: dict[str, float]) -> Column:
    """A profile's value; unknown profiles count as balanced."""
    return F.when(profile == "fast", F.lit(table["fast"])).when(profile == "accurate", F.lit(table["accurate"])).otherwise(F.lit(table["balanced"]))
