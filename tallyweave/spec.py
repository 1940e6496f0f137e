"""Sizes and seeds of a summary.

One frozen ``SketchSpec`` describes everything two summaries must share to be comparable or
mergeable: the hash seeds and the table sizes. All sizes are bounds on what an operator may
broadcast or keep in one task.
"""

from __future__ import annotations

import math
import random
from dataclasses import asdict, dataclass, replace

# Number of universal levels, slots of a heavy bucket, bytes of a bucket,
# bytes of a counter, growth base of the guardian strategy, guard factor of the elastic one.
LEVELS = 14
SLOTS = 8
BUCKET_BYTES = 64
COUNTER_BYTES = 4
GUARDIAN_BASE = 1.08
#: A gap at which the power passes the 31 bits of the coin; larger ones have the same outcome.
GUARDIAN_GAP = 280
ELASTIC_FACTOR = 8
# Arrivals per shard of an ordered replay: a few seconds of one core, and the bound on one task's longest bucket.
SHARD_ROWS = 4_000_000

# Below / above these shares of the memory only one of the two parts is used.
ONLY_UNIVERSAL = 1e-5
ONLY_HEAVY = 1 - 1e-5

STRATEGIES = ("elastic", "guardian", "spacesaving", "frequent")


@dataclass(frozen=True)
class SketchSpec:
    rows: int = 5
    width: int = 1024
    levels: int = LEVELS
    #: Candidates of a level; None keeps every key.
    capacity: int | None = 256
    buckets: int = 64
    slots: int = SLOTS
    heavy_ratio: float = 0.6
    seed: int = 1
    #: Arrivals of a shard of an ordered replay; None replays the whole stream as one, bucket by bucket.
    shard_rows: int | None = SHARD_ROWS

    def __post_init__(self):
        for name in ("rows", "width", "levels", "capacity", "slots", "shard_rows"):
            if (size := getattr(self, name)) is not None and size < 1:
                raise ValueError(f"{name} must be at least 1")
        if self.buckets < (1 if self.uses_heavy else 0):
            raise ValueError("a heavy part needs a bucket at least")
        if self.levels > 31:
            raise ValueError("levels come from the bits of one 31-bit hash")
        if self.rows > 16:
            raise ValueError("rows is limited to 16")

    @property
    def cells(self) -> int:
        """Counters of the whole universal sketch."""
        return self.levels * self.rows * self.width

    @property
    def heavy_rows(self) -> int:
        """Upper bound on the rows of the heavy table."""
        return self.buckets * self.slots

    @property
    def uses_heavy(self) -> bool:
        return self.heavy_ratio > ONLY_UNIVERSAL

    @property
    def uses_universal(self) -> bool:
        return self.heavy_ratio < ONLY_HEAVY

    def with_trial(self, trial: int) -> "SketchSpec":
        """Same sizes, fresh seeds."""
        return replace(self, seed=self.seed * 1_000_003 + trial)

    def with_sizes(self, **sizes) -> "SketchSpec":
        return replace(self, **sizes)

    def metadata(self) -> dict:
        return asdict(self)


def levels_for(keys: int, capacity: int) -> int:
    """Levels after which a list of ``capacity`` holds all keys that are sampled into the last one, by expectation."""
    return min(31, max(1, math.ceil(math.log2(max(1, keys) / max(1, capacity))) + 1))


def sketch_params_from_memory(
    mem_bytes: int,
    heavy_ratio: float = 0.6,
    rows: int = 5,
    counter_ratio: float = 0.9,
    levels: int = LEVELS,
    seed: int = 1,
) -> SketchSpec:
    """Split a byte budget into heavy buckets, counters and candidate lists.

    Every quotient is cut to an integer at the same place, so that two callers with the same
    budget always get mergeable summaries. A pure universal sketch always has five rows.
    """
    heavy_bytes = int(heavy_ratio * mem_bytes)
    level_bytes = int(mem_bytes * (1 - heavy_ratio)) // levels
    rows = rows if heavy_ratio > ONLY_UNIVERSAL else 5
    counter_bytes = int(counter_ratio * level_bytes)
    list_bytes = int((1 - counter_ratio) * level_bytes)
    return SketchSpec(
        rows=rows,
        width=max(1, counter_bytes // COUNTER_BYTES // rows),
        levels=levels,
        capacity=max(1, list_bytes // COUNTER_BYTES),
        buckets=max(1 if heavy_ratio > ONLY_UNIVERSAL else 0, heavy_bytes // BUCKET_BYTES),
        heavy_ratio=heavy_ratio,
        seed=seed,
    )


def distinct_seeds(n: int, seed: int = 1) -> list[int]:
    """``n`` different positive seeds below 2^31, reproducible from one seed."""
    return random.Random(f"seeds:{seed}").sample(range(1, 2**31 - 1), n)
