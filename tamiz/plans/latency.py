"""How long searches take, again and again."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame


def percentiles(runs: list[Callable[[], DataFrame]], warm: int = 1) -> dict[str, float]:
    """Milliseconds of the runs, each of which is collected: median, 95th percentile (the nearest rank), mean. The first
    `warm` ones are run before, too, and don't count."""
    took = []
    for k, run in enumerate([*runs[:warm], *runs]):
        began = time.perf_counter()
        run().collect()
        if k >= warm:
            took.append(1000 * (time.perf_counter() - began))
    took.sort()
    rank = lambda p: took[max(0, -(-len(took) * p // 100) - 1)]
    return {"p50_ms": round(rank(50), 2), "p95_ms": round(rank(95), 2), "mean_ms": round(sum(took) / len(took), 2), "runs": len(took)}
