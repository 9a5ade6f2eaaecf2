"""What a query is evaluated with."""

from __future__ import annotations

from dataclasses import dataclass


#: 30 days in ms.
LONG_CHUNK = 2_592_000_000


@dataclass(frozen=True)
class Options:
    """Durations in ms.

    lookback: how long a sample stays the newest one. extended_lookback: how far the
    extended functions look before a window. sub_step: a subquery's default step.
    max_samples: 0, or how many samples a query's selectors may hold together.
    timeout: 0, or seconds after which a query's collection is cancelled.
    series_chunk: the time range in which one task sorts a series' samples; beyond it the
    parts of a series are worked on side by side. 0: never cut. None: LONG_CHUNK where
    the query reads more than two of them.
    """

    lookback: int = 300_000
    extended_lookback: int = 3_600_000
    sub_step: int = 60_000
    max_samples: int = 0
    timeout: float = 0
    series_chunk: int | None = None
    extended: bool = False
    optimize: bool = True

    def chunk(self, low: int, high: int) -> int:
        """How series are cut by a query that reads the times from low to high."""
        if self.series_chunk is not None:
            return self.series_chunk
        return LONG_CHUNK if high - low > 2 * LONG_CHUNK else 0
