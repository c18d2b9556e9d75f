"""Pages as they arrive: metrics and boundaries over unbounded input.

Decoding a whole stack needs its end, so it stays a batch job; what a page and the one before it
decide can be said at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _grams(text: str, n: int) -> set[str]:
    t = (text or "").strip()
    return {t[i : i + n] for i in range(len(t) - n + 1)} if len(t) >= n else {t} - {""}


def arriving_boundaries(pages: DataFrame, at: float = 0.15, n: int = 4, idle: str = "1 hour") -> DataFrame:
    """stream_id, pos, prob, boundary of pages (stream_id, pos, text, ts) in order of arrival.

    State: the last page of each stream. A stream that is idle is forgotten; pages must arrive in order of pos, and one that
    comes before its stream's last page is dropped.
    """
    wait = pd.Timedelta(idle)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, text = state.get if state.exists else (-1, "")
        rows, latest = [], None
        for page in pd.concat(list(batches)).sort_values("pos").itertuples():
            latest = page.ts if latest is None or page.ts > latest else latest
            if page.pos <= last:
                continue
            a, b = _grams(text, n), _grams(page.text, n)
            prob = 1.0 if last < 0 else 1 - (len(a & b) / len(a | b) if a or b else 1.0)
            rows.append((key[0], page.pos, prob, last < 0 or prob > 1 - at))
            last, text = int(page.pos), page.text or ""
        state.update((last, text))
        due = latest + wait
        state.setTimeoutTimestamp(max(int(due.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["stream_id", "pos", "prob", "boundary"])

    kept = pages.withWatermark("ts", idle).select("stream_id", "pos", "text", "ts")
    return kept.groupBy("stream_id").applyInPandasWithState(step, "stream_id long, pos long, prob double, boundary boolean", "pos long, text string", "append", GroupStateTimeout.EventTimeTimeout)


def arrival_counts(pages: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Pages and documents begun in each window of arrival."""
    timed = pages.withWatermark("ts", late).groupBy(F.window("ts", window))
    return timed.agg(F.count("*").alias("pages"), F.count_if("boundary").alias("documents")).select(F.col("window.start").alias("start"), "pages", "documents")
