"""Streams: open-ended versions of the stateful operators, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def episodes(events: DataFrame, days: int = 30, late: str = "1 day") -> DataFrame:
    """The events (patient, signal, event_id, ts) that start an episode: more than `days` after the last one kept.

    State is one timestamp per patient and signal, which goes once the watermark has passed the episode's end. Events
    that come out of order within a batch are sorted; one older than the last kept is taken as part of its episode.
    """

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        out = []
        for e in pd.concat(list(batches)).sort_values(["ts", "event_id"]).itertuples():
            now = int(e.ts.timestamp() // 86400)
            if last is None or now - last > days:
                last = now
                out.append((key[0], key[1], e.event_id, e.ts))
        state.update((last,))
        state.setTimeoutTimestamp(max((last + days + 1) * 86_400_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["patient", "signal", "event_id", "ts"])

    marked = events.withWatermark("ts", late)
    return marked.groupBy("patient", "signal").applyInPandasWithState(judge, "patient long, signal string, event_id long, ts timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def heartbeat_windows(beats: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Beats of each site by window; a site without a row in the newest window is offline."""
    return beats.withWatermark("ts", late).groupBy(F.window("ts", width), "site").agg(F.count("*").alias("beats"), F.max("ts").alias("last_seen")).select("site", F.col("window.start").alias("begin"), "beats", "last_seen")


def once(results: DataFrame, late: str = "7 days") -> DataFrame:
    """Results without those delivered again: same site, query and content within the watermark."""
    content = F.sha2(F.to_json(F.struct(*sorted(c for c in results.columns if c != "ts"))), 256)
    return results.withColumn("content_hash", content).withWatermark("ts", late).dropDuplicatesWithinWatermark(["site", "content_hash"])
