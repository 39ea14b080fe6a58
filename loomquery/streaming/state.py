"""Stateful streams: repeated reads and the circuit breaker."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def dedup_reads(stream: DataFrame) -> DataFrame:
    """(session, key, seq, repeat) for a stream of (session, key, seq, digest); state is by session and key."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for rows in frames:
            rows, out = rows.sort_values("seq"), []
            for seq, digest in zip(rows["seq"], rows["digest"]):
                out.append((key[0], key[1], seq, digest == last))
                last = digest
            yield pd.DataFrame(out, columns=["session", "key", "seq", "repeat"])
        state.update((last,))

    return stream.groupBy("session", "key").applyInPandasWithState(step, "session string, key string, seq long, repeat boolean", "digest string", "append", GroupStateTimeout.NoTimeout)


def circuit_breaker(stream: DataFrame, trip: int = 3) -> DataFrame:
    """(session, seq, streak, tripped) for a stream of (session, seq, ok, fingerprint): failures in a row."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, last = state.get if state.exists else (0, None)
        for rows in frames:
            rows, out = rows.sort_values("seq"), []
            for seq, ok, fingerprint in zip(rows["seq"], rows["ok"], rows["fingerprint"]):
                streak = 0 if ok else 1 if fingerprint and last and fingerprint != last else streak + 1
                last = None if ok else fingerprint or last
                out.append((key[0], seq, streak, streak >= trip))
            yield pd.DataFrame(out, columns=["session", "seq", "streak", "tripped"])
        state.update((streak, last))

    return stream.groupBy("session").applyInPandasWithState(step, "session string, seq long, streak int, tripped boolean", "streak int, fingerprint string", "append", GroupStateTimeout.NoTimeout)
