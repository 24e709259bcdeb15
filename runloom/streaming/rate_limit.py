"""Token-bucket admission over request tables and streams.

The bucket of a key is full again after a pause of ``burst / rate`` seconds, whatever happened before.
In batch such pauses cut a key into sessions that are worked on in parallel, each read in time order with
constant memory. In a stream the bucket is the key's state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from runloom.operators.ordering import epoch_seconds, with_session_start

ADMISSION = "admitted boolean, tokens_left double, wait_seconds double"


def spend(tokens: float, last: float | None, now: float, need: float, burst: float, rate: float) -> tuple[bool, float, float]:
    """One request: whether it is admitted, the tokens left, and how long a waiting caller would wait.

    A refused request takes nothing; one that asks for more than the bucket holds is always refused.
    """
    if last is not None and now > last:
        tokens = min(burst, tokens + rate * (now - last))
    if need > burst:
        return False, tokens, float("nan")
    if tokens >= need:
        return True, tokens - need, 0.0
    return False, tokens, (need - tokens) / rate


def rate_limit_admission(requests: DataFrame, key: str, order: str, per_minute: float = 60.0, burst: float = 10.0) -> DataFrame:
    """Admission of every request of ``key, ts, tokens``; ``order`` breaks ties of equal times."""
    rate = per_minute / 60.0
    pause = burst / rate
    rows = with_session_start(requests.withColumn("_at", epoch_seconds(requests, "ts")), [key], "_at", order, pause)
    sorted_rows = rows.repartition(key, "_session").sortWithinPartitions(key, "_session", "_at", order)

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, tokens, last = None, burst, None
        for part in parts:
            admitted, left, wait = [], [], []
            for name, session, now, need in zip(part[key], part["_session"], part["_at"], part["tokens"]):
                if (name, session) != current:
                    current, tokens, last = (name, session), burst, None
                ok, tokens, pause_for = spend(tokens, last, now, need, burst, rate)
                last = now
                admitted.append(ok)
                left.append(tokens)
                wait.append(pause_for)
            out = part[[key, order, "ts", "tokens"]].copy()
            out["admitted"], out["tokens_left"], out["wait_seconds"] = admitted, left, wait
            yield out

    fields = ", ".join(f"`{n}` {requests.schema[n].dataType.simpleString()}" for n in (key, order, "ts", "tokens"))
    done = sorted_rows.select(key, order, "ts", "tokens", "_at", "_session").mapInPandas(walk, f"{fields}, {ADMISSION}")
    return done.withColumn("wait_seconds", F.nanvl("wait_seconds", F.lit(None).cast("double")))


def stream_admission(requests: DataFrame, key: str, order: str, per_minute: float = 60.0, burst: float = 10.0) -> DataFrame:
    """Streaming version: the bucket and its time are the state of each key.

    Rows of a batch are taken in time order. A request older than the key's state is marked ``late`` and
    neither admitted nor counted; the clock does not go back.
    """
    rate = per_minute / 60.0
    fields = ", ".join(f"`{n}` {requests.schema[n].dataType.simpleString()}" for n in (key, order, "ts", "tokens"))

    def walk(_, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (burst, None)
        batch = pd.concat(list(parts), ignore_index=True).sort_values(["_at", order], ignore_index=True)
        rows = []
        for now, need in zip(batch["_at"], batch["tokens"]):
            late = last is not None and now < last
            if late:
                rows.append((False, tokens, float("nan"), True))
                continue
            ok, tokens, wait = spend(tokens, last, now, need, burst, rate)
            last = now
            rows.append((ok, tokens, wait, False))
        state.update((tokens, last))
        out = batch[[key, order, "ts", "tokens"]].copy()
        out[["admitted", "tokens_left", "wait_seconds", "late"]] = pd.DataFrame(rows, index=out.index)
        yield out

    timed = requests.withColumn("_at", epoch_seconds(requests, "ts"))
    return timed.groupBy(key).applyInPandasWithState(
        walk, f"{fields}, {ADMISSION}, late boolean", "tokens double, last double", "append", GroupStateTimeout.NoTimeout
    )
