"""Robots files kept by host for a day: which requests must fetch the file again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TTL_US = 24 * 3600 * 1_000_000
#: A file that could not be had is asked for again much sooner.
FAILED_TTL_US = 60 * 1_000_000


def due(at: np.ndarray, ok: np.ndarray, fetched: int | None, fine: bool, ttl_us: int, failed_ttl_us: int) -> tuple[np.ndarray, int, bool]:
    """Which of the ordered requests fetch, and time and outcome of the last fetch.

    One step a fetch, not one a request: the next fetch is found by binary search.
    """
    fetch, place = np.zeros(len(at), bool), 0
    while True:
        if fetched is not None:
            place += int(np.searchsorted(at[place:], fetched + (ttl_us if fine else failed_ttl_us), side="right"))
        if place >= len(at):
            return fetch, fetched, fine
        fetch[place], fetched, fine = True, int(at[place]), bool(ok[place])


def refreshes(requests: DataFrame, ttl_us: int = TTL_US, failed_ttl_us: int = FAILED_TTL_US) -> DataFrame:
    """``requests`` (host string, at_us long, request_id long and, where fetches can fail, ok
    boolean: the outcome of a fetch at that time) with ``fetch``.

    The first request of a host fetches, and then the first one over ``ttl_us`` after the last
    fetch, or over ``failed_ttl_us`` after a failed one.  A host's state is a time and an outcome.
    It expires when the host has been silent for ``ttl_us`` of processing time: where requests
    come as they are made the next one would fetch anyway; a slow replay fetches once more.
    Requests of one micro-batch are taken in order of (at_us, request_id); a host's share of a
    micro-batch is bounded by the source's limit.  One that comes late, from before the last
    fetch, does not fetch.
    """
    has_outcome = "ok" in requests.columns

    def decide(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        fetched, fine = state.get if state.exists else (None, True)
        rows = pd.concat(list(parts)).sort_values(["at_us", "request_id"])
        at = rows["at_us"].to_numpy()
        ok = rows["ok"].fillna(False).to_numpy(bool) if has_outcome else np.ones(len(at), bool)
        fetch, fetched, fine = due(at, ok, fetched, fine, ttl_us, failed_ttl_us)
        state.update((int(fetched), bool(fine)))
        state.setTimeoutDuration(max(1, ttl_us // 1000))
        yield pd.DataFrame({"host": key[0], "request_id": rows["request_id"].to_numpy(), "at_us": at, "fetch": fetch})

    return requests.groupBy("host").applyInPandasWithState(
        decide, "host string, request_id long, at_us long, fetch boolean", "fetched_us long, ok boolean", "append", GroupStateTimeout.ProcessingTimeTimeout
    )
