"""Chunked transfers as a stateful stream: strict chunks, digests, resume, idempotent finish, expiry."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHUNK = 1 << 20
#: State of a transfer that is silent this long is dropped.
RETAIN_MS = 5 * 60 * 1000
STATE = "size long, offset long, digests string, finished boolean"
EVENTS = "transfer string, file string, seq long, status string, offset long"


def checksum(digests: list[str]) -> str:
    return hashlib.sha256(bytes.fromhex("".join(digests))).hexdigest()


def receive(state: tuple | None, message: dict, chunk: int = CHUNK) -> tuple[tuple | None, str]:
    """One message (kind start, chunk or finish) against the state of a file: the new state and a status.

    start again resumes at the last whole chunk; finish again is ``replayed``; whatever doesn't fit changes nothing.
    """
    kind = message["kind"]
    if kind == "start":
        if state is None:
            return (int(message["size"]), 0, "", False), "started"
        return (state, "resumed") if state[0] == message["size"] else (state, "error: another manifest")
    if state is None:
        return None, "error: not started"
    size, offset, digests, finished = state
    held = digests.split(",") if digests else []
    if kind == "chunk":
        data = message["payload"] or b""
        if offset >= size:
            return state, "error: nothing is missing"
        if message["offset"] != offset or len(data) != min(chunk, size - offset):
            return state, "error: unexpected chunk"
        held.append(hashlib.sha256(data).hexdigest())
        return (size, offset + len(data), ",".join(held), False), "written"
    if offset != size:
        return state, "error: incomplete"
    if message["checksum"] != checksum(held):
        return state, "error: checksum"
    return (size, offset, digests, True), "replayed" if finished else "finished"


def receiver(messages: DataFrame, chunk: int = CHUNK, retain_ms: int = RETAIN_MS) -> DataFrame:
    """Statuses of a stream of (transfer, file, seq, kind, size, offset, payload, checksum) messages, keyed by file."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(*key, None, "expired", None)], columns=["transfer", "file", "seq", "status", "offset"]).astype({"seq": "Int64", "offset": "Int64"})
            return
        now = tuple(state.get) if state.exists else None
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for m in rows.to_dict("records"):
            now, status = receive(now, m, chunk)
            out.append((*key, m["seq"], status, now[1] if now else 0))
        if now is not None:
            state.update(now)
            state.setTimeoutDuration(retain_ms)
        yield pd.DataFrame(out, columns=["transfer", "file", "seq", "status", "offset"])

    return messages.groupBy("transfer", "file").applyInPandasWithState(step, EVENTS, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
