"""Keyed state machines: pure steps from a state and a row to outputs and a state.

A state is a dict of plain values; times are microseconds. Spark partitions the
stream by key, keeps each key's state and calls the steps in arrival order.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from typing import Any, NamedTuple

from gridstream.functions.exact import stable_mean

State = dict[str, Any]
SECOND = 1_000_000


class Kind(NamedTuple):
    """How a machine's state lies in the store: typed columns, and the way there and back."""

    columns: str
    pack: Callable[[State], tuple]
    unpack: Callable[[tuple], State]


def _pair(ns: int | None) -> tuple[int | None, int | None]:
    return (None, None) if ns is None else divmod(ns, 10**9)


def _known(**values: Any) -> State:
    return {k: v for k, v in values.items() if v is not None}


def _nanos_of(seconds: int | None, part: int | None) -> int | None:
    return None if seconds is None else int(seconds) * 10**9 + int(part or 0)


EXPORT = Kind(
    "second long, values array<double>, flags array<boolean>",
    lambda s: (s["second"], s["values"], s["flags"]),
    lambda t: {"second": int(t[0]), "values": list(t[1]), "flags": list(t[2])},
)
CAPTURE = Kind(
    "seconds long, nanos int, onset long",
    lambda s: (*_pair(s.get("seen")), s.get("onset")),
    lambda t: _known(seen=_nanos_of(t[0], t[1]), onset=t[2]),
)
LATEST = Kind(
    "names array<string>, values array<double>, clocks array<long>",
    lambda s: (list(s), [v[0] for v in s.values()], [v[1] for v in s.values()]),
    lambda t: {n: [v, c] for n, v, c in zip(*t, strict=True)},
)
ALARM = Kind(
    "seconds long, nanos int, member boolean, episode_id string, activated_us long",
    lambda s: (*_pair(s.get("watermark")), s.get("member"), *s.get("episode", (None, None))),
    lambda t: _known(watermark=_nanos_of(t[0], t[1]), member=t[2], episode=None if t[3] is None else [t[3], int(t[4])]),
)


FLAGS = ["blocked", "not_topical", "overflow", "substituted"]
EXPORTS = uuid.UUID("f39fc794-f7e9-4d59-9c2a-5bb1d84af1b2")  # fixed value: namespace of export identities


def export_id(mrid: str, second: int, mean: float, address: tuple, flags: list[bool]) -> str:
    """Identity of an export: what it says, where to, why, and its flags in the order of FLAGS."""
    return str(uuid.uuid5(EXPORTS, "\0".join([mrid, str(second), mean.hex(), *map(str, address), *(str(int(f)) for f in flags)])))


def export_step(state: State, row: Any, key: tuple) -> list[dict]:
    """Per-mrid second means: a later second closes the open one, an earlier one is late."""
    second = row.field_us // SECOND
    out = []
    if state and second < state["second"]:
        return out
    if state and second > state["second"]:
        mean, address = stable_mean(state["values"]), (row.common_address, row.object_address, row.cause)
        flags = dict(zip(FLAGS, state["flags"], strict=True))
        ident = export_id(key[0], state["second"], mean, address, state["flags"])
        out.append({"mrid": key[0], "second_us": state["second"] * SECOND, "n": len(state["values"]), "mean": mean, **flags, "export_id": ident})
        state.clear()
    state.setdefault("second", second)
    state.setdefault("values", []).append(row.double_value)
    state["flags"] = [was or bool(getattr(row, f)) for was, f in zip(state.get("flags", [False] * 4), FLAGS, strict=True)]
    return out


def nanos(row: Any) -> int:
    """A row's time to the nanosecond, or to the microsecond where that is all it has."""
    if not hasattr(row, "at_seconds"):
        return 1000 * row.mccs_us
    return int(row.at_seconds) * 10**9 + int(row.at_nanos)


def capture_step(state: State, row: Any, key: tuple) -> list[dict]:
    """Episodes above a threshold, emitted when they end."""
    if nanos(row) <= state.get("seen", -math.inf):
        return []
    state["seen"] = nanos(row)
    onset = state.get("onset")
    if row.double_value > row.threshold:
        if onset is None:
            state["onset"] = row.mccs_us
        return []
    if onset is None:
        return []
    del state["onset"]
    return [{"mrid": key[0], "onset_us": onset, "cleared_us": row.mccs_us}]


def latest_step(state: State, row: Any, key: tuple) -> list[dict]:
    """The group's newest values; inputs too old against the newest time are evicted."""
    state[row.input] = [row.double_value, row.clock_us]
    names = row.names.split(",")
    if any(n not in state for n in names):
        return []
    newest = max(state[n][1] for n in names)
    stale = [n for n in names if row.max_age_us >= 0 and newest - state[n][1] > row.max_age_us]
    for n in stale:
        del state[n]
    if stale:
        return []
    return [{"group": key[0], "arrival_seq": row.arrival_seq, "newest_us": newest, "inputs": [state[n][0] for n in names]}]


EPISODES = uuid.UUID("f5d55f94-655f-5460-a315-f56a8a891007")


def alarm_step(state: State, row: Any, key: tuple) -> list[dict]:
    """Transitions of one rule and mrid; a removal clears but keeps the watermark.
    Where ``bound``, rows count only between joining and removal."""
    base = {"alarm_key": row.alarm_key, "rule": key[0], "mrid": key[1], "arrival_seq": row.arrival_seq, "mccs_us": None if row.gone else row.mccs_us}
    active = state.get("episode")
    if getattr(row, "joined", False):
        state["member"] = True
        return []
    if getattr(row, "bound", False) and not row.gone and not state.get("member"):
        return []
    if row.gone:
        state.pop("member", None)
        state.pop("episode", None)
        return [base | {"action": "clear", "episode_id": active[0], "activated_us": active[1]}] if active else []
    if nanos(row) <= state.get("watermark", -math.inf):
        return []
    state["watermark"] = nanos(row)
    if row.double_value > row.threshold:
        action = "refresh" if active else "activate"
        if not active:
            name = json.dumps([row.alarm_key, row.topic, str(row.partition), str(row.offset)], separators=(",", ":"), ensure_ascii=False)
            active = state["episode"] = [str(uuid.uuid5(EPISODES, name)), row.mccs_us]
    elif active:
        action = "clear"
        del state["episode"]
    else:
        return [base | {"action": "evaluate", "episode_id": None, "activated_us": None}]
    return [base | {"action": action, "episode_id": active[0], "activated_us": active[1]}]
