"""The gate that a candidate command has to pass, as a step from one command of an aircraft to the next."""

from __future__ import annotations

from typing import Any, NamedTuple


class Issued(NamedTuple):
    """The last accepted command of one kind: its target and time."""

    target: float
    epoch: float


class GateState(NamedTuple):
    """When an aircraft's next command may come, and its last accepted commands by kind."""

    until: float
    last: dict[str, Issued]


def _against(state: GateState, r: Any, axis_s: float, memory_s: float) -> str:
    """Why the gate rejects the command, or an empty text. The first reason counts."""
    if r.epoch < state.until:
        return "aircraft cooldown"
    before = state.last.get(r.family)
    if before is None:
        return ""
    if r.epoch < before.epoch + axis_s:
        return "axis cooldown"
    if r.target == before.target and r.epoch - before.epoch < memory_s:
        return "repeated target"
    if r.family == "altitude":
        phase = getattr(r, "phase", None)
        back = (phase == "departure" and r.target < before.target) or (phase == "arrival" and r.target > before.target)
        return "regressive altitude" if back else ""
    speed = getattr(r, "ground_speed_kt", None)
    if r.family == "speed" and speed is not None and (before.target - speed) * (r.target - speed) < 0:
        return "speed reversal"
    return ""


def gate_step(state: GateState | None, r: Any, cooldown_s: float, axis_s: float, memory_s: float) -> tuple[GateState, str]:
    """The state after a command, and the reason against it.

    A command is rejected while the aircraft or its kind of command pauses, if it repeats the last target within the
    memory, if it takes a departure down or an arrival up again, or if it turns a speed change round. Unknown phases
    and speeds reject nothing. Only accepted commands change the state.
    """
    state = state or GateState(float("-inf"), {})
    reason = _against(state, r, axis_s, memory_s)
    if not reason:
        state = GateState(r.epoch + cooldown_s, {**state.last, r.family: Issued(r.target, r.epoch)})
    return state, reason
