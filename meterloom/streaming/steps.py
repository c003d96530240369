"""State machines over one key's rows: `step(state, row) -> (state, output or None)`.

States are plain JSON values, rows are dicts in event order. The streaming
operators and the batch checks drive the same functions.
"""

from __future__ import annotations

from meterloom.operators import sequences as S


def flap_step(state, row):
    """A firing restarts while fewer than three restarts lie in the window, else disables."""
    at = int(row["at_ms"])
    kept = [int(t) for t in state[0] if at - int(t) < S.FLAP_WINDOW_MS]
    if len(kept) >= S.FLAP_MAX:
        return (kept,), {"outcome": "disabled", "recent": len(kept)}
    return ([*kept, at],), {"outcome": "restarted", "recent": len(kept)}


def first_output_step(state, row, timeout_ms=60_000):
    """First-output stall: a request past its timeout while the whole service stays silent.

    Deadlines that lie before a row are settled with what was known by then.
    """
    s = dict(state or {"last": row["at_ms"], "open": {}})
    at, opened, fired = row["at_ms"], dict(s["open"]), []
    for request, (since, run) in sorted(s["open"].items(), key=lambda e: (e[1][0], e[0])):
        due = since + timeout_ms
        if due > at:
            continue
        del opened[request]
        if due - s["last"] >= timeout_ms:
            fired.append({"request": request, "run_id": run, "at_ms": due})
    if row["kind"] == "open":
        opened[str(row["request"])] = [at, row["run_id"]]
    elif row["kind"] == "frame":
        opened.pop(str(row["request"]), None)
        s["last"] = at
    return {"last": s["last"], "open": opened}, fired or None


def first_output_due(state, timeout_ms=60_000):
    """When the oldest open request runs out of time."""
    return min((since + timeout_ms for since, _ in state["open"].values()), default=None)


def budget_due(state):
    return state["deadline"]


def budget_step(state, row, max_age_ms=86_400_000, mode="immediate"):
    """Restart decisions: the flap budget for firings, and a periodic age limit outside it."""
    s = dict(state or {"recent": [], "deadline": None, "armed": False})
    at, out = row["at_ms"], []
    due = s["deadline"] is not None and at >= s["deadline"]
    if due and (mode == "immediate" or (mode == "on_idle" and row.get("inflight") == 0) or (mode == "on_request" and row["kind"] == "request")):
        out.append({"at_ms": s["deadline"] if mode == "immediate" else at, "trigger": "periodic", "outcome": "restarted"})
        s["deadline"] = None
    if row["kind"] == "spawn":
        s["deadline"] = at + max_age_ms
    elif row["kind"] == "firing":
        # The run is drained whatever the outcome, and its age limit goes with it.
        (recent,), found = flap_step((s["recent"],), row)
        s["recent"], s["deadline"] = [int(t) for t in recent], None
        out.append({"at_ms": at, "trigger": row["trigger"], "outcome": found["outcome"]})
    return s, out or None
