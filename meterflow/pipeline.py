"""A small dependency runner for daily jobs."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from graphlib import TopologicalSorter


@dataclass(frozen=True)
class Step:
    name: str
    run: Callable[[], object]
    after: tuple[str, ...] = ()
    retries: int = 1
    wait_s: float = 120


def run_daily(steps: list[Step], sleep: Callable[[float], None] = time.sleep) -> dict[str, str]:
    """Run steps in dependency order; each is retried, and what depends on a failed step is skipped.

    Returns done, failed or skipped for each step. Unknown dependencies and cycles are errors.
    """
    known = {s.name: s for s in steps}
    for s in steps:
        if missing := set(s.after) - set(known):
            raise ValueError(f"{s.name} depends on unknown {sorted(missing)}")
    status: dict[str, str] = {}
    for name in TopologicalSorter({s.name: s.after for s in steps}).static_order():
        step = known[name]
        if any(status[a] != "done" for a in step.after):
            status[name] = "skipped"
            continue
        for attempt in range(step.retries + 1):
            try:
                step.run()
                status[name] = "done"
                break
            except Exception:
                status[name] = "failed"
                if attempt < step.retries:
                    sleep(step.wait_s)
    return status
