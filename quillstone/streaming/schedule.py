"""Scheduled jobs that never run twice at once, across drivers: a lease with an expiry in a versioned manifest.

A run takes the lease by committing a version, which only one runner can; it works, then commits its result and gives the lease back.
A runner that dies leaves a lease that expires, and whoever comes next takes over; if the first comes back after that, its
result is not recorded. The last result, failed or not, and the number of runs stay in the manifest.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from quillstone.operators.versions import Versions

LEASE_MS = 3_600_000


class Schedule:
    """A job every ``hours`` (zero or less: never) with its state below ``root``."""

    def __init__(self, spark: SparkSession, root: str, hours: float, lease_ms: int = LEASE_MS, clock: Callable[[], int] = lambda: int(time.time() * 1000)) -> None:
        self.versions, self.hours, self.lease_ms, self.clock = Versions(spark, root), hours, lease_ms, clock

    def status(self) -> dict:
        """running, next_run, total_runs, last_run and last_result."""
        m, now = self.versions.read()[1], self.clock()
        last = m.get("last_run")
        due = None if self.hours <= 0 else now if last is None else last + int(self.hours * 3_600_000)
        return {"running": m.get("until", 0) > now, "next_run": due, "total_runs": m.get("runs", 0), "last_run": last, "last_result": m.get("result")}

    def run(self, job: Callable[[], dict], force: bool = False) -> dict | None:
        """The job's result, with ``success``; None if it is not due, runs elsewhere, or lost its lease meanwhile."""
        owner, start = uuid.uuid4().hex, self.clock()

        def take(number: int, m: dict) -> dict | None:
            last, now = m.get("last_run"), self.clock()
            due = force or (self.hours > 0 and (last is None or now - last >= self.hours * 3_600_000))
            return None if not due or m.get("until", 0) > now else m | {"owner": owner, "until": now + self.lease_ms}

        self.versions.change(take)
        if self.versions.read()[1].get("owner") != owner:
            return None
        try:
            result = job() | {"success": True}
        except Exception as e:  # a failed run is a run: it is recorded and the schedule goes on
            result = {"success": False, "error": str(e)[:500]}
        result |= {"timestamp": start, "duration_ms": self.clock() - start}

        def give_back(number: int, m: dict) -> dict | None:
            return None if m.get("owner") != owner else {"runs": m.get("runs", 0) + 1, "last_run": start, "result": result}

        before = self.versions.read()[1].get("owner")
        self.versions.change(give_back)
        return result if before == owner else None
