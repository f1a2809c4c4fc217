"""Memory of this process."""

from __future__ import annotations

import resource
from pathlib import Path


def memory() -> dict:
    """Current and peak resident MB of this process; current is None where the system does not tell."""
    now = None
    status = Path("/proc/self/status")
    if status.exists():
        now = next((round(int(x.split()[1]) / 1024, 3) for x in status.read_text().splitlines() if x.startswith("VmRSS:")), None)
    return {"current_mb": now, "peak_mb": round(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024, 3)}
