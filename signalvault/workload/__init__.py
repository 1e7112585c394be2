from signalvault.workload import comparing, ledgers, merging, planning  # noqa: F401  (they register queries)
from signalvault.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
