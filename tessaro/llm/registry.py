"""Names under which the operators' queries are registered."""

from __future__ import annotations

from tessaro.llm import oracles
from tessaro.llm import queries as q

#: Queries of parts and invariants of the operators' results.
_CHECKS = ("quality_base_counts", "line_dedup_words", "packing_invariants", "mixing_targets", "mixing_near_targets", "shard_invariants")
QUERIES = {name: f for name, f in vars(q).items() if name.startswith("op") or name in _CHECKS}
ORACLE_SQL = dict(oracles.ORACLE_SQL)
