"""All registered queries of the engine, with their SQL."""

from __future__ import annotations

from scenelake.plans import basics, kinematics, lanes, pairs, predictions, primitives, samples, scoring, shapes, trajectories

FLAGSHIP = "scene_scores"
_MODULES = (kinematics, pairs, lanes, scoring, predictions, primitives, basics, trajectories, shapes, samples)
_ALL = {name: pair for module in _MODULES for name, pair in module.QUERIES.items()}


def queries() -> dict:
    return {name: run for name, (run, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
