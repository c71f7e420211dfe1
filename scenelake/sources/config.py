"""Configurations: files with a base, and overrides from the command line."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any


def merged(base: dict, new: dict) -> dict:
    """``base`` with the values of ``new``; mappings are merged key by key."""
    out = dict(base)
    for key, value in new.items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def load(path: str | Path) -> dict:
    """A JSON file, or YAML where that library is there; ``_BASE_`` names a file beside it to start from."""
    path = Path(path)
    text = path.read_text()
    if path.suffix in (".yaml", ".yml"):
        import yaml

        own = yaml.safe_load(text) or {}
    else:
        own = json.loads(text)
    base = own.pop("_BASE_", None)
    return merged(load(path.parent / base), own) if base else own


def overridden(config: dict, pairs: list[str]) -> dict:
    """``config`` with ``a.b=value`` pairs set; keys must exist, values are JSON or text of the old type."""
    out: dict = config
    for pair in pairs:
        name, _, text = pair.partition("=")
        try:
            value: Any = json.loads(text)
        except json.JSONDecodeError:
            value = text
        *way, last = name.split(".")
        old: Any = out
        for key in (*way, last):
            if not isinstance(old, dict) or key not in old:
                raise KeyError(name)
            old = old[key]
        if old is not None and not isinstance(value, type(old)) and not (isinstance(old, float) and isinstance(value, int)):
            raise TypeError(f"{name} is {type(old).__name__}")
        change: dict = {last: value}
        for key in reversed(way):
            change = {key: change}
        out = merged(out, change)
    return out
