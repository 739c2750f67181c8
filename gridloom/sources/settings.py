"""Run settings: defaults, then a JSON file, then what the caller gives."""

from __future__ import annotations

import json


def merge(defaults: dict, path: str | None = None, **given) -> dict:
    """Later sources win; None counts as not given; unknown names raise ValueError."""
    own = dict(defaults)
    layers = [given]
    if path:
        with open(path, encoding="utf-8") as f:
            layers.insert(0, json.load(f))
    for layer in layers:
        unknown = sorted(set(layer) - set(defaults))
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        own.update({k: v for k, v in layer.items() if v is not None})
    return own


def batch(spec: dict, required: tuple[str, ...] = ("id",)) -> list[dict]:
    """The experiments of a batch: `common` settings below each one's own; ids must be there and differ."""
    out, seen = [], set()
    for own in spec.get("experiments", []):
        full = {**spec.get("common", {}), **own}
        lost = [k for k in required if k not in full]
        if lost:
            raise ValueError(f"missing settings: {', '.join(lost)}")
        if full["id"] in seen:
            raise ValueError(f"experiment {full['id']} is there twice")
        seen.add(full["id"])
        out.append(full)
    return out
