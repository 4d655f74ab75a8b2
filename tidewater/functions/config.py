"""Layered configuration: providers, then checks, then overrides, then randomised values. Driver side only."""

from __future__ import annotations

import importlib
import uuid
from collections.abc import Callable, Mapping
from typing import Any

SPECIFIER, PROVIDERS, OVERRIDE, RANDOMIZE = "specifier", "providers", "config.override.", ".randomize"


def load_prefixed(config: Mapping[str, Any], prefix: str) -> dict[str, Any]:
    """The entries under a prefix, without it."""
    return {k[len(prefix) :]: v for k, v in config.items() if k.startswith(prefix)}


def to_collection(value: Any) -> list:
    """A comma-separated text or any iterable as a list; None as an empty one."""
    if value is None:
        return []
    return [x.strip() for x in value.split(",")] if isinstance(value, str) else list(value)


def instantiate(path: str) -> Any:
    """An instance, made without arguments, of the class at a dotted path; an instance or class passes through."""
    if not isinstance(path, str):
        return path() if isinstance(path, type) else path
    module, _, name = path.rpartition(".")
    return getattr(importlib.import_module(module), name)()


def create(config: Mapping[str, Any], required: tuple[str, ...] = (), environment: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """The configuration that results from all layers.

    Providers come first: callables from the specifier to a mapping, or dotted paths of classes whose instances are such and may have
    `configure(config)`. What a provider gives replaces what is there, a later one's what an earlier one gave, and `providers`
    stays. Then every required key must be set; a generic override (`config.override.<key>`) replaces a key only if it is present; a specific one
    (`config.override.<specifier>.<key>`) always applies; last, `<key>.randomize` = true appends a random suffix.
    """
    env, out = dict(environment or {}), dict(config)
    specifier = str(out.get(SPECIFIER, ""))
    for p in to_collection(out.get(PROVIDERS)):
        p = p if isinstance(p, Callable) and not isinstance(p, type) else instantiate(p)
        if hasattr(p, "configure"):
            p.configure(dict(config))
        out |= p(specifier)
    if missing := [k for k in required if out.get(k) is None]:
        raise ValueError(f"missing configuration: {', '.join(missing)}")
    general = load_prefixed(env, OVERRIDE)
    out |= {k: v for k, v in general.items() if k in out}
    if specifier:
        out |= load_prefixed(general, f"{specifier}.")
    for k in [k for k in out if k.endswith(RANDOMIZE)]:
        if str(out.pop(k)).lower() == "true" and (name := k[: -len(RANDOMIZE)]) in out:
            out[name] = f"{out[name]}-{uuid.uuid4()}"
    return out
