"""Configuration files: TOML sections to the engine's configuration."""

from __future__ import annotations

import os
import tomllib
from dataclasses import fields, replace

from .model import EngineConfig

# Section names of the file by field of the configuration.
SECTIONS = {"flows": "flows", "clones": "clones", "risk": "risk", "communities": "communities", "dead-code": "dead_code", "search": "search"}


def load_config(path: str) -> EngineConfig:
    """The configuration of a file; defaults where the file, a section or a key is missing; an error where it is invalid.

    Keys may be written with ``-`` or ``_``. Sections and keys of other programs are left alone.
    """
    if not os.path.exists(path):
        return EngineConfig()
    with open(path, "rb") as source:
        content = tomllib.load(source)
    config = EngineConfig()
    for section, name in SECTIONS.items():
        given = content.get(section, {})
        if not isinstance(given, dict):
            raise ValueError(f"[{section}] must be a table")
        own = getattr(config, name)
        known = {f.name: getattr(own, f.name) for f in fields(own)}
        found = {}
        for key, value in given.items():
            key = key.replace("-", "_")
            if key not in known:
                continue
            default = known[key]
            if isinstance(default, tuple):
                value = tuple(value) if isinstance(value, list) else value
            elif isinstance(default, float) and isinstance(value, int) and not isinstance(value, bool):
                value = float(value)
            if not isinstance(value, type(default)):
                raise ValueError(f"[{section}] {key}: {value!r} is no {type(default).__name__}")
            found[key] = value
        config = replace(config, **{name: replace(own, **found)})
    return config
