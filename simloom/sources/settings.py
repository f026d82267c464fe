"""Tool settings from JSON with type coercion."""

from __future__ import annotations

import dataclasses
import json


def load_settings(settings_class, path: str):
    """Instance of a dataclass with values from a JSON file; unknown names are errors.

    Values are coerced to the type of the default: texts such as ``"yes"`` become booleans and
    numeric texts become numbers.
    """
    with open(path, encoding="utf-8") as source:
        given = json.load(source)
    fields = {f.name: f for f in dataclasses.fields(settings_class)}
    unknown = sorted(set(given) - set(fields))
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return settings_class(**{name: _coerced(value, fields[name].default) for name, value in given.items()})


def _coerced(value, default):
    if isinstance(default, bool):
        return value if isinstance(value, bool) else str(value).strip().lower() in {"1", "true", "yes", "on"}
    if isinstance(default, (int, float)) and not isinstance(value, bool):
        return type(default)(value)
    return value
