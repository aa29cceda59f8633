"""Configurations: YAML or JSON, checked against a schema with defaults, merged from patches."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any


class ConfigError(ValueError):
    """A configuration breaks its schema."""


def read(path: str | Path) -> dict:
    text = Path(path).read_text()
    if str(path).endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


_KINDS = {"number": (int, float), "integer": int, "string": str, "boolean": bool, "array": list, "object": dict}


def validate(value: Any, schema: dict, at: str = "") -> Any:
    """value with defaults put in. Knows type, enum, minimum, maximum, required, properties, items and
    additionalProperties; unknown keys fail unless allowed."""
    kind = schema.get("type")
    if kind and (not isinstance(value, _KINDS[kind]) or (kind in ("number", "integer") and isinstance(value, bool))):
        raise ConfigError(f"{at or 'config'}: {kind} expected")
    if "enum" in schema and value not in schema["enum"]:
        raise ConfigError(f"{at}: not one of {schema['enum']}")
    if "minimum" in schema and value < schema["minimum"] or "maximum" in schema and value > schema["maximum"]:
        raise ConfigError(f"{at}: out of range")
    if isinstance(value, dict) and "properties" in schema:
        known, out = schema["properties"], dict(value)
        if (extra := sorted(set(value) - set(known))) and not schema.get("additionalProperties"):
            raise ConfigError(f"{at or 'config'}: unknown keys {', '.join(extra)}")
        for name, part in known.items():
            if name not in out and "default" in part:
                out[name] = part["default"]
            if name in out:
                out[name] = validate(out[name], part, f"{at}.{name}".lstrip("."))
        if missing := sorted(set(schema.get("required", [])) - set(out)):
            raise ConfigError(f"{at or 'config'}: missing {', '.join(missing)}")
        return out
    if isinstance(value, list) and "items" in schema:
        return [validate(x, schema["items"], f"{at}[{i}]") for i, x in enumerate(value)]
    return value


def merge(base: dict, patch: dict) -> dict:
    out = dict(base)
    for k, v in patch.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def complexity(patch: Any) -> int:
    """Number of leaves."""
    if isinstance(patch, dict):
        return sum(map(complexity, patch.values()))
    return sum(map(complexity, patch)) if isinstance(patch, list) else 1
