"""Configuration as plain data on the driver (SRC-19/20)."""

from __future__ import annotations

from typing import Any


def merged(defaults: dict[str, Any], *layers: dict[str, Any]) -> dict[str, Any]:
    """Later layers over earlier ones, dictionaries merged key by key."""
    out = dict(defaults)
    for layer in layers:
        for k, v in (layer or {}).items():
            out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def section_rows(config: dict[str, Any]) -> list[tuple[str, str, list[str], int | None]]:
    """(file, header, aliases, order) from entries that are a header or say more."""
    out = []
    for file, entry in (config.get("sections") or {}).items():
        if isinstance(entry, str):
            out.append((file, entry, [], None))
        else:
            out.append((file, entry.get("header", ""), list(entry.get("aliases") or []), entry.get("order")))
    return sorted(out, key=lambda r: (999 if r[3] is None else r[3]))


def check(value: Any, schema: dict[str, Any], at: str = "") -> list[str]:
    """Errors of a value against the part of JSON Schema that configurations use."""
    kinds = {"string": str, "number": (int, float), "integer": int, "boolean": bool, "array": list, "object": dict}
    errors = []
    if "oneOf" in schema:
        return [] if any(not check(value, s, at) for s in schema["oneOf"]) else [f"{at or '.'}: fits none of the forms"]
    kind = schema.get("type")
    if kind and (not isinstance(value, kinds[kind]) or (kind in ("number", "integer") and isinstance(value, bool))):
        return [f"{at or '.'}: is no {kind}"]
    if "enum" in schema and value not in schema["enum"]:
        errors.append(f"{at}: is none of {schema['enum']}")
    if isinstance(value, str) and "pattern" in schema:
        import re

        if not re.search(schema["pattern"], value):
            errors.append(f"{at}: does not match {schema['pattern']}")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            errors.append(f"{at}: out of range")
    if isinstance(value, list):
        if len(value) < schema.get("minItems", 0) or len(value) > schema.get("maxItems", len(value)):
            errors.append(f"{at}: wrong number of items")
        for k, v in enumerate(value):
            errors += check(v, schema.get("items", {}), f"{at}[{k}]")
    if isinstance(value, dict):
        errors += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in schema.get("properties", {}):
                errors += check(v, schema["properties"][k], f"{at}.{k}")
    return errors
