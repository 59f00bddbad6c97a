"""Extraction programs: flat field specs and nested schemas, their validation and their Spark types."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import types as T

from pagequarry.functions.text import Transform


@dataclass(frozen=True)
class FieldSpec:
    """``name=selector``, ``name=selector[]``, ``name=selector@attr``."""

    name: str
    selector: str
    attr: str = ""
    multiple: bool = False
    trim: bool = True

    def spark_type(self) -> T.DataType:
        return T.ArrayType(T.StringType()) if self.multiple else T.StringType()


def parse_field_spec(spec: str) -> FieldSpec:
    name, eq, selector = spec.partition("=")
    if not eq or not name or not selector:
        raise ValueError(f"invalid field spec {spec!r}: name=selector expected")
    selector, attr = selector.strip(), ""
    if "@" in selector:
        selector, _, attr = selector.rpartition("@")
    multiple = selector.endswith("[]")
    selector = (selector[:-2] if multiple else selector).strip()
    if not selector:
        raise ValueError(f"invalid field spec {spec!r}: empty selector")
    return FieldSpec(name.strip(), selector, attr, multiple)


@dataclass(frozen=True)
class SchemaField:
    """selectors: None if the key is absent; ("",) is the matched element itself."""

    selectors: tuple[str, ...] | None = None
    attr: str = ""
    multiple: bool = False
    fields: Mapping[str, SchemaField] = field(default_factory=dict)
    transforms: tuple[Transform, ...] = ()

    def spark_type(self) -> T.DataType:
        one: T.DataType = T.StringType()
        if self.fields:
            one = T.StructType([T.StructField(k, f.spark_type()) for k, f in self.fields.items()])
        elif any(t.type == "split" for t in self.transforms):
            one = T.ArrayType(T.StringType())
        return T.ArrayType(one) if self.multiple else one


@dataclass(frozen=True)
class Schema:
    version: int
    fields: Mapping[str, SchemaField]

    def spark_type(self) -> T.StructType:
        return T.StructType([T.StructField(k, f.spark_type()) for k, f in self.fields.items()])


KNOWN = {"trim", "lowercase", "uppercase", "regex", "split"}
_FIELD_KEYS = {"selector", "attr", "multiple", "fields", "transforms"}


def _known_keys(where: str, given: Mapping, allowed: set[str]) -> None:
    if extra := set(given) - allowed:
        raise ValueError(f"{where}: unknown keys {sorted(extra)}")


def _field(path: str, raw: object) -> SchemaField:
    if not isinstance(raw, Mapping):
        raise ValueError(f"{path}: a mapping is expected")
    _known_keys(path, raw, _FIELD_KEYS)
    sel = raw.get("selector")
    selectors = None if sel is None else (sel,) if isinstance(sel, str) else tuple(sel)
    steps = []
    for t in raw.get("transforms") or ():
        _known_keys(path, t, {"type", "pattern", "separator"})
        steps.append(Transform(t.get("type", ""), t.get("pattern", ""), t.get("separator", "")))
    return SchemaField(selectors, raw.get("attr", ""), bool(raw.get("multiple", False)), {k: _field(f"{path}.{k}", v) for k, v in (raw.get("fields") or {}).items()}, tuple(steps))


def _validate(path: str, f: SchemaField, top: bool, version: int) -> None:
    if top and (not f.selectors or f.selectors == ("",)):
        raise ValueError(f"{path}: top-level fields need a selector")
    if version == 1 and f.selectors and len(f.selectors) > 1:
        raise ValueError(f"{path}: fallback selectors need version 2")
    if version == 1 and f.transforms:
        raise ValueError(f"{path}: transforms need version 2")
    if f.transforms and f.fields:
        raise ValueError(f"{path}: transforms on a field with fields")
    for t in f.transforms:
        if t.type not in KNOWN:
            raise ValueError(f"{path}: unknown transform {t.type!r}")
        if t.type == "regex" and not t.pattern:
            raise ValueError(f"{path}: regex needs a pattern")
        if t.type == "split" and not t.separator:
            raise ValueError(f"{path}: split needs a separator")
    for k, c in f.fields.items():
        _validate(f"{path}.{k}", c, False, version)


def parse_schema(raw: Mapping) -> Schema:
    _known_keys("schema", raw, {"version", "fields", "name", "description"})
    version = raw.get("version", 0)
    if version not in (1, 2):
        raise ValueError(f"version {version} is not supported (1 or 2)")
    fields = {k: _field(k, v) for k, v in (raw.get("fields") or {}).items()}
    if not fields:
        raise ValueError("schema has no fields")
    for k, f in fields.items():
        _validate(k, f, True, version)
    return Schema(version, fields)


def load_schema(path: str) -> Schema:
    """Schema of a .json, .yaml or .yml file."""
    text = Path(path).read_text()
    if path.endswith(".json"):
        return parse_schema(json.loads(text))
    if path.endswith((".yaml", ".yml")):
        import yaml

        return parse_schema(yaml.safe_load(text))
    raise ValueError(f"{path}: .yaml, .yml or .json expected")
