"""Mapping specifications and their compilation to Columns.

A specification says how a row's cells name entities and which pairs of these are
joined by an edge. It is small and lives on the driver; compiled, it becomes
ordinary expressions over one scan, so column pruning and pushdown work as usual.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions import normalizers as N


class MappingError(ValueError):
    """A specification that cannot be compiled."""


@dataclass(frozen=True)
class Key:
    """prefix + transform(column), or a template with {column} places."""

    column: str | None = None
    prefix: str = ""
    transform: str | None = None
    template: str | None = None
    transforms: dict = field(default_factory=dict, hash=False)

    @classmethod
    def of(cls, spec: dict | None) -> Key | None:
        spec = spec or {}
        if not (spec.get("column") or spec.get("template")):
            return None
        return cls(spec.get("column"), spec.get("prefix") or "", spec.get("transform"), spec.get("template"), dict(spec.get("transforms") or {}))

    def to_dict(self) -> dict:
        if self.template:
            return {"template": self.template, "transforms": self.transforms}
        return {"prefix": self.prefix, "column": self.column} | ({"transform": self.transform} if self.transform else {})


@dataclass(frozen=True)
class Attribute:
    name: str
    column: str | None = None
    type: str = "string"
    description: str = ""

    @classmethod
    def of(cls, spec: dict | str) -> Attribute:
        if isinstance(spec, str):
            return cls(spec, spec)
        name = str(spec.get("name") or spec.get("column") or "")
        return cls(name, spec.get("column") or spec.get("source_column"), str(spec.get("type") or "string").lower(), str(spec.get("description") or ""))


@dataclass
class Entity:
    name: str
    key: Key | None
    attributes: list[Attribute] = field(default_factory=list)


@dataclass
class Edge:
    """An end is an entity, by its own key or by one of the edge's."""

    predicate: str | None
    source: str
    target: str
    source_by: Key | None = None
    target_by: Key | None = None


@dataclass
class MappingSpec:
    entities: dict[str, Entity]
    edges: list[Edge]
    null_policy: str = "skip"

    @classmethod
    def of(cls, spec: dict | str) -> MappingSpec:
        """From a dict or JSON text."""
        if isinstance(spec, str):
            spec = json.loads(spec)
        entities = {
            name: Entity(name, Key.of((e or {}).get("key")), [Attribute.of(a) for a in (e or {}).get("attributes") or []])
            for name, e in (spec.get("entities") or {}).items()
        }
        edges = [
            Edge(
                e.get("predicate") or e.get("label") or e.get("relation"),
                (e.get("source") or {}).get("entity") or "", (e.get("target") or {}).get("entity") or "",
                Key.of((e.get("source") or {}).get("by")), Key.of((e.get("target") or {}).get("by")),
            )
            for e in spec.get("edges") or []
        ]
        return cls(entities, edges, (spec.get("options") or {}).get("null_policy") or "skip")

    def to_dict(self) -> dict:
        def end(name, by):
            return {"entity": name} | ({"by": by.to_dict()} if by else {})

        return {
            "entities": {n: {"key": e.key.to_dict() if e.key else {}, "attributes": [vars(a) for a in e.attributes]} for n, e in self.entities.items()},
            "edges": [{"predicate": e.predicate, "source": end(e.source, e.source_by), "target": end(e.target, e.target_by)} for e in self.edges],
            "options": {"null_policy": self.null_policy},
        }


PLACE = re.compile(r"\{([^{}]*)\}")


def cell(column: str, columns: list[str]) -> Column:
    """A cell as text; "" for null and for a column that the table lacks."""
    return N.text(F.col(f"`{column}`")) if column in columns else F.lit("")


def key_column(key: Key | None, columns: list[str]) -> Column:
    """The id a row gives for a key; null where it gives none."""
    if key is None:
        return F.lit(None).cast("string")
    if key.template:
        parts, at = [], 0
        for m in PLACE.finditer(key.template):
            if m.start() > at:
                parts.append(F.lit(key.template[at:m.start()]))
            parts.append(N.transform(key.transforms.get(m[1]))(cell(m[1], columns)))
            at = m.end()
        if at < len(key.template):
            parts.append(F.lit(key.template[at:]))
        value = F.concat(*parts)
        return F.when(value != "", value)
    value = N.transform(key.transform)(cell(key.column, columns))
    return F.when(value != "", F.concat(F.lit(key.prefix), value))


def entity_column(spec: MappingSpec, name: str, columns: list[str], by: Key | None = None) -> Column:
    entity = spec.entities.get(name)
    return key_column(by or (entity.key if entity else None), columns)


def compiled_edges(spec: MappingSpec, columns: list[str]) -> list[tuple[str, Column, Column]]:
    """(predicate, source id, target id) of each edge that has a predicate."""
    return [
        (e.predicate, entity_column(spec, e.source, columns, e.source_by), entity_column(spec, e.target, columns, e.target_by))
        for e in spec.edges if e.predicate
    ]


#: Words in the name or description of an attribute that make it a label, and types that do not: fixed values.
TITLE_WORDS = ("name", "title", "label")
DESCRIBED_WORDS = ("name", "label", "display", "title", "identifier")
SECOND_WORDS = ("display", "description", "full_name")
NO_LABEL_TYPES = ("integer", "float", "date", "datetime")


def label_order(entity: Entity) -> list[Attribute]:
    """Attributes that can label an entity, best first. Rank of an attribute:
    named like a title, described like one, named like a description, any text but
    ids and dates, anything but ids, numbers and dates; then all but ids; then the
    first one."""
    def rank(a: Attribute) -> int | None:
        name, about = a.name.lower(), a.description.lower()
        is_id = name.endswith("_id")
        if any(w in name for w in TITLE_WORDS):
            return 1
        if any(w in about for w in DESCRIBED_WORDS):
            return 2
        if any(w in name for w in SECOND_WORDS):
            return 3
        if a.type == "string" and not is_id and "date" not in name:
            return 4
        if not is_id and a.type not in NO_LABEL_TYPES:
            return 5
        return None

    usable = [a for a in entity.attributes if a.column]
    ranked = sorted((a for a in usable if rank(a)), key=rank)[:1]
    rest = [a for a in usable if not a.name.lower().endswith("_id")]
    order = []
    for a in ranked + rest + usable[:1]:
        if a not in order:
            order.append(a)
    return order


def label_column(entity: Entity, columns: list[str], node_id: Column) -> Column:
    """The first non-blank one of label_order, else the id."""
    values = [F.nullif(N.trim(cell(a.column, columns)), F.lit("")) for a in label_order(entity)]
    return F.coalesce(*values, node_id)
