"""From an ontology and a table's headers to a mapping specification. All of it
is plan-time work on the driver; no data is read."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

from .mapping import Attribute, Edge, Entity, Key, MappingSpec

#: Signs between the ends of a relationship given as text: fixed values.
ARROW = re.compile(r"\s*(?:->|→|-|\|)\s*")
#: Header names to try for a target whose name holds the word: fixed values.
SYNONYMS = {
    "customer": ("segment", "customer"),
    "date": ("date",),
    "product": ("product",),
    "country": ("country",),
    "transaction": ("transaction", "txn", "row_id"),
}


def snake(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9]+", "_", name).strip("_").lower()


def camel_snake(name: str) -> str:
    return snake(re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name))


def compact(name: str) -> str:
    return camel_snake(name).replace("_", "")


class Headers:
    """A table's headers, looked up without regard to case or blanks at the ends."""

    def __init__(self, headers: list[str]):
        self.original = list(headers)
        self.lower = [h.strip().lower() for h in headers]
        self.by_lower = dict(zip(reversed(self.lower), reversed(self.original)))

    def find(self, name: str | None) -> str | None:
        return self.by_lower.get(name.strip().lower()) if isinstance(name, str) and name.strip() else None

    def first(self, test) -> str | None:
        return next((o for o, h in zip(self.original, self.lower) if test(h)), None)


@dataclass
class OntologyEntity:
    name: str
    keys: list[str] = field(default_factory=list)  # columns; several: a composite key
    attributes: list[Attribute] = field(default_factory=list)
    phrase: str = ""  # a key given in words


@dataclass
class Relationship:
    predicate: str
    source: str
    target: str
    source_col: str = ""
    target_col: str = ""


@dataclass
class Ontology:
    entities: list[OntologyEntity]
    relationships: list[Relationship]

    def entity(self, name: str) -> OntologyEntity | None:
        return next((e for e in self.entities if e.name.lower() == name.strip().lower()), None)


def normalise(spec: dict | None) -> Ontology:
    """Entities as a dict by name or a list; relationships as objects or as text
    like "A -> B". A key may be a column, a list of columns or a phrase; without
    one the first attribute that ends in _id is taken."""
    spec = spec if isinstance(spec, dict) else {}
    given = spec.get("entities") or []
    if isinstance(given, dict):
        given = [{"name": n} | (e if isinstance(e, dict) else {}) for n, e in given.items()]
    entities = []
    for e in given:
        name = str(e.get("name") or "Entity").strip() or "Entity"
        attributes = [Attribute.of(a) for a in e.get("attributes") or []]
        key = e.get("key") or e.get("primary_key")
        if isinstance(key, dict):
            key = key.get("columns") or key.get("column")
        keys = [k.strip() for k in ([key] if isinstance(key, str) else key or []) if isinstance(k, str) and k.strip()]
        phrase = ""
        if len(keys) == 1 and keys[0].lower().startswith("composite key"):
            keys, phrase = [], keys[0]
        if not keys and not phrase:
            keys = [a.name for a in attributes if a.name.endswith("_id")][:1]
        entities.append(OntologyEntity(name, keys, attributes, phrase))
    relationships = []
    rels = spec.get("relationships") or []
    for r in [rels] if isinstance(rels, dict) else rels:
        if isinstance(r, str):
            parts = [p for p in ARROW.split(r) if p]
            if len(parts) >= 2:
                relationships.append(Relationship("related_to", parts[0].strip(), parts[-1].strip()))
        elif isinstance(r, dict):

            def end(v):
                return str((v.get("name") or v.get("entity") or "") if isinstance(v, dict) else v or "").strip()

            join = r.get("join_columns") if isinstance(r.get("join_columns"), dict) else {}
            predicate = str(r.get("predicate") or r.get("relation") or r.get("label") or "").strip() or "related_to"
            relationships.append(Relationship(predicate, end(r.get("source")), end(r.get("target")), str(join.get("source_col") or "").strip(), str(join.get("target_col") or "").strip()))
    return Ontology(entities, relationships)


def suggest(profile: list[dict], name: str = "Row") -> dict:
    """An ontology from a column profile (name, non_null, nulls, distinct,
    inferred_type): what stands in for a model that looks at the table. The key is
    the first column whose values are all there and all different, those that end
    in key or id first; text columns with at most half as many values as rows, and
    other such columns that end in key or id, are targets of has_<column>; the rest
    are attributes."""
    def named(c: str) -> bool:
        return snake(c).endswith(("id", "key"))

    unique = [p["name"] for p in profile if p["non_null"] and not p["nulls"] and p["distinct"] == p["non_null"]]
    key = next(iter(sorted(unique, key=lambda c: not named(c))), None)
    targets = [p["name"] for p in profile if p["name"] != key and p["non_null"] and 2 * p["distinct"] <= p["non_null"] and (p["inferred_type"] == "string" or named(p["name"]))]
    attributes = [{"name": p["name"], "type": p["inferred_type"]} for p in profile if p["name"] not in (key, *targets)]
    main = {"name": name, "attributes": attributes} | ({"key": key} if key else {})
    return {"entities": [main, *({"name": t, "key": t} for t in targets)], "relationships": [{"predicate": f"has_{snake(t)}", "source": name, "target": t} for t in targets]}


def main_entity(ontology: Ontology, headers: Headers) -> tuple[str, str]:
    """(entity, key column): the source of most relationships (the first of
    equals); else the first whose key is a header; else the first with a header
    that ends in _id, or the first header."""
    counts = Counter(r.source.lower() for r in ontology.relationships if r.source)
    if counts:
        e = ontology.entity(max(counts, key=counts.get))
        if e:
            return e.name, headers.find(e.keys[0] if e.keys else None) or (headers.original or ["id"])[0]
    for e in ontology.entities:
        if found := headers.find(e.keys[0] if e.keys else None):
            return e.name, found
    name = ontology.entities[0].name if ontology.entities else "Entity"
    return name, headers.first(lambda h: h.endswith("_id")) or (headers.original or ["id"])[0]


def header_containing(target: str, headers: Headers, attributes: list[Attribute]) -> str | None:
    """The header that names a target: equal, containing it, a like-named
    attribute, or a synonym."""
    name = camel_snake(target)
    if found := headers.find(name) or headers.first(lambda h: compact(name) in compact(h)):
        return found
    for a in attributes:
        s = camel_snake(a.name)
        if (found := headers.find(s)) and (s in name or name in s):
            return found
    for word, others in SYNONYMS.items():
        if word in target.lower():
            for o in others:
                if found := headers.find(o):
                    return found
    return None


def header_equal(target: str, headers: Headers, attributes: list[Attribute]) -> str | None:
    """The header that names a target: equal (with or without underscores), the
    target's own _id attribute, or an _id header that holds its name."""
    name = camel_snake(target)
    own = next((a.name for a in attributes if a.name.endswith("_id")), None)
    return (
        headers.find(name) or headers.first(lambda h: compact(h) == compact(name)) or headers.find(own)
        or headers.first(lambda h: h.endswith("_id") and name in h)
    )


def prefix(entity: str) -> str:
    return f"{snake(entity)}:"


def composite(entity: str, columns: list[str]) -> Key:
    return Key(template=prefix(entity) + "|".join("{%s}" % c for c in columns), transforms={c: "trim" if c.lower() == "date" else "slug" for c in columns})


def own_key(e: OntologyEntity, headers: Headers, prefixed: bool = True) -> Key | None:
    """The key that an entity's definition gives, if its columns exist."""
    columns = [headers.find(k) for k in e.keys]
    if e.phrase:
        columns = [o for o, h in zip(headers.original, headers.lower) if h and h in e.phrase.lower()]
    if not columns or not all(columns):
        return None
    return composite(e.name, columns) if len(columns) > 1 else Key(columns[0], prefix(e.name) if prefixed else "")


def compile_star(spec: dict, headers: list[str]) -> tuple[MappingSpec, list[str]]:
    """One main entity and the targets of its relationships, each from the header
    that names it best, by a slug of its value."""
    ontology, h, warnings = normalise(spec), Headers(headers), []
    if not ontology.entities:
        return MappingSpec({}, []), ["no entities in the ontology"]
    name, column = main_entity(ontology, h)
    main = ontology.entity(name) or OntologyEntity(name)
    if h.find(column) is None:
        warnings.append(f"key column {column!r} of {name!r} is not among the headers")
    key = own_key(main, h) if main.phrase or len(main.keys) > 1 else None
    if key is not None and not key.template:
        key = composite(name, [key.column])
    entities = {name: Entity(name, key or Key(column, prefix(name)))}
    edges = []
    for r in ontology.relationships:
        if not r.target or r.source.lower() != name.lower():
            continue
        found = header_containing(r.target, h, main.attributes)
        if not found:
            warnings.append(f"no header for target {r.target!r}")
            continue
        entities[r.target] = Entity(r.target, Key(found, prefix(r.target), "slug"))
        edges.append(Edge(r.predicate, name, r.target))
    return MappingSpec(entities, edges), warnings


def compile_all(spec: dict, headers: list[str], prefixed: bool = True) -> tuple[MappingSpec, list[str]]:
    """All entities and relationships. Ends are named by their entities' own keys; a
    join column that differs from the target's key names the target's end by
    that column, under the target's prefix. prefixed=False leaves prefixes out."""
    ontology, h, warnings = normalise(spec), Headers(headers), []
    main, _ = main_entity(ontology, h)
    entities = {}
    for e in ontology.entities:
        key = own_key(e, h, prefixed)
        if e.keys and key is None:
            warnings.append(f"entity {e.name!r}: key {', '.join(e.keys)!r} is not among the headers")
        entities[e.name] = Entity(e.name, key, list(e.attributes))
    edges = []
    for r in ontology.relationships:
        source, target = r.source or main, r.target
        known = ontology.entity(target)
        column = h.find(r.source_col) or h.find(r.target_col) or header_equal(target, h, known.attributes if known else [])
        own = entities[known.name].key if known else None
        by = Key(column, prefix(target) if prefixed else "") if column and (own is None or own.column not in (None, column)) else None
        edges.append(Edge(r.predicate, (ontology.entity(source) or OntologyEntity(source)).name, known.name if known else target, None, by))
        if not known:
            entities.setdefault(target, Entity(target, by))
    return MappingSpec(entities, edges), warnings


def bind_attributes(mapping: MappingSpec, headers: list[str]) -> tuple[MappingSpec, list[str]]:
    """Give each attribute its column: equal header, equal snake case, or one whose
    compact form holds the attribute's or is held by it."""
    h, missing = Headers(headers), []
    entities = {}
    for name, e in mapping.entities.items():
        bound = []
        for a in e.attributes:
            c = compact(a.name)
            column = h.find(a.column) or h.find(a.name) or h.first(lambda x: snake(x) == camel_snake(a.name)) or (c and h.first(lambda x: c in compact(x) or (compact(x) and compact(x) in c)))
            if not column:
                missing.append(f"{name}.{a.name}")
            bound.append(Attribute(a.name, column or None, a.type, a.description))
        entities[name] = Entity(name, e.key, bound)
    return MappingSpec(entities, mapping.edges, mapping.null_policy), missing


def populate_keys(mapping: MappingSpec, headers: list[str], prefixed: bool = True) -> tuple[MappingSpec, list[str]]:
    """Keys for the entities without one: <entity>_id, a join column of an edge, or
    the first header."""
    h, warnings, entities = Headers(headers), [], {}
    for name, e in mapping.entities.items():
        key = e.key
        if key is None:
            joins = [by.column for x in mapping.edges for end, by in ((x.target, x.target_by), (x.source, x.source_by)) if end == name and by and by.column]
            column = h.find(f"{snake(name)}_id") or next((c for j in joins if (c := h.find(j))), None)
            if column is None and h.original:
                column = h.original[0]
                warnings.append(f"entity {name!r}: keyed by the first header {column!r}")
            key = Key(column, prefix(name) if prefixed else "") if column else None
            if key is None:
                warnings.append(f"entity {name!r}: no header to key it by")
        entities[name] = Entity(name, key, e.attributes)
    return MappingSpec(entities, mapping.edges, mapping.null_policy), warnings


def validate(spec: dict, headers: list[str] | None = None, min_entities: int = 1) -> list[str]:
    """What is wrong with an ontology; nothing if it is valid."""
    ontology, issues = normalise(spec), []
    h = Headers(headers or [])
    if len(ontology.entities) < min_entities:
        issues.append(f"fewer than {min_entities} entities")
    if headers:
        for e in ontology.entities:
            issues += [f"entity {e.name!r}: key {k!r} is not among the headers" for k in e.keys if h.find(k) is None]
        for r in ontology.relationships:
            issues += [f"relationship {r.predicate!r}: {side} {c!r} is not among the headers" for side, c in (("source_col", r.source_col), ("target_col", r.target_col)) if c and h.find(c) is None]
    return issues


def compile_mapping(spec: dict, headers: list[str], strategy: str = "all", prefixed: bool = True) -> tuple[MappingSpec, list[str]]:
    """An ontology to a complete mapping: compile, bind, populate. strategy: "all" or "star"."""
    issues = validate(spec, headers)
    mapping, warnings = compile_star(spec, headers) if strategy == "star" else compile_all(spec, headers, prefixed)
    mapping, missing = bind_attributes(mapping, headers)
    mapping, filled = populate_keys(mapping, headers, prefixed)
    return mapping, issues + warnings + [f"attribute {m} has no column" for m in missing] + filled
