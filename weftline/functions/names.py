"""Entity names: normal forms, keys and stable ids."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .normalizers import slug, text, trim

#: Types by kind, honorifics, company suffixes and abbreviations: fixed values.
PERSON_TYPES = ("person", "people", "author")
ORG_TYPES = ("org", "organization", "company", "institution")
LOCATION_TYPES = ("location", "place", "city")
HONORIFICS = ("dr", "prof", "mr", "mrs", "ms")
COMPANY_SUFFIXES = ("inc", "ltd", "corp", "llc", "co")
ABBREVIATIONS = {"st": "street", "ave": "avenue"}
PROTECTED_PREFIXES = ("txn", "transaction", "date")


@F.pandas_udf(StringType())
def _fold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def ascii_fold(c: Column) -> Column:
    """Compatibility forms without marks; what is then not ASCII goes. Only texts
    with such characters leave the JVM's own path in meaning, all pass the UDF."""
    return _fold(text(c))


def squeeze(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, r"\s+", " "))


def basic(c: Column, fold: bool = True) -> Column:
    """Folded, lower case, signs to blanks, single blanks. fold=False: for ASCII
    input, without leaving the JVM."""
    t = ascii_fold(c) if fold else text(c)
    return squeeze(F.regexp_replace(F.lower(t), r"[^a-z0-9\s]", " "))


def _words(c: Column, words) -> Column:
    return F.regexp_replace(c, rf"\b({'|'.join(words)})\b\s*", "")


def person(c: Column, fold: bool = True, reorder: bool = False) -> Column:
    """Without honorifics. reorder: "last, first" is turned round and lone initials go first."""
    if reorder:
        t = ascii_fold(c) if fold else text(c)
        parts = F.split(t, ",")
        t = F.when(F.size(parts) == 2, F.concat_ws(" ", F.btrim(parts[1]), F.btrim(parts[0]))).otherwise(t)
        t = F.regexp_replace(t, r"\b[A-Za-z]\.(\s|$)", "$1")
        return squeeze(_words(basic(t, False), HONORIFICS))
    return squeeze(_words(basic(c, fold), HONORIFICS))


def organisation(c: Column, fold: bool = True, ampersand: bool = False) -> Column:
    if ampersand:
        c = F.replace(text(c), F.lit("&"), F.lit(" and "))
    return squeeze(F.regexp_replace(basic(c, fold), rf"\b({'|'.join(COMPANY_SUFFIXES)})\b", ""))


def location(c: Column, fold: bool = True) -> Column:
    t = basic(c, fold)
    for short, full in ABBREVIATIONS.items():
        t = F.regexp_replace(t, rf"\b{short}\b", full)
    return squeeze(t)


def normalize_name(name: Column, kind: Column, fold: bool = True, version: int = 1) -> Column:
    """By the entity's type. Version 2 also reorders "Last, First" and reads & as "and"."""
    k = F.lower(F.btrim(text(kind)))
    v2 = version >= 2
    return (
        F.when(k.isin(*PERSON_TYPES), person(name, fold, v2))
        .when(k.isin(*ORG_TYPES), organisation(name, fold, v2))
        .when(k.isin(*LOCATION_TYPES), location(name, fold))
        .otherwise(basic(name, fold))
    )


def normalized_key(name: Column, kind: Column, fold: bool = True, version: int = 1) -> Column:
    return F.concat_ws("|", F.lower(text(kind)), normalize_name(name, kind, fold, version))


def value_part(key: Column) -> Column:
    """The name of a normalized key."""
    return F.substr(key, F.instr(key, "|") + 1)


def short_sha1(c: Column) -> Column:
    return F.substring(F.sha1(c.cast("binary")), 1, 16)


def resolved_id(key: Column) -> Column:
    return F.concat(F.lit("res::"), short_sha1(key))


def relation_id(source: Column, predicate: Column, target: Column) -> Column:
    return short_sha1(F.concat_ws("|", source, predicate, target))


def entity_key(kb: Column, document: Column, entity: Column) -> Column:
    """A row id that is the same in every run."""
    return F.sha2(F.concat_ws("\x1f", text(kb), text(document), text(entity)), 256)


def prefix_of(node_id: Column) -> Column:
    """What stands before the first colon; "node" if there is none or nothing before it."""
    at = F.instr(node_id, ":")
    return F.when(at > 1, F.substring_index(node_id, ":", 1)).otherwise(F.lit("node"))


def value_of(node_id: Column) -> Column:
    at = F.instr(node_id, ":")
    return F.when(at > 0, F.substr(node_id, at + 1)).otherwise(node_id)


def canonical_value(value: Column) -> Column:
    return slug(F.regexp_replace(trim(value), r"\s+", " "))


def merge_label(node_id: Column) -> Column:
    """The value with nothing but a-z and 0-9 left."""
    return F.regexp_replace(F.lower(value_of(node_id)), "[^a-z0-9]+", "")


def kb_slug(name: Column) -> Column:
    s = slug(name)
    return F.when(s == "", "kb").otherwise(s)


def relation_type(c: Column) -> Column:
    """Upper case with underscores; RELATED_TO if nothing is left."""
    t = F.btrim(F.regexp_replace(F.upper(text(c)), "[^A-Z0-9]+", "_"), F.lit("_"))
    return F.when(t == "", "RELATED_TO").otherwise(t)
