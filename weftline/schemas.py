"""Schemas of the frames that the operators exchange."""

from pyspark.sql import types as T

S, L, D, I, TS = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType(), T.TimestampType()


def schema(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


PROPERTIES = T.MapType(S, S)
NODES = schema(node_id=S, type=S, label=S, properties=PROPERTIES)
EDGES = schema(src=S, predicate=S, dst=S)
STORED_NODES = schema(entity_key=S, kb_id=L, document_id=S, node_id=S, type=S, label=S, properties=PROPERTIES)
STORED_EDGES = schema(edge_key=S, kb_id=L, document_id=S, src=S, predicate=S, dst=S, properties=PROPERTIES, confidence=D)
DOCUMENTS = schema(document_id=S, kb_id=L, title=S, file_name=S, file_path=S, file_type=S, file_size=L, status=S, created_at=TS)
KNOWLEDGE_BASES = schema(kb_id=L, owner_id=S, slug=S, name=S, description=S, created_at=TS)
ONTOLOGIES = schema(ontology_id=S, kb_id=L, document_id=S, specification=S, status=S, version=I, is_canonical=T.BooleanType(), created_at=TS)
CHUNKS = schema(chunk_id=S, document_id=S, idx=I, content=S, start=I, end=I, word_count=I, page_number=I, strategy=S, prev_id=S, next_id=S)
MENTIONS = schema(entity_id=S, name=S, type=S, category=S, document_id=S, chunk_id=I, created_at=TS)
RELATIONS = schema(relationship_id=S, source_entity_id=S, target_entity_id=S, relation=S, context=S, document_id=S, chunk_id=I, created_at=TS)
RESOLVED = schema(resolved_id=S, name=S, type=S, category=S, normalized_key=S, mention_count=L, doc_count=L)
RESOLUTION_MAP = schema(entity_id=S, resolved_id=S, strategy=S, confidence=D)
COLUMN_STATS = schema(name=S, non_null=L, nulls=L, distinct=L, inferred_type=S, examples=T.ArrayType(S))

#: Allowed values: fixed.
FILE_TYPES = ("PDF", "MD", "TXT", "CSV")
ATTRIBUTE_TYPES = {
    "string": S, "integer": L, "float": D, "boolean": T.BooleanType(),
    "date": T.DateType(), "datetime": TS, "enum": S,
}
