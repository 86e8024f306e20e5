"""Knowledge bases, ontologies, documents, profiles and mappings as frames. Changes
are new frames; sources.tables.VersionedTable stores them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.names import kb_slug
from weftline.schemas import FILE_TYPES

from .store import insert_missing, latest, upsert

#: Categories by kind of entity: fixed values.
CATEGORIES = {
    "Named Entity": ("people", "organizations", "locations", "products", "events", "other"),
    "Concept/Idea": ("concepts", "ideas", "theories", "abstract notions", "philosophical concepts", "scientific concepts"),
}
CSV_MIME = ("text/csv", "application/vnd.ms-excel")


def category_is_valid(kind: Column, category: Column) -> Column:
    out = F.lit(False)
    for k, categories in CATEGORIES.items():
        out = F.when(kind == k, category.isin(*categories)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def is_csv(file_name: Column, mime: Column) -> Column:
    return F.endswith(F.lower(F.coalesce(file_name, F.lit(""))), F.lit(".csv")) | F.lower(F.coalesce(mime, F.lit(""))).isin(*CSV_MIME)


def valid_documents(docs: DataFrame) -> DataFrame:
    """Rows that a store may hold: a known file type and an id."""
    return docs.where(F.col("document_id").isNotNull() & F.col("file_type").isin(*FILE_TYPES))


# -- knowledge bases ---------------------------------------------------------------


def create_knowledge_bases(old: DataFrame, new: DataFrame) -> DataFrame:
    """Add knowledge bases; one that its owner has under that slug stays as it is.
    new: owner_id, name and perhaps slug."""
    slug = F.coalesce(F.col("slug"), kb_slug(F.col("name"))) if "slug" in new.columns else kb_slug(F.col("name"))
    new = new.withColumn("slug", slug).dropDuplicates(["owner_id", "slug"])
    known = old.select(F.col("owner_id").alias("_o"), F.col("slug").alias("_s"))
    fresh = new.join(known, F.col("owner_id").eqNullSafe(F.col("_o")) & (F.col("slug") == F.col("_s")), "left_anti")
    return old.unionByName(fresh, allowMissingColumns=True)


def knowledge_base(kbs: DataFrame, slug: str, owner: str | None = None) -> DataFrame:
    """By slug and owner; no owner means those without one."""
    return kbs.where((F.col("slug") == slug) & F.col("owner_id").eqNullSafe(F.lit(owner)))


def newest_first(df: DataFrame, tie: str, limit: int | None = None) -> DataFrame:
    out = df.orderBy(F.desc_nulls_last("created_at"), tie)
    return out if limit is None else out.limit(limit)


# -- ontologies --------------------------------------------------------------------


def add_ontologies(old: DataFrame, new: DataFrame) -> DataFrame:
    """Append; the version goes on from the last of the same knowledge base and document."""
    keys = ["kb_id", "document_id"]
    last = old.groupBy(*[F.col(k).alias("_" + k) for k in keys]).agg(F.max("version").alias("_v"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col("_" + k))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("ontology_id"))
    numbered = new.join(last, same, "left").withColumn("version", (F.coalesce("_v", F.lit(0)) + n).cast("int")).drop("_v", *["_" + k for k in keys])
    return old.unionByName(numbered, allowMissingColumns=True)


def current_ontologies(ontologies: DataFrame) -> DataFrame:
    """The highest version for each knowledge base and document."""
    return latest(ontologies, ["kb_id", "document_id"], "version")


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(~F.coalesce(condition, F.lit(False)))


def save_mappings(old: DataFrame, new: DataFrame) -> DataFrame:
    """One mapping for each ontology."""
    return upsert(old, new, ["ontology_id"])


def save_profiles(old: DataFrame, new: DataFrame) -> DataFrame:
    """One profile for each document."""
    return upsert(old, new, ["document_id"])


# -- documents ---------------------------------------------------------------------


def save_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, valid_documents(new), ["document_id"])


def new_documents(old: DataFrame, found: DataFrame) -> DataFrame:
    """Found files that are not known by path."""
    return insert_missing(old.select("file_path").limit(0), found.join(old.select("file_path"), "file_path", "left_anti"), ["file_path"])


def with_chunks(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with an array of (idx, content) in order; empty without chunks."""
    c = chunks.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("idx", "content"))).alias("chunks"))
    none = F.array().cast(c.schema["chunks"].dataType)
    return docs.join(c, "document_id", "left").withColumn("chunks", F.coalesce("chunks", none))


# -- cards (queries of the example application) ---------------------------------------


def due_cards(cards: DataFrame, user: str, now: Column, limit: int | None = None) -> DataFrame:
    out = cards.where((F.col("user_id") == user) & (F.col("due_at") <= now)).orderBy("due_at", "card_id")
    return out if limit is None else out.limit(limit)


def cards_of(entities: DataFrame, user: str, first: int = 10, order: str = "node_id") -> DataFrame:
    """Cards for a user's first entities: card_id, user_id, front."""
    return entities.orderBy(order).limit(first).select(F.concat(F.lit("card:"), "node_id").alias("card_id"), F.lit(user).alias("user_id"), F.col("label").alias("front"))


def cards_by_domain(cards: DataFrame, user: str, domains: list[str]) -> DataFrame:
    """A user's cards with one of the domains (array column domains)."""
    wanted = F.array(*map(F.lit, domains)).cast("array<string>")
    return cards.where((F.col("user_id") == user) & F.arrays_overlap("domains", wanted))


def save_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks by id: those of a document that comes again take the place of all it had."""
    return old.join(new.select("document_id").distinct(), "document_id", "left_anti").unionByName(new.dropDuplicates(["chunk_id"]), allowMissingColumns=True)


def recent_reviews(reviews: DataFrame, user: str, now: Column, days: int = 7) -> DataFrame:
    return reviews.where((F.col("user_id") == user) & (F.to_date("reviewed_at") >= F.date_sub(F.to_date(now), days)))
