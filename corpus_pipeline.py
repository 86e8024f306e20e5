"""The corpus pipeline: STAGES applied to ``documents``, each on all that the one
before it kept.

1. language ID: documents without a letter, or whose language has a calibrated
   probability under MIN_SCORE, go. It learns from the labelled rows that are not
   held out (see langid).
2. line dedup: lines of 40 or more characters that 5 or more documents hold stay
   only in the last of these.
3. near-dedup: texts whose five-word shingles have a Jaccard similarity of 0.8 or
   more are linked; of each component the document with the smallest id stays.
4. benchmark decontamination: documents that hold a copy of a test item go.
5. best-fit packing: what is left is packed into sequences of 2048 tokens.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.llm import decontaminate, jaccard, langid, line_dedup, packing
from weftline.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Four languages leave one in four to chance; less than this is no decision.
MIN_SCORE = 0.35


def identify_language(spark, docs, sf_dir):
    """The rows, as they are, whose text has a letter and a language of MIN_SCORE or
    more. Null, empty and letterless texts go. A table without a labelled row that
    may be learned from has no languages, so no row stays. Null and repeated ids,
    repeated rows and nulls in other columns make no difference; very long texts
    are judged whole; columns beyond those of documents are dropped. Empty: empty."""
    return langid.identified(docs.select(*COLUMNS), langid.fit(docs, ~langid.held_out()), MIN_SCORE)


def drop_common_lines(spark, docs, sf_dir):
    """All rows, with the lines that stay and n_chars counted anew. A null text
    becomes an empty one. Rows without an id lose nothing and do not count; rows
    that repeat an id count as one document. Null lang and source stay null; columns
    beyond those of documents are dropped. Empty: empty."""
    return line_dedup.line_dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark, docs, sf_dir):
    """The row with the smallest id of each group of near copies, as it is. Candidates
    come by op10's fingerprints and by MinHash; shingle sets decide. Null and
    empty texts are equal to each other, so one of them stays. Rows without an id
    stay; of rows that repeat an id all stay or none. Null lang, source and n_chars
    stay null; columns beyond those of documents are dropped. Empty: empty."""
    return jaccard.one_of_each(docs).select(*COLUMNS)


def decontaminate_benchmark(spark, docs, sf_dir):
    """The rows, as they are, that hold no copy of a test item. Null and empty texts
    stay; null and repeated ids and repeated rows make no difference; very long texts
    are searched whole; columns beyond those of documents are dropped. An empty
    benchmark: all rows. Empty: empty."""
    return decontaminate.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark, docs, sf_dir):
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row for each
    piece of at most 2048 ids. A null or empty text is one piece, the end id. Rows
    without an id and rows that repeat one are packed each. Other columns are not
    read. Empty: empty."""
    import public_tokenizers

    return packing.sequences(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_common_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", decontaminate_benchmark),
    ("packing", pack),
]


def run(spark, sf_dir):
    """The result of the last stage for ``documents``. Each stage's result is written
    to the shared folder and read back, so the next one works on all of it and a
    lost executor costs a stage's tasks at most. An empty table gives an empty one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs


#: Language ID, near-dedup and tokenisation have no SQL form; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None
