"""Corpus pipeline: the stages of STAGES applied one after the other to the documents table.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; what it returns is written as
Parquet and read again as the next stage's input. All but the last return rows with the columns of documents, other
columns and clashing names included; texts are worked on whole, however long; an empty table gives an empty result.
"""

from __future__ import annotations

from presswork.llm import decontaminate, mix, neardup, quality, tokens
from presswork.llm.common import table, written


def quality_rules(spark, docs, sf_dir):
    """Documents that the quality rules keep.

    Null, empty and blank texts go. Rows with equal texts, repeated rows among them, go or stay together; ids and other
    columns may be null and play no part. Ties: a posterior of exactly one half stays."""
    return quality.keep_good(docs)


def near_dedup(spark, docs, sf_dir):
    """One document, the one with the smallest id, of each group of near copies.

    Texts without words (null, empty, blank) are in no group and all stay. A null id is larger than any other; of rows
    that tie in id the text with the smallest hash stays, and of repeated rows (id and text) one."""
    return neardup.keep_first(docs)


def decontaminated(spark, docs, sf_dir):
    """Documents that are not contaminated by the benchmark.

    Null and empty texts stay, null and empty benchmark texts are no items. Repeated rows go or stay together; ids may be
    null or repeated and play no part. Ties: a document of which exactly a twentieth is hit goes."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark, docs, sf_dir):
    """Documents as often as the mix takes them; sources weigh 5, 2, 1 in turn.

    A null source is a source of its own, the last; a null text has size 0. Rows that tie in id, source and size, repeated
    rows among them, are taken equally often; null ids are keys like others."""
    return mix.mix(docs)


def token_files(spark, docs, sf_dir):
    """Token files of what is left, read back: doc_id, start, n_tokens and ids_crc32 of every row.

    Null and empty texts are the end id alone. Null ids come first; rows that tie in id are in the order of their text's
    hash; repeated rows are written as often as they occur."""
    return tokens.digest(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("token output", token_files),
]

#: SQL cannot express near-duplicate components by full sets at this size, the mix or a tokenizer.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
