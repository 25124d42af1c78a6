"""The corpus pipeline: quality, near-duplicates, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its output is written as
Parquet and read again as the next one's docs.

Defined results: null texts count as empty; the classifier and decontamination keep a document
without words, and all such documents are near-duplicates of each other; texts are read whole;
a row without an id goes through all stages, as decisions go by id; rows that share an id share
decisions, and one of them stays where near-duplicates are dropped; of equal documents that with the
smallest id stays; an empty table gives empty results; further columns stay until the last stage.
"""

from __future__ import annotations

from symgrain.llm import bpe, decontam, quality, selection, simhash
from symgrain.llm.common import materialize, table
from symgrain.shipping import shipped


def keep_quality(spark, docs, sf_dir):
    """Documents that the perplexity classifier does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark, docs, sf_dir):
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more)."""
    return selection.keep_representatives(docs, simhash.near_duplicates(docs))


def drop_contaminated(spark, docs, sf_dir):
    """Documents without a passage of the benchmark."""
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"))
    return selection.without(docs, materialize(found.where("contaminated AND doc_id IS NOT NULL").select("doc_id").distinct(), "contaminated"))


def encode(spark, docs, sf_dir):
    """(doc_id, ids, n_tokens) of each document."""
    return bpe.encode_documents(docs)


STAGES = [("quality classifier", shipped(keep_quality)), ("SimHash near-dedup", shipped(drop_near_duplicates)), ("benchmark decontamination", shipped(drop_contaminated)), ("byte-level BPE", shipped(encode))]

#: SQL can express neither the classifier nor the fingerprints.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{k}")
    return docs


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
