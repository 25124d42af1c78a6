"""Takes decided documents out of a table.

Defined results: rows without an id stay, as nothing can name them; texts, null, empty or very
long, are passed through unread; empty tables on either side drop nothing or give no rows; all
columns of the documents stay, under their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgrain.llm.common import BROADCAST_IDS, materialize


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is not in ids (distinct, no nulls); rows without an id stay."""
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids.hint("merge"), "doc_id", "left_anti").select(docs.columns)


def keep_representatives(docs: DataFrame, components: DataFrame) -> DataFrame:
    """One document of each component: that with the least doc_id, once. components: doc_id, component_id of each row of docs. Rows without an id stay."""
    known = materialize(components.where("doc_id IS NOT NULL").select("doc_id", "component_id"), "components")
    kept = without(docs, materialize(known.where("doc_id <> component_id").select("doc_id").distinct(), "dropped"))
    again = materialize(known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "repeated")
    if again.isEmpty():
        return kept
    return without(kept, again).unionByName(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns))
