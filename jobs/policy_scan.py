"""Scans documents and pages for what a policy forbids, as their files arrive.

Each run takes the files that came since the last one (a checkpoint tells) and appends, for every
line that breaks a rule, (id, line, what) under ``findings/origin=.../kind=...``: a listed word,
standing by itself, or a license that is not allowed, named by a listed phrase or by an
SPDX-License-Identifier expression. Then ``report/origin=...`` is written anew from all findings:
how many texts and lines break each rule. A run that was broken off goes on from its checkpoint;
a run without new files changes nothing. Findings follow the rules of their day: to apply others
to texts already scanned, give a new checkpoint and output.

Null texts have no lines; ids may be null or repeat; other columns are left out.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import LOG, command_line, read_back
from symgrain.operators import policy

FINDINGS = "id long, line long, what string, origin string, kind string"
#: Tables: origin, column of the id, column of the text.
TABLES = (("documents", "doc_id", "text"), ("pages", "page_id", "html"))


def broken_rules(texts: DataFrame, config: dict) -> DataFrame:
    """(id, line, what, origin, kind) of all that breaks a rule; texts: (origin, id, text). One pass without a shuffle, so it serves batches and streams."""
    lines = policy.numbered_lines(texts.select("origin", "id", "text"), "text")
    found = policy.word_findings(F.col("content"), config["words"])
    named = policy.license_findings(F.col("content"), config["licenses"], config["allowed"])
    rules = F.concat(F.transform(found, lambda what: F.struct(F.lit("word").alias("kind"), what.alias("what"))), F.transform(named, lambda what: F.struct(F.lit("license").alias("kind"), what.alias("what"))))
    each = lines.select("origin", "id", F.col("line").cast("long").alias("line"), F.explode(rules).alias("rule"))
    return each.select("id", "line", "rule.what", "origin", "rule.kind")


def as_pattern(path: str) -> str:
    """The path as a pattern that it alone matches: file streams take a single file only so, and a folder as well."""
    folder, slash, name = path.rstrip("/").rpartition("/")
    return f"{folder}{slash}[{name[0]}]{name[1:]}"


def run(spark: SparkSession, config: dict, documents: str, pages: str, out: str, checkpoint: str) -> dict:
    """Scans what is new in both tables; returns how many rows it read (without files' row groups that hold no text), and how many findings there are by now."""
    streams = []
    for (origin, key, text), path in zip(TABLES, (documents, pages), strict=True):
        rows = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(as_pattern(path))
        streams.append(rows.select(F.lit(origin).alias("origin"), F.col(key).cast("long").alias("id"), F.col(text).alias("text")))
    findings = broken_rules(streams[0].unionByName(streams[1]), config)
    query = findings.writeStream.format("parquet").partitionBy("origin", "kind").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(f"{out}/findings")
    query.awaitTermination()
    read = sum(p["numInputRows"] for p in query.recentProgress)
    every = read_findings(spark, out)
    texts = every.groupBy("origin", "kind", "what", "id").agg(F.count(F.lit(1)).alias("lines"))
    report = texts.groupBy("origin", "kind", "what").agg(F.count(F.lit(1)).alias("texts"), F.sum("lines").alias("lines"))
    report.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("origin").parquet(f"{out}/report")
    result = {"read": read, "findings": every.count()}
    LOG.info("policy_scan: read %(read)d new rows; %(findings)d findings in all", result)
    LOG.info("policy_scan: wrote %s/findings and %s/report", out, out)
    return result


def read_findings(spark: SparkSession, out: str) -> DataFrame:
    return read_back(spark, f"{out}/findings", FINDINGS)


if __name__ == "__main__":
    paths = {"documents": "Parquet folder or file of documents", "pages": "the same of pages", "out": "folder for findings and report", "checkpoint": "folder that remembers what was scanned"}
    sys.exit(command_line("policy_scan", __doc__, paths, run))
