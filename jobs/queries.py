"""The jobs as queries: each runs twice into one new folder and returns its output as it then stands; and the SQL that checks them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from jobs import monthly_scores, policy_scan
from jobs.common import default_config
from symgrain.operators.checkpoints import shared
from symgrain.oracles import BACKWARDS, DEGREE, MOVED, ONE, ROUNDING, TEXT_LINES, closure, scored


def _folder(spark, name):
    return f"{shared(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def job1_policy_scan(spark, sf_dir):
    folder = _folder(spark, "policy-scan")
    for _ in range(2):
        policy_scan.run(spark, default_config("policy_scan"), f"{sf_dir}/documents.parquet", f"{sf_dir}/pages.parquet", f"{folder}/out", f"{folder}/checkpoint")
    return policy_scan.read_findings(spark, f"{folder}/out")


def job2_monthly_scores(spark, sf_dir):
    folder = _folder(spark, "monthly-scores")
    for _ in range(2):
        monthly_scores.run(spark, default_config("monthly_scores"), f"{sf_dir}/lineitem.parquet", folder)
    return monthly_scores.read_scores(spark, folder).select("month", "candidate", "n", "nnz_l", "flops", F.round("flop_ratio", ROUNDING).alias("flop_ratio"), F.round("fill_ratio", ROUNDING).alias("fill_ratio"), "bucket", "cheapest", "links")


POLICY = f"""
WITH texts AS (SELECT 'documents' AS origin, doc_id AS id, text FROM documents UNION ALL SELECT 'pages', page_id, html FROM pages),
lines AS ({TEXT_LINES.format("origin, id")} texts WHERE length(text) > 0),
rule(kind, sought, what) AS (VALUES ('word', 'script', 'active content'), ('word', 'track', 'tracking call'), ('word', 'token', 'access token'), ('word', 'password', 'password'),
  ('license', 'GNU General Public License, version 3', 'GPL-3.0'), ('license', 'CC BY-NC 4.0', 'CC-BY-NC-4.0'), ('license', 'All rights reserved', 'none'))
SELECT id, CAST(line AS BIGINT) AS line, what, origin, kind FROM lines JOIN rule ON CASE kind WHEN 'word' THEN regexp_matches(content, '(^|[^A-Za-z0-9_])' || sought || '([^A-Za-z0-9_]|$)') ELSE contains(content, sought) END"""

MONTHLY = f"""
WITH RECURSIVE {ONE}, {DEGREE}, {MOVED}, {BACKWARDS}, {closure("cn", "e")}, {scored("sn", "cn")}, {closure("cd", "d")}, {scored("sd", "cd")}, {closure("ct", "t")}, {scored("st", "ct")},
every AS (SELECT 'natural' AS candidate, 1 AS place, * FROM sn UNION ALL SELECT 'degree', 2, * FROM sd UNION ALL SELECT 'reverse', 3, * FROM st),
linked AS (SELECT mid, count(*) AS links FROM h GROUP BY mid)
SELECT replace(x.mid, 'month-', '') AS month, candidate, x.n, x.nnz_l, x.flops, round(CAST(x.flops AS DOUBLE) / sn.flops, {ROUNDING}) AS flop_ratio, round(CAST(x.nnz_l AS DOUBLE) / sn.nnz_l, {ROUNDING}) AS fill_ratio,
  CASE WHEN x.n < 1000 THEN 'lt_1k' WHEN x.n < 10000 THEN '1k_10k' ELSE 'gt_10k' END AS bucket, row_number() OVER (PARTITION BY x.mid ORDER BY x.flops, place) = 1 AS cheapest, links
FROM every x JOIN sn USING (mid) JOIN linked USING (mid)"""


def queries():
    return {f.__name__: f for f in (job1_policy_scan, job2_monthly_scores)}


def oracle_sql():
    return {"job1_policy_scan": POLICY, "job2_monthly_scores": MONTHLY}
