import datetime
import json
import os
import random
import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import monthly_scores, policy_scan
from jobs.common import config_of, default_config
from symgrain.operators import policy
from tests.conftest import ROOT

CONFIG = {"words": {"bad": "bad word", "very": "emphasis"}, "licenses": {"All rights reserved": "none", "MIT License": "MIT"}, "allowed": ["MIT", "Apache-2.0", "A WITH B"], "files_per_batch": 1}


def plain_findings(origin, rows):
    out = []
    for key, text in rows:
        for k, line in enumerate((text or "").replace("\r\n", "\n").removesuffix("\n").split("\n") if text else []):
            out += [(key, k + 1, what, origin, "word") for word, what in CONFIG["words"].items() if re.search(rf"(?<![A-Za-z0-9_]){word}(?![A-Za-z0-9_])", line)]
            out += [(key, k + 1, "none", origin, "license")] * ("All rights reserved" in line)
            if found := re.search(r"SPDX-License-Identifier:\s*([^*]*)", line):
                expression = found[1].strip()
                out += [(key, k + 1, expression, origin, "license")] * (expression != "" and not plainly_allowed(expression, CONFIG["allowed"]))
    return out


def plainly_allowed(text, allowed):
    """By recursive descent."""
    tokens, at = re.findall(r"[()/]|[^\s()/]+(?:\s+WITH\s+[^\s()/]+)?", text), 0

    def take(*wanted):
        nonlocal at
        if at < len(tokens) and tokens[at] in wanted:
            at += 1
            return True
        return False

    def either():
        found = both()
        while take("OR", "/"):
            found = both() or found
        return found

    def both():
        found = one()
        while take("AND"):
            found = one() and found
        return found

    def one():
        nonlocal at
        if take("("):
            found = either()
            if not take(")"):
                raise ValueError
            return found
        if at >= len(tokens) or tokens[at] in (")", "AND", "OR", "/"):
            raise ValueError
        at += 1
        return re.sub(r"\s+", " ", tokens[at - 1]) in allowed

    try:
        return either() and at == len(tokens)
    except ValueError:
        return False


def test_license_expressions_equal_recursive_descent(spark):
    rng = random.Random(8)
    texts = ["(MIT OR Apache-2.0) AND GPL-3.0", "GPL-3.0 AND (MIT OR BSD)", "Apache-2.0 OR(GPL-3.0)", "MIT/Apache-2.0", "", None, "()", "MIT Apache-2.0", "(MIT", "MIT)", "((MIT))", "GPL-3.0 OR MIT AND GPL-3.0", "A  WITH B AND MIT", "A", "(" * 60 + "MIT" + ")" * 60]
    texts += [" ".join(rng.choices(["(", ")", "AND", "OR", "/", "MIT", "GPL-3.0", "A WITH B"], k=rng.randint(1, 9))) for _ in range(3000)]

    def grown(depth):
        if depth == 0 or rng.random() < 0.2:
            return rng.choice(["MIT", "GPL-3.0", "Apache-2.0", "X"])
        inner = f" {rng.choice(['AND', 'OR'])} ".join(grown(depth - 1) for _ in range(rng.randint(1, 3)))
        return f"({inner})" if rng.random() < 0.6 else inner

    texts += [grown(4) for _ in range(500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, license string")
    found = {r["i"]: r["ok"] for r in rows.select("i", policy.license_allowed(F.col("license"), CONFIG["allowed"]).alias("ok")).collect()}
    wrong = [(t, found[i]) for i, t in enumerate(texts) if found[i] != (t is not None and plainly_allowed(t, CONFIG["allowed"]))]
    assert not wrong
    assert not found[0] and not found[1] and found[2] and found[len(texts) - 1] is not None


def write(spark, rows, path, schema, mode="append"):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode(mode).parquet(path)


def findings(spark, out):
    return sorted(map(tuple, policy_scan.read_findings(spark, out).collect()), key=str)


def test_policy_scan_takes_only_what_is_new(spark, tmp_path):
    docs, pages, out, mark = (str(tmp_path / x) for x in ("docs", "pages", "out", "mark"))
    first = [(1, "fine\na bad line\r\nvery bad", "x"), (2, None, "x"), (3, "", "x"), (4, "badly very_bad\nAll rights reserved.\n", "x"), (None, "bad", "x"), (1, "bad again", "x")]
    more = [(7, "// SPDX-License-Identifier: (MIT OR GPL-3.0) AND X */\n/* SPDX-License-Identifier: MIT OR GPL-3.0 */\nMIT License", "x"), (8, "word " * 50_000 + "bad", "x")]
    html = [(1, "<p>bad</p>", "u")]
    write(spark, first, docs, "doc_id long, text string, line string")
    write(spark, html, pages, "page_id long, html string, kind string")
    assert policy_scan.run(spark, CONFIG, docs, pages, out, mark)["read"] == 7
    want = plain_findings("documents", [r[:2] for r in first]) + plain_findings("pages", [r[:2] for r in html])
    assert findings(spark, out) == sorted(want, key=str)
    write(spark, more, docs, "doc_id long, text string, line string")
    assert policy_scan.run(spark, CONFIG, docs, pages, out, mark)["read"] == 2
    want += plain_findings("documents", [r[:2] for r in more])
    assert findings(spark, out) == sorted(want, key=str)
    again = policy_scan.run(spark, CONFIG, docs, pages, out, mark)
    assert again == {"read": 0, "findings": len(want)} and findings(spark, out) == sorted(want, key=str)
    report = {(r["origin"], r["kind"], r["what"]): (r["texts"], r["lines"]) for r in spark.read.parquet(f"{out}/report").collect()}
    for (origin, kind, what), (texts, lines) in report.items():
        mine = [w for w in want if w[2:] == (what, origin, kind)]
        assert (len({w[0] for w in mine}), len(mine)) == (texts, lines)
    assert len(report) == len({w[2:] for w in want})


def test_policy_scan_of_nothing(spark, tmp_path):
    docs, pages, out, mark = (str(tmp_path / x) for x in ("docs", "pages", "out", "mark"))
    write(spark, [], docs, "doc_id long, text string")
    write(spark, [(1, None)], pages, "page_id long, html string")
    for _ in range(2):
        assert policy_scan.run(spark, CONFIG, docs, pages, out, mark)["findings"] == 0
    assert findings(spark, out) == []


def test_policy_scan_command_line(spark, tmp_path):
    write(spark, [(1, "a token")], str(tmp_path / "docs"), "doc_id long, text string")
    write(spark, [(1, "<script>")], str(tmp_path / "pages"), "page_id long, html string")
    (tmp_path / "own.json").write_text(json.dumps(default_config("policy_scan") | {"words": {"token": "access token"}}))
    line = [sys.executable, "-m", "jobs.policy_scan", "--config", str(tmp_path / "own.json"), *(x for p in ("documents", "pages", "out", "checkpoint") for x in (f"--{p}", str(tmp_path / {"documents": "docs"}.get(p, p))))]
    run = subprocess.run(line, cwd=ROOT, env=os.environ | {"SPARK_LOCAL_IP": "127.0.0.1"}, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr[-2000:]
    assert "read 2 new rows; 1 findings" in run.stderr
    assert findings(spark, str(tmp_path / "out")) == [(1, 1, "access token", "documents", "word")]
    assert config_of(spark, str(tmp_path / "own.json"))["words"] == {"token": "access token"}


def day(month, d=1):
    return datetime.datetime(1998, month, d)


def items(rng, month, n):
    return [(rng.randint(1, 9), rng.randint(1, 20), day(month, rng.randint(1, 28)), 1.0) for _ in range(n)]


LINES = "l_suppkey long, l_partkey long, l_shipdate timestamp, mid double"


def scores(spark, out):
    return sorted(map(str, monthly_scores.read_scores(spark, out).collect()))


def test_monthly_scores_replaces_changed_months(spark, tmp_path):
    rng, config = random.Random(2), default_config("monthly_scores")
    path, out, fresh = (str(tmp_path / x) for x in ("lines", "out", "fresh"))
    write(spark, items(rng, 1, 60) + items(rng, 2, 60) + [(None, 1, day(1), 1.0), (1, None, day(2), 1.0), (1, 1, None, 1.0)], path, LINES)
    first = monthly_scores.run(spark, config, path, out)
    assert (first["scored"], first["months"]) == (2, 2)
    before = scores(spark, out)
    assert monthly_scores.run(spark, config, path, out) == first | {"scored": 0} and scores(spark, out) == before
    write(spark, items(rng, 2, 40) + items(rng, 3, 30), path, LINES)
    second = monthly_scores.run(spark, config, path, out)
    assert (second["scored"], second["months"]) == (2, 3)
    january = [r for r in before if "1998-01" in r]
    assert len(january) == 3 and set(january) <= set(scores(spark, out)) and len(scores(spark, out)) == 9
    monthly_scores.run(spark, config, path, fresh)
    assert scores(spark, out) == scores(spark, fresh)
    assert sorted(map(str, spark.read.parquet(f"{out}/report").collect())) == sorted(map(str, spark.read.parquet(f"{fresh}/report").collect()))
    # Rows that are there already change nothing.
    write(spark, spark.read.parquet(path).limit(5).collect(), path, LINES)
    assert monthly_scores.run(spark, config, path, out)["scored"] == 0
    cheapest = monthly_scores.read_scores(spark, out).groupBy("month").agg(F.count_if("cheapest").alias("n"), F.min("flops").alias("low"), F.min(F.when(F.col("cheapest"), F.col("flops"))).alias("mine")).collect()
    assert all(r["n"] == 1 and r["low"] == r["mine"] for r in cheapest)


def test_monthly_scores_of_nothing_and_bad_config(spark, tmp_path):
    path, out = str(tmp_path / "lines"), str(tmp_path / "out")
    write(spark, [], path, LINES)
    assert monthly_scores.run(spark, default_config("monthly_scores"), path, out) == {"links": 0, "scored": 0, "months": 0}
    assert spark.read.parquet(f"{out}/report").where("matrices > 0").count() == 0
    with pytest.raises(ValueError, match="baseline"):
        monthly_scores.run(spark, {"candidates": ["degree"], "baseline": "natural"}, path, out)
