"""Command line: ``emit-deps FILE``, ``scan-tree FOLDER``, ``run CORPUS LOG [NOTE]``.

Exit codes: 0 fine, 1 rejected, 2 usage.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from symgrain.operators import policy
from symgrain.plans.scored_run import scored_run
from symgrain.shipping import ship


def emit_deps(spark: SparkSession, path: str) -> int:
    """Prints name=version of each entry; a file that is missing has none."""
    text = open(path).read() if os.path.exists(path) else ""
    rows = policy.dependencies(spark.createDataFrame([(path, text)], "path string, text string")).orderBy("line").collect()
    for row in rows:
        if row["fault"]:
            print(f"{path}:{row['line']}: {row['fault']}", file=sys.stderr)
            return 1
    print("".join(f"{r['name']}={r['version']}\n" for r in rows), end="")
    return 0


def scan_tree(spark: SparkSession, folder: str) -> int:
    """Looks through vendored crates, one folder each; only manifests are read."""
    if not os.path.isdir(folder) or not os.listdir(folder):
        return 0
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.regexp_replace("path", "^file:/+", "/").alias("full"))
    below = F.expr(f"substring(full, {len(os.path.abspath(folder)) + 2})")
    named = files.select(F.substring_index(below, "/", 1).alias("crate"), F.regexp_replace(below, "^[^/]*/", "").alias("path"))
    manifests = policy.read_sources(spark, folder, "Cargo.toml").select(F.regexp_replace("path", "^file:/+", "/").alias("full"), "text")
    texts = manifests.select(F.substring_index(below, "/", 1).alias("crate"), F.regexp_replace(below, "^[^/]*/", "").alias("path"), "text")
    bad = policy.vendored_faults(named.join(texts, ["crate", "path"], "left")).orderBy("crate").first()
    if bad:
        print(f"{bad['crate']}: {bad['fault']}", file=sys.stderr)
    return int(bad is not None)


def main(arguments: list[str]) -> int:
    commands = {"emit-deps": (emit_deps, 1, 1), "scan-tree": (scan_tree, 1, 1), "run": (None, 2, 3)}
    name, rest = (arguments or [""])[0], arguments[1:]
    if name not in commands or not commands[name][1] <= len(rest) <= commands[name][2]:
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("symgrain").getOrCreate()
    ship(spark)
    if name == "run":
        found = scored_run(spark, *rest)
        print(found.get("document") or f"{found['status']}: {found['reason']}")
        return int(found["status"] != "OK")
    return commands[name][0](spark, *rest)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
