"""Policy queries over files that Spark derives from the given tables, and their SQL.

Each document becomes a source file: its whole text in a block comment, and behind it one of some
fixed snippets, by its number. Parts become manifests, dependency lists and vendored crates in
the same way; license expressions come from the license lines of documents. What is found
must come from the snippet alone, at the line to which the text moves it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from symgrain.operators import policy, validate
from symgrain.oracles import MANIFESTS, SOURCES, values
from symgrain.sources import jsonl

QUERIES: dict = {}
ALLOWED = ["MIT", "Apache-2.0", "BSD-3-Clause"]
#: What lines of dependency lists look like, by number; NAME is the part's; and what is wrong with each (nothing: null).
ENTRIES = (
    ('NAME = "1.2.3" # kept', None), ('\tNAME\t=\t"0.1.0-rc.1+x"\t', None), ('NAME = { git = "u" }', "table or array"), ('NAME = "^1"', "version not plain"),
    ("NAME = 1", "version not quoted"), (' = "1.0"', "no name"), ("NAME", "no name = version"), ("# NAME", ""), ("", ""),
)
VERSIONS = (("", True), ("-rc.1+x", True), (" 2", False), (".*", False), ("_1", False))
ENDINGS = (("x.so", True), ("x.a", True), ("lib.rs", False), (".so", False), ("a.so.1", False), ("notes.asm", False), ("y.dll", True), ("z.OBJ", False), ("o", False))


def query(f):
    QUERIES[f.__name__] = f
    return f


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _numbered(spark, rows, names: str):
    """A fixed small table with its rows' numbers as ``i``."""
    return F.broadcast(spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], f"i long, {names}"))


def _sources(spark, sf_dir):
    """(path, text)"""
    docs = _read(spark, sf_dir, "documents").join(_numbered(spark, [(s[0], s[1]) for s in SOURCES], "snippet string, code string"), F.col("doc_id") % len(SOURCES) == F.col("i"))
    return docs.select(F.concat(F.lit("d"), "doc_id", F.lit("/"), "snippet").alias("path"), F.concat(F.lit("/*"), F.translate(F.coalesce("text", F.lit("")), "*", ""), F.lit("*/"), "code").alias("text"))


_S = f"""s AS (SELECT 'd' || doc_id || '/' || path AS path, snippet.path AS snippet, len(string_split(coalesce(text, ''), chr(10))) - 1 AS breaks, spot, what, code, shown
  FROM documents JOIN ({values([(i, s[0], s[2], s[3], s[4], s[5]) for i, s in enumerate(SOURCES)], "i", "path", "spot", "what", "code", "shown")}) snippet ON doc_id % {len(SOURCES)} = i)"""


@query
def strip_comments(spark, sf_dir):
    """Sources without comments, with and without the insides of strings."""
    return _sources(spark, sf_dir).select("path", *[policy.stripped(F.col("text"), blank).alias(name) for name, blank in (("code", True), ("shown", False))])


@query
def source_scan(spark, sf_dir):
    return policy.first_findings(_sources(spark, sf_dir)).select("path", F.col("line").cast("long").alias("line"), "what")


@query
def source_purity(spark, sf_dir):
    """Build scripts, one for some documents, are found by name, all others by what they hold."""
    scripts = _read(spark, sf_dir, "documents").where("doc_id % 10 = 0").select(F.concat(F.lit("d"), "doc_id", F.when(F.col("doc_id") % 20 == 0, "/build.rs").otherwise("/rebuild.rs")).alias("path"), F.lit("fn main() {}").alias("text"))
    return policy.purity(_sources(spark, sf_dir).unionByName(scripts)).select("path", F.col("line").cast("long").alias("line"), "what")


@query
def macro_calls(spark, sf_dir):
    """Where ``asm`` is called as a macro, and its line."""
    code = _sources(spark, sf_dir).select("path", policy.stripped(F.col("text"), True).alias("code"))
    return code.select("path", policy.has_macro_call(F.col("code"), "asm").alias("called"), policy.macro_line(F.col("code"), "asm").cast("long").alias("line"))


@query
def attribute_lines(spark, sf_dir):
    return policy.lines_of(_sources(spark, sf_dir)).where(policy.has_attribute(F.col("content"), "link")).select("path", F.col("line").cast("long").alias("line"))


def _parts(spark, sf_dir, rows, names: str):
    return _read(spark, sf_dir, "part").join(_numbered(spark, rows, names), F.col("p_partkey") % len(rows) == F.col("i"))


@query
def dep_line_parse(spark, sf_dir):
    """A dependency list for each hundred parts, an entry for each behind the header, in the order of their keys; another table ends it."""
    entry = F.replace("entry", F.lit("NAME"), F.concat(F.lit("part-"), "p_partkey"))
    rows = _parts(spark, sf_dir, [e[:1] for e in ENTRIES], "entry string").groupBy(F.expr("p_partkey div 100").alias("list")).agg(F.sort_array(F.collect_list(F.struct("p_partkey", entry.alias("entry")))).alias("all"))
    files = rows.select(F.col("list").cast("string").alias("path"), F.concat(F.lit('early = "1.0"\n\t[dependencies]\t# here\n'), F.array_join("all.entry", "\n"), F.lit('\n[dev-dependencies]\nlate = "2"\n')).alias("text"))
    return policy.dependencies(files).select("path", F.col("line").cast("long").alias("line"), "name", "version", "fault")


@query
def version_shape(spark, sf_dir):
    text = F.concat("p_size", F.lit("."), "p_partkey", "ending")
    return _parts(spark, sf_dir, [v[:1] for v in VERSIONS], "ending string").select("p_partkey", policy.plain_version(text).alias("plain"), policy.plain_version(F.concat(F.lit("v"), text)).alias("prefixed"))


@query
def crate_split(spark, sf_dir):
    """Parts' names as folders, with a version for all but some."""
    folder = F.concat(F.translate("p_name", " ", "-"), F.when(F.col("p_partkey") % 5 == 0, "-sys").otherwise(F.concat(F.lit("-"), "p_size", F.lit(".0.0-alpha.1"))))
    return _read(spark, sf_dir, "part").select("p_partkey", folder.alias("folder"), policy.crate_name(folder).alias("crate"))


def _manifests(spark, sf_dir):
    """(key, name, manifest)"""
    return _parts(spark, sf_dir, [m[1:2] for m in MANIFESTS], "manifest string").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.concat(F.lit("# "), "p_name", F.lit("\n"), "manifest").alias("manifest"))


@query
def build_tools(spark, sf_dir):
    """Tools among the build dependencies of manifests, some behind tabs."""
    return policy.build_tools(_manifests(spark, sf_dir).select(F.concat(F.lit("part-"), "key").alias("path"), F.col("manifest").alias("text")))


@query
def native_files(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages").join(_numbered(spark, [e[:1] for e in ENDINGS], "ending string"), F.col("page_id") % len(ENDINGS) == F.col("i"))
    path = F.concat(F.regexp_extract("url", "^[^?#]*", 0), F.lit("/"), "ending")
    return pages.select("page_id", policy.native_file(path).alias("native"))


@query
def vendored_faults(spark, sf_dir):
    """A crate for each part, with its manifest; some wrap a library, some ship a blob."""
    m = _manifests(spark, sf_dir)
    crate = F.concat(F.lit("part-"), "key", F.when(F.col("key") % 7 == 0, "-sys").otherwise(""), F.lit("-1.0.0"))
    files = m.select(crate.alias("crate"), F.lit("Cargo.toml").alias("path"), F.col("manifest").alias("text"))
    blobs = m.where("key % 11 = 0").select(crate.alias("crate"), F.explode(F.array(F.lit("lib/x.so"), F.lit("lib/y.rs"))).alias("path"), F.lit(None).cast("string").alias("text"))
    return policy.vendored_faults(files.unionByName(blobs))


_NAMES = {"Released under the MIT License": "MIT", "Licensed under the Apache License, Version 2.0": "Apache-2.0", "GNU General Public License, version 3": "GPL-3.0", "CC BY-NC 4.0": "CC-BY-NC-4.0"}


@query
def license_gate(spark, sf_dir):
    """Expressions of the licenses that neighbouring documents name: any of them, all of them, and any of them beside one that is not allowed or may be exchanged."""
    texts = _read(spark, sf_dir, "documents").select((F.col("doc_id") / 40).cast("long").alias("group"), F.explode(F.array_compact(F.array(*[F.when(F.contains("text", F.lit(p)), F.lit(n)) for p, n in _NAMES.items()]))).alias("name"))
    named = texts.groupBy("group").agg(F.sort_array(F.collect_set("name")).alias("names"))
    any_, all_ = F.array_join("names", " OR "), F.array_join("names", " AND ")
    forms = {"any": any_, "all": all_, "both": F.concat(F.lit("("), any_, F.lit(") AND GPL-3.0")), "either": F.concat(F.lit("GPL-3.0 AND MIT OR("), all_, F.lit(")")), "slash": F.concat(F.lit("(MIT/GPL-3.0) AND ("), any_, F.lit(")"))}
    crates = named.select(F.explode(F.array(*[F.struct(F.concat("group", F.lit(f"-{form}")).alias("crate"), e.alias("license")) for form, e in forms.items()])).alias("c")).select("c.*")
    return policy.license_faults(crates, ALLOWED)


@query
def policy_gate(spark, sf_dir):
    """The first fault of each document: of its text, its language, its license."""
    fault = lambda test, name: F.when(test, F.lit(name))
    text = F.coalesce("text", F.lit(""))
    return _read(spark, sf_dir, "documents").select("doc_id", policy.gate(fault(F.contains(text, F.lit("token")), "source"), fault(F.col("lang") != "en", "dependency"), fault(F.contains(text, F.lit("icense")), "license")).alias("fault"))


@query
def exit_reasons(spark, sf_dir):
    """Of exit codes made from events."""
    code = F.when(F.col("event_id") % 41 > 0, (F.col("event_id") % 150 - 12)).cast("int")
    return _read(spark, sf_dir, "events").groupBy(validate.exit_reason(code).alias("reason")).agg(F.count(F.lit(1)).alias("events"))


@query
def json_fields(spark, sf_dir):
    """Fields of the properties of events: a number, one below zero, a text, an array; and the properties shortened behind their text."""
    j = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("long").alias("k"), (-F.get_json_object("props", "$.k").cast("long")).alias("minus"), F.col("event_type").alias("kind"), F.array("user_id", "event_id").alias("ids")))
    return _read(spark, sf_dir, "events").select(
        "event_id", jsonl.integer_field(F.col("props"), "k").alias("k"), jsonl.integer_field(j, "minus").alias("minus"), jsonl.text_field(j, "kind").alias("kind"), F.array_join(jsonl.integers_field(j, "ids"), ",").alias("ids"), jsonl.shortened(F.repeat("props", 12)).alias("shown")
    )


_PART = lambda rows, *names: f"part JOIN ({values([(i, *r) for i, r in enumerate(rows)], 'i', *names)}) t ON p_partkey % {len(rows)} = i"
_MANIFEST_TOOLS = [(tool,) for *_, tool in MANIFESTS]
_L = "[x for x in ['MIT', 'Apache-2.0', 'GPL-3.0', 'CC-BY-NC-4.0'] if contains(text, CASE x WHEN 'MIT' THEN 'Released under the MIT License' WHEN 'Apache-2.0' THEN 'Licensed under the Apache License, Version 2.0' WHEN 'GPL-3.0' THEN 'GNU General Public License, version 3' ELSE 'CC BY-NC 4.0' END)]"

ORACLES = {
    "strip_comments": f"WITH {_S} SELECT path, repeat(chr(10), breaks) || code AS code, repeat(chr(10), breaks) || shown AS shown FROM s",
    "source_scan": f"WITH {_S} SELECT path, CAST(breaks + spot AS BIGINT) AS line, what FROM s WHERE what IS NOT NULL",
    "source_purity": f"WITH {_S} SELECT path, CAST(breaks + spot AS BIGINT) AS line, what FROM s WHERE what IS NOT NULL UNION ALL SELECT 'd' || doc_id || '/build.rs', NULL, 'build script' FROM documents WHERE doc_id % 20 = 0",
    "macro_calls": f"WITH {_S} SELECT path, snippet = 'f10' AS called, CASE WHEN snippet = 'f10' THEN CAST(breaks + 2 AS BIGINT) END AS line FROM s",
    "attribute_lines": f"WITH {_S} SELECT path, CAST(breaks + 2 AS BIGINT) AS line FROM s WHERE snippet = 'f13'",
    "dep_line_parse": f"""WITH q AS (SELECT CAST(p_partkey // 100 AS VARCHAR) AS path, row_number() OVER (PARTITION BY p_partkey // 100 ORDER BY p_partkey) + 2 AS line, count(*) OVER (PARTITION BY p_partkey // 100) AS n, p_partkey, i, fault FROM {_PART([e[1:] for e in ENTRIES], "fault")}),
      e AS (SELECT path, line, CASE WHEN i IN (5, 6) THEN '' ELSE 'part-' || p_partkey END AS name, CASE i WHEN 0 THEN '1.2.3' WHEN 1 THEN '0.1.0-rc.1+x' WHEN 3 THEN '^1' WHEN 5 THEN '1.0' ELSE '' END AS version, fault FROM q WHERE fault IS NULL OR fault <> '')
      SELECT path, CAST(line AS BIGINT) AS line, name, version, fault FROM (SELECT * FROM e UNION ALL SELECT DISTINCT path, 1, 'early', '1.0', 'before [dependencies]' FROM q UNION ALL SELECT DISTINCT path, n + 3, '', '', 'another table' FROM q UNION ALL SELECT DISTINCT path, n + 4, 'late', '2', NULL FROM q)""",
    "version_shape": f"SELECT p_partkey, plain, false AS prefixed FROM {_PART([v[1:] for v in VERSIONS], 'plain')}",
    "crate_split": "SELECT p_partkey, replace(p_name, ' ', '-') || CASE WHEN p_partkey % 5 = 0 THEN '-sys' ELSE '-' || p_size || '.0.0-alpha.1' END AS folder, replace(p_name, ' ', '-') || CASE WHEN p_partkey % 5 = 0 THEN '-sys' ELSE '' END AS crate FROM part",
    "build_tools": f"SELECT 'part-' || p_partkey AS path, tool FROM {_PART(_MANIFEST_TOOLS, 'tool')} WHERE tool IS NOT NULL",
    "native_files": f"SELECT page_id, native FROM pages JOIN ({values([(i, n) for i, (_, n) in enumerate(ENDINGS)], 'i', 'native')}) t ON page_id % {len(ENDINGS)} = i",
    "vendored_faults": f"SELECT crate, fault FROM (SELECT 'part-' || p_partkey || CASE WHEN p_partkey % 7 = 0 THEN '-sys' ELSE '' END || '-1.0.0' AS crate, CASE WHEN p_partkey % 7 = 0 THEN 'wraps a native library' WHEN tool IS NOT NULL THEN 'builds with ' || tool WHEN p_partkey % 11 = 0 THEN 'ships lib/x.so' END AS fault FROM {_PART(_MANIFEST_TOOLS, 'tool')}) WHERE fault IS NOT NULL",
    "license_gate": f"""WITH g AS (SELECT doc_id // 40 AS k, list_sort(list_distinct(flatten(list({_L})))) AS names FROM documents WHERE text IS NOT NULL GROUP BY k),
      c AS (SELECT k, array_to_string(names, ' OR ') AS o, array_to_string(names, ' AND ') AS a, list_contains(names, 'MIT') OR list_contains(names, 'Apache-2.0') AS any_ok, NOT (list_contains(names, 'GPL-3.0') OR list_contains(names, 'CC-BY-NC-4.0')) AS all_ok FROM g WHERE len(names) > 0)
      SELECT crate, license FROM (SELECT k || '-any' AS crate, o AS license, any_ok AS ok FROM c UNION ALL SELECT k || '-all', a, all_ok FROM c UNION ALL SELECT k || '-both', '(' || o || ') AND GPL-3.0', false FROM c UNION ALL SELECT k || '-either', 'GPL-3.0 AND MIT OR(' || a || ')', all_ok FROM c UNION ALL SELECT k || '-slash', '(MIT/GPL-3.0) AND (' || o || ')', any_ok FROM c) WHERE NOT ok""",
    "policy_gate": "SELECT doc_id, CASE WHEN contains(coalesce(text, ''), 'token') THEN 'source' WHEN lang <> 'en' THEN 'dependency' WHEN contains(coalesce(text, ''), 'icense') THEN 'license' END AS fault FROM documents",
    "exit_reasons": "SELECT CASE WHEN event_id % 41 = 0 THEN 'no exit status' WHEN event_id % 150 - 12 = 0 THEN NULL WHEN event_id % 150 < 12 THEN 'killed by signal ' || (12 - event_id % 150) ELSE 'exit code ' || (event_id % 150 - 12) END AS reason, count(*) AS events FROM events GROUP BY ALL",
    "json_fields": "SELECT event_id, k, CASE WHEN k = 0 THEN CAST(0 AS BIGINT) END AS minus, event_type AS kind, user_id || ',' || event_id AS ids, left(repeat(props, 12), 80) || '…' AS shown FROM (SELECT *, CAST(regexp_extract(props, ':\\s*(\\d+)', 1) AS BIGINT) AS k FROM events)",
}
