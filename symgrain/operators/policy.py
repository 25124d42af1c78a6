"""Policy scans of source text, dependency lists and vendored trees, as queries over (path, text) tables.

Stripping comments needs a lexer and runs as an Arrow function; all else is regular.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from symgrain.functions.lexing import strip_comments

#: Words and macros that sources may not use, in order of report; tools that compile native code; endings of native files.
WORDS = (("extern", "foreign functions"), ("no_mangle", "no_mangle"), ("proc_macro", "procedural macros"))
MACROS = ("asm", "global_asm", "naked_asm", "llvm_asm")
BUILD_TOOLS = ("cc", "gcc", "clang", "cmake", "bindgen", "nasm")
NATIVE_ENDINGS = ("a", "so", "dylib", "dll", "lib", "o", "obj")
#: Texts of a batch that are Python strings at once.
TEXTS_AT_ONCE = 64
_EDGE = "[^A-Za-z0-9_]"


def bare(text: Column) -> Column:
    """Without white space of any kind at both ends (trim() takes spaces only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def _some_at_once(texts: pa.Array, change: Callable[[str], str]) -> pa.Array:
    """Each text changed, nulls kept; only ``TEXTS_AT_ONCE`` are Python strings at any time."""
    some = [pa.array([None if t is None else change(t) for t in texts.slice(at, TEXTS_AT_ONCE).to_pylist()], pa.string()) for at in range(0, len(texts), TEXTS_AT_ONCE)]
    return pa.concat_arrays(some) if some else pa.array([], pa.string())


def stripped(text: Column, blank_strings: bool) -> Column:
    @F.arrow_udf("string")
    def strip(texts: pa.Array) -> pa.Array:
        return _some_at_once(texts, lambda t: strip_comments(t, blank_strings))

    return strip(text)


def has_word(text: Column, word: str) -> Column:
    """Whether the word stands between characters that cannot belong to a name."""
    return text.rlike(f"(^|{_EDGE}){word}({_EDGE}|$)")


def has_macro_call(text: Column, name: str) -> Column:
    """Whether the name is called as a macro: ``name ! (``, across lines."""
    return text.rlike(rf"(^|{_EDGE}){name}\s*!\s*[(\[{{]")


def macro_line(text: Column, name: str) -> Column:
    """The line (from 1) of the first call, or null."""
    before = F.regexp_extract(text, rf"(?s)^(.*?)(?:^|(?<![A-Za-z0-9_])){name}\s*!\s*[(\[{{]", 1)
    return F.when(has_macro_call(text, name), F.size(F.split(before, "\n", -1)))


def has_attribute(line: Column, name: str) -> Column:
    return (line.contains("#[") & line.contains(name) & line.contains("]")) | (line.contains("#![") & line.contains(name))


def numbered_lines(files: DataFrame, text: str = "text") -> DataFrame:
    """Every other column, and line (from 1) and content of each line; a break at the end opens no line."""
    others = [c for c in files.columns if c != text]
    whole = F.regexp_replace(F.regexp_replace(F.col(text), "\r\n", "\n"), "\n$", "")
    return files.where(F.length(text) > 0).select(*others, F.posexplode(F.split(whole, "\n", -1)).alias("at", "content")).select(*others, (F.col("at") + 1).alias("line"), "content")


def lines_of(files: DataFrame, text: str = "text") -> DataFrame:
    """(path, line from 1, content) of each line."""
    return numbered_lines(files.select("path", text), text)


def source_findings(files: DataFrame) -> DataFrame:
    """(path, rank, line, what) of all that sources may not use; rank: the order in which kinds are looked for within a file."""
    views = files.select("path", stripped(F.col("text"), True).alias("code"), stripped(F.col("text"), False).alias("shown"))
    code = lines_of(views.select("path", F.col("code").alias("text")))
    line = bare(F.col("content"))
    link = has_attribute(line, "link") & (line.contains("link(") | line.contains("link =") | line.contains("link_name"))
    kinds = [F.when(has_word(line, w), F.struct(F.lit(k).alias("k"), F.lit(what).alias("what"))) for k, (w, what) in enumerate(WORDS)] + [F.when(link, F.struct(F.lit(len(WORDS)).alias("k"), F.lit("link attribute").alias("what")))]
    by_line = code.select("path", "line", F.explode(F.array_compact(F.array(*kinds))).alias("f")).select("path", F.lit(0).alias("rank"), "line", "f.k", "f.what")
    calls = F.array(*[F.struct(F.lit(k).alias("k"), macro_line(F.col("code"), m).alias("line")) for k, m in enumerate(MACROS)])
    macros = views.select("path", F.explode(calls).alias("m")).where("m.line IS NOT NULL").select("path", F.lit(1).alias("rank"), "m.line", "m.k", F.lit("inline assembly").alias("what"))
    shown = lines_of(views.select("path", F.col("shown").alias("text")))
    includes = shown.where(F.col("content").contains("include!") & F.col("content").contains("..")).select("path", F.lit(2).alias("rank"), "line", F.lit(0).alias("k"), F.lit("include of a path outside").alias("what"))
    return by_line.unionByName(macros).unionByName(includes)


def first_findings(files: DataFrame) -> DataFrame:
    """(path, line, what): the first finding of each file that has one."""
    first = F.min(F.struct("rank", F.when(F.col("rank") == 1, F.col("k")).otherwise(0).alias("order"), "line", "k", "what")).alias("f")
    return source_findings(files).groupBy("path").agg(first).select("path", "f.line", "f.what")


def read_sources(spark: SparkSession, folder: str, pattern: str = "*.rs") -> DataFrame:
    """(path, text) of the files below a folder."""
    rows = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def purity(files: DataFrame) -> DataFrame:
    """(path, line, what) of the files that break a rule; build scripts do so by their name."""
    scripts = files.where(F.col("path").rlike("(^|/)build\\.rs$")).select("path", F.lit(None).cast("int").alias("line"), F.lit("build script").alias("what"))
    others = files.where(~F.col("path").rlike("(^|/)build\\.rs$"))
    return scripts.unionByName(first_findings(others))


def uncommented(line: Column) -> Column:
    """The line up to the first #, trimmed."""
    return bare(F.substring_index(line, "#", 1))


def plain_version(text: Column) -> Column:
    return text.rlike(r"^[0-9][0-9A-Za-z.+-]*$")


def dependencies(files: DataFrame) -> DataFrame:
    """(path, line, name, version, fault) of each entry of restricted dependency lists; (fault: why a line is none)."""
    rows = lines_of(files).select("path", "line", uncommented(F.col("content")).alias("t")).where("t <> ''")
    header = F.when(F.col("t") == "[dependencies]", F.col("line"))
    seen = F.max(header).over(W.partitionBy("path").orderBy("line").rowsBetween(W.unboundedPreceding, 0))
    name, value = (bare(F.regexp_extract("t", r"^([^=]*)=(.*)$", k)) for k in (1, 2))
    version = F.regexp_extract(value, r'^"(.*)"$', 1)
    fault = (
        F.when(F.col("t").startswith("["), "another table").when(seen.isNull(), "before [dependencies]").when(~F.col("t").contains("="), "no name = version")
        .when(value.rlike(r"^[{\[]"), "table or array").when(~value.rlike(r'^".*"$') | (value == '"'), "version not quoted").when(~plain_version(version), "version not plain").when(name == "", "no name")
    )
    return rows.select("path", "line", "t", name.alias("name"), version.alias("version"), fault.alias("fault")).where("t <> '[dependencies]'").drop("t")


def crate_name(folder: Column) -> Column:
    """The folder's name without its version: up to the last hyphen before a digit."""
    short = F.regexp_extract(folder, r"(?s)^(.*)-[0-9].*$", 1)
    return F.when(folder.rlike(r"(?s)^(.*)-[0-9].*$"), short).otherwise(folder)


def build_tools(manifests: DataFrame) -> DataFrame:
    """(path, tool): the first native build tool that a manifest names among its build dependencies, by key, table header or rename."""
    tools = "|".join(BUILD_TOOLS)
    rows = lines_of(manifests).select("path", "line", bare(F.col("content")).alias("t"))
    named = bare(F.regexp_extract("t", r"^\[(?:.*\.)?build-dependencies\.(.*)\]$", 1))
    plain = (F.col("t") == "[build-dependencies]") | F.col("t").rlike(r"^\[target\..*\.build-dependencies\]$")
    opens = F.when(named != "", True).when(F.col("t").startswith("["), plain)
    section = F.last(opens, ignorenulls=True).over(W.partitionBy("path").orderBy("line").rowsBetween(W.unboundedPreceding, 0))
    entry = F.coalesce(section, F.lit(False)) & ~F.col("t").startswith("[") & ~F.col("t").startswith("#") & (F.col("t") != "")
    key = F.regexp_extract("t", r"^([^=\s.]*)", 1)
    renamed = F.regexp_extract("t", rf"""package\s*=\s*(?:"({tools})"|'({tools})')""", 1)
    renamed = F.when(renamed != "", renamed).otherwise(F.regexp_extract("t", rf"""package\s*=\s*(?:"({tools})"|'({tools})')""", 2))
    tool = F.when(named.isin(*BUILD_TOOLS), named).when(entry & key.isin(*BUILD_TOOLS), key).when(entry & (renamed != ""), renamed)
    return rows.select("path", "line", tool.alias("tool")).where("tool IS NOT NULL").groupBy("path").agg(F.min_by("tool", "line").alias("tool"))


def native_file(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]\.([^./]+)$", 1).isin(*NATIVE_ENDINGS)


def vendored_faults(files: DataFrame) -> DataFrame:
    """(crate, fault): the first reason to reject a vendored crate. files: (crate, path within it, text or null)."""
    names = files.select("crate").distinct().where(F.endswith(crate_name(F.col("crate")), F.lit("-sys"))).select("crate", F.lit(0).alias("k"), F.lit("wraps a native library").alias("fault"))
    tools = build_tools(files.where("path = 'Cargo.toml'").select(F.col("crate").alias("path"), "text")).select(F.col("path").alias("crate"), F.lit(1).alias("k"), F.concat(F.lit("builds with "), "tool").alias("fault"))
    blobs = files.where(native_file(F.col("path"))).groupBy("crate").agg(F.min("path").alias("p")).select("crate", F.lit(2).alias("k"), F.concat(F.lit("ships "), "p").alias("fault"))
    return names.unionByName(tools).unionByName(blobs).groupBy("crate").agg(F.min(F.struct("k", "fault")).alias("f")).select("crate", "f.fault")


def license_allowed(expression: Column, allowed: list[str]) -> Column:
    """Whether a license expression can be met by allowed licenses: AND needs both sides, OR (or a slash) one, AND binds tighter, brackets first; ``X WITH Y`` is a license of its own. Null, empty and malformed expressions cannot, nor can brackets deeper than 60.

    The tokens are folded from left to right. Two stacks of bits, a bit for each open bracket,
    hold whether an alternative before the current one was met, and whether the current one is so far.
    """
    one, others = F.lit(1).cast("long"), F.lit(~1).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("ors"), one.alias("ands"), F.lit(0).alias("depth"), F.lit(True).alias("operand"), F.lit(False).alias("bad"))

    def step(s: Column, t: Column) -> Column:
        opens, closes, both, either = t == "(", t == ")", t == "AND", t.isin("OR", "/")
        met = s["ors"].bitwiseOR(s["ands"]).bitwiseAND(one) == 1
        outer = F.shiftright(s["ands"], 1)
        ors = F.when(opens, F.shiftleft(s["ors"], 1)).when(closes, F.shiftright(s["ors"], 1)).when(either, s["ors"].bitwiseOR(s["ands"].bitwiseAND(one))).otherwise(s["ors"])
        ands = (
            F.when(opens, F.shiftleft(s["ands"], 1).bitwiseOR(one)).when(closes & met, outer).when(closes, outer.bitwiseAND(others))
            .when(either, s["ands"].bitwiseOR(one)).when(both | t.isin(*allowed), s["ands"]).otherwise(s["ands"].bitwiseAND(others))
        )
        depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        misplaced = F.when(opens, ~s["operand"] | (s["depth"] >= 60)).when(closes, s["operand"] | (s["depth"] == 0)).when(both | either, s["operand"]).otherwise(~s["operand"])
        return F.struct(ors.alias("ors"), ands.alias("ands"), depth.alias("depth"), (opens | both | either).alias("operand"), (s["bad"] | misplaced).alias("bad"))

    tokens = F.regexp_extract_all(expression, F.lit(r"[()/]|[^\s()/]+(?:\s+WITH\s+[^\s()/]+)?"), F.lit(0))
    tokens = F.transform(tokens, lambda t: F.regexp_replace(t, r"\s+", " "))
    end = lambda s: ~s["bad"] & ~s["operand"] & (s["depth"] == 0) & (s["ors"].bitwiseOR(s["ands"]).bitwiseAND(one) == 1)
    return F.coalesce(F.aggregate(tokens, start, step, end), F.lit(False))


def license_faults(crates: DataFrame, allowed: list[str]) -> DataFrame:
    """Crates (crate, license) whose license expression cannot be met by the allowed licenses."""
    return crates.where(~license_allowed(F.col("license"), allowed))


def word_findings(line: Column, words: dict[str, str]) -> Column:
    """What is said of each listed word that the line holds by itself, in the list's order."""
    return F.array_compact(F.array(*[F.when(has_word(line, word), F.lit(what)) for word, what in words.items()]))


def license_findings(line: Column, phrases: dict[str, str], allowed: list[str]) -> Column:
    """The licenses that the line names, by a listed phrase or an SPDX expression, and that are not allowed."""
    spdx = bare(F.regexp_extract(line, r"SPDX-License-Identifier:\s*([^*]*)", 1))
    by_phrase = [F.when(F.contains(line, F.lit(phrase)), F.lit(name)) for phrase, name in phrases.items() if name not in allowed]
    return F.array_compact(F.array(*by_phrase, F.when((spdx != "") & ~license_allowed(spdx, allowed), spdx)))


def gate(source: Column, dependency: Column, license_: Column) -> Column:
    """The first fault: of the sources, then the dependencies, then the licenses."""
    return F.coalesce(source, dependency, license_)
