import json
import math
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from symgrain.functions.graph import Graph
from symgrain.functions.lexing import strip_comments
from symgrain.functions.symbolic import column_counts, elimination_tree
from symgrain.catalogue import order_report
from symgrain.operators import pattern, policy, scoring, sinks, symbolic, validate, walks
from symgrain.operators.numbering import numbered_by
from symgrain.plans import bestof
from symgrain.sources import binary, generators, jsonl, tables

LINE = '{"n":4,"nnz":12,"indptr":[0,3,6,8,12],"indices":[0,1,3,0,1,3,2,3,0,1,2,3],"hash":"x","source":"st"}'


def edges(spark, pairs, mid="m"):
    return spark.createDataFrame([(mid, a, b) for a, b in pairs], "mid string, a long, b long")


def vertices(spark, n, mid="m"):
    return spark.createDataFrame([(mid, i) for i in range(n)], "mid string, id long")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_symmetrize_pack_unpack(spark):
    both = pattern.symmetrize(edges(spark, [(0, 1), (1, 0), (2, 2), (1, 3)]))
    assert rows(both) == [("m", 0, 1), ("m", 1, 0), ("m", 1, 3), ("m", 3, 1)]
    packed = pattern.pack(both, vertices(spark, 5))
    r = packed.first()
    assert (r["n"], r["col_at"], r["rows"]) == (5, [0, 1, 3, 3, 4, 4], [1, 0, 3, 1])
    assert rows(pattern.unpack(packed)) == rows(both)
    assert pattern.faults(packed).first()["fault"] is None
    assert rows(pattern.degrees(both, vertices(spark, 5)).select("v", "degree")) == [(0, 1), (1, 2), (2, 0), (3, 1), (4, 0)]
    assert rows(pattern.out_of_range(both, spark.createDataFrame([("m", 3)], "mid string, n long")).select("a", "b")) == [(1, 3), (3, 1)]
    assert pattern.asymmetric(both).isEmpty() and pattern.asymmetric(edges(spark, [(0, 1)])).count() == 1


def test_jsonl(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_text(LINE + "\n\n" + LINE.replace('"st"', '"two"') + "\n")
    loaded = jsonl.load(spark, str(path))
    assert [r["mid"] for r in loaded.orderBy("seq").collect()] == ["st", "two"]
    assert jsonl.edges_of(loaded).where("mid = 'st'").count() == 8
    bad = ["not json", '{"n":2}', '{"n":1,"indptr":[0],"indices":[]}', '{"n":1,"indptr":[1,1],"indices":[0]}', '{"n":1,"indptr":[0,2],"indices":[0]}', '{"n":2,"indptr":[0,2,1],"indices":[1]}', '{"n":1,"indptr":[0,1],"indices":[1]}', "   "]
    lines = spark.createDataFrame(list(enumerate(bad)), "seq long, value string")
    assert [r["fault"].split(":")[0] for r in jsonl.parse(lines).orderBy("seq").collect()] == ["n missing", "col_at missing", "col_at length", "col_at start", "col_at end", "col_at falls", "row out of range"]
    path.write_text("not json\n")
    with pytest.raises(ValueError, match="n missing: not json"):
        jsonl.load(spark, str(path))
    path.write_text("version https://git-lfs.github.com/spec/v1\noid sha256:0\n")
    with pytest.raises(ValueError, match="pointer"):
        jsonl.load(spark, str(path))
    assert jsonl.load(spark, str(tmp_path / "absent")).count() == 0
    (tmp_path / "many").mkdir()
    for k, size in enumerate((1, 60, 7)):  # Spark deals larger files first
        (tmp_path / "many" / f"{k}.jsonl").write_text("".join(LINE.replace('"st"', f'"{k}-{i:02}"') + "\n" for i in range(size)) + ("\t \n" if k else "bad\n"))
    scanned = jsonl.scan(spark, str(tmp_path / "many")).orderBy("seq").collect()
    assert [r["mid"] for r in scanned] == ["0-00", "", *[f"1-{i:02}" for i in range(60)], *[f"2-{i:02}" for i in range(7)]]
    with pytest.raises(ValueError, match="line 1: n missing: bad"):
        jsonl.load(spark, str(tmp_path / "many"))
    assert jsonl.parse(spark.createDataFrame([(0, LINE)], "seq long, value string")).select(pattern.entries()).first()[0] == 8
    assert spark.createDataFrame([(0, [0], [])], "n long, col_at array<long>, rows array<long>").select(pattern.entries()).first()[0] == 0
    assert jsonl.corpus_path("d", " ") == "d" and jsonl.corpus_path("d", "x") == "x"
    fields = spark.createDataFrame([(LINE,)], "j string").select(jsonl.integer_field(F.col("j"), "n"), jsonl.text_field(F.col("j"), "source"), F.size(jsonl.integers_field(F.col("j"), "indptr")), jsonl.shortened(F.lit("x" * 90)))
    assert tuple(fields.first()) == (4, "st", 5, "x" * 80 + "…")


def test_binary():
    data = binary.pattern_bytes(2, [0, 1, 2], [1, 0])
    n, at, r = binary.pattern_from(data)
    assert (n, at.tolist(), r.tolist()) == (2, [0, 1, 2], [1, 0])
    assert binary.order_from(binary.order_bytes([2, 0, 1])).tolist() == [2, 0, 1]
    for bad in (b"", data[:-1], data + b"x", struct.pack("<QQ", 1, 1 << 60), binary.pattern_bytes(3, [0, 1, 2], [1, 0])):
        with pytest.raises(binary.Broken):
            binary.pattern_from(bad)
    with pytest.raises(binary.Broken):
        binary.order_from(data)


def test_generators_and_scores(spark):
    for make, n, want in ((generators.arrow(spark, 50), 50, (1275, 42925)), (generators.grid2d(spark, 10), 100, (1009, 10687))):
        both = pattern.symmetrize(make)
        v = both.select("mid", F.col("a").alias("id")).distinct()
        got = symbolic.scores(both, symbolic.natural_order(v)).first()
        assert (got["n"], got["nnz_l"], got["flops"]) == (n, *want)
    assert generators.grid3d(spark, 3).count() == 54
    assert rows(generators.arrow(spark, 4)) == [("arrow-4", 0, 1), ("arrow-4", 0, 2), ("arrow-4", 0, 3), ("arrow-4", 1, 2), ("arrow-4", 2, 3)] and generators.arrow(spark, 1).isEmpty()
    arrow = pattern.symmetrize(generators.arrow(spark, 50))
    last = spark.createDataFrame([("arrow-50", "hub last", (v - 1) % 50, v) for v in range(50)], "mid string, candidate string, k long, v long")
    assert symbolic.scores(arrow, last).first()["nnz_l"] == 147
    grid = pattern.symmetrize(generators.grid2d(spark, 4))
    v = grid.select("mid", F.col("a").alias("id")).distinct()
    kernel = rows(symbolic.columns(grid, symbolic.natural_order(v)).select("j", "parent", "c"))
    assert kernel == rows(symbolic.columns_by_paths(grid, v).select("j", "parent", "c"))
    assert len(generators.kkt_edges(600, 200, 42)) > 1000 and generators.kkt_edges(30, 10, 1) == generators.kkt_edges(30, 10, 1)


def test_scoring_vectors(spark):
    n = spark.createDataFrame([(i,) for i in (0, 999, 1000, 9999, 10000, 340000)], "n long")
    assert [r[0] for r in n.select(scoring.size_bucket(F.col("n"))).collect()] == ["lt_1k", "lt_1k", "1k_10k", "1k_10k", "gt_10k", "gt_10k"]

    def combined(a, b, c):
        means = spark.createDataFrame([(0, "lt_1k", 0.3, 1, a, a), (1, "1k_10k", 0.3, 1, b, b), (2, "gt_10k", 0.4, 1, c, c)], "place int, bucket string, weight double, matrices long, flop_geomean double, fill_geomean double")
        return scoring.combine(means).first()["score"]

    assert math.isclose(combined(0.8, 0.9, 0.7), 0.79)
    assert math.isclose(combined(None, 0.9, 0.7), (0.27 + 0.28) / 0.7)
    assert math.isclose(combined(0.873, None, None), 0.873)
    assert math.isnan(combined(None, None, None))
    ratio = spark.createDataFrame([(5, 0.5, 0.5), (6, 0.8, 0.8)], "n long, flop_ratio double, fill_ratio double")
    means = {r["bucket"]: r for r in scoring.bucket_means(ratio).collect()}
    assert math.isclose(means["lt_1k"]["flop_geomean"], math.sqrt(0.4)) and means["gt_10k"]["flop_geomean"] is None
    tied = spark.createDataFrame([("m", 2, 5), ("m", 1, 5), ("m", 3, 9)], "mid string, cand_idx long, flops long")
    assert scoring.cheapest(tied).first()["cand_idx"] == 1


def test_validation_vectors(spark):
    def fault(order, n):
        found = spark.createDataFrame([("m", "c", k, v) for k, v in enumerate(order)], "mid string, candidate string, k long, v long")
        return validate.order_faults(found, spark.createDataFrame([("m", n)], "mid string, n long")).first()["fault"]

    assert [fault(o, n) for o, n in (([2, 0, 1], 3), ([], 0), ([0, 1], 3), ([0, 3, 1], 3), ([0, 1, 1], 3))] == [None, None, "length", "range", "repeat"]
    outcomes = spark.createDataFrame([(1, None), (3, "late"), (2, "early")], "seq long, reason string")
    assert tuple(validate.run_status(outcomes).first()) == ("FAIL", "early")
    assert tuple(validate.run_status(outcomes.where("seq = 1")).first()) == ("OK", None)
    codes = spark.createDataFrame([(0,), (-9,), (3,), (None,)], "c int").select(validate.exit_reason(F.col("c")))
    assert [r[0] for r in codes.collect()] == [None, "killed by signal 9", "exit code 3", "no exit status"]
    one = spark.createDataFrame([("m", "c", 0, 1), ("m", "c", 1, 0)], "mid string, candidate string, k long, v long")
    assert validate.differing(one, one).isEmpty() and validate.digest(one).count() == 1


def test_sinks(spark, tmp_path):
    note = spark.range(1).select(sinks.composed_note(F.lit("a\tb"), F.lit("c\nd")), sinks.composed_note(F.lit("r"), F.lit("")), sinks.composed_note(F.lit(None), F.lit("n"))).first()
    assert tuple(note) == ("a b | c d", "r", "n")
    line = spark.range(1).select(sinks.log_line(F.lit(5), F.lit("FAIL"), F.lit(float("nan")), F.lit(0.5), F.lit("x")).alias("line"))
    assert line.first()[0] == "5\tFAIL\tNaN\t0.500000\tx"
    for _ in range(2):
        sinks.append_log(line, str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).count() == 2
    means = scoring.bucket_means(spark.createDataFrame([(5, 0.5, 0.25)], "n long, flop_ratio double, fill_ratio double"))
    document = json.loads(sinks.score_document(means, scoring.combine(means)).first()["document"])
    metrics = document["metrics"]
    assert list(document) == ["score", "metrics"] and document["score"] == metrics["geomean_flop_ratio"] == 0.5 and metrics["geomean_fill_ratio"] == 0.25 and metrics["matrices"] == 1
    assert metrics["weights"] == {"lt_1k": 0.3, "1k_10k": 0.3, "gt_10k": 0.4} and list(metrics["buckets"]) == ["lt_1k", "1k_10k", "gt_10k"]
    assert metrics["buckets"]["gt_10k"] == {"count": 0, "geomean_flop_ratio": None, "geomean_fill_ratio": None} and metrics["buckets"]["lt_1k"]["geomean_fill_ratio"] == 0.25
    assert [tuple(r) for r in sinks.bucket_report(means).collect()][1] == ("1k_10k", 0, "—", "—")


def test_walks(spark):
    both = pattern.symmetrize(edges(spark, [(0, 1), (1, 2), (2, 3), (4, 5), (0, 2)]))
    v = vertices(spark, 7)
    assert rows(walks.components(both, v).select("v", "component")) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 4), (5, 4), (6, 6)]
    levels = walks.levels(both, spark.createDataFrame([("m", 0)], "mid string, v long"))
    assert rows(levels.select("v", "level")) == [(0, 0), (1, 1), (2, 1), (3, 2)]
    assert tuple(walks.median_level(levels).first()) == ("m", 4, 1)
    assert rows(walks.lacks(both, v).select("v", "degree", "lack"))[:4] == [(0, 2, 0), (1, 2, 0), (2, 3, 2), (3, 1, 0)]
    assert tuple(walks.first_pivot(walks.lacks(both, v)).first()) == ("m", 6, 0, 0)
    sides = spark.createDataFrame([("m", i, i < 2) for i in range(4)], "mid string, v long, side boolean")
    assert rows(walks.border(both, sides).select("v")) == [(0,), (1,), (2,)]
    assert rows(walks.gains(both, sides).select("v", "gain")) == [(0, 0), (1, 0), (2, 1), (3, -1)]


def test_best_of(spark):
    grid = pattern.symmetrize(generators.grid2d(spark, 12))
    v = grid.select("mid", F.col("a").alias("id")).distinct()
    packed, sizes = pattern.pack(grid, v), pattern.matrices(grid, v)
    assert bestof.gates(spark).count() == 29
    admissions = bestof.admitted(sizes)
    assert admissions.count() == 28
    best = bestof.best_of(packed, admissions).first()
    assert best["flops"] <= best["base_flops"]
    big = spark.createDataFrame([("b", 400_000, 2_000_000), ("c", 299_999, 400_000)], "mid string, n long, nnz long")
    assert rows(bestof.admitted(big).select("mid", "cand_idx")) == [("b", 1), ("c", 1), ("c", 11)]
    orders = bestof.orders_of(packed, (1, 17))
    assert [r["fault"] for r in validate.order_faults(orders, sizes).collect()] == [None, None]


def test_registered_orders(spark):
    before, grid = len(bestof.GATES), pattern.symmetrize(generators.grid2d(spark, 3))
    v = grid.select("mid", F.col("a").alias("id")).distinct()
    index = bestof.register("own", lambda g: list(range(g.n))[::-1], bestof.Gate(max_n=100))
    try:
        assert index == 29 and bestof.admitted(pattern.matrices(grid, v)).where("cand_idx = 29").first()["candidate"] == "own"
        assert [r["v"] for r in bestof.orders_of(pattern.pack(grid, v), (29,)).orderBy("k").collect()] == list(range(8, -1, -1))
    finally:
        del bestof.ALGORITHMS[29], bestof.GATES[before:]


def test_numbering_by_ranges(spark):
    data = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 7 == 0, "b").otherwise("c").alias("g"), F.hash("id").alias("x"), "id").repartition(5)
    got = numbered_by(data, "g", ["x", "id"], "k").collect()
    for g in "abc":
        each = sorted((r["x"], r["id"], r["k"]) for r in got if r["g"] == g)
        assert [k for *_, k in each] == list(range(len(each)))
    assert numbered_by(data.limit(0), "g", ["x"], "k").isEmpty()


def test_failed_candidates_are_passed_over(monkeypatch):
    def broken(graph):
        raise RuntimeError("no")

    monkeypatch.setitem(bestof.ALGORITHMS, 17, ("rcm", broken))
    monkeypatch.setitem(bestof.ALGORITHMS, 18, ("sloan 2 1", lambda g: [0] * g.n))
    run = lambda index: bestof.run_candidate("m", index, "x", 3, [0, 1, 3, 4], [1, 0, 2, 1])[3:8]
    assert run(1) == (3, 5, 9, "OK", None)
    assert run(17) == (3, None, None, "FAIL", "RuntimeError: no")
    assert run(18) == (3, None, None, "FAIL", "not an order of the vertices")


def test_arrivals(spark, tmp_path):
    from symgrain.streaming.arrivals import score_arrivals

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text(LINE + "\nnot json\n")
    for _ in range(2):
        score_arrivals(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


SOURCES = [
    ('extern "C" { fn f(); }', "foreign functions"), ("// extern in prose\nfn f() {}", None), ("/* a /* extern */ extern */ let x = 1;", None), ('let s = "extern";', None), ('let s = "/*"; extern "C" {}', "foreign functions"), ("let c = '\"'; extern crate x;", "foreign functions"),
    ("fn f<'a>(x: &'a str) {} // '\nextern", "foreign functions"), ("#[no_mangle]\nfn f() {}", "no_mangle"), ("fn no_mangle_helper() {}", None), ("let asm = 5; if asm != 5 {}", None), ("core::arch::asm\n  !\n (\"nop\")", "inline assembly"), ('include!("../x.rs");', "include of a path outside"), ('include!("x.rs");', None),
    ("#[link(name = \"c\")]", "link attribute"), ("let link = 1; x.link();", None), ('let r = r#"extern " "#; extern', "foreign functions"), ('let r = r#"extern"#;', None), ("use proc_macro::TokenStream;", "procedural macros"), ("let a = '\\u{41}'; let b = b'x'; // extern", None),
]


def test_source_rules(spark):
    files = spark.createDataFrame([(f"f{i:02}", s) for i, (s, _) in enumerate(SOURCES)], "path string, text string")
    got = {r["path"]: r["what"] for r in policy.first_findings(files).collect()}
    assert [got.get(f"f{i:02}") for i in range(len(SOURCES))] == [w for _, w in SOURCES]
    lines = {r["path"]: r["line"] for r in policy.source_findings(files).where("what = 'inline assembly'").collect()}
    assert lines == {"f10": 1}
    scripts = spark.createDataFrame([("a/build.rs", "fn main() {}"), ("a/mod.rs", "fn main() {}")], "path string, text string")
    assert rows(policy.purity(scripts).select("path", "what")) == [("a/build.rs", "build script")]


def test_white_space_does_not_hide_entries(spark):
    hidden = ['\t[build-dependencies]\ncc = "1"', '[build-dependencies]\n\tcc = "1"', "[build-dependencies]\n\u00a0cc='1'", '[build-dependencies]\r\n\tcc\t= "1"\r\n']
    files = spark.createDataFrame([(f"m{i}", t) for i, t in enumerate(hidden)], "path string, text string")
    assert rows(policy.build_tools(files)) == [(f"m{i}", "cc") for i in range(4)]
    listed = policy.dependencies(spark.createDataFrame([("d", '\t[dependencies]\n foo\t=\t"1.0"\n\t\n')], "path string, text string"))
    assert rows(listed.select("name", "version", "fault")) == [("foo", "1.0", None)]


def test_stripping_keeps_lines():
    source = "a /* x\n y */ b // c\n\"s\\\"t\n\" 'q' r\"z\n\""
    for blank in (True, False):
        assert strip_comments(source, blank).count("\n") == source.count("\n")
    assert strip_comments('x = "a\\"b" + y', True) == 'x = "    " + y'
    assert strip_comments("a /* never ends\n", False) == "a \n"


def test_vendored_trees(spark):
    manifest = lambda t: "[package]\nname = \"x\"\n" + t
    crates = {
        "foo-sys-1.0.0-alpha.1": [("Cargo.toml", manifest(""))], "a-1.0.0": [("Cargo.toml", manifest("[build-dependencies]\ncc = \"1\"\n"))], "b-1.0.0": [("Cargo.toml", manifest("[target.'cfg(unix)'.build-dependencies.cmake]\nversion = \"1\"\n"))],
        "c-1.0.0": [("Cargo.toml", manifest("[build-dependencies]\nmine = { package = \"bindgen\" }\n"))], "d-1.0.0": [("Cargo.toml", manifest("[dependencies]\ncc = \"1\"\n"))], "e-1.0.0": [("lib/x.so", None)], "f-1.0.0": [("Cargo.toml", manifest("[build-dependencies]\ncc.workspace = true\n"))],
        "g-1.0.0": [("Cargo.toml", manifest("[build-dependencies.mine]\npackage = 'cc'\n"))], "h-1.0.0": [("src/lib.rs", "x"), ("notes.asm", None)],
    }
    files = spark.createDataFrame([(c, p, t) for c, each in crates.items() for p, t in each], "crate string, path string, text string")
    got = dict(rows(policy.vendored_faults(files)))
    assert got == {"foo-sys-1.0.0-alpha.1": "wraps a native library", "a-1.0.0": "builds with cc", "b-1.0.0": "builds with cmake", "c-1.0.0": "builds with bindgen", "e-1.0.0": "ships lib/x.so", "f-1.0.0": "builds with cc", "g-1.0.0": "builds with cc"}


def test_components_are_joined_up_across_chunks(spark):
    """Patterns of more links than a chunk: a long path in mixed order, a star, pairs."""
    number = np.random.default_rng(5).permutation(60)
    links = {"path": list(zip(number[:-1], number[1:])), "star": [(7, v) for v in range(60) if v != 7], "pairs": [(2 * k, 2 * k + 1) for k in range(30)]}
    half = spark.createDataFrame([(m, int(min(e)), int(max(e))) for m, each in links.items() for e in each], "mid string, a long, b long")
    want = {"path": lambda v: 0, "star": lambda v: 0, "pairs": lambda v: v // 2 * 2}
    for chunk in (10, 10_000):
        got = walks.linked_components(half, chunk=chunk).collect()
        assert sorted((r["mid"], r["v"], r["component"]) for r in got) == sorted((m, v, f(v)) for m, f in want.items() for v in range(60))


def test_no_row_for_the_kernel_holds_a_pattern_of_many_components(spark, monkeypatch):
    monkeypatch.setattr(symbolic, "LINKS_AT_ONCE", 20)
    rng = np.random.default_rng(6)
    links = {(10 * k + int(min(e)), 10 * k + int(max(e))) for k in range(40) for e in rng.integers(0, 10, (14, 2)) if e[0] != e[1]}
    edges = spark.createDataFrame([("p", a, b) for a, b in links | {(b, a) for a, b in links}], "mid string, a long, b long")
    vertices = spark.createDataFrame([("p", v) for v in range(400)], "mid string, id long")
    orders = symbolic.natural_order(vertices).unionByName(symbolic.reverse_order(vertices))
    assert max(len(r["order"]) for r in symbolic._groups(edges, orders).collect()) < 200
    for candidate, name in (("natural", lambda v: v), ("reverse", lambda v: 399 - v)):
        graph = Graph.edges(400, [name(a) for a, _ in links], [name(b) for _, b in links])
        parent, counts = elimination_tree(graph), column_counts(graph)
        got = symbolic.columns(edges, orders.where(F.col("candidate") == candidate)).collect()
        assert sorted((r["j"], -1 if r["parent"] is None else r["parent"], r["c"]) for r in got) == list(zip(range(400), parent, counts))
        row = symbolic.scores(edges, orders).where(F.col("candidate") == candidate).first()
        assert tuple(row)[2:] == (400, sum(counts), sum(c * c for c in counts))


def test_levels_compute_their_edges_once(spark):
    seen = spark.sparkContext.accumulator(0)
    marked = F.udf(lambda a: seen.add(1) or a, "long")
    path = edges(spark, [(a, b) for k in range(5) for a, b in ((k, k + 1), (k + 1, k))]).withColumn("a", marked("a"))
    got = walks.levels(path, spark.createDataFrame([("m", 0)], "mid string, v long")).collect()
    assert sorted((r["v"], r["level"]) for r in got) == [(k, k) for k in range(6)]
    assert seen.value == 10


def test_candidates_by_parts(spark):
    """Four components and two vertices without links, a part each or more together: the figures of whole patterns."""
    edges = [(m, 4 * i + a, 4 * i + b) for m in "xy" for i in range(4) for a, b in ((0, 1), (1, 2), (2, 3), (3, 0))]
    both = pattern.symmetrize(spark.createDataFrame(edges, "mid string, a long, b long"))
    v = spark.range(18).crossJoin(spark.createDataFrame([("x",), ("y",)], "mid string")).select("mid", "id")
    own = {40: ("own", lambda g: list(range(g.n))[::-1]), 41: ("broken", lambda g: [0] * g.n if g.n > 1 else [0])}
    asked = spark.createDataFrame([(m, i, n) for m in "xy" for i, n in ((1, "amd"), (21, "grown dissection"), (40, "own"), (41, "broken"))], "mid string, cand_idx long, candidate string")
    whole = rows(bestof.candidate_scores(pattern.pack(both, v), asked, own=own))
    for at_once in (1, 4, 1000):
        parts = symbolic.parts(both, v, at_once)
        assert at_once == 1000 or parts.count() > 4
        assert rows(bestof.part_scores(parts, asked, own)) == whole
        assert [(r["mid"], r["n"], r["whole"], r["repeats"], r["counts_agree"], r["nnz_l"], r["natural_flops"]) for r in order_report(parts, 21).orderBy("mid").collect()] == [(m, 18, True, True, True, 38, 94) for m in "xy"]


def test_degrees_counted_by_key(spark):
    linked = spark.createDataFrame([("x", 5, 5), ("x", 5, 7), ("x", 6, 7), ("y", 9, 1)], "mid string, l long, r long")
    found = tables.numbered_with_degrees(linked)
    assert rows(found) == [("x", 0, 5, 2, 0), ("x", 0, 6, 1, 1), ("x", 1, 5, 1, 2), ("x", 1, 7, 2, 3), ("y", 0, 9, 1, 0), ("y", 1, 1, 1, 1)]
    vertices = tables.numbered(linked)
    assert rows(found.select("mid", F.col("id").alias("v"), "degree")) == rows(pattern.degrees(pattern.both_ways(tables.edge_list(linked, vertices)), vertices))


def test_few_texts_are_strings_at_once():
    """Batches of any size; before, a whole batch was a pandas series."""
    texts = pa.array([None if k % 5 == 0 else f"a{k} // b" for k in range(policy.TEXTS_AT_ONCE * 2 + 1)])
    assert policy._some_at_once(texts, str.upper).to_pylist() == [t and t.upper() for t in texts.to_pylist()]
    assert policy._some_at_once(texts[:0], str.upper).to_pylist() == []


def test_rows_of_parts_do_not_grow_with_the_part(spark, monkeypatch):
    from symgrain.operators import symbolic

    monkeypatch.setattr(symbolic, "PIECE_LINKS", 4)
    path = spark.createDataFrame([("path", i, i + 1) for i in range(200)], "mid string, a long, b long")
    both = pattern.symmetrize(path.unionByName(spark.createDataFrame([("path", 300, 301)], "mid string, a long, b long")))
    vertices = both.selectExpr("mid", "a AS id").distinct().unionByName(spark.createDataFrame([("path", 400)], "mid string, id long"))
    parts = symbolic.parts(both, vertices, 400).cache()
    assert parts.selectExpr("max(size(a)) AS most").first()["most"] < 30 and parts.select("part").distinct().count() <= 2
    row = order_report(parts, 21).first()
    assert (row["n"], row["whole"], row["nnz_l"]) == (204, True, 405)
