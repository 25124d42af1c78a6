"""All queries of the pattern engine by name; ``oracles`` holds the SQL that checks them."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgrain.functions import orderings
from symgrain.functions import symbolic as kernels
from symgrain.operators import blocks, pattern, pivots, policy, scoring, sinks, sweeps, symbolic, udtf, validate, walks
from symgrain.operators.checkpoints import cut, shared, stored
from symgrain.operators.numbering import numbered_by
from symgrain import policy_queries
from symgrain.oracles import BAD_LINES, ROUNDING
from symgrain.oracles import ORACLES as PATTERN_ORACLES
from symgrain.plans import bestof
from symgrain.sources import frames, generators, jsonl, tables

ALL = ("month", "priority", "orders")
QUERIES: dict = dict(policy_queries.QUERIES)
ORACLES = PATTERN_ORACLES | policy_queries.ORACLES


def query(f):
    QUERIES[f.__name__] = f
    return f


def _family(spark, sf_dir, families=("month",)):
    """(edges both ways, vertices) of the families."""
    linked = tables.links(spark, sf_dir, families)
    vertices = tables.numbered(linked)
    return pattern.both_ways(tables.edge_list(linked, vertices)), vertices


def _generated(edges: DataFrame):
    both = pattern.symmetrize(edges)
    return both, both.select("mid", F.col("a").alias("id")).distinct()


def _orders(edges, vertices):
    found = [symbolic.natural_order(vertices), symbolic.degree_order(pattern.degrees(edges, vertices)), symbolic.reverse_order(vertices)]
    return found[0].unionByName(found[1]).unionByName(found[2])


def _scores(spark, sf_dir, families=ALL, candidates=("natural", "degree")):
    edges, vertices = _stored_family(spark, sf_dir, families)
    return symbolic.scores(edges, _orders(edges, vertices).where(F.col("candidate").isin(*candidates)))


def _ratios(spark, sf_dir, families=ALL):
    return scoring.ratios(_scores(spark, sf_dir, families), "degree", "natural")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, ROUNDING) for n in names})


@query
def edges_symmetrize(spark, sf_dir):
    """From links given in both directions, with repeats and loops."""
    linked = tables.links(spark, sf_dir)
    once = tables.edge_list(linked, tables.numbered(linked))
    return pattern.symmetrize(once.unionByName(once.select("mid", F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(once.select("mid", "a", F.col("a").alias("b"))))


@query
def vertex_index(spark, sf_dir):
    return _family(spark, sf_dir, ALL)[1].select("mid", "kind", "key", "id")


@query
def csc_build(spark, sf_dir):
    return pattern.columns_of(*_family(spark, sf_dir)).select("mid", "col", "col_end", F.array_join(F.transform("rows", lambda x: x.cast("string")), ",").alias("rows"))


@query
def csc_roundtrip(spark, sf_dir):
    return pattern.unpack(pattern.pack(*_family(spark, sf_dir)))


@query
def csc_column(spark, sf_dir):
    """The rows of each pattern's last column."""
    packed = pattern.pack(*_family(spark, sf_dir))
    return packed.select("mid", F.explode(pattern.column(F.col("col_at"), F.col("rows"), F.col("n") - 1)).alias("row"))


@query
def upper_triangle(spark, sf_dir):
    return pattern.upper(_family(spark, sf_dir)[0])


@query
def degree_hist(spark, sf_dir):
    return pattern.degrees(*_family(spark, sf_dir, ALL)).groupBy("mid", "degree").agg(F.count(F.lit(1)).alias("vertices"))


@query
def pattern_stats(spark, sf_dir):
    return pattern.matrices(*_family(spark, sf_dir, ALL))


@query
def size_buckets(spark, sf_dir):
    sizes = pattern.matrices(*_family(spark, sf_dir, ALL))
    return sizes.groupBy(scoring.size_bucket(F.col("n")).alias("bucket")).agg(F.count(F.lit(1)).alias("matrices"))


@query
def edge_checks(spark, sf_dir):
    """Entries out of range and entries without their reverse, in patterns whose one-way links were shifted by one."""
    edges, vertices = _family(spark, sf_dir)
    shifted = edges.where("a < b").select("mid", "a", (F.col("b") + 1).alias("b"))
    sizes = vertices.groupBy("mid").agg(F.count(F.lit(1)).alias("n"))
    wide = pattern.out_of_range(shifted, sizes).groupBy("mid").agg(F.count(F.lit(1)).alias("out_of_range"))
    lone = pattern.asymmetric(shifted).groupBy("mid").agg(F.count(F.lit(1)).alias("one_way"))
    return sizes.join(wide, "mid", "left").join(lone, "mid", "left").select("mid", "n", F.coalesce("out_of_range", F.lit(0)).alias("out_of_range"), F.coalesce("one_way", F.lit(0)).alias("one_way"))


@query
def order_degree(spark, sf_dir):
    found = tables.numbered_with_degrees(tables.links(spark, sf_dir, ALL))
    return symbolic.degree_order(found.select("mid", F.col("id").alias("v"), "degree"))


@query
def order_reverse(spark, sf_dir):
    return symbolic.reverse_order(_family(spark, sf_dir, ALL)[1])


@query
def permute_edges(spark, sf_dir):
    edges, vertices = _family(spark, sf_dir)
    return symbolic.permute(edges, symbolic.degree_order(pattern.degrees(edges, vertices)))


@query
def bijection_check(spark, sf_dir):
    """Degree orders, whole and spoilt: one cut short, one with a vertex out of range, one with a vertex twice."""
    edges, vertices = _family(spark, sf_dir)
    good = symbolic.degree_order(pattern.degrees(edges, vertices))
    sizes = vertices.groupBy("mid").agg(F.count(F.lit(1)).alias("n"))
    first = F.col("k") == 0
    spoilt = [
        good.where("k > 0").withColumn("candidate", F.lit("short")),
        good.join(sizes, "mid").withColumn("v", F.when(first, F.col("n")).otherwise(F.col("v"))).drop("n").withColumn("candidate", F.lit("range")),
        good.join(good.where("k = 1").select("mid", F.col("v").alias("second")), "mid").withColumn("v", F.when(first, F.col("second")).otherwise(F.col("v"))).drop("second").withColumn("candidate", F.lit("repeat")),
    ]
    return validate.order_faults(good.unionByName(spoilt[0]).unionByName(spoilt[1]).unionByName(spoilt[2]), sizes)


@query
def determinism_check(spark, sf_dir):
    """Places where degree order differs between two runs under different partitioning (none), and from the reverse of the reverse order's mirror."""
    edges, vertices = _stored_family(spark, sf_dir)
    one = symbolic.degree_order(pattern.degrees(edges, vertices))
    two = symbolic.degree_order(pattern.degrees(edges.repartition(7, "b"), vertices.repartition(3)))
    other = symbolic.reverse_order(vertices).withColumn("candidate", F.lit("degree"))
    rows = validate.differing(one, two).select("mid", F.lit("again").alias("run")).unionByName(validate.differing(one, other).select("mid", F.lit("reverse").alias("run")))
    return rows.groupBy("mid", "run").agg(F.count(F.lit(1)).alias("differences"))


@query
def run_status(spark, sf_dir):
    """A run fails with its first bad pattern: here the first, by name, whose most links at one vertex exceed 30."""
    sizes = pattern.matrices(*_family(spark, sf_dir))
    outcomes = sizes.select(F.col("mid").alias("seq"), F.when(F.col("max_degree") > 30, F.concat(F.lit("degree too high: "), "mid")).alias("reason"))
    return validate.run_status(outcomes)


@query
def etree_parent(spark, sf_dir):
    edges, vertices = _stored_family(spark, sf_dir)
    return symbolic.columns(edges, symbolic.natural_order(vertices)).select("mid", "j", F.coalesce("parent", F.lit(-1)).alias("parent"))


@query
def column_counts(spark, sf_dir):
    edges, vertices = _stored_family(spark, sf_dir)
    return symbolic.columns(edges, symbolic.natural_order(vertices)).select("mid", "j", "c")


@query
def column_counts_relational(spark, sf_dir):
    """By paths, on the priority family, whose paths are short."""
    edges, vertices = _family(spark, sf_dir, ("priority",))
    return symbolic.columns_by_paths(edges, vertices).withColumn("parent", F.coalesce("parent", F.lit(-1)))


@query
def score_natural(spark, sf_dir):
    return _scores(spark, sf_dir, ALL, ("natural",)).drop("candidate")


@query
def score_degree(spark, sf_dir):
    return _scores(spark, sf_dir, ALL, ("degree",)).drop("candidate")


@query
def flop_ratio(spark, sf_dir):
    return _rounded(_ratios(spark, sf_dir), "flop_ratio", "fill_ratio")


@query
def bucket_geomean(spark, sf_dir):
    return _rounded(scoring.bucket_means(_ratios(spark, sf_dir)).drop("place"), "flop_geomean", "fill_geomean")


@query
def weighted_score(spark, sf_dir):
    return _rounded(scoring.combine(scoring.bucket_means(_ratios(spark, sf_dir))), "score", "fill")


@query
def weighted_score_missing_bucket(spark, sf_dir):
    return _rounded(scoring.combine(scoring.bucket_means(_ratios(spark, sf_dir, ("month",)))), "score", "fill")


@query
def bestof_argmin(spark, sf_dir):
    scored = _scores(spark, sf_dir, ("month",), ("natural", "degree", "reverse"))
    ranked = scored.withColumn("cand_idx", F.expr("cast(array_position(array('natural', 'degree', 'reverse'), candidate) as bigint)"))
    return scoring.cheapest(ranked).select("mid", "candidate", "cand_idx", "flops")


@query
def gate_admission(spark, sf_dir):
    return bestof.admitted(pattern.matrices(*_family(spark, sf_dir, ALL)))


def _nations(spark, sf_dir):
    """One pattern: regions, their nations, the nations' customers and suppliers; vertices numbered by kind and key."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    nation = read("nation")
    edges = nation.select(F.col("n_regionkey").cast("long").alias("a"), (F.col("n_nationkey") + 100).cast("long").alias("b"))
    edges = edges.unionByName(read("customer").select((F.col("c_nationkey") + 100).cast("long").alias("a"), (F.col("c_custkey") * 2 + 1000).alias("b")))
    edges = edges.unionByName(read("supplier").select((F.col("s_nationkey") + 100).cast("long").alias("a"), (F.col("s_suppkey") * 2 + 1001).alias("b")))
    return _generated(edges.withColumn("mid", F.lit("nations")))


@query
def bfs_levels(spark, sf_dir):
    """Distance from region 0."""
    edges, _ = _nations(spark, sf_dir)
    starts = spark.createDataFrame([("nations", 0)], "mid string, v long")
    return walks.levels(edges, starts)


@query
def components(spark, sf_dir):
    edges, vertices = _nations(spark, sf_dir)
    return walks.components(edges, vertices)


@query
def median_level_split(spark, sf_dir):
    edges, vertices = _stored_family(spark, sf_dir)
    starts = vertices.where("id = 0").select("mid", F.col("id").alias("v"))
    return walks.median_level(walks.levels(edges, starts))


def _halves(vertices):
    return vertices.select("mid", F.col("id").alias("v"), (F.col("id") % 3 == 0).alias("side"))


@query
def cut_boundary(spark, sf_dir):
    edges, vertices = _family(spark, sf_dir)
    return walks.border(edges, _halves(vertices))


@query
def subset_gain(spark, sf_dir):
    edges, vertices = _family(spark, sf_dir)
    return walks.gains(edges, _halves(vertices))


@query
def deficiency_first_pivot(spark, sf_dir):
    edges, vertices = _stored_family(spark, sf_dir)
    return walks.first_pivot(walks.lacks(edges, vertices))


def _closed(spark, make):
    edges, vertices = _generated(make)
    return symbolic.scores(edges, symbolic.natural_order(vertices)).drop("candidate")


@query
def arrow_score(spark, sf_dir):
    """The hub first, then the hub last."""
    edges, vertices = _generated(generators.arrow(spark, 50).unionByName(generators.arrow(spark, 200)))
    sizes = vertices.groupBy("mid").agg(F.count(F.lit(1)).alias("n"))
    last = vertices.join(sizes, "mid").select("mid", F.lit("hub last").alias("candidate"), F.expr("(id + n - 1) % n").alias("k"), F.col("id").alias("v"))
    return symbolic.scores(edges, symbolic.natural_order(vertices).unionByName(last))


@query
def grid2d_score(spark, sf_dir):
    return _closed(spark, generators.grid2d(spark, 10))


@query
def grid3d_score(spark, sf_dir):
    return _closed(spark, generators.grid3d(spark, 4))


@query
def kkt_score(spark, sf_dir):
    return _closed(spark, generators.kkt(spark, 600, 200, 42))


def _texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("d"), "doc_id").alias("path"), "text")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("p"), "page_id").alias("path"), F.col("html").alias("text"))
    return docs.unionByName(pages)


@query
def text_forbidden_words(spark, sf_dir):
    """Lines of documents and pages that hold one of some words as a whole word."""
    rows = policy.lines_of(_texts(spark, sf_dir))
    return rows.where(policy.has_word(F.col("content"), "(license|License|idiot|script)")).groupBy("path").agg(F.count(F.lit(1)).alias("lines"), F.min("line").cast("long").alias("first_line"))


@query
def matrix_table(spark, sf_dir):
    sizes = pattern.matrices(*_family(spark, sf_dir, ALL)).select("mid", "nnz")
    return sinks.matrix_table(_ratios(spark, sf_dir).join(sizes, "mid"))


@query
def bucket_report(spark, sf_dir):
    return sinks.bucket_report(scoring.bucket_means(_ratios(spark, sf_dir, ("month",))))


@query
def score_json(spark, sf_dir):
    means = scoring.bucket_means(_ratios(spark, sf_dir, ("month",)))
    return sinks.score_document(means, scoring.combine(means))


@query
def run_log_row(spark, sf_dir):
    total = scoring.combine(scoring.bucket_means(_ratios(spark, sf_dir, ("month",))))
    note = sinks.composed_note(F.lit("a\tb"), F.lit("c\nd"))
    return total.select(sinks.log_line(F.lit(1_700_000_000), F.lit("OK"), F.col("score"), F.col("fill"), note).alias("line"))


_REPORT = "mid string, candidate string, n long, whole boolean, repeats boolean, counts_agree boolean, nnz_l long, flops long, natural_flops long"


def order_report(parts: DataFrame, index: int) -> DataFrame:
    """What one candidate's order, made component by component, is worth on each pattern: whether it is an order, comes out the same twice, and is scored alike by both ways to count columns; and what the natural order costs. parts: as ``symbolic.parts`` gives."""
    name, make = bestof.ALGORITHMS[index]

    def run(rows):
        graph = symbolic.part_of(rows)[1]
        n, order = graph.n, orderings.by_components(graph, make)
        moved = kernels.reordered(graph, order)
        counts = kernels.column_counts(moved)
        out = (rows.column("mid")[0].as_py(), name, n, kernels.is_order(order, n), order == orderings.by_components(graph, make), counts == kernels.column_counts_by_rows(moved), sum(counts), sum(c * c for c in counts), sum(c * c for c in kernels.column_counts(graph)))
        return pa.Table.from_pylist([dict(zip((f.split()[0] for f in _REPORT.split(", ")), out, strict=True))])

    each = walks.dealt(parts, "mid", "part").groupBy("mid", "part").applyInArrow(run, _REPORT)
    sums, all_ = [F.sum(c).alias(c) for c in ("n", "nnz_l", "flops", "natural_flops")], [F.bool_and(c).alias(c) for c in ("whole", "repeats", "counts_agree")]
    return each.groupBy("mid", "candidate").agg(*sums, *all_)


def _kernel_order(index):
    def run(spark, sf_dir):
        """Against the natural order's flops, which the SQL side computes too."""
        report = order_report(symbolic.parts(*_stored_family(spark, sf_dir)), index)
        return report.select("mid", "n", "natural_flops", "whole", "repeats", "counts_agree", (F.col("flops") <= F.col("natural_flops")).alias("no_dearer"))

    return run


for _name, _index in (("order_amd", 1), ("order_amf", 5), ("order_sloan", 18), ("order_gggp", 21), ("order_minfill", 22), ("order_multilevel", 23)):
    QUERIES[_name] = _kernel_order(_index)


@query
def order_rcm(spark, sf_dir):
    """Every vertex's place in the monthly patterns, a component at a time."""
    return sweeps.cuthill_mckee(*_stored_family(spark, sf_dir))


@query
def order_nd(spark, sf_dir):
    """Every vertex's place in the yearly patterns, a part at a time once it fits a task."""
    return sweeps.nested_dissection(*_stored_family(spark, sf_dir, ("year",)))


@query
def nested_dissection(spark, sf_dir):
    """Every vertex's place in the yearly patterns, whose parts are all split in one loop."""
    return sweeps.nested_dissection(*_stored_family(spark, sf_dir, ("year",)))


@query
def cuthill_mckee(spark, sf_dir):
    """Every vertex's place in the yearly patterns, numbered level by level."""
    return sweeps.cuthill_mckee(*_stored_family(spark, sf_dir, ("year",)))


@query
def minimum_degree(spark, sf_dir):
    """Every vertex's place in the yearly patterns, many pivots a round."""
    return pivots.minimum_degree(*_stored_family(spark, sf_dir, ("year",)))


@query
def score_minimum_degree(spark, sf_dir):
    """What that order costs, some components together."""
    edges, vertices = _stored_family(spark, sf_dir, ("year",))
    return symbolic.scores(edges, pivots.minimum_degree(edges, vertices)).drop("candidate")


def _stored_family(spark, sf_dir, families=("month",)):
    linked = stored(tables.links(spark, sf_dir, families), "links")
    vertices = stored(tables.numbered(linked), "vertices")
    return pattern.both_ways(stored(tables.edge_list(linked, vertices), "family")), vertices


@query
def score_components(spark, sf_dir):
    """Degree order of all families, connected components counted some together."""
    edges, vertices = _stored_family(spark, sf_dir, ALL)
    order = stored(symbolic.degree_order(pattern.degrees(edges, vertices)), "order")
    return symbolic.scores(edges, order).drop("candidate")


@query
def columns_dissected(spark, sf_dir):
    """The elimination tree and column counts of the dissected patterns of brands, part by part, separators last."""
    edges, vertices = _stored_family(spark, sf_dir, ("brand",))
    found = blocks.columns_by_blocks(edges, sweeps.dissected(edges, vertices, leaf=100, within=sweeps.TASK_LINKS))
    return found.select("mid", "j", F.coalesce("parent", F.lit(-1)).alias("parent"), "c")


@query
def bestof_full(spark, sf_dir):
    """The cheapest of all admitted candidates of each monthly pattern: against the floor, and against the natural and the degree order, which are none of them."""
    edges, vertices = _stored_family(spark, sf_dir)
    scored = symbolic.scores(edges, _orders(edges, vertices).where("candidate IN ('natural', 'degree')"))
    others = scored.groupBy("mid").agg(F.max(F.when(F.col("candidate") == "natural", F.col("flops"))).alias("natural_flops"), F.max(F.when(F.col("candidate") == "degree", F.col("flops"))).alias("degree_flops"))
    candidates = stored(bestof.part_scores(symbolic.parts(edges, vertices), bestof.admitted(pattern.matrices(edges, vertices))), "candidates")
    joined = bestof.best_scored(candidates).join(others, "mid")
    return joined.select("mid", "n", "natural_flops", "degree_flops", (F.col("flops") <= F.col("base_flops")).alias("at_most_floor"), (F.col("flops") <= F.least("natural_flops", "degree_flops")).alias("at_most_others"), (F.col("nnz_l") >= F.col("n")).alias("counts_diagonal"))


@query
def own_order(spark, sf_dir):
    """A run with an order of one's own: the reverse, given beside the candidates for this plan alone."""
    edges, vertices = _stored_family(spark, sf_dir)
    index = max(bestof.ALGORITHMS) + 1
    mine = vertices.select("mid").distinct().select("mid", F.lit(index).cast("long").alias("cand_idx"), F.lit("backwards").alias("candidate"))
    scored = bestof.part_scores(symbolic.parts(edges, vertices), mine, own={index: ("backwards", orderings.backwards)})
    return scored.select("mid", "candidate", "n", "nnz_l", "flops", "status")


@query
def order_by_sql(spark, sf_dir):
    """Reverse Cuthill-McKee as a table function, called by SQL text on the components of the monthly patterns, of which those of higher numbers come first."""
    name = f"rcm_{uuid.uuid4().hex}"
    udtf.register_part_order(spark, name, orderings.reverse_cuthill_mckee)
    parts = symbolic.parts(*_stored_family(spark, sf_dir))
    found = spark.sql(f"SELECT mid, -component AS place, posexplode(vs) AS (at, v) FROM {name}(TABLE({{parts}}) PARTITION BY (mid, part))", parts=parts)
    placed = numbered_by(found, "mid", ["place", "at"], "k").select("mid", "k", "v")
    spark.sql(f"DROP TEMPORARY FUNCTION {name}")
    return placed


@query
def frames_roundtrip(spark, sf_dir):
    """The entries of the monthly patterns, written as binary files, one for each, and read back."""
    frames.register_frames(spark)
    path = f"{shared(spark).rstrip('/')}/frames-{uuid.uuid4().hex}"
    parts = pattern.pieces(*_stored_family(spark, sf_dir)).repartition("mid").sortWithinPartitions("mid", "col")
    parts.write.format("frames").option("kind", "pieces").mode("append").save(path)
    return pattern.unpack_pieces(spark.read.format("frames").option("kind", "pieces").load(path).where("fault IS NULL"))


@query
def jsonl_scan_rejects(spark, sf_dir):
    """Monthly patterns written as JSON lines and read back, with lines that are none among them."""
    path = f"{shared(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    jsonl.write(pattern.pack(*_family(spark, sf_dir)), path)
    bad = spark.createDataFrame([(i, line) for i, (line, *_) in enumerate(BAD_LINES)], "seq long, value string")
    lines = jsonl.file_order(spark.read.text(path)).withColumn("seq", F.col("seq") + 100).unionByName(bad)
    none = F.lit(-1).cast("long")
    return jsonl.parse(lines).select("mid", F.coalesce("n", none).alias("n"), F.coalesce(F.size("rows").cast("long"), none).alias("nnz"), F.coalesce("fault", F.lit("")).alias("fault"))
