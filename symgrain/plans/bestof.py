"""The best-of plan: which candidates a pattern's size admits, their orders, the cheapest.

Gates depend on (n, nnz) alone. Patterns are packed once; each admitted (pattern, candidate) is a
row of its own, dealt over all tasks, so a large pattern's candidates run side by side. A
candidate that fails or gives no order is passed over; the first is the floor and must succeed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgrain.functions import orderings
from symgrain.functions.graph import Graph
from symgrain.functions.minimum_degree import minimum_degree
from symgrain.functions.multilevel import multilevel_dissection
from symgrain.functions.orderings import by_components
from symgrain.functions.symbolic import is_order, score
from symgrain.operators.scoring import cheapest
from symgrain.operators.symbolic import part_of
from symgrain.operators.walks import dealt


def _amd(**knobs) -> Callable[[Graph], list[int]]:
    return lambda g: minimum_degree(g, **knobs)


@dataclass(frozen=True)
class Gate:
    """Admits n < max_n and min_nnz <= nnz < max_nnz; None: no bound."""

    max_n: int | None = None
    max_nnz: int | None = None
    min_nnz: int = 0


#: Candidates in order of consideration, with their gates. The last six stand in for graph-partitioning libraries.
_SMALL, _MIDDLE, _SPARSE = Gate(150_000, 130_000), Gate(60_000, 400_000), Gate(300_000, 130_000)
CANDIDATES: tuple[tuple[int, str, Callable[[Graph], list[int]], tuple[Gate, ...]], ...] = (
    (1, "amd", _amd(), (Gate(),)),
    (2, "amf a5", _amd(fill=True, dense=5.0), (Gate(250_000, 1_500_000),)),
    (3, "amd a5", _amd(dense=5.0), (_MIDDLE,)),
    (4, "amd a2", _amd(dense=2.0), (_MIDDLE,)),
    (5, "amf", _amd(fill=True), (_MIDDLE,)),
    (6, "amf a2", _amd(fill=True, dense=2.0), (_MIDDLE,)),
    (7, "amd a1", _amd(dense=1.0), (Gate(60_000, 150_000),)),
    (8, "amd a16", _amd(dense=16.0), (Gate(60_000, 150_000),)),
    (9, "amf a1", _amd(fill=True, dense=1.0), (_SPARSE,)),
    (10, "amf a16", _amd(fill=True, dense=16.0), (_SPARSE,)),
    (11, "amf all", _amd(fill=True, dense=-1.0), (_SPARSE, Gate(300_000, 1_500_000, 400_000))),
    (12, "amd calm", _amd(aggressive=False), (_SMALL,)),
    (13, "amd calm a5", _amd(aggressive=False, dense=5.0), (_SMALL,)),
    (14, "amd calm a2", _amd(aggressive=False, dense=2.0), (_SMALL,)),
    (15, "amd calm all", _amd(aggressive=False, dense=-1.0), (_SMALL,)),
    (16, "amd all", _amd(dense=-1.0), (_SMALL,)),
    (17, "rcm", orderings.reverse_cuthill_mckee, (_SMALL,)),
    (18, "sloan 2 1", lambda g: orderings.sloan(g, 2, 1), (_SMALL,)),
    (19, "sloan 1 2", lambda g: orderings.sloan(g, 1, 2), (_SMALL,)),
    (20, "nested dissection", orderings.nested_dissection, (_SMALL,)),
    (21, "grown dissection", orderings.grown_dissection, (_SMALL,)),
    (22, "minimum fill", orderings.minimum_fill, (Gate(3_000, 12_000),)),
    (23, "multilevel 4 4", multilevel_dissection, (Gate(130_000, 320_000),)),
    (24, "multilevel 16 20", lambda g: multilevel_dissection(g, 16, 20), (Gate(21_000, 120_000),)),
    (25, "multilevel 32 30", lambda g: multilevel_dissection(g, 32, 30), (Gate(8_000, 40_000),)),
    (26, "multilevel 2 8", lambda g: multilevel_dissection(g, 2, 8), (Gate(12_000, 200_000),)),
    (27, "multilevel 10 8", lambda g: multilevel_dissection(g, 10, 8), (Gate(10_000, 120_000),)),
    (28, "multilevel 8 40", lambda g: multilevel_dissection(g, 8, 40), (Gate(6_000, 50_000),)),
)
ALGORITHMS = {index: (name, make) for index, name, make, _ in CANDIDATES}
GATES = [(index, name, gate) for index, name, _, each in CANDIDATES for gate in each]


def register(name: str, make: Callable[[Graph], list[int]], *admits: Gate) -> int:
    """Adds one's own order to the candidates, behind those there are, and returns its number. make: from a graph to its vertices in order; it goes to the tasks with the plan. Without gates it is admitted always."""
    index = max(ALGORITHMS) + 1
    ALGORITHMS[index] = (name, make)
    GATES.extend((index, name, gate) for gate in admits or (Gate(),))
    return index


def gates(spark: SparkSession) -> DataFrame:
    """(cand_idx, candidate, max_n, min_nnz, max_nnz): 29 rows, and those registered."""
    rows = [(i, name, g.max_n, g.min_nnz, g.max_nnz) for i, name, g in GATES]
    return spark.createDataFrame(rows, "cand_idx long, candidate string, max_n long, min_nnz long, max_nnz long")


def admitted(matrices: DataFrame) -> DataFrame:
    """(mid, cand_idx, candidate) that each pattern's (n, nnz) admits; the gates are a fixed small table."""
    g = F.broadcast(gates(matrices.sparkSession))
    inside = (F.col("max_n").isNull() | (F.col("n") < F.col("max_n"))) & (F.col("nnz") >= F.col("min_nnz")) & (F.col("max_nnz").isNull() | (F.col("nnz") < F.col("max_nnz")))
    return matrices.join(g, inside).select("mid", "cand_idx", "candidate").distinct()


_SCORED = "mid string, cand_idx long, candidate string, n long, nnz_l long, flops long, status string, reason string"


def _tried(graph: Graph, make: Callable[[Graph], list[int]]) -> tuple:
    """(nnz_l, flops, status, reason, order) of an order that may fail."""
    try:
        order = make(graph)
        if not is_order(order, graph.n):
            return None, None, "FAIL", "not an order of the vertices", None
        return *score(graph, order), "OK", None, order
    except Exception as error:
        return None, None, "FAIL", f"{type(error).__name__}: {error}", None


def run_candidate(mid, index, name, n, col_at, rows, algorithms=ALGORITHMS):
    """One candidate on one packed pattern: a row of candidate_scores, with the order. A failure is a row that says why."""
    try:
        graph = Graph.packed(n, col_at, rows)
    except Exception as error:
        return mid, index, name, n, None, None, "FAIL", f"{type(error).__name__}: {error}", None
    return mid, index, name, n, *_tried(graph, algorithms[index][1])


def candidate_scores(packed: DataFrame, admissions: DataFrame, with_orders: bool = False, own: dict[int, tuple[str, Callable[[Graph], list[int]]]] | None = None) -> DataFrame:
    """(mid, cand_idx, candidate, n, nnz_l, flops, status, reason, and if asked the order): one kernel run per row. own: further orders by number, for this plan alone."""
    work = packed.join(admissions, "mid").select("mid", "cand_idx", "candidate", "n", "col_at", "rows").repartition("mid", "cand_idx")

    algorithms = ALGORITHMS | (own or {})  # registered ones too, by value

    def run(batches):
        kinds = [pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 3, pa.string(), pa.string(), pa.list_(pa.int64())]
        names = [c.split()[0] for c in _SCORED.split(", ")] + ["order"]
        keep = len(names) - (not with_orders)
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                out = run_candidate(*(x.as_py() for x in row), algorithms)
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in list(zip(out, kinds, strict=True))[:keep]], names[:keep])

    return work.mapInArrow(run, _SCORED + (", order array<long>" if with_orders else ""))


def part_scores(parts: DataFrame, admissions: DataFrame, own: dict[int, tuple[str, Callable[[Graph], list[int]]]] | None = None) -> DataFrame:
    """candidate_scores, without orders, of patterns given by parts as ``symbolic.parts`` does: a candidate orders component by component, and fails if it fails on one."""
    work = dealt(parts.join(admissions, "mid").select("mid", "part", "cand_idx", "candidate", "a", "b"), "mid", "part", "cand_idx")
    algorithms = ALGORITHMS | (own or {})

    def run(rows: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in _SCORED.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 3, pa.string(), pa.string()]
        mid, index, name = (rows.column(c)[0].as_py() for c in ("mid", "cand_idx", "candidate"))
        graph, make = part_of(rows)[1], algorithms[index][1]
        out = (mid, index, name, graph.n, *_tried(graph, lambda g: by_components(g, make))[:-1])
        return pa.table([pa.array([v], k) for v, k in zip(out, kinds, strict=True)], names)

    good = F.bool_and(F.col("status") == "OK")
    whole = lambda c: F.when(good, F.sum(c)).alias(c)
    return work.groupBy("mid", "part", "cand_idx", "candidate").applyInArrow(run, _SCORED).groupBy("mid", "cand_idx", "candidate").agg(F.sum("n").alias("n"), whole("nnz_l"), whole("flops"), F.when(good, "OK").otherwise("FAIL").alias("status"), F.min("reason").alias("reason"))


def best_of(packed: DataFrame, admissions: DataFrame) -> DataFrame:
    """The cheapest admitted candidate of each pattern (ties: the first), beside the floor's figures."""
    return best_scored(candidate_scores(packed, admissions))


def best_scored(scored: DataFrame) -> DataFrame:
    """The same of scored candidates, read twice."""
    best = cheapest(scored.where("status = 'OK'").drop("status", "reason"))
    floor = scored.where("cand_idx = 1").select("mid", F.col("flops").alias("base_flops"), F.col("nnz_l").alias("base_nnz_l"))
    return best.join(floor, "mid")


def orders_of(packed: DataFrame, candidates: tuple[int, ...]) -> DataFrame:
    """(mid, cand_idx, candidate, k, v) by the named candidates, whatever the gates say."""
    picked = packed.sparkSession.createDataFrame([(i, ALGORITHMS[i][0]) for i in candidates], "cand_idx long, candidate string")
    admissions = packed.select("mid").join(F.broadcast(picked))
    rows = candidate_scores(packed, admissions, with_orders=True).where("status = 'OK'")
    return rows.select("mid", "cand_idx", "candidate", F.posexplode("order").alias("k", "v")).withColumn("k", F.col("k").cast("long"))
