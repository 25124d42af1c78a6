"""Near-duplicate embeddings by cross-polytope hashing.

A vector is rotated fast (three rounds of random signs and a Hadamard transform); its hash is
the axis that it then lies nearest to, with the sign. A table joins two such hashes. Multiprobe:
each vector also enters the buckets that the second-nearest axis of either hash gives. Members
of a bucket are compared in double precision, so every link is verified.

Equal vectors with equal labels collapse to one class first, those that can link at all. A pair
counts only in the first bucket in which it meets, so tasks return sums and one link per member,
never pairs. A bucket of more than ``cap`` members is cut into blocks whose pairs go to
different tasks.

Hashes per table grow with the logarithm of the number of vectors, so that chance fills a bucket
with some OCCUPANCY members at most, and tables with the hashes. Measured in 64 dimensions, a
pair at cosine 0.93 meets in a table of 1, 2, 3, 4 hashes with probability 0.88, 0.72, 0.55,
0.41; TABLES then miss fewer than one in a million. Recall is measured in the tests.

Defined results: vectors that are null, zero, empty, or hold null or non-finite components, and
rows without label or vec_id, link with nothing: n_links 0, their own component (null without a
vec_id, and then kept is null); vectors of different lengths do not link; rows that repeat a
vec_id are separate vectors; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgrain.llm.buckets import by_cells, deal, least_linked, ranges, starts_of
from symgrain.llm.common import connected_components, materialize, trimmed

#: Tables by hashes per table.
TABLES = {1: 7, 2: 12, 3: 18, 4: 28}
OCCUPANCY, CAP = 64, 2048
#: Pairs that one numpy step may hold, and the cell size from which blocks are multiplied instead.
_PAIRS, _LARGE = 200_000, 48


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, unscaled; the length is a power of two."""
    n, size = 1, x.shape[1]
    while n < size:
        y = x.reshape(len(x), -1, 2, n)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), size)
        n *= 2
    return x


def axes(x: np.ndarray, table: int, k: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest signed axis of each row after rotation, the second-nearest, and the gap between them."""
    signs = np.random.default_rng([seed, table, k, x.shape[1]]).choice([-1.0, 1.0], size=(3, x.shape[1]))
    for s in signs:
        x = hadamard(x * s) / np.sqrt(x.shape[1])
    away, rows = np.abs(x), np.arange(len(x))
    first = away.argmax(axis=1)
    top = away[rows, first]
    away[rows, first] = -1
    second = away.argmax(axis=1)
    code = lambda at: 2 * at + (x[rows, at] < 0)
    return code(first), code(second), top - away[rows, second]


def hashes_for(vectors: int, size: int) -> int:
    """Hashes per table for so many vectors of that length: two at least, for which a table's buckets number (2 x width) ^ hashes."""
    return next((k for k in range(2, max(TABLES)) if vectors * (k + 1) <= OCCUPANCY * (2 * _width(size)) ** k), max(TABLES))


def _width(size: int) -> int:
    return 1 << max((size - 1).bit_length(), 1)


def signatures(unit: np.ndarray, hashes: int = 2, tables: int | None = None, seed: int = 11) -> np.ndarray:
    """rows x tables x (hashes + 1) bucket numbers: all nearest axes, then each replaced by the second-nearest. A row's buckets of one table differ."""
    width, tables = _width(unit.shape[1]), tables or TABLES[hashes]
    padded = np.zeros((len(unit), width))
    padded[:, : unit.shape[1]] = unit
    out = np.empty((len(unit), tables, hashes + 1), np.int64)
    for t in range(tables):
        both = [axes(padded, t, k, seed) for k in range(hashes)]
        for p in range(hashes + 1):
            out[:, t, p] = 0
            for k, (first, second, _) in enumerate(both):
                out[:, t, p] = out[:, t, p] * 2 * width + (second if p == k + 1 else first)
    return out


def _signed(classes: DataFrame, kind: str, hashes: int, seed: int) -> DataFrame:
    """(c1, c2, node, label, n, vec, size, met): met: the buckets of each class."""

    @trimmed
    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            flat, sizes = np.asarray(lists.flatten()).astype(kind), np.diff(np.asarray(lists.offsets))
            ends = np.cumsum(sizes)
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                for start in range(0, len(rows), 1000):
                    some = rows[start : start + 1000]
                    x = flat[(ends[some] - size)[:, None] + np.arange(size)]
                    met = signatures(_unit(x), hashes, seed=seed).reshape(len(some), -1)
                    at = pa.array(some)
                    offsets = pa.array(np.arange(len(some) + 1, dtype=np.int32) * met.shape[1])
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in (0, 1, 2, 4, 5)), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(np.full(len(some), size, np.int32)), pa.ListArray.from_arrays(offsets, pa.array(met.ravel()))], ["c1", "c2", "node", "label", "n", "vec", "size", "met"])

    return classes.select("c1", "c2", "node", "embedding", "label", "n").mapInArrow(run, "c1 long, c2 int, node long, label long, n long, vec binary, size int, met array<long>")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # squares stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _linked_pairs(cells: np.ndarray, unit: np.ndarray, least: float):
    """Places (i, j), i > j, of the same cell with cosine of at least ``least``, some at a time."""
    starts, here = starts_of(cells), np.arange(len(cells))
    sizes = np.bincount(starts, minlength=len(cells))[starts]
    small = np.flatnonzero((sizes < _LARGE) & (here > starts))
    steps = np.cumsum(small - starts[small]) // _PAIRS
    for part in np.split(small, np.flatnonzero(np.diff(steps)) + 1) if len(small) else []:
        j, of = ranges(starts[part], part)
        i = part[of]
        near = np.einsum("ij,ij->i", unit[i], unit[j]) >= least
        yield i[near], j[near]
    for start in np.flatnonzero((sizes >= _LARGE) & (here == starts)):
        stop = start + sizes[start]
        for a in range(start, stop, 512):
            b = min(a + 512, stop)
            i, j = np.nonzero(unit[a:b] @ unit[start:b].T >= least)
            i, j = i + a, j + start
            below = j < i
            yield i[below], j[below]


def _cells_to_links(dealt: DataFrame, kind: str, least: float, probes: int) -> DataFrame:
    """(node, links, root): how many vectors a class links with, and a class linked with it, summed over the pairs that first meet in this cell."""

    @trimmed
    def run(batches):
        def handle(cells, rows):
            sizes = rows.column("size").to_numpy()
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                yield from compare(cells[at], rows.take(pa.array(at)).combine_chunks())

        def compare(cells, rows):
            nodes, n, table, bucket, block, label = (rows.column(c).to_numpy() for c in ("node", "n", "table", "bucket", "block", "label"))
            own = np.asarray(rows.column("own").to_pylist(), bool)
            unit = _unit(np.frombuffer(b"".join(rows.column("vec").to_pylist()), kind).reshape(len(nodes), -1))
            met = np.asarray(rows.column("met").combine_chunks().flatten()).reshape(len(nodes), -1, probes)
            labels, links = np.arange(len(nodes)), np.zeros(len(nodes), np.int64)
            for i, j in _linked_pairs(cells, unit, least):
                good = (label[i] == label[j]) & (nodes[i] != nodes[j]) & ((block[i] != block[j]) | own[i])
                i, j = i[good], j[good]
                for s in range(0, len(i), _PAIRS // 4):
                    p, q = i[s : s + _PAIRS // 4], j[s : s + _PAIRS // 4]
                    shared = (met[p][:, :, :, None] == met[q][:, :, None, :]).any(axis=3).reshape(len(p), -1)
                    # Two buckets of one table may be shared: the one that both would name first is the lesser.
                    t = shared.argmax(axis=1) // probes
                    options = np.where(shared.reshape(len(p), -1, probes)[np.arange(len(p)), t], met[p, t], np.iinfo(np.int64).max)
                    here = (t == table[p]) & (options.min(axis=1) == bucket[p])
                    p, q = p[here], q[here]
                    labels = least_linked(labels, p, q)
                    links += np.bincount(p, weights=n[q], minlength=len(nodes)).astype(np.int64) + np.bincount(q, weights=n[p], minlength=len(nodes)).astype(np.int64)
            out = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[out]), pa.array(links[out]), pa.array(nodes[labels[out]])], ["node", "links", "root"])

        yield from by_cells(batches, handle, rows=30_000)

    return dealt.select("cell", "node", "label", "vec", "size", "n", "met", "table", "bucket", "block", "own").mapInArrow(run, "node long, links long, root long")


def near_duplicates(vectors: DataFrame, least: float = 0.93, hashes: int | None = None, cap: int = CAP, seed: int = 11) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of (vec_id, embedding, label). hashes: per table; by default as many as the number of vectors asks for."""
    kind = "<f8" if vectors.schema["embedding"].dataType.elementType.simpleString() == "double" else "<f4"
    usable = F.expr("label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0 AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity')) AND exists(embedding, x -> x <> 0)")
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding").withColumn("usable", usable)
    rows = rows.withColumns({"c1": F.xxhash64("label", F.size("embedding"), "embedding"), "c2": F.hash("embedding", F.size("embedding"), "label")})
    good = rows.where("usable")
    if hashes is None:
        seen = good.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("embedding")).alias("size")).first()
        hashes = hashes_for(seen["n"], seen["size"] or 1)
    classes = good.groupBy("c1", "c2").agg(F.min("vec_id").alias("node"), F.any_value("label").alias("label"), F.any_value("embedding").alias("embedding"), F.count(F.lit(1)).alias("n"))
    classes = materialize(_signed(classes, kind, hashes, seed), "vector-classes")

    probes = hashes + 1
    keyed = classes.select("node", "label", "n", "vec", "size", "met", F.posexplode("met").alias("at", "bucket")).withColumn("table", F.expr(f"at div {probes}"))
    dealt = deal(keyed.withColumn("key", F.xxhash64("label", "size", "table", "bucket")).drop("at"), cap)
    found = materialize(_cells_to_links(dealt, kind, least, probes), "vector-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    components = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = classes.select("c1", "c2", "node", "n").join(links, "node", "left").join(components, "node", "left")
    joined = rows.select("vec_id", "usable", "c1", "c2").join(named, ["c1", "c2"], "left")
    component = F.when(F.col("usable"), F.coalesce("component", "node")).otherwise(F.col("vec_id"))
    return joined.select("vec_id", F.when(F.col("usable"), F.col("n") - 1 + F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
