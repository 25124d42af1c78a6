"""SimHash near-duplicates.

A text's fingerprint has the bits that are set in over half of its shingles' hashes. Exact
copies and equal fingerprints collapse to one node first. Fingerprints that can lie within the
radius share a bucket; each bucket's fingerprints form a BK-tree (a child hangs on its parent
by their Hamming distance), and a search follows only edges within the radius of the distance
just measured. The trees of many buckets are built and searched together, level by level, in
numpy. A task links the members of each component of a bucket to its least node, and components are joined
from the distinct links. Wide fingerprints take two rounds: the second gives links only of what the first did not join.

Two ways to bucket:

``exact`` (64 bits, radius 3): of four 16-bit blocks one must be equal, and of the four 12-bit
blocks of the rest, which still differ in 3 bits at most, one more: 16 keys of 28 bits, and no
pair within the radius escapes.

``bands`` (wide fingerprints): keys of some bits drawn by a fixed seed. A pair that differs in
a share p of the bits meets with probability 1 - (1 - (1 - p)^bits)^bands; the bits grow with the
logarithm of the number of documents, and the bands with the bits. Links found there are
candidates: those of nearly equal fingerprints stand; groups that hold others are compared by
the Jaccard similarity of the whole shingle sets.

Defined results: a null text has no words and, like any wordless one, fingerprint zero, which
links like any other; fewer words than a shingle: the whole sequence is one; every row gives
one row, repeats included; a null doc_id is never a component's id unless the whole component
has none; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgrain.llm.buckets import by_cells, deal, least_linked, ranges, spanning, starts_of
from symgrain.llm.common import BROADCAST_IDS, as_stored, connected_components, materialize, trimmed

SEED = 42
#: Members of a bucket that one tree may hold.
CAP = 4096
#: 64-bit words of fingerprints that one numpy step may compare.
_VISITS = 1_000_000
#: Partitions at least for wide fingerprints: a text's bands then go to as many, whatever the input's size.
TASKS = 64
#: Wide fingerprints: standard errors by which a candidate may be farther apart than the similarity asks, and by which one must be nearer to need no verification; shingles that a set must have for that; chance of a pair to share no band.
SLACK, SURE, SURE_SHINGLES, MISS = 4.0, 5.0, 64, 0.0025
#: Members of a bucket that chance alone may bring together, and the fewest bits of a band.
OCCUPANCY, BAND_BITS = 64, 14
#: Bands that are searched before the others.
FIRST_BANDS = 8
#: Members and bytes of a block of shingle sets; a cell holds two blocks.
SET_CAP, SET_BYTES = 2048, 16 << 20
_LANES = np.uint64(0x0101010101010101)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at the six ASCII white-space characters (what bytes.lower and bytes.split do)."""
    return (text or "").encode().lower().split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    if not words:
        return np.empty(0, np.uint64)
    one = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([one(b" ".join(words), SEED)], np.uint64)
    columns = [words[k : len(words) - size + 1 + k] for k in range(size)]
    return np.array([one(s, SEED) for s in map(b" ".join, zip(*columns, strict=True))], np.uint64)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit; byte lanes of 255 hashes are added at a time."""
    rest = -len(hashes) % 255
    padded = np.concatenate([hashes, np.zeros(rest, np.uint64)]).reshape(-1, 255)
    counts = np.empty(64, np.int64)
    for shift in range(8):
        lanes = ((padded >> np.uint64(shift)) & _LANES).sum(axis=1, dtype=np.uint64)
        counts[shift::8] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0)
    return counts


def fingerprint(hashes: np.ndarray, words: int = 1) -> bytes:
    """words x 64 bits, each word little-endian; further words come from re-mixed hashes."""
    if not len(hashes):
        return bytes(8 * words)
    out = []
    for k in range(words):
        h = hashes
        if k:
            h = (h ^ np.uint64(k * 0x632BE59BD9B4E019 & (2**64 - 1))) * _MIX
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
        out.append(np.packbits(_bit_counts(h) * 2 > len(h), bitorder="little").tobytes())
    return b"".join(out)


def fingerprints(docs: DataFrame, shingle: int, words: int = 1, distinct: bool = False) -> DataFrame:
    """(doc_id, print binary, shingles int) of every row; distinct: a shingle that a text repeats counts once."""

    @trimmed
    def run(batches):
        for batch in batches:
            out, sizes = [], []
            for text in batch.column(1).to_pylist():
                hashes = shingle_hashes(words_of(text), shingle)
                hashes = np.unique(hashes) if distinct else hashes
                out.append(fingerprint(hashes, words))
                sizes.append(len(hashes))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(sizes, pa.int32()), batch.column(2)], ["doc_id", "print", "shingles", "place"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("place")).mapInArrow(run, "doc_id long, print binary, shingles int, place long")


def bk_forest(prints: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parent and edge of each fingerprint; roots: the first place of its tree. A parent's place is always lower."""
    wide = 64 * prints.shape[1] + 1
    parent, edge = np.full(len(roots), -1), np.zeros(len(roots), np.int64)
    open_ = np.flatnonzero(roots != np.arange(len(roots)))
    at = roots[open_]
    while len(open_):
        away = np.bitwise_count(prints[open_] ^ prints[at]).sum(axis=1, dtype=np.int64)
        _, first, of = np.unique(at * wide + away, return_index=True, return_inverse=True)
        new = open_[first]
        parent[new], edge[new] = at[first], away[first]
        stays = np.ones(len(open_), bool)
        stays[first] = False
        open_, at = open_[stays], new[of][stays]
    return parent, edge


def bk_links(prints: np.ndarray, roots: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each fingerprint the first place of its component, over links within the radius in the same tree; and links (place, place, distance) that join the components, nearer ones preferred."""
    parent, edge = bk_forest(prints, roots)
    wide = 64 * prints.shape[1] + 1
    keys = np.where(parent < 0, -1, parent * wide + edge)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    labels, used = np.arange(len(roots)), []
    asks = np.flatnonzero(roots != labels)
    step = max(20_000 // prints.shape[1], 1)
    for begin in range(0, len(asks), step):
        pending, found = [(asks[begin : begin + step], roots[asks[begin : begin + step]])], []
        while pending:
            ask, node = pending.pop()
            away = np.bitwise_count(prints[ask] ^ prints[node]).sum(axis=1, dtype=np.int64)
            near = (away <= radius) & (labels[ask] != labels[node])
            found.append((ask[near], node[near], away[near]))
            if sum(len(f[0]) for f in found) > _VISITS:
                a, b, d = (np.concatenate(x) for x in zip(*found, strict=True))
                nearest = np.argsort(d, kind="stable")
                a, b, d = a[nearest], b[nearest], d[nearest]
                labels, pick = spanning(labels, a, b)
                used.append((a[pick], b[pick], d[pick]))
                found = []
            low = np.searchsorted(keys, node * wide + np.maximum(away - radius, 0))
            high = np.searchsorted(keys, node * wide + np.minimum(away + radius, wide - 1), side="right")
            for cut in _cuts((high - low) * prints.shape[1]):
                child, of = ranges(low[cut], high[cut])
                child, who = order[child], ask[cut][of]
                earlier = child < who  # the other half finds the same links
                if earlier.any():
                    pending.append((who[earlier], child[earlier]))
        if found:
            a, b, d = (np.concatenate(x) for x in zip(*found, strict=True))
            labels, pick = spanning(labels, a, b)
            used.append((a[pick], b[pick], d[pick]))
    empty = np.empty(0, np.int64)
    return labels, *(np.concatenate([empty, *x]) for x in (zip(*used, strict=True) if used else [()] * 3))


def _cuts(sizes: np.ndarray) -> list[slice]:
    """Slices of places whose sizes add up to about _VISITS each."""
    if not len(sizes):
        return []
    part = np.cumsum(sizes) // _VISITS
    at = np.flatnonzero(np.diff(part)) + 1
    return [slice(a, b) for a, b in zip([0, *at], [*at, len(sizes)], strict=True)]


def stars(labels: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Of each place the least node of its component; labels: the first place of it."""
    least = np.full(len(labels), np.iinfo(np.int64).max)
    np.minimum.at(least, labels, nodes)
    return least[labels]


def _links(dealt: DataFrame, radius: int, words: int, sure: int | None = None) -> DataFrame:
    """(a, b, stands) links of nodes that join what lies within the radius; dealt: cell, node long, print binary, shingles int, strong long, loose long.

    strong and loose name what a node is joined to already, by links that stand and by any: the
    least node of each. What links of up to ``sure`` bits between nodes of SURE_SHINGLES or more join
    (all links, if none is named) is linked by links that stand, strong to the least strong; what
    only others join, by links that do not stand, loose to the least loose. What is joined already
    gives no link.
    """

    @trimmed
    def run(batches):
        def handle(cells, rows):
            nodes, strong, loose = (rows.column(c).to_numpy() for c in ("node", "strong", "loose"))
            prints = np.frombuffer(b"".join(rows.column("print").to_pylist()), "<u8").reshape(-1, words)
            starts = starts_of(cells)
            labels, a, b, away = bk_links(prints, starts, radius)
            places, stands = np.arange(len(nodes)), np.ones(len(a), bool)
            if sure is not None:
                sizes = rows.column("shingles").to_numpy()
                stands = (away <= sure) & (np.minimum(sizes[a], sizes[b]) >= SURE_SHINGLES)
            near = least_linked(places, *_together(starts, strong))
            near = least_linked(near, a[stands], b[stands])
            half = least_linked(near.copy(), *_together(starts, loose))
            whole = least_linked(half.copy(), a, b)
            ends = np.unique(np.stack([strong, stars(near, strong)]), axis=1), np.unique(np.stack([stars(half, loose), stars(whole, loose)]), axis=1)
            ends = [x[:, x[0] != x[1]] for x in ends]
            low, high = np.concatenate(ends, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), pa.array(np.arange(len(low)) < ends[0].shape[1])], ["a", "b", "stands"])

        yield from by_cells(batches, handle, rows=60_000 // words)

    return dealt.select("cell", "node", "print", "shingles", "strong", "loose").mapInArrow(run, "a long, b long, stands boolean").distinct()


def _together(starts: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (place, place) of what has one name within a cell; starts: the first place of each place's cell."""
    order = np.lexsort((names, starts))
    same = (starts[order][1:] == starts[order][:-1]) & (names[order][1:] == names[order][:-1])
    return order[:-1][same], order[1:][same]


def _joined(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """nodes with the least node that links (a, b, stands) join each to: ``strong`` by those that stand, ``loose`` by any. One run finds both, of doubled numbers, odd for those that stand."""
    twice = lambda rows, odd: rows.select(*[(F.col(c) * 2 + odd).alias(c) for c in ("a", "b")])
    ends = connected_components(twice(found, 0).unionByName(twice(found.where("stands"), 1)))
    for name, odd in (("loose", 0), ("strong", 1)):
        part = ends.where(F.col("node").bitwiseAND(F.lit(1)) == odd).select(F.shiftright("node", 1).alias("node"), F.shiftright("component", 1).alias(name))
        nodes = nodes.join(part, "node", "left").withColumn(name, F.coalesce(name, "node"))
    return nodes


def _exact_keys(node: Column) -> Column:
    """The 16 keys of a 64-bit fingerprint for radius 3."""
    keys = []
    for a in range(4):
        block = F.shiftrightunsigned(node, 16 * a).bitwiseAND(F.lit(0xFFFF))
        rest = [16 * b for b in range(4) if b != a]
        low48 = [F.shiftrightunsigned(node, s).bitwiseAND(F.lit(0xFFFF)) for s in rest]
        packed = low48[0].bitwiseOR(F.shiftleft(low48[1], 16)).bitwiseOR(F.shiftleft(low48[2], 32))
        for b in range(4):
            part = F.shiftrightunsigned(packed, 12 * b).bitwiseAND(F.lit(0xFFF))
            keys.append(F.lit(4 * a + b).cast("long") * (1 << 28) + block * (1 << 12) + part)
    return F.array(*keys)


def _by_row(rows: DataFrame, nodes: DataFrame, named: DataFrame, on: list[str]) -> DataFrame:
    """doc_id, what names the node, component_id of each row. The nodes' components are written first: the one join that meets a hot node's rows is then between plain exchanges, which adaptive execution can split."""
    resolved = materialize(nodes.select("node", "least", *[c for c in on if c != "node"]).join(named, "node", "left").select(*on, F.coalesce("component_id", "least").alias("component_id")), "simhash-components")
    return rows.select("doc_id", *on).join(resolved, on)


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 3, cap: int = CAP) -> DataFrame:
    """doc_id, fingerprint (hex), component_id over links of 64-bit fingerprints within radius (3 at most)."""
    if radius > 3:
        raise ValueError("the 16 keys find pairs within 3 bits; use near_duplicates for more")
    prints = fingerprints(docs, shingle)
    rows = materialize(prints.select("doc_id", _signed(F.hex("print")).alias("node")), "simhash-prints")
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("least"))
    keyed = nodes.select("node", F.explode(_exact_keys(F.col("node"))).alias("key"))
    dealt = deal(keyed, cap).select("cell", "node", _bytes_of("node").alias("print"), F.lit(0).alias("shingles"), F.col("node").alias("strong"), F.col("node").alias("loose"))
    components = connected_components(_links(dealt, radius, 1).select("a", "b"))
    named = nodes.join(components, "node")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("node", "component_id")
    return _by_row(rows, nodes, named, ["node"]).select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")


def _signed(hex_little: Column) -> Column:
    """The long whose little-endian bytes the hex digits give."""
    big = F.concat(*[F.substring(hex_little, 15 - 2 * k, 2) for k in range(8)])
    return F.conv(big, 16, -10).cast("long")


def _bytes_of(node: str) -> Column:
    """A long's little-endian bytes."""
    big = F.lpad(F.hex(node), 16, "0")
    return F.unhex(F.concat(*[F.substring(big, 15 - 2 * k, 2) for k in range(8)]))


def _agreement(similarity: float) -> float:
    """The share of equal SimHash bits of two sets with this Jaccard similarity (equal sizes, the worst case)."""
    return 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi


def band_plan(documents: int, agree: float) -> tuple[int, int]:
    """Bits of a band and number of bands: chance fills a bucket with OCCUPANCY documents at most, and a pair that agrees in that share of the bits shares no band with probability MISS."""
    bits = max(BAND_BITS, math.ceil(math.log2(max(documents, 1) / OCCUPANCY)))
    return bits, math.ceil(math.log(MISS) / math.log1p(-(agree**bits)))


def _banded(classes: DataFrame, words: int, band_bits: int, bands: int, seed: int) -> DataFrame:
    """classes (k1, k2, node, least, place, shingles, print) with keys array<long>, one of each band."""
    bits, drawn = 64 * words, np.random.default_rng(seed)
    chosen = np.concatenate([drawn.permutation(bits) for _ in range(-(-band_bits * bands // bits))])[: band_bits * bands].reshape(bands, band_bits)
    weights = (1 << np.arange(band_bits)).astype(np.int64)

    @trimmed
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                raw = part.column("print").to_pylist()
                spread = np.unpackbits(np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1), axis=1, bitorder="little")
                keys = (spread[:, chosen].astype(np.int64) @ weights) | (np.arange(bands, dtype=np.int64) << band_bits)
                offsets = pa.array(np.arange(len(raw) + 1, dtype=np.int32) * bands)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))], [*part.schema.names, "keys"])

    return classes.select("k1", "k2", "node", "least", "place", "shingles", "print").mapInArrow(run, "k1 long, k2 long, node long, least long, place long, shingles int, print binary, keys array<long>")


def true_links(sets: list[np.ndarray], starts: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (place, place) that join all sets of one cell (starts: its first place) that are similar enough, directly or by others. A set is compared with all of its cell that it is not joined to yet and that are of a size that can do."""
    sizes = np.fromiter(map(len, sets), np.int64, count=len(sets))
    values, ids = np.unique(np.concatenate(sets) if sets else np.empty(0, np.uint32), return_inverse=True)
    begin, marked = np.concatenate([[0], np.cumsum(sizes)]), np.zeros(len(values), bool)
    labels, links = np.arange(len(sets)), ([np.empty(0, np.int64)], [np.empty(0, np.int64)])
    ends = np.searchsorted(starts, starts, side="right")
    for a in range(len(sets)):
        others = np.arange(a + 1, ends[a])
        others = others[(labels[others] != labels[a]) & (np.minimum(sizes[others], sizes[a]) >= similarity * np.maximum(sizes[others], sizes[a])) & (sizes[others] > 0)]
        marked[ids[begin[a] : begin[a + 1]]] = True
        for cut in _cuts(sizes[others]):
            some = others[cut]
            at, _ = ranges(begin[some], begin[some + 1])
            shared = np.add.reduceat(marked[ids[at]], np.cumsum(sizes[some]) - sizes[some], dtype=np.int64)
            some = some[shared >= similarity * (sizes[some] + sizes[a] - shared)]
            labels, pick = spanning(labels, np.full(len(some), a), some)
            links[0].append(np.full(len(pick), a))
            links[1].append(some[pick])
        marked[ids[begin[a] : begin[a + 1]]] = False
    return np.concatenate(links[0]), np.concatenate(links[1])


def _verified(docs: DataFrame, nodes: DataFrame, grouped: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) that join the nodes of each group whose shingle sets have that Jaccard similarity; grouped: (node, group). One text of each node is read. Its set (32 bits a shingle) goes to the cell of its group, or to several where the group is cut into blocks, by members and by bytes."""
    asked = materialize(grouped.join(nodes.select("node", "place"), "node"), "simhash-asked")
    placed = docs.select("text", F.monotonically_increasing_id().alias("place"))
    texts = placed.join(F.broadcast(asked) if asked.count() <= BROADCAST_IDS else asked.hint("merge"), "place").select("node", "group", "text")

    @trimmed
    def read(batches):
        for batch in batches:
            sets = [np.unique(shingle_hashes(words_of(text), shingle).astype(np.uint32)) for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([s.nbytes for s in sets], pa.int64())], ["node", "group", "shingles", "bytes"])

    @trimmed
    def compare(batches):
        def handle(cells, rows):
            nodes = rows.column("node").to_numpy()
            a, b = true_links([np.frombuffer(x, np.uint32) for x in rows.column("shingles").to_pylist()], starts_of(cells), similarity)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], ["a", "b"])

        yield from by_cells(batches, handle, rows=2 * SET_CAP)

    sets = materialize(texts.mapInArrow(read, "node long, group long, shingles binary, bytes long"), "simhash-sets")
    dealt = deal(sets, SET_CAP, key="group", tasks=TASKS, weight="bytes", most=SET_BYTES)
    return dealt.select("cell", "node", "shingles").mapInArrow(compare, "a long, b long").distinct()


def _band_links(known: DataFrame, keys: Column, radius: int, words: int, sure: int, cap: int) -> DataFrame:
    """_links of these keys; known: nodes with strong and loose."""
    keyed = known.select("node", "print", "shingles", "strong", "loose", F.explode(keys).alias("key"))
    return materialize(_links(deal(keyed, cap, tasks=TASKS), radius, words, sure), "simhash-found")


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, words: int = 8, cap: int = CAP, seed: int = 7) -> DataFrame:
    """(doc_id, component_id): documents linked by sets of distinct shingles with that Jaccard similarity.

    Candidates are fingerprints that share a band and lie within the radius: that of the
    similarity plus SLACK standard errors. Each bucket gives links that suffice to join its
    candidates, nearest first; together they give the groups that candidates can form at all.
    Links nearer than the similarity asks by SURE standard errors stand. A group that holds any
    other is compared within by the shingle sets themselves, so no similar pair of it depends on which
    links a bucket happened to give. Recall is measured in the tests. Documents whose fingerprints are equal, of
    which 128 hashed bits are compared, are one class.
    """
    bits, agree = 64 * words, _agreement(similarity)
    error = math.sqrt(bits * agree * (1 - agree))
    radius, sure = round(bits * (1 - agree) + SLACK * error), round(bits * (1 - agree) - SURE * error)

    docs = as_stored(docs, "simhash-docs")
    prints = fingerprints(docs, shingle, words, distinct=True)
    rows = materialize(prints.withColumns({"k1": F.xxhash64("print"), "k2": F.xxhash64(F.reverse(F.hex("print")))}), "simhash-wide")
    classes = rows.groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.min("place").alias("place"), F.any_value("shingles").alias("shingles"), F.any_value("print").alias("print")).withColumn("node", F.monotonically_increasing_id())
    nodes = materialize(_banded(classes, words, *band_plan(rows.count(), agree), seed), "simhash-nodes")

    # The first bands join the large groups; the others need links only for what these left apart.
    known = nodes.withColumns({"strong": F.col("node"), "loose": F.col("node")})
    first = _band_links(known, F.slice("keys", 1, FIRST_BANDS), radius, words, sure, cap)
    known = _joined(nodes, first)
    second = _band_links(known, F.slice("keys", FIRST_BANDS + 1, 1 << 20), radius, words, sure, cap)
    star = lambda name, stands: known.where(F.col("node") != F.col(name)).select(F.col("node").alias("a"), F.col(name).alias("b"), F.lit(stands).alias("stands"))
    grouped = _joined(nodes, second.unionByName(star("strong", True)).unionByName(star("loose", False))).select("node", "strong", F.col("loose").alias("group"))
    grouped = materialize(grouped, "simhash-groups")
    unsure = materialize(first.unionByName(second).where("NOT stands").select(F.col("a").alias("node")).distinct().join(grouped, "node").select("group").distinct(), "simhash-unsure")
    stand = grouped.where("node <> strong").select(F.col("node").alias("a"), F.col("strong").alias("b"))
    links = stand.unionByName(_verified(docs, nodes, grouped.select("node", "group").join(unsure, "group"), shingle, similarity))
    components = connected_components(materialize(links, "simhash-links"))
    named = nodes.select("node", "least").join(components, "node")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("node", "component_id")
    return _by_row(rows, nodes, named, ["k1", "k2"]).select("doc_id", "component_id")
