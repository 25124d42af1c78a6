"""Language-model scores from a hashed maximum-entropy model.

The probability of a token is that of its class given the context, times that of its leaf given
the class and the context, times that of the token within its leaf. Classes: each of the most
frequent words has its own; the others share classes by the first two bytes of their spelling.
Leaves: in half of those of a shared class stands one frequent word each; the other words share
the other half by hash. Both softmaxes are maximum-entropy models over hashed features of the
context: the word before (bigram), the two before (trigram) and the word before that alone
(skip); for leaves the class is hashed in. Within a leaf a token has add-one probability, with
one place left for what is unknown.

Steps, each over all data:

1. Texts become chunks of some million tokens: numbers into the chunk's own vocabulary of word
   hashes (XXH64; words are told apart by their 64 bits), written once as Parquet.
2. Vocabulary counts of training documents are summed by hash.
3. Weights: in each round every task descends the gradient over its share of the training
   chunks, starting from the weights so far; the results are averaged, weighted by tokens, in a
   tree of bounded fan-in. The tables of weights grow with the vocabulary, up to MOST_ROWS.
4. The counts go back to the chunks that hold the word, and each chunk is scored in numpy
   batches.

Defined results: a null or empty text has the end token alone; a null doc_id counts as training;
every row gives one row, repeats included; without training tokens every token is unknown; an
empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgrain.llm.common import materialize, trimmed

HEAD, TAIL = 32, 16
CLASSES = HEAD + TAIL
#: Rows of a table of weights: these at least, then as many as a WORDS_PER_ROW-th of the vocabulary asks for, up to what a worker can hold.
ROWS, WORDS_PER_ROW, MOST_ROWS = 1 << 15, 128, 1 << 18
#: Leaves of a shared class for a vocabulary of LEAF_WORDS; they double when it grows sixteenfold.
LEAVES, LEAF_WORDS = 32, 1 << 20
CHUNK_TOKENS, CHUNK_WORDS, CHUNKS_PER_TASK = 4_000_000, 600_000, 2
#: FIRST: what the sums of squared gradients begin with, so that a row met once takes a step by its gradient and not by its sign alone, in every round.
BATCH, RATE, FIRST, ROUNDS = 8192, 0.3, 1.0, 2
#: Rows that numpy works on at a time, which stay in the processor's cache; and how far from zero no exponential needs its row's largest taken off.
STRIDE, SAFE = 1024, 60.0
#: Tables added up at a time, and the least number of blocks that a table is cut into, of BLOCK_CELLS at most.
FAN, BLOCKS, BLOCK_CELLS = 64, 8, 1 << 18
END = np.int64(np.uint64(xxhash.xxh64_intdigest(b"")).view(np.int64))
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at the six ASCII white-space characters (what bytes.lower and bytes.split do)."""
    return (text or "").encode().lower().split()


def tail_of(word: bytes) -> int:
    return xxhash.xxh32_intdigest(word[:2]) % TAIL


class _Vocabulary(dict):
    def __missing__(self, word):
        self[word] = number = len(self)
        return number


_CHUNK = "chunk long, doc_ids array<long>, held array<boolean>, sizes array<int>, low binary, high binary, vocab array<long>, tails array<int>, counts array<int>"


def chunks_of(docs: DataFrame, held_out, chunk_tokens: int = CHUNK_TOKENS, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """A row per chunk of documents; b"" stands for the end token. counts: of each word in the chunk's training documents."""

    @trimmed
    def run(batches):
        number = TaskContext.get().partitionId() << 24

        def fresh():
            return _Vocabulary({b"": 0}), [], [], []

        def row(vocab, ids, held, tokens):
            nonlocal number
            sizes = np.array([len(t) for t in tokens], np.int32)
            flat = np.concatenate(tokens)
            # Frequent words get low numbers, so most numbers' upper bytes are zero and pack well.
            rank = np.argsort(-np.bincount(flat, minlength=len(vocab)), kind="stable")
            place = np.empty(len(rank), np.uint32)
            place[rank] = np.arange(len(rank))
            flat = place[flat]
            trained = flat[~np.repeat(np.array(held, bool), sizes)]
            counts = np.bincount(trained, minlength=len(vocab)).astype(np.int32)
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in vocab], np.uint64).view(np.int64)[rank]
            tails = np.array([tail_of(w) for w in vocab], np.int32)[rank]
            values = [number, ids, held, sizes, flat.astype("<u2").tobytes(), (flat >> 16).astype("<u2").tobytes(), hashes, tails, counts]
            number += 1
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 2]
            arrays = [pa.array([v], k) if not isinstance(v, np.ndarray) else pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for v, k in zip(values, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in _CHUNK.split(", ")])

        vocab, ids, held, tokens = fresh()
        total = 0
        for batch in batches:
            for doc_id, text, out in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                words.append(b"")
                tokens.append(np.fromiter(map(vocab.__getitem__, words), np.int32, count=len(words)))
                ids.append(doc_id)
                held.append(out)
                total += len(words)
                if total >= chunk_tokens or len(vocab) >= chunk_words:
                    yield row(vocab, ids, held, tokens)
                    (vocab, ids, held, tokens), total = fresh(), 0
        if ids:
            yield row(vocab, ids, held, tokens)

    return docs.select(F.col("doc_id").cast("long"), "text", held_out.alias("held")).mapInArrow(run, _CHUNK)


def rows_for(distinct: int) -> int:
    """Rows of the table of weights for so many distinct words, a power of two."""
    return min(max(ROWS, 1 << (-(-distinct // WORDS_PER_ROW) - 1).bit_length()), MOST_ROWS) if distinct else ROWS


def leaves_for(distinct: int) -> int:
    """Leaves of a shared class for so many distinct words, a power of two."""
    return LEAVES << max(0, (-(-distinct // LEAF_WORDS) - 1).bit_length() // 4) if distinct else LEAVES


def contexts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes of each token's context: bigram, trigram, skip. starts: places where a document begins; before it stand end tokens."""
    h = hashes.view(np.uint64)
    end = np.uint64(np.int64(END).view(np.uint64))
    one = np.concatenate([[end], h[:-1]])
    two = np.concatenate([[end, end], h[:-2]])[: len(h)]
    one[starts] = end
    two[starts] = end
    after = starts + 1
    two[after[after < len(h)]] = end
    return np.stack([one * _M1, ((one * _M2) ^ (two * _M3)) * _M1, (two + _M2) * _M3])


def rows_of(keys: np.ndarray, rows: int) -> np.ndarray:
    """Hashes brought to rows of a table: their upper bits."""
    return (keys >> np.uint64(65 - rows.bit_length())).astype(np.int32)


def features(hashes: np.ndarray, starts: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """Rows of the weight table of each token's context."""
    return rows_of(contexts(hashes, starts), rows)


def leaf_rows(keys: np.ndarray, classes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Rows of the leaves' table of weights: of each context together with the class, and of the class alone (these rows stand before the bias)."""
    rows, own = len(weights) - 1 - TAIL, (classes - HEAD).astype(np.uint64)
    return np.concatenate([rows_of((keys ^ ((own + np.uint64(1)) * _M2)) * _M3, rows), (rows + classes - HEAD).astype(np.int32)[None]])


def _softmax(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    n, width = rows.shape[1], weights.shape[1]
    out, more, ones = np.empty((n, width), weights.dtype), np.empty((min(n, STRIDE), width), weights.dtype), np.ones(width, weights.dtype)
    for s in range(0, n, STRIDE):
        z = out[s : s + STRIDE]
        np.take(weights, rows[0, s : s + STRIDE], axis=0, out=z, mode="clip")
        for row in rows[1:, s : s + STRIDE]:
            z += np.take(weights, row, axis=0, out=more[: len(z)], mode="clip")
        z += weights[-1]
        if not -SAFE < z.min() <= z.max() < SAFE:
            z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z *= (1 / (z @ ones))[:, None]
    return out


def _order(row: np.ndarray, size: int) -> np.ndarray:
    """What sorts numbers below size: passes over 16 bits at a time, which numpy sorts in linear time."""
    order = np.argsort(row.astype(np.uint16), kind="stable")
    return order if size <= 1 << 16 else order[np.argsort((row >> 16).astype(np.uint16)[order], kind="stable")]


def _totals(slope: np.ndarray, order: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Sums of the slope's rows, in that order, by groups of so many. Most groups are of one or two, and a sum by groups costs as much for each of them as for a long one."""
    first = np.cumsum(times) - times
    total = slope.take(order[first], axis=0, mode="clip")
    twice, often = np.flatnonzero(times == 2), times > 2
    total[twice] += slope.take(order[first[twice] + 1], axis=0, mode="clip")
    if often.any():
        sizes = times[often]
        total[often] = np.add.reduceat(slope.take(order[np.repeat(often, times)], axis=0, mode="clip"), np.cumsum(sizes) - sizes, axis=0)
    return total


def descend(weights: np.ndarray, squares: np.ndarray, rows: np.ndarray, classes: np.ndarray) -> None:
    """One step over a batch: weights and the sums of squared gradients (Adagrad) change in place. The last row is the bias."""
    slope = _softmax(weights, rows)
    slope[np.arange(len(classes)), classes] -= 1
    for row in rows:
        order = _order(row, len(weights))
        at = row[order]
        ends = np.append(np.flatnonzero(at[1:] != at[:-1]) + 1, len(at))
        begins = np.concatenate([[0], ends[:-1]])
        for s in range(0, len(ends), STRIDE):
            begin, end = begins[s : s + STRIDE], ends[s : s + STRIDE]
            some, total = at[begin].astype(np.intp), _totals(slope, order[begin[0] : end[-1]], end - begin)
            square = total * total
            square += squares.take(some, axis=0, mode="clip")
            squares[some] = square
            np.sqrt(square, out=square)
            total *= RATE
            total /= square
            weights[some] = np.subtract(weights.take(some, axis=0, mode="clip"), total, out=total)
    total = slope.sum(axis=0)
    squares[-1] += total * total
    weights[-1] -= RATE * total / np.sqrt(squares[-1])


def classes_of(vocab: np.ndarray, tails: np.ndarray, head: np.ndarray) -> np.ndarray:
    """The class of each word; head: the hashes of the words that have their own, in order."""
    order = np.argsort(head)
    slot = np.minimum(np.searchsorted(head[order], vocab), max(len(head) - 1, 0))
    own = head[order][slot] == vocab if len(head) else np.zeros(len(vocab), bool)
    return np.where(own, order[slot] if len(head) else 0, HEAD + tails).astype(np.int64)


def leaves_of(vocab: np.ndarray, classes: np.ndarray, own: np.ndarray, place: np.ndarray, leaves: int) -> np.ndarray:
    """The leaf of each word within its class; own: the hashes, ascending, of the words that have their own, place: which."""
    half = leaves // 2
    found = half + (vocab & (half - 1))
    if len(own):
        slot = np.minimum(np.searchsorted(own, vocab), len(own) - 1)
        found = np.where(own[slot] == vocab, place[slot], found)
    return np.where(classes < HEAD, 0, found)


def _column(batch, name, at):
    start, stop = batch.column(name).offsets[at].as_py(), batch.column(name).offsets[at + 1].as_py()
    return batch.column(name).values.slice(start, stop - start)


def _tokens(batch, at) -> np.ndarray:
    """A chunk's words by number."""
    low, high = (np.frombuffer(batch.column(c)[at].as_py(), "<u2") for c in ("low", "high"))
    return low.astype(np.int32) | (high.astype(np.int32) << 16)


def _average(chunks: DataFrame, weights, head: np.ndarray, own: np.ndarray, place: np.ndarray):
    """Descends over all training tokens of the chunks from the given weights (of classes, of leaves); returns the tasks' average. Steps travel in half precision, sums are made in double."""
    spark = chunks.sparkSession
    shared = spark.sparkContext.broadcast((weights, head, own, place))
    blocks = max(BLOCKS, -(-sum(w.size for w in weights) // BLOCK_CELLS))

    @trimmed
    def run(batches):
        start, heads, words, places = shared.value
        first, second = (w.copy() for w in start)
        squares, squares2, seen = np.full(first.shape, FIRST, np.float32), np.full(second.shape, FIRST, np.float32), 0
        for batch in batches:
            for at in range(batch.num_rows):
                vocab, tails, sizes = (np.asarray(_column(batch, c, at)) for c in ("vocab", "tails", "sizes"))
                tokens = _tokens(batch, at)
                held = np.asarray(_column(batch, "held", at).to_pylist(), bool)
                classes, starts = classes_of(vocab, tails, heads), np.cumsum(sizes) - sizes
                leaves = leaves_of(vocab, classes, words, places, second.shape[1])
                keys, trained = contexts(vocab[tokens], starts), np.flatnonzero(~np.repeat(held, sizes))
                for s in range(0, len(trained), BATCH):
                    some = trained[s : s + BATCH]
                    descend(first, squares, rows_of(keys[:, some], len(first) - 1), classes[tokens[some]])
                below = trained[classes[tokens[trained]] >= HEAD]
                for s in range(0, len(below), BATCH):
                    some = below[s : s + BATCH]
                    descend(second, squares2, leaf_rows(keys[:, some], classes[tokens[some]], second), leaves[tokens[some]])
                seen += len(trained)
        if seen:
            task = TaskContext.get().partitionId()
            flat = np.array_split(np.concatenate([(a - b).ravel().astype(np.float16) for a, b in zip((first, second), start, strict=True)]), blocks)
            yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array([task] * blocks, pa.int64()), pa.array([float(seen)] * blocks), pa.array([b.tobytes() for b in flat])], ["block", "task", "seen", "step"])

    schema = "block int, task long, seen double, step binary"

    def add(table, kind=np.float16):
        seen = table.column("seen").to_numpy()
        mean = np.zeros(len(table.column("step")[0].as_py()) // np.dtype(kind).itemsize, np.float64)
        for n, b in zip(seen, table.column("step"), strict=True):
            mean += n / seen.sum() * np.frombuffer(b.as_py(), kind)
        return pa.table({"block": table.column("block")[:1], "task": pa.array([table.column("task")[0].as_py() // FAN], pa.int64()), "seen": pa.array([float(seen.sum())]), "step": pa.array([mean.astype(np.float32).tobytes()])})

    # Written by the shuffle alone: each table crosses the disk once.
    parts = chunks.select("held", "sizes", "low", "high", "vocab", "tails").mapInArrow(run, schema).groupBy("block", (F.col("task") / FAN).cast("long").alias("group")).applyInArrow(lambda t: add(t), schema)
    n = -(-chunks.rdd.getNumPartitions() // FAN)
    while n > 1:
        parts = materialize(parts, "lm-parts").groupBy("block", (F.col("task") / FAN).cast("long").alias("group")).applyInArrow(lambda t: add(t, np.float32), schema)
        n = -(-n // FAN)
    found = sorted(parts.collect(), key=lambda r: r["block"])
    shared.unpersist()
    if not found:
        return weights
    step = np.concatenate([np.frombuffer(r["step"], np.float32) for r in found])
    return [w + part.reshape(w.shape) for w, part in zip(weights, np.split(step, [weights[0].size]), strict=True)]


def train_and_score(docs: DataFrame, held_out=None, rounds: int = ROUNDS, chunk_tokens: int = CHUNK_TOKENS, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row. held_out: boolean column of docs that are not learned from; by default crc32(doc_id as text) mod 7 = 2."""
    if held_out is None:
        held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    spark = docs.sparkSession
    chunks = materialize(chunks_of(docs, held_out, chunk_tokens, chunk_words), "lm-chunks")
    each = chunks.select(F.inline(F.arrays_zip("vocab", "tails", "counts"))).where("counts > 0")
    counts = materialize(each.groupBy(F.col("vocab").alias("word")).agg(F.sum("counts").alias("c"), F.max("tails").alias("tail")), "lm-counts")
    total, distinct = (int(x or 0) for x in counts.agg(F.sum("c"), F.count(F.lit(1))).first())
    leaves = leaves_for(distinct)
    half = leaves // 2
    top = counts.where(F.col("word") != int(END)).orderBy(F.desc("c"), "word").limit(HEAD - 1 + 16 * TAIL * half).collect()
    head = np.array([END, *(r["word"] for r in top[: HEAD - 1])], np.int64)

    number = F.coalesce(*[F.when(F.col("word") == int(h), F.lit(i)) for i, h in enumerate(head)], F.lit(HEAD) + F.col("tail"))
    shared_leaf = F.when(number < HEAD, 0).otherwise(F.lit(half) + F.col("word").bitwiseAND(F.lit(half - 1)))
    sizes = np.zeros((CLASSES, leaves, 2), np.float64)  # of each leaf: training tokens, words
    for r in counts.groupBy(number.alias("class"), shared_leaf.cast("int").alias("leaf")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        sizes[r["class"], r["leaf"]] = r["n"], r["v"]
    taken, places = [0] * TAIL, {}
    for r in top[HEAD - 1 :]:
        if taken[r["tail"]] < half:
            places[r["word"]] = taken[r["tail"]]
            sizes[HEAD + r["tail"], taken[r["tail"]]] = r["c"], 1
            sizes[HEAD + r["tail"], half + (r["word"] & (half - 1))] -= r["c"], 1
            taken[r["tail"]] += 1
    own = np.array(sorted(places), np.int64)
    place = np.array([places[w] for w in sorted(places)], np.int64)

    rows = rows_for(distinct)
    weights = [np.zeros((rows + 1, CLASSES), np.float32), np.zeros((rows + TAIL + 1, leaves), np.float32)]
    for _ in range(rounds):
        weights = _average(chunks, weights, head, own, place)
    shared = spark.sparkContext.broadcast((weights, head, own, place, sizes))

    def score(left, right):
        (first, second), head, own, place, sizes = shared.value
        batch = left.combine_chunks().to_batches()[0]
        vocab, tails, lengths = (np.asarray(_column(batch, c, 0)) for c in ("vocab", "tails", "sizes"))
        tokens = _tokens(batch, 0)
        words = right.column("word").to_numpy()
        order = np.argsort(words)
        known = np.zeros(len(vocab), np.int64)
        if len(words):
            slot = np.minimum(np.searchsorted(words[order], vocab), len(words) - 1)
            known = np.where(words[order][slot] == vocab, right.column("c").to_numpy()[order][slot], 0)
        classes, starts = classes_of(vocab, tails, head), np.cumsum(lengths) - lengths
        base = np.log10((known + 1) / (total + distinct + 1))
        leaves = leaves_of(vocab, classes, own, place, second.shape[1])
        inside = np.log10((known + 1) / (sizes[classes, leaves].sum(axis=1) + 1))
        keys = contexts(vocab[tokens], starts)
        chosen = np.empty(len(tokens), np.float64)
        for s in range(0, len(tokens), BATCH):
            p = _softmax(first, rows_of(keys[:, s : s + BATCH], len(first) - 1))
            chosen[s : s + BATCH] = np.log10(np.maximum(p[np.arange(len(p)), classes[tokens[s : s + BATCH]]], 1e-30))
        below = np.flatnonzero(classes[tokens] >= HEAD)
        for s in range(0, len(below), BATCH):
            some = below[s : s + BATCH]
            p = _softmax(second, leaf_rows(keys[:, some], classes[tokens[some]], second))
            chosen[some] += np.log10(np.maximum(p[np.arange(len(p)), leaves[tokens[some]]], 1e-30))
        add = lambda x: np.add.reduceat(x, starts)
        return pa.table({
            "doc_id": _column(batch, "doc_ids", 0), "held_out": _column(batch, "held", 0), "n_tokens": pa.array(lengths.astype(np.int64)), "n_known": pa.array(add((known > 0)[tokens].astype(np.int64))),
            "train_tokens": pa.array(np.full(len(lengths), total)), "base_score": pa.array(add(base[tokens])), "score": pa.array(add(chosen + inside[tokens])),
        })

    asked = chunks.select(F.col("chunk").alias("asker"), F.explode("vocab").alias("word"))
    answers = asked.join(counts.select("word", "c"), "word").select("asker", "word", "c")
    # A chunk is one group; there are as many tasks as the chunks ask for.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), chunks.count() // CHUNKS_PER_TASK)
    left, right = chunks.drop("counts").repartition(tasks, "chunk").groupBy("chunk"), answers.repartition(tasks, "asker").groupBy("asker")
    return left.cogroup(right).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
