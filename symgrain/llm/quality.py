"""Quality classifier: perplexity under an interpolated modified Kneser-Ney n-gram model.

The model is over code units: a text is its UTF-16 units (letters of all scripts stand for
themselves; Latin capitals are one symbol and so are digits), and four units pack into one long.
Counts never leave Spark's tables:

1. Documents are read in chunks of some CHUNK_BYTES. Each chunk asks once for every distinct
   4-gram of its texts, and tells how often its trusted documents hold it.
2. Counts are summed by gram; lower levels count what precedes (Chen and Goodman 1998). Each
   level's probabilities come from joins on gram, on context and on the shorter gram, for the
   distinct grams that are asked for. All these tables are sharded by gram.
3. What a gram's probability is made of goes back to the chunks that ask for it, where the
   chunk's texts are scored in numpy.

A trusted document is scored as if it had not been counted (its own grams are taken off the
counts of the highest order; lower orders keep them), so bounds are those of held-out text.

A document is rejected if its perplexity lies above its language's bound: the trusted
documents' quantile of what is left after an allowance for short texts, whose means scatter
(ALLOWANCE standard errors of trusted text's log10 probabilities), times a margin that vanishes
as trusted documents grow in number. Languages with few trusted documents, and null, take the bound of all. Units do not
see a word that is likely and comes again and again: a document of LEAST_WORDS or more is also
rejected if over a share MOST_REPEATED of its words equal the word before (trusted documents of
sf0.1: 0.15 at most).

Defined results: a null or empty text has no units, perplexity null, and is kept; texts are
scored whole; repeated rows are scored alike (but for what is trusted) and each gives a row;
labels that repeat an id or are null count once and not; without trusted text nothing is
rejected; an empty table gives no rows; other columns are left out, or kept as they are by
``keep_good``.
"""

from __future__ import annotations

from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgrain.llm.common import BROADCAST_IDS, as_stored, materialize, trimmed

ORDER, UNIT_BITS = 4, 16
CHUNK_BYTES, CHUNKS_PER_TASK = 16 << 20, 8
ALLOWANCE, LEAST_WORDS, MOST_REPEATED = 3.0, 5, 0.3
#: Rows of bounds by language that may be broadcast; beyond it they are joined by shuffle.
BROADCAST_LANGUAGES = 100_000
_START = ord("\n")


def _folds() -> np.ndarray:
    """The symbol of each unit: itself, but for Latin capitals, digits and white space."""
    table = np.arange(1 << UNIT_BITS, dtype=np.uint16)
    for unit in range(0x180):
        if chr(unit).isupper():
            table[unit] = ord("A")
    table[ord("0") : ord("9") + 1] = ord("0")
    table[ord("\t")] = table[ord("\r")] = ord(" ")
    return table


_FOLDS = _folds()


def units_of(text: str) -> np.ndarray:
    return _FOLDS[np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2")]


def grams_of(text: str) -> np.ndarray:
    """Each unit with the three before it, the last in the lowest bits; the text starts after line breaks."""
    padded = np.concatenate([np.full(ORDER - 1, _START, np.uint16), units_of(text)]).astype(np.uint64)
    grams = padded[ORDER - 1 :].copy()
    for k in range(1, ORDER):
        grams |= padded[ORDER - 1 - k : len(padded) - k] << np.uint64(UNIT_BITS * k)
    return grams.view(np.int64)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more (Chen and Goodman), from how many grams have the counts 1 to 4; within [0, 1, 2, 3] where some are missing."""
    if not n1 or not n2:
        return 0.5, 0.75, 1.0
    n, y = (n1, n2, n3, n4), n1 / (n1 + 2 * n2)
    found = [k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] else k / 2 + 0.5 for k in range(3)]
    return tuple(min(max(d, 0.05), k + 1.0) for k, d in enumerate(found))


def _summed(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.empty(0, np.int64)
    return grams[first], np.add.reduceat(counts, first) if len(first) else counts


def _asked(chunked: DataFrame) -> DataFrame:
    """(chunk, g, n): every distinct gram of a chunk, and its count in the chunk's trusted documents."""

    @trimmed
    def run(batches):
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        now = None

        def row():
            grams, counts = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            parts.clear()
            for start in range(0, len(grams), 100_000):
                some = slice(start, start + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams[some]), now)), pa.array(grams[some]), pa.array(counts[some])], ["chunk", "g", "n"])

        for batch in batches:
            chunks = batch.column(0).to_numpy()
            for start, stop in _runs(chunks):
                if now is not None and chunks[start] != now and parts:
                    yield from row()
                now = int(chunks[start])
                trusted, texts = (batch.column(k).slice(start, stop - start).to_pylist() for k in (1, 2))
                for flag in (True, False):
                    found = [grams_of(t) for t, f in zip(texts, trusted, strict=True) if t and f is flag]
                    if found:
                        grams, counts = np.unique(np.concatenate(found), return_counts=True)
                        parts.append((grams, counts * flag))
                if sum(len(g) for g, _ in parts) > 4_000_000:
                    parts[:] = [_summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))]
        if parts:
            yield from row()

    return chunked.select("_q_chunk", "_q_trusted", "text").mapInArrow(run, "chunk long, g long, n long")


def _runs(values: np.ndarray, most: int = 256):
    """(start, stop) of runs of equal values, cut into ``most`` places at most."""
    cuts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]])) if len(values) else []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        for start in range(a, b, most):
            yield start, min(start + most, b)


def _shorter(units: int) -> Column:
    """A gram's last units."""
    return F.col("g").bitwiseAND(F.lit((1 << (UNIT_BITS * units)) - 1))


def _model(asked: DataFrame) -> tuple[DataFrame, tuple[float, float, float]]:
    """(g, n, total, cut, low) for all that is asked for: the gram's count, its context's count and discounts, the shorter gram's probability; and the discounts of the highest order."""
    counts = {ORDER: materialize(asked.where("n > 0").groupBy("g").agg(F.sum("n").alias("n")), "quality-grams")}
    for k in range(ORDER - 1, 0, -1):
        counts[k] = counts[k + 1].select(_shorter(k).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    wanted = {ORDER: asked.select("g").distinct()}
    for k in range(ORDER - 1, 0, -1):
        wanted[k] = wanted[k + 1].select(_shorter(k).alias("g")).distinct()
    low, cuts = None, ()
    for k in range(1, ORDER + 1):
        cuts = discounts(*(int(x or 0) for x in counts[k].agg(*[F.count_if(F.col("n") == i) for i in range(1, 5)]).first()))
        cut = F.when(F.col("n") == 1, cuts[0]).when(F.col("n") == 2, cuts[1]).otherwise(cuts[2])
        found = wanted[k].join(counts[k], "g", "left")
        if k == 1:  # one context
            total, whole = counts[1].agg(F.sum("n"), F.sum(cut)).first()
            found = found.select("g", "n", F.lit(total).cast("long").alias("total"), F.lit(whole).cast("double").alias("cut"), F.lit(2.0**-UNIT_BITS).alias("low"))
        else:
            context = F.shiftrightunsigned("g", UNIT_BITS)
            contexts = counts[k].groupBy(context.alias("h")).agg(F.sum("n").alias("total"), F.sum(cut).alias("cut"))
            found = found.withColumns({"h": context, "s": _shorter(k - 1)}).join(contexts, "h", "left").join(low, "s").select("g", "n", "total", "cut", "low")
        left = F.greatest(F.coalesce(F.col("n") - cut, F.lit(0.0)), F.lit(0.0))
        p = F.when(F.col("total").isNull(), F.col("low")).otherwise((left + F.col("cut") * F.col("low")) / F.col("total"))
        if k < ORDER:
            low = materialize(found.select(F.col("g").alias("s"), p.alias("low")), "quality-level")
    return found.select("g", *[F.coalesce(F.col(c).cast("float"), F.lit(0.0).cast("float")).alias(c) for c in ("n", "total", "cut", "low")]), cuts


def repeated(text: str) -> float:
    """Share of the words, after the first, that equal the word before; 0 for a text of few words."""
    words = text.split()
    return sum(map(eq, words, islice(words, 1, None))) / (len(words) - 1) if len(words) >= LEAST_WORDS else 0.0


class ChunkModel:
    """What a chunk was told about its grams."""

    def __init__(self, answers: pa.Table, cuts: tuple[float, float, float]):
        order = np.argsort(answers.column("g").to_numpy())
        self.grams, self.n, self.total, self.cut, self.low = (answers.column(c).to_numpy()[order].astype(np.int64 if c == "g" else np.float64) for c in ("g", "n", "total", "cut", "low"))
        self.cuts = np.array([0.0, *cuts])
        _, self.context = np.unique(self.grams.view(np.uint64) >> np.uint64(UNIT_BITS), return_inverse=True)
        self.log = np.log10(self._p(self.n, self.total, self.cut, self.low))

    def _discount(self, n: np.ndarray) -> np.ndarray:
        return self.cuts[np.clip(n, 0, 3).astype(np.int64)]

    def _p(self, n, total, cut, low) -> np.ndarray:
        seen = total > 0
        return np.where(seen, (np.maximum(n - self._discount(n), 0) + cut * low) / np.where(seen, total, 1), low)

    def perplexities(self, texts: list[str], trusted: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """log10 perplexity of each text (none is empty), and the mean square of its units' log10 probabilities."""
        found = [grams_of(t) for t in texts]
        sizes = np.array([len(g) for g in found])
        at = np.searchsorted(self.grams, np.concatenate(found))
        log, starts = self.log[at], np.cumsum(sizes) - sizes
        out, squares = -np.add.reduceat(log, starts) / sizes, np.add.reduceat(log * log, starts) / sizes
        own = np.flatnonzero(trusted)
        if len(own):
            who = np.repeat(np.arange(len(texts)), sizes)
            mine = np.asarray(trusted)[who]
            out[own], squares[own] = (x[own] / sizes[own] for x in self._without(who[mine], at[mine], len(texts)))
        return out, squares

    def _without(self, who: np.ndarray, at: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """The sums of -log10 probabilities of each text and of their squares, its own counts taken off."""
        keys, m = np.unique(who * len(self.grams) + at, return_counts=True)
        who, at = keys // len(self.grams), keys % len(self.grams)
        _, inside = np.unique(who * len(self.grams) + self.context[at], return_inverse=True)
        n = self.n[at] - m
        total = self.total[at] - np.bincount(inside, weights=m)[inside]
        cut = self.cut[at] - np.bincount(inside, weights=self._discount(self.n[at]) - self._discount(n))[inside]
        log = np.log10(self._p(n, total, np.maximum(cut, 1e-9), self.low[at]))
        return np.bincount(who, weights=-m * log, minlength=texts), np.bincount(who, weights=m * log * log, minlength=texts)


def trusted_ids(labels: DataFrame) -> DataFrame:
    return materialize(labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("_q_id"), F.lit(True).alias("_q_trusted")).distinct(), "trusted")


def _chunked(docs: DataFrame, labels: DataFrame, chunk_bytes: int) -> DataFrame:
    """docs with _q_chunk and _q_trusted. A chunk is a run of a task's rows; both readings of the table must deal rows alike, as those of files do."""
    trusted = trusted_ids(labels)
    docs = as_stored(docs, "quality-docs")
    size = docs.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    rows = max(int(chunk_bytes * size[1] / max(size[0] or 1, 1)), 1)
    placed = docs.withColumn("_q_chunk", F.shiftright(F.monotonically_increasing_id(), min(rows.bit_length() - 1, 33)))
    few = trusted.count() <= BROADCAST_IDS
    joined = placed.join(F.broadcast(trusted) if few else trusted.hint("merge"), F.col("doc_id").cast("long") == F.col("_q_id"), "left").drop("_q_id")
    joined = joined.withColumn("_q_trusted", F.coalesce("_q_trusted", F.lit(False)))
    return joined if few else materialize(joined.repartition("_q_chunk").sortWithinPartitions("_q_chunk"), "quality-docs")


_ADDED = {"_q_units": "long", "_q_log": "double", "_q_square": "double", "_q_repeated": "double"}


def score(docs: DataFrame, labels: DataFrame, columns: list[str], chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The named columns of each row, _q_trusted, _q_units, _q_log (log10 perplexity), _q_square (mean square of log10 probabilities) and _q_repeated (share of repeated words), written once."""
    chunked = _chunked(docs, labels, chunk_bytes)
    asked = materialize(_asked(chunked), "quality-asked")
    model, cuts = _model(asked)
    answers = asked.select("chunk", "g").join(model, "g")
    carried = [*columns, "_q_trusted"]
    needed = [*dict.fromkeys(["_q_chunk", "text", *carried])]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        model, rows = ChunkModel(right, cuts), left.combine_chunks()
        units, (logs, squares, again) = np.zeros(rows.num_rows, np.int64), np.zeros((3, rows.num_rows))
        for start in range(0, rows.num_rows, 128):
            texts, trusted = (rows.column(c).slice(start, 128).to_pylist() for c in ("text", "_q_trusted"))
            full = [i for i, t in enumerate(texts) if t]
            if full:
                at = start + np.array(full)
                logs[at], squares[at] = model.perplexities([texts[i] for i in full], [trusted[i] for i in full])
                units[at] = [len(texts[i].encode("utf-16-le", "surrogatepass")) // 2 for i in full]
                again[at] = [repeated(texts[i]) for i in full]
        added = (pa.array(units), pa.array(logs, mask=units == 0), pa.array(squares, mask=units == 0), pa.array(again))
        return pa.table({**{c: rows.column(c) for c in carried}, **dict(zip(_ADDED, added, strict=True))})

    source = chunked.select(*needed)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*carried).schema) + "".join(f", {c} {t}" for c, t in _ADDED.items())
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), asked.agg(F.count_distinct("chunk")).first()[0] // CHUNKS_PER_TASK)
    left, right = source.repartition(tasks, "_q_chunk").groupBy("_q_chunk"), answers.repartition(tasks, "chunk").groupBy("chunk")
    return materialize(left.cogroup(right).applyInArrow(run, schema), "quality-scores")


def _allowance(scores: DataFrame) -> Column:
    """What a text's length allows, on log10."""
    mean = lambda c: F.sum(F.col("_q_units") * F.col(c)) / F.sum("_q_units")
    spread = scores.where("_q_trusted AND _q_log IS NOT NULL").agg(F.sqrt(F.greatest(mean("_q_square") - F.pow(mean("_q_log"), 2), F.lit(0.0)))).first()[0]
    return F.when(F.col("_q_units") > 0, F.lit(ALLOWANCE * (spread or 0.0)) / F.sqrt("_q_units")).otherwise(0.0)


def bounds(scores: DataFrame, allowance: Column, quantile: float, doubt: float, least_docs: int) -> DataFrame:
    """(_q_lang, _q_bound): a row for each language with enough trusted documents, and one with a null language for the others."""
    good = scores.where("_q_trusted AND _q_log IS NOT NULL").select(F.col("lang").cast("string").alias("_q_lang"), (F.col("_q_log") - allowance).alias("left"))
    best = F.percentile_approx("left", F.lit(quantile), F.lit(20_000))
    cut = best + F.abs(best) * doubt / F.sqrt(F.count(F.lit(1)))
    own = good.where("_q_lang IS NOT NULL").groupBy("_q_lang").agg(cut.alias("_q_bound"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_docs).select("_q_lang", "_q_bound")
    return own.unionByName(good.agg(cut.alias("_q_bound")).select(F.lit(None).cast("string").alias("_q_lang"), "_q_bound"))


def _judged(scores: DataFrame, quantile: float, doubt: float, least_docs: int) -> DataFrame:
    """scores with _q_bound (of log10 perplexity) and _q_keep."""
    allowance = _allowance(scores)
    limits = materialize(bounds(scores, allowance, quantile, doubt, least_docs), "quality-bounds")
    own = limits.where("_q_lang IS NOT NULL")
    rest = limits.where("_q_lang IS NULL").select(F.col("_q_bound").alias("rest")).scalar()
    joined = scores.join(F.broadcast(own) if own.count() <= BROADCAST_LANGUAGES else own, F.col("lang").cast("string") == F.col("_q_lang"), "left").drop("_q_lang").withColumn("_q_rest", rest)
    bound = F.coalesce("_q_bound", "_q_rest") + allowance
    keep = F.coalesce((F.col("_q_log") <= bound) & ((F.col("_q_repeated") <= MOST_REPEATED) | bound.isNull()), F.lit(True))
    return joined.withColumns({"_q_bound": bound, "_q_keep": keep}).drop("_q_rest")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.995, doubt: float = 0.5, least_docs: int = 50, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, lang, n_units, perplexity, bound, keep of each row."""
    rows = _judged(score(docs, labels, ["doc_id", "lang"], chunk_bytes), quantile, doubt, least_docs)
    power = lambda c: F.pow(F.lit(10.0), c)
    return rows.select("doc_id", "lang", F.col("_q_units").alias("n_units"), power("_q_log").alias("perplexity"), power("_q_bound").alias("bound"), F.col("_q_keep").alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, quantile: float = 0.995, doubt: float = 0.5, least_docs: int = 50, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The rows of docs that are not rejected, all columns kept."""
    rows = _judged(score(docs, labels, docs.columns, chunk_bytes), quantile, doubt, least_docs)
    return rows.where("_q_keep").select(docs.columns)
