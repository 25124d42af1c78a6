"""Byte-level BPE encoding and decoding.

The vocabulary's byte strings, mapped to Latin-1 text, go into one Aho-Corasick automaton,
whose trie tells how far any token can reach from a byte. Encoding takes the longest token at
each position that may follow the previous one and goes back where none may. Whether two tokens may stand side by side depends on those two
alone (would merging have crossed their border first?), so the answers are memoised; an end
position that once failed is not tried again, which keeps the time linear. The result is that
of applying the merges in rank order.

Defined results: a null text counts as empty and gives no ids; texts of any length are encoded
whole; rows are independent, so ties, repeats and empty tables need no rule.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from symgrain.llm.buckets import ranges
from symgrain.llm.common import trimmed

TIKTOKEN_FILE = "byte_bpe_50k.tiktoken"
#: Pieces that a worker's memo may hold (some 60 bytes each), and of how many bytes; words and pairs that its dictionaries may, and texts, or bytes of them, encoded at a time.
MEMO_PIECES, MEMO_BYTES, MEMO_WORDS, MEMO_PAIRS = 600_000, 24, 40_000, 150_000
MEMO_CHARS, DOCS_AT_ONCE, BYTES_AT_ONCE = 80, 1_000, 1 << 19
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Where this is not found, splitting at single spaces never cuts what ByteLevel keeps together.
SPACE_AFTER_SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}] "


class _Memo(dict):
    """Remembers up to MEMO_WORDS new results and as many older ones, so frequent keys outlive a full memo."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


def words_and_sizes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each string's first MEMO_BYTES bytes, zeros behind them, as 64-bit words; and its length in bytes. The two tell strings of up to MEMO_BYTES apart."""
    strings = pa.concat_arrays([strings])  # from offset zero
    _, offsets, data = strings.buffers()
    ends = np.frombuffer(offsets, np.int32, len(strings) + 1).astype(np.int64)
    raw = np.frombuffer(data, np.uint8, ends[-1]) if data is not None else np.empty(0, np.uint8)
    sizes = np.diff(ends)
    raw = np.concatenate([raw, np.zeros(MEMO_BYTES, np.uint8)])
    table = np.lib.stride_tricks.sliding_window_view(raw, MEMO_BYTES)[ends[:-1]]
    table = np.where(np.arange(MEMO_BYTES) < sizes[:, None], table, 0).astype(np.uint8)
    return table.view("<u8"), sizes


class PieceMemo:
    """Ids of pieces of up to MEMO_BYTES bytes, found by the pieces' own bytes: an open-addressed table names the entry, whose words and length must equal the piece's. Emptied when full."""

    def __init__(self, size: int):
        self.size = size
        self.slots = 1 << max(2 * size - 1, 1).bit_length()
        self.clear()

    def clear(self) -> None:
        self.table = np.full(self.slots, -1, np.int32)
        self.words, self.sizes = np.empty((0, MEMO_BYTES // 8), np.uint64), np.empty(0, np.uint8)
        self.begin, self.length = np.empty(0, np.int64), np.empty(0, np.int32)
        self.ids, self.used, self.entries = np.empty(1 << 16, np.int32), 0, 0

    def _slots(self, words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        mixed = sizes.astype(np.uint64)
        for column in words.T:
            mixed = (mixed ^ column) * _MIX
            mixed ^= mixed >> np.uint64(32)
        return (mixed & np.uint64(self.slots - 1)).astype(np.int64)

    def places(self, words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Each piece's entry, or -1."""
        found, slot, open_ = np.full(len(sizes), -1, np.int64), self._slots(words, sizes), np.arange(len(sizes))
        while len(open_):
            entry = self.table[slot]
            there = entry >= 0
            open_, slot, entry = open_[there], slot[there], entry[there]
            same = (self.sizes[entry] == sizes[open_]) & (self.words[entry] == words[open_]).all(axis=1)
            found[open_[same]] = entry[same]
            open_, slot = open_[~same], (slot[~same] + 1) & (self.slots - 1)
        return found

    def append(self, values: np.ndarray) -> int:
        """Puts ids behind the others and returns where they begin."""
        at = self.used
        if at + len(values) > len(self.ids):
            self.ids = np.concatenate([self.ids[:at], np.empty(at // 2 + len(values), np.int32)])
        self.ids[at : at + len(values)] = values
        self.used += len(values)
        return at

    def add(self, words: np.ndarray, sizes: np.ndarray, begin: np.ndarray, length: np.ndarray) -> None:
        """Enters pieces, all different and none known."""
        first, total = self.entries, self.entries + len(sizes)
        if total > len(self.sizes):
            room = max(total, min(2 * len(self.sizes), self.size))
            self.words, self.sizes, self.begin, self.length = (np.concatenate([a[:first], np.empty((room - first, *a.shape[1:]), a.dtype)]) for a in (self.words, self.sizes, self.begin, self.length))
        for kept, fresh in ((self.words, words), (self.sizes, sizes), (self.begin, begin), (self.length, length)):
            kept[first:total] = fresh
        self.entries = total
        entry, slot = np.arange(first, total, dtype=np.int32), self._slots(words, sizes)
        while len(entry):
            free = self.table[slot] < 0
            self.table[slot[free]] = entry[free]
            lost = self.table[slot] != entry
            entry, slot = entry[lost], (slot[lost] + 1) & (self.slots - 1)


class PieceEncoder:
    """Encodes texts by their distinct pieces where single spaces never cut a pre-token; subclasses give _whole."""

    by_piece = True
    whole_if: list[str] = []  # texts that hold one of these are not cut

    def __init__(self, memo_pieces: int):
        self.memo = PieceMemo(memo_pieces)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has."""
        raise NotImplementedError

    def _new_pieces(self, pieces: pa.Array, some: np.ndarray, begin: np.ndarray, length: np.ndarray) -> None:
        """Encodes some of the pieces and notes where their ids are."""
        values, sizes = self._whole([" " + p for p in pieces.take(pa.array(some)).to_pylist()])
        begin[some], length[some] = self.memo.append(values) + np.cumsum(sizes) - sizes, sizes

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
        """Where in the memo's ids each distinct piece, which a space precedes, begins, and how many it has; and where the ids that are remembered end."""
        if self.memo.entries + len(pieces) > self.memo.size:
            self.memo.clear()
        words, sizes = words_and_sizes(pieces)
        place = self.memo.places(words, sizes)
        old, new = place >= 0, np.flatnonzero(place < 0)
        begin, length = (np.zeros(len(pieces), np.int64) for _ in range(2))
        begin[old], length[old] = self.memo.begin[place[old]], self.memo.length[place[old]]
        short = sizes[new] <= MEMO_BYTES if len(new) <= self.memo.size else np.zeros(len(new), bool)
        kept = new[short]
        self._new_pieces(pieces, kept, begin, length)
        self.memo.add(words[kept], sizes[kept], begin[kept], length[kept])
        used = self.memo.used
        self._new_pieces(pieces, new[~short], begin, length)  # for this batch only
        return begin, length, used

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after another, and how many each has; end_id, if given, ends each text."""
        n = len(texts)
        if not n:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        texts = pc.fill_null(texts.cast(pa.string()), "")
        plain = ~pc.match_substring_regex(texts, SPACE_AFTER_SPACE).to_numpy(zero_copy_only=False).astype(bool) & self.by_piece
        for content in self.whole_if:
            plain &= ~pc.match_substring(texts, content).to_numpy(zero_copy_only=False).astype(bool)
        plain = pa.array(plain)
        split = pc.split_pattern(pc.if_else(plain, texts, ""), " ")
        offsets, values = np.asarray(split.offsets).astype(np.int64), split.values
        firsts = np.zeros(len(values), bool)
        firsts[offsets[:-1]] = True
        coded = values.filter(pa.array(~firsts)).dictionary_encode()
        begin, length, kept = self._pieces(coded.dictionary)
        heads, sizes = self._whole(pc.if_else(plain, values.filter(pa.array(firsts)), texts).to_pylist())
        used = self.memo.append(np.concatenate([heads, np.array([] if end_id is None else [end_id], np.int32)]))
        pool, self.memo.used = self.memo.ids, kept  # what is only this batch's will be written over
        begin = np.concatenate([begin, used + np.cumsum(sizes) - sizes, [used + len(heads)]])
        length = np.concatenate([length, sizes, [int(end_id is not None)]])
        # What stands where: a text's first piece, its others, the end.
        parts = np.full(len(values) + n, len(length) - 1)
        places = np.arange(len(values)) + np.repeat(np.arange(n), np.diff(offsets))
        parts[places[firsts]] = len(coded.dictionary) + np.arange(n)
        parts[places[~firsts]] = coded.indices.to_numpy()
        at, _ = ranges(begin[parts], begin[parts] + length[parts])
        return pool[at], np.add.reduceat(length[parts], offsets[:-1] + np.arange(n))


class BytePairCodec(PieceEncoder):
    """Encodes and decodes with one vocabulary; one is built per Python worker and path."""

    _built: dict[str, BytePairCodec] = {}

    def __init__(self, path: str, pattern: str):
        super().__init__(MEMO_PIECES)
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.bytes_of: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.text_of = [str(v) for v in range(len(self.bytes_of))]
        self.pattern = regex.compile(pattern)
        self.rank_of = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in self.rank_of.items():
            self.automaton.add_word(token, rank)
        self.automaton.make_automaton()
        self.size_of = [len(token or b"") for token in self.bytes_of]
        # The longest token that each path of the trie starts with, and for each token the next shorter one.
        self.ending: dict[str, int | None] = {"": None}
        self.shorter: list[int | None] = [None] * len(self.bytes_of)
        for token, rank in sorted(self.rank_of.items()):
            for size in range(1, len(token) + 1):
                if (path := token[:size]) not in self.ending:
                    self.ending[path] = self.rank_of.get(path, self.ending[path[:-1]])
            self.shorter[rank] = self.ending[token[:-1]]
        self._split_tokens(ranks)
        self.fits: dict[int, bool] = {}
        self.words = _Memo(lambda word: self._encode_word(word.encode()))
        self.by_piece = pattern == public_tokenizers.PATTERN

    @classmethod
    def of(cls, path: str, pattern: str) -> BytePairCodec:
        if path not in cls._built:
            cls._built[path] = cls(path, pattern)
        return cls._built[path]

    def _split_tokens(self, ranks: dict[bytes, int]) -> None:
        """For each token the two that merge into it (itself twice if none do), and the token that each such pair makes."""
        self.left, self.right, self.merged = list(range(len(self.bytes_of))), list(range(len(self.bytes_of))), {}
        for token, rank in ranks.items():
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                best, at = min((ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1))
                if best >= rank:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(parts) == 2:
                pair = ranks[parts[0]], ranks[parts[1]]
                self.left[rank], self.right[rank] = pair
                self.merged[pair] = rank

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether encoding the two tokens' bytes together gives these two tokens.

        Undoes the merges beside the border, the latest first. If the two tokens that then
        touch would have merged before the last undone merge, the border was crossed.
        """
        x, y, before, fits = a, b, float("inf"), None
        while fits is None:
            made = self.merged.get((x, y))
            if made is not None and made < before:
                fits = False
                break
            x_whole, y_whole = self.right[x] == x, self.left[y] == y
            if x_whole and y_whole:
                fits = True
            elif y_whole or (x > y and not x_whole):
                before, x = x, self.right[x]
            else:
                before, y = y + 1, self.left[y]
        if len(self.fits) >= MEMO_PAIRS:
            self.fits.clear()
        self.fits[a << 32 | b] = fits
        return fits

    def _encode_word(self, word: bytes) -> tuple[int, ...]:
        text = word.decode("latin-1")
        whole = self.rank_of.get(text)
        if whole is not None:
            return (whole,)
        fits, shorter, size_of, first = self.fits, self.shorter, self.size_of, self._longest_at
        rank, at, end, last = first(text, 0), 0, len(text), None
        out: list[int] = []
        dead = set()
        while at < end:
            while rank is not None:
                if not dead or at + size_of[rank] not in dead:
                    if last is None:
                        break
                    pair = last << 32 | rank
                    if fits[pair] if pair in fits else self._may_follow(last, rank):
                        break
                rank = shorter[rank]
            if rank is not None:
                out.append(rank)
                last = rank
                at += size_of[rank]
                if at < end:
                    rank = first(text, at)
            elif out:
                dead.add(at)
                rank = out.pop()
                at -= size_of[rank]
                rank = shorter[rank]
                last = out[-1] if out else None
            else:
                raise ValueError("the vocabulary lacks a byte")
        return tuple(out)

    def _longest_at(self, text: str, at: int) -> int | None:
        """The longest token that starts there."""
        piece = text[at : at + self.longest]
        return self.ending[piece[: self.automaton.longest_prefix(piece)]]

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        word, found = self.words.__getitem__, map(self.pattern.findall, texts)
        each = [word(ws[0]) if len(ws) == 1 else tuple(chain.from_iterable(map(word, ws))) for ws in found]
        sizes = np.fromiter(map(len, each), np.int64, count=len(each))
        return np.fromiter(chain.from_iterable(each), np.int32, count=int(sizes.sum())), sizes

    def encode_one(self, text: str | None) -> list[int]:
        return self._whole([text or ""])[0].tolist()

    def forget(self) -> None:
        """Empties what remembers earlier texts."""
        self.memo.clear()
        for memo in (self.words, self.words.older, self.fits):
            memo.clear()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _rows(batches, limit: int = DOCS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, limit):
            yield batch.slice(start, limit)


def _texts(batches) -> Iterator[pa.RecordBatch]:
    """Rows whose texts (the second column) have BYTES_AT_ONCE together, or one that has more, and DOCS_AT_ONCE at most."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + BYTES_AT_ONCE, "right"))
            stop = min(max(stop, start + 1), start + DOCS_AT_ONCE)
            yield batch.slice(start, stop - start)
            start = stop
        del batch  # while the next one is read


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, ids array<int>, n_tokens long) of every row; other columns are left out, so their names cannot clash.

    Workers wait in a pool that deals tasks to each in turn, so there may be more of them than tasks
    at once: what a worker remembers goes with its task.
    """
    path, pattern = path or public_tokenizers.path(TIKTOKEN_FILE), pattern or public_tokenizers.PATTERN
    kind = docs.schema[id_col].dataType.simpleString()

    @trimmed
    def run(batches):
        codec = BytePairCodec.of(path, pattern)
        try:
            for batch in _texts(batches):
                ids, sizes = codec.encode(batch.column(1))
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)), pa.array(sizes)], [id_col, "ids", "n_tokens"])
                del batch
        finally:
            codec.forget()

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, n_tokens long")


def decode_documents(tokens: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id_col, bytes binary) of rows with ids; null ids give null."""
    path, pattern = path or public_tokenizers.path(TIKTOKEN_FILE), pattern or public_tokenizers.PATTERN
    kind = tokens.schema[id_col].dataType.simpleString()

    @trimmed
    def run(batches):
        codec = BytePairCodec.of(path, pattern)
        for batch in _rows(batches):
            out = [None if ids is None else codec.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], [id_col, "bytes"])

    return tokens.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, bytes binary")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encodes and decodes each text in one Python pass and returns digests of both: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path, pattern = path or public_tokenizers.path(TIKTOKEN_FILE), pattern or public_tokenizers.PATTERN

    @trimmed
    def run(batches):
        codec = BytePairCodec.of(path, pattern)
        for batch in _rows(batches):
            shas, decoded = [], []
            values, sizes = codec.encode(batch.column(1))
            ends = np.cumsum(sizes)
            for start, end in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
                ids = values[start:end].tolist()
                shas.append(hashlib.sha256(" ".join(map(codec.text_of.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(shas, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
