"""Best-fit packing planned on the histogram of lengths.

Best fit decreasing runs over counts of equal lengths, of which there are at most as many
as tokens fit in a sequence, not over documents. The plan says which ranks of a length go
to which sequences; pieces find their slot by their rank within their length.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import words
from .common import give_back, picked, staged

CAPACITY = 2048
#: Words that a task keeps ids of, some 20 MB. They only save time.
_CACHE_WORDS = 500_000
_PIECE_BYTES = 1 << 20
_LETTER, _NUMBER, _MARK, _OTHER = 1, 2, 3, 4
#: Kinds of the characters that are their own NFC form and lower-case one by one; blanks are 0, all that isn't listed is other.
_KIND = np.full(1 << 16, _OTHER, dtype=np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
for _c in (*range(0x21, 0x7F), *range(0xA1, 0x180), *range(0x2010, 0x2028)):
    _KIND[_c] = {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(_c))[0], _MARK)
# The settings in a tokenizer's file under which a text's ids are those of its words, in order.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_CUTS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
_WORD_END = "</w>"


def cuts_words(settings: dict) -> bool:
    """Whether a tokenizer file's settings are those that ``WordTokens`` knows to cut texts by."""
    before, model = settings.get("pre_tokenizer") or {}, settings.get("model") or {}
    steps = before.get("pretokenizers") or [{}]
    return (
        (settings.get("normalizer") or {}).get("normalizers") == _NORMALIZERS and [s.get("type") for s in steps] == ["Split", "ByteLevel"]
        and steps[0].get("pattern") == {"Regex": _CUTS} and (steps[0].get("behavior"), steps[0].get("invert")) == ("Removed", True)
        and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
        and model.get("type") == "BPE" and model.get("end_of_word_suffix") == _WORD_END and not model.get("dropout")
        and all(t["content"].startswith("<|") for t in settings.get("added_tokens") or [])
    )


def kinds(data: np.ndarray) -> np.ndarray:
    """The kind of each byte's character."""
    out = _KIND[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first, second, third = (data[np.minimum(lead + k, len(data) - 1)].astype(np.int64) for k in range(3))
        two = first < 0xE0
        code = np.where(two, (first & 31) << 6 | second & 63, (first & 15) << 12 | (second & 63) << 6 | third & 63)
        kind = np.where(first < 0xF0, _KIND[code], _OTHER)
        out[lead] = out[lead + 1] = kind
        out[lead[~two] + 2] = kind[~two]
    return out


def word_spans(low: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end bytes of the words of texts in ASCII lower case: runs of letters or of marks, single digits, and English endings after an apostrophe."""
    n = len(low)
    begin, edge = np.zeros(n + 4, dtype=bool), np.zeros(n + 4, dtype=bool)
    edge[offs] = edge[n:] = True
    begin[:n] = (kind > 0) & ((low & 0xC0) != 0x80)
    begin[1:n] &= (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER) | edge[1:n]
    wide = np.append(low, np.zeros(4, np.uint8))
    quotes = np.flatnonzero((low == 0x27) & begin[:n])
    for ending in _ENDINGS:
        fit = np.ones(len(quotes), dtype=bool)
        for k, c in enumerate(ending.encode(), 1):
            fit &= (wide[quotes + k] == c) & ~edge[quotes + k]
        some = quotes[fit]
        begin[some + 1] = False
        after = some + len(ending) + 1
        after = after[after < n]
        begin[after] |= (kind[after] == _LETTER) & ((low[after] & 0xC0) != 0x80)
    start = np.flatnonzero(begin[:n])
    stop = np.flatnonzero(np.append(kind == 0, True))
    following = np.append(start[1:], n)
    at = np.searchsorted(offs, start, "right")
    return start, np.minimum(np.minimum(following, offs[np.minimum(at, len(offs) - 1)]), stop[np.searchsorted(stop, start)])


class WordTokens:
    """Ids of whole texts, with those of a word kept by its hash for its next occurrence.

    Where the file says that the tokenizer cuts a text into words before it merges, the ids of a text are those of
    its words, in order. Texts with other than plain Latin characters, those that could hold a
    special token's name, and all texts under other files go through the tokenizer as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_word = cuts_words(json.load(f))
        vocabulary = self.tokenizer.get_vocab() if self.by_word else {}
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(_WORD_END)]] = True
        # Of each word known: its hash (sorted), when it was last used, and where its ids stand.
        self.hash, self.known, self.clock = np.zeros(0, np.uint64), np.zeros(0, "<u4"), 0
        self.used, self.first, self.size = (np.zeros(0, np.int64) for _ in range(3))

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learnt(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids one after the other, and how many each has: several words are one text, and a word's last id marks its end."""
        ids, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for low in range(0, len(found), 4096):
            some = found[low : low + 4096]
            got = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.ends[got]) + 1
            if len(ends) == len(some):
                sizes.append(np.diff(ends, prepend=0))
            else:  # a letter whose lower case isn't one
                each = [self.whole(word) for word in some]
                got = np.concatenate(each)
                sizes.append(np.array([len(e) for e in each], dtype=np.int64))
            ids.append(got)
        return np.concatenate(ids), np.concatenate(sizes)

    def _look_up(self, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each word stand in ``known``, and how many there are."""
        distinct, one, which = np.unique(words.hash_spans(low, start, end), return_index=True, return_inverse=True)
        self.clock += 1
        place = np.searchsorted(self.hash, distinct)
        new = np.append(self.hash, ~words.U64(0))[place] != distinct
        self.used[place[~new]] = self.clock
        if new.any():
            raw = low.tobytes()
            ids, size = self._learnt([raw[s:e].decode() for s, e in zip(start[one[new]].tolist(), end[one[new]].tolist(), strict=True)])
            stay = np.arange(len(self.hash))
            if len(stay) + len(size) > _CACHE_WORDS:  # of the others, only what was used last
                stay = np.sort(np.argsort(-self.used, kind="stable")[: max(_CACHE_WORDS // 2, int((self.used == self.clock).sum()))])
                kept = self.size[stay]
                self.known, self.first = self.known[_runs(self.first[stay], kept)], np.cumsum(kept) - kept
            else:
                self.first = self.first[stay]
            merged = np.concatenate([self.hash[stay], distinct[new]])
            order = np.argsort(merged, kind="stable")
            first = np.concatenate([self.first, len(self.known) + np.cumsum(size) - size])
            self.hash, self.first, self.known = merged[order], first[order], np.concatenate([self.known, ids])
            self.size = np.concatenate([self.size[stay], size])[order]
            self.used = np.concatenate([self.used[stay], np.full(len(size), self.clock)])[order]
            place = np.searchsorted(self.hash, distinct)
        return self.first[place][which], self.size[place][which]

    def ids(self, data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
        """The ids of each text of a piece."""
        low = words.LOWER[data]
        kind = kinds(low)
        odd = np.flatnonzero(kind == _OTHER)
        named = np.flatnonzero((low[:-1] == 0x3C) & (low[1:] == 0x7C))
        plain = np.full(len(offs) - 1, self.by_word)
        plain[np.searchsorted(offs, np.concatenate([odd, named]), "right") - 1] = False
        start, end = word_spans(low, offs, kind) if plain.any() else (np.zeros(0, np.int64),) * 2
        text = np.searchsorted(offs, start, "right") - 1
        start, end, text = start[plain[text]], end[plain[text]], text[plain[text]]
        first, size = self._look_up(low, start, end) if len(start) else (start, start)
        ids = self.known[_runs(first, size)]
        cuts = np.append(0, np.cumsum(size))[np.searchsorted(text, np.arange(len(offs)))]
        raw = data.tobytes() if not plain.all() else b""
        return [ids[cuts[d] : cuts[d + 1]] if plain[d] else self.whole(raw[offs[d] : offs[d + 1]].decode()) for d in range(len(plain))]


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of runs that begin at ``first``, one run after the other."""
    return np.arange(int(size.sum())) + np.repeat(first - np.cumsum(size) + size, size)


_tokens: dict[str, WordTokens] = {}


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    tokens = _tokens.setdefault(path, WordTokens(path)) if path not in _tokens else _tokens[path]
    end, seen, step = np.uint32(end_id).tobytes(), {}, 4 * capacity
    for batch in batches:
        give_back()
        for low, high, data, offs in words.pieces(batch.column(1), _PIECE_BYTES):
            rows, starts, lengths, crcs, numbers, ranks, raws = [], [], [], [], [], [], []
            for r, got in enumerate(tokens.ids(data, offs)):
                raw = got.tobytes() + end
                for number, at in enumerate(range(0, len(raw), step)):
                    part = raw[at : at + step]
                    n = len(part) // 4
                    rank = seen[n] = seen.get(n, -1) + 1
                    rows.append(r), starts.append(at // 4), lengths.append(n), crcs.append(zlib.crc32(part)), numbers.append(number), ranks.append(rank)
                    if keep_ids:
                        raws.append(part)
            ids = batch.column(0).slice(low, high - low)
            columns = [ids.take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32())] + [pa.array(c, pa.int64()) for c in (starts, lengths, crcs, ranks)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "chunk_rank"]
            if keep_ids:
                columns, names = columns + [pa.array(raws, pa.binary())], names + ["ids"]
            yield pa.RecordBatch.from_arrays(columns, names)


def tokenized(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents, staged: ids (if kept), their CRC, and the rank within length and chunk.

    A chunk is what one task has read; its number and ranks are fixed once written.
    """
    rows = picked(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(
        lambda it: _pieces(it, tokenizer, capacity, end_id, keep_ids),
        f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, chunk_rank bigint" + ", ids binary" * keep_ids,
    )
    return staged(out.withColumn("chunk", F.spark_partition_id()), "pieces")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, first sequence, items in each sequence, offset), best fit decreasing.

    Sequences in the same state stand in runs (first, count, used). A length takes the fullest run
    it fits in, as often as it fits; a run is split only where a length's count ends, so runs and
    rows stay within a few times the number of lengths.
    """
    rows, free, runs, made = [], [], {}, 0

    def put(space: int, first: int, count: int) -> None:
        if count and space:
            if space not in runs:
                insort(free, space)
            runs.setdefault(space, []).append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            i = bisect_left(free, length)
            if i == len(free):
                first, count, space = made, -(-left // (capacity // length)), capacity
                made += count
            else:
                space = free[i]
                first, count = runs[space].pop()
                if not runs[space]:
                    del runs[space], free[i]
            each = space // length
            full = min(count, left // each)
            if full:
                rows.append((length, rank, first, each, capacity - space))
                put(space - each * length, first, full)
                left, rank, first, count = left - full * each, rank + full * each, first + full, count - full
            if count and left:  # one sequence takes the rest, which is less than it could
                rows.append((length, rank, first, left, capacity - space))
                put(space - left * length, first, 1)
                rank, left, first, count = rank + left, 0, first + 1, count - 1
            put(space, first, count)
    return rows


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; sequences are gapless from 0 and hold at most ``capacity``."""
    spark = pieces.sparkSession
    by_chunk = staged(pieces.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n")), "lengths")
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = by_chunk.select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_rank"))
    histogram = {r["length"]: r["n"] for r in by_chunk.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    rows = np.array(sorted(plan(histogram, capacity)) or np.zeros((0, 5)), dtype=np.int64).reshape(-1, 5)
    span = max(histogram.values(), default=0) + 1
    slots = spark.sparkContext.broadcast((rows, rows[:, 0] * span + rows[:, 1]))

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, keys = slots.value
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            row = table[np.searchsorted(keys, length * span + rank, "right") - 1] if len(length) else table[:0]
            inside = rank - row[:, 1]
            each = np.maximum(row[:, 3], 1)
            extra = [pa.array(row[:, 2] + inside // each), pa.array(row[:, 4] + inside % each * length)]
            names = batch.schema.names
            keep = [i for i, n in enumerate(names) if n != "rank"]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + extra, [names[i] for i in keep] + ["sequence_id", "offset"])

    ranked = pieces.join(first, ["length", "chunk"]).withColumn("rank", F.col("first_rank") + F.col("chunk_rank")).drop("first_rank", "chunk_rank", "chunk")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(seat, fields + ", sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece of each document: its ids, where they begin, and its sequence and place there.

    A null text is empty and has the end id alone. Only documents longer than a sequence are cut.
    Repeated rows are packed each. An empty table gives no pieces; extra columns are ignored.
    """
    return packed(tokenized(docs, tokenizer, capacity, end_id, keep_ids, id_col, text_col), capacity)
