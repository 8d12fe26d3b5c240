"""Benchmark decontamination with suffix arrays over the training text.

The documents of a piece of some MB are one shard. Its suffix array holds the suffixes
that begin with the first words of some benchmark suffix (no other can match), ordered by
their words. Every benchmark suffix is binary-searched in every shard; the longest
verbatim match at each place follows from the order. Items of fewer words than a lead are looked
up whole. Benchmarks go out in blocks of a fixed size, one at a time, so that neither the driver nor a
broadcast ever holds more than one.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import words
from .common import picked, staged

WINDOW = 10
LEAD = 3
#: Words of a suffix that its key in the array holds; longer matches are compared further.
DEPTH = 96
BLOCK_BYTES = 8 << 20
_MATCH = pa.struct([("item", pa.string()), ("item_start", pa.int64()), ("start", pa.int64()), ("length", pa.int64())])
_TOP = b"\xff" * 9


def _key(h: np.ndarray, start: int, end: int) -> bytes:
    return h[start : min(end, start + DEPTH)].astype(">u8").tobytes()


@dataclass
class Block:
    """Word hashes of some benchmark items, one after the other, and an index of their leading words."""

    items: list[str]
    hashes: np.ndarray
    first: np.ndarray
    window: int
    leads: np.ndarray
    lead_at: np.ndarray
    seen: np.ndarray
    #: Of items with so many words, fewer than a lead: hashes of all their words, sorted, and which items they are.
    short: dict[int, tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def of(rows: list[tuple[str, str]], window: int = WINDOW) -> Block | None:
        """None if no item has a word."""
        raw = pa.array([t or "" for _, t in rows], pa.large_string())
        data, offs = words.text_bytes(raw)
        w = words.Words(words.LOWER[data[offs[0] : offs[-1]]], offs - offs[0], words.ALNUM)
        some = np.flatnonzero(w.count)
        if not len(some):
            return None
        lead = min(LEAD, window)
        at, key = w.windows(lead)
        order = np.argsort(key, kind="stable")
        short = {}
        for n in range(1, lead):
            mine = np.flatnonzero(w.count[some] == n)
            whole = words.mix(words.chained(w.hash, n))[w.first[some[mine]]] if len(mine) else np.zeros(0, np.uint64)
            by = np.argsort(whole, kind="stable")
            short[n] = (whole[by], mine[by])
        seen = np.zeros(1 << 20, dtype=bool)
        seen[(key & words.U64((1 << 20) - 1)).astype(np.int64)] = True
        return Block([rows[i][0] for i in some], w.hash, np.append(w.first[some], len(w)), window, key[order], at[order], seen, short)

    @property
    def lead(self) -> int:
        return min(LEAD, self.window)

    def item_of(self, at: int) -> int:
        return int(np.searchsorted(self.first, at, "right")) - 1


def shard_matches(w: words.Words, block: Block) -> list[list[tuple[str, int, int, int]]]:
    """Per document of a shard: (item, first word there, first word here, words) of its maximal matches."""
    out: list[list[tuple[str, int, int, int]]] = [[] for _ in w.count]
    for n, (whole, which) in block.short.items():
        if not len(whole):
            continue
        at, key = w.windows(n)
        low, high = np.searchsorted(whole, key, "left"), np.searchsorted(whole, key, "right")
        for k in np.flatnonzero(high > low).tolist():
            d = int(np.searchsorted(w.first, at[k], "right")) - 1
            out[d] += [(block.items[i], 0, int(at[k] - w.first[d]), n) for i in which[low[k] : high[k]].tolist()]
    if not len(block.leads):
        return out
    at, key = w.windows(block.lead)
    maybe = block.seen[(key & words.U64((1 << 20) - 1)).astype(np.int64)]
    at, key = at[maybe], key[maybe]
    if not len(at):
        return out
    near = np.minimum(np.searchsorted(block.leads, key), len(block.leads) - 1)
    real = block.leads[near] == key
    at, key = at[real], key[real]
    if not len(at):
        return out
    h, text = w.hash, np.searchsorted(w.first, at, "right") - 1
    ends = w.first[text + 1]
    array = sorted((_key(h, s, e), s, e, d) for s, e, d in zip(at.tolist(), ends.tolist(), text.tolist(), strict=True))
    keys = [a[0] for a in array]
    present = np.isin(block.leads, key)
    for t in block.lead_at[present].tolist():
        i = block.item_of(t)
        begin, end = int(block.first[i]), int(block.first[i + 1])
        need = min(block.window, end - begin)
        if end - t < need:
            continue
        prefix = block.hashes[t : t + need].astype(">u8").tobytes()
        low = bisect_left(keys, prefix[: 8 * DEPTH])
        high = bisect_left(keys, prefix[: 8 * DEPTH] + _TOP, low)
        for _, s, e, d in array[low:high]:
            if t > begin and s > w.first[d] and h[s - 1] == block.hashes[t - 1]:
                continue  # part of the match that begins a word before
            n = min(end - t, e - s)
            differ = np.flatnonzero(h[s : s + n] != block.hashes[t : t + n])
            length = int(differ[0]) if len(differ) else n
            if length >= need:
                out[d].append((block.items[i], t - begin, s - int(w.first[d]), length))
    return out


def blocks(benchmark: DataFrame, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> tuple[int, Iterator[Block | None]]:
    """How many blocks of about ``block_bytes`` of text the benchmark has, and the blocks, of which only one is on the driver at a time."""
    rows = picked(benchmark, item=item_col, text=text_col).filter(F.col("text").isNotNull()).select(F.col("item").cast("string"), "text")
    size = rows.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    n = -(-size // block_bytes)

    def each() -> Iterator[Block | None]:
        for k in range(n):
            part = rows.filter(F.pmod(F.xxhash64("item"), F.lit(n)) == k) if n > 1 else rows
            yield Block.of([(r["item"] or "", r["text"]) for r in part.collect()], window)

    return n, each()


def _scanned(rows: DataFrame, block: Block | None) -> DataFrame:
    """``rows`` (row, text) with ``n_words`` and ``matches`` in place of the text."""
    shared = rows.sparkSession.sparkContext.broadcast(block)  # about BLOCK_BYTES of text

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offs in words.pieces(batch.column(1)):
                w = words.Words(words.LOWER[data], offs, words.ALNUM)
                found = shard_matches(w, shared.value) if shared.value is not None else [[] for _ in w.count]
                out = pa.array([[dict(zip(("item", "item_start", "start", "length"), m, strict=True)) for m in ms] for ms in found], pa.list_(_MATCH))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(w.count.astype(np.int64)), out], ["row", "n_words", "matches"])

    match = T.StructType().add("item", "string").add("item_start", "long").add("start", "long").add("length", "long")
    return rows.mapInArrow(scan, T.StructType([rows.schema["row"]]).add("n_words", "long").add("matches", T.ArrayType(match)))


def with_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``row`` (all columns of ``docs``), ``n_words`` and ``matches``: the longest matches of at least a window.

    A window is ``window`` consecutive words of an item, or all of a shorter item. Null or empty texts
    and items have no words; items with a null id have a blank one. Repeated rows are each judged; an empty table gives no rows.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    text = F.col(f"`{text_col}`").alias("text")
    n, each = blocks(benchmark, window, item_col, item_text_col, block_bytes)
    if n <= 1:
        return _scanned(docs.select(whole.alias("row"), text), next(each, None))
    # Rows get a number once, and each block's matches are written before the next block is made.
    numbered = staged(docs.select(whole.alias("row"), text, F.monotonically_increasing_id().alias("no")), "numbered")
    keyed, found, counts = numbered.select(F.col("no").alias("row"), "text"), None, None
    for block in each:
        part = staged(_scanned(keyed, block), "block_matches")
        counts = counts if counts is not None else part.select(F.col("row").alias("no"), "n_words")
        some = part.filter(F.size("matches") > 0).select(F.col("row").alias("no"), "matches")
        found = some if found is None else found.union(some)
    merged = found.groupBy("no").agg(F.flatten(F.collect_list("matches")).alias("matches"))
    empty = F.array().cast(merged.schema["matches"].dataType)
    return numbered.drop("text").join(counts, "no").join(merged, "no", "left").select("row", "n_words", F.coalesce("matches", empty).alias("matches"))


def hit_words() -> Column:
    """How many words the matches cover."""
    return F.expr(
        "aggregate(array_sort(matches, (a, b) -> CASE WHEN a.start < b.start THEN -1 WHEN a.start > b.start THEN 1 ELSE 0 END),"
        " named_struct('hit', 0L, 'upto', 0L), (s, m) -> named_struct('hit', s.hit + greatest(0L, m.start + m.length - greatest(s.upto, m.start)),"
        " 'upto', greatest(s.upto, m.start + m.length)), s -> s.hit)"
    )


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, ``n_hit``, ``items`` (sorted as strings), ``matches``, ``contaminated``."""
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item"])))
    found = with_matches(docs, benchmark, **options)
    return found.select(F.col(f"row.`{id_col}`").alias("doc_id"), "n_words", hit_words().alias("n_hit"), items.alias("items"), "matches", (F.size("matches") > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without those in which a window of the benchmark occurs; all columns stay. Nulls, repeated rows and empty tables as in ``with_matches``."""
    return with_matches(docs, benchmark, **options).filter(F.size("matches") == 0).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
