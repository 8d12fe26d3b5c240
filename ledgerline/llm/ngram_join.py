"""Exact Jaccard join of word n-gram sets by partitioning the universe of n-grams.

Sets of similar sizes share a band. In a band, n-grams are hashed into segments; two sets
that reach the similarity differ in few n-grams, so by the pigeonhole principle some
segment of theirs is equal, or equal up to one n-gram where both sides also index their
segments with one n-gram deleted. There are more segments than a set needs; each set leaves
out as many of its own as it has to spare, those that most other sets share, which is the
allocation of the least cost. Empty segments count for nothing; a set that runs out of
segments moves to a further hashing, and in the last one empty segments count too, so no pair
is lost.

Sets with an equal segment are candidates. Large groups are linked star by star first;
what links already connect needs no further comparison, and all other pairs of a segment
are compared. A comparison begins with parities, then with counts of n-grams by cells, whose differences bound that of
the sets from below, and ends with the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from . import words
from .common import integral, picked, staged
from .components import connected

NGRAM = 5
#: Similarity as a fraction.
NUM, DEN = 3, 4
LEVELS = 4
#: Bands up to this size use segments with one deletion.
DELETE_UP_TO = 16
#: Rows up to which a table of ids is broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: The share of signatures (one in so many) that the stars use, and their rounds.
SAMPLE_SIGNATURES, STAR_ROUNDS = 8, 2
#: Bytes of the cells' parities that every set carries into the last join.
CELLS = 128
#: Members compared with one copy of a representative.
SALT_ROWS = 4096
U64 = words.U64
_KEY = U64((1 << 40) - 1)

_TOPS = [1]
while _TOPS[-1] < 1 << 40:
    _TOPS.append(2 * _TOPS[-1])
TOPS = np.array(_TOPS, dtype=np.int64)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Most n-grams in which sets of these sizes can differ at the similarity."""
    return (DEN - NUM) * (a + b) // (DEN + NUM)


def segments(band: np.ndarray) -> np.ndarray:
    """Number of segments of each band: a third more than its largest sets need."""
    most = differing(TOPS[band], TOPS[band])
    two = TOPS[band] <= DELETE_UP_TO
    need = np.where(two & (most > 0), -(-(most + 1) // 2), most + 1)
    return np.where(most < 2, 1, need + 1 + need // 3)


def shingle_sets(w: words.Words, size: int = NGRAM) -> list[np.ndarray]:
    """Per text its distinct n-grams, sorted; the whole of a text with fewer words."""
    grams = words.mix(words.chained(w.hash, size))
    out = []
    for low, high in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        n = high - low
        if n >= size:
            out.append(np.unique(grams[low : high - size + 1]))
        else:
            out.append(words.mix(words.chained(w.hash[low:high], n) + U64(n)) if n else np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, 2 * number of its set + 1 if it is one of the band above, spare segments of each such number)."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    spare = np.zeros(2 * len(sets), dtype=np.int64)
    if not size.sum():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), spare
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    own_band = np.searchsorted(TOPS, np.maximum(size, 1))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    reach = size * DEN // NUM
    for up in (0, 1):
        band = own_band + up
        partner = np.minimum(TOPS[band], reach) if not up else reach
        left = (size > 0) & ((reach > TOPS[own_band]) if up else True)
        for level in range(LEVELS):
            if not left.any():
                break
            worth, more = _emit(every, owner, left, band, differing(size, partner), level)
            found += [(sig, 2 * text + up) for sig, text in more]
            enough = worth > differing(size, partner)
            if level == 0:
                plain = TOPS[band] > DELETE_UP_TO
                spare[up::2] = np.where(left & enough & plain, worth - differing(size, partner) - 1, 0)
            left = left & ~enough
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), spare


def _emit(every: np.ndarray, owner: np.ndarray, live: np.ndarray, band: np.ndarray, most: np.ndarray, level: int) -> tuple[np.ndarray, list]:
    """What the live sets' segments are worth in one hashing, and their signatures in it.

    An empty segment is worth nothing and has no signature, but in the last hashing.
    """
    last = level == LEVELS - 1
    m = np.where(live, segments(band), 0)
    first = np.concatenate([[0], np.cumsum(m)])
    pick = live[owner]
    e, o = every[pick], owner[pick]
    spread = words.mix(e + U64(0x51ED27 * (level + 1)))
    at = first[o] + ((spread >> U64(11)) % m[o].astype(np.uint64)).astype(np.int64)
    total = int(first[-1])
    count = np.bincount(at, minlength=total)
    sums = np.zeros(total, dtype=np.uint64)
    np.add.at(sums, at, spread)
    text = np.repeat(np.arange(len(m)), m)
    two = (TOPS[band] <= DELETE_UP_TO)[text]
    upto = np.concatenate([[0], np.cumsum(np.where(two, np.minimum(count, 2), np.minimum(count, 1)))])
    worth = np.where(live, upto[first[1:]] - upto[first[:-1]], 0)
    send = (count > 0) | (last & (worth <= most)[text])
    place = words.mix((band[text] * 8 + level).astype(np.uint64) * U64(0x9E3779B97F4A7C15) + (np.arange(total) - first[text]).astype(np.uint64))
    out = [(words.mix(sums[send] ^ place[send]), text[send])]
    minus = two[at] & ((count[at] > 1) | (last & (worth <= most)[o]))
    out.append((words.mix((sums[at[minus]] - spread[minus]) ^ place[at[minus]]), o[minus]))
    return worth, out


def _planes(values: np.ndarray) -> bytes:
    """The values' first bytes, then their second ones and so on, which a shuffle compresses well."""
    return np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


ROW = "kind int, bucket int, sig bigint, doc bigint, comp bigint, n bigint, spare bigint, sigs binary, docs binary, comps binary, cells array<tinyint>"
_ROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("sig", pa.int64()), ("doc", pa.int64()), ("comp", pa.int64()), ("n", pa.int64()), ("spare", pa.int64()), ("sigs", pa.binary()), ("docs", pa.binary()), ("comps", pa.binary()), ("cells", pa.list_(pa.int8()))])


def _rows(kind: int, bucket: np.ndarray, **columns) -> pa.RecordBatch:
    given = {"kind": np.full(len(bucket), kind, np.int32), "bucket": bucket.astype(np.int32)} | columns
    return pa.RecordBatch.from_arrays([(given[f.name] if isinstance(given[f.name], pa.Array) else pa.array(given[f.name], f.type)) if f.name in given else pa.nulls(len(bucket), f.type) for f in _ROW], schema=_ROW)


def _index(batches: Iterator[pa.RecordBatch], buckets: int, sample: int) -> Iterator[pa.RecordBatch]:
    """Documents go as twice their id, plus one in the band above. Of each piece: by bucket the distinct signatures, each with the set of the least and of the greatest
    component that has it (kind 0); all sets of signatures that more than one has (kind 2); the sizes (kind 1)."""
    for batch in batches:
        for low, high, data, offs in words.pieces(batch.column(1), 1 << 20):
            ids, comps = (batch.column(c).slice(low, high - low).to_numpy() for c in (0, 2))
            sets = shingle_sets(words.Words(words.LOWER[data], offs, words.SPACED))
            size = np.array([len(s) for s in sets], dtype=np.int64)
            sig, text, spare = signatures(sets)
            ids, comps = np.stack([2 * ids, 2 * ids + 1], 1).ravel(), np.repeat(comps, 2)
            yield _rows(1, ids // 2 % buckets, doc=ids, n=np.repeat(size, 2), spare=spare, cells=_parities(sets))
            if sample > 1:
                chosen = (sig >> U64(56)) % U64(sample) == 0
                sig, text = sig[chosen], text[chosen]
            if not len(sig):
                continue
            name = ((sig >> U64(40)) % U64(buckets)) << U64(40) | (sig & _KEY)
            order = np.lexsort((ids[text], comps[text], name))
            name, doc, comp = name[order], ids[text[order]], comps[text[order]]
            first = np.ones(len(name), dtype=bool)
            first[1:] = name[1:] != name[:-1]
            last = np.append(first[1:], True)
            group = np.cumsum(first) - 1
            heads, ends = np.flatnonzero(first), np.flatnonzero(last)
            lone = (doc[heads] // 2 == doc[ends] // 2)[group]
            send = np.unique(np.concatenate([heads, ends[comp[ends] != comp[heads]]]))
            send = send[np.lexsort((doc[send], name[send] >> U64(40)))]
            bucket = (name[send] >> U64(40)).astype(np.int64)
            some, cuts = np.unique(bucket, return_index=True)
            cuts = np.append(cuts, len(send)).tolist()
            five = (name[send] & _KEY).view(np.uint8).reshape(-1, 8)[:, :5]
            parts = [slice(x, y) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            sent, far = doc[send], comp[send] - doc[send]
            yield _rows(0, some, sigs=[np.ascontiguousarray(five[p].T).tobytes() for p in parts], docs=[_planes(np.diff(sent[p], prepend=0)) for p in parts], comps=[_planes(far[p]) for p in parts])
            meet = np.flatnonzero(~lone)
            if len(meet):
                yield _rows(2, (name[meet] >> U64(40)).astype(np.int64), sig=name[meet].view(np.int64), doc=doc[meet], comp=comp[meet])


def _parities(sets: list[np.ndarray]) -> pa.Array:
    """For each of 8 * ``CELLS`` cells whether an odd number of a set's n-grams fall into it, a bit each; twice for each set."""
    size = [len(s) for s in sets]
    cell = (words.mix(np.concatenate(sets)) & U64(8 * CELLS - 1)).astype(np.int64)
    bits = np.zeros(CELLS * len(sets), np.uint8)
    np.bitwise_xor.at(bits, np.repeat(np.arange(len(sets)), size) * CELLS + (cell >> 3), (1 << (cell & 7)).astype(np.uint8))
    flat = np.repeat(bits.view(np.int8).reshape(len(sets), CELLS), 2, axis=0).ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, CELLS), pa.int32()), pa.array(flat))


def _unplaned(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _meet(rows: pa.Table) -> pa.Table:
    """Of a bucket: signatures of more than one component, with all their sets; the sizes pass."""
    kinds = rows["kind"].to_numpy()
    sizes = rows.filter(pa.array(kinds == 1)).select(["sig", "doc", "comp", "n", "spare", "cells"])
    local, packed = rows.filter(pa.array(kinds == 2)), rows.filter(pa.array(kinds == 0))
    names, docs, comps = [local["sig"].to_numpy()], [local["doc"].to_numpy()], [local["comp"].to_numpy()]
    for b, s, d, c in zip(*(packed[x].to_pylist() for x in ("bucket", "sigs", "docs", "comps")), strict=True):
        five = np.frombuffer(s, np.uint8).reshape(5, -1)
        eight = np.zeros((five.shape[1], 8), np.uint8)
        eight[:, :5] = five.T
        names.append((eight.view("<u8").ravel() | U64(b) << U64(40)).view(np.int64))
        docs.append(np.cumsum(_unplaned(d)))
        comps.append(_unplaned(c) + docs[-1])
    name, doc, comp = np.concatenate(names), np.concatenate(docs), np.concatenate(comps)
    if not len(name):
        return sizes
    order = np.argsort(name, kind="stable")
    name, doc, comp = name[order], doc[order], comp[order]
    cuts = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
    wide = np.minimum.reduceat(comp, cuts) != np.maximum.reduceat(comp, cuts)
    keep = np.repeat(wide, np.diff(np.append(cuts, len(name))))
    name, doc, comp = name[keep], doc[keep], comp[keep]
    if len(name):
        order = np.lexsort((doc, name))
        fresh = np.concatenate([[True], (name[order][1:] != name[order][:-1]) | (doc[order][1:] != doc[order][:-1])])
        name, doc, comp = (x[order][fresh] for x in (name, doc, comp))
    met = pa.table({"sig": pa.array(name), "doc": pa.array(doc), "comp": pa.array(comp), "n": pa.nulls(len(name), pa.int64()), "spare": pa.nulls(len(name), pa.int64()), "cells": pa.nulls(len(name), pa.list_(pa.int8()))})
    return pa.concat_tables([sizes, met])


def _small(ids: DataFrame) -> DataFrame:
    """Broadcast a table of ids if its count allows."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def _counts(grams: np.ndarray) -> bytes:
    """How many n-grams fall into each of about as many cells as there are n-grams."""
    cells = 1 << max(0, int(len(grams)).bit_length() - 1)
    return np.minimum(np.bincount((words.mix(grams) & U64(cells - 1)).astype(np.int64), minlength=cells), 255).astype(np.uint8).tobytes()


def _to_sets(batches: Iterator[pa.RecordBatch], counts: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offs in words.pieces(batch.column(1)):
            sets = shingle_sets(words.Words(words.LOWER[data], offs, words.SPACED))
            part = batch.slice(low, high - low)
            columns = [part.column(i) for i in range(part.num_columns) if i != 1]
            names = [n for i, n in enumerate(part.schema.names) if i != 1]
            raw = pa.array([_counts(s) if counts else s.tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays(columns + [pa.array([len(s) for s in sets], pa.int64()), raw], names + ["n", "grams"])


def _may_reach(a: np.ndarray, b: np.ndarray, n: int, m: int) -> bool:
    """False only if the cells' counts differ in more n-grams than similar sets of these sizes can."""
    cells = min(len(a), len(b))
    a, b = a.astype(np.int64).reshape(-1, cells).sum(0), b.astype(np.int64).reshape(-1, cells).sum(0)
    full = 255 if max(a.max(), b.max()) < 255 else 0  # a full cell's count isn't known
    return not full or int(np.abs(a - b).sum()) <= (DEN - NUM) * (n + m) // (DEN + NUM)


def _reach(a: np.ndarray, b: np.ndarray) -> bool:
    place = np.minimum(np.searchsorted(a, b), len(a) - 1)
    both = int((a[place] == b).sum())
    return both > 0 and DEN * both >= NUM * (len(a) + len(b) - both)


def _compare(batches: Iterator[pa.RecordBatch], counts: bool) -> Iterator[pa.RecordBatch]:
    """Rows come by representative, its own first; gives the pairs that may reach the similarity or, of whole sets, do."""
    at, chosen, size = None, np.zeros(0, np.uint64), 0
    for batch in batches:
        found = []
        reps, roles, docs, sizes = (batch.column(i).to_pylist() for i in (0, 2, 3, 4))
        for rep, role, doc, n, raw in zip(reps, roles, docs, sizes, batch.column(5), strict=True):
            if role == 0:
                at, chosen, size = rep, np.frombuffer(raw.as_buffer(), np.uint8 if counts else np.uint64), n
            elif at == rep and n and size and min(n, size) * DEN >= NUM * max(n, size):
                grams = np.frombuffer(raw.as_buffer(), np.uint8 if counts else np.uint64)
                if _may_reach(chosen, grams, size, n) if counts else _reach(chosen, grams):
                    found.append((rep, doc))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["rep", "doc"])


def _side_by_side(pairs: DataFrame, source: DataFrame, counts: bool) -> DataFrame:
    """The pairs (rep, doc) that pass ``_compare``. A representative of many members goes to several tasks.

    ``source`` gives (doc, n, grams) of the ids it is joined with.
    """
    salts = pairs.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).alias("salts"))
    salted = staged(pairs.join(salts, "rep").select("rep", "doc", F.pmod(F.xxhash64("doc"), "salts").cast("int").alias("salt")), "salted")
    keys = salted.select("doc", "rep", "salt", F.lit(1).alias("role")).union(salted.select("rep", "rep", "salt", F.lit(0)).distinct())
    by_doc = keys.groupBy("doc").agg(F.collect_list(F.struct("rep", "salt", "role")).alias("keys"))
    rows = source(_small(staged(by_doc, "keys"))).select(F.explode("keys").alias("k"), "doc", "n", "grams").select("k.rep", "k.salt", "k.role", "doc", "n", "grams")
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "rep", "salt").sortWithinPartitions("rep", "salt", "role").mapInArrow(lambda it: _compare(it, counts), "rep bigint, doc bigint")


def _cheapest(index: DataFrame) -> DataFrame:
    """(sig, doc, comp, n, cells) of each set's segments but for the most frequent ones, as many as it has to spare.

    Similar sets share more segments than either has to spare, so the rarest that they share stays in both.
    """
    met = index.filter("n is null").select("sig", "doc", "comp")
    info = index.filter("n is not null").select("doc", "n", "spare", "cells")
    counts = met.groupBy("sig").agg(F.count(F.lit(1)).alias("met"))
    order = Window.partitionBy("doc").orderBy(F.desc("met"), "sig")  # a set's own segments
    ranked = met.join(counts, "sig").withColumn("place", F.row_number().over(order)).join(info, "doc")
    return ranked.filter("place > spare").select("sig", "doc", "comp", "n", "cells")


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in how many n-grams the sets differ at least: in one of each cell of another parity."""
    return np.bitwise_count((a ^ b).view(np.uint8)).sum(1, dtype=np.int64)


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by signature. Pairs of one signature and different components whose sizes and parities allow the similarity."""
    held: list[np.ndarray] = []

    def pairs(part: list[np.ndarray]) -> pa.RecordBatch:
        sig, doc, comp, n, cells = part
        left, right = [], []
        for step in range(1, len(sig)):
            at = np.flatnonzero(sig[step:] == sig[:-step])
            if not len(at):
                break
            to = at + step
            fit = (comp[at] != comp[to]) & (DEN * np.minimum(n[at], n[to]) >= NUM * np.maximum(n[at], n[to]))
            at, to = at[fit], to[fit]
            for low in range(0, len(at), 1 << 16):
                x, y = at[low : low + (1 << 16)], to[low : low + (1 << 16)]
                fit = (DEN + NUM) * _apart(cells[x], cells[y]) <= (DEN - NUM) * (n[x] + n[y])
                left.append(doc[x[fit]] >> 1)
                right.append(doc[y[fit]] >> 1)
        a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (left, right))
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["rep", "doc"])

    for batch in batches:
        new = [batch.column(i).to_numpy() for i in range(4)] + [batch.column(4).flatten().to_numpy().reshape(-1, CELLS)]
        held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
        cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
        if cut:
            yield pairs([x[:cut] for x in held])
            held = [x[cut:] for x in held]
    if held:
        yield pairs(held)


def _allowed(pairs: DataFrame, index: DataFrame) -> DataFrame:
    """The pairs (rep, doc) whose sizes and parities allow the similarity."""
    info = index.filter("n is not null and doc % 2 = 0").select(F.shiftright("doc", 1).alias("id"), "n", "cells")
    both = pairs.join(info.toDF("rep", "m", "rep_cells"), "rep").join(info.toDF("doc", "n", "cells"), "doc")
    apart = F.expr("aggregate(zip_with(cells, rep_cells, (a, b) -> bit_count((a ^ b) & 255)), 0, (s, d) -> s + d)")
    return both.filter(DEN * F.least("n", "m") >= NUM * F.greatest("n", "m")).filter((DEN + NUM) * apart <= (DEN - NUM) * (F.col("n") + F.col("m"))).select("rep", "doc")


def _crossing(kept: DataFrame) -> DataFrame:
    """Pairs (rep, doc) that share a signature across components and may reach the similarity."""
    parts = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kept.repartition(parts, "sig").sortWithinPartitions("sig").mapInArrow(_matched, "rep bigint, doc bigint").distinct()


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_SIGNATURES) -> tuple[DataFrame, DataFrame]:
    """(sizes, components): every document's set size, and (node, component) of those that are linked.

    First, documents that share one of a sample of the signatures are linked star by star, one
    candidate each at a time, which settles large groups at the cost of their size. Then all signatures
    are indexed with the components found, and every pair that shares one across components is
    compared. The sample doesn't change the result.
    """
    spark = docs.sparkSession
    rows = picked(docs, doc_id=id_col, text=text_col).select(integral(docs, id_col).alias("doc_id"), "text").filter(F.col("doc_id").isNotNull())
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * docs.rdd.getNumPartitions())

    def met(groups: DataFrame | None, part: int) -> DataFrame:
        placed = rows.withColumn("comp", F.col("doc_id"))
        if groups is not None:
            placed = rows.join(_small(groups.withColumnRenamed("node", "doc_id")), "doc_id", "left").select("doc_id", "text", F.coalesce("component", "doc_id").alias("comp"))
        packed = placed.mapInArrow(lambda it: _index(it, buckets, part), ROW)
        return staged(packed.groupBy("bucket").applyInArrow(_meet, "sig bigint, doc bigint, comp bigint, n bigint, spare bigint, cells array<tinyint>"), "index")

    def from_text(counts: bool):
        def join(keys: DataFrame) -> DataFrame:
            wide = rows.join(keys.withColumnRenamed("doc", "doc_id"), "doc_id").select(F.col("doc_id").alias("doc"), "text", "keys")
            fields = T.StructType([wide.schema["doc"], wide.schema["keys"], T.StructField("n", T.LongType()), T.StructField("grams", T.BinaryType())])
            return wide.mapInArrow(lambda it: _to_sets(it, counts), fields)

        return join

    def verified(pairs: DataFrame) -> DataFrame:
        return _side_by_side(pairs, from_text(False), False).toDF("a", "b")

    index = met(None, sample)
    sizes = index.filter("n is not null and doc % 2 = 0").groupBy(F.shiftright("doc", 1).alias("doc")).agg(F.max("n").alias("n_shingles"))
    some = index.filter("n is null").select("sig", F.shiftright("doc", 1).alias("doc"))
    edges, tried, groups = None, None, None
    for k in range(STAR_ROUNDS):
        placed = some.withColumn("c", F.col("doc")) if groups is None else some.join(groups.withColumnRenamed("node", "doc"), "doc", "left").select("sig", "doc", F.coalesce("component", "doc").alias("c"))
        placed = staged(placed, "placed")
        pick = F.min_by if k % 2 == 0 else F.max_by
        stars = placed.groupBy("sig").agg(pick("doc", F.struct("c", "doc")).alias("rep"), pick("c", F.struct("c", "doc")).alias("rep_c"), F.min("c").alias("x"), F.max("c").alias("y")).filter("x <> y").drop("x", "y")
        votes = placed.join(stars, "sig").filter("c <> rep_c").groupBy("doc", "rep").agg(F.count(F.lit(1)).alias("n"))
        if tried is not None:
            votes = votes.join(tried, ["doc", "rep"], "left_anti")
        pairs = staged(votes.groupBy("doc").agg(F.max_by("rep", F.struct("n", -F.col("rep"))).alias("rep")).select("rep", "doc"), "pairs")
        if pairs.isEmpty():
            break
        found = verified(_allowed(pairs, index))
        edges = staged(found if edges is None else edges.union(found), "links")
        tried = pairs if tried is None else tried.union(pairs)
        groups = staged(connected(edges), "groups")
    cross = _crossing(_cheapest(met(groups, 1)))
    cross = staged(cross if tried is None else cross.join(tried.union(tried.select(F.col("doc"), F.col("rep"))), ["rep", "doc"], "left_anti"), "pairs")
    if not cross.isEmpty():
        found = verified(staged(_side_by_side(cross, from_text(True), True), "near"))
        edges = staged(found if edges is None else edges.union(found), "links")
        groups = connected(edges)
    if groups is None:
        groups = sizes.select(F.col("doc").alias("node"), F.col("doc").alias("component")).filter("false")
    return sizes, groups


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles`` and ``component_id``, the least id that links reach.

    ``doc_id`` is an integer. Words are lower-cased (ASCII) and parted by white space; a document is its set of
    distinct ``NGRAM``-word shingles, or of its whole sequence if shorter. Null and empty texts have no
    shingles and are linked with nothing. Rows with a null id keep a null component. Rows that repeat
    an id are one document and must repeat its text; extra columns are ignored; an empty table gives no rows.
    """
    sizes, groups = links(docs, id_col, text_col, **options)
    rows = picked(docs, doc_id=id_col).select(F.col("doc_id").cast("long"))
    out = rows.join(sizes.withColumnRenamed("doc", "doc_id"), "doc_id", "left").join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group of similar ones, that with the least id; all columns stay."""
    _, groups = links(docs, id_col, text_col, **options)
    gone = groups.filter("node <> component").select(F.col("node").alias(id_col))
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
