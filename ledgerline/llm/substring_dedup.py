"""Substring dedup: words in a window that starts in an earlier document too are removed.

1. Each window of ``window`` words has an anchor, the phrase of a few words with the least
   hash in it; equal windows have equal anchors. Anchors are grouped by their words: those of more than one
   document are confirmed as recurring phrases.
2. The confirmed phrases are cut into shards of some ten thousand, those first seen in one document together. Documents
   go to the shards of their anchors, in blocks of some MB; each task compiles its shard's phrases into an Aho-Corasick
   automaton and streams its block through it. A document is never told where a phrase stands in it: the automaton alone
   locates every occurrence, and a window may recur only if its anchor is such an occurrence.
3. All documents of a window meet in the shard of its anchor, over the shard's blocks: windows meet by hash there, each
   block sending one entry for equal ones, and each block learns which of its windows start in a smaller document.
4. The words these windows cover go.

Shards grow in number, not in size, and a frequent phrase's documents are many blocks. A document without a confirmed phrase holds
no recurring window and doesn't stream; the others stream through as many automata as there are shards of their anchors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words
from .common import integral, picked, staged

WINDOW = 50
PHRASE = 8
#: Phrases of an automaton, and bytes of the documents that one task streams through it.
SHARD_PHRASES = 1 << 15
BLOCK_BYTES = 16 << 20
#: Id tables up to so many rows are broadcast.
BROADCAST_ROWS = 1_000_000
#: Beyond them, the parts in which the documents of one phrase look for its shard.
SALTS = 16
#: Entries of windows that one task resolves.
RESOLVE_ROWS = 1 << 20


def _sliding_min(g: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values."""
    span = 1
    while 2 * span <= width:
        g = np.minimum(g[:-span], g[span:])
        span *= 2
    return np.minimum(g[: len(g) - (width - span)], g[width - span :]) if width > span else g


def _phrases(w: words.Words, phrase: int) -> np.ndarray:
    """Hash of the phrase at each word, also of those that reach into the next text."""
    return words.mix(words.chained(w.hash, phrase))


def _joined(w: words.Words, raw: bytes, d: int, keep: np.ndarray | None = None) -> bytes:
    if keep is None:
        return b" ".join(raw[w.offs[d] : w.offs[d + 1]].split())
    low, high = w.first[d], w.first[d + 1]
    return b" ".join(raw[s:e] for s, e in zip(w.start[low:high][keep].tolist(), w.end[low:high][keep].tolist(), strict=True))


def _survey(batches: Iterator[pa.RecordBatch], window: int, phrase: int) -> Iterator[pa.RecordBatch]:
    """Per document: words, bytes, digest of all words joined, and its anchors with their words."""
    for batch in batches:
        for low, high, data, offs in words.pieces(batch.column(2)):
            w, raw = words.Words(data, offs, words.SPACED), data.tobytes()
            at, text = np.zeros(0, np.int64), w.text
            if len(w) >= window:
                at = np.flatnonzero(text[: len(w) - window + 1] == text[window - 1 :])
            grams = _phrases(w, phrase)
            anchor = _sliding_min(grams, window - phrase + 1)[at] if len(at) else np.zeros(0, np.uint64)
            doc = text[at]
            fresh = np.ones(len(at), dtype=bool)
            fresh[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
            place = _anchor_places(grams, at[fresh], window - phrase + 1)
            said = [b" ".join(raw[s:e].split()) for s, e in zip(w.start[place].tolist(), w.end[place + phrase - 1].tolist(), strict=True)]
            ends = np.searchsorted(doc[fresh], np.arange(len(w.count) + 1)).astype(np.int32)
            shas = [hashlib.sha256(_joined(w, raw, d)).hexdigest() for d in range(len(w.count))]
            part = batch.slice(low, high - low)
            pairs = pa.StructArray.from_arrays([pa.array(anchor[fresh].view(np.int64)), pa.array(said, pa.binary())], ["anchor", "phrase"])
            anchors = pa.ListArray.from_arrays(pa.array(ends), pairs)
            columns = [part.column(0), part.column(1), pa.array(w.count.astype(np.int64)), pa.array(np.diff(offs)), pa.array(shas), anchors]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "n_words", "bytes", "sha256", "anchors"])


def _anchor_places(grams: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Where the least of the ``width`` hashes from each start stands."""
    out = np.zeros(len(starts), dtype=np.int64)
    for low in range(0, len(starts), 1 << 14):
        some = starts[low : low + (1 << 14)]
        out[low : low + len(some)] = some + grams[some[:, None] + np.arange(width)].argmin(1)
    return out


def _compiled(ids: np.ndarray, places: np.ndarray, phrase: int) -> ahocorasick.Automaton | None:
    """The automaton of the phrases that begin at ``places`` of ``ids``; of no phrases there is none."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
    for s in places.tolist():
        automaton.add_word(tuple(ids[s : s + phrase].tolist()))
    if not len(automaton):
        return None
    automaton.make_automaton()
    return automaton


def _located(ids: np.ndarray, w: words.Words, phrases: ahocorasick.Automaton | np.ndarray | None, window: int, phrase: int, grams: np.ndarray | None = None) -> np.ndarray:
    """Starts of the windows that hold one of the phrases, all of whose occurrences an automaton locates.

    ``phrases`` is the automaton, or the places of its phrases in ``ids``. With the hashes of the phrase at each word
    (``grams``), only windows whose least one was located count.
    """
    automaton = _compiled(ids, phrases, phrase) if isinstance(phrases, np.ndarray) else phrases
    if automaton is None or len(w) < window:
        return np.zeros(0, np.int64)
    at = np.zeros(len(w), dtype=bool)
    for d in np.flatnonzero(w.count >= window).tolist():
        low, high = int(w.first[d]), int(w.first[d + 1])
        at[[low + end - phrase + 1 for end, _ in automaton.iter(tuple(ids[low:high].tolist()))]] = True
    text, width = w.text, window - phrase + 1
    whole = text[: len(w) - window + 1] == text[window - 1 :]
    if grams is not None:
        least = _sliding_min(grams, width)[: len(whole)]
        found = _sliding_min(np.where(at[: len(grams)], grams, words.U64(2**64 - 1)), width)[: len(whole)]
        return np.flatnonzero(whole & (least == found) & _any(at, width)[: len(whole)])
    return np.flatnonzero(whole & _any(at, width)[: len(whole)])


def _any(flags: np.ndarray, width: int) -> np.ndarray:
    """Whether any of each ``width`` consecutive flags is set."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[width:] > total[:-width]


def _stream(docs: pa.Table, phrases: pa.Table, window: int, phrase: int) -> pa.Table:
    """A block of documents through the automaton of its shard: per piece of the block, the windows located and their hashes."""
    rows = []
    if docs.num_rows and phrases.num_rows:
        data, offs = words.text_bytes(phrases["phrase"])
        said = words.Words(data[offs[0] : offs[-1]], offs - offs[0], words.SPACED)
        vocabulary, ids = np.unique(said.hash, return_inverse=True)
        automaton = _compiled(ids, said.first[:-1], phrase)
        shard, block = docs["shard"][0].as_py(), docs["block"][0].as_py()
        for low, high, data, offs in words.pieces(docs["text"]):
            w = words.Words(data, offs, words.SPACED)
            at = np.minimum(np.searchsorted(vocabulary, w.hash), len(vocabulary) - 1)
            ids = np.where(vocabulary[at] == w.hash, at, len(vocabulary))  # words of no phrase are one other word
            starts = _located(ids, w, automaton, window, phrase, _phrases(w, phrase))
            if not len(starts):
                continue
            text, part = w.text[starts], docs.slice(low, high - low)
            held = np.bincount(text, minlength=high - low)
            some = np.flatnonzero(held)
            rows.append({
                "shard": shard, "piece": f"{shard}-{block}-{low}", "doc_ids": part["doc_id"].take(pa.array(some)).to_pylist(),
                "text_keys": part["text_key"].take(pa.array(some)).to_pylist(), "held": held[some].tolist(),
                "starts": (starts - w.first[text]).astype(np.int32).tobytes(), "hashes": words.mix(words.chained(w.hash, window))[starts].tobytes(), "windows": len(starts),
            })
    return pa.Table.from_pylist(rows, LOCATED)


LOCATED = pa.schema([("shard", pa.int32()), ("piece", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("text_keys", pa.list_(pa.int64())), ("held", pa.list_(pa.int64())), ("starts", pa.binary()), ("hashes", pa.binary()), ("windows", pa.int64())])
LOCATED_TYPE = "shard int, piece string, doc_ids array<bigint>, text_keys array<bigint>, held array<bigint>, starts binary, hashes binary, windows bigint"


def _distinct(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a piece: its windows' owners, the distinct hashes, each window's, and the least id of each."""
    owner = np.repeat(np.array(row["doc_ids"], dtype=np.int64), row["held"])
    distinct, which = np.unique(np.frombuffer(row["hashes"], np.uint64), return_inverse=True)
    least = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(least, which, owner)
    return owner, distinct, which, least


def _ask(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            _, distinct, _, least = _distinct(row)
            to = (distinct >> words.U64(20)) % words.U64(buckets)
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange(buckets + 1).astype(np.uint64))
            some = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(some, pa.int32()), pa.array([row["piece"]] * len(some), pa.string()),
                    pa.array([distinct[order[cuts[b] : cuts[b + 1]]].tobytes() for b in some], pa.binary()),
                    pa.array([least[order[cuts[b] : cuts[b + 1]]].tobytes() for b in some], pa.binary()),
                ],
                ["bucket", "piece", "hashes", "least"],
            )


def _answer(asked: pa.Table) -> pa.Table:
    """Per piece the hashes of the bucket that a smaller document of another piece has."""
    parts = [(np.frombuffer(h, np.uint64), np.frombuffer(m, np.int64)) for h, m in zip(asked["hashes"].to_pylist(), asked["least"].to_pylist(), strict=True)]
    hashes, least = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    distinct, which = np.unique(hashes, return_inverse=True)
    first = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(first, which, least)
    earlier, at, out = first[which] < least, 0, []
    for h, _ in parts:
        out.append(h[earlier[at : at + len(h)]].tobytes())
        at += len(h)
    keep = [i for i, o in enumerate(out) if o]
    return pa.table({"piece": asked["piece"].take(pa.array(keep, pa.int64())), "earlier": pa.array([out[i] for i in keep], pa.binary())})


def _spans(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Per document of a piece, the runs of words that go."""
    for batch in batches:
        for row in batch.to_pylist():
            owner, distinct, which, least = _distinct(row)
            elsewhere = np.isin(distinct, np.frombuffer(b"".join(row["earlier"] or []), np.uint64))
            gone = elsewhere[which] | (least[which] < owner)
            starts, out, at = np.frombuffer(row["starts"], np.int32), [], 0
            for doc_id, key, n in zip(row["doc_ids"], row["text_keys"], row["held"], strict=True):
                mine = starts[at : at + n][gone[at : at + n]].astype(np.int64)
                at += n
                if len(mine):
                    edge = np.flatnonzero(np.diff(mine) > window)  # between runs that don't touch
                    first, last = mine[np.concatenate([[0], edge + 1])], mine[np.concatenate([edge, [len(mine) - 1]])]
                    out.append((doc_id, key, [{"start": int(a), "length": int(b) + window - int(a)} for a, b in zip(first, last, strict=True)]))
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), SPANS), strict=True)], ["doc_id", "text_key", "spans"])


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents without the words of their runs, which may overlap."""
    names = ["doc_id", "text_key", "n_removed", "kept", "removed"]
    for batch in batches:
        out = []
        for doc_id, key, text, spans in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            said = text.encode().split()
            edge = np.zeros(len(said) + 1, dtype=np.int32)
            np.add.at(edge, [s["start"] for s in spans], 1)
            np.add.at(edge, [s["start"] + s["length"] for s in spans], -1)
            gone = np.cumsum(edge[:-1]) > 0
            runs = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).reshape(-1, 2)
            kept = b" ".join([said[k] for k in np.flatnonzero(~gone).tolist()]).decode()
            out.append((doc_id, key, int(gone.sum()), kept, [{"start": int(a), "length": int(b - a)} for a, b in runs]))
        columns = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), SPANS), strict=True)], names)


def recurring_phrases(survey: DataFrame) -> DataFrame:
    """The anchors that more than one document has, compared by their words: ``anchor``, ``phrase`` and the least document's id, ``first``."""
    anchors = survey.filter(F.col("doc_id").isNotNull()).select("doc_id", F.inline("anchors"))
    seen = anchors.groupBy("anchor", "phrase").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    return seen.filter("first <> last").drop("last")


def _shards_of(survey: DataFrame, phrases: DataFrame, n_phrases: int) -> DataFrame:
    """Per document the shards of its anchors, their number being bounded by that of the shards."""
    anchors = survey.filter(F.col("doc_id").isNotNull()).select("doc_id", "text_key", "bytes", F.explode("anchors.anchor").alias("anchor"))
    lookup = phrases.select("anchor", "shard").distinct()
    if n_phrases <= BROADCAST_ROWS:
        met = anchors.join(F.broadcast(lookup), "anchor")
    else:  # the documents of a frequent phrase ask in parts
        lookup = lookup.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = anchors.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(SALTS)).cast("int")).join(lookup, ["anchor", "salt"])
    return met.groupBy("doc_id", "text_key").agg(F.max("bytes").alias("bytes"), F.collect_set("shard").alias("shards"))


def repeated_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, phrase: int = PHRASE, shard_phrases: int = SHARD_PHRASES, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256``, ``kept`` (null where nothing
    went) and ``removed`` (runs of words).

    ``doc_id`` is an integer. Words are what stands between white space. Windows are judged on the
    input. Null or shorter texts lose nothing, nor do rows with a null id, which are no one's earlier document; rows with
    equal ids are one document. An empty table gives no rows; extra columns are ignored. A document must fit a task, and
    so must the phrases that were first seen in one document.
    """
    rows = picked(docs, doc_id=id_col, text=text_col).select(integral(docs, id_col).alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    kind = "doc_id bigint, text_key bigint, n_words bigint, bytes bigint, sha256 string, anchors array<struct<anchor:bigint,phrase:binary>>"
    survey = staged(rows.mapInArrow(lambda it: _survey(it, window, phrase), kind), "survey")
    confirmed = staged(recurring_phrases(survey), "phrases")
    n_phrases = confirmed.count()
    n_shards = max(1, -(-n_phrases // shard_phrases))
    phrases = confirmed.withColumn("shard", F.pmod(F.xxhash64("first"), F.lit(n_shards)).cast("int"))
    marked = staged(_shards_of(survey, phrases, n_phrases), "marked")
    blocks = marked.select(F.explode("shards").alias("shard"), "bytes").groupBy("shard").agg(F.ceil(F.sum("bytes") / block_bytes).cast("int").alias("blocks")).withColumn("blocks", F.greatest("blocks", F.lit(1)))
    blocks = F.broadcast(blocks) if n_shards <= BROADCAST_ROWS else blocks
    found = F.broadcast(marked) if marked.count() <= BROADCAST_ROWS else marked
    dealt = rows.join(found.drop("bytes"), ["doc_id", "text_key"]).withColumn("shard", F.explode("shards")).drop("shards").join(blocks, "shard")
    dealt = dealt.select("shard", F.pmod(F.xxhash64("doc_id", "text_key"), F.col("blocks")).cast("int").alias("block"), "doc_id", "text_key", "text")
    lists = phrases.join(blocks, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "phrase")
    streamed = dealt.groupBy("shard", "block").cogroup(lists.groupBy("shard", "block")).applyInArrow(lambda d, p: _stream(d, p, window, phrase), LOCATED_TYPE)
    located = staged(streamed, "located")
    total = located.agg(F.sum("windows").alias("n")).first()["n"] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // RESOLVE_ROWS))
    asked = located.mapInArrow(lambda it: _ask(it, buckets), "bucket int, piece string, hashes binary, least binary")
    answers = asked.groupBy("bucket").applyInArrow(_answer, "piece string, earlier binary").groupBy("piece").agg(F.collect_list("earlier").alias("earlier"))
    spans = located.join(answers, "piece", "left").mapInArrow(lambda it: _spans(it, window), "doc_id bigint, text_key bigint, spans array<struct<start:bigint,length:bigint>>")
    spans = staged(spans.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    losing = spans.select("doc_id", "text_key")
    if losing.count() <= BROADCAST_ROWS:  # only the texts that lose words are shuffled
        rows = rows.join(F.broadcast(losing), ["doc_id", "text_key"], "left_semi")
    whole = rows.join(spans, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "spans")
    cut = whole.mapInArrow(_cut, "doc_id bigint, text_key bigint, n_removed bigint, kept string, removed array<struct<start:bigint,length:bigint>>")
    once = cut.dropDuplicates(["doc_id", "text_key"])
    return survey.select("doc_id", "text_key", "n_words", "sha256").join(once, ["doc_id", "text_key"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("kept").isNull(), F.col("sha256")).otherwise(F.sha2("kept", 256)).alias("kept_sha256"), "kept", "removed",
    )
