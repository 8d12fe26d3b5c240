"""Compression classifier of text quality.

Two zstandard dictionaries are trained on good and bad labelled text. A text that resembles good
text compresses better with the good one; the difference of the two sizes, divided by
their sum, becomes a probability by a logistic calibration on other labelled rows. Nothing else enters the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import picked, staged

#: The most labelled rows of each class that are read to fit, each with its whole text.
SAMPLE_ROWS = 1500
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
BLOCK_BYTES = 128
#: Length of the pieces that dictionaries are made of, and of their common parts, in bytes.
SEGMENT, PART = 64, 8


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learnt from: those whose id, as text, has a CRC-32 divisible by 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


@dataclass
class Model:
    """Dictionaries of bad (0) and good (1) text, and the calibration of the normalised size difference."""

    dictionaries: tuple[bytes, bytes] | None = None
    intercept: float = 0.0
    slope: float = 0.0
    _tools: list = field(default_factory=list, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tools": []}

    def difference(self, raw: bytes) -> float:
        """How much smaller a text gets with the good dictionary than with the bad one, divided by both sizes' sum.

        Blocks of the whole text are compressed each on its own, so that what repeats inside it doesn't hide what it resembles.
        """
        if not self._tools:
            for content in self.dictionaries:
                d = zstandard.ZstdCompressionDict(content)
                d.precompute_compress(LEVEL)
                self._tools.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
        parts = [raw[i : i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)] or [b""]
        bad, good = (sum(map(len, map(t.compress, parts))) for t in self._tools)
        return (bad - good) / (bad + good)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        x = np.array([self.difference(t) for t in texts]) if self.dictionaries else np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(x * self.slope + self.intercept, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05, steps: int = 60) -> np.ndarray:
    """Weights (intercept first) by Newton's method with step halving. The ridge, which few rows feel most, spares the intercept."""
    x1 = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x1.shape[1])
    ridges = np.append(1e-6, np.full(x.shape[1], ridge))

    def loss(v: np.ndarray) -> float:
        z = x1 @ v
        return float(np.sum(weight * (np.logaddexp(0, z) - y * z)) + ridges @ (v * v) / 2)

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        g = x1.T @ (weight * (p - y)) + ridges * w
        h = (x1 * (weight * p * (1 - p))[:, None]).T @ x1 + np.diag(ridges)
        move, step = np.linalg.solve(h, g), 1.0
        while (then := loss(w - step * move)) > now and step > 1e-6:
            step /= 2
        if now - then < 1e-9:
            break
        w, now = w - step * move, then
    return w


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE_ROWS) -> tuple[DataFrame, tuple[int, int]]:
    """(doc_id, label, half, text) of at most ``rows`` rows of each class, picked by a hash of the id among those not held out, and the classes' label counts.

    The ids are picked in ``labels`` alone; ids with no label or with contradictory ones aren't used. Of rows that
    repeat an id, the least text counts.
    """
    known = picked(labels, doc_id=id_col, label=label_col).filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    one = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter(F.col("label") == F.col("most")).drop("most")
    counts = {int(r["label"]): r["count"] for r in one.groupBy("label").count().collect()}  # two rows
    some = [one.filter(F.col("label") == k).orderBy(F.xxhash64(F.col("doc_id")), "doc_id").limit(rows) for k in (0, 1)]
    texts = picked(docs, doc_id=id_col, text=text_col).join(F.broadcast(some[0].union(some[1])), "doc_id")  # at most 2 * rows ids
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).cast("int")
    found = texts.groupBy("doc_id", "label").agg(F.min(F.coalesce(F.col("text"), F.lit(""))).alias("text"))
    return found.select("doc_id", F.col("label").cast("int").alias("label"), half.alias("half"), "text"), (counts.get(0, 0), counts.get(1, 0))


def trained(texts: list[bytes]) -> bytes:
    """A dictionary of what the texts have in common; so few that nothing can be trained are the dictionary themselves."""
    size = min(DICTIONARY_BYTES, sum(map(len, texts)) // 4)
    try:
        return zstandard.train_dictionary(size, texts, k=SEGMENT, d=PART, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"\n".join(texts).ljust(16)[-DICTIONARY_BYTES:]


def _dictionaries(group: pa.Table) -> pa.Table:
    """Of the training rows of a class (at most ``SAMPLE_ROWS`` of them) the dictionary."""
    texts = [t.encode() for t in group.sort_by("doc_id").column("text").to_pylist() if t]
    return pa.table({"label": group.column("label").slice(0, 1), "n": pa.array([len(texts)], pa.int64()), "dictionary": pa.array([trained(texts) if len(texts) > 1 else b""], pa.binary())})


def fit(docs: DataFrame, labels: DataFrame, **options) -> Model:
    """One half of the sampled rows trains the dictionaries, the other calibrates, weighted by the classes' label counts.

    Both are of whole texts, and a task for each class trains its dictionary. Only the dictionaries and the differences come to the driver.
    """
    sample, counts = labelled(docs, labels, **options)
    sample = staged(sample, "labelled")
    share = (counts[1] + 1) / (sum(counts) + 2)
    plain = Model(intercept=float(np.log(share / (1 - share))))
    made = sample.filter("half = 0").groupBy("label").applyInArrow(_dictionaries, "label int, n long, dictionary binary").collect()  # two rows
    by = {r["label"]: bytes(r["dictionary"]) for r in made if r["n"] > 1}
    if len(by) < 2:
        return plain
    model = Model((by[0], by[1]))

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.difference(t.encode()) for t in batch.column(1).to_pylist()], pa.float64())], ["label", "x"])

    found = sample.filter("half = 1").orderBy("doc_id").select("label", "text").mapInArrow(differences, "label int, x double").collect()
    y, x = (np.array([float(r[c]) for r in found]) for c in ("label", "x"))
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return plain
    weight = np.array(counts) / np.maximum(np.bincount(y.astype(int), minlength=2), 1)
    weight *= len(y) / weight[y.astype(int)].sum()
    centre, scale = x.mean(), x.std() + 1e-9
    w = logistic(((x - centre) / scale)[:, None], y, weight[y.astype(int)])
    model.slope = float(w[1] / scale)
    model.intercept = float(w[0] - model.slope * centre)
    return model


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = 0.3,
    sample_rows: int = SAMPLE_ROWS,
    model: Model | None = None,
) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``held_out``, ``score`` (0 to 1, higher is better) and ``predicted``.

    Whole texts are compressed; null counts as empty. With too few labelled rows of a class (two in each half)
    every score is the share of good ones. Ids and other columns never enter a score. Repeated rows are scored each, rows with a null id too; an
    empty table gives no rows.
    """
    model = model or fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, rows=sample_rows)
    rows = picked(docs, doc_id=id_col, text=text_col)
    scored = _scored(rows.select(F.struct("doc_id").alias("row"), "text"), model, threshold)
    return scored.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` without those that score below the threshold; all columns stay. Nulls, repeated rows and empty tables as in ``quality_scores``."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, rows=sample_rows)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    return _scored(rows, model, threshold).filter("predicted = 1").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def _scored(rows: DataFrame, model: Model, threshold: float) -> DataFrame:
    """``row`` (whatever it holds), ``score`` and ``predicted`` of rows (row, text)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY_BYTES at most

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                texts = [(t or "").encode() for t in part.column(1).to_pylist()]
                s = shared.value.scores(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["row", "score", "predicted"])

    return rows.mapInArrow(score, T.StructType([rows.schema["row"]]).add("score", "double").add("predicted", "integer"))
