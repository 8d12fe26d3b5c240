"""Host-level quality rules.

Rule failures of documents are counted by host; each host's failure rate is shrunk by a
beta prior fitted to all hosts (method of moments); a host whose shrunk rate is above the
limit fails as a whole, and that verdict joins back to its documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import words
from .common import picked, staged, with_groups

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_BLANKS = b" \t\n\x0b\x0c\r"
#: The prior's weight, in documents, where hosts don't differ beyond chance.
NO_SPREAD = 1e9
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column(batch.schema.get_field_index("text"))
        for low, high, data, offs in words.pieces(text):
            w = words.Words(data, offs, words.SPACED)
            visible = words.SPACED[data] & ((data & 0xC0) != 0x80)
            at, h = w.windows(5)
            key = words.mix(h + w.text[at].astype(np.uint64))
            order = np.argsort(key)
            same = key[order[1:]] == key[order[:-1]]
            twice = np.zeros(len(at), dtype=bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            out = {
                "n_words": w.count,
                "word_chars": words.sums_at(visible, offs),
                "n_symbols": words.sums_at(SYMBOLS[data], offs),
                "n_dup_lines": _repeated_lines(data, offs),
                "n_repeat_words": w.per_text(words.covered(at[twice], 5, len(w))),
            }
            kept = [batch.column(i).slice(low, high - low) for i in range(batch.num_columns) if batch.schema.names[i] != "text"]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(kept + [pa.array(v.astype(np.int64)) for v in out.values()], names + list(out))


def _repeated_lines(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    raw, out = data.tobytes(), np.zeros(len(offs) - 1, dtype=np.int64)
    for d in range(len(out)):
        lines = [x for x in raw[offs[d] : offs[d + 1]].split(b"\n") if x.strip(_BLANKS)]
        out[d] = len(lines) - len(set(lines))
    return out


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per document: ``doc_id``, ``host`` and the measures of its whole text."""
    rows = picked(docs, doc_id=id_col, host=host_col, text=text_col)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("text").schema)
    return rows.mapInArrow(_measure, fields + "".join(f", {m} bigint" for m in MEASURES))


def base_failed(min_words: int, max_repeat_pct: int) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))


def host_rates(per_doc: DataFrame) -> DataFrame:
    """Per host: documents, failures by rule, and the failure rate shrunk by the empirical beta prior.

    The prior's mean is that of the hosts' rates and its weight follows from their variance, less the part that counts of
    so few documents have by chance; the weight is that of one document at least, and with no spread beyond chance (or one
    host) all hosts have the mean. A null host is a host of its own.
    """
    hosts = staged(
        per_doc.groupBy("host").agg(
            F.count(F.lit(1)).alias("docs"),
            F.sum(F.col("base_failed").cast("long")).alias("failed"),
            F.sum(F.col("too_short").cast("long")).alias("failed_short"),
            F.sum(F.col("repetitive").cast("long")).alias("failed_repeats"),
        ),
        "hosts",
    )
    rate = F.col("failed") / F.col("docs")
    spread = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"), F.avg(1 / F.col("docs")).alias("few")).first()  # one row
    mean = spread["m"] or 0.0
    var = (spread["v"] or 0.0) - mean * (1 - mean) * (spread["few"] or 0.0)
    weight = max(1.0, mean * (1 - mean) / var - 1) if var > 0 else NO_SPREAD
    return hosts.withColumn("host_rate", (F.col("failed") + F.lit(mean * weight)) / (F.col("docs") + F.lit(weight)))


def host_quality(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 10,
    max_repeat_pct: int = 20,
    max_host_rate: float = 0.5,
) -> DataFrame:
    """One row per document: its measures, ``base_failed``, its host's figures and ``kept``.

    Null or empty texts have no words and fail. Repeated rows stay repeated, each judged alone.
    Empty input gives an empty result. Hosts of more than a 1,024th of the documents are dealt over many tasks. Columns other than the three named ones are ignored.
    """
    per_doc = staged(
        measures(docs, id_col, text_col, host_col)
        .withColumn("too_short", F.col("n_words") < min_words)
        .withColumn("repetitive", 100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
        .withColumn("base_failed", base_failed(min_words, max_repeat_pct)),
        "quality",
    )
    hosts = host_rates(per_doc).withColumn("host_kept", F.col("host_rate") <= max_host_rate)
    key = F.struct(F.col("host").isNull().alias("no"), F.coalesce(F.col("host").cast("string"), F.lit("")).alias("h"))
    left, right = per_doc.withColumn("k", key), hosts.withColumn("k", key).withColumn("n", F.col("docs")).drop("host")
    met = with_groups(left, right, "k", "doc_id", per_doc.count())
    return met.drop("k", "n").withColumn("kept", ~F.col("base_failed") & F.col("host_kept"))
