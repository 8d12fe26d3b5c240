"""Fuzzy line dedup in DataFrame functions alone.

A line's set are the shingles of ``SHINGLE`` characters at all its positions, in lower case. Its MinHash
values are the least hashes of ``BINS`` equal parts of the ring of hashes, an empty part taking the
next one's; they are aggregates over the exploded positions, which Spark compiles. Bands of two
values bring alike lines together: all pairs of small buckets at once; of large ones first, in rounds, one line and those of other
components, then all pairs that these links don't join yet. Of such pairs, sketches rule out those whose sets provably differ too much, the
others are compared exactly; union-find joins the links, and the first line of each component stays.

Equal lines are one from the start. Texts are shuffled only of lines that share a band.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import picked, staged
from .components import connected

SHINGLE = 9
SIMILARITY = 0.75
#: Where callers don't say otherwise, lines of fewer words aren't judged; op5 and the pipeline judge all that aren't blank (1).
MIN_WORDS = 3
BINS = 16
#: Pairs of parts of the ring whose values make a band.
BANDS = ((0, 9), (3, 12), (6, 15), (2, 8), (5, 13), (4, 11), (1, 14), (7, 10))
#: Hashes of a part that are looked at in a line without repetition: its least ones. Empty parts from which a line is read again.
DEPTH, EMPTY = 5, 4
#: Of ``BINS`` values, those that lines must have in common to be compared, once they have ``FILLED`` shingles: a pair of
#: similarity 0.75 falls short with a probability of 0.008, one of 0.8 with 0.0015.
AGREEING, FILLED = 8, 64
BROADCAST_ROWS = 1_000_000
#: Lines of a bucket up to which all its pairs are made at once, so that their number grows with that of the lines.
SMALL = 64
#: Turns, at least two, in which one line of each larger bucket meets the others, and the lines of a bucket in the round after them.
STAR_ROUNDS, STARS = 2, 32
#: Lines of a bucket that meet in one task.
BLOCK = 1024
#: Longs of a line's sketch.
WORDS = 32
#: Share of all lines from which an equal line counts as hot; there are at most as many hot ones.
HOT_SHARE = 1e-4


def _wide(line: Column) -> Column:
    """A line in lower case with two bytes a character (one beyond the basic plane counts as two)."""
    return F.encode(F.lower(line), "UTF-16BE")


def _positions(wide: str) -> Column:
    return F.greatest(F.expr(f"octet_length({wide}) div 2 - {SHINGLE - 1}"), F.lit(1))


def _offsets(n: Column) -> Column:
    """Where the shingles of a column of two bytes a character begin, in bytes from 1."""
    return F.sequence(F.lit(1), (2 * n - 1).cast("int"), F.lit(2))


def shingle_hashes(wide: str) -> Column:
    """Hashes of the ``SHINGLE`` characters at each position of a column of two bytes a character; a shorter line is its own one shingle.

    The bytes are an element of an array, since a lambda would copy a column's at each position.
    """
    found = F.transform(F.array(wide), lambda w: F.transform(_offsets(_positions(wide)), lambda at: F.xxhash64(F.substring(w, at, F.lit(2 * SHINGLE)))))
    return F.get(found, F.lit(0))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return picked(docs, doc_id=id_col, text=text_col).filter(F.col("doc_id").isNotNull())


def judged_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Every line of at least ``min_words`` words: ``doc_id``, ``line_no``, ``line`` and its hash ``h``."""
    lines = _rows(docs, id_col, text_col).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    pattern = r"\S" if min_words <= 1 else rf"^\s*+(?:\S++\s++){{{min_words - 1}}}\S"
    return lines.filter(F.col("line").rlike(pattern)).withColumn("h", F.xxhash64("line"))


def _values(lines: DataFrame, depth: int | None) -> DataFrame:
    """Per line: ``h``, its number of positions ``n``, and the least hash of each part, null where there is none (below the bound).

    Aggregates of longs over exploded positions, in compiled code from the text to the partial aggregate. With a ``depth``
    only hashes below a bound are aggregated, as many of a part as that if all shingles differ; the first position
    keeps every line in the result.
    """
    wide = lines.select("h", _wide(F.col("line")).alias("wide")).select("h", "wide", _positions("wide").alias("n"))
    # The bound is a line's own, so it is worked out before its positions are rows.
    bound = F.when(F.col("n") > depth * BINS, (float(depth * BINS << 60) / F.col("n")).cast("bigint")) if depth else F.lit(None).cast("bigint")
    at = wide.select("h", "wide", "n", F.coalesce(bound, F.lit(1 << 60)).alias("bound"), F.explode(_offsets(F.col("n"))).alias("at"))
    hashed = at.select("h", "n", "at", "bound", F.xxhash64(F.substring(F.col("wide"), F.col("at"), F.lit(2 * SHINGLE))).alias("g"))
    low = F.col("g").bitwiseAND((1 << 60) - 1) < F.col("bound")
    kept = hashed.filter(low | (F.col("at") == 1)).select("h", "n", F.when(low, F.col("g")).alias("g"), (F.shiftright("g", 60) + BINS // 2).cast("int").alias("part"))
    return kept.groupBy("h").agg(F.max("n").alias("n"), *[F.min(F.when(F.col("part") == k, F.col("g"))).alias(f"m{k}") for k in range(BINS)])


def signatures(lines: DataFrame) -> DataFrame:
    """Per distinct line: ``h``, ``n``, a digest of its values (``low``, ``high``) and its bands; an empty part takes the next one's value.

    Lines that repeat themselves so much that several parts stay empty below the bound are aggregated again without one; few
    others are (a part is empty by chance with a probability of exp(-DEPTH)).
    """
    bounded = staged(_digested(_values(lines, DEPTH)), "signatures")
    again = bounded.filter((F.col("n") > DEPTH * BINS) & (F.col("empty") > EMPTY)).select("h")
    # Written, or all texts would be read anew for these few lines wherever signatures are used.
    whole = staged(_digested(_values(lines.join(_small(again), "h"), None)), "repeated_signatures")
    return bounded.join(_small(again), "h", "left_anti").unionByName(whole).drop("empty")


def _digested(values: DataFrame) -> DataFrame:
    """``h``, ``n``, the number of empty parts, a byte of each value in two longs, and the bands."""
    empty = sum((F.col(f"m{k}").isNull().cast("int") for k in range(BINS)), F.lit(0))
    full = values.select("h", "n", empty.alias("empty"), *[F.coalesce(*[F.col(f"m{(k + j) % BINS}") for j in range(BINS)], F.lit(0)).alias(f"m{k}") for k in range(BINS)])
    bands = [F.xxhash64(F.lit(k), f"m{a}", f"m{b}").alias(f"band{k}") for k, (a, b) in enumerate(BANDS)]
    return full.select("h", "n", "empty", _digest(range(8)).alias("low"), _digest(range(8, 16)).alias("high"), *bands)


def _digest(part: range) -> Column:
    """A byte of each of eight values, in one long."""
    out = F.lit(0).cast("bigint")
    for j, k in enumerate(part):
        out = out.bitwiseOR(F.shiftleft(F.col(f"m{k}").bitwiseAND(255), 8 * j))
    return out


def _alike() -> Column:
    """Whether lines ``x`` and ``y`` have enough values in common, or so few shingles that values don't tell."""
    same = F.lit(0)
    for name in ("low", "high"):
        apart = F.col(f"x.{name}").bitwiseXOR(F.col(f"y.{name}"))
        for j in range(8):
            same = same + F.when(F.shiftrightunsigned(apart, 8 * j).bitwiseAND(255) == 0, 1).otherwise(0)
    return (F.least("x.n", "y.n") < FILLED) | (same >= AGREEING)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _sketches(texts: DataFrame) -> DataFrame:
    """Per line: ``h``, the ``size`` of its set and, in ``WORDS`` longs, for each of 64 * ``WORDS`` cells whether an odd number of its shingles fall into it."""
    hashed = texts.select("h", _wide(F.col("line")).alias("wide")).select("h", F.explode(F.array_distinct(shingle_hashes("wide"))).alias("g"))
    word, bit = F.shiftrightunsigned("g", 59), F.expr("shiftleft(1L, CAST(g & 63 AS INT))")
    return hashed.groupBy("h").agg(F.count("g").alias("size"), *[F.coalesce(F.bit_xor(F.when(word == k, bit)), F.lit(0).cast("bigint")).alias(f"p{k}") for k in range(WORDS)])


def _possible(similarity: float) -> Column:
    """False only if lines ``x`` and ``y`` can't be so similar: cells of another parity hold a shingle that the other line hasn't."""
    differ = sum((F.bit_count(F.col(f"x.p{k}").bitwiseXOR(F.col(f"y.p{k}"))) for k in range(WORDS)), F.lit(0))
    sized = F.least("x.size", "y.size") >= similarity * F.greatest("x.size", "y.size") - 1e-6
    return sized & (differ * (1 + similarity) <= (1 - similarity) * (F.col("x.size") + F.col("y.size")) + 1e-6)


def _linked(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose lines' sets have at least the Jaccard ``similarity``."""
    few = _small(pairs)

    def side(end: str) -> DataFrame:
        return texts.join(few.withColumn("h", F.col(end)), "h").select("a", "b", _wide(F.col("line")).alias(f"wide_{end}"))

    both = side("a").join(side("b"), ["a", "b"])
    hashes = both.select("a", "b", shingle_hashes("wide_a").alias("x"), shingle_hashes("wide_b").alias("y"))
    # Written before they are judged, so that the optimiser doesn't make the sets anew for each place of the condition.
    sized = staged(hashes.select("a", "b", F.size(F.array_intersect("x", "y")).alias("common"), F.size(F.array_union("x", "y")).alias("all")), "compared_lines")
    return sized.filter(F.col("common") >= similarity * F.col("all") - 1e-6).select("a", "b")


def _open(buckets: DataFrame, groups: DataFrame | None) -> DataFrame:
    """The lines of the buckets that hold several components, with the component ``c`` that links join them to so far."""
    grouped = buckets.withColumn("c", F.col("h"))
    if groups is not None:
        grouped = buckets.drop("c").join(groups.withColumnRenamed("node", "h"), "h", "left").withColumn("c", F.coalesce("component", "h")).drop("component")
    grouped = grouped.repartition("band")
    several = grouped.groupBy("band").agg(F.min("c").alias("first"), F.max("c").alias("last")).filter("first <> last")
    return staged(grouped.join(several.select("band"), "band"), "open_buckets")


def _fresh(pairs: DataFrame, tried: DataFrame) -> DataFrame:
    """Each of the pairs (a, b) once, the lesser line first, without those that were compared before."""
    once = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return once.join(tried, ["a", "b"], "left_anti")


def _sketched(opened: DataFrame, sketches: DataFrame) -> DataFrame:
    """The lines with their sketches, never null, which spares a join's condition a test for each of its many columns."""
    columns = ("h", "c", "n", "low", "high", "size", *[f"p{k}" for k in range(WORDS)])
    return opened.join(sketches, "h").select("band", *[F.coalesce(k, F.lit(0).cast("bigint")).alias(k) for k in columns])


def _stars(opened: DataFrame, sketches: DataFrame, tried: DataFrame, turn: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of one line of each bucket, another one each turn, and all lines of other components, as many as the bucket has lines, that may be similar.

    All lines of a bucket are as likely to be the one, so that most often it is of the largest component.
    """
    chosen = opened.groupBy("band").agg(F.min_by("h", F.xxhash64("h", F.lit(turn))).alias("rep"))
    x = opened.join(chosen, "band").filter("h = rep").alias("x")
    met = x.join(opened.alias("y"), (F.col("x.band") == F.col("y.band")) & (F.col("x.c") != F.col("y.c")) & _alike())
    return staged(_judged(_fresh(met.select(F.col("x.h").alias("a"), F.col("y.h").alias("b")), tried), sketches, similarity), "line_stars")


def _many_stars(opened: DataFrame, sketches: DataFrame, tried: DataFrame, similarity: float) -> DataFrame:
    """Such pairs with about ``STARS`` lines of each bucket, which reach most lines that are similar to a part of a large component only."""
    parts = opened.groupBy("band").agg(F.ceil(F.count("h") / STARS).alias("parts"))
    rows = _sketched(opened, sketches).repartition("band")
    chosen = rows.join(parts, "band").filter(F.pmod(F.xxhash64("h", F.lit(-1)), "parts") == 0).alias("x")
    met = chosen.join(rows.alias("y"), (F.col("x.band") == F.col("y.band")) & (F.col("x.c") != F.col("y.c")) & _alike() & _possible(similarity))
    return staged(_fresh(met.select(F.col("x.h").alias("a"), F.col("y.h").alias("b")), tried), "line_stars")


def _rest(opened: DataFrame, sketches: DataFrame, tried: DataFrame, similarity: float) -> DataFrame:
    """Every pair (a, b) that shares a bucket, isn't joined by links yet and may be similar.

    Large buckets are dealt into blocks of about ``BLOCK`` lines; each two blocks meet under a key of their own.
    """
    several = opened.groupBy("band").agg(F.ceil(F.count("h") / BLOCK).alias("blocks"))
    dealt = _sketched(opened, sketches).join(several, "band").withColumn("block", F.pmod("h", "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    same = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in ("band", "i", "j")]
    fresh = F.expr("x.h < y.h and x.c <> y.c and (x.i = x.j or x.block <> y.block)")
    met = dealt.alias("x").join(dealt.alias("y"), same[0] & same[1] & same[2] & fresh & _alike() & _possible(similarity))
    return staged(_fresh(met.select(F.col("x.h").alias("a"), F.col("y.h").alias("b")), tried), "line_rest")


def _near(buckets: DataFrame) -> DataFrame:
    """Every pair (a, b) of lines with enough values in common that shares a small bucket."""
    small = buckets.filter(F.col("lines") <= SMALL)
    met = small.alias("x").join(small.alias("y"), (F.col("x.band") == F.col("y.band")) & (F.col("x.h") < F.col("y.h")) & _alike())
    return staged(met.select(F.col("x.h").alias("a"), F.col("y.h").alias("b")).distinct(), "line_near")


def _judged(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) that may be similar."""
    both = pairs.alias("pair").join(sketches.alias("x"), F.col("pair.a") == F.col("x.h")).join(sketches.alias("y"), F.col("pair.b") == F.col("y.h"))
    return both.filter(_possible(similarity)).select("pair.a", "pair.b")


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose lines are of two components."""
    of = lambda end: groups.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.filter(~F.col("of_a").eqNullSafe(F.col("of_b")) | F.col("of_a").isNull()).select("a", "b")


def _components(buckets: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(node, component) of the lines that links join.

    Pairs of small buckets are compared in two turns: of each line first the pair with the least other line, then those that are not joined yet.
    Stars in the same turns settle the large groups of large buckets at the cost of their size, before all their pairs that are left are made.
    """
    near = _near(buckets)
    large = staged(buckets.filter(F.col("lines") > SMALL), "large_buckets")
    wanted = near.select("a").union(near.select("b")).union(large.select("h")).distinct().toDF("h")
    sketches = staged(_sketches(texts.join(_small(wanted), "h", "left_semi")), "line_sketches")
    possible = staged(_judged(near, sketches, similarity), "line_pairs")
    first = staged(possible.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first_pairs")
    stars, tried, groups = not large.isEmpty(), possible, None

    def joined(pairs: DataFrame) -> DataFrame:
        found = _linked(pairs, texts, similarity)
        return staged(connected(found if groups is None else groups.select(F.col("component").alias("a"), F.col("node").alias("b")).union(found)), "groups")

    opened = large
    for turn in range(STAR_ROUNDS):
        pairs = first if turn == 0 else staged(_apart(possible.join(first, ["a", "b"], "left_anti"), groups), "other_pairs")
        if stars:
            opened = _open(opened, groups)
            added = _stars(opened, sketches, tried, turn, similarity)
            pairs, tried = pairs.union(added), tried.union(added)
        groups = joined(pairs)
    if not stars:
        return groups
    opened = _open(opened, groups)
    added = _many_stars(opened, sketches, tried, similarity)
    groups, tried = joined(added), tried.union(added)
    return joined(_rest(_open(opened, groups), sketches, tried, similarity))


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """Per judged line: ``doc_id``, ``line_no`` (from 0), ``first_doc_id`` and ``first_line_no`` of its component, and ``kept``.

    The line with the least (doc_id, line_no) stays. Links are exact, candidates are those that MinHash bands find (a pair
    of similarity s shares a band with probability 1 - (1 - s*s)**8). Null or empty texts have no judged
    lines; rows with a null id aren't judged; rows that repeat an id give their lines under the same places. An empty table gives
    no rows; extra columns are ignored.
    """
    return _placed(docs, id_col, text_col, similarity, min_words).drop("h")


def _placed(docs: DataFrame, id_col: str, text_col: str, similarity: float, min_words: int) -> DataFrame:
    lines = judged_lines(docs, id_col, text_col, min_words)
    flat = staged(lines.select("doc_id", "line_no", "h"), "lines")
    firsts = staged(flat.groupBy("h").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count(F.lit(1)).alias("n_equal")), "distinct_lines")
    signed = signatures(lines)
    # Dealt by band once: the least line of each bucket and its members are found in the same partitions.
    keys = signed.select("h", F.explode(F.array(*[f"band{k}" for k in range(len(BANDS))])).alias("band")).repartition("band")
    met = keys.groupBy("band").agg(F.count("h").alias("lines")).filter("lines > 1")
    shared = staged(keys.join(met.hint("shuffle_hash"), "band").select("band", "h", "lines"), "shared_bands")
    wanted = staged(shared.select("h").distinct().join(firsts, "h").select("h", F.col("first.doc_id").alias("doc_id")), "wanted_lines")
    # Only the lines that are compared are read again, each from the first document that has it.
    texts = staged(lines.join(_small(wanted), ["doc_id", "h"]).groupBy("h").agg(F.min("line").alias("line")), "line_texts")
    buckets = staged(shared.join(signed.select("h", "n", "low", "high"), "h").select("band", "h", "n", "low", "high", "lines"), "line_buckets")
    groups = _components(buckets, texts, similarity)
    return _first_of_each(flat, firsts, groups)


def _first_of_each(flat: DataFrame, firsts: DataFrame, groups: DataFrame) -> DataFrame:
    """``flat`` with the first place of each line's component and ``kept``. Lines that very many documents share meet a broadcast."""
    members = groups.withColumnRenamed("node", "h").join(firsts, "h")
    heads = members.groupBy("component").agg(F.min("first").alias("head"))
    own = firsts.join(groups.withColumnRenamed("node", "h").join(heads, "component").select("h", "head"), "h", "left")
    own = staged(own.select("h", "n_equal", F.coalesce("head", "first").alias("head")), "line_heads")
    total = flat.count()
    hot = own.filter(F.col("n_equal") > max(1000, int(HOT_SHARE * total))).select("h", "head")  # at most 1 / HOT_SHARE lines
    often = flat.join(F.broadcast(hot), "h")
    seldom = flat.join(F.broadcast(hot.select("h")), "h", "left_anti").join(own.select("h", "head"), "h")
    kept = (F.col("doc_id") == F.col("head.doc_id")) & (F.col("line_no") == F.col("head.line_no"))
    return often.unionByName(seldom).select("h", "doc_id", "line_no", F.col("head.doc_id").alias("first_doc_id"), F.col("head.line_no").alias("first_line_no"), kept.alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the lines that go, and without documents of which nothing but blanks is left; all columns stay.

    Documents that lose no line stay as they are, empty ones and those with a null text or id too. ``length_col`` takes the new
    number of characters. Rows that repeat an id each lose their own lines.
    """
    place = lambda i, h: F.xxhash64(i, h)
    gone = _placed(docs, id_col, text_col, similarity, min_words).filter(~F.col("kept")).groupBy("doc_id").agg(F.collect_set(place(F.col("line_no"), F.col("h"))).alias("gone"))
    joined = docs.alias("d").join(gone.alias("g"), F.col(f"d.`{id_col}`") == F.col("g.doc_id"), "left")
    mine = {c: F.col(f"d.`{c}`") for c in docs.columns}
    left = F.filter(F.split(mine[text_col], "\n", -1), lambda x, i: ~F.array_contains(F.col("g.gone"), place(i, F.xxhash64(x))))
    text = F.when(F.col("g.gone").isNull(), mine[text_col]).otherwise(F.array_join(left, "\n"))
    out = joined.select(*[(text if c == text_col else e).alias(c) for c, e in mine.items()], F.col("g.gone").isNotNull().alias("__cut"))
    out = out.filter(~F.col("__cut") | F.col(f"`{text_col}`").rlike(r"\S"))
    if length_col:
        out = out.withColumn(length_col, F.when(F.col("__cut"), F.length(F.col(f"`{text_col}`")).cast(docs.schema[length_col].dataType)).otherwise(F.col(f"`{length_col}`")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
