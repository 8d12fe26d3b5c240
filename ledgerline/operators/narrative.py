"""What a release says in prose: figures of segments, findings by rules, and which of its sections are missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .documents import MONEY_UNITS, multiplier
from .releases import page_lines
from ..functions.text import number

# How releases name segments and their results, the sections that hold explanations, and what is found in them:
# (finding, subject, section, terms that a sentence has all of, terms of which it has one, status).
FIGURE, UNIT = r"[△▲\-−]?[0-9][0-9,]*(?:\.[0-9]+)?", "円|千円|百万円|億円"
SEGMENT = rf"([^。、]{{1,40}}?事業)の売上高は({FIGURE})({UNIT}).*?セグメント(利益|損失)は({FIGURE})({UNIT})"
SALES, RESULT, LOSS = "売上高", "セグメント", "損失"
RESULTS_OF_SEGMENTS, OUTLOOK = "各セグメントの経営成績", "業績予想などの将来予測情報"
RULES = (
    ("business_environment", "食品流通・スーパーマーケット市場", RESULTS_OF_SEGMENTS, ("経営環境",), ("値上げ", "原材料", "節約", "消費"), "negative"),
    ("revenue_driver", "全社売上", RESULTS_OF_SEGMENTS, ("取引", "堅調"), ("売上", "得意先", "増収"), "positive"),
    ("profit_driver", "フローズン事業", RESULTS_OF_SEGMENTS, ("費",), ("人件費", "採用費", "減益", "下回"), "negative"),
    ("positive_factor", "スーパーマーケット事業", RESULTS_OF_SEGMENTS, ("出店",), ("増加", "増収", "伸長"), "positive"),
    ("outlook", "全社業績", OUTLOOK, ("業績",), ("計画どおり", "順調", "見通し", "予想"), "unchanged"),
)
#: (finding, subject, pattern on the first page); 有 is a change.
FLAGS = (
    ("forecast_change", "通期会社予想", "直近に公表されている業績予想からの修正の有無[:：]?(有|無)"),
    ("dividend_change", "配当予想", "直近に公表されている配当予想からの修正の有無[:：]?(有|無)"),
)


def joined_lines(text: Column, normalise: bool = True) -> Column:
    return F.array_join(page_lines(text, normalise), "")


def segment_figures(texts: DataFrame, key: str = "doc_id", normalise: bool = True) -> DataFrame:
    """Per segment two rows (key, pos, category, name, value): its sales, and the next result after them, in a later sentence if need be.

    A sales figure between another one and that one's result is passed over. A loss is negative whatever its sign says; triangles and minus signs are
    negative too. Values are in yen.
    """
    groups = [F.regexp_extract_all("line", F.lit(SEGMENT), F.lit(i)).alias(f"g{i}") for i in range(1, 7)]
    found = texts.select(key, joined_lines(F.col("text"), normalise).alias("line")).select(key, F.posexplode(F.arrays_zip(*groups)).alias("pos", "m"))
    value = lambda figure, unit: number(F.col(figure)) * multiplier(F.col(unit), MONEY_UNITS)
    result = F.when(F.col("m.g4") == LOSS, -F.abs(value("m.g5", "m.g6"))).otherwise(value("m.g5", "m.g6"))
    both = F.array(F.struct(F.lit(SALES).alias("name"), value("m.g2", "m.g3").alias("value")), F.struct(F.concat(F.lit(RESULT), F.col("m.g4")).alias("name"), result.alias("value")))
    return found.select(key, "pos", F.col("m.g1").alias("category"), F.inline(both))


def _sections(pages: DataFrame, key: str) -> DataFrame:
    """Per document the last page with each marker, and the first page, in one aggregate."""
    page = F.struct("page_no", "text")
    with_ = lambda marker: F.max_by(page, F.when(F.col("text").contains(marker), F.col("page_no")))
    return pages.groupBy(key).agg(with_(RESULTS_OF_SEGMENTS).alias("s0"), with_(OUTLOOK).alias("s1"), F.min_by(page, "page_no").alias("first"))


def missing_sections(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, section) of documents without a section; nothing is found in such a document."""
    gone = [F.when(F.col(c).isNull(), F.lit(m)) for c, m in (("s0", RESULTS_OF_SEGMENTS), ("s1", OUTLOOK))]
    return _sections(pages, key).select(key, F.explode(F.array_compact(F.array(*gone))).alias("section"))


def findings(pages: DataFrame, key: str = "doc_id", normalise: bool = True) -> DataFrame:
    """Rows (key, n, finding_type, subject, statement, status, page_no): of each rule the first sentence of its section that fits, and the flags of the first page.

    ``pages``: key, page_no, text. A section is the last page that has its marker. ``n`` is the rule's place.
    """
    rows = _sections(pages, key).filter("s0 is not null and s1 is not null")
    text = {RESULTS_OF_SEGMENTS: "s0", OUTLOOK: "s1"}
    rows = rows.select(key, *[F.struct(F.col(f"{c}.page_no").alias("page_no"), joined_lines(F.col(f"{c}.text"), normalise).alias("line")).alias(c) for c in ("s0", "s1", "first")])
    rows = rows.select("*", *[F.split(f"{c}.line", "(?<=[。！？])", -1).alias(f"{c}_sentences") for c in ("s0", "s1")])

    def fits(required: tuple[str, ...], some: tuple[str, ...]):
        def holds(sentence: Column) -> Column:
            every, one = F.lit(True), F.lit(False)
            for term in required:
                every = every & sentence.contains(term)
            for term in some:
                one = one | sentence.contains(term)
            return every & one

        return holds

    found = []
    for n, (kind, subject, section, required, some, status) in enumerate(RULES):
        statement = F.trim(F.try_element_at(F.filter(f"{text[section]}_sentences", fits(required, some)), F.lit(1)))
        found.append(F.struct(F.lit(n).alias("n"), F.lit(kind).alias("finding_type"), F.lit(subject).alias("subject"), statement.alias("statement"), F.lit(status).alias("status"), F.col(f"{text[section]}.page_no").cast("long").alias("page_no")))
    for n, (kind, subject, pattern) in enumerate(FLAGS, start=len(RULES)):
        statement = F.nullif(F.regexp_extract("first.line", pattern, 0), F.lit(""))
        status = F.when(F.regexp_extract("first.line", pattern, 1) == "有", "changed").otherwise("unchanged")
        found.append(F.struct(F.lit(n).alias("n"), F.lit(kind).alias("finding_type"), F.lit(subject).alias("subject"), statement.alias("statement"), status.alias("status"), F.col("first.page_no").cast("long").alias("page_no")))
    return rows.select(key, F.inline(F.array(*found))).filter("statement is not null")


def consistency_checks(metrics: DataFrame, key: str = "doc_id", tolerance: float = 0.3, margin: float = 50.0) -> DataFrame:
    """Rows (key, metric, check_type, status) per document and metric.

    ``metrics``: key, metric, actual, prior, forecast, reported_yoy and the three units. Where a unit isn't yen only its presence is in question; else growth,
    rounded to one place, may differ from the reported one by ``tolerance``. The operating margin is checked where revenue and operating profit are in yen.
    A missing figure can't be checked and asks for review; without prior sales there is no growth.
    """
    yen = F.col("actual_unit").eqNullSafe("JPY") & F.col("prior_unit").eqNullSafe("JPY") & F.col("forecast_unit").eqNullSafe("JPY")
    grown = F.round((F.col("actual") / F.nullif("prior", F.lit(0)) - 1) * 100, 1)
    near = F.coalesce(F.round(F.abs(grown - F.col("reported_yoy")), 9) <= tolerance, F.lit(False))
    status = lambda good: F.when(good, "passed").otherwise("review_required")
    each = metrics.select(key, "metric", F.when(yen, "year_over_year_reconciliation").otherwise("money_unit_presence").alias("check_type"), status(yen & near).alias("status"))
    of = lambda name, c: F.max(F.when(F.col("metric") == name, F.col(c)))
    wide = metrics.groupBy(key).agg(of("revenue", "actual").alias("r"), of("revenue", "actual_unit").alias("ru"), of("operating_profit", "actual").alias("o"), of("operating_profit", "actual_unit").alias("ou"))
    percent = F.col("o") / F.nullif("r", F.lit(0)) * 100
    margins = wide.filter("ru = 'JPY' and ou = 'JPY'").select(key, F.lit("operating_profit").alias("metric"), F.lit("operating_margin_sanity").alias("check_type"), status(F.coalesce(percent.between(-margin, margin), F.lit(False))).alias("status"))
    return each.unionByName(margins)
