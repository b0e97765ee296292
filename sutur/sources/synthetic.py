"""Generated rows: lines of a synthetic corpus, composed benchmark texts and page placements."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from sutur.config import SyntheticDataConfig
from sutur.errors import BenchmarkError
from sutur.functions.numbers import derived_seed
from sutur.functions.text import padded_number, urdu_number
from sutur.guards import require_all

#: Lines per synthetic document.
LINES_PER_DOCUMENT = 4


def synthetic_lines(
    spark: SparkSession, count: int, texts: Sequence[str], seed: int = 1337, line_prefix: str = "synthetic-", document_prefix: str = "document-", document_digits: int = 4
) -> DataFrame:
    """``count`` samples whose texts repeat the corpus in turn; every four lines share a document.

    Numbers are padded to six and four digits and never cut, so ids stay distinct at any count.
    """
    corpus = spark.createDataFrame(list(enumerate(texts)), "k bigint, text string")
    n = F.col("id")
    number = padded_number(n, 6)
    sample_id = F.concat(F.lit(line_prefix), number)
    rows = spark.range(1, count + 1).withColumn("k", F.pmod(n - 1, F.lit(max(1, len(texts)))))
    document = F.floor((n - 1) / LINES_PER_DOCUMENT) + 1
    return rows.join(F.broadcast(corpus), "k").select(
        F.lit(1).alias("schema_version"), sample_id.alias("sample_id"), F.concat(F.lit("images/"), sample_id, F.lit(".png")).alias("image_path"),
        "text", F.concat(F.lit(document_prefix), padded_number(document, document_digits)).alias("document_id"), F.lit(None).cast("string").alias("page_id"),
        F.pmod(n - 1, F.lit(LINES_PER_DOCUMENT)).cast("int").alias("line_index"), F.array(F.lit("synthetic")).alias("tags"),
        derived_seed(F.lit(seed), sample_id).alias("seed"),
    )


def composed_texts(spark: SparkSession, documents: int, templates: Sequence[str], width: int = 4) -> DataFrame:
    """Every document with every template: (document, template, number, text).

    ``{number}`` and ``{urdu_number}`` in a template become a running number in Urdu digits,
    ``{ascii_number}`` the same in ASCII digits, unique over all rows. The
    templates are a short list, so the product is one generated row per result.
    """
    pieces = spark.createDataFrame([(i, t) for i, t in enumerate(templates)], "template int, pattern string")
    rows = spark.range(documents).select(F.col("id").alias("document"), F.explode(F.sequence(F.lit(0), F.lit(len(templates) - 1))).alias("template"))
    number = F.col("document") * len(templates) + F.col("template") + 1
    text = F.replace("pattern", F.lit("{number}"), urdu_number(number, width))
    text = F.replace(F.replace(text, F.lit("{urdu_number}"), urdu_number(number, width)), F.lit("{ascii_number}"), padded_number(number, width))
    return rows.join(F.broadcast(pieces), "template").select("document", "template", number.alias("number"), text.alias("text"))


@F.pandas_udf(ArrayType(StructType([StructField("direction", StringType()), StructField("text", StringType())])))
def directional_runs(texts: pd.Series) -> pd.Series:
    """Runs of left-to-right numbers and right-to-left rest in visual order (last run first)."""
    out = []
    for text in texts:
        runs: list[list[str]] = []
        for ch in text or "":
            direction = "ltr" if unicodedata.bidirectional(ch) in ("EN", "AN") else "rtl"
            if runs and runs[-1][0] == direction:
                runs[-1][1] += ch
            else:
                runs.append([direction, ch])
        out.append([{"direction": d, "text": t} for d, t in reversed(runs)])
    return pd.Series(out)


# Where the lines of generated pages lie, by layout family, in reading order. Every entry is
# (area, kind, column, tops); areas are those of _areas. Families without an entry have no lines.
PLACEMENTS = {
    "one_column": (("indented by 80", "line", None, (90, 290, 490, 690, 890)),),
    "mild_skew": (("indented by 80", "line", None, (90, 290, 490, 690, 890)),),
    "one_column_wide": (("whole", "line", None, (100,)), ("indented by 100", "line", None, (350, 600, 850))),
    "balanced_two_column": (("right", "line", 0, (90, 350, 610, 870)), ("left", "line", 1, (90, 350, 610, 870))),
    "uneven_two_column": (("right", "line", 0, (90, 350, 610, 870)), ("left", "line", 1, (90, 350, 610))),
    "spanning_top": (("whole", "spanning", None, (55,)), ("right", "line", 0, (330, 590, 850)), ("left", "line", 1, (330, 590, 850))),
    "spanning_middle": (
        ("right", "line", 0, (70, 260)), ("left", "line", 1, (70, 260)), ("whole", "spanning", None, (485,)), ("right", "line", 0, (720, 940)), ("left", "line", 1, (720, 940)),
    ),
    "spanning_footer": (("right", "line", 0, (90, 350, 610)), ("left", "line", 1, (90, 350, 610)), ("whole", "spanning", None, (950,))),
    "blank": (),
    "near_blank": (),
}


def _areas(config: SyntheticDataConfig) -> dict[str, tuple[int, int]]:
    """Left and right edge of the areas that lines are placed in."""
    left, right = config.page_margin, config.page_width - config.page_margin
    column = (right - left - config.column_gutter) // 2
    return {"whole": (left, right), "indented by 80": (left + 80, right), "indented by 100": (left + 100, right), "left": (left, left + column), "right": (right - column, right)}


def page_placements(pages: DataFrame, config: SyntheticDataConfig = SyntheticDataConfig()) -> DataFrame:
    """Lines of generated pages: the columns of ``pages`` with (reading_order_index, left, right, y, region_kind, column_index).

    pages  layout_family string and any columns that name the page. A page of a family without lines has no row; an
    unknown family fails. Numbers of lines are bounded by the table above, which is all that is broadcast.
    """
    areas = _areas(config)
    table = []
    for family, parts in PLACEMENTS.items():
        places = [(*areas[area], y, kind, column) for area, kind, column, tops in parts for y in tops]
        table += [(family, order, *place) for order, place in enumerate(places)]
    spark = pages.sparkSession
    layout = spark.createDataFrame(table, "layout_family string, reading_order_index int, left int, right int, y int, region_kind string, column_index int")
    require_all(pages, F.col("layout_family").isin(*PLACEMENTS), ["layout_family"], BenchmarkError, "unsupported layout family")
    return pages.join(F.broadcast(layout), "layout_family")


def column_placements(spark: SparkSession, pages: int, lines: int, columns: int, width: int = 1000, top: int = 100, pitch: int = 100, height: int = 60) -> DataFrame:
    """Ground-truth boxes of generated pages: (page, line, column_index, box), the right column first."""
    n = F.col("line")
    side = F.pmod(n, F.lit(columns)).cast("int")
    inner = width // columns
    x = F.lit(width) - (side + 1) * inner + inner // 10
    y = F.lit(top) + F.floor(n / columns).cast("int") * pitch
    box = F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), F.lit(inner * 8 // 10).alias("width"), F.lit(height).alias("height"))
    rows = spark.range(pages).select(F.col("id").alias("page"), F.explode(F.sequence(F.lit(0), F.lit(lines - 1))).alias("line"))
    return rows.select("page", "line", F.when(F.lit(columns > 1), side).alias("column_index"), box.alias("box"))
