"""Validation of generated answers, as Column expressions over arrays of lines.

Each line gets a citation number and a final text under one of four modes; an
answer's mode is the first that any of its lines calls for. All that remains is
one check over the lines: every number in range and nothing forbidden.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.functions.predicates import FORBIDDEN

# How a line says its citation.
_PLACEHOLDER = r"(?i)\[n\][.!?]?$"
_EXPLICIT = r"\[(\d+)\][.!?]*$"
_NUMBER = r"\b(\d{1,3})\b"
_PASSAGE = r"(?i)\bpassages?\b[^\d]*"
NOTHING = "NOT_ENOUGH_INFORMATION"


def lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def mode(rows: Column) -> Column:
    """Of non-empty lines: placeholder, explicit, number or sequence."""
    return (
        F.when(F.exists(rows, lambda x: x.rlike(_PLACEHOLDER)), "placeholder")
        .when(F.exists(rows, lambda x: x.rlike(_EXPLICIT)), "explicit")
        .when(F.exists(rows, lambda x: x.rlike(_NUMBER)), "number")
        .otherwise("sequence")
    )


def cited_lines(rows: Column, how: Column, most: Column) -> Column:
    """array<struct<cited int, text string>>; cited is null where a line calls for a number and has none."""
    explicit = lambda x: F.try_to_number(F.nullif(F.regexp_extract(x, _EXPLICIT, 1), F.lit("")), F.lit("9999999999")).cast("int")
    in_range = lambda x: F.get(F.filter(F.transform(F.regexp_extract_all(x, F.lit(_NUMBER), F.lit(1)), lambda n: n.cast("int")), lambda n: (n >= 1) & (n <= most)), F.lit(0))
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    # The n-th placeholder is citation n.
    nth = lambda i: F.size(F.filter(F.slice(rows, 1, i + 1), lambda y: y.rlike(_PLACEHOLDER)))

    def line(x: Column, i: Column) -> Column:
        cited = (
            F.when(how == "placeholder", F.when(x.rlike(_PLACEHOLDER), nth(i)).otherwise(explicit(x)))
            .when(how == "explicit", F.when(x.rlike(_EXPLICIT), explicit(x)).otherwise(in_range(x)))
            .when(how == "number", F.coalesce(in_range(x), F.lit(1)))
            .otherwise(i + 1)
        )
        marked = lambda t: F.concat(t, F.lit(" ["), cited.cast("string"), F.lit("]"))
        text = (
            F.when(how == "placeholder", F.regexp_replace(x, F.lit(r"(?i)\[n\]([.!?]?)$"), F.concat(F.lit("["), F.coalesce(cited.cast("string"), F.lit("")), F.lit("]$1"))))
            .when(how == "explicit", marked(strip(F.regexp_replace(x, _EXPLICIT, ""))))
            .when(how == "number", marked(strip(F.regexp_replace(x, _PASSAGE, ""))))
            .otherwise(marked(x))
        )
        return F.struct(cited.cast("int").alias("cited"), text.alias("text"))

    return F.transform(rows, line)


def decision(rows: Column, how: Column, cited: Column, most: Column) -> Column:
    """ACCEPT, NOT_ENOUGH_INFORMATION or INVALID_OUTPUT. most: the greatest passage number, 0 or null without passages."""
    most = F.coalesce(most, F.lit(0))
    fits = ~F.exists(cited, lambda c: F.coalesce((c["cited"] < 1) | (c["cited"] > most) | c["text"].rlike(FORBIDDEN), F.lit(True)))
    return (
        F.when(F.size(rows) == 0, "INVALID_OUTPUT")
        .when(F.upper(F.array_join(rows, " ")) == NOTHING, NOTHING)
        .when(most < 1, "INVALID_OUTPUT")
        .when(F.exists(rows, lambda x: F.upper(x) == NOTHING), NOTHING)
        .when((how == "sequence") & (F.size(rows) > most), "INVALID_OUTPUT")
        .when(fits, "ACCEPT")
        .otherwise("INVALID_OUTPUT")
    )


def validated(df, text_col: str, most_col: str):
    """df with columns lines, mode, cited and decision."""
    df = df.withColumn("lines", lines(F.col(text_col)))
    df = df.withColumn("mode", mode(F.col("lines")))
    df = df.withColumn("cited", cited_lines(F.col("lines"), F.col("mode"), F.coalesce(F.col(most_col), F.lit(0))))
    return df.withColumn("decision", decision(F.col("lines"), F.col("mode"), F.col("cited"), F.col(most_col)))


def running_citations(rows: DataFrame, answer: str, order: str, cites: Column) -> DataFrame:
    """rows with `citation`: how many lines of the answer cite, up to this one."""
    return rows.withColumn("citation", F.count_if(cites).over(Window.partitionBy(answer).orderBy(order)))
