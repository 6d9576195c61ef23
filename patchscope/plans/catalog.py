"""Every query with its independent SQL.

A query takes (spark, sf_dir). Doubles are rounded to six digits on both sides, undefined
ratios are NULL, and every tie has an explicit breaker.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Round floating columns; adding zero turns -0.0 into 0.0."""
    floating = (T.DoubleType, T.FloatType)
    return df.select(*[
        (F.round(F.col(f.name).cast("double"), DIGITS) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, floating) else F.col(f.name)
        for f in df.schema.fields
    ])


def query(sql: str | None = None):
    """Register a query under its function name, with the SQL that must give the same rows."""

    def register(function):
        @functools.wraps(function)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(function(spark, sf_dir))

        QUERIES[function.__name__] = run
        if sql:
            ORACLES[function.__name__] = sql
        return run

    return register


def r(expression: str, name: str) -> str:
    """SQL counterpart of :func:`tidy`."""
    return f"round({expression}, {DIGITS}) + 0.0::DOUBLE AS {name}"


def div(a: str, b: str) -> str:
    """SQL ratio that is NULL on a zero denominator."""
    return f"(CASE WHEN ({b}) = 0 THEN NULL ELSE ({a})::DOUBLE / ({b}) END)"


# SQL text for the confusion counts and the scores on top of them
def counts_sql(source: str, keys: str, threshold: float = 0.5, weight: str = "1") -> str:
    k = f"{keys}, " if keys else ""
    g = f"GROUP BY {keys}" if keys else ""
    total = lambda cond: f"CAST(coalesce(sum(CASE WHEN {cond} THEN {weight} END), 0) AS BIGINT)"
    return f"""SELECT {k}{total(f'prob >= {threshold} AND label = 1')} AS TP, {total(f'prob >= {threshold} AND label = 0')} AS FP,
       {total(f'prob < {threshold} AND label = 1')} AS FN, {total(f'prob < {threshold} AND label = 0')} AS TN FROM {source} {g}"""


POD, POFD, FAR = div("TP", "TP + FN"), div("FP", "FP + TN"), div("FP", "FP + TP")
CSI, PC, BIAS = div("TP", "TP + FP + FN"), div("TP + TN", "TP + FP + FN + TN"), div("TP + FP", "TP + FN")
AUC = f"(({POD} + 1 - {POFD}) / 2)"
SCALAR_COLUMNS = ",\n  ".join([
    "TP, FP, FN, TN", "0.5::DOUBLE AS Threshold", r(f"coalesce({POD}, 0)", "POD"), r(f"coalesce({POFD}, 0)", "POFD"),
    r(f"coalesce({FAR}, 0)", "FAR"), r(CSI, "CSI"), r(PC, "ProportionCorrect"), r(BIAS, "Bias"), r(POD, "HitRate"),
    r(POFD, "FalseAlarmRate"), r(AUC, "AUC"),
])
SCALAR_RAW = ",\n  ".join([
    "TP, FP, FN, TN", f"coalesce({POD}, 0) AS POD", f"coalesce({POFD}, 0) AS POFD", f"coalesce({FAR}, 0) AS FAR", f"{CSI} AS CSI",
    f"{PC} AS ProportionCorrect", f"{BIAS} AS Bias", f"{AUC} AS AUC",
])


def curve_sql(source: str, keys: str, width: str = "0.05", bins: int = 21, weight: str = "1") -> str:
    """Reliability curve rows: keys, bin, Bin_Start, Bin_Center, Total_Freq, Positive_Freq, rate."""
    return f"""SELECT k.*, b.bin, b.bin * {width}::DOUBLE AS Bin_Start, b.bin * {width}::DOUBLE + {width}::DOUBLE / 2 AS Bin_Center,
       coalesce(c.n, 0) AS Total_Freq, coalesce(c.pos, 0) AS Positive_Freq, {div('c.pos', 'c.n')} AS rate
  FROM (SELECT DISTINCT {keys} FROM {source}) k, (SELECT CAST(range AS INT) AS bin FROM range(0, {bins})) b
  LEFT JOIN (SELECT {keys}, least(CAST(floor(round(prob / {width}::DOUBLE, 9)) AS INT), {bins - 1}) AS bin,
             CAST(sum({weight}) AS BIGINT) AS n, CAST(sum({weight} * label) AS BIGINT) AS pos
             FROM {source} GROUP BY ALL) c
  ON b.bin = c.bin AND {' AND '.join(f'k.{x.strip()} = c.{x.strip()}' for x in keys.split(','))}"""


def brier_sql(curve: str, keys: str) -> str:
    return f"""SELECT {keys}, rel AS reliability, res AS resolution, climo * (1 - climo) AS uncertainty, climo,
       rel - res + climo * (1 - climo) AS BS, CASE WHEN climo * (1 - climo) = 0 THEN NULL ELSE (res - rel) / (climo * (1 - climo)) END AS BSS
  FROM (SELECT {keys}, sum(Total_Freq * (Bin_Center - rate) * (Bin_Center - rate)) / sum(Total_Freq) AS rel,
        sum(Total_Freq * (rate - c) * (rate - c)) / sum(Total_Freq) AS res, any_value(c) AS climo
        FROM (SELECT *, sum(Positive_Freq) OVER (PARTITION BY {keys}) / sum(Total_Freq) OVER (PARTITION BY {keys}) AS c FROM ({curve}))
        GROUP BY {keys})"""


BRIER_COLUMNS = ", ".join(r(c, c) for c in ("BS", "BSS", "reliability", "resolution", "uncertainty", "climo"))
