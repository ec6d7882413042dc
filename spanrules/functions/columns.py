"""Column helpers shared by the operators (all built-in expressions, no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def qcol(name: str) -> Column:
    """Column by exact name; endpoint names may contain dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def clean_double(c: Column) -> Column:
    """NaN -> NULL, so a missing value satisfies no comparison (Spark orders NaN above all)."""
    d = c.cast("double")
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


def micros_to_millis(c: Column) -> Column:
    """Microseconds to rounded milliseconds (half away from zero), as double."""
    return F.round(c / F.lit(1000.0)).cast("double")


def safe_div(num: Column, den: Column) -> Column:
    """``num / den``, or 0 when ``den`` is 0 (the reference's convention for empty rules)."""
    return F.when(den != 0, F.try_divide(num, den)).otherwise(F.lit(0.0))


def fmeasure(precision: Column, recall: Column) -> Column:
    """``2pr / (p + r)``, 0 when both are 0. Same operation order as the reference."""
    return F.when((precision > 0) | (recall > 0),
                  F.try_divide(F.lit(2.0) * (precision * recall), precision + recall)).otherwise(F.lit(0.0))


def beta_fscore(precision: Column, recall: Column, beta: Column) -> Column:
    """``(1 + b^2) * (p r / (b^2 p + r))``, 0 when the denominator is 0."""
    b2 = beta * beta
    den = b2 * precision + recall
    return F.when(den != 0, (F.lit(1.0) + b2) * F.try_divide(precision * recall, den)).otherwise(F.lit(0.0))


def harmonic3(precision: Column, recall: Column, disjointness: Column) -> Column:
    """``3prd / (pr + pd + rd)``, 0 when the denominator is 0."""
    p, r, d = precision, recall, disjointness
    den = p * r + p * d + r * d
    return F.when(den != 0, F.try_divide(F.lit(3.0) * p * r * d, den)).otherwise(F.lit(0.0))


def sq_dev(n: Column, s1: Column, s2: Column) -> Column:
    """Sum of squared deviations from the mean, from count, sum and sum of squares.

    The sums are about a centre (see :func:`spanrules.operators.cube.bucket_cube`), which the result
    does not depend on; it keeps them of the size of the deviations, so nothing cancels that matters.
    """
    return F.when(n > 0, F.greatest(s2 - F.try_divide(s1 * s1, n), F.lit(0.0))).otherwise(F.lit(0.0))


def r6(c: Column) -> Column:
    """Rounded to 6 digits, the precision results are reported with."""
    return F.round(c, 6)


def literal_frame(spark, rows, schema):
    """A small DataFrame of literal rows, built JVM-side (``inline`` of typed literals).

    For driver-side summaries of bounded size (thresholds, intervals); unlike
    ``createDataFrame`` from Python objects it needs no Python worker to execute.
    """
    from pyspark.sql import types as T

    st = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def lit(v, dt):
        if isinstance(dt, T.ArrayType):
            if not v:
                return F.array().cast(dt)
            return F.array(*[lit(x, dt.elementType) for x in v]).cast(dt)
        return F.lit(v).cast(dt)

    structs = [F.struct(*[lit(v, f.dataType).alias(f.name) for v, f in zip(r, st.fields)]) for r in rows]
    arr = F.array(*structs) if structs else F.array().cast(T.ArrayType(st))
    return spark.range(1).select(F.inline(arr.cast(T.ArrayType(st))))
