"""Readers and writers of populations and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Columns of the municipalities file that the published simulations use (fixed values).
MUNICIPALITIES = "COORD_X DOUBLE, COORD_Y DOUBLE, AREA DOUBLE"


def read_csv(spark: SparkSession, path: str, schema: str = MUNICIPALITIES) -> DataFrame:
    """A CSV file with a header, columns picked by name: other columns are allowed in any order."""
    names = [c.split()[0] for c in schema.split(", ")]
    raw = spark.read.option("header", True).csv(path)
    return raw.selectExpr(*[f"cast(`{c.split()[0]}` as {c.split()[1]}) as `{c.split()[0]}`" for c in schema.split(", ")]) if set(names) <= set(raw.columns) else spark.read.schema(schema).csv(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None) -> None:
    """Parquet, CSV, JSON or ORC, partitioned by columns if asked for."""
    out = df.write.mode("overwrite")
    out = out.partitionBy(*by) if by else out
    (out.option("header", True) if kind == "csv" else out).format(kind).save(path)


def latex(df: DataFrame, most: int = 1000) -> str:
    """The first rows as a LaTeX table."""
    rows = df.limit(most).collect()
    line = lambda xs: " & ".join(map(str, xs)) + r" \\"
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", line(df.columns), r"\hline", *map(line, rows), r"\end{tabular}"])
