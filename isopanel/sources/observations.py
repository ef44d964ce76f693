"""From observation files to typed rows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from posixpath import join

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import blank_to_null, parse_number, parse_year
from . import catalog as c
from .catalog import Indicator, RowRule

#: What a row must have to count.
REQUIRED = ("country", "year", "value")

RENAMES = {c.PERIOD_COLUMN: "year", c.COUNTRY_COLUMN: "country"}


def scan_observations(
    spark: SparkSession,
    path: str,
    columns: Iterable[str] | None = None,
    multiline: bool = False,
    corrupt: str | None = None,
) -> DataFrame:
    """One observation CSV, or a folder of its parts, with header lines; all columns are text, missing tokens null.

    The names in the header say which column is which, in any order. A part of a folder whose header differs from the
    others' fails the job instead of being read by position. ``columns`` picks some columns by name. With
    ``multiline``, records may have line breaks inside of quotes; each file is then read by one task, so leave it off
    for large files that have none. ``corrupt`` names a further column that holds a line whose number of fields is not
    that of the header, and null otherwise.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("enforceSchema", False)
    reader = reader.option("multiLine", multiline)
    header = reader.csv(path).columns
    names = header if corrupt is None else [*header, corrupt]
    if corrupt is not None:
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt)
    df = reader.schema(T.StructType([T.StructField(name, T.StringType()) for name in names])).csv(path)
    wanted = header if columns is None else list(columns)
    line = [] if corrupt is None else [F.col(f"`{corrupt}`")]
    return df.select([blank_to_null(F.col(f"`{name}`")).alias(name) for name in wanted] + line)


def scan_many(
    spark: SparkSession,
    root: str,
    files: Mapping[str, str] = c.SOURCE_FILES,
    multiline: bool = False,
    corrupt: str | None = None,
) -> dict[str, DataFrame]:
    """All named sources below one folder, each still unread but for its header."""
    return {
        name: scan_observations(spark, join(root, file), multiline=multiline, corrupt=corrupt)
        for name, file in files.items()
    }


def union_datasets(datasets: Mapping[str, DataFrame]) -> DataFrame:
    """All sources as one frame, told apart by ``dataset``; columns that a source lacks are null."""
    named = [df.withColumn("dataset", F.lit(name)) for name, df in datasets.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def standardize_columns(df: DataFrame) -> DataFrame:
    """Rename the period and country columns where present and type the period."""
    renamed = df.withColumnsRenamed(RENAMES)
    return renamed.withColumn("year", parse_year("year")) if "year" in renamed.columns else renamed


def master_country_list(datasets: Iterable[DataFrame]) -> DataFrame:
    """Distinct countries over all sources. The caller orders them; here the order would cost a shuffle."""
    lists = [
        df.select("country").where(F.col("country").isNotNull()).distinct()
        for df in map(standardize_columns, datasets)
        if "country" in df.columns
    ]
    return reduce(DataFrame.union, lists).distinct()


def filter_by_codes(df: DataFrame, codes: Mapping[str, str]) -> DataFrame:
    """Rows on which every coded column has the wanted value."""
    return df.where(RowRule(equals=codes).condition())


def filter_and_rename(
    df: DataFrame, codes: Mapping[str, str], value_name: str, value_column: str = c.VALUE_COLUMN
) -> DataFrame:
    """Filter by codes, give the observation column its own name and type the year. Values stay text."""
    return standardize_columns(filter_by_codes(df, codes).withColumnRenamed(value_column, value_name))


def coerce_numeric(df: DataFrame, *columns: str) -> DataFrame:
    """Text columns to doubles; what is not a number becomes null."""
    return df.withColumns({name: parse_number(F.col(f"`{name}`")) for name in columns})


def drop_incomplete(df: DataFrame, *columns: str) -> DataFrame:
    """Drop rows with a missing value in any of the columns."""
    return df.dropna(subset=list(columns))


def load_rows(
    df: DataFrame,
    rule: RowRule,
    extra: Mapping[str, str] | None = None,
    required: Iterable[str] = REQUIRED,
    with_year: bool = True,
) -> DataFrame:
    """Filter, type, drop incomplete rows and project. ``extra`` maps further source columns to output names.

    The rule reads coded columns only, so it reaches the scan; typing happens on the rows that are left.
    """
    extra = dict(extra or {})
    kept = df.where(rule.condition())
    selected: list[Column] = [F.col(f"`{c.COUNTRY_COLUMN}`").alias("country")]
    if with_year:
        selected.append(parse_year(F.col(c.PERIOD_COLUMN)).alias("year"))
    selected += [F.col(f"`{name}`").alias(alias) for name, alias in extra.items()]
    selected.append(parse_number(F.col(c.VALUE_COLUMN)).alias("value"))
    return drop_incomplete(kept.select(*selected), *required)


def load_indicator(df: DataFrame, indicator: Indicator) -> DataFrame:
    """Canonical rows (country, year, value) of one indicator."""
    return project_canonical(load_rows(df, indicator.rows))


def load_power_total(df: DataFrame) -> DataFrame:
    """Power rows to be summed: no subtotal sources, no all-grids rows. A missing source or grid is kept."""
    return project_canonical(load_rows(df, c.POWER_TOTAL_ROWS))


def load_power_all_grids(df: DataFrame) -> DataFrame:
    """The same with all-grids rows kept, which counts them twice; for results that were made that way."""
    return project_canonical(load_rows(df, c.POWER_ALL_GRIDS_ROWS))


def load_power_by_source(df: DataFrame) -> DataFrame:
    """All-grids rows per energy source."""
    return load_rows(
        df, c.POWER_BY_SOURCE_ROWS, {c.SOURCE_COLUMN: "member"}, ("country", "year", "member", "value")
    )


def load_power_by_source_grid(df: DataFrame, with_subtotals: bool = False) -> DataFrame:
    """Energy source to grid status, all years together."""
    rule = c.POWER_FLOW_WITH_SUBTOTALS_ROWS if with_subtotals else c.POWER_FLOW_ROWS
    extra = {c.SOURCE_COLUMN: "source", c.GRID_COLUMN: "target"}
    return load_rows(df, rule, extra, ("country", "source", "target", "value"), with_year=False)


def load_flow_rows_with_year(df: DataFrame) -> DataFrame:
    """Flow rows, subtotals included, with their year where it is known."""
    extra = {c.SOURCE_COLUMN: "source", c.GRID_COLUMN: "target"}
    return load_rows(df, c.POWER_FLOW_WITH_SUBTOTALS_ROWS, extra, ("country", "source", "target", "value"))


def load_products(df: DataFrame, rule: RowRule = c.CROP_ROWS) -> DataFrame:
    """Product rows (country, year, member, value)."""
    return load_rows(df, rule, {c.PRODUCT_COLUMN: "member"}, ("country", "year", "member", "value"))


def project_canonical(df: DataFrame) -> DataFrame:
    return df.select("country", "year", "value")


def load_panels(datasets: Mapping[str, DataFrame], catalog: c.Catalog = c.STANDARD_CATALOG) -> dict[str, DataFrame]:
    """Rows of all indicators as panels (country, indicator, year, value), one for each aggregate in use."""
    parts: dict[str, list[DataFrame]] = {}
    for i in catalog.indicators:
        if i.source in datasets:
            rows = load_indicator(datasets[i.source], i)
            parts.setdefault(i.agg, []).append(
                rows.select("country", F.lit(i.name).alias("indicator"), "year", "value")
            )
    return {agg: reduce(DataFrame.union, frames) for agg, frames in parts.items()}
