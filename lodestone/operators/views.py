"""SQL over the tables without the excluded countries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Session:
    """Tables for SQL text: ``{name}`` in a statement stands for the table of that name."""

    def __init__(self, tables: Mapping[str, DataFrame]):
        self.tables = dict(tables)

    def sql(self, statement: str) -> DataFrame:
        spark = next(iter(self.tables.values())).sparkSession
        return spark.sql(statement, **self.tables)

    def register(self) -> None:
        """The same as temporary views of the session."""
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name)


def session(tables: Mapping[str, DataFrame], exclude_countries: Sequence[str] = (), column: str = "country") -> Session:
    """Views of the tables without the given countries; a null country goes with the filter, as in SQL."""
    keep = lambda df: df.filter(~F.col(column).isin(*exclude_countries)) if exclude_countries and column in df.columns else df
    return Session({n: keep(df) for n, df in tables.items()})
