"""Values that a table can take: a rule per column, compiled from the declared table.

A value that does not fit refuses its own row; the rest of the batch arrives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.schemas import declared

# Wide enough for any number of the declared tables, with places left to round from.
_WIDE = "decimal(38,10)"


def fitted(col: Column | str, kind: T.DataType) -> Column:
    """The value as ``kind``, NULL where it has none; numbers are rounded, as they are when stored.

    A text keeps its characters: whether it is too long is told by ``unfit``.
    """
    col = F.col(col) if isinstance(col, str) else col
    if isinstance(kind, T.DecimalType):
        return F.round(col.try_cast(_WIDE), kind.scale).try_cast(kind)
    if isinstance(kind, T.IntegralType):
        return F.round(col.try_cast(_WIDE)).try_cast(kind)
    if isinstance(kind, (T.VarcharType, T.StringType)):
        return col.cast("string")
    return col.try_cast(kind)


def unfit(col: Column | str, kind: T.DataType) -> Column:
    """Whether a value is given that ``kind`` cannot hold; never NULL."""
    col = F.col(col) if isinstance(col, str) else col
    if isinstance(kind, T.VarcharType):
        return F.coalesce(F.length(col.cast("string")) > kind.length, F.lit(False))
    return col.isNotNull() & fitted(col, kind).isNull()


class Rules:
    """Types of a table's columns: the declared limits of texts, and numbers as the frame has them."""

    def __init__(self, table: str, like: DataFrame | None = None, sources: dict[str, str] | None = None):
        """``sources`` names the column a value comes from where it is not called like its target."""
        self.kinds = {f.name: f.dataType for f in declared(table).fields}
        for f in like.schema.fields if like is not None else []:
            if not isinstance(self.kinds.get(f.name), (T.VarcharType, T.StringType)):
                self.kinds[f.name] = f.dataType
        self.sources = sources or {}

    def _pairs(self, df: DataFrame, columns: list[str]) -> list[tuple[str, str]]:
        named = [(c, self.sources.get(c, c)) for c in columns]
        return [(c, source) for c, source in named if source in df.columns]

    def faults(self, df: DataFrame, columns: list[str]) -> Column:
        """Names of the source columns whose value does not fit, joined by commas; '' if all do."""
        found = [F.when(unfit(s, self.kinds[c]), F.lit(s)) for c, s in self._pairs(df, columns)]
        return F.array_join(F.array_compact(F.array(*found)), ",")

    def judge(self, df: DataFrame, columns: list[str], incomplete: Column) -> DataFrame:
        """The rows with ``reason``: 'incomplete', 'unfit: ' and the columns, or NULL."""
        faults = self.faults(df, columns)
        return df.withColumn(
            "reason",
            F.when(incomplete, F.lit("incomplete")).when(faults != "", F.concat(F.lit("unfit: "), faults)),
        )

    def typed(self, df: DataFrame, columns: list[str]) -> DataFrame:
        """The rows with the values of ``columns`` in their types."""
        return df.withColumns({s: fitted(s, self.kinds[c]) for c, s in self._pairs(df, columns)})
