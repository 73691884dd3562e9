"""Records in order: a frame whose hidden columns say which record comes before which."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.paths import ref

HIDDEN = "__doc_"
INDEX = f"{HIDDEN}idx"


@dataclass(frozen=True)
class Rows:
    """`order` sorts the records; `sorted_by` counts the sorts that were put before the index;
    rows that a step has `shuffled` are put in order again when they are shown."""

    df: DataFrame
    order: tuple[tuple[Column, bool], ...]  # with whether it descends
    sorted_by: int = 0
    tables: dict[str, DataFrame] | None = None
    shuffled: bool = False

    @classmethod
    def of(cls, df: DataFrame, order: list[str] | None = None, tables: dict[str, DataFrame] | None = None) -> Rows:
        """Records come in the order of the named columns, else as the source has them."""
        if INDEX not in df.columns:
            index = F.struct(*[ref(c) for c in order]) if order else F.monotonically_increasing_id()
            df = df.withColumn(INDEX, index)
        return cls(df, ((F.col(INDEX), False),), 0, tables or {})

    @property
    def fields(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith(HIDDEN)]

    @property
    def hidden(self) -> list[Column]:
        return [F.col(c) for c in self.df.columns if c.startswith(HIDDEN)]

    @property
    def visible(self) -> DataFrame:
        df = self.df.orderBy(*self.by()) if self.shuffled else self.df
        return df.select(*[ref(c) for c in self.fields])

    def schema(self):
        return self.df.select(*[ref(c) for c in self.fields]).schema

    def with_df(self, df: DataFrame) -> Rows:
        return replace(self, df=df)

    def scattered(self, df: DataFrame) -> Rows:
        """`df`, which holds records with their hidden columns in any order."""
        return replace(self, df=df, shuffled=True)

    def project(self, columns: list[Column]) -> Rows:
        """These columns, and the hidden ones."""
        return self.with_df(self.df.select(*columns, *self.hidden))

    def one(self, df: DataFrame) -> Rows:
        """A single record that stands for all."""
        return Rows.of(df, tables=self.tables)

    def by(self, backwards: bool = False) -> list[Column]:
        """What orderBy takes: nulls come first, last where it descends."""
        return [c.desc_nulls_last() if descends != backwards else c.asc_nulls_first() for c, descends in self.order]

    def sort(self, keys: list[tuple[Column, bool]]) -> Rows:
        """`keys` go before the order so far, which decides ties."""
        out = replace(self, order=(*keys, *self.order), sorted_by=self.sorted_by + 1, shuffled=False)
        return out.with_df(self.df.orderBy(*out.by()))
