"""Row filters on a text verdict that keep every column as it is."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from nearfield.llm.common import sliced


def keep_rows(df: DataFrame, text_col: str, verdict: Callable[[list], Sequence[bool]]) -> DataFrame:
    """Rows whose text the verdict (texts -> booleans) keeps.  Arrow batches pass through, so that no value of the
    other columns changes its type on the way.  NULL texts reach the verdict as None; an empty table stays empty; columns
    may have any names and types that Arrow knows."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield b.filter(pa.array(verdict(b.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)
