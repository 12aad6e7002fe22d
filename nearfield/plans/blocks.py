"""Blocks of vectors as rows: (ids, t, n, m), the ids an array, the vectors one matrix of n rows as bytes of type t.

Ids and other columns never leave Arrow, so that they stay what they are whatever their type, and beside NULLs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.errors import VectorError

BLOCK_ROWS, BLOCK_BYTES = 4096, 8 << 20


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of an Arrow column without NULLs, one a row; they must have one length."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        held = column.to_pylist()
        flat, sizes = np.frombuffer(b"".join(held), "u1"), {len(v) for v in held}
    else:
        flat, sizes = column.flatten().to_numpy(zero_copy_only=False), set(pc.unique(pc.list_value_length(column)).to_pylist())
    if len(sizes) > 1:
        raise VectorError(f"vectors of different dimensions in one column: {sorted(sizes)}")
    return flat.reshape(len(column), -1)


def unpacked(row: dict) -> np.ndarray:
    return np.frombuffer(row["m"], row["t"]).reshape(row["n"], -1)


def pack(ids: pa.Array, vectors: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray]]:
    step = max(1, min(BLOCK_ROWS, BLOCK_BYTES // max(1, vectors.shape[1] * 8)))
    for i in range(0, len(vectors), step):
        yield ids.slice(i, step), vectors[i : i + step]


def blocks(df: DataFrame, id_col: str, column: str, by: Sequence[str] = ()) -> DataFrame:
    """df's vectors that are not NULL in blocks of rows that stand together (and agree in ``by``, columns of integers)."""
    rows = df.filter(F.col(column).isNotNull()).select(*by, F.col(id_col).alias("_id"), F.col(column).alias("_v"))
    schema = T.StructType([*[rows.schema[c] for c in by], T.StructField("ids", T.ArrayType(rows.schema["_id"].dataType)), *T._parse_datatype_string("t string, n int, m binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            keys = [b.column(i).to_numpy(zero_copy_only=False) for i in range(len(by))]
            cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1 if by and b.num_rows > 1 else np.empty(0, "i8")
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                part = b.slice(lo, hi - lo)
                for ids, m in pack(part.column(len(by)), matrix(part.column(len(by) + 1))):
                    own = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                    yield pa.RecordBatch.from_arrays([*[part.column(i).slice(0, 1) for i in range(len(by))], own, pa.array([m.dtype.str]), pa.array([len(m)], pa.int32()), pa.array([m.tobytes()], pa.binary())], schema.names)

    return rows.mapInArrow(run, schema)


def merged(old: tuple | None, pos: np.ndarray, d: np.ndarray, ids: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(pos, distance, id) of the k nearest of each query among the old and the new ones; ties by id, NULL first."""
    if old is not None:
        pos, d, ids = np.concatenate([old[0], pos]), np.concatenate([old[1], d]), pa.concat_arrays([old[2], ids])
    rank = pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
    order = np.lexsort((rank, d, pos))
    p = pos[order]
    first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else np.empty(0, "i8")
    place = np.arange(len(p)) - np.repeat(first, np.diff(np.append(first, len(p))))
    order = order[place < k]
    return pos[order], d[order], ids.take(pa.array(order))
