"""Exact nearest-neighbour plans.

Order of a plan: scan with pushed predicates -> id set -> distance -> distance bounds -> top k -> wide
columns.  Only (id, distance) and what the predicates need go through the top k; wide columns are joined
back to at most K_MAX rows.  Batches of queries and range joins work on blocks of vectors (blocks.py, kernels.py).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield import texts as M
from nearfield.errors import VectorError
from nearfield.functions import scalar as S
from nearfield.plans import kernels
from nearfield.plans.blocks import BLOCK_ROWS, blocks, matrix, merged

K_MAX = 4096
#: Query vectors that one pass over the table serves, at most so many bytes.
QUERY_BYTES = 64 << 20
_BOUNDS = {"gt": lambda d, x: d > x, "ge": lambda d, x: d >= x, "lt": lambda d, x: d < x, "le": lambda d, x: d <= x}


def check_k(k: int) -> int:
    if k < 0:
        raise VectorError(M.K_NEGATIVE)
    if k > K_MAX:
        raise VectorError(M.K_LARGE.format(k, K_MAX))
    return k


#: What strict_compat lets a predicate be made of, by the names of Catalyst's expressions.
_ALLOWED = {"EqualTo", "EqualNullSafe", "LessThan", "LessThanOrEqual", "GreaterThan", "GreaterThanOrEqual", "Not", "In", "And", "Or", "Between", "Literal", "AttributeReference", "Cast"}


def _strict(df: DataFrame, predicate: Column, barred: frozenset) -> None:
    """Raises for a predicate that names a barred column or is made of other operators than comparisons."""
    todo = [df.filter(predicate)._jdf.queryExecution().analyzed().condition()]
    while todo:
        e = todo.pop()
        kind, children = e.nodeName(), [e.children().apply(i) for i in range(e.children().size())]
        if kind == "AttributeReference" and e.name() in barred:
            raise VectorError(f"an auxiliary column cannot be used in a search's WHERE: {e.name()}")
        if kind not in _ALLOWED:
            raise VectorError(f"illegal operator in a search's WHERE: {kind}")
        of = {c.dataType().typeName() for c in children}
        if "boolean" in of and kind not in ("EqualTo", "Not", "And", "Or"):
            raise VectorError("boolean columns take = and != only")
        if kind == "In" and of & {"boolean", "double", "float"}:
            raise VectorError("IN takes integers and texts only")
        todo += children


def literal(query, elem: str) -> Column:
    if isinstance(query, Column):
        return query
    if elem == "bit":
        return F.lit(bytes(query))
    return F.array(*[F.lit(float(x) if elem == "float32" else int(x)) for x in query]).cast("array<float>" if elem == "float32" else "array<tinyint>")


@dataclass(frozen=True)
class Knn:
    """A search over one vector column.  Methods return a changed copy; ``run`` gives the DataFrame.

    Rows whose distance is NULL (a NULL vector, or a zero vector under cosine) are left out.  Ties go to the
    smaller id.  Fewer than k rows: all of them; k = 0: none.
    """

    df: DataFrame
    column: str
    id_col: str = "vec_id"
    elem: str = "float32"
    metric: str = "l2"
    predicates: tuple = ()
    bounds: tuple = field(default=())
    #: With strict_compat: the columns that a predicate must not name.
    barred: frozenset | None = None

    def where(self, predicate: Column) -> Knn:
        if self.barred is not None:
            _strict(self.df, predicate, self.barred)
        return replace(self, predicates=(*self.predicates, predicate))

    def within(self, **bounds: float) -> Knn:
        """gt, ge, lt, le on the distance, applied before the top k."""
        if bad := set(bounds) - set(_BOUNDS):
            raise VectorError(f"illegal constraint on distance: {sorted(bad)}")
        return replace(self, bounds=(*self.bounds, *bounds.items()))

    def ids(self, ids: Iterable | DataFrame, keep: bool = True) -> Knn:
        """Only (or all but) these ids.  A DataFrame becomes a semi (anti) join; Spark chooses how to run it."""
        if isinstance(ids, DataFrame):
            other = ids.select(F.col(ids.columns[0]).alias(self.id_col)).distinct()
            return replace(self, df=self.df.join(other, self.id_col, "left_semi" if keep else "left_anti"))
        inside = F.col(self.id_col).isin(list(ids))
        return self.where(inside if keep else ~inside)

    def filtered(self) -> DataFrame:
        df = self.df
        for p in self.predicates:
            df = df.filter(p)
        return df

    def scored(self, query) -> DataFrame:
        """All rows that pass, with their distance."""
        d = S.distance(F.col(self.column), literal(query, self.elem), self.elem, self.metric)
        df = self.filtered().withColumn("distance", d).filter(F.col("distance").isNotNull())
        for op, x in self.bounds:
            df = df.filter(_BOUNDS[op](F.col("distance"), F.lit(float(x))))
        return df

    def run(self, query, k: int, columns: Iterable[str] = (), order_by: str = "distance") -> DataFrame:
        """(id, distance, columns) of the k nearest rows to one query vector.  order_by, a column of the result, orders the
        k rows; with strict_compat only distance does."""
        if order_by != "distance":
            if self.barred is not None:
                raise VectorError("a search can be ordered by distance only")
            return replace(self, barred=None).run(query, k, [*columns, *([] if order_by in (self.id_col, *columns) else [order_by])]).orderBy(order_by)
        top = self.scored(query).select(self.id_col, "distance").orderBy("distance", self.id_col).limit(check_k(k))
        columns = [c for c in columns if c not in (self.id_col, "distance")]
        if not columns:
            return top
        wide = self.df.select(self.id_col, *columns)  # k <= K_MAX rows bound the broadcast
        return wide.join(F.broadcast(top), self.id_col).select(self.id_col, "distance", *columns)

    def batch_sql(self, queries: DataFrame, k: int, query_id: str = "query_id", query_col: str = "query") -> DataFrame:
        """The k nearest rows of every query row, as a window over a join: the defining form."""
        q = queries.select(F.col(query_id).alias("query_id"), F.col(query_col).alias("_q"))
        d = S.distance(F.col(self.column), F.col("_q"), self.elem, self.metric)
        pairs = self.filtered().select(self.id_col, self.column).crossJoin(q).select("query_id", self.id_col, d.alias("distance")).filter(F.col("distance").isNotNull())
        for op, x in self.bounds:
            pairs = pairs.filter(_BOUNDS[op](F.col("distance"), F.lit(float(x))))
        return self._ranked(pairs, k)

    def _ranked(self, pairs: DataFrame, k: int) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy("distance", self.id_col)
        return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= check_k(k))

    def batch(self, queries: DataFrame, k: int, query_id: str = "query_id", query_col: str = "query") -> DataFrame:
        """As batch_sql, in blocks: blocks of queries are rows that meet blocks of the table, every task keeps the k best of
        its rows for each query, and a window merges them.  Up to QUERY_BYTES of queries are sent to every task; more of
        them meet the table in a Cartesian product of blocks, so that neither the driver nor a task holds all."""
        check_k(k)
        asked = blocks(queries, query_id, query_col).withColumn("_q", F.monotonically_increasing_id())
        asked = asked.select("_q", F.struct("ids", "t", "n", "m").alias("q"))
        if (asked.agg(F.sum(F.octet_length("q.m"))).first()[0] or 0) <= QUERY_BYTES:
            asked = F.broadcast(asked)
        rows = blocks(self.filtered(), self.id_col, self.column)
        kinds = queries.schema[query_id].dataType, self.df.schema[self.id_col].dataType
        found = _nearest(rows.select(F.struct("ids", "t", "n", "m").alias("b")).crossJoin(asked), k, self.metric, self.bounds, kinds)
        return self._ranked(found.withColumnRenamed("_id", self.id_col), k)


def _nearest(pairs: DataFrame, k: int, metric: str, bounds: tuple, kinds: tuple) -> DataFrame:
    """(query_id, _id, distance): of the pairs of blocks (b, _q, q) in a task the k nearest of each query."""
    schema = T.StructType([T.StructField("query_id", kinds[0]), T.StructField("_id", kinds[1]), T.StructField("distance", T.DoubleType())])
    low = max([x for op, x in bounds if op in ("gt", "ge")], default=-np.inf)
    high = min([x for op, x in bounds if op in ("lt", "le")], default=np.inf)

    def out(held: dict) -> Iterator[pa.RecordBatch]:
        for (pos, d, ids), qids in held.values():
            for i in range(0, len(d), 10_000):
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(pos[i : i + 10_000])), ids.slice(i, 10_000), pa.array(d[i : i + 10_000])], schema.names)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for r in range(batch.num_rows):
                key, side = cols["_q"][r].as_py(), {}
                for c in ("b", "q"):
                    s = cols[c][r]
                    side[c] = s["ids"].values, np.frombuffer(s["m"].as_buffer(), s["t"].as_py()).reshape(s["n"].as_py(), -1)
                (ids, x), (qids, q) = side["b"], side["q"]
                if x.shape[1] != q.shape[1]:
                    raise VectorError(M.DIMENSIONS % (x.shape[1], q.shape[1]))
                step = max(1, kernels.STEP_BYTES // (8 * len(x)))
                for lo in range(0, len(q), step):
                    pos, at = kernels.nearest(x, q[lo : lo + step], metric, k, low, high)
                    pos = pos + lo
                    d = kernels.exact(x, q, pos, at, metric)
                    for op, bound in bounds:
                        fine = _BOUNDS[op](d, bound)
                        pos, at, d = pos[fine], at[fine], d[fine]
                    held[key] = merged(held[key][0] if key in held else None, pos, d, ids.take(pa.array(at)), k), qids
            if sum(v[0][1].nbytes for v in held.values()) > QUERY_BYTES:
                yield from out(held)
                held = {}
        yield from out(held)

    return pairs.mapInArrow(search, schema)


def range_join(a: DataFrame, b: DataFrame, radius: float, id_col: str, column: str, metric: str = "l2", cells: int = 64, sample: int = 16384, seed: int = 42) -> DataFrame:
    """Pairs (a_id < b_id) of two vector tables closer than radius; cosine is turned into l2 of unit vectors first.

    b's vectors are members of the cell of their nearest centroid (k-means of the ``sample`` rows with the smallest hashes).
    A vector of a visits the cells that can hold a partner: by the triangle inequality those whose centroid is no farther
    than the cell's radius and this one, and no farther than its own nearest centroid and twice this one.  Members and
    visitors of a cell are cut into blocks, so that a cell of any size is compared by many tasks; matrix products prune,
    and what they leave is measured exactly.  Where all vectors lie at nearly one distance from another (random ones in many
    dimensions) no such bound rules cells out, and all pairs are measured, in blocks.
    """
    if metric not in ("l2", "l1"):
        raise VectorError("range_join takes l2 or l1; normalise first for cosine")
    picked = [r[column] for r in b.filter(F.col(column).isNotNull()).orderBy(F.xxhash64(id_col, F.lit(seed)), id_col).select(column).limit(sample).collect()]
    centres = kernels.kmeans(np.array(picked, "f8"), cells, 10, seed) if picked else np.zeros((1, 1))

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            d = kernels.pairwise(centres, matrix(x.column(1)), metric) if x.num_rows else np.empty((0, 1))
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(d.argmin(1), pa.int32()), pa.array(d.min(1, initial=np.inf))], ["_id", "_v", "cell", "_d"])

    def member(df: DataFrame) -> DataFrame:
        rows = spread(df.filter(F.col(column).isNotNull()).select(F.col(id_col).alias("_id"), F.col(column).alias("_v")))
        return rows.mapInArrow(cell, T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("_d", T.DoubleType())]))

    members = member(b)
    shape = {r["cell"]: (r["r"], r["n"]) for r in members.groupBy("cell").agg(F.max("_d").alias("r"), F.count("*").alias("n")).collect()}  # a row a cell
    reach = np.array([shape.get(i, (-np.inf, 0))[0] for i in range(len(centres))])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                d = kernels.pairwise(centres, matrix(x.column(1)), metric)
                slack = 1e-9 * (1 + d.max())
                who, where = np.nonzero((d <= reach + radius + slack) & (d <= d.min(1)[:, None] + 2 * radius + slack) & np.isfinite(reach))
                got = x.take(pa.array(who))
                yield pa.RecordBatch.from_arrays([*got.columns, pa.array(where, pa.int32())], ["_id", "_v", "cell"])

    rows = spread(a.filter(F.col(column).isNotNull()).select(F.col(id_col).alias("_id"), F.col(column).alias("_v")))
    visitors = rows.mapInArrow(visits, T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())]))
    sizes = F.create_map(*[F.lit(x) for c, (_, n) in shape.items() for x in (c, n // BLOCK_ROWS + 1)]) if shape else F.create_map(F.lit(0), F.lit(1))
    part = F.pmod(F.xxhash64("_id"), F.coalesce(F.try_element_at(sizes, F.col("cell")), F.lit(1)).cast("bigint"))
    cut = lambda df: blocks(df.select("cell", "_id", "_v", part.alias("part")).repartition("cell", "part").sortWithinPartitions("cell", "part"), "_id", "_v", ["cell", "part"])
    side = lambda df, c: cut(df).select("cell", F.struct("ids", "t", "n", "m").alias(c))
    kind = rows.schema["_id"].dataType
    pairs = side(visitors, "x").join(side(members, "y"), "cell")
    schema = T.StructType([T.StructField("a_id", kind), T.StructField("b_id", b.schema[id_col].dataType), T.StructField("distance", T.DoubleType())])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = batch.column(1), batch.column(2)
            for r in range(batch.num_rows):
                (xi, x), (yi, y) = [(s["ids"].values, np.frombuffer(s["m"].as_buffer(), s["t"].as_py()).reshape(s["n"].as_py(), -1)) for s in (xs[r], ys[r])]
                step = max(1, kernels.STEP_BYTES // (8 * len(y)))
                for lo in range(0, len(x), step):
                    d, off = kernels.about(y, x[lo : lo + step], metric)
                    pos, at = np.nonzero(d < radius + off)
                    pos = pos + lo
                    d = kernels.exact(y, x, pos, at, metric)
                    fine = d < radius
                    yield pa.RecordBatch.from_arrays([xi.take(pa.array(pos[fine])), yi.take(pa.array(at[fine])), pa.array(d[fine])], schema.names)

    return pairs.repartition("cell", F.xxhash64("x.ids"), F.xxhash64("y.ids")).mapInArrow(near, schema).filter("a_id < b_id")


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores (a table of one small file is read by one task)."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= n else df.repartition(n)
