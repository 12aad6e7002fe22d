"""Versioned vector tables: a change writes the rows of the files that it touches, and then a new list of files.

``<path>/_spec.json``; ``<path>/data/d=<name>/`` (Parquet, by cell and partition keys); ``<path>/_log/<n>.json``, the files of
version n and the state of its indexes; ``<path>/index/``.  An insert adds files; update, replace and delete rewrite the
files that hold a row concerned.  A version is put in place by a rename that fails where it is there already, so that of
two writers one is told to try again (an insert does so itself).  Files are reached by Hadoop's file system API, so any
store that Spark reads will do.  Readers that opened an earlier version keep it until ``vacuum``.

A search uses the index that its column declares: an ivf column's rows are stored by cell (-1 until one is assigned), and a
search reads the probed cells' files; a rescore column's codes are stored beside it and scanned first; a diskann column's
graph covers the files there were when it was built, and rows of later files are its buffer.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, replace
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield import texts as M
from nearfield.errors import VectorError
from nearfield.functions import scalar as S
from nearfield.operators import rescore
from nearfield.operators.graph import GraphIndex
from nearfield.operators.ivf import UNASSIGNED, IvfIndex
from nearfield.plans.knn import Knn
from nearfield.plans.spec import VecTableSpec, VectorColumn

FORMAT = 2
TRIES = 5


class ChangedByOther(VectorError):
    """Another writer has put its version in place first."""


class _Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root, self.conf = spark._jvm, root.rstrip("/"), spark._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def write_new(self, name: str, text: str) -> bool:
        """Whole or not at all: written aside, then renamed to a name that must be free.  False where it is not."""
        side, to = self._path(f"{name}.{uuid.uuid4().hex}.new"), self._path(name)
        out = self.fs.create(side, False)
        out.write(bytearray(text.encode()))
        out.close()
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri() if to.toUri().getScheme() else self.fs.getUri(), self.conf).rename(side, to, options)
        except Py4JJavaError as e:
            self.fs.delete(side, False)
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise
        return True

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._path(name))] if self.exists(name) else []

    def parquet(self, name: str) -> list[str]:
        """The Parquet files below a folder, by their paths below the root."""
        found, base = self.fs.listFiles(self._path(name), True), self.fs.makeQualified(self._path("")).toUri().getPath().rstrip("/")
        out = []
        while found.hasNext():
            path = found.next().getPath()
            if path.getName().endswith(".parquet"):
                out.append(path.toUri().getPath()[len(base) + 1 :])
        return sorted(out)

    def below_root(self, uri: str) -> str:
        """A file's path below the root, from what Spark calls it."""
        base = self.fs.makeQualified(self._path("")).toUri().getPath().rstrip("/")
        path = unquote(uri)
        return path[path.index(f"{base}/") + len(base) + 1 :]

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def rename(self, to: str) -> None:
        if not self.fs.rename(self._path(""), self.jvm.org.apache.hadoop.fs.Path(to)):
            raise VectorError(f"cannot rename {self.root} to {to}")


@dataclass(frozen=True)
class IvfKnn(Knn):
    """A search that reads the cells nearest the query, and rows without a cell."""

    ivf: IvfIndex | None = None
    quantizer: str = "none"
    oversample: int = 1

    def run(self, query, k: int, columns: Iterable[str] = (), order_by: str = "distance") -> DataFrame:
        probed = replace(self, df=self.df.filter(F.col("_cell").isin(self.ivf.probes(list(query)))))
        if self.quantizer == "none":
            return Knn.run(probed, query, k, columns, order_by)
        top = rescore.search(probed, list(query), k, {"binary": "bit"}.get(self.quantizer, self.quantizer), self.oversample)
        return Knn.run(replace(probed, df=probed.df.join(F.broadcast(top.select(self.id_col)), self.id_col)), query, k, columns, order_by)

    def batch(self, queries: DataFrame, k: int, query_id: str = "query_id", query_col: str = "query") -> DataFrame:
        return self.ivf.batch(self.filtered().withColumnRenamed("_cell", "cell"), queries, k, None, query_id, query_col, self.bounds)


@dataclass(frozen=True)
class RescoreKnn(Knn):
    """A search over the stored codes, then over the nearest rows by these."""

    quantizer: str = "bit"
    oversample: int = 8

    def run(self, query, k: int, columns: Iterable[str] = (), order_by: str = "distance") -> DataFrame:
        top = rescore.search(self, list(query), k, self.quantizer, self.oversample, f"_code_{self.column}")
        exact = replace(self, df=self.df.join(F.broadcast(top.select(self.id_col)), self.id_col), predicates=())  # at most k rows
        return Knn.run(exact, query, k, columns, order_by)

    def batch(self, queries: DataFrame, k: int, query_id: str = "query_id", query_col: str = "query") -> DataFrame:
        return rescore.batch(self, queries, k, self.quantizer, self.oversample, query_id, query_col, f"_code_{self.column}")


@dataclass(frozen=True)
class GraphKnn(Knn):
    """A search of the stored graph and, exactly, of rows that it does not cover.  Rows that a predicate bars are passed
    through as deleted ones are.  Distance bounds need all distances: such searches are exact."""

    graph: GraphIndex | None = None
    index: DataFrame | None = None
    covered: tuple = ()
    width: int = 128

    def batch(self, queries: DataFrame, k: int, query_id: str = "query_id", query_col: str = "query") -> DataFrame:
        if self.bounds:
            return Knn.batch(self, queries, k, query_id, query_col)
        rows = self.filtered()
        inside = F.col("_file").isin(list(self.covered)) if self.covered else F.lit(False)
        dead = self.index.select(self.id_col).join(rows.filter(inside).select(self.id_col), self.id_col, "left_anti")
        found = self.graph.search(self.index, queries, k, self.width, None, dead, query_id, query_col)
        waiting = Knn(rows.filter(~inside), self.column, self.id_col, self.elem, self.metric).batch(queries, k, query_id, query_col)
        return self._ranked(found.drop("rank").unionByName(waiting.drop("rank")), k)

    def run(self, query, k: int, columns: Iterable[str] = (), order_by: str = "distance") -> DataFrame:
        if self.bounds:
            return Knn.run(self, query, k, columns, order_by)
        one = self.df.sparkSession.createDataFrame([(0, [float(x) for x in query])], "query_id long, query array<double>")
        top = self.batch(one, k).select(self.id_col)
        return Knn.run(replace(self, df=self.df.join(F.broadcast(top), self.id_col), predicates=()), query, k, columns, order_by)  # at most k rows


class VecTable:
    """A table of vectors with a primary key.  insert, replace, update and delete each make one version."""

    def __init__(self, spark: SparkSession, path: str, spec: VecTableSpec):
        self.spark, self.path, self.spec, self.files = spark, path.rstrip("/"), spec, _Files(spark, path)

    @classmethod
    def create(cls, spark: SparkSession, path: str, definition: str | VecTableSpec, strict_compat: bool = False) -> VecTable:
        spec = definition if isinstance(definition, VecTableSpec) else VecTableSpec.parse(definition, strict_compat)
        table = cls(spark, path, spec)
        if not table.files.write_new("_spec.json", json.dumps({"format": FORMAT, "spec": spec.to_json()})):
            raise VectorError(f"table {path} already exists")
        table._commit(0, [], {})
        return table

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VecTable:
        held = json.loads(_Files(spark, path).read("_spec.json"))
        if held.get("format") != FORMAT:
            raise VectorError(f"table {path} has format {held.get('format')}; this engine reads {FORMAT}")
        return cls(spark, path, VecTableSpec.from_json(held["spec"]))

    # --- versions

    @property
    def version(self) -> int:
        return max([int(n[:-5]) for n in self.files.names("_log") if n.endswith(".json") and n[:-5].isdigit()], default=0)

    def _state(self, version: int | None = None) -> tuple[int, list[str], dict]:
        n = self.version if version is None else version
        held = json.loads(self.files.read(f"_log/{n}.json"))
        return n, held["files"], held["index"]

    def _commit(self, base: int, files: list[str], index: dict) -> None:
        if not self.files.write_new(f"_log/{base + 1}.json", json.dumps({"files": files, "index": index})):
            raise ChangedByOther(f"version {base + 1} of {self.path} was written by another writer; read the table again and retry")

    # --- reading

    def _indexed(self, kind: str) -> list[VectorColumn]:
        return [v for v in self.spec.vectors if v.index == kind]

    @property
    def _cells(self) -> VectorColumn | None:
        """The column whose cells rows are stored by: the first with an ivf index."""
        return next(iter(self._indexed("ivf")), None)

    def _stored(self) -> T.StructType:
        extra = [T.StructField(f"_code_{v.name}", T.BinaryType() if v.options["quantizer"] == "bit" else T.ArrayType(T.ByteType())) for v in self._indexed("rescore")]
        return T.StructType([*self.spec.schema().fields, *extra, *([T.StructField("_cell", T.IntegerType())] if self._cells else [])])

    def _read(self, files: list[str]) -> DataFrame:
        """The rows of some files, with codes, cells and ``_file``."""
        if not files:
            return self.spark.createDataFrame([], T.StructType([*self._stored().fields, T.StructField("_file", T.StringType())]))
        rows = self.spark.read.schema(self._stored()).option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/{f}" for f in files])
        name = F.substring_index(F.substring_index("_metadata.file_path", "/data/", -1), "?", 1)
        return rows.select(*self._stored().names, name.alias("_file"))

    def df(self, version: int | None = None) -> DataFrame:
        return self._read(self._state(version)[1]).select(*self.spec.schema().names)

    def info(self) -> DataFrame:
        n, files, index = self._state()
        return self.spark.createDataFrame([("version", str(n)), ("format", str(FORMAT)), ("engine", S.vec_version()), ("files", str(len(files))), ("indexes", ",".join(sorted(index))), ("spec", self.spec.to_json())], "key string, value string")

    # --- writing

    def _valid(self, rows: DataFrame) -> DataFrame:
        """rows in the table's types.  Wrong dimensions, NULL vectors, and NULL metadata under strict_compat raise
        while the job runs; unknown columns raise here."""
        spec, schema = self.spec, self.spec.schema()
        if extra := set(rows.columns) - {f.name for f in schema}:
            raise VectorError(f"no such columns: {sorted(extra)}")
        if "distance" in rows.columns or "k" in rows.columns:
            raise VectorError("hidden columns cannot be written")
        if spec.key not in rows.columns:
            if spec.key_type != "bigint":
                raise VectorError("text primary keys must be given")
            top = self.df().agg(F.coalesce(F.max(spec.key), F.lit(0)).alias("_top"))
            numbered = rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
            before = numbered.groupBy("_part").count().withColumn("_off", F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
            own = F.row_number().over(Window.partitionBy("_part").orderBy("_at"))
            rows = numbered.withColumn("_own", own).join(F.broadcast(before.select("_part", "_off")), "_part").crossJoin(F.broadcast(top)).withColumn(spec.key, F.col("_top") + F.coalesce("_off", F.lit(0)) + F.col("_own")).drop("_part", "_at", "_off", "_own", "_top")
        out = []
        for f in schema:
            c = F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType)
            c = c.cast(f.dataType)
            v = next((v for v in spec.vectors if v.name == f.name), None)
            if v:
                n = S.vec_length(c, v.elem)
                c = F.when(c.isNull(), F.raise_error(F.lit(f"column {v.name}: vector is NULL")).cast("void")).when(n != v.dims, F.raise_error(F.concat(F.lit(M.DIMENSION_OF_COLUMN.format(v.name, v.dims)), n.cast("string"))).cast("void")).otherwise(c)
            elif f.name == spec.key or spec.strict_compat and f.name in spec.metadata:
                c = F.when(c.isNull(), F.raise_error(F.lit(f"column {f.name} is NULL")).cast("void")).otherwise(c)
            out.append(c.alias(f.name))
        return rows.select(*out)

    def _unique(self, rows: DataFrame, against: DataFrame | None) -> None:
        key = self.spec.key
        twice = rows.groupBy(key).count().filter("count > 1").select(key)
        if against is not None:
            twice = twice.unionByName(rows.select(key).join(against.select(key), key, "left_semi"))
        if twice.limit(1).count():
            raise VectorError(M.UNIQUE.format(self.path.rsplit("/", 1)[-1]))

    def _put(self, rows: DataFrame, index: dict) -> list[str]:
        """Writes rows (of the table's columns) to a new folder; its files.  Folders are by cell and partition keys, and rows
        are dealt by ranges of these and a hash of the key, so that a hot one is written by many tasks."""
        for v in self._indexed("rescore"):
            rows = rescore.build(rows, v.name, v.options["quantizer"], f"_code_{v.name}")
        keys = list(self.spec.partitions)
        if self._cells:
            ivf = self._ivf(index)
            rows = (ivf.assign(rows) if ivf else rows.withColumn("cell", F.lit(UNASSIGNED))).withColumnRenamed("cell", "_cell")
            keys = ["_cell", *keys]
        folder = f"data/d=w{uuid.uuid4().hex}"
        writer = (rows.repartitionByRange(*keys, F.xxhash64(self.spec.key)) if keys else rows).write
        (writer.partitionBy(*keys) if keys else writer).parquet(f"{self.path}/{folder}")
        return self.files.parquet(folder)

    def _touched(self, files: list[str], which) -> list[str]:
        """The files with a row that ``which`` (rows -> rows) leaves: names only come to the driver."""
        named = {f[len("data/") :]: f for f in files}
        return [named[unquote(r[0])] if unquote(r[0]) in named else named[r[0]] for r in which(self._read(files)).select("_file").distinct().collect()]

    def _rewrite(self, base: int, files: list[str], index: dict, touched: list[str], rows: DataFrame) -> None:
        gone = set(touched)
        self._commit(base, [f for f in files if f not in gone] + self._put(rows, index), index)

    def insert(self, rows: DataFrame) -> None:
        rows, added = self._valid(rows), None
        for last in [False] * (TRIES - 1) + [True]:
            base, files, index = self._state()
            self._unique(rows, self._read(files))
            added = added or self._put(rows, index)
            try:
                self._commit(base, files + added, index)
                break
            except ChangedByOther:
                if last:
                    raise
        for v in self._indexed("diskann"):
            if v.name in index and v.options["buffer_threshold"]:
                self._flush(v)

    def replace(self, rows: DataFrame) -> None:
        """INSERT OR REPLACE: rows with a known key take the old row's place."""
        rows, key = self._valid(rows), self.spec.key
        self._unique(rows, None)
        base, files, index = self._state()
        touched = self._touched(files, lambda x: x.join(rows.select(key), key, "left_semi"))
        kept = self._read(touched).join(rows.select(key), key, "left_anti").select(*rows.columns)
        self._rewrite(base, files, index, touched, kept.unionByName(rows))

    def update(self, changes: dict[str, Column | object], where: Column) -> None:
        """Sets columns on the rows where the condition is true.  The key and partition keys cannot change."""
        if bad := set(changes) & {self.spec.key, *self.spec.partitions}:
            raise VectorError(f"UPDATE on {sorted(bad)} is not supported")
        base, files, index = self._state()
        hit = F.coalesce(where, F.lit(False))
        touched = self._touched(files, lambda x: x.filter(hit))
        if touched:
            new = {c: F.when(hit, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in changes.items()}
            rows = self._read(touched).select(*self.spec.schema().names)
            self._rewrite(base, files, index, touched, self._valid(rows.withColumns(new)))

    def delete(self, where: Column | DataFrame) -> None:
        """Drops rows by a condition, or by a table of keys."""
        base, files, index = self._state()
        key = self.spec.key
        if isinstance(where, DataFrame):
            ids = where.select(F.col(where.columns[0]).alias(key)).distinct()
            hit, rest = (lambda x: x.join(ids, key, "left_semi")), (lambda x: x.join(ids, key, "left_anti"))
        else:
            hit, rest = (lambda x: x.filter(where)), (lambda x: x.filter(~F.coalesce(where, F.lit(False))))
        touched = self._touched(files, hit)
        if touched:
            self._rewrite(base, files, index, touched, rest(self._read(touched)).select(*self.spec.schema().names))

    # --- searching

    def point(self, key: object) -> DataFrame:
        return self.df().filter(F.col(self.spec.key) == F.lit(key))

    def knn(self, column: str | None = None) -> Knn:
        """A search of the column by the index that it declares, exact where it has none or none is built yet."""
        v = self.spec.vector(column)
        _, files, index = self._state()
        barred = frozenset(self.spec.auxiliary) if self.spec.strict_compat else None
        base = {"df": self._read(files), "column": v.name, "id_col": self.spec.key, "elem": v.elem, "metric": v.metric, "barred": barred}
        if v is self._cells and (ivf := self._ivf(index)):
            return IvfKnn(**base, ivf=ivf, quantizer=v.options["quantizer"], oversample=v.options["oversample"])
        if v.index == "rescore":
            return RescoreKnn(**base, quantizer=v.options["quantizer"], oversample=v.options["oversample"])
        if v.index == "diskann" and v.name in index:
            held = index[v.name]
            covered = tuple(f[len("data/") :] for f in held["files"])
            return GraphKnn(**base, graph=self._graph(v), index=self.spark.read.parquet(f"{self.path}/{held['path']}"), covered=covered, width=v.options.get("search_list_size_search", v.options["search_list_size"]))
        return Knn(**base)

    # --- indexes

    def _ivf(self, index: dict) -> IvfIndex | None:
        v = self._cells
        return IvfIndex.from_json(index[v.name]["ivf"]) if v and v.name in index else None

    def _graph(self, v: VectorColumn) -> GraphIndex:
        o = v.options
        return GraphIndex(v.name, self.spec.key, v.metric, o["n_neighbors"], o["search_list_size"], quantizer=o["neighbor_quantizer"], insert_width=o.get("search_list_size_insert"), buffer_threshold=o["buffer_threshold"])

    def build_index(self, column: str | None = None) -> None:
        """ivf: trains the centroids and stores every row by its cell.  diskann: builds the graph of all rows.  (rescore
        codes are written with the rows; flat columns have none.)"""
        v = self.spec.vector(column)
        base, files, index = self._state()
        if v is self._cells:
            o = v.options
            ivf = IvfIndex.train(self._read(files), o["nlist"] or 128, v.name, self.spec.key, v.metric, min(o["nprobe"], o["nlist"] or 128))
            self._reassigned(base, files, index, ivf)
        elif v.index == "diskann":
            graph = self._graph(v)
            self._keep_graph(base, files, index, v, graph.build(self._read(files).select(self.spec.key, v.name)))

    def _reassigned(self, base: int, files: list[str], index: dict, ivf: IvfIndex) -> None:
        index = index | {self._cells.name: {"ivf": ivf.to_json()}}
        self._rewrite(base, files, index, files, self._read(files).select(*self.spec.schema().names))

    def _trained(self) -> tuple[int, list[str], dict, IvfIndex]:
        base, files, index = self._state()
        if (ivf := self._ivf(index)) is None:
            raise VectorError("the index has no centroids yet")
        return base, files, index, ivf

    def assign_vectors(self) -> None:
        """ivf: gives the rows that wait their cells; only their files are rewritten."""
        base, files, index, _ = self._trained()
        waiting = [f for f in files if f"/_cell={UNASSIGNED}/" in f]
        if waiting:
            self._rewrite(base, files, index, waiting, self._read(waiting).select(*self.spec.schema().names))

    def set_centroid(self, i: int, vector: list[float]) -> None:
        """ivf: moves a centroid, and assigns every row anew."""
        base, files, index, ivf = self._trained()
        ivf.set_centroid(i, vector)
        self._reassigned(base, files, index, ivf)

    def clear_centroids(self) -> None:
        """ivf: untrained again; searches are exact until build_index()."""
        base, files, index, _ = self._trained()
        self._commit(base, files, {k: x for k, x in index.items() if k != self._cells.name})

    def set_nprobe(self, n: int) -> None:
        base, files, index, ivf = self._trained()
        self._commit(base, files, index | {self._cells.name: {"ivf": replace(ivf, nprobe=n).to_json()}})

    def _keep_graph(self, base: int, files: list[str], index: dict, v: VectorColumn, made: DataFrame) -> None:
        path = f"index/{v.name}-{uuid.uuid4().hex}"
        made.write.parquet(f"{self.path}/{path}")
        self._commit(base, files, index | {v.name: {"path": path, "files": files}})

    def _flush(self, v: VectorColumn) -> None:
        """diskann: once buffer_threshold rows wait, they are put into the graph, and rows that are gone are taken out."""
        base, files, index = self._state()
        held = index[v.name]
        known = set(held["files"])
        new, old = [f for f in files if f not in known], [f for f in files if f in known]
        graph, key = self._graph(v), self.spec.key
        buffer = self._read(new).select(key, v.name)
        stored = self.spark.read.parquet(f"{self.path}/{held['path']}")
        if buffer.limit(graph.buffer_threshold).count() == graph.buffer_threshold:
            gone = stored.select(key).join(self._read(old).select(key), key, "left_anti")
            kept = stored if gone.isEmpty() else graph.delete(stored, gone)
            self._keep_graph(base, files, index, v, graph.insert(kept, buffer))

    # --- the table as a whole

    def vacuum(self) -> None:
        """Drops what the current version does not name."""
        n, files, index = self._state()
        used = set(files)
        for folder in self.files.names("data"):
            own = self.files.parquet(f"data/{folder}")
            for f in own:
                if f not in used:
                    self.files.delete(f)
            if not used & set(own):
                self.files.delete(f"data/{folder}")
        graphs = {x["path"] for x in index.values() if "path" in x}
        for name in self.files.names("index"):
            if f"index/{name}" not in graphs:
                self.files.delete(f"index/{name}")
        for name in self.files.names("_log"):
            if name != f"{n}.json":
                self.files.delete(f"_log/{name}")

    def rename(self, path: str) -> VecTable:
        self.files.rename(path)
        return VecTable.open(self.spark, path)

    def drop(self) -> None:
        self.files.delete("")
