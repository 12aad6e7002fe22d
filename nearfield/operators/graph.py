"""Proximity-graph index: one pruned neighbour graph a shard, beam search in every shard, one merged top k.

A single graph over all rows would need sequential inserts; shards of bounded size build in parallel and are searched in
parallel, and losing an executor costs the rebuild of its shards only.  An index is a table (shard, place, id, vector, links,
medoid): the place is a row's number in its shard, links are places, and searches begin at the medoid, the row nearest the
shard's mean.  With a quantizer the beam runs on codes (sign bits or int8), and what it holds is measured exactly.

Ids never enter the kernels, which know places only; they are joined to results by shard and place.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.errors import VectorError
from nearfield.functions.scalar import STEP
from nearfield.plans import kernels
from nearfield.plans.knn import Knn, check_k

ALPHA = 1.2
NEIGHBOURS_MAX = 256
QUANTIZERS = ("binary", "int8")
#: Queries that meet a shard at a time.
QUERY_ROWS = 20_000


def prune(p: int, candidates: np.ndarray, x: np.ndarray, degree: int, metric: str = "l2", alpha: float = ALPHA) -> np.ndarray:
    """The robust neighbours of point p: nearest first, without those that an earlier one covers
    (alpha * its distance <= the distance from p)."""
    candidates = np.unique(candidates[candidates != p])
    if not len(candidates):
        return candidates
    d = kernels.pairwise(x[candidates], x[p : p + 1], metric)[0]
    order = np.lexsort((candidates, d))
    candidates, d = candidates[order], d[order]
    between = kernels.about(x[candidates], x[candidates], metric)[0]
    alive, kept = np.ones(len(candidates), bool), []
    for i in range(len(candidates)):
        if alive[i]:
            kept.append(candidates[i])
            if len(kept) == degree:
                break
            alive[i + 1 :] &= alpha * between[i, i + 1 :] > d[i + 1 :]
    return np.array(kept)


def encode(x: np.ndarray, quantizer: str | None) -> np.ndarray:
    """Codes of vectors: sign bits, int8 of [-1, 1], or the vectors themselves."""
    if quantizer == "binary":
        return np.packbits(x > 0, axis=1, bitorder="little")
    if quantizer == "int8":
        return np.clip(np.trunc((x + 1.0) / STEP - 128.0), -128, 127).astype("i1")
    return x


def beam(q: np.ndarray, x: np.ndarray, links: list[np.ndarray], start: int, width: int, metric: str, dead: np.ndarray | None = None, codes: np.ndarray | None = None, code: np.ndarray | None = None) -> list[tuple[float, int]]:
    """(distance, place) of the best points, nearest first: expands the nearest open point until the ``width`` best are all
    expanded.  Dead points are passed through and never among the best.  With codes the search compares these with the
    query's code, and the best are measured exactly at the end."""
    far, target = (x, q) if codes is None else (codes, code)
    by = metric if codes is None or codes.dtype != np.uint8 else "hamming"

    def away(some: np.ndarray) -> np.ndarray:
        d = kernels.exact(far, target[None], np.zeros(len(some), "i8"), some, by)
        return np.where(np.isnan(d), np.inf, d)  # a zero vector under cosine

    first = float(away(np.array([start]))[0])
    seen, open_ = np.zeros(len(x), bool), [(first, start)]
    seen[start] = True
    best: list[tuple[float, int]] = []  # a heap of the width best alive, worst first
    if dead is None or not dead[start]:
        best.append((-first, -start))
    while open_:
        d, p = heapq.heappop(open_)
        if len(best) >= width and d > -best[0][0]:
            break
        new = links[p][~seen[links[p]]]
        if len(new):
            seen[new] = True
            for dist, j in zip(away(new).tolist(), new.tolist(), strict=True):
                if len(best) < width or dist <= -best[0][0]:
                    heapq.heappush(open_, (dist, j))
                    if dead is None or not dead[j]:
                        heapq.heappush(best, (-dist, -j))
                        if len(best) > width:
                            heapq.heappop(best)
    places = np.array([-j for _, j in best], "i8")
    d = kernels.exact(x, q[None], np.zeros(len(places), "i8"), places, metric)
    return sorted((a, b) for a, b in zip(d.tolist(), places.tolist()) if a == a)


def medoid(x: np.ndarray, metric: str) -> int:
    """The place nearest the mean."""
    d = kernels.pairwise(x, x.mean(0, keepdims=True), metric)[0]
    return int(np.where(np.isnan(d), np.inf, d).argmin())


def build_links(x: np.ndarray, degree: int = 72, width: int = 128, metric: str = "l2", seed: int = 1) -> list[np.ndarray]:
    """Neighbour lists of a shard: each point's candidates are its ``width`` nearest, from matrix products in blocks, and
    half as many random ones (long links); they are pruned, linked back, and pruned again where a list is full."""
    n, rng = len(x), np.random.default_rng(seed)
    links: list[np.ndarray] = []
    step = max(1, kernels.STEP_BYTES // (8 * n))
    for i in range(0, n, step):
        d = kernels.about(x, x[i : i + step], metric)[0]
        d = np.where(np.isnan(d), np.inf, d)
        near = np.argpartition(d, min(width, n - 1), axis=1)[:, : width + 1]
        for j, own in enumerate(near):
            links.append(prune(i + j, np.concatenate([own, rng.integers(0, n, width // 2)]), x, degree, metric))
    return connected(linked_back(links, range(n), x, degree, metric), x, metric)


def linked_back(links: list[np.ndarray], new, x: np.ndarray, degree: int, metric: str) -> list[np.ndarray]:
    """links with those of the new points reversed; lists over the degree are pruned."""
    back: dict[int, list[int]] = {}
    for p in new:
        for j in links[p].tolist():
            back.setdefault(j, []).append(p)
    for j, of in back.items():
        grown = np.union1d(links[j], np.array(of, "i8"))
        links[j] = grown if len(grown) <= degree else prune(j, grown, x, degree, metric)
    return links


def connected(links: list[np.ndarray], x: np.ndarray, metric: str) -> list[np.ndarray]:
    """links, so that every point can be reached from the medoid: one that cannot is linked from its nearest that can."""
    seen, todo = np.zeros(len(x), bool), [medoid(x, metric)]
    seen[todo[0]] = True
    while True:
        while todo:
            new = links[todo.pop()]
            new = new[~seen[new]]
            seen[new] = True
            todo += new.tolist()
        lost = np.flatnonzero(~seen)
        if not len(lost):
            return links
        p, fine = int(lost[0]), np.flatnonzero(seen)
        d = kernels.pairwise(x[fine], x[p : p + 1], metric)[0]
        at = int(fine[np.where(np.isnan(d), np.inf, d).argmin()])
        links[at] = np.append(links[at], p)
        seen[p], todo = True, [p]


class GraphIndex:
    """build() gives an index to store, and search() reads it.  Rows added since wait in a buffer table that searches scan
    exactly; insert() puts them into the graph, flushed() does so once there are enough, delete() takes rows out and repairs
    the lists that named them, and compact() builds anew."""

    def __init__(self, column: str = "embedding", id_col: str = "vec_id", metric: str = "l2", degree: int = 72, width: int = 128, shard_rows: int = 4096, quantizer: str | None = None, insert_width: int | None = None, buffer_threshold: int = 0):
        if degree % 8 or not 0 < degree <= NEIGHBOURS_MAX:
            raise VectorError(f"n_neighbors must be divisible by 8 and at most {NEIGHBOURS_MAX}")
        if quantizer not in (None, *QUANTIZERS):
            raise VectorError(f"unknown neighbor_quantizer {quantizer}")
        self.column, self.id_col, self.metric, self.degree, self.width, self.shard_rows = column, id_col, metric, degree, width, shard_rows
        self.quantizer, self.insert_width, self.buffer_threshold = quantizer, insert_width or width, buffer_threshold

    def _shard(self, n: int) -> Column:
        return F.pmod(F.xxhash64(self.id_col), F.lit(n))

    def build(self, df: DataFrame) -> DataFrame:
        """(shard, place, id, vector, links, medoid) of the rows whose vector is not NULL."""
        rows = df.filter(F.col(self.column).isNotNull())
        shards = max(1, -(-rows.count() // self.shard_rows))  # by a hash: even whatever the ids are
        placed = rows.select(self._shard(shards).alias("shard"), self.id_col, self.column)
        own = Window.partitionBy("shard").orderBy(self.id_col, F.xxhash64(self.column))
        return self._linked(placed.withColumn("place", F.row_number().over(own) - 1), lambda x, old, new: build_links(x, self.degree, self.insert_width, self.metric))

    def _linked(self, placed: DataFrame, make) -> DataFrame:
        """placed(shard, place, id, vector, and links where there are such) with new links and medoids."""
        column, metric = self.column, self.metric
        known = "links" in placed.columns

        def graph(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("place").reset_index(drop=True)
            x = np.stack(pdf[column].to_numpy()).astype("f8")
            old = [np.asarray(j, "i8") if j is not None else None for j in pdf["links"]] if known else []
            links = make(x, old, pdf["fresh"].to_numpy() if known else None)
            return pd.DataFrame({"shard": pdf["shard"], "place": pdf["place"], "links": [np.asarray(j, "i4") for j in links], "medoid": np.arange(len(pdf)) == medoid(x, metric)})

        wanted = placed.select("shard", "place", column, *(["links", "fresh"] if known else []))
        made = wanted.groupBy("shard").applyInPandas(graph, "shard bigint, place int, links array<int>, medoid boolean")
        return placed.select("shard", "place", self.id_col, column).join(made, ["shard", "place"])

    def insert(self, index: DataFrame, rows: DataFrame) -> DataFrame:
        """index with the rows in their shards' graphs: a beam search finds a new point's candidates, which are pruned and
        linked back.  Points that are there keep their places.  An index that grows well past shard_rows a shard is better
        compacted."""
        n = (index.agg(F.max("shard")).first()[0] or 0) + 1
        top = index.groupBy("shard").agg(F.max("place").alias("_top"))
        own = Window.partitionBy("shard").orderBy(self.id_col, F.xxhash64(self.column))
        new = rows.filter(F.col(self.column).isNotNull()).select(self._shard(n).alias("shard"), self.id_col, self.column).withColumn("_own", F.row_number().over(own)).join(top, "shard", "left")
        new = new.select("shard", (F.coalesce("_top", F.lit(-1)) + F.col("_own")).cast("int").alias("place"), self.id_col, self.column, F.lit(None).cast("array<int>").alias("links"), F.lit(True).alias("fresh"))
        degree, width, metric, quantizer = self.degree, self.insert_width, self.metric, self.quantizer

        def add(x: np.ndarray, links: list, fresh: np.ndarray) -> list[np.ndarray]:
            codes = encode(x, quantizer) if quantizer else None
            had = np.flatnonzero(~fresh)
            if not len(had):
                return build_links(x, degree, width, metric)
            start, links = int(had[medoid(x[had], metric)]), [j if j is not None else np.empty(0, "i8") for j in links]
            for p in np.flatnonzero(fresh).tolist():
                found = np.array([j for _, j in beam(x[p], x, links, start, width, metric, None, codes, None if codes is None else codes[p])], "i8")
                links[p] = prune(p, found, x, degree, metric)
                linked_back(links, [p], x, degree, metric)
            return connected(links, x, metric)

        return self._linked(index.select("shard", "place", self.id_col, self.column, "links", F.lit(False).alias("fresh")).unionByName(new), add)

    def flushed(self, index: DataFrame, buffer: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(index, buffer): the buffer's rows are in the graph, and it is empty, once there are buffer_threshold of them."""
        if buffer.limit(max(1, self.buffer_threshold)).count() < max(1, self.buffer_threshold):
            return index, buffer
        return self.insert(index, buffer), buffer.limit(0)

    def delete(self, index: DataFrame, ids: DataFrame) -> DataFrame:
        """index without the ids: a list that named one takes that one's neighbours as candidates in its place and is pruned;
        medoids that are gone are chosen anew."""
        gone = ids.select(F.col(ids.columns[0]).alias(self.id_col)).distinct().withColumn("_gone", F.lit(True))
        flagged = index.join(gone, self.id_col, "left").withColumn("dead", F.coalesce("_gone", F.lit(False)))
        column, degree, metric = self.column, self.degree, self.metric

        def repair(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("place").reset_index(drop=True)
            x, dead, links = np.stack(pdf[column].to_numpy()).astype("f8"), pdf["dead"].to_numpy(), [np.asarray(j, "i8") for j in pdf["links"]]
            alive = np.flatnonzero(~dead)
            if not len(alive):
                return pd.DataFrame({"shard": [], "was": [], "place": [], "links": [], "medoid": []}, dtype=object)
            number = np.cumsum(~dead) - 1
            out = []
            for p in alive.tolist():
                own, todo, seen = links[p][~dead[links[p]]], links[p][dead[links[p]]].tolist(), set(links[p].tolist())
                if todo:
                    more = []
                    while todo:  # through chains of deleted points
                        for j in links[todo.pop()].tolist():
                            if j not in seen:
                                seen.add(j)
                                (todo if dead[j] else more).append(j)
                    own = prune(p, np.concatenate([own, np.array(more, "i8")]).astype("i8"), x, degree, metric)
                out.append(number[own])
            kept = x[alive]
            out = connected(out, kept, metric)
            return pd.DataFrame({"shard": pdf["shard"].to_numpy()[alive], "was": pdf["place"].to_numpy()[alive], "place": np.arange(len(alive)), "links": [j.astype("i4") for j in out], "medoid": np.arange(len(alive)) == medoid(kept, metric)})

        made = flagged.select("shard", "place", column, "links", "dead").groupBy("shard").applyInPandas(repair, "shard bigint, was int, place int, links array<int>, medoid boolean")
        rows = index.select("shard", F.col("place").alias("was"), self.id_col, column)
        return rows.join(made, ["shard", "was"]).select("shard", "place", self.id_col, column, "links", "medoid")

    def set_medoid(self, index: DataFrame, id_value: object) -> DataFrame:
        """index whose searches of the shard that holds the id begin at its row."""
        found = index.filter(F.col(self.id_col) == F.lit(id_value)).select("shard", "place").first()
        if found is None:
            raise VectorError(f"no row with {self.id_col} {id_value}")
        return index.withColumn("medoid", F.when(F.col("shard") == found["shard"], F.col("place") == found["place"]).otherwise(F.col("medoid")))

    def search(self, index: DataFrame, queries: DataFrame, k: int, width: int | None = None, buffer: DataFrame | None = None, deleted: DataFrame | None = None, query_id: str = "query_id", query_col: str = "query") -> DataFrame:
        """(query_id, id, distance, rank) of each query, whose ids may have any type.  Deleted ids are passed through by the
        beam and never among its best, so that k others are found.  Queries meet the shards in blocks of QUERY_ROWS."""
        check_k(k)
        column, id_col, metric, wide, quantizer = self.column, self.id_col, self.metric, max(width or self.width, k, 1), self.quantizer
        asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_col).alias("query")).filter("query is not null")
        n = -(-asked.count() // QUERY_ROWS)
        # a query's key, the same however often it is computed; rows that repeat have equal keys and equal results
        asked = asked.select("query_id", F.xxhash64("query_id", "query").alias("_q"), F.col("query"))
        blocks = F.sequence(F.lit(0), F.lit(max(n, 1) - 1))
        gone = F.lit(False)
        rows = index
        if deleted is not None:
            rows = index.join(deleted.select(F.col(deleted.columns[0] if id_col not in deleted.columns else id_col).alias(id_col)).distinct().withColumn("_gone", F.lit(True)), id_col, "left")
            gone = F.coalesce("_gone", F.lit(False))
        shards = rows.select("shard", F.explode(blocks).alias("block"), "place", column, "links", "medoid", gone.alias("dead"))
        each = index.select("shard").distinct().crossJoin(asked.select("_q", "query").dropDuplicates(["_q"])).select(F.col("shard").alias("_s"), F.pmod("_q", F.lit(max(n, 1))).cast("int").alias("_b"), "_q", "query")

        def run(pdf: pd.DataFrame, qdf: pd.DataFrame) -> pd.DataFrame:
            if not len(pdf) or not len(qdf):
                return pd.DataFrame({"shard": [], "place": [], "_q": [], "distance": []}, dtype=object)
            pdf = pdf.sort_values("place")
            x, links, dead = np.stack(pdf[column].to_numpy()).astype("f8"), [np.asarray(j, "i8") for j in pdf["links"]], pdf["dead"].to_numpy()
            start, codes = int(np.flatnonzero(pdf["medoid"].to_numpy())[0]), encode(x, quantizer) if quantizer else None
            got = []
            for key, q in zip(qdf["_q"].tolist(), qdf["query"], strict=True):
                v = np.asarray(q, "f8")
                code = encode(v[None], quantizer)[0] if quantizer else None
                got += [(key, p, d) for d, p in beam(v, x, links, start, wide, metric, dead, codes, code)[:k]]
            return pd.DataFrame({"shard": pdf["shard"].iat[0], "place": [g[1] for g in got], "_q": [g[0] for g in got], "distance": [g[2] for g in got]})

        got = shards.groupBy("shard", "block").cogroup(each.groupBy("_s", "_b")).applyInPandas(run, "shard bigint, place int, _q bigint, distance double")
        found = got.join(index.select("shard", "place", id_col), ["shard", "place"]).join(asked.select("query_id", "_q"), "_q").select("query_id", id_col, "distance")
        if buffer is not None:
            waiting = buffer if deleted is None else buffer.join(deleted.select(F.col(deleted.columns[0] if id_col not in deleted.columns else id_col).alias(id_col)).distinct(), id_col, "left_anti")
            found = found.unionByName(Knn(waiting, column, id_col, "float32", metric).batch(queries, k, query_id, query_col).drop("rank"))
        w = Window.partitionBy("query_id").orderBy("distance", id_col)
        return found.dropDuplicates(["query_id", id_col]).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    def compact(self, index: DataFrame, buffer: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
        rows = index.select(self.id_col, self.column).unionByName(buffer.select(self.id_col, self.column))
        if deleted is not None:
            rows = rows.join(deleted.select(self.id_col).distinct(), self.id_col, "left_anti")
        return self.build(rows)
