"""Most similar vectors for every vector: inverted file with product-quantised residuals.

Coarse centroids split the unit vectors of a model into lists, four times the
square root of their number whatever that is: bins are trained first, the lists
of each bin then by a task of its own.  Residuals are stored as product-quantiser
codes.  A query visits its nearest lists, ranks their codes by asymmetric
distance tables, and the best are ranked again by their exact cosine.  How many
lists it visits follows from exact neighbours of a sample of queries.  Lists of
one bin are searched together in units of bounded size, so that a query's vector
travels once per unit and not once per list, and a hot topic is spread over many
tasks.  Exact copies of a vector form one class that is searched once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.operators.skew import found_hot, hot_keys, salted_join
from codeloom.sources.workspace import Workspace

DIMENSION = 64
SUBSPACES = 16
CODES = 256
#: Vectors per model that bins and codebooks are trained on (about; chosen by hash of the id), and per list.
TRAIN_ROWS, ROWS_PER_LIST = 20_000, 32
LIST_FACTOR, LISTS_PER_BIN = 4.0, 64
#: Queries per model whose exact neighbours are found to set the number of lists visited, and the share of these
#: neighbours that must lie in lists visited.
CALIBRATION, RECALL = 256, 0.95
RERANK = 64
#: Members of a unit; queries come to it in chunks of twice as many.
BLOCK = 32_768
_CELLS = 4_000_000  # scores held at once


@dataclass
class Index:
    centroids: np.ndarray  # lists x dimension
    bin_of: np.ndarray  # of each list
    codebooks: np.ndarray = field(default_factory=lambda: np.zeros((SUBSPACES, 1, DIMENSION // SUBSPACES), np.float32))
    probes: int = 1
    unit_of: np.ndarray | None = None  # of each list
    blocks: np.ndarray | None = None  # of each unit
    chunks: np.ndarray | None = None

    def list_order(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest lists of each row, nearest first."""
        near = x @ self.centroids.T - 0.5 * (self.centroids**2).sum(1)
        n = min(n, near.shape[1])
        top = np.argpartition(-near, n - 1, axis=1)[:, :n] if n < near.shape[1] else np.tile(np.arange(n), (len(x), 1))
        order = np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable")
        return np.take_along_axis(top, order, 1)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        r = x - self.centroids[lists]
        codes = np.empty((len(x), len(self.codebooks)), dtype=np.uint8)
        width = self.codebooks.shape[2]
        for s, book in enumerate(self.codebooks):
            part = r[:, s * width : (s + 1) * width]
            codes[:, s] = (part @ book.T - 0.5 * (book**2).sum(1)).argmax(1)
        return codes

    def offsets(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What the squared distance to a coded member holds whatever the query."""
        width = self.codebooks.shape[2]
        y = self.centroids[lists].copy()
        for s, book in enumerate(self.codebooks):
            y[:, s * width : (s + 1) * width] += book[codes[:, s]]
        return (y**2).sum(1)

    def distances(self, queries: np.ndarray, lists: np.ndarray, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Asymmetric squared distances of exact unit queries to coded members, from a table per query."""
        width = self.codebooks.shape[2]
        which, at = np.unique(lists, return_inverse=True)
        # Members by queries, so that a code's row of the table is copied whole.
        dot = np.take(self.centroids[which] @ queries.T, at, axis=0)
        for s, book in enumerate(self.codebooks):
            dot += np.take(book @ queries[:, s * width : (s + 1) * width].T, codes[:, s], axis=0)
        return 1 + offsets - 2 * np.ascontiguousarray(dot.T)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        total, count = np.zeros_like(centres), np.zeros(len(centres))
        half = 0.5 * (centres**2).sum(1)
        for at in range(0, len(x), 2048):
            part = x[at : at + 2048]
            near = (part @ centres.T - half).argmax(1)
            np.add.at(total, near, part)
            count += np.bincount(near, minlength=len(centres))
        some = count > 0
        centres[some] = total[some] / count[some, None]
    return centres


def _vectors(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float32).reshape(len(column), DIMENSION) if len(column) else np.empty((0, DIMENSION), np.float32)


def _unit(x: np.ndarray, kind: type = np.float32) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(kind)


def list_count(n: int) -> int:
    """Lists for ``n`` vectors."""
    return max(1, min(int(LIST_FACTOR * np.sqrt(n)), n // 4))


def _train_bins(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("vec_id")
    bins = -(-list_count(int(pdf["n"].iloc[0])) // LISTS_PER_BIN)
    return pd.DataFrame({"model_id": [pdf["model_id"].iloc[0]], "bins": [kmeans(_unit(_vectors(pdf["v"])), bins).tobytes()]})


def _nearest_bin(bins: dict[str, np.ndarray], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for model, part in pdf.groupby("model_id", sort=False):
            c = bins[model]
            out = part.copy()
            out["bin"] = (_unit(_vectors(part["v"])) @ c.T - 0.5 * (c**2).sum(1)).argmax(1).astype(np.int32)
            yield out


def _train_lists(pdf: pd.DataFrame) -> pd.DataFrame:
    """Lists of one bin, as many as its share of the sample."""
    pdf = pdf.sort_values("vec_id")
    lists = max(1, round(list_count(int(pdf["n"].iloc[0])) * len(pdf) / pdf["sampled"].iloc[0]))
    return pd.DataFrame({"model_id": [pdf["model_id"].iloc[0]], "bin": [pdf["bin"].iloc[0]], "lists": [kmeans(_unit(_vectors(pdf["v"])), lists).tobytes()]})


def _train_codebooks(indexes: dict[str, Index]):
    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        index, x = indexes[pdf["model_id"].iloc[0]], _unit(_vectors(pdf["v"]))
        r = x - index.centroids[np.concatenate([index.list_order(x[a : a + 2048], 1)[:, 0] for a in range(0, len(x), 2048)])]
        width = DIMENSION // SUBSPACES
        books = np.stack([kmeans(r[:, s * width : (s + 1) * width], CODES, rounds=6) for s in range(SUBSPACES)])
        return pd.DataFrame({"model_id": [pdf["model_id"].iloc[0]], "codebooks": [books.astype(np.float32).tobytes()]})

    return train


def _exact_ranks(indexes: dict[str, Index], queries: dict[str, tuple[np.ndarray, np.ndarray]], k: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(model_id, query, cosine, place): a batch's ``k`` best of each sampled query, and the place of their list among
    those nearest to the query."""
    places = {}
    for model, (_, q) in queries.items():
        order = indexes[model].list_order(q, len(indexes[model].centroids))
        places[model] = np.argsort(order, axis=1)
    for pdf in batches:
        for model, part in pdf.groupby("model_id", sort=False):
            if model not in queries:
                continue
            ids, q = queries[model]
            x = _unit(_vectors(part["v"]))
            cosine = q @ x.T
            cosine[ids[:, None] == part["vec_id"].to_numpy()] = -2
            best = np.argsort(-cosine, axis=1)[:, :k]
            own = indexes[model].list_order(x, 1)[:, 0]
            out = pd.DataFrame({"model_id": model, "query": np.repeat(ids, best.shape[1]), "cosine": np.take_along_axis(cosine, best, 1).ravel().astype(float)})
            out["place"] = np.take_along_axis(places[model], own[best], 1).ravel().astype(np.int32)
            yield out[out["cosine"] > -1.5]


def _place(indexes: dict[str, Index], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The lists that each vector visits, nearest (its own, with its code) first."""
    for pdf in batches:
        for model, part in pdf.groupby("model_id", sort=False):
            x, index = _unit(_vectors(part["v"])), indexes[model]
            visits = index.list_order(x, index.probes)
            codes = index.encode(x, visits[:, 0])
            yield pd.DataFrame(
                {"model_id": model, "vec_id": part["vec_id"].to_numpy(), "v": part["v"].to_numpy(), "lists": list(visits.astype(np.int32)), "code": [c.tobytes() for c in codes]}
            )


def _visited(index: Index, lists: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(row, unit) of the units that rows of lists visit, each once."""
    units = np.sort(index.unit_of[np.stack(lists.to_numpy())], axis=1)
    new = np.ones(units.shape, dtype=bool)
    new[:, 1:] = units[:, 1:] != units[:, :-1]
    row, column = np.nonzero(new)
    return row, units[row, column]


def _count_visits(indexes: dict[str, Index], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for model, part in pdf.groupby("model_id", sort=False):
            units, n = np.unique(_visited(indexes[model], part["lists"])[1], return_counts=True)
            yield pd.DataFrame({"model_id": model, "unit": units.astype(np.int32), "n": n})


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows repeated ``n`` times each, and the number of the copy."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def _route(indexes: dict[str, Index], members: bool, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Members to their unit's block, once for each chunk of queries; queries to a chunk of each unit they visit, once
    for each block."""
    for pdf in batches:
        for model, part in pdf.groupby("model_id", sort=False):
            index, ids = indexes[model], part["vec_id"].to_numpy()
            mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
            if members:
                row = np.arange(len(part))
                unit = index.unit_of[np.array([x[0] for x in part["lists"]])]
                mine, other = index.blocks, index.chunks
            else:
                row, unit = _visited(index, part["lists"])
                mine, other = index.chunks, index.blocks
            copy, there = _spread(other[unit])
            row, unit = row[copy], unit[copy]
            here = (mixed[row] % mine[unit].astype(np.uint64)).astype(np.int32)
            out = pd.DataFrame({"model_id": model, "unit": unit.astype(np.int32), "block": here if members else there.astype(np.int32), "chunk": there.astype(np.int32) if members else here, "vec_id": ids[row], "v": part["v"].to_numpy()[row]})
            if members:
                out["list"], out["code"] = np.array([x[0] for x in part["lists"]], dtype=np.int32)[row], part["code"].to_numpy()[row]
            else:
                out["lists"] = part["lists"].to_numpy()[row]
            yield out


def _search(indexes: dict[str, Index], k: int, rerank: int, floor: float):
    def search(key: tuple, members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query": pd.Series(dtype="int64"), "found": pd.Series(dtype="int64"), "cosine": pd.Series(dtype=float)})]
        if members.empty or queries.empty:
            return found[0]
        index = indexes[key[0]]
        members = members.sort_values(["list", "vec_id"])
        ids, lists = members["vec_id"].to_numpy(), members["list"].to_numpy()
        y = _unit(_vectors(members["v"]), np.float64)
        codes = np.frombuffer(b"".join(members["code"]), np.uint8).reshape(len(ids), SUBSPACES)
        offsets = index.offsets(lists, codes)
        own, starts = np.unique(lists, return_index=True)
        ends = np.r_[starts[1:], len(lists)]
        visits = np.stack(queries["lists"].to_numpy())
        # Queries of one list visit nearly the same lists and are searched together.
        order = np.lexsort((queries["vec_id"].to_numpy(), visits[:, 0]))
        visits, asked = visits[order], queries["vec_id"].to_numpy()[order]
        q = _unit(_vectors(queries["v"].iloc[order]), np.float64)
        first = np.flatnonzero(np.r_[True, visits[1:, 0] != visits[:-1, 0]])
        for lo, hi in zip(first, np.r_[first[1:], len(asked)]):
            here = np.flatnonzero(np.isin(own, visits[lo:hi]))
            if not len(here):
                continue
            some = np.concatenate([np.arange(starts[i], ends[i]) for i in here])
            step = max(1, _CELLS // len(some))
            for a in range(lo, hi, step):
                b = min(a + step, hi)
                score = index.distances(q[a:b].astype(np.float32), lists[some], codes[some], offsets[some])
                visited = (visits[a:b, :, None] == own[here]).any(1)
                score[~np.repeat(visited, ends[here] - starts[here], axis=1)] = np.inf
                score[asked[a:b, None] == ids[some]] = np.inf
                n = min(rerank, len(some))
                near = np.argpartition(score, n - 1, axis=1)[:, :n] if n < len(some) else np.tile(np.arange(n), (b - a, 1))
                exact = np.einsum("qd,qnd->qn", q[a:b], y[some[near]])
                exact[np.isinf(np.take_along_axis(score, near, 1))] = -2
                best = np.lexsort((ids[some[near]], -exact), axis=1)[:, :k]
                cosine, hit = np.take_along_axis(exact, best, 1), ids[some[np.take_along_axis(near, best, 1)]]
                ok = cosine >= max(floor - 1e-9, -1.5)
                found.append(pd.DataFrame({"query": np.broadcast_to(asked[a:b, None], ok.shape)[ok], "found": hit[ok], "cosine": cosine[ok]}))
        return pd.concat(found, ignore_index=True)

    return search


def usable_vectors(vectors: DataFrame, work: Workspace) -> DataFrame:
    """(vec_id, model_id, v): vectors of 64 finite numbers that are not all zero, as bytes.

    Rows without vec_id or model_id are left out; of several rows of one vec_id
    the smallest model and, by bytes, vector hold.
    """
    inf = float("inf")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (x < F.lit(inf)) & (x > F.lit(-inf))) & F.exists("vector", lambda x: x != 0)
    rows = vectors.where((F.size("vector") == DIMENSION) & fine & F.col("vec_id").isNotNull() & F.col("model_id").isNotNull())

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[["vec_id", "model_id"]].copy()
            out["v"] = [np.asarray(v, np.float32).tobytes() for v in pdf["vector"]]
            yield out

    rows = work.write(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "model_id", F.col("vector").cast("array<float>").alias("vector")).mapInPandas(pack, "vec_id long, model_id string, v binary"), "vectors")
    # Only ids are shuffled to look for repeated ones.
    repeated = work.write(rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vec_id"), "repeated")
    if repeated.isEmpty():
        return rows
    once = rows.join(repeated, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("model_id", "v")).alias("row")).select("vec_id", "row.model_id", "row.v")
    return rows.join(repeated, "vec_id", "left_anti").unionAll(once)


def _trained(reps: DataFrame, sizes: DataFrame, k: int, train_rows: int, calibration: int, recall: float) -> dict[str, Index]:
    """Index of each model: bins, their lists, codebooks and the number of lists to visit."""
    model = reps.join(sizes, "model_id")
    lists = F.greatest(F.lit(1.0), F.least(LIST_FACTOR * F.sqrt("n"), F.col("n") / 4))

    def sample(rows) -> DataFrame:
        """About ``rows`` of each model, by hash."""
        return model.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < F.greatest(F.lit(1), F.ceil(rows / F.col("n") * (1 << 30))))

    for_bins = F.greatest(F.lit(float(train_rows)), lists / LISTS_PER_BIN * ROWS_PER_LIST)
    bins = {r["model_id"]: np.frombuffer(r["bins"], np.float32).reshape(-1, DIMENSION) for r in sample(for_bins).groupBy("model_id").applyInPandas(_train_bins, "model_id string, bins binary").collect()}
    rows = sample(F.greatest(F.lit(float(train_rows)), lists * ROWS_PER_LIST))
    sampled = rows.groupBy("model_id").agg(F.count(F.lit(1)).alias("sampled"))
    binned = rows.join(sampled, "model_id").mapInPandas(lambda it: _nearest_bin(bins, it), "model_id string, vec_id long, v binary, n long, sampled long, bin int")
    by_model: dict[str, list] = {}
    for r in binned.groupBy("model_id", "bin").applyInPandas(_train_lists, "model_id string, bin int, lists binary").collect():
        by_model.setdefault(r["model_id"], []).append((r["bin"], np.frombuffer(r["lists"], np.float32).reshape(-1, DIMENSION)))
    indexes = {}
    for name, parts in by_model.items():
        parts.sort(key=lambda x: x[0])
        indexes[name] = Index(np.concatenate([c for _, c in parts]), np.repeat([b for b, _ in parts], [len(c) for _, c in parts]))
    books = sample(F.lit(float(train_rows))).groupBy("model_id").applyInPandas(_train_codebooks(indexes), "model_id string, codebooks binary").collect()
    for r in books:
        indexes[r["model_id"]].codebooks = np.frombuffer(r["codebooks"], np.float32).reshape(SUBSPACES, -1, DIMENSION // SUBSPACES)

    asked = sample(F.lit(float(calibration))).select("model_id", "vec_id", "v").orderBy("vec_id").toPandas()
    queries = {name: (part["vec_id"].to_numpy(), _unit(_vectors(part["v"]))) for name, part in asked.groupby("model_id")}
    ranks = reps.mapInPandas(lambda it: _exact_ranks(indexes, queries, k, it), "model_id string, query long, cosine double, place int")
    order = W.partitionBy("model_id", "query").orderBy(F.desc("cosine"), "place")
    ranks = ranks.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).groupBy("model_id", "place").agg(F.count(F.lit(1)).alias("n")).toPandas()
    for name, part in ranks.groupby("model_id"):
        part = part.sort_values("place")
        reached = part["n"].cumsum().to_numpy() >= recall * part["n"].sum()
        indexes[name].probes = int(part["place"].to_numpy()[reached.argmax()]) + 1
    return indexes


def _cut(index: Index, sizes: np.ndarray, block: int) -> None:
    """Units of lists: lists of one bin up to ``block`` members together, larger lists alone in several blocks."""
    index.unit_of, members = np.zeros(len(sizes), dtype=np.int64), []
    for i in range(len(sizes)):
        if i == 0 or index.bin_of[i] != index.bin_of[i - 1] or members[-1] + sizes[i] > block:
            members.append(0)
        members[-1] += int(sizes[i])
        index.unit_of[i] = len(members) - 1
    index.blocks = np.maximum(1, -(-np.array(members) // block))


def nearest_neighbours(
    vectors: DataFrame, k: int = 5, *, recall: float = RECALL, rerank: int = RERANK, train_rows: int = TRAIN_ROWS, calibration: int = CALIBRATION, block: int = BLOCK, floor: float = -1.0
) -> DataFrame:
    """(vec_id, neighbour, cosine, rank): the ``k`` most similar usable vectors of the same model.

    ``vectors``: vec_id, model_id, vector; see :func:`usable_vectors`.  Ties go to
    the smaller vec_id; copies of a vector are neighbours of each other.  A model
    with one vector gives no rows.  Bins and codebooks are trained on about
    ``train_rows`` vectors per model, lists on about 32 each; every vector is
    indexed and every vector is a query.  The number of lists visited is the least
    that holds ``recall`` of the exact neighbours of about ``calibration`` vectors
    per model.  Neighbours of a cosine below ``floor`` are left out.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "neighbours")
    rows = usable_vectors(vectors, work)
    # Classes of exact copies; -0.0 and 0.0 differ in bytes and are merely near.
    same = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit("h2"), "v").alias("h2")]
    keyed = rows.select("vec_id", "model_id", *same)
    by_class = ["model_id", "h1", "h2"]
    classes = work.write(keyed.groupBy(*by_class).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size")), "classes")
    copied = classes.where("size > 1")
    single = classes.where("size = 1").select(F.col("rep").alias("vec_id"), "rep", "size")
    copies_hot = found_hot(work.write(hot_keys(keyed.join(copied.select(*by_class), by_class), by_class), "hot"))
    members = salted_join(keyed, copied, by_class, copies_hot, "vec_id").select("vec_id", "rep", "size")
    members = work.write(members.unionAll(single), "members")

    # Read by every step of the training, so joined once; without copies the vectors are the classes.
    others = work.write(members.where("vec_id <> rep").select("vec_id"), "others")
    reps = rows if others.isEmpty() else work.write(rows.join(others, "vec_id", "left_anti"), "reps")
    sizes = work.write(reps.groupBy("model_id").agg(F.count(F.lit(1)).alias("n")), "sizes")
    indexes = _trained(reps, sizes, k, train_rows, calibration, recall)

    placed = work.write(reps.mapInPandas(lambda it: _place(indexes, it), "model_id string, vec_id long, v binary, lists array<int>, code binary"), "placed")
    # Lists are few (4 sqrt(n)), and so are units.
    counted = placed.groupBy("model_id", F.col("lists")[0].alias("list")).agg(F.count(F.lit(1)).alias("n")).toPandas()
    for name, index in indexes.items():
        own = counted[counted["model_id"] == name]
        _cut(index, np.bincount(own["list"], own["n"], len(index.centroids)).astype(np.int64), block)
    visits = placed.select("model_id", "lists").mapInPandas(lambda it: _count_visits(indexes, it), "model_id string, unit int, n long").groupBy("model_id", "unit").agg(F.sum("n").alias("n")).toPandas()
    for name, index in indexes.items():
        own = visits[visits["model_id"] == name]
        index.chunks = np.maximum(1, -(-np.bincount(own["unit"], own["n"], len(index.blocks)).astype(np.int64) // (2 * block)))

    cell = ["model_id", "unit", "block", "chunk"]
    left = placed.mapInPandas(lambda it: _route(indexes, True, it), "model_id string, unit int, block int, chunk int, vec_id long, v binary, list int, code binary")
    right = placed.select("model_id", "vec_id", "v", "lists").mapInPandas(lambda it: _route(indexes, False, it), "model_id string, unit int, block int, chunk int, vec_id long, v binary, lists array<int>")
    hits = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(_search(indexes, k, rerank, floor), "query long, found long, cosine double")
    by_query = W.partitionBy("query").orderBy(F.desc("cosine"), "found")
    best = work.write(hits.withColumn("r", F.row_number().over(by_query)).where(F.col("r") <= k).drop("r"), "best")

    # Copies: a class offers its k + 1 smallest ids, and they come before any other class.
    offered = members.withColumn("r", F.row_number().over(W.partitionBy("rep").orderBy("vec_id"))).where(F.col("r") <= k + 1).select("rep", F.col("vec_id").alias("neighbour"))
    offered = work.write(offered, "offered")
    hot = found_hot(work.write(hot_keys(members, ["rep"]), "hot_classes"))
    inner = salted_join(members.where("size > 1"), offered, ["rep"], hot, "vec_id").where("vec_id <> neighbour").select("vec_id", "neighbour", F.lit(1.0).alias("cosine"), F.lit(0).alias("level"))
    outer = members.where(F.col("size") <= k).join(best.withColumnRenamed("query", "rep"), "rep").select("vec_id", F.col("found").alias("rep"), "cosine")
    hot_reps = found_hot(work.write(hot_keys(outer, ["rep"]), "hot_found"))
    outer = salted_join(outer, offered, ["rep"], hot_reps, "vec_id").select("vec_id", "neighbour", "cosine", F.lit(1).alias("level"))
    rank = F.row_number().over(W.partitionBy("vec_id").orderBy("level", F.desc("cosine"), "neighbour"))
    return inner.unionAll(outer).withColumn("rank", rank).where(F.col("rank") <= k).select("vec_id", "neighbour", "cosine", "rank")


def similar_pairs(neighbours: DataFrame, floor: float = 0.9) -> DataFrame:
    """(vec_a, vec_b), smaller first, of neighbours with at least ``floor`` cosine similarity."""
    pairs = neighbours.where(F.col("cosine") >= floor).select(F.least("vec_id", "neighbour").alias("vec_a"), F.greatest("vec_id", "neighbour").alias("vec_b"))
    return pairs.distinct()
