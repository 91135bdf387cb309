"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Vectors are spread over shards by a hash of their id, so copies of one vector are spread too;
equal vectors inside a shard become one graph point with the smallest ids behind it.  A shard
is one row of a written table: ids, unit vectors, and per layer a flat array of neighbour
numbers.  Queries meet every shard, in blocks, and the shards' best are merged by score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from tabsight.llm.common import materialize, tables

NEIGHBOURS = 5
DEGREE = 16  # links per point in the upper layers, twice as many in the lowest
BREADTH = 64  # candidates kept while searching
SHARDS = 8  # at least, so that a small table still uses several tasks
SHARD_VECTORS = 100_000
QUERY_BLOCK = 4096
_INSERT = 256
_LEVEL_SHARE = 16  # one point in so many reaches the next layer


def search_layer(
    vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray, breadth: int
) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search for many queries at once: (points, similarities), best first, -1 where nothing was found."""
    q, n = len(queries), len(vectors)
    seen = np.zeros((q, n + 1), dtype=bool)
    seen[:, n] = True
    rows = np.arange(q)
    points = np.full((q, breadth), n)
    near = np.full((q, breadth), -np.inf, dtype=np.float32)
    done = np.ones((q, breadth), dtype=bool)
    points[:, 0] = entries
    near[:, 0] = np.einsum("qd,qd->q", queries, vectors[entries])
    done[:, 0] = False
    seen[rows, entries] = True
    active = rows
    while len(active):
        front = np.where(done[active], -np.inf, near[active])
        best = front.argmax(axis=1)
        going = front[np.arange(len(active)), best] > -np.inf
        active, best = active[going], best[going]
        if not len(active):
            break
        done[active, best] = True
        reached = links[points[active, best]]
        reached = np.where(reached < 0, n, reached)
        reached = np.where(seen[active[:, None], reached], n, reached)
        seen[active[:, None], reached] = True
        got = np.einsum("qd,qkd->qk", queries[active], vectors[np.minimum(reached, n - 1)])
        got = np.where(reached == n, -np.inf, got).astype(np.float32)
        all_near = np.concatenate([near[active], got], axis=1)
        all_points = np.concatenate([points[active], reached], axis=1)
        all_done = np.concatenate([done[active], got == -np.inf], axis=1)
        top = np.argpartition(-all_near, breadth - 1, axis=1)[:, :breadth]
        near[active] = np.take_along_axis(all_near, top, axis=1)
        points[active] = np.take_along_axis(all_points, top, axis=1)
        done[active] = np.take_along_axis(all_done, top, axis=1)
    order = np.argsort(-near, axis=1, kind="stable")
    near, points = np.take_along_axis(near, order, axis=1), np.take_along_axis(points, order, axis=1)
    return np.where(near == -np.inf, -1, points), near


def diverse(vectors: np.ndarray, candidates: np.ndarray, near: np.ndarray, keep: int) -> np.ndarray:
    """Up to ``keep`` of the candidates (best first) such that none is nearer to a kept one than to the point itself.

    Free places are filled with the best of the rest.
    """
    if not len(candidates):
        return candidates
    between = vectors[candidates] @ vectors[candidates].T
    kept: list[int] = []
    rest: list[int] = []
    for i in range(len(candidates)):
        if len(kept) == keep:
            break
        (rest if kept and between[i, kept].max() > near[i] else kept).append(i)
    return candidates[kept + rest[: keep - len(kept)]]


def build(vectors: np.ndarray, seed: int = 1) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(members, links) per layer, lowest first: point numbers, and flat neighbour numbers padded with -1.

    Points enter in batches: each batch is searched in the graph so far, and its points may
    also link with each other.  Links go both ways; a point with too many keeps a diverse set.
    """
    n = len(vectors)
    rng = np.random.default_rng(seed)
    level = np.minimum((-np.log(rng.random(n) + 1e-300) / np.log(_LEVEL_SHARE)).astype(int), 8)
    level[0] = max(int(level.max()), 0)  # the first point is the entry to every layer
    members, all_links = [], []
    entry_layers: list[tuple[np.ndarray, np.ndarray]] = []
    for layer in range(int(level.max()), -1, -1):
        own = np.flatnonzero(level >= layer)
        degree = 2 * DEGREE if layer == 0 else DEGREE
        local = vectors[own]
        links = np.full((len(own), degree), -1, dtype=np.int32)
        fill = np.zeros(len(own), dtype=np.int64)

        def connect(a: int, found: np.ndarray, near: np.ndarray, local=local, links=links, fill=fill, degree=degree) -> None:
            chosen = diverse(local, found, near, degree // 2)
            links[a, : len(chosen)] = chosen
            fill[a] = len(chosen)
            for b in chosen:
                if fill[b] < degree:
                    links[b, fill[b]] = a
                    fill[b] += 1
                else:
                    options = np.append(links[b], a)
                    sims = local[options] @ local[b]
                    order = np.argsort(-sims, kind="stable")
                    kept = diverse(local, options[order], sims[order], degree)
                    links[b, :] = -1
                    links[b, : len(kept)] = kept
                    fill[b] = len(kept)

        start = 1
        while start < len(own):
            stop = min(len(own), start + min(_INSERT, max(1, start)))
            batch = np.arange(start, stop)
            entries = descend(vectors, entry_layers, local[batch])
            entries = np.searchsorted(own, entries)  # members of upper layers are members here
            entries = np.where(entries < start, entries, 0)
            found, near = search_layer(local[:start], links[:start], local[batch], entries, BREADTH)
            among = local[batch] @ local[batch].T
            for i, a in enumerate(batch):
                good = found[i] >= 0
                options = np.concatenate([found[i][good], batch[:i]])
                sims = np.concatenate([near[i][good], among[i, :i]])
                order = np.argsort(-sims, kind="stable")[:BREADTH]
                connect(int(a), options[order], sims[order])
            start = stop
        members.insert(0, own)
        all_links.insert(0, links)
        entry_layers.append((own, links))
    return members, all_links


def descend(vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], queries: np.ndarray) -> np.ndarray:
    """Greedy way from the highest layer down: the point number where each query arrives."""
    at = np.zeros(len(queries), dtype=np.int64)
    for own, links in layers:
        found, _ = search_layer(vectors[own], links, queries, np.searchsorted(own, at), 1)
        at = own[found[:, 0]]
    return at


def search(vectors: np.ndarray, members: list[np.ndarray], links: list[np.ndarray], queries: np.ndarray, breadth: int) -> np.ndarray:
    """Point numbers near each query, best first, -1 where there are fewer than ``breadth``."""
    out = []
    for start in range(0, len(queries), _INSERT):
        some = queries[start : start + _INSERT]
        entries = descend(vectors, list(zip(members, links))[:0:-1], some)
        out.append(search_layer(vectors, links[0], some, entries, breadth)[0])
    return np.concatenate(out) if out else np.empty((0, breadth), dtype=np.int64)


def usable(raw: list) -> tuple[np.ndarray, np.ndarray]:
    """(mask, matrix): vectors with finite components and a length above 0; the rest take no part.

    All usable vectors of one call must have the dimension of the first one; others take no part.
    """
    mask = np.zeros(len(raw), dtype=bool)
    kept = []
    for i, v in enumerate(raw):
        if v is None or not len(v):
            continue
        x = np.asarray(v, dtype=np.float64)
        if not np.isfinite(x).all() or not x.any() or (kept and len(x) != len(kept[0])):
            continue
        mask[i] = True
        kept.append(x)
    return mask, np.array(kept, dtype=np.float64) if kept else np.empty((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 (scaled by the largest component first, so that nothing overflows)."""
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    return (scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))).astype(np.float32)


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of paired rows in double precision."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    y = y / np.abs(y).max(axis=1, keepdims=True)
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def write_index(vectors: DataFrame, shards: int, keep: int) -> DataFrame:
    """The written index, one row per shard: distinct vectors, the ``keep`` smallest ids of each, layers."""
    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        mask, matrix = usable(pdf["v"].tolist())
        if not mask.any():
            return pd.DataFrame({"shard": [], "dim": [], "vectors": [], "ids": [], "counts": [], "members": [], "links": []})
        ids = pdf["vec_id"].to_numpy(np.int64)[mask]
        order = np.argsort(ids, kind="stable")
        ids, matrix = ids[order], matrix[order]
        matrix = matrix + 0.0  # one zero
        as_bytes = np.ascontiguousarray(matrix).view(np.dtype((np.void, matrix.shape[1] * 8))).ravel()
        _, first, which = np.unique(as_bytes, return_index=True, return_inverse=True)
        behind: list[list[int]] = [[] for _ in first]
        for i, w in enumerate(which):
            if len(behind[w]) < keep and (not behind[w] or behind[w][-1] != ids[i]):
                behind[w].append(int(ids[i]))
        distinct = matrix[first]
        members, links = build(unit(distinct))
        return pd.DataFrame({
            "shard": [int(pdf["shard"].iloc[0])], "dim": [matrix.shape[1]], "vectors": [distinct.astype("<f8").tobytes()],
            "ids": [np.array([i for b in behind for i in b], "<i8").tobytes()],
            "counts": [np.array([len(b) for b in behind], "<i4").tobytes()],
            "members": [[m.astype("<i4").tobytes() for m in members]], "links": [[x.astype("<i4").tobytes() for x in links]],
        })

    placed = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).repartition(shards, "shard")
    schema = "shard int, dim int, vectors binary, ids binary, counts binary, members array<binary>, links array<binary>"
    return materialize(placed.groupBy("shard").applyInPandas(kernel, schema), "graphs")


def read_graph(row: pd.Series) -> tuple:
    vectors = np.frombuffer(row["vectors"], "<f8").reshape(-1, int(row["dim"]))
    counts = np.frombuffer(row["counts"], "<i4")
    starts = np.concatenate([[0], np.cumsum(counts)])
    members = [np.frombuffer(m, "<i4").astype(np.int64) for m in row["members"]]
    links = [np.frombuffer(x, "<i4").reshape(len(m), -1) for m, x in zip(members, row["links"])]
    return vectors, np.frombuffer(row["ids"], "<i8"), starts, members, links


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, breadth: int = BREADTH) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest cosines found, without the query's own id.

    ``vectors`` and ``queries`` have (vec_id, embedding).  Scores are doubles of the original
    vectors, ties go to the smaller id.  Null, zero or non-finite vectors take no part, nor do
    rows without an id; of repeated rows one counts.  An empty table gives no rows.
    """
    narrow = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).dropna()
    shards = tables(narrow.count(), SHARD_VECTORS, SHARDS)
    index = write_index(narrow, shards, k + 1)
    asked = queries.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("q")).dropna()
    asked = asked.dropDuplicates(["query_id"])
    blocks = tables(asked.count(), QUERY_BLOCK)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    spread = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def find(mine: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        if not len(mine) or not len(graph):
            return empty
        stored, ids, starts, members, links = read_graph(graph.iloc[0])
        mask, matrix = usable(mine["q"].tolist())
        if not mask.any() or matrix.shape[1] != stored.shape[1]:
            return empty
        names = mine["query_id"].to_numpy(np.int64)[mask]
        found = search(unit(stored), members, links, unit(matrix), breadth)
        who, place = np.nonzero(found >= 0)
        point = found[who, place]
        score = cosine(matrix[who], stored[point])
        sizes = np.diff(starts)[point]
        at = np.repeat(starts[point] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        out = pd.DataFrame({"query_id": np.repeat(names[who], sizes), "vec_id": ids[at], "score": np.repeat(score, sizes)})
        out = out[out["query_id"] != out["vec_id"]].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        return out.groupby("query_id").head(k)

    pairs = asked.groupBy("shard", "block").cogroup(spread.groupBy("shard", "block")).applyInPandas(
        find, "query_id long, vec_id long, score double")
    # at most k rows per shard and query
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def neighbours_of_sample(embeddings: DataFrame, every: int = 50) -> DataFrame:
    """The 5 nearest of every row whose vec_id is divisible by ``every``, among all other rows."""
    return nearest(embeddings, embeddings.filter(F.col("vec_id") % every == 0))
