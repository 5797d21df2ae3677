"""Embedding near-duplicates by search in a robust-pruned flat graph.

Equal vectors of a label are one node from here on. Nodes are dealt to overlapping shards by a tree of
cluster centres that is fitted level by level on Spark, until a shard is the nearest one of no more than
about twice SHARD nodes; a node is a member of its OVERLAP nearest shards, whatever the size of the table.
Each shard builds a graph over its members: near neighbours, pruned so that an edge is dropped where a
shorter way over a kept neighbour exists. The adjacency lists of a node are united over its shards.

Each node then searches the united graph, greedily from its shards' medoids, and from where that ends and
from its own place it expands over all nodes within a range wider than the threshold. Where the search meets
a node that belongs to a shard the query has not been to, the query goes there in the next round, until no
round finds a new shard. A query and the nearest shard of a node that it found, in whatever shard, make one
row: all nodes of that shard are then compared with the query in double precision, so no link that the search
found is lost, and no pair leaves a task. Only counts and a spanning forest of the links do, so a group of n
near copies makes n rows, not n squared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SMALL_IDS, cut, written
from .components import components

THRESHOLD = 0.93
#: Nodes that are to have a shard as their nearest (up to twice as many do), and shards of a node.
SHARD, OVERLAP = 340, 3
#: Centres that one cell of the tree is split into at most, nodes of the sample for each of them, rounds of the fit, levels.
FAN, SAMPLE_EACH, ROUNDS, MAX_LEVELS = 64, 24, 8, 24
#: Candidate neighbours, edges of a node, slack of the pruning, medoids of a shard, and how far below the threshold to expand.
CANDIDATES, DEGREE, ALPHA, MEDOIDS, RANGE = 32, 16, 1.2, 8, 0.12
#: Queries that search at a time.
BLOCK = 256
#: Rows of a cell or queries of a shard that one task takes, on average.
PART = 2_048


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _vectors(table: pa.Table, column: str = "u") -> np.ndarray:
    """The vectors of a column, all of one length, without a Python object for each number."""
    return table[column].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def _lists(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """A column of lists as (row of each value, value)."""
    c = table[column].combine_chunks()
    return np.repeat(np.arange(len(c)), c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), c.flatten().to_numpy(zero_copy_only=False)


def _kmeans(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means from k rows that are evenly spaced in the order given."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        full = np.linalg.norm(sums, axis=1) > 1e-9
        c[full] = unit(sums[full])
    return c


def _fit(table: pa.Table) -> pa.Table:
    """One cell's sample -> its children: their numbers and centres."""
    table = table.sort_by("h")
    cell, k = table["cell"][0].as_py(), min(table["k"][0].as_py(), table.num_rows)
    c = _kmeans(_vectors(table), k, ROUNDS)
    numbers = [xxhash.xxh64_intdigest(f"{cell}/{j}") - (1 << 63) for j in range(k)]
    return pa.table({"cell": pa.array([cell] * k), "child": pa.array(numbers), "centre": pa.array(list(c), pa.list_(pa.float32()))})


def _assign(overlap: int):
    """Members of a cell and its children -> each member's nearest children, with the cosine to their centres. Without children it stays."""

    def run(rows: pa.Table, children: pa.Table) -> pa.Table:
        if not rows.num_rows or not children.num_rows:
            return pa.table({"key": rows["key"], "h": rows["h"], "cell": rows["cell"], "cosine": pa.array(np.full(rows.num_rows, -2.0))})
        key, h, child = rows["key"].to_numpy(), rows["h"].to_numpy(), children["child"].to_numpy()
        near = (_vectors(rows) @ _vectors(children, "centre").T).astype(float)
        # directions that no centre tells apart are dealt evenly
        near += 1e-12 * ((h[:, None] ^ child[None, :]) & 1023)
        k = min(overlap, child.size)
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        return pa.table({"key": np.repeat(key, k), "h": np.repeat(h, k), "cell": child[best].ravel(), "cosine": np.take_along_axis(near, best, 1).ravel()})

    return run


def deal(nodes: DataFrame, shard: int = SHARD, overlap: int = OVERLAP) -> DataFrame:
    """nodes (key, h, label, u, ...) with `shards`, the numbers of the node's nearest shards, and `home`, that of the nearest.

    Every level splits the cells that are still the nearest of over 2 * shard nodes. Samples and centres of a cell are
    rows that are joined to it, and its counts too unless they are few for the table as a whole, so that nothing here
    grows on the driver or in a broadcast. Vectors of different labels or lengths never share a shard.
    """
    vectors = nodes.select("key", "u")
    root = F.struct(F.lit(-2.0).alias("cosine"), F.xxhash64("label", F.size("u")).alias("cell"))
    where = cut(nodes.select("key", "h", F.lit(0).alias("at"), root.alias("c")).select("key", "h", "at", "c.*"))  # a node's cells, the nearest at 0
    for _ in range(MAX_LEVELS):
        wide = where.where("at = 0").groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > 2 * shard)
        wide = cut(wide.select("cell", "n", F.least(F.lit(FAN), F.ceil(F.col("n") / shard)).cast("int").alias("k"), F.ceil(F.col("n") * overlap / PART).cast("int").alias("parts")))
        n_wide = wide.count()
        if not n_wide:
            break
        few = F.broadcast(wide) if n_wide <= SMALL_IDS else wide
        members = where.join(few, "cell")
        rate = F.col("k") * SAMPLE_EACH / F.col("n")
        sample = members.where(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < rate * (1 << 30)).join(vectors, "key").select("cell", "k", "h", "u")
        children = cut(sample.groupBy("cell").applyInArrow(_fit, "cell long, child long, centre array<float>"))
        rows = members.join(vectors, "key").select("cell", F.pmod("h", F.col("parts")).cast("int").alias("part"), "key", "h", "u")
        centres = children.join(few, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "child", "centre")
        moved = rows.groupBy("cell", "part").cogroup(centres.groupBy("cell", "part")).applyInArrow(_assign(overlap), "key long, h long, cell long, cosine double")
        both = where.drop("at").join(few.select("cell"), "cell", "left_anti").unionByName(moved)
        # overlap * overlap cells of a node at most
        best = both.groupBy("key").agg(F.min("h").alias("h"), F.slice(F.sort_array(F.collect_list(F.struct("cosine", "cell")), asc=False), 1, overlap).alias("c"))
        where = cut(best.select("key", "h", F.posexplode("c").alias("at", "c")).select("key", "h", "at", "c.*"))
    cells = where.groupBy("key").agg(F.collect_list("cell").alias("shards"), F.min_by("cell", "at").alias("home"))
    return nodes.join(cells, "key")


def build_graph(x: np.ndarray) -> np.ndarray:
    """Neighbours of each unit vector, a row of at most DEGREE with -1 behind: the nearest, robustly pruned."""
    n = len(x)
    k = min(CANDIDATES, n - 1)
    out = np.full((n, DEGREE), -1)
    for at in range(0, n if k else 0, BLOCK):
        near = x[at : at + BLOCK] @ x.T
        rows = np.arange(len(near))
        near[rows, rows + at] = -2
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        close = np.take_along_axis(near, best, 1)
        order = np.argsort(-close, axis=1)
        best, own = np.take_along_axis(best, order, 1), np.maximum(0, 2 - 2 * np.take_along_axis(close, order, 1))  # squared distances, nearest first
        v = x[best]
        between = np.matmul(v, v.transpose(0, 2, 1))
        between *= -2 * ALPHA * ALPHA
        between += 2 * ALPHA * ALPHA
        # all rows at once: the nearest open candidate is kept, and closes those that it is clearly nearer to than the row is
        alive, count = np.ones(best.shape, bool), np.zeros(len(near), int)
        for j in range(k):
            keep = np.flatnonzero(alive[:, j] & (count < DEGREE))
            out[at + keep, count[keep]] = best[keep, j]
            count[keep] += 1
            alive[keep] &= between[keep, j] > own[keep]
    return out


def medoids(x: np.ndarray, k: int = MEDOIDS) -> np.ndarray:
    """Members nearest to the centres of a few clusters of the shard."""
    c = _kmeans(x, min(k, len(x)), 3)
    return np.unique(np.argmax(c @ x.T, axis=1))


def search(x: np.ndarray, edges: np.ndarray, q: np.ndarray, own: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Triples (query, node, cosine) of what a search of the graph meets with a cosine of `least` or more.

    x: unit vectors of the nodes; edges: a row of neighbours for each, -1 behind; q: unit vectors of the queries;
    own: a query's own node, -1 for none.
    """
    n, entries = len(x), medoids(x)
    for at in range(0, len(q), BLOCK):
        own_q, here = q[at : at + BLOCK], own[at : at + BLOCK]
        # greedy: from the best medoid to the best neighbour, as long as that is nearer
        score = own_q @ x[entries].T
        now, best, rows = entries[np.argmax(score, axis=1)], score.max(axis=1), np.arange(len(own_q))
        while rows.size:
            near = edges[now[rows]]
            s = np.where(near >= 0, np.matmul(x[near], own_q[rows][:, :, None])[:, :, 0], -2)
            j = np.argmax(s, axis=1)
            top = s[np.arange(rows.size), j]
            better = top > best[rows]
            rows, j, near, top = rows[better], j[better], near[better], top[better]
            now[rows], best[rows] = near[np.arange(rows.size), j], top
        # expand: over everything within the range, from there and from the query's own place
        visited = np.zeros(len(own_q) * n, bool)
        known = np.flatnonzero(here >= 0)
        key = np.concatenate([np.arange(len(own_q)) * n + now, known * n + here[known]])
        while key.size:
            key = np.unique(key[~visited[key]])
            visited[key] = True
            qs, vs = np.divmod(key, n)
            near = np.concatenate([np.einsum("pd,pd->p", own_q[qs[i : i + 65536]], x[vs[i : i + 65536]]) for i in range(0, qs.size, 65536)] or [np.zeros(0)])
            go = near >= least
            qs, vs, near = qs[go], vs[go], near[go]
            yield qs + at, vs, near
            wide = edges[vs]
            q2, v2 = np.repeat(qs, wide.shape[1]), wide.ravel()
            key = (q2 * n + v2)[v2 >= 0]


def _graph(table: pa.Table) -> pa.Table:
    """One shard's adjacency lists."""
    table = table.sort_by("key")
    key, edges = table["key"].to_numpy(), build_graph(_vectors(table))
    lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum((edges >= 0).sum(axis=1))]).astype(np.int32), pa.array(key[edges[edges >= 0]], pa.int64()))
    return pa.table({"key": pa.array(key), "near": lists})


def _visit(threshold: float):
    """Queries search one shard -> rows (key, shard, kind): 0, a shard to verify the query in; 1, one to search next."""

    def run(queries: pa.Table | None, members: pa.Table) -> pa.Table:
        empty = pa.table({"key": pa.array([], pa.int64()), "shard": pa.array([], pa.int64()), "kind": pa.array([], pa.int32())})
        if not members.num_rows or queries is not None and not queries.num_rows:
            return empty
        members = members.sort_by("key")
        key, home, x = members["key"].to_numpy(), members["home"].to_numpy(), _vectors(members)
        row, to = _lists(members, "near")
        at = np.minimum(np.searchsorted(key, to), key.size - 1)
        row, at = row[key[at] == to], at[key[at] == to]  # the united lists, as far as they stay in this shard
        edges = np.full((key.size, max(1, int(np.bincount(row, minlength=1).max()))), -1)
        edges[row, np.arange(row.size) - np.searchsorted(row, row)] = at
        own = queries if queries is not None else members
        q, q_home = (_vectors(own), own["home"].to_numpy()) if queries is not None else (x, home)
        q_key = own["key"].to_numpy()
        m_row, m_shard = _lists(members, "shards")
        starts = np.searchsorted(m_row, np.arange(key.size + 1))
        verify, further = [], []
        for qs, vs, near in search(x, edges, q, np.arange(key.size) if queries is None else np.full(q_key.size, -1), threshold - RANGE):
            other = q_key[qs] != key[vs]
            qs, vs, near = qs[other], vs[other], near[other]
            hit = near >= threshold - 1e-5
            verify.append(np.stack([np.concatenate([q_key[qs[hit]], key[vs[hit]]]), np.concatenate([home[vs[hit]], q_home[qs[hit]]])]))
            count = starts[vs + 1] - starts[vs]
            more = np.repeat(starts[vs] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
            further.append(np.unique(np.stack([np.repeat(q_key[qs], count), m_shard[more]]), axis=1))
            if len(verify) > 64:
                verify, further = ([np.unique(np.concatenate(v, axis=1), axis=1)] for v in (verify, further))
        verify, further = (np.unique(np.concatenate([*v, np.zeros((2, 0), np.int64)], axis=1), axis=1) for v in (verify, further))
        # a query has been to its own shards already
        o_row, o_shard = _lists(own, "shards")
        mine = np.unique(np.stack([q_key[o_row], o_shard]), axis=1)
        both, first, n = np.unique(np.concatenate([mine, further], axis=1), axis=1, return_index=True, return_counts=True)
        further = both[:, (n == 1) & (first >= mine.shape[1])]
        out = np.concatenate([verify, further], axis=1)
        return pa.table({"key": pa.array(out[0].astype(np.int64)), "shard": pa.array(out[1].astype(np.int64)), "kind": pa.array(np.repeat([0, 1], [verify.shape[1], further.shape[1]]).astype(np.int32))})

    return run


def _verify(threshold: float):
    """Links of queries with a shard's own nodes by cosine in double precision: rows (a, a, links) and, for the components, (a, b, 0)."""

    def run(queries: pa.Table, block: pa.Table) -> pa.Table:
        out = [], [], []
        if queries.num_rows and block.num_rows:
            queries, block = queries.sort_by("key"), block.sort_by("key")
            (qk, bk), (q, b) = ([t["key"].to_numpy() for t in (queries, block)], [_vectors(t, "x") for t in (queries, block)])
            (qn, bn), n = ([np.sqrt((v * v).sum(axis=1)) for v in (q, b)], block["n"].to_numpy())
            label, bu = np.arange(bk.size), b / bn[:, None]
            for at in range(0, qk.size, BLOCK):
                i, j = np.nonzero((q[at : at + BLOCK] / qn[at : at + BLOCK, None]) @ bu.T >= threshold - 1e-9)
                i += at
                real = np.concatenate([(q[i[s : s + 65536]] * b[j[s : s + 65536]]).sum(axis=1) / (qn[i[s : s + 65536]] * bn[j[s : s + 65536]]) >= threshold for s in range(0, i.size, 65536)] or [np.zeros(0, bool)])
                real &= qk[i] != bk[j]
                i, j = i[real], j[real]
                for a, hits in zip(*_runs(i, j), strict=True):
                    groups, first = np.unique(label[hits], return_index=True)  # one link to each group that this row joins
                    out[0].append(np.full(groups.size + 1, qk[a]))
                    out[1].append(np.append(qk[a], bk[hits[first]]))
                    out[2].append(np.append(n[hits].sum(), np.zeros(groups.size, np.int64)))
                    if groups.size > 1:
                        label[np.isin(label, groups)] = groups[0]
        return pa.table([pa.array(np.concatenate([*c, np.zeros(0, np.int64)]).astype(np.int64)) for c in out], names=["a", "b", "links"])

    return run


def _runs(i: np.ndarray, j: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """The values of j for each of the sorted values of i."""
    rows, starts = np.unique(i, return_index=True)
    return rows.tolist(), np.split(j, starts[1:]) if rows.size else []


def _meet(queries: DataFrame, members: DataFrame, function, schema: str, few) -> DataFrame:
    """Queries (shard, key, ...) and members (shard, ...) of the same shard, with a shard's many queries dealt to several tasks.

    few: how to mark a table of one row a shard, for broadcast or not.
    """
    parts = few(queries.groupBy("shard").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    left = queries.join(parts, "shard").withColumn("part", part).drop("parts")
    right = members.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of its own, where both sides come from one table
    return left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInArrow(lambda q, m: function(q, m), schema)


@F.arrow_udf(T.ArrayType(T.FloatType()))
def _directions(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Unit vectors in single precision, which the search takes; links are verified in double precision. Vectors are not zero."""
    for x in columns:
        sizes = x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        v, starts = x.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
        if v.size:
            v = v / np.repeat(np.maximum.reduceat(np.abs(v), starts), sizes)
            v = v / np.repeat(np.sqrt(np.add.reduceat(v * v, starts)), sizes)
        yield pa.ListArray.from_arrays(np.append(starts, v.size).astype(np.int32), pa.array(v.astype(np.float32)))


def _usable(embedding: Column) -> Column:
    return F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(embedding, lambda v: v != 0)


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, shard: int = SHARD, overlap: int = OVERLAP) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of vectors.

    vectors: vec_id (integer), embedding (array of numbers), label; other columns are not read. Vectors link
    when their labels are equal and not null and their cosine in double precision reaches the threshold. A
    vector that is null, empty, zero or holds null or non-finite components links with nothing, and neither does
    one without a vec_id; vectors of different lengths never link. Equal vectors link with each other. Rows that
    share a vec_id are vectors of their own. n_links: rows linked directly; component_id: the smallest vec_id
    reachable; kept: vec_id = component_id. An empty table gives an empty table.
    """
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    usable = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & _usable(F.col("x")), F.lit(False))
    rows = cut(rows.withColumn("usable", usable))
    nodes = rows.where("usable").groupBy("label", "x").agg(F.min("vec_id").cast("long").alias("least"), F.count("*").alias("n"))
    nodes = written(nodes.withColumns({"key": F.monotonically_increasing_id(), "h": F.xxhash64("x"), "u": _directions("x")}))
    dealt = written(deal(nodes, shard, overlap).select("key", "x", "u", "n", "shards", "home"))
    small = dealt.select(F.explode("shards")).distinct().count() <= SMALL_IDS
    few = F.broadcast if small else (lambda d: d)
    members = dealt.select("key", "u", F.explode("shards").alias("shard"))
    graph = members.groupBy("shard").applyInArrow(_graph, "key long, near array<long>")
    united = graph.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # at most `overlap` lists of DEGREE each
    ready = written(dealt.join(united, "key").select("key", "u", "shards", "home", "near"))
    members = ready.withColumn("shard", F.explode("shards"))
    visit = _visit(threshold)
    found = cut(members.groupBy("shard").applyInArrow(lambda t: visit(None, t), "key long, shard long, kind int"))
    verify, pairs = found.where("kind = 0"), lambda d, old: d.select("key", "shard", F.lit(old).alias("old"))
    done, further = None, found.where("kind = 1")
    while True:  # a query goes on where its last round led, and never twice to one shard
        both = pairs(further, 0) if done is None else pairs(further, 0).unionByName(pairs(done, 1))
        wanted = cut(both.groupBy("key", "shard").agg(F.max("old").alias("old")).where("old = 0").select("key", "shard"))
        if wanted.isEmpty():
            break
        done = wanted if done is None else done.unionByName(wanted)
        queries = wanted.join(ready.select("key", "u", "shards", "home"), "key")
        found = cut(_meet(queries, members, visit, "key long, shard long, kind int", few))
        verify, further = verify.unionByName(found.where("kind = 0")), found.where("kind = 1")
    asked = cut(verify.select("key", "shard").distinct()).join(dealt.select("key", "x"), "key")
    links = cut(_meet(asked, dealt.select(F.col("home").alias("shard"), "key", "x", "n"), _verify(threshold), "a long, b long, links long", few))
    counts = links.where("a = b").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    roots = components(links.where("a <> b"), "a", "b").toDF("key", "root")
    known = nodes.join(counts, "key", "left").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    known = known.select(F.col("label").alias("l"), F.col("x").alias("v"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "root", "least")
    known = known.join(known.groupBy("root").agg(F.min("least").alias("component_id")), "root").drop("root", "least")
    linked = rows.where("usable").join(known, (F.col("label") == F.col("l")) & (F.col("x") == F.col("v"))).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _count_true(threshold: float):
    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        n = np.zeros(asked.num_rows, np.int64)
        if asked.num_rows and rows.num_rows:
            q, x = unit(_vectors(asked, "x")), unit(_vectors(rows, "x"))
            for at in range(0, len(q), BLOCK):
                n[at : at + BLOCK] = (q[at : at + BLOCK] @ x.T >= threshold).sum(axis=1)
        return pa.table({"vec_id": asked["vec_id"], "n": pa.array(n)})

    return run


def audit_recall(vectors: DataFrame, links: DataFrame, threshold: float = THRESHOLD, block: int = 4_096) -> float:
    """Share of the true links of the rows whose vec_id is divisible by 100 that near_vectors counted, by brute force in blocks.

    Blocks of query rows meet blocks of all rows of their label, as tasks of their own; links is near_vectors' result.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("x"))).withColumn("d", F.size("x"))
    blocks = rows.groupBy("label", "d").agg(F.ceil(F.count("*") / block).alias("rs"), F.ceil(F.count_if(F.expr("vec_id % 100 = 0")) / block).alias("qs"))
    at = rows.join(blocks, ["label", "d"])
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    asked = at.where("vec_id % 100 = 0").select("label", "d", every("rs").alias("r"), part("qs").alias("q"), "vec_id", "x")
    against = at.where("qs > 0").select("label", "d", part("rs").alias("r"), every("qs").alias("q"), "x")
    against = against.select(*[F.col(c).alias(c) for c in against.columns])
    keys = ["label", "d", "r", "q"]
    true = asked.groupBy(*keys).cogroup(against.groupBy(*keys)).applyInArrow(_count_true(threshold), "vec_id long, n long").agg(F.sum("n"), F.count_distinct("vec_id")).first()
    n = rows.where("vec_id % 100 = 0").count()  # each row meets itself once
    got = links.where("vec_id % 100 = 0").agg(F.sum("n_links")).first()[0] or 0
    return got / ((true[0] or 0) - n) if (true[0] or 0) > n else 1.0
