"""Embedding near-duplicates by NN-descent.

1. Equal vectors of a label become one node. Nodes are sorted by (label, side of random hyperplanes, projection) for a few
   random trees; each vector's best neighbours in short overlapping runs of that order start the neighbour graph. The
   order is dealt by range, so a hot label or a tight cluster is spread over tasks.
2. NN-descent: at each node, its neighbours and the nodes it is a neighbour of (the best of them, three lists' length
   together) are compared with each other; pairs better than what their ends have enter their lists. Only pairs with a new
   end are compared, only nodes with a new neighbour take part, and rounds end when hardly any list changes.
3. Only a pair both whose ends' lists are saturated (even the last neighbour is a link) can have been compared and left
   out. So saturated nodes get lists four times as long, trees of their own start these lists anew, and descent goes on for
   them, until none is saturated or lists hold `longest` neighbours.
4. Pairs over the threshold, measured again in double precision, are links. What is saturated even then is finished
   exactly: such nodes of a label are compared with those of its other components, in blocks that return which components
   are linked, and the members of their components are compared in tiles of bounded size, which return counts, not pairs.
5. A bounded sample of nodes is compared with all vectors; if the links found fall short of the wanted recall, new trees
   add to the graph and descent goes on. If that doesn't help with over 512 trees, the operator fails.

Nulls: vectors that are null, zero or hold null or non-finite components, and those without a label, link with nothing and
are their own component; a null vec_id gets a null component and is kept. Repeated rows are links of each other. Where
rows of one vec_id hold different vectors, one of them (the least by bytes) takes part and the others link only with rows
equal to them. Vectors of different lengths are not compared. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, workers
from .components import components

#: Sample of nodes (at most) whose links are audited against brute force, at any input size.
AUDITED = 200
#: Saturated nodes of a label in one block, at most about; fewer while that makes no more than SPREAD blocks.
BLOCK = 1 << 16
SPREAD = 8


#: Similarities of descent are single precision; this far under the threshold, they are measured again.
SLACK = 1e-4


def _matrix(column: pa.Array, dim: int, kind=np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim)


def _single(batches):
    """node, label, dim, vec, weight with the vector in single precision too (small)."""
    for b in batches:
        small = [np.frombuffer(v, np.float64).astype(np.float32).tobytes() for v in b.column("vec").to_pylist()]
        yield pa.record_batch({c: b.column(c) for c in b.schema.names} | {"small": pa.array(small, pa.binary())})


def _unit(batches):
    """vec_id, label, dim, vec (unit length, doubles as bytes; null where it can't be compared)."""
    for b in batches:
        out, dims = [], []
        for e, label in zip(b.column("embedding").to_pylist(), b.column("label").to_pylist()):
            x = None if e is None or label is None or any(v is None for v in e) else np.array(e, np.float64)
            size = 0.0
            if x is not None and len(x) and np.isfinite(x).all():
                top = np.abs(x).max()
                size = float(np.linalg.norm(x / top)) if top else 0.0
            if size:
                out.append((x / top / size + 0.0).tobytes())
                dims.append(len(x))
            else:
                out.append(None)
                dims.append(0)
        yield pa.record_batch({"vec_id": b.column("vec_id"), "label": b.column("label"), "dim": pa.array(dims, pa.int32()), "vec": pa.array(out, pa.binary())})


def _plant(trees: int, bits: int, seed: int):
    """Each node once a tree, with its sides of the tree's hyperplanes and a projection."""

    def run(batches):
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = b.filter(pa.array(dims == dim))
                x = _matrix(part.column("vec"), dim, np.float32)
                for t in range(trees):
                    planes = np.random.Generator(np.random.PCG64([seed, t, int(dim)])).standard_normal((dim, bits + 1)).astype(np.float32)
                    y = x @ planes
                    code = (y[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(x), np.int64)
                    yield pa.record_batch({"tree": pa.array(np.full(len(x), t, np.int32)), "label": part.column("label"), "dim": part.column("dim"), "code": pa.array(code), "at": pa.array(y[:, bits].astype(np.float64)), "node": part.column("node"), "vec": part.column("vec")})

    return run


_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("sim", pa.float64())])


def _edges(u, v, sim) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.ascontiguousarray(u), pa.int64()), pa.array(np.ascontiguousarray(v), pa.int64()), pa.array(np.ascontiguousarray(sim), pa.float64())], schema=_EDGE)


def _runs(k: int, length: int):
    """Best k neighbours of each row within overlapping runs of rows that come sorted."""

    def best(ids, x):
        n = len(ids)
        if n < 2:
            return None
        sim = x @ x.T
        np.fill_diagonal(sim, -2.0)
        m = min(k, n - 1)
        top = np.argpartition(-sim, m - 1, axis=1)[:, :m]
        rows = np.repeat(np.arange(n), m)
        cols = top.ravel()
        return _edges(ids[rows], ids[cols], sim[rows, cols])

    def run(batches):
        key, ids, vecs, seen = None, [], [], 0

        def flush():
            return best(np.array(ids, np.int64), _matrix(pa.array(vecs, pa.binary()), key[2], np.float32)) if len(ids) > seen else None

        for b in batches:
            for t, label, dim, node, vec in zip(*(b.column(c).to_pylist() for c in ("tree", "label", "dim", "node", "vec"))):
                if (t, label, dim) != key:
                    if key is not None and (out := flush()) is not None:
                        yield out
                    key, ids, vecs, seen = (t, label, dim), [], [], 0
                ids.append(node)
                vecs.append(vec)
                if len(ids) == length:
                    yield flush()
                    ids, vecs = ids[length // 2 :], vecs[length // 2 :]
                    seen = len(ids)
        if key is not None and (out := flush()) is not None:
            yield out

    return run


def _local_join(batches):
    """Pairs among a node's neighbours, one of them new at least, that are better than the worst neighbour of the first."""
    for b in batches:
        dims = b.column("dim").to_pylist()
        u, v, s = [], [], []
        for dim, members in zip(dims, b.column("members").to_pylist()):
            ids = np.array([m["v"] for m in members], np.int64)
            worst, new = np.array([m["worst"] for m in members]), np.array([m["new"] for m in members], bool)
            x = np.frombuffer(b"".join(m["small"] for m in members), np.float32).reshape(-1, dim)
            sim = (x @ x.T).astype(np.float64)
            np.fill_diagonal(sim, -3.0)
            i, j = np.nonzero((sim > worst[:, None]) & (new[:, None] | new[None, :]))
            u.append(ids[i])
            v.append(ids[j])
            s.append(sim[i, j])
        if u:
            yield _edges(np.concatenate(u), np.concatenate(v), np.concatenate(s))


def _exact(threshold: float):
    """The pairs (u, v) whose vectors, in double precision, reach the threshold."""

    def run(batches):
        for b in batches:
            dims, keep = b.column("dim").to_numpy(), np.zeros(b.num_rows, bool)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                part = b.take(pa.array(at))
                keep[at] = np.einsum("ij,ij->i", _matrix(part.column("x"), dim), _matrix(part.column("y"), dim)) >= threshold
            yield pa.record_batch({"u": b.column("u"), "v": b.column("v")}).filter(pa.array(keep))

    return run


def _tile(threshold: float):
    def run(key, rows):
        low, dim = key[1].as_py(), rows["dim"][0].as_py()
        side = rows["block"].to_numpy() == low
        ids, weight = rows["node"].to_numpy(), rows["weight"].to_numpy().astype(np.float64)
        x = _matrix(rows["vec"].combine_chunks() if isinstance(rows["vec"], pa.ChunkedArray) else rows["vec"], dim)
        linked = x[side] @ x[~side].T if key[1].as_py() != key[2].as_py() else x @ x.T
        linked = linked >= threshold
        if key[1].as_py() != key[2].as_py():
            out_ids = np.concatenate([ids[side], ids[~side]])
            count = np.concatenate([linked @ weight[~side], weight[side] @ linked])
        else:
            np.fill_diagonal(linked, False)
            out_ids, count = ids, linked @ weight
        return pa.table({"node": pa.array(out_ids, pa.int64()), "n": pa.array(np.rint(count).astype(np.int64), pa.int64())})

    return run


def _bridges(threshold: float, step: int = 1024):
    """Linked components of two blocks of saturated nodes, as a forest."""

    def run(key, rows):
        dim, low, high = key[1].as_py(), key[2].as_py(), key[3].as_py()
        block, part = rows["block"].to_numpy(), rows["component"].to_numpy()
        x = _matrix(rows["vec"].combine_chunks() if isinstance(rows["vec"], pa.ChunkedArray) else rows["vec"], dim)
        root: dict[int, int] = {}

        def find(c):
            while root.get(c, c) != c:
                c = root[c]
            return c

        # by component, so that most steps within one need no products
        one, two = (side[np.argsort(part[side], kind="stable")] for side in (np.flatnonzero(block == low), np.flatnonzero(block == high)))
        for i in range(0, len(one), step):
            for j in range(0, len(two), step):
                a, b = one[i : i + step], two[j : j + step]
                p, q = part[a], part[b]
                if p[0] == p[-1] == q[0] == q[-1]:
                    continue
                r, c = np.nonzero((x[a] @ x[b].T >= threshold) & (p[:, None] != q[None, :]))
                for u, v in np.unique(np.stack([p[r], q[c]], axis=1), axis=0).tolist():
                    u, v = find(u), find(v)
                    root[max(u, v)] = min(u, v)
        joined = [(c, find(c)) for c in root if find(c) != c]
        return pa.table({"u": pa.array([u for u, _ in joined], pa.int64()), "v": pa.array([v for _, v in joined], pa.int64())})

    return run


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k best (u, v, sim, new, rank) of each u; ranked before the shuffle too, so no node's candidates are gathered."""
    # the same pair measured in other places may differ in its last digits
    once = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("u").orderBy(F.col("sim").desc(), "v"))).where(F.col("rank") <= k)


def _planes(nodes: DataFrame, run_length: int) -> int:
    """Hyperplanes of a tree whose cells, of the largest label, hold about half a run."""
    largest = nodes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    return max(0, math.ceil(math.log2(max(1, largest) / run_length)) + 1)


def _start(nodes: DataFrame, k: int, run_length: int, trees: int, bits: int, seed: int) -> DataFrame:
    """Edges (u, v, sim, new) of a few random trees."""
    planted = nodes.select("node", "label", "dim", F.col("small").alias("vec")).mapInArrow(workers.by_task(_plant(trees, bits, seed)), "tree int, label long, dim int, code long, at double, node long, vec binary")
    parts = max(common.shuffle_partitions(nodes.sparkSession), trees * -(-common.stored_bytes(nodes) // common.TARGET_BYTES))
    order = ["tree", "label", "dim", "code", "at", "node"]
    found = planted.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(workers.by_task(_runs(k, run_length)), "u long, v long, sim double")
    return found.withColumn("new", F.lit(1))


def _descend(nodes: DataFrame, graph, k: int, rounds: int, threshold: float, settled: float = 0.05):
    """NN-descent on a written graph (u, v, sim, new, rank); nodes whose lists hold less than k by the plan are open."""
    for _ in range(rounds):
        g = graph.df
        full = g.groupBy("u").agg(F.count(F.lit(1)).alias("size"), F.min("sim").alias("last"), F.max("open").alias("open"))
        worst = F.when(F.col("open") == 0, F.lit(2.0)).when(F.col("size") >= k, F.col("last")).otherwise(F.lit(-2.0))
        known = nodes.select(F.col("node").alias("v"), "dim", "small").join(full.select(F.col("u").alias("v"), worst.alias("worst")), "v", "left")
        known = known.withColumn("worst", F.coalesce("worst", F.lit(-2.0)))
        both = g.select(F.col("u").alias("x"), "v", "sim", "new").unionByName(g.select(F.col("v").alias("x"), F.col("u").alias("v"), "sim", "new")).groupBy("x", "v").agg(F.max("sim").alias("sim"), F.max("new").alias("new"))
        by = Window.partitionBy("x")
        ranked = both.withColumn("rank", F.row_number().over(by.orderBy(F.col("sim").desc(), "v"))).where(F.col("rank") <= 3 * k)
        busy = ranked.withColumn("busy", F.max("new").over(by)).where("busy = 1").select("x", "v", "new")
        members = busy.join(known, "v").groupBy("x").agg(F.first("dim").alias("dim"), F.collect_list(F.struct("v", "new", "worst", "small")).alias("members")).select("dim", "members")
        better = members.mapInArrow(workers.by_task(_local_join), "u long, v long, sim double").withColumn("new", F.lit(1))
        back = g.where("new = 1").select(F.col("v").alias("u"), F.col("u").alias("v"), "sim", F.lit(0).alias("new"))
        old = g.select("u", "v", "sim", F.lit(0).alias("new"))
        shut = full.where("open = 0").select("u", F.lit(0).alias("shut"))
        then = _best(old.unionByName(back).unionByName(better), k).join(shut, "u", "left").withColumn("open", F.coalesce("shut", F.lit(1))).drop("shut")
        then = common.materialize(common.few(then, nodes))
        graph.drop()
        graph = then
        count = graph.df.agg(F.count(F.lit(1)).alias("n"), F.sum("new").alias("new"), F.sum(F.when(F.col("sim") >= threshold - SLACK, F.col("new"))).alias("links")).first()
        if (count.new or 0) <= settled * (count.n or 0) and not count.links:
            break
    return graph


def _saturated(graph, k: int, threshold: float) -> DataFrame:
    return graph.df.groupBy("u").agg(F.count(F.lit(1)).alias("size"), F.min("sim").alias("last")).where((F.col("size") >= k) & (F.col("last") >= threshold - SLACK)).select("u")


def near_dedup(embeddings: DataFrame, threshold: float = 0.98, k: int = 10, run_length: int = 64, recall: float = 0.99, trees: int = 3, rounds: int = 8, longest: int = 160, tile: int = 1024, seed: int = 5) -> DataFrame:
    """vec_id, n_links, component_id, kept, one row for each input row.

    k, longest: neighbours a node's list holds at first and at most; trees: random trees that start the graph; rounds: of
    descent at each length of lists, at most.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("long").alias("label"))
    rows = common.materialize(rows.mapInArrow(_unit, "vec_id long, label long, dim int, vec binary")).df
    classes = rows.where("vec IS NOT NULL AND vec_id IS NOT NULL").groupBy("label", "dim", "vec").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight"))
    single = classes.groupBy("node").agg(F.min(F.struct("vec", "label", "dim", "weight")).alias("x"))
    single = single.select("node", "x.label", "x.dim", "x.vec", "x.weight").mapInArrow(_single, "node long, label long, dim int, vec binary, weight long, small binary")
    nodes = common.materialize(common.few(single, rows)).df
    bits = _planes(nodes, run_length)
    graph, planted, grow = None, 0, trees
    while True:
        begun = _start(nodes, k, run_length, grow, bits, seed + planted)
        if graph is not None:
            begun = begun.unionByName(graph.df.select("u", "v", "sim", F.lit(0).alias("new")))
        # lists that grew longer before are found again from their saturation
        then = common.materialize(common.few(_best(begun, k).withColumn("open", F.lit(1)), nodes))
        if graph is not None:
            graph.drop()
        graph, length = _descend(nodes, then, k, rounds, threshold), k
        while length * 4 <= longest and not (full := common.materialize(_saturated(graph, length, threshold))).df.isEmpty():
            length *= 4
            dense = common.materialize(common.few(nodes.join(full.df, nodes["node"] == full.df["u"], "left_semi"), nodes)).df
            again = _start(dense, length, 2 * length, trees, _planes(dense, 2 * length), seed + planted + length)
            kept = graph.df.select("u", "v", "sim", F.lit(1).alias("new"))
            opened = _best(kept.unionByName(again), length).join(full.df.withColumn("open", F.lit(1)), "u", "left").withColumn("open", F.coalesce("open", F.lit(0))).withColumn("new", F.col("open"))
            then = common.materialize(common.few(opened, nodes))
            graph.drop()
            graph = _descend(nodes, then, length, rounds, threshold)
        planted += grow
        found = _links(nodes, graph, threshold, length, tile)
        reached = _audit(nodes, found, threshold)
        if reached >= recall:
            break
        if planted > 512:
            raise RuntimeError(f"{planted} trees find {reached:.4f} of the links of a sample, {recall} are wanted")
        grow = planted
    own = classes.join(nodes.select("node", F.col("vec").alias("node_vec"), F.col("label").alias("node_label")), "node", "left").select("label", "dim", "vec", F.col("node"), "weight", ((F.col("vec") == F.col("node_vec")) & (F.col("label") == F.col("node_label"))).alias("takes_part"))
    known = own.join(found, "node", "left").select("label", "dim", "vec", (F.col("weight") - 1 + F.when(F.col("takes_part"), F.coalesce("n", F.lit(0))).otherwise(0)).alias("n"), F.when(F.col("takes_part"), F.coalesce("component", "node")).otherwise(F.col("node")).alias("component"))
    out = rows.join(known, ["label", "dim", "vec"], "left")
    alone = F.col("vec").isNull() | F.col("vec_id").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.when(alone, F.lit(0)).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _links(nodes, graph, threshold, length, tile) -> DataFrame:
    """node, n (other vectors linked, but for equal ones), component: nodes with links."""
    near = graph.df.where(F.col("sim") >= threshold - SLACK).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    ends = nodes.select(F.col("node").alias("u"), "dim", F.col("vec").alias("x")), nodes.select(F.col("node").alias("v"), F.col("vec").alias("y"))
    near = near.join(ends[0], "u").join(ends[1], "v").select("u", "v", "dim", "x", "y").mapInArrow(workers.by_task(_exact(threshold)), "u long, v long")
    near = common.materialize(common.few(near.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v"), graph.df, narrow=False)).df
    part = common.materialize(common.few(components(near.where("u > v")), near)).df
    full = common.materialize(_saturated(graph, length, threshold).withColumnRenamed("u", "node")).df
    part = _across(nodes, part, full, threshold)
    saturated = part.join(full, "node", "left_semi").select("component").distinct()
    weights = nodes.select(F.col("node").alias("v"), "weight")
    plain = part.join(saturated, "component", "left_anti").join(near, F.col("node") == F.col("u")).join(weights, "v").groupBy("node").agg(F.sum("weight").cast("long").alias("n"), F.first("component").alias("component"))
    dense = part.join(saturated, "component", "left_semi")
    size = dense.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / float(tile)).alias("blocks"))
    member = dense.join(size, "component").join(nodes.select("node", "dim", "vec", "weight"), "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = member.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "dim", "vec", "weight")
    counted = dealt.groupBy("component", "low", "high").applyInArrow(_tile(threshold), "node long, n long").groupBy("node").agg(F.sum("n").cast("long").alias("n"))
    whole = dense.join(counted, "node").select("node", "n", "component")
    return common.materialize(common.few(plain.select("node", "n", "component").unionByName(whole), near)).df


def _across(nodes: DataFrame, part: DataFrame, full: DataFrame, threshold: float) -> DataFrame:
    """part (node, component), with components joined where saturated nodes of theirs are linked."""
    ends = common.materialize(common.few(part.join(full, "node", "left_semi").join(nodes.select("node", "label", "dim", "vec"), "node"), nodes))
    blocks = F.greatest(F.ceil(F.col("size") / float(BLOCK)), F.least(F.lit(SPREAD).cast("long"), F.ceil(F.col("size") / 1024.0)))
    several = ends.df.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("label", "dim", blocks.alias("blocks"))
    member = ends.df.join(several, ["label", "dim"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = member.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("label", "dim", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "component", "vec")
    linked = common.materialize(common.few(dealt.groupBy("label", "dim", "low", "high").applyInArrow(_bridges(threshold), "u long, v long").distinct(), nodes))
    ends.drop()
    if linked.df.isEmpty():
        return part
    root = components(linked.df).select(F.col("node").alias("component"), F.col("component").alias("root"))
    return common.materialize(common.few(part.join(root, "component", "left").select("node", F.coalesce("root", "component").alias("component")), part)).df


def _audit(nodes: DataFrame, found: DataFrame, threshold: float) -> float:
    """Share of the sampled nodes' true links that were found; the sample is bounded, what it is compared with is not."""
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(AUDITED // 2).select("node", "label", "dim", "vec")
    some = found.orderBy(F.xxhash64("node"), "node").limit(AUDITED // 2).select("node")
    sample = sample.unionByName(nodes.join(some, "node", "left_semi").select("node", "label", "dim", "vec")).distinct()
    asked = [(r["node"], r["label"], r["dim"], bytes(r["vec"])) for r in sample.collect()]
    if not asked:
        return 1.0
    by: dict[tuple, tuple] = {}
    for key in {(label, dim) for _, label, dim, _ in asked}:
        own = [(n, v) for n, label, dim, v in asked if (label, dim) == key]
        by[key] = (np.array([n for n, _ in own], np.int64), np.frombuffer(b"".join(v for _, v in own), np.float64).reshape(-1, key[1]))

    def count(batches):
        for b in batches:
            labels, dims = b.column("label").to_numpy(), b.column("dim").to_numpy()
            for (label, dim), (ids, x) in by.items():
                part = b.filter(pa.array((labels == label) & (dims == dim)))
                if part.num_rows:
                    sim = _matrix(part.column("vec"), dim) @ x.T >= threshold
                    sim &= part.column("node").to_numpy()[:, None] != ids[None, :]
                    yield pa.record_batch({"node": pa.array(ids), "expected": pa.array(part.column("weight").to_numpy() @ sim, pa.int64())})

    true = nodes.select("node", "label", "dim", "vec", "weight").mapInArrow(count, "node long, expected long").groupBy("node").agg(F.sum("expected").cast("long").alias("expected"))
    got = true.where("expected > 0").join(found.select("node", "n"), "node", "left").agg(F.sum("expected"), F.sum(F.least("expected", F.coalesce("n", F.lit(0))))).first()
    return 1.0 if not got[0] else got[1] / got[0]


def op5_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dedup(common.table(spark, sf_dir, "embeddings"))


#: DuckDB: every pair of vectors of a label, and all that each can reach.
ORACLE_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), u AS (
  SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v
), l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) >= 0.98
), r AS (
  SELECT vec_id, vec_id AS root FROM embeddings UNION SELECT l.y, r.root FROM r JOIN l ON r.vec_id = l.x
), c AS (
  SELECT vec_id, min(root) AS component_id FROM r GROUP BY vec_id
)
SELECT c.vec_id, (SELECT count(*) FROM l WHERE l.x = c.vec_id) AS n_links, component_id, c.vec_id = component_id AS kept FROM c
"""
