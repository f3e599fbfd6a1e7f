"""Near-duplicate vectors by NN-descent.

Equal vectors are one node with a size. Random-projection leaves give every node a first
list of `k` neighbours. Each descent round joins neighbours of neighbours: a node's
neighbours, forward and backward, meet with their vectors and every pair of them
that would improve a list is kept. Lists whose every entry passes the threshold are
saturated; they double, and descend again.

The threshold edges of the graph give connected components. Those with lists that are still
saturated are held against each other exactly, pruned by centres and radii,
and joined where any pair links. Inside each component all
pairs are compared in blocks, so link counts are whole even where a group of
copies is larger than any list; only sizes of links are summed, no pairs are written.
Leaf tables grow with the number of nodes, so that a pair at the threshold meets in one of
them with probability `RECALL`. An audit holds a bounded, stated query set against all
nodes and averages over the queries that have links, so one group's links outweigh no
other's. It grows until enough queries have links; without them it is undecided and a second
attempt is made in any case. While it finds too few links, further leaves and
rounds are added; if that does not help, the query fails.

Defined cases: vectors that are null, of length zero, all zeros, or hold a null or
non-finite component link with nothing; a shorter vector counts as padded with zeros;
a null id is never the least of its component unless all are null; rows that repeat an
id are vectors of their own with the same id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import release, settle, ship
from cairn.llm.components import components

K = 16
LEAF = 128
LEAVES = 4
ROUNDS = 3
WIDEN = 2
THRESHOLD = 0.9
#: Leaf tables dealt at once, and attempts after which too low a recall is an error.
PASS, ATTEMPTS = 8, 5
#: The audit's query sets, chosen by the hash of the ids; queries with links that decide; the mean share of their links to be found.
AUDITS, LINKED, RECALL = (512, 4096, 32768), 64, 0.97
BLOCK = 512
EDGES = "a long, b long, sim double"


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype=np.float64).reshape(len(raw), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _pad(width: int):
    def run(batches):
        for batch in batches:
            out = []
            for v in batch.column("v"):
                x = np.zeros(width)
                got = np.asarray(v.as_py(), dtype=np.float64)
                x[: len(got)] = got
                # Scaled so that squares neither vanish nor overflow; the direction stays.
                out.append((x / np.abs(x).max()).tobytes())
            yield pa.record_batch([batch.column("id"), batch.column("size"), pa.array(out, pa.binary())], names=["id", "size", "vec"])

    return run


def _leaf(planes: np.ndarray):
    """The codes of each vector in every table; planes: tables x width x bits."""
    bits = 1 << np.arange(planes.shape[2], dtype=np.int64)

    def run(batches):
        for batch in batches:
            x = _unit([v.as_py() for v in batch.column("vec")]) if batch.num_rows else np.zeros((0, planes.shape[1]))
            codes = np.stack([((x @ p) > 0) @ bits for p in planes], axis=1)
            yield pa.record_batch([batch.column("id"), batch.column("vec"), pa.array(codes.tolist(), pa.list_(pa.int64()))], names=["id", "vec", "codes"])

    return run


def _best_in_block(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, x = pdf["id"].to_numpy(), _unit(pdf["vec"].tolist())
        n, m = len(ids), min(k, len(ids) - 1)
        if m < 1:
            return pd.DataFrame({"a": [], "b": [], "sim": []}).astype({"a": "int64", "b": "int64", "sim": "float64"})
        out = []
        for lo in range(0, n, BLOCK):
            s = x[lo : lo + BLOCK] @ x.T
            rows = np.arange(len(s))
            s[rows, lo + rows] = -2
            at = np.argpartition(-s, m - 1, axis=1)[:, :m]
            out.append(pd.DataFrame({"a": np.repeat(ids[lo : lo + BLOCK], m), "b": ids[at].reshape(-1), "sim": s[rows[:, None], at].reshape(-1)}))
        return pd.concat(out)

    return run


def _bits(n: int) -> int:
    return max(1, min(40, math.ceil(math.log2(max(2, n / LEAF)))))


def _tables(n: int) -> int:
    """Leaf tables in which a pair at the threshold shares a leaf at least once with probability `RECALL`."""
    together = (1 - math.acos(THRESHOLD) / math.pi) ** _bits(n)
    return max(LEAVES, math.ceil(math.log(1 - RECALL) / math.log1p(-together)))


def _leaves(nodes: DataFrame, n: int, width: int, first: int, tables: int, k: int) -> tuple[DataFrame, DataFrame]:
    """The best `k` of each node in its leaves of tables first..first + tables, and the settled codes they read."""
    planes = np.stack([np.random.default_rng(1000 + first + i).normal(size=(width, _bits(n))) for i in range(tables)])
    coded = settle(nodes.select("id", "vec").mapInArrow(_leaf(planes), "id long, vec binary, codes array<long>"))
    sizes = coded.select(F.posexplode("codes").alias("table", "leaf")).groupBy("table", "leaf").agg(F.count(F.lit(1)).alias("_n"))
    each = coded.select("id", "vec", F.posexplode("codes").alias("table", "leaf")).join(sizes, ["table", "leaf"])
    salted = each.withColumn("salt", F.pmod(F.xxhash64("id", F.col("table") + first), F.ceil(F.col("_n") / (2 * LEAF))))
    return salted.select("id", "vec", "table", "leaf", "salt").groupBy("table", "leaf", "salt").applyInPandas(_best_in_block(k), EDGES), coded


def _trim(edges: DataFrame, limits: DataFrame) -> DataFrame:
    """The best `k` of each node's edges; limits: (a, k) of the nodes with other lists than K."""
    w = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    one = edges.repartition(F.col("a")).dropDuplicates(["a", "b"])
    ranked = one.withColumn("_r", F.row_number().over(w)).join(limits, "a", "left")
    return ranked.where(F.col("_r") <= F.coalesce("k", F.lit(K))).select("a", "b", "sim")


def _meet(batches):
    """Pairs of each node's neighbours that would improve one of their lists; rows come sorted by node."""

    def pairs(group):
        ids = np.array(group["v"], dtype=np.int64)
        worst = np.array(group["worst"])
        x = _unit(group["vec"])
        i, j = np.triu_indices(len(ids), 1)
        a, b, s = [], [], []
        for lo in range(0, len(i), 1 << 20):
            p, q = i[lo : lo + (1 << 20)], j[lo : lo + (1 << 20)]
            sim = (x @ x.T)[p, q] if len(ids) <= 2048 else np.einsum("ij,ij->i", x[p], x[q])
            for left, right in ((p, q), (q, p)):
                use = sim > worst[left]
                a.append(ids[left[use]]), b.append(ids[right[use]]), s.append(sim[use])
        return a, b, s

    now, group = None, {"v": [], "worst": [], "vec": []}
    out: list[list] = [[], [], []]

    def flush():
        nonlocal out
        if out[0]:
            a, b, s = (np.concatenate(x) for x in out)
            out = [[], [], []]
            yield pa.record_batch([pa.array(a), pa.array(b), pa.array(s)], names=["a", "b", "sim"])

    def close():
        if len(group["v"]) > 1:
            for x, y in zip(out, pairs(group)):
                x.extend(y)

    for batch in batches:
        for u, v, worst, vec in zip(*(batch.column(c).to_pylist() for c in ("u", "v", "worst", "vec"))):
            if u != now:
                close()
                now, group = u, {"v": [], "worst": [], "vec": []}
            group["v"].append(v), group["worst"].append(worst), group["vec"].append(vec)
        yield from flush()
    close()
    yield from flush()


def _descend(graph: DataFrame, nodes: DataFrame, limits: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """One round of neighbours-of-neighbours joins; `only`: (u) the nodes whose neighbours meet."""
    worst = graph.groupBy("a").agg(F.min("sim").alias("_least"), F.count(F.lit(1)).alias("_n")).join(limits, "a", "left")
    worst = worst.select(F.col("a").alias("v"), F.when(F.col("_n") < F.coalesce("k", F.lit(K)), -1.0).otherwise(F.col("_least")).alias("worst"))
    back = graph.withColumn("_r", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("sim"), "a"))).join(limits.withColumnRenamed("a", "b"), "b", "left")
    back = back.where(F.col("_r") <= F.coalesce("k", F.lit(K)))
    around = graph.select(F.col("a").alias("u"), F.col("b").alias("v")).union(back.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct()
    if only is not None:
        around = around.join(only, "u", "left_semi")
    known = nodes.select(F.col("id").alias("v"), "vec").join(worst, "v", "left").withColumn("worst", F.coalesce("worst", F.lit(-1.0)))
    met = around.join(known, "v").repartition(F.col("u")).sortWithinPartitions("u")
    new = met.select("u", "v", "worst", "vec").mapInArrow(_meet, EDGES)
    return settle(_trim(graph.union(new), limits))


def _saturated(graph: DataFrame, limits: DataFrame) -> DataFrame:
    """(a, k): doubled lists of the nodes whose every entry links."""
    full = graph.groupBy("a").agg(F.min("sim").alias("_least"), F.count(F.lit(1)).alias("_n")).join(limits, "a", "left")
    return full.where((F.col("_least") >= THRESHOLD) & (F.col("_n") >= F.coalesce("k", F.lit(K)))).select("a", (2 * F.coalesce("k", F.lit(K))).alias("k"))


def _widen(limits: DataFrame, more: DataFrame) -> DataFrame:
    return settle(limits.join(more.select("a"), "a", "left_anti").unionByName(more))


def _count_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums of the sizes of linked nodes: inside small components, or between two blocks of a large one."""
    out_id, out_n = [], []
    for _, g in pdf.groupby("component", sort=False):
        ids, size, x, side = g["id"].to_numpy(), g["size"].to_numpy(dtype=np.float64), _unit(g["vec"].tolist()), g["side"].to_numpy()
        mixed = (side != side[0]).any()
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if mixed else left
        if not mixed and side[0] == 1:
            continue
        for lo in range(0, len(left), BLOCK):
            rows = left[lo : lo + BLOCK]
            hit = (x[rows] @ x[right].T) >= THRESHOLD
            if not mixed:
                hit[np.arange(len(rows)), lo + np.arange(len(rows))] = False
            out_id.append(ids[rows]), out_n.append(hit @ size[right])
            if mixed:
                out_id.append(ids[right]), out_n.append(size[rows] @ hit)
    ids = np.concatenate(out_id) if out_id else np.zeros(0, dtype=np.int64)
    n = np.concatenate(out_n) if out_n else np.zeros(0)
    return pd.DataFrame({"id": ids.astype(np.int64), "n": np.rint(n).astype(np.int64)})


def _links(nodes: DataFrame, member: DataFrame) -> DataFrame:
    """(id, component, n): the exact sum of the sizes linked with each node inside its component."""
    sizes = member.groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
    rows = settle(nodes.join(member.withColumnRenamed("node", "id"), "id").join(sizes, "component"))
    small = rows.where(F.col("_n") <= BLOCK)
    parts = max(1, math.ceil(small.count() / BLOCK))
    small = small.select("id", "size", "vec", "component", F.lit(0).alias("side"), F.pmod(F.xxhash64("component"), F.lit(parts)).alias("x"), F.lit(-1).cast("long").alias("y"))
    blocks = F.ceil(F.col("_n") / BLOCK)
    large = rows.where(F.col("_n") > BLOCK).withColumn("_i", F.pmod(F.xxhash64("id"), blocks)).withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    large = large.select("id", "size", "vec", "component", (F.col("_i") > F.col("_j")).cast("int").alias("side"), F.least("_i", "_j").alias("x"), F.greatest("_i", "_j").alias("y"))
    large = large.withColumn("tag", F.col("component"))
    both = small.withColumn("tag", F.lit(None).cast("long")).unionByName(large)
    counted = both.groupBy("tag", "x", "y").applyInPandas(_count_links, "id long, n long")
    return counted.groupBy("id").agg(F.sum("n").alias("n"))


def _cell(pdf: pd.DataFrame) -> pd.DataFrame:
    """The centre of a cell and the largest angle of a member to it."""
    x = _unit(pdf["vec"].tolist())
    centre = x.sum(0)
    if np.linalg.norm(centre) < 1e-6:
        centre = x[0]
    centre = centre / np.linalg.norm(centre)
    radius = float(np.arccos(np.clip((x @ centre).min(), -1, 1)))
    return pd.DataFrame({"cell": [pdf["cell"].iloc[0]], "component": [pdf["component"].iloc[0]], "centre": [centre.tobytes()], "radius": [radius]})


def _close(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs of cells of two components whose balls leave room for a link."""
    side = pdf["side"].to_numpy()
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if (side == 1).any() else left
    if not len(left):
        return pd.DataFrame({"p": [], "q": []}).astype(str)
    cell, comp, radius, c = pdf["cell"].to_numpy(), pdf["component"].to_numpy(), pdf["radius"].to_numpy(), _unit(pdf["centre"].tolist())
    near = np.arccos(np.clip(c[left] @ c[right].T, -1, 1)) <= radius[left][:, None] + radius[right][None, :] + (math.acos(THRESHOLD) + 1e-6)
    near &= comp[left][:, None] != comp[right][None, :]
    if right is left:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    return pd.DataFrame({"p": cell[left[i]], "q": cell[right[j]]})


def _touch(pdf: pd.DataFrame) -> pd.DataFrame:
    """One link between two cells, if there is any."""
    side, ids, x = pdf["side"].to_numpy(), pdf["id"].to_numpy(), _unit(pdf["vec"].tolist())
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    for lo in range(0, len(left), BLOCK):
        rows = left[lo : lo + BLOCK]
        i, j = np.nonzero(x[rows] @ x[right].T >= THRESHOLD)
        if len(i):
            return pd.DataFrame({"a": [ids[rows[i[0]]]], "b": [ids[right[j[0]]]]})
    return pd.DataFrame({"a": [], "b": []}).astype("int64")


def _across(nodes: DataFrame, member: DataFrame, full: DataFrame) -> DataFrame | None:
    """(a, b): a link for every two linked components in which some list is full; full: (a) those nodes.

    Lists that are full of nearer nodes hide links to other groups, so the components are
    compared exactly: cells of at most about `BLOCK` members by centre and radius, then
    the members of the cells that this does not rule out.
    """
    named = member.withColumnRenamed("node", "id")
    hot = named.join(full.withColumnRenamed("a", "id"), "id").select("component").distinct()
    sizes = settle(named.join(hot, "component").groupBy("component").agg(F.count(F.lit(1)).alias("_n")))
    if sizes.limit(2).count() < 2:
        return None
    rows = nodes.select("id", "vec").join(named.join(sizes, "component"), "id")
    rows = settle(rows.select("id", "vec", "component", F.concat_ws(":", "component", F.pmod(F.xxhash64("id"), F.ceil(F.col("_n") / BLOCK))).alias("cell")))
    cells = settle(rows.groupBy("cell").applyInPandas(_cell, "cell string, component long, centre binary, radius double"))
    blocks = max(1, math.ceil(cells.count() / BLOCK))
    dealt = cells.withColumn("_i", F.pmod(F.xxhash64("cell"), F.lit(blocks))).withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    dealt = dealt.select("cell", "component", "centre", "radius", (F.col("_i") > F.col("_j")).cast("int").alias("side"), F.least("_i", "_j").alias("x"), F.greatest("_i", "_j").alias("y"))
    pairs = settle(dealt.groupBy("x", "y").applyInPandas(_close, "p string, q string"))
    both = pairs.select("p", "q", F.col("p").alias("cell"), F.lit(0).alias("side")).unionByName(pairs.select("p", "q", F.col("q").alias("cell"), F.lit(1).alias("side")))
    met = both.join(rows.select("cell", "id", "vec"), "cell")
    return settle(met.groupBy("p", "q").applyInPandas(_touch, "a long, b long"))


def _audit(queries: list[tuple[int, int, bytes]]):
    ids = np.array([q[0] for q in queries], dtype=np.int64)
    comp = np.array([q[1] for q in queries], dtype=np.int64)
    x = _unit([q[2] for q in queries])

    def run(batches):
        all_, found = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                y = _unit([v.as_py() for v in batch.column("vec")]).T
                id_, component = batch.column("id").to_numpy(), batch.column("component").to_numpy()
                for lo in range(0, len(ids), BLOCK):
                    at = slice(lo, lo + BLOCK)
                    q, r = np.nonzero(x[at] @ y >= THRESHOLD)
                    q, r = q[ids[at][q] != id_[r]], r[ids[at][q] != id_[r]]
                    size = len(ids[at])
                    all_[at] += np.bincount(q, minlength=size)
                    found[at] += np.bincount(q[comp[at][q] == component[r]], minlength=size)
        some = np.flatnonzero(all_)
        yield pa.record_batch([pa.array(ids[some]), pa.array(all_[some]), pa.array(found[some])], names=["q", "n", "found"])

    return run


def recall(nodes: DataFrame, member: DataFrame, n: int, audit: int) -> tuple[int, int, int, float]:
    """Of about `audit` of `n` nodes held against all: links, links inside a component, queries with links, their mean share of links found."""
    named = nodes.join(member.withColumnRenamed("node", "id"), "id", "left").select("id", "vec", F.coalesce("component", "id").alias("component"))
    mine = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 40)) < F.lit(math.ceil((1 << 40) * min(1.0, audit / max(1, n))))
    chosen = named.where(mine).select("id", "component", "vec").collect()  # about `audit` rows
    if not chosen:
        return 0, 0, 0, 1.0
    each = named.mapInArrow(_audit([(a, b, bytes(c)) for a, b, c in chosen]), "q long, n long, found long").groupBy("q").agg(F.sum("n").alias("n"), F.sum("found").alias("found"))
    r = each.agg(F.sum("n"), F.sum("found"), F.count(F.lit(1)), F.avg(F.col("found") / F.col("n"))).first()
    return int(r[0] or 0), int(r[1] or 0), int(r[2]), 1.0 if r[3] is None else float(r[3])


def audited(nodes: DataFrame, member: DataFrame, n: int) -> tuple[tuple[int, int, int, float], bool]:
    """The recall of the first query set with enough linked queries, and whether there was one."""
    for audit in AUDITS:
        got = recall(nodes, member, n, audit)
        if got[2] >= LINKED or audit >= n:
            return got, True
    return got, False


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, n_links, component_id, kept, audit_links, audit_found) for every row."""
    v = F.col("v")
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    valid = F.coalesce((F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = settle(rows.withColumn("ok", valid).withColumn("_row", F.monotonically_increasing_id()))
    distinct = rows.where("ok").groupBy("v").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("size"), F.min("_row").alias("id"))
    distinct = settle(distinct)
    width = distinct.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    nodes = settle(distinct.select("id", "size", "v").mapInArrow(_pad(width), "id long, size long, vec binary"))
    n = nodes.count()
    graph = None
    limits = settle(nodes.sparkSession.createDataFrame([], "a long, k int"))
    tables = _tables(n)
    for attempt in range(ATTEMPTS):
        for at in range(0, tables, PASS):
            more, coded = _leaves(nodes, n, width, attempt * tables + at, min(PASS, tables - at), K)
            before, graph = graph, settle(_trim(more if graph is None else graph.union(more), limits))
            release(coded, *([] if before is None else [before]))
        for _ in range(ROUNDS):
            before = graph
            graph = _descend(before, nodes, limits)
            changed = graph.join(before, ["a", "b"], "left_anti").count()
            release(before)
            if changed < 0.005 * K * n:
                break
        for _ in range(WIDEN):
            more = settle(_saturated(graph, limits))
            if not more.limit(1).count():
                break
            limits = _widen(limits, more)
            graph = _descend(graph, nodes, limits, more.select(F.col("a").alias("u")))
        linked = graph.where(F.col("sim") >= THRESHOLD)
        member = components(linked)
        bridges = _across(nodes, member, _saturated(graph, limits).select("a"))
        if bridges is not None and bridges.limit(1).count():
            member = components(linked.select("a", "b").unionByName(bridges))
        audit, decided = audited(nodes, member, n)
        if audit[3] >= RECALL and (decided or attempt):
            break
    else:
        raise RuntimeError(f"op3: {audit[2]} linked queries of the audit find {audit[3]:.4f} of their links after {ATTEMPTS} attempts, less than {RECALL}")
    counted = _links(nodes, member)
    classes = distinct.select("v", "id", "least", "size").join(member.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    names = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = settle(classes.join(names, "component").join(counted, "id", "left").select("v", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).cast("long").alias("n_links"), "component_id"))
    linked = rows.where("ok").join(named, "v", "left").select("key", "n_links", "component_id")
    alone = rows.where(~F.col("ok")).select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("key").alias(key), "n_links", "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(True)).alias("kept"),
        F.lit(audit[0]).cast("long").alias("audit_links"), F.lit(audit[1]).cast("long").alias("audit_found"),
    )


ship(__name__)
