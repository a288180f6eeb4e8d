"""Community detection: deterministic Louvain moves with connected communities (a simplified Leiden) per connected component, label propagation, merging of small communities, splits."""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.components import connected_components
from sparkloom.operators.graph import neighbours, simple_graph
from sparkloom.session import materialise


def _adjacency(edges: list[tuple[str, str, float]]) -> dict[str, dict[str, float]]:
    adj: dict[str, dict[str, float]] = defaultdict(dict)
    for a, b, w in edges:
        adj[a][b] = adj[a].get(b, 0.0) + w
        adj[b][a] = adj[b].get(a, 0.0) + w
    return adj


def modularity(adj: dict[str, dict[str, float]], label: dict[str, int]) -> float:
    total = sum(sum(x.values()) for x in adj.values())
    if not total:
        return 0.0
    inner: dict[int, float] = defaultdict(float)
    strength: dict[int, float] = defaultdict(float)
    for a, near in adj.items():
        for b, w in near.items():
            strength[label[a]] += w
            if label[a] == label[b]:
                inner[label[a]] += w
    return sum(inner[c] / total - (strength[c] / total) ** 2 for c in strength)


def leiden(edges: list[tuple[str, str, float]], rounds: int = 10) -> dict[str, int]:
    """Communities of a graph in memory: local moves, refinement into connected parts, aggregation. Nodes go in sorted order."""
    names = sorted({x for a, b, _ in edges for x in (a, b)})
    place = {x: i for i, x in enumerate(names)}
    src, dst = (np.array([place[e[k]] for e in edges], np.int64) for k in (0, 1))
    found = communities_of(src, dst, np.array([e[2] for e in edges], np.float64), len(names), rounds)
    return dict(zip(names, found.tolist(), strict=True))


def communities_of(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, n: int, rounds: int = 10) -> np.ndarray:
    """The same for nodes 0 to n - 1 in the order of their names: the number of each one's community, in the order of their least nodes."""
    a, b, w = _summed(np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([weight, weight]).astype(np.float64), n)
    total, loops = float(w.sum()), np.zeros(n)
    member, least, size = np.arange(n), np.arange(n), n
    for _ in range(rounds):
        at = np.searchsorted(a, np.arange(size + 1))
        label = np.arange(size)
        if not _moved(at, b, w, label, total, np.bincount(a, weights=w, minlength=size) + loops):
            break
        same = label[a] == label[b]
        part = np.arange(size)  # the least node of each connected part
        while True:
            low = part.copy()
            np.minimum.at(low, a[same], part[b[same]])
            low = low[low]
            if np.array_equal(low, part):
                break
            part = low
        # parts are named by the least member of their least node, as before the nodes' order is that of the names
        name, inverse = np.unique(part, return_inverse=True)
        member, size = inverse[member], len(name)
        x, y = inverse[a], inverse[b]
        loops = np.bincount(inverse, weights=loops, minlength=size) + np.bincount(x[x == y], weights=w[x == y], minlength=size)
        a, b, w = _summed(x[x != y], y[x != y], w[x != y], size)
    return np.unique(member, return_inverse=True)[1]


def _summed(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parallel directed edges added up, by both ends in order."""
    key = a * n + b
    order = np.argsort(key, kind="stable")
    key, w = key[order], w[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    key, w = key[first], np.add.reduceat(w, first) if len(first) else w
    return key // max(n, 1), key % max(n, 1), w


def _moved(at: np.ndarray, near: np.ndarray, w: np.ndarray, label: np.ndarray, total: float, strength: np.ndarray) -> bool:
    """Nodes go to the neighbouring label of largest gain until none gains; gains are compared at twelve digits, ties go to the own label, then to the
    smallest. Nodes whose neighbours left wait for the next pass."""
    size = len(label)
    of, gain = strength.copy(), np.zeros(size)
    bound, own_strength = at.tolist(), strength.tolist()
    moved, queue, waiting = False, range(size), np.ones(size, bool)
    while len(queue):
        again = []
        for a in queue:
            waiting[a] = False
            own, lo, hi = int(label[a]), bound[a], bound[a + 1]
            if lo == hi:
                continue
            s = own_strength[a]
            of[own] -= s
            around = label[near[lo:hi]]
            np.add.at(gain, around, w[lo:hi])
            value = gain[around] - of[around] * s / total
            stay = float(gain[own] - of[own] * s / total)
            gain[around] = 0.0
            top = max(float(value.max()), stay)
            best = own
            if round(stay, 12) < round(top, 12):
                close = value >= top - 2e-12
                best = min(c for c, x in zip(around[close].tolist(), value[close].tolist(), strict=True) if round(x, 12) == round(top, 12))
            of[best] += s
            if best != own:
                label[a] = best
                moved = True
                left = near[lo:hi][(around != best) & ~waiting[near[lo:hi]]]
                waiting[left] = True
                again += left.tolist()
        queue = again
    return moved


def leiden_partition(edges: DataFrame, max_size: int = 50, levels: int = 3) -> DataFrame:
    """(name, level, community): each connected component is partitioned in a task of its own; communities above max_size are divided again
    on the next level. Community ids are `component/number`, finer ones append `/number`."""
    graph = materialise(simple_graph(edges), "leiden-edges")
    labels = connected_components(graph, "source", "target")
    keyed = graph.join(labels.select(F.col("node").alias("source"), F.col("component")), "source")

    def solve(part: pa.Table) -> pa.Table:
        root = str(part["component"][0].as_py())
        names = pa.concat_arrays([*part["source"].chunks, *part["target"].chunks]).dictionary_encode()
        order = pc.sort_indices(names.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        ends, names = rank[names.indices.to_numpy()].reshape(2, -1), names.dictionary.take(order)
        out = []
        todo = [(root, 0, np.arange(len(names)), ends[0], ends[1], part["weight"].to_numpy().astype(np.float64))]
        del part, ends
        while todo:
            prefix, level, nodes, src, dst, weight = todo.pop()
            found = communities_of(src, dst, weight, len(nodes))
            sizes = np.bincount(found)
            titles = pa.array([f"{prefix}/{c}" for c in range(len(sizes))], pa.string())
            out.append(pa.table([names.take(pa.array(nodes)), pa.array(np.full(len(nodes), level, np.int32)), titles.take(pa.array(found))], schema=schema))
            if level + 1 < levels and len(sizes) > 1:
                for c in np.flatnonzero(sizes > max_size).tolist():
                    inner = (found[src] == c) & (found[dst] == c)
                    if inner.any():
                        own = np.unique(np.concatenate([src[inner], dst[inner]]))
                        todo.append((f"{prefix}/{c}", level + 1, nodes[own], np.searchsorted(own, src[inner]), np.searchsorted(own, dst[inner]), weight[inner]))
        return pa.concat_tables(out)

    schema = pa.schema([("name", pa.string()), ("level", pa.int32()), ("community", pa.string())])
    return keyed.select("component", "source", "target", "weight").groupBy("component").applyInArrow(solve, "name string, level int, community string")


def label_propagation(edges: DataFrame, seeds: DataFrame, cap: int = 50, rounds: int = 10) -> DataFrame:
    """(name, community): nodes without a community take the one that most neighbours have and that isn't full (ties by community); at most
    `cap` members, first by name. What is left after the rounds gets no row."""
    near = materialise(neighbours(simple_graph(edges)).select("a", "b"), "lp-edges")
    known = materialise(seeds.select("name", "community"), "lp-known")
    for _ in range(rounds):
        votes = near.join(known.select(F.col("name").alias("b"), "community"), "b").join(known.select(F.col("name").alias("a")), "a", "left_anti").groupBy("a", "community").agg(F.count("*").alias("n"))
        size = known.groupBy("community").agg(F.count("*").alias("size"))
        free = votes.join(size, "community").where(F.col("size") < cap)
        pick = free.groupBy("a", ).agg(F.max(F.struct("n", F.col("community").alias("c"))).alias("m")).select(F.col("a").alias("name"), F.col("m.c").alias("community"))
        w = Window.partitionBy("community").orderBy("name")
        fresh = pick.join(size, "community").withColumn("r", F.row_number().over(w)).where(F.col("r") + F.col("size") <= cap).select("name", "community")
        fresh = materialise(fresh, "lp-fresh")
        if fresh.isEmpty():
            break
        known = materialise(known.unionByName(fresh), "lp-known")
    return known


def merge_small(centroid_pairs: DataFrame, small: DataFrame) -> DataFrame:
    """DBSCAN with two as the least size is connected components of the pairs within reach: small (community) and pairs (a, b) give
    (community, merged), singles go to one bucket."""
    labels = connected_components(centroid_pairs, "a", "b")
    return small.join(labels, small["community"] == labels["node"], "left").select("community", F.coalesce(F.concat(F.lit("merged-"), F.col("component").cast("string")), F.lit("misc")).alias("merged"))


def greedy_modularity(edges: list[tuple[str, str]]) -> dict[str, int]:
    """Communities by merging, again and again, the two of largest gain in modularity until none gains (ties by name); unweighted edges."""
    names = sorted({x for e in edges for x in e})
    place = {x: i for i, x in enumerate(names)}
    ends = np.array([[place[a], place[b]] for a, b in edges], np.int64).reshape(-1, 2)
    root = merged_by_gain(ends[:, 0], ends[:, 1], len(names))
    return dict(zip(names, np.unique(root, return_inverse=True)[1].tolist(), strict=True))


def merged_by_gain(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """The same for nodes 0 to n - 1 in the order of their names: the least node of each one's community. A community has its neighbours as two arrays
    and one entry in the queue, its best merge when it last changed. A pair's gain only changes when one of the two is merged, and then that one is
    looked at anew; so an entry whose two sides haven't changed since is the best of all, and memory is in proportion to the edges."""
    key = np.unique(np.concatenate([src * n + dst, dst * n + src]))
    a, b = key // max(n, 1), key % max(n, 1)
    total, root = float(len(key)), np.arange(n)
    share = np.bincount(a, minlength=n) / max(total, 1.0)
    a, b = a[a != b], b[a != b]
    at = np.searchsorted(a, np.arange(n + 1))
    near, weight = np.split(b.astype(np.int32), at[1:-1]), np.split(np.ones(len(b), np.float32), at[1:-1])
    changed, seen = [0] * n, [0] * n  # how often a node was merged, and its best partner had been when it was looked at
    gain = 2 * (1.0 / max(total, 1.0) - share[a] * share[b])
    has = np.flatnonzero(np.diff(at))
    top = np.zeros(n)
    top[has] = np.maximum.reduceat(gain, at[has]) if len(has) else 0
    best = np.flatnonzero(gain == top[a])
    first = best[np.unique(a[best], return_index=True)[1]]
    heap = [(-g, min(x, y), max(x, y), x, 0) for g, x, y in zip(gain[first].tolist(), a[first].tolist(), b[first].tolist(), strict=True)]
    del key, a, b, gain, best, first, top
    heapq.heapify(heap)

    def look(x: int) -> None:
        own = near[x]
        to = root[own]
        while True:
            up = root[to]
            if np.array_equal(up, to):
                break
            to = up
        if len(own) and (np.any(to != own) or np.any(own[1:] <= own[:-1])):
            root[own] = to
            order = np.argsort(to, kind="stable")
            to, w = to[order], weight[x][order]
            start = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            to, w = to[start], np.add.reduceat(w, start)
            keep = to != x
            near[x], weight[x] = to[keep].astype(np.int32), w[keep]
        if len(near[x]):
            g = 2 * (weight[x].astype(np.float64) / total - share[x] * share[near[x]])
            k = int(np.argmax(g))
            y = int(near[x][k])
            seen[x] = changed[y]
            heapq.heappush(heap, (-float(g[k]), min(x, y), max(x, y), x, changed[x]))

    while heap:
        g, p, q, x, when = heapq.heappop(heap)
        if changed[x] != when:
            continue  # what was merged, or looked at again
        y = q if x == p else p
        if changed[y] != seen[x]:
            look(x)
            continue
        if -g <= 1e-12:
            break
        root[q] = p
        share[p] += share[q]
        near[p], weight[p] = np.concatenate([near[p], near[q]]), np.concatenate([weight[p], weight[q]])
        near[q] = weight[q] = None
        changed[p] += 1
        changed[q] = -1
        look(p)
    while not np.array_equal(root[root], root):
        root = root[root]
    return root


def split_folder(edges: DataFrame, members: DataFrame, least: int = 3, most_between: float = 0.5) -> DataFrame:
    """Folders that fall into two parts of `least` nodes or more with few edges between: community, part_a, part_b, within, between, ratio."""
    a, b = members.select(F.col("name").alias("source"), "community"), members.select(F.col("name").alias("target"), "community")
    inner = simple_graph(edges).join(a, "source").join(b, ["target", "community"])

    def solve(part: pa.Table) -> pa.Table:
        names = pa.concat_arrays([*part["source"].chunks, *part["target"].chunks]).dictionary_encode()
        order = pc.sort_indices(names.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        ends, names = rank[names.indices.to_numpy()].reshape(2, -1), names.dictionary.take(order)
        label = merged_by_gain(ends[0], ends[1], len(names))
        size = np.bincount(label, minlength=len(names))
        p, q = np.lexsort((np.arange(len(size)), -size))[:2].tolist()
        if size[q] < least:
            return pa.table([[]] * 6, schema=schema)
        x, y = label[ends[0]], label[ends[1]]
        within, between = int(((x == y) & ((x == p) | (x == q))).sum()), int((((x == p) & (y == q)) | ((x == q) & (y == p))).sum())
        ratio = between / max(1, within + between)
        if ratio > most_between:
            return pa.table([[]] * 6, schema=schema)
        part_a, part_b = (pa.array([names.filter(pa.array(label == k)).to_pylist()], pa.list_(pa.string())) for k in (p, q))
        return pa.table([part["community"][:1].cast(pa.string()), part_a, part_b, [within], [between], [ratio]], schema=schema)

    schema = pa.schema([("community", pa.string()), ("part_a", pa.list_(pa.string())), ("part_b", pa.list_(pa.string())), ("within", pa.int64()), ("between", pa.int64()), ("ratio", pa.float64())])
    return inner.select("community", "source", "target").groupBy("community").applyInArrow(solve, "community string, part_a array<string>, part_b array<string>, within long, between long, ratio double")
