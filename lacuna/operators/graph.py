"""Multi-relational gap graph: edges, communities, edge betweenness, bridges and frontier.

Edges are a table ``src, dst, weight, edge_type, cosine`` with ``src < dst``. Everything
that is relational is a plan over it. Louvain communities and Brandes betweenness are
sequential by nature: they run per connected component in a grouped task. No edge leaves
a component, so with the global edge weight as a literal the split is exact. A component is
worked on as arrays, whatever its size; one above ``most_edges``, if that is given, is
refused instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.numeric import share
from lacuna.operators import similarity
from lacuna.operators.components import connected_components
from lacuna.operators.rows import numbered, share_of_max
from lacuna.session import kept, read_arrays, remove, shared_folder, write_arrays

#: Weight of a semantic edge per cosine, of a common paper, and of a common section per cosine.
WEIGHTS = {"semantic": 1.0, "paper": 0.5, "section": 0.3}
#: Edges of a component that one task takes, at most; None: any number.
MOST_EDGES: int | None = None
#: Tasks that share the sources of a component in edge betweenness.
SOURCE_PARTS = 24
#: Edges from which a component is worked on by arrays instead of lists.
LIST_EDGES = 64
#: Nodes, each counted once per source, that are worked on at once.
SOURCE_CELLS = 131_072
#: Edges from which a component is shared by tasks, and edges whose sums are one row.
ARRAY_EDGES, EDGE_BLOCK = 20_000, 65_536


def knn_edges(df: DataFrame, key: str, k: int = 8, least: float = 0.45, vector: str = "embedding", indexed: bool = False) -> DataFrame:
    """``src, dst, cosine``: pairs of which one is among the other's ``k`` nearest with ``least`` or more; ``indexed`` searches the nearest cells only."""
    search = similarity.nearest_indexed if indexed else similarity.nearest
    d = search(df, df, k, key, key, vector, least, not_self=True)
    return d.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "cosine").distinct()


def merge_relations(semantic: DataFrame, paper: DataFrame, section: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """One edge per pair: the greatest weight of its relations, their names joined, the greatest cosine."""
    w = WEIGHTS | (weights or {})
    parts = [
        semantic.select("src", "dst", (F.col("cosine") * w["semantic"]).alias("weight"), F.lit("1semantic").alias("t"), "cosine"),
        paper.select("src", "dst", F.lit(w["paper"]).alias("weight"), F.lit("2paper").alias("t"), "cosine"),
        section.select("src", "dst", (F.col("cosine") * w["section"]).alias("weight"), F.lit("3section").alias("t"), "cosine"),
    ]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    names = F.transform(F.array_sort(F.collect_set("t")), lambda x: F.substring(x, 2, 20))
    return u.groupBy("src", "dst").agg(F.round(F.max("weight"), 8).alias("weight"), F.array_join(names, "+").alias("edge_type"), F.max("cosine").alias("cosine"))


def merged_relations(df: DataFrame, key: str, paper: str, section: str, k: int = 8, least: float = 0.45, least_section: float = 0.3, vector: str = "embedding", weights: dict[str, float] | None = None) -> DataFrame:
    """What ``merge_relations`` gives for the nearest rows, the pairs of a paper and the similar pairs of a section, without gathering pairs.

    The pairs of a section grow with the square of its rows, so they are not shuffled: the
    task that makes a pair tells its other relations by the papers of both ends and by the
    last of the ``k`` nearest of each. Every pair comes from one of the three joins only.
    Keys must be unique; null and empty papers and sections are none.
    """
    w = WEIGHTS | (weights or {})
    # 0 is no paper and no section
    code = lambda c: F.when(F.col(c) != "", F.xxhash64(c)).otherwise(F.lit(0))
    rows = df.select(F.col(key).cast("bigint").alias("node"), F.col(vector).alias("vector"), F.col(paper).alias("paper"), F.col(section).alias("section"), code(paper).alias("p"), code(section).alias("s"))
    near = similarity.nearest(rows, rows, k, "node", "node", "vector", least, not_self=True, tags=("p", "s"))
    last = near.where(F.col("rank") == k).select(F.col("a").alias("node"), F.col("cosine").alias("bar"), F.col("b").alias("last"))
    rows = rows.join(last, "node", "left").fillna({"bar": -1.0, "last": 2**63 - 1})

    def is_near(x: dict[str, np.ndarray], y: dict[str, np.ndarray], c: np.ndarray) -> np.ndarray:
        hit = lambda a, b: (c > a["bar"]) | ((c == a["bar"]) & (b["id"] <= a["last"]))
        return (c >= least) & (hit(x, y) | hit(y, x))

    def of_section(x: dict[str, np.ndarray], y: dict[str, np.ndarray], c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.ones(len(c), bool), 4 + 2 * ((x["p"] == y["p"]) & (x["p"] != 0)) + is_near(x, y, c)

    def of_paper(x: dict[str, np.ndarray], y: dict[str, np.ndarray], c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return ~((x["s"] == y["s"]) & (x["s"] != 0) & (c >= least_section)), 2 + is_near(x, y, c)

    parts = [
        similarity.keyed_pairs(rows, "node", "section", "vector", least_section, more=("bar", "last", "p", "s"), judge=of_section),
        similarity.keyed_pairs(rows, "node", "paper", "vector", more=("bar", "last", "p", "s"), judge=of_paper),
        near.where(~F.col("same_p") & ~(F.col("same_s") & (F.col("cosine") >= least_section))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cosine").distinct().withColumn("code", F.lit(1)),
    ]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    has = lambda bit, x: F.when(F.col("code").bitwiseAND(bit) != 0, x)
    weight = F.greatest(has(1, F.col("cosine") * w["semantic"]), has(2, F.lit(w["paper"])), has(4, F.col("cosine") * w["section"]))
    return u.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.round(weight, 8).alias("weight"), F.concat_ws("+", has(1, F.lit("semantic")), has(2, F.lit("paper")), has(4, F.lit("section"))).alias("edge_type"), "cosine")


def _by_component(edges: DataFrame, most_edges: int | None) -> tuple[DataFrame, str]:
    """``component, src, dst, weight``, materialised, and its folder."""
    comp = connected_components(edges, "src", "dst")
    d, folder = kept(edges.join(comp, edges.src == comp.node).select("component", "src", "dst", "weight"))
    if most_edges is not None:
        big = d.groupBy("component").count().agg(F.max("count")).first()[0] or 0
        if big > most_edges:
            raise ValueError(f"a component of {big} edges exceeds the {most_edges} one task takes; raise the similarity threshold or use label_communities")
    return d, folder


def _numbered_ends(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, numbers of the one ends, of the other), without sorting all ends at once."""
    nodes = np.union1d(np.unique(src), np.unique(dst))
    return nodes, np.searchsorted(nodes, src).astype(np.int32), np.searchsorted(nodes, dst).astype(np.int32)


def _adjacent(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the first link of each node, other ends, edges): links by node, those of a node in the order of the edges."""
    e = len(a)
    start = np.concatenate([a, b])
    order = np.argsort(start, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(start, minlength=n))])
    del start
    to = np.concatenate([b, a]).astype(np.int32)[order]
    order %= max(1, e)
    return first, to, order.astype(np.int32)


class _Links:
    """Neighbours of every node with the weight of their edges, in arrays; a dictionary is made only of those of the node asked for."""

    def __init__(self, a: np.ndarray, b: np.ndarray, weight: np.ndarray, n: int) -> None:
        self.first, self.to, edge = _adjacent(a, b, n)
        self.weight = weight[edge]

    def __len__(self) -> int:
        return len(self.first) - 1

    def __getitem__(self, v: int) -> dict[int, float]:
        i, j = self.first[v], self.first[v + 1]
        to, weight = self.to[i:j].tolist(), self.weight[i:j].tolist()
        got = dict(zip(to, weight))
        if len(got) < len(to):
            got = {}
            for u, w in zip(to, weight):
                got[u] = got.get(u, 0.0) + w
        return got


def louvain(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, total: float, resolution: float = 1.0, levels: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, community) of greatest modularity gain, in id order; ties take the smaller community. ``total`` is the weight of all edges of the graph."""
    nodes, a, b = _numbered_ends(src, dst)
    member = np.arange(len(nodes))
    links: list[dict[int, float]] | _Links = _Links(a, b, weight, len(nodes))
    loops = [0.0] * len(nodes)
    m2 = 2 * total
    for _ in range(levels):
        size = len(links)
        degree = [sum(links[v].values()) + 2 * loops[v] for v in range(size)]
        comm, tot = list(range(size)), degree[:]
        moved_any = False
        for _ in range(50):
            moved = False
            for v in range(size):
                old = comm[v]
                to: dict[int, float] = {}
                for u, w in links[v].items():
                    to[comm[u]] = to.get(comm[u], 0.0) + w
                tot[old] -= degree[v]
                best, gain = old, to.get(old, 0.0) - resolution * degree[v] * tot[old] / m2
                for c in sorted(to):
                    g = to[c] - resolution * degree[v] * tot[c] / m2
                    if g > gain + 1e-12:
                        best, gain = c, g
                tot[best] += degree[v]
                if best != old:
                    comm[v], moved, moved_any = best, True, True
            if not moved:
                break
        if not moved_any:
            break
        names = {c: k for k, c in enumerate(sorted(set(comm)))}
        comm = [names[c] for c in comm]
        member = np.array(comm)[member]
        new: list[dict[int, float]] = [{} for _ in names]
        new_loops = [0.0] * len(names)
        for v in range(size):
            new_loops[comm[v]] += loops[v]
            for u, w in links[v].items():
                if comm[u] == comm[v]:
                    new_loops[comm[v]] += w / 2
                else:
                    new[comm[v]][comm[u]] = new[comm[v]].get(comm[u], 0.0) + w
        links, loops = new, new_loops
    return nodes, member


def communities(edges: DataFrame, resolution: float = 1.0, most_edges: int | None = MOST_EDGES) -> DataFrame:
    """``node, community``: Louvain communities by weight, each named by its smallest node.

    Deterministic: the same edges give the same communities whatever their order or
    partitions. Nodes without an edge are not listed.
    """
    total = edges.agg(F.sum("weight")).first()[0]
    if not total:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("community")).limit(0)

    def run(t: pa.Table) -> pa.Table:
        src, dst, weight = (t[c].to_numpy() for c in ("src", "dst", "weight"))
        order = np.lexsort((dst, src))
        nodes, member = louvain(src[order], dst[order], weight[order], float(total), resolution)
        # nodes ascend, so the first of a community is its smallest
        _, first, at = np.unique(member, return_index=True, return_inverse=True)
        return pa.table({"node": nodes, "community": nodes[first][at]})

    d, folder = _by_component(edges, most_edges)
    got, _ = kept(d.select("component", "src", "dst", "weight").groupBy("component").applyInArrow(run, "node bigint, community bigint"))
    remove(folder)
    return got


def label_communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """``node, community`` by weighted label propagation: coarser, but a plain plan for components of any size."""
    from lacuna.session import cut

    both = cut(edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")))
    label = both.select(F.col("src").alias("node"), F.col("src").alias("community")).distinct()
    for _ in range(rounds):
        votes = both.join(label, both.dst == label.node).groupBy("src", "community").agg(F.sum("weight").alias("w"))
        label = cut(votes.groupBy("src").agg(F.max_by("community", F.struct(F.round("w", 9), -F.col("community"))).alias("community")).withColumnRenamed("src", "node"))
    return label


def renumber(members: DataFrame, nodes: DataFrame, paper: str = "id") -> DataFrame:
    """``node, cluster_id``: communities numbered from 0 by papers, then members, then old name. ``nodes`` has ``node`` and the paper."""
    size = members.join(nodes, "node").groupBy("community").agg(F.countDistinct(paper).alias("p"), F.count(F.lit(1)).alias("n"))
    names = numbered(size, F.desc("p"), F.desc("n"), F.col("community"), name="cluster_id")
    return members.join(names.select("community", F.col("cluster_id").cast("int").alias("cluster_id")), "community").select("node", "cluster_id")


def brandes(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(src, dst, sum over all sources of the share of shortest paths through the edge), unweighted."""
    nodes, a, b = _numbered_ends(src, dst)
    work = _by_lists if len(src) < LIST_EDGES else _by_arrays
    return src, dst, work(a, b, len(nodes), np.arange(len(nodes)))


def _by_lists(a: np.ndarray, b: np.ndarray, n: int, chosen: np.ndarray) -> np.ndarray:
    """Scores of the edges, a source at a time."""
    adj: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist())):
        adj[i].append((j, k))
        adj[j].append((i, k))
    score = np.zeros(len(a))
    for s in chosen.tolist():
        dist, sigma = [-1] * n, [0.0] * n
        dist[s], sigma[s] = 0, 1.0
        queue = [s]
        for v in queue:
            for u, _ in adj[v]:
                if dist[u] < 0:
                    dist[u] = dist[v] + 1
                    queue.append(u)
                if dist[u] == dist[v] + 1:
                    sigma[u] += sigma[v]
        delta = [0.0] * n
        for v in reversed(queue):
            for u, k in adj[v]:
                if dist[u] == dist[v] - 1:
                    c = sigma[u] / sigma[v] * (1 + delta[v])
                    score[k] += c
                    delta[u] += c
    return score


def _by_arrays(a: np.ndarray, b: np.ndarray, n: int, chosen: np.ndarray) -> np.ndarray:
    """As ``_by_lists``, all edges of a distance at once: a few bytes an edge."""
    return _over_links(*_adjacent(a, b, n), chosen)


def _over_links(first: np.ndarray, to: np.ndarray, edge: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Several sources at once, each with nodes of its own numbers, so that small components and long chains take few steps."""
    n, score = len(first) - 1, np.zeros(len(to) // 2)
    number = np.int32 if len(to) < 2**31 else np.int64
    degree, first, steps = np.diff(first).astype(number), first[:-1].astype(number), np.arange(0, dtype=number)
    width = max(1, SOURCE_CELLS // max(1, n, len(to) // 8))
    for i in range(0, len(chosen), width):
        some = chosen[i : i + width]
        alone, size = len(some) == 1, n * len(some)
        dist, sigma = np.full(size, -1, np.int32), np.zeros(size)
        front, rings = (np.arange(len(some)) * n + some).astype(number), []
        dist[front], sigma[front] = 0, 1.0
        while len(front):
            node = front if alone else front % n
            count = degree[node]
            end = np.cumsum(count, dtype=number)
            if end[-1] > len(steps):
                steps = np.arange(end[-1], dtype=number)
            at = np.repeat(first[node] - end + count, count)
            at += steps[: end[-1]]
            u = to[at] if alone else to[at] + np.repeat(front - node, count)
            new = np.flatnonzero(dist[u] < 0)
            v, u, k = np.repeat(front, count)[new], u[new], edge[at[new]]
            np.add.at(sigma, u, sigma[v])
            rings.append((v, u, k))
            dist[u] = len(rings)
            front = np.flatnonzero(dist == len(rings)).astype(number) if 16 * len(u) > size else np.unique(u)
        delta = np.zeros(size)
        for v, u, k in reversed(rings):
            c = sigma[v] / sigma[u] * (1 + delta[u])
            np.add.at(score, k, c)
            np.add.at(delta, v, c)
    return score


def edge_betweenness(edges: DataFrame, n_nodes: int | None = None, most_edges: int | None = MOST_EDGES) -> DataFrame:
    """``src, dst, betweenness``: unweighted, normalised with the number of all nodes.

    Every node is a source, so the work is the nodes of a component times its edges.
    The sources of a component from ``ARRAY_EDGES`` edges on are shared by ``SOURCE_PARTS``
    tasks, which map its links from files that one task writes, and give their sums in
    packed blocks.
    """
    n = n_nodes if n_nodes is not None else edges.select(F.explode(F.array("src", "dst"))).distinct().count()
    scale = n * (n - 1) if n > 1 else 1
    spark, folder = edges.sparkSession, shared_folder(edges.sparkSession)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["src", "dst"])
        s, d, x = brandes(pdf.src.to_numpy(), pdf.dst.to_numpy())
        return pd.DataFrame({"src": s, "dst": d, "x": x})

    def links(t: pa.Table) -> pa.Table:
        component, src, dst = t["component"][0].as_py(), t["src"].to_numpy(), t["dst"].to_numpy()
        order = np.lexsort((dst, src))
        nodes, a, b = _numbered_ends(src[order], dst[order])
        del order, src, dst
        first, to, edge = _adjacent(a, b, len(nodes))
        write_arrays(folder, str(component), nodes=nodes, a=a, b=b, first=first, to=to, edge=edge)
        return pa.table({"component": pa.array([component], pa.int64())})

    d, edge_folder = _by_component(edges, most_edges)
    # one row per ``ARRAY_EDGES`` edges at most
    large = F.broadcast(d.groupBy("component").count().where(F.col("count") >= ARRAY_EDGES).select("component"))
    held = d.join(large, "component").select("component", "src", "dst").groupBy("component").applyInArrow(links, "component bigint").toArrow()["component"].to_pylist()
    got = d.join(large, "component", "left_anti").select("component", "src", "dst").groupBy("component").applyInPandas(one, "src bigint, dst bigint, x double")

    def run(component: int, part: int) -> Iterator[pa.RecordBatch]:
        nodes, a, b, first, to, edge = read_arrays(folder, str(component), "nodes", "a", "b", "first", "to", "edge")
        x = _over_links(first, to, edge, np.arange(part, len(nodes), SOURCE_PARTS))
        for i in range(0, len(x), EDGE_BLOCK):
            ends = None if part else np.concatenate([nodes[a[i : i + EDGE_BLOCK]], nodes[b[i : i + EDGE_BLOCK]]]).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([component], pa.int64()), pa.array([i], pa.int64()), pa.array([ends], pa.binary()), pa.array([x[i : i + EDGE_BLOCK].tobytes()], pa.binary())], names=["component", "block", "ends", "x"])

    def add(t: pa.Table) -> pa.Table:
        ends = np.frombuffer(next(e for e in t["ends"].to_pylist() if e is not None), np.int64)
        x = sum(np.frombuffer(y, np.float64) for y in t["x"].to_pylist())
        return pa.table({"src": ends[: len(x)], "dst": ends[len(x) :], "x": x})

    if held:
        packed = similarity.over_items(spark, [(c, p) for c in held for p in range(SOURCE_PARTS)], run, "component bigint, block bigint, ends binary, x binary")
        got = got.unionByName(packed.groupBy("component", "block").applyInArrow(add, "src bigint, dst bigint, x double"))
    done, _ = kept(got.select("src", "dst", F.round(F.col("x") / scale, 9).alias("betweenness")))
    remove(folder)
    remove(edge_folder)
    return done


def _ends(edges: DataFrame, labels: DataFrame) -> DataFrame:
    a = labels.select(F.col("node").alias("src"), F.col("cluster_id").alias("ca"))
    b = labels.select(F.col("node").alias("dst"), F.col("cluster_id").alias("cb"))
    return edges.join(a, "src").join(b, "dst")


def type_shares(gaps: DataFrame, cluster: str = "cluster_id", kind: str = "gap_type") -> DataFrame:
    """``cluster, kind, share`` of each kind within its cluster."""
    n = gaps.groupBy(cluster, kind).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(cluster))).select(cluster, kind, "share")


def pair_context(pairs: DataFrame, gaps: DataFrame, cluster: str = "cluster_id", paper: str = "id", kind: str = "gap_type") -> DataFrame:
    """Add ``paper_overlap`` (Jaccard of the papers) and ``type_complementarity`` (half the L1 distance of the kinds' shares) to ``cluster_a, cluster_b``."""
    papers = gaps.where(F.col(paper).isNotNull()).select(cluster, paper).distinct()
    size = papers.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    pa_, pb = papers.select(F.col(cluster).alias("cluster_a"), F.col(paper).alias("p")), papers.select(F.col(cluster).alias("cluster_b"), F.col(paper).alias("p"))
    common = pairs.select("cluster_a", "cluster_b").join(pa_, "cluster_a").join(pb, ["cluster_b", "p"]).groupBy("cluster_a", "cluster_b").agg(F.count(F.lit(1)).alias("both"))
    t = type_shares(gaps, cluster, kind)
    ta, tb = t.select(F.col(cluster).alias("cluster_a"), kind, F.col("share").alias("sa")), t.select(F.col(cluster).alias("cluster_b"), kind, F.col("share").alias("sb"))
    # sum of least shares: half the L1 distance of two distributions is 1 minus it
    met = pairs.select("cluster_a", "cluster_b").join(ta, "cluster_a").join(tb, ["cluster_b", kind]).groupBy("cluster_a", "cluster_b").agg(F.sum(F.least("sa", "sb")).alias("same"))
    d = pairs.join(common, ["cluster_a", "cluster_b"], "left").join(met, ["cluster_a", "cluster_b"], "left")
    d = d.join(size.select(F.col(cluster).alias("cluster_a"), F.col("n").alias("na")), "cluster_a", "left").join(size.select(F.col(cluster).alias("cluster_b"), F.col("n").alias("nb")), "cluster_b", "left")
    both = F.coalesce("both", F.lit(0))
    union = F.coalesce("na", F.lit(0)) + F.coalesce("nb", F.lit(0)) - both
    return d.withColumn("paper_overlap", F.round(both / F.greatest(F.lit(1), union), 6)).withColumn("type_complementarity", F.round(1 - F.coalesce("same", F.lit(0.0)), 6)).drop("both", "same", "na", "nb")


def bridge_pairs(edges: DataFrame, labels: DataFrame, gaps: DataFrame, betweenness: DataFrame, top: int = 30) -> DataFrame:
    """Pairs of communities by the betweenness of all edges between them, fewer common papers and other kinds; scores over the greatest."""
    d = _ends(edges.join(betweenness, ["src", "dst"]), labels).where("ca <> cb")
    p = d.groupBy(F.least("ca", "cb").alias("cluster_a"), F.greatest("ca", "cb").alias("cluster_b")).agg(F.sum("betweenness").alias("b"), F.round(F.avg("cosine"), 6).alias("cosine_sim"))
    # a row per pair of communities is kept, so that the shuffles of the edges are gone before the next joins, which read it several times
    p, _ = kept(p)
    p = pair_context(p, gaps.join(labels, gaps.node == labels.node).drop(labels.node))
    p = p.withColumn("raw", F.col("b") * (1 - F.col("paper_overlap")) * (0.5 + 0.5 * F.col("type_complementarity")))
    p = share_of_max(p, "raw", "bridge_score").withColumn("bridge_score", F.round("bridge_score", 6))
    return p.select("cluster_a", "cluster_b", "cosine_sim", "paper_overlap", "type_complementarity", "bridge_score").orderBy(F.desc("bridge_score"), "cluster_a", "cluster_b").limit(top)


def individual_bridges(edges: DataFrame, labels: DataFrame, betweenness: DataFrame, top: int = 50) -> DataFrame:
    """Single edges between communities by betweenness over the greatest."""
    # kept, as its joins would otherwise stand twice in the plan and their shuffles lie beside each other
    between, _ = kept(_ends(edges.join(betweenness, ["src", "dst"]), labels).where("ca <> cb").select("src", "dst", "ca", "cb", "cosine", "betweenness"))
    d = share_of_max(between, "betweenness", "bridge_score")
    return d.select("src", "dst", F.col("ca").alias("cluster_a"), F.col("cb").alias("cluster_b"), "cosine", "betweenness", F.round("bridge_score", 6).alias("bridge_score")).orderBy(F.desc("bridge_score"), "src", "dst").limit(top)


def frontier(edges: DataFrame, labels: DataFrame, nodes: DataFrame, top: int | None = 50) -> DataFrame:
    """Nodes with many neighbours in many other communities; ``nodes`` has ``node`` and ``confidence``.

    Score ``(1 - own share of the neighbours) * ln(1 + other communities) + 0.05 *
    confidence`` over the greatest; a node without edges has own share 0.
    """
    d = _ends(edges, labels)
    both = d.select(F.col("src").alias("node"), F.col("ca").alias("own"), F.col("cb").alias("other")).unionByName(d.select(F.col("dst").alias("node"), F.col("cb").alias("own"), F.col("ca").alias("other")))
    deg = both.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.count_if(F.col("own") == F.col("other")).alias("intra_degree"), F.countDistinct(F.when(F.col("own") != F.col("other"), F.col("other"))).alias("n_neighbour_clusters"))
    x = nodes.join(labels, "node").join(deg, "node", "left").fillna(0, ["degree", "intra_degree", "n_neighbour_clusters"])
    raw = (1 - share(F.col("intra_degree"), F.col("degree"))) * F.log1p("n_neighbour_clusters") + 0.05 * F.coalesce("confidence", F.lit(0.0))
    # kept, as the greatest is looked up first
    x, _ = kept(x.withColumn("raw", raw).select("node", "cluster_id", "confidence", "intra_degree", "n_neighbour_clusters", "raw"))
    x = share_of_max(x, "raw", "frontier_score").withColumn("frontier_score", F.round("frontier_score", 6))
    x = x.select("node", "cluster_id", "confidence", "intra_degree", "n_neighbour_clusters", "frontier_score")
    return x if top is None else x.orderBy(F.desc("frontier_score"), "node").limit(top)


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Weighted modularity of a labelling (``node, cluster_id``)."""
    m = edges.agg(F.sum("weight")).first()[0] or 0.0
    if not m:
        return 0.0
    d = _ends(edges, labels)
    inside = d.where("ca = cb").agg(F.sum("weight")).first()[0] or 0.0
    deg = d.select(F.col("ca").alias("c"), "weight").unionByName(d.select(F.col("cb").alias("c"), "weight")).groupBy("c").agg(F.sum("weight").alias("k")).agg(F.sum(F.col("k") * F.col("k"))).first()[0] or 0.0
    return float(inside / m - resolution * deg / (4 * m * m))
