"""Graph metrics that need whole small networks: one network of at most a few hundred nodes per grouped-map call.

``weights="length"`` takes an edge's weight as its length, as path metrics of thresholded networks do (a strong
correlation is then a long edge); ``None`` counts hops.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIE = 1e-10


def adjacency(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> np.ndarray:
    m = np.zeros((n, n))
    m[src, dst] = m[dst, src] = w
    return m


def distances(m: np.ndarray, weights: str | None = "length") -> np.ndarray:
    """All shortest path lengths; inf between components."""
    d = np.where(m > 0, m if weights else 1.0, np.inf)
    np.fill_diagonal(d, 0)
    for k in range(len(d)):
        d = np.minimum(d, d[:, k : k + 1] + d[k : k + 1])
    return d


def component_labels(m: np.ndarray) -> np.ndarray:
    """Smallest node index of each node's component."""
    label = np.arange(len(m))
    while True:
        near = np.where(m > 0, label[None, :], len(m)).min(1, initial=len(m))
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def path_counts(m: np.ndarray, d: np.ndarray, weights: str | None = "length") -> np.ndarray:
    """Number of shortest paths between all nodes; lengths within TIE are equal."""
    n = len(m)
    length = np.where(m > 0, m if weights else 1.0, np.inf)
    sigma = np.eye(n)
    for s in range(n):
        for v in np.argsort(d[s], kind="stable"):
            if v != s and np.isfinite(d[s, v]):
                before = np.isclose(d[s] + length[:, v], d[s, v], rtol=0, atol=TIE)
                sigma[s, v] = sigma[s, before].sum()
    return sigma


def betweenness(m: np.ndarray, weights: str | None = "length") -> tuple[np.ndarray, np.ndarray]:
    """(node betweenness, edge betweenness), neither normalised, each pair of nodes once."""
    n, d = len(m), distances(m, weights)
    sigma = path_counts(m, d, weights)
    length = np.where(m > 0, m if weights else 1.0, np.inf)
    node, edge = np.zeros(n), np.zeros((n, n))
    for s in range(n):
        for t in range(s + 1, n):
            if not np.isfinite(d[s, t]):
                continue
            on = np.isclose(d[s] + d[t], d[s, t], rtol=0, atol=TIE)
            share = np.where(on, sigma[s] * sigma[t] / sigma[s, t], 0)
            share[[s, t]] = 0
            node += share
            step = np.isclose(d[s][:, None] + length + d[t][None, :], d[s, t], rtol=0, atol=TIE)
            edge += np.where(step, sigma[s][:, None] * sigma[t][None, :] / sigma[s, t], 0)
    return node, edge + edge.T


def eigenvector(m: np.ndarray) -> np.ndarray:
    """Centrality of the leading eigenvector, largest 1; of equal eigenvalues, the component of the smallest node."""
    n = len(m)
    if not n or not (m > 0).any():
        return np.zeros(n)
    label, best, out = component_labels(m), -1.0, np.zeros(n)
    for c in np.unique(label):
        own = np.flatnonzero(label == c)
        values, vectors = np.linalg.eigh(m[np.ix_(own, own)])
        if values[-1] > best + 1e-9:
            best, v = values[-1], np.abs(vectors[:, -1])
            out = np.zeros(n)
            out[own] = v / v.max()
    return out


def pagerank(m: np.ndarray, damping: float = 0.85) -> np.ndarray:
    n = len(m)
    s = m.sum(1)
    p = np.where(s[:, None] > 0, m / np.where(s, s, 1)[:, None], 1 / n)
    return np.linalg.solve(np.eye(n) - damping * p.T, np.full(n, (1 - damping) / n))


def louvain(m: np.ndarray) -> tuple[np.ndarray, float]:
    """(community labels, modularity), nodes visited in order so that reruns agree."""
    total = m.sum()
    if total == 0:
        return np.arange(len(m)), 0.0
    members = np.arange(len(m))
    level = m.copy()
    while True:
        n = len(level)
        community, degree = np.arange(n), level.sum(1)
        sums, moved_any, moved = degree.copy(), False, True
        while moved:
            moved = False
            for v in range(n):
                own = community[v]
                sums[own] -= degree[v]
                links = np.bincount(community, level[v] * (np.arange(n) != v), n)
                gain = links - degree[v] * sums / total
                best = int(np.argmax(gain))
                if gain[best] <= gain[own] + 1e-12:
                    best = own
                sums[best] += degree[v]
                if best != own:
                    community[v], moved, moved_any = best, True, True
        _, community = np.unique(community, return_inverse=True)
        members = community[members]
        if not moved_any:
            break
        k = community.max() + 1
        onto = np.eye(k)[community]
        level = onto.T @ level @ onto
    return members, modularity(m, members)


def modularity(m: np.ndarray, members: np.ndarray) -> float:
    total = m.sum()
    if total == 0:
        return 0.0
    onto = np.eye(members.max() + 1)[members]
    inside = np.diag(onto.T @ m @ onto) / total
    return float((inside - ((onto.T @ m).sum(1) / total) ** 2).sum())


def transitivity(m: np.ndarray) -> float:
    a = (m > 0).astype(float)
    k = a.sum(1)
    triples = (k * (k - 1)).sum()
    return float(np.trace(a @ a @ a) / triples) if triples else 0.0


def mean_distance(m: np.ndarray, weights: str | None = "length") -> float:
    """Mean over all pairs; inf for a disconnected or empty network."""
    n = len(m)
    if n < 2:
        return np.inf
    d = distances(m, weights)[np.triu_indices(n, 1)]
    return float(d.mean()) if np.isfinite(d).all() else np.inf


def small_world_sigma(m: np.ndarray, seed: int = 42) -> float:
    """(C / C_random) / (L / L_random) against one seeded random graph of as many nodes and edges; 0 if undefined."""
    n, edges = len(m), int((m > 0).sum() // 2)
    i, j = np.triu_indices(n, 1)
    pick = np.random.default_rng(seed).permutation(len(i))[:edges]
    random = adjacency(n, i[pick], j[pick], np.ones(edges))
    c, cr, length, lr = transitivity(m), transitivity(random), mean_distance(m), mean_distance(random, None)
    return float((c / cr) / (length / lr)) if cr > 0 and np.isfinite(length) and np.isfinite(lr) and length > 0 else 0.0


def spanning_tree(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> list[int]:
    """Edges of a minimum spanning forest, by (w, i, j)."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for e in sorted(range(len(w)), key=lambda e: (w[e], i[e], j[e])):
        a, b = find(int(i[e])), find(int(j[e]))
        if a != b:
            root[a] = b
            kept.append(e)
    return kept


def _matrices(pdf: pd.DataFrame, nodes: list[str]) -> np.ndarray:
    at = {x: k for k, x in enumerate(nodes)}
    return adjacency(len(nodes), pdf["src"].map(at).to_numpy(int), pdf["dst"].map(at).to_numpy(int), pdf["w"].to_numpy(float))


def node_metrics(edges: DataFrame, nodes: list[str], key=("method", "grp"), weights: str | None = "length") -> DataFrame:
    """(key, node, betweenness, closeness, eigenvector, pagerank, community) of every network that has edges."""

    def run(k, pdf: pd.DataFrame) -> pd.DataFrame:
        m = _matrices(pdf, nodes)
        n, d = len(m), distances(m, weights)
        whole = np.isfinite(d).all()
        closeness = (n - 1) / d.sum(1) if whole and n > 1 else np.zeros(n)
        between = betweenness(m, weights)[0] / ((n - 1) * (n - 2) / 2) if n > 2 else np.zeros(n)
        out = pd.DataFrame({"node": nodes, "betweenness": between, "closeness": closeness, "eigenvector": eigenvector(m), "pagerank": pagerank(m), "community": louvain(m)[0]})
        return pd.DataFrame({name: [v] * n for name, v in zip(key, k, strict=True)}).join(out)

    types = ", ".join(f"{c} {t}" for c, t in edges.select(*key).dtypes)
    return edges.groupBy(*key).applyInPandas(run, f"{types}, node string, betweenness double, closeness double, eigenvector double, pagerank double, community int")


def global_metrics(edges: DataFrame, nodes: list[str], key=("method", "grp"), weights: str | None = "length") -> DataFrame:
    """(key, n_nodes, n_edges, density, connected, clustering, path_length, sigma, modularity, diameter, n_components)."""

    def run(k, pdf: pd.DataFrame) -> pd.DataFrame:
        m = _matrices(pdf, nodes)
        n, e = len(m), len(pdf)
        d = distances(m, weights)
        whole = bool(np.isfinite(d).all())
        row = {"n_nodes": n, "n_edges": e, "density": 2 * e / (n * (n - 1)) if n > 1 else 0.0, "connected": whole, "clustering": transitivity(m), "path_length": mean_distance(m, weights), "sigma": small_world_sigma(m), "modularity": louvain(m)[1], "diameter": float(d.max()) if whole else 0.0, "n_components": len(np.unique(component_labels(m)))}
        return pd.DataFrame([dict(zip(key, k, strict=True)) | row])

    types = ", ".join(f"{c} {t}" for c, t in edges.select(*key).dtypes)
    return edges.groupBy(*key).applyInPandas(run, f"{types}, n_nodes int, n_edges int, density double, connected boolean, clustering double, path_length double, sigma double, modularity double, diameter double, n_components int")


def singular(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Singular value decomposition (u, s, vt) of a square matrix; by the eigenvectors of x'x where the iteration fails."""
    try:
        return np.linalg.svd(x, full_matrices=False)
    except np.linalg.LinAlgError:
        v = np.linalg.eigh(x.T @ x)[1][:, ::-1]
        s = np.linalg.norm(x @ v, axis=0)
        return x @ v / np.where(s > 0, s, 1), s, v.T


def pca(corr: DataFrame, nodes: list[str], key=("method", "grp")) -> DataFrame:
    """(key, component, node, loading, score, variance, share, cumulative) of the correlation matrix's rows, centred and
    scaled; signs so that a component's largest loading is positive."""

    def run(k, pdf: pd.DataFrame) -> pd.DataFrame:
        at = {x: i for i, x in enumerate(nodes)}
        m = np.eye(len(nodes))
        for i, j, r in zip(pdf["i"], pdf["j"], pdf["r"], strict=True):
            m[at[i], at[j]] = m[at[j], at[i]] = r if r is not None and np.isfinite(r) else 0.0
        sd = m.std(0, ddof=1)
        u, s, vt = singular((m - m.mean(0)) / np.where(sd > 0, sd, 1))
        sign = np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(1)])
        vt, u = vt * sign[:, None], u * sign
        variance = s**2 / (len(nodes) - 1)
        share = variance / variance.sum()
        rows = [{"component": c + 1, "node": node, "loading": vt[c, v], "score": u[v, c] * s[c], "variance": variance[c], "share": share[c], "cumulative": share[: c + 1].sum()} for c in range(len(s)) for v, node in enumerate(nodes)]
        return pd.DataFrame(rows).assign(**dict(zip(key, k, strict=True)))[[*key, "component", "node", "loading", "score", "variance", "share", "cumulative"]]

    types = ", ".join(f"{c} {t}" for c, t in corr.select(*key).dtypes)
    return corr.groupBy(*key).applyInPandas(run, f"{types}, component int, node string, loading double, score double, variance double, share double, cumulative double")
