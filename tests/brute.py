"""Plain Python versions of the operators, for small inputs."""

from collections import defaultdict, deque

import numpy as np


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return sorted((n, find(n)) for n in nodes)


def neighbors(edges):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    return near


def betweenness(nodes, edges):
    near = neighbors(edges)
    total = {tuple(sorted(e)): 0.0 for e in edges}
    for source in nodes:
        distance, paths, order, before = {source: 0}, defaultdict(float), [], defaultdict(list)
        paths[source] = 1.0
        queue = deque([source])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if w not in distance:
                    distance[w] = distance[v] + 1
                    queue.append(w)
                if distance[w] == distance[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        share = defaultdict(float)
        for w in reversed(order):
            for v in before[w]:
                part = paths[v] / paths[w] * (1 + share[w])
                total[tuple(sorted((v, w)))] += part / 2
                share[v] += part
    return total


def modularity(edges, label, weight=None):
    weight = weight or {e: 1.0 for e in edges}
    m = sum(weight.values())
    inside, total = defaultdict(float), defaultdict(float)
    for (a, b), w in weight.items():
        total[label[a]] += w
        total[label[b]] += w
        if label[a] == label[b]:
            inside[label[a]] += w
    return sum(inside[c] / m - (total[c] / (2 * m)) ** 2 for c in total)


def laplacian(values, affinity):
    """The matrix form, ``values`` being nodes by features."""
    x, w = np.asarray(values, float), np.asarray(affinity, float)
    d = w.sum(axis=1)
    ones = d @ x
    spread = (d[:, None] * x * x).sum(axis=0) - ones * ones / d.sum()
    within = (x * (w @ x)).sum(axis=0) - ones * ones / d.sum()
    return 1 - within / np.where(spread < 1e-12, 10000, spread)


def spec(values, gamma=1.0):
    """Through the eigenvectors of the normalised Laplacian."""
    x = np.asarray(values, float)
    w = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    d = w.sum(axis=1)
    root = np.sqrt(d)
    normal = np.eye(len(x)) - w / np.outer(root, root)
    eigen, vectors = np.linalg.eigh(normal)
    scores = []
    for f in x.T:
        f = root * f
        f = f / np.linalg.norm(f)
        cosines = (vectors.T @ f) ** 2
        scores.append((cosines[1:] * eigen[1:]).sum() / (1 - cosines[0]))
    return scores


def spec_by_pairs(values, gamma=1.0):
    x = np.asarray(values, float)
    w = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    d = w.sum(axis=1)
    cut = [(w * (f[:, None] - f[None]) ** 2).sum() / 2 for f in x.T]
    return [c / ((d * f * f).sum() - (d @ f) ** 2 / d.sum()) for c, f in zip(cut, x.T, strict=True)]


def glance(groups):
    """``groups`` maps a community to ``{node: [values]}``."""
    scores = {}
    for members in groups.values():
        n = len(members)
        width = len(next(iter(members.values())))
        means = [
            sum(abs(a[r] - b[r]) for a in members.values() for b in members.values()) / n**2 for r in range(width)
        ]
        for node, own in members.items():
            scores[node] = max(
                sum(abs(own[r] - other[r]) > means[r] for other in members.values()) / n for r in range(width)
            )
    return scores
