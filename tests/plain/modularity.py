"""Modularity in one task, node by node: what the distributed forms are held against."""

import heapq

import numpy as np


def louvain_labels(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, resolution: float = 1.0) -> dict[int, int]:
    """Modularity by local moves and aggregation, nodes in order, so that the result is always the same. Label: the smallest member."""
    names = np.unique(np.concatenate((src, dst)))
    member = {int(n): i for i, n in enumerate(names)}
    graph: list[dict[int, float]] = [{} for _ in names]
    for a, b, w in zip(src, dst, weight, strict=True):
        i, j = member[int(a)], member[int(b)]
        graph[i][j] = graph[i].get(j, 0.0) + w
        graph[j][i] = graph[j].get(i, 0.0) + w
    where = np.arange(len(names))
    loops = [0.0] * len(graph)
    total = float(weight.sum()) or 1.0
    while True:
        degree = [sum(g.values()) + 2 * s for g, s in zip(graph, loops, strict=True)]
        comm, size = list(range(len(graph))), list(degree)
        moved = again = True
        moved = False
        while again:
            again = False
            for i, g in enumerate(graph):
                near: dict[int, float] = {}
                for j, w in g.items():
                    near[comm[j]] = near.get(comm[j], 0.0) + w
                own = comm[i]
                size[own] -= degree[i]
                gain = lambda c: near.get(c, 0.0) - resolution * size[c] * degree[i] / (2 * total)
                best = own
                for c in sorted(near):
                    if gain(c) > gain(best) + 1e-12:
                        best = c
                size[best] += degree[i]
                if best != own:
                    comm[i], again, moved = best, True, True
        if not moved:
            break
        number = {c: k for k, c in enumerate(sorted(set(comm)))}
        new: list[dict[int, float]] = [{} for _ in number]
        new_loops = [0.0] * len(number)
        for i, g in enumerate(graph):
            a = number[comm[i]]
            new_loops[a] += loops[i]
            for j, w in g.items():
                b = number[comm[j]]
                if a == b:
                    new_loops[a] += w / 2
                else:
                    new[a][b] = new[a].get(b, 0.0) + w
        where = np.array([number[comm[k]] for k in where])
        graph, loops = new, new_loops
    least: dict[int, int] = {}
    for n, k in zip(names, where, strict=True):
        least[int(k)] = min(least.get(int(k), int(n)), int(n))
    return {int(n): least[int(k)] for n, k in zip(names, where, strict=True)}


def greedy_labels(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, resolution: float = 1.0) -> dict[int, int]:
    """Modularity by merging, again and again, the two groups whose union gains most. Label: the smallest member."""
    names = np.unique(np.concatenate((src, dst)))
    total = float(weight.sum()) or 1.0
    between: dict[int, dict[int, float]] = {int(n): {} for n in names}
    for a, b, w in zip(src.tolist(), dst.tolist(), weight.tolist(), strict=True):
        between[a][b] = between[a].get(b, 0.0) + w
        between[b][a] = between[b].get(a, 0.0) + w
    degree = {n: sum(g.values()) for n, g in between.items()}
    gain = lambda a, b: between[a][b] / total - resolution * degree[a] * degree[b] / (2 * total * total)
    heap = [(-gain(a, b), a, b) for a, g in between.items() for b in g if a < b]
    heapq.heapify(heap)
    label = {n: n for n in between}
    while heap:
        g, a, b = heapq.heappop(heap)
        if g >= -1e-12:
            break
        if a not in between or b not in between or b not in between[a] or abs(g + gain(a, b)) > 1e-12:
            continue  # one of them has grown since; its new pairs are in the heap too
        label[b] = a
        for c, w in between.pop(b).items():
            if c == a:
                continue
            between[a][c] = between[c][a] = between[a].get(c, 0.0) + w
            del between[c][b]
        del between[a][b]
        degree[a] += degree.pop(b)
        for c in between[a]:
            heapq.heappush(heap, (-gain(a, c), min(a, c), max(a, c)))

    def root(n: int) -> int:
        while label[n] != n:
            n = label[n]
        return n

    return {n: root(n) for n in label}
