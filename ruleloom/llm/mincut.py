"""Minimum cuts of small graphs with two terminals."""

from __future__ import annotations

from collections import deque


def minimum_cut(source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes lie on the source's side of a minimum cut; of several such cuts, the one with fewest there.

    ``source[i]`` and ``sink[i]`` are the capacities from the source to node ``i``
    and from it to the sink; ``edges`` are ``(i, j, capacity)`` both ways.  Maximum
    flow by blocking flows over shortest paths (Dinic).
    """
    n = len(source)
    direct = [min(a, b) for a, b in zip(source, sink, strict=True)]  # flows straight through a node
    into = [a - d for a, d in zip(source, direct, strict=True)]
    out = [b - d for b, d in zip(sink, direct, strict=True)]
    near: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    room: list[int] = []
    for i, j, capacity in edges:
        if i != j and capacity > 0:
            near[i].append(len(to))
            near[j].append(len(to) + 1)
            to += [j, i]
            room += [capacity, capacity]
    while True:
        depth = [-1] * n
        queue = deque(i for i in range(n) if into[i] > 0)
        for i in queue:
            depth[i] = 0
        ended = None
        while queue:
            i = queue.popleft()
            if ended is not None and depth[i] >= ended:
                break
            if out[i] > 0:
                ended = depth[i]
                continue
            for e in near[i]:
                if room[e] > 0 and depth[to[e]] < 0:
                    depth[to[e]] = depth[i] + 1
                    queue.append(to[e])
        if ended is None:
            return [d >= 0 for d in depth]
        tried = [0] * n
        for begin in range(n):
            while into[begin] > 0 and depth[begin] == 0:
                path, i = [], begin
                while not (out[i] > 0 and depth[i] == ended):
                    while tried[i] < len(near[i]):
                        e = near[i][tried[i]]
                        if room[e] > 0 and depth[to[e]] == depth[i] + 1 and depth[i] < ended:
                            break
                        tried[i] += 1
                    else:
                        if not path:
                            i = -1
                            break
                        i = to[path.pop() ^ 1]
                        tried[i] += 1
                        continue
                    path.append(e)
                    i = to[e]
                if i < 0:
                    break
                flow = min([into[begin], out[i], *(room[e] for e in path)])
                into[begin] -= flow
                out[i] -= flow
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
