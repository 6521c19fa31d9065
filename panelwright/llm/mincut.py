"""Two-label minimum cut on small sparse graphs, with whole-number capacities."""

from __future__ import annotations

from collections import deque


def settle(pull: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Labels of a minimum cut: True on the source side.

    ``pull[i]`` is the terminal capacity of node i, to the source if positive
    and to the sink if negative; ``edges`` are (i, j, capacity) for separating
    i and j. Of several minimum cuts the one with the fewest nodes on the
    source side is returned.

    A node whose pull exceeds all its edges has its label in every minimum
    cut; it is settled and its edges become pulls of its neighbours, again and
    again. Maximum flow decides what is left.
    """
    n = len(pull)
    pull = list(pull)
    beside: list[dict[int, int]] = [{} for _ in range(n)]
    for i, j, c in edges:
        if i != j and c > 0:
            beside[i][j] = beside[i].get(j, 0) + c
            beside[j][i] = beside[j].get(i, 0) + c
    hold = [sum(b.values()) for b in beside]
    label: list[bool | None] = [None] * n
    work = deque(range(n))
    while work:
        i = work.popleft()
        if label[i] is not None or abs(pull[i]) <= hold[i]:
            continue
        label[i] = pull[i] > 0
        for j, c in beside[i].items():
            if label[j] is None:
                pull[j] += c if label[i] else -c
                hold[j] -= c
                work.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        side = _flow(rest, pull, beside, label)
        for i in rest:
            label[i] = i in side
    return [bool(x) for x in label]


def _flow(nodes: list[int], pull: list[int], beside: list[dict[int, int]], label: list[bool | None]) -> set[int]:
    """Nodes on the source side of a maximum flow, by blocking flows on level graphs."""
    inner = set(nodes)
    room = {i: {j: c for j, c in beside[i].items() if j in inner} for i in nodes}
    give = {i: pull[i] for i in nodes if pull[i] > 0}
    take = {i: -pull[i] for i in nodes if pull[i] < 0}
    while True:
        level = {i: 0 for i, c in give.items() if c}
        queue = deque(level)
        reached = False
        while queue:
            i = queue.popleft()
            if take.get(i):
                reached = True
            for j, c in room[i].items():
                if c and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if not reached:
            return set(level)
        arcs = {i: [j for j in room[i] if level.get(j) == level[i] + 1] for i in level}
        for start in [i for i, c in give.items() if c]:
            path = [start]
            while path and give[start]:
                i = path[-1]
                if take.get(i):
                    steps = list(zip(path, path[1:]))
                    send = min(give[start], take[i], *(room[a][b] for a, b in steps))
                    give[start] -= send
                    take[i] -= send
                    for a, b in steps:
                        room[a][b] -= send
                        room[b][a] += send
                    full = next((k for k, (a, b) in enumerate(steps) if not room[a][b]), None)
                    if full is not None:  # back to the first edge without room
                        del path[full + 1 :]
                    continue
                while arcs[i] and not room[i][arcs[i][-1]]:
                    arcs[i].pop()
                if arcs[i]:
                    path.append(arcs[i][-1])
                else:  # nothing beyond this node: no later path need try it
                    path.pop()
                    if path:
                        arcs[path[-1]].pop()
