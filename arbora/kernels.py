"""Sequential graph algorithms on adjacency lists, for what one task can hold.

Used by the driver-side ``DAG`` and inside grouped Arrow kernels of the distributed ``Graph``.  Ties are
always broken by name (byte order, as Spark orders strings).
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Mapping

from arbora.errors import CycleError, GraphError, NodeNotFoundError


def byte_key(name: str) -> bytes:
    return name.encode("utf-8")


class Adjacency:
    """Names and parallel-edge adjacency (a bag), index based."""

    def __init__(self, names: Iterable[str], edges: Iterable[tuple[str, str]]):
        self.names = list(names)
        self.index = {n: i for i, n in enumerate(self.names)}
        self.out: list[list[int]] = [[] for _ in self.names]
        self.inc: list[list[int]] = [[] for _ in self.names]
        for a, b in edges:
            i, j = self.at(a), self.at(b)
            self.out[i].append(j)
            self.inc[j].append(i)
        order = sorted(range(len(self.names)), key=lambda i: byte_key(self.names[i]))
        self.place = [0] * len(order)
        for k, i in enumerate(order):
            self.place[i] = k
        self.by_name = order

    def at(self, name: str) -> int:
        try:
            return self.index[name]
        except KeyError:
            raise NodeNotFoundError(name) from None

    def label(self, ids: Iterable[int]) -> list[str]:
        return [self.names[i] for i in ids]

    # ---- orders ----

    def kahn(self) -> list[int]:
        """FIFO Kahn order; zeros and freed neighbours by name.  Raises CycleError on a cycle."""
        need = [len(x) for x in self.inc]
        queue = deque(i for i in self.by_name if not need[i])
        out = []
        while queue:
            i = queue.popleft()
            out.append(i)
            freed = []
            for j in self.out[i]:
                need[j] -= 1
                if not need[j]:
                    freed.append(j)
            queue.extend(sorted(freed, key=self.place.__getitem__))
        if len(out) < len(self.names):
            raise CycleError(self.label(self.a_cycle(need)))
        return out

    def a_cycle(self, need: list[int]) -> list[int]:
        """One cycle among the nodes that Kahn couldn't release."""
        left = {i for i, n in enumerate(need) if n}
        i = min(left, key=self.place.__getitem__)
        seen: dict[int, int] = {}
        walk: list[int] = []
        while i not in seen:
            seen[i] = len(walk)
            walk.append(i)
            i = min((j for j in self.inc[i] if j in left), key=self.place.__getitem__)
        return [*walk[seen[i] :], i][::-1]

    def depth_first(self) -> list[int]:
        """Reverse post-order, nodes and neighbours by name (iterative)."""
        self.kahn()
        done, state = [], [0] * len(self.names)
        for root in self.by_name:
            if state[root]:
                continue
            stack = [(root, iter(sorted(self.out[root], key=self.place.__getitem__)))]
            state[root] = 1
            while stack:
                i, rest = stack[-1]
                for j in rest:
                    if not state[j]:
                        state[j] = 1
                        stack.append((j, iter(sorted(self.out[j], key=self.place.__getitem__))))
                        break
                else:
                    done.append(i)
                    stack.pop()
        return done[::-1]

    def by_priority(self, priority: Mapping[str, float]) -> list[int]:
        """Ready node of highest priority first, ties by name."""
        need = [len(x) for x in self.inc]
        key = lambda i: (-priority.get(self.names[i], 0.0), self.place[i], i)
        heap = [key(i) for i, n in enumerate(need) if not n]
        heapq.heapify(heap)
        out = []
        while heap:
            i = heapq.heappop(heap)[2]
            out.append(i)
            for j in self.out[i]:
                need[j] -= 1
                if not need[j]:
                    heapq.heappush(heap, key(j))
        if len(out) < len(self.names):
            raise CycleError(self.label(self.a_cycle(need)))
        return out

    def levels(self) -> list[int]:
        """Longest number of hops from a root, per node."""
        lvl = [0] * len(self.names)
        for i in self.kahn():
            for j in self.out[i]:
                lvl[j] = max(lvl[j], lvl[i] + 1)
        return lvl

    def layers(self, priority: Mapping[str, float] | None = None) -> list[list[int]]:
        lvl = self.levels()
        out: list[list[int]] = [[] for _ in range(max(lvl, default=-1) + 1)]
        for i in self.by_name:
            out[lvl[i]].append(i)
        if priority is not None:
            out = [sorted(x, key=lambda i: (-priority.get(self.names[i], 0.0), self.place[i])) for x in out]
        return out

    def all_orders(self, limit: int | None) -> list[list[int]]:
        """Topological orders in name order by backtracking, ``limit`` at most; none of an empty graph."""
        self.kahn()
        found: list[list[int]] = []
        need = [len(x) for x in self.inc]
        done: list[int] = []
        # per place of the order, what may still stand there; a loop, so that depth is not bounded by the stack
        open_: list[Iterator[int]] = [iter([i for i in self.by_name if not need[i]])] if self.names else []
        while open_ and (limit is None or len(found) < limit):
            if len(done) == len(open_):  # come back to this place: take its last choice away
                i = done.pop()
                for j in self.out[i]:
                    need[j] += 1
                need[i] = 0
            i = next(open_[-1], None)
            if i is None:
                open_.pop()
                continue
            need[i] = -1
            for j in self.out[i]:
                need[j] -= 1
            done.append(i)
            if len(done) == len(self.names):
                found.append(list(done))
            else:
                open_.append(iter([j for j in self.by_name if not need[j]]))
        return found

    def reach(self, starts: Iterable[int], forward: bool = True, depth: int | None = None) -> set[int]:
        """Nodes within ``depth`` hops, starts included."""
        side = self.out if forward else self.inc
        seen, edge = set(starts), list(starts)
        step = 0
        while edge and (depth is None or step < depth):
            step += 1
            nxt = []
            for i in edge:
                for j in side[i]:
                    if j not in seen:
                        seen.add(j)
                        nxt.append(j)
            edge = nxt
        return seen

    def shortest(self, a: int, b: int) -> list[int] | None:
        """Fewest hops, then the smallest path by names."""
        far = {b: 0}
        edge = [b]
        while edge and a not in far:
            nxt = []
            for j in edge:
                for i in self.inc[j]:
                    if i not in far:
                        far[i] = far[j] + 1
                        nxt.append(i)
            edge = nxt
        if a not in far:
            return None
        path = [a]
        while path[-1] != b:
            here = far[path[-1]]
            path.append(min((j for j in self.out[path[-1]] if far.get(j, -1) == here - 1), key=self.place.__getitem__))
        return path

    def paths(self, a: int, b: int, limit: int | None) -> list[list[int]]:
        """All paths in name order, ``limit`` at most (a == b is the one path of a)."""
        if a == b:
            return [[a]]
        useful = self.reach([b], forward=False)
        out: list[list[int]] = []
        stack = [(a, iter(sorted(self.out[a], key=self.place.__getitem__)))]
        while stack and (limit is None or len(out) < limit):
            _, rest = stack[-1]
            for j in rest:
                if j == b:
                    out.append([i for i, _ in stack] + [b])
                    break
                if j in useful:
                    stack.append((j, iter(sorted(self.out[j], key=self.place.__getitem__))))
                    break
            else:
                stack.pop()
        return out

    def longest(self, a: int, b: int, cost: Callable[[int], float]) -> tuple[list[int], float] | None:
        """Path of greatest summed node cost; the first predecessor in order wins ties."""
        best: dict[int, tuple[float, int | None]] = {a: (cost(a), None)}
        for i in self.kahn():
            if i in best:
                for j in self.out[i]:
                    c = best[i][0] + cost(j)
                    if j not in best or c > best[j][0]:
                        best[j] = (c, i)
        if b not in best:
            return None
        path: list[int] = [b]
        while (up := best[path[-1]][1]) is not None:
            path.append(up)
        return path[::-1], best[b][0]

    # ---- weights and plans ----

    def bottom_levels(self, cost: Callable[[int], float]) -> list[float]:
        """Cost of the longest way down to a leaf, own cost included; below zero doesn't pass on."""
        out = [0.0] * len(self.names)
        for i in reversed(self.kahn()):
            out[i] = cost(i) + max([0.0, *(out[j] for j in self.out[i])])
        return out

    def critical(self, cost: Callable[[int], float]) -> tuple[list[int], float]:
        if not self.names:
            return [], 0.0
        down = self.bottom_levels(cost)
        pick = lambda ids: min(ids, key=lambda i: (-down[i], self.place[i]))
        path = [pick(range(len(self.names)))]
        while self.out[path[-1]]:
            path.append(pick(self.out[path[-1]]))
        return path, down[path[0]]

    def list_schedule(self, workers: int, cost: Callable[[int], float]) -> tuple[list[tuple[float, int]], float]:
        """(start, node) under ``workers`` slots, by bottom level then name; and the true finish."""
        workers, down = max(1, workers), self.bottom_levels(cost)
        need = [len(x) for x in self.inc]
        ready = [(-down[i], self.place[i], i) for i, n in enumerate(need) if not n]
        heapq.heapify(ready)
        running: list[tuple[float, int]] = []
        now, finish, starts = 0.0, 0.0, []
        while ready or running:
            while ready and len(running) < workers:
                i = heapq.heappop(ready)[2]
                starts.append((now, i))
                heapq.heappush(running, (now + cost(i), i))
            now, i = heapq.heappop(running)
            finish = max(finish, now)
            for j in self.out[i]:
                need[j] -= 1
                if not need[j]:
                    heapq.heappush(ready, (-down[j], self.place[j], j))
        return starts, finish

    def step_keys(self, starts: list[tuple[float, int]], cost: Callable[[int], float]) -> list[tuple[float, int]]:
        """(start, wait) per scheduled node: nodes of one step start together and don't depend on each other.

        ``wait`` counts the free nodes that a node waits for within its start time.
        """
        at = {i: s for s, i in starts}
        wait: dict[int, int] = {}
        for i in self.kahn():
            wait[i] = max((wait[p] + 1 for p in self.inc[i] if at[p] == at[i] and cost(p) == 0), default=0)
        return [(s, wait[i]) for s, i in starts]

    # ---- partitions ----

    def part_by_levels(self, k: int) -> list[int]:
        lvl = self.levels()
        n = max(lvl, default=-1) + 1
        k = max(1, min(k, n))
        per = -(-n // k) if n else 1
        return [min(k - 1, x // per) for x in lvl]

    def part_balanced(self, k: int, cost: Callable[[int], float]) -> list[int]:
        """Walk in (level, name) order, next part once a part's cost reaches total / k."""
        lvl = self.levels()
        order = sorted(range(len(lvl)), key=lambda i: (lvl[i], self.place[i]))
        k = max(1, min(k, len(order) or 1))
        share = sum(map(cost, order)) / k
        out, part, load = [0] * len(order), 0, 0.0
        for i in order:
            if load >= share and part < k - 1:
                part, load = part + 1, 0.0
            out[i] = part
            load += cost(i)
        return out

    def part_low_cut(self, k: int, cost: Callable[[int], float], rounds: int = 10, imbalance: float = 0.3) -> list[int]:
        """Level parts, then moves of nodes near a boundary to the part behind it where that lowers the cut.

        A node moves only if it lies within two levels of the boundary (levels of its part as the round
        found them), no edge then runs backwards, the part it leaves keeps a node, and the part it enters
        stays within (1 + imbalance) times the mean cost.
        """
        part, lvl = self.part_by_levels(k), self.levels()
        n = max(part, default=0) + 1
        load, size = [0.0] * n, [0] * n
        for i, p in enumerate(part):
            load[p] += cost(i)
            size[p] += 1
        most = (1 + imbalance) * sum(load) / n
        order = self.kahn()
        for _ in range(rounds):
            low, high = [1 << 62] * n, [-1] * n
            for i, p in enumerate(part):
                low[p], high[p] = min(low[p], lvl[i]), max(high[p], lvl[i])
            moved = False
            for i in order:
                at = part[i]
                for to in (at + 1, at - 1):
                    near = lvl[i] >= high[at] - 1 if to > at else lvl[i] <= low[at] + 1
                    if not 0 <= to < n or not near or size[at] < 2 or load[to] + cost(i) > most:
                        continue
                    if any(part[j] > to for j in self.inc[i]) or any(part[j] < to for j in self.out[i]):
                        continue
                    around = [*self.inc[i], *self.out[i]]
                    if sum(part[j] == to for j in around) > sum(part[j] == at for j in around):
                        load[at], load[to] = load[at] - cost(i), load[to] + cost(i)
                        size[at], size[to] = size[at] - 1, size[to] + 1
                        part[i], moved = to, True
                        break
            if not moved:
                break
        return part

    # ---- structure ----

    def dominators(self, root: int) -> dict[int, int]:
        """Immediate dominator of every node reachable from root; root is its own."""
        below = self.reach([root])
        order = [i for i in self.kahn() if i in below]
        rank = {i: r for r, i in enumerate(order)}
        idom = {root: root}
        for i in order:
            if i == root:
                continue
            ups = [p for p in self.inc[i] if p in idom]
            d = ups[0]
            for p in ups[1:]:
                while d != p:
                    if rank[d] > rank[p]:
                        d = idom[d]
                    else:
                        p = idom[p]
            idom[i] = d
        return idom

    def redundant(self) -> set[tuple[int, int]]:
        """Edges u -> v with another way of two hops or more."""
        out = set()
        for u in range(len(self.names)):
            nxt = set(self.out[u])
            if len(nxt) > 1:  # nothing reaches itself, so what one of them reaches is another's
                out |= {(u, v) for v in nxt & self.reach({k for w in nxt for k in self.out[w]})}
        return out

    def strong_components(self) -> list[int]:
        """For every node the first by name of those it is on a cycle with; itself if on none."""
        n = len(self.names)
        seen, low, label, count = [-1] * n, [0] * n, [-1] * n, 0
        held: list[int] = []
        for start in self.by_name:
            if seen[start] >= 0:
                continue
            walk = [(start, iter(self.out[start]))]
            while walk:
                i, rest = walk[-1]
                if seen[i] < 0:
                    seen[i] = low[i] = count
                    count += 1
                    held.append(i)
                for j in rest:
                    if seen[j] < 0:
                        walk.append((j, iter(self.out[j])))
                        break
                    if label[j] < 0:
                        low[i] = min(low[i], seen[j])
                else:
                    walk.pop()
                    if walk:
                        low[walk[-1][0]] = min(low[walk[-1][0]], low[i])
                    if low[i] == seen[i]:
                        group = []
                        while not group or group[-1] != i:
                            group.append(held.pop())
                        first = min(group, key=self.place.__getitem__)
                        for j in group:
                            label[j] = first
        return label

    def weak_components(self) -> list[int]:
        comp = [-1] * len(self.names)
        for root in self.by_name:
            if comp[root] < 0:
                edge = [root]
                comp[root] = root
                while edge:
                    i = edge.pop()
                    for j in (*self.out[i], *self.inc[i]):
                        if comp[j] < 0:
                            comp[j] = root
                            edge.append(j)
        return comp


def costing(adj: Adjacency, costs: Mapping[str, float] | None, default: float = 1.0) -> Callable[[int], float]:
    """Cost by index; unknown names are ignored, missing ones cost ``default``."""
    table = [default] * len(adj.names)
    for name, c in (costs or {}).items():
        if name in adj.index:
            table[adj.index[name]] = float(c)
    return table.__getitem__


def require(ok: bool, message: str) -> None:
    if not ok:
        raise GraphError(message)
