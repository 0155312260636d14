"""How many cycles a graph has, without listing them: what the reports read, whatever their number and length."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.graph import _components, _per_group

#: Counts, and minutes made of them, are stored in 38 digits; more cycles than this in one group are an error, never a lower figure.
MOST = 10**35


def _core(first, ahead: dict) -> tuple[dict, dict, int]:
    """Edges with their ways, backwards too, once every node of one way in or out is drawn together with that neighbour; the ways back
    to ``first`` that are found so.

    A path over such a node passes the neighbour anyway, so none is lost or made. Loops at other nodes are on no cycle through ``first``.
    """
    out = {n: dict.fromkeys(ts, 1) for n, ts in ahead.items()}
    into: dict = {n: set() for n in ahead}
    for n, ts in out.items():
        for t in ts:
            into[t].add(n)
    closed, queue = 0, [n for n in out if n != first]
    while queue:
        v = queue.pop()
        if v not in out or (len(out[v]) > 1 and len(into[v]) > 1):
            continue
        ways, sources = out.pop(v), into.pop(v)
        for t in ways:
            into[t].discard(v)
        for s in sources:
            n = out[s].pop(v)
            for t, m in ways.items():
                if s != t:
                    out[s][t] = out[s].get(t, 0) + n * m
                    into[t].add(s)
                elif s == first:
                    closed += n * m
        queue += [n for n in {*ways, *sources} if n != first]
    return out, into, closed


def _twins(first, out: dict) -> list[list]:
    """Nodes that may change places (the same ways to and from all others, and to each other), in lists of two and more."""
    into: dict = {n: {} for n in out}
    for s, ts in out.items():
        for t, w in ts.items():
            into[t][s] = w
    alike = defaultdict(list)
    for n in out:
        if n != first:
            for w in {0, *out[n].values()}:
                own = {(n, w)} if w else set()
                alike[frozenset(out[n].items() | own), frozenset(into[n].items() | own)].append(n)
    return [ns for ns in alike.values() if len(ns) > 1]


def _through(first, ahead: dict) -> int:
    """The number of cycles through ``first`` in a strongly connected graph without loops.

    Paths that stand at one node with the same nodes still to go are counted together, those with most to go first. Of the nodes not yet
    passed only those matter that lie on a way back, and of twins only how many. Exact; the states are at most n * 2^n in the core of
    ``_core``, few in sparse graphs and where all nodes are linked with all others.
    """
    out, into, total = _core(first, ahead)
    number = {n: i for i, n in enumerate(n for n in out if n != first)}
    mask = lambda ns: sum(1 << number[n] for n in ns if n != first)
    succ, pred = {n: mask(out[n]) for n in out}, {n: mask(into[n]) for n in out}
    name = list(number)

    def reach(start: int, free: int, step: dict) -> int:
        seen = new = start & free
        while new and seen != free:
            low = new & -new
            more = step[name[low.bit_length() - 1]] & free & ~seen
            seen |= more
            new = (new ^ low) | more
        return seen

    sets = []
    for ns in _twins(first, out):
        bits = sorted(number[n] for n in ns)
        lowest = [0]
        for b in bits:
            lowest.append(lowest[-1] | 1 << b)
        sets.append((lowest[-1], lowest, name[bits[-1]]))

    def same(node, free: int) -> tuple:
        """The state that stands for all that differ from this one by twins: the first of them are free, the last one is passed."""
        for all_, lowest, last in sets:
            free = free & ~all_ | lowest[(free & all_).bit_count()]
            if node != first and all_ >> number[node] & 1:
                node = last
        return node, free

    states: dict[int, Counter] = defaultdict(Counter)
    everything = (1 << len(name)) - 1
    states[len(name)][first, everything] = 1
    for size in range(len(name), -1, -1):
        for (node, free), ways in states.pop(size, {}).items():
            useful = reach(pred[first], reach(succ[node], free, succ), pred)
            if useful != free:
                states[useful.bit_count()][node, useful] += ways
                continue
            for t, n in out[node].items():
                if t == first:
                    total += ways * n
                elif free >> number[t] & 1:
                    states[size - 1][same(t, free & ~(1 << number[t]))] += ways * n
    return total


def _inner(nodes: set, ahead: dict) -> Iterator[dict]:
    """The strongly connected parts of several nodes within ``nodes``, with the edges inside, without loops."""
    parts = defaultdict(list)
    for n, c in _components({n: [t for t in ahead[n] if t in nodes] for n in nodes}).items():
        parts[c].append(n)
    for part in parts.values():
        if len(part) > 1:
            inside = set(part)
            yield {n: [t for t in ahead[n] if t in inside and t != n] for n in part}


def counts(ahead: dict) -> tuple[dict, int]:
    """Least node -> number of its cycles; the number of nodes on cycles. A loop counts where its node is a component of its own."""
    found, work = {}, list(_inner(set(ahead), ahead))
    on = {n for part in work for n in part}
    loops = [n for n, ts in ahead.items() if n in ts and n not in on]
    cyclic = len(on) + len(loops)
    while work:
        part = work.pop()
        first = min(part)
        found[first] = _through(first, part)
        work += _inner(set(part) - {first}, part)
    return found | dict.fromkeys(loops, 1), cyclic


def _listed(ahead: dict) -> Iterator[list]:
    """All cycles in order of their nodes. A path goes on only where a way back is left, so none is walked in vain."""
    work, graphs = list(_inner(set(ahead), ahead)), {}
    on = {n for part in work for n in part}
    while work:
        part = work.pop()
        first = min(part)
        graphs[first] = part
        work += _inner(set(part) - {first}, part)
    for first in sorted({*graphs, *(n for n, ts in ahead.items() if n in ts and n not in on)}):
        if first not in graphs:
            yield [first]
            continue
        part = graphs[first]
        path, seen = [first], {first}
        turns = [iter(sorted(part[first]))]
        while turns:
            for t in turns[-1]:
                if t == first:
                    yield list(path)
                elif t not in seen and (len(part[path[-1]]) == 1 or _returns(t, first, part, seen)):
                    path.append(t)
                    seen.add(t)
                    turns.append(iter(sorted(part[t])))
                    break
            else:
                turns.pop()
                seen.discard(path.pop())


def _returns(node, first, part: dict, seen: set) -> bool:
    work, known = [node], {node}
    while work:
        for t in part[work.pop()]:
            if t == first:
                return True
            if t not in seen and t not in known:
                known.add(t)
                work.append(t)
    return False


def least_texts(most: int, k: int) -> list[int]:
    """Of the numbers 1 to ``most`` the ``k`` whose decimal texts come first, in that order."""
    out, n = [], 1
    while len(out) < min(most, k):
        out.append(n)
        if n * 10 <= most:
            n *= 10
        else:
            while n % 10 == 9 or n == most:
                n //= 10
            n += 1
    return out


def cycle_counts(edges: DataFrame, group: str, named: int) -> DataFrame:
    """group, node, cycle_id, cycles, cyclic_files, lone_files: all cycles of each group, of any length, counted and not listed.

    A row of one cycle (cycle_id, its least node) for each of the ``named`` ids whose texts come first, as ``elementary_cycles`` without
    bounds would number them, and a row without an id per least node for the number of its other cycles. cyclic_files, on every row, is
    the number of nodes on cycles. lone_files, the nodes on this cycle only, is there where all cycles of the group are named.
    """

    def rows(ahead: dict) -> list[tuple]:
        per, cyclic = counts(ahead)
        if (total := sum(per.values())) > MOST:
            raise OverflowError(f"{total} cycles of one group are more than {MOST}")
        lone: dict = {}
        if 0 < total <= named:
            cycles = list(_listed(ahead))
            times = Counter(n for c in cycles for n in c)
            lone = {i: sum(times[n] == 1 for n in c) for i, c in enumerate(cycles, 1)}
        out, before, ids = [], 0, sorted(least_texts(total, named), reverse=True)
        for first in sorted(per):
            upto, rest = before + per[first], per[first]
            while ids and ids[-1] <= upto:
                i = ids.pop()
                out.append((first, Decimal(i), Decimal(1), cyclic, lone.get(i, -1)))
                rest -= 1
            if rest:
                out.append((first, Decimal(0), Decimal(rest), cyclic, -1))
            before = upto
        return out

    # no nulls in between, which pandas turns into floating-point figures
    out = _per_group(edges, group, "node {node}, cycle_id decimal(38,0), cycles decimal(38,0), cyclic_files bigint, lone_files bigint", rows)
    return out.withColumns({"cycle_id": F.nullif("cycle_id", F.lit(0)), "lone_files": F.nullif("lone_files", F.lit(-1))})
