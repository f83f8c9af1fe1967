"""Work on the commit graph of one repository inside a task: walks, labels, reachability and merge bases.

Names stand for commits and for parents that are no commits alike. Each function takes plain dictionaries that hold a
repository of bounded size; the callers see to the bound and bring a repository's rows together.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

Parents = dict[str, list[str]]
Labels = dict[str, tuple[int, int, int]]


def discovery(parents: Parents, start: str, within: int | None = None) -> Iterator[tuple[str, int]]:
    """(name, distance) in the order of a first-in-first-out walk; `within` ends it at a distance."""
    depth, found = {start: 0}, [start]
    for name in found:  # grows while it is read
        yield name, depth[name]
        if within is None or depth[name] + 1 < within:
            for parent in parents.get(name, ()):
                if parent not in depth:
                    depth[parent] = depth[name] + 1
                    found.append(parent)


def generations(parents: Parents) -> dict[str, int]:
    """1 + the longest way to a name without parents. Names on a cycle, or with one behind them, are left out."""
    children: dict[str, list[str]] = {}
    waiting = {}
    for child, own in parents.items():
        different = set(own)
        waiting[child] = len(different)
        for parent in different:
            children.setdefault(parent, []).append(child)
    ready = [n for n in {*children, *parents} if not waiting.get(n)]
    level = dict.fromkeys(ready, 1)
    for name in ready:
        for child in children.get(name, ()):
            level[child] = max(level.get(child, 0), level[name] + 1)
            waiting[child] -= 1
            if not waiting[child]:
                ready.append(child)
    return {n: level[n] for n in ready}


def labels(parents: Parents) -> Labels:
    """(generation, first, last) of every name that no cycle stands behind.

    first..last numbers the names whose line of first parents leads through this one, itself included, so a name is on
    the line of another exactly if its interval holds the other's first number.
    """
    level = generations(parents)
    below: dict[str | None, list[str]] = {}
    for name in sorted(level):
        own = parents.get(name)
        below.setdefault(own[0] if own else None, []).append(name)
    first, out, number = {}, {}, 0
    stack: list[tuple[str, bool]] = [(n, False) for n in below.get(None, ())]
    while stack:
        name, left = stack.pop()
        if left:
            out[name] = level[name], first[name], number - 1
            continue
        first[name] = number
        number += 1
        stack.append((name, True))
        stack.extend((n, False) for n in below.get(name, ()))
    return out


def decided(start: str, candidate: str, known: Labels) -> bool | None:
    """Does `start` reach `candidate`, as far as labels tell: a line of first parents says yes, generations say no."""
    if start == candidate:
        return True
    s, c = known.get(start), known.get(candidate)
    if s is None or c is None:
        return None
    if c[1] <= s[1] <= c[2]:
        return True
    return False if c[0] >= s[0] else None


def reaches(parents: Parents, known: Labels, start: str, candidate: str) -> bool:
    """Does `start` reach `candidate`: a walk over those names that labels do not decide."""
    seen, stack = {start}, [start]
    while stack:
        name = stack.pop()
        answer = decided(name, candidate, known)
        if answer:
            return True
        if answer is None:
            for parent in parents.get(name, ()):
                if parent not in seen:
                    seen.add(parent)
                    stack.append(parent)
    return False


class Reached:
    """What `start` reaches, opened in descending generation only as far down as is asked for."""

    def __init__(self, parents: Parents, known: Labels, start: str) -> None:
        self.parents, self.known, self.start, self.seen = parents, known, start, {start}
        self.open = [(self._rank(start), start)]

    def _rank(self, name: str) -> float:
        label = self.known.get(name)
        return -label[0] if label else float("-inf")

    def __contains__(self, name: str) -> bool:
        answer = decided(self.start, name, self.known)
        if answer is not None:
            return answer
        rank = self._rank(name)
        # With a generation, all that is above it is enough; without one everything may be needed.
        while self.open and name not in self.seen and (rank == float("-inf") or self.open[0][0] < rank):
            _, opened = heapq.heappop(self.open)
            for parent in self.parents.get(opened, ()):
                if parent not in self.seen:
                    self.seen.add(parent)
                    heapq.heappush(self.open, (self._rank(parent), parent))
        return name in self.seen


def merge_base(parents: Parents, known: Labels, there: set[str], left: str, right: str) -> tuple[str | None, str | None, int]:
    """(base, reason, names visited): the first commit in the left walk that the right one reaches too.

    The left walk goes on until the first hit; the right side is opened by generation, no deeper than the left asks.
    """
    reached, met, visited = Reached(parents, known, right), False, 0
    for name, _ in discovery(parents, left):
        visited += 1
        if name in reached:
            if name in there:
                return name, None, visited + len(reached.seen)
            met = True
    return None, "missing commit" if met else "no common ancestor", visited + len(reached.seen)


def relax(parents: dict[int, list[tuple[int, int]]], held: dict[int, int], fresh: dict[int, int], own: int, within: int | None) -> tuple[dict[int, int], dict[tuple[int, int], int]]:
    """Shorter distances inside section `own`, and offers to names of other sections, from distances that are new.

    `parents` names each parent with its section; `held` are the distances known before.
    """
    best, found = dict(held), {}
    offers: dict[tuple[int, int], int] = {}
    heap = [(d, n) for n, d in fresh.items()]
    heapq.heapify(heap)
    while heap:
        depth, name = heapq.heappop(heap)
        if depth >= best.get(name, depth + 1):
            continue
        best[name] = found[name] = depth
        if within is not None and depth + 1 >= within:
            continue
        for parent, section in parents.get(name, ()):
            if section == own:
                if depth + 1 < best.get(parent, depth + 2):
                    heapq.heappush(heap, (depth + 1, parent))
            else:
                offers[section, parent] = min(depth + 1, offers.get((section, parent), depth + 1))
    return found, offers


def ordered(links: list[tuple[int, int, int, int]], entry: dict[int, int]) -> list[tuple[int, int]]:
    """(distance, name) of the names that `links` lead to, in walk order.

    `links` are (distance of the parent, child, idx, parent) where the parent is one step further than the child; `entry`
    numbers the children of the first distance in walk order.
    """
    links.sort()
    order, out, at = entry, [], 0
    while at < len(links):
        depth, end = links[at][0], at
        first: dict[int, tuple[int, int]] = {}
        while end < len(links) and links[end][0] == depth:
            _, child, idx, parent = links[end]
            first[parent] = min(first.get(parent, (order[child], idx)), (order[child], idx))
            end += 1
        level = sorted(first, key=first.__getitem__)
        order = {n: i for i, n in enumerate(level)}
        out.extend((depth, n) for n in level)
        at = end
    return out
