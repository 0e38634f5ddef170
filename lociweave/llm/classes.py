"""Classes of tokens in one page and in one host: order, nesting and the roles that tokens have by their place in classes.

A class is given by its tokens, each with the class's number (lower numbers are stronger), its place in the class and
the class's size.  An instance of a class is one occurrence of each of its tokens, from the first to the last.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict

#: Marks instead of a gap: all instances of a class, and those that overlap another class's without lying in one gap.
ALL, CROSSED = -1, -2

Classes = dict[int, tuple[int, int, int]]


def in_order(places: list[list[int]]) -> list[int]:
    """Which tokens follow each other in all instances; places: the places of each token in a page, equally many."""
    if all(len(p) == 1 for p in places):  # a longest increasing run
        ends: list[int] = []
        last: list[int] = []
        before: list[int] = []
        for k, (p,) in enumerate(places):
            at = bisect_left(ends, p)
            ends[at:], last[at:] = [p, *ends[at + 1 :]], [k, *last[at + 1 :]]
            before.append(last[at - 1] if at else -1)
        kept, k = [], last[-1]
        while k >= 0:
            kept.append(k)
            k = before[k]
        return kept[::-1]
    kept = [0]
    for k, p in enumerate(places[1:], 1):
        first, previous = places[kept[0]], places[kept[-1]]
        if all(a < b for a, b in zip(previous, p, strict=True)) and all(a < b for a, b in zip(p, first[1:])):
            kept.append(k)
    return kept


def relations(roles: list[int], classes: Classes) -> tuple[set[int], Counter]:
    """Of one page: tokens that aren't in their class's order; how many instances (class, other class, gap) lie in a gap
    of the other's instances or cross them, and of each class how many there are."""
    seen: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for place, role in enumerate(roles):
        c = classes.get(role)
        if c is not None:
            seen[c[0]].append((c[1], place, c[2]))
    broken: set[int] = set()
    events: list[tuple[int, int, int, int, int]] = []
    for number, found in seen.items():
        size = found[0][2]
        times = len(found) // size
        kept = list(range(size))
        if [f[0] for f in found] != kept * times:
            places: list[list[int]] = [[] for _ in kept]
            for index, place, _ in found:
                places[index].append(place)
            kept = in_order(places) if all(len(p) == times for p in places) else []
            ordered = set(kept)
            broken |= {roles[place] for index, place, _ in found if index not in ordered}
            found = [f for f in found if f[0] in ordered]
        if len(kept) > 1:
            end = len(kept)
            events += [(place, number, index, k // end, (k % end == 0) - (k % end == end - 1)) for k, (index, place, _) in enumerate(found)]
    events.sort()
    counts: Counter = Counter()
    open_: dict[int, tuple[int, int]] = {}
    started: dict[int, dict[int, tuple[int, int]]] = {}
    for _, number, index, instance, edge in events:
        if edge > 0:
            started[number] = dict(open_)
        open_[number] = (index, instance)
        if edge < 0:
            del open_[number]
            counts[number, number, ALL] += 1
            for other, at in started[number].items():
                counts[number, other, at[0] if open_.get(other) == at else CROSSED] += 1
    return broken, counts


def settled(classes: list[tuple[int, int, int, int]], broken: set[int], counts: dict[tuple[int, int, int], int]) -> list[tuple[int, int, int, int]]:
    """The classes (number, index, token, size) of a host that are ordered and nested in all its pages.

    Broken tokens leave their class; of two classes that aren't nested the stronger stays."""
    whole: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for number, index, token, _ in sorted(classes):
        if token not in broken:
            whole[number].append((index, token))
    gaps: dict[tuple[int, int], Counter] = defaultdict(Counter)
    for (number, other, gap), n in counts.items():
        if gap != ALL:
            gaps[number, other][gap] += n

    def nested(number: int, other: int) -> bool:
        """Whether all instances of the one lie in the same gap of the other, or none in any."""
        inside: Counter = Counter()
        indices = [index for index, _ in whole[other]]
        for gap, n in gaps.get((number, other), {}).items():
            if gap == CROSSED:
                return False
            below = sum(index <= gap for index in indices)
            if 0 < below < len(indices):
                inside[below] += n
        return not inside or (len(inside) == 1 and sum(inside.values()) == counts[number, number, ALL])

    kept: list[int] = []
    for number in sorted(whole):
        if len(whole[number]) > 1 and all(nested(number, other) and nested(other, number) for other in kept):
            kept.append(number)
    return [(number, k, token, len(whole[number])) for number in kept for k, (_, token) in enumerate(whole[number])]


def roles_of(tokens: list[int], rounds: list[Classes]) -> list[int]:
    """The tokens of a page told apart by where they stand: tokens of classes keep their role, others take one from the
    token of the innermost open class before them, by each round's classes in turn.

    Hashes of tuples of numbers are the same in all Python processes."""
    roles = tokens
    for classes in rounds:
        found, open_ = [], []
        for token, role in zip(tokens, roles, strict=True):
            c = classes.get(role)
            if c is None:
                found.append(hash((token, open_[-1][1])) if open_ else token)
                continue
            found.append(role)
            number, index, size = c
            if index == 0:
                open_.append((number, role))
            elif any(o[0] == number for o in open_):
                while open_[-1][0] != number:
                    open_.pop()
                open_[-1] = (number, role)
                if index == size - 1:
                    open_.pop()
        roles = found
    return roles
