"""Haplotype paths: bounded walks through a region's k-mers from the start of its reference to the end."""

from __future__ import annotations

from collections import deque

LETTERS = {"CT": "ATNG", "GA": "ATNC"}


def distances(found: set[str], target: str, letters: str) -> dict[str, int]:
    """How many letters each k-mer is from the target, by breadth-first search backward; the target may lack support."""
    away, queue = {target: 0}, deque([target])
    while queue:
        here = queue.popleft()
        for c in letters:
            before = c + here[:-1]
            if before in found and before not in away:
                away[before] = away[here] + 1
                queue.append(before)
    return away


def tails_of_cycles(found: set[str], start: str, target: str, letters: str, most: int) -> set[str]:
    """The k-mers with an edge back to one that the depth-first walk from the start is still on; the target ends no branch."""
    tails: set[str] = set()
    seen, on_path = {start}, {start}
    stack = [(start, iter(letters))]
    while stack:
        here, rest = stack[-1]
        c = next(rest, None) if not most or len(here) + len(stack) - 1 <= most else None
        if c is None:
            stack.pop()
            on_path.discard(here)
            continue
        then = here[1:] + c
        if then not in found:
            continue
        if then in seen:
            if then in on_path:
                tails.add(here)
            continue
        seen.add(then)
        on_path.add(then)
        stack.append((then, iter(letters)))
    return tails


def paths(found: set[str], reference: str, k: int, conversion: str, longest: int, shortest: int, limit: int = 0, no_cycles: bool = False, stop_at_short: bool = False) -> list[str]:
    """The texts of *shortest* to longest + 1 letters that lead from the reference's first k-mer to its last.

    In depth-first order, letters in the order A, T, N, and the conversion's fourth.  A walk ends at
    the target.  Texts of 2k + 1 letters or fewer don't count.  limit: one more than so many are
    looked for at most (0: all).  A k-mer that can't reach the target within what is left is not entered, so
    dead ends cost nothing.  no_cycles: k-mers with an edge back into their own walk are not entered.
    stop_at_short: a walk that meets the target too early tries no further letter there, as older results have it.
    """
    if len(reference) < k:
        return []
    letters, start, target = LETTERS[conversion], reference[:k], reference[-k:]
    away = distances(found, target, letters)
    barred = tails_of_cycles(found, start, target, letters, longest) if no_cycles else set()
    known: dict[str, tuple] = {}

    def onward(here: str) -> tuple:
        """The letters that go on from a k-mer, with the k-mers they lead to and how far those are from the target (-1: they are it)."""
        if (got := known.get(here)) is None:
            ends = [(c, here[1:] + c) for c in letters]
            got = known[here] = tuple((c, then, -1 if then == target else away.get(then, longest + 2)) for c, then in ends if then == target or (then in found and then not in barred))
        return got

    out: list[str] = []
    walk, text, length = [iter(onward(start))], [start], k
    while walk and not (limit and len(out) > limit):
        step = next(walk[-1], None) if length <= longest else None
        if step is None:
            walk.pop()
            text.pop()
            length -= 1
            continue
        c, then, far = step
        if far < 0:
            if length + 1 < shortest:
                if stop_at_short:
                    walk[-1] = iter(())
            elif length + 1 > 2 * k + 1:
                out.append("".join(text) + c)
        elif length + far <= longest:
            walk.append(iter(onward(then)))
            text.append(c)
            length += 1
    return out


def with_reference(found: list[str], reference: str) -> list[str]:
    """The paths, and the reference at the end if it isn't among them."""
    return found if reference in found else [*found, reference]
