"""Deep-shallow sorting of suffixes, and which stretches around a common point recur.

Suffixes are sorted by multikey quicksort on eight bytes at a time down to a shallow depth;
groups that still agree there are put into a blind trie, which finds each one's place by a
few branching bytes and one comparison.
"""

from __future__ import annotations

from bisect import bisect_left

SHALLOW = 64
STEP = 8


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the longest common prefix, known to be at least `at`."""
    end = min(len(a), len(b))
    if a[at:end] == b[at:end]:
        return end
    step = 32
    while a[at : at + step] == b[at : at + step]:
        at += step
    while step > 1:
        step //= 2
        if a[at : at + step] == b[at : at + step]:
            at += step
    return at


class BlindTrie:
    """A Patricia trie of strings that agree in their first `depth` bytes, sorted by a walk."""

    def __init__(self, texts: list[bytes], depth: int):
        self.texts, self.depth = texts, depth

    def sort(self, group: list[int]) -> list[int]:
        # A node is (depth, branches by byte, -1 for a string that ends there); a leaf a list of equal strings.
        root: object = [group[0]]
        for i in group[1:]:
            text, node = self.texts[i], root
            while isinstance(node, tuple):
                d, branches = node
                b = text[d] if d < len(text) else -1
                node = branches.get(b) or next(iter(branches.values()))
            other = self.texts[node[0]]
            lcp = common(text, other, self.depth)
            if lcp == len(text) == len(other):
                node.append(i)
                continue
            up, b, node = None, 0, root
            while isinstance(node, tuple) and node[0] < lcp:
                up, b = node, text[node[0]] if node[0] < len(text) else -1
                node = node[1][b]
            mine, theirs = (text[lcp] if lcp < len(text) else -1), (other[lcp] if lcp < len(other) else -1)
            if isinstance(node, tuple) and node[0] == lcp:
                node[1][mine] = [i]
                continue
            new = (lcp, {theirs: node, mine: [i]})
            if up is None:
                root = new
            else:
                up[1][b] = new
        out, stack = [], [root]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                out += node
        return out


def suffix_order(texts: list[bytes], depth: int = 0) -> list[int]:
    """Indices of the texts in order; all texts agree in their first `depth` bytes."""
    if len(texts) < 2:
        return [*range(len(texts))]
    deep, trie = depth + SHALLOW, BlindTrie(texts, depth + SHALLOW)
    out: list[int] = []
    stack = [([*range(len(texts))], depth)]
    while stack:
        group, at = stack.pop()
        if len(group) == 1:
            out += group
            continue
        if at >= deep:
            out += trie.sort(group)
            continue
        # The length tells a text that ends from one with zero bytes there.
        keys = {i: (texts[i][at : at + STEP].ljust(STEP, b"\0"), min(len(texts[i]) - at, STEP)) for i in group}
        pivot = keys[group[len(group) // 2]]
        less, same, more = [], [], []
        for i in group:
            (less if keys[i] < pivot else more if keys[i] > pivot else same).append(i)
        if more:
            stack.append((more, at))
        if pivot[1] < STEP:  # all of `same` end here: they are equal
            stack += [([i], at) for i in same]
        else:
            stack.append((same, at + STEP))
        if less:
            stack.append((less, at))
    return out


def recurring(lefts: list[bytes], rights: list[bytes], counts: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For every occurrence of a common point, the stretches around it that recur.

    lefts are the bytes before the point, nearest first, and rights those from it on; counts
    say how many occurrences look exactly so. A stretch (l, r) reaches l bytes to the left
    and r to the right, has at least `length` bytes and also stands at another occurrence.

    Occurrences are joined in order of how far they agree to the right (the LCP intervals of
    the sorted rights); whenever two become neighbours in the order of their lefts, they give
    the longest left agreement at that level.
    """
    n = len(rights)
    found: list[list[tuple[int, int]]] = [[(len(x), len(y))] if c > 1 and len(x) + len(y) >= length else [] for x, y, c in zip(lefts, rights, counts, strict=True)]
    if n < 2:
        return found
    order, by_left = suffix_order(rights), suffix_order(lefts)
    rank = [0] * n
    for r, i in enumerate(by_left):
        rank[i] = r
    levels = sorted(((common(rights[a], rights[b]), k) for k, (a, b) in enumerate(zip(order, order[1:]))), reverse=True)
    sets: list[list[int]] = [[rank[i]] for i in order]  # left ranks of the members, sorted
    of = [*range(n)]

    def find(k: int) -> int:
        while of[k] != k:
            of[k] = of[of[k]]
            k = of[k]
        return k

    def meet(i: int, j: int, right: int) -> None:
        left = common(lefts[i], lefts[j])
        if left + right >= length:
            found[i].append((left, right))
            found[j].append((left, right))

    for right, k in levels:
        a, b = find(k), find(k + 1)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        large, small = sets[a], sets[b]
        of[b] = a
        sets[b] = []
        for x in small:
            at = bisect_left(large, x)
            if at:
                meet(by_left[large[at - 1]], by_left[x], right)
            if at < len(large):
                meet(by_left[large[at]], by_left[x], right)
            large.insert(at, x)
    return found
