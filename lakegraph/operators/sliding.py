"""Order statistics of a frame that slides over ordered rows."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

LOAD = 512


class SortedBlocks:
    """Numbers in order, in sorted blocks of a bounded length: adding, removing and finding by rank touch one block."""

    def __init__(self, load: int = LOAD):
        self.blocks: list[list] = []
        self.ends: list = []
        self.load = load

    def add(self, x) -> None:
        if not self.blocks:
            self.blocks, self.ends = [[x]], [x]
            return
        at = min(bisect_left(self.ends, x), len(self.ends) - 1)
        block = self.blocks[at]
        insort(block, x)
        if len(block) > 2 * self.load:
            self.blocks[at:at + 1] = [block[:self.load], block[self.load:]]
            self.ends[at:at + 1] = [block[self.load - 1], block[-1]]
        else:
            self.ends[at] = block[-1]

    def remove(self, x) -> None:
        at = bisect_left(self.ends, x)
        block = self.blocks[at]
        del block[bisect_right(block, x) - 1]
        if block:
            self.ends[at] = block[-1]
        else:
            del self.blocks[at], self.ends[at]

    def at_rank(self, k: int):
        """The k-th smallest, from 1."""
        for block in self.blocks:
            if k <= len(block):
                return block[k - 1]
            k -= len(block)
        raise IndexError("rank is beyond the frame")


def frame_elements(values: list, size: int, shares: tuple[float, ...]) -> list[list]:
    """For each share, the element at rank ``ceil(share * n)`` of the last ``size`` values, at every place.

    NaN is the largest value, as in Spark. Ranks of all values take their place, so any kind can be compared.
    """
    nan = object()
    clean = [nan if x != x else x for x in values]
    order = sorted(set(clean) - {nan}) + [nan]
    rank = {x: i for i, x in enumerate(order)}
    ranks, back = [rank[x] for x in clean], order[:-1] + [float("nan")]
    frame, out = SortedBlocks(), [[] for _ in shares]
    for i, r in enumerate(ranks):
        frame.add(r)
        if i >= size:
            frame.remove(ranks[i - size])
        n = min(i + 1, size)
        for found, share in zip(out, shares):
            found.append(back[frame.at_rank(max(1, -int(-share * n // 1)))])
    return out
