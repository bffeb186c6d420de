"""Suffix arrays by induced sorting, and permuted common prefixes, over the bytes of one shard."""

from __future__ import annotations

import numpy as np

#: Symbols packed into one number when leftmost-smaller substrings are compared.
PACKED = 6


def smaller_suffixes(symbols: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; ``symbols`` ends with a 0 that occurs nowhere else."""
    size = len(symbols)
    changes = np.where(symbols[:-1] != symbols[1:], np.arange(size - 1), size)
    change = np.minimum.accumulate(changes[::-1])[::-1]
    return np.append(symbols[change] < symbols[change + 1], True)


def dense(keys: np.ndarray) -> np.ndarray:
    """The rank of each key among the distinct keys."""
    order = np.argsort(keys)
    ordered = keys[order]
    ranks = np.empty(len(keys), np.int64)
    ranks[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
    return ranks


def substring_names(symbols: np.ndarray, smaller: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """Names, in order, of the substrings that reach from one leftmost smaller suffix to the next, the types counted in."""
    typed = symbols.astype(np.int64) * 2 + smaller
    lengths = np.append(np.diff(leftmost) + 1, 1)
    last = len(symbols) - 1
    names = np.zeros(len(leftmost), np.int64)
    for done in range(0, int(lengths.max()), PACKED):
        active = np.flatnonzero(lengths > done) if done else np.arange(len(leftmost))
        starts, left = leftmost[active] + done, lengths[active] - done
        packed = np.zeros(len(active), np.int64)
        for i in range(PACKED):
            packed = (packed << 10) | np.where(i < left, typed[np.minimum(starts + i, last)], 0)
        if not done:
            names = dense(packed)
            continue
        # Substrings with equal names so far end together, so whole groups are refined.
        order = np.lexsort((packed, names[active]))
        group, part = names[active][order], packed[order]
        within = np.cumsum(np.concatenate([[0], (group[1:] != group[:-1]) | (part[1:] != part[:-1])]))
        finer = names * (len(leftmost) + 1)
        finer[active[order]] += within
        names = dense(finer)
    return names


def leftmost_order(symbols: np.ndarray, smaller: np.ndarray, leftmost: np.ndarray, depth: int) -> np.ndarray:
    """The leftmost smaller suffixes in order, right for their first ``depth`` symbols at least.

    The names of their substrings form a string a third as long or less. It is sorted by its own names again and again, each
    time over twice as many, until all differ or they cover ``depth``; a substring moves on by two symbols or more.
    """
    names, covered = substring_names(symbols, smaller, leftmost), 2
    step = 1
    size = len(leftmost)
    while covered < depth + 2 and names.max() < size - 1:
        following = np.zeros(size, np.int64)
        following[:-step] = names[step:] + 1
        names = dense(names * (size + 1) + following)
        step *= 2
        covered *= 2
        if step >= size:
            break
    return leftmost[np.argsort(names)]


def deal(found: np.ndarray, symbols: np.ndarray, buckets: list[list[np.ndarray]]) -> None:
    """Append positions to the buckets of their symbols, keeping their order."""
    if len(found):
        own = symbols[found]
        order = np.argsort(own, kind="stable")
        found, own = found[order], own[order]
        cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
        for part, symbol in zip(np.split(found, cuts), own[np.concatenate([[0], cuts])].tolist()):
            buckets[symbol].append(part)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` (bytes) in the order of their suffixes, right for the first ``depth`` bytes at least.

    Suffixes are classified, the leftmost smaller ones are put in order, and all others follow by induction:
    bucket by bucket upwards for the larger ones, downwards for the smaller ones, each position dealt once.
    """
    symbols = np.append(text.astype(np.int16) + 1, np.int16(0))
    smaller = smaller_suffixes(symbols)
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    ordered = leftmost_order(symbols, smaller, leftmost, depth)
    kinds = int(symbols.max()) + 1
    first: list[list[np.ndarray]] = [[] for _ in range(kinds)]
    deal(ordered, symbols, first)
    upper: list[list[np.ndarray]] = [[] for _ in range(kinds)]
    lower: list[list[np.ndarray]] = [[] for _ in range(kinds)]

    def induce(current: np.ndarray, smaller_ones: bool, buckets: list[list[np.ndarray]]) -> None:
        before = current[current > 0] - 1
        deal(before[smaller[before] == smaller_ones], symbols, buckets)

    def exhaust(symbol: int, smaller_ones: bool, buckets: list[list[np.ndarray]]) -> np.ndarray:
        """Scan a bucket, also the positions that scanning it adds to it."""
        at = 0
        while at < len(buckets[symbol]):
            part = buckets[symbol][at:]
            at = len(buckets[symbol])
            induce(np.concatenate(part), smaller_ones, buckets)
        return np.concatenate(buckets[symbol]) if buckets[symbol] else np.zeros(0, np.int64)

    larger = []
    for symbol in range(kinds):
        larger.append(exhaust(symbol, False, upper))
        if first[symbol]:
            induce(np.concatenate(first[symbol]), False, upper)
    out: list[np.ndarray] = []
    for symbol in range(kinds - 1, 0, -1):
        down = exhaust(symbol, True, lower)
        induce(larger[symbol][::-1], True, lower)
        out += [down, larger[symbol][::-1]]
    return np.concatenate(out)[::-1] if out else np.zeros(0, np.int64)


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each position, the common prefix with the suffix before it in ``order``: the permuted common prefixes.

    Where position and predecessor both follow those of the position before, the prefix is shorter by one; only the
    others are compared, eight bytes at a time.
    """
    size = len(text)
    before = np.full(size, -1, np.int64)
    before[order[1:]] = order[:-1]
    follows = np.zeros(size, bool)
    follows[1:] = (before[1:] == before[:-1] + 1) & (before[:-1] >= 0) & (text[:-1] == text[np.maximum(before[:-1], 0)])
    heads = np.flatnonzero(~follows)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.ndarray((size,), "<u8", padded.data, 0, (1,))
    shared = np.zeros(len(heads), np.int64)
    left, right = heads, before[heads]
    active = np.flatnonzero(right >= 0)
    limit = size - np.maximum(left, right)
    while len(active):
        at = shared[active]
        x = words[np.minimum(left[active] + at, size - 1)] ^ words[np.minimum(right[active] + at, size - 1)]
        equal = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) // 8)
        shared[active] = np.minimum(at + equal, limit[active])
        active = active[(equal == 8) & (shared[active] < limit[active])]
    nearest = np.maximum.accumulate(np.where(follows, 0, np.arange(size)))
    head_of = np.cumsum(~follows) - 1
    return np.maximum(shared[head_of] - (np.arange(size) - nearest), 0)


def repeated_starts(text: np.ndarray, valid: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(repeated, first) of one shard: which valid positions start a string of ``length`` bytes that a smaller valid position
    starts too, and those that are the smallest of their string."""
    repeated, first = np.zeros(len(text), bool), np.zeros(len(text), bool)
    if not valid.any():
        return repeated, first
    order = suffix_array(text, length)
    classes = np.cumsum(common_prefixes(text, order)[order] < length)
    use = valid[order]
    places, classes = order[use], classes[use]
    cuts = np.concatenate([[0], np.flatnonzero(classes[1:] != classes[:-1]) + 1])
    smallest = np.minimum.reduceat(places, cuts)
    first[smallest] = True
    repeated[places] = True
    repeated[smallest] = False
    return repeated, first
