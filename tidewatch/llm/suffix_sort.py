"""Deep-shallow sorting of byte strings: multikey quicksort to a shallow depth, then blind tries."""

from __future__ import annotations

import numpy as np

#: Eight bytes are one character of the quicksort; this many of them are its depth.
SHALLOW = 8


def as_words(strings: list[bytes]) -> np.ndarray:
    """One row of big-endian 64-bit words for each string, padded with zeros."""
    width = max(1, -(-max(map(len, strings), default=1) // 8))
    flat = b"".join(s.ljust(8 * width, b"\0") for s in strings)
    return np.frombuffer(flat, ">u8").reshape(len(strings), width).astype(np.uint64)


def multikey_quicksort(words: np.ndarray, depth: int = SHALLOW) -> list[np.ndarray]:
    """Groups of row numbers in order; the rows of a group agree in the first `depth` words."""
    depth = min(depth, words.shape[1])
    out, stack = [], [(np.arange(len(words)), 0)]
    while stack:
        rows, at = stack.pop()
        if len(rows) < 2 or at == depth:
            if len(rows):
                out.append(rows)
            continue
        key = words[rows, at]
        pivot = np.partition(key[:: max(1, len(key) // 9)], len(key[:: max(1, len(key) // 9)]) // 2)[len(key[:: max(1, len(key) // 9)]) // 2]
        less, more = key < pivot, key > pivot
        stack.append((rows[more], at))
        stack.append((rows[~(less | more)], at + 1))
        stack.append((rows[less], at))
    return out


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class BlindTrie:
    """A trie that keeps only the places where strings differ; a string is compared with one leaf when it is added."""

    def __init__(self):
        self.root = None  # a leaf is (string, ids), a branch is [place, {byte or -1: child}]

    def add(self, s: bytes, i: int) -> None:
        if self.root is None:
            self.root = (s, [i])
            return
        node = self.root
        while isinstance(node, list):
            place, children = node
            child = children.get(s[place] if place < len(s) else -1)
            node = child if child is not None else next(iter(children.values()))
        found, ids = node
        n = common_prefix(s, found)
        if n == len(s) == len(found):
            ids.append(i)
            return
        above, key, node = None, None, self.root
        while isinstance(node, list) and node[0] < n:
            above, key = node, s[node[0]] if node[0] < len(s) else -1
            node = node[1][key]
        new = s[n] if n < len(s) else -1
        if isinstance(node, list) and node[0] == n:
            node[1][new] = (s, [i])
            return
        branch = [n, {found[n] if n < len(found) else -1: node, new: (s, [i])}]
        if above is None:
            self.root = branch
        else:
            above[1][key] = branch

    def order(self) -> list[int]:
        out, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack += [node[1][k] for k in sorted(node[1], reverse=True)]
            else:
                out += node[1]
        return out


def deep_shallow_sort(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): row numbers in order of their strings, and the common prefix of each with the one before (0 for the first)."""
    if not strings:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    words = as_words(strings)
    order = []
    for group in multikey_quicksort(words):
        if len(group) == 1:
            order.append(int(group[0]))
            continue
        trie = BlindTrie()
        for i in group.tolist():
            trie.add(strings[i], i)
        order += trie.order()
    order = np.array(order, np.int64)
    length = np.array([len(s) for s in strings], np.int64)[order]
    lcp = np.zeros(len(order), np.int64)
    for lo in range(1, len(order), 65536):
        hi = min(len(order), lo + 65536)
        apart = words[order[lo:hi]] ^ words[order[lo - 1 : hi - 1]]
        differ = apart != 0
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), words.shape[1])
        x = apart[np.arange(hi - lo), np.minimum(first, words.shape[1] - 1)]
        lead = np.zeros(hi - lo, np.int64)  # equal leading bytes of the first word that differs
        for byte in range(1, 8):
            lead += (x >> np.uint64(64 - 8 * byte)) == 0
        lcp[lo:hi] = np.minimum(8 * first + np.where(first < words.shape[1], lead, 0), np.minimum(length[lo:hi], length[lo - 1 : hi - 1]))
    return order, lcp
