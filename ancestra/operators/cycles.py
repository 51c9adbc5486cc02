"""Edges that close a cycle as they come, found by halving the order.

An edge closes a cycle if its ends are strongly connected as soon as it is there. When two ends become so is searched
for all edges at once: strong components of the earlier half of a range, in which edges within a component go on with the earlier
half, and the others, between components, with the later. Each edge is in one range at a time, so edges are gone through
as often as a range can be halved, on arrays of numbers.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


def closing(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """For edges ``src[i] -> dst[i]`` between vertices 0 to n - 1, in order: whether dst reached src over the edges before (self-loops included)."""
    src, dst = np.asarray(src, np.int32), np.asarray(dst, np.int32)
    result = src == dst
    label = components(src, dst, n)
    at = np.flatnonzero(~result & (label[src] == label[dst])).astype(np.int32)
    a, b = src[at], dst[at]
    low, high = np.zeros(len(at), np.int32), np.full(len(at), len(src) - 1, np.int32)
    while len(at):
        # vertices of different ranges have different numbers, so one pass finds the components of all
        used = np.zeros(n, bool)
        used[a] = used[b] = True
        new = np.cumsum(used, dtype=np.int32) - 1
        a, b, n = new[a], new[b], int(new[-1]) + 1
        mid = low + (high - low) // 2
        early = at <= mid
        label = components(a[early], b[early], n)
        one = label[a] == label[b]
        result[at[one & ~early]] = True
        later = ~one
        a, b = np.where(later, label[a] + np.int32(n), a), np.where(later, label[b] + np.int32(n), b)
        low, high, n = np.where(later, mid + 1, low), np.where(later, high, mid), 2 * n
        left = later | early
        found = left & (low == high)
        result[at[found & (at == low)]] = True
        left &= ~found
        a, b, at, low, high = a[left], b[left], at[left], low[left], high[left]
    return result


def components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For vertices 0 to n - 1 one vertex of their strong component, over edges ``a[i] -> b[i]``."""
    label = np.arange(n, dtype=np.int32)
    while len(a):  # without edges from where none leads, or to where none goes on
        into, out = np.zeros(n, bool), np.zeros(n, bool)
        into[b] = out[a] = True
        kept = into[a] & out[b]
        before = len(a)
        a, b = a[kept], b[kept]
        if len(a) > 0.95 * before:
            break
    if not len(a):
        return label
    used = np.zeros(n, bool)
    used[a] = used[b] = True
    names = np.flatnonzero(used).astype(np.int32)
    new = np.cumsum(used, dtype=np.int32) - 1
    a, b = new[a], new[b]
    start = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=len(names)))])
    label[names] = names[_components(start, b[np.argsort(a, kind="stable")], len(names))]
    return label


def _components(start: np.ndarray, heads: np.ndarray, n: int) -> np.ndarray:
    """Tarjan's algorithm without recursion; the heads of ``v`` are ``heads[start[v]:start[v + 1]]``."""
    links = memoryview(heads)
    todo = start.tolist()
    end = todo[1:]
    number, low = [0] * n, [0] * n
    done = n + 1
    root = np.zeros(n, np.int32)
    count = 0
    open_: list[int] = []
    for first in range(n):
        if number[first]:
            continue
        count += 1
        number[first] = low[first] = count
        open_.append(first)
        path = [first]
        while path:
            v = path[-1]
            i, last, least = todo[v], end[v], low[v]
            while i < last:
                w = links[i]
                i += 1
                x = number[w]
                if not x:
                    count += 1
                    number[w] = low[w] = count
                    open_.append(w)
                    path.append(w)
                    break
                if x < least:
                    least = x
            else:
                path.pop()
                if least == number[v]:
                    while True:
                        w = open_.pop()
                        number[w] = done
                        root[w] = v
                        if w == v:
                            break
                elif least < low[path[-1]]:
                    low[path[-1]] = least
            todo[v], low[v] = i, least
    return root


def ranks(edges: Iterable[tuple]) -> tuple[np.ndarray, np.ndarray, int]:
    """Ends of edges as numbers from 0."""
    codes: dict = {}
    pairs = np.array([(codes.setdefault(a, len(codes)), codes.setdefault(b, len(codes))) for a, b in edges], np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1], len(codes)
