"""Sorted runs of byte strings, front-coded, and their merge by a loser tree that never compares a known common prefix again."""

from __future__ import annotations

from collections.abc import Iterator

Entry = tuple[int, bytes, int]  # common prefix with the one before, string, id


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """The length of the common prefix of a and b, of which `known` bytes are known to be equal."""
    most, at = min(len(a), len(b)), known
    while at < most:
        x, y = a[at : at + 64], b[at : at + 64]
        if x != y:
            n = min(len(x), len(y))
            diff = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
            return at + n - (diff.bit_length() + 7) // 8 if diff else at + n
        at += 64
    return most


def front_code(strings: list[tuple[bytes, int]]) -> tuple[bytes, list[int], list[int], list[int]]:
    """Sorted (string, id) as the joined tails that the common prefixes leave, with the prefixes' lengths, tails' lengths and ids."""
    tails, prefixes, lengths, ids, last = [], [], [], [], b""
    for s, i in strings:
        n = common_prefix(last, s)
        tails.append(s[n:])
        prefixes.append(n)
        lengths.append(len(s) - n)
        ids.append(i)
        last = s
    return b"".join(tails), prefixes, lengths, ids


def decode(tails: bytes, prefixes: list[int], lengths: list[int], ids: list[int]) -> Iterator[Entry]:
    last, at = b"", 0
    for n, m, i in zip(prefixes, lengths, ids):
        last = last[:n] + tails[at : at + m]
        at += m
        yield n, last, i


def merge(runs: list[Iterator[Entry]]) -> Iterator[Entry]:
    """All runs' strings in order, each with the length of its common prefix with the one before.

    Each leaf's head is known by its common prefix with the last string that went out. Of two heads the one with the longer prefix
    is smaller; only where the prefixes are equally long are bytes compared, from there on."""
    k = 1
    while k < len(runs):
        k *= 2
    heads: list[Entry | None] = [next(r, None) for r in runs] + [None] * (k - len(runs))
    prefix = [0] * k  # of each leaf's head with the last one out
    tree = [0] * k  # losers

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's prefix becomes that with the winner."""
        x, y = heads[a], heads[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        p, q = prefix[a], prefix[b]
        if p > q:
            return a, b
        if p < q:
            return b, a
        s, t = x[1], y[1]
        n = common_prefix(s, t, p)
        if n == len(s) or (n < len(t) and s[n] < t[n]):
            prefix[b] = n
            return a, b
        prefix[a] = n
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, tree[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1) if k > 1 else 0
    while (head := heads[winner]) is not None:
        yield prefix[winner], head[1], head[2]
        heads[winner] = nxt = next(runs[winner], None)
        prefix[winner] = nxt[0] if nxt else 0
        node = (winner + k) // 2
        while node:
            winner, tree[node] = play(winner, tree[node])
            node //= 2
