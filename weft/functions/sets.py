"""Set similarity, hierarchical clustering and sampling on driver- or group-sized inputs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np

EPSILON = 1e-9
SIMILARITY, TEMPLATE_SHARE, SPLIT_FROM, CONTAINMENT, CHROME = 0.8, 0.9, 10, 0.9, 0.8
DEPTHS, KNEE = (1, 2, 3, 4, 5, 6, 8, 10), 1.5
TOKENS_AT_ONCE, ROWS_AT_ONCE = 1_024, 512


def jaccard(a: frozenset | set, b: frozenset | set) -> float:
    if not a and not b:
        return 1.0
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def similarity_matrix(sets: Sequence[frozenset | set]) -> np.ndarray:
    """All pairs' Jaccard similarities by products of 0/1 rows, a slice of tokens and of rows at a time: one n x n matrix is held."""
    ids: dict[str, int] = {}
    rows = [[ids.setdefault(t, len(ids)) for t in s] for s in sets]
    sizes = np.array([len(r) for r in rows], np.float64)
    at, of = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.array([i for r in rows for i in r], int)
    out = np.zeros((len(sets), len(sets)))
    for start in range(0, len(ids), TOKENS_AT_ONCE):
        here = (of >= start) & (of < start + TOKENS_AT_ONCE)
        x = np.zeros((len(sets), min(TOKENS_AT_ONCE, len(ids) - start)), np.float32)
        x[at[here], of[here] - start] = 1
        for i in range(0, len(sets), ROWS_AT_ONCE):
            out[i : i + ROWS_AT_ONCE] += x[i : i + ROWS_AT_ONCE] @ x.T
    for i in range(0, len(sets), ROWS_AT_ONCE):
        both = out[i : i + ROWS_AT_ONCE]
        union = sizes[i : i + ROWS_AT_ONCE, None] + sizes[None] - both
        out[i : i + ROWS_AT_ONCE] = np.divide(both, union, out=np.ones_like(both), where=union > 0)
    return out


def dendrogram(sets: Sequence[frozenset | set]) -> list[tuple[int, int, float]]:
    """(survivor, dead, height) of complete linkage by nearest-neighbour chains; ties go to the lower index."""
    return linkage(similarity_matrix(sets)) if len(sets) > 1 else []


def linkage(s: np.ndarray) -> list[tuple[int, int, float]]:
    """dendrogram() of a similarity matrix, which is overwritten."""
    n = len(s)
    np.fill_diagonal(s, -np.inf)
    alive, chain, out = np.ones(n, bool), [], []
    while len(out) < n - 1:
        if not chain:
            chain.append(int(np.argmax(alive)))
        top = chain[-1]
        row = np.where(alive, s[top], -np.inf)
        row[top] = -np.inf
        best = int(np.argmax(row))
        if len(chain) > 1 and best == chain[-2]:
            height = float(row[best])
            del chain[-2:]
            keep, gone = min(top, best), max(top, best)
            joined = np.minimum(s[top], s[best])
            s[keep], s[:, keep] = joined, joined
            s[keep, keep] = -np.inf
            alive[gone] = False
            out.append((keep, gone, height))
        else:
            chain.append(best)
    return out


def root_of(parent: list[int] | dict, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def labels_at(n: int, merges: list[tuple[int, int, float]], threshold: float) -> list[int]:
    parent = list(range(n))
    for keep, gone, height in merges:
        if height >= threshold - EPSILON:
            parent[root_of(parent, gone)] = root_of(parent, keep)
    return [root_of(parent, i) for i in range(n)]


def auto_cut(heights: Sequence[float], upper: float) -> float:
    """The middle of the widest gap in descending order (the first of equals), at most `upper`."""
    h = sorted(heights, reverse=True)
    gaps = [a - b for a, b in zip(h, h[1:])]
    if not gaps or max(gaps) == 0:
        return upper
    i = gaps.index(max(gaps))
    return min((h[i] + h[i + 1]) / 2, upper)


def first_seen(roots: Sequence[int]) -> list[str]:
    names: dict[int, str] = {}
    return [names.setdefault(r, f"cluster:{len(names)}") for r in roots]


def structural_clusters(sets: Sequence[frozenset | set], threshold: float = SIMILARITY) -> list[str]:
    return first_seen(labels_at(len(sets), dendrogram(sets), threshold))


def split_by_frequency(tokens: set, frequency: Counter, pages: int, threshold: float = TEMPLATE_SHARE) -> tuple[set, set]:
    """(template tokens, content tokens)."""
    if not 0 < threshold <= 1:
        raise ValueError(f"the threshold is a share in (0, 1], not {threshold}")
    common = {t for t in tokens if pages and frequency[t] >= threshold * pages - EPSILON}
    return common, set(tokens) - common


def comparison_sets(sets: Sequence[set], weights: Sequence[int] | None = None) -> list[set]:
    """The sets' content tokens. A set with a weight stands for as many equal ones."""
    weights = weights or [1] * len(sets)
    if sum(weights) < SPLIT_FROM:
        return list(sets)
    frequency: Counter = Counter()
    for s, w in zip(sets, weights):
        for t in s:
            frequency[t] += w
    return [split_by_frequency(s, frequency, sum(weights))[1] or s for s in sets]


def auto_cut_roots(sets: Sequence[frozenset | set], weights: Sequence[int], upper: float = SIMILARITY) -> list[int]:
    """The roots of complete linkage at the auto-cut. Equal sets merge first, at 1, so each is clustered once, with its share of heights."""
    ids: dict[frozenset, int] = {}
    place = [ids.setdefault(frozenset(s), len(ids)) for s in sets]
    merges = dendrogram(list(ids))
    roots = labels_at(len(ids), merges, auto_cut([h for _, _, h in merges] + [1.0] * (sum(weights) - len(ids)), upper))
    return [roots[i] for i in place]


def contained(clusters: dict[int, tuple[set, int]], cutoff: float = CONTAINMENT) -> dict[int, int]:
    """Each cluster (tokens, pages) to the one that absorbs it: the best at containing it, then with the larger union, then with more pages; chains are followed, cycles end at their largest."""
    into: dict[int, int] = {}
    for x, (tokens, _) in clusters.items():
        if not tokens:
            continue
        best = None
        for y, (others, pages) in clusters.items():
            both = len(tokens & others)
            if y != x and both / len(tokens) >= cutoff:
                rank = (both / len(tokens), len(tokens) + len(others) - both, pages)
                if best is None or rank > best[0]:
                    best = (rank, y)
        if best:
            into[x] = best[1]
    return followed(into, {c: (len(t), n) for c, (t, n) in clusters.items()})


def followed(into: dict[int, int], clusters: dict[int, tuple[int, int]]) -> dict[int, int]:
    """Each of the clusters (tokens, pages) to the end of its chain; a cycle ends at its largest."""
    done: dict[int, int] = {}
    for start in clusters:
        path, at = [], start
        while at not in done and at in into and at not in path:
            path.append(at)
            at = into[at]
        if at in done:
            end = done[at]
        elif at in path:  # a cycle
            loop = path[path.index(at) :]
            end = max(loop, key=lambda c: clusters[c])
        else:
            end = at
        done.update(dict.fromkeys([*path, at], end))
    return done


def edit_distance(a: Sequence, b: Sequence) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def fnv1a(text: str) -> int:
    h = 2166136261
    units = text.encode("utf-16-le", "surrogatepass")
    for i in range(0, len(units), 2):
        unit = int.from_bytes(units[i : i + 2], "little")
        if 0xD800 <= unit < 0xDC00 and i + 3 < len(units):  # the code point that begins here
            low = int.from_bytes(units[i + 2 : i + 4], "little")
            if 0xDC00 <= low < 0xE000:
                unit = 0x10000 + ((unit - 0xD800) << 10) + low - 0xDC00
        h = ((h ^ unit) * 16777619) & 0xFFFFFFFF
    return h


def uniform_stream(seed: int | str):
    """Numbers in [0, 1) of a 32-bit generator; text seeds are hashed."""
    state = (fnv1a(seed) if isinstance(seed, str) else seed) & 0xFFFFFFFF
    while True:
        state = (state + 1831565813) & 0xFFFFFFFF
        t = ((state ^ state >> 15) * (state | 1)) & 0xFFFFFFFF
        t ^= (t + (((t ^ t >> 7) * (t | 61)) & 0xFFFFFFFF)) & 0xFFFFFFFF
        yield ((t ^ t >> 14) & 0xFFFFFFFF) / 4294967296


def reservoir(n: int, size: int, seed: int | str = 0) -> list[int]:
    """Places of a uniform sample of `size` of n items, in order."""
    if size < 0:
        raise ValueError("the sample's size isn't negative")
    if size >= n:
        return list(range(n))
    kept, draw = list(range(size)), uniform_stream(seed)
    for i in range(size, n):
        if not size:
            break
        j = int(next(draw) * (i + 1))
        if j < size:
            kept[j] = i
    return sorted(kept)


def shell(pages: Sequence[Sequence[set]]) -> set:
    """Tokens whose share of pages with a landmark instance that has them reaches the cut."""
    count = Counter(t for page in pages for t in set().union(*page))
    if not count:
        return set()
    cut = auto_cut([c / len(pages) for c in count.values()], CHROME)
    return {t for t, c in count.items() if c / len(pages) >= cut}


def is_chrome(tokens: set, shell_tokens: set, threshold: float = CHROME) -> bool:
    return bool(tokens) and len(tokens & shell_tokens) / len(tokens) >= threshold


def depth_cap(pages: Sequence[str], depths: Sequence[int] = DEPTHS, knee: float = KNEE) -> int:
    """The depth before the steepest rise (of at least `knee`) in the number of clusters; else the last."""
    from weft.functions.skeleton import cap_depth, tokenize

    if not depths or list(depths) != sorted(set(depths)) or not knee > 1:
        raise ValueError("depths ascend strictly and the knee ratio is over 1")
    return knee_depth([[set(tokenize(cap_depth(p, d))[0]) for p in pages] for d in depths], depths, knee)


def knee_depth(sets: Sequence[Sequence[set]], depths: Sequence[int] = DEPTHS, knee: float = KNEE) -> int:
    """depth_cap() of the pages' token sets at each depth; equal sets share a cluster, so each counts once."""
    counts = [len(set(structural_clusters(list(dict.fromkeys(map(frozenset, at)))))) for at in sets]
    rises = [(b / a, i) for i, (a, b) in enumerate(zip(counts, counts[1:])) if a and b / a >= knee]
    return depths[max(rises, key=lambda r: (r[0], -r[1]))[1]] if rises else depths[-1]
