"""Recursive graph bisection of documents by their terms, for operator 12.

A segment of documents is halved, and documents change sides in pairs as long as that lowers the estimated bits of the terms'
gap-coded postings: sum over terms and sides of d * log2(n / (d + 1)), d being the term's documents among the side's n.
All segments of a level are treated at once.
"""

from __future__ import annotations

import numpy as np

ROUNDS = 6


def move_costs(held: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What one more and one less document of a term costs, for counts (segments, sides, terms)
    and sizes (segments, sides)."""
    logs = np.log2(np.arange(1, int(held.max(initial=0)) + 4, dtype=np.float32))
    n = np.log2(np.maximum(sizes, 1)).astype(np.float32)[:, :, None]
    d = held.astype(np.float32)
    now = d * (n - logs[held])
    less = np.maximum(held - 1, 0)
    return (d + 1) * (n - logs[held + 1]) - now, less.astype(np.float32) * (n - logs[less]) - now


def bisect(doc: np.ndarray, term: np.ndarray, n_docs: int, n_terms: int, levels: int, rounds: int = ROUNDS) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order of the documents after ``levels`` halvings, and for each level the preference (segments, terms)
    of a term's documents: what joining the right half costs less what joining the left one costs.

    ``doc`` and ``term`` are the edges of the graph. Segments that follow one another in the order are halves of one segment.
    """
    order, borders, preferences = np.arange(n_docs), np.array([0, n_docs]), []
    for _ in range(levels):
        middles = (borders[:-1] + borders[1:]) // 2
        segment = np.repeat(np.arange(len(middles)), np.diff(borders))
        sizes = np.stack([middles - borders[:-1], borders[1:] - middles], axis=1)
        side = (np.arange(n_docs) >= middles[segment]).astype(np.int64)
        cell = np.empty(n_docs, np.int64)
        shape = (len(middles), 2, n_terms)
        for _ in range(rounds):
            cell[order] = segment * 2 + side
            edge = cell[doc] * n_terms + term
            held = np.bincount(edge, minlength=len(middles) * 2 * n_terms).reshape(shape)
            more, less = move_costs(held, sizes)
            gain = np.bincount(doc, weights=-(less + more[:, ::-1]).reshape(-1)[edge], minlength=n_docs)[order]
            # By segment, side and falling gain: the i-th of either side are a pair.
            at = np.lexsort((-gain, side, segment))
            paired = np.arange(n_docs) - borders[segment] < sizes[segment, 0]
            left = np.flatnonzero(paired)
            right = left + sizes[segment[left], 0]
            swap = gain[at[left]] + gain[at[right]] > 1e-6
            a, b = at[left[swap]], at[right[swap]]
            order[a], order[b] = order[b], order[a]
            if not swap.any():
                break
        cell[order] = segment * 2 + side
        held = np.bincount(cell[doc] * n_terms + term, minlength=len(middles) * 2 * n_terms).reshape(shape)
        more, _ = move_costs(held, sizes)
        preferences.append(more[:, 1] - more[:, 0])
        borders = np.sort(np.concatenate([borders, middles]))
    return order, preferences


def routed(doc: np.ndarray, term: np.ndarray, n_docs: int, preferences: list[np.ndarray]) -> np.ndarray:
    """The leaf to which each document goes: at every level the half where its terms cost less."""
    leaf = np.zeros(n_docs, np.int64)
    for preference in preferences:
        right = np.bincount(doc, weights=preference[leaf[doc], term], minlength=n_docs) < 0
        leaf = leaf * 2 + right
    return leaf
