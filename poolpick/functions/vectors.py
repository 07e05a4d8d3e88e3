"""Vector arithmetic: numpy block kernels.

The block kernels run inside one pool block x target block cell at a
time; the whole pool x target matrix never exists.
"""

from __future__ import annotations

import numpy as np

# pool rows x target rows handled per numpy block (bounds task memory)
BLOCK_CELLS = 1 << 22


def arrow_matrix(col) -> np.ndarray:
    """A pyarrow list<double> column of equal-length vectors as a float64 matrix,
    straight from the values buffer (no per-row Python)."""
    n = len(col)
    if n == 0:
        return np.zeros((0, 0), dtype=np.float64)
    if col.null_count:
        raise ValueError("NULL vector in input")
    offs = col.offsets.to_numpy()
    lens = np.diff(offs)
    d = int(lens[0])
    if not np.all(lens == d):
        raise ValueError("vectors differ in length")
    vals = col.values.to_numpy(zero_copy_only=False)[offs[0]:offs[-1]]
    return vals.astype(np.float64, copy=False).reshape(n, d)


def block_rows(n_targets: int) -> int:
    return max(1, BLOCK_CELLS // max(1, n_targets))


def sq_dists(p: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared L2 distances [len(p), len(t)] via one matrix product, and a bound of their error.

    Both sides are shifted by the targets' mean first, so vectors far from the
    origin lose no digits to cancellation.
    """
    mean = t.mean(axis=0)
    return shifted_sq_dists(p - mean, t - mean)


def shifted_sq_dists(p: np.ndarray, t: np.ndarray, t_sq: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """``sq_dists`` of sides that are shifted already; one array of [len(p), len(t)] and no temporaries of that size."""
    p_sq, t_sq = sq_norms(p), sq_norms(t) if t_sq is None else t_sq
    d2 = p @ t.T
    d2 *= -2.0
    d2 += p_sq[:, None]
    d2 += t_sq
    np.maximum(d2, 0.0, out=d2)
    return d2, 1e-13 * max(1, p.shape[1]) * (p_sq.max(initial=0.0) + t_sq.max(initial=0.0))


def sq_norms(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def pair_dists(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """L2 distance of row i of ``p`` to row i of ``t`` by direct differences: the same for a pair in any block."""
    diff = p - t
    return np.sqrt(np.einsum("ij,ij->i", diff, diff))


MIN_NORM = 1e-8  # norms below count as this, so a zero vector has similarity 0


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), MIN_NORM)[:, None]
