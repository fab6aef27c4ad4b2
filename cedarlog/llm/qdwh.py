"""Eigenvectors of a symmetric matrix by spectral divide and conquer over polar decompositions."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps


def polar(a: np.ndarray, lower: float) -> np.ndarray:
    """The orthogonal factor of ``a`` by the QR-based dynamically weighted Halley iteration.

    ``lower`` is a lower bound of the smallest singular value over the largest.
    """
    n = len(a)
    x = a / max(np.linalg.norm(a, 2), np.finfo(float).tiny)
    low = min(max(lower, EPS), 1.0)
    eye = np.eye(n)
    for _ in range(40):
        # weights of the rational function that lifts all of [low, 1] closest to 1
        d = np.cbrt(4 * (1 - low * low) / low**4)
        root = np.sqrt(1 + d)
        wa = root + 0.5 * np.sqrt(max(8 - 4 * d + 8 * (2 - low * low) / (low * low * root), 0.0))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.concatenate([np.sqrt(wc) * x, eye]))
        step = (wb / wc) * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        moved = np.linalg.norm(step - x)
        x = (step + step.T) / 2
        low = min(low * (wa + wb * low * low) / (1 + wc * low * low), 1.0)
        if moved <= np.cbrt(10 * EPS) * np.sqrt(n) and 1 - low < 10 * EPS:
            break
    return x


def _basis(projector: np.ndarray, rank: int, rng: np.random.Generator) -> np.ndarray:
    """An orthogonal matrix whose first ``rank`` columns span the projector's range."""
    n = len(projector)
    q, _ = np.linalg.qr(rng.normal(size=(n, n)))
    for _ in range(2):  # the projector's eigenvalues are 1 and 0, so that twice is enough
        inside = projector @ q[:, :rank]
        q, _ = np.linalg.qr(np.concatenate([inside, q[:, rank:] - projector @ q[:, rank:]], axis=1))
    return q


def _split(a: np.ndarray, scale: float, rng: np.random.Generator) -> tuple[np.ndarray, int] | None:
    """(orthogonal matrix, how many of its columns belong to the larger eigenvalues), or None if all are equal."""
    n = len(a)
    mean = np.trace(a) / n
    spread = np.linalg.norm(a - mean * np.eye(n))
    if spread <= 4 * n * EPS * scale:
        return None
    best = None
    for nudge in (0.0, 0.11, -0.13, 0.29, -0.31, 0.53, -0.59, 0.83, -0.89):
        shifted = a - (mean + nudge * spread / np.sqrt(n)) * np.eye(n)
        factor = polar(shifted, EPS)
        projector = (factor + np.eye(n)) / 2
        rank = int(np.rint(np.trace(projector)))
        if not 0 < rank < n:
            continue
        q = _basis(projector, rank, rng)
        rest = np.linalg.norm(q[:, rank:].T @ a @ q[:, :rank])
        if best is None or rest < best[0]:
            best = (rest, q, rank)
        if rest <= 8 * n * EPS * scale:  # else the shift lay on an eigenvalue
            break
    return best[1:] if best else None


def top_components(a: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues, falling, and their unit eigenvectors as columns.

    Each polar decomposition of the shifted matrix gives the projector onto the
    eigenvalues above the shift; both sides are split further until a side is one
    vector or has equal eigenvalues. Sides beyond the first ``count`` are left whole.
    A vector's entry of the largest size is positive.
    """
    a = (a + a.T) / 2
    n = len(a)
    scale = max(float(np.linalg.norm(a, 2)), np.finfo(float).tiny) if n else 0.0
    rng = np.random.default_rng(5)
    found: list[np.ndarray] = []
    todo = [np.eye(n)] if n else []
    while todo and len(found) < count:
        basis = todo.pop()
        own = basis.T @ a @ basis
        parts = _split((own + own.T) / 2, scale, rng) if basis.shape[1] > 1 else None
        if parts is None:
            found += list(basis.T)
            continue
        q, rank = parts
        todo += [basis @ q[:, rank:], basis @ q[:, :rank]]  # the larger ones next
    vectors = np.array(found[: max(count, 0)]).reshape(-1, n).T
    values = np.einsum("ij,ik,kj->j", vectors, a, vectors) if vectors.size else np.zeros(0)
    order = np.argsort(-values, kind="stable")
    vectors, values = vectors[:, order], values[order]
    if vectors.size:
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1, 1)
    return values, vectors
