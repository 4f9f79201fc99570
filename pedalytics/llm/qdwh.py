"""Eigenvectors of symmetric matrices by spectral divide and conquer on QDWH polar factors."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
STEPS = 60          # far more than the six or so that the iteration takes
SHIFTS = 24         # shifts tried for one block


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix: its sign function where it is not singular.

    Dynamically weighted Halley iteration: the weights follow a lower bound of
    the singular values, so about six steps do; steps with large weights are
    done by a QR factorisation of the stacked matrix, the last ones by
    Cholesky factors.
    """
    n = len(a)
    scale = np.linalg.norm(a)
    if not scale:
        return np.zeros_like(a)
    x, eye = a / scale, np.eye(n)
    try:
        least = 1 / np.linalg.norm(np.linalg.inv(x))
    except np.linalg.LinAlgError:
        least = EPS
    low = min(max(least, EPS), 1.0)
    for _ in range(STEPS):
        square = low * low
        d = np.cbrt(4 * max(1 - square, 0.0) / (square * square))
        root = np.sqrt(1 + d)
        wa = root + np.sqrt(max(8 - 4 * d + 8 * (2 - square) / (square * root), 0.0)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))
            after = (wb / wc) * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        else:
            factor = np.linalg.cholesky(eye + wc * (x.T @ x))
            half = np.linalg.solve(factor, x.T)
            after = (wb / wc) * x + (wa - wb / wc) * np.linalg.solve(factor.T, half).T
        after = (after + after.T) / 2
        low = min(low * (wa + wb * square) / (1 + wc * square), 1.0)
        moved, x = np.linalg.norm(after - x), after
        if moved < np.cbrt(EPS) * 0.1 and abs(1 - low) < 1e-8:
            break
    return x


def _split(a: np.ndarray, shift: float, allowed: float) -> tuple[np.ndarray, int] | None:
    """An orthogonal basis whose first k columns span the eigenvectors above ``shift``, if there is a clean cut."""
    n = len(a)
    projector = (polar_factor(a - shift * np.eye(n)) + np.eye(n)) / 2
    k = round(float(np.trace(projector)))
    if not 0 < k < n:
        return None
    start = np.random.default_rng(n).standard_normal((n, k))
    for _ in range(2):  # subspace iteration on the projector
        start, _ = np.linalg.qr(projector @ start)
    basis, _ = np.linalg.qr(start, mode="complete")
    if np.linalg.norm(basis[:, k:].T @ a @ basis[:, :k]) > allowed:
        return None
    return basis, k


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns, largest entry positive) of a symmetric matrix.

    A shifted matrix's polar factor is the sign of its eigenvalues; half of
    one plus it projects on the invariant subspace above the shift.  The block
    is turned to that subspace and its complement and both are split again,
    down to single directions or blocks that are diagonal to rounding.
    """
    n = len(matrix)
    whole = np.linalg.norm(matrix)
    exact = n * EPS * whole
    values, vectors = np.zeros(n), np.zeros((n, n))
    todo, done = [((matrix + matrix.T) / 2, np.eye(n))], 0
    while todo:
        a, basis = todo.pop()
        diagonal = np.diag(a).copy()
        if len(a) > 1 and np.linalg.norm(a - np.diag(diagonal)) > exact / 8:
            cut = None
            spread = max(np.linalg.norm(a - diagonal.mean() * np.eye(len(a))), exact)
            for i in range(SHIFTS):
                # the mean of the eigenvalues always lies between the least and the largest; the others balance better
                shift = (float(np.median(diagonal)), float(diagonal.mean()))[i % 2]
                shift += (i // 2) * spread * 1e-3 * (1 if i % 4 < 2 else -1)
                cut = _split(a, shift, exact * 8)
                if cut:
                    break
            if cut is None:
                raise ArithmeticError("no shift separates the spectrum")
            turn, k = cut
            for part in (turn[:, :k], turn[:, k:]):
                block = part.T @ a @ part
                todo.append(((block + block.T) / 2, basis @ part))
            continue
        values[done:done + len(a)], vectors[:, done:done + len(a)] = diagonal, basis
        done += len(a)
    # products of many bases: orthogonal again, and what is left beside the diagonal taken to first order
    vectors, _ = np.linalg.qr(vectors)
    rest = vectors.T @ matrix @ vectors
    values = np.diag(rest).copy()
    gap = values[None, :] - values[:, None]
    apart = np.abs(gap) > 1e6 * exact
    vectors, upper = np.linalg.qr(vectors + vectors @ np.where(apart, rest / np.where(apart, gap, 1.0), 0.0))
    vectors *= np.where(np.diag(upper) < 0, -1.0, 1.0)
    values = np.einsum("ij,ij->j", vectors, matrix @ vectors)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(n)]
    return values, vectors * np.where(largest < 0, -1.0, 1.0)
