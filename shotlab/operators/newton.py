"""Kernel-form Newton solver for L2-regularised logistic regression (numpy, per group).

Objective (as the reference's linear model): C * sum_i loss_i + 1/2 ||W||^2,
intercept unpenalised. By the representer theorem W = A^T X, so the fit
needs only the Gram matrix K = X X^T of the (few) training rows: n*L
unknowns whatever the number of features. Binary uses the sigmoid loss,
three or more classes the multinomial (softmax) loss. Newton steps come from
conjugate gradients in the eigenvectors of K, so memory is that of K.
"""

from __future__ import annotations

import numpy as np


def _logsumexp(F):
    m = F.max(axis=1, keepdims=True)
    return (m + np.log(np.exp(F - m).sum(axis=1, keepdims=True)))[:, 0]


# Largest gradient entry, relative to 1 + C, at which a fit counts as converged.
LIMIT = 1e-3


def _converged(g: float, C: float) -> None:
    if not g <= LIMIT * (1.0 + C):
        raise RuntimeError(f"the Newton fit stopped with a gradient of {g:.3g} at C={C}")


#: Conjugate-gradient products of one Newton step, and Newton steps of one fit.
CG, STEPS = 200, 200


class Basis:
    """A kernel matrix with its eigenvectors, shared by the fits of all C.

    In them a Hessian with equal row weights is diagonal, which is the scaling of the
    conjugate gradients. Memory is two n x n matrices, whatever the number of classes."""

    def __init__(self, K):
        self.K = K
        value, self.vec = np.linalg.eigh((K + K.T) / 2)
        self.value = np.maximum(value, 0.0)

    def scale(self, D, c, h):
        """(I + c * h_l * K)^-1 D, column by column."""
        return self.vec @ ((self.vec.T @ D) / (1.0 + c * self.value[:, None] * h[None, :]))


def _curve(P, U, binary):
    return P * (1 - P) * U if binary else P * (U - (P * U).sum(axis=1, keepdims=True))


def _parts(F, Y, binary):
    """Sum of losses, probabilities."""
    if binary:
        return float(np.sum(np.logaddexp(0.0, F) - Y * F)), np.exp(-np.logaddexp(0.0, -F))
    return float(np.sum(_logsumexp(F) - np.sum(F * Y, axis=1))), np.exp(F - _logsumexp(F)[:, None])


def _minimise(basis, Y, C, binary, tol, max_iter, init):
    """Newton steps on coefficients A (n, l) and intercepts b (l), W = X'A, without ever forming a
    Hessian: its product with a direction (D, e) is D + C H(K D + e), C sum H(K D + e).

    Gradients and directions are coefficient pairs; products of two of them are tr(D' K D) + e'e,
    the primal ones, in which the Hessian is symmetric."""
    K, (n, k) = basis.K, Y.shape
    A, b = (np.zeros((n, k)), np.zeros(k)) if init is None else (init[0].copy(), init[1].copy())
    KA = K @ A
    F = KA + b
    loss, P = _parts(F, Y, binary)
    J = 0.5 * float((A * KA).sum()) + C * loss
    for _ in range(max_iter):
        R = P - Y
        g, ge = A + C * R, C * R.sum(axis=0)
        if max(np.abs(g).max(), np.abs(ge).max()) < tol * (1.0 + C):
            break
        h = (P * (1 - P)).mean(axis=0)
        he = C * n * h + 1e-12
        r, re = -g, -ge
        Kr = K @ r
        z, ze = basis.scale(r, C, h), re / he
        d, de, Kd = z, ze, K @ z
        rz = rz0 = float((z * Kr).sum() + ze @ re)
        S, Se, KS = np.zeros_like(A), np.zeros(k), np.zeros_like(A)
        for _ in range(CG):
            if not rz > 0:
                break
            cur = C * _curve(P, Kd + de, binary)
            H, He = d + cur, cur.sum(axis=0)
            KH = K @ H
            a = rz / float((d * KH).sum() + de @ He)
            S, Se, KS = S + a * d, Se + a * de, KS + a * Kd
            r, re, Kr = r - a * H, re - a * He, Kr - a * KH
            z, ze = basis.scale(r, C, h), re / he
            rz, last = float((z * Kr).sum() + ze @ re), rz
            if rz <= 1e-4 * min(1.0, rz0) * rz0:
                break
            d, de = z + rz / last * d, ze + rz / last * de
            Kd = K @ d
        t = 1.0
        while True:
            F = KA + t * KS + b + t * Se
            loss, Pn = _parts(F, Y, binary)
            An = A + t * S
            Jn = 0.5 * float((An * (KA + t * KS)).sum()) + C * loss
            if Jn <= J or t < 1e-12:
                break
            t *= 0.5
        if t < 1e-12:
            break
        done = J - Jn <= 1e-15 * max(1.0, abs(J))
        A, b, P, J = An, b + t * Se, Pn, Jn
        KA = K @ A
        if done:
            break
    R = P - Y
    _converged(max(np.abs(K @ (A + C * R)).max() / max(1.0, np.abs(K).max()), np.abs(C * R.sum(axis=0)).max()), C)
    return A, b


def fit_binary(K, t, C, tol=1e-9, max_iter=STEPS, init=None):
    """Coefficients (n) and intercept of the sigmoid loss; ``K`` a kernel matrix or its ``Basis``."""
    basis = K if isinstance(K, Basis) else Basis(K)
    start = None if init is None else (init[0][:, None], np.array([init[1]]))
    A, b = _minimise(basis, np.asarray(t, float)[:, None], C, True, tol, max_iter, start)
    return A[:, 0], float(b[0])


def fit_multinomial(K, y, L, C, tol=1e-9, max_iter=STEPS, init=None):
    """Coefficients (n, L) and intercepts (L) of the softmax loss."""
    return _minimise(K if isinstance(K, Basis) else Basis(K), np.eye(L)[y], C, False, tol, max_iter, init)


def fit_predict(K_tr, y_tr, K_te, C, init=None, return_state=False):
    """Fit on (K_tr or its ``Basis``, y_tr), predict rows of K_te (test x train). Returns class
    labels (and the solver state, to warm-start the next C)."""
    classes = np.unique(y_tr)
    state = None
    if len(classes) == 1:                # a single class: nothing to separate
        pred = np.full(K_te.shape[0], classes[0])
    elif len(classes) == 2:
        yi = np.searchsorted(classes, y_tr)
        a, b = fit_binary(K_tr, (yi == 1).astype(float), C, init=init)
        pred, state = np.where(K_te @ a + b > 0, classes[1], classes[0]), (a, b)
    else:
        yi = np.searchsorted(classes, y_tr)
        A, b = fit_multinomial(K_tr, yi, len(classes), C, init=init)
        pred, state = classes[np.argmax(K_te @ A + b, axis=1)], (A, b)
    return (pred, state) if return_state else pred


def gradient_norm(K, y_idx, L, C, A, b):
    """Max |gradient| of the primal objective in kernel form (for tests)."""
    if L == 2 and A.ndim == 1:
        f = K @ A + b
        s = 1 / (1 + np.exp(-f))
        r = s - y_idx
        return max(np.abs(K @ (A + C * r)).max(), abs(C * r.sum()))
    F = K @ A + b
    P = np.exp(F - F.max(axis=1, keepdims=True))
    P /= P.sum(axis=1, keepdims=True)
    Y = np.zeros_like(P)
    Y[np.arange(len(y_idx)), y_idx] = 1
    R = P - Y
    return max(np.abs(K @ (A + C * R)).max(), np.abs(C * R.sum(axis=0)).max())
