"""Non-negative positive-unlabelled learning for linear models, in numpy.

Risk (logistic loss l, class prior p, positives P, unlabelled U):

    p * E_P[l(g)] + max(0, E_U[l(-g)] - p * E_P[l(-g)])

The bracket estimates the risk on the unseen negatives. Where it falls below zero the
model has begun to overfit the positives, and the step climbs that term instead.

The class prior is estimated from the same two samples: a plain classifier of positives
against unlabelled rows is fitted on one half, and on the other half the share of
unlabelled over the share of positive rows above a score is an upper bound of the prior.
The score at which that bound, with its confidence width, is least is used (best bin
estimation). No row known to be negative is needed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


@dataclass(frozen=True)
class LinearScorer:
    """score = sigmoid(features @ weights + bias)."""

    weights: np.ndarray
    bias: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        return sigmoid(features @ self.weights + self.bias)


def fit_nnpu(
    positive: np.ndarray,
    unlabelled: np.ndarray,
    prior: float | None,
    *,
    steps: int = 400,
    rate: float = 0.05,
    l2: float = 1e-4,
    beta: float = 0.0,
    floor: float = -np.inf,
) -> LinearScorer:
    """Full-batch Adam on the non-negative risk. Deterministic.

    positive, unlabelled: rows of features. No positives: the constant score `prior`.
    prior None: the plain risk of telling positives from unlabelled rows, weighed alike.
    beta: how far below zero the negatives' risk may fall before a step climbs it.
    floor: the least weight; 0 where every feature is known to speak for the positives.
    """
    plain = prior is None
    prior = 0.5 if plain else float(np.clip(prior, 1e-3, 1 - 1e-3))
    width = unlabelled.shape[1] if unlabelled.size else positive.shape[1] if positive.size else 0
    bias0 = float(np.log(prior / (1 - prior)))
    if not len(positive) or not len(unlabelled):
        return LinearScorer(np.zeros(width), bias0)
    w = np.zeros(width + 1)
    w[-1] = bias0
    p, u = np.asarray(positive, np.float32), np.asarray(unlabelled, np.float32)  # the bias is kept apart, so nothing is copied
    m, v = np.zeros_like(w), np.zeros_like(w)

    def pull(rows: np.ndarray, by: np.ndarray) -> np.ndarray:
        """Mean of the rows' gradients, each times its factor."""
        return np.append(rows.T @ by.astype(np.float32), by.sum()) / len(rows)

    for step in range(1, steps + 1):
        gp, gu = (x @ w[:-1].astype(np.float32) + w[-1] for x in (p, u))
        sp, su = sigmoid(gp), sigmoid(gu)
        pos_grad = prior * pull(p, sp - 1.0)
        if plain:
            grad = pos_grad + 0.5 * pull(u, su)
        else:
            neg_grad = pull(u, su) - prior * pull(p, sp)
            neg_risk = np.mean(np.logaddexp(0, gu)) - prior * np.mean(np.logaddexp(0, gp))
            grad = pos_grad + neg_grad if neg_risk >= -beta else -neg_grad
        grad = grad + l2 * np.append(w[:-1], 0.0)
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w[:-1] = np.maximum(w[:-1], floor)
    return LinearScorer(w[:-1].copy(), float(w[-1]))


def best_bin(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float | None:
    """The prior that scores of held-back positive and unlabelled rows show.

    For every score c that occurs, q(c) is the share of rows at or above it. The share of
    positives among the unlabelled is at most q_u(c) / q_p(c); the c with the least upper
    confidence bound of that is taken. The c that all rows reach says nothing and takes no
    part; None if there is no other.
    """
    cuts = np.unique(np.concatenate([positive, unlabelled]))
    share = lambda x: 1.0 - np.searchsorted(np.sort(x), cuts, side="left") / len(x)
    qp, qu = share(positive), share(unlabelled)
    tells = (qp > 0) & (qu < 1)
    if not tells.any():
        return None
    qp, qu = qp[tells], qu[tells]
    wide = np.sqrt(np.log(4 / delta) / (2 * len(unlabelled))) + (1 + gamma) * np.sqrt(np.log(4 / delta) / (2 * len(positive)))
    at = int(np.argmin((qu + wide) / qp))
    return float(np.clip(qu[at] / qp[at], 1e-3, 1 - 1e-3))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, default: float, **how) -> float:
    """The class prior, by best bin estimation on both halves in turn; `default` with fewer than two rows of a kind, or if nothing tells rows apart.

    Rows should be in no order that depends on their class; every second one is held back.
    """
    if min(len(positive), len(unlabelled)) < 2:
        return default
    found = []
    for fit_on in (0, 1):
        model = fit_nnpu(positive[fit_on::2], unlabelled[fit_on::2], None, **how)
        found.append(best_bin(model.scores(positive[1 - fit_on :: 2]), model.scores(unlabelled[1 - fit_on :: 2])))
    found = [x for x in found if x is not None]
    return float(np.mean(found)) if found else default
