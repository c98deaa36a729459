"""Weak supervision: rules vote, expectation-maximisation finds how far each vote can be trusted."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np

#: A rule's vote: against, none, for.
VOTES = (-1, 0, 1)


class LabelModel:
    """prior: share of positives. weight[r][v + 1]: log of P(vote v of rule r | positive) / P(... | negative)."""

    def __init__(self, prior: float, weight: np.ndarray):
        self.prior, self.weight = prior, weight

    @property
    def bias(self) -> float:
        return math.log(self.prior / (1 - self.prior))

    def posterior(self, votes: Sequence[int]) -> float:
        z = self.bias + sum(float(self.weight[r][v + 1]) for r, v in enumerate(votes))
        return 1 / (1 + math.exp(-max(-700, min(700, z))))


def fit(patterns: Mapping[tuple[int, ...], int], rules: int, start_prior: float = 0.8, belief: float | Sequence[float] = 0.85, strength: float = 20.0, rounds: int = 500) -> LabelModel:
    """Fit two classes to counts of vote patterns by expectation-maximisation, starting from the majority vote.

    For each class and rule it estimates how often the rule votes for rather than against; an abstention says
    nothing. Beforehand each vote is believed to be right with probability `belief` (one for all rules or one each), as if `strength` votes of each
    class had shown it, and the share of positives to be start_prior, as if as many rows had; both fade as the counts
    grow. The beliefs give the classes their names. Without patterns only they are used.
    """
    votes = np.array(list(patterns), np.int64).reshape(len(patterns), rules)
    n = np.array(list(patterns.values()), float)
    is_for, against = votes == 1, votes == -1
    sure = np.broadcast_to(np.asarray(belief, float), (rules,))
    prior, weight = start_prior, np.stack([np.log((1 - sure) / sure), np.zeros(rules), np.log(sure / (1 - sure))], axis=1)
    p = 1 / (1 + np.exp(-(math.log(start_prior / (1 - start_prior)) + 1.5 * against.sum(axis=1) * -1.0)))
    for _ in range(rounds if len(n) else 0):
        prior = float(((n * p).sum() + strength * start_prior) / (n.sum() + strength))
        new = np.zeros_like(weight)
        shares = []
        for rows, right in ((n * p, sure), (n * (1 - p), 1 - sure)):
            yes, no = rows @ is_for, rows @ against
            shares.append((yes + strength * right) / (yes + no + strength))
        new[:, 0] = np.log((1 - shares[0]) / (1 - shares[1]))
        new[:, 2] = np.log(shares[0] / shares[1])
        z = math.log(prior / (1 - prior)) + new[np.arange(rules), votes + 1].sum(axis=1)
        p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
        done = np.abs(new - weight).max() < 1e-6
        weight = new
        if done:
            break
    return LabelModel(prior, weight)
