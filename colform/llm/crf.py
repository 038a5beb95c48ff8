"""Two-state linear-chain conditional random fields on many chains at once.

Chains are the columns of (steps, chains) matrices of log-odds for state 1; ``lengths`` says how many steps of a chain
count. Forward-backward runs a step at a time over all chains, on scaled probabilities.
"""

from __future__ import annotations

import numpy as np

from . import vectortext as V


def lay_out(counts: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts each sequence of ``counts`` elements into chains of at most ``steps``.

    Returns the chain lengths, and for each element its step and its chain.
    """
    pieces = -(-counts // steps)
    chain_of_piece = V.offsets_of(pieces)
    place = V.ragged_arange(counts)
    chain = np.repeat(chain_of_piece[:-1], counts) + place // steps
    lengths = np.bincount(chain, minlength=int(chain_of_piece[-1]))
    return lengths, place % steps, chain


def marginals(odds: np.ndarray, lengths: np.ndarray, transition: np.ndarray, pairs: bool = False):
    """P(state 1) at every step; with ``pairs`` also the expected transitions, 2 x 2."""
    steps, chains = odds.shape
    e = np.exp(np.clip(odds, -30, 30))
    t = np.exp(np.clip(transition, -30, 30))
    forward = np.empty((steps, 2, chains))
    a0 = np.full(chains, 0.5)
    a1 = np.full(chains, 0.5)
    for s in range(steps):
        n0, n1 = (a0, a1 * e[s]) if s == 0 else (a0 * t[0, 0] + a1 * t[1, 0], (a0 * t[0, 1] + a1 * t[1, 1]) * e[s])
        total = n0 + n1
        a0, a1 = n0 / total, n1 / total
        forward[s, 0], forward[s, 1] = a0, a1
    out = np.empty((steps, chains))
    expected = np.zeros((2, 2))
    b0 = np.ones(chains)
    b1 = np.ones(chains)
    for s in range(steps - 1, -1, -1):
        if s < steps - 1:
            inside = s + 1 < lengths
            eb = e[s + 1] * b1
            if pairs:
                f0, f1 = forward[s]
                joint = np.stack([f0 * t[0, 0] * b0, f0 * t[0, 1] * eb, f1 * t[1, 0] * b0, f1 * t[1, 1] * eb])
                expected += (joint / joint.sum(axis=0))[:, inside].sum(axis=1).reshape(2, 2)
            n0 = t[0, 0] * b0 + t[0, 1] * eb
            n1 = t[1, 0] * b0 + t[1, 1] * eb
            total = n0 + n1
            b0, b1 = np.where(inside, n0 / total, 1.0), np.where(inside, n1 / total, 1.0)
        p = forward[s, 1] * b1
        out[s] = p / (p + forward[s, 0] * b0)
    return (out, expected) if pairs else out


def observed(labels: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Counts of the transitions in (steps, chains) labels."""
    steps = len(labels)
    inside = np.arange(1, steps)[:, None] < lengths[None, :]
    return np.bincount((2 * labels[:-1] + labels[1:])[inside], minlength=4).reshape(2, 2).astype(float)


def fit_logistic(x: np.ndarray, y: np.ndarray, rows: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Newton's method for a logistic regression; x without the constant, whose weight comes last. ``rows`` weighs the rows."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (rows * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(curve, x.T @ (rows * (y - p)) - ridge * w)
    return w


def logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    total = w[-1]
    for i in range(len(w) - 1):
        total = total + x[:, i] * w[i]
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def labelled_sample(docs, labels, label: str, keep, per_class: int, seed: int, max_chars: int):
    """(texts, labels, weights) of a bounded sample of labelled rows, drawn by a hash of the id.

    ``keep`` is the condition on doc_id that leaves the held-out rows out. About ``per_class`` rows of each label, of which
    at most the first ``max_chars`` characters are learned from; scoring has no such bound.
    """
    from pyspark.sql import functions as F

    from .shared import hash_share, sample_rate

    usable = labels.where(keep).where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in usable.groupBy("y").count().collect()}
    if not counts:
        return [], np.zeros(0), np.zeros(0)
    rates = F.create_map(*[F.lit(x) for y, n in counts.items() for x in (y, sample_rate(per_class, n))])
    drawn = usable.where(hash_share("doc_id", seed) < F.element_at(rates, F.col("y"))).distinct()
    # The sample's ids, bounded by per_class, go to the texts; the texts stay where they are.
    drawn = F.broadcast(drawn.orderBy(hash_share("doc_id", seed), "doc_id", "y").limit(4 * per_class))
    rows = docs.where(keep).select("doc_id", F.substring("text", 1, max_chars).alias("text")).join(drawn, "doc_id").orderBy("doc_id", "y", "text").toArrow()
    y = np.array(rows["y"].to_pylist(), float)
    # A row stands for as many as its class was thinned by, so that scores are probabilities among all rows.
    weights = np.array([(1 << 20) / sample_rate(per_class, counts[int(v)]) for v in y])
    return [x or "" for x in rows["text"].to_pylist()], y, weights / max(weights.mean(), 1e-9) if len(weights) else weights
