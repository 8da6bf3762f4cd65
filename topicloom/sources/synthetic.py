"""Synthetic corpora for tests: planted topics, and streams in which a topic emerges."""

from __future__ import annotations

import numpy as np


def blobs(topics: int = 3, per_topic: int = 35, dim: int = 32, noise: float = 0.08, seed: int = 99) -> tuple[list[str], np.ndarray, np.ndarray]:
    """texts, unit vectors and true topics; each topic has seven words of its own."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(topics, dim))
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    truth = np.repeat(np.arange(topics), per_topic)
    x = centre[truth] + noise * rng.normal(size=(len(truth), dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    names = [[f"word{chr(97 + t)}{chr(97 + i)}" for i in range(7)] for t in range(topics)]
    texts = [" ".join(rng.choice(names[t], size=rng.integers(5, 12))) for t in truth]
    return texts, x, truth


def stream(topics: int = 6, batches: int = 5, size: int = 120, emerging: int | None = None, enters: int = 3, share: float = 0.35, noise_docs: float = 0.05, overlap: float = 0.18, dim: int = 48, seed: int = 7) -> list[tuple[list[str], np.ndarray, np.ndarray]]:
    """Batches of texts, vectors and truth (-1 for noise): Zipf topic sizes, shared words, filler words."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(topics, dim))
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    common = [f"common{chr(97 + i)}" for i in range(12)]
    filler = [f"filler{chr(97 + i)}" for i in range(20)]
    own = [[f"theme{chr(97 + t)}{chr(97 + i)}" for i in range(12)] for t in range(topics)]
    zipf = 1 / np.arange(1, topics + 1)
    out = []
    for b in range(batches):
        p = zipf.copy()
        if emerging is not None:
            p[emerging] = 0.0
            p = p / p.sum()
            if b >= enters:
                p = p * (1 - share)
                p[emerging] = share
        p = p / p.sum()
        truth = rng.choice(topics, size=size, p=p)
        lost = rng.random(size) < noise_docs
        x = centre[truth] + 0.08 * rng.normal(size=(size, dim))
        x[lost] = rng.normal(size=(int(lost.sum()), dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        texts = [" ".join(rng.choice(filler, 14) if no else [rng.choice(common if rng.random() < overlap else own[t]) for _ in range(12)] + list(rng.choice(filler, 2))) for t, no in zip(truth, lost, strict=True)]
        out.append((texts, x, np.where(lost, -1, truth)))
    return out
