"""Consistent weighted sampling with gamma-distributed variates (the improved scheme), vectorised in numpy.

A term with weight w draws, from its hash alone, r and c of the Gamma(2, 1) distribution and b uniform in [0, 1). With
t = floor(ln w / r + b), the term's value is ln c - r (t - b) - r; a sample of a weighted set is the (term, t) of least
value. Two sets' samples are equal with the probability of their generalised Jaccard similarity, sum of minima over sum
of maxima of the weights.
"""

from __future__ import annotations

import numpy as np

from gazeframe.llm.common import mix

#: Terms that are drawn at once: what is in work stays within a processor's cache.
PIECE = 512


def _gamma_quantiles(n: int) -> np.ndarray:
    """Quantiles of Gamma(2, 1) at (i + 0.5) / n, by Newton's method on 1 - (1 + x) exp(-x)."""
    u = (np.arange(n) + 0.5) / n
    x = np.sqrt(2 * u) + u
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - u) / np.maximum(x * np.exp(-x), 1e-300), 1e-9)
    return x.astype(np.float32)


_R = _gamma_quantiles(4096)


def _mix32(x: np.ndarray, spare: np.ndarray) -> None:
    """A bijective finaliser of 32-bit values, in place."""
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        np.right_shift(x, np.uint32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        np.multiply(x, np.uint32(factor), out=x)
    np.right_shift(x, np.uint32(16), out=spare)
    np.bitwise_xor(x, spare, out=x)


def _seeds(samples: int) -> tuple[np.ndarray, np.ndarray]:
    s = mix(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return s.astype(np.uint32)[:, None], (s >> np.uint64(32)).astype(np.uint32)[:, None]


def variates(terms: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(r, ln c, b) of each sample and term, rows by sample, from 64 hashed bits: 20 and 20 for c, 12 for r, 12 for b."""
    one, two = _seeds(samples)
    low = terms.astype(np.uint32)[None, :] ^ one
    high = (terms >> np.uint64(32)).astype(np.uint32)[None, :] + two
    spare = np.empty_like(low)
    _mix32(low, spare)
    np.bitwise_xor(high, low, out=high)  # so that either half of a hash bears on both
    _mix32(high, spare)
    c, u = np.empty(low.shape, np.float32), np.empty(low.shape, np.float32)
    np.right_shift(low, np.uint32(12), out=spare)
    np.copyto(c, spare.view(np.int32), casting="unsafe")
    c += np.float32(0.5)
    np.right_shift(high, np.uint32(12), out=spare)
    np.copyto(u, spare.view(np.int32), casting="unsafe")
    u += np.float32(0.5)
    c *= u
    c *= np.float32(2.0**-40)
    np.log(c, out=c)
    np.negative(c, out=c)
    np.maximum(c, np.float32(1e-9), out=c)
    np.log(c, out=c)
    np.bitwise_and(high, np.uint32(4095), out=high)
    np.copyto(u, high.view(np.int32), casting="unsafe")
    u *= np.float32(1 / 4096)
    np.bitwise_and(low, np.uint32(4095), out=low)
    return np.take(_R, low, mode="clip"), c, u


def values(r: np.ndarray, c: np.ndarray, b: np.ndarray, log_weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The terms' values and steps t at their weights; overwrites c."""
    t = log_weights / r
    t += b
    np.floor(t, out=t)
    y = b - t
    y -= np.float32(1)
    y *= r
    c += y
    return c, t


def sample(terms: np.ndarray, log_weights: np.ndarray, samples: int) -> np.ndarray:
    """The 64-bit identity of each sample of one weighted set; terms are distinct hashes. No terms: zeros."""
    best = np.full(samples, np.inf, np.float32)
    out = np.zeros(samples, np.uint64)
    rows = np.arange(samples)
    for i in range(0, len(terms), PIECE):
        h = terms[i : i + PIECE]
        value, t = values(*variates(h, samples), log_weights[i : i + PIECE].astype(np.float32)[None, :])
        at = value.argmin(1)
        v = value[rows, at]
        new = v < best
        best = np.where(new, v, best)
        out = np.where(new, mix(h[at] + t[rows, at].astype(np.int64).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), out)
    return out


def jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Generalised Jaccard similarity of two weighted sets with sorted distinct terms; of two empty ones, 1."""
    if not len(a) and not len(b):
        return 1.0
    at = np.searchsorted(b, a)
    both = at < len(b)
    both[both] = b[at[both]] == a[both]
    least = float(np.minimum(wa[both], wb[at[both]]).sum())
    return least / (float(wa.sum()) + float(wb.sum()) - least)
