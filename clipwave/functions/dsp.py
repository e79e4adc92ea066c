"""Filters and spectra in NumPy, for use inside Arrow functions on arrays of samples.

Butterworth filters are designed as second-order sections (analog prototype, band
transformation, bilinear transform), which stay accurate where one high-order polynomial
would not. Band energy is a one-sided Hamming periodogram summed over the bins of a band.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def butter_band(order: int, low: float, high: float, rate: float, stop: bool = False) -> np.ndarray:
    """Sections (b0, b1, b2, a1, a2) of a band-pass (``stop``: band-stop) of twice ``order``."""
    fast = 2 * rate
    w1, w2 = (fast * np.tan(np.pi * f / rate) for f in (low, high))
    centre, width = w1 * w2, w2 - w1
    proto = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    half = width / proto / 2 if stop else proto * width / 2
    root = np.sqrt(half**2 - centre)
    poles = np.concatenate([half + root, half - root])
    zeros = np.tile([1j, -1j], order) * np.sqrt(centre) if stop else np.zeros(order)
    bilinear = lambda s: (fast + s) / (fast - s)
    z, p = bilinear(zeros.astype(complex)), bilinear(poles)
    z = z if stop else np.concatenate([z, -np.ones(order)])
    # A wide band of odd order has two real poles, which share a section; all others are conjugate pairs.
    real = np.sort(p[np.abs(p.imag) < 1e-12].real)
    upper = p[p.imag >= 1e-12]
    upper = upper[np.argsort(np.abs(upper))]
    top = np.poly(z[:2]).real if stop else np.array([1.0, 0.0, -1.0])
    rows = np.array([*([*top, -a - b, a * b] for a, b in zip(real[::2], real[1::2], strict=True)), *([*top, -2 * q.real, abs(q) ** 2] for q in upper)])
    # Gain 1 in the middle of the pass band (band-stop: at 0 Hz).
    at = 1.0 if stop else np.exp(2j * np.arctan(np.sqrt(centre) / fast))
    gain = np.prod([np.polyval(r[:3], at) / np.polyval([1, r[3], r[4]], at) for r in rows])
    rows[0, :3] /= abs(gain)
    return rows


BLOCK = 64


def block_form(section: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """A section over ``n`` samples at once: output and next state as matrices of input and state."""
    b0, b1, b2, a1, a2 = section
    step, gain, out = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0]), np.array([1.0, 0.0])
    powers = [np.eye(2)]
    for _ in range(n):
        powers.append(powers[-1] @ step)
    response = np.array([b0, *(out @ p @ gain for p in powers[: n - 1])])
    at = np.arange(n)[:, None] - np.arange(n)[None, :]
    direct = np.where(at >= 0, response[np.maximum(at, 0)], 0.0)
    from_state = np.array([out @ p for p in powers[:n]])
    to_state = np.array([p @ gain for p in powers[:n]])[::-1].T
    return direct, from_state, to_state, powers[n]


def run_sections(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Causal filtering along the first axis from silence; columns are channels, all filtered at once, block by block."""
    y = np.array(x, dtype=np.float64)
    for section in sections:
        state, forms = np.zeros((2, y.shape[1])), {}
        for k in range(0, len(y), BLOCK):
            part = y[k : k + BLOCK]
            if len(part) not in forms:
                forms[len(part)] = block_form(section, len(part))
            direct, from_state, to_state, over = forms[len(part)]
            y[k : k + BLOCK], state = direct @ part + from_state @ state, over @ state + to_state @ part
    return y


def band_energy(x: np.ndarray, rate: float, low: float, high: float) -> np.ndarray:
    """Power in a band, along the first axis: Hamming periodogram, bins from ``low`` to ``high`` times their width."""
    n = len(x)
    w = np.hamming(n)
    density = np.abs(np.fft.rfft(x * (w if x.ndim == 1 else w[:, None]), axis=0)) ** 2 / (rate * (w**2).sum())
    density[1 : (n + 1) // 2] *= 2
    f = np.fft.rfftfreq(n, 1 / rate)
    return density[(f >= low) & (f <= high)].sum(axis=0) * rate / n


@lru_cache(maxsize=16)
def leaky_form(n: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Leaky means of ``n`` samples: what each sample and the mean before them weigh in each."""
    at = np.arange(n)[:, None] - np.arange(n)[None, :]
    return np.where(at >= 0, (1 - alpha) * alpha ** np.maximum(at, 0), 0.0), alpha ** np.arange(1, n + 1)


def leaky_highpass(x: np.ndarray, alpha: float, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples less a one-pole leaky mean that goes on from ``mean``; and the mean to go on from."""
    inside, before = leaky_form(len(x), alpha)
    means = inside @ x + before[:, None] * mean
    return x - means, means[-1]


def filled(x: np.ndarray) -> np.ndarray:
    """A window with missing samples as their channel's mean, less the mean; a channel without samples is 0."""
    known = ~np.isnan(x)
    mean = np.where(known, x, 0).sum(axis=0) / np.maximum(known.sum(axis=0), 1)
    return np.where(known, x, mean) - mean


def parallel_form(sections: np.ndarray) -> tuple[float, list[complex], list[complex]]:
    """A cascade of sections as direct * x + the sum of weight / (1 - pole / z): direct, poles and weights.

    Of two conjugate poles the upper one is given; the lower one's term is its conjugate."""
    poles = [complex(p) for s in sections for p in np.roots([1.0, s[3], s[4]])]
    direct = float(np.prod([s[2] / s[4] for s in sections]))
    upper = [p for p in poles if p.imag >= 0]
    weights = []
    for p in upper:
        above = np.prod([s[0] + s[1] / p + s[2] / p**2 for s in sections])
        others = list(poles)
        others.remove(p)
        weights.append(complex(above / np.prod([1 - q / p for q in others])))
    return direct, upper, weights
