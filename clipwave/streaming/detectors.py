"""Stimulation finder and streaming afterdischarge detector.

Both walk over windows of 20 ms and are plain state machines in NumPy, one column for each
channel. The same objects serve batch groups and Structured Streaming: their state is a
handful of small arrays of fixed shape, so blocks of any length give the same log.
"""

from __future__ import annotations

import pickle
import re
from dataclasses import dataclass, field

import numpy as np

from ..functions import dsp
from ..operators.channels import NOT_CONTACTS


@dataclass(frozen=True)
class Settings:
    """Defaults of the detector, in seconds, microvolts and counts."""

    window: float = 0.02
    highpass: float = 0.99
    decay: float = 0.3
    on_energy: float = 1e9
    off_energy: float = 1e7
    vote_seconds: float = 0.3
    vote_share: float = 0.5
    separation: float = 0.5
    baseline_all: int = 100
    baseline_kept: int = 50
    look_seconds: float = 5.0
    ratio: float = 30.0
    saturation: float = 1e4
    cool_seconds: float = 2.0
    history_seconds: float = 2.0
    history_votes: int = 10
    hf_low: float = 400.0
    hf_high: float = 500.0
    hf_most: float = 1e4
    bad_amplitude: float = 1e4
    bad_most: int = 10
    bad_every: int = 100
    bad_less: int = 5
    contact_most: int = 11


def split_label(label: str) -> tuple[str, int] | None:
    m = re.search(r"([A-Za-z]+)(\d+)", label)
    return (m[1], int(m[2])) if m else None


def next_contacts(labels: list[str]) -> np.ndarray:
    """For each channel the index of its electrode's next contact, or -1."""
    place: dict[str, int] = {}
    for i, name in enumerate(labels):
        place.setdefault(name, i)
    after = [split_label(n) for n in labels]
    return np.array([place.get(f"{p[0]}{p[1] + 1}", -1) if p else -1 for p in after])


def rounded(x: float) -> int:
    return int(np.floor(x + 0.5))


class Onset:
    """Votes for stimulation in the last windows, and the pair that carries it while it is on."""

    def __init__(self, channels: int, after: np.ndarray, s: Settings) -> None:
        self.s, self.after = s, after
        self.votes = np.zeros((int(np.ceil(s.vote_seconds / s.window - 1e-9)), channels), dtype=bool)
        self.turn = 0
        self.pair: tuple[int, int] | None = None

    def vote(self, energy: np.ndarray) -> tuple[int, int] | None:
        """The loudest bipolar pair whose contacts both have the votes."""
        self.votes[self.turn % len(self.votes)] = energy > self.s.on_energy
        self.turn += 1
        won = self.votes.sum(axis=0) > len(self.votes) * self.s.vote_share
        pairs = [(i, int(self.after[i])) for i in np.flatnonzero(won) if self.after[i] >= 0 and won[self.after[i]]]
        return max(pairs, key=lambda p: energy[list(p)].mean(), default=None)

    def start(self, pair: tuple[int, int]) -> None:
        self.pair = pair
        self.votes[:] = False

    def ended(self, energy: np.ndarray) -> bool:
        if energy[list(self.pair)].mean() < self.s.off_energy:
            self.pair = None
            return True
        return False


def decayed(buffer: np.ndarray, window: np.ndarray, decay: float) -> np.ndarray:
    return np.where(np.isnan(buffer), window, buffer) * decay + window


def find_stimulations(x: np.ndarray, labels: list[str], rate: float, t0: float, end: float, s: Settings = Settings()) -> list[tuple[int, int, float, float]]:  # noqa: B008
    """Stimulations in one piece of a session: channel pair, onset and end in seconds.

    The last complete window isn't looked at, and one that is still on ends with the piece."""
    size, found = rounded(s.window * rate), []
    onset = Onset(len(labels), next_contacts(labels), s)
    off_limits = np.isin(labels, NOT_CONTACTS)
    buffer = np.full((size, len(labels)), np.nan)
    started = -np.inf
    for k in range(max(0, -(-(len(x) - size) // size))):
        w = dsp.filled(x[k * size : (k + 1) * size])
        w[:, off_limits] = np.nan
        buffer = decayed(buffer, w, s.decay)
        energy = np.nan_to_num((buffer**2).sum(axis=0))
        t = t0 + (k + 1) * size / rate
        if onset.pair is None:
            pair = onset.vote(energy)
            if pair and t - started > s.separation:
                onset.start(pair)
                started = t
                found.append([*pair, t, end])
        elif onset.ended(energy):
            found[-1][3] = t
    return [tuple(f) for f in found]


@dataclass
class Detector:
    """Streaming detector: ``feed`` blocks of samples (rows) of all channels in order."""

    labels: list[str]
    rate: float
    t0: float = 0.0
    s: Settings = field(default_factory=Settings)

    def __post_init__(self) -> None:
        n, s = len(self.labels), self.s
        self.size = rounded(s.window * self.rate)
        self.after = next_contacts(self.labels)
        self.off_limits = np.isin(self.labels, NOT_CONTACTS)
        self.onset = Onset(n, self.after, s)
        self.rest, self.seen = np.empty((0, n)), 0
        self.mean = np.zeros(n)
        self.buffer = np.full((self.size, n), np.nan)
        self.quiet = np.zeros((s.baseline_all, n))  # energies of the last windows without stimulation
        self.baseline = np.zeros(n)
        self.history = np.zeros((rounded(s.history_seconds / s.window), n), dtype=bool)
        self.turn = 0
        self.bad, self.windows = np.zeros(n), 0
        self.saturated_at = np.full(n, -np.inf)
        self.stim: tuple[int, int] | None = None
        self.ended_at = -np.inf
        self.after_stim = False
        self.reported = np.zeros(n, dtype=bool)

    def to_bytes(self) -> bytes:
        return pickle.dumps(self)

    @staticmethod
    def from_bytes(raw: bytes) -> Detector:
        return pickle.loads(raw)  # noqa: S301  written by to_bytes only

    def feed(self, block: np.ndarray) -> list[tuple[str, str, float]]:
        """Events (kind, channel, seconds): stim_on and stim_off for both contacts, ad once for each channel and stimulation."""
        x = np.concatenate([self.rest, block]) if len(self.rest) else block
        out: list[tuple[str, str, float]] = []
        whole = len(x) // self.size
        for k in range(whole):
            self.seen += self.size
            out += self.window(x[k * self.size : (k + 1) * self.size], self.t0 + self.seen / self.rate)
        self.rest = x[whole * self.size :].copy()
        return out

    def eligible(self) -> np.ndarray:
        """Channels a discharge is looked for in: of the stimulated electrode, apart from the pair and the channels that touch it."""
        letters = split_label(self.labels[self.stim[0]])[0]
        number = [int(m[1]) if (m := re.search(r"(\d+)$", n)) else np.inf for n in self.labels]
        ok = np.array([n.startswith(letters) for n in self.labels]) & (np.array(number) < self.s.contact_most) & ~self.off_limits
        ok[list(self.stim)] = False
        return ok & ~np.isin(self.after, self.stim)

    def window(self, raw: np.ndarray, t: float) -> list[tuple[str, str, float]]:
        s, out = self.s, []
        self.windows += 1
        if self.windows == s.bad_every:
            self.windows, self.bad = 0, np.maximum(self.bad - s.bad_less, 0)
        x, self.mean = dsp.leaky_highpass(dsp.filled(raw), s.highpass, self.mean)
        x[:, self.off_limits] = np.nan
        bipolar = np.where(self.after >= 0, x - x[:, self.after], np.nan)
        bipolar = bipolar - bipolar.mean(axis=0)
        power = (bipolar**2).sum(axis=0)
        self.buffer = decayed(self.buffer, x, s.decay)
        energy = np.nan_to_num((self.buffer**2).sum(axis=0))
        # What is looked for depends on the state before this window.
        stimulating = self.onset.pair is not None
        look = not stimulating and self.stim is not None and t <= self.ended_at + s.look_seconds
        self.after_stim = stimulating or look or (self.after_stim and self.stim is None)
        if stimulating:
            if self.onset.ended(energy):
                self.ended_at = t
                out += [("stim_off", self.labels[i], t) for i in self.stim]
        else:
            with np.errstate(invalid="ignore"):
                self.bad = self.bad + (bipolar > s.bad_amplitude).sum(axis=0)
            if pair := self.onset.vote(energy):
                self.onset.start(pair)
                self.stim, self.reported[:] = pair, False
                self.baseline = self.quiet[: s.baseline_kept].mean(axis=0)
                out += [("stim_on", self.labels[i], t) for i in pair]
            self.quiet = np.concatenate([self.quiet[1:], power[None]])
        above = np.zeros(len(self.labels), dtype=bool)
        if self.after_stim:
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = power / self.baseline
                above = (ratio > s.ratio) & (ratio < s.saturation)
                if self.rate >= 2 * s.hf_high:
                    above &= ~(dsp.band_energy(np.nan_to_num(bipolar), self.rate, s.hf_low, s.hf_high) > s.hf_most)
                self.saturated_at[ratio > s.saturation] = t
            above &= ~(t - self.saturated_at < s.cool_seconds)
        if not look:
            self.history[:] = False
            return out
        self.history[self.turn % len(self.history)] = above
        self.turn += 1
        hit = (self.history.sum(axis=0) > s.history_votes) & self.eligible() & ~(self.bad > s.bad_most)
        fresh = hit & ~self.reported
        out += [("ad", self.labels[i], t) for i in np.flatnonzero(fresh)]
        self.reported |= fresh
        self.history[:, self.reported] = False
        return out
