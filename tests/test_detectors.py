"""Detectors on recordings whose events are known."""

import numpy as np
import pytest

from clipwave.functions import dsp
from clipwave.sources import eeg
from clipwave.streaming import jobs
from clipwave.streaming.detectors import Detector, find_stimulations

LABELS = [f"LA{k}" for k in range(1, 9)]


def signal(clip, seconds=20, rate=1000.0):
    return eeg.recording(clip, range(8), 0, int(seconds * rate), rate)


def test_finder_times():
    x = np.zeros((30_000, 8))
    t = np.arange(30_000) / 1000
    x[:, 2] = 2e4 * np.sin(2 * np.pi * 50 * t) * ((t >= 10) & (t < 12))
    x[:, 3] = -x[:, 2]
    found = find_stimulations(x, LABELS, 1000.0, 0.0, 30.0)
    assert [(a, b) for a, b, *_ in found] == [(2, 3)]
    assert found[0][2:] == pytest.approx((10.16, 12.06))


@pytest.mark.parametrize("size", [1, 7, 100, 250, 1000, 20_000])
def test_block_size_does_not_matter(size):
    x = signal(1)
    whole = Detector(LABELS, 1000.0).feed(x)
    d, log = Detector(LABELS, 1000.0), []
    for k in range(0, len(x), size):
        log += d.feed(x[k : k + size])
        if k % (50 * size) == 0:
            d = Detector.from_bytes(d.to_bytes())
    assert log == whole
    assert [e[:2] for e in log if e[0] == "stim_on"] == [("stim_on", "LA3"), ("stim_on", "LA4")]
    ads = [e[1] for e in log if e[0] == "ad"]
    assert ads and len(ads) == len(set(ads)) and not {"LA2", "LA3", "LA4"} & set(ads)


def test_no_discharge_no_detection():
    assert {e[0] for e in Detector(LABELS, 1000.0).feed(signal(0))} == {"stim_on", "stim_off"}


def test_missing_samples_and_excluded_labels():
    x = signal(1)
    x[100, 0] = x[200:300, 1] = np.nan
    x[400:500] = np.nan
    log = Detector([*LABELS[:7], "EKG1"], 1000.0).feed(x)
    assert "EKG1" not in {e[1] for e in log} and {"stim_on", "ad"} <= {e[0] for e in log}


def test_band_pass():
    s = dsp.butter_band(4, 1, 50, 512)
    at = lambda f: abs(np.prod([np.polyval(r[:3], np.exp(2j * np.pi * f / 512)) / np.polyval([1, *r[3:]], np.exp(2j * np.pi * f / 512)) for r in s]))
    assert at(1) == pytest.approx(2**-0.5, abs=1e-6) and at(50) == pytest.approx(2**-0.5, abs=1e-6)
    assert at(10) == pytest.approx(1, abs=1e-3) and at(200) < 1e-3
    notch = dsp.butter_band(2, 58, 62, 512, stop=True)
    t = np.arange(5120) / 512
    assert np.abs(dsp.run_sections(notch, np.sin(2 * np.pi * 60 * t)[:, None])[2560:]).max() < 0.01


def test_band_energy():
    t = np.arange(1000) / 1000
    x = 3 * np.sin(2 * np.pi * 30 * t)
    assert dsp.band_energy(x, 1000, 20, 40) == pytest.approx(4.5, rel=1e-3)
    assert dsp.band_energy(x, 1000, 100, 200) < 1e-3


def test_stream_equals_batch(spark):
    blocks = eeg.blocks(eeg.read_eeg(spark, clips=2, seconds=14, rate=1000, piece_seconds=7), 700)
    key = lambda r: (r["clip"], r["t"], r["kind"], r["channel"])
    batch = sorted(map(key, jobs.replay(blocks).collect()))
    assert batch and sorted(map(key, jobs.run_stream(blocks).collect())) == batch


def test_pieces_of_a_session_merge(spark):
    got = jobs.session_stimulations(eeg.read_eeg(spark, clips=1, seconds=30, piece_seconds=11)).collect()
    assert [(r["pair"], round(r["on"], 6), round(r["off"], 6), r["merged"]) for r in got] == [("LA3-LA4", 10.16, 12.06, 2)]


def test_edf_round_trip():
    x = np.array([[0.5, -3.2], [np.nan, 7.9], [1.0, 0.0]])
    raw = eeg.edf_bytes(["LA1", "LA2"], 3.0, x)
    assert len(raw) == 256 * 3 + 12 and raw[236:244].strip() == b"1"
    back = np.frombuffer(raw[768:], "<i2").reshape(2, 3).T.astype(float)
    low, high = np.array([0, -4]), np.array([1, 8])
    assert np.allclose((back + 32768) / 65535 * (high - low) + low, np.nan_to_num(x), atol=1e-3)
