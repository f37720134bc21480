"""Filter design and kernel, differences, and their errors."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from myospark.functions import butterworth
from myospark.functions.butterworth import advance, design, zero_phase
from myospark.functions.recurrence import STEP, Recurrence, starts
from myospark.operators import long_series
from myospark.operators.filters import bandpass, bandpass_signals, to_differential


def gain(f, frequency, rate):
    z = np.exp(2j * np.pi * frequency / rate)
    return abs(np.prod([(b0 + b1 / z + b2 / z**2) / (1 + a1 / z + a2 / z**2) for b0, b1, b2, a1, a2 in f.sections])) ** 2


@pytest.mark.parametrize(("args", "low", "high"), [((4, 40, 100, 1000), 0.2851, 0.7708), ((4, 20, 450, 2000), 0.3847, 0.6722), ((8, 20, 450, 2000), 0.3841, 0.6676), ((4, 20, 400, 1000), 0.3890, 0.9392)])
def test_gain_at_the_edges_after_both_passes(args, low, high):
    f = design(*args)
    assert f.pad == 3 * (args[0] + 1)
    assert gain(f, args[1], args[3]) == pytest.approx(low, abs=1e-4)
    assert gain(f, args[2], args[3]) == pytest.approx(high, abs=1e-4)


def test_tones_in_and_out_of_the_band():
    """Five seconds at 2,500 Hz: what lies an octave or more outside of 70 to 300 Hz goes, what lies in the middle stays."""
    rate, inside, outside = 2500, [110, 190], [7, 23, 640, 1100]
    t = np.arange(5 * rate) / rate
    x = sum(k * np.cos(2 * np.pi * f * t + f) for k, f in enumerate(inside + outside, 1))
    y = zero_phase([x], design(6, 70, 300, rate))[0]
    share = np.abs(np.fft.rfft(y)) / np.abs(np.fft.rfft(x))
    assert all(share[5 * f] > 0.9 for f in inside) and all(share[5 * f] < 0.05 for f in outside)


def direct(x, f):
    """The same filter by its whole polynomials, one sample at a time, both ways, over a long extension at rest."""
    b, a = np.array([1.0]), np.array([1.0])
    for b0, b1, b2, a1, a2 in f.sections:
        b, a = np.convolve(b, [b0, b1, b2]), np.convolve(a, [1, a1, a2])
    p = f.pad
    x = np.concatenate([2 * x[0] - x[p:0:-1], x, 2 * x[-1] - x[-2 : -p - 2 : -1]])
    for _ in range(2):
        held = np.concatenate([np.full(5000, x[0]), x])  # a steady state instead of initial conditions
        y = np.zeros(len(held))
        for i in range(len(held)):
            y[i] = sum(b[k] * held[i - k] for k in range(len(b)) if i >= k) - sum(a[k] * y[i - k] for k in range(1, len(a)) if i >= k)
        x = y[5000:][::-1]
    return x[p:-p]


def test_kernel_against_direct_form():
    rng, f = np.random.default_rng(1), design(4, 60, 200, 1000)
    series = [rng.standard_normal(n) for n in (16, 40, 77)]
    for x, y in zip(series, zero_phase(series, f), strict=True):
        np.testing.assert_allclose(y, direct(x, f), atol=1e-9)


def test_long_series_in_blocks(monkeypatch):
    x, f = np.random.default_rng(2).standard_normal(50_000), design(4, 40, 100, 1000)
    blocks = zero_phase([x], f)[0]
    monkeypatch.setattr(butterworth, "LONGEST", 10**9)
    np.testing.assert_allclose(blocks, zero_phase([x], f)[0], atol=1e-12)


@settings(max_examples=10, deadline=None)
@given(st.integers(20, 60), st.floats(-5, 5))
def test_filter_is_linear(n, k):
    rng, f = np.random.default_rng(n), design(4, 40, 100, 1000)
    a, b = rng.standard_normal(n), rng.standard_normal(n)
    ya, yb, both = zero_phase([a, b, a + k * b], f)
    np.testing.assert_allclose(both, ya + k * yb, atol=1e-9)


@pytest.mark.parametrize("args", [(3, 40, 100, 1000), (0, 40, 100, 1000), (4, 0, 100, 1000), (4, 100, 40, 1000), (4, 40, 100, 0), (4, 480, 490, 1000)])
def test_design_errors(args):
    with pytest.raises(ValueError):
        design(*args)


def test_too_short():
    with pytest.raises(ValueError, match="too short"):
        zero_phase([np.zeros(15)], design(4, 40, 100, 1000))


def test_bandpass_in_long_form_and_in_chunks(spark):
    rng = np.random.default_rng(3)
    series = {k: rng.standard_normal(n) for k, n in (("a", 40), ("b", 90))}
    rows = [(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)]
    got = bandpass(spark.createDataFrame(rows, "k string, i int, v double"), ["k"], ["i"], "v", 4, 40, 100, 1000).collect()
    want = dict(zip(series, zero_phase(list(series.values()), design(4, 40, 100, 1000)), strict=True))
    for r in got:
        assert r["filtered"] == pytest.approx(want[r["k"]][r["i"]], abs=1e-12)
    chunks = [("f", 0, j, j * 30, [float(v) for v in series["b"][j * 30 : j * 30 + 30]]) for j in range(3)]
    signals = spark.createDataFrame(chunks, "file_id string, channel_idx int, chunk_idx int, start_sample long, samples array<double>")
    out = sorted(bandpass_signals(signals, 4, 40, 100, 1000).collect(), key=lambda r: r["chunk_idx"])
    np.testing.assert_allclose(np.concatenate([r["samples"] for r in out]), want["b"], atol=1e-12)


NARROW, WIDE = (4, 0.2, 3, 2000), (6, 20, 450, 2000)  # the first forgets its states only after some 10^5 samples


@pytest.mark.parametrize("args", [NARROW, WIDE])
def test_recurrence_cut_anywhere(args):
    x, r = np.random.default_rng(4).standard_normal(5 * STEP + 77), Recurrence(design(*args))
    whole, after = advance(x[:, None], r.f.sections, r.f.initial[:, :, None])
    (y,), (end,) = r.run([x], [r.initial])
    np.testing.assert_allclose(y, whole[:, 0], atol=1e-10)
    np.testing.assert_allclose(end, after.ravel(), atol=1e-9)
    cuts = np.split(x, [0, 1, 2, STEP, STEP + 1, 900])
    found, last = starts(r, [len(b) for b in cuts], r.left_by(cuts), r.initial)
    np.testing.assert_allclose(np.concatenate(r.run(cuts, found)[0]), y, atol=1e-9)
    np.testing.assert_allclose(last, end, atol=1e-9)


@pytest.mark.parametrize("args", [NARROW, WIDE])
def test_long_series_over_many_tasks(spark, args):
    """Blocks of unequal lengths, of one sample and of none, dealt over tasks; a null key is a series like others."""
    rng = np.random.default_rng(5)
    series = {"a": rng.standard_normal(9000), None: rng.standard_normal(400), "b": rng.standard_normal(22)}
    cuts = {"a": [0, 3, 3, 7, 2500, 6100, 8999], None: [1, 390], "b": [20]}
    rows = [(k, j, [float(v) for v in b], f"{k} {j}") for k, x in series.items() for j, b in enumerate(np.split(x, cuts[k]))]
    blocks = spark.createDataFrame(rows, "k string, j int, x array<double>, kept string").repartition(7)
    got = sorted(long_series.filter_blocks(blocks, ["k"], "j", "x", design(*args)).collect(), key=lambda r: r["j"])
    assert all(r["kept"] == f"{r['k']} {r['j']}" and r.asDict().keys() == {"k", "j", "x", "kept"} for r in got)
    for k, x in series.items():
        y = np.concatenate([r["x"] for r in got if r["k"] == k])
        np.testing.assert_allclose(y, zero_phase([x], design(*args))[0], atol=1e-9)


def test_long_form_of_one_series_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(long_series, "BLOCK_BITS", 7)
    x = np.random.default_rng(6).standard_normal(5000)
    rows = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "k int, i int, v double").repartition(3)
    out = long_series.bandpass_long(rows, ["k"], ["i"], "v", *WIDE)
    got = sorted(out.collect(), key=lambda r: r["i"])
    assert out.columns == ["k", "i", "v", "filtered"] and [r["v"] for r in got] == x.tolist()
    np.testing.assert_allclose([r["filtered"] for r in got], zero_phase([x], design(*WIDE))[0], atol=1e-9)


def test_errors_and_emptiness_of_long_series(spark):
    blocks = lambda rows: spark.createDataFrame(rows, "k int, j int, x array<double>")
    with pytest.raises(Exception, match="too short"):
        long_series.filter_blocks(blocks([(1, 0, [1.0] * 10), (1, 1, [1.0] * 11)]), ["k"], "j", "x", design(*WIDE)).collect()
    with pytest.raises(Exception, match="have the same j"):
        long_series.filter_blocks(blocks([(1, 0, [1.0] * 40), (1, 0, [1.0] * 40)]), ["k"], "j", "x", design(*WIDE)).collect()
    assert long_series.filter_blocks(blocks([]), ["k"], "j", "x", design(*WIDE)).collect() == []


def matrices(spark, *shapes):
    rows = [(m, c, [float(v) for v in x]) for m, s in enumerate(shapes) for c, x in enumerate(np.random.default_rng(m).standard_normal(s))]
    return spark.createDataFrame(rows, "m int, c int, x array<double>")


def test_to_differential(spark):
    t = np.linspace(0, 1, 1000)
    first = np.stack([np.sin(2 * np.pi * f * t) for f in (10, 100, 500)])
    rows = [(m, c, [float(v) for v in x]) for m, k in ((1, 1.0), (2, 0.5)) for c, x in enumerate(k * first)]
    out = to_differential(spark.createDataFrame(rows, "m int, c int, x array<double>"), "m", "c", "x", 1000, {"n": 4, "low": 20, "up": 400}).collect()
    assert len(out) == 4
    for r in out:
        k = 1.0 if r["m"] == 1 else 0.5
        np.testing.assert_allclose(r["raw"], k * (first[r["diff_idx"] + 1] - first[r["diff_idx"]]), atol=1e-10)
        assert len(r["filtered"]) == 1000 and not np.allclose(r["raw"], r["filtered"])


@pytest.mark.parametrize(("shapes", "spec"), [([(1, 100)], {"n": 4}), ([], {"n": 4}), ([(2, 100), (3, 100)], {"n": 4}), ([(2, 100)], {"n": 3})])
def test_differential_errors(spark, shapes, spec):
    with pytest.raises(ValueError):
        to_differential(matrices(spark, *shapes), "m", "c", "x", 1000, {"low": 20, "up": 400} | spec).collect()
    with pytest.raises(KeyError):
        to_differential(matrices(spark, (2, 100)), "m", "c", "x", 1000, {"n": 4})
