import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fringeline.operators import kernels as K

R = np.random.default_rng(0)


def noise(n):
    return R.normal(size=n) + 1j * R.normal(size=n)


def test_auto_rows_sum_to_one():
    f = np.stack([K.spectra(noise(640), 64) for _ in range(3)])
    v = K.normalise(K.accumulate(f))
    assert np.allclose([np.abs(v[i, i]).sum() for i in range(3)], 1)


def test_swapped_streams_are_conjugate():
    a, b = K.spectra(noise(640), 64), K.spectra(noise(640), 64)
    assert np.allclose(K.accumulate(np.stack([a, b]))[0, 1], K.accumulate(np.stack([b, a]))[0, 1].conj())


def test_delayed_copy_gives_a_slope():
    x = noise(64)
    f = K.accumulate(np.stack([np.fft.fft(x)[None], np.fft.fft(np.roll(x, 3))[None]]))[0, 1]
    assert np.allclose(np.angle(f * np.exp(-2j * np.pi * 3 * np.arange(64) / 64)), 0, atol=1e-9)


def test_power_is_kept():
    x = noise(256)
    assert np.allclose((np.abs(K.spectra(x, 64)) ** 2).sum() / 64, (np.abs(x) ** 2).sum())


def test_windows_drop_the_remainder():
    assert K.windows(np.arange(130), 64).shape == (2, 64)


@pytest.mark.parametrize("mode", ["full", "linear", "first"])
def test_rotation_keeps_magnitude_and_undoes(mode):
    x, c = noise(64), np.array([1e-3, 1e-6, 0])
    y = K.fringe_rotate(x, 128, 64.0, 1000.0, c, mode=mode)
    assert np.allclose(np.abs(x), np.abs(y))
    assert np.allclose(K.fringe_rotate(y, 128, 64.0, -1000.0, c, mode=mode), x)


def test_linear_mode_is_exact_for_linear_delays():
    x, c = noise(64), np.array([1e-3, 1e-4, 0])
    assert np.allclose(K.fringe_rotate(x, 0, 64.0, 1000.0, c, mode="linear"), K.fringe_rotate(x, 0, 64.0, 1000.0, c))


@given(st.floats(-5, 5))
@settings(deadline=None)
def test_fraction_is_within_half_a_sample(d):
    f = float(K.fraction(np.array([d]), 32.0)[0])
    assert -0.5 <= f <= 0.5 and np.isclose((d * 32 - f) % 1.0 % 1.0, 0, atol=1e-6) or np.isclose((d * 32 - f) % 1.0, 1, atol=1e-6)


def test_half_bands_and_scales():
    f = np.arange(8)
    assert K.half_band(f, "L").tolist() == [4, 5, 6, 7] and K.half_band(f, "U").tolist() == [0, 1, 2, 3]
    assert K.band_scale(8, "lower").tolist() == [-0.5, -0.375, -0.25, -0.125]


def test_calibration_window_of_the_example():
    assert K.calibration_bins(32e6, 3480.4e6, 5e6) == 160


def test_slips():
    assert K.slip(0.4 / 64, 0.6 / 64, 1.0, 64.0, 65) == (1, 32)
    assert K.slip(0.6 / 64, 0.4 / 64, -1.0, 64.0, 65) == (-1, 32)
    assert K.slip(0.1 / 64, 0.2 / 64, 1.0, 64.0, 65) == (0, -1)
    x = np.arange(5)
    assert K.apply_slip(x, 1, 2).tolist() == [0, 1, 3, 4] and K.apply_slip(x, -1, 2).tolist() == [0, 1, 0, 2, 3, 4]


@pytest.mark.parametrize("bits", [1, 2, 4, 8, 16])
def test_stored_components(bits):
    q = np.random.default_rng(bits).integers(0, 1 << bits, (3, 21))
    for row, raw in zip(q, K.stored(q, bits), strict=True):
        assert K.components(raw.tobytes(), bits)[:21].tolist() == row.tolist()
        assert np.array_equal(K.stored_levels(raw.tobytes(), bits)[:21], K.levels(row, bits))
