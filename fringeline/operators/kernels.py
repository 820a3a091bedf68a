"""NumPy kernels of the correlator; samples are complex arrays, nothing here knows of Spark."""

from __future__ import annotations

import numpy as np

# The levels of two-bit samples.
LEVELS = np.array([-3.336, -1.0, 1.0, 3.336])


def levels(q: np.ndarray, bits: int, *, even: bool = False) -> np.ndarray:
    """Values of stored components: the level table for two bits, else (or on demand) even levels from -1 to 1."""
    return LEVELS[q] if bits == 2 and not even else -1 + q.astype(float) * 2 / ((1 << bits) - 1)


#: The four values of each byte of two-bit components.
BYTE_LEVELS = LEVELS[np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3]


def stored_levels(raw: bytes, bits: int) -> np.ndarray:
    """Values of stored() components, with the filling."""
    return BYTE_LEVELS[np.frombuffer(raw, np.uint8)].ravel() if bits == 2 else levels(components(raw, bits), bits)


def pairs(components: np.ndarray) -> np.ndarray:
    """Complex samples of interleaved components."""
    return components[..., 0::2] + 1j * components[..., 1::2]


def stored(components: np.ndarray, bits: int) -> np.ndarray:
    """Bytes of the components of the last axis, the first one in the lowest bits; filled up with zeros."""
    if bits > 8:
        return np.ascontiguousarray(components.astype("<u2" if bits <= 16 else "<u4")).view(np.uint8)
    per = 8 // bits
    lead, n = components.shape[:-1], components.shape[-1]
    out = np.zeros((*lead, -(-n // per) * per), np.uint8)
    out[..., :n] = components
    out = out.reshape(*lead, -1, per)
    total = out[..., 0].copy()
    for i in range(1, per):
        total |= out[..., i] << np.uint8(bits * i)
    return total


def components(raw: bytes, bits: int) -> np.ndarray:
    """The inverse of stored(), with the filling."""
    if bits > 8:
        return np.frombuffer(raw, "<u2" if bits <= 16 else "<u4")
    shifts = np.arange(0, 8 // bits * bits, bits, dtype=np.uint8)
    return (np.frombuffer(raw, np.uint8)[:, None] >> shifts & np.uint8((1 << bits) - 1)).ravel()


def delay(coeffs: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Quadratic delay at offsets t within a block."""
    return coeffs[0] + t * (coeffs[1] + t * coeffs[2])


def turns(f: float, fs: float, d: np.ndarray, lower_complex: bool) -> np.ndarray:
    """Phase argument in turns, reduced to its fraction before it is used."""
    x = (f - fs if lower_complex else f) * d
    return x - np.trunc(x)


def rotator(x: np.ndarray) -> np.ndarray:
    return np.exp(2j * np.pi * x)


def fringe_rotate(samples: np.ndarray, first: int, fs: float, f: float, coeffs: np.ndarray, *, lower_complex: bool = False, mode: str = "full") -> np.ndarray:
    """Rotates samples, or rows of them, numbered from first.  mode: every sample, a line between the ends, or the first sample's phase."""
    n = samples.shape[-1]
    at = lambda i: np.where(lower_complex, f - fs, f) * delay(coeffs, (first + np.asarray(i, float)) / fs)
    if mode == "full":
        x = at(np.arange(n))
    elif mode == "linear":
        a, b = at(0), at(n - 1)
        x = a + (b - a) * np.arange(n) / max(n - 1, 1)
    else:
        x = at(0) + np.zeros(n)
    return samples * rotator(x - np.trunc(x))


def windows(samples: np.ndarray, size: int) -> np.ndarray:
    """Whole windows of a stream; the remainder is dropped."""
    n = len(samples) // size
    return samples[: n * size].reshape(n, size)


def spectra(samples: np.ndarray, size: int, *, hanning: bool = False) -> np.ndarray:
    rows = windows(samples, size)
    if hanning:
        rows = rows * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / (size - 1)))
    return np.fft.fft(rows, axis=1)


def half_band(spectrum: np.ndarray, sideband: str) -> np.ndarray:
    n = spectrum.shape[-1] // 2
    return spectrum[..., n:] if sideband == "L" else spectrum[..., :n]


def fraction(d: np.ndarray, fs: float) -> np.ndarray:
    """Fraction of a sample in (-0.5, 0.5]."""
    x = d * fs
    x = x - np.floor(x)
    return np.where(x > 0.5, x - 1, x)


def band_scale(size: int, kind: str) -> np.ndarray:
    """Frequency of each coefficient as a part of the sample rate: complex, or a half of a real signal's band."""
    if kind == "complex":
        return np.arange(size) / size
    k = np.arange(size // 2) / size
    return k if kind == "upper" else -(0.5 - k)


def fraction_rotate(spectrum: np.ndarray, fr: np.ndarray, kind: str, size: int) -> np.ndarray:
    return spectrum * np.exp(2j * np.pi * band_scale(size, kind)[None, :] * fr[:, None])


def accumulate(streams: np.ndarray) -> np.ndarray:
    """acc[i, k, :] = sum over windows of F_i conj(F_k) for i <= k; streams is (stream, window, coefficient)."""
    i, k = np.triu_indices(len(streams))
    out = np.zeros((len(streams), len(streams), streams.shape[2]), complex)
    out[i, k] = products(streams, i, k)
    return out


def products(streams: np.ndarray, i: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The sums over windows of F_i conj(F_k) of each pair (i, k)."""
    out = np.empty((len(i), streams.shape[2]), complex)
    for row, (a, b) in enumerate(zip(i.tolist(), k.tolist(), strict=True)):
        out[row] = np.einsum("wf,wf->f", streams[a], streams[b].conj())
    return out


def shared(streams: np.ndarray, have: np.ndarray, i: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that both streams of each pair have, and the total power of either over these.

    streams is (stream, window, coefficient), zero in the windows that a stream has not; have is (stream, window).
    """
    power = np.einsum("swf,swf->sw", streams, streams.conj()).real
    return np.einsum("pw,pw->p", have[i].astype(np.int64), have[k].astype(np.int64)), np.einsum("pw,pw->p", power[i], have[k].astype(float)), np.einsum("pw,pw->p", power[k], have[i].astype(float))


def normalise(acc: np.ndarray) -> np.ndarray:
    """Divides by the geometric mean of the streams' total powers; a stream without power gives NaN."""
    power = np.abs(np.einsum("iif->if", acc)).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return acc / np.sqrt(power[:, None, None] * power[None, :, None])


def slips(d_start: np.ndarray, d_end: np.ndarray, slope: np.ndarray, fs: np.ndarray, n: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """+1 (drop), -1 (insert) or 0, and the sample where the delay's fraction of a sample crosses one half, of chunks of n samples."""
    a, b = d_start * fs % 1.0, d_end * fs % 1.0
    kind = np.where((slope > 0) & (a < 0.5) & (b >= 0.5), 1, np.where((slope < 0) & (b < 0.5) & (a >= 0.5), -1, 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        at = np.round((0.5 - a) / (b - a) * (n - 1))
    return kind, np.where(kind != 0, at, -1).astype(np.int64)


def moved(coeffs: np.ndarray, fs: float, shift: int, first: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """New numbers of samples numbered from first, once all slips before them are made, and which of them stay.

    A sample at which the delay's whole samples go up is dropped; where they go down, a number is left free before it.
    """
    n = first + np.arange(-1, count)
    whole = np.floor(delay(coeffs, n / fs) * fs + 0.5).astype(np.int64)  # a half goes up
    return n[1:] - (whole[1:] - shift), whole[1:] <= whole[:-1]


def slip(d_start: float, d_end: float, slope: float, fs: float, n: int) -> tuple[int, int]:
    """slips() of one chunk."""
    kind, at = slips(*(np.array([float(x)]) for x in (d_start, d_end, slope, fs)), n)
    return int(kind[0]), int(at[0])


def apply_slip(samples: np.ndarray, kind: int, index: int) -> np.ndarray:
    if kind > 0:
        return np.delete(samples, index)
    return np.insert(samples, index, 0) if kind < 0 else samples


def calibration_bins(fs: float, f: float, step: float) -> int:
    """Samples of one period of the calibration tones."""
    from math import gcd

    a = gcd(int(f - fs / 2), int(step))
    return int(fs) // gcd(int(fs), a)


def fold(samples: np.ndarray, first: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of samples, numbered from first, by their number modulo bins."""
    at = (first + np.arange(len(samples))) % bins
    sums = np.bincount(at, samples.real, bins) + (1j * np.bincount(at, samples.imag, bins) if np.iscomplexobj(samples) else 0)
    return sums, np.bincount(at, minlength=bins)


def tones(folded: np.ndarray, shift: int = 0) -> np.ndarray:
    """Spectrum of one folded period, rolled by the whole samples of the delay."""
    return np.fft.fft(np.roll(folded, shift % len(folded)))


def calibration(samples: np.ndarray, bins: int, shift: int = 0) -> tuple[np.ndarray, int]:
    """Folds whole periods and transforms; also the number of periods."""
    n = len(samples) // bins
    return tones(fold(samples[: n * bins], 0, bins)[0], shift), n


def drift(coeffs: np.ndarray, fs: float, period: float, shift: int) -> int:
    """Samples by which windows of a block may lie off its whole shift, either way: from the delay at the ends and the turn."""
    if not np.abs(coeffs).max() > 0:
        return 1
    t = [0.0, period]
    if coeffs[2]:
        t.append(min(max(-coeffs[1] / (2 * coeffs[2]), 0.0), period))
    return int(np.ceil(np.abs(delay(coeffs, np.array(t)) * fs - shift).max())) + 2
