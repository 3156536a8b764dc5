"""Descriptors of one excerpt of mono samples, in numpy over blocks of frames."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

# Frames, bands and limits of the descriptors.
FRAME, HOP, BANDS, ROLLOFF = 2048, 480, 40, 0.85
CHROMA_FRAME, CHROMA_HOP = 8192, 4096
EXCERPT_SECONDS, LEAST_TRACK_SECONDS, LEAST_EXCERPT_SECONDS = 90.0, 45, 20.0
PITCHES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
# Krumhansl's and Kessler's profiles of major and minor keys.
PROFILES = {
    "major": (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88),
    "minor": (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17),
}
#: Frames transformed at once.
_BLOCK = 512


def hann(n: int) -> np.ndarray:
    """The periodic window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def spectra(x: np.ndarray, size: int, hop: int) -> Iterator[np.ndarray]:
    """Transforms of the windowed frames, a block of frames at a time."""
    if len(x) >= size:
        frames, window = sliding_window_view(x, size)[::hop], hann(size)
        for i in range(0, len(frames), _BLOCK):
            yield np.fft.rfft(frames[i : i + _BLOCK] * window, axis=1)


def log_bands(rate: int, size: int, bands: int = BANDS) -> np.ndarray:
    """Edges, as bins, of bands between 30 Hz and 16 kHz that are alike in the logarithm."""
    hz = np.exp(np.linspace(math.log(30.0), math.log(min(16_000.0, rate / 2)), bands + 1))
    return np.minimum(np.floor(hz * size / rate + 0.5).astype(int), size // 2)


def spectral(x: np.ndarray, rate: int) -> tuple[dict[str, float], np.ndarray]:
    """Means over frames that aren't silent of centroid, rolloff (Hz) and flatness (dB); and logarithmic energies by frame and band."""
    low = log_bands(rate, FRAME)[:-1]
    high = np.minimum(np.maximum(log_bands(rate, FRAME)[1:], low + 1), FRAME // 2 + 1)
    hz, sums, voiced, bands = np.arange(1, FRAME // 2 + 1) * rate / FRAME, np.zeros(3), 0, []
    for block in spectra(x, FRAME, HOP):
        power = block.real**2 + block.imag**2
        upto = np.concatenate([np.zeros((len(power), 1)), np.cumsum(power, axis=1)], axis=1)
        bands.append(np.log1p(1000 * (upto[:, high] - upto[:, low]) / FRAME))
        power = power[:, 1:]
        total = power.sum(axis=1)
        power, total = power[total >= 1e-9], total[total >= 1e-9]
        voiced += len(power)
        rolled = (np.cumsum(power, axis=1) >= ROLLOFF * total[:, None]).argmax(axis=1)
        flat = np.exp(np.log(power + 1e-12).mean(axis=1)) / power.mean(axis=1)
        sums += [(power @ hz / total).sum(), hz[rolled].sum(), (10 * np.log10(np.maximum(flat, 1e-12))).sum()]
    means = sums / voiced if voiced else np.full(3, np.nan)
    return dict(zip(("spectral_centroid", "spectral_rolloff", "spectral_flatness"), means.tolist(), strict=True)), np.concatenate(bands) if bands else np.zeros((0, BANDS))


def around(values: np.ndarray, half: int) -> np.ndarray:
    """The mean of each value and those up to `half` away."""
    sums, at = np.concatenate([[0.0], np.cumsum(values)]), np.arange(len(values))
    low, high = np.maximum(at - half, 0), np.minimum(at + half + 1, len(values))
    return (sums[high] - sums[low]) / (high - low)


def onset_envelope(bands: np.ndarray) -> np.ndarray:
    """Rises summed over bands, less their mean within 25 frames, at least 0."""
    flux = np.zeros(len(bands))
    flux[1:] = np.maximum(np.diff(bands, axis=0), 0).sum(axis=1)
    return np.maximum(flux - around(flux, 25), 0)


def onset_rate(envelope: np.ndarray, fps: float) -> float:
    """Peaks a second: over mean and deviation, not exceeded within 3 frames, at least 50 ms apart."""
    n = len(envelope)
    if n < 3:
        return 0.0
    top = sliding_window_view(np.pad(envelope, 3, constant_values=-np.inf), 7).max(axis=1)
    gap, taken, last = math.ceil(0.05 * fps), 0, -np.inf
    for t in np.flatnonzero((envelope > envelope.mean() + envelope.std()) & (envelope >= top)).tolist():
        if t - last >= gap:
            taken, last = taken + 1, t
    return taken * fps / n


def tempo(envelope: np.ndarray, fps: float) -> float | None:
    """Beats a minute from 40 to 220: the best autocorrelation, weighted towards 120, refined between frames."""
    n = len(envelope)
    centred = envelope - (envelope.mean() if n else 0)
    energy = float(centred @ centred)
    least, most = max(1, math.floor(60 * fps / 220)), min(math.ceil(60 * fps / 40), n // 2)
    if energy < 1e-12 or most <= least + 2:
        return None
    padded = np.fft.rfft(centred, 1 << (2 * n - 1).bit_length())
    auto = np.fft.irfft(padded * padded.conj())[: most + 2] / energy
    lags = np.arange(least, most + 1)
    score = auto[lags] * np.exp(-0.5 * np.log2(60 * fps / lags / 120) ** 2)
    best = int(lags[score.argmax()])
    if score.max() <= 0:
        return None
    a, b, c = auto[best - 1 : best + 2]
    bend = a - 2 * b + c
    return 60 * fps / (best + (float(np.clip(0.5 * (a - c) / bend, -0.5, 0.5)) if abs(bend) > 1e-12 else 0.0))


def chroma(x: np.ndarray, rate: int) -> np.ndarray | None:
    """How much of each pitch class there is from 100 to 5000 Hz: a sum over frames, each scaled by its greatest."""
    hz = np.arange(CHROMA_FRAME // 2 + 1) * rate / CHROMA_FRAME
    on = np.flatnonzero((hz >= 100) & (hz < 5000))
    pitch = np.zeros((len(on), 12))
    midi = 69 + 12 * np.log2(hz[on] / 440)
    pitch[np.arange(len(on)), np.floor(midi + 0.5).astype(int) % 12] = 1
    total, frames = np.zeros(12), 0
    for block in spectra(x, CHROMA_FRAME, CHROMA_HOP):
        bins = np.abs(block[:, on]) @ pitch
        peak = bins.max(axis=1)
        total += (bins[peak > 1e-9] / peak[peak > 1e-9, None]).sum(axis=0)
        frames += int((peak > 1e-9).sum())
    return total if frames else None


def key(x: np.ndarray, rate: int) -> tuple[str, str, float] | None:
    """(pitch, scale, strength) of the profile that goes with the chroma best."""
    found = chroma(x, rate)
    if found is None:
        return None
    names = [(tonic, scale) for tonic in range(12) for scale in PROFILES]
    turned = np.array([np.roll(PROFILES[scale], tonic) for tonic, scale in names])
    a, b = found - found.mean(), turned - turned.mean(axis=1, keepdims=True)
    r = b @ a / np.sqrt((a @ a) * (b * b).sum(axis=1)) if a @ a >= 1e-12 else np.zeros(len(names))
    tonic, scale = names[int(r.argmax())]
    return PITCHES[tonic], scale, float(np.clip(r.max(), 0, 1))


def _biquad(rate: int, f0: float, q: float, gain: float | None) -> tuple[np.ndarray, np.ndarray]:
    """A stage of the loudness weighting: a shelf of so many dB above f0, or without gain a high pass."""
    k = math.tan(math.pi * f0 / rate)
    a0 = 1 + k / q + k * k
    a = np.array([1, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0])
    if gain is None:
        return np.array([1.0, -2.0, 1.0]), a
    high = 10 ** (gain / 20)
    band = high**0.4996667741545416
    return np.array([high + band * k / q + k * k, 2 * (k * k - high), high - band * k / q + k * k]) / a0, a


def weighted(x: np.ndarray, rate: int) -> np.ndarray:
    """Samples with the ear's weighting (ITU-R BS.1770), by their spectrum; zeros after them take the filters' tail."""
    n = 1 << (len(x) + rate).bit_length()
    z = np.exp(-2j * np.pi * np.arange(n // 2 + 1) / n)
    response = 1
    # Frequency, quality and gain of both stages.
    for f0, q, gain in ((1681.974450955533, 0.7071752369554196, 3.999843853973347), (38.13547087602444, 0.5003270373238773, None)):
        b, a = _biquad(rate, f0, q, gain)
        response = response * (b[0] + b[1] * z + b[2] * z * z) / (a[0] + a[1] * z + a[2] * z * z)
    return np.fft.irfft(np.fft.rfft(x, n) * response, n)[: len(x)]


def loudness(x: np.ndarray, rate: int) -> tuple[float | None, float | None]:
    """Integrated loudness (LUFS) and loudness range (LU) after EBU R128; null for silence."""
    step = rate // 10
    squares = weighted(x, rate)[: len(x) // step * step].reshape(-1, step)
    tenths = (squares * squares).mean(axis=1)
    level = lambda e: -0.691 + 10 * np.log10(np.maximum(e, 1e-30))

    def gated(energy: np.ndarray, below: float) -> np.ndarray:
        energy = energy[level(energy) >= -70]
        return energy[level(energy) >= level(energy.mean()) - below] if len(energy) else energy

    def means(width: int, hop: int) -> np.ndarray:
        return sliding_window_view(tenths, width).mean(axis=1)[::hop] if len(tenths) >= width else tenths[:0]

    loud, short = gated(means(4, 1), 10), np.sort(gated(means(30, 10), 20))
    spread = None
    if len(short):
        low, high = (short[int((len(short) - 1) * p + 0.5)] for p in (0.1, 0.95))
        spread = float(level(high) - level(low))
    return float(level(loud.mean())) if len(loud) else None, spread


def dynamic_complexity(x: np.ndarray, rate: int) -> float | None:
    """The mean deviation of 400 ms blocks' levels that are over -70 dB; null under two."""
    size = rate * 2 // 5
    power = (x[: len(x) // size * size].reshape(-1, size).astype(float) ** 2).mean(axis=1)
    level = 10 * np.log10(np.maximum(power, 1e-12))
    level = level[level > -70]
    return float(np.abs(level - level.mean()).mean()) if len(level) >= 2 else None


def zero_crossing_rate(x: np.ndarray) -> float:
    return float(np.count_nonzero(np.diff(x >= 0))) / max(len(x), 1)


def excerpt(x: np.ndarray, rate: int, seconds: float | None = None) -> np.ndarray:
    """At most 90 seconds of a track; an error if it's known to last under 45 or there are under 20."""
    if seconds is not None and seconds < LEAST_TRACK_SECONDS:
        raise ValueError(f"a track of {seconds} s is too short")
    x = x[: int(EXCERPT_SECONDS * rate)]
    if len(x) < LEAST_EXCERPT_SECONDS * rate:
        raise ValueError(f"an excerpt of {len(x) / rate:.1f} s is too short")
    return x


def extract(x: np.ndarray, rate: int) -> dict[str, float | str | None]:
    """All descriptors; what isn't finite is null. Under four frames of samples are an error."""
    if len(x) <= 4 * FRAME:
        raise ValueError("too few samples")
    x = np.asarray(x, float)
    means, bands = spectral(x, rate)
    envelope, fps = onset_envelope(bands), rate / HOP
    pitch, scale, strength = key(x, rate) or (None, None, None)
    integrated, spread = loudness(x, rate)
    out = {
        "bpm": tempo(envelope, fps), "onset_rate": onset_rate(envelope, fps), "key": pitch, "scale": scale, "key_strength": strength, "loudness_integrated": integrated, "loudness_range": spread,
        "dynamic_complexity": dynamic_complexity(x, rate), **means, "zero_crossing_rate": zero_crossing_rate(x),
    }
    return {k: None if isinstance(v, float) and not math.isfinite(v) else v for k, v in out.items()}


def resample(x: np.ndarray, source: int, target: int, lobes: int = 32) -> np.ndarray:
    """Samples at another rate, by a sinc under a Blackman window. Output samples of one
    phase between input samples share their weights, so each phase is a product of a matrix and a vector."""
    if source == target or not len(x):
        return x
    up, down = target // math.gcd(source, target), source // math.gcd(source, target)
    cut = min(target / source, 1.0) * 0.95
    half = math.ceil(lobes / cut)
    out = np.zeros(len(x) * up // down)
    view = sliding_window_view(np.pad(np.asarray(x, float), (half - 1, half + down)), 2 * half)
    for r in range(min(up, len(out))):
        base, phase = divmod(r * down, up)
        t = np.arange(1 - half, half + 1) - phase / up
        taper = 0.42 - 0.5 * np.cos(np.pi * (t / half + 1)) + 0.08 * np.cos(2 * np.pi * (t / half + 1))
        weights = np.where(np.abs(t) < half, cut * np.sinc(cut * t) * taper, 0.0)
        place = out[r::up]
        place[:] = view[base::down][: len(place)] @ weights
    return out


def windows(x: np.ndarray, size: int = 480_000) -> np.ndarray:
    """Windows of that size: a last part of half of it or more counts, and one short
    excerpt alone; what is short is repeated as often as it fits, then padded with zeros."""
    parts = [p for p in np.split(x, range(size, len(x), size)) if 2 * len(p) >= size] or [x] * bool(len(x))
    return np.array([np.pad(np.tile(p, size // len(p)), (0, size % len(p))) for p in parts]).reshape(-1, size)


def _mel(hz: np.ndarray) -> np.ndarray:
    return np.where(hz < 1000, 3 * hz / 200, 15 + np.log(np.maximum(hz, 1) / 1000) * 27 / math.log(6.4))


def _hz(mel: np.ndarray) -> np.ndarray:
    return np.where(mel < 15, 200 * mel / 3, 1000 * np.exp(math.log(6.4) / 27 * (mel - 15)))


def mel_filters(rate: int = 48_000, size: int = 1024, mels: int = 64, low: float = 50.0, high: float = 14_000.0) -> np.ndarray:
    """Triangles on Slaney's scale, of one area each: bins by bands."""
    edges = _hz(np.linspace(_mel(np.array(low)), _mel(np.array(high)), mels + 2))
    hz = np.linspace(0, rate / 2, size // 2 + 1)[:, None]
    up, down = (hz - edges[:-2]) / np.diff(edges)[:-1], (edges[2:] - hz) / np.diff(edges)[1:]
    return np.maximum(np.minimum(up, down), 0) * 2 / (edges[2:] - edges[:-2])


def log_mel(window: np.ndarray, rate: int = 48_000, size: int = 1024, hop: int = 480) -> np.ndarray:
    """Levels (dB) by frame and band, of frames centred on every `hop`-th sample."""
    padded = np.pad(np.asarray(window, float), size // 2, mode="reflect")
    filters = mel_filters(rate, size)
    return np.concatenate([10 * np.log10(np.maximum((b.real**2 + b.imag**2) @ filters, 1e-10)) for b in spectra(padded, size, hop)])


def pooled(vectors: np.ndarray) -> np.ndarray:
    """The unit of the sum of unit vectors, so that no loud window counts for more."""
    units = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    total = units.sum(axis=0)
    return total / max(float(np.linalg.norm(total)), 1e-9)


def synthetic(album: int, track: int, rate: int = 48_000, seconds: float = 25.0) -> np.ndarray:
    """A track of an invented album: its chord, tempo and noise are the album's, what differs is small."""
    rng = np.random.default_rng(1000 * album + track)
    t = np.arange(int(rate * seconds)) / rate
    root = 220 * 2 ** ((album * 5 % 12) / 12)
    chord = sum(np.sin(2 * np.pi * root * r * t) for r in (1, 2 ** ((4 - album % 2) / 12), 2 ** (7 / 12)))
    beat = 60 / (90 + 12 * album)
    pulse = np.exp(-40 * (t % beat)) * rng.standard_normal(len(t))
    return (0.1 * chord + (0.05 + 0.02 * album) * pulse + 0.002 * rng.standard_normal(len(t))).astype(np.float32)
