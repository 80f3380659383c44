import math


def kernel_weights(peak: int, lags: int = 14) -> list[float]:
    """Gaussian weights over the lags around a peak, computed plainly."""
    sigma = max(1.5, peak / 2.5)
    raw = [math.exp(-0.5 * ((n - peak) / sigma) ** 2) for n in range(1, lags + 1)]
    return [w / sum(raw) for w in raw]
