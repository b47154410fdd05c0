"""Seeded samplers for series of shares, one chain for each series: a quick logit-normal AR(1), and a beta state-space model.

The second has a beta response, an AR(1) process on the logit scale, linear terms of lagged covariates in place of
splines, and priors as a parameter. Draws have the form that the draw summaries take.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def fit_series(y: np.ndarray, draws: int, burn: int, seed: int) -> np.ndarray:
    """Draws of the fitted mean (draws by times) of a logit-normal AR(1), by Gibbs steps; missing values are drawn too."""
    rng = np.random.default_rng(seed)
    z = np.log(np.clip(y, 0.001, 0.999) / (1 - np.clip(y, 0.001, 0.999)))
    hole = np.isnan(z)
    mu, rho, s2 = (0.0 if hole.all() else float(np.nanmean(z))), 0.3, 1.0
    z = np.where(hole, mu, z)
    out = np.empty((draws, len(z)))
    for i in range(burn + draws):
        prev = np.concatenate([[mu], z[:-1]]) - mu
        fit = mu + rho * prev
        z = np.where(hole, fit + rng.normal(0, np.sqrt(s2), len(z)), z)
        s2 = (0.5 * np.sum((z - fit) ** 2) + 0.25) / rng.gamma(0.5 * len(z) + 2.0)
        x, r = z[:-1] - mu, z[1:] - mu
        prec = np.sum(x * x) / s2 + 1 / 0.35**2
        rho = float(np.clip(rng.normal((np.sum(x * r) / s2 + 0.3 / 0.35**2) / prec, np.sqrt(1 / prec)), -0.99, 0.99))
        prec = len(z) * (1 - rho) ** 2 / s2 + 1 / 4.0
        mu = float(rng.normal(((1 - rho) * np.sum(z[1:] - rho * z[:-1]) + z[0]) / s2 / prec, np.sqrt(1 / prec)))
        if i >= burn:
            out[i - burn] = 1 / (1 + np.exp(-(mu + rho * (np.concatenate([[mu], z[:-1]]) - mu))))
    return out


def sample_draws(df: DataFrame, series: str, time: str, value: str, *, draws: int = 500, burn: int = 500, seed: int = 1) -> DataFrame:
    """(series, draw, time, value): posterior draws of each series of shares, the same for the same seed and data.

    A series is as long as its panel of times, so a task holds one series; times are its own distinct ones, in order, repeated ones averaged.
    """
    from pyspark.sql import functions as F

    panel = df.where(F.col(series).isNotNull() & F.col(time).isNotNull()).groupBy(series, time).agg(F.avg(value).alias(value))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time)
        own = seed + int.from_bytes(str(pdf[series].iloc[0]).encode()[-6:], "big") % 1_000_003
        out = fit_series(pdf[value].to_numpy(float), draws, burn, own)
        n = len(pdf)
        return pd.DataFrame({series: np.repeat(pdf[series].iloc[0], draws * n), "draw": np.repeat(np.arange(draws, dtype=np.int32), n), "time": np.tile(pdf[time].to_numpy(np.int32), draws), "value": out.ravel()})

    return panel.groupBy(series).applyInPandas(run, f"`{series}` {dict(df.dtypes)[series]}, draw int, time int, value double")


SLICES = 2

# A state-space model with a beta response -------------------------------------------------------------------------


@dataclass(frozen=True)
class Priors:
    """Priors of the state-space model; the defaults are those of the forecasts this library serves."""

    # Gamma (shape, rate) of the precision, normal (mean, sd) of the autocorrelation, half student t (degrees, scale) of the
    # process deviation, and the sd of the covariates' coefficients and of the intercept.
    phi: tuple[float, float] = (4.0, 1.0)
    ar1: tuple[float, float] = (0.3, 0.35)
    sigma: tuple[float, float] = (3.0, 0.25)
    beta_sd: float = 0.5
    mean: tuple[float, float] = (0.0, 2.0)

    def log(self, phi: float, ar1: float, sigma: float) -> float:
        """Log density of the parameters, up to a constant; minus infinity where they cannot be."""
        if phi <= 0 or sigma <= 0 or not -1 < ar1 < 1:
            return -np.inf
        df, scale = self.sigma
        return (self.phi[0] - 1) * np.log(phi) - self.phi[1] * phi - 0.5 * ((ar1 - self.ar1[0]) / self.ar1[1]) ** 2 - (df + 1) / 2 * np.log1p((sigma / scale) ** 2 / df)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for positive numbers: Stirling's series after eight steps up."""
    steps = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7)
    shift, z = np.log(steps), x + 8
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


def _log_likelihood(y: np.ndarray, seen: np.ndarray, eta: np.ndarray, phi: float) -> float:
    """Of the seen shares under a beta distribution with mean logistic(eta) and precision phi; ``y`` holds their logarithms, then those of what they lack to 1."""
    e = np.exp(-np.clip(eta[seen], -13.8, 13.8))
    shape = np.concatenate([1 / (1 + e), e / (1 + e)]) * phi
    return len(e) * math.lgamma(phi) - float(np.sum(_log_gamma(shape)) - np.dot(shape - 1, y))


def _memory(n: int, ar1: float) -> np.ndarray:
    """Matrix that turns independent shocks to a stationary AR(1) series of unit innovations."""
    lag = np.subtract.outer(np.arange(n), np.arange(n))
    m = np.where(lag >= 0, ar1 ** np.maximum(lag, 0), 0.0)
    m[:, 0] /= np.sqrt(1 - ar1 * ar1)
    return m


def fit_beta_series(y: np.ndarray, x: np.ndarray, draws: int, burn: int, seed: int, priors: Priors = Priors()) -> tuple[np.ndarray, np.ndarray]:
    """Draws of the mean (draws by times) and of (phi, ar1, sigma, intercept, coefficients) of a beta state-space model.

    The logit of the mean is an intercept, the covariates' effects and an AR(1) process. Shocks on one side, intercept and coefficients on the other, whose
    priors are normal, are drawn by elliptical slices, the other three by Metropolis steps whose size is fitted while
    burning in. Missing values of ``y`` add nothing, so steps past the last one are forecasts; missing covariates count as 0.
    """
    rng = np.random.default_rng(seed)
    n, k = len(y), x.shape[1]
    x = np.nan_to_num(x)
    seen = ~np.isnan(y)
    y = np.clip(y[seen], 0.001, 0.999)
    y = np.concatenate([np.log(y), np.log1p(-y)])
    scale = np.concatenate([np.ones(n), [priors.mean[1]], np.full(k, priors.beta_sd)])
    state = rng.normal(size=n + 1 + k) * 0.1  # in units of the priors' deviations
    theta, step = np.array([np.log(priors.phi[0] / priors.phi[1]), priors.ar1[0], np.log(priors.sigma[1])]), np.array([0.3, 0.2, 0.3])

    def eta(s: np.ndarray, ar1: float, sigma: float, m: np.ndarray) -> np.ndarray:
        v = s * scale
        return priors.mean[0] + v[n] + x @ v[n + 1 :] + sigma * (m @ v[:n])

    first = np.arange(n + 1 + k) < n
    blocks = [first, ~first]
    m = _memory(n, theta[1])
    like = _log_likelihood(y, seen, eta(state, theta[1], np.exp(theta[2]), m), np.exp(theta[0]))
    means, params = np.empty((draws, n)), np.empty((draws, 4 + k))
    for i in range(burn + draws):
        for block in blocks * SLICES:  # an elliptical slice through a block of the state and a fresh draw of its prior
            other, bar, angle = rng.normal(size=len(state)), like + np.log(rng.random()), rng.uniform(0, 2 * np.pi)
            low, high = angle - 2 * np.pi, angle
            while high - low > 1e-9:
                new = np.where(block, state * np.cos(angle) + other * np.sin(angle), state)
                got = _log_likelihood(y, seen, eta(new, theta[1], np.exp(theta[2]), m), np.exp(theta[0]))
                if got > bar:
                    state, like = new, got
                    break
                low, high = (angle, high) if angle < 0 else (low, angle)
                angle = rng.uniform(low, high)
        for j in range(3):
            new = theta.copy()
            new[j] += rng.normal() * step[j]
            if not -0.99 < new[1] < 0.99:
                continue
            m2 = _memory(n, new[1]) if j == 1 else m
            got = _log_likelihood(y, seen, eta(state, new[1], np.exp(new[2]), m2), np.exp(new[0]))
            gain = got - like + priors.log(np.exp(new[0]), new[1], np.exp(new[2])) - priors.log(np.exp(theta[0]), theta[1], np.exp(theta[2])) + (new[0] - theta[0]) + (new[2] - theta[2])  # on the log scale
            ok = np.log(rng.random()) < gain
            if ok:
                theta, m, like = new, m2, got
            if i < burn:
                step[j] *= 1.05 if ok else 0.98
        if i >= burn:
            v = state * scale
            means[i - burn] = 1 / (1 + np.exp(-eta(state, theta[1], np.exp(theta[2]), m)))
            params[i - burn] = [np.exp(theta[0]), theta[1], np.exp(theta[2]), priors.mean[0] + v[n], *v[n + 1 :]]
    return means, params


def beta_forecast(df: DataFrame, series: str, time: str, value: str, covariates: list[str], *, horizon: int = 2, draws: int = 500, burn: int = 500, seed: int = 1, priors: Priors = Priors()) -> DataFrame:
    """(series, draw, time, value, is_forecast): draws of the mean share at each time of a series and ``horizon`` steps on.

    Covariates are columns of the same rows (lagged values, seasons as 0 and 1); they are centred and scaled within the series. Times are the
    whole steps from a series' first to its last; those without a row have no value and covariates of 0, as the steps past the
    last have. A task holds one series, which is as long as its calendar. The same for the same seed and data.
    """
    from pyspark.sql import functions as F

    panel = df.where(F.col(series).isNotNull() & F.col(time).isNotNull()).groupBy(series, time).agg(F.avg(value).alias(value), *[F.avg(c).alias(c) for c in covariates])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.set_index(time).sort_index()
        last = int(pdf.index[-1])
        pdf = pdf.reindex(range(int(pdf.index[0]), last + horizon + 1))
        key = pdf[series].dropna().iloc[0]
        x = pdf[covariates].to_numpy(float).reshape(len(pdf), len(covariates))
        with np.errstate(invalid="ignore"):
            n = np.maximum(1, (~np.isnan(x)).sum(0))
            centre = np.nansum(x, 0) / n
            spread = np.sqrt(np.nansum((x - centre) ** 2, 0) / n)
        x = (x - centre) / np.where(spread > 0, spread, 1.0)
        own = seed + int.from_bytes(str(key).encode()[-6:], "big") % 1_000_003
        means, _ = fit_beta_series(pdf[value].to_numpy(float), x, draws, burn, own, priors)
        t = pdf.index.to_numpy(np.int32)
        return pd.DataFrame({series: np.repeat(key, means.size), "draw": np.repeat(np.arange(draws, dtype=np.int32), len(t)), "time": np.tile(t, draws), "value": means.ravel(), "is_forecast": np.tile(t > last, draws)})

    return panel.groupBy(series).applyInPandas(run, f"`{series}` {dict(df.dtypes)[series]}, draw int, time int, value double, is_forecast boolean")


def save_model(draws: DataFrame, folder: str, series: str, priors: Priors = Priors()) -> DataFrame:
    """Writes draws as Parquet and their summary by series as CSV under a folder; the summary."""
    from pyspark.sql import functions as F

    draws.write.mode("overwrite").parquet(f"{folder}/draws")
    kept = draws.sparkSession.read.parquet(f"{folder}/draws")
    s = kept.groupBy(series).agg(F.count_distinct("draw").alias("n_draws"), F.count_distinct("time").alias("n_times"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")).withColumn("priors", F.lit(repr(priors)))
    s.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/summary")
    return s
