"""Black-Scholes-Merton prices, Greeks and implied volatility on arrays.

All functions work on NumPy arrays of one length; ``call`` is boolean.
"""

from __future__ import annotations

import numpy as np

from voltide.functions.special import norm_cdf, norm_pdf

LOW_VOL, HIGH_VOL, BISECTIONS = 1e-6, 5.0, 80
OK, INVALID, OUT_OF_BOUNDS, NO_BRACKET = "OK", "INVALID_INPUT", "OUT_OF_BOUNDS", "NO_BRACKET"
GREEKS = ("delta", "gamma", "vega_1volpt", "theta_1calendar_day", "rho_1pct")


def _d(spot, strike, tau, r, q, sigma):
    root = sigma * np.sqrt(tau)
    d1 = (np.log(spot / strike) + (r - q + 0.5 * sigma * sigma) * tau) / root
    return d1, d1 - root


def approximate_cdf(x):
    """The rational approximation that SQL texts use (error below 7.5e-8)."""
    k = 1.0 / (1.0 + 0.2316419 * np.abs(x))
    poly = k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429))))
    tail = 0.3989422804014327 * np.exp(-0.5 * x * x) * poly
    return np.where(x >= 0, 1.0 - tail, tail)


def price(call, spot, strike, tau, r, q, sigma, norm_cdf=norm_cdf):
    """Present value of European options."""
    d1, d2 = _d(spot, strike, tau, r, q, sigma)
    forward, cash = spot * np.exp(-q * tau), strike * np.exp(-r * tau)
    sign = np.where(call, 1.0, -1.0)
    return sign * (forward * norm_cdf(sign * d1) - cash * norm_cdf(sign * d2))


def greeks(call, spot, strike, tau, r, q, sigma) -> dict[str, np.ndarray]:
    """Price, delta, gamma, vega per 0.01 of volatility, theta per calendar
    day and rho per 0.01 of rate."""
    d1, d2 = _d(spot, strike, tau, r, q, sigma)
    dq, dr = np.exp(-q * tau), np.exp(-r * tau)
    sign = np.where(call, 1.0, -1.0)
    n1, n2 = norm_cdf(sign * d1), norm_cdf(sign * d2)
    pdf, root = norm_pdf(d1), np.sqrt(tau)
    theta = -spot * dq * pdf * sigma / (2.0 * root) + sign * (q * spot * dq * n1 - r * strike * dr * n2)
    return {
        "price": sign * (spot * dq * n1 - strike * dr * n2),
        "delta": sign * dq * n1,
        "gamma": dq * pdf / (spot * sigma * root),
        "vega_1volpt": spot * dq * pdf * root * 0.01,
        "theta_1calendar_day": theta / 365.0,
        "rho_1pct": sign * strike * tau * dr * n2 * 0.01,
    }


def more_greeks(call, spot, strike, tau, r, q, sigma) -> dict[str, np.ndarray]:
    """Higher and mixed sensitivities, unscaled."""
    d1, d2 = _d(spot, strike, tau, r, q, sigma)
    dq, dr, root = np.exp(-q * tau), np.exp(-r * tau), np.sqrt(tau)
    sign, pdf = np.where(call, 1.0, -1.0), norm_pdf(d1)
    gamma, vega = dq * pdf / (spot * sigma * root), spot * dq * pdf * root
    vomma = vega * d1 * d2 / sigma
    carry = (r - q) / (sigma * root) - d2 / (2.0 * tau)
    return {
        "dividend_rho": -sign * spot * tau * dq * norm_cdf(sign * d1),
        "vanna": -dq * pdf * d2 / sigma,
        "vomma": vomma,
        "charm": sign * q * dq * norm_cdf(sign * d1) - dq * pdf * carry,
        "speed": -gamma / spot * (d1 / (sigma * root) + 1.0),
        "zomma": gamma * (d1 * d2 - 1.0) / sigma,
        "color": gamma * (q + 1.0 / (2.0 * tau) + d1 * carry),
        "veta": vega * (q + d1 * (r - q) / (sigma * root) - (1.0 + d1 * d2) / (2.0 * tau)),
        "ultima": -vega / sigma**2 * (d1 * d2 * (1.0 - d1 * d2) + d1 * d1 + d2 * d2),
        "dual_delta": -sign * dr * norm_cdf(sign * d2),
        "dual_gamma": dr * norm_pdf(d2) / (strike * sigma * root),
    }


def price_bounds(call, spot, strike, tau, r, q):
    """No-arbitrage bounds: lower (attained) and upper (not attained)."""
    forward, cash = spot * np.exp(-q * tau), strike * np.exp(-r * tau)
    lower = np.maximum(np.where(call, forward - cash, cash - forward), 0.0)
    return lower, np.where(call, forward, cash)


def bisect(call, spot, strike, tau, r, q, observed, cdf=norm_cdf):
    """The middle after 80 halvings of the bracket towards the price."""
    low, high = np.full(observed.shape, LOW_VOL), np.full(observed.shape, HIGH_VOL)
    with np.errstate(all="ignore"):
        for _ in range(BISECTIONS):
            middle = (low + high) / 2.0
            below = price(call, spot, strike, tau, r, q, middle, cdf) < observed
            low, high = np.where(below, middle, low), np.where(below, high, middle)
    return (low + high) / 2.0


def implied_volatility(call, spot, strike, tau, r, q, observed) -> tuple[np.ndarray, np.ndarray]:
    """(status, root) by exactly 80 bisections on [1e-6, 5], no early stop.

    The root is NaN unless the status is OK.
    """
    call = np.asarray(call, bool)
    args = [np.asarray(x, np.float64) for x in (spot, strike, tau, r, q)]
    observed = np.asarray(observed, np.float64)
    with np.errstate(all="ignore"):
        finite = np.isfinite(observed) & np.logical_and.reduce([np.isfinite(x) for x in args])
        valid = finite & (args[0] > 0) & (args[1] > 0) & (args[2] > 0)
        lower, upper = price_bounds(call, *args)
        valid &= np.isfinite(lower) & np.isfinite(upper)
        inside = valid & (observed >= lower) & (observed < upper)
        full = lambda v: np.full(observed.shape, v)
        p_low, p_high = price(call, *args, full(LOW_VOL)), price(call, *args, full(HIGH_VOL))
        solvable = inside & (p_low < p_high) & (observed >= p_low) & (observed <= p_high)
        status = np.where(~valid, INVALID, np.where(~inside, OUT_OF_BOUNDS, np.where(~solvable, NO_BRACKET, OK))).astype(object)
        root = full(np.nan)
        if solvable.any():
            root[solvable] = bisect(call[solvable], *(x[solvable] for x in args), observed[solvable])
    return status, root
