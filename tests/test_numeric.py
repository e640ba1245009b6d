import datetime as dt
import math
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from voltide.functions import bsm, canonical, curves, rng, special
from voltide.operators import paths


def one(*xs):
    return [np.array([float(x)]) for x in xs]


def test_erfc_is_that_of_the_c_library():
    x = np.concatenate([np.linspace(-7, 26, 40_001), [0.0, 0.46875, 4.0, np.inf, -np.inf]])
    want = np.array([math.erfc(v) for v in x])
    big = want > 1e-300
    assert np.abs(special.erfc(x)[big] / want[big] - 1).max() < 2e-15
    assert np.isnan(special.erfc(np.array([np.nan]))).all()


def test_greeks_golden():
    g = bsm.greeks(np.array([True]), *one(100, 100, 1.0, 0.05, 0.02, 0.2))
    want = {"price": "9.22700551", "delta": "0.58685115", "gamma": "0.01895058", "vega_1volpt": "0.37901158", "theta_1calendar_day": "-0.01394334", "rho_1pct": "0.49458109"}
    assert {k: canonical.decimal_text(float(v[0])) for k, v in g.items()} == want


IV = [
    ("call", 120, 90, 180, 0.04, 0.015, 30.95764523, "0.20000000"), ("put", 120, 90, 180, 0.04, 0.015, 0.08409457, "0.20000000"),
    ("call", 100, 100, 7, 0.01, 0.02, 0.26667714, "0.05000000"), ("put", 100, 100, 7, 0.01, 0.02, 0.28584971, "0.05000000"),
    ("call", 80, 120, 730, -0.01, 0.03, 22.18505914, "0.80000000"), ("put", 80, 120, 730, -0.01, 0.03, 69.26805725, "0.80000000"),
    ("call", 100, 100, 365, 0.03, 0.01, 97.60471801, "4.90000000"), ("put", 100, 100, 365, 0.03, 0.01, 95.64428799, "4.90000000"),
    ("call", 100, 100, 365, 0.05, 0.02, 9.22700551, "0.20000000"), ("put", 100, 100, 365, 0.05, 0.02, 6.33008063, "0.20000000"),
]


@pytest.mark.parametrize("side,s,k,days,r,q,quote,vol", IV)
def test_implied_volatility_golden(side, s, k, days, r, q, quote, vol):
    status, root = bsm.implied_volatility(np.array([side == "call"]), *one(s, k, days / 365, r, q, quote))
    assert status[0] == bsm.OK and canonical.decimal_text(float(root[0])) == vol


@pytest.mark.parametrize("quote,status", [(0, bsm.OUT_OF_BOUNDS), (200, bsm.OUT_OF_BOUNDS), (97.75917633, bsm.NO_BRACKET), (float("nan"), bsm.INVALID)])
def test_implied_volatility_failures(quote, status):
    got, root = bsm.implied_volatility(np.array([True]), *one(100, 100, 1, 0.05, 0.02, quote))
    assert got[0] == status and np.isnan(root[0])


@given(st.floats(50, 150), st.floats(50, 150), st.floats(0.05, 3), st.floats(-0.02, 0.1), st.floats(0, 0.08), st.floats(0.05, 0.9))
def test_parity_and_differences(s, k, tau, r, q, vol):
    args = one(s, k, tau, r, q, vol)
    c, p = bsm.greeks(np.array([True]), *args), bsm.greeks(np.array([False]), *args)
    forward = s * math.exp(-q * tau) - k * math.exp(-r * tau)
    assert abs(c["price"][0] - p["price"][0] - forward) < 1e-11
    assert abs(c["delta"][0] - p["delta"][0] - math.exp(-q * tau)) < 1e-13
    h, more = 1e-4, bsm.more_greeks(np.array([True]), *args)
    f = lambda **d: bsm.greeks(np.array([True]), *(x + d.get(n, 0.0) for n, x in zip("sktrqv", args, strict=True)))
    slope = lambda what, n, step=h: (f(**{n: step})[what][0] - f(**{n: -step})[what][0]) / (2 * step)
    close = lambda a, b, tol=2e-4: math.isclose(a, b, rel_tol=tol, abs_tol=2e-4)
    assert close(c["delta"][0], slope("price", "s")) and close(c["vega_1volpt"][0], slope("price", "v") / 100)
    assert close(c["theta_1calendar_day"][0], -slope("price", "t") / 365) and close(c["rho_1pct"][0], slope("price", "r") / 100)
    assert close(more["vanna"][0], slope("delta", "v"), 1e-3) and close(more["dividend_rho"][0], slope("price", "q"))
    assert close(more["vomma"][0], slope("vega_1volpt", "v") * 100, 1e-2) and close(more["speed"][0], slope("gamma", "s"), 1e-3)
    assert close(more["dual_delta"][0], slope("price", "k")) and close(more["zomma"][0], slope("gamma", "v"), 1e-2)
    assert close(more["charm"][0], -slope("delta", "t"), 1e-2) and close(more["color"][0], slope("gamma", "t") * -1, 1e-2) or tau < 0.1


@given(st.decimals(-1000, 1000, places=10))
def test_quantise(x):
    got = canonical.quantise(x)
    assert abs(got - x) <= Decimal("5e-9") and not str(got).startswith("-0.00000000")
    assert canonical.DECIMAL8.fullmatch(canonical.decimal_text(x))


def test_column_text_equals_exact_text(spark):
    import random

    rng = random.Random(3)
    xs = [rng.uniform(-1, 1) * 10.0 ** rng.randrange(-12, 9) for _ in range(3000)] + [131072.552788015, 0.5e-8, 1.5e-8, -0.5e-8, -1e-20, 0.0, -0.0, 1e-300, 123456789.123456785, 2.5e-8]
    xs += [round(rng.uniform(0, 1e6), 9) for _ in range(2000)] + [None, math.nan, math.inf, -math.inf]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    got = {r.i: r.t for r in df.select("i", canonical.decimal_column(df.x).alias("t")).collect()}
    assert got == {i: canonical.decimal_text(x) for i, x in enumerate(xs)}


def test_canonical_forms():
    assert canonical.quantise_to_increment("101.25", "0.5") == Decimal("101.0") and canonical.quantise_to_increment("101.75", "0.5") == Decimal("102")
    assert canonical.canonical_json({"b": 1, "a": "é"}) == '{"a":"é","b":1}'
    with pytest.raises(ValueError):
        canonical.canonical_json({"a": float("nan")})
    assert canonical.tagged(0.1) == {"float64": "0.10000000000000001"} and canonical.tagged(Decimal("1.50")) == {"decimal": "1.50"}
    assert canonical.near_half("0.123456785") and not canonical.near_half("0.12345678")
    assert canonical.moneyness_token(Decimal("0.95")) == "M0p95"
    assert canonical.tagged(dt.datetime(2026, 1, 2, 3, 4, 5)) == {"datetime": "2026-01-02T03:04:05.000000"}
    assert canonical.tagged_json('{"a": [0.5, 1, null]}') == {"json": {"a": [{"float64": "0.5"}, 1, None]}}
    assert canonical.stable_id("x-", {"a": 1}) == canonical.stable_id("x-", {"a": 1}) != canonical.stable_id("x-", {"a": 2})


@pytest.mark.parametrize("base,sd,z,want", [(2, 1, math.log(1.25) + 0.5, 2), (2, 1, math.log(1.75) + 0.5, 4), (1, 2, 1e100, 2**63 - 1), (1, 2, -1e100, 0)])
def test_volume_law(base, sd, z, want):
    assert paths.volume_of(base, sd, z) == want


def test_curves():
    nodes = [(0.0, 1.0), (1.0, 3.0), (2.0, 2.0)]
    t = np.linspace(-0.5, 3, 700_001)
    v = np.array([curves.value(nodes, x) for x in t[::7000]])
    assert v[0] == 1.0 and v[-1] == 2.0
    dense = np.interp(t, [0, 1, 2], [1, 3, 2])
    assert curves.integral(nodes, -0.5, 3) == pytest.approx(np.trapezoid(dense, t), abs=1e-9)
    assert curves.integral_of_square(nodes, -0.5, 3) == pytest.approx(np.trapezoid(dense**2, t), abs=1e-6)
    m, var = curves.log_moments([(0, 0.05)], [(0, 0.2)], 0.0, 2.0)
    assert (m, var) == (pytest.approx(0.1 - 0.04), pytest.approx(0.08))
    assert curves.root_mean_square([(0, 0.2)], 0, 1) == pytest.approx(0.2)


def test_keyed_draws():
    assert rng.key_seed("s", 1, "a") == rng.key_seed("s", 1, "a") != rng.key_seed("s", 1, "b")
    assert (rng.gaussians(5, "k")[:3] == rng.gaussians(3, "k")).all()
    z = np.array([rng.gaussian("k", i) for i in range(4000)])
    assert abs(z.mean()) < 0.06 and abs(z.std() - 1) < 0.05
    assert all(0 < rng.uniform("u", i) < 1 for i in range(200))


def test_polar_normals_of_a_known_generator():
    """The Mersenne twister of seed 42 starts 1608637542, 3421126067; the polar
    form is computed here from the raw words."""
    words = np.random.MT19937()
    words._legacy_seeding(rng.key_seed("z"))
    assert np.random.RandomState(42).randint(0, 2**32, size=2, dtype=np.uint64).tolist() == [1608637542, 3421126067]
    want = []
    while len(want) < 21:
        x, y = (2 * (words.random_raw() + 0.5) / 2**32 - 1 for _ in range(2))
        r = x * x + y * y
        if 0 < r < 1:
            ratio = math.sqrt(-2 * math.log(r) / r)
            want += [x * ratio, y * ratio]
    assert rng.gaussians(21, "z") == pytest.approx(want[:21], abs=1e-15)
    assert rng.gaussian("z") == pytest.approx(want[0], abs=1e-15)


def test_legacy_range_and_volume():
    high, low = paths.legacy_range(Decimal(100), Decimal(102), 0.2, 1 / 365, -1.5, "0.01")
    wide = 0.2 * math.sqrt(1 / 365) * 1.5 * 0.25
    assert high == canonical.quantise_to_increment(Decimal(102) * Decimal(str(1 + wide)), "0.01")
    assert low == canonical.quantise_to_increment(Decimal(100) * Decimal(str(1 - wide)), "0.01")
    assert paths.legacy_range(Decimal("0.01"), Decimal("0.01"), 9.0, 1.0, 3.0, "0.01")[1] == Decimal("0.01")
    assert paths.legacy_volume(0.5) == 1_000_000


def test_draws_of_many_keys_are_those_of_each():
    keys = [("s", 7, "x", i) for i in range(700)]
    assert rng.first_gaussians(keys) == pytest.approx([rng.gaussian(*k) for k in keys], abs=1e-15)
    assert rng.first_gaussians(keys, pairs=1) == pytest.approx([rng.gaussian(*k) for k in keys], abs=1e-15)
    assert rng.first_uniforms(keys).tolist() == [rng.uniform(*k) for k in keys]
    assert rng.first_words(np.array([42], np.uint32), 200)[:, 0].tolist() == np.random.RandomState(42).randint(0, 2**32, size=200, dtype=np.uint64).tolist()


def test_draws_across_chunks_are_those_of_each_seed():
    seeds = np.random.default_rng(3).integers(0, 2**32, 2 * rng._AT_ONCE + 77, dtype=np.uint32)
    found = rng.gaussians_of(seeds)
    for i in [*range(0, len(seeds), 97), rng._AT_ONCE - 1, rng._AT_ONCE, len(seeds) - 1]:
        assert found[i] == rng._gaussians(1, int(seeds[i]))[0]
    assert (rng.gaussians_of(seeds, 1) == found).all() and (rng.gaussians_of(seeds, rng._MORE_PAIRS) == found).all()
    assert len(rng.gaussians_of(seeds[:0])) == 0 == len(rng.suffix_seeds([], ["1"]))
    heads, tails = ["x" * n + "é|" for n in range(130)], ["", "1", "12", "123456789" * 20]
    assert rng.suffix_seeds(heads, tails).tolist() == [rng.key_seed(h + t) for h in heads for t in tails]


def test_many_doubles_are_rounded_as_each():
    import random

    r = random.Random(7)
    xs = [r.uniform(-2000, 2000) for _ in range(3000)] + [r.randrange(-9999, 9999) / 200 for _ in range(3000)] + [10.0 ** r.randrange(-12, 14) * r.random() for _ in range(500)] + [0.0, -0.0, -0.004, 0.005, 0.015, 1e30, 5e-324]
    for step in ("0.01", "0.05", "3", "1e3", "0.00000001", "0.000000001"):
        assert list(map(str, canonical.quantise_all_to_increment(xs, step))) == [str(canonical.quantise_to_increment(x, step)) for x in xs]
    assert canonical.quantise_all_to_increment([], "0.01") == []
    for step in ("0", "-1"):
        with pytest.raises(ValueError):
            canonical.quantise_all_to_increment([1.0], step)


def test_keys_hashed_side_by_side_are_those_of_hashlib(monkeypatch):
    import hashlib

    from voltide.functions import sha256

    want = lambda heads, tails: [int.from_bytes(hashlib.sha256(h + t).digest()[:4], "big") for h in heads for t in tails]
    tails = [str(k).encode() for k in range(1, 65)]
    by_day = [f"{'x' * 50}|2026-01-{d:02d}|P{i}|".encode() for d in range(1, 6) for i in range(60, 140)]  # of 64 and 65 bytes at the least
    odd = [b"y" * n + bytes([n]) for n in range(200)]  # all lengths, some without room for a tail
    for heads in (by_day, by_day[:-1], odd, by_day * 2 + odd, [b"z" * 70], []):
        texts = [h.decode("latin1") for h in heads]
        assert rng.suffix_seeds([x for x in texts if x.isascii()], [t.decode() for t in tails]).tolist() == want([h for h in heads if h.isascii()], tails)
        for least, columns in ((1, 100), (1, 5000), (4096, 16_384)):
            monkeypatch.setattr(sha256, "LEAST", least)
            monkeypatch.setattr(sha256, "COLUMNS", columns)
            found = dict(pair for numbers, words in sha256.first_words(heads, tails) for pair in zip(numbers.tolist(), words.tolist(), strict=True))
            assert all(found[i] == want([heads[i]], tails) for i in found)
            assert least > 1 or len(found) == sum(len(h) % 64 + 2 <= sha256.ROOM for h in heads)
    # The keys of some days' bridges need no hashing one by one.
    names, made = [f"P{i}" for i in range(100)], []
    monkeypatch.setattr(rng.hashlib, "sha256", lambda x: made.append(x) or hashlib.new("sha256", x))
    paths.bridge_draws(paths.MarketSpec(), names, [f"2026-01-0{d}" for d in range(1, 6)])
    assert not made
