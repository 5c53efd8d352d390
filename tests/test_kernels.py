import math

import numpy as np
import pytest

from lagsieve.functions import generators as G
from lagsieve.functions import kernels as K
from lagsieve.operators.innovation import RidgeBase, innovation_of
from lagsieve.plans import splits as S


def test_ridge_path_equals_the_normal_equations():
    rng = np.random.default_rng(7)
    X = rng.normal(size=(80, 4))
    X = np.column_stack([X, X[:, 0] + X[:, 1]])
    y = X @ rng.normal(size=5) + rng.normal(size=80)
    path = K.ridge_path(X, y, (0.0, 0.01, 0.3, 10.0))
    Xc, yc = X - X.mean(0), y - y.mean()
    for i, a in enumerate(path.alphas):
        coef = np.linalg.pinv(Xc) @ yc if a == 0 else np.linalg.solve(Xc.T @ Xc + a * np.eye(5), Xc.T @ yc)
        assert np.allclose(path.coef[i], coef, atol=1e-8) and abs(path.intercept[i] - (y.mean() - X.mean(0) @ coef)) < 1e-10
    assert abs(path.df[0] - 4) < 1e-9
    with pytest.raises(ValueError):
        path.predict(X, 0.5)
    for bad in ([], [-1.0], [1.0, 1.0]):
        with pytest.raises(ValueError):
            K.ridge_path(X, y, bad)


def test_gcv_alpha_is_nearly_the_best():
    rng = np.random.default_rng(11)
    beta = rng.normal(size=45) * (rng.random(45) < 0.3)
    X, V = rng.normal(size=(90, 45)), rng.normal(size=(120, 45))
    y, v = X @ beta + rng.normal(size=90), V @ beta + rng.normal(size=120)
    path = K.ridge_path(X, y, np.logspace(-4, 4, 25))
    errors = [float(((v - path.predict(V, a)) ** 2).mean()) for a in path.alphas]
    assert ((v - path.predict(V, path.best_gcv())) ** 2).mean() <= 1.10 * min(errors)
    assert K.choose_alpha(path, V, v) == path.alphas[int(np.argmin(errors))]
    with pytest.raises(ValueError):
        K.choose_alpha(path, V, v, "other")


def test_partial_fits_equal_joint_ones():
    rng = np.random.default_rng(23)
    base, more = rng.normal(size=(160, 4)), rng.normal(size=(160, 2))
    y = base @ rng.normal(size=4) + 0.5 * more[:, 0] + rng.normal(size=160)
    assert abs(K.incremental_r2(y, base, more) - K.incremental_r2_partial(y, base, more)) < 1e-10
    assert abs(K.incremental_r2(y, base, base @ rng.normal(size=(4, 4)))) < 1e-12


def test_lag_windows():
    z = np.arange(30.0)
    u = K.rows_of(6, 14, 3, 2)
    assert u.tolist() == list(range(6, 14))
    assert K.lagged(z, u, 3, 2)[0].tolist() == [2, 3, 4]
    assert K.rows_of(0, 8, 3, 2).tolist() == [4, 5, 6, 7]
    with pytest.raises(ValueError):
        K.rows_of(0, 4, 3, 2)
    assert K.feature_names(2, 0, True) == ["own[0]_lag_2", "own[0]_lag_1"]


def ramp(n, cuts):
    r = [S.Range(a, b) for a, b in zip(cuts, cuts[1:])]
    return S.Splits(S.Range(0, cuts[3]), r[1], S.Range(cuts[3], n), S.Range(0, cuts[3]), *r)


def test_the_base_sees_fit_rows_alone():
    t = np.arange(80.0)
    z = np.sin(t / 5) + 0.1 * t
    moved = z.copy()
    moved[55:70] += 100
    s = ramp(80, [8, 35, 55, 70])
    calls = []

    class Spy(RidgeBase):
        def fit(self, X, y):
            calls.append(len(y))
            return super().fit(X, y)

    a, b = Spy((0.1, 1.0)), Spy((0.1, 1.0))
    innovation_of(z, s, 4, 2, a)
    innovation_of(moved, s, 4, 2, b)
    assert calls == [27, 27] and a.alpha == b.alpha and (a.path.coef == b.path.coef).all()
    with pytest.raises(RuntimeError):
        RidgeBase((1.0,)).predict(np.ones((2, 2)))
    with pytest.raises(ValueError):
        RidgeBase((1.0,), "val_grid")


def source(n=512):
    rng = np.random.default_rng(123)
    x = G.ar1(rng, n, 0.7) + np.sin(2 * np.pi * np.arange(n) / 37)
    return x, np.roll(x, 3) + 0.1 * rng.normal(size=n)


@pytest.mark.parametrize("n", [512, 511])
def test_surrogates_keep_the_spectrum_and_lose_the_phase(n):
    x, other = source(n)
    s = K.surrogate(x, 0, 0, 5)
    assert np.allclose(np.abs(np.fft.rfft(s)), np.abs(np.fft.rfft(x)), atol=1e-8) and abs(s.mean() - x.mean()) < 1e-10
    wrap = lambda z: np.array([(z * np.roll(z, k)).mean() for k in range(20)])
    assert np.allclose(wrap(s), wrap(x), atol=1e-10)
    assert K.xcorr_absmax(s, other) < 0.7 * K.xcorr_absmax(x, other)
    assert (K.surrogate(x, 0, 0, 5) == s).all() and not (K.surrogate(x, 1, 0, 5) == s).all()
    assert (K.surrogate(x, 0, 0, 5, np.fft.rfft(x)) == s).all()


def test_constant_series_and_permutations():
    assert (K.phase_randomize(np.ones(9), 1) == 1).all()
    x, _ = source(64)
    assert sorted(K.row_permute(x, 3)) == sorted(x) and (K.row_permute(x, 3) == K.row_permute(x, 3)).all()
    parts = K.row_permute_design([x[:20, None], x[20:40, None], x[40:, None]], 0, 1)
    assert [len(p) for p in parts] == [20, 20, 24] and sorted(np.vstack(parts)[:, 0]) == sorted(x)


def test_tails():
    assert abs(K.incomplete_beta(2, 3, 0.4) - 0.5248) < 1e-12
    assert abs(K.spearman_p(0.5, 20) - 0.024769558804109693) < 1e-9 and math.isnan(K.spearman_p(0.5, 2))
    d, p = K.ks_uniform((np.arange(100) + 0.5) / 100)
    assert abs(d - 0.005) < 1e-12 and p > 0.999
    assert K.ks_uniform(np.full(100, 0.01))[1] < 1e-6
    assert K.spearman([1, 2, 2, 4], [1, 3, 3, 9]) == pytest.approx(1.0) and math.isnan(K.spearman([1, 2], [1, 2]))


def test_coherence():
    x, other = source()
    same = K.welch_coherence(x, x, 128)
    assert np.allclose(same[np.isfinite(same)], 1)
    assert K.coherence_features(x, other)[0] > 2 * K.coherence_features(x, np.random.default_rng(0).normal(size=512))[0]


def test_r2():
    y = np.array([1.0, 2, 3])
    assert K.r2_out_of_sample(y, y) == 1 and K.r2_out_of_sample(y, y * 0, baseline=0.0) == 0
    assert math.isnan(K.residual_r2(np.zeros(3), y))
    with pytest.raises(ValueError):
        K.r2_out_of_sample(np.ones(3), y)
