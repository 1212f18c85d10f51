import numpy as np
import pytest

from tilespark.operators import kernels as K

RNG = np.random.default_rng(5)


@pytest.mark.parametrize("n", [4, 8, 16, 32])
def test_dct_is_orthonormal(n):
    m = K.dct_matrix(n)
    assert np.allclose(m @ m.T, np.eye(n))


def test_zigzag_is_a_permutation_and_starts_right():
    assert sorted(K.zigzag(8)) == list(range(64))
    assert K.zigzag(8)[:6] == (0, 1, 8, 16, 9, 2)


def test_quantised_error_is_bounded():
    t = RNG.normal(0, 0.1, (20, 64))
    back = K.dct_restore(K.dct_quantise(t, 0.05), 0.05)
    assert np.abs(t - back).max() < 4 * 0.05
    assert np.sqrt(((t - back) ** 2).mean()) < 0.05 / 2


def test_weights_run_from_one():
    w = K.weights(8, 0.5).reshape(8, 8)
    assert w[0, 0] == 1 and w[7, 7] == 1.5
    assert K.weights(1, 0.5)[0] == 1


def test_bernstein_sums_to_one_and_ramps_are_exact():
    assert np.allclose(K.bernstein(8).sum(axis=1), 1)
    y, x = np.mgrid[0:16, 0:16] / 15
    t = (0.2 + 0.3 * x + 0.4 * y).reshape(1, -1)
    assert np.allclose(K.bicubic_eval(K.bicubic_fit(t), 16), t)


def test_poisson_inverts_gradients():
    t = RNG.random((5, 64))
    assert np.allclose(K.poisson(*K.forward(t), t.mean(axis=1)), t)


def test_divergence_of_a_constant_is_zero():
    assert not K.divergence(*K.forward(np.ones((2, 64)))).any()


def test_blur_keeps_constants_and_means():
    assert np.allclose(K.blur(np.full((1, 64), 0.3), 1.5), 0.3)
    t = RNG.random((3, 64))
    assert np.allclose(K.blur(t, 1.0).mean(axis=1), t.mean(axis=1))


def test_retinex_multiplies_back():
    t = RNG.random((4, 64)) * 0.5 + 0.2
    albedo, light = K.retinex(t)
    inside = albedo < 1
    assert np.allclose((albedo * light)[inside], t[inside])


def test_ssim():
    t = RNG.random((4, 64))
    assert np.allclose(K.ssim(t, t), 1)
    assert (K.ssim(t, 1 - t) < 0.5).all()


def test_two_buckets_recover_a_step():
    m = K.half_planes(8)
    assert len(m) == 18
    t = np.where(m[7] > 0, 0.8, 0.1)[None, :]
    model, mse, c0, c1 = K.two_bucket_fit(t)
    assert mse[0] < 1e-12 and np.allclose([c0[0], c1[0]], [0.1, 0.8])


def test_median_cut_recovers_few_colours():
    colours = RNG.random((5, 3))
    points = colours[RNG.integers(0, 5, 200)]
    palette, labels = K.median_cut(points, 16)
    assert len(palette) == 5 and np.allclose(palette[labels], points)
    palette, labels = K.median_cut(RNG.random((500, 3)), 8)
    assert len(palette) == 8 and set(labels) == set(range(8))


def test_median_cut_of_one_point():
    palette, labels = K.median_cut(np.array([[0.1, 0.2, 0.3]]), 4)
    assert len(palette) == 1 and labels.tolist() == [0]
