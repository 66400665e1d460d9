import math

import pytest

from panelspark.functions.distributions import (
    incomplete_beta,
    normal_quantile,
    normal_two_sided,
    student_quantile,
    student_two_sided,
)


def test_student_quantiles():
    assert student_quantile(0.975, 29) == pytest.approx(2.045230, abs=1e-6)
    assert student_quantile(0.975, 7) == pytest.approx(2.364624, abs=1e-6)
    assert student_quantile(0.975, 1) == pytest.approx(12.706205, abs=1e-5)


def test_student_tail_is_consistent():
    for df in (1, 3, 29, 1000):
        for t in (0.0, 0.5, 2.0, 7.0):
            q = 1 - student_two_sided(t, df) / 2
            assert student_quantile(q, df) == pytest.approx(t, rel=1e-5, abs=1e-6)
    assert student_two_sided(1.0, 1) == pytest.approx(0.5, abs=1e-12)


def test_normal():
    assert normal_quantile(0.975) == pytest.approx(1.959963984540054, abs=1e-12)
    assert normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)


def test_incomplete_beta_edges():
    assert incomplete_beta(2, 3, 0) == 0 and incomplete_beta(2, 3, 1) == 1
    assert incomplete_beta(1, 1, 0.3) == pytest.approx(0.3)


# Published results of a region-clustered model.
PUBLISHED = [
    (25.277620979258533, 1.1147205662705284, 22.676195043057973, 7.696359074790117e-114,
     23.092808816542203, 27.462433141974863),
    (6.107015539419426, 3.1527091232446565, 1.9370691366332908, 0.052736892728581036,
     -0.07218079587095083, 12.286211874709803),
    (-0.18030574452125545, 0.04841067212074214, -3.7245040529813522, 0.00019569956842356074,
     -0.2751889183452873, -0.08542257069722363),
]


def test_published_normal_inference():
    critical = normal_quantile(0.975)
    for beta, se, t, p, low, high in PUBLISHED:
        assert beta / se == pytest.approx(t, rel=1e-12)
        assert normal_two_sided(beta / se) == pytest.approx(p, rel=1e-9)
        assert (beta - critical * se, beta + critical * se) == pytest.approx((low, high), rel=1e-12)


def test_published_cluster_correction():
    corrected, plain = 0.04841067212074214, 0.044189078784892026
    groups, n, k = 6, 250_519, 42
    factor = math.sqrt(groups / (groups - 1) * (n - 1) / (n - k))
    assert corrected / plain == pytest.approx(factor, rel=1e-9)


def test_published_adjusted_r_squared():
    cases = [
        (21510, 58, 0.8371607404699599, 0.8367280611023853),
        (21510, 63, 0.8397615249905434, 0.8392983000429709),
        (21480, 58, 0.6236643287689367, 0.6226629687997383),
        (239, 38, 0.9205822869459259, 0.905963105935972),
        (239, 42, 0.9232830145428738, 0.9073165353360607),
    ]
    for n, k, r2, adjusted in cases:
        assert 1 - (1 - r2) * (n - 1) / (n - k) == pytest.approx(adjusted, abs=1e-12)
