import math

import numpy as np
import pytest

from millrace.functions import distributions as D


@pytest.mark.parametrize(
    "got, expected, tolerance",
    [
        (D.t_ppf(0.975, 10), 2.228138851986303, 1e-10),
        (D.t_ppf(0.05, 3), -2.353363434801823, 1e-9),
        (D.t_cdf(1.0, 1), 0.75, 1e-12),
        (D.f_ppf(0.95, 3, 20), 3.098391, 1e-5),
        (D.chi2_ppf(0.95, 5), 11.070497693516351, 1e-8),
        (D.norm_ppf(0.975), 1.959963984540054, 1e-12),
        (D.studentized_range_ppf(0.95, 3, 10), 3.877676, 2e-3),
        (D.studentized_range_ppf(0.95, 5, 20), 4.231857, 2e-3),
        (D.noncentral_f_cdf(3.0, 2, 10, 0.0), D.f_cdf(3.0, 2, 10), 1e-10),
        (1 - D.dunnett_cdf(2.0, 1, 15), D.t_two_sided(2.0, 15), 1e-4),
    ],
)
def test_known_values(got, expected, tolerance):
    assert abs(got - expected) < tolerance


def test_shapiro_published_example():
    # Shapiro and Wilk's weights of eleven men
    w, p = D.shapiro(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0]))
    assert abs(w - 0.79) < 0.01 and p < 0.01
    assert D.shapiro(np.random.default_rng(0).normal(size=200))[1] > 0.05 and math.isnan(D.shapiro(np.array([1.0]))[0])


def test_noncentral_f_agrees_with_draws():
    r = np.random.default_rng(1)
    x = ((r.normal(size=(200_000, 3)) + [2.0, 0, 0]) ** 2).sum(1) / 3 / (r.chisquare(12, 200_000) / 12)
    assert abs((x < 4).mean() - D.noncentral_f_cdf(4.0, 3, 12, 4.0)) < 0.005
