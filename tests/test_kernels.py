"""Kernels against closed forms and simulated truth."""

import numpy as np
import pytest

from cellspan.functions import numeric as N


def test_t_tail():
    assert N.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-3)
    assert N.t_two_sided(0, 5) == pytest.approx(1)


def test_savgol_keeps_parabola():
    x = np.arange(30.0)
    assert np.allclose(N.savgol(x**2 - 3 * x, 9, 2), x**2 - 3 * x)
