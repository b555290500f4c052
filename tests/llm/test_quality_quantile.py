import math

from tideline.llm import quality


def test_quantile_of_counted_steps():
    assert quality.low_quantile({}) == -math.inf
    assert quality.low_quantile({-3: 1, 5: 998}) == -3 * quality.GRID
    assert quality.low_quantile({-3: 1, 5: 999, 9: 1000}) == 5 * quality.GRID
    assert quality.low_quantile({-9: 2, -3: 1, 5: 1997}) == -3 * quality.GRID
    assert quality.low_quantile({7: 1}) == 7 * quality.GRID
