import math

from holdfast.functions.stats import chi2_sf, normal_sf_two_sided, t_sf_two_sided


def test_tails_match_known_values():
    assert math.isclose(chi2_sf(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(chi2_sf(9.487729036781154, 4), 0.05, rel_tol=1e-9)
    assert math.isclose(t_sf_two_sided(2.2281388519649385, 10), 0.05, rel_tol=1e-8)
    assert math.isclose(normal_sf_two_sided(1.959963984540054), 0.05, rel_tol=1e-9)
