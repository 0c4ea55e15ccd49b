from hypothesis import given
from hypothesis import strategies as st

from millrace.operators import strategy


@given(st.integers(0, 500), st.lists(st.integers(1, 50), min_size=1, max_size=6))
def test_no_run_is_lost(budget, shares):
    out = strategy.allocate_budget(budget, {str(i): float(s) for i, s in enumerate(shares)})
    assert sum(out.values()) == budget and all(v >= 0 for v in out.values())


def test_recommendations():
    many = strategy.recommend(8)
    assert [s.name for s in many.stages] == ["screening", "response surface", "confirmation"]
    assert strategy.recommend(3).stages[0].design == "full factorial" and strategy.recommend(3, mixture=True).stages[0].name == "mixture"
    assert strategy.recommend(8, budget=10).notes
