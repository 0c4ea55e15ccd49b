"""Rules of thumb for a series of experiments: how many runs, in which stages, of what design."""

from __future__ import annotations

from dataclasses import dataclass, field

from millrace.operators.doe import estimate_runs


@dataclass(frozen=True)
class Stage:
    name: str
    design: str
    factors: int
    runs: int
    why: str


@dataclass
class Strategy:
    stages: list[Stage] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)

    @property
    def runs(self) -> int:
        return sum(s.runs for s in self.stages)


def allocate_budget(budget: int, shares: dict[str, float]) -> dict[str, int]:
    """Whole runs in proportion to shares, none lost: the largest remainders get what rounding leaves."""
    total = sum(shares.values())
    exact = {k: budget * v / total for k, v in shares.items()}
    out = {k: int(v) for k, v in exact.items()}
    for k in sorted(exact, key=lambda k: (out[k] - exact[k], k))[: budget - sum(out.values())]:
        out[k] += 1
    return out


def recommend(factors: int, budget: int | None = None, mixture: bool = False, curvature: bool = False, known_important: int | None = None) -> Strategy:
    """Screening where factors are many, a response surface of those that matter, then confirmation."""
    out = Strategy()
    if mixture:
        out.stages.append(Stage("mixture", "simplex centroid" if budget is None or budget >= 2**factors - 1 else "simplex lattice", factors, min(2**factors - 1, budget or 2**factors - 1), "the factors are shares of a whole"))
        return out
    keep = known_important if known_important is not None else min(factors, 3)
    usual = estimate_runs(factors)
    if factors > 4 and known_important is None:
        design = "definitive screening" if curvature and factors >= 5 else "Plackett-Burman"
        out.stages.append(Stage("screening", design, factors, 2 * (factors + factors % 2) + 1 if design.startswith("def") else usual["screening"], "few of many factors are expected to matter"))
    elif factors >= 2 and not curvature:
        out.stages.append(Stage("factorial", "full factorial" if factors <= 3 else "fractional factorial", factors, 2 ** min(factors, 3), "all interactions of few factors can be seen"))
    if curvature or factors > 4:
        k = max(2, keep)
        out.stages.append(Stage("response surface", "central composite" if k <= 4 else "Box-Behnken", k, 2**k + 2 * k + 4, "an optimum needs squared terms"))
    out.stages.append(Stage("confirmation", "replicates", keep, usual["confirmation"], "the prediction is to be met"))
    if budget is not None and out.runs > budget:
        out.notes.append(f"{out.runs} runs are more than the {budget} there are; by their shares the stages would have {allocate_budget(budget, {s.name: s.runs for s in out.stages})}")
    return out
