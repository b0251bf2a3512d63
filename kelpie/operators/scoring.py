"""Failure scores and run decisions as plain expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the composite impact and of two failure heuristics, and thresholds of the decisions.
COMPOSITE = {"sim": 0.25, "in_dep": 0.20, "hashed": 0.15, "depth": 0.10, "pf": 0.20, "failure": 0.10}
HEURISTIC = {"sim": 0.40, "direct": 0.25, "failure": 0.20, "hashed": 0.15}
THREE = {"sim": 0.5, "impact": 0.3, "change": 0.2}
SIM, PF, IMPACT, GATE, MARGIN, DIRTY_GRID = 0.65, 0.30, 0.15, 0.35, 0.25, 0.05
ALONE = 0.5  # a decision by similarity alone


def least_one(c: Column, n: float) -> Column:
    return F.least(c / n, F.lit(1.0))


def composite(sim: Column, in_dep: Column, hashed: Column, pf: Column, depth: Column, failure: Column) -> Column:
    """Weighted impact of a candidate test; depth counts as 1 - depth / 6, at least 0."""
    near = F.greatest(F.lit(0.0), 1 - depth / 6)
    w = COMPOSITE
    return w["sim"] * sim + w["in_dep"] * in_dep + w["hashed"] * hashed + w["depth"] * near + w["pf"] * pf + w["failure"] * failure


def heuristic(sim: Column, direct: Column, failure: Column, hashed: Column) -> Column:
    w = HEURISTIC
    return w["sim"] * sim + w["direct"] * direct + w["failure"] * failure + w["hashed"] * hashed


def three_signal(sim: Column, impact: Column, lines: Column) -> Column:
    """A failure probability from similarity, impact and changed lines."""
    w = THREE
    return w["sim"] * sim + w["impact"] * impact + w["change"] * least_one(lines, 200.0)


def raised(threshold: float, dirty: Column | None) -> Column:
    """The threshold, raised on a dirty grid."""
    return F.lit(threshold) if dirty is None else F.when(dirty, F.lit(round(threshold + DIRTY_GRID, 4))).otherwise(F.lit(threshold))


def gate(pf: Column, threshold: float = GATE, margin: float = MARGIN, dirty: Column | None = None) -> Column:
    """Three ways by failure probability: run all, run, prune."""
    t = raised(threshold, dirty)
    return F.when(pf >= F.round(t + margin, 4), "RUN_ALL_TESTS").when(pf >= t, "RUN_TEST").otherwise("PRUNE_TEST")


def alone(sim: Column) -> Column:
    """A decision by similarity alone."""
    return F.when(sim >= ALONE, "RUN_TEST").otherwise("PRUNE_TEST")


def confident(action: Column, confidence: Column, least: float) -> Column:
    """The action, or a full run where its confidence is below ``least``; a missing confidence counts as 1."""
    return F.when(F.coalesce(confidence, F.lit(1.0)) < least, "FULL_RUN").otherwise(action)


def valid_threshold(x: float) -> float:
    """``x`` if it lies in (0, 1]; an error otherwise."""
    if not 0 < x <= 1:
        raise ValueError(f"a threshold lies above 0 and up to 1, not at {x}")
    return x


def boosted(pf: Column, dirty: Column, by: float = 0.1) -> Column:
    """A failure probability raised on a dirty grid, at most 1."""
    return F.when(dirty, F.least(pf + by, F.lit(1.0))).otherwise(pf)


def cascade(c: dict[str, Column], dirty: Column) -> Column:
    """The first rule that holds for a candidate, or PRUNED."""
    t = raised(SIM, dirty)
    yes = lambda x: F.coalesce(x, F.lit(False))
    return (
        F.when(yes(c["always"]), "ALWAYS_RUN")
        .when(yes(c["hashed"] & c["in_dep"] & (c["depth"] <= 1)), "DIRECT_DEPENDENCY")
        .when(yes(c["sim"] >= t), "HIGH_SIMILARITY")
        .when(yes(c["in_dep"] & (c["sim"] >= t / 2)), "TRANSITIVE_DEP")
        .when(yes(c["pf"] >= PF), "HIGH_PF")
        .when(yes(c["impact"] >= IMPACT), "COMPOSITE_IMPACT")
        .otherwise("PRUNED")
    )


def reason(rule: Column, c: dict[str, Column], dirty: Column) -> Column:
    """A sentence on the rule of ``cascade`` with the figures behind it."""
    t = raised(SIM, dirty)
    say = lambda text, *x: F.format_string(text, *[v.cast("double") for v in x])
    return (
        F.when(rule == "ALWAYS_RUN", F.lit("ALWAYS_RUN: historic failure rate above 20%"))
        .when(rule == "DIRECT_DEPENDENCY", say("DIRECT_DEPENDENCY: hash changed + direct import path (sim=%.3f)", c["sim"]))
        .when(rule == "HIGH_SIMILARITY", say("HIGH_SIMILARITY: sim=%.3f >= %.2f", c["sim"], t))
        .when(rule == "TRANSITIVE_DEP", say("TRANSITIVE_DEP: depth=%.0f, sim=%.3f", c["depth"], c["sim"]))
        .when(rule == "HIGH_PF", say("HIGH_PF: pf=%.3f >= %.2f", c["pf"], F.lit(PF)))
        .when(rule == "COMPOSITE_IMPACT", say("COMPOSITE_IMPACT: score=%.3f", c["impact"]))
        .when(rule == "PRUNED", F.concat(say("PRUNED: sim=%.3f < %.2f, pf=%.3f < %.2f, dep=", c["sim"], t, c["pf"], F.lit(PF)), F.when(c["in_dep"], "yes").otherwise("no"), say(", impact=%.3f", c["impact"])))
        .otherwise(rule)
    )
