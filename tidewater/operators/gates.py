"""The correctness gates C1 to C8 and performance gates P1 to P9 of a model, measured on its own split.

A failed correctness gate voids a result whatever its performance; a missed performance gate is a finding. What cannot be
measured from what is given (one seed, no rate, no typology) is `not_run`, never a pass.
"""

from __future__ import annotations

import statistics
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.columns import schema_hash
from tidewater.operators import checks, history, metrics, model, splits
from tidewater.operators.ablation import at_once_map
from tidewater.session import cut

#: The gates' texts and bars.
CORRECTNESS = {
    "C1": "Leakage suite passes", "C2": "Shuffled-label PR-AUC within 2x base rate", "C3": "Random-score PR-AUC at base rate",
    "C4": "Split boundary timestamps strictly ordered and recorded", "C5": "Training and inference feature schemas identical",
    "C6": "One command reproduces the headline PR-AUC", "C7": "Same seed and data produce identical predictions",
    "C8": "No single feature above 50% of mean |SHAP|",
}
PERFORMANCE = {
    "P1": "E2 beats E1 by > 2 sigma", "P2": "E1 beats E0 by > 2 sigma", "P3": "E7 beats E2 by > 2 sigma (or inconclusive)",
    "P4": "Recall at 1% alert budget", "P5": "No typology at zero recall", "P6": "PR-AUC standard deviation across seeds",
    "P7": "No monotone decline across test sub-windows", "P8": "Feature extraction throughput", "P9": "Peak resident memory",
}
SHARE, RECALL, DEVIATION, RATE, MEMORY_GB = 0.50, 0.45, 0.02, 1000.0, 10.0
BUDGET = 0.01

SCHEMA = "gate string, kind string, description string, status string, detail string, measured double, threshold double"


@dataclass
class Gate:
    """One verdict; a gate of unknown outcome was not run."""

    gate: str
    passed: bool | None
    detail: str = ""
    measured: float | None = None
    threshold: float | None = None
    inconclusive: bool = False

    def row(self) -> tuple:
        kind = "correctness" if self.gate in CORRECTNESS else "performance"
        status = "inconclusive" if self.inconclusive else "not_run" if self.passed is None else "pass" if self.passed else "fail"
        text = (CORRECTNESS | PERFORMANCE)[self.gate]
        number = lambda x: None if x is None else float(x)
        return self.gate, kind, text, status, self.detail, number(self.measured), number(self.threshold)


def two_sigma(gate: str, better: list[float] | None, worse: list[float] | None, may_be_equal: bool = False) -> Gate:
    """Whether one arm's mean over seeds lies above another's by twice their mean deviation."""
    if not better or not worse or len(better) < 2:
        return Gate(gate, None, "too few seeds or no such arm")
    deviations = [statistics.stdev(x) for x in (better, worse) if len(x) > 1 and statistics.stdev(x) > 0]
    bar = 2 * statistics.mean(deviations) if deviations else 0.0
    delta = statistics.mean(better) - statistics.mean(worse)
    close = may_be_equal and abs(delta) <= bar
    return Gate(gate, delta > bar, f"delta {delta:+.4f} against 2 sigma {bar:.4f}", delta, bar, close)


def leakage(tx: DataFrame, until_us: int) -> int:
    """How many transfers up to an instant have another history once later transfers are there too; none, without leaks."""
    upto = tx.filter(F.col("t_us") <= until_us)
    alone, whole = history.behaviour(upto), history.behaviour(tx)
    digest = lambda df, name: df.select("row_pos", F.xxhash64(*history.BEHAVIOUR).alias(name))
    return digest(alone, "a").join(digest(whole, "b"), "row_pos", "left").filter("b IS NULL OR a <> b").count()


def evaluate_gates(
    tx: DataFrame, split: DataFrame, columns: list[str], fit: Callable[[DataFrame, DataFrame, int], model.Package], seeds: tuple[int, ...] = (7,),
    arms: dict[str, list[float]] | None = None, rows_per_second: float | None = None, peak_gb: float | None = None, headline: float | None = None,
) -> DataFrame:
    """(gate, kind, description, status, detail, measured, threshold, voided) for every gate.

    `split` has the features, labels and part of every transfer of `tx`; `fit(train, val, seed)` makes a package, and the
    first seed's is judged; fits run at the same time. `arms` holds the average precision of other arms by seed (E0, E1, E7), `headline` a published one.
    """
    part = lambda s: split.filter(F.col("split") == s)
    train, val, test = part("train"), part("val"), part("test")
    by_chance = lambda a, b: model.score(b, fit(a, val, seeds[0]))
    wanted = [*[lambda s=s: fit(train, val, s) for s in (*seeds, seeds[0])], lambda: checks.shuffled_label_test(train, test, by_chance).first()]
    *packages, refit, shuffled = at_once_map(tx.sparkSession, lambda f: f(), wanted)
    package = packages[0]
    scored = cut(model.score(test, package), "gate-scores")  # most gates read it
    main = metrics.evaluate(scored).first()
    precision = main.average_precision
    out: list[Gate] = []

    ends = {r.split: (r.lo, r.hi) for r in split.groupBy("split").agg(F.min("t_us").alias("lo"), F.max("t_us").alias("hi")).collect()}
    train_end = ends.get("train", (None, None))[1]
    changed = leakage(tx, train_end) if train_end is not None else None
    out.append(Gate("C1", None if changed is None else changed == 0, "transfers whose history changes with later ones", changed, 0))

    out.append(Gate("C2", shuffled.passed, "average precision from permuted labels", shuffled.average_precision, shuffled.ceiling))
    null = {r.name: r for r in checks.null_baselines(test).collect()}
    random_one = null.get("random")
    out.append(Gate("C3", random_one.passed if random_one else None, "average precision of a random score", random_one and random_one.average_precision, random_one and random_one.ceiling))
    have = [ends[s] for s in ("train", "val", "test") if s in ends]
    ordered = len(have) == 3 and have[0][1] < have[1][0] and have[1][1] < have[2][0]
    out.append(Gate("C4", ordered, "; ".join(f"{s} {a}..{b}" for s, (a, b) in sorted(ends.items()))))
    out.append(Gate("C5", package.schema_hash == schema_hash(columns), f"{package.schema_hash} against {schema_hash(columns)}"))
    out.append(Gate("C6", None if headline is None or precision is None else abs(headline - precision) < 1e-9, "average precision against the recorded one", precision, headline))
    again = model.score(test, refit).select("transaction_id", F.col("raw_score").alias("again"))
    differ = scored.join(again, "transaction_id").filter(F.abs(F.col("raw_score") - F.col("again")) > 0).count()
    out.append(Gate("C7", differ == 0, "predictions that differ between two fits", differ, 0))
    top = model.mean_absolute(model.contributions(test, package), columns).orderBy(F.desc("share"), "feature").first()
    share = top.share if top and top.share is not None else None
    out.append(Gate("C8", None if share is None else share < SHARE, f"top feature {top.feature}" if top else "", share, SHARE))

    own = [precision, *[metrics.evaluate(model.score(test, p)).first().average_precision for p in packages[1:]]]
    own, arms = [x for x in own if x is not None], arms or {}
    out.append(two_sigma("P1", own, arms.get("E1"), may_be_equal=True))
    out.append(two_sigma("P2", arms.get("E1"), arms.get("E0")))
    out.append(two_sigma("P3", arms.get("E7"), own, may_be_equal=True))
    point = metrics.budget_points(scored, (BUDGET,)).first()
    recall = point.recall if point else None
    out.append(Gate("P4", None if recall is None else recall >= RECALL, f"recall at {BUDGET:.0%}", recall, RECALL))
    flagged = metrics.flag_top(scored.join(tx.select("row_pos", "pattern_type"), "row_pos"), BUDGET) if "pattern_type" not in scored.columns else metrics.flag_top(scored, BUDGET)
    caught = metrics.recall_by(flagged, F.col("pattern_type"), "typology").collect()
    missed = sorted(r.value for r in caught if not r.caught)
    out.append(Gate("P5", None if not caught else not missed, f"zero recall: {', '.join(missed)}" if missed else "", len(missed) if caught else None, 0))
    deviation = statistics.stdev(own) if len(own) > 1 else None
    out.append(Gate("P6", None if deviation is None else deviation < DEVIATION, f"{len(own)} seeds", deviation, DEVIATION))
    decline = checks.monotone_decline(metrics.evaluate(splits.time_buckets(scored), by=["bucket"])).first()
    out.append(Gate("P7", decline.passed, f"{decline.windows} windows"))
    out.append(Gate("P8", None if rows_per_second is None else rows_per_second >= RATE, "transfers a second", rows_per_second, RATE))
    out.append(Gate("P9", None if peak_gb is None else peak_gb <= MEMORY_GB, "GB", peak_gb, MEMORY_GB))
    return checks.gate_report(tx.sparkSession.createDataFrame([g.row() for g in out], SCHEMA))


def markdown(report: DataFrame) -> str:
    """The report of seventeen gates as two tables, the correctness gates first."""
    rows = sorted(report.collect(), key=lambda r: r.gate)
    lines = [f"Result {'VOIDED: a correctness gate failed' if any(r.voided for r in rows) else 'stands: no correctness gate failed'}.", ""]
    for kind in ("correctness", "performance"):
        lines += [f"## {kind.title()} gates", "", "| Gate | Check | Status | Measured | Bar | Detail |", "|-|-|-|-|-|-|"]
        shown = lambda x: "-" if x is None else f"{x:.6g}"
        lines += [f"| {r.gate} | {r.description} | {r.status} | {shown(r.measured)} | {shown(r.threshold)} | {r.detail or '-'} |" for r in rows if r.kind == kind] + [""]
    return "\n".join(lines)
