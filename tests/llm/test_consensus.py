from datetime import datetime, timedelta

import numpy as np
import pytest

from tidewright.llm import consensus

SCHEMA = "observation_id string, fish_instance_id string, finding_id string, reviewer_id string, review_status string, presence string, severity string, recorded_at timestamp, label int, weight string"


def table(spark, rows):
    return spark.createDataFrame([(f"o{i}", f, "x", r, s, p, v, None if d is None else datetime(2031, 1, 1) + timedelta(days=d), 9, "clash") for i, (f, r, s, p, v, d) in enumerate(rows)], SCHEMA)


def test_chi_squared_quantiles():
    for k, want in ((1, 0.000982), (2, 0.050636), (10, 3.246973), (50, 32.357364), (10_000, 9724.718)):
        assert consensus._chi2(0.025, k) == pytest.approx(want, rel=1e-3)


def settled(spark, rows):
    findings, _ = consensus.discover(table(spark, rows))
    return {r.fish_instance_id: (r.presence, r.severity, r.settled_by) for r in findings.collect()}


def test_rules(spark):
    rows = [
        ("a", "r1", "reviewed", "no", "none", 1), ("a", "r2", " Reviewed", "NO ", "none", 1), ("a", "r3", "ADJUDICATED", "Yes", "Severe ", 2), ("a", "r3", "adjudicated", "yes", "minor", 1),
        ("b", "r1", "pending", "yes", "severe", 9), ("b", "r1", "reviewed", "no", None, 1), ("b", "r2", "reviewed", "n", "none", 1),
        ("c", "r1", "pending", "y", "moderate", 1), ("d", "r1", "reviewed", "uncertain", "uncertain", 1), ("d", None, "reviewed", None, None, None),
        ("e", "r1", "reviewed", "yes", "unknown", 1), ("e", "r2", "reviewed", "yes", "minor", 1), ("e", "r2", "reviewed", "yes", "minor", 1), (None, "r1", "reviewed", "yes", "minor", 1),
    ]
    got = settled(spark, rows)
    assert got == {"a": ("yes", "severe", "adjudication"), "b": ("no", None, "consensus"), "c": ("yes", "moderate", "consensus"), "d": (None, None, None), "e": ("yes", "minor", "consensus")}


def test_empty(spark):
    assert settled(spark, []) == {}
    assert consensus.found(table(spark, [])).count() == 0


def test_better_than_the_majority(spark):
    """Three careful reviewers and six careless ones who err together."""
    rng = np.random.default_rng(4)
    labels = [("no", "none"), ("yes", "minor"), ("yes", "moderate"), ("yes", "severe")]
    rows, truth = [], {}
    for i in range(300):
        t = int(rng.integers(4))
        truth[f"f{i:03d}"] = t
        wrong = int(rng.integers(4))
        for r in rng.choice(9, size=5, replace=False):
            said = t if rng.random() < (0.95 if r < 3 else 0.45) else (wrong if r >= 3 else int(rng.integers(4)))
            rows.append((f"f{i:03d}", f"r{r}", "reviewed", *labels[said], 1))
    findings, reviewers = consensus.discover(table(spark, rows))
    got = {r.fish_instance_id: consensus.LABELS.index(r.severity) if r.severity else 0 for r in findings.collect()}
    votes = {f: np.bincount([labels.index(x[3:5]) for x in rows if x[0] == f], minlength=4).argmax() for f in truth}
    right = np.mean([got[f] == t for f, t in truth.items()])
    assert right > np.mean([votes[f] == t for f, t in truth.items()]) + 0.02 and right > 0.85
    weight = {r.reviewer_id: r.weight for r in reviewers.collect()}
    assert min(weight[f"r{i}"] for i in range(3)) > max(weight[f"r{i}"] for i in range(3, 9))
    assert findings.where("agreement < 0 or agreement > 1").count() == 0


def test_errors_are_to_adjudicated_labels(spark):
    """The crowd is wrong on every finding; only the one who disagreed with it is right. The adjudicator's own row has no labels."""
    rows = [(f"f{i}", r, "reviewed", *(("yes", "severe") if r == "right" else ("no", "none")), 1) for i in range(8) for r in ("right", "w1", "w2")]
    rows += [(f"f{i}", "judge", "adjudicated", "yes", "severe", 2) for i in range(8)]
    _, reviewers = consensus.discover(table(spark, rows))
    got = {r.reviewer_id: r for r in reviewers.collect()}
    assert {k: (r.n_labels, r.mean_error) for k, r in got.items()} == {"right": (8, 0.0), "w1": (8, 1.0), "w2": (8, 1.0), "judge": (0, None)}
    assert got["right"].weight > got["w1"].weight > got["judge"].weight == 0


def test_round_limit_is_told(spark, monkeypatch):
    """Where the rounds end too soon, the findings whose label still changed say so; others don't."""
    rows = [(f"f{i}", r, "reviewed", *(("yes", "severe") if i % 2 or r == "a" else ("no", "none")), 1) for i in range(6) for r in "abc"]
    rows += [("g", "a", "reviewed", "yes", "minor", 1), ("g", "b", "reviewed", "no", "none", 1)]
    findings, _ = consensus.discover(table(spark, rows))
    assert {r.settled_by for r in findings.collect()} == {"consensus"}
    monkeypatch.setattr(consensus, "MAX_ROUNDS", 2)
    findings, _ = consensus.discover(table(spark, rows))
    assert {r.settled_by for r in findings.collect()} <= {"consensus", "last round"} and findings.count() == 7
