import random

import builders
import pytest

from faultline.operators.queue import rank_queue
from faultline.operators.review import agreement, apply_reviews, final_state, replay, timeline


def reviews(spark, rows):
    full = [(at, *row, "2026-09-25 10:00:00") for at, row in enumerate(rows, start=1)]
    return spark.createDataFrame(
        full, "id bigint, run_id string, finding_id string, action string, new_level string, reviewer string, reviewed_at string"
    ).selectExpr("* except (reviewed_at)", "cast(reviewed_at as timestamp) as reviewed_at")


def test_running_agreement(spark):
    log = reviews(spark, [("run", "a", "accepted", None, "r1"), ("run", "b", "overridden", "S1", "r1"), ("run", "c", "accepted", None, "r2")])
    rows = timeline(log).orderBy("id").collect()
    assert [r.n for r in rows] == [1, 2, 3] and [round(r.agreement_rate, 2) for r in rows] == [1.0, 0.5, 0.67]
    got = agreement(log).first()
    assert (got.total, got.accepted, got.overridden, got.marked_u) == (3, 2, 1, 0) and got.agreement_rate == pytest.approx(2 / 3)
    assert agreement(log.filter("false")).isEmpty()


def test_override_reranks_and_keeps_the_prior_level(spark):
    found = builders.findings(spark, [builders.finding("a/full", "S4"), builders.finding("b/full", "S2"), builders.finding("c/full", "S3")])
    log = reviews(spark, [("run", "a/full", "overridden", "S1", "alice"), ("run", "c/full", "accepted", None, "bob")])
    ranked = {r.finding_id: r for r in rank_queue(apply_reviews(found, log), None, "2026-09-25").collect()}
    a = ranked["a/full"]
    assert [f for f, r in sorted(ranked.items(), key=lambda i: i[1].queue_rank)] == ["c/full", "b/full", "a/full"]
    assert (a.unified.level, a.review.status, a.review.prior_level, a.review.reviewer) == ("S1", "overridden", "S4", "alice")
    assert a.action.code == "schedule" and a.review.reviewed_at == "2026-09-25T10:00:00+00:00"
    assert ranked["c/full"].review.prior_level == "S3" and ranked["b/full"].review.status == "pending"


def test_replay_and_state_equal_a_plain_loop(spark):
    rng = random.Random(5)
    names = ["hot"] * 30 + [f"f{at}" for at in range(10)]
    rows = []
    for _ in range(1500):
        action = rng.choice(["accepted", "overridden", "marked_u"])
        rows.append((f"run{rng.randrange(2)}", rng.choice(names), action, f"S{rng.randrange(5)}" if action == "overridden" else None, "r"))
    model = {(run, name): "S2" for run in ("run0", "run1") for name in set(names)}
    level, want, last = dict(model), [], {}
    for at, (run, name, action, new, _) in enumerate(rows, start=1):
        prior = level[run, name]
        level[run, name] = {"accepted": prior, "overridden": new, "marked_u": "U"}[action]
        want.append((at, prior, level[run, name]))
        last[run, name] = (action, prior)
    log = reviews(spark, rows)
    models = spark.createDataFrame([(*k, v) for k, v in model.items()], "run_id string, finding_id string, level string")
    got = [(r.id, r.prior_level, r.new_level) for r in replay(log, models).orderBy("id").collect()]
    assert got == want
    found = builders.findings(spark, [builders.finding(name, "S2", run_id=run) for run, name in model])
    state = {(r.run_id, r.finding_id): r for r in apply_reviews(found, log).collect()}
    for key, (action, prior) in last.items():
        row = state[key]
        assert (row.unified.level, row.review.status, row.review.prior_level) == (level[key], action, prior), key


def test_state_is_limited_before_the_shuffle(spark):
    log = reviews(spark, [("run", "a", "accepted", None, "r1")])
    assert final_state(log)._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 4
