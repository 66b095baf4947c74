import random
from collections import Counter

from pyspark.sql import functions as F

from quire.llm import join_maintenance, queries

COLS = "batch int, join_key long, part string, n long"


def joined(left, right):
    """Full outer join of two bags (key, part)."""
    out = Counter()
    for side, other, flip in ((left, right, False), (right, left, True)):
        for (k, p), n in side.items():
            met = [(q, m) for (j, q), m in other.items() if j == k and k is not None and m]
            if not flip:
                for q, m in met:
                    out[k, (p,), (q,)] += n * m
            if not met and n:
                out[(k, None, (p,)) if flip else (k, (p,), None)] += n
    return Counter({k: v for k, v in out.items() if v})


def plain(left, right, batch):
    state = lambda rows, t: Counter({k: n for k, n in sum_(r for r in rows if r[0] <= t).items() if n})
    before, after = (joined(state(left, t), state(right, t)) for t in (batch - 1, batch))
    return sorted([(batch, *k, after[k] - before[k], after[k]) for k in before | after if after[k] != before[k]], key=str)


def sum_(rows):
    out = Counter()
    for _, k, p, n in rows:
        out[k, p] += n
    return out


def test_changes_of_random_logs(spark):
    rng = random.Random(3)
    logs = []
    for side in range(2):
        rows = [(0, rng.choice([None, 1, 2, 3, 4, 5, 6, 7]), rng.choice(["a", "b", None]), rng.randint(1, 3)) for _ in range(25)]
        for t in (1, 2, 3):
            rows += [(t, k, p, -n) for _, k, p, n in rng.sample(rows[:25], 2)] if t < 3 or side else []
            rows += [(t, rng.choice([None, 2, 9, 10]), rng.choice(["a", "-", None]), 1) for _ in range(3 if t < 3 else 0)]
        logs.append(rows)
    frames = [spark.createDataFrame(x, COLS) for x in logs]
    for t in (1, 2, 3, 4):
        got = [(r.batch, r.join_key, r.left_part and tuple(r.left_part), r.right_part and tuple(r.right_part), r.weight, r.total) for r in join_maintenance.changes(*frames, t).collect()]
        assert sorted(got, key=str) == plain(*logs, t)


def test_only_affected_keys_are_joined(spark):
    state = spark.createDataFrame([(k, "x", 1) for k in (1, 2, None)], "join_key long, part string, n long")
    keys = join_maintenance.affected(state.filter("join_key = 2"), state.filter("join_key is null"))
    assert sorted([r.join_key for r in join_maintenance.touched(state, keys).collect()], key=str) == [2, None]


def test_a_log_by_rule(spark):
    rows = spark.createDataFrame([(1, None), (2, "q"), (2, "q"), (None, "z")], "doc_id long, lang string")
    present = F.col("doc_id") == 2
    log = join_maintenance.log_of(rows, [(F.coalesce(present, F.lit(False)), F.col("doc_id"), F.col("lang")), (F.lit(True), F.col("doc_id") + 1, F.col("lang")), (F.lit(True), F.col("doc_id") + 1, F.col("lang"))], "test-log")
    assert sorted([tuple(r) for r in log.collect()], key=str) == sorted([(0, 2, "q", 2), (1, 2, "q", -2), (1, 3, "q", 2), (1, 2, None, 1), (1, None, "z", 1)], key=str)


def test_empty_logs_and_hot_keys(spark):
    none = spark.createDataFrame([], COLS)
    hot = spark.createDataFrame([(0, 1, f"p{k}", 1000) for k in range(50)] + [(1, 1, "p0", -1)], COLS)
    assert join_maintenance.maintained(none, none, [1, 2]).collect() == []
    assert [(r.weight, r.total, r.right_part) for r in join_maintenance.changes(hot, none, 1).collect()] == [(-1, 999, None)]


def test_rows_of_the_query_have_no_broadcast(spark):
    df = queries.op11_join_maintenance(spark, "/root/testdata/sf0.001")
    assert df.count() > 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Python" not in plan and "SinglePartition" not in plan
