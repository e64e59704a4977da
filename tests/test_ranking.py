import random

from rolecast.operators import evaluate, ranking


def plain(rows, k):
    taken, left = [], sorted(rows, key=lambda r: r[2])
    while left and len(taken) < k:
        best, score = None, float("-inf")
        for r in left:
            n = lambda *i: sum(all(t[j] == r[j] for j in i) for t in taken)  # noqa: B023, E731
            s = r[1] - (0.05 if n(3, 4) else 0) - 0.04 * n(3) - (0.15 if n(3) >= 3 else 0) - 0.015 * n(4) - 0.08 * n(5) - r[6]
            if round(s, 9) > score:
                best, score = r, round(s, 9)
        taken.append(best)
        left.remove(best)
    return [r[0] for r in taken]


def test_diversify_against_a_loop(spark):
    rnd = random.Random(1)
    people = {p: [(j, round(rnd.uniform(0.3, 0.9), 2), j + 1, rnd.choice("AB"), rnd.choice("xyz"), rnd.choice("pq"), rnd.choice((0.0, 0.03))) for j in range(rnd.choice((3, 12, 25)))] for p in range(6)}
    rows = [(p, *r) for p, rs in people.items() for r in rs]
    df = spark.createDataFrame(rows, "resume_id long, job_id long, total double, rank long, company string, title string, template string, generic double")
    out = ranking.diversify(df, 8).collect()
    for p, rs in people.items():
        mine = [r["job_id"] for r in sorted((r for r in out if r["resume_id"] == p), key=lambda r: r["position"])]
        assert mine == plain(rs, 8) and len(mine) == len(set(mine)) == min(8, len(rs))


def test_spearman_bounds(spark):
    rows = [("same", i, i, i) for i in range(1, 6)] + [("turned", i, i, 6 - i) for i in range(1, 6)] + [("one", 1, 1, 1)]
    out = {r["resume_id"]: r["rho"] for r in evaluate.spearman(spark.createDataFrame(rows, "resume_id string, item int, rank_a int, rank_b int")).collect()}
    assert out == {"same": 1.0, "turned": -1.0, "one": 1.0}


def test_same_items(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "k int") for v in ([1, 2, 2], [1, 2, 3]))
    assert sorted(map(tuple, evaluate.same_items(a, b, ["k"]).collect())) == [(2, "left"), (3, "right")]
