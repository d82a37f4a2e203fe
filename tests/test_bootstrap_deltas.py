"""Both metrics of the paired bootstrap against brute force over the same draws, at the published number of resamples."""

import hashlib
import math
import random

from vietloom.operators import evaluate as E
from vietloom.plans import catalog

NAMES = ["gold_edits", "predicted_edits", "correct_edits", "lai_token_errors", "system_token_errors"]


def score(rows):
    g, p, c, lai, sys = (sum(r[k] for r in rows) for k in range(5))
    pr, re = c / p if p else 0.0, c / g if g else 0.0
    return {"f1": 2 * pr * re / (pr + re) if pr + re else 0.0, "ERR": (lai - sys) / lai if lai else 0.0}


def draws(row, rep, prime=2**31 - 1):
    """The draw written out: squarings modulo a prime, then the Poisson distribution turned around."""
    a = (row + (rep + 1) * 1664525) % prime
    b = (a * a + row) % prime
    c = (b * b + rep + 1) % prime
    u, k, p, total = c * 48271 % prime, 0, 1 / math.e, 1 / math.e
    while k < 10 and u >= int(total * prime):
        k += 1
        p /= k
        total += p
    return k


def number(i, seed):
    return int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:8], 16) % (2**31 - 1)


def test_brute_force(frame):
    r, n, seed = random.Random(4), 9, 7
    rows = []
    for i in range(n):
        gold, lai = r.randint(0, 5), r.randint(0, 6)
        for m in "abc":
            p = r.randint(0, 5)
            rows.append((f"i{i}", m, gold, p, r.randint(0, min(gold, p)), lai, r.randint(0, 6), 0))
    df = frame(rows, "id string, model string, " + ", ".join(f"{c} long" for c in [*NAMES, "exact"]))
    got = {x.metric: x for x in E.bootstrap(df, "a", "b", 2000, seed).collect()}
    by = {(i, m): x for i, m, *x in rows}
    deltas = {"f1": [], "ERR": []}
    for rep in range(2000):
        at = [k for k in range(n) for _ in range(draws(number(f"i{k}", seed), rep))]
        a, b = (score([by[f"i{k}", m] for k in at]) for m in "ab")
        for k in deltas:
            deltas[k].append(a[k] - b[k])
    for k, v in deltas.items():
        v.sort()
        assert got[k].replicates == 2000
        assert all(abs(x - y) < 1e-9 for x, y in zip((got[k]["mean"], got[k]["low"], got[k]["high"]), (sum(v) / 2000, v[49], v[1949]), strict=True))
    old = E.bootstrap(df.drop("gold_edits", "predicted_edits", "correct_edits"), "a", "b", 2000, seed).collect()
    assert [x.metric for x in old] == ["ERR"] and all(abs(old[0][c] - got["ERR"][c]) < 1e-9 for c in ("mean", "low", "high"))


def test_draws_are_poisson_and_unrelated():
    rows, reps = [number(f"i{i}", 1) for i in range(300)], range(200)
    w = [[draws(x, r) for x in rows] for r in reps]
    flat = [v for line in w for v in line]
    assert abs(sum(flat) / len(flat) - 1) < 0.02 and abs(sum((v - 1) ** 2 for v in flat) / len(flat) - 1) < 0.05
    sums = [sum(line) for line in w]  # of 300 unrelated draws: variance 300
    assert abs(sum((s - 300) ** 2 for s in sums) / len(sums) - 300) < 100
    near = [sum((a - 1) * (b - 1) for a, b in zip(w[i], w[i + 1], strict=True)) / 300 for i in range(199)]  # replicates side by side
    cols = list(zip(*w, strict=True))
    beside = [sum((a - 1) * (b - 1) for a, b in zip(cols[i], cols[i + 1], strict=True)) / 200 for i in range(299)]
    assert abs(sum(near) / len(near)) < 0.02 and abs(sum(beside) / len(beside)) < 0.02


def test_query_has_both_metrics(spark, tmp_path):
    spark.createDataFrame([(f"{i}", "test", "t k bik", "tôi không biết") for i in range(6)], "id string, split string, input_text string, target_text string").write.parquet(f"{tmp_path}/gold.parquet")
    got = catalog.queries()["bootstrap_ci_deltas"](spark, str(tmp_path)).collect()
    assert {r.metric: r.replicates for r in got} == {"f1": 2000, "ERR": 2000}
