"""Separation of close pairs: particles at few places are many pairs, but few rows."""

import math

from driftfield.operators import paths


def test_pairs_of_copies_are_weighed_not_listed(spark):
    """400 particles start at 20 places and end at 40; one starts apart from all, one has no end, one is on its own place at both ends."""
    rows = []
    for i in range(400):
        p, e = i % 20, i % 40
        rows += [(i, 0, 0.0, 0.3 * p, 0.1 * (p % 3), 0.0), (i, 1, 2.0, 1.1 * e, 0.7 * (e % 4), 0.2 * e)]
    rows += [(400, 0, 0.0, 99.0, 0.0, 0.0), (400, 1, 2.0, 1.0, 1.0, 1.0), (401, 0, 0.0, 0.1, 0.1, 0.0), (401, 1, 2.0, None, None, None)]
    traj = spark.createDataFrame(rows, "particle_id bigint, t_idx bigint, t double, x double, y double, z double")
    e = paths.ends(traj)
    got = paths._separations(e, 1.0, rows=7).collect()
    starts = {r[0]: r[3:] for r in rows if r[1] == 0}
    ends = {r[0]: r[3:] for r in rows if r[1] == 1}
    logs = []
    for a in range(401):
        for b in range(401):
            d0, d1 = math.dist(starts[a], starts[b]), math.dist(ends[a], ends[b])
            if 0 < d0 < 1.0 and d1 > 0:
                logs.append(math.log(d1 / d0))
    assert sum(r["n"] for r in got) == len(logs)
    assert math.isclose(sum(r["s"] for r in got), sum(logs), rel_tol=1e-9)
    # 40 rows of copies, not 400, meet in groups: far fewer than pairs
    assert len(got) < 200
    rate = paths.mixing(traj.filter("particle_id < 401"), 1.0).first()["separation_rate"]
    assert math.isclose(rate, sum(logs) / len(logs) / 2.0, rel_tol=1e-9)
