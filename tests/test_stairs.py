"""Greedy chains by rounds, against the same chains taken one by one."""

import random

from emberway.operators import elements


def plain(rows):
    """(model, stair, n, z_min, z_max) of (model, tread, minx, maxx, miny, maxy, z), one chain after another."""
    out, bounds = [], elements.STAIR
    for model in sorted({r[0] for r in rows}):
        t = sorted((r for r in rows if r[0] == model), key=lambda r: (r[6], r[1]))
        used, n = set(), 0
        fits = lambda a, b: all(min(a[i + 1], b[i + 1]) - max(a[i], b[i]) >= bounds["overlap"] for i in (2, 4))
        for i in range(len(t)):
            if i in used:
                continue
            chain = [i]
            while True:
                used.add(chain[-1])
                a = t[chain[-1]]
                ways = [(t[j][6] - a[6], j) for j in range(len(t)) if j not in used and bounds["min_rise"] <= t[j][6] - a[6] <= bounds["max_rise"] and fits(a, t[j])]
                if not ways:
                    break
                chain.append(min(ways)[1])
            z = [t[j][6] for j in chain]
            rises = [b - a for a, b in zip(z, z[1:])]
            if len(chain) >= bounds["treads"] and z[-1] - z[0] >= bounds["total_rise"] and max(rises) - min(rises) <= bounds["spread"]:
                out.append((model, n, len(chain), z[0], z[-1]))
                n += 1
    return out


SCHEMA = "model long, tread string, minx double, maxx double, miny double, maxy double, z double"


def found(spark, rows):
    out = elements.stair_chains(spark.createDataFrame(rows, SCHEMA)).collect()
    return sorted((r["model"], r["stair"], r["n"], r["z_min"], r["z_max"]) for r in out)


def test_chains_by_rounds_are_those_taken_one_by_one(spark):
    """Flights that share treads, ties of height, steps missed by little, wide treads and heights below 0."""
    rng, rows = random.Random(8), []
    for model in range(14):
        for f in range(rng.randrange(2, 7)):
            rise, x, y, z = rng.choice([0.12, 0.15, 0.17, 0.2, 0.22]), rng.choice([0.0, 0.5, 3.0, 6.0]), rng.choice([0.0, 0.4, -2.0]), rng.choice([0.0, 0.05, -0.4])
            for i in range(rng.randrange(3, 10)):
                wide = rng.choice([1.0, 1.0, 1.0, 5.0, 0.2])
                rows.append((model, f"{f}-{i}", x, x + wide, y, y + 1.0, round(z + i * rise + rng.choice([0] * 14 + [0.01, 0.03]), 3)))
    rng.shuffle(rows)
    want = plain(rows)
    assert found(spark, rows) == want and len(want) > 5


def test_no_chains(spark):
    assert found(spark, []) == [] and found(spark, [(1, "a", 0.0, 1.0, 0.0, 1.0, 0.0)]) == []
