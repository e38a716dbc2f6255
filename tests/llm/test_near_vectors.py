import numpy as np
from pyspark.sql import functions as F

from rowlore.llm import near_vectors as nv

ROWS = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=0.9):
    good = {}
    for k, (i, v) in enumerate(rows):
        ok = i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        if ok:
            wide = np.array(v, np.float32).astype(float)
            good[k] = wide / np.linalg.norm(wide)
    links = {k: [m for m in good if m != k and len(good[m]) == len(good[k]) and good[m] @ good[k] >= cosine] for k in good}
    out = {}
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for m in links.get(todo.pop(), []):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        ids = [rows[m][0] for m in seen if rows[m][0] is not None]
        out[k] = (len(links.get(k, [])), min(ids) if ids else None)
    return out


def vectors(n=700, width=24):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, width))
    rows = []
    for i in range(n):
        base = centres[rng.integers(12)] if i % 3 == 0 else rng.normal(size=width)
        spread = rng.choice([0.05, 0.2, 0.3])
        rows.append(((i * 7) % 10007, (base + spread * rng.normal(size=width) * (i % 3 == 0)).astype(np.float32).tolist()))
    same = rows[5][1]
    rows += [(20000 + i, same) for i in range(120)] + [(20001, same), (None, same)]
    rows += [(30000, None), (30001, []), (30002, [0.0] * width), (30003, [float("nan")] + [1.0] * (width - 1)), (30004, [float("inf")] * width)]
    rows += [(30005, [None] + [1.0] * (width - 1)), (30006, [1.0, 2.0]), (30007, [2.0, 4.0]), (30008, [x * 3 for x in same])]
    return rows


def test_equals_brute_force(spark, monkeypatch):
    rows = vectors()
    df = spark.createDataFrame([(i, v, k) for k, (i, v) in enumerate(rows)], ROWS).repartition(5)
    want = brute(rows)
    assert sum(n > 3 for n, _ in want.values()) > 200
    for block in (1024, 16):
        monkeypatch.setattr(nv, "BLOCK", block)
        monkeypatch.setattr(nv, "BUCKET", 40)
        tagged = df.withColumnRenamed("label", "row")
        got = {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in nv.near_vectors(tagged).collect()}
        assert got == {(rows[k][0], n, c, rows[k][0] is None or c == rows[k][0]) for k, (n, c) in want.items()}
    assert nv.near_vectors(df).count() == len(rows)
    assert nv.near_vectors(df.limit(0)).count() == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1)], ROWS).withColumn("node", F.lit(1)).withColumn("weight", F.lit("x"))
    assert sorted(tuple(r) for r in nv.near_vectors(df).collect()) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_recall_at_the_bound():
    """Pairs with a cosine of just 0.9: nearly all share a table, and no estimate rules one out."""
    rng = np.random.default_rng(8)
    n, width = 4000, 64
    a = nv.units(rng.normal(size=(n, width)))
    b = rng.normal(size=(n, width))
    b = nv.units(b - (a * b).sum(axis=1, keepdims=True) * a)
    b = nv.units(0.9001 * a + np.sqrt(1 - 0.9001**2) * b)
    tables = nv.Tables.fitting(50_000_000)
    met = (tables.keys(a) == tables.keys(b)).any(axis=1)
    assert met.mean() >= 0.99
    found = 0
    for i in range(0, n, 500):
        x, y = nv.close_pairs(nv.Codes.of(a[i : i + 500]), nv.Codes.of(b[i : i + 500]), 0.9, False)
        found += int((x == y).sum())
    assert found >= n - 1


def test_estimates_are_unbiased():
    rng = np.random.default_rng(2)
    a = nv.units(rng.normal(size=(2000, 64)))
    b = nv.units(a + 0.6 * rng.normal(size=a.shape) / 8)
    codes = nv.Codes.of(a)
    error = (codes.signs * nv.Codes.of(b).turned).sum(axis=1) / codes.factor - (a * b).sum(axis=1)
    assert abs(error.mean()) < 0.005
