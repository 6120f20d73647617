"""Vector index, peer tone, permutation test, bootstrap and covariances against brute force."""

import datetime as dt
import itertools
import secrets

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crosspanel.operators import joins as J
from crosspanel.operators import resampling as P
from crosspanel.operators import risk as K
from crosspanel.operators import vectors as V


def test_recall_on_the_embeddings(spark):
    """Queries are the rows whose id is divisible by 100; the number of probes is tuned on other rows."""
    base = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    queries, others = base.filter("id % 100 = 0"), base.filter("id % 100 = 50")
    index = V.build_index(base)
    assert index.rows.count() == base.count()
    probes = V.tuned_probes(index, J.nearest_vectors(others, base, 10), others, 0.93)
    got, want = ({(r.query, r.id) for r in x.select("query", "id").collect()} for x in (V.search(index, queries, 10, probes), J.nearest_vectors(queries, base, 10)))
    assert len(want) == 10 * queries.count() and len(got & want) >= 0.9 * len(want) and probes < len(index.centroids)


def test_nearest_vectors_are_dealt_to_tasks(spark):
    """Several blocks of queries and copies that tie; a null vector and one of length 0 come last.  No query meets all rows in a task."""
    rng = np.random.default_rng(1)
    v = [*rng.standard_normal((40, 4)).tolist(), *[[0.1, 0.7, 0.3, 0.9]] * 30, [0.0] * 4, None]
    base = spark.createDataFrame(list(enumerate(v)), "id long, embedding array<double>")
    got = J.nearest_vectors(base.filter("id % 10 = 0 or id = 71"), base, 40, block=3)
    assert "NestedLoop" not in got._jdf.queryExecution().toString()
    unit = [None if x is None or not any(x) else np.array(x) / np.sqrt(sum(y * y for y in x)) for x in v]
    cosine = lambda a, b: None if a is None or b is None else float(np.cumsum(a * b)[-1])
    for q in (0, 60, 70, 71):
        want = sorted(((i, cosine(unit[q], u)) for i, u in enumerate(unit) if i != q), key=lambda x: (x[1] is None, -round(x[1] or 0, 12), x[0]))[:40]
        rows = sorted((r["rank"], r.id, r.similarity) for r in got.filter(f"query = {q}").collect())
        assert [r[1] for r in rows] == [i for i, _ in want] and [r[2] is None for r in rows] == [x is None for _, x in want]


def test_all_cells_give_the_exact_result(spark):
    rng = np.random.default_rng(0)
    rows = [(i, f"g{i % 7}", rng.standard_normal(8).tolist()) for i in range(400)] + [(400 + i, "copy", [1.0] * 8) for i in range(300)] + [(800, "zero", [0.0] * 8), (801, "none", None)]
    base = spark.createDataFrame(rows, "id long, g string, embedding array<double>")
    queries = base.filter("id % 100 = 0 and id < 800")
    index = V.build_index(base, cells=10, group="g", shard=50)
    assert index.shards.agg(F.max("shards")).first()[0] > 1 and index.rows.count() == 700
    got = [(r.query, r.id, r["rank"]) for r in V.search(index, queries, 5, probes=10).collect()]
    want = [(r.query, r.id, r["rank"]) for r in J.nearest_vectors(queries, base.filter("id < 800"), 5).collect()]
    assert sorted(got) == sorted(want)
    apart = V.search(index, queries, 5, probes=10, group="g").join(base.select(F.col("id").alias("query"), "g"), "query").collect()
    assert len(apart) == 35 and all(r.group != r.g for r in apart)
    assert V.search(V.build_index(base.limit(0)), queries, 5).count() == 0


def test_cells_are_computed_once(spark, monkeypatch):
    """A task's rows fall to another cell each time it is computed: shards are those of the cells that the rows are listed in."""
    rng = np.random.default_rng(3)
    base = spark.createDataFrame([(i, rng.standard_normal(4).tolist()) for i in range(600)], "id long, embedding array<double>").repartition(4, "id")
    near = V._near

    def drifting(df, points, probes):
        def run(batches):
            cell = secrets.randbelow(10)
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([cell] * b.num_rows, pa.int32())], names=[*b.schema.names, "cell"])

        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "cell int"])
        return df.mapInArrow(run, schema) if probes == 1 else near(df, points, probes)

    monkeypatch.setattr(V, "_near", drifting)
    queries = base.filter("id % 100 = 0")
    index = V.build_index(base, cells=10, shard=60)
    got, again = ({(r.query, r.id, r["rank"]) for r in V.search(index, queries, 20, probes=10).collect()} for _ in range(2))
    want = {(r.query, r.id, r["rank"]) for r in J.nearest_vectors(queries, base, 20).collect()}
    assert got == want and again == want


def test_peer_tone_by_hand(spark):
    """Tones of a, b, c: 1, 0, -1.  a: .5 less the mean of b and c; d has no passage, so all three are peers; of e's two one is e."""
    hits = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long")
    passages = spark.createDataFrame([(1, "a", 3, 0), (2, "b", 1, 1), (3, "c", 0, 2), (4, "c", 0, 1), (9, "d", 9, 0)], "id long, group string, positive long, negative long")
    tones = spark.createDataFrame([("a", 0.5), ("d", 0.1), ("c", -0.4)], "group string, tone double")
    got = {r.group: (r.peers, round(r.gap, 6)) for r in V.peer_tone(hits, passages, tones).collect()}
    assert got == {"a": (2, 1.0), "d": (3, 0.3), "c": (2, -1.0)}
    few = V.peer_tone(hits.filter("id < 3"), passages, tones).collect()
    assert {r.group: (r.peers, r.gap) for r in few} == {"a": (1, 0.0), "d": (2, pytest.approx(-1.0)), "c": (2, pytest.approx(-1.0))}


def test_feistel_permutes(spark):
    for n in (1, 2, 3, 5, 100, 1_000, 4_097):
        for draw in range(3):
            assert sorted(P.permuted(np.arange(n), draw, n).tolist()) == list(range(n))
    first = np.array([P.permuted(np.arange(200), d, 200)[:3] for d in range(4_000)])
    assert abs(first.mean() - 99.5) < 3 and abs(np.corrcoef(first[:, 0], first[:, 1])[0, 1]) < 0.06 and len(set(first[:, 0].tolist())) == 200


def test_p_values_against_brute_force(spark):
    """200 rows: 10,000 shuffles by numpy, and the exact standard error of the bootstrap."""
    rng = np.random.default_rng(5)
    for shift in (0.0, 0.25):
        x = rng.standard_normal(200) + np.where(np.arange(200) < 80, shift, 0)
        df = spark.createDataFrame([(i, float(v), i < 80) for i, v in enumerate(x)] + [(999, None, True)], "id long, x double, a boolean").repartition(3)
        got = P.spread_test(df, "x", "a", ["id"], 4_000).first()
        spread = x[:80].mean() - x[80:].mean()
        shuffled = [(s := rng.permutation(x))[:80].mean() - s[80:].mean() for _ in range(10_000)]
        assert got.spread == pytest.approx(spread) and got.p_value == pytest.approx(np.mean(np.array(shuffled) >= spread), abs=0.03)
        error = (x[:80].var() / 80 + x[80:].var() / 120) ** 0.5
        assert got.bootstrap_mean == pytest.approx(spread, abs=0.02) and got.high - got.low == pytest.approx(3.92 * error, rel=0.08)
    plan = P.resampled_spreads(df, "x", "a", ["id"], 50)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Explode" not in plan
    again = P.resampled_spreads(df.repartition(1), "x", "a", ["id"], 50).orderBy("draw").collect()
    assert [r.permuted for r in again] == pytest.approx([r.permuted for r in P.resampled_spreads(df, "x", "a", ["id"], 50).orderBy("draw").collect()])


def test_exact_permutation_of_few_rows(spark):
    """Five rows, two of them first: the share of all ten splits."""
    x = [1.0, 5.0, 2.0, 4.0, 3.0]
    df = spark.createDataFrame([(i, v, i < 2) for i, v in enumerate(x)], "id long, x double, a boolean")
    sums = [sum(x[i] for i in c) for c in itertools.combinations(range(5), 2)]
    assert P.spread_test(df, "x", "a", ["id"], 5_000).first().p_value == pytest.approx(np.mean([s >= x[0] + x[1] for s in sums]), abs=0.03)


def test_covariances_by_blocks(spark):
    rng = np.random.default_rng(2)
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(50)]
    x = rng.standard_normal((50, 9))
    x[rng.random((50, 9)) < 0.2] = np.nan
    rows = [(d, f"t{j}", None if np.isnan(x[i, j]) else float(x[i, j])) for i, d in enumerate(days) for j in range(9)]
    df = spark.createDataFrame(rows, "date date, ticker string, r double")
    got = {(r.a, r.b): r.cov for r in K.covariances(df, "r", block=4, days=20).collect()}
    for i in range(9):
        for j in range(9):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            assert got[f"t{i}", f"t{j}"] == pytest.approx(np.cov(x[both, i], x[both, j])[0, 1])


def test_contributions_without_pairs(spark):
    rng = np.random.default_rng(3)
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(30)]
    df = spark.createDataFrame([(d, f"t{j}", float(rng.standard_normal())) for d in days for j in range(5)], "date date, ticker string, r double")
    weights = spark.createDataFrame([(f"t{j}", 0.1 * (j + 1)) for j in range(5)], "ticker string, weight double")
    names = ("marginal", "contribution", "share", "component_var")
    one, two = ({r.ticker: [r[c] for c in names] for r in x.collect()} for x in (K.series_contributions(weights, df, "r"), K.risk_contributions(weights, K.covariances(df, "r"))))
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k]) for k in one)
    incomplete = df.union(spark.createDataFrame([(dt.date(2025, 1, 1), "t0", 9.0)], df.schema))
    less = {r.ticker: [r[c] for c in names] for r in K.series_contributions(weights, incomplete, "r").collect()}
    assert all(less[k] == pytest.approx(one[k]) for k in one)
