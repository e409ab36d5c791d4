"""Distractor mining against comparing all rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from optiq.operators import mining

SCHEMA = "id long, group int, vector array<float>"


def by_hand(rows, asked, k):
    out = {}
    good = [(i, g, v, np.array(v, dtype=float) / np.linalg.norm(v)) for i, g, v in rows
            if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v) and len(v) == 8]
    for i, g, v, u in good:
        if i in asked:
            for j, h, w, x in good:
                if j != i and h != g and w != v:
                    out.setdefault(i, {})[j] = max(out.get(i, {}).get(j, -2), round(float(u @ x), 9))
    return {i: sorted(((-s, j) for j, s in c.items()))[:k] for i, c in out.items()}


@pytest.mark.parametrize("exact", [True, False])
def test_mining_equals_brute_force(spark, exact, monkeypatch):
    monkeypatch.setattr(mining, "BLOCK", 40)   # lists are split, queries salted
    monkeypatch.setattr(mining, "BATCH", 5)
    monkeypatch.setattr(mining, "BATCHES", 1)
    rng = np.random.default_rng(1)
    hubs = rng.normal(size=(6, 8))
    rows = [(i, i % 4, np.float32(hubs[i % 6] + rng.normal(size=8) * .3).tolist()) for i in range(400)]
    rows += [(400 + i, i % 3, rows[0][2]) for i in range(200)]       # a third are copies
    rows += [(700, None, rows[5][2]), (701, None, [0.0] * 8), (None, 1, rows[1][2]), (702, 1, None),
             (703, 1, [math.nan] * 8), (704, 1, [1.0, 2.0]), (20, 0, rows[21][2])]
    df = spark.createDataFrame(rows, SCHEMA)
    asked = [i for i, _, _ in rows if i is not None and i % 20 == 0] + [700, 701, 9999]
    queries = spark.createDataFrame([(i,) for i in asked], "id long").withColumn("vector", F.lit(1))
    got = {}
    for r in mining.mine_distractors(df, queries, k=5, lists=12, sample=300, probes=3, exact=exact).collect():
        got.setdefault(r.id, []).append((r.rank, -r.similarity, r.candidate))
    want = by_hand(rows, set(asked), 5)
    if exact:
        assert {i: [c for _, *c in sorted(g)] for i, g in got.items()} == {i: [list(c) for c in w] for i, w in want.items()}
    else:
        hit = sum(len({c for *_, c in got.get(i, [])} & {c for _, c in w}) for i, w in want.items())
        assert hit >= 0.9 * sum(map(len, want.values()))


def test_mining_edges(spark):
    one = spark.createDataFrame([(1, 1, [1.0, 0.0])], SCHEMA)
    none = one.where("false")
    ids = one.select("id")
    assert mining.mine_distractors(none, ids).collect() == []
    assert mining.mine_distractors(one, ids).collect() == []
    assert mining.mine_distractors(one, ids.where("false")).collect() == []
    two = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 2, [-3.0, 0.0])], SCHEMA)
    assert [tuple(r) for r in mining.mine_distractors(two, ids).collect()] == [(1, 1, 2, -1.0)]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_index(spark, sf):
    """Probing a part of the lists only; the vectors have no clusters at all."""
    v = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").selectExpr("vec_id id", "label group", "embedding vector")
    q = v.where("id % 20 = 0").select("id")
    index = mining.build(v, lists=32)
    full = {(r.id, r.candidate) for r in mining.search(index, q, 9).collect()}
    part = {(r.id, r.candidate) for r in mining.search(index, q, 9, probes=20, exact=False).collect()}
    assert len(part & full) >= 0.9 * len(full)


def test_best_takes_equal_ones_from_the_left():
    rows = np.array([[1, 3, 3, 3, 2], [-np.inf, -np.inf, 5, -np.inf, -np.inf]])
    assert mining.best(rows, 2).tolist() == [[1, 2], [2, -1]]
    assert mining.best(rows, 7)[1].tolist() == [2] + [-1] * 6


def test_probed_batches_are_bounded():
    """A large batch of queries that probe all lists leaves as many batches of bounded size."""
    import pyarrow as pa
    rng = np.random.default_rng(1)
    u, lists, n = rng.normal(size=(1000, 4)), rng.normal(size=(32, 4)), 1000
    batch = pa.RecordBatch.from_arrays([*[pa.array(range(n))] * 3, pa.array([x.tobytes() for x in u], pa.binary()),
                                        pa.array([-2.0] * n)], names=["id", "own", "same", "u", "kth"])
    out = list(mining.all_probed([batch], lists, np.zeros(32), np.ones(32), 8, True))
    assert max(len(x) for x in out) <= mining.PROBED * 32 and sum(len(x) for x in out) == n * 24
    whole = mining.probed(batch, lists, np.zeros(32), np.ones(32), 8, True)
    assert pa.Table.from_batches(out).combine_chunks().equals(pa.Table.from_batches([whole]))


def test_the_query_asks_for_every_id(spark, tmp_path):
    from optiq.plans.catalog import QUERIES
    rng = np.random.default_rng(3)
    rows = [(i, i % 3, np.float32(rng.normal(size=8)).tolist()) for i in range(90)] + [(7, 2, [1.0] * 8)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for r in QUERIES["mine_distractors"](spark, str(tmp_path)).collect():
        got.setdefault(r["item"], []).append((r["rank"], r.candidate))
    want = by_hand(rows, set(range(90)), 9)
    assert {i: [c for _, c in sorted(g)] for i, g in got.items()} == {i: [c for _, c in w] for i, w in want.items()}


@pytest.mark.parametrize("spread", [0.0, 0.01])
def test_rows_of_one_id_leave_room_for_others(spark, spread):
    """An id with more rows than k in one block counts once, copies and near copies alike."""
    rng = np.random.default_rng(5)
    hub = rng.normal(size=8)
    near = lambda s: np.float32(hub + rng.normal(size=8) * s).tolist()
    rows = [(i, 1, near(0.3)) for i in range(40)] + [(100, 2, near(spread)) for _ in range(60)]
    rows += [(200 + i, 3, near(0.0)) for i in range(60)] + [(300, 4, near(0.1))]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in mining.mine_distractors(df, df.select("id"), k=5, lists=4, sample=100).collect():
        got.setdefault(r.id, []).append((r.rank, r.candidate))
    want = by_hand(rows, {i for i, *_ in rows}, 5)
    assert {i: [c for _, c in sorted(g)] for i, g in got.items()} == {i: [c for _, c in w] for i, w in want.items()}


def test_single_precision_does_not_decide(spark):
    """Candidates that differ by less than single precision tells apart, the best ones of largest id."""
    turned = lambda a: [math.cos(a), math.sin(a)]
    rows = [(0, 0, turned(0.0))] + [(i, 1, turned(1.0 - i * 4e-9)) for i in range(1, 101)]
    df = spark.createDataFrame(rows, "id long, group int, vector array<double>")
    got = mining.mine_distractors(df, df.where("id = 0").select("id"), k=3, lists=2, sample=50).collect()
    assert [r.candidate for r in sorted(got, key=lambda r: r["rank"])] == [100, 99, 98]


def test_a_query_is_sent_once_to_a_shelf():
    """Not once to each list: lists share shelves, whatever their number."""
    import pyarrow as pa
    rng = np.random.default_rng(1)
    unit = lambda n: (x := rng.normal(size=(n, 4))) / np.linalg.norm(x, axis=1, keepdims=True)
    size = np.full(256, 200)
    size[9] = 3 * mining.BLOCK
    shelf, parts = mining.Index(unit(256), None, np.ones(256), size).shelves()
    assert len(parts) < 20 and parts[shelf[9]] > 1 and (shelf == shelf[9]).sum() == 1
    for more in (1, 10, 1000):
        many, dealt = mining.Index(None, None, None, size * more).shelves()
        room = min(max(mining.BLOCK, size.sum() * more / mining.SHELVES), mining.LARGER * mining.BLOCK)
        assert max((size[many == j] * more).sum() / n for j, n in enumerate(dealt)) <= room
    batch = pa.RecordBatch.from_arrays([*[pa.array(range(100))] * 3, pa.array([x.tobytes() for x in unit(100)], pa.binary()),
                                        pa.array([-2.0] * 100)], names=["id", "own", "same", "u", "kth"])
    out = pa.Table.from_batches(mining.all_probed([batch], unit(256), np.ones(256), size, 8, True, shelf))
    assert len(set(zip(out.column("id").to_pylist(), out.column("shelf").to_pylist(), strict=True))) == len(out) <= 100 * len(parts)
    wants = np.unpackbits(np.frombuffer(b"".join(out.column("lists").to_pylist()), dtype=np.uint8).reshape(len(out), -1), axis=1)
    assert (wants.sum(axis=1) == 248).all()
