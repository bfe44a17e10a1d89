import numpy as np
import pytest

from veldra.llm import embeddings


def brute(rows):
    unit = lambda v: np.array(v, float) / max(abs(x) for x in v)
    good = {i: (unit(v), y) for i, v, y in rows if i is not None and y is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(good)
    links = {i: set() for i in ids}
    for a in ids:
        for b in ids:
            (x, p), (y, q) = good[a], good[b]
            if a != b and p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                links[a].add(b)
    root = {}
    for i in ids:
        if i not in root:
            todo, seen = [i], {i}
            while todo:
                for j in links[todo.pop()] - seen:
                    seen.add(j)
                    todo.append(j)
            root |= {j: min(seen) for j in seen}
    return {i: (len(links.get(i, ())), root.get(i, i)) for i, _, _ in rows}


def check(spark, rows, label="int"):
    got = embeddings.near(spark.createDataFrame([(*r, "x") for r in rows], f"vec_id long, embedding array<float>, label {label}, component_id string")).collect()
    assert len(got) == len(rows)
    return {r.vec_id: (r.n_links, r.component_id) for r in got}


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(40):
        x = rng.normal(size=32)
        for _ in range(rng.integers(1, 12)):
            rows.append((len(rows), (x + rng.normal(size=32) * rng.choice([0, 0.05, 0.12])).astype("f4").tolist(), int(rng.integers(0, 2))))
    rows += [(len(rows) + k, rng.normal(size=32).astype("f4").tolist(), 0) for k in range(200)]
    got, want = check(spark, rows), brute(rows)
    found, true = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
    assert true > 200 and 0.98 * true <= found <= true
    assert np.mean([got[i][1] == want[i][1] for i in want]) > 0.98


def test_a_large_group_is_split_and_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "MOST_BLOCK", 64)
    rng = np.random.default_rng(4)
    x = rng.normal(size=16)
    rows = [(i, (x + rng.normal(size=16) * 0.03).astype("f4").tolist(), 1) for i in range(400)] + [(400 + i, x.astype("f4").tolist(), 1) for i in range(50)]
    rows += [(1000 + i, rng.normal(size=16).astype("f4").tolist(), 1) for i in range(50)]
    got, want = check(spark, rows), brute(rows)
    assert sum(n for n, _ in got.values()) >= 0.98 * sum(n for n, _ in want.values())
    assert {got[i][1] for i in range(450)} == {0}


@pytest.mark.parametrize("label", ["int", "string"])
def test_odd_vectors(spark, label):
    y = (lambda v: None if v is None else str(v)) if label == "string" else (lambda v: v)
    rows = [(0, [1.0, 0.0], y(1)), (1, [2.0, 0.0], y(1)), (2, None, y(1)), (3, [0.0, 0.0], y(1)), (4, [float("nan"), 1.0], y(1)), (5, [1.0, None], y(1)), (6, [1.0, 0.0], None), (7, [1.0, 0.0], y(2)), (8, [], y(1)), (9, [1.0], y(1)), (10, [1.0, 0.0], y(1)), (11, [float("inf"), 0.0], y(1))]
    assert check(spark, rows, label) == brute(rows)
    assert check(spark, [], label) == {}


def test_repeated_rows_and_null_ids(spark):
    got = embeddings.near(spark.createDataFrame([(0, [1.0, 1.0], 1), (0, [1.0, 1.0], 1), (None, [1.0, 1.0], 1)], "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((str(r.vec_id), r.n_links, r.kept) for r in got) == [("0", 1, True), ("0", 1, True), ("None", 0, False)]


def test_only_one_dimension_of_pivots(spark):
    rows = [(i, [float(i + 1)], 0) for i in range(5)]
    assert check(spark, rows) == brute(rows)


@pytest.mark.parametrize("lengths", [1, 16])
def test_two_lengths_with_many_pivots(spark, monkeypatch, lengths):
    monkeypatch.setattr(embeddings, "LENGTHS", lengths)
    monkeypatch.setattr(embeddings, "MOST_BLOCK", 32)
    monkeypatch.setattr(embeddings, "LEAST_BLOCK", 8)
    rng = np.random.default_rng(8)
    rows = []
    for size, groups in ((32, 30), (16, 15)):
        for _ in range(groups):
            x = rng.normal(size=size)
            rows += [(len(rows) + k, (x + rng.normal(size=size) * 0.05).astype("f4").tolist(), 1) for k in range(5)]
    got, want = check(spark, rows), brute(rows)
    for size in (32, 16):
        ids = [i for i, v, _ in rows if len(v) == size]
        found, true = sum(got[i][0] for i in ids), sum(want[i][0] for i in ids)
        assert true > 200 and 0.98 * true <= found <= true


def test_components_of_any_magnitude(spark):
    rng = np.random.default_rng(11)
    rows = []
    for size in (1e200, 1e-200, 1e300):
        x = rng.normal(size=24)
        rows += [(len(rows) + k, ((x + rng.normal(size=24) * 0.01) * size).tolist(), 1) for k in range(6)]
    got = embeddings.near(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute(rows) and all(r.n_links >= 5 for r in got)


def test_rare_lengths_beside_many_pivots(spark):
    rng = np.random.default_rng(12)
    rows = [(i, rng.normal(size=16).astype("f4").tolist(), 1) for i in range(150)]
    x = rng.normal(size=8)
    rows += [(500 + i, (x + rng.normal(size=8) * 0.01).astype("f4").tolist(), 1) for i in range(6)]
    got, want = check(spark, rows), brute(rows)
    assert all(got[500 + i] == want[500 + i] == (5, 500) for i in range(6))


def test_one_id_with_different_vectors(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [0.0, 1.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.0], 2)]
    got = embeddings.near(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(0, 0, 0), (0, 1, 0), (1, 1, 0), (2, 0, 2)]


def test_pairs_of_a_list_against_a_loop():
    import pandas as pd

    rng = np.random.default_rng(13)
    n = 300
    frame = pd.DataFrame({"label": 1, "dim": 8, "key": np.repeat([5, 6], n // 2), "mine": 0, "other": 0, "member": rng.random(n) < 0.5, "cid": np.arange(n), "m": 1, "near": 0})
    near = np.argsort(rng.random((n, 9)), axis=1)[:, : embeddings.PREFIX]
    frame["near"] = (near << (10 * np.arange(embeddings.PREFIX))).sum(axis=1) | embeddings.PREFIX << 60
    for chunk in (7, 1000):
        cut = [frame.iloc[i : i + chunk] for i in range(0, n, chunk)]
        got = set()
        for f in embeddings.blocks(iter(cut), 20):
            for x, y in embeddings.pairs(f):
                got |= {(int(f["cid"][a]), int(f["cid"][b])) for a, b in zip(x, y, strict=True)}
        want = set()
        for a in range(n):
            for b in range(n):
                if frame["member"][a] and not frame["member"][b] and frame["key"][a] == frame["key"][b] and len(set(near[a]) & set(near[b])) >= embeddings.SHARED:
                    if not set(near[b][:2]) <= set(near[a]) or a < b:
                        want.add((a, b))
        assert got == want
