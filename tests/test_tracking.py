from itertools import permutations

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from boxtrail.operators import tracking as t
from boxtrail.operators.assign import greedy, least_cost, solve
from boxtrail.sources.detections import smooth


def best(cost):
    n, m = cost.shape
    if n > m:
        return best(cost.T)
    return min(sum(cost[i, p[i]] for i in range(n)) for p in permutations(range(m), n))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.randoms())
def test_least_cost_is_least(n, m, rnd):
    cost = np.array([[rnd.randint(0, 20) for _ in range(m)] for _ in range(n)], float)
    pairs = least_cost(cost)
    assert len(pairs) == min(n, m) and len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)
    assert sum(cost[a, b] for a, b in pairs) == best(cost)


def test_known_costs():
    assert solve(np.array([[1.0, 2, 3], [2, 1, 4], [3, 3, 1]]), 2.0) == [(0, 0), (1, 1), (2, 2)]
    iou = np.full((10, 10), 0.2) + 0.6 * np.eye(10)
    assert solve(1 - iou, 0.5, "auto") == [(i, i) for i in range(10)] == greedy(1 - iou, 0.5)
    assert solve(np.zeros((0, 3)), 1.0) == []


def test_three_of_four_tracks_match():
    tracks = np.array([[10, 10, 30, 30], [40, 10, 60, 30], [70, 10, 90, 30], [100, 10, 120, 30]], float)
    dets = tracks[:3] + 2
    assert solve(1 - t.overlaps(dets, tracks), 0.7) == [(0, 0), (1, 1), (2, 2)]


def test_filter_in_one_dimension():
    f = t.KalmanFilter(np.array([[1.0, 1], [0, 1]]), np.array([[1.0, 0]]), np.diag([0.01, 0.01]), np.array([[0.1]]))
    x, p = f.predict(np.array([[0.0, 1]]), np.diag([1000.0, 1000])[None])
    assert x[0, 0] == 1
    x, p, ok = f.update(x, p, np.array([[0.9]]))
    assert ok.all() and x[0, 0] == pytest.approx(0.900005, abs=1e-5)


def test_infinite_edges_make_no_track():
    k = t.Tracker(t.TrackerConfig(max_age=1))
    k.step([[0, 1.5, 12.6, np.inf, 0.9]])
    assert len(k) == 0 and len(k.step(np.zeros((0, 5)))["id"]) == 0


def test_score_gate_on_the_first_frame():
    k = t.Tracker(t.TrackerConfig(max_age=1, min_hits=3))
    assert k.step([[0, 1.5, 12.6, 25, 0.9], [-5.5, 18, 1, 20, 0.15]])["id"].tolist() == [1]


def test_ids_stay_and_rise():
    k = t.Tracker(t.TrackerConfig(max_age=3, return_all=True))
    a = np.array([[0, 0, 20, 20, 0.9], [50, 0, 70, 20, 0.9], [100, 0, 120, 20, 0.9]])
    assert k.step(a)["id"].tolist() == [1, 2, 3]
    assert k.step(a + [2, 1, 2, 1, 0])["id"].tolist() == [1, 2, 3]
    out = k.step(np.concatenate((a[:2] + [4, 2, 4, 2, 0], [[200, 0, 220, 20, 0.9]])))
    assert out["id"].tolist() == [1, 2, 3, 4] and out["since"].tolist() == [0, 0, 1, 0]
    k.remove(2)
    k.clear()
    assert len(k) == 0 and k.next_id == 1


def test_grid_and_dense_overlaps_agree():
    rng = np.random.default_rng(0)
    lo = rng.uniform(0, 900, (120, 2))
    b = np.concatenate((lo, lo + rng.uniform(5, 90, (120, 2))), 1)
    assert np.allclose(t.overlaps(b[:60], b[60:]), t.cell_overlaps(b[:60], b[60:], 100.0))


@pytest.mark.parametrize("kind", ["sort", "kalman", "two_pass"])
def test_one_track_for_an_object(spark, sf, kind):
    s = smooth(spark, sf)
    got = t.track(s, t.TrackerConfig(kind=kind, return_all=True)).toPandas()
    assert not got.duplicated(["stream_id", "frame_id", "track_id"]).any()
    both = s.toPandas().merge(got.dropna(subset=["det_id"]).astype({"det_id": "int64"}), on=["stream_id", "det_id"])
    assert (both.groupby(["stream_id", "gt_id"]).track_id.nunique() == 1).all()
    assert (both.groupby(["stream_id", "track_id"]).gt_id.nunique() == 1).all()


def test_batches_do_not_matter(spark, sf):
    s = smooth(spark, sf).where("stream_id = 0").orderBy("frame_id", "det_id").toPandas().assign(class_id=0)
    frames, rows = s.frame_id.to_numpy(), t.as_rows(s)
    whole = t.StreamRunner(t.TrackerConfig(return_all=True), 0)
    a = t.as_frame(whole.feed(frames, rows) + whole.finish())
    cut = t.StreamRunner(t.TrackerConfig(return_all=True), 0)
    b = t.as_frame([x for i in range(0, len(s), 7) for x in cut.feed(frames[i : i + 7], {c: v[i : i + 7] for c, v in rows.items()})] + cut.finish())
    pd.testing.assert_frame_equal(a, b)


def test_best_pairs_by_picture(spark, sf):
    from boxtrail.operators.assign import best_pairs
    from boxtrail.operators.pairs import pair_join
    from boxtrail.sources.detections import dense

    d = dense(spark, sf)
    pairs = pair_join(d.where("class_id = 0"), d.where("class_id = 1"))
    got = best_pairs(pairs, 0.1).toPandas()
    assert not got.duplicated(["stream_id", "frame_id", "l_id"]).any() and not got.duplicated(["stream_id", "frame_id", "r_id"]).any()
    for key, part in list(pairs.toPandas().groupby(["stream_id", "frame_id"]))[:12]:
        cost = (1 - part.pivot(index="l_id", columns="r_id", values="iou")).fillna(1.0).to_numpy()
        mine = got[(got.stream_id == key[0]) & (got.frame_id == key[1])]
        whole = np.where(cost <= 0.9, np.trunc(cost * 1000), 1_000_000)
        assert np.trunc((1 - mine.iou) * 1000).sum() + 1_000_000 * (min(cost.shape) - len(mine)) == pytest.approx(best(whole), abs=len(mine))


def test_stream_equals_batch(spark, sf):
    from boxtrail.streaming.live import run_tracks

    s = smooth(spark, sf).selectExpr("*", "gt_id as class_id")
    c = t.TrackerConfig(return_all=True)
    order = ["stream_id", "frame_id", "track_id"]
    a, b = (x.select(*order, "det_id").toPandas().sort_values(order).reset_index(drop=True) for x in (t.track(s, c), run_tracks(s, c)))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)
