"""Queries do the whole job: against SQL or brute force written apart from the plans."""

from __future__ import annotations

import dataclasses
import math

import numpy as np
import pytest

from compare import database, same_rows
from skein.operators import clusters, fit
from skein.plans import catalog, pipeline, reads

PLANS, SQL = catalog.queries(), catalog.oracle_sql()
R = np.random.default_rng(3)


@pytest.fixture(scope="module")
def con(sf):
    return database(sf)


# --- videos of the fits -----------------------------------------------------------------------


@pytest.mark.parametrize("name", ["vec_01_fit_clusters", "vec_17_sub_clusters"])
def test_points_are_grouped_by_the_video_of_their_comment(spark, sf, con, name):
    same_rows(PLANS[name](spark, sf).select("id", "video_id"), con, "SELECT e.vec_id AS id, c.video_id FROM embeddings e JOIN raw_comments c ON c.comment_id = e.vec_id")


@pytest.mark.parametrize("name", ["vec_03_adaptive_grid", "vec_04_k_means", "vec_05_silhouette", "vec_09_split_gate", "lbl_04_positions"])
def test_groups_are_videos(spark, sf, con, name):
    same_rows(PLANS[name](spark, sf).select("video_id").distinct(), con, "SELECT DISTINCT c.video_id FROM embeddings e JOIN raw_comments c ON c.comment_id = e.vec_id")


def test_noise_split_takes_the_noise_of_the_fit(spark, sf):
    noise = PLANS["vec_01_fit_clusters"](spark, sf).filter("is_noise").select("id")
    split = PLANS["vec_08_noise_split"](spark, sf).select("id")
    assert sorted(split.collect()) == sorted(noise.collect())


def test_large_groups_give_the_same_without_all_distances(monkeypatch):
    x = R.normal(size=(120, 8))
    whole = fit.density_clusters(x, 5, 2), fit.silhouette(x, np.arange(120) % 3)
    monkeypatch.setattr(fit, "_rows_at_once", lambda n: 7)
    part = fit.density_clusters(x, 5, 2), fit.silhouette(x, np.arange(120) % 3)
    assert (whole[0][0] == part[0][0]).all() and whole[1] == pytest.approx(part[1])


# --- caps of one video ------------------------------------------------------------------------

FIRST = "f AS (SELECT * FROM raw_comments c WHERE NOT EXISTS (SELECT 1 FROM raw_comments d WHERE d.video_id = c.video_id AND d.youtube_comment_id = c.youtube_comment_id AND d.comment_id < c.comment_id))"


@pytest.fixture(params=[(1500, 1400), (40, 30), (20, 60)])
def limits(request, monkeypatch):
    """Limits of a run, and others that the small test tables reach."""
    changed = dataclasses.replace(reads.S, max_comments=request.param[0], max_relevant=request.param[1])
    monkeypatch.setattr(reads, "S", changed)
    return request.param


def test_comments_are_capped_by_video(spark, sf, con, limits):
    sql = f"WITH {FIRST} SELECT comment_id, published_at FROM f QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY published_at DESC, comment_id) <= {limits[0]}"
    same_rows(PLANS["srt_04_capped_comments"](spark, sf), con, sql)


def test_samples_are_of_one_video(spark, sf, con, limits):
    most, relevant = limits
    sql = f"""WITH {FIRST}, r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY published_at DESC, comment_id) AS a, row_number() OVER (PARTITION BY video_id ORDER BY like_count DESC NULLS LAST, comment_id) AS b FROM f),
    u AS (SELECT video_id, comment_id, 0 AS s, a AS o FROM r WHERE a <= {most} UNION ALL SELECT video_id, comment_id, 1, b FROM r WHERE b <= {relevant} AND a > {most})
    SELECT comment_id FROM u QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY s, o) <= {most}"""
    same_rows(PLANS["src_05_hybrid_sample"](spark, sf), con, sql)


# --- filter, collapse and gate of the fit -----------------------------------------------------


def _around(*sizes, dims=24, spread=0.05):
    return np.vstack([np.eye(dims)[i] + spread * R.normal(size=(n, dims)) for i, n in enumerate(sizes)])


def _assigned(n, confidence=0.9, ambiguous=False):
    return fit.Assigned(np.zeros(n, int), np.full(n, confidence), np.full(n, ambiguous), np.zeros(n, bool))


def test_rows_far_from_all_clusters_are_removed():
    out = fit.cluster_rows(np.vstack([_around(20, 20), np.eye(24)[10:18]]))
    assert out["cluster_key"].iloc[:40].notna().all() and out["cluster_key"].iloc[40:].isna().all()


def test_quality_filter_takes_rows_and_then_small_clusters():
    x = fit.unit_rows(_around(10, 4))
    keys, f = np.array(["a"] * 10 + ["b"] * 4, object), _assigned(14)
    f.confidence[[0, 10, 11]] = 0.34
    fit.drop_low_quality(x, keys, f, fit.FitSettings())
    assert keys.tolist() == [None] + ["a"] * 9 + [None] * 4


def test_small_bad_clusters_collapse_and_incoherent_rest_goes():
    s, loose = fit.FitSettings(), np.eye(24)[:9]
    x = fit.unit_rows(np.vstack([_around(200), loose, np.tile(np.eye(24)[20], (5, 1))]))
    keys, f = np.array(["a"] * 200 + ["emerging_other"] * 9 + ["b"] * 5, object), _assigned(214)
    f.ambiguous[209:] = True
    fit.collapse_small(x, keys, f, s)
    assert keys.tolist() == ["a"] * 200 + [None] * 9 + ["emerging_other"] * 5
    keys = np.array(["a"] * 200 + ["b"] * 14, object)
    fit.collapse_small(x, keys, _assigned(214), s)
    assert (keys[200:] == "b").all()  # no small one


def test_large_split_goes_by_confidence_ambiguity_and_nearness_of_parts():
    s, at = fit.FitSettings(), np.arange(40)
    apart, groups = fit.unit_rows(_around(20, 20)), [np.arange(20), np.arange(20, 40)]
    assert fit.passes_large_gate(apart, at, groups, _assigned(40), s)
    near = fit.unit_rows(np.vstack([np.eye(24)[:1] + 0.7 * np.eye(24)[1:2], np.eye(24)[:1] - 0.7 * np.eye(24)[1:2]]).repeat(20, axis=0) + 0.01 * R.normal(size=(40, 24)))
    # coherent, sure and clear parents stay whole; the same parent splits where many of its rows are ambiguous
    assert not fit.passes_large_gate(near, at, groups, _assigned(40), s)
    assert fit.passes_large_gate(near, at, groups, _assigned(40, ambiguous=True), s)


# --- reviews ----------------------------------------------------------------------------------


@pytest.mark.parametrize("most", [300, 3])
def test_rows_are_reviewed_up_to_the_limit_and_flagged_beyond(spark, sf, con, monkeypatch, most):
    monkeypatch.setattr(pipeline, "S", dataclasses.replace(pipeline.S, max_reviews=most))
    beyond = f"""SELECT comment_id FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY comment_id) AS place FROM ({SQL["flt_01_preprocess"]}) WHERE moderation_reason = 'borderline_for_llm') WHERE place > {most}"""
    out = PLANS["flt_16_reviewed_decisions"](spark, sf)
    assert out.filter("action = 'flag' AND reason = 'llm_review_cap_fallback'").count() == out.filter("reason = 'llm_review_cap_fallback'").count()
    same_rows(out.filter("reason = 'llm_review_cap_fallback'").select("comment_id"), con, beyond)
    assert most > 100 or out.filter("reason = 'llm_review_cap_fallback'").count() > 0


# --- groups of given labels -------------------------------------------------------------------


def _resolved(rows):
    """id, label, vector -> position by id, with loops."""
    unit, label = fit.unit_rows(np.array([v for _, _, v in rows])), np.array([k for _, k, _ in rows])
    sizes = {k: int((label == k).sum()) for k in sorted(set(label.tolist()) - {-1})}
    kept = [k for k in sizes if sizes[k] >= max(2, math.ceil(0.03 * len(rows)))] or sorted(sizes, key=lambda k: (-sizes[k], k))[:1]
    out = {}
    for (i, k, _), u in zip(rows, unit, strict=True):
        cos = sorted(((float(u @ fit.unit_rows(np.array([[*np.mean([v for _, g, v in rows if g == c], axis=0)]]))[0]), c) for c in kept), reverse=True)
        far = cos[1][0] if len(cos) > 1 else -1.0
        out[i] = k if k in kept else cos[0][1] if cos and cos[0][0] >= 0.34 and cos[0][0] - far >= 0.035 else None
    return out


def _two_to_one(seed=5):
    r = np.random.default_rng(seed)
    labels = [0] * 60 + [1] * 40 + [2] * 3 + [3] + [-1] * 16
    return [(i, k, [float(c) for c in 0.9 * np.eye(6)[max(k, 0) % 2] + r.normal(size=6)]) for i, k in enumerate(labels)]


@pytest.mark.parametrize("rows", [_two_to_one(), [(0, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (2, -1, [0.1, 1.0])]])
def test_small_groups_dissolve_and_members_of_large_ones_stay(spark, rows):
    got = clusters.resolved_groups(spark.createDataFrame(rows, "id int, label int, v array<double>"), "label").collect()
    assert {r["id"]: r["position"] for r in got} == _resolved(rows)


def test_groups_are_resolved_within_their_topic(spark):
    rows = [(t * 1000 + i, t, k, v) for t in range(3) for i, k, v in _two_to_one(5 + t)]
    df = spark.createDataFrame(rows, "id int, topic int, label int, v array<double>")
    got = {(r["topic"], r["id"]): r["position"] for r in clusters.resolved_groups(df, "label", run=["topic"]).collect()}
    want = {(t, t * 1000 + i): p for t in range(3) for i, p in _resolved(_two_to_one(5 + t)).items()}
    assert got == want


def test_a_thousand_runs_in_one_plan_without_pairs(spark):
    r = np.random.default_rng(1)
    rows = [(i, i % 1000, int(i // 1000 % 2), [float(x) for x in r.normal(size=4)]) for i in range(8000)]
    df = spark.createDataFrame(rows, "id bigint, run bigint, label int, v array<double>")
    near = clusters.nearest_two(df, clusters.centroids(df, ["run", "label"]), "label", run=["run"])
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    got = {x["id"]: (x["primary"], x["primary_cos"], x["secondary_cos"]) for x in near.collect()}
    v, run, label = np.array([x[3] for x in rows]), np.array([x[1] for x in rows]), np.array([x[2] for x in rows])
    for i in range(0, 8000, 97):
        c = np.stack([v[(run == run[i]) & (label == k)].mean(axis=0) for k in (0, 1)])
        cos = c @ v[i] / np.linalg.norm(c, axis=1) / np.linalg.norm(v[i])
        assert got[i][0] == cos.argmax() and np.allclose(got[i][1:], np.sort(cos)[::-1])


def test_incoherent_rest_is_deleted_and_small_bad_clusters_collapse(spark):
    rows = [(-1, 20, 30.0, 0.69, 0.0), (0, 80, 40.0, 0.2, 0.9), (1, 11, 5.0, 0.36, 0.0), (2, 11, 5.0, 0.9, 0.45), (3, 11, 5.0, 0.38, 0.1), (4, 12, 5.0, 0.1, 0.9), (5, 11, 6.3, 0.1, 0.9)]
    d = spark.createDataFrame(rows, "label int, size int, share double, coherence double, ambiguous double")
    assert dict(map(tuple, clusters.collapsed_clusters(d, "label").collect())) == {0: "0", 1: "emerging_other", 2: "emerging_other", 3: "3", 4: "4", 5: "5"}
    d = spark.createDataFrame([(-1, 20, 30.0, 0.70, 0.0)], d.schema)
    assert dict(map(tuple, clusters.collapsed_clusters(d, "label").collect())) == {-1: "emerging_other"}


# --- vectors of all comments ------------------------------------------------------------------


def test_every_comment_has_a_vector(spark, sf, con):
    got = PLANS["vec_23_cached_vectors"](spark, sf)
    assert got.filter("embedding IS NULL OR size(embedding) <> 64").count() == 0
    same_rows(got.select("comment_id", "is_hit"), con, "SELECT comment_id, comment_id IN (SELECT vec_id FROM embeddings) AS is_hit FROM raw_comments")
    same_rows(got.filter("is_hit").select("comment_id", "embedding"), con, "SELECT vec_id AS comment_id, embedding FROM embeddings WHERE vec_id IN (SELECT comment_id FROM raw_comments)")
