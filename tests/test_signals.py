"""Frames, arrays, allocation, sources and sinks on small hand-made inputs."""

import io
import math
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F
from spanloom.functions import numeric as N
from spanloom.functions.spectral import frames_of, measures
from spanloom.operators import allocate as A
from spanloom.operators import frames as R
from spanloom.operators import sequences as S
from spanloom.plans import boundary as B
from spanloom.sources import readers, sinks


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def arr(*x):
    return F.array(*[F.lit(float(v)) for v in x])


def test_rounding(spark):
    assert one(spark, N.timestamp_to_sample(F.lit(0.5), 5, 100, "nearest")) == 2
    assert one(spark, N.timestamp_to_sample(F.lit(1.00000001), 1, 100, "ceil")) == 1
    assert one(spark, N.timestamp_to_sample(F.lit(-3.0), 10, 100, "floor")) == 0 and one(spark, N.timestamp_to_sample(F.lit(99.0), 10, 100, "floor")) == 100
    assert one(spark, N.frame_to_sample(F.lit(1), 44105, True)) == 442 and one(spark, N.frame_to_sample(F.lit(1), 44105, False)) == 441


def test_gains_and_crossfade(spark):
    g = one(spark, N.equal_power_gain(F.lit(5)))
    assert np.allclose(g, np.sin(np.linspace(0, math.pi / 2, 5)))
    x = one(spark, R.crossfade(arr(1, 1, 1, 1), arr(1, 1, 1, 1), 2))
    assert len(x) == 6 and x[:2] == [1, 1] and x[4:] == [1, 1]
    assert one(spark, R.edge_fades(arr(1, 1, 1, 1, 1), 2)) == [0, 1, 1, 1, 0]
    assert one(spark, R.zero_crossings(arr(-1, 0, 1, 0, -1))) == [1, 3]
    assert one(spark, R.argmin_abs(arr(3, -1, 1))) == 1


def test_softmax(spark):
    assert np.allclose(one(spark, N.softmax(arr(0.25, 0.75))), [0.25, 0.75])
    assert np.allclose(one(spark, N.softmax(arr(1, 2, 3))), np.exp([1, 2, 3]) / np.exp([1, 2, 3]).sum())


def test_stable_silence(spark):
    levels = [0, -60, -60, 0, -60, -60, -60, -60, 0, -60, -60, -60]
    df = spark.createDataFrame([("a", i * 10, float(v), 20) for i, v in enumerate(levels)], "rec string, start int, db double, raw int")
    got = R.stable_silence(df, ["rec"], "start", "db", -40.0, 10, 30, "raw", 10).first()
    assert got.silence_start == 40
    assert R.stable_silence(df, ["rec"], "start", "db", -40.0, 10, 50, "raw", 10).count() == 0


def test_morphology_matches_plain_python(spark):
    r = np.random.default_rng(4)
    mask = r.random(60) < 0.4
    df = spark.createDataFrame([("a", i, bool(m)) for i, m in enumerate(mask)], "rec string, i int, m boolean")
    for size in (2, 3, 4, 7):
        got = [x.o for x in R.dilate(df, ["rec"], "i", "m", size, "o").orderBy("i").collect()]
        lo, hi = size // 2, size - 1 - size // 2
        assert got == [bool(mask[max(0, i - lo) : i + hi + 1].any()) for i in range(60)]
        got = [x.o for x in R.erode(df, ["rec"], "i", "m", size, "o").orderBy("i").collect()]
        assert got == [i - lo >= 0 and i + hi < 60 and bool(mask[i - lo : i + hi + 1].all()) for i in range(60)]


def test_noise_floor_and_gates(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (-80, -70, -60, -50, float("nan"))], "rec string, db double")
    r = R.noise_floor(df, ["rec"], "db").first()
    assert abs(r.noise_floor_db - np.percentile([-80, -70, -60, -50], 12)) < 1e-9 and r.threshold_db == -56
    m = spark.createDataFrame([("a", 0.1, 25.0, 1, 40.0)], "id string, rms double, crest_db double, clipped int, duration_ms double")
    got = m.select(R.gate_reasons(m.columns, ("duration_ms", 80.0)).alias("r")).first().r
    assert [x.code for x in got] == ["insufficient_duration", "clipping", "excessive_crest_factor"]


def test_spectral():
    assert frames_of(np.arange(10.0), 4, 3).shape == (3, 4) and frames_of(np.ones(2), 4, 3).shape == (1, 4)
    flux, variance, burst = measures(np.sin(np.arange(400) * 0.3), 64, 32)
    noisy = measures(np.concatenate([np.sin(np.arange(200) * 0.3), 20 * np.sin(np.arange(200) * 2.0)]), 64, 32)
    assert flux < 0.2 < noisy[0] and burst < 1 < noisy[2]


def test_greedy_assembly(spark):
    rows = [(1, 100, 1, "a", 0, 40), (1, 100, 2, "b", 30, 70), (1, 100, 3, "c", 100, 150), (1, 100, 4, "d", 200, 260), (2, 500, 1, "a", 0, 40)]
    df = spark.createDataFrame(rows, "req int, need long, rank int, candidate_id string, st long, en long")
    got = {r.req: r for r in A.greedy_assembly(df, ["req"], "need", 5).collect()}
    assert [t.candidate_id for t in got[1].takes] == ["a", "c", "d"] and got[1].status == "assembled"
    lengths = [t.en - t.st for t in got[1].takes]
    assert sum(lengths) - 5 * 2 == 100 and got[2].status == "unavailable" and got[2].takes == []


def test_weighted_merge_depends_on_order(spark):
    df = spark.createDataFrame([("a", 0, 10, 0.5, 0.6), ("a", 5, 15, 0.9, 0.9), ("a", 40, 50, 0.2, 0.2)], "rec string, st long, en long, mean_p double, max_p double")
    got = sorted(tuple(r) for r in A.merge_weighted(df, ["rec"]).collect())
    assert got[0][:3] == ("a", 0, 15) and abs(got[0][3] - (0.5 * 10 + 0.9 * 5) / 15) < 1e-12 and got[0][4:] == (0.9, 2) and got[1][5] == 1


def test_split_long(spark):
    levels = [5, 5, 5, 1, 5, 5, 5, 5, 0, 5, 5, 5]
    f = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(levels)], "rec string, i int, x double")
    runs = spark.createDataFrame([("a", 0, 12)], "rec string, st long, en long")
    got = sorted((r.st, r.en) for r in S.split_long(f, runs, ["rec"], "i", "x", 4, 2).collect())
    assert got[0][0] == 0 and got[-1][1] == 12 and all(a[1] == b[0] for a, b in zip(got, got[1:])) and (0, 3) in got


def wav(samples, rate=8000, channels=2):
    b = io.BytesIO()
    with wave.open(b, "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(np.repeat(np.asarray(samples, "<i2"), channels).tobytes())
    return b.getvalue()


def test_wav_files(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav([0, 16384, -32768]))
    (tmp_path / "b.wav").write_bytes(b"no audio")
    got = {r.path[-5:]: r for r in readers.wav_files(spark, str(tmp_path)).collect()}
    assert got["a.wav"].samples == [0.0, 0.5, -1.0] and got["a.wav"].channels == 2 and got["a.wav"].error is None
    assert got["b.wav"].error and got["b.wav"].samples is None


def test_transcript_falls_back_to_the_whole(spark):
    rows = ['{"rec_id":"a","atoms":[{"atom_index":2,"words":[{"word":"late","start":3,"end":4}]},{"atom_index":1,"words":[{"word":" ","start":0,"end":1},{"word":"early","start":1,"end":2}]}]}', '{"rec_id":"b","atoms":[],"whole":{"words":[{"word":"only","start":2,"end":1}]}}']
    docs = spark.createDataFrame([(r,) for r in rows], "j string").select(F.from_json("j", readers.TRANSCRIPT).alias("p")).select("p.*")
    w = readers.transcript_words(docs)
    assert sorted((r.rec_id, r.word_id, r.text) for r in w.collect()) == [("a", 0, "early"), ("a", 1, "late"), ("b", 0, "only")]
    assert [(r.rule, r.rec_id) for r in readers.word_violations(w).collect()] == [("reversed", "b")]


def test_tiers_carry_errors(spark):
    payload = '{"tiers":{"words":{"entries":[["0.0","0.5","a"],["0.4","0.9","b"],["0.9","9","c"],["x","1","d"]]}}}'
    docs = spark.createDataFrame([("c", 10.0, 1.0, payload)], "context_id string, offset_s double, duration_s double, payload string")
    got = {r.label: r for r in readers.tier_intervals(docs, "words", 100).collect()}
    assert got["a"].error is None and (got["a"].st, got["a"].en) == (1000, 1050)
    assert [got[k].error for k in "bcd"] == ["out_of_order", "out_of_bounds", "not_a_number"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.1, 0.2]), (2, [0.3])], "id int, x array<double>")
    assert sinks.write_verified(df, str(tmp_path / "w"), ["id"], "x").count() == 2
    with pytest.raises(Exception, match="exists"):
        sinks.write_documents(df, str(tmp_path / "w"))
    done = str(tmp_path / "done")
    assert sinks.pending(spark, df, done, "r1", ["id"]).count() == 2
    sinks.append_done(df.where("id = 1").select("id"), done, "r1")
    assert [r.id for r in sinks.pending(spark, df, done, "r1", ["id"]).collect()] == [2]
    assert sinks.pending(spark, df, done, "r2", ["id"]).count() == 2


def test_trace_violations_are_found(spark):
    t = spark.createDataFrame([("a", 0, 0, "source", 0, 10, 0, 10), ("a", 1, 0, "source", 20, 20, 11, 11)], "rec string, idx int, part int, kind string, st long, en long, out_st long, out_en long")
    p = spark.createDataFrame([("a", 5, 15)], "rec string, st long, en long")
    assert sorted(r.rule for r in B.trace_violations(t, p, ["rec"]).collect()) == ["cut_inside_protected", "empty_segment", "output_not_contiguous"]


def test_conservative_growth_settles(spark):
    sel = spark.createDataFrame([("a", 2, 4), ("a", 7, 8)], "rec string, st long, en long")
    n = spark.createDataFrame([("a", 10)], "rec string, n long")
    unsafe = spark.createDataFrame([("a", 3)], "rec string, word_id long")
    got = sorted((r.st, r.en) for r in B.grown_selection(sel, unsafe, ["rec"], n).collect())
    assert got == [(2, 8)]


def test_mapped_outputs():
    from spanloom.plans.enrich import mapped_outputs

    assert mapped_outputs(["don't", "stop"], ["don", "'t", "stop"]) == [(0, 0, 2), (1, 2, 3)]
    assert mapped_outputs(["ab"], ["a", "b", "c"]) is None and mapped_outputs([], []) == []


def test_allocation_prefers_the_least_used(spark):
    from spanloom.plans.enrich import allocate_in_order

    req = spark.createDataFrame([("a", i, 10, 0, 40.0) for i in range(3)] + [("a", 9, 999, 0, 40.0)], "rec string, req long, need long, ref long, level double")
    cand = spark.createDataFrame([("a", "x", 0, 20, 40.0), ("a", "y", 50, 70, 41.0)], "rec string, candidate_id string, st long, en long, level double")
    got = {r.req: (r.candidate_id, r.take_st, r.uses) for r in allocate_in_order(req, cand, "rec").collect()}
    assert got == {0: ("x", 5, 1), 1: ("y", 55, 1), 2: ("x", 5, 2), 9: (None, None, 0)}
