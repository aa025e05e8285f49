"""The look-ahead planner: contract, fail-soft, and the same plan in batch and on a stream."""

import pytest
from spanloom.streaming import planner as P


def say(text, pause=0.0, at=0.0, first=0):
    out = []
    for i, w in enumerate(text.split()):
        out.append((first + i, w, at, at + 0.4))
        at += 0.5 + (pause if w.endswith(".") else 0)
    return out


class Scripted:
    def __init__(self, *answers):
        self.answers, self.seen = list(answers), []

    def decide(self, pending, final, attempt, error):
        self.seen.append((len(pending), final, attempt, error))
        a = self.answers.pop(0)
        return a(pending, final) if callable(a) else a


def test_windows_are_anchored_at_the_first_unread_word():
    w = [(i, "x", s, s) for i, s in enumerate([0, 5, 29.9, 30, 31, 100, 101])]
    assert P.take_window(w, 0, 30) == 3 and P.take_window(w, 3, 30) == 5 and P.take_window(w, 5, 30) == 7 and P.take_window(w, 7, 30) == 7


def test_retakes_keep_the_last():
    words = say("We will now start the big tour. We will now start the big tour today. And then we go home.", 2)
    f = P.Fold(P.RulePlanner(), window=4)
    f.feed(words)
    f.finish()
    kept = [" ".join(words[i][1] for a, b in t for i in range(a, b)) for t in f.committed]
    assert kept == ["We will now start the big tour today.", "And then we go home."]


def test_retry_then_passthrough_keeps_the_newest_waiting():
    bad = {"thoughts": [[[5, 3]]], "pending": None}
    wait = lambda p, final: {"thoughts": [], "pending": p[0][0]}
    f = P.Fold(Scripted(wait, bad, bad, bad, bad), window=2)
    f.feed(say("a b c d e f g h"))
    assert f.log[0]["how"] == "planner" and f.log[1]["how"] == "passthrough" if len(f.log) > 1 else True
    f.finish()
    assert f.pending == [] and f.log[-1]["how"] == "passthrough"
    assert [x for t in f.committed for a, b in t for x in range(a, b)] == list(range(8))


@pytest.mark.parametrize("bad", [{}, {"thoughts": [], "pending": None}, {"thoughts": [[]], "pending": 1}, {"thoughts": [[[0, 9]]], "pending": 1}, {"thoughts": [[[1, 2], [0, 1]]], "pending": 2}, {"thoughts": [], "pending": 7}])
def test_contract(bad):
    with pytest.raises(P.DecisionError):
        P.validate(bad, say("a b c"), False, 0)


def test_words_behind_the_frontier_fail():
    f = P.Fold(P.RulePlanner())
    f.feed(say("a b c"))
    with pytest.raises(P.DecisionError):
        f.feed([(1, "b", 0.5, 0.9)])


def test_state_survives_a_round_trip():
    import json

    words = say("One two three four. Five six seven eight. Nine ten eleven.", 2)
    whole = P.Fold(P.RulePlanner(), window=3)
    whole.feed(words)
    whole.finish()
    state = None
    for i in range(0, len(words), 2):
        f = P.Fold(P.RulePlanner(), json.loads(json.dumps(state)) if state else None, window=3)
        f.feed(words[i : i + 2])
        state = f.state()
    f.finish()
    assert f.committed == whole.committed


def test_stream_equals_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = [(r, i, w, s, e) for r in ("a", "b") for i, w, s, e in say("We will start the big tour. We will start the big tour today. Then we go. So it ends here.", 2)]
    schema = "rec string, word_id long, text string, start_s double, end_s double"
    df = spark.createDataFrame(rows, schema)
    want = sorted(map(tuple, P.plan_batch(df, "rec", window=5.0).collect()))
    src = str(tmp_path / "in")
    for k, part in enumerate([rows[:9], rows[9:30], rows[30:], [("a", None, None, None, None), ("b", None, None, None, None)]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(src) if k < 0 else spark.createDataFrame(part, schema).coalesce(1).write.json(f"{src}/{k}")
    got = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).option("recursiveFileLookup", True).json(src)
    plan = P.plan_stream(stream, "rec", window=5.0)
    q = plan.writeStream.outputMode("append").foreachBatch(lambda b, _: got.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    assert sorted(got) == want
