"""A chronological look-ahead planner with committed and pending state.

``Fold`` is the state machine of one recording: words arrive in windows anchored at the
first unread word, a planner decides which prefix to commit, and the rest stays pending.
The same fold runs in batch (``plan_batch``, one group per recording) and on a stream
(``plan_stream``, state per recording), so both give the same plan.

A word may not arrive behind the frontier: that is an error, not late data to drop.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame

Word = tuple[int, str, float, float]


class DecisionError(ValueError):
    """A decision that breaks its contract."""


class Planner(Protocol):
    """Anything that turns pending words into a decision.

    A decision has ``thoughts``, each a list of half-open word-id ranges, and
    ``pending``, the first id to keep waiting or null; only the last pass may end with
    null pending while nothing waits.
    """

    def decide(self, pending: list[Word], final: bool, attempt: int, error: str | None) -> dict[str, Any]: ...


class RulePlanner:
    """Deterministic retake rules.

    Utterances end at terminal punctuation or at a pause of ``pause`` seconds. Of
    utterances that share a run of five words, or their first three, the last one stays.
    The newest utterance waits unless the input has ended.
    """

    def __init__(self, pause: float = 1.0, grams: int = 5, opening: int = 3):
        self.pause, self.grams, self.opening = pause, grams, opening

    def utterances(self, words: list[Word]) -> list[list[Word]]:
        out: list[list[Word]] = []
        for w in words:
            old = out[-1][-1] if out else None
            if old is None or w[2] - old[3] >= self.pause or old[1].rstrip("\"'”’)").endswith((".", "?", "!", "…")):
                out.append([])
            out[-1].append(w)
        return out

    def key(self, utterance: list[Word]) -> list[str]:
        return [k for w in utterance if (k := "".join(c for c in w[1].lower() if c.isalnum()))]

    def retake(self, a: list[str], b: list[str]) -> bool:
        n, m = self.grams, self.opening
        runs = {tuple(a[i : i + n]) for i in range(len(a) - n + 1)}
        return any(tuple(b[i : i + n]) in runs for i in range(len(b) - n + 1)) or len(a) >= m and a[:m] == b[:m]

    def decide(self, pending: list[Word], final: bool, attempt: int, error: str | None) -> dict[str, Any]:
        said = self.utterances(pending)
        keys = [self.key(u) for u in said]
        ready = said if final else said[:-1]
        thoughts = [[[u[0][0], u[-1][0] + 1]] for k, u in enumerate(ready) if not any(self.retake(keys[k], later) for later in keys[k + 1 :])]
        # what a later, still waiting take repeats must wait with it
        if not final and said:
            first = next((k for k in range(len(said) - 1) if self.retake(keys[k], keys[-1])), len(said) - 1)
            thoughts = [t for t in thoughts if t[0][0] < said[first][0][0]]
            return {"thoughts": thoughts, "pending": said[first][0][0]}
        return {"thoughts": thoughts, "pending": None}


def take_window(words: list[Word], start: int, seconds: float) -> int:
    """End of the next window: at least one word, then while a word starts before the first one's start plus ``seconds``."""
    if start >= len(words):
        return start
    limit, end = words[start][2] + seconds, start + 1
    while end < len(words) and words[end][2] < limit:
        end += 1
    return end


def validate(decision: Any, pending: list[Word], final: bool, committed_end: int) -> None:
    """Raise if a decision is not one of these pending words, in order, behind the frontier."""
    if not isinstance(decision, dict) or set(decision) != {"thoughts", "pending"}:
        raise DecisionError("a decision has thoughts and pending, nothing else")
    ids = [w[0] for w in pending]
    known, at = set(ids), committed_end
    for thought in decision["thoughts"]:
        if not thought:
            raise DecisionError("a thought needs a range")
        for a, b in thought:
            if type(a) is not int or type(b) is not int or a >= b:
                raise DecisionError(f"[{a}, {b}) is no range")
            if a < at:
                raise DecisionError(f"[{a}, {b}) lies behind {at}")
            if not set(range(a, b)) <= known:
                raise DecisionError(f"[{a}, {b}) leaves the pending words")
            at = b
    keep = decision["pending"]
    if keep is None:
        if not final:
            raise DecisionError("only the last pass may keep nothing pending")
    elif keep not in known or keep < at or final:
        raise DecisionError(f"pending can't start at {keep}")


class Fold:
    """State of one recording; ``state`` and ``Fold(planner, state)`` carry it between batches."""

    def __init__(self, planner: Planner, state: dict[str, Any] | None = None, window: float = 30.0, attempts: int = 2):
        self.planner, self.window, self.attempts = planner, window, attempts
        s = state or {}
        self.committed: list[list[list[int]]] = s.get("committed", [])
        self.pending: list[Word] = [tuple(w) for w in s.get("pending", [])]
        self.unread: list[Word] = [tuple(w) for w in s.get("unread", [])]
        self.frontier: int = s.get("frontier", 0)
        self.end: int = s.get("end", 0)
        self.log: list[dict[str, Any]] = s.get("log", [])

    def state(self) -> dict[str, Any]:
        return {"committed": self.committed, "pending": self.pending, "unread": self.unread, "frontier": self.frontier, "end": self.end, "log": self.log}

    def feed(self, words: list[Word]) -> None:
        """Take words in; windows that are complete (a later word has come) are decided."""
        for w in sorted(words):
            if w[0] < self.frontier:
                raise DecisionError(f"word {w[0]} came behind the frontier {self.frontier}")
            self.unread.append(w)
            self.frontier = w[0] + 1
        while (n := take_window(self.unread, 0, self.window)) < len(self.unread):
            self.step(self.unread[:n], False)
            self.unread = self.unread[n:]

    def finish(self) -> None:
        """The input has ended: decide what is left, and flush what waits."""
        if self.unread:
            self.step(self.unread, False)
            self.unread = []
        if self.pending:
            self.step([], True)

    def step(self, new: list[Word], final: bool) -> None:
        older, self.pending = len(self.pending), self.pending + new
        error, decision = None, None
        for attempt in range(self.attempts):
            try:
                decision = self.planner.decide(list(self.pending), final, attempt, error)
                validate(decision, self.pending, final, self.end)
                break
            except DecisionError as e:
                error, decision = str(e), None
        how = "planner"
        if decision is None:  # fail soft: what was waiting before this window goes through as it is; all of it at the end
            n, how = (len(self.pending) if final else older), "passthrough"
            decision = {"thoughts": [[[self.pending[0][0], self.pending[n - 1][0] + 1]]] if n else [], "pending": None if final else self.pending[n][0]}
        self.committed = [*self.committed, *decision["thoughts"]]
        if decision["thoughts"]:
            self.end = decision["thoughts"][-1][-1][1]
        keep = decision["pending"]
        if keep is not None:
            self.end = max(self.end, min(keep, self.end))
        self.pending = [] if keep is None else [w for w in self.pending if w[0] >= keep]
        self.log.append({"pass": len(self.log), "final": final, "how": how, "thoughts": len(decision["thoughts"]), "pending": len(self.pending), "error": error})


PLAN = "thought int, range_no int, st long, en long, how string"


def _rows(fold: Fold) -> list[tuple]:
    hows = [e["how"] for e in fold.log for _ in range(e["thoughts"])]
    return [(t, k, a, b, hows[t]) for t, ranges in enumerate(fold.committed) for k, (a, b) in enumerate(ranges)]


def plan_batch(words: DataFrame, key: str, planner: Planner | None = None, window: float = 30.0) -> DataFrame:
    """(key, thought, range_no, st, en, how) of every recording's words (word_id, text, start_s, end_s)."""
    planner = planner or RulePlanner()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("word_id")
        fold = Fold(planner, window=window)
        fold.feed([(int(a), b, float(c), float(e)) for a, b, c, e in zip(pdf["word_id"], pdf["text"], pdf["start_s"], pdf["end_s"])])
        fold.finish()
        out = pd.DataFrame(_rows(fold), columns=["thought", "range_no", "st", "en", "how"])
        out.insert(0, key, pdf[key].iloc[0])
        return out

    kind = words.schema[key].dataType.simpleString()
    return words.select(key, "word_id", "text", "start_s", "end_s").groupBy(key).applyInPandas(run, f"{key} {kind}, {PLAN}")


def plan_stream(words: DataFrame, key: str, planner: Planner | None = None, window: float = 30.0) -> DataFrame:
    """The same plan from a stream; a row with a null word_id marks a recording's end, which emits its plan."""
    planner = planner or RulePlanner()
    kind = words.schema[key].dataType.simpleString()

    def run(ids: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        fold = Fold(planner, json.loads(state.get[0]) if state.exists else None, window)
        rows = pd.concat(list(batches))
        ended = rows["word_id"].isna().any()
        rows = rows[rows["word_id"].notna()].sort_values("word_id")
        fold.feed([(int(a), b, float(c), float(e)) for a, b, c, e in zip(rows["word_id"], rows["text"], rows["start_s"], rows["end_s"])])
        if ended:
            fold.finish()
            if state.exists:
                state.remove()
            out = pd.DataFrame(_rows(fold), columns=["thought", "range_no", "st", "en", "how"])
            out.insert(0, key, ids[0])
            yield out
        else:
            state.update((json.dumps(fold.state()),))

    return words.select(key, "word_id", "text", "start_s", "end_s").groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {PLAN}", "state string", "append", "NoTimeout")


def windows(words: DataFrame, key: str, seconds: float) -> DataFrame:
    """(key, window_no, st, en): look-ahead windows by word id, anchored at each first unread word."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("word_id")
        ws = [(int(i), "", float(s), 0.0) for i, s in zip(pdf["word_id"], pdf["start_s"])]
        out, at = [], 0
        while at < len(ws):
            end = take_window(ws, at, seconds)
            out.append((pdf[key].iloc[0], len(out), ws[at][0], ws[end - 1][0] + 1))
            at = end
        return pd.DataFrame(out, columns=[key, "window_no", "st", "en"])

    kind = words.schema[key].dataType.simpleString()
    return words.select(key, "word_id", "start_s").groupBy(key).applyInPandas(run, f"{key} {kind}, window_no int, st long, en long")
