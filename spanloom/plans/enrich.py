"""Enrichment of transcripts, contexts of alignment, repair targets and ordered room-tone allocation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators import intervals as I
from spanloom.operators import sequences as S

# --- enrichment --------------------------------------------------------------------------


def join_evidence(atoms: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Atoms with their acoustic segment, and the violations: unknown, missing and repeated segments."""
    both = atoms.join(segments.groupBy("rec_id", "atom").agg(F.count("*").alias("n"), F.first("observed").alias("observed"), F.first("error").alias("error")), ["rec_id", "atom"], "full")
    rule = F.when(F.col("expected").isNull(), "unknown_segment").when(F.col("n").isNull(), "missing_segment").when(F.col("n") > 1, "repeated_segment")
    return both.where("expected is not null"), both.where(rule.isNotNull()).select(rule.alias("rule"), "rec_id", "atom")


def enrich(atoms: DataFrame, segments: DataFrame) -> DataFrame:
    """(rec_id, atom, status, words, n_relabelled, n_retries) of every atom.

    ``expected`` is an atom's array of words, ``observed`` an array of structs of word,
    start, end and score. Words are given their expected spelling where the two align,
    and hidden retries are found. An atom without words, without evidence, with failed or
    with empty evidence keeps its own words and says so.
    """

    @F.pandas_udf("struct<words: array<string>, n_relabelled: int, retries: array<string>>")
    def merge(expected: pd.Series, observed: pd.Series) -> pd.DataFrame:
        out = []
        for x, seen in zip(expected, observed):
            x, seen = [*x], [dict(w) for w in seen]
            words = S.relabel(x, seen)
            out.append(([w["word"] for w in words], sum(w["word"] != w["observed"] for w in words), [r["text"] for r in S.insertions(x, seen)]))
        return pd.DataFrame(out, columns=["words", "n_relabelled", "retries"])

    rows, _ = join_evidence(atoms, segments)
    status = (
        F.when(F.size("expected") == 0, "lexically_empty").when(F.col("n").isNull(), "no_evidence").when(F.col("n") > 1, "ambiguous_evidence").when(F.col("error").isNotNull(), "evidence_failed").when(F.size("observed") == 0, "nothing_heard").otherwise("enriched")
    )
    rows = rows.withColumn("status", status)
    good = rows.where("status = 'enriched'").withColumn("m", merge("expected", "observed")).select("rec_id", "atom", "status", "m.words", "m.n_relabelled", F.size("m.retries").alias("n_retries"))
    kept = rows.where("status <> 'enriched'").select("rec_id", "atom", "status", F.col("expected").alias("words"), F.lit(0).alias("n_relabelled"), F.lit(0).alias("n_retries"))
    return good.unionByName(kept)


def report(enriched: DataFrame) -> DataFrame:
    """Counters of an enrichment run by recording."""
    names = ["enriched", "lexically_empty", "no_evidence", "ambiguous_evidence", "evidence_failed", "nothing_heard"]
    return enriched.groupBy("rec_id").agg(F.count("*").alias("atoms"), *[F.count_if(F.col("status") == s).alias(s) for s in names], F.sum("n_relabelled").alias("relabelled"), F.sum("n_retries").alias("retries"))


def mapped_outputs(tokens: list[str], outputs: list[str], most: int = 3) -> list[tuple[int, int, int]] | None:
    """(token, first, end) of the outputs that spell each token in order, the fewest of them first; null if they don't fit."""
    at, out = 0, []
    for k, token in enumerate(tokens):
        n = next((n for n in range(1, most + 1) if at + n <= len(outputs) and "".join(outputs[at : at + n]).replace("'", "") == token.replace("'", "")), None)
        if n is None:
            return None
        out.append((k, at, at + n))
        at += n
    return out if at == len(outputs) else None


def mapped_outputs_udf():
    @F.pandas_udf("array<struct<token: int, st: int, en: int>>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        found = (mapped_outputs([*x], [*y]) for x, y in zip(a, b))
        return pd.Series([None if f is None else [{"token": k, "st": s, "en": e} for k, s, e in f] for f in found])

    return run


# --- contexts ------------------------------------------------------------------------------


def contexts(roles: DataFrame, words: DataFrame, keys: list[str], reach: int = 3) -> DataFrame:
    """(keys, word_id, st, en): ``reach`` words on each side of a role word, grown over words that overlap its edges in time."""
    w = Window.partitionBy(*keys).orderBy("word_id")
    far = F.max("en").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = words.withColumn("_new", F.when(F.col("st") < far, 0).otherwise(1)).withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = Window.partitionBy(*keys, "_g")
    last = words.groupBy(*keys).agg(F.max("word_id").alias("_last"))
    ends = island.select(*keys, F.col("word_id").alias("_e"), F.min("word_id").over(g).alias("_first_id"), F.max("word_id").over(g).alias("_last_id"))
    r = roles.join(last, keys).withColumn("_a", F.greatest(F.col("word_id") - reach, F.lit(0))).withColumn("_b", F.least(F.col("word_id") + reach, F.col("_last")))
    left = ends.select(*keys, F.col("_e").alias("_a"), F.col("_first_id").alias("st"))
    right = ends.select(*keys, F.col("_e").alias("_b"), (F.col("_last_id") + 1).alias("en"))
    return r.drop("st", "en").join(left, [*keys, "_a"]).join(right, [*keys, "_b"]).select(*keys, "word_id", F.col("st").cast("long").alias("st"), F.col("en").cast("long").alias("en"))


def repair_targets(failures: DataFrame, thoughts: DataFrame, keys: list[str], reach: int = 80) -> DataFrame:
    """(keys, thought, ctx_st, ctx_en, n): thoughts to repair, with the word context each may use.

    A failure's word implicates the thought that owns it, or else every thought whose
    bounds hold it. The context reaches ``reach`` words out but not past the neighbours.
    """
    w = Window.partitionBy(*keys).orderBy("st")
    t = thoughts.withColumn("_lo", F.coalesce(F.lag("en").over(w), F.lit(0))).withColumn("_hi", F.coalesce(F.lead("st").over(w), F.lit(1 << 60)))
    t = t.withColumn("ctx_st", F.greatest(F.col("st") - reach, F.col("_lo"))).withColumn("ctx_en", F.least(F.col("en") + reach, F.col("_hi")))
    point = failures.select(*keys, F.col("word_id").cast("long").alias("st"), (F.col("word_id") + 1).cast("long").alias("en"), "word_id")
    hits = I.overlap_join(point, t.select(*keys, "st", "en", "thought", "ctx_st", "ctx_en"), keys, carry=["thought", "ctx_st", "ctx_en"], width=256)
    return hits.groupBy(*keys, "thought", "ctx_st", "ctx_en").agg(F.count("*").alias("n"))


def edge_transitions(trace: DataFrame, keys: list[str], fade: int) -> DataFrame:
    """Fades of every inserted piece towards its source neighbours, at most half of it long."""
    w = Window.partitionBy(*keys).orderBy("out_st", "part")
    half = F.floor((F.col("out_en") - F.col("out_st")) / 2).cast("long")
    side = lambda k: F.when(k == "source", F.least(F.lit(fade).cast("long"), half)).otherwise(F.lit(0).cast("long"))
    t = trace.withColumn("_p", F.lag("kind").over(w)).withColumn("_n", F.lead("kind").over(w)).where("kind = 'ambience'")
    return t.select(*keys, "idx", "out_st", "out_en", side(F.col("_p")).alias("fade_in"), side(F.col("_n")).alias("fade_out"))


def allocate_in_order(requests: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """(key, req, candidate_id, take_st, take_en, uses): requests served in order, each preferring what was used least.

    The use counts carry over from request to request, so a recording is one fold; a
    request that no candidate is long enough for gets nothing, which makes its pause zero.
    """
    schema = f"{key} {requests.schema[key].dataType.simpleString()}, req long, candidate_id string, take_st long, take_en long, uses long"

    def run(ids: tuple, reqs: pd.DataFrame, cands: pd.DataFrame) -> pd.DataFrame:
        used: dict[str, int] = {}
        pool = list(cands.sort_values(["st", "candidate_id"]).itertuples(index=False))
        out = []
        for r in reqs.sort_values("req").itertuples(index=False):
            fits = [c for c in pool if c.en - c.st >= r.need]
            best = min(fits, key=lambda c: (int(abs(c.level - r.level) // 3), used.get(c.candidate_id, 0), abs(c.level - r.level), abs((c.st + c.en) // 2 - r.ref), c.st - c.en, c.st, c.candidate_id), default=None)
            if best is None:
                out.append((ids[0], r.req, None, None, None, 0))
                continue
            used[best.candidate_id] = used.get(best.candidate_id, 0) + 1
            st = best.st + (best.en - best.st - r.need) // 2
            out.append((ids[0], r.req, best.candidate_id, st, st + r.need, used[best.candidate_id]))
        frame = pd.DataFrame(out, columns=[key, "req", "candidate_id", "take_st", "take_en", "uses"])
        return frame.astype({"take_st": "Int64", "take_en": "Int64"})

    return requests.groupBy(key).cogroup(candidates.groupBy(key)).applyInPandas(run, schema)
