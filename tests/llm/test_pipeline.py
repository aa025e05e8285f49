"""The pipeline's stages on a small corpus, each held against plain Python."""

from random import Random

import corpus_pipeline as P
import pytest
from spanloom.llm import langid, mixing
from test_linededup import brute as brute_lines
from test_simhash import brute_components, brute_fp


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = Random(11)
    parts = {"en": "th er ing the of and re".split(), "de": "ung sch der und ei ß en".split(), "fr": "eau que é les ai tion on".split(), "es": "ción ado ñ los rr que es".split()}
    word = lambda lang: "".join(r.choices(parts[lang], k=r.randint(1, 4)))
    say = lambda lang, n: " ".join(word(lang) for _ in range(n)) + "."
    rows = []
    for i in range(160):
        lang = r.choice(sorted(parts))
        rows.append([i, "\n".join(say(lang, r.randint(15, 60)) for _ in range(r.randint(2, 5))), lang, "hot" if i % 3 == 0 else f"s{i % 5}"])
    bench = [(k, say("en", 30)) for k in range(8)]
    for i, k in ((20, 0), (41, 3)):
        rows[i][1] += "\n" + bench[k][1]
    rows += [[200, rows[5][1], "en", "s1"], [201, rows[5][1], "en", "s1"], [202, "own start of it\n" + rows[6][1].split("\n")[0], "en", "s2"], [203, None, "en", "s1"], [204, "", None, None], [205, "123 !!", "fr", "s1"]]
    near = rows[9][1].replace(" ", "  ", 3).split(" ")
    near[4] = "changed"
    rows.append([206, " ".join(near), rows[9][2], "s1"])
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), rows, bench


def test_stages(spark, corpus):
    d, rows, bench = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["language_id", "line_dedup", "simhash_dedup", "decontamination", "mixing"] and P.ORACLE_SQL is None
    kept = []
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, d)
        if k < 4:
            assert out.columns == docs.columns
        out = spark.createDataFrame(out.collect(), out.schema)
        kept.append({r.doc_id: r for r in out.collect()})
        docs = out
    text = {i: t for i, t, *_ in rows}
    assert set(kept[0]) == {i for i, t in text.items() if any(c.isalpha() for c in t or "")}
    lines = brute_lines([(i, text[i]) for i in sorted(kept[0])], 30)
    assert {i: r.text for i, r in kept[1].items()} == {i: t for i, t in lines.items() if t.strip()}
    assert all(r.n_chars == len(r.text) for r in kept[1].values())
    ids = sorted(kept[1])
    comp = brute_components([brute_fp(kept[1][i].text) for i in ids])
    assert set(kept[2]) == {ids[c] for c in set(comp)}
    leaks = {i for i, r in kept[2].items() if any(t in r.text for _, t in bench)}
    assert leaks and set(kept[3]) == set(kept[2]) - leaks
    assert set(kept[4]) <= set(kept[3]) and len(kept[4]) > 0.5 * len(kept[3])
    assert all(mixing.draw(i) < r.prob for i, r in kept[4].items())


def test_run_and_empty(spark, corpus, tmp_path):
    d, rows, _ = corpus
    assert 0 < P.run(spark, d).count() < len(rows)
    e = str(tmp_path)
    spark.read.parquet(f"{d}/documents.parquet").limit(0).write.parquet(f"{e}/documents.parquet")
    spark.read.parquet(f"{d}/benchmark.parquet").write.parquet(f"{e}/benchmark.parquet")
    assert P.run(spark, e).count() == 0
    assert langid.UND == "und"


CLASH = ["score", "prob", "weight", "n_tokens", "mix_topic", "_n_removed", "_o", "rid", "runs", "lang_pred", "component_id", "cosine"]


def test_repeated_ids_rows_and_clashing_names(spark, corpus):
    """Rows of one id and different texts are told apart, equal rows are one, and no user column is touched."""
    d, rows, bench = corpus
    a, b, c = (rows[k][1] for k in (30, 31, 32))
    lang = {x[1]: x[2] for x in rows}
    odd = [(1, a, lang[a]), (2, a, lang[a]), (2, b, lang[b]), (5, c, lang[c]), (5, c, lang[c]), (5, c, lang[c]), (None, None, "en"), (None, "", None), (7, bench[0][1] + " and more words here", "en")]
    train = [(1000 + i, t, y) for i, t, y, *_ in rows[:100]]
    kinds = ", ".join(f"`{n}` int" for n in CLASH)
    docs = spark.createDataFrame([(i, t, y, "s", len(t or ""), *range(12)) for i, t, y in odd + train], f"doc_id long, text string, lang string, source string, n_chars long, {kinds}")
    out = P.language_id(spark, docs, d)
    assert out.columns == docs.columns and out.count() == docs.count() - 2
    few = spark.createDataFrame(docs.where("doc_id < 1000 or doc_id is null").collect(), docs.schema)
    out = P.line_dedup(spark, few, d)
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert out.columns == docs.columns and got == sorted([(1, a), (2, b), *[(5, c)] * 3, (None, None), (None, ""), (7, odd[-1][1])], key=str)
    out = P.simhash_dedup(spark, few, d)
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    kept_blank = [x for x in got if not x[1]]
    assert len(kept_blank) == 1 and [x for x in got if x[1]] == sorted([(1, a), (2, b), (5, c), (7, odd[-1][1])], key=str)
    out = P.decontamination(spark, few, d)
    assert out.columns == docs.columns and out.count() == few.count() - 1 and 7 not in {r.doc_id for r in out.collect()}
    out = P.mix(spark, few, d)
    assert out.columns[: len(docs.columns)] == docs.columns and len({c.lower() for c in out.columns}) == len(docs.columns) + 4
    for r in out.collect():
        assert [r[n] for n in CLASH] == list(range(12))
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, d).count() == 0
