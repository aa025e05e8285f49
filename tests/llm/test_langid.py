import numpy as np
from spanloom.llm import langid as L


def corpus(n=240):
    r = np.random.default_rng(1)
    parts = {"en": "th er ing the of and".split(), "de": "ung sch der und ei ß".split(), "fr": "eau que é les ai tion".split(), "es": "ción ado ñ los rr que".split()}
    rows = []
    for i in range(n):
        lang = sorted(parts)[i % 4]
        rows.append((i, " ".join("".join(r.choice(parts[lang], 3)) for _ in range(40)).capitalize(), lang))
    return rows


def test_held_out_accuracy_and_cases(spark):
    rows = [*corpus(), (900, None, "en"), (901, "", "en"), (902, "12 !! 3", None), (903, "the of and " * 60_000, "en"), (904, "the", None), (None, "der und", "de"), (0, corpus()[0][1], "de")]
    df = spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id long, text string, lang string, score double").repartition(3)
    got = L.predict(df).collect()
    assert len(got) == len(rows)
    truth = {i: y for i, _, y in corpus()}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 30 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    by = {r.doc_id: r for r in got}
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (900, 901, 902))
    assert by[903].lang_pred == "en" and all(0 <= r.score <= 1 for r in got)
    kept = L.recognised(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.lang_pred != "und")
    assert all(r.score == 0.0 for r in kept.collect())  # a column of the user's, not the prediction's
    assert {r.lang_pred for r in L.predict(df.limit(3).selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}
    assert L.predict(df.limit(0)).count() == 0


def test_segments_are_whole_text(monkeypatch):
    t = "Été aux bords — de la mer, " * 50
    whole = np.sort(np.concatenate(list(L.grams(t))))
    monkeypatch.setattr(L, "SEGMENT", 37)
    assert (np.sort(np.concatenate(list(L.grams(t)))) == whole).all()


def test_family_first():
    assert L.family("pt-BR") == "romance" and L.family("xx") == "other"
    m = L.Model(["der und ung", "the of and ing"], ["de", "en"])
    assert m.families == ["germanic"] and len(m.duels) == 1


def test_many_languages(spark):
    """Every lang value is learned, however many there are."""
    r = np.random.default_rng(3)
    heads = ["en", "fr", "ru", "hi", "ar", "tr", "fi", "zh", "xx"]
    langs = [f"{heads[k % 9]}-{k}" for k in range(207)]
    rows = []
    for k, lang in enumerate(langs):
        words = ["".join(chr(0x4E00 + 40 * k + int(c)) for c in r.integers(0, 40, 3)) for _ in range(12)]
        rows += [(20 * k + j, " ".join(r.choice(words, 30)), lang) for j in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(df, sample=300)
    assert set(model.langs) == set(langs)
    got = L.predict(df, model).where("held_out").join(df, "doc_id").selectExpr("lang_pred = lang ok").collect()
    assert np.mean([x.ok for x in got]) > 0.9
