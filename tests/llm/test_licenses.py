import hashlib
import re

from spanloom.llm import licenses as L


def brute(t):
    x = (t or "").lower()
    x = re.sub(L.COPYRIGHT, " ", x)
    x = re.sub(L.RESERVED, " ", x)
    x = re.sub(r"[\W_]+", " ", x).strip()
    for a, b in L.SPELLINGS:
        x = x.replace(a, b)
    return hashlib.sha256(x.encode()).hexdigest()


def test_variants_meet(spark):
    mit, bsd = L.KNOWN[0][1], L.KNOWN[1][1]
    rows = [
        (1, mit), (2, mit.upper().replace("LICENSE", "Licence").replace("\n\n", "\n")), (3, "Copyright (c) 2019 Jane Doe\nAll rights reserved.\n\n" + bsd),
        (4, "© 2020-2024, Ünal\n" + bsd.replace(",", " ,")), (5, mit + " And more."), (6, None), (7, ""), (8, "prose\nReleased under the MIT Licence!\nmore\nLicensed under CC BY-NC 4.0"),
        (8, "other text"), (9, "x " * 200_000), (None, mit), (1, mit), (10, "été\nCOPYRIGHT notice of nothing"),
    ]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, digest string")
    got = L.scan(df).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id or 0, r.digest) for r in got) == sorted((i or 0, brute(t)) for i, t in rows)
    lic = {(r.doc_id, r.license_id) for r in got}
    assert {(1, "MIT"), (2, "MIT"), (3, "BSD-2-Clause"), (4, "BSD-2-Clause"), (5, None), (6, None), (7, None), (None, "MIT")} <= lic
    assert {r.notices for r in got if r.doc_id == 8} == {"", "CC-BY-NC-4.0,MIT"}
    assert L.scan(df.limit(0)).count() == 0
