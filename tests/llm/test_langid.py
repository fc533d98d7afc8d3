import random

import numpy as np

from pitchlake.llm import langid

SYLLABLES = {"xx": "ka ro mi ten sul", "yy": "öst äng ür schl ein", "zz": "ção não ela ria que"}


def texts(lang, n, seed):
    rng = random.Random(seed)
    parts = SYLLABLES[lang].split()
    return [" ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 60))) for _ in range(n)]


def test_held_out_accuracy_and_edges(spark, make):
    rows, langs = [], []
    for lang in SYLLABLES:
        for t in texts(lang, 60, lang):
            rows.append((len(rows), t))
            langs.append(lang)
    rows += [(1000, None), (1001, ""), (1002, "123 !? ²"), (None, texts("xx", 1, 5)[0]), (1003, texts("yy", 1, 9)[0] * 2000)]
    langs += [None] * 5
    docs = make(rows, langs)
    model = langid.fit(docs)
    got = langid.predict(docs.select("doc_id", "text", langid.fold().alias("held_out")), model).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    held = [i for i in range(180) if by[i]["held_out"]]
    assert len(held) > 20 and np.mean([by[i]["lang_pred"] == langs[i] for i in held]) > 0.97
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert by[None]["lang_pred"] == "xx" and by[1003]["lang_pred"] == "yy"
    assert all(0 <= r["score"] <= 1 for r in got)


def test_pieces_do_not_change_scores(monkeypatch):
    rng = np.random.default_rng(0)
    model = langid.Model(["a", "b"], rng.standard_normal((1 << langid.BITS, 2)).astype("f4"), np.zeros(2))
    batch = texts("xx", 20, 3)
    whole = model.predict(batch)
    monkeypatch.setattr(langid, "PIECE", 37)
    again = model.predict(batch)
    assert whole[0] == again[0] and np.allclose(whole[1], again[1])


def test_no_labels(make):
    docs = make([(1, "abc"), (2, None)])
    assert {r["lang_pred"] for r in langid.predict(docs.select("doc_id", "text"), langid.fit(docs)).collect()} == {"und"}
    assert langid.predict(docs.limit(0).select("doc_id", "text"), langid.fit(docs.limit(0))).count() == 0
