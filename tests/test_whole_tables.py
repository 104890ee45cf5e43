"""Queries over plain tables take every row: all languages, lengths and sources."""

import pytest

from knotwork.plans.catalog import QUERIES

WORDS = [["red", "apple", "tree"], ["blue", "boat", "sea"], ["grüne", "wiese", "haus"]]
ROWS = [(i, " ".join(WORDS[i % 3] * (900 if i % 4 == 0 else 3)), ["en", "fr", "de"][i % 3], f"src{i % 9}") for i in range(24)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rows = [(*r, len(r[1])) for r in ROWS]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    return d


def test_topics(spark, folder, monkeypatch):
    from knotwork.operators import learning

    sizes, fit = [], learning.topics

    def kept(*a, **b):
        out = fit(*a, **b)
        sizes.append(len(out.first()["topics"]))
        return out

    monkeypatch.setattr(learning, "topics", kept)
    got = QUERIES["topics_lda"](spark, folder).collect()
    assert sorted(r["doc_id"] for r in got) == [r[0] for r in ROWS] and sizes == [20]
    assert all(1 / 20 <= r["strongest"] <= 1 for r in got)


def test_selected(spark, tmp_path):
    import hashlib
    import re

    rows = [(1, "No. One with it. Next one! Far off. Farther.", "en"), (2, "Rien. Avec with moi. Fin.", "fr"), (3, "Nothing here.", "en"), (4, "Filler one. " * 400 + "Here with us. End.", "de"), (5, "Same with. Same with. Other.", "es")]
    spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for i, t, _ in rows:
        s = [x for x in re.sub(r"([.!?])\s+", "\\1\x01", t.strip()).split("\x01") if x]
        near = [x for k, x in enumerate(s) if any("with" in y for y in s[max(k - 1, 0) : k + 2])]
        if near:
            want[i] = hashlib.md5(" ".join(dict.fromkeys(near)).encode()).hexdigest()
    assert sorted(want) == [1, 2, 4, 5]
    assert {r["doc_id"]: r["digest"] for r in QUERIES["text_selected"](spark, str(tmp_path)).collect()} == want


def test_weights_and_pairs(spark, folder):
    import math
    import re
    from collections import Counter

    counts = {i: Counter(re.findall(r"[a-zA-Z0-9_]{2,}", t.lower())) for i, t, *_ in ROWS}
    held = Counter(w for c in counts.values() for w in c)
    idf = {w: math.log((1 + len(counts)) / (1 + n)) + 1 for w, n in held.items() if 2 <= n <= 0.8 * len(counts)}
    w = {}
    for i, c in counts.items():
        raw = {x: n * idf[x] for x, n in c.items() if x in idf}
        size = math.sqrt(sum(v * v for v in raw.values()))
        w[i] = {x: v / size for x, v in raw.items()}
    got = {(r["block"], r["rid"], r["term"]): r["w"] for r in QUERIES["tfidf_weights"](spark, folder).collect()}
    want = {(s, i, x): v for i, _, _, s in ROWS for x, v in w[i].items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)
    block = {r[0]: r[3] for r in ROWS}
    want = {(a, b): v for a in w for b in w if a < b and block[a] == block[b] and (v := sum(x * w[b].get(k, 0) for k, x in w[a].items())) > 0.2}
    got = {(r["src"], r["dst"]): r["sim"] for r in QUERIES["tfidf_cosine_pairs"](spark, folder).collect()}
    assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in want)


def test_replaced_names(spark, folder):
    assert sorted(r["doc_id"] for r in QUERIES["text_replace_name"](spark, folder).collect()) == [r[0] for r in ROWS]
