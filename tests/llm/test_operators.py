"""Operators on awkward tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import os
import random
import zlib

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

COLUMNS = "doc_id long, text string, source string, kept boolean, size long, component string, sha string, label int, n long"
LONG = " ".join(f"w{i % 997}" for i in range(30000))


def awkward(spark):
    r = random.Random(0)
    base = " ".join(r.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(r.randrange(40)) for _ in range(60))
    near = base.replace(" ", "  ", 3).split()
    near[5] = "changed"
    rows = [(5, base), (3, base + " "), (9, " ".join(near)), (1, None), (2, ""), (7, " \n\t"), (4, "one"), (6, "one"), (6, "one"), (None, "nothing here"), (None, base), (10, LONG), (11, LONG + " tail"), (12, "a b\na b\na b c d e f g h i j"), (13, "Ünï cödé 日本 🎉 \x0b x")]
    return spark.createDataFrame([(i, t, s, None, None, "x", None, None, None) for (i, t), s in zip(rows, ["b", "a", None] * 5, strict=True)], COLUMNS)


def norm(t):
    return "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")


def test_exact_dedup(spark):
    from knotwork.llm.exact_dedup import deduplicate, exact_dedup

    df = awkward(spark)
    rows = [(r["doc_id"], r["text"] or "") for r in df.collect()]
    got = exact_dedup(df).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t), i is None, i))
    want = sorted(((i, min(groups[norm(t)])[2], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows), key=str)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == want
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)
    out = deduplicate(df)
    winner = {}  # of a group's rows: most code points, then ids before none, then the smallest id
    for i, t in rows:
        winner[norm(t)] = min(winner.get(norm(t), (1,)), (-len(t), i is None, i or 0))
    got = sorted(((-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect()))
    assert out.columns == df.columns and got == sorted(winner.values())
    top = 2**63 - 1
    odd = spark.createDataFrame([(4, "one"), (6, "one"), (6, "two"), (6, "t w o"), (6, "two "), (top, "x y"), (None, "xy"), (top, "z")], "doc_id long, text string")
    assert sorted(map(tuple, deduplicate(odd).collect())) == [(4, "one"), (6, "t w o"), (top, "x y"), (top, "z")]
    assert {(r["doc_id"], r["keep_id"]) for r in exact_dedup(odd).collect()} == {(4, 4), (6, 4), (6, 6), (top, top), (None, top)}
    assert exact_dedup(df.limit(0)).count() == 0 and deduplicate(df.limit(0)).count() == 0


def test_runs_of_one_hash():
    """Two texts of one hash: both are told as runs that may go on elsewhere, and null ids and the largest id stay what they are."""
    import pyarrow as pa

    from knotwork.llm.exact_dedup import _runs

    cols = [("a", 1, 1, 5), ("b", None, 1, 7), ("b", 2**63 - 1, 1, 7), ("c", 3, 1, 7), ("d", 4, 1, 8), ("e", 5, 1, 9)]
    whole = pa.record_batch([pa.array(list(x), t) for x, t in zip(zip(*cols, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["norm", "doc_id", "n", "h"])
    for step in (1, 2, 6):
        rows = [r for b in _runs([whole.slice(a, step) for a in range(0, 6, step)]) for r in b.to_pylist()]
        assert [(r["doc_id"], r["keep_id"], r["size"], r["edge"]) for r in rows] == [(1, 1, 1, True), (None, 2**63 - 1, 2, True), (2**63 - 1, 2**63 - 1, 2, True), (3, 3, 1, True), (4, 4, 1, False), (5, 5, 1, True)]


def brute_near(rows, words=2, percent=80):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    low = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    return {i: (len(s), low[i]) for i, s in sets.items()}


def test_near_dedup(spark):
    from knotwork.llm.near_dedup import deduplicate, near_dedup

    df = awkward(spark)
    r = random.Random(4)
    more = []
    for g in range(12):
        w = [f"g{g}x{r.randrange(50)}" for _ in range(r.randrange(20, 120))]
        for k in range(8):
            v = list(w)
            for _ in range(r.randrange(0, 8)):
                v[r.randrange(len(v))] = f"e{r.random()}"
            more.append((100 + 10 * g + k, " ".join(v)))
    every = df.union(spark.createDataFrame([(i, t, *[None] * 7) for i, t in more], COLUMNS))
    rows = [(x["doc_id"], x["text"]) for x in every.collect() if x["doc_id"] is not None]
    want = brute_near(rows)
    got = near_dedup(every, words=2).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got if x["doc_id"] is not None} == want
    assert all(x["kept"] and x["component_id"] is None for x in got if x["doc_id"] is None) and len(got) == every.count()
    assert near_dedup(every.limit(0)).count() == 0
    assert deduplicate(df).columns == df.columns


def edited(r, words, n):
    v = list(words)
    for k in r.sample(range(len(v)), n):
        v[k] = f"e{r.random()}"
    return v


def test_large_nodes_and_families(spark):
    """Whatever fits a leaf, a task or a block: branching, pivots, distributed steps and pairs of blocks find what brute force finds.

    Among the documents are some whose only link is to one that is surely like its node's pivot.
    """
    from knotwork.llm.near_dedup import Limits, near_dedup

    r = random.Random(11)
    hub = [f"h{k}" for k in range(120)]
    members = [edited(r, hub, 2) for _ in range(90)]
    rows = [(i, " ".join(v)) for i, v in enumerate(members + [edited(r, v, 6) for v in members[:50]] + [edited(r, hub, 20) for _ in range(40)])]
    want = brute_near(rows)
    assert 2 < len({c for _, c in want.values()}) < 60
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for limits in (Limits(), Limits(leaf=16), Limits(leaf=16, local=40), Limits(leaf=16, local=40, docs=50), Limits(docs=1000, shingles=2000)):
        got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_dedup(df, words=2, limits=limits).collect()}
        assert got == want, limits


def test_repeated_ids_with_different_texts(spark):
    """Rows of one id are one document, with the links of all its texts."""
    from knotwork.llm.near_dedup import near_dedup

    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    df = spark.createDataFrame([(7, a), (7, b), (7, b), (3, b), (9, a), (11, "c d e")], "doc_id long, text string")
    assert sorted((x["doc_id"], x["component_id"]) for x in near_dedup(df, words=2).collect()) == [(3, 3), (7, 3), (7, 3), (7, 3), (9, 3), (11, 11)]


def test_family_edges_hold_all_candidates():
    """Any two rows of tokens that agree enough are in one family, at every size of leaf."""
    import numpy as np

    from knotwork.llm import near_dedup as nd
    from knotwork.operators.components import forest

    assert nd.FAR - nd.NEAR >= nd.POSITIONS - nd.DOUBT
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 256, (6, nd.POSITIONS), np.uint8)
    tokens = centre[rng.integers(0, 6, 400)]
    change = rng.random(tokens.shape) < rng.choice([0.02, 0.1, 0.3], (400, 1))
    tokens = np.where(change, rng.integers(0, 256, tokens.shape, np.uint8), tokens).astype(np.uint8)
    same = (tokens[:, None] == tokens[None]).sum(2) >= nd.DOUBT
    rep = np.arange(400)
    whole = list(nd._family_edges(5, rep, tokens, 1000))
    names, root = forest(*(np.concatenate(x) for x in zip(*whole, strict=True)))
    exact = dict(zip(names.tolist(), root.tolist(), strict=True))
    i, j = np.nonzero(np.triu(same, 1))
    assert all(exact[a] == exact[b] for a, b in zip(i.tolist(), j.tolist(), strict=True))
    trees = [list(nd._family_edges(s, rep, tokens, 20)) for s in range(nd.TREES)]
    names, root = forest(*(np.concatenate(x) for x in zip(*[e for t in trees for e in t], strict=True)))
    label = dict(zip(names.tolist(), root.tolist(), strict=True))
    assert all(label[a] == label[b] for a, b in zip(i.tolist(), j.tolist(), strict=True))


def test_linked_components_are_exact():
    import numpy as np

    from knotwork.llm.near_dedup import linked_components

    rng = np.random.default_rng(3)
    for trial in range(40):
        base = [rng.integers(0, 60, 20) for _ in range(3)]
        sets = [np.unique(np.concatenate((base[k % 3][rng.random(20) < 0.93], rng.integers(100, 2000, rng.integers(0, 3)), [5]))).astype(np.uint64) for k in range(50)]
        got = linked_components(np.concatenate(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets]))), 80)
        low = list(range(50))
        for _ in sets:
            for i in range(50):
                for j in range(i):
                    n = len(np.intersect1d(sets[i], sets[j]))
                    if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                        low[i] = low[j] = min(low[i], low[j])
        assert got.tolist() == low, trial


def test_mixing(spark):
    from knotwork.llm.mixing import mix, mixed

    rows = [(i, "w " * (1 + (i * 7919) % 97), f"s{i % 4}" if i % 5 else None) for i in range(800)] + [(900, None, "s1"), (901, "", "zz"), (902, "a b", "tiny")]
    df = spark.createDataFrame([(i, t, s, *[None] * 6) for i, t, s in rows], COLUMNS)
    got = mix(df).collect()
    assert len(got) == len(rows) and {(r["doc_id"], r["taken"]) for r in mix(df.repartition(7)).collect()} == {(r["doc_id"], r["taken"]) for r in got}
    of, size, target, taken = dict((i, s) for i, _, s in rows), {}, {}, {}
    for r in got:
        s = of[r["doc_id"]]
        size[s] = size.get(s, 0) + r["size"]
        target[s] = r["target"]
        taken[s] = taken.get(s, 0) + r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    capped = set()
    while True:
        rest = sum(size.values()) - sum(3 * size[s] for s in capped)
        want = {s: 3 * size[s] if s in capped else rest * weight[s] / sum(weight[x] for x in order if x not in capped) for s in order}
        over = {s for s in order if s not in capped and want[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    for s in order:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s]) and abs(taken[s] - want[s]) <= max(3, 0.01 * want[s])
    assert {(r["doc_id"], r["taken"]) for r in mix(df, bucket_size=3).collect()} == {(r["doc_id"], r["taken"]) for r in got}
    clash = df.withColumnsRenamed({"kept": "copies", "size": "id_taken", "n": "copy"})
    assert mixed(clash).columns == clash.columns and mixed(clash).count() == mixed(df).count()
    assert mixed(df).columns == df.columns and mixed(df).count() == sum(r["copies"] for r in got)
    assert mix(df.limit(0)).count() == 0


def test_rules(spark):
    from knotwork.llm.quality_rules import ablation, apply_policy, filter_documents, mask, quality_ledger

    df = awkward(spark)
    ledger = apply_policy(quality_ledger(df))
    rows = {(r["doc_id"], r["n_words"]) for r in ledger.collect()}
    assert {(i, len((t or "").encode().split())) for i, t in ((r["doc_id"], r["text"]) for r in df.collect())} == rows
    assert filter_documents(df).count() == ledger.where("kept").count() and filter_documents(df).columns == df.columns
    a = {r["rule"]: r for r in ablation(ledger).collect()}
    assert a["few_words"]["failed"] == ledger.where("failed & 1 <> 0").count() and mask("base") == 3
    assert quality_ledger(df.limit(0)).count() == 0 and all(r["failed"] == 0 for r in ablation(quality_ledger(df.limit(0))).collect())


def test_token_manifest_is_one_checkpoint_file(spark):
    from pathlib import Path

    from knotwork.llm.token_files import read_token_files, write_token_files
    from knotwork.session import shared_dir

    shared_dir(spark)
    top = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    df = spark.createDataFrame([(i, f"text {i}") for i in range(100)], "doc_id long, text string")
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        before = set(top.rglob("part-*"))
        manifest = write_token_files(df, public_tokenizers.path("byte_bpe_50k.json"))
        assert len(set(top.rglob("part-*")) - before) == 1 < manifest.count()
        assert [r["doc_id"] for r in read_token_files(manifest).orderBy("start").collect()] == list(range(100))
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_tokens(spark):
    from tokenizers import Tokenizer

    from knotwork.llm.pieces import piece_decode, piece_encode
    from knotwork.llm.token_files import read_token_files, write_token_files

    df = awkward(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = read_token_files(write_token_files(df, path)).orderBy("start").collect()
    t = Tokenizer.from_file(path)
    texts = sorted(((r["doc_id"] is not None, r["doc_id"], r["text"] or "") for r in df.collect()), key=lambda x: (x[0], x[1] or 0))
    assert [r["doc_id"] for r in got] == [x[1] for x in texts] and got[0]["start"] == 0
    size = sum(r["n_tokens"] for r in got)
    assert size == sum(len(t.encode(x[2], add_special_tokens=False).ids) + 1 for x in texts)
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:], strict=False))
    long = next(r for r in got if r["doc_id"] == 10)
    ids = t.encode(LONG, add_special_tokens=False).ids + [2]
    assert long["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
    assert read_token_files(write_token_files(df.limit(0), path)).count() == 0
    few = write_token_files(df, path, file_ids=50)
    assert few.count() > 3 and read_token_files(few).orderBy("start").collect() == got
    least = spark.createDataFrame([(-(2**63), "a b"), (None, "c"), (5, "d")], "doc_id long, text string")
    assert [r["doc_id"] for r in read_token_files(write_token_files(least, path)).orderBy("start").collect()] == [None, -(2**63), 5]
    model = public_tokenizers.path("piece_bpe_32k.model")
    enc = piece_encode(df, model)
    assert all(r["round_trip"] for r in enc.collect())
    back = {(r["doc_id"], r["text"]) for r in piece_decode(enc, model).collect()}
    assert back == {(r["doc_id"], r["text"] or "") for r in df.collect()}
    assert piece_encode(df.limit(0), model).count() == 0


def test_n_best_ids(spark, tmp_path):
    """The query and the pipeline's last stage return the ids of all dealt segmentations: each decodes to the text and has its score."""
    import corpus_pipeline
    from knotwork.llm.entry import QUERIES
    from pyspark.sql import functions as F

    from knotwork.llm.pieces import piece_decode, pieces, segmentation

    df = awkward(spark)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    model = public_tokenizers.path("piece_bpe_32k.model")
    p = pieces(model)
    plain = lambda ids: not set(ids) & set(p.byte_id.tolist())
    texts = {(r["doc_id"], r["text"] or "") for r in df.collect()}
    for out in (QUERIES["op3_sentencepiece"](spark, str(tmp_path)), corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path))):
        out = out.select("*", *[segmentation(k).alias(f"ids_{k}") for k in (2, 3, 4)])
        rows = out.collect()
        assert out.where(F.size("changes_2") > 0).count() > 3
        assert len(rows) == df.count() and any(r["ids_4"] for r in rows)
        assert {(r["doc_id"], r["text"]) for r in piece_decode(out, model).collect()} == texts
        for k in (2, 3, 4):
            back = {(r["doc_id"], r["text"]) for r in piece_decode(out, model, ids_col=f"ids_{k}").collect()}
            assert back <= texts and len(back) == len({(r["doc_id"], r["decoded_sha256"]) for r in rows if r[f"ids_{k}"] is not None})
        for r in rows:
            every = [r["ids"], *(r[f"ids_{k}"] for k in (2, 3, 4) if r[f"ids_{k}"] is not None)]
            told = [r["score"], *(r[f"score_{k}"] for k in (2, 3, 4) if r[f"score_{k}"] is not None)]
            assert len(every) == len(told) == len({tuple(x) for x in every}) and r["n_pieces"] == len(r["ids"])
            for ids, score in zip(every, told, strict=True):
                if plain(ids):
                    assert abs(sum(float(p.score[i]) for i in ids) - score) < 1e-6 * max(1, abs(score))


def test_pipeline_on_awkward_tables(spark, tmp_path):
    """Nulls, repeated rows, empty texts, clashing columns and an empty table through all stages; every text left is encoded."""
    import corpus_pipeline
    from knotwork.llm.pieces import piece_decode

    r = random.Random(9)
    prose = [" ".join(f"{r.choice('alpha beta gamma delta some other words of plain prose'.split())}{r.randrange(90)}" for _ in range(60)) + "." for _ in range(30)]
    rows = [*[(i, t) for i, t in enumerate(prose)], (40, prose[0]), (41, prose[1] + " "), (42, prose[2].replace(" ", "  ", 1) + " tail"), (5, prose[5]), (None, prose[7]), (None, "x"), (50, None), (51, "")]
    names = "doc_id long, text string, source string, copies boolean, size long, component string, sha string, label int, n long"
    docs = spark.createDataFrame([(i, t, f"s{(i or 0) % 3}" if i != 3 else None, None, None, "x", None, None, None) for i, t in rows], names)
    for k, table in enumerate((docs, docs.limit(0))):
        table.write.parquet(f"{tmp_path}/{k}/documents.parquet")
        now = spark.read.parquet(f"{tmp_path}/{k}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, f"{tmp_path}/{k}")
            assert now.columns == docs.columns, name
        left = sorted(x["text"] for x in now.collect())
        out = corpus_pipeline.run(spark, f"{tmp_path}/{k}")
        assert sorted(x["text"] for x in piece_decode(out, public_tokenizers.path("piece_bpe_32k.model")).collect()) == left
        found = {norm(t) for t in left}
        assert found == set() if k else 10 < len(found) <= 30 and not found - {norm(t) for _, t in rows}


def test_pages_and_licenses(spark):
    from knotwork.llm.license_scan import license_scan
    from knotwork.llm.page_text import extract_pages

    pages = spark.createDataFrame([(1, "u", None, "t"), (2, None, "", "t"), (None, "u", "<p>x", "t"), (3, "u", "<article><p>" + "word " * 20000 + "</article>", "t")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in extract_pages(pages).collect()}
    assert got[1]["text"] == got[2]["text"] == "" and got[3]["n_chars"] == 5 * 20000 - 1 and len(got) == 4
    assert extract_pages(pages.limit(0)).count() == 0
    docs = awkward(spark)
    assert license_scan(docs).count() == 0 and license_scan(docs.limit(0)).count() == 0
    note = "Licensed under CC BY 4.0."
    some = spark.createDataFrame([(None, note, "a"), (5, "x " + note, "b"), (5, "x " + note, "b"), (6, None, None), (7, note + " " + note, "")], "doc_id long, text string, license string")
    assert sorted(((r["doc_id"] or 0, r["start_char"], r["end_char"]) for r in license_scan(some).collect())) == [(0, 0, 24), (5, 2, 26), (5, 2, 26), (7, 0, 24), (7, 26, 50)]


def test_classifiers(spark):
    from knotwork.llm.line_quality import line_quality
    from knotwork.llm.toxicity import toxicity

    docs, none = awkward(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for f in (toxicity, line_quality):
        for r in f(docs, none).collect():
            assert 0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 5 == 0)
        assert f(docs.limit(0), none).count() == 0


def held_out_share(spark, query, column):
    d = "/root/testdata/sf0.01"
    r = query(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select(column, "predicted").collect()
    return sum(x[0] == x[1] for x in r) / len(r)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_toxicity_held_out_accuracy(spark):
    from knotwork.llm.toxicity import op6_toxicity

    assert held_out_share(spark, op6_toxicity, "toxic") >= 0.95


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_quality_held_out_accuracy(spark):
    from knotwork.llm.line_quality import op9_line_quality

    assert held_out_share(spark, op9_line_quality, "quality") >= 0.93


def test_classifiers_fit_awkward_rows(spark):
    """Null labels and ids, repeated rows and labels, empty texts and clashing columns, with labels enough to fit."""
    from knotwork.llm.line_quality import line_quality
    from knotwork.llm.toxicity import toxicity

    r = random.Random(3)
    rows = [(i, " ".join(r.choice("good plain calm word text line".split()) for _ in range(30)) + (" you total moron" if i % 3 == 0 else ""), i % 3 == 0) for i in range(300)]
    extra = [(None, "you total moron", None), (7, "", None), (8, None, None), *rows[:5]]
    docs = spark.createDataFrame([(i, t, "s", True, 1, "c", "x", 1, 2) for i, t, _ in rows + extra], COLUMNS)
    labels = spark.createDataFrame([(i, int(not y), int(y)) for i, _, y in rows] + [(None, 1, 1), (3, None, None), (4, 0, 0)], "doc_id long, quality int, toxic int")
    got = toxicity(docs, labels).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= x["score"] <= 1 for x in got)
    said = {x["doc_id"]: x["predicted"] for x in got}
    assert all(said[i] == int(y) for i, _, y in rows if i not in (7, 8)) and said[None] == 1
    assert line_quality(docs, labels).count() == len(got)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_pipeline_and_oracles(spark):
    import duckdb

    import corpus_pipeline
    from knotwork.llm.entry import ORACLES, QUERIES

    d = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, d)
    assert out.count() > 0 and out.where("not round_trip").count() == 0
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{d}/documents.parquet'")
    for name, sql in ORACLES.items():
        got, want = QUERIES[name](spark, d).toPandas(), c.execute(sql).df()
        rows = lambda x: sorted(map(repr, x[sorted(x.columns)].itertuples(index=False, name=None)))
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want), name
