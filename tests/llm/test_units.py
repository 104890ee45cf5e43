"""Operators of the llm subpackage without Spark: brute force, round trips, held-out accuracy."""

import itertools

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_shingles_are_exact():
    from knotwork.llm.shingles import shingle_sets

    texts = ["The cat the CAT the cat", "", "one", "a\tb\nc  d", "É x É x", None]
    for k in (1, 2, 5):
        _, at = shingle_sets(pa.array(texts), k)
        for i, t in enumerate(texts):
            w = (t or "").encode().lower().split()
            want = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
            assert at[i + 1] - at[i] == len(want)


def test_token_files_round_trip():
    from tokenizers import Tokenizer

    from knotwork.llm.token_files import DacFile, WordEncoder, dac_encode

    rng = np.random.default_rng(0)
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, plain = WordEncoder(path), Tokenizer.from_file(path)
    parts = ["a", "foo", " ", "\n", "\t", "  ", "1", "it's", "!", "<|endoftext|>", "é", " \n", "日本", "\x1c", "\x85", ".", "Bar", "...", "|", "×", "…"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(3000)] + [""]
    ids, at = own.encode(pa.array(texts))
    for i, e in enumerate(plain.encode_batch(texts, add_special_tokens=False)):
        assert ids[at[i] : at[i + 1]].tolist() == e.ids, texts[i]
    for n in (0, 1, 5, 3000):
        x = np.minimum(2 ** (rng.random(n) * 16), 50256).astype(np.uint32)
        f = DacFile(dac_encode(x, np.array([7]), np.array([0, n])))
        assert (f.all() == x).all() and all(f.get(i) == x[i] for i in rng.integers(0, n, 50).tolist()) if n else len(f.all()) == 0
        for _ in range(40):
            a, b = sorted(rng.integers(0, n + 1, 2).tolist())
            assert (f.slice(a, b) == x[a:b]).all()
    read = []

    class Source:
        def read_at(self, n, at):
            read.append(n)
            return raw[at : at + n]

    x = np.minimum(2 ** (rng.random(200_000) * 16), 50256).astype(np.uint32)
    raw = dac_encode(x, np.array([7]), np.array([0, len(x)]))
    f = DacFile(Source())
    read.clear()
    assert f.get(123_456) == x[123_456] and sum(read) < 600


def test_token_files_new_words_and_packing_are_cheap():
    import tracemalloc

    from knotwork.llm.token_files import WordEncoder, _pack, _unpack, safe_cuts

    own = WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    given, encode = [], own._encode
    own._encode = lambda texts: given.append(len(texts)) or encode(texts)
    words = [w.encode() for w in (*(f" w{chr(97 + i % 26)}{i}" for i in range(20_000)), " 's", "'s", "é", " 日本", ".", "…|", "\u0301a", " ", "\n", " \n", "\x85", "a\x1c", "x" * 900)]
    slots = own.words(words)
    assert sum(given) < 200  # the library is given lines of words and not 20,000 texts
    for w, k in zip(words, slots.tolist(), strict=True):
        assert own.pool[own.first[k] :][: own.size[k]].tolist() == encode([w.decode()])[0], w
    assert (own.words(words[::-1]) == slots[::-1]).all()
    small = WordEncoder(public_tokenizers.path("byte_bpe_50k.json"), most=50)
    for a in range(0, 400, 30):  # words are forgotten and met again
        some = words[a % 120 : a % 120 + 40]
        for w, k in zip(some, small.words(some).tolist(), strict=True):
            assert small.pool[small.first[k] :][: small.size[k]].tolist() == encode([w.decode()])[0]
        assert len(small.slot) <= 50
    for some in ([b"a\n", b"b"], [b"\xc2\xa0a", b"b"]):  # a piece spans two lines: each word by itself
        assert [x.tolist() for x in own._lines(some)] == [x.tolist() for x in own._each(some)]
    rng = np.random.default_rng(1)
    for width in range(1, 33):
        for n in (0, 1, 7, 8, 9, 70_003):
            v = rng.integers(0, 1 << width, n).astype(np.uint32)
            bits = ((v[:, None] >> np.arange(width, dtype=np.uint32)) & 1).astype(np.uint8)
            raw = _pack(v, width)
            assert raw.tobytes() == np.packbits(bits, bitorder="little").tobytes() and (_unpack(raw, width, n) == v).all()
    v = rng.integers(0, 1 << 9, 1 << 19).astype(np.uint32)
    tracemalloc.start()
    raw = _pack(v, 9)
    assert tracemalloc.get_traced_memory()[1] < 3 * v.nbytes
    tracemalloc.stop()
    for t in ("", "a", "\n", ".", "a.", "a\nb", "\na", "é.b", "Ã.", "×.", "a\n", "é\nb"):
        raw = np.frombuffer(t.encode(), np.uint8)
        whole = encode([t])[0]
        at = [*safe_cuts(raw, np.array([0, len(raw)])).tolist(), len(raw)]
        assert sum((encode([t.encode()[a:b].decode()])[0] for a, b in itertools.pairwise(at)), []) == whole


def test_pieces_n_best_is_exact():
    from knotwork.llm.pieces import Pieces

    p = Pieces(public_tokenizers.path("piece_bpe_32k.model"))

    def every(unit):
        out = []

        def go(i, score):
            if i == len(unit):
                out.append(score)
                return
            for j in range(i + 1, len(unit) + 1):
                k = p.ids.get(unit[i:j])
                if k is not None:
                    go(j, score + p.score[k])
            if unit[i] not in p.ids:
                go(i + 1, score + p.fallback)

        go(0, 0.0)
        return sorted(out, reverse=True)

    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("atheion é\n日▁ "), rng.integers(0, 10))) for _ in range(150)] + ["", "  two  spaces  "]
    ids, at, scores = p.encode(pa.array(texts))
    raw, ends = p.decode(ids, at)
    for i, t in enumerate(texts):
        assert raw[ends[i] : ends[i + 1]].tobytes().decode() == t
        if len(t) < 10:
            assert [x for x in scores[i] if x == x] == every(" " + t)[:4]


def test_chain_marginals():
    from knotwork.llm.line_quality import forward_backward

    rng = np.random.default_rng(0)
    u, t = rng.normal(size=5), rng.normal(size=(2, 2))
    p, z = np.zeros(5), 0.0
    for y in itertools.product((0, 1), repeat=5):
        s = np.exp(sum(u[i] * y[i] for i in range(5)) + sum(t[y[i], y[i + 1]] for i in range(4)))
        p, z = p + s * np.array(y), z + s
    assert np.allclose(forward_backward(u, np.array([0, 5]), t)[0], p / z)


def test_tree_marginals():
    from knotwork.llm.page_text import marginals

    rng = np.random.default_rng(0)
    parent = np.array([-1, 0, 0, 1, 1, 2])
    u, q = rng.normal(size=(6, 2)), rng.normal(size=(6, 2, 2))
    p, z = np.zeros(6), 0.0
    for y in itertools.product((0, 1), repeat=6):
        s = np.exp(sum(u[i, y[i]] for i in range(6)) + sum(q[i, y[parent[i]], y[i]] for i in range(1, 6)))
        p, z = p + s * np.array(y), z + s
    assert np.allclose(marginals(u, q, parent)[0], p / z)


def test_pages():
    from knotwork.llm.page_text import _WHITE, labelled_pages, main_text, parse, trained

    w, q = trained()
    wrong = 0
    for source in labelled_pages(60, seed=99):
        nodes, stream = parse(source)
        y = [0] * len(nodes)
        for i in range(1, len(nodes)):
            y[i] = nodes[i].label if nodes[i].label is not None else y[nodes[i].parent]
        blocks, now = [], []
        for i, s in [*stream, (0, None)]:
            if s is None:
                t = _WHITE.sub(" ", "".join(now)).strip()
                blocks += [t] if t else []
                now = []
            elif y[i]:
                now.append(s)
        wrong += main_text(source, w, q) != "\n\n".join(blocks)
    assert wrong <= 3
    page = "<html><body><nav><ul><li><a href=/>x</a></ul></nav><article><h1>A &amp; B</h1><p>one\n two<br>three<p>f&eacute;</article><footer>&copy; z</footer>"
    assert main_text(page, w, q) == "A & B\n\none two three\n\nfé"
    assert main_text("", w, q) == ""


def test_hostile_pages_take_time_in_proportion():
    import time

    from knotwork.llm.page_text import main_text, parse, trained

    w, q = trained()
    for source in ("<b>x" * 100_000, "<div>x" * 50_000, "<p><table>" * 20_000 + "x", "</b>" * 200_000, "<li>x" * 50_000, "<" * 200_000, "<a b='" * 30_000, '<a "' * 30_000 + "'>", "<script>" + "</script" * 100_000, "<!" * 100_000, "<a" * 100_000, "<a" * 100_000 + " '"):
        began = time.time()
        main_text(source, w, q)
        assert time.time() - began < 20, source[:9]
    nodes, stream = parse("<b>x" * 2000)
    assert "".join(s for _, s in stream if s) == "x" * 2000 and len(nodes) == 2001


def test_misspellings_and_context():
    from knotwork.llm.toxicity import EXACT, FUZZY, PRIOR, STEM, Lexicon, sigmoid, text_features

    lex = Lexicon(["idiot", "loser", "moron", "lowei-", "scum"])
    got = dict(zip(words := "idiot idoit idiiot idot adiot closer lser moron morno mroon loweixyz lowexi scum scumm xyz".split(), lex.match(words).tolist(), strict=True))
    assert got == {"idiot": EXACT, "idoit": FUZZY, "idiiot": FUZZY, "idot": FUZZY, "adiot": FUZZY, "closer": FUZZY, "lser": FUZZY, "moron": EXACT, "morno": FUZZY, "mroon": FUZZY, "loweixyz": STEM, "lowexi": 0, "scum": EXACT, "scumm": 0, "xyz": 0}
    score = sigmoid(text_features(pa.array(["you are an idiot", 'he said the word "idiot" is an insult', "a fine day", "what an 1d1ot", ""]), lex) @ PRIOR)
    assert score[0] > 0.5 and score[3] > 0.1 and max(score[1], score[2], score[4]) < 0.05


def test_automaton_against_brute_force_edits():
    """Every word within one edit (swaps included) of a long term, and no other, is a misspelling."""
    from knotwork.llm.toxicity import EXACT, FUZZY, STEM, Lexicon

    def near(a, b):
        if a == b:
            return True
        if len(a) == len(b):
            d = [i for i in range(len(a)) if a[i] != b[i]]
            return len(d) == 1 or len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]]
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    rng = np.random.default_rng(6)
    terms = ["abcab", "bacca", "aabbcc", "cab", "ccba-", "abcde"]
    words = sorted({"".join(rng.choice(list("abcdx"), rng.integers(2, 9))) for _ in range(6000)} | {t[:i] + c + t[j:] for t in terms for i in range(len(t)) for j in (i, i + 1) for c in "abx"} | {t[:i] + t[i : i + 2][::-1] + t[i + 2 :] for t in terms for i in range(len(t))})
    words = [w for w in words if w and "-" not in w]
    got = Lexicon(terms).match(words).tolist()
    for w, g in zip(words, got, strict=True):
        exact, stem = w in terms, w.startswith("ccba")
        fuzzy = any(near(w, t) for t in terms if len(t) >= 5 and not t.endswith("-"))
        assert g == (EXACT if exact else STEM if stem else FUZZY if fuzzy else 0), w


def test_look_alikes_and_chance_terms():
    from knotwork.llm.toxicity import beyond_chance, choose_terms, plain

    assert [plain(w) for w in ("$tupid", "1d10t!", "|diot,", "(Word)", "100", "$5", "end!!", "l0ser|")] == ["stupid", "idiot", "idiot", "word", "100", "$5", "end", "loser"]
    assert not beyond_chance(3, 3, 45, 329, 20000) and beyond_chance(9, 9, 45, 329, 20000) and not beyond_chance(5, 5, 0, 9, 5) and not beyond_chance(5, 5, 9, 9, 5)
    assert choose_terms([("often", 12, 12), ("chance", 3, 3)], 45, 329, tried=20000) == ["often"]


def test_context_window_against_brute_force():
    """A hit counts as quoted if a reporting word or a pair of quotation marks stands around it, six words to either side."""
    from knotwork.llm.toxicity import REPORTING, WINDOW, Lexicon, text_features

    rng = np.random.default_rng(8)
    lex, pool = Lexicon(["moron"]), ["moron", "said", "a", "b", "c", "d", "e", "f", "\"g", "h\"", "you"]
    for _ in range(300):
        words = rng.choice(pool, rng.integers(1, 30)).tolist()
        quoted = plain_hits = 0
        for i, w in enumerate(words):
            if w == "moron":
                lo, hi = max(0, i - WINDOW), i + WINDOW + 1
                marks = any(x == '"g' for x in words[lo : i + 1]) and any(x == 'h"' for x in words[i:hi])
                if marks or any(x in REPORTING for x in words[lo:hi]):
                    quoted += 1
                else:
                    plain_hits += 1
        x = text_features(pa.array(["x", " ".join(words)]), lex)[1]
        assert np.allclose([x[1], x[7]], np.log1p([plain_hits, quoted]))


def test_licenses():
    from knotwork.llm.license_scan import TEMPLATES, scan_texts

    rows = scan_texts(pa.array(["foo Released under the MIT License. bar", "x " + TEMPLATES["MIT"].replace("Software", "Program", 2) + " y", None, "", "no licence here"]))
    assert [(r[0], r[1]) for r in rows] == [(0, "MIT-notice"), (1, "MIT")] and rows[0][5:] == (4, 34) and rows[1][2] > 0.98


def test_repeated_notices():
    """Every occurrence of a notice is told with its own span, as a search for the plain sentence finds them."""
    import re

    from knotwork.llm.license_scan import TEMPLATES, scan_texts

    rng = np.random.default_rng(4)
    notes = ["All-rights-reserved", "CC-BY-4.0-notice", "MIT-notice", "GPL-3.0-notice"]
    for _ in range(60):
        parts, text = [], ""
        for name in rng.choice([*notes, ""], rng.integers(1, 9)).tolist():
            filler = " ".join(rng.choice(["lorem", "ipsum", "dolor", "é"], rng.integers(0, 4)))
            text += (filler + " " if filler else "") + (TEMPLATES[name] + " " if name else "")
        for name in notes:  # without the full stop, which is no word
            parts += [(m.start(), m.end(), name) for m in re.finditer(re.escape(TEMPLATES[name].rstrip(".")), text)]
        got = sorted((r[5], r[6], r[1]) for r in scan_texts(pa.array([text])))
        assert got == sorted(parts), text
    assert [r[5:] for r in scan_texts(pa.array(["All rights reserved. " * 5]))] == [(21 * k, 21 * k + 19) for k in range(5)]
    assert len(scan_texts(pa.array([None, "", "All rights reserved. " * 20000]))) == 20000


def test_alignment_against_brute_force():
    from knotwork.llm.license_scan import align, winnow

    rng = np.random.default_rng(12)
    for _ in range(200):
        t, r = rng.integers(1, 5, rng.integers(1, 7)), rng.integers(1, 5, rng.integers(1, 9))
        best = 0
        for k in range(len(t), 0, -1):
            subs = {tuple(t[list(c)]) for c in itertools.combinations(range(len(t)), k)}
            ends = [(c[0], -c[-1]) for c in itertools.combinations(range(len(r)), k) if tuple(r[list(c)]) in subs] if k <= len(r) else []
            if ends:
                best = (k, max(ends)[0], -max(e for e in ends if e[0] == max(ends)[0])[1])
                break
        got = align(t, r, 0, band=20)
        assert got == best if best else got[0] == 0
        g = rng.integers(0, 50, rng.integers(1, 12)).astype(np.uint64)
        for w in (2, 3):
            k = min(w, len(g))
            want = {max(i for i in range(a, a + k) if g[i] == g[a : a + k].min()) for a in range(len(g) - k + 1)}
            assert set(winnow(g, w).tolist()) == want


def test_repeated_words():
    from knotwork.llm.quality_rules import coded_words, repeated_words
    from knotwork.llm.common import utf8_buffers

    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(list("abc"), rng.integers(0, 30))) for _ in range(100)]
    raw, offs = utf8_buffers(pa.array(texts))
    blank = np.isin(raw, [9, 10, 11, 12, 13, 32])
    code, doc = coded_words(raw, offs, blank)
    hit = np.bincount(doc[repeated_words(code, doc, len(texts))], minlength=len(texts))
    for i, t in enumerate(texts):
        w = t.split()
        grams = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
        covered = {j + k for j, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
        assert hit[i] == len(covered)
