"""Toxicity by a lexicon met with misspellings, and the context of each hit.

Terms (whole words and stems) are learned from labelled rows, with a bar for how many terms are tried, so that words which
toxic rows hold by chance stay out. The lexicon is a trie; its product with a Levenshtein automaton of one edit
(insertion, deletion, substitution or swap, anywhere in terms of five letters or more; stems and shorter terms take no
edit; look-alike digits and signs are read as letters) is determinised once, so every distinct word of a batch is matched
by table lookups, all words together. Each hit is weighed by its context window: inside quotation marks, or near words of reporting or negation, it
counts as quoted and not as abuse. A logistic fit on the hits' counts gives the score.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import cut, digest_input, folds, prepare, slices, table, tidy, utf8_buffers
from knotwork.llm.labelled import fit_logistic, labelled_sample, sigmoid

#: ``CHANCE``: how likely one chance word among all words tried may be taken for a term.
SAMPLE, TERMS, WINDOW, LONGEST, CHANCE = 8000, 96, 6, 24, 0.05
#: Signs read as letters, words that report or discuss, words that address someone.
LOOKALIKE = dict(zip("013457@$!|", "oieastasii", strict=True))
MARKS = ".,;:?\"'()[]{}<>«»“”„‘’*_~#%&-–—…"
REPORTING = frozenset("said says say called calls wrote writes word words term terms quote quoted quotes phrase slur slurs insult insults uses used using mentions mentioned meaning means defined dit appelé mot terme sagte nannte wort begriff dijo llamó palabra término".split())
ADDRESS = frozenset("you your youre yourself u ur du dich dir dein tu te toi ton vous tú ti usted".split())
FEATURES = ("bias", "log_abuse", "any_abuse", "log_stem", "any_stem", "log_fuzzy", "any_fuzzy", "log_quoted", "any_quoted", "density", "addressed")
#: Where labels say little (misspelt or quoted hits are rare among them) the fit stays near these.
PRIOR = np.array([-5.0, 1.0, 4.0, 1.0, 3.0, 1.0, 2.0, 0.2, 0.3, 1.0, 0.5])
STRENGTH = np.array([0.01, 0.3, 0.3, 0.3, 0.3, 1.0, 1.0, 3.0, 3.0, 0.5, 1.0])
EXACT, STEM, FUZZY = 3, 2, 1


def plain(word: str) -> str:
    """Lower case, outer marks removed, look-alikes as letters (unless the word is a number). Signs at the front may be letters."""
    w = word.lower().strip(MARKS).rstrip(MARKS + "!|").lstrip("¡")
    if any(c in LOOKALIKE for c in w) and any(c.isalpha() for c in w):
        w = "".join(LOOKALIKE.get(c, c) for c in w)
    return w


class Lexicon:
    """Determinised product of the terms' trie with the one-edit automaton; a trailing ``-`` marks a stem."""

    def __init__(self, terms: list[str]):
        self.terms = sorted(set(terms))
        children: list[dict[str, int]] = [{}]
        ends: list[int] = [0]  # 0 none, EXACT word, STEM stem
        for t in self.terms:
            stem, t = t.endswith("-"), t.rstrip("-")
            at = 0
            for c in t:
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    ends.append(0)
                at = children[at][c]
            ends[at] = max(ends[at], STEM if stem else EXACT)
        depth = [0] * len(children)
        longest = [0] * len(children)
        for i, kids in enumerate(children):
            for k in kids.values():
                depth[k] = depth[i] + 1
        for i in range(len(children) - 1, -1, -1):
            longest[i] = max([depth[i] if ends[i] else 0, *(longest[k] for k in children[i].values())])
        letters = sorted({c for kids in children for c in kids})
        self.letters = {c: i + 1 for i, c in enumerate(letters)}  # class 0: any other character
        classes = [None, *letters]
        # NFA states: (node, edits, swap) where swap is the letter still owed after a swap began, and "stem" once one is met.
        def close(states):
            out = set(states)
            for node, e, owed in states:  # a deletion goes down without reading; only in long terms
                if node != "stem" and e == 0 and owed is None:
                    out.update((k, 1, None) for k in children[node].values() if longest[k] >= 5)
            return frozenset(out)

        def move(states, c):
            new = set()
            for node, e, owed in states:
                if node == "stem":
                    new.add((node, e, owed))
                    continue
                kids = children[node]
                if owed is not None:
                    if c == owed[0]:
                        new.add((owed[1], 1, None))
                    continue
                if c in kids:
                    k = kids[c]
                    new.add((k, e, None))
                    if ends[k] == STEM and e == 0:
                        new.add(("stem", 0, None))
                if e == 0:
                    if longest[node] >= 5:
                        new.add((node, 1, None))  # an inserted character
                        new.update((k, 1, None) for x, k in kids.items() if x != c and longest[k] >= 5)
                    for x, k in kids.items():  # a swap: the next but one letter comes first
                        if c in children[k] and longest[k] >= 5 and x != c:
                            new.add((node, 1, (x, children[k][c])))
            return close(new)

        def verdict(states) -> int:
            best = 0
            for node, e, owed in states:
                if node == "stem":
                    best = max(best, STEM)
                elif owed is None and ends[node]:
                    if e == 0:
                        best = max(best, ends[node])
                    elif depth[node] >= 5 and ends[node] == EXACT:
                        best = max(best, FUZZY)
            return best

        start = close({(0, 0, None)})
        index = {frozenset(): 0, start: 1}
        todo, rows, accept = [start], {0: [0] * len(classes)}, {0: 0}
        while todo:
            s = todo.pop()
            accept[index[s]] = verdict(s)
            row = []
            for c in classes:
                t = move(s, c)
                if t not in index:
                    index[t] = len(index)
                    todo.append(t)
                row.append(index[t])
            rows[index[s]] = row
        self.next = np.array([rows[i] for i in range(len(index))], np.int32)
        self.accept = np.array([accept[i] for i in range(len(index))], np.int8)

    def match(self, words: list[str]) -> np.ndarray:
        """EXACT, STEM, FUZZY or 0 for each word."""
        k = len(words)
        size = np.fromiter(map(len, words), np.int64, k)
        short = np.flatnonzero((size > 0) & (size <= LONGEST))
        joined = "".join(words[i] for i in short)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        classes = np.zeros(max(int(points.max(initial=0)), max(map(ord, self.letters), default=0)) + 1, np.int32)
        for c, i in self.letters.items():
            classes[ord(c)] = i
        code = classes[points]
        at = np.cumsum(size[short]) - size[short]
        state = np.ones(len(short), np.int32)
        live = np.arange(len(short))
        for step in range(LONGEST):
            live = live[(size[short][live] > step) & (state[live] != 0)]
            if not len(live):
                break
            state[live] = self.next[state[live], code[at[live] + step]]
        out = np.zeros(k, np.int8)
        out[short] = self.accept[state]
        for i in np.flatnonzero(size > LONGEST).tolist():  # long words: the same automaton, one by one
            s = 1
            for c in words[i]:
                s = self.next[s, self.letters.get(c, 0)]
                if not s:
                    break
            out[i] = self.accept[s]
        return out


def _candidates(batches):
    """(term, toxic documents, documents) counts of words and stems for labelled texts."""
    toxic, every = Counter(), Counter()
    for b in batches:
        for text, label in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            words = {w for w in map(plain, set(text.split())) if 3 <= len(w) <= LONGEST and w.isalpha()}
            terms = words | {w[:k] + "-" for w in words for k in (4, 5, 6) if len(w) > k}
            every.update(terms)
            if label:
                toxic.update(terms)
    if every:
        names = list(toxic)
        yield pa.record_batch([pa.array(names, pa.string()), pa.array([toxic[t] for t in names], pa.int64()), pa.array([every[t] for t in names], pa.int64())], names=["term", "toxic", "all"])
        rest = [t for t in every if t not in toxic]
        yield pa.record_batch([pa.array(rest, pa.string()), pa.array([0] * len(rest), pa.int64()), pa.array([every[t] for t in rest], pa.int64())], names=["term", "toxic", "all"])


def beyond_chance(t: int, k: int, n_toxic: int, n_all: int, tried: int) -> bool:
    """Whether a word of ``k`` rows, ``t`` of them toxic, is no chance find among ``tried`` words: (k over t) p^t tried < CHANCE."""
    if not 0 < n_toxic < n_all:
        return False
    ways = math.lgamma(k + 1) - math.lgamma(t + 1) - math.lgamma(k - t + 1)
    return t * math.log(n_all / n_toxic) - ways > math.log(max(tried, 1) / CHANCE)


def choose_terms(counts: list[tuple[str, int, int]], n_toxic: int, n_all: int, most: int = TERMS, tried: int = 1) -> list[str]:
    """Terms by coverage of toxic documents among those far more frequent there than chance gives; stems only if several words
    share them. A stem's own words that are terms themselves stay, for their misspellings."""
    n_clean = max(n_all - n_toxic, 1)
    good = {}
    for term, t, k in counts:
        odds = math.log((t + 0.5) / (n_toxic - t + 0.5)) - math.log((k - t + 0.5) / (n_clean - (k - t) + 0.5))
        if odds > 3 and k - t <= 0.1 * t and beyond_chance(t, k, n_toxic, n_all, tried):
            good[term] = t
    chosen: list[str] = []
    stems: list[str] = []
    for term in sorted(good, key=lambda x: (-good[x], -len(x), x)):
        stem = term.endswith("-")
        base = term.rstrip("-")
        if stem:
            if any(base.startswith(s) for s in stems):
                continue
            words = [good[w] for w in good if not w.endswith("-") and w.startswith(base)]
            if good[term] <= 1.3 * max(words, default=0) or good[term] < 3:
                continue
            stems.append(base)
        chosen.append(term)
        if len(chosen) >= most:
            break
    return chosen


def _features(batches, terms: tuple[str, ...]):
    lexicon = Lexicon(list(terms))
    for whole in batches:
        for b in slices(whole, "text", 2 << 20):
            x = text_features(b.column(1), lexicon)
            yield pa.record_batch([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), len(FEATURES)).cast(pa.list_(pa.float64()))], names=["doc_id", "x"])


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def text_features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    n = len(texts)
    raw, offs = utf8_buffers(texts)
    words, doc, first = _split(raw, offs)
    coded = words.dictionary_encode()
    names = [plain(w.decode()) for w in coded.dictionary.to_pylist()]
    kind = lexicon.match(names)
    code = coded.indices.to_numpy().astype(np.int64)
    hits = np.flatnonzero(kind[code] > 0)
    n_words = np.bincount(doc, minlength=n)
    count = np.zeros((n, 4))  # abuse by exact word, stem, misspelling; quoted
    addressed = np.zeros(n)
    for h in hits.tolist():
        d = int(doc[h])
        lo, hi = max(h - WINDOW, int(first[d])), min(h + WINDOW + 1, int(first[d + 1]))
        near = [names[c] for c in code[lo:hi].tolist()]
        if _quoted(words, h, lo, hi) or any(w in REPORTING for w in near if w):
            count[d, 3] += 1
        else:
            count[d, {EXACT: 0, STEM: 1, FUZZY: 2}[int(kind[code[h]])]] += 1
        addressed[d] += any(w in ADDRESS for w in near if w)
    x = np.zeros((n, len(FEATURES)))
    x[:, 0] = 1
    for k in range(4):
        x[:, 1 + 2 * k] = np.log1p(count[:, k])
        x[:, 2 + 2 * k] = count[:, k] > 0
    x[:, 9] = np.minimum(100 * count[:, :3].sum(1) / np.maximum(n_words, 1), 5) / 5
    x[:, 10] = addressed > 0
    return x


def _quoted(words: pa.Array, h: int, lo: int, hi: int) -> bool:
    """A quotation mark opens at or before the hit and closes at or after it, within the window."""
    before = [words[i].as_py().decode() for i in range(lo, h + 1)]
    after = [words[i].as_py().decode() for i in range(h, hi)]
    opens = any(w[:1] in "\"“«„‘" for w in before if w)
    closes = any(w.rstrip(".,;:!?")[-1:] in "\"”»“’" for w in after if w.rstrip(".,;:!?"))
    return opens and closes


def _split(raw: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of a batch as one binary array, each one's text, and where each text's words begin."""
    n = len(raw)
    solid = ~_BLANK[raw]
    start, end = solid.copy(), solid.copy()
    if n:
        start[1:] &= ~solid[:-1]
        end[:-1] &= ~solid[1:]
        inner = offs[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        start[inner] = solid[inner]
        end[inner - 1] = solid[inner - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    at = np.concatenate(([0], np.cumsum(e - s))).astype(np.int64)
    arr = pa.Array.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(at), pa.py_buffer(raw[solid].tobytes())])
    doc = np.searchsorted(offs, s, "right") - 1
    return arr, doc, np.searchsorted(doc, np.arange(len(offs)))


def train(df: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE) -> tuple[tuple[str, ...], np.ndarray]:
    """Terms and weights from at most ``most`` labelled rows. Without labels there are no terms, and the prior scores."""
    sample = labelled_sample(df, labels, label, most)
    sizes = sample.groupBy("label").count().collect()
    n_all, n_toxic = sum(r["count"] for r in sizes), sum(r["count"] for r in sizes if r["label"] == 1)
    counts = sample.mapInArrow(tidy(_candidates), "term string, toxic long, all long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("all").alias("all"))
    counts = cut(counts)
    tried = counts.count()
    least = max(3, n_toxic // 50)
    # What reaches the driver is bounded by the sample: terms of a sample's toxic rows that hardly occur in its other rows.
    counts = counts.where((F.col("toxic") >= least) & (10 * (F.col("all") - F.col("toxic")) <= F.col("toxic"))).orderBy(F.desc("toxic"), "term").limit(20 * TERMS).collect()
    terms = tuple(choose_terms([(r["term"], r["toxic"], r["all"]) for r in counts], n_toxic, n_all, tried=tried))
    if not terms:
        return terms, PRIOR
    rows = sample.select("doc_id", "text").mapInArrow(tidy(partial(_features, terms=terms)), "doc_id long, x array<double>").join(sample.select("doc_id", "label"), "doc_id").orderBy("doc_id").collect()
    return terms, fit_logistic(np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows]), PRIOR, STRENGTH)


def _score(batches, terms: tuple[str, ...], weights: np.ndarray):
    lexicon = Lexicon(list(terms))
    for whole in batches:
        for b in slices(whole, "text", 2 << 20):
            p = sigmoid(text_features(b.column(1), lexicon) @ weights)
            yield pa.record_batch([b.column(0), pa.array(p)], names=["doc_id", "score"])


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``.

    Only the text is an input of the score. Null and empty texts have no hit and score low. Null ids stay null (their
    crc32 is that of the empty text), repeated rows have a row each, an empty table gives an empty result; other columns
    are ignored. Without labels no term is known and every text scores low.
    """
    prepare(df.sparkSession)
    terms, weights = train(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels, most=most)
    out = digest_input(df, id_col, text_col).mapInArrow(tidy(partial(_score, terms=terms, weights=weights)), "doc_id long, score double")
    return out.select("doc_id", (folds(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
