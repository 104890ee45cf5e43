"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Its potentials come from binned measurements of the line and of the lines before and after;
neighbouring labels are tied by a transition. Labels exist for documents only, so the fit begins with each line bearing
its document's label and then, for bad documents, lets lines that look good be good (the worst line stays bad). The
length-weighted mean of forward-backward marginals is a document's evidence, and a fitted logistic makes it a score.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import digest_input, folds, prepare, slices, table, tidy, utf8_buffers
from knotwork.llm.labelled import fit_logistic, labelled_sample, sigmoid
from knotwork.llm.quality_rules import coded_words, repeated_words

SAMPLE, ROUNDS, RATE, RIDGE, THRESHOLD = 6000, 60, 0.3, 1e-3, 0.3
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _class(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in chars]] = True
    return t


_CLASSES = [_class("#*$%&<>@^~+="), _class("".join(map(chr, range(65, 91)))), _class("!?"), _class("|\\/_"), _class("0123456789"), _class(".,;:")]
#: Bin edges of the measurements, in order: characters, words, symbols, capitals, exclamations, bars and digits and stops a word,
#: word length, share of distinct words, share of words in repeated passages, earlier equal lines.
EDGES = [
    np.array([1, 20, 60, 150, 400, 1200]), np.array([1, 3, 8, 20, 60, 200]), np.array([0.02, 0.1, 0.3, 0.8, 2]), np.array([0.01, 0.03, 0.08, 0.2, 0.5, 0.8]), np.array([0.02, 0.1, 0.4, 1]),
    np.array([0.02, 0.1, 0.4, 0.8]), np.array([0.02, 0.1, 0.3, 1]), np.array([0.02, 0.06, 0.1, 0.2, 0.4]), np.array([2.5, 3.5, 4.5, 5.5, 6.5, 8, 11]), np.array([0.3, 0.5, 0.7, 0.85, 0.95]), np.array([0.001, 0.1, 0.3, 0.6, 0.9]), np.array([1, 2, 5]),
]
_BINS = [len(e) + 1 for e in EDGES]
_FIRST = np.concatenate(([0], np.cumsum(_BINS)))
N_OWN = int(_FIRST[-1])
N_FEATURES = 3 * N_OWN + 2  # the line, the one before, the one after; first and last line


def line_bins(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin numbers (lines x measurements), characters of each line, and where each text's lines begin."""
    raw, offs = utf8_buffers(texts)
    n, size = len(texts), len(raw)
    feed = np.flatnonzero(raw == 10)
    # A text's first line begins with it, the others after a line feed; an empty text has one empty line.
    starts = np.concatenate((offs[:-1], feed + 1))
    owner = np.concatenate((np.arange(n), np.searchsorted(offs, feed, "right") - 1))
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    first = np.searchsorted(owner, np.arange(n + 1))
    ends = np.concatenate((starts[1:], [size]))
    same = np.concatenate((owner[1:] == owner[:-1], [False]))
    stops = np.where(same, ends - 1, offs[owner + 1])  # without the line feed

    def per_line(hit: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(hit)))
        return (total[stops] - total[starts]).astype(float)

    blank = _BLANK[raw]
    lead = (raw & 0xC0) != 0x80
    chars, solid = per_line(lead), per_line(lead & ~blank)
    code, doc = coded_words(raw, offs, blank)
    begins = ~blank
    if size:
        begins[1:] &= blank[:-1]
        begins[offs[:-1][offs[:-1] < size]] |= ~blank[offs[:-1][offs[:-1] < size]]
    words = per_line(begins)
    w = np.maximum(words, 1)
    line_of = np.repeat(np.arange(len(starts)), words.astype(np.int64)) if words.sum() == len(code) else np.searchsorted(starts, np.flatnonzero(begins), "right") - 1
    pair = np.unique(line_of * np.int64(code.max(initial=0) + 1) + code) // np.int64(code.max(initial=0) + 1)
    distinct = np.bincount(pair.astype(np.int64), minlength=len(starts))
    again = np.bincount(line_of[repeated_words(code, doc, n)], minlength=len(starts)) if len(code) else np.zeros(len(starts))
    line = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, size).astype(np.int64)), pa.py_buffer(raw.tobytes())])
    key = owner * np.int64(len(line) + 1) + line.dictionary_encode().indices.to_numpy()
    rank = np.argsort(key, kind="stable")
    fresh = np.concatenate(([True], key[rank][1:] != key[rank][:-1])) if len(rank) else np.zeros(0, bool)
    at = np.arange(len(rank))
    earlier = np.zeros(len(rank))
    earlier[rank] = at - np.maximum.accumulate(np.where(fresh, at, 0))
    earlier[words == 0] = 0
    counts = [per_line(c[raw]) for c in _CLASSES]
    measured = [chars, words, counts[0] / w, counts[1] / np.maximum(solid, 1), counts[2] / w, counts[3] / w, counts[4] / w, counts[5] / w, solid / w, distinct / w, again / w, earlier]
    bins = np.stack([np.searchsorted(e, m, "right") + f for e, m, f in zip(EDGES, measured, _FIRST, strict=False)], 1).astype(np.int16)
    return bins, chars, first


def _unary(bins: np.ndarray, first: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Log potential of good over bad for each line."""
    own = w[:N_OWN][bins].sum(1)
    before, after = w[N_OWN : 2 * N_OWN][bins].sum(1), w[2 * N_OWN : 3 * N_OWN][bins].sum(1)
    head = np.zeros(len(bins), bool)
    tail = np.zeros(len(bins), bool)
    head[first[:-1]] = True
    tail[first[1:] - 1] = True
    own[1:] += np.where(head[1:], 0, before[:-1])
    own[:-1] += np.where(tail[:-1], 0, after[1:])
    return own + w[-2] * head + w[-1] * tail


def forward_backward(unary: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line and the summed pair marginals of neighbours (2 x 2), all chains at once, longest first."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, size = first[:-1][order], size[order]
    n = len(unary)
    pot = np.stack((np.zeros(n), unary), 1)
    a, b = pot.copy(), np.zeros((n, 2))
    longest = int(size[0]) if len(size) else 0
    live = [begin[: np.searchsorted(-size, -t, "right")] + t - 1 for t in range(1, longest + 1)]  # lines at place t - 1
    for t in range(1, longest):
        k = live[t]
        a[k] = pot[k] + np.logaddexp(a[k - 1, 0, None] + trans[0], a[k - 1, 1, None] + trans[1])
    for t in range(longest - 1, 0, -1):
        k = live[t]
        c = pot[k] + b[k]
        b[k - 1] = np.logaddexp(trans[:, 0] + c[:, 0, None], trans[:, 1] + c[:, 1, None])
    both = a + b
    z = np.logaddexp(both[:, 0], both[:, 1])
    pairs = np.zeros((2, 2))
    if longest > 1:
        k = np.concatenate(live[1:])
        j = a[k - 1][:, :, None] + trans[None] + (pot[k] + b[k])[:, None, :]
        pairs = np.exp(j - z[k][:, None, None]).sum(0)
    return np.exp(both[:, 1] - z), pairs


def fit_chain(bins: np.ndarray, first: np.ndarray, y: np.ndarray, w: np.ndarray, trans: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Adaptive gradient ascent on the chains' likelihood."""
    head, tail = first[:-1], first[1:] - 1
    inner = np.ones(len(bins), bool)
    inner[head] = False
    nxt = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[nxt - 1], y[nxt]), 1)
    gw, gt = np.zeros_like(w), np.zeros_like(trans)
    for _ in range(rounds):
        p, pairs = forward_backward(_unary(bins, first, w), first, trans)
        miss = y - p
        d = np.zeros_like(w)
        for k in range(bins.shape[1]):
            d[:N_OWN] += np.bincount(bins[:, k], weights=miss, minlength=N_OWN)
            d[N_OWN : 2 * N_OWN] += np.bincount(bins[nxt - 1, k], weights=miss[nxt], minlength=N_OWN)
            d[2 * N_OWN : 3 * N_OWN] += np.bincount(bins[nxt, k], weights=miss[nxt - 1], minlength=N_OWN)
        d[-2], d[-1] = miss[head].sum(), miss[tail].sum()
        d = d / len(bins) - RIDGE * w
        t = (seen - pairs) / len(bins) - RIDGE * trans
        gw += d * d
        gt += t * t
        w = w + RATE * d / np.sqrt(gw + 1e-12)
        trans = trans + RATE * t / np.sqrt(gt + 1e-12)
    return w, trans


def evidence(p: np.ndarray, chars: np.ndarray, first: np.ndarray) -> np.ndarray:
    weight = chars + 1
    total = np.add.reduceat(weight, first[:-1]) if len(first) > 1 else np.zeros(0)
    good = np.add.reduceat(weight * p, first[:-1]) if len(first) > 1 else np.zeros(0)
    m = good / total
    return np.stack((np.ones(len(m)), np.log((m + 0.01) / (1.01 - m)), m), 1)


def fit_model(bins: np.ndarray, chars: np.ndarray, first: np.ndarray, label: np.ndarray):
    """``(w, trans, calibration)`` from lines of labelled documents."""
    size = np.diff(first)
    doc = np.repeat(np.arange(len(size)), size)
    y = label[doc]
    w, trans = fit_chain(bins, first, y, np.zeros(N_FEATURES), np.zeros((2, 2)), ROUNDS)
    p, _ = forward_backward(_unary(bins, first, w), first, trans)
    worst = np.full(len(size), np.inf)
    np.minimum.at(worst, doc, p)
    y = np.where((label[doc] == 0) & (p > 0.5) & (p > worst[doc]), 1, label[doc])
    w, trans = fit_chain(bins, first, y, w, trans, ROUNDS)
    p, _ = forward_backward(_unary(bins, first, w), first, trans)
    cal = fit_logistic(evidence(p, chars, first), label.astype(float), np.array([0.0, 0.5, 2.0]), np.array([0.01, 0.1, 0.1]))
    return w, trans, cal


def score_texts(texts: pa.Array, model) -> np.ndarray:
    bins, chars, first = line_bins(texts)
    p, _ = forward_backward(_unary(bins, first, model[0]), first, model[1])
    return sigmoid(evidence(p, chars, first) @ model[2])


def _sample_lines(batches):
    for whole in batches:
        for b in slices(whole, "text", 1 << 20):
            bins, chars, first = line_bins(b.column(1))
            rows = [bins[first[i] : first[i + 1]].tobytes() for i in range(b.num_rows)]
            sizes = [chars[first[i] : first[i + 1]].tobytes() for i in range(b.num_rows)]
            yield pa.record_batch([b.column(0), b.column(2), pa.array(rows, pa.binary()), pa.array(sizes, pa.binary())], names=["doc_id", "label", "bins", "chars"])


def train(df: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE):
    """The model from at most ``most`` labelled rows. Without labels all weights are zero and every text scores a half or more."""
    rows = labelled_sample(df, labels, label, most).mapInArrow(tidy(_sample_lines), "doc_id long, label int, bins binary, chars binary").orderBy("doc_id").collect()
    if not rows:
        return np.zeros(N_FEATURES), np.zeros((2, 2)), np.array([0.0, 0.5, 2.0])
    bins = [np.frombuffer(r["bins"], np.int16).reshape(-1, len(EDGES)) for r in rows]
    chars = np.concatenate([np.frombuffer(r["chars"]) for r in rows])
    first = np.concatenate(([0], np.cumsum([len(x) for x in bins])))
    return fit_model(np.concatenate(bins), chars, first, np.array([r["label"] for r in rows]))


def _score(batches, model):
    for whole in batches:
        for b in slices(whole, "text", 1 << 20):
            yield pa.record_batch([b.column(0), pa.array(score_texts(b.column(1), model))], names=["doc_id", "score"])


def line_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``.

    Only the text is an input of the score. Null and empty texts are one empty line and are scored as such. Null ids stay
    null (their crc32 is that of the empty text), repeated rows have a row each, an empty table gives an empty result;
    other columns are ignored.
    """
    prepare(df.sparkSession)
    model = train(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels, most=most)
    out = digest_input(df, id_col, text_col).mapInArrow(tidy(partial(_score, model=model)), "doc_id long, score double")
    return out.select("doc_id", (folds(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op9_line_quality(spark, sf_dir: str) -> DataFrame:
    return line_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
