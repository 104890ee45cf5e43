"""SentencePiece encoding and decoding with N-best segmentations.

A text is segmented over the lattice of a public piece model: the score of a segmentation is the sum of its pieces'
scores; a character without a piece falls back to its bytes at a penalty below every piece. The lattice falls apart
before each space that follows a non-space (no piece spans such a place; the table is checked for it), so distinct units
of a batch are segmented once. Forward Viterbi scores are computed for all units of a batch together; they are the exact
heuristic of a backward A-star search, whose first results are a unit's best segmentations in order. The N best of a
text change only units whose loss is among its N - 1 smallest losses (a change elsewhere has N at least as good ones
before it), so the search runs in those units alone and their results are merged.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import digest_input, prepare, slices, table, tidy, utf8_buffers
from knotwork.llm.shingles import U, mix

#: ``KNOWN`` units and ``SEARCHED`` searches are remembered by a worker at most.
N_BEST, PENALTY, UNITS, KNOWN, SEARCHED = 4, 10.0, 30_000, 500_000, 20_000
NEVER = -1e18
_STEP = U(0x9E3779B97F4A7C15)


class Pieces:
    """The piece table of a model, and segmentation over it."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.score = np.array([model.get_score(i) for i in range(n)], np.float64)
        names = [model.id_to_piece(i).replace("▁", " ") for i in range(n)]
        plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)]
        self.byte_id = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        self.bytes = [b"" if not p else s.encode() for p, s in zip(plain, names, strict=True)]
        for b in range(256):
            self.bytes[self.byte_id[b]] = bytes([b])
        self.ids = {s: i for i, (p, s) in enumerate(zip(plain, names, strict=True)) if p and s}
        if any(" " in s.lstrip(" ") for s in self.ids):
            raise ValueError("a piece spans a word's end: units can't be cut there")
        self.longest = max(map(len, self.ids))
        usual = self.score[[i for i in self.ids.values() if self.score[i] > -1e8]]
        self.fallback = float(usual.min()) - PENALTY
        self.byte_lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.byte_starts = np.concatenate(([0], np.cumsum(self.byte_lengths)))[:-1]
        self.byte_pool = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.forget()
        # Hashes of all prefixes of pieces, with the piece that ends there or -1.
        found: dict[int, int] = {}
        for s, i in self.ids.items():
            h = 0
            for k, c in enumerate(s):
                h = (h * int(_STEP) + int(mix(np.array([ord(c)], np.uint64))[0])) % 2**64 if k else int(mix(np.array([ord(c)], np.uint64))[0])
                found.setdefault(h, -1)
            found[h] = i
        self.prefix = np.array(sorted(found), np.uint64)
        self.prefix_piece = np.array([found[int(h)] for h in self.prefix], np.int64)

    def lattice(self, points: np.ndarray, ends: np.ndarray):
        """Edges (start, end, piece or -1 for fallback, score) over code points; ``ends``: where each point's unit ends."""
        n = len(points)
        value = mix(points)
        at = np.arange(n)
        h = value.copy()
        edges = []
        single = np.zeros(n, bool)
        for k in range(1, self.longest + 1):
            slot = np.minimum(np.searchsorted(self.prefix, h), len(self.prefix) - 1)
            live = self.prefix[slot] == h
            at, h, slot = at[live], h[live], slot[live]
            piece = self.prefix_piece[slot]
            ok = piece >= 0
            edges.append((at[ok], at[ok] + k, piece[ok], self.score[piece[ok]]))
            if k == 1:
                single[at[ok]] = True
            more = at + k < ends[at]
            at, h = at[more], h[more]
            if not len(at):
                break
            h = h * _STEP + value[at + k]
        bare = np.flatnonzero(~single)
        edges.append((bare, bare + 1, np.full(len(bare), -1), np.full(len(bare), self.fallback)))
        return tuple(np.concatenate(x) for x in zip(*edges, strict=True))

    def viterbi(self, units: pa.Array):
        """For each distinct unit (binary): best score, loss of the second best (inf if none), ids and where they begin."""
        raw, offs = utf8_buffers(units)
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        at = lead[offs]
        size = np.diff(at)
        unit = np.repeat(np.arange(len(size)), size)
        s, e, piece, score = self.lattice(points, at[1:][unit])
        own = unit[s]
        local_s, local_e = s - at[own], e - at[own]
        node = at[own] + own  # node index of a unit's start: one more node than points a unit
        ns, ne = node + local_s, node + local_e
        n_nodes = len(points) + len(size)
        first_node, last_node = at[:-1] + np.arange(len(size)), at[1:] + np.arange(len(size))
        alpha = np.full(n_nodes, NEVER)
        alpha[first_node] = 0
        back = np.full(n_nodes, -1)
        order = np.lexsort((s, ne, local_e))  # of equal sums the longest last piece wins
        starts = np.searchsorted(local_e[order], np.arange(1, (size.max() if len(size) else 0) + 2))
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            k = order[a:b]
            if len(k):
                total = alpha[ns[k]] + score[k]
                new = np.flatnonzero(np.concatenate(([True], ne[k][1:] != ne[k][:-1])))
                top = np.maximum.reduceat(total, new)
                alpha[ne[k][new]] = top
                hit = np.flatnonzero(total == np.repeat(top, np.diff(np.append(new, len(k)))))
                back[ne[k][hit[::-1]]] = k[hit[::-1]]
        beta = np.full(n_nodes, NEVER)
        beta[last_node] = 0
        order = np.lexsort((ns, -local_s))
        starts = np.searchsorted(-local_s[order], np.arange(-(size.max() if len(size) else 0), 2))
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            k = order[a:b]
            if len(k):
                new = np.flatnonzero(np.concatenate(([True], ns[k][1:] != ns[k][:-1])))
                beta[ns[k][new]] = np.maximum.reduceat(score[k] + beta[ne[k]], new)
        best = alpha[last_node]
        used = np.zeros(len(s), bool)
        live, rounds, chain = np.arange(len(size)), [], last_node.copy()
        live = live[size > 0]
        while len(live):
            k = back[chain[live]]
            used[k] = True
            rounds.append((live, k))
            chain[live] = ns[k]
            live = live[chain[live] > first_node[live]]
        other = np.where(used, NEVER, alpha[ns] + score + beta[ne])
        second = np.full(len(size), NEVER)
        np.maximum.at(second, own, other)
        loss = np.where(second <= NEVER / 2, np.inf, best - second)
        who = np.concatenate([r[0] for r in rounds]) if rounds else np.zeros(0, np.int64)
        edge = np.concatenate([r[1] for r in rounds]) if rounds else np.zeros(0, np.int64)
        order = np.lexsort((ns[edge], who))
        who, edge = who[order], edge[order]
        width = np.where(piece[edge] >= 0, 1, 0)
        bare = np.flatnonzero(width == 0)
        begin = np.flatnonzero((raw & 0xC0) != 0x80) if len(raw) else np.zeros(0, np.int64)
        begin = np.append(begin, len(raw))
        width[bare] = begin[s[edge[bare]] + 1] - begin[s[edge[bare]]]
        ids = np.repeat(piece[edge], width)
        place = np.cumsum(width) - width
        for j in bare.tolist():
            a = begin[s[edge[j]]]
            ids[place[j] : place[j] + width[j]] = self.byte_id[raw[a : a + width[j]]]
        count = np.bincount(who, weights=width, minlength=len(size)).astype(np.int64)
        return best, loss, ids, np.concatenate(([0], np.cumsum(count)))

    def segment(self, names: pa.Array) -> np.ndarray:
        """Where each of these distinct units is among the known ones; unknown ones are segmented. What is known is bounded."""
        slot = pc.index_in(names, value_set=self.known)
        fresh = names.filter(slot.is_null())
        if len(self.known) + len(fresh) > KNOWN:
            self.forget()
            slot, fresh = pa.nulls(len(names), pa.int32()), names
        got = [self.viterbi(fresh.slice(a, UNITS)) for a in range(0, len(fresh), UNITS)]
        if got:
            self.best, self.loss = (np.concatenate((x, *(g[i] for g in got))) for i, x in enumerate((self.best, self.loss)))
            new = np.concatenate([np.diff(g[3]) for g in got])
            self.first = np.concatenate((self.first, len(self.unit_ids) + np.cumsum(new) - new))
            self.sizes = np.concatenate((self.sizes, new))
            self.unit_ids = np.concatenate((self.unit_ids, *(g[2].astype(np.int32) for g in got)))
        place = slot.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        place[place < 0] = len(self.known) + np.arange(len(fresh))
        self.known = pa.concat_arrays([self.known, fresh])
        return place

    def forget(self) -> None:
        self.known = pa.array([], pa.large_binary())
        self.best, self.loss = np.zeros(0), np.zeros(0)
        self.first, self.sizes, self.unit_ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.searched: dict[tuple[int, int], tuple[list[float], list[np.ndarray]]] = {}

    def n_best(self, unit: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best segmentations of one unit in order, by backward A-star with forward Viterbi scores."""
        if not unit:
            return [(0.0, ())]
        points = np.array([ord(c) for c in unit], np.uint32)
        into: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(len(unit) + 1)]
        for s, e, p, score in zip(*(x.tolist() for x in self.lattice(points, np.full(len(unit), len(unit)))), strict=True):
            into[e].append((s, score, (p,) if p >= 0 else tuple(int(self.byte_id[b]) for b in unit[s:e].encode())))
        forward = [0.0] + [NEVER] * len(unit)
        for e in range(1, len(unit) + 1):
            forward[e] = max(forward[s] + score for s, score, _ in into[e])
        agenda, found = [(-forward[-1], (), len(unit), 0.0)], []
        while agenda and len(found) < n:
            _, tail, at, behind = heapq.heappop(agenda)
            if at == 0:
                found.append((behind, tail))
                continue
            for s, score, own in into[at]:
                heapq.heappush(agenda, (-(forward[s] + score + behind), own + tail, s, behind + score))
        return found

    def unit_best(self, slot: int, name: pa.Scalar, n: int) -> tuple[list[float], list[np.ndarray]]:
        """Scores and ids of a known unit's ``n`` best segmentations; the first ids are the ones that Viterbi chose."""
        top = self.searched.get((slot, n))
        if top is None:
            if len(self.searched) >= SEARCHED:
                self.searched.clear()
            found = self.n_best(name.as_py().decode(), n)
            chosen = tuple(self.unit_ids[self.first[slot] : self.first[slot] + self.sizes[slot]].tolist())
            ids = [chosen, *(x for _, x in found if x != chosen)][: len(found)]  # of equal scores the search may find others first
            top = self.searched[slot, n] = [x for x, _ in found], [np.array(x, np.int32) for x in ids]
        return top

    def encode(self, texts: pa.Array, n: int = N_BEST):
        """``n_best_ids`` without the ids of the others than the best."""
        return self.n_best_ids(texts, n, False)[:3]

    def n_best_ids(self, texts: pa.Array, n: int = N_BEST, others: bool = True):
        """Ids of each text's best segmentation, where each text's begin, the scores of its ``n`` best (nan: fewer), and for
        each text its second best to ``n``-th best as changes of the best: (place, number of ids there, ids instead)."""
        texts = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts.cast(pa.large_string()), pa.scalar("", pa.large_string()))
        raw, offs = utf8_buffers(texts)
        space = raw == 32
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut[offs[:-1]] = True
        begin = np.flatnonzero(cut)
        units = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.append(begin, len(raw)).astype(np.int64)), pa.py_buffer(raw.tobytes())])
        coded = units.dictionary_encode()
        code, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        slot = self.segment(names)
        best, loss, sizes, first = self.best[slot], self.loss[slot], self.sizes[slot], self.first[slot]
        k = sizes[code]
        total = np.cumsum(k)
        out = self.unit_ids[np.repeat(first[code] - (total - k), k) + np.arange(total[-1] if len(total) else 0)]
        doc = np.searchsorted(begin, offs)
        at = np.concatenate(([0], total))[doc]
        scores = np.full((len(texts), n), np.nan)
        scores[:, 0] = np.add.reduceat(best[code], doc[:-1]) if len(texts) else 0
        more: list[list[list[tuple[int, int, np.ndarray]]]] = [[] for _ in range(len(texts))]
        ends = np.concatenate(([0], total))
        for d in range(len(texts)) if n > 1 else ():
            own = code[doc[d] : doc[d + 1]]
            lost = loss[own]
            few = np.argpartition(lost, n - 2)[: n - 1] if len(own) >= n else np.arange(len(own))
            few = np.sort(few[np.isfinite(lost[few])])
            # What a segmentation loses, and its changes: (unit of the text, which of the unit's best).
            merged: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
            for i in few.tolist():
                top = self.unit_best(int(slot[own[i]]), names[int(own[i])], n)[0]
                merged = heapq.nsmallest(n, ((m + top[0] - x, (*how, (i, j)) if j else how) for m, how in merged for j, x in enumerate(top)), key=lambda c: (c[0], len(c[1])))
            scores[d, : len(merged)] = scores[d, 0] - np.array([m for m, _ in merged])
            for _, how in merged[1:] if others else ():
                more[d].append([(int(ends[doc[d] + i] - at[d]), int(k[doc[d] + i]), self.unit_best(int(slot[own[i]]), names[int(own[i])], n)[1][j]) for i, j in how])
        return out, at, scores, more

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of each text from its ids (the space put before each text is dropped), and where each begins."""
        k = self.byte_lengths[ids]
        total = np.cumsum(k)
        raw = self.byte_pool[np.repeat(self.byte_starts[ids] - (total - k), k) + np.arange(total[-1] if len(total) else 0)]
        ends = np.concatenate(([0], total))[at]
        keep = np.ones(len(raw), bool)
        keep[ends[:-1]] = False
        return raw[keep], ends - np.arange(len(ends))


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


_CHANGES = pa.list_(pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))]))
CHANGES = "array<struct<at: int, drop: int, ids: array<int>>>"
SCHEMA = "doc_id long, n_pieces long, ids_crc32 long, score double, score_2 double, score_3 double, score_4 double, round_trip boolean, decoded_sha256 string"


def _encode(batches, path: str, with_ids: bool):
    p = pieces(path)
    for whole in batches:
        for b in slices(whole, "text", 2 << 20):
            ids, at, scores, more = p.n_best_ids(b.column(1), others=with_ids)
            raw, ends = p.decode(ids, at)
            source, bounds = utf8_buffers(b.column(1))
            n = b.num_rows
            same = [bool(np.array_equal(raw[ends[i] : ends[i + 1]], source[bounds[i] : bounds[i + 1]])) for i in range(n)]
            little = ids.astype("<u4")
            crc = [zlib.crc32(little[at[i] : at[i + 1]]) for i in range(n)]
            sha = [hashlib.sha256(raw[ends[i] : ends[i + 1]]).hexdigest() for i in range(n)]
            cols = [b.column(0), pa.array(np.diff(at)), pa.array(crc, pa.int64()), *(pa.array(scores[:, j], mask=np.isnan(scores[:, j])) for j in range(4)), pa.array(same), pa.array(sha)]
            names = ["doc_id", "n_pieces", "ids_crc32", "score", "score_2", "score_3", "score_4", "round_trip", "decoded_sha256"]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32))))
                names.append("ids")
                for j in range(N_BEST - 1):
                    cols.append(pa.array([[{"at": a, "drop": d, "ids": i} for a, d, i in x[j]] if len(x) > j else None for x in more], _CHANGES))
                    names.append(f"changes_{j + 2}")
            yield pa.record_batch(cols, names=names)


def piece_encode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per input row: the best segmentation's ``ids``, ``n_pieces`` and ``ids_crc32`` (ids as little-endian unsigned
    32-bit integers), the scores of the four best segmentations, the second to fourth as changes of the best, ``changes_2``
    to ``changes_4`` (null where there are fewer; see ``segmentation``), and what decoding gives: ``decoded_sha256`` (of UTF-8) and ``round_trip`` (it equals the
    text). Ids and changes are left out without ``with_ids``.

    Null texts count as empty: a single piece for the space that the model puts before each text. Of segmentations with
    equal scores the one with the longer last piece, then the longer one before it, is the best. Null ids stay null,
    repeated rows have a row each, an empty table gives an empty result, other columns are ignored.
    """
    prepare(df.sparkSession)
    schema = SCHEMA + (f", ids array<int>, changes_2 {CHANGES}, changes_3 {CHANGES}, changes_4 {CHANGES}" if with_ids else "")
    return digest_input(df, id_col, text_col).mapInArrow(tidy(partial(_encode, path=model, with_ids=with_ids)), schema)


def segmentation(rank: int) -> Column:
    """The ids of the ``rank``-th best segmentation (2 to 4) of a row of ``piece_encode``; null if there are fewer."""
    changes, ids = F.col(f"changes_{rank}"), F.col("ids")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ids"))
    upto = lambda s, c: F.slice(ids, s["at"] + 1, c["at"] - s["at"])
    step = lambda s, c: F.struct((c["at"] + c["drop"]).alias("at"), F.concat(s["ids"], upto(s, c), c["ids"]).alias("ids"))
    return F.when(changes.isNotNull(), F.aggregate(changes, start, step, lambda s: F.concat(s["ids"], F.slice(ids, s["at"] + 1, F.size(ids)))))


def _join(batches, path: str):
    p = pieces(path)
    for b in batches:
        ids = pc.list_flatten(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
        k = pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
        raw, ends = p.decode(ids, np.concatenate(([0], np.cumsum(k))))
        yield pa.record_batch([b.column(0), pa.array([raw[a:e].tobytes().decode("utf-8", "replace") for a, e in zip(ends[:-1], ends[1:], strict=True)], pa.string())], names=["doc_id", "text"])


def piece_decode(df: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` from the ids of a segmentation (also one that is not the best). Rows without ids are dropped."""
    prepare(df.sparkSession)
    d = df.where(F.size(ids_col) > 0).select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return d.mapInArrow(tidy(partial(_join, path=model)), "doc_id long, text string")


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
