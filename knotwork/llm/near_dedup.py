"""Near-duplicate groups by a chosen-path set similarity join.

Every document becomes its set of word shingles and a row of minwise tokens. Independent trees branch the documents:
the first ``PATH`` steps of a tree are taken at once, by positions drawn for the tree; after that a node picks each
token position with probability ``BRANCH / POSITIONS`` (a hash of node and position decides, so the node needs no
state), and a document goes to one child for each picked position, named by its token there. Documents that agree in
picked tokens share the child. A node of at most ``Limits.leaf`` documents is compared exhaustively on the tokens.

A larger node has a pivot. Documents with at least ``NEAR`` of its tokens join the pivot's family, those with less than
``FAR`` branch on; a candidate pair is together in one of the two, by the triangle inequality. So a group of copies is
not branched again and again, and no pair of it is told: trees only tell which documents are of one *family*, a
component of candidates. Links never leave a family.

Families are then resolved on whole shingle sets, which travel once: a family that fits a block (bounded in documents and
bytes) is one task's work; a larger one is cut into blocks, and each pair of its blocks is one. An inverted index of the
block's shingles gives a document's exact overlap with all others at once. Documents of the component that is largest so
far need no look of their own, as a link to another component is seen from the other side. Only spanning forests of
links come out.
"""

from __future__ import annotations

import hashlib
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import cut, digest_input, prepare, slices, tidy
from knotwork.llm.shingles import U, mix, shingle_sets
from knotwork.operators.components import connected_components

POSITIONS, TREES, PATH, BRANCH, DEPTH = 128, 20, 3, 1.25, 20
SEED = 20240611


class Limits(NamedTuple):
    """What one task holds. The links do not depend on it."""

    leaf: int = 1024  #: documents of a node that are compared exhaustively
    local: int = 16384  #: documents of a node that one task branches on its own (2 MB of tokens); larger ones in distributed steps
    docs: int = 4096  #: documents of a block
    shingles: int = 1 << 20  #: shingles of a block (8 MB of hashes)


#: Of 128 tokens: pairs with less than DOUBT equal ones are 4.5 standard deviations under 0.8 and are not candidates.
DOUBT = 82
#: Candidates differ in at most POSITIONS - DOUBT tokens, and so do their numbers of tokens equal to the pivot's; with
#: FAR - NEAR not below that a candidate pair is near together or far together.
NEAR, FAR = 52, 98
SKETCH = "doc_id long, n_shingles long, digest binary, roots array<long>, tokens binary"
_ODD = mix(np.arange(1, POSITIONS + 1, dtype=np.uint64) * U(0xA24BAED4963EE407)) | U(1)
_XOR = mix(np.arange(1, POSITIONS + 1, dtype=np.uint64) * U(0x9FB21C651E98DF25))
_CHANCE = U(int(BRANCH / POSITIONS * 2**64))
#: The first ``PATH`` positions of every tree: all documents stand at its root, so all choose alike.
_PICKS = np.array([np.random.default_rng([SEED, t]).choice(POSITIONS, PATH, replace=False) for t in range(TREES)])


def _digest(x: np.ndarray) -> bytes:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


def _sketches(batches, words: int):
    """Each document's set size and digest, where the first steps of all trees lead (by full minwise values), and a byte of each token."""
    for whole in batches:
        for b in slices(whole, "text"):
            x, at = shingle_sets(b.column(1), words)
            size = np.diff(at)
            some = np.flatnonzero(size)
            low = np.zeros((b.num_rows, POSITIONS), np.uint64)
            for k in range(POSITIONS) if len(some) else ():
                low[some, k] = mix(np.minimum.reduceat((x ^ _XOR[k]) * _ODD[k], at[:-1][some]))
            tokens = (low >> U(56)).astype(np.uint8)
            roots = np.empty((b.num_rows, TREES), np.uint64)
            for t in range(TREES):
                roots[:, t] = U(t + 1)
                for k in _PICKS[t]:
                    roots[:, t] = mix(mix(roots[:, t] + _ODD[k]) ^ low[:, k])
            names = [_digest(x[at[i] : at[i + 1]]) if size[i] else None for i in range(b.num_rows)]
            keys = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * TREES), pa.array(roots.reshape(-1).view(np.int64)))
            yield pa.record_batch([b.column(0), pa.array(size, pa.int64()), pa.array(names, pa.binary()), keys, pa.array([t.tobytes() for t in tokens], pa.binary())], names=["doc_id", "n_shingles", "digest", "roots", "tokens"])


def _token_rows(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, POSITIONS)


def _children(node: np.ndarray, tokens: np.ndarray):
    """(row, child) for every position that a row's node picks."""
    rows, names = [], []
    step = 1 << 13
    for a in range(0, len(node), step):
        n = node[a : a + step]
        r, p = np.nonzero(mix(n[:, None] ^ _XOR[None, :]) < _CHANCE)
        rows.append(r + a)
        names.append(mix(mix(n[r] + _ODD[p]) ^ (tokens[a + r, p].astype(np.uint64) + U(1))))
    return np.concatenate(rows), np.concatenate(names)


def _branch(batches):
    for b in batches:
        if b.num_rows:
            r, child = _children(b.column(0).to_numpy().view(np.uint64), _token_rows(b.column(2)))
            yield pa.record_batch([pa.array(child.view(np.int64)), pa.array(b.column(1).to_numpy()[r])], names=["node", "rep"])


def _groups(batches):
    """Whole groups from rows sorted by their first column, as lists of batches."""
    held, at = [], None
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0).to_numpy()
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        for a, e in zip(np.concatenate(([0], cuts)).tolist(), np.concatenate((cuts, [len(key)])).tolist(), strict=True):
            if held and at != key[a]:
                yield at, held
                held = []
            at = key[a]
            held.append(b.slice(a, e - a))
    if held:
        yield at, held


def _equal_bytes(tokens: np.ndarray) -> np.ndarray:
    """Number of equal tokens of every two rows, eight tokens a step: a byte of x is zero where its high bit stays clear."""
    n = len(tokens)
    words = np.ascontiguousarray(tokens).view(np.uint64)
    low = U(0x7F7F7F7F7F7F7F7F)
    out = np.empty((n, n), np.uint8)
    for i in range(0, n, 64):
        differ = np.zeros((min(64, n - i), n), np.uint8)
        for w in range(words.shape[1]):
            x = words[i : i + 64, None, w] ^ words[None, :, w]
            differ += np.bitwise_count((((x & low) + low) | x) & ~low)
        out[i : i + 64] = POSITIONS - differ
    return out


def _reached(hit: np.ndarray) -> np.ndarray:
    """The first row of each row's component in a symmetric matrix of links."""
    first = np.full(len(hit), -1)
    for i in range(len(hit)):
        if first[i] < 0:
            first[i] = i
            front = np.array([i])
            while len(front):
                front = np.flatnonzero(hit[front].any(0) & (first < 0))
                first[front] = i
    return first


def _family_edges(node: int, rep: np.ndarray, tokens: np.ndarray, leaf: int):
    """(document, document) of one family each, for all a node's candidates: a leaf's components, or pivot and branches."""
    todo = [(U(node), np.arange(len(rep)), 0)]
    while todo:
        at, own, depth = todo.pop()
        if len(own) == 2:
            if (tokens[own[0]] == tokens[own[1]]).sum() >= DOUBT:
                yield rep[own[:1]], rep[own[1:]]
            continue
        if len(own) <= leaf:
            first = _reached(_equal_bytes(tokens[own]) >= DOUBT)
            far = np.flatnonzero(first != np.arange(len(own)))
            yield rep[own[far]], rep[own[first[far]]]
            continue
        pivot = own[np.argmin(mix(rep[own].view(np.uint64) ^ mix(np.array([at], np.uint64))))]
        same = (tokens[own] == tokens[pivot]).sum(1)
        near = own[same >= NEAR] if depth < DEPTH else own
        yield rep[near], np.full(len(near), rep[pivot])
        far = own[same < FAR]
        if depth < DEPTH and len(far):
            r, child = _children(np.full(len(far), at, np.uint64), tokens[far])
            order = np.argsort(child, kind="stable")
            names, begin = np.unique(child[order], return_index=True)
            for name, part in zip(names, np.split(far[r[order]], begin[1:])):  # noqa: B905  (no child: one empty part)
                if len(part) > 1:
                    todo.append((name, part, depth + 1))


def _families(batches, leaf: int):
    out, n = [], 0
    for node, held in _groups(batches):
        rep = np.concatenate([b.column(1).to_numpy() for b in held])
        tokens = np.concatenate([_token_rows(b.column(2)) for b in held])
        rep, first = np.unique(rep, return_index=True)
        if len(rep) < 2:
            continue
        for pair in _family_edges(int(node) % 2**64, rep, tokens[first], leaf):
            out.append(pair)
            n += len(pair[0])
        if n > 20_000:
            yield _edges(out)
            out, n = [], 0
    if n:
        yield _edges(out)


def _edges(out, names=("a", "b")):
    return pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=list(names))


def _near_pivot(batches):
    for b in batches:
        if b.num_rows:
            same = (_token_rows(b.column(2)) == _token_rows(b.column(4))).sum(1)
            yield pa.record_batch([*(b.column(k) for k in range(4)), pa.array(same.astype(np.int32))], names=["node", "rep", "tokens", "pivot", "same"])


def _trees(reps: DataFrame, limits: Limits) -> DataFrame:
    """``(a, b)``: documents of one family. One shuffle groups the nodes; only nodes above ``limits.local`` need a round of their own."""
    rows = reps.select(F.explode("roots").alias("node"), "rep")
    edges = None
    for depth in range(DEPTH + 1):
        counts = cut(rows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1"))
        top = counts.agg(F.max("n")).first()[0] or 0
        shared = rows.join(counts, "node").join(reps.select("rep", "tokens"), "rep").select("node", "rep", "tokens", "n")
        small = shared if top <= limits.local else shared.where(F.col("n") <= limits.local)
        found = small.drop("n").repartition("node").sortWithinPartitions("node").mapInArrow(tidy(partial(_families, leaf=limits.leaf)), "a long, b long")
        edges = found if edges is None else edges.union(found)
        if top <= limits.local:
            return edges
        big = shared.where(F.col("n") > limits.local)
        pivot = big.groupBy("node").agg(F.min_by(F.struct("rep", "tokens"), F.struct(F.xxhash64("node", "rep"), "rep")).alias("p"))
        pivot = cut(pivot.select("node", F.col("p.tokens").alias("pivot_tokens"), F.col("p.rep").alias("pivot")))
        near = big.join(pivot, "node").select("node", "rep", "tokens", "pivot", "pivot_tokens")
        near = cut(near.mapInArrow(tidy(_near_pivot), "node long, rep long, tokens binary, pivot long, same int"))
        edges = edges.union((near.where(F.col("same") >= NEAR) if depth < DEPTH else near).select("rep", "pivot"))
        if depth < DEPTH:
            rows = near.where(F.col("same") < FAR).select("node", "rep", "tokens").mapInArrow(tidy(_branch), "node long, rep long")
    return edges


def _sets(batches, words: int):
    """Each document's whole set, once for each task that needs it: its family's, or those of its block with the others."""
    for whole in batches:
        for b in slices(whole, "text"):
            x, at = shingle_sets(b.column(5), words)
            out, n = [], 0
            for i, (rep, digest, family, blocks) in enumerate(zip(*(b.column(k).to_pylist() for k in range(1, 5)), strict=True)):
                own = x[at[i] : at[i + 1]]
                if _digest(own) != digest:  # another text of a repeated id
                    continue
                data = own.tobytes()
                key = mix(np.array([family % 2**64], np.uint64))[0]
                if blocks == 1:
                    tasks = [key]
                else:
                    mine = int(mix(np.array([rep % 2**64], np.uint64))[0]) % blocks
                    others = np.setdiff1d(np.arange(blocks, dtype=np.uint64), [mine])
                    tasks = mix(mix(key ^ np.minimum(others, U(mine))) + np.maximum(others, U(mine)))
                for t in tasks:
                    out.append((int(t.view(np.int64)), rep, data))
                    n += len(data)
                    if n > 4 << 20:
                        yield _set_batch(out)
                        out, n = [], 0
            if out:
                yield _set_batch(out)


def _set_batch(out):
    task, rep, data = zip(*out, strict=True)
    return pa.record_batch([pa.array(task, pa.int64()), pa.array(rep, pa.int64()), pa.array(data, pa.binary())], names=["task", "rep", "shingles"])


def linked_components(x: np.ndarray, at: np.ndarray, percent: int) -> np.ndarray:
    """The first row of each row's component, of rows ``x[at[i]:at[i + 1]]`` (sets), linked by exact overlap.

    Rows are looked at in the order of how common their members are; a look is one pass over the index of the row's
    members. Rows of the largest component so far are skipped: a link between two components has an end outside of it.
    """
    n = len(at) - 1
    size = np.diff(at)
    _, member, count = np.unique(x, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), size)
    common = count[member] > 1  # a member of one row alone adds to its size only
    row, member = row[common], member[common]
    mine = np.searchsorted(row, np.arange(n + 1))
    posting = row[np.argsort(member, kind="stable")]
    count = np.where(count > 1, count, 0)
    begin = np.cumsum(count) - count
    label = np.arange(n)
    done = mine[1:] == mine[:-1]
    order = np.argsort(-np.bincount(row, count[member], n) / np.maximum(size, 1), kind="stable")
    main = -1
    while True:
        left = order[~done[order] & (label[order] != main)]
        if not len(left):
            return label
        i = left[0]
        done[i] = True
        m = member[mine[i] : mine[i + 1]]
        length = count[m]
        index = np.arange(length.sum()) + np.repeat(begin[m] - np.cumsum(length) + length, length)
        same = np.bincount(posting[index], minlength=n)
        linked = 100 * same >= percent * (size[i] + size - same)
        linked[i] = True
        joined = np.zeros(n, bool)
        joined[label[linked]] = True
        joined = joined[label]
        label[joined] = label[joined].min()
        main = np.bincount(label).argmax()


def _links(batches, percent: int):
    """A spanning forest of the links of each task's documents: (document, smallest of its component there)."""
    out, n = [], 0
    for _, held in _groups(batches):
        rep = np.concatenate([b.column(1).to_numpy() for b in held])
        if len(rep) < 2:
            continue
        data = [s for b in held for s in b.column(2).to_pylist()]
        order = np.argsort(rep, kind="stable")
        at = np.concatenate(([0], np.cumsum([len(data[i]) // 8 for i in order])))
        rep = rep[order]
        first = linked_components(np.frombuffer(b"".join([data[i] for i in order]), np.uint64), at, percent)
        far = np.flatnonzero(rep[first] != rep)
        out.append((rep[far], rep[first[far]]))
        n += len(far)
        if n > 20_000:
            yield _edges(out)
            out, n = [], 0
    if n:
        yield _edges(out)


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Two documents are linked if ``100 * intersection >= percent * union`` of their sets of ``words``-word shingles (words
    are runs outside ``[\\x20\\x09-\\x0D]``, A-Z lower-cased; with fewer words the whole sequence is the one shingle).
    ``component_id`` is the smallest id that links reach. Null or empty texts have no shingle and stand alone; so do
    rows with a null id (``component_id`` null, kept). Rows that repeat an id are one document with the links of all its
    texts; each row has its own text's ``n_shingles``. An empty table gives an empty result; other columns are ignored.
    A pair at the threshold shares the first steps of one tree at least with a probability above 0.999999 (``TREES``
    trees), closer pairs with more.
    """
    prepare(df.sparkSession)
    d = digest_input(df, id_col, text_col)
    sk = cut(d.mapInArrow(tidy(partial(_sketches, words=words)), SKETCH))
    linked = sk.where("digest is not null and doc_id is not null")
    # A set's tokens are the same in all its documents, so one aggregation leaves the distinct sets.
    classes = linked.groupBy("digest").agg(F.min("doc_id").alias("id"), F.count("*").alias("members"), F.first("n_shingles").alias("n_shingles"), F.first("roots").alias("roots"), F.first("tokens").alias("tokens"))
    classes = cut(classes.withColumn("rep", F.xxhash64("digest")))  # a clash of two only makes their family larger
    family = cut(connected_components(_trees(classes, limits)))
    found = classes.join(family, classes["rep"] == family["node"]).select("id", "digest", "n_shingles", F.col("component").alias("family"))
    sizes = found.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / limits.docs), F.ceil(F.sum("n_shingles") / limits.shingles)).alias("blocks"), F.count("*").alias("n"))
    need = found.join(sizes.where("n > 1"), "family").select("id", "digest", "family", "blocks")
    texts = d.join(need, d["doc_id"] == need["id"]).select("doc_id", "id", "digest", "family", "blocks", "text")
    sets = texts.mapInArrow(tidy(partial(_sets, words=words)), "task long, rep long, shingles binary")
    links = sets.repartition("task").sortWithinPartitions("task").mapInArrow(tidy(partial(_links, percent=percent)), "a long, b long")
    # Texts of one id: their classes' ids are joined.
    again = linked.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("doc_id")
    again = linked.select("doc_id", "digest").join(again, "doc_id", "left_semi").distinct().join(classes.select("digest", "id"), "digest").select("doc_id", "id")
    parts = connected_components(links.union(again))
    # Only classes that a link or a copy ties to another id need a lookup; the others are their own component.
    label = classes.join(parts, classes["id"] == parts["node"], "left").select("digest", "id", F.coalesce("component", "id").alias("component"), "members")
    label = label.where("members > 1 or component <> id").select("digest", "component")
    out = sk.drop("tokens", "roots").join(label, "digest", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df`` whose document stays for its group, with all their columns."""
    kept = near_dedup(df, id_col, text_col, words, percent).where("kept").select(F.col("doc_id").alias("__kept")).distinct()
    return df.join(kept, df[id_col].cast("long").eqNullSafe(F.col("__kept")), "left_semi")


def op5_near_dedup(spark, sf_dir: str) -> DataFrame:
    from knotwork.llm.common import table

    return near_dedup(table(spark, sf_dir, "documents"), words=2, percent=80)


ORACLE_OP5 = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM d),
c AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM c a JOIN c b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
f AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT f.b, r.c FROM r JOIN f ON r.doc_id = f.a)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, k.c AS component_id, s.doc_id = k.c AS kept
FROM s JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) k ON s.doc_id = k.doc_id
"""
