"""Token-id output as directly addressable codes.

An id's bits are split over levels of chunks. A level stores the chunks of the ids that reach it back to back, a
continuation bitmap (one bit a chunk: another level follows), and a rank directory (ones before each block of the
bitmap). The place of an id's chunk on the next level is the rank of its bit, so any id is read in a few steps without
decoding others. Level widths are chosen for each file from its histogram of id lengths.

File: magic, json header (counts, widths, array lengths), then doc ids, document bounds, and per level the packed
chunks, the packed bitmap and the rank directory. A range partition of the ids is one file or
several, in ascending order.
"""

from __future__ import annotations

import atexit
import json
import os
import re
import uuid
import zlib
from functools import lru_cache, partial
from itertools import chain, combinations, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.llm.common import cut, digest_input, prepare, shared_dir, slices, table, tidy, utf8_buffers

MAGIC, BLOCK, END_ID = b"KWDAC1\n\0", 512, 2
#: Ids of a file, and ids read at a time.
FILE_IDS, RUN_IDS = 1 << 22, 1 << 18
MANIFEST = "part int, file int, path string, docs long, ids long"
#: A space between white space and more white space or the end: the one case in which cutting before a space changes the pieces.
_SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_RISKY = rf"[{_SPACE}] (?:[{_SPACE}]|\z)|<\|"
#: Words that may be encoded a line each, fewer bytes than this, and lines of a text that the library is given.
_LINE, LINE_BYTES, LINES = rf"\A ?[^{_SPACE}]+\z", 64, 256


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,!?;:|$*#%&)\""]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), *range(28, 33)]] = True


def safe_cuts(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where texts may be cut without changing a piece, as sorted byte positions with every text's begin.

    The tokenizer's pieces are runs of letters, of digits or of other marks, each with one space before it at most, and
    runs of white space. So a cut is safe before a space (callers see to runs of white space), between a Latin letter
    and a plain mark, and around a line feed between non-spaces.
    """
    n = len(raw)
    cut = raw == 32

    def wide(at):  # the second byte of a Latin letter beyond ASCII; the byte before a text's first is no 0xC3
        return (raw[at - 1] == 0xC3) & (raw[at] != 0x97) & (raw[at] != 0xB7) & (at > 0)

    mark = np.flatnonzero(_MARK[raw[1:]])  # places less one, so the bytes before the marks
    cut[mark[_LETTER[raw[mark]] | wide(mark)] + 1] = True
    feed = np.flatnonzero(raw[1:-1] == 10) + 1
    before = feed - 1
    alone = feed[(~_BLANK[raw[before]] & (raw[before] < 0x80) | wide(before)) & _LETTER[raw[feed + 1]]]
    cut[alone] = cut[alone + 1] = True
    cut[offs[:-1][offs[:-1] < n]] = True
    return np.flatnonzero(cut)


class WordEncoder:
    """Byte-level BPE of whole texts by the tokenizers library, each distinct word encoded once.

    Texts are cut at safe places and the parts encoded; texts with a space inside a run of white space, or with what
    looks like a special token, are encoded as a whole. New words go to the library many at a time, a line each.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        self.feed = self._encode(["\n"])[0]
        self.forget()

    def forget(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.pool, self.first, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these words, one word after the other, and how many each has."""
        ids = self._encode([w.decode() for w in words])
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum())), size

    def _lines(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_each``, for words without white space but a space before them.

        A line feed before such a word or its space is a piece of its own, so no id spans two words and the line feed's
        id is found between them alone. A tokenizer of which this is not true gives another number of line feeds.
        """
        ids = self._encode(["\n".join([w.decode() for w in words[a : a + LINES]]) + "\n" for a in range(0, len(words), LINES)])
        ids = np.fromiter(chain.from_iterable(ids), np.uint32, sum(map(len, ids)))
        ends = np.flatnonzero(ids == self.feed[0]) if len(self.feed) == 1 else ()
        if len(ends) != len(words):
            return self._each(words)
        return ids[ids != self.feed[0]], np.diff(ends, prepend=-1) - 1

    def words(self, names: list[bytes]) -> np.ndarray:
        """Slots of these distinct words. What is remembered is bounded; a forgotten word is encoded again."""
        found = np.fromiter(map(self.slot.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(found < 0)
        if len(self.slot) + len(new) > self.most:
            self.forget()
            new = np.arange(len(names))
        if len(new):
            texts = pa.array([names[i] for i in new.tolist()], pa.large_binary()).cast(pa.large_string())
            line = pc.and_(pc.less(pc.binary_length(texts), LINE_BYTES), pc.match_substring_regex(texts, _LINE)).to_numpy(zero_copy_only=False)
            for new, encode in ((new[line], self._lines), (new[~line], self._each)):
                own, n = [names[i] for i in new.tolist()], len(self.slot)
                ids, size = encode(own)
                self.first = np.concatenate((self.first, len(self.pool) + np.cumsum(size) - size))
                self.size = np.concatenate((self.size, size))
                self.pool = np.concatenate((self.pool, ids))
                found[new] = np.arange(n, n + len(own))
                self.slot.update(zip(own, range(n, n + len(own)), strict=True))
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids and each text's first, for an array without nulls."""
        n = len(texts)
        risky = pc.match_substring_regex(texts, _RISKY)
        raw, offs = utf8_buffers(pc.if_else(risky, "", texts) if pc.any(risky).as_py() else texts)
        begin = safe_cuts(raw, offs) if len(raw) else np.zeros(0, np.int64)
        parts = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.append(begin, len(raw)).astype(np.int64)), pa.py_buffer(raw.tobytes())])
        coded = parts.dictionary_encode()
        slot = self.words(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        k = self.size[slot]
        total = np.cumsum(k)
        place = np.repeat((self.first[slot] - (total - k)).astype(np.int32), k)
        place += np.arange(len(place), dtype=np.int32)
        ids = self.pool[place]
        at = np.concatenate(([0], total))[np.searchsorted(begin, offs)]
        whole = np.flatnonzero(risky.to_numpy(zero_copy_only=False))
        if len(whole):
            extra = [np.array(x, np.uint32) for x in self._encode([texts[int(d)].as_py() for d in whole])]
            ids = np.insert(ids, np.repeat(at[whole], [len(x) for x in extra]), np.concatenate(extra))
            longer = np.zeros(n + 1, np.int64)
            longer[whole + 1] = [len(x) for x in extra]
            at = at + np.cumsum(longer)
        return ids, at


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def choose_widths(histogram: np.ndarray, most_levels: int = 4) -> tuple[int, ...]:
    """Chunk widths with the fewest bits for ids whose bit lengths are counted in ``histogram`` (index: bits)."""
    top = max(1, int(np.flatnonzero(histogram)[-1]) if histogram.any() else 1)
    above = lambda b: int(histogram[b + 1 :].sum())
    best = None
    for k in range(min(most_levels, top)):
        for inner in combinations(range(1, top), k):
            ends = (*inner, top)
            cost, low = 0, 0
            for e in ends:
                cost += (above(low) if low else int(histogram.sum())) * (e - low + (e < top))
                low = e
            if best is None or cost < best[0]:
                best = (cost, tuple(int(b - a) for a, b in zip((0, *ends), ends, strict=False)))
        if k == 1 and top > 20:
            break
    return best[1]


def _places(width: int):
    """Of eight values of ``width`` bits, which are ``width`` bytes: number, 64-bit word, bit in it, whether it ends in the next."""
    for j in range(8):
        word, bit = divmod(j * width, 64)
        yield j, word, np.uint64(bit), bit + width > 64


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    if width in (8, 16):
        return values.astype(f"<u{width // 8}").view(np.uint8)
    out = np.empty(-(-len(values) * width // 8), np.uint8)
    for a in range(0, len(values), 1 << 15):  # a multiple of 8 values: every part ends on a byte
        n = min(1 << 15, len(values) - a)
        v = np.zeros((-(-n // 8), 8), np.uint64)
        v.reshape(-1)[:n] = values[a : a + n]
        words = np.zeros((len(v), -(-width // 8)), "<u8")
        for j, word, bit, over in _places(width):
            words[:, word] |= v[:, j] << bit
            if over:
                words[:, word + 1] |= v[:, j] >> (np.uint64(64) - bit)
        own = -(-n * width // 8)
        out[a * width // 8 :][:own] = words.view(np.uint8)[:, :width].reshape(-1)[:own]
    return out


def _unpack(raw: np.ndarray, width: int, n: int) -> np.ndarray:
    if width in (8, 16):
        return raw[: n * width // 8].view(f"<u{width // 8}").astype(np.uint32)
    out = np.empty((-(-n // 8), 8), np.uint32)
    for a in range(0, len(out), 1 << 12):
        own = out[a : a + (1 << 12)]
        part = raw[a * width : (a + len(own)) * width]
        if len(part) < len(own) * width:
            part = np.concatenate((part, np.zeros(len(own) * width - len(part), np.uint8)))
        words = np.zeros((len(own), -(-width // 8)), "<u8")
        words.view(np.uint8)[:, :width] = part.reshape(-1, width)
        for j, word, bit, over in _places(width):
            v = words[:, word] >> bit
            if over:
                v |= words[:, word + 1] << (np.uint64(64) - bit)
            own[:, j] = v & np.uint64((1 << width) - 1)
    return out.reshape(-1)[:n]


def dac_encode(ids: np.ndarray, doc_ids: np.ndarray, bounds: np.ndarray, nulls: int = 0) -> bytes:
    """One file's bytes. ``bounds``: where each document begins, and the end; the first ``nulls`` documents have no id."""
    edges = np.uint64(1) << np.arange(32, dtype=np.uint64)
    values, often = (np.arange(1 << 16), np.bincount(ids, minlength=1 << 16)) if ids.max(initial=0) < 1 << 16 else np.unique(ids, return_counts=True)
    widths = choose_widths(np.bincount(np.searchsorted(edges, values.astype(np.uint64), "right"), often, 33).astype(np.int64))
    parts, levels, rest = [], [], ids.astype(np.uint32)
    for k, w in enumerate(widths):
        last = k == len(widths) - 1
        chunk = rest & np.uint32((1 << w) - 1)
        higher = (rest >> np.uint32(w)) if w < 32 else np.zeros_like(rest)
        go_on = higher > 0
        own = [_pack(chunk, w).tobytes()]
        if not last:
            ones = np.add.reduceat(go_on.astype(np.int64), np.arange(0, max(len(go_on), 1), BLOCK)) if len(go_on) else np.zeros(0, np.int64)
            own += [np.packbits(go_on, bitorder="little").tobytes(), np.concatenate(([0], np.cumsum(ones)))[:-1].astype("<u8").tobytes() if len(ones) else b""]
        levels.append({"width": w, "n": len(rest), "sizes": [len(x) for x in own]})
        parts += own
        rest = higher[go_on]
    head = json.dumps({"docs": len(doc_ids), "nulls": nulls, "ids": len(ids), "levels": levels}).encode()
    return b"".join([MAGIC, len(head).to_bytes(8, "little"), head, doc_ids.astype("<i8").tobytes(), bounds.astype("<u8").tobytes(), *parts])


class DacFile:
    """Random access to the ids of one file: ``get(i)`` reads one id, ``slice(a, b)`` a run of them.

    ``source``: the file's bytes, or a file that ``pyarrow.fs`` opened; of a file only the header and the bytes that a
    call needs are read.
    """

    def __init__(self, source):
        self.source = source
        head = self._bytes(0, 16)
        if head[:8] != MAGIC:
            raise ValueError("not a token file")
        n = int.from_bytes(head[8:], "little")
        self.head = json.loads(self._bytes(16, n))
        docs, at = self.head["docs"], 16 + n
        self.doc_ids = np.frombuffer(self._bytes(at, 8 * docs), "<i8")
        self.bounds = np.frombuffer(self._bytes(at + 8 * docs, 8 * docs + 8), "<u8").astype(np.int64)
        at += 16 * docs + 8
        self.levels = []  # width, number, and where chunks, bitmap and rank directory begin
        for lv in self.head["levels"]:
            sizes = [*lv["sizes"], 0, 0][:3]
            self.levels.append((lv["width"], lv["n"], at, at + sizes[0] if len(lv["sizes"]) > 1 else None, at + sizes[0] + sizes[1]))
            at += sum(sizes)

    def _bytes(self, at: int, n: int) -> bytes:
        return self.source[at : at + n] if isinstance(self.source, bytes) else self.source.read_at(n, at)

    def _rank(self, level: int, i: int) -> int:
        """Ones before place ``i`` of a level's bitmap: an entry of the directory, and at most a block of bits."""
        _, n, _, bitmap, ranks = self.levels[level]
        block = min(i, n - 1) // BLOCK
        bits = np.frombuffer(self._bytes(bitmap + block * BLOCK // 8, (i - block * BLOCK + 7) // 8), np.uint8)
        return int.from_bytes(self._bytes(ranks + 8 * block, 8), "little") + int(np.unpackbits(bits, bitorder="little")[: i - block * BLOCK].sum())

    def get(self, i: int) -> int:
        return int(self.slice(i, i + 1)[0])

    def slice(self, a: int, b: int) -> np.ndarray:
        """The ids at places ``a`` to ``b - 1``: on each level one run of chunks and bits, found by two ranks on the one before."""
        out, where, shift = np.zeros(b - a, np.uint32), None, 0  # where: None for all
        for level, (width, _, chunks, bitmap, _) in enumerate(self.levels):
            if a >= b:
                break
            first, skip = a // 8 * width, a % 8  # eight chunks end on a byte
            raw = np.frombuffer(self._bytes(chunks + first, -(-(b * width) // 8) - first), np.uint8)
            chunk = _unpack(raw, width, skip + b - a)[skip:]
            if where is None:
                out = chunk
            else:
                out[where] |= chunk << np.uint32(shift)
            if bitmap is None:
                break
            bits = np.frombuffer(self._bytes(bitmap + a // 8, (b + 7) // 8 - a // 8), np.uint8)
            on = np.flatnonzero(np.unpackbits(bits, bitorder="little")[a % 8 : a % 8 + b - a].view(bool))
            where = on if where is None else where[on]
            a, b, shift = self._rank(level, a), self._rank(level, b), shift + width
        return out

    def all(self) -> np.ndarray:
        return self.slice(0, self.head["ids"])


def _open(uri: str):
    return pa.fs.FileSystem.from_uri(uri)


def _write(batches, folder: str, tokenizer: str, end_id: int, most: int):
    """Encode one sorted partition and write its files, each of ``most`` ids or, for its last document, as many as that has.

    Names hold the attempt, so tasks that run again or twice write beside each other; the manifest names the files that count.
    """
    ids, docs, nulls, counts, held, done = [], [], [], [], 0, 0
    task = TaskContext.get()
    part = task.partitionId()
    fs, root = _open(folder)

    def write():
        own, bounds = np.concatenate(docs), np.concatenate(([0], np.cumsum(np.concatenate(counts))))
        fs.create_dir(root, recursive=True)
        name = f"part-{part:06d}-{done:05d}-{task.taskAttemptId()}.dac"
        with fs.open_output_stream(f"{root}/{name}") as f:
            f.write(dac_encode(np.concatenate(ids), own, bounds, sum(nulls)))
        return pa.record_batch([pa.array([part], pa.int32()), pa.array([done], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([len(own)]), pa.array([int(bounds[-1])])], names=["part", "file", "path", "docs", "ids"])

    for whole in batches:
        for b in slices(whole, "text", min(4 << 20, 4 * most)):
            x, at = encoder(tokenizer).encode(b.column(1))
            x = np.insert(x, at[1:], np.uint32(end_id)).astype(np.uint16 if x.max(initial=0) < 65536 else np.uint32)
            ids.append(x)
            counts.append(np.diff(at) + 1)
            nulls.append(b.column(0).null_count)
            docs.append(b.column(0).fill_null(0).to_numpy(zero_copy_only=False))
            held += len(x)
            if held >= most:
                yield write()
                ids, docs, nulls, counts, held, done = [], [], [], [], 0, done + 1
    if docs:
        yield write()


def write_token_files(df: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the ids of all texts in ascending id order, and return the manifest ``part, file, path, docs, ids, before``.

    Null texts are empty (only the end id); null ids come first; rows that repeat an id follow in an order fixed by their
    text. An empty table writes no file. ``folder`` is a URI that all executors reach (a fresh one in the shared folder by
    default, removed when the driver's Python ends). ``before`` counts the ids of all files before.
    """
    spark = prepare(df.sparkSession)
    if folder is None:
        folder = f"{shared_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
        folder = folder if re.match(r"\w+:", folder) else f"file://{folder}"
        atexit.register(_remove, folder)
    d = digest_input(df, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    done = d.mapInArrow(tidy(partial(_write, folder=folder, tokenizer=tokenizer, end_id=end_id, most=file_ids)), MANIFEST)
    done = cut(done.repartition(1))  # a row for each file: one checkpoint file and not one a task, as local file systems start a process for each
    order = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    return done.withColumn("before", F.coalesce(F.sum("ids").over(order), F.lit(0)))


def _remove(folder: str) -> None:
    try:
        fs, root = _open(folder)
        fs.delete_dir(root)
    except OSError:
        return


def _read(batches):
    for b in batches:
        for path, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            fs, name = _open(path)
            with fs.open_input_file(name) as f:
                dac = DacFile(f)
                at, n, k = dac.bounds, dac.head["docs"], 0
                while k < n:  # some documents at a time, by random access
                    end = max(k + 1, int(np.searchsorted(at, at[k] + RUN_IDS, "right")) - 1)
                    ids, own = dac.slice(int(at[k]), int(at[end])).astype("<u4"), at[k : end + 1] - at[k]
                    crc = [zlib.crc32(ids[x:y]) for x, y in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)]
                    yield pa.record_batch([pa.array(dac.doc_ids[k:end], pa.int64(), mask=np.arange(k, end) < dac.head["nulls"]), pa.array(at[k:end] + before), pa.array(np.diff(own)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    k = end


def read_token_files(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files, from the files alone."""
    paths = manifest.select("path", "before")
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number given outright is not coalesced: paths are small, files are not
    return paths.repartition(tasks, "path").mapInArrow(tidy(_read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
