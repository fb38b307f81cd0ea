"""Token ids in binary files: Simple-8b words, with escapes and per-block offsets.

A file is a row of segments, a segment a header, the documents' ids and lengths, the word
offset of every block of ids, and 64-bit words. A word's upper four bits select how many
ids its lower sixty bits hold; selector 0 says that the next word is one whole 64-bit
value. Blocks start at a word boundary, so they are packed and unpacked side by side.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.llm.common import keep, scratch

# Fixed values of the code: ids in a word and bits for each, by selector (0 is the escape).
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
SHORT = np.array([x.bit_length() for x in range(1 << 16)], np.uint8)
BLOCK = 256  # ids
MAGIC = b"TMS8SEG1"
HEADER = "<8sIQQQQQ"  # magic, task, ids before, documents, ids, blocks, words
TEXT_BYTES = 1 << 21  # text that is tokenized at a time and makes a segment
SEGMENTS_PER_FILE = 16
CACHED_WORDS = 400_000  # about 15 MB, and twice that while words are looked up
MARK = "\x01"  # between words that are coded together
# Letters that are one code point in any case and form, and signs after them.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
PARTS = f"^(?P<stem>[{LETTERS}]+)(?P<signs>[!-&(-/:;=?@\\[-`{{-~]*)$"
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
TOGETHER_WORDS = 4_096
TOGETHER_IDS = 1 << 16  # words whose ids are put in place at a time
TOGETHER = 512  # blocks that are packed or unpacked at a time: their arrays stay in the cache


def bit_lengths(values: np.ndarray) -> np.ndarray:
    """Bits of each unsigned 64-bit value."""
    out = np.zeros(values.shape, np.uint8)
    rest = values
    while rest.any():
        out[rest > 0] = out[rest > 0] // 16 * 16 + SHORT[(rest & np.uint64(0xFFFF)).astype(np.int64)][rest > 0]
        rest = rest >> np.uint64(16)
        out[rest > 0] = out[rest > 0] // 16 * 16 + 16
    return out


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the values, and the word offset of each block (one more than blocks)."""
    words, offsets, upto = [np.zeros(0, np.uint64)], [np.zeros(1, np.uint64)], 0
    for lo in range(0, len(values), TOGETHER * BLOCK):
        some, where = _pack(values[lo : lo + TOGETHER * BLOCK])
        words.append(some)
        offsets.append(where[1:] + np.uint64(upto))
        upto += len(some)
    return np.concatenate(words), np.concatenate(offsets)


def _pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(values)
    blocks = -(-n // BLOCK)
    ids = np.zeros((blocks, BLOCK), np.uint64)
    ids.reshape(-1)[:n] = values
    wide = np.zeros((blocks, BLOCK + 120), np.uint64)  # what follows a block counts as zeros
    wide[:, :BLOCK] = ids
    bits = np.zeros((blocks, BLOCK + 120), np.uint8)
    bits[:, :BLOCK] = bit_lengths(ids)
    # the selector for a word that starts here: the most ids that fit
    most, reach = bits[:, :BLOCK].copy(), 1
    best = np.where(most > 60, 0, 15).astype(np.uint8)
    for s in range(14, 0, -1):
        for k in range(reach, COUNTS[s]):
            np.maximum(most, bits[:, k : k + BLOCK], out=most)
        reach = COUNTS[s]
        fits = most <= WIDTHS[s]
        if not fits.any() and most.min() > WIDTHS[1]:
            break  # longer runs only grow wider
        best[fits] = s
    # all blocks take their next word at once
    length = np.full(blocks, BLOCK)
    length[-1] = n - (blocks - 1) * BLOCK
    at, used, alive = np.zeros(blocks, np.int64), np.zeros(blocks, np.int64), np.arange(blocks)
    where, starts, places, which = [], [], [], []
    while len(alive):
        here = at[alive]
        s = best[alive, here]
        where.append(alive)
        starts.append(here)
        places.append(used[alive])
        which.append(s)
        used[alive] += 1 + (s == 0)
        here = here + COUNTS[s]
        at[alive] = here
        alive = alive[here < length[alive]]
    offsets = np.concatenate([[0], np.cumsum(used)])
    block, start, selector = np.concatenate(where), np.concatenate(starts), np.concatenate(which)
    place = np.concatenate(places) + offsets[block]
    flat, first = wide.reshape(-1), block * (BLOCK + 120) + start
    words = np.zeros(int(offsets[-1]), np.uint64)
    for s in range(1, 16):
        mine = np.flatnonzero(selector == s)
        if len(mine):
            word = np.full(len(mine), s << 60, np.uint64)
            at = first[mine]
            for k in range(COUNTS[s] if WIDTHS[s] else 0):
                word |= flat[at + k] << np.uint64(k * WIDTHS[s])
            words[place[mine]] = word
    escaped = np.flatnonzero(selector == 0)
    words[place[escaped] + 1] = flat[first[escaped]]
    return words, offsets.astype(np.uint64)


def unpack(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values; blocks are walked side by side from their offsets."""
    out, at = np.zeros(n, np.uint64), offsets.astype(np.int64)
    for lo in range(0, len(at) - 1, TOGETHER):
        some = at[lo : lo + TOGETHER + 1]
        here = out[lo * BLOCK : (lo + TOGETHER) * BLOCK]
        here[:] = _unpack(words[some[0] : some[-1]], some - some[0])[: len(here)]
    return out


def _unpack(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros((len(offsets) - 1, BLOCK + 120), np.uint64)
    at, ends = offsets[:-1].copy(), offsets[1:]
    filled, alive = np.zeros(len(at), np.int64), np.flatnonzero(at < ends)
    where, places, starts = [], [], []
    selectors = (words >> np.uint64(60)).astype(np.int64)
    while len(alive):
        where.append(alive)
        places.append(at[alive])
        starts.append(filled[alive])
        s = selectors[at[alive]]
        filled[alive] += COUNTS[s]
        at[alive] += 1 + (s == 0)
        alive = alive[at[alive] < ends[alive]]
    if where:
        flat = out.reshape(-1)
        block, place, start = np.concatenate(where), np.concatenate(places), np.concatenate(starts)
        chosen = selectors[place]
        for s in range(2, 16):
            mine = np.flatnonzero(chosen == s)
            mask = np.uint64((1 << int(WIDTHS[s])) - 1)
            first, word = block[mine] * (BLOCK + 120) + start[mine], words[place[mine]]
            for k in range(COUNTS[s] if len(mine) else 0):
                flat[first + k] = (word >> np.uint64(k * WIDTHS[s])) & mask
        raw = np.flatnonzero(chosen == 0)
        out[block[raw], start[raw]] = words[place[raw] + 1]
    return out[:, :BLOCK].reshape(-1)


class WordIds:
    """Ids of words, remembered. The tokenizer drops white space, so that a text's ids are
    those of its words one after the other; ASCII white space never joins two characters.

    Where the tokenizer lowers letters and cuts signs off them, words are remembered as lowered
    stems and signs: many words share them. The first ``CACHED_WORDS`` different ones stay (in Arrow,
    a few bytes more than their letters), which in any natural text are nearly all that come; what is
    beyond is tokenized each time.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark, self.parted = self._mark(), self._parted()
        self.words = pa.array([], pa.string())
        self.flat, self.begin = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    @staticmethod
    def of_worker(path: str) -> WordIds:
        """One for all tasks of a Python worker: it is kept by the tokenizer's library."""
        import tokenizers

        known = tokenizers.__dict__.setdefault("_word_ids", {})
        if path not in known:
            known[path] = WordIds(path)
        return known[path]

    def _mark(self) -> int | None:
        """The id of a control character that stands alone, if it has one: words are coded
        together with it between them, at less cost."""
        found = self.tokenizer.encode(f"a {MARK} b", add_special_tokens=False).ids
        parts = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in ("a", MARK, "b")]
        alone = len(parts[1]) == 1 and found == sum(parts, []) and parts[1][0] not in parts[0] + parts[2]
        return parts[1][0] if alone else None

    def _parted(self) -> bool:
        """Whether a word of letters and signs has the ids of its lowered letters and then those
        of its signs: letters are lowered one by one, and runs of either are coded apart."""
        told = json.loads(self.tokenizer.to_str())
        normal, cut = ((told[k] or {}).get(names, []) for k, names in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
        kinds = [n["type"] for n in normal]
        blanks = all(n["pattern"] == {"Regex": r"\s+"} and n["content"] == " " for n in normal if n["type"] == "Replace")
        split = [{k: c.get(k) for k in ("type", "pattern", "behavior", "invert")} for c in cut[:1]]
        return (
            set(kinds) <= {"NFC", "Replace", "Lowercase"} and "Lowercase" in kinds and blanks
            and split == [{"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}]
            and [(c["type"], c["add_prefix_space"], c["use_regex"]) for c in cut[1:]] == [("ByteLevel", False, False)]
            and all(set(t["content"]) & set("<>") for t in told["added_tokens"])  # no stem or sign is one
        )

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of the words and their ends, if the marks between them can be told apart."""
        if self.mark is None or any(MARK in w for w in words):
            return None
        text = f" {MARK} ".join([*words, ""])
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        marks = np.flatnonzero(ids == self.mark)
        return (np.delete(ids, marks), marks - np.arange(len(marks))) if len(marks) == len(words) else None

    def _apart(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [one.ids for one in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for x in found for i in x], np.uint32), np.cumsum([len(x) for x in found], dtype=np.int64)

    def coded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, and where each one's end."""
        ids, ends, upto = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
        for lo in range(0, len(words), TOGETHER_WORDS):
            some = words[lo : lo + TOGETHER_WORDS]
            found, where = self._together(some) or self._apart(some)
            ids.append(found)
            ends.append(where + upto)
            upto += len(found)
        return np.concatenate(ids), np.concatenate(ends)

    def slots(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, where they begin, and the place of each (different) word: its ids are
        ``ids[begin[place]:begin[place + 1]]``."""
        if not self.parted:
            return self._known(words)
        parts = pc.extract_regex(words, PARTS)
        whole = pc.is_null(parts)
        stems = pc.if_else(whole, words, pc.utf8_lower(pc.struct_field(parts, "stem")))
        signs = pc.fill_null(pc.struct_field(parts, "signs"), "")
        both = pa.concat_arrays([stems, signs]).dictionary_encode()
        flat, begin, place = self._known(both.dictionary)
        pairs = place[both.indices.to_numpy().reshape(2, -1).T.reshape(-1)]  # a word's stem, then its signs
        n = begin[pairs + 1] - begin[pairs]
        ends = np.concatenate([[0], np.cumsum(n)])
        flat = flat[np.repeat(begin[pairs] - ends[:-1], n) + np.arange(ends[-1])]
        return flat, ends[::2], np.arange(len(words))

    def _known(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``slots`` of words that are remembered as they are."""
        known = pc.index_in(words, value_set=self.words)
        new = words.filter(pc.is_null(known))
        place = pc.fill_null(known, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        place[pc.is_null(known).to_numpy(zero_copy_only=False)] = len(self.words) + np.arange(len(new))
        ids, ends = self.coded(new.to_pylist())
        flat, begin = np.concatenate([self.flat, ids]), np.concatenate([self.begin, self.begin[-1] + ends])
        stay = max(0, min(len(new), CACHED_WORDS - len(self.words)))
        if stay:
            self.words = pa.concat_arrays([self.words, new.slice(0, stay)])
            self.begin = begin[: len(self.words) + 1].copy()
            self.flat = flat[: self.begin[-1]].copy()
        return flat, begin, place


def text_ids(coder: WordIds, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each with the end id after it, and their numbers."""
    split = pc.ascii_split_whitespace(texts)
    words = split.flatten()
    full = pc.not_equal(words, "")  # blanks at the ends of a text split off empty words
    upto = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False)
    first = upto[np.concatenate([[0], np.cumsum(sizes)])]
    coded = words.filter(full).dictionary_encode()
    flat, begin, place = coder.slots(coded.dictionary)
    slot = place[coded.indices.to_numpy(zero_copy_only=False)]
    del split, words, full, upto, coded, place
    done = np.concatenate([[0], np.cumsum(begin[slot + 1] - begin[slot])])
    ends = done[first]
    out = np.full(int(done[-1]) + len(texts), end_id, flat.dtype)
    # documents in runs of some words: where ids come from takes eight times the ids' own memory
    cuts = [0, *(np.flatnonzero(np.diff(first[1:] // TOGETHER_IDS)) + 1), len(texts)]
    for lo, hi in zip(cuts, cuts[1:]):
        some = slot[first[lo] : first[hi]]
        n = begin[some + 1] - begin[some]
        gather = np.repeat(begin[some] - (done[first[lo] : first[hi]] - ends[lo]), n)
        gather += np.arange(len(gather))
        part = np.insert(flat[gather], ends[lo + 1 : hi + 1] - ends[lo], end_id)
        out[ends[lo] + lo : ends[hi] + hi] = part
    return out, np.diff(ends) + 1


def segment(task: int, before: int, doc_ids: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> bytes:
    words, offsets = pack(ids)
    null = np.asarray(pc.is_null(doc_ids).to_numpy(zero_copy_only=False), np.uint8)
    numbers = pc.fill_null(doc_ids, 0).to_numpy(zero_copy_only=False)
    head = struct.pack(HEADER, MAGIC, task, before, len(lengths), len(ids), len(offsets) - 1, len(words))
    parts = (numbers.astype("<i8"), lengths.astype("<u8"), null, offsets.astype("<u8"), words.astype("<u8"))
    return head + b"".join(p.tobytes() for p in parts)


def segments(content: memoryview) -> Iterator[tuple]:
    """Task, ids before, document ids (None for NULL), lengths and ids of every segment."""
    at = 0
    while at < len(content):
        magic, task, before, docs, n, blocks, words = struct.unpack_from(HEADER, content, at)
        if magic != MAGIC:
            raise ValueError("not a segment")
        at += struct.calcsize(HEADER)

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(content, kind, count, at)
            at += out.nbytes
            return out

        numbers, lengths, null = take("<i8", docs), take("<u8", docs), take("u1", docs)
        offsets, packed = take("<u8", blocks + 1), take("<u8", words)
        at += 1  # the line end that the text writer puts after a row
        doc_ids = [None if x else int(d) for d, x in zip(numbers, null)]
        yield task, before, doc_ids, lengths.astype(np.int64), unpack(packed, offsets, n)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2) -> None:
    """Writes the ids of all texts in ascending order of doc_id.

    A NULL text is an empty one, a NULL doc_id comes first, documents with equal ids stand
    in the order of a hash of their text. No rows give a file without segments. Columns
    other than doc_id and text are ignored. Spark's text writer puts the segments into
    files, so they reach any file system that Spark writes, and a task that is lost and
    done again leaves one copy.
    """
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("_h", F.xxhash64("text"))
    ranged = slim.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").drop("_h")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder, task, before = WordIds.of_worker(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            size = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
            group = np.cumsum(size) // TEXT_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(size)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    part = batch.slice(lo, hi - lo)
                    ids, lengths = text_ids(coder, part.column("text"), end_id)
                    made = segment(task, before, part.column("doc_id"), ids, lengths)
                    before += len(ids)
                    yield pa.RecordBatch.from_pydict({"value": pa.array([made], pa.binary())})

    rows = ranged.mapInArrow(encode, "value binary").select(F.col("value").cast("string").alias("value"))
    writer = rows.write.option("compression", "none").option("maxRecordsPerFile", SEGMENTS_PER_FILE)
    writer.text(folder)


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Per document: ``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids``."""
    files = spark.read.format("binaryFile").load(folder).select("content")
    names = ["task", "local", "doc_id", "n_tokens", "ids_crc32"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    schema = "task int, local long, doc_id long, n_tokens long, ids_crc32 long"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for task, before, doc_ids, lengths, values in segments(memoryview(content.as_buffer())):
                    ends = np.cumsum(lengths)
                    raw = values.astype("<u4").tobytes()
                    crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends, lengths)]
                    data = [[task] * len(crc), before + ends - lengths, doc_ids, lengths, crc]
                    columns = [pa.array(x, k) for x, k in zip(data, kinds)]
                    if with_ids:
                        edges = np.concatenate([[0], ends]).astype(np.int32)
                        columns.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(values.astype(np.int64))))
                    yield pa.RecordBatch.from_arrays(columns, names + ["ids"] * with_ids)

    rows = keep(files.mapInArrow(decode, schema + ", ids array<long>" * with_ids), "decoded")
    # one row per writing task
    sums = rows.groupBy("task").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    out = rows.join(base, "task").withColumn("start", F.col("_base") + F.col("local"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)


def tokenize(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Writes the ids of all documents to the shared folder and reads them back."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    folder = scratch(docs.sparkSession, "tokens")
    write_tokens(docs, folder, str(tokenizer), end_id)
    return read_tokens(docs.sparkSession, folder)


def run(spark: SparkSession, sf: str) -> DataFrame:
    return tokenize(spark.read.parquet(f"{sf}/documents.parquet"))
