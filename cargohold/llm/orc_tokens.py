"""Token ids in ORC: integer run lengths, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cargohold.llm.common import give_back, kept, mix, slices, small_batches, staged, utf8

#: Written after every document.
END_ID = 2
#: Writer settings: a Bloom filter and a row index entry for every ROWS_PER_INDEX rows let readers skip parts of a stripe.
ROWS_PER_INDEX, STRIPE_BYTES = 1000, 16 << 20
#: Distinct pre-tokens that a worker remembers; beyond, those that were met again stay.
REMEMBERED = 600_000
_SLOTS = 1 << 20
#: New pre-tokens that the library encodes as one text.
JOINED = 100
#: Parts that a character can have in the pattern below, and those whose part isn't certain.
LETTER, NUMBER, BLANK, BREAK, OTHER, UNSURE = range(6)
#: The pre-tokenizer that is followed here (fixed values): byte-level with the pattern
#: 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
SHORT_FORMS, LONG_FORMS = b"stmd", (b"re", b"ve", b"ll")


@cache
def _classes() -> np.ndarray:
    """Class of every code point; those whose part in the pattern isn't certain are UNSURE."""
    table = np.full(0x110000, UNSURE, np.uint8)
    for i in range(0x20, 0x10000):
        kind = unicodedata.category(chr(i))
        if kind[0] in "LN":
            table[i] = LETTER if kind[0] == "L" else NUMBER
        elif kind[0] in "PSM":
            table[i] = OTHER
    table[0x20], table[0x09:0x0E] = BLANK, BREAK
    return table


def byte_classes(data: np.ndarray) -> np.ndarray:
    """Class of the character that each byte of UTF-8 text belongs to."""
    kind = _classes()[:256][data]
    if (data >= 0x80).any():
        lead = np.flatnonzero(data >= 0xC0)
        more = np.append(data, np.zeros(3, np.uint8))
        tail = [(more[lead + k] & 0x3F).astype(np.int32) for k in (1, 2, 3)]
        first = data[lead].astype(np.int32)
        two, three = first < 0xE0, first < 0xF0
        code = np.where(
            two, (first & 0x1F) << 6 | tail[0], np.where(three, (first & 0x0F) << 12 | tail[0] << 6 | tail[1], (first & 0x07) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2])
        )
        found = _classes()[np.minimum(code, 0x10FFFF)]
        for k, here in ((0, slice(None)), (1, slice(None)), (2, ~two), (3, ~three)):
            kind[lead[here] + k] = found[here]
    return kind


def pretoken_starts(data: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of UTF-8 texts without UNSURE characters begin; `offsets` are the texts' places and the end."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    fresh = np.zeros(n + 1, bool)
    fresh[offsets] = True
    white = (kind == BLANK) | (kind == BREAK)
    start = fresh[:-1].copy()
    inner = ~start[1:]
    # A character begins a pre-token where its class changes, unless the blank before it is part of its pre-token.
    start[1:] |= ~white[1:] & (kind[1:] != kind[:-1]) & (kind[:-1] != BLANK) & inner
    # A run of white space is one pre-token but for its last character, if something follows it.
    ends = ~(white[1:] | fresh[1:-1]) & white[:-1]
    start[1:] |= white[1:] & ~white[:-1] & inner
    start[:-1] |= ends
    marks = np.flatnonzero(start & (data == 0x27))
    if len(marks):
        after = np.append(data, np.zeros(3, np.uint8))
        end = offsets[np.searchsorted(offsets, marks, "right")]
        short = np.isin(after[marks + 1], np.frombuffer(SHORT_FORMS, np.uint8)) & (marks + 1 < end)
        long = np.zeros(len(marks), bool)
        for form in LONG_FORMS:
            long |= (after[marks + 1] == form[0]) & (after[marks + 2] == form[1]) & (marks + 2 < end)
        for which, size in ((short, 2), (long, 3)):
            at, stop = marks[which], end[which]
            start[at + 1] = False
            then = at[at + size < stop] + size
            start[then[~white[then]]] = True
    return np.flatnonzero(start)


class Encoder:
    """Byte-level BPE ids of whole texts, by the tokenizers library, with a memory of pre-tokens.

    Merges never cross pre-tokens. Where the tokenizer's file names the pre-tokenizer that is followed here, texts are
    cut into pre-tokens as bytes, all texts of a batch at once, and the library encodes each pre-token it has not yet
    seen. Texts with rare characters or added tokens, and all texts of another tokenizer, go to the library whole. Either way the
    ids are the library's for the whole text.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        made = json.loads(self.library.to_str())
        cutter = made.get("pre_tokenizer") or {}
        self.known = {k: cutter.get(k) for k in BYTE_LEVEL} == BYTE_LEVEL and not any(made.get(k) for k in ("normalizer", "truncation", "padding"))
        self.known &= made["model"].get("type") == "BPE" and not made["model"].get("dropout")
        alone = self.library.encode("\n", add_special_tokens=False).ids
        self.line_break = alone[0] if len(alone) == 1 else -1
        self.forget()

    def forget(self) -> None:
        self.low, self.high = np.zeros(_SLOTS, np.uint64), np.zeros(_SLOTS, np.uint64)
        self.length, self.entry = np.zeros(_SLOTS, np.uint8), np.zeros(_SLOTS, np.int32)
        self.long: dict[bytes, int] = {}
        self.first, self.count, self.uses = (np.zeros(REMEMBERED + 1, t) for t in (np.int64, np.int32, np.int32))
        self.ids, self.filled, self.entries = np.zeros(1 << 20, np.int32), 0, 0

    def thin_out(self) -> None:
        """Forget pre-tokens met once only, or if these are few, the less used half."""
        if not self.entries:
            return
        uses, slots = self.uses[: self.entries], np.flatnonzero(self.length)
        least = max(2, int(np.median(uses)) + 1)
        stay = np.flatnonzero(uses >= least)[: REMEMBERED // 2]
        number = np.full(self.entries, -1, np.int32)
        number[stay] = np.arange(len(stay))
        slots = slots[number[self.entry[slots]] >= 0]
        held = self.low[slots], self.high[slots], self.length[slots], number[self.entry[slots]]
        long = {t: int(number[e]) for t, e in self.long.items() if number[e] >= 0}
        first, count, ids, uses = self.first[stay], self.count[stay], self.ids, uses[stay] // 2
        self.forget()
        ends = np.cumsum(count.astype(np.int64))
        self.entries, self.filled, self.long = len(stay), int(ends[-1]) if len(stay) else 0, long
        self.ids = np.zeros(max(len(ids), 1 << 20), np.int32)
        self.ids[: self.filled] = ids[np.repeat(first - ends + count, count) + np.arange(self.filled)]
        self.first[: len(stay)], self.count[: len(stay)], self.uses[: len(stay)] = ends - count, count, uses
        self._place(*held)

    @staticmethod
    def _slot(low: np.ndarray, high: np.ndarray, length: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(low ^ (mix(high) + length.astype(np.uint64))) & np.uint64(_SLOTS - 1)).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Entry of each short pre-token, -1 if it is new."""
        at = self._slot(low, high, length)
        found, left = np.full(len(low), -1, np.int64), np.arange(len(low))
        while len(left):
            slot = at[left]
            taken = self.length[slot] > 0
            same = taken & (self.length[slot] == length[left]) & (self.low[slot] == low[left]) & (self.high[slot] == high[left])
            found[left[same]] = self.entry[slot[same]]
            left = left[taken & ~same]
            at[left] = (at[left] + 1) & (_SLOTS - 1)
        return found

    def _place(self, low: np.ndarray, high: np.ndarray, length: np.ndarray, entry: np.ndarray) -> None:
        """Put new, distinct pre-tokens into free slots; where several want one, the last gets it and the others move on."""
        at, left = self._slot(low, high, length), np.arange(len(low))
        while len(left):
            slot = at[left]
            free = self.length[slot] == 0
            self.entry[slot[free]] = entry[left[free]]
            won = free & (self.entry[slot] == entry[left])
            mine, where = left[won], slot[won]
            self.low[where], self.high[where], self.length[where] = low[mine], high[mine], length[mine]
            left = left[~won]
            at[left] = (at[left] + 1) & (_SLOTS - 1)

    def _encode_tokens(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of single pre-tokens one after another, the number of each, and which pre-token that is.

        Those without white space but a leading blank are encoded JOINED at a time with line breaks between.
        """
        simple = [i for i, t in enumerate(tokens) if not (t[-1].isspace() or t[:2].isspace())]
        alone = sorted(set(range(len(tokens))).difference(simple))
        groups = [simple[k : k + JOINED] for k in range(0, len(simple), JOINED)]
        flat, sizes, order = [], [], []
        for group, e in zip(groups, self.library.encode_batch_fast(["\n".join([tokens[i] for i in g]) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.int32)
            cuts = np.flatnonzero(ids == self.line_break)
            if len(cuts) != len(group) - 1:
                alone += group
                continue
            flat.append(np.delete(ids, cuts))
            sizes.append(np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1)
            order += group
        for i, e in zip(alone, self.library.encode_batch_fast([tokens[i] for i in alone], add_special_tokens=False), strict=True):
            flat.append(np.array(e.ids, np.int32))
            sizes.append([len(e.ids)])
        return np.concatenate(flat), np.concatenate(sizes).astype(np.int64), np.array(order + alone, np.int64)

    def _learn(self, tokens: list[bytes], low: np.ndarray, high: np.ndarray, length: np.ndarray) -> None:
        flat, sizes, order = self._encode_tokens([t.decode() for t in tokens])
        if self.filled + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(flat)), np.int32)])
        self.ids[self.filled : self.filled + len(flat)] = flat
        self.first[self.entries + order], self.count[self.entries + order] = self.filled + np.cumsum(sizes) - sizes, sizes
        entry = self.entries + np.arange(len(tokens))
        self.filled, self.entries = self.filled + len(flat), self.entries + len(tokens)
        short = length <= 16
        self.long.update((tokens[i], int(entry[i])) for i in np.flatnonzero(~short))
        self._place(low[short], high[short], length[short].astype(np.uint8), entry[short].astype(np.int32))

    def _entries(self, data: bytes, begin: np.ndarray, length: np.ndarray) -> np.ndarray | None:
        """Entry of each pre-token, learning the new ones; None if there are more of these than can be remembered."""
        words = np.ndarray((len(data) + 8,), "<u8", data + bytes(16), strides=(1,))
        masks = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
        low = words[begin] & masks[np.minimum(length, 8)]
        high = words[np.minimum(begin + 8, len(data) + 7)] & masks[np.clip(length - 8, 0, 8)]
        short = length <= 16
        for room in (self.thin_out, self.forget, None):
            entry = np.full(len(begin), -1, np.int64)
            entry[short] = self._find(low[short], high[short], length[short])
            for i in np.flatnonzero(~short):
                entry[i] = self.long.get(data[begin[i] : begin[i] + length[i]], -1)
            new = np.flatnonzero(entry < 0)
            tokens = [data[b : b + n] for b, n in zip(begin[new].tolist(), length[new].tolist(), strict=True)]
            fresh = dict(zip(tokens, new.tolist(), strict=True))
            if self.entries + len(fresh) > REMEMBERED:
                if room is None:
                    return None
                room()
                continue
            if len(new):
                known = dict(zip(fresh, range(self.entries, self.entries + len(fresh)), strict=True))
                at = np.fromiter(fresh.values(), np.int64, len(fresh))
                self._learn(list(fresh), low[at], high[at], length[at])
                entry[new] = np.fromiter(map(known.__getitem__, tokens), np.int64, len(new))
            self.uses += np.bincount(entry, minlength=len(self.uses)).astype(np.int32)
            return entry
        return None

    def _plain(self, data: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        starts = pretoken_starts(data, kind, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        raw = data.tobytes()
        entry = self._entries(raw, starts, np.diff(np.append(starts, len(data))))
        if entry is None:
            return self._each([raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
        count = self.count[entry].astype(np.int64)
        upto = np.cumsum(count)
        ids = self.ids[np.repeat(self.first[entry] - upto + count, count) + np.arange(upto[-1])]
        sums = np.append(0, upto)[np.searchsorted(starts, offsets)]
        return ids, np.diff(sums)

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [self.library.encode(t, add_special_tokens=False).ids for t in texts]
        sizes = np.array([len(x) for x in lists], np.int64)
        return np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum())), sizes

    def _whole(self, data: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts the library must get whole: those with uncertain characters or added tokens."""
        if not self.known:
            return np.ones(len(offsets) - 1, bool)
        at, raw = list(np.flatnonzero(kind == UNSURE)), data.tobytes()
        for token in self.added:
            place = raw.find(token)
            while place >= 0:
                at.append(place)
                place = raw.find(token, place + 1)
        out = np.zeros(len(offsets) - 1, bool)
        if at:
            out[np.searchsorted(offsets, np.unique(at), "right") - 1] = True
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty) one after another, each closed by END_ID, and the offsets of the texts."""
        data, offsets = utf8(column)
        kind = byte_classes(data)
        whole = self._whole(data, kind, offsets)
        sizes, parts = np.zeros(len(whole), np.int64), {}
        if whole.any():
            at = np.flatnonzero(whole)
            parts[True], sizes[at] = self._each([data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in at])
        at = np.flatnonzero(~whole)
        if len(at):
            if whole.any():
                stay = np.repeat(~whole, np.diff(offsets))
                data, kind, offsets = data[stay], kind[stay], np.append(0, np.cumsum(np.diff(offsets)[at]))
            parts[False], sizes[at] = self._plain(data, kind, offsets)
        ends = np.append(0, np.cumsum(sizes + 1))
        out = np.full(ends[-1], END_ID, np.int32)
        for flag, ids in parts.items():
            at = np.flatnonzero(whole == flag)
            n = sizes[at]
            out[np.repeat(ends[at] - np.cumsum(n) + n, n) + np.arange(len(ids))] = ids
        return out, ends


def encoder(path: str) -> Encoder:
    return kept(("encoder", path), lambda: Encoder(path))


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                ids, offsets = encoder(path).encode(batch.column("text"))
                n = batch.num_rows
                yield pa.record_batch(
                    {
                        "part": pa.array(np.full(n, part, np.int32)),
                        "pos": pa.array(np.arange(row, row + n)),
                        "doc_id": batch.column("doc_id"),
                        "ids": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)),
                    }
                )
                row += n
        give_back()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """ORC files of (part, pos, doc_id, ids), ascending by document id from file to file and within each.

    `part` and `pos` are a row's file and place. Null texts count as empty: such a document holds the end id only.
    A null id comes first; rows that repeat an id stand beside each other, by text. Texts are encoded whole, however
    long. An empty table gives files without rows. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    encoded = ordered.mapInArrow(_encode(tokenizer), "part int, pos long, doc_id long, ids array<int>")
    writer = encoded.write.option("compression", "zstd").option("orc.bloom.filter.columns", "doc_id")
    with small_batches(docs.sparkSession):
        writer.option("orc.row.index.stride", ROWS_PER_INDEX).option("orc.stripe.size", STRIPE_BYTES).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows; a filter on doc_id skips stripes and row groups by their statistics and Bloom filters."""
    return spark.read.schema("part int, pos long, doc_id long, ids array<int>").orc(path)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4")
        crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.record_batch(
            {**{c: batch.column(c) for c in ("part", "pos", "doc_id")}, "n_tokens": pa.array(np.diff(offsets).astype(np.int64)), "ids_crc32": pa.array(crc, pa.int64())}
        )


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files."""
    rows = staged(read_tokens(spark, path).mapInArrow(_sums, "part int, pos long, doc_id long, n_tokens long, ids_crc32 long"), "token-sums")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)) + F.col("ahead")
    return rows.join(staged(parts, "token-parts"), "part").select("doc_id", start.alias("start"), "n_tokens", "ids_crc32")
