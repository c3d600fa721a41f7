"""Byte-level BPE: encoding by a pair occurrence index, and decoding."""

from __future__ import annotations

import heapq
import json
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stormgrid.llm.common import gathered, sliced, small_batches, table

TOKENIZER = "byte_bpe_50k.json"

# The split pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Texts are gathered up to so many bytes, and their new words merged together in lots of so many
#: bytes. A worker forgets its words once it holds so many, or so many bytes of them.
GATHER_BYTES = 8 << 20
LOT_BYTES = 1 << 20
MOST_WORDS = 200_000
MOST_BYTES = 16 << 20
#: Texts of more characters than this are split word by word, not into one list.
LONG_TEXT = 1 << 20

_loaded: dict[str, Vocabulary] = {}


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in such vocabularies: itself, or the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


def check_kind(spec: dict) -> None:
    """Refuse vocabulary files that ask for other steps than splitting by ``PATTERN`` and merging bytes."""
    split, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain_split = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    flags = ("single_word", "lstrip", "rstrip", "normalized")
    plain_special = not any(x.get(k) for x in spec.get("added_tokens", []) for k in flags)
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
    if spec.get("normalizer") or spec.get("post_processor") or not plain_split or not plain_special or any(model.get(k) for k in odd):
        raise ValueError("the vocabulary is not plain byte-level BPE: it has a normaliser, another split, or merge options")


class Vocabulary:
    """Merge ranks, token bytes, and the words that this worker has merged so far."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_kind(spec)
        ids: dict[str, int] = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        symbols = byte_symbols()
        back = {s: b for b, s in enumerate(symbols)}
        self.size = max([*ids.values(), *self.special.values()]) + 1
        self.first = np.array([ids[s] for s in symbols], np.int32)
        pieces = [b""] * self.size
        for token, i in ids.items():
            pieces[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            pieces[i] = token.encode()
        self.lengths = np.array([len(x) for x in pieces], np.int32)
        self.starts = np.cumsum(self.lengths, dtype=np.int32) - self.lengths
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([ids[a] * self.size + ids[b] for a, b in merges], np.int64)
        made = np.array([ids[a + b] for a, b in merges], np.int64)
        self.by_key = np.argsort(keys, kind="stable")
        # One key more than any pair has, so that every search ends inside.
        self.keys = np.append(keys[self.by_key], np.iinfo(np.int64).max)
        self.by_key = np.append(self.by_key, -1)
        self.made, self.pair = made, keys
        self.split = regex.compile(PATTERN)
        self.parts = (
            regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
            if self.special
            else None
        )
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, int] = defaultdict(count().__next__)
        for s in self.special:
            self.words[s]
        own = np.array(list(self.special.values()), np.int32)
        self.ids, self.counts = [own], [np.ones(len(own), np.int32)]
        self.held = 0

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of tokens, or -1."""
        key = left.astype(np.int64) * self.size + right
        key[(left < 0) | (right < 0)] = -1
        at = self.keys.searchsorted(key)
        return np.where(self.keys[at] == key, self.by_key[at], -1)

    def learn(self, words: Iterator[str]) -> None:
        """Merge new words, in lots of about ``LOT_BYTES`` at once, and remember their ids."""
        lot, size = [], 0
        for word in words:
            raw = word.encode()
            lot.append(raw)
            size += len(raw)
            if size >= LOT_BYTES:
                self.merge(lot)
                lot, size = [], 0
        if lot:
            self.merge(lot)

    def merge(self, raw: list[bytes]) -> None:
        """Merge the words of a lot, all at once."""
        self.held += sum(map(len, raw))
        # Tokens of all words in a row, each word followed by -1, as a linked list.
        flat = np.frombuffer(b"\xff".join(raw) + b"\xff", np.uint8)
        token = self.first[flat]
        ends = np.cumsum([len(x) + 1 for x in raw]) - 1
        token[ends] = -1
        n = len(token)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[-1] = n - 1
        before[0] = n - 1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(at: np.ndarray) -> None:
            """Add the pairs that begin at these places to the index."""
            rank = self.ranks(token[at], token[after[at]])
            found = rank >= 0
            at, rank = at[found], rank[found]
            if not len(at):
                return
            order = rank.argsort(kind="stable")
            at, rank = at[order], rank[order]
            cuts = [0, *((rank[1:] != rank[:-1]).nonzero()[0] + 1).tolist(), len(at)]
            for r, a, b in zip(rank[cuts[:-1]].tolist(), cuts[:-1], cuts[1:], strict=True):
                if r in index:
                    index[r].append(at[a:b])
                else:
                    index[r] = [at[a:b]]
                    heapq.heappush(active, r)

        note(np.arange(n - 1, dtype=np.int32))
        while active:
            r = heapq.heappop(active)
            groups = index.pop(r)
            a, b = divmod(int(self.pair[r]), self.size)
            at = groups[0] if len(groups) == 1 else np.concatenate(groups)
            # Pairs that another merge has broken up are no longer there.
            at = at[(token[at] == a) & (token[after[at]] == b)]
            if a == b and len(at) > 1:
                # In a run of equal tokens every second pair overlaps the one before it. Only here
                # can a place be noted twice: beside a neighbour that merged in the same step.
                at = np.unique(at)
                fresh = np.concatenate([[True], after[at[:-1]] != at[1:]])
                run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            far = after[gone]
            token[at] = self.made[r]
            token[gone] = -2
            after[at] = far
            before[far] = at
            note(np.concatenate([before[at], at]))
        left = token >= 0
        word_of = np.searchsorted(ends, np.flatnonzero(left))
        self.ids.append(token[left])
        self.counts.append(np.bincount(word_of, minlength=len(raw)).astype(np.int32))

    def each_word(self, text: str) -> Iterator[str]:
        start = 0
        for special in self.parts.finditer(text) if self.parts else ():
            yield from (m[0] for m in self.split.finditer(text[start : special.start()]))
            yield special[0]
            start = special.end()
        yield from (m[0] for m in self.split.finditer(text[start:]))

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        """Token ids of each text; none for null or empty."""
        plain = self.parts is None
        if len(self.words) > MOST_WORDS or self.held > MOST_BYTES:
            self.forget()
        known, number = len(self.words), self.words.__getitem__  # a new word gets the next number
        used, lengths = array("i"), np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            if text and len(text) > LONG_TEXT:
                before = len(used)
                used.extend(map(number, self.each_word(text)))
                lengths[k] = len(used) - before
            elif text:
                words = list(self.each_word(text)) if not plain and any(s in text for s in self.special) else self.split.findall(text)
                used.extend(map(number, words))
                lengths[k] = len(words)
        used = np.frombuffer(used, np.int32) if used else np.zeros(0, np.int32)
        if len(self.words) > known:
            self.learn(islice(self.words, known, None))
        if len(self.ids) > 1:
            self.ids, self.counts = [np.concatenate(self.ids)], [np.concatenate(self.counts)]
        ids, counts = self.ids[0], self.counts[0]
        starts = np.cumsum(counts, dtype=np.int32) - counts
        flat = spread(ids, starts[used], counts[used])
        per_word = np.concatenate([[0], np.cumsum(counts[used])])
        offsets = per_word[np.concatenate([[0], np.cumsum(lengths)])]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))

    def decode(self, column: pa.ListArray) -> pa.Array:
        """The text of each list of ids; bytes that are no UTF-8 become U+FFFD, unknown ids nothing."""
        flat = column.flatten()
        ids = flat.fill_null(-1).to_numpy(zero_copy_only=False)
        known = (ids >= 0) & (ids < self.size)
        ids = np.where(known, ids, 0)
        counts = np.where(known, self.lengths[ids], 0)
        data = spread(self.bytes, self.starts[ids], counts).tobytes()
        sizes = pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]
        null = column.is_null().to_numpy(zero_copy_only=False)
        return pa.array(texts, pa.string(), mask=null)


def spread(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The slices ``values[s : s + c]`` one after the other."""
    ends = np.cumsum(counts)
    if not len(ends) or not ends[-1]:
        return values[:0]
    # Steps of one inside a slice, and a jump where the next begins.
    starts, ends, counts = starts[counts > 0], ends[counts > 0], counts[counts > 0]
    at = np.ones(int(ends[-1]), np.int32)
    at[0] = starts[0]
    at[ends[:-1]] = starts[1:] - starts[:-1] - counts[:-1] + 1
    return values[np.cumsum(at, dtype=np.int32)]


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def _mapped(df: DataFrame, column: str, out: str, kind: T.DataType, convert, gather: int) -> DataFrame:
    """``df`` with ``out`` (replaced if there) made from ``column`` in Arrow batches of ``gather`` bytes."""
    keep = [c for c in df.columns if c.lower() != out.lower()]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in gathered(batches, gather):
            for batch in held.combine_chunks().to_batches():
                made = convert(batch.column(column))
                columns = [batch.column(c) for c in keep]
                yield from sliced(pa.RecordBatch.from_arrays([*columns, made], [*keep, out]))
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """Add ``out``, the token ids of ``text_col`` by the byte-level BPE vocabulary at ``path``.

    Texts are split by ``PATTERN``, and at the file's special tokens. The distinct words of some
    megabytes of a partition are merged in lots of a megabyte (a longer word alone): an index holds
    the places of every pair of neighbours, the lowest active rank is applied to all its places, and
    the pairs beside them enter the index. Workers remember merged words, up to ``MOST_WORDS`` and
    ``MOST_BYTES``. The file must be readable on executors; one with a normaliser, another split or
    other merge options raises ValueError.

    Null and empty texts give an empty list; texts of any length are encoded whole; special tokens
    written in a text are found there, as the tokenizers library finds them; other columns stay
    (one named as ``out``, in any case, is replaced).
    """

    def convert(column: pa.Array) -> pa.ListArray:
        return vocabulary(path).encode(column.to_pylist())

    return _mapped(df, text_col, out, T.ArrayType(T.IntegerType()), convert, GATHER_BYTES)


def decode(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``, the text of the token ids in ``ids_col``; null ids give null, empty ones ''."""

    def convert(column: pa.Array) -> pa.Array:
        return vocabulary(path).decode(column)

    return _mapped(df, ids_col, out, T.StringType(), convert, 1)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def digests(encoded: DataFrame) -> DataFrame:
    """n_tokens and sha256 of ids and text, from the columns ids and decoded."""
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def query(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    path = path or tokenizer_path()
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = encode(docs, path).select("doc_id", "ids")
    return digests(decode(encoded, path))
