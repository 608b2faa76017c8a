"""BPE encoding and decoding with a contiguous rank array for each short word.

The vocabulary file is that of a public tokenizer with word ends (lower case, white space dropped). A word
is held as a list of symbols with, beside it, the list of ranks of adjacent pairs. The smallest rank is
sought again and again, the boundary there is deleted, and the ranks of its two neighbours are refreshed.

All words of one length that a batch of texts brings are merged side by side, as rows of arrays. Text is
split at white space, and each chunk is encoded once per worker while it stays in a bounded cache of ids: the
normaliser (NFC, lower case) and the word pattern never reach across white space. Special tokens are not in
that cache. Letters and digits are told apart by this Python's Unicode tables; for code points assigned lately
the library's may differ.
"""

from __future__ import annotations

import gc
import heapq
import json
import unicodedata
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import for_python, table, trimmed

VOCABULARY = "word_bpe_49k.json"
#: White space as Unicode has it; U+001C to U+001F, at which str.split() also splits, are not.
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
_ODD = regex.compile(r"[\x1c-\x1f]")
_CHUNK = regex.compile(rf"[^{_SPACE}]+")
#: The word pattern of the vocabulary file (fixed value).
_PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_SPACE}\p{{L}}\p{{N}}]+")
_END = "</w>"
#: The rank of a pair that never merges.
NONE = 1 << 30
_STOPS = frozenset(",.;:!?")
#: Chunks that one worker keeps, about 200 bytes each; twice as many at most.
CACHE = 200_000
#: Characters of the texts that are held as chunks at a time (a longer text goes alone).
HELD = 1_000_000
#: Words above this many symbols are merged with a heap and links, in n log n steps.
SHORT = 200


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where it is a visible Latin-1 character, else U+0100 and on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(rest)) for b in range(256)]


def _lowered(text: str) -> str:
    return text.lower() if "Σ" not in text else "".join([x.lower() for x in text])  # no final sigma


class Bpe:
    """Encoder and decoder of one vocabulary file.

    encode(): ids without special tokens added; their strings in a text are special tokens all the same.
    decode(): the tokens of ids, joined by one space, special ones included, as the file has no decoder.
    An unknown id raises KeyError. Empty text: no ids; no ids: empty text.
    """

    def __init__(self, path: str, cache: int = CACHE):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t.encode() for t, i in [*self.ids.items(), *self.special.items()]}
        self.marks = {t: array("I", [i]).tobytes() for t, i in self.special.items()}
        pairs, merged = [], []
        for merge in spec["model"]["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pairs.append(self.ids[a] << 20 | self.ids[b])
            merged.append(self.ids[a + b])
        self.ranks = {p: n for n, p in reversed([*enumerate(pairs)])}  # pair of symbols -> rank
        self.merged = np.array([*merged, -1], dtype=np.int32)  # rank -> merged symbol
        self.keys = np.array(sorted(self.ranks), dtype=np.int64)
        self.key_ranks = np.array([self.ranks[k] for k in self.keys.tolist()], dtype=np.int32)
        letters = _byte_letters()
        self.first = np.array([self.ids[x] for x in letters], dtype=np.int32)
        self.last = np.array([self.ids[x + _END] for x in letters], dtype=np.int32)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.room = cache

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols; NONE where they never merge or one is missing (-1)."""
        k = a.astype(np.int64) << 20 | b
        i = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where((self.keys[i] == k) & (b >= 0), self.key_ranks[i], NONE)

    def merge(self, words: np.ndarray) -> np.ndarray:
        """Words of one length, a row of symbols each, after all merges: rows are filled up with -1 at the end.

        Beside the symbols stands the array of adjacent ranks. Each step finds the smallest rank of every
        word (the leftmost among equals), deletes the boundary there, and ranks its two neighbours anew.
        """
        n, width = words.shape
        out = np.full((n, width), -1, dtype=np.int32)
        s, at = words.astype(np.int32), np.arange(n)
        r = self.pair_ranks(s[:, :-1], s[:, 1:])
        while True:
            if s.shape[1] < 2:
                out[at, : s.shape[1]] = s
                return out
            j = r.argmin(1)
            best = r[np.arange(len(s)), j]
            if (done := best == NONE).any():
                out[at[done], : s.shape[1]] = s[done]
                go = ~done
                s, r, at, j, best = s[go], r[go], at[go], j[go], best[go]
                if not len(s):
                    return out
            rows, cols = np.arange(len(s)), np.arange(s.shape[1] - 1)
            s[rows, j] = self.merged[best]
            s = np.where(cols <= j[:, None], s[:, :-1], s[:, 1:])
            r = np.where(cols[:-1] < j[:, None], r[:, :-1], r[:, 1:])
            if not r.shape[1]:
                continue
            new = s[rows, j]
            left, right = np.flatnonzero(j > 0), np.flatnonzero(j < r.shape[1])
            r[left, j[left] - 1] = self.pair_ranks(s[left, j[left] - 1], new[left])
            r[right, j[right]] = self.pair_ranks(new[right], s[right, j[right] + 1])

    def merge_long(self, symbols: list[int]) -> list[int]:
        """The same for one long word, with a heap of pairs and links between symbols."""
        n = len(symbols)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        rank = lambda a, b: self.ranks.get(a << 20 | b, -1)
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank(symbols[i], symbols[i + 1])) >= 0]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], gone[j] = int(self.merged[r]), 1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank(symbols[i], symbols[k])) >= 0:
                    heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
            if (h := before[i]) >= 0 and (r := rank(symbols[h], symbols[i])) >= 0:
                heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
        return [s for s, x in zip(symbols, gone, strict=True) if not x]

    def encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of words as the pattern cuts them, as bytes."""
        by_size: dict[int, list[tuple[str, bytes]]] = defaultdict(list)
        for p in set(pieces):
            raw = p.encode()
            by_size[len(raw)].append((p, raw))
        out: dict[str, bytes] = {}
        for size, own in by_size.items():
            raw = np.frombuffer(b"".join([x[1] for x in own]), dtype=np.uint8).reshape(-1, size)
            s = np.concatenate([self.first[raw[:, :-1]], self.last[raw[:, -1:]]], axis=1)
            if size > SHORT:
                out |= {p: array("I", self.merge_long(row)).tobytes() for (p, _), row in zip(own, s.tolist(), strict=True)}
                continue
            s = self.merge(s)
            flat, ends = s.tobytes(), (4 * size * np.arange(len(own)) + 4 * (s >= 0).sum(1)).tolist()
            for k, ((p, _), end) in enumerate(zip(own, ends, strict=True)):
                out[p] = flat[4 * size * k : end]
        return out

    def learn(self, chunks: set[str]) -> None:
        """Encodes what stands between white space, all at once, and keeps the ids as bytes."""
        if len(self.known) > self.room:
            self.older, self.known = self.known, {}
        missing = []
        for c in chunks:
            if c in self.known:
                continue
            found = self.older.get(c)
            if found is None:
                missing.append(c)
            else:
                self.known[c] = found
        cut: list[tuple[str, list[str]]] = []
        for c in missing:
            text = c.lower() if c.isascii() else _lowered(unicodedata.normalize("NFC", c))
            cut.append((c, [text] if text.isalpha() else [text[:-1], text[-1]] if text[-1:] in _STOPS and text[:-1].isalpha() else _PIECE.findall(text)))
        ids = self.encode_pieces([p for _, x in cut for p in x])
        for c, x in cut:
            self.known[c] = ids[x[0]] if len(x) == 1 else b"".join([ids[p] for p in x])

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as bytes. A null text has none."""
        cut = [self._chunks(t) if t else [] for t in texts]
        out, i = [], 0
        while i < len(cut):  # as many texts at a time as the cache has room for
            chunks, j = set(), i
            while j < len(cut) and (j == i or len(chunks) < self.room):
                chunks.update(cut[j])
                j += 1
            chunks.difference_update(self.marks)
            on = gc.isenabled()
            gc.disable()  # no cycles arise; else each collection walks the whole cache
            try:
                self.learn(chunks)
            finally:
                if on:
                    gc.enable()
            get, marks = self.known.__getitem__, self.marks
            out += [b"".join(map(get, x)) if marks.keys().isdisjoint(x) else b"".join([marks.get(c) or get(c) for c in x]) for x in cut[i:j]]
            i = j
        return out

    def _chunks(self, text: str) -> list[str]:
        if self.split and any(s in text for s in self.special):
            return [c for x in self.split.split(text) for c in ([x] if x in self.special else self._plain(x))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        return _CHUNK.findall(text) if _ODD.search(text) else text.split()

    def encode(self, text: str | None) -> list[int]:
        return array("I", self.encode_all([text])[0]).tolist()

    def decode_bytes(self, ids: array | list[int]) -> bytes:
        return b" ".join(map(self.tokens.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode()


def encoded(bpe: Bpe, texts: list[str | None]) -> Iterator[tuple[bytes, bytes]]:
    """Ids and decoded text (UTF-8) of each text, a few texts at a time."""
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > HELD:
            yield from ((x, bpe.decode_bytes(array("I", x))) for x in bpe.encode_all(texts[at:i]))
            at, size = i, 0
        size += len(t or "")
    yield from ((x, bpe.decode_bytes(array("I", x))) for x in bpe.encode_all(texts[at:]))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Bpe:
    """One for each file and Python worker."""
    return Bpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def bpe_encode(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """docs with bpe_ids (array<int>) and bpe_decoded (string), one row for each row.

    Whole texts. Null and empty texts: no ids and an empty string. Rows, repeated ones too, and further
    columns pass through; columns that already have the two names are replaced. Narrow: no shuffle.
    path must hold on every executor; None takes the installed public file there.
    """
    for_python(docs.sparkSession)
    docs = docs.drop("bpe_ids", "bpe_decoded")
    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema), "bpe_ids array<int>", "bpe_decoded string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path or default_path())
        for whole in batches:
            at = whole.schema.get_field_index(text)
            for b in pieces(whole, whole.column(at)):
                got = [*encoded(bpe, b.column(at).to_pylist())]
                offsets = pa.array(np.cumsum([0, *(len(x) // 4 for x, _ in got)]), pa.int32())
                flat = pa.array(np.frombuffer(b"".join([x for x, _ in got]), dtype=np.int32))
                said = pa.array([x for _, x in got], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(offsets, flat), said], [*b.schema.names, "bpe_ids", "bpe_decoded"])

    return docs.mapInArrow(trimmed(run), schema)


def pieces(batch: pa.RecordBatch, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about HELD bytes of text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(batch):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HELD, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def bpe_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of whole texts, without carrying ids through Spark.

    One row for each row of docs (doc_id, text). Null and empty texts: no tokens, digests of nothing. Repeated
    rows and rows that share a doc_id or have none are each answered; an empty table gives no rows; further
    columns are not looked at.
    """
    for_python(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path or default_path())
        for b in batches:
            n, ids, said = [], [], []
            for raw, text in encoded(bpe, b.column(1).to_pylist()):
                n.append(len(raw) // 4)
                ids.append(sha256(raw).hexdigest())
                said.append(sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(said)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bpe_digests() of all documents; nulls, ties and empty tables as there."""
    return bpe_digests(table(spark, sf_dir, "documents", "doc_id", "text"))
