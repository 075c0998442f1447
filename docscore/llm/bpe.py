"""Byte-level BPE encoding and decoding by speculation and verification.

A greedy longest match proposes tokens for each pre-token. A proposal is the BPE
encoding exactly when every adjacent pair of its tokens is compatible, that is, if
merging the bytes of the two tokens would have kept the border between them. The
pairs of all proposals of a batch are tested together with numpy; only pre-tokens
with an incompatible pair are merged exactly.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed value: the pre-token pattern of byte-level BPE
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# the same where a text is ASCII
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"

NEVER = np.iinfo(np.int64).max
CACHE_WORDS = 200_000
CACHE_LETTERS = 64
SLICE_CHARS = 1_000_000
STREAM_CHARS = 4_000_000
STREAM_WORDS = 200_000
BATCH_ROWS = 1_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Tables:
    """What encoding needs of a tokenizer file; small enough to be broadcast."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model, added = spec["model"], spec.get("added_tokens", [])
        pre = spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or spec.get("normalizer") or pre.get("add_prefix_space"):
            raise ValueError("only byte-level BPE without a normalizer or prefix space is supported")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that take neighbouring text are not supported")
        letters = byte_letters()
        spell = {}
        for token, i in model["vocab"].items():
            spell[i] = bytes(letters[c] for c in token)
        self.added = {t["content"]: t["id"] for t in added}
        size = 1 + max(*spell, *self.added.values())
        self.bytes_of: list[bytes] = [spell.get(i, b"") for i in range(size)]
        for content, i in self.added.items():
            self.bytes_of[i] = content.encode()
        self.size = size
        vocab = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merge = {}
        for rank, (a, b) in enumerate(merges):
            self.merge.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.byte_id = [0] * 256
        for letter, b in letters.items():
            self.byte_id[b] = vocab[letter]
        # the last merge of each token: its rank and its two parts
        self.rank = np.full(size, -1, np.int64)
        self.first_part, self.last_part = np.arange(size), np.arange(size)
        self.reachable: dict[bytes, int] = {}
        by_result: dict[int, list[tuple[int, int, int]]] = {}
        for (a, b), (rank, made) in self.merge.items():
            by_result.setdefault(made, []).append((rank, a, b))
        for i, word in spell.items():
            if len(word) == 1:
                self.reachable[word] = i
            elif self.exact(word) == [i]:
                rank, a, b = self.last_merge(word, by_result.get(i, []))
                self.rank[i], self.first_part[i], self.last_part[i] = rank, a, b
                self.reachable[word] = i
        pairs = sorted((a * size + b, rank) for (a, b), (rank, _) in self.merge.items())
        self.pair_keys = np.array([k for k, _ in pairs], np.int64)
        self.pair_ranks = np.array([r for _, r in pairs], np.int64)
        self.longest: dict[bytes, int] = {}
        for word in self.reachable:
            head = word[:2]
            self.longest[head] = max(self.longest.get(head, 1), len(word))

    def last_merge(self, word: bytes, ways: list[tuple[int, int, int]]) -> tuple[int, int, int]:
        if len(ways) == 1:
            return ways[0]
        for rank, a, b in sorted(ways):
            cut = len(self.bytes_of[a])
            if self.exact(word[:cut]) == [a] and self.exact(word[cut:]) == [b]:
                return rank, a, b
        raise ValueError(f"no merge makes {word!r}")

    def exact(self, word: bytes) -> list[int]:
        """Merge the lowest-ranked adjacent pair, the leftmost first, until none is left."""
        ids = [self.byte_id[b] for b in word]
        if len(ids) > 48:
            return self._exact_long(ids)
        find, none = self.merge.get, (NEVER, -1)
        # the merge of each token with the next one
        ways = [find(pair, none) for pair in zip(ids, ids[1:])]
        while ways:
            best = min(ways)
            if best is none:
                break
            at = ways.index(best)
            ids[at : at + 2] = [best[1]]
            del ways[at]
            if at:
                ways[at - 1] = find((ids[at - 1], best[1]), none)
            if at < len(ways):
                ways[at] = find((best[1], ids[at + 1]), none)
        return ids

    def _exact_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list: n log n for long pre-tokens."""
        n, merge = len(ids), self.merge
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(k: int) -> None:
            if k >= 0 and after[k] < n and (found := merge.get((ids[k], ids[after[k]]))):
                heapq.heappush(heap, (found[0], k, ids[k], ids[after[k]], found[1]))

        for k in range(n - 1):
            offer(k)
        while heap:
            _, k, a, b, made = heapq.heappop(heap)
            if ids[k] != a or after[k] >= n or ids[after[k]] != b:
                continue
            gone = after[k]
            ids[k], ids[gone] = made, -1
            after[k] = after[gone]
            if after[k] < n:
                before[after[k]] = k
            offer(before[k])
            offer(k)
        return [i for i in ids if i >= 0]

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, at, n, known, longest = [], 0, len(word), self.reachable, self.longest
        while at < n:
            for size in range(min(longest.get(word[at : at + 2], 1), n - at), 0, -1):
                found = known.get(word[at : at + size])
                if found is not None:
                    break
            out.append(found)
            at += size
        return out

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each pair of tokens: does BPE keep the border between them?

        The border pair is followed back in time: of the two tokens at the border the
        younger one is undone. A pair that could have merged before either token was
        used up breaks the border. Equal ranks merge the leftmost pair first.
        """
        keep = np.ones(len(left), bool)
        live = np.arange(len(left))
        l, r = left.astype(np.int64), right.astype(np.int64)
        l_until, r_until = np.full(len(l), NEVER), np.full(len(l), NEVER)
        while len(live):
            key = l * self.size + r
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            rank = np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)
            broken = (rank < l_until) & (rank <= r_until) & (rank < NEVER)
            keep[live[broken]] = False
            l_rank, r_rank = self.rank[l], self.rank[r]
            go = ~broken & ((l_rank >= 0) | (r_rank >= 0))
            live, l, r, l_rank, r_rank = live[go], l[go], r[go], l_rank[go], r_rank[go]
            l_until, r_until = l_until[go], r_until[go]
            undo = l_rank > r_rank
            l_until, r_until = np.where(undo, l_rank, l_until), np.where(undo, r_until, r_rank)
            l, r = np.where(undo, self.last_part[l], l), np.where(undo, r, self.first_part[r])
        return keep

    def encode_words(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """The ids of distinct pre-tokens: proposals, one check of all pairs, exact merges for the rest."""
        raw = [w.encode() for w in words]
        known = self.reachable
        proposed = [(known[w],) if w in known else self.propose(w) for w in raw]
        sizes = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter(chain.from_iterable(proposed), np.int64, int(sizes.sum()))
        ends = np.cumsum(sizes)
        border = np.ones(max(len(flat) - 1, 0), bool)
        border[ends[:-1] - 1] = False  # the next pre-token begins there
        where = np.flatnonzero(border)
        keys, back = np.unique(flat[where] * self.size + flat[where + 1], return_inverse=True)
        bad = where[~self.compatible(keys // self.size, keys % self.size)[back]]
        failed = set(np.searchsorted(ends, bad, side="right").tolist())
        return {w: tuple(self.exact(raw[k]) if k in failed else proposed[k]) for k, w in enumerate(words)}


class Encoder:
    """Encodes whole texts in a worker; distinct pre-tokens are cached within a bound."""

    def __init__(self, tables: Tables, cache_words: int = CACHE_WORDS):
        self.tables, self.limit = tables, cache_words
        self.cache: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}  # the cache before it last was full
        self.passing: list[str] = []  # too long to keep
        self.words = regex.compile(PATTERN).findall
        self.stream = regex.compile(PATTERN).finditer
        self.ascii_words = re.compile(ASCII_PATTERN).findall
        contents = sorted(tables.added, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, contents)) + ")") if contents else None

    def pieces(self, text: str) -> Iterator[list[str] | int]:
        """Pre-tokens of a text in slices, and the ids of added tokens between them."""
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                yield self.tables.added[part]
            elif len(part) <= STREAM_CHARS:
                yield self.ascii_words(part) if part.isascii() else self.words(part)
            else:
                found = self.stream(part)
                while some := [m.group() for m in islice(found, STREAM_WORDS)]:
                    yield some

    def learn(self, slices: list[list[str]]) -> dict[str, tuple[int, ...]]:
        """A lookup that has every pre-token of ``slices``."""
        for word in self.passing:
            self.cache.pop(word, None)
        self.passing = []
        need = set().union(*slices)
        unseen = need.difference(self.cache)
        if unseen:
            if len(self.cache) + len(unseen) > self.limit:
                self.older, self.cache = self.cache, {}
                unseen = need
            known = unseen.intersection(self.older)
            self.cache.update(zip(known, map(self.older.__getitem__, known)))
            found = self.tables.encode_words(list(unseen.difference(known)))
            self.cache.update(found)
            self.passing = [w for w in found if len(w) > CACHE_LETTERS]
        return self.cache

    def forget(self) -> None:
        """Empty the cache; the worker lives on when its task is over."""
        self.cache, self.older, self.passing = {}, {}, []

    def encode(self, text: str | None) -> Iterator[list[int]]:
        """The ids of a text, in slices; null is the empty text."""
        for piece in self.pieces(text or ""):
            if isinstance(piece, int):
                yield [piece]
            elif piece:
                lookup = self.learn([piece])
                yield list(chain.from_iterable(map(lookup.__getitem__, piece)))

    def encode_many(self, texts: list[str]) -> Iterator[Iterator[list[int]]]:
        """``encode`` of each text in turn, with the unknown pre-tokens of short texts encoded together."""
        waiting, chars = [], 0
        for text in texts:
            if len(text) > SLICE_CHARS or chars + len(text) > SLICE_CHARS:
                yield from self._together(waiting)
                waiting, chars = [], 0
            if len(text) > SLICE_CHARS:
                yield self.encode(text)
            else:
                waiting.append(list(self.pieces(text)))
                chars += len(text)
        yield from self._together(waiting)

    def _together(self, waiting: list[list]) -> Iterator[Iterator[list[int]]]:
        lookup = self.learn([p for pieces in waiting for p in pieces if not isinstance(p, int)])
        for pieces in waiting:
            yield ([p] if isinstance(p, int) else list(chain.from_iterable(map(lookup.__getitem__, p))) for p in pieces if p != [])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tables.bytes_of.__getitem__, ids))


_TABLES: dict[str, Tables] = {}


def load_tables(path: str) -> Tables:
    """Tables of the tokenizer file at ``path``; built once in a process."""
    if path not in _TABLES:
        with open(path, encoding="utf-8") as file:
            _TABLES[path] = Tables(file.read())
    return _TABLES[path]


def broadcast_tables(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(load_tables(path))


_ENCODERS: dict[int, Encoder] = {}


def worker_encoder(shared) -> Encoder:
    """The encoder of this Python worker, kept between tasks."""
    tables = shared.value
    if id(tables) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[id(tables)] = Encoder(tables)
    return _ENCODERS[id(tables)]


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: the token ids of every text as ``array<int>``.

    Null is the empty text, with no ids. Rows stay as they are, repeated or with a
    null id; an empty table gives no rows; other columns are never read.
    """
    shared = broadcast_tables(docs.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = [list(chain.from_iterable(x)) for x in encoder.encode_many([t or "" for t in part.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
        encoder.forget()

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text``: the text of every row of ids; bytes that are no UTF-8 become U+FFFD.
    Null ids give the empty text."""
    shared = broadcast_tables(encoded.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared)
        for batch in batches:
            texts = [encoder.decode(x.as_py() or []).decode("utf-8", "replace") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    picked = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text without materialising ids: a digest row per input row.

    Columns ``doc_id, n_tokens, ids_sha256, decoded_sha256, lossless``. Texts stream
    through in slices, so a text of any length needs bounded memory. Null and empty
    texts have no tokens, and the digests of the empty string.
    """
    shared = broadcast_tables(docs.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared)
        numbers = list(map(str, range(encoder.tables.size)))
        for batch in (b.slice(k, BATCH_ROWS) for b in batches for k in range(0, b.num_rows, BATCH_ROWS)):
            counts, digests, decoded, same = [], [], [], []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for text, slices in zip(texts, encoder.encode_many(texts), strict=True):
                n, names, plain = 0, hashlib.sha256(), hashlib.sha256()
                reader = codecs.getincrementaldecoder("utf-8")("replace")
                for ids in slices:
                    names.update((("," if n else "") + ",".join(map(numbers.__getitem__, ids))).encode())
                    plain.update(reader.decode(encoder.decode(ids)).encode())
                    n += len(ids)
                plain.update(reader.decode(b"", True).encode())
                counts.append(n)
                digests.append(names.hexdigest())
                decoded.append(plain.hexdigest())
                same.append(decoded[-1] == hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string()), pa.array(same, pa.bool_())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "lossless"],
            )
        encoder.forget()

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean")


def default_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
