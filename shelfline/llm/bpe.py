"""Byte-level BPE encoding and decoding with a published vocabulary; nothing is trained here.

Each text is cut at added tokens, then by the tokenizer's own pattern into short words. A word is merged with a contiguous
rank array: its part boundaries and, beside each, the rank of the pair that starts there; again and again the smallest
rank is found, the boundary behind it deleted, and the ranks of the two neighbours refreshed. A word's ids are kept in a
bounded table for the words to come, since a few words make most of a text.

The array of a long word comes in blocks of `BLOCK` parts, each with its own least rank, so that only the least of these
and one block are scanned for the next merge.

Defined results: null and empty texts have no ids and decode to the empty text; texts of any length are encoded whole;
repeated rows each get their own row; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm import common as C

#: Fixed value: the pattern by which byte-level tokenizers of this family cut texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK = 512
_NONE = 1 << 60


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in vocabulary files: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Tokenizer:
    """One vocabulary file. ranks: pair of parts to (rank, merged part)."""

    def __init__(self, path: str, most_kept: int = 200_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = {c: b for b, c in byte_letters().items()}
        raw = lambda token: bytes(letters[c] for c in token)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = spec["model"]["vocab"]
        ids = {raw(t): i for t, i in vocab.items() if t not in self.added}
        self.parts = {i: t for t, i in ids.items()} | {i: t.encode() for t, i in self.added.items()}
        self.letter = [ids[bytes([b])] for b in range(256)]
        self.rank: dict[int, int] = {}  # of a pair of ids
        self.merged: list[int] = []  # id of what the pair of each rank becomes
        for n, pair in enumerate(spec["model"]["merges"]):
            x, y = map(raw, pair.split(" ") if isinstance(pair, str) else pair)
            self.rank.setdefault(ids[x] << 20 | ids[y], n)
            self.merged.append(ids[x + y])
        self.cut = regex.compile(PATTERN)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.kept = _Kept(self, most_kept)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word's parts. Boundary i stands before part i, and ranks[i] is that of the pair around boundary i + 1."""
        parts = [self.letter[b] for b in word]
        rank = self.rank.get
        ranks = [rank(a << 20 | b, _NONE) for a, b in zip(parts, parts[1:])]
        if len(parts) > BLOCK:
            return self._merge_blocks(parts, [*ranks, _NONE])
        while ranks and (least := min(ranks)) != _NONE:
            i = ranks.index(least)
            new = parts[i] = self.merged[least]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(new << 20 | parts[i + 1], _NONE)
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 20 | new, _NONE)
        return parts

    def _merge_blocks(self, parts: list[int], ranks: list[int]) -> list[int]:
        """The same, with the array cut into blocks: a part's rank is that of the pair it begins, maybe over a block's end."""
        rank = self.rank.get
        cut = range(0, len(parts), BLOCK)
        parts_of, ranks_of = [parts[i : i + BLOCK] for i in cut], [ranks[i : i + BLOCK] for i in cut]
        least_of = [min(r) for r in ranks_of]
        while (least := min(least_of)) != _NONE:
            b = least_of.index(least)
            i = ranks_of[b].index(least)
            new = parts_of[b][i] = self.merged[least]
            # The part behind goes, which may begin the next block.
            c, j = (b, i + 1) if i + 1 < len(parts_of[b]) else (b + 1, 0)
            del parts_of[c][j], ranks_of[c][j]
            touched = {b, c} if i else {b, c, max(0, b - 1)}
            if not parts_of[c]:
                del parts_of[c], ranks_of[c], least_of[c]
                touched.discard(c)
            behind = parts_of[b][i + 1] if i + 1 < len(parts_of[b]) else parts_of[b + 1][0] if b + 1 < len(parts_of) else None
            ranks_of[b][i] = _NONE if behind is None else rank(new << 20 | behind, _NONE)
            if i:
                ranks_of[b][i - 1] = rank(parts_of[b][i - 1] << 20 | new, _NONE)
            elif b:
                ranks_of[b - 1][-1] = rank(parts_of[b - 1][-1] << 20 | new, _NONE)
            for x in touched:
                least_of[x] = min(ranks_of[x])
        return [x for block in parts_of for x in block]

    def encode(self, text: str) -> list[int]:
        kept, out = self.kept, []
        for i, piece in enumerate(self.split.split(text) if self.split else [text]):
            if i % 2:
                out.append(self.added[piece])
            elif piece:
                for ids in map(kept.__getitem__, self.cut.findall(piece)):
                    out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        parts = self.parts
        return b"".join([parts[i] for i in ids]).decode("utf-8", "replace")


class _Kept(dict):
    """Ids of words met lately. When full, it starts anew and takes from what it held the words that still occur."""

    def __init__(self, tokenizer: Tokenizer, most: int):
        self.tokenizer, self.most, self.old = tokenizer, most, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.old.get(word) or tuple(self.tokenizer.merge(word.encode()))
        if len(word) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


@lru_cache(2)
def tokenizer(path: str) -> Tokenizer:
    """One for each Python worker, which runs many tasks."""
    return Tokenizer(path)


def encode(documents: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per document: id, n_tokens, ids (if kept), ids_sha256 of the comma-joined ids, decoded (if kept), decoded_sha256."""
    docs = documents.select(F.col(id_col), F.col(text_col).alias("_text"))
    kind = documents.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, " + "ids array<int>, decoded string, " * keep_ids + "ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(vocabulary)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        for batch in batches:
            for at, to, texts in C.text_groups(batch.column(1)):
                n, ids, decoded, a, b = [], [], [], [], []
                for x in texts:
                    found = t.encode(x.decode())
                    back = t.decode(found)
                    n.append(len(found))
                    a.append(sha(",".join(map(str, found))))
                    b.append(sha(back))
                    if keep_ids:
                        ids.append(found)
                        decoded.append(back)
                columns = {id_col: batch.column(0).slice(at, to - at), "n_tokens": pa.array(n, pa.int64())}
                if keep_ids:
                    columns |= {"ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.string())}
                yield pa.RecordBatch.from_pydict(columns | {"ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())})

    return docs.mapInArrow(run, schema)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(C.table(spark, sf_dir, "documents"), default_vocabulary(), keep_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
