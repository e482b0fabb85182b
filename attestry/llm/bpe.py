"""Byte-level BPE over Arrow batches with the tokenizers library.

Byte-level BPE works on printable stand-ins for bytes (``byte_to_char``). ``from_ranks`` builds a tokenizer
from a rank file: the vocabulary in stand-in characters, and as merges every split of a token into two tokens,
in the order of the ranks, so that the lowest rank merges first as with the ranks themselves.

``ChunkCache`` encodes whole texts from their space-separated chunks. The splitting pattern never lets a
match run over a space that stands between two characters other than white space, except that this space
opens the next match, so a text's ids are those of its chunks, each but the first with its leading space.
Each different chunk is encoded once by the library and looked up from then on; where a space has white
space beside it, the neighbouring chunks stay together.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MULTI, ENGLISH = "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return name if os.path.sep in name else public_tokenizers.path(name)


def byte_to_char() -> dict[int, str]:
    """Printable Latin-1 bytes stand for themselves, the others for U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in plain)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def from_ranks(ranks: dict[bytes, int], pattern: str):
    """A tokenizers.Tokenizer with the ids of the rank file."""
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    char = byte_to_char()
    text = {t: "".join(char[b] for b in t) for t in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.__getitem__):
        cuts = [(ranks[token[:i]], token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        merges += [(text[a], text[b]) for _, a, b in sorted(cuts)]
    t = Tokenizer(models.BPE(vocab={text[k]: v for k, v in ranks.items()}, merges=merges, ignore_merges=True))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    t.decoder = decoders.ByteLevel()
    return t


@lru_cache(maxsize=4)
def load(name: str = MULTI):
    """The tokenizer of a rank file or of a tokenizers JSON file (a name of public_tokenizers or a path)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    path = vocabulary_path(name)
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)
    import public_tokenizers

    return from_ranks(read_ranks(path), public_tokenizers.PATTERN)


@lru_cache(maxsize=4)
def id_bytes(name: str = MULTI) -> list[bytes]:
    """The bytes of every id: the byte table reversed over the vocabulary. Special tokens are their UTF-8."""
    back = {c: b for b, c in byte_to_char().items()}
    t = load(name)
    vocab = t.get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return out


class ChunkCache(dict):
    """Ids of whole texts as little-endian unsigned 32-bit integers.

    Maps a chunk to the ids of a space and the chunk. A chunk not met before is split by the pattern and its
    matches, in stand-in characters, go through the library's BPE model; the library's whole pipeline takes
    those that hold an added token's string. Beyond ``limit`` chunks the table starts anew, so memory is
    bounded while every text is encoded whole.
    """

    _odd = re.compile(r"\s\x20|\x20\s|^\x20|\x20$")
    _cut = re.compile(r"(?<=\S)\x20(?=\S)")

    def __init__(self, name: str | None = None, limit: int = 800_000):
        import public_tokenizers
        import regex

        super().__init__()
        self.tokenizer, self.limit = load(name or ENGLISH), limit
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        self.char = [c for _, c in sorted(byte_to_char().items())]

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        if chunk.isalpha():
            out = self._match(" " + chunk)
        else:
            out = self.encode_chunk(" " + chunk)
        self[chunk] = out
        return out

    def _match(self, match: str) -> bytes:
        if match.isascii() and match[1:].isalpha() and match[0] == " ":
            stand_in = "\u0120" + match[1:]
        else:
            stand_in = "".join([self.char[b] for b in match.encode()])
        return array("I", [t.id for t in self.model.tokenize(stand_in)]).tobytes()

    def encode_chunk(self, chunk: str) -> bytes:
        if any(a in chunk for a in self.added):
            return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        return b"".join([self[m[1:]] if m[0] == " " and m[1:].isalpha() else self._match(m) for m in self.find(chunk)])

    def chunks(self, text: str) -> list[str]:
        return self._cut.split(text) if self._odd.search(text) else text.split(" ")

    def encode_bytes(self, texts: list[str]) -> Iterator[bytes]:
        get = self.__getitem__
        for t in texts:
            first, *rest = self.chunks(t)
            yield self.encode_chunk(first) + b"".join(map(get, rest))


def decode_bytes(ids, table: list[bytes]) -> bytes:
    """The bytes of the ids. A character split over tokens is whole again in the joined bytes."""
    return b"".join([table[i] for i in ids])


def decode_texts(ids, table: list[bytes]) -> list[str]:
    """The text that each id completes: bytes of a character split over ids wait for its last byte.

    Bytes that no character can be made of come out as U+FFFD.
    """
    import codecs

    reader = codecs.getincrementaldecoder("utf-8")("replace")
    last = len(ids) - 1
    return [reader.decode(table[i], final=k == last) for k, i in enumerate(ids)]


def encode(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = MULTI, offsets: bool = True) -> DataFrame:
    """``keep`` columns, ``ids array<int>`` and, if asked, character ``starts`` and ``ends`` of each token.

    Null text: empty. A token that is part of a character has that whole character's offsets.
    """
    src = df.select(F.col(text).cast("string").alias("__text"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load(name)
        for b in batches:
            enc = [t.encode(x or "", add_special_tokens=False) for x in b.column(0).to_pylist()]
            cols = [*(b.column(i) for i in range(1, b.num_columns)), pa.array([e.ids for e in enc], pa.list_(pa.int32()))]
            if offsets:
                cols += [pa.array([[o[i] for o in e.offsets] for e in enc], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names[1:], *(["ids", "starts", "ends"] if offsets else ["ids"])])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[1:]]
    return src.mapInArrow(run, ", ".join([*fields, "ids array<int>", *(["starts array<int>", "ends array<int>"] if offsets else [])]))


def decode(df: DataFrame, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), name: str = MULTI) -> DataFrame:
    """``keep`` columns and ``decoded`` (binary): the bytes of ``ids``; null ids are empty."""
    src = df.select(F.col(ids).alias("__ids"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = id_bytes(name)
        for b in batches:
            out = pa.array([decode_bytes(x or (), table) for x in b.column(0).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(1, b.num_columns)), out], names=[*b.schema.names[1:], "decoded"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[1:]]
    return src.mapInArrow(run, ", ".join([*fields, "decoded binary"]))


def digest(df: DataFrame, id_col: str = "doc_id", text: str = "text", name: str = MULTI) -> DataFrame:
    """Per document: n_tokens, ids_sha256, decoded_sha256, ids in memory only while their text is.

    Null text: empty. Repeated rows give repeated results; an empty table gives an empty one. Only the id
    and the text are read.
    """
    src = df.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, table = _cache(name), id_bytes(name)
        for b in batches:
            rows = []
            for raw in enc.encode_bytes([t or "" for t in b.column(1).to_pylist()]):
                out = decode_bytes(memoryview(raw).cast("I"), table)
                rows.append((len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(out).hexdigest()))
            cols = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.string())))], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


@lru_cache(maxsize=2)
def _cache(name: str) -> ChunkCache:
    return ChunkCache(name)
