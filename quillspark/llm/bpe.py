"""BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words of a batch of texts, those not met before, go into a trie. A depth-first walk gives every node the last token of its
prefix's encoding; a token may follow the last token of the prefix before it only if the two, merged
by rank, stay two tokens. An encoding is read back along these last tokens, so a prefix that many words
share is encoded once. Words are what the vocabulary's own normalizer and splitter make of the text.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from itertools import pairwise
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, prepare, read_table, stage_of

#: Encoded words that a Python worker remembers; the memory is emptied beyond that.
REMEMBERED = 1_000_000
#: Characters of the texts whose words share a trie.
PART = 1 << 21
END = "</w>"
#: Characters whose lower case and classes are the same for Python and the tokenizers library.
_PLAIN = re.compile("[\x00-įı-ſ‐-‧]*")
_ASCII = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
_L = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_LATIN = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_L}]+|[{_N}]|[^\t-\r \x85\xa0{_L}{_N}]+")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class TrieEncoder:
    """Encodes as the tokenizers library does with a word-end byte-level BPE file."""

    def __init__(self, config: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(config)  # only its normalizer and splitter, for rare scripts
        raw = json.loads(config)
        self.vocab: dict[str, int] = raw["model"]["vocab"]
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in raw["model"]["merges"]]
        self.ranks = {pair: i for i, pair in enumerate(merges)}
        self.special = {x["content"]: x["id"] for x in raw.get("added_tokens", [])}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        names = {i: t for t, i in (self.vocab | self.special).items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.width = [len(t.removesuffix(END)) for t in self.names]
        self.longest = max(map(len, self.vocab))
        self.alphabet = byte_alphabet()
        self.bytes_of = {c: b for b, c in enumerate(self.alphabet)}
        self.follows: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.packed: dict[str, bytes] = {}

    # -- the merge rule, used on pairs of tokens only
    def merged(self, symbols: list[str]) -> list[str]:
        while len(symbols) > 1:
            rank, at = min((self.ranks.get(pair, 1 << 30), i) for i, pair in enumerate(pairwise(symbols)))
            if rank == 1 << 30:
                break
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        return symbols

    @staticmethod
    def symbols(token: str) -> list[str]:
        return [*token[: -len(END) - 1], token[-len(END) - 1 :]] if token.endswith(END) else [*token]

    def stands(self, token: int) -> bool:
        """Whether the token's own text is encoded as that token."""
        if (known := self.whole.get(token)) is None:
            known = self.whole[token] = self.merged(self.symbols(self.names[token])) == [self.names[token]]
        return known

    def may_follow(self, left: int, right: int) -> bool:
        if (known := self.follows.get(left << 20 | right)) is None:
            if len(self.follows) > 2_000_000:
                self.follows.clear()
            a, b = self.names[left], self.names[right]
            known = self.follows[left << 20 | right] = self.merged(self.symbols(a) + self.symbols(b)) == [a, b]
        return known

    def last_token(self, prefix: str, path: list[int], end: str) -> int:
        """The last token of prefix + end; path[i]: that of the prefix's first i + 1 characters."""
        n = len(prefix)
        find, whole, follows = self.vocab.get, self.whole, self.follows
        for start in range(n - self.longest if n > self.longest else 0, n):
            token = find(prefix[start:] + end)
            if token is None:
                continue
            if (known := whole.get(token)) is None:
                known = self.stands(token)
            if known:
                if not start:
                    return token
                left = path[start - 1]
                if (known := follows.get(left << 20 | token)) is None:
                    known = self.may_follow(left, token)
                if known:
                    return token
        raise ValueError(f"no token ends {prefix!r}")

    def learn(self, words: Iterable[str]) -> None:
        """Encodes distinct words together: one trie, one depth-first walk."""
        root: dict = {}
        for word in words:
            spelled = word if word.isascii() and word.isprintable() else self.spelled(word)
            node = root
            for c in spelled[:-1]:
                below = node.get(c)
                if below is None:
                    below = node[c] = {}
                node = below
            node[spelled[-1] + END] = word
        todo, path, prefix = [(0, "", root)], [], ""
        last, width, packed = self.last_token, self.width, self.packed
        while todo:
            depth, edge, node = todo.pop()
            if edge:
                del path[depth - 1 :]
                prefix = prefix[: depth - 1] + edge
                path.append(last(prefix, path, ""))
            for c, below in node.items():
                if len(c) > 1:  # a word ends here: read its encoding back along the last tokens
                    token, at = last(prefix[:depth] + c[0], path, END), depth + 1
                    ids = [token]
                    while (at := at - width[token]) > 0:
                        token = path[at - 1]
                        ids.append(token)
                    ids.reverse()
                    packed[below] = pack(f"<{len(ids)}I", *ids)
                else:
                    todo.append((depth + 1, c, below))

    def pieces(self, text: str) -> list[str]:
        """The words of a text without special tokens, in lower case."""
        if text.isascii():
            return _ASCII.findall(text.lower())
        if _PLAIN.fullmatch(text):
            return _LATIN.findall(text.lower())
        return [bytes(map(self.bytes_of.__getitem__, x)).decode() for x, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    def spelled(self, word: str) -> str:
        return "".join([self.alphabet[b] for b in word.encode()])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers, for each text."""
        parts: list[list[list[str] | bytes]] = []
        for text in texts:
            if self.split_special and "<|" in text:
                parts.append([pack("<I", self.special[x]) if x in self.special else self.pieces(x) for x in self.split_special.split(text)])
            else:
                parts.append([self.pieces(text)])
        if len(self.packed) > REMEMBERED:
            self.packed.clear()
        self.learn(set().union(*(run for part in parts for run in part if isinstance(run, list))).difference(self.packed))
        get = self.packed.__getitem__
        return [b"".join([run if isinstance(run, bytes) else b"".join(map(get, run)) for run in part]) for part in parts]

    def decode(self, ids: bytes) -> str:
        """As the library decodes without a decoder: token strings, a blank between."""
        names = self.names
        return " ".join([names[i] for i in np.frombuffer(ids, "<u4").tolist()])


@functools.lru_cache(maxsize=2)
def _encoder(config: str) -> TrieEncoder:
    return TrieEncoder(config)


def _parts(texts: list[str | None]) -> Iterator[list[str]]:
    """Texts that share a trie: as they come, until they have PART characters; that bounds the words in hand."""
    part, held = [], 0
    for text in texts:
        part.append(text or "")
        held += len(part[-1])
        if held >= PART:
            yield part
            part, held = [], 0
    if part:
        yield part


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoded(docs: DataFrame, vocabulary: str | None = None, text: str = "text", out: str = "_bpe", texts: bool = False) -> DataFrame:
    """docs with a struct column: n_tokens, ids_sha256, decoded_sha256, and with texts=True ids and decoded.

    Whole texts are encoded. A null text counts as empty and has no tokens. Rows are independent:
    repeated rows repeat, an empty table stays empty; a column of docs named as `out` gives way, all others pass
    through untouched.
    vocabulary: a tokenizers file on the driver (a few MB, fixed size), broadcast to the workers.
    """
    spark = docs.sparkSession
    prepare(spark)
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        config = spark.sparkContext.broadcast(f.read())

    def run(column: pa.Array) -> pa.Array:
        encoder = _encoder(config.value)
        rows = []
        values = column.to_pylist()
        for part in _parts(values):
            for ids in encoder.encode_batch(part):
                plain = encoder.decode(ids)
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(plain.encode()).hexdigest(), *((ids, plain) if texts else ())))
        columns = [*zip(*rows)] or [()] * (5 if texts else 3)
        kinds = (("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.binary()), ("decoded", pa.string()))[: len(columns)]
        return pa.StructArray.from_arrays([pa.array(list(x), kind) for x, (_, kind) in zip(columns, kinds)], [name for name, _ in kinds])

    kind = "n_tokens:bigint,ids_sha256:string,decoded_sha256:string" + ",ids:binary,decoded:string" * texts
    return docs.withColumn(out, arrow(run, f"struct<{kind}>")(F.col(text)))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """encoded() over all documents: number and digests of ids and decoded text, one row a row."""
    return encoded(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "_bpe.*")


@stage_of("text")
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with the digest columns of their encoding."""
    return encoded(docs).select("*", "_bpe.*").drop("_bpe")
