"""BPE encoding and decoding in batched numpy merge rounds.

A batch's new words lie side by side in one flat array of symbols. In each round every word finds its lowest-ranked pair (pair keys are looked up by binary search in the sorted merge table) and merges it wherever it occurs, from the left; words without a pair that merges leave the array.
Words are the pre-tokenizer's pieces; each worker keeps those it has seen, up to a bound of bytes, since few words make most of a text.

Nulls: a null or empty text has no tokens and decodes to the empty text. Whole texts are encoded, in slices of a few MB of rows. Repeated rows are encoded alike; other columns, whatever their names, are only passed on where asked for.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import in_pieces

#: Fixed value: the pre-tokenizer's pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same words in ASCII text, where the standard library is faster.
ASCII_PATTERN = r" ?[A-Za-z]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"
#: Of the words that a worker keeps: bytes at most, after which it starts anew.
KEPT_BYTES = 120 << 20


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in such a vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ByteBPE:
    """Encoder and decoder of a byte-level BPE file of the tokenizers library."""

    def __init__(self, definition: dict):
        vocab, merges = definition["model"]["vocab"], definition["model"]["merges"]
        self.added = {t["content"]: t["id"] for t in definition.get("added_tokens", [])}
        chars = byte_chars()
        to_byte = {c: b for b, c in chars.items()}
        self.byte_ids = np.array([vocab[chars[b]] for b in range(256)], np.int32)
        self.width = max([*vocab.values(), *self.added.values()]) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        new = np.array([vocab[a + b] for a, b in pairs], np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of, self.new_of_rank = keys[order], order, new
        texts = [b""] * self.width
        for token, i in vocab.items():
            texts[i] = bytes(to_byte[c] for c in token)
        for token, i in self.added.items():
            texts[i] = token.encode()
        lengths = np.array([len(t) for t in texts], np.int64)
        self.token_bytes, self.token_len = np.frombuffer(b"".join(texts), np.uint8), lengths
        self.token_at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        self.ids_of: dict[str, bytes] = {}
        self.text_of: dict[str, str] = {}
        self.kept = 0
        self.split_any, self.split_ascii = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or the number of merges where it has none: binary search in the sorted keys."""
        pair = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.rank_of[at], len(self.keys)).astype(np.int32)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and where each word's begin; all are merged together round by round."""
        data, none = np.frombuffer(b"".join(words), np.uint8), np.int32(len(self.keys))
        length = np.fromiter(map(len, words), np.int64, len(words))
        sym, word = self.byte_ids[data], np.arange(len(words), dtype=np.int32)
        rank = np.append(self.ranks(sym[:-1], sym[1:]), none)
        rank[np.cumsum(length) - 1] = none  # the last symbol of a word has no pair
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(word):
            first = np.cumsum(length) - length
            best = np.minimum.reduceat(rank, first)
            live = best < none
            if not live.all():
                each = np.repeat(live, length)
                done.append((word[~live], length[~live], sym[~each]))
                word, length, best, sym, rank = word[live], length[live], best[live], sym[each], rank[each]
                if not len(word):
                    break
                first = np.cumsum(length) - length
            where = np.flatnonzero(rank == np.repeat(best, length))
            near = np.diff(where) == 1
            if near.any():  # in a row of hits every second one merges
                row = np.concatenate([[0], np.flatnonzero(~near) + 1])
                where = where[(np.arange(len(where)) - np.repeat(row, np.diff(np.append(row, len(where))))) % 2 == 0]
            sym[where] = self.new_of_rank[rank[where]]
            rank[where] = rank[where + 1]  # none if the pair was a word's last
            keep = np.ones(len(sym), bool)
            keep[where + 1] = False
            length = length - np.bincount(np.searchsorted(first, where, "right") - 1, minlength=len(word))
            sym, rank = sym[keep], rank[keep]
            now = where - np.arange(len(where))
            ends = np.zeros(len(sym), bool)
            ends[np.cumsum(length) - 1] = True
            for at in (now, now[now > 0] - 1):  # only pairs beside a merge have a new rank
                at = at[~ends[at]]
                rank[at] = self.ranks(sym[at], sym[at + 1])
            rank[ends] = none
        word, length = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        sym = np.concatenate([d[2] for d in done])
        begin = (np.cumsum(length) - length)[order := np.argsort(word)]
        length = length[order]
        out = np.cumsum(length) - length
        return sym[np.arange(len(sym)) + np.repeat(begin - out, length)], np.append(out, len(sym))

    def learn(self, words: set[str]) -> None:
        """Merges the words that are not known yet, in groups of about a MB."""
        new = sorted(words - self.ids_of.keys())
        if self.kept > KEPT_BYTES:
            self.ids_of, self.text_of, self.kept = {}, {}, 0
            new = sorted(words)
        at = 0
        while at < len(new):
            group, size = [], 0
            while at < len(new) and (size < 1 << 20 or not group):
                group.append(new[at])
                size += len(new[at])
                at += 1
            ids, begin = self.merge([w.encode() for w in group])
            raw, names, begin = ids.astype("<i4").tobytes(), list(map(str, ids.tolist())), begin.tolist()
            for w, a, z in zip(group, begin, begin[1:], strict=False):
                self.ids_of[w], self.text_of[w] = raw[4 * a : 4 * z], ",".join(names[a:z])
            self.kept += 350 * len(group) + 3 * size + 12 * len(ids)

    def split(self, text: str) -> list[str]:
        return (self.split_ascii if text.isascii() else self.split_any)(text)

    def pieces(self, text: str) -> list[str]:
        """The words of a text, special tokens as words of their own."""
        if self.special is None or not any(t in text for t in self.added):
            return self.split(text)
        out: list[str] = []
        for k, part in enumerate(self.special.split(text)):
            out += [part] if k % 2 else self.split(part)
        return out

    def encode_batch(self, texts: list[str | None]) -> list[tuple[np.ndarray, str]]:
        """Of each text its ids, and these in decimal joined by commas."""
        split = [self.pieces(t) if t else [] for t in texts]
        self.learn(set().union(*split))
        for t, i in self.added.items():
            self.ids_of[t], self.text_of[t] = np.array([i], "<i4").tobytes(), str(i)
        out = []
        for words in split:
            joined = ",".join([self.text_of[w] for w in words])
            out.append((np.frombuffer(b"".join([self.ids_of[w] for w in words]), "<i4"), joined))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of token ids in UTF-8; bytes that are none are replaced, as the library does."""
        if not len(ids):
            return b""
        n = self.token_len[ids]
        end = np.cumsum(n)
        place = np.arange(end[-1]) + np.repeat(self.token_at[ids] - (end - n), n)
        raw = self.token_bytes[place].tobytes()
        return raw.decode("utf-8", "replace").encode()


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each row of docs: its id, n_tokens, ids_sha256, decoded_sha256, and token_ids where asked for.

    vocabulary: path of the vocabulary file on the driver; its content (about 2 MB) goes with the task.
    """
    from pathlib import Path

    definition = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text(encoding="utf-8"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = None
        for b in in_pieces(batches, "t", 4 << 20):
            bpe = bpe or ByteBPE(json.loads(definition.value))
            coded = bpe.encode_batch(b.column(1).to_pylist())
            cols = [b.column(0), pa.array([len(ids) for ids, _ in coded], pa.int64()), pa.array([hashlib.sha256(s.encode()).hexdigest() for _, s in coded]), pa.array([hashlib.sha256(bpe.decode(ids)).hexdigest() for ids, _ in coded])]
            names = ["i", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols.append(pa.array([ids for ids, _ in coded], pa.list_(pa.int32())))
                names.append("token_ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"i {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", token_ids array<int>" if with_ids else "")
    return docs.selectExpr(f"`{id_col}` AS i", f"`{text_col}` AS t").mapInArrow(run, schema).withColumnRenamed("i", id_col)


def vocabulary_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path())
