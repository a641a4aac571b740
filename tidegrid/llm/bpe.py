"""Byte-level BPE encoding by a traversal of a trie of distinct words, and decoding.

The encoding of a byte string is its last token plus the encoding of what
stands before it, and two neighbouring tokens are right exactly when no merge would
have crossed the boundary between them. So one state per prefix, its
last token, determines the encoding. The new distinct words of a batch go into
a trie; a depth-first walk computes the state of every node from the states of
the nodes above it, so a prefix that many words share is encoded once. Words
longer than ``TRIE_BYTES`` use the same recurrence without trie nodes.

Encoded pieces of text between spaces are kept from batch to batch; when the
store is full it is emptied, which changes no result.
"""

from __future__ import annotations

import gc
import hashlib
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidegrid.llm.common import batches_of_texts, id_text, per_worker, with_fields

#: Fixed value: the pattern that splits text into words before merging.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TRIE_BYTES = 512
STORE_ENTRIES = 600_000
_WORD = -1  # key of a trie node that ends a word; other keys are bytes


def printable_bytes() -> dict[str, int]:
    """The character by which the vocabulary file writes each byte: itself if it prints, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Bpe:
    """Vocabulary, merges and special tokens of a byte-level tokenizer file."""

    def __init__(self, file_text: str):
        spec = json.loads(file_text)
        to_byte = printable_bytes()
        as_bytes = lambda token: bytes(to_byte[c] for c in token)
        ids = {as_bytes(t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.bytes_of = {str(i): t for t, i in ids.items()} | {str(i): t.encode() for t, i in self.special.items()}
        self.words = regex.compile(WORDS)
        # By id: length, rank of the merge that makes the token (-1 for a byte), and its two parts.
        self.length = {i: len(t) for t, i in ids.items()}
        self.rank = {i: -1 for t, i in ids.items() if len(t) == 1}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge_rank: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = map(as_bytes, merge if isinstance(merge, list) else merge.split(" "))
            whole = ids[left + right]
            self.merge_rank[ids[left], ids[right]] = rank
            if whole not in self.rank:
                self.rank[whole], self.parts[whole] = rank, (ids[left], ids[right])
        # Tokens by their bytes read backwards; one that merging never yields cannot be used.
        self.backwards: dict = {}
        for token, i in ids.items():
            if i in self.parts and not self.stays(*self.parts[i], self.rank[i]) or i not in self.rank:
                continue
            node = self.backwards
            for byte in reversed(token):
                node = node.setdefault(byte, {})
            node[_WORD] = i
        self.decimal = {i: f",{i}" for i in self.length}
        self.fits: dict[int, bool] = {}
        self.store: dict[str, str] = {}

    def stays(self, left: int, right: int, limit: int = 1 << 40) -> bool:
        """Whether no merge joins the tokens across their boundary before rank ``limit``.

        Going back in time, the part at the boundary that was made last is undone. A merge of the
        two parts at the boundary would have come first if its rank is below that of the merge which
        used one of them up; at the same rank the leftmost place comes first.
        """
        while True:
            rank = self.merge_rank.get((left, right))
            if rank is not None and rank < limit:
                return False
            if self.rank[left] > self.rank[right]:
                limit, left = self.rank[left], self.parts[left][1]
            elif self.rank[right] < 0:
                return True
            else:
                limit, right = self.rank[right] + 1, self.parts[right][0]

    def last_token(self, path: bytes | bytearray, depth: int, last: list[int]) -> int:
        """The last token of ``path[:depth]``, given those of all shorter prefixes."""
        node, k, ends = self.backwards, depth, []
        while k:
            k -= 1
            node = node.get(path[k])
            if node is None:
                break
            if _WORD in node:
                ends.append((k, node[_WORD]))
        fits = self.fits
        for start, token in reversed(ends):
            if not start:
                return token
            pair = last[start] << 24 | token
            known = fits.get(pair)
            if known is None:
                known = fits[pair] = self.stays(last[start], token)
            if known:
                return token
        raise ValueError("a byte without a token")

    def encode_words(self, words: set[bytes]) -> dict[bytes, str]:
        """Ids of distinct words, as decimals joined by commas."""
        collecting = gc.isenabled()
        gc.disable()  # a trie has no cycles; scanning its nodes would only cost time
        try:
            return self._walk_trie(words)
        finally:
            if collecting:
                gc.enable()

    def _walk_trie(self, words: set[bytes]) -> dict[bytes, str]:
        trie: dict = {}
        out = {}
        for word in words:
            if len(word) > TRIE_BYTES:
                out[word] = self._encode_long(word)
                continue
            node = trie
            for byte in word:
                child = node.get(byte)
                if child is None:
                    child = node[byte] = {}
                node = child
            node[_WORD] = word
        # State of a prefix: its last token and, written out from it, its ids.
        path, last, ids = bytearray(TRIE_BYTES), [0] * (TRIE_BYTES + 1), [""] * (TRIE_BYTES + 1)
        length, decimal, last_token = self.length, self.decimal, self.last_token
        stack = [(trie, 0, 0)]
        while stack:
            node, depth, byte = stack.pop()
            if depth:
                path[depth - 1] = byte
                last[depth] = token = last_token(path, depth, last)
                ids[depth] = ids[depth - length[token]] + decimal[token]
            depth += 1
            for key, child in node.items():
                if key == _WORD:
                    out[child] = ids[depth - 1][1:]
                else:
                    stack.append((child, depth, key))
        return out

    def _encode_long(self, word: bytes) -> str:
        last = [0]
        for depth in range(1, len(word) + 1):
            last.append(self.last_token(word, depth, last))
        ids, depth = [], len(word)
        while depth:
            ids.append(str(last[depth]))
            depth -= self.length[last[depth]]
        return ",".join(reversed(ids))

    def learn(self, pieces: set[str]) -> None:
        """Store the ids of pieces of text; the words of the new ones go through one trie."""
        new = pieces.difference(self.store)
        if len(self.store) + len(new) > STORE_ENTRIES:
            self.store.clear()
            self.fits.clear()
            new = pieces
        words = {p: [w.encode() for w in self.words.findall(p)] for p in new}
        encoded = self.encode_words({w for ws in words.values() for w in ws})
        for piece, ws in words.items():
            self.store[piece] = encoded[ws[0]] if len(ws) == 1 else ",".join(map(encoded.__getitem__, ws))

    def encode_batch(self, texts: list[str]) -> list[str]:
        """Per text its ids, as decimals joined by commas."""
        plain = []  # per text: strings to encode, and ids of special tokens between them
        for text in texts:
            if self.split_special and self.split_special.search(text):
                found = [str(self.special[m]) for m in self.split_special.findall(text)]
                plain.append((self.split_special.split(text), found))
            else:
                plain.append(([text], []))
        # A word takes the space before it, so text may be cut before any single space that
        # follows something else than white space. Text with longer runs is split as a whole.
        cut, needed = {}, set()
        for part in {p for parts, _ in plain for p in parts}:
            pieces = part.split(" ")
            if all(p and not p[-1].isspace() for p in set(pieces[:-1])):
                pieces = [pieces[0], *[" " + p for p in pieces[1:]]]
                cut[part] = pieces
                needed.update(pieces)
            else:
                cut[part] = None
        self.learn(needed)
        whole = {p: self.words.findall(p) for p, pieces in cut.items() if pieces is None}
        encoded = self.encode_words({w.encode() for ws in whole.values() for w in ws})
        done = {p: ",".join(encoded[w.encode()] for w in ws) for p, ws in whole.items()}
        store = self.store.__getitem__
        for part, pieces in cut.items():
            if pieces is not None:
                done[part] = ",".join(filter(None, map(store, pieces)))
        out = []
        for parts, found in plain:
            ids = [done[parts[0]]]
            for token, part in zip(found, parts[1:]):
                ids += [token, done[part]]
            out.append(",".join(filter(None, ids)))
        return out

    def decode(self, ids: str) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""


def worker_bpe(file_text: str) -> Bpe:
    """The worker's encoder; what it has stored serves the worker's later tasks."""
    return per_worker("bpe", file_text, lambda: Bpe(file_text))


def encode_ids(docs: DataFrame, tokenizer_path: str, *others: str) -> DataFrame:
    """doc_id, ``others``, n_tokens, ids, round_trip (decoding gives the text) for every row.

    Nulls and edges: null and empty texts have no ids and decode to an empty
    text; texts of any length are encoded whole; rows are independent, so
    repeated rows repeat; further columns are ignored. The tokenizer file is
    read by the driver and broadcast: its size is fixed (a few MB).
    """
    shared = _shared_file(docs, tokenizer_path)
    names = ["doc_id", *others]

    def run(stream):
        bpe = worker_bpe(shared.value)
        for batch in stream:
            for part in batches_of_texts([batch]):
                texts = part.column(len(names)).to_pylist()
                ids = bpe.encode_batch(texts)
                numbers = [np.fromstring(i, dtype=np.int32, sep=",") for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array([len(n) for n in numbers], pa.int64()),
                     pa.array(numbers, pa.list_(pa.int32())),
                     pa.array([bpe.decode(i) == t for i, t in zip(ids, texts)])],
                    names=[*names, "n_tokens", "ids", "round_trip"])

    rows = id_text(docs, *others).select(*names, "text")
    return rows.mapInArrow(run, with_fields(rows.drop("text"), n_tokens="long", ids="array<int>", round_trip="boolean"))


def encode_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; edges as in ``encode_ids``.

    Hashed in the task that makes the ids, so that ids and texts are not moved.
    """
    shared = _shared_file(docs, tokenizer_path)

    def run(stream):
        bpe = worker_bpe(shared.value)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in stream:
            for part in batches_of_texts([batch]):
                ids = bpe.encode_batch(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([i.count(",") + 1 if i else 0 for i in ids], pa.int64()),
                     pa.array([digest(i) for i in ids]), pa.array([digest(bpe.decode(i)) for i in ids])],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = id_text(docs)
    return rows.mapInArrow(run, with_fields(
        rows.select("doc_id"), n_tokens="long", ids_sha256="string", decoded_sha256="string"))


def _shared_file(docs: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())
