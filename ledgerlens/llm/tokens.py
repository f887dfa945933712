"""Token ids of whole texts inside Arrow tasks, through a bounded cache of text chunks."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import returning_memory

#: Bytes that a cache of chunks, or of words in them, holds; when full, it starts anew.
CACHE_BYTES = 32 << 20
#: What an entry takes beside its own bytes: two objects and a place in the table.
ENTRY_BYTES = 200
#: Longer chunks rarely come again, and are not kept.
KEPT_CHARS = 64
#: Bytes of text that are split into chunks at a time (a longer text makes a part of its own).
PART_BYTES = 2 << 20


class Tokenizer:
    """Ids of a tokenizer file of the ``tokenizers`` library, special tokens not added.

    ``encode`` gives the ids of many texts as one array of ``dtype`` and where each text's
    begin. Files of the lower-casing kind that drops white space (word ends marked in the
    vocabulary) are encoded chunk by chunk between spaces, each distinct chunk once: a
    chunk's ids there do not depend on its neighbours. Every other file encodes whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Library

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Library.from_str(json.dumps(spec))
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.by_chunk = spec["model"].get("end_of_word_suffix") == "</w>" and spec["model"]["type"] == "BPE"
        if self.by_chunk:
            piece, size = _piece_encoder(spec), self.dtype.itemsize
            table = [i.to_bytes(size, "little") for i in range(self.library.get_vocab_size())]
            self._pattern = _pattern(spec)
            self._special = tuple(t["content"] for t in spec["added_tokens"])
            self._words = _Cache(lambda w: b"".join([table[i] for i in piece(w.encode() + b"\xff")]))
            self._chunks = _Cache(self._chunk)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): text k's ids are ``ids[bounds[k]:bounds[k + 1]]``; null texts have none."""
        if not self.by_chunk:
            coded = [self._library(t or "") for t in texts.to_pylist()]
            bounds = np.cumsum([0, *(len(c) // self.dtype.itemsize for c in coded)])
            return np.frombuffer(b"".join(coded), self.dtype), bounds
        spaced = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
        lists = pc.split_pattern(spaced, " ")
        chunks = lists.flatten().dictionary_encode()
        coded = [self._chunks[c] for c in chunks.dictionary.to_numpy(zero_copy_only=False).tolist()]
        flat = np.frombuffer(b"".join(coded), self.dtype)
        lengths = np.fromiter(map(len, coded), np.int64, len(coded)) // self.dtype.itemsize
        starts = np.cumsum(lengths) - lengths
        which = chunks.indices.to_numpy(zero_copy_only=False)
        each = lengths[which]
        ends = np.cumsum(each)
        ids = flat[np.repeat(starts[which] - ends + each, each) + np.arange(ends[-1] if len(ends) else 0)]
        words = np.cumsum([0, *lists.value_lengths().to_pylist()])
        return ids, np.concatenate([[0], ends])[words]

    def _library(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        try:
            chunk.encode("latin-1")  # such text is in normal form, and lower case knows no context
        except UnicodeEncodeError:
            return self._library(chunk)
        low = chunk.lower()
        if low.isalpha():
            return self._words[low]
        head, last = low[:-1], low[-1:]
        if head.isalpha() and not last.isspace():
            return self._words[head] + self._words[last]
        if any(s in chunk for s in self._special):
            return self._library(chunk)
        return b"".join([self._words[w] for w in self._pattern.findall(low)])


class _Cache(dict):
    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make
        self.held = 0

    def __missing__(self, key: str) -> bytes:
        made = self.make(key)
        if len(key) <= KEPT_CHARS:
            self.held += len(key) + len(made) + ENTRY_BYTES
            if self.held > CACHE_BYTES:
                self.clear()
                self.held = len(key) + len(made) + ENTRY_BYTES
            self[key] = made
        return made


def _pattern(spec: dict):
    import regex

    steps = spec["pre_tokenizer"]["pretokenizers"]
    return regex.compile(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split"))


def _piece_encoder(spec: dict) -> Callable[[bytes], list[int]]:
    """Byte-pair ids of one word's bytes, followed by 0xFF for the word's end.

    That byte never occurs in UTF-8, and (byte, end) are the first merges of such a
    vocabulary, so ranks by id over the words' bytes give the vocabulary's merges."""
    import tiktoken

    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    added = {t["content"] for t in spec["added_tokens"]}
    ranks = {}
    for token, i in spec["model"]["vocab"].items():
        if token in added:
            continue
        ends = token.endswith("</w>") and token != "</w>"
        body = bytes(byte_of[c] for c in (token[:-4] if ends else token))
        if body != b"\xff" or ends:
            ranks[body + (b"\xff" if ends else b"")] = i
    unused = max(spec["model"]["vocab"].values()) + 1
    encoding = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={"unused": unused})
    return encoding._core_bpe.encode_single_piece


def text_parts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(ids, texts) in parts of about ``PART_BYTES``, from batches of those two columns."""
    for batch in returning_memory(batches):
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        parts = np.cumsum(sizes) // PART_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a)
