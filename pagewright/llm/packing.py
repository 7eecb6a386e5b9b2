"""Harmonic packing of tokenised documents into sequences of ``capacity`` tokens.

A piece of ``n`` tokens belongs to class ``capacity // n``, and a sequence of class ``c``
holds exactly ``c`` pieces, so no search for room is needed and every task fills its own
sequences.  A document is cut into whole sequences first.  What remains goes into its class
uncut where that wastes at most ``waste`` of its room, and is otherwise cut at the largest
reciprocal ``capacity // c`` that fits, which fills its class's sequences all but exactly.
Sequences that are still open when a task ends are joined into one run of tokens and cut
into full sequences, and the last remainder into powers of two, which need no padding.

Defined results: a null text is the empty text; every document ends with the id 0, so an
empty one is a piece of one token.  The name of a special token in a text, such as
``<|endoftext|>``, is that token, as the vocabulary's own encoder has it; a text with one goes
through that encoder as a whole.  Repeated rows are packed as often as they occur.  An empty
table gives no piece.  Memory is bounded by one document, the open sequences (at most
``capacity`` tokens for each of about ``2 * sqrt(capacity)`` classes) and the word cache of
``CACHE_BYTES``, which ends with its task.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import runs, strings
from pagewright.session import bounded_batches

END = np.zeros(1, dtype="<u4").tobytes()
#: About what the words that a task remembers, and their ids, may take.
CACHE_BYTES = 48_000_000
#: Of a remembered word: two objects and their place in a dictionary.
WORD_BYTES = 200
#: A space that does not begin a word.
BLANKS = re.compile(r" (?:\s|\Z)")


# How byte-level BPE vocabularies split words, and the characters whose classes
# in that rule are the same in every version of Unicode.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
STEADY = re.compile(r"[\n\x21-\x7e\xa1-\xac\xae-\u017f]+")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1
    characters for themselves, the other bytes for those from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def fast_encoding(path: str):
    """An encoder that gives the same ids several times faster, or None for another kind of vocabulary.

    The rank of a merge is its result's id in these vocabularies, so the ids are the ranks.
    """
    try:
        import tiktoken
    except ImportError:  # all words go through the vocabulary's own encoder
        return None
    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    split, model = parts.get("pre_tokenizer") or {}, parts["model"]
    if parts.get("normalizer") or split.get("type") != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space") or model.get("type") != "BPE":
        return None
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    if [model["vocab"][m] for m in merged] != list(range(256, 256 + len(merged))):
        return None
    alphabet, special = byte_alphabet(), {t["content"] for t in parts.get("added_tokens", [])}
    ranks = {bytes(alphabet[c] for c in name): i for name, i in model["vocab"].items() if name not in special}
    return tiktoken.Encoding(path, pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


class WordTokenizer:
    """Ids of whole texts from a byte-level BPE whose words begin with their space.

    A space before a character that is not white space always begins a new word of such a
    vocabulary, so the parts between these places are encoded once each and remembered: the
    first part of a text as it is, each other part by what follows its space.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = fast_encoding(path)
        self.known: dict[str, bytes] = {}
        self.held = 0
        vocabulary = self.tokenizer.get_vocab()
        #: a token's name has a character for each of its bytes
        self.sizes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        self.sizes[list(vocabulary.values())] = list(map(len, vocabulary))

    @staticmethod
    def parts(text: str) -> list[str]:
        found = text.split(" ")
        if not BLANKS.search(text):
            return found
        first, *rest = found
        found = [first]
        for x in rest:
            if x and not x[0].isspace():
                found.append(x)
            else:  # white space belongs to the part before it
                found[-1] += " " + x
        return found

    def plain(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each of ``texts``."""
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def together(self, words: list[str], most: int = 500) -> Iterator[bytes]:
        """Ids of words of steady characters after a space each, encoded as one text; the
        sizes of the tokens tell where each word's end."""
        for i in range(0, len(words), most):
            own = words[i : i + most]
            ids = np.array(self.fast.encode_ordinary(" " + " ".join(own)), dtype="<u4")
            ends = np.cumsum([len(w.encode()) + 1 for w in own])
            ends = np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1
            flat = ids.tobytes()
            yield from (flat[4 * a : 4 * b] for a, b in pairwise([0, *ends.tolist()]))

    def forget(self) -> None:
        self.known.clear()
        self.held = 0

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if self.held > CACHE_BYTES:
            self.forget()
        whole = [i for i, t in enumerate(texts) if any(name in t for name in self.special)]
        if whole:
            apart = dict(zip(whole, self.plain([texts[i] for i in whole]), strict=True))
            others = iter(self.encode([t for i, t in enumerate(texts) if i not in apart]))
            return [apart[i] if i in apart else next(others) for i in range(len(texts))]
        known = self.known
        split = [self.parts(t) for t in texts]
        heads = self.plain([words[0] for words in split])
        new = list(set().union(*split).difference(known))
        steady = [x for x in new if STEADY.fullmatch(x)] if self.fast else []
        known.update(zip(steady, self.together(steady), strict=True))
        rest = [x for x in new if x not in known]
        known.update(zip(rest, self.plain([" " + x for x in rest]), strict=True))
        self.held += WORD_BYTES * len(new) + sum(map(len, new))
        return [head + b"".join(map(known.__getitem__, words[1:])) for head, words in zip(heads, split, strict=True)]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


class Packer:
    """One task's open sequences; finished pieces gather in ``out``."""

    def __init__(self, worker: int, capacity: int, waste: float):
        self.capacity, self.waste, self.next = capacity, waste, worker << 40
        self.open: dict[int, list[tuple]] = {}
        self.out: list[tuple] = []

    def lengths(self, n: int) -> Iterator[int]:
        """The pieces that the remainder of ``n`` tokens is cut into."""
        while n:
            held = self.capacity // n
            spare = self.capacity - held * n
            if spare <= self.waste * held * n:
                yield n
                return
            piece = self.capacity // -(-self.capacity // n)
            yield piece
            n -= piece

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for key, start, ids, total in pieces:
            n = len(ids) // 4
            self.out.append((key, start, n, zlib.crc32(ids), total, self.next, offset))
            offset += n
        self.next += 1

    def add(self, key, ids: bytes) -> None:
        total = len(ids) // 4
        at = 0
        while total - at >= self.capacity:
            self.close([(key, at, ids[4 * at : 4 * (at + self.capacity)], total)])
            at += self.capacity
        for n in self.lengths(total - at):
            held = self.capacity // n
            pieces = self.open.setdefault(held, [])
            pieces.append((key, at, ids[4 * at : 4 * (at + n)], total))
            at += n
            if len(pieces) == held:
                self.close(self.open.pop(held))

    def finish(self) -> None:
        """Cut the open sequences anew into full ones and into powers of two."""
        rest = [p for held in sorted(self.open) for p in self.open[held]]
        self.open = {}
        left = sum(len(p[2]) for p in rest) // 4
        pieces: list[tuple] = []
        room = target = 0
        for key, start, ids, total in rest:
            while ids:
                if not room:
                    room = target = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
                n = min(room, len(ids) // 4)
                pieces.append((key, start, ids[: 4 * n], total))
                start, ids, room, left = start + n, ids[4 * n :], room - n, left
                if not room:
                    self.close(pieces)
                    pieces, left = [], left - target


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = 1024, waste: float = 1 / 64) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    inputs = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    kind = inputs.schema["__key"].dataType.simpleString()
    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer, key_type = tokenizer(path), Packer(TaskContext.get().partitionId(), capacity, waste), pa.int64()

        def flush() -> Iterator[pa.RecordBatch]:
            columns = list(zip(*packer.out, strict=True)) or [[] for _ in names]
            packer.out = []
            kinds = [key_type, *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

        try:
            for batch in batches:
                keys, texts, key_type = batch.column("__key").to_pylist(), strings(batch, "__text"), batch.schema.field("__key").type
                for a, b in runs(texts, 1 << 20):
                    for k, ids in zip(keys[a:b], words.encode(texts[a:b]), strict=True):
                        packer.add(k, ids + END)
                    yield from flush()
            packer.finish()
            yield from flush()
        finally:
            words.forget()  # the worker goes on to other tasks

    bounded_batches(docs.sparkSession)
    return inputs.mapInArrow(packed, schema)
