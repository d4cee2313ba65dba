"""Best-fit packing of token pieces into sequences as they come, with a fixed number of open bins."""

from __future__ import annotations

import re
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .byte_bpe import DOUBTFUL, bounded, characters_of_bytes, raw
from .common import held, slices, table, texts, trimming

#: Tokens of a sequence, bins that stand open, and the id that ends a document.
SEQUENCE, OPEN_BINS, END = 2048, 1024, 0
#: Pieces whose ids a worker keeps, and most characters of one: some 50 MB.
CACHED, LONGEST = 200_000, 64
#: Tasks number their sequences apart by so many bits.
TASK_BITS = 40
#: Added tokens, letters whose lower case depends on what stands around them, and characters that libraries class differently.
UNSURE = re.compile(f"<\\||[Σİ]|{DOUBTFUL.pattern}")


class Packer:
    """Bounded-space online best fit: open bins stand in stacks by free space, and bit f of a set says that stack f has one.

    A piece goes to the open bin with the least room that suffices, found as the lowest set bit from the piece's length on.
    With no such bin, one opens; beyond most open bins the fullest closes first. A full bin closes at once.
    """

    def __init__(self, size: int = SEQUENCE, most: int = OPEN_BINS):
        self.size, self.most = size, most
        self.stacks: list[list[int]] = [[] for _ in range(size + 1)]
        self.free, self.open, self.bins = 0, 0, 0

    def _taken(self, room: int) -> int:
        number = self.stacks[room].pop()
        if not self.stacks[room]:
            self.free ^= 1 << room
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece of 1 to size tokens."""
        fitting = self.free >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            number = self._taken(room)
        else:
            room, number = self.size, self.bins
            self.bins += 1
        left = room - length
        if left:
            if self.open == self.most:
                self._taken((self.free & -self.free).bit_length() - 1)
            self.stacks[left].append(number)
            self.free |= 1 << left
            self.open += 1
        return number, self.size - room


class WordEncoder:
    """Ids of whole texts as the tokenizers library gives them, for a lower-case vocabulary with word ends that drops white space.

    A word's last symbol carries END_OF_WORD in the vocabulary. Here the mark is a capital letter, which no lower-case
    text has: words joined by it are merged in one call, with ranks of the vocabulary's order. Each distinct piece
    between white space is encoded once while it is kept; texts in doubt go to the library whole.
    """

    END_OF_WORD, MARK = "</w>", "A"
    #: Fixed value: the vocabulary's split, with a space as a part of its own to tell pieces apart.
    SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+| ")

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        byte, end = characters_of_bytes(), self.END_OF_WORD
        added = {x.content for x in self.library.get_added_tokens_decoder().values()}
        ranks = {}
        for token, i in self.library.get_vocab().items():
            if token not in added:
                body = token.removesuffix(end)
                ranks[bytes(byte[c] for c in body) + self.MARK.encode() * token.endswith(end)] = i
        # The bare capital would be taken for a mark with nothing before it: it can't occur, and any free rank does.
        ranks[self.MARK.encode()] = max(self.library.get_vocab().values()) + 1
        self.core = tiktoken.Encoding("words", pat_str=f"[^{self.MARK}]*{self.MARK}", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.gap = ranks[b" " + self.MARK.encode()]
        self.pieces: dict[str, bytes] = {}

    def encode(self, found: list[str]) -> list[bytes]:
        split = [None if UNSURE.search(x) else x.split() for x in found]
        wanted = set().union(*(x for x in split if x))
        fresh = list(wanted.difference(self.pieces))
        if fresh:
            joined = unicodedata.normalize("NFC", " ".join(fresh)).lower()
            data = bytes(self.core.encode_to_tiktoken_buffer(self.MARK.join([*self.SPLIT.findall(joined), ""]), set()))
            at = 0
            for piece, n in zip(fresh, [*(4 * np.flatnonzero(np.frombuffer(data, "<u4") == self.gap)).tolist(), len(data)], strict=True):
                self.pieces[piece] = data[at:n]
                at = n + 4
        get = self.pieces.__getitem__
        out = [raw(self.library.encode(x, add_special_tokens=False).ids) if s is None else b"".join(map(get, s)) for x, s in zip(found, split, strict=True)]
        self.pieces = bounded(self.pieces, wanted, fresh, CACHED, LONGEST)
        return out


PLACED = "piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
_KINDS = (pa.int32(), *[pa.int64()] * 5, pa.binary())


def pack(docs: DataFrame, doc_id: str, text: str, path: str, size: int = SEQUENCE, most: int = OPEN_BINS, ids: bool = False) -> DataFrame:
    """A row for each piece of each document: where it stands in which sequence, and with ids its token ids.

    A document is its text's ids and END; only one longer than size is cut, at multiples of size. Each task packs what it
    reads as it comes, with most bins open at any time, of which the fullest closes when another must open. It numbers its
    sequences apart from other tasks', so nothing is shuffled and a task that runs again gives the same rows. Null text is
    empty: one piece of END alone. Repeated rows are packed each for itself; an empty table gives no rows; only doc_id and
    text are read.
    """
    wanted = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = f"doc_id {wanted.schema[0].dataType.simpleString()}, {PLACED}" + ", ids binary" * ids
    names = [x.split()[0] for x in schema.split(", ")]
    end, cut = raw([END]), 4 * size

    def packed(batches):
        engine = held(("words", path), lambda: WordEncoder(path))
        packer, base = Packer(size, most), TaskContext.get().partitionId() << TASK_BITS
        for batch in slices(batches):
            owner: list[int] = []
            columns: list[list] = [[] for _ in names[1:]]
            for row, found in enumerate(engine.encode(texts(batch.column(1)))):
                whole = found + end
                for piece, at in enumerate(range(0, len(whole), cut)):
                    part = whole if len(whole) <= cut else whole[at : at + cut]
                    bin_, offset = packer.place(len(part) // 4)
                    owner.append(row)
                    for column, value in zip(columns, (piece, at // 4, len(part) // 4, zlib.crc32(part), base + bin_, offset, part), strict=False):
                        column.append(value)
            keys = batch.column(0).take(pa.array(owner, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *map(pa.array, columns, _KINDS)], names=names)

    return wanted.mapInArrow(trimming(packed, "words"), schema)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces of at most 2048 tokens and their places; see pack for nulls, empty and long texts."""
    return pack(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"))
