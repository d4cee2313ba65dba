"""Byte-level BPE: a vocabulary's merges, a minimal acyclic transducer of frequent words, and an encoder over both."""

from __future__ import annotations

import json
import mmap
import re
from collections.abc import Iterable
from functools import cache
from itertools import islice

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

#: The split of byte-level BPE, and the characters that stand for bytes in its vocabulary files.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

#: Texts with characters that libraries may class differently are encoded by the tokenizers library itself.
DOUBTFUL = re.compile("[\x1c-\x1f՘-֏࢏౜೜₏₝-₟꟎-꭭\U00010000-\U0010ffff]")
#: Where a cut before each single space isn't always a cut between words.
SPACED = re.compile(r"\s |[\s\x00]\Z|\x00")
#: Pieces whose ids a worker keeps, and most characters of one: some 50 MB.
CACHED, LONGEST = 200_000, 64


def bounded(kept: dict, latest: Iterable, fresh: list, most: int, longest: int) -> dict:
    """kept without long keys; beyond most keys only those of the latest texts, where frequent ones are, and of these most at most."""
    for x in fresh:
        if len(x) > longest:
            kept.pop(x, None)
    if len(kept) <= most:
        return kept
    return dict(islice(((x, kept[x]) for x in latest if x in kept), most // 2))


def characters_of_bytes() -> dict[str, int]:
    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        byte = characters_of_bytes()
        ranks = {bytes(byte[c] for c in token): i for token, i in data["model"]["vocab"].items()}
        self.added = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.core = tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.tokens = [b""] * (1 + max([*ranks.values(), *self.added.values()]))
        for token, i in ranks.items():
            self.tokens[i] = token
        for token, i in self.added.items():
            self.tokens[i] = token.encode()
        self.lengths = np.array([len(x) for x in self.tokens], np.int64)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.words = regex.compile(WORDS)
        #: Texts that may hold an added token.
        self.special = re.compile("|".join(map(re.escape, self.added)) or r"(?!)")

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text; bytes that are no UTF-8 become the replacement character."""
        found = b"".join([self.tokens[i] for i in ids.tolist()])
        try:
            found.decode()
        except UnicodeDecodeError:
            found = found.decode(errors="replace").encode()
        return found


class Lexicon:
    """Words to ids: a minimal acyclic automaton numbers its words, the numbers lead to the ids.

    Equal suffixes share states. An arc carries how many words sort before its branch, so the sum along a word's path is its number.
    """

    FIELDS = (("keys", np.int64), ("targets", np.int32), ("before", np.int32), ("final", np.uint8), ("starts", np.int64), ("ids", np.uint32))

    @classmethod
    def compiled(cls, words: dict[bytes, list[int]]) -> bytes:
        """The lexicon's file. words: each with its ids; the empty word is left out."""
        arcs: list[list[tuple[int, int]]] = [[]]
        final, known = [False], {}

        def settle(path: list[int], upto: int) -> None:
            """Replace the last word's states below depth upto by equal states that are known."""
            while len(path) - 1 > upto:
                state = path.pop()
                same = known.setdefault((final[state], tuple(arcs[state])), state)
                byte = arcs[path[-1]][-1][0]
                arcs[path[-1]][-1] = (byte, same)

        ordered, path, last = sorted(w for w in words if w), [0], b""
        for word in ordered:
            shared = 0
            while shared < min(len(word), len(last)) and word[shared] == last[shared]:
                shared += 1
            settle(path, shared)
            for byte in word[shared:]:
                arcs.append([])
                final.append(False)
                arcs[path[-1]].append((byte, len(arcs) - 1))
                path.append(len(arcs) - 1)
            final[path[-1]] = True
            last = word
        settle(path, 0)

        order, new = [], {}
        stack = [(0, False)]
        while stack:  # states after all that they lead to
            state, done = stack.pop()
            if done:
                new[state] = len(order)
                order.append(state)
            elif state not in new:
                new[state] = -1
                stack.append((state, True))
                stack.extend((t, False) for _, t in arcs[state] if t not in new)
        count = {}
        keys, targets, before = [], [], []
        for state in order:
            n = int(final[state])
            for byte, t in arcs[state]:
                keys.append(new[state] << 8 | byte)
                targets.append(new[t])
                before.append(n)
                n += count[t]
            count[state] = n
        ids = [words[w] for w in ordered]
        fields = {
            "keys": keys, "targets": targets, "before": before, "final": [final[s] for s in order],
            "starts": np.cumsum([0, *map(len, ids)]), "ids": [i for x in ids for i in x],
        }
        parts = [np.asarray(fields[name], kind).tobytes() for name, kind in cls.FIELDS]
        head = json.dumps({"root": new[0], "bytes": [len(x) for x in parts]}).encode().ljust(256)
        return head + b"".join(x + bytes(-len(x) % 8) for x in parts)

    def __init__(self, path: str):
        """Maps the file into memory: the workers of a machine share its pages."""
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        head, at = json.loads(self.map[:256]), 256
        self.root = head["root"]
        for (name, kind), n in zip(self.FIELDS, head["bytes"], strict=True):
            setattr(self, name, np.frombuffer(self.map, kind, n // np.dtype(kind).itemsize, at))
            at += n + -n % 8

    def ids_of(self, words: list[bytes]) -> list[bytes | None]:
        """Each word's ids as little-endian unsigned 32-bit integers, None for words that aren't in the lexicon."""
        out: list[bytes | None] = [None] * len(words)
        number = self.numbers(words)
        hits = np.flatnonzero(number >= 0)
        data = self.ids.astype("<u4", copy=False)
        for i, a, b in zip(hits.tolist(), self.starts[number[hits]].tolist(), self.starts[number[hits] + 1].tolist(), strict=True):
            out[i] = data[a:b].tobytes()
        return out

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, -1 for words that aren't in the lexicon; all words walk at once, a byte a step."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        data, starts = np.frombuffer(b"".join(words), np.uint8), np.cumsum(n) - n
        state, number = np.full(len(words), self.root), np.zeros(len(words), np.int64)
        on = np.flatnonzero(n > 0) if len(self.keys) else np.zeros(0, np.int64)
        number[n == 0] = -1
        if not len(self.keys):
            number[:] = -1
        step = 0
        while len(on):
            key = state[on] << 8 | data[starts[on] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            good = self.keys[at] == key
            number[on[~good]] = -1
            on, at = on[good], at[good]
            state[on] = self.targets[at]
            number[on] += self.before[at]
            step += 1
            over = n[on] == step
            ends = on[over]
            number[ends[self.final[state[ends]] == 0]] = -1
            on = on[~over]
        return number


class Encoder:
    """Encodes whole texts as the tokenizers library does, and keeps the ids of recent pieces between spaces."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        v, plans, wanted, firsts, words = self.vocabulary, [], set(), set(), set()
        for text in texts:
            if DOUBTFUL.search(text) or v.special.search(text):
                plans.append((None, text))
            elif SPACED.search(text):
                plans.append((self.words, found := v.words.findall(text)))
                words.update(found)
            else:
                first, *rest = text.split(" ")
                firsts.add("\0" + first)
                wanted.update(rest)
                plans.append((self.pieces, ["\0" + first, *rest]))
        fresh, first, new = list(wanted.difference(self.pieces)), list(firsts.difference(self.pieces)), list(words.difference(self.words))
        self._follow(fresh)
        for x in first:
            self.pieces[x] = raw(v.core.encode_ordinary(x[1:]))
        for x in new:
            self.words[x] = raw(v.core.encode_single_piece(x.encode()))
        out = [raw(v.library.encode(x, add_special_tokens=False).ids) if cache is None else b"".join(map(cache.__getitem__, x)) for cache, x in plans]
        self.pieces = bounded(self.pieces, wanted, fresh + first, CACHED, LONGEST)
        self.words = bounded(self.words, words, new, CACHED // 4, LONGEST)
        return out

    def _follow(self, fresh: list[str]) -> None:
        """Keep the ids of pieces that follow a space: from the lexicon, else merged exactly, all in one call."""
        known = self.lexicon.ids_of([(" " + x).encode() for x in fresh])
        self.pieces.update((x, ids) for x, ids in zip(fresh, known, strict=True) if ids is not None)
        unseen = [x for x, ids in zip(fresh, known, strict=True) if ids is None]
        if unseen:
            data = bytes(self.vocabulary.core.encode_to_tiktoken_buffer("".join([" " + x for x in unseen]), set()))
            ends = np.cumsum(self.vocabulary.lengths[np.frombuffer(data, "<u4")])
            sizes = np.fromiter((len(x.encode()) + 1 for x in unseen), np.int64, len(unseen))
            at = 0
            for x, n in zip(unseen, (4 + 4 * np.searchsorted(ends, np.cumsum(sizes))).tolist(), strict=True):
                self.pieces[x] = data[at:n]
                at = n


def raw(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.asarray(ids, "<u4").tobytes()


@cache
def vocabulary(path: str) -> Vocabulary:
    """The driver reads each file once; a worker's stands in its encoder."""
    return Vocabulary(path)
