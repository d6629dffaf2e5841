"""Whole texts to ids of a byte-level BPE, with a bounded cache of encoded words.

A single space between two other characters always begins a new pre-token, so a
text can be cut in front of such spaces and every cut piece encoded on its own.
The pieces of a few megabytes of text are numbered at once; each distinct one is
looked up or encoded once, and the ids of all texts are gathered by number.
Texts with any other white space around a space go through the tokenizer as they
are, and so do texts that hold one of its added tokens, which it reads as that
token.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from .lattice_batch import ragged
from .word_ids import outer_bytes, strings

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
CACHE_ENTRIES = 700_000
BATCH_CHARS = 1 << 20
#: Matches nothing.
NEVER = r"[^\s\S]"
#: Behind letters these always begin a pre-token of their own; the apostrophe does not.
_MARKS = ".,;:!?%*#$&|)-"


class PieceEncoder:
    """Ids of texts as bytes of little-endian unsigned 32-bit integers.

    The cache has two generations: when the younger is full it becomes the older, and what is used again moves back.
    """

    def __init__(self, path: str = BYTE_BPE):
        self.tokenizer = Tokenizer.from_file(path)
        added = sorted((token.content for token in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        #: Finds an added token in a text; without any it finds nothing.
        self.added = re.compile("|".join(map(re.escape, added)) or NEVER)
        #: Bytes of every id; added tokens are not met where this is used.
        self.widths = np.array([len(self.tokenizer.id_to_token(token) or "") for token in range(self.tokenizer.get_vocab_size())], np.int64)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, pieces: list[str]) -> None:
        """Encode new pieces; a word followed by marks is put together from the two."""
        plain, joined, stems = [], [], set()
        for piece in pieces:
            if piece[-1] in _MARKS:
                stem = piece.rstrip(_MARKS)
                if stem.isalpha():
                    joined.append((piece, stem))
                    stems.add(stem)
                    continue
            plain.append(piece)
        known, older = self.known, self.older
        stems = {stem for stem in stems if stem not in known}.difference(plain)
        moved = stems.intersection(older)
        known.update(zip(moved, map(older.__getitem__, moved)))
        stems -= moved
        self._encode_new([*plain, *stems], known)
        for piece, stem in joined:
            tail = piece[len(stem):]
            if tail not in self.marks:
                self.marks[tail] = self.whole(tail)
            known[piece] = known[stem] + self.marks[tail]

    def _encode_new(self, pieces: list[str], known: dict[str, bytes]) -> None:
        """Encode pieces without spaces, each with one in front, as one string and cut the ids at the spaces."""
        at = 0
        while at < len(pieces):
            size, end = 0, at
            while end < len(pieces) and (size < BATCH_CHARS or end == at):
                size += len(pieces[end]) + 1
                end += 1
            part = pieces[at:end]
            text = " " + " ".join(part)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            # Ids stand for bytes of the text one behind the other, so their widths tell where each begins.
            firsts = np.cumsum(self.widths[ids]) - self.widths[ids]
            cuts = (4 * np.searchsorted(firsts, np.flatnonzero(np.frombuffer(text.encode(), np.uint8) == 32))).tolist()
            raw = ids.tobytes()
            known.update(zip(part, [raw[low:high] for low, high in zip(cuts, [*cuts[1:], len(raw)])]))
            at = end

    def _head(self, text: str) -> bytes:
        """A text's first piece, which has no space in front."""
        held = self.heads.get(text)
        if held is None:
            if len(self.heads) > CACHE_ENTRIES // 8:
                self.heads.clear()
            held = self.heads[text] = self.whole(text)
        return held

    def found(self, wanted: list[str]) -> list[bytes]:
        """The ids of all wanted pieces, which are in the younger generation then."""
        if len(self.known) > CACHE_ENTRIES // 2:
            self.known, self.older = {}, self.known
            self.marks.clear()
        known, older = self.known, self.older
        held = list(map(known.get, wanted))
        missing = [at for at, ids in enumerate(held) if ids is None]
        new = []
        for at in missing:
            piece = wanted[at]
            ids = older.get(piece)
            if ids is None:
                new.append(piece)
            else:
                known[piece] = ids
        self._learn(new)
        for at in missing:
            held[at] = known[wanted[at]]
        return held

    def encode_column(self, column: pa.Array) -> list[bytes]:
        """The ids of every text; null has none."""
        texts = column.cast(pa.large_string()).fill_null("")
        lists = pc.split_pattern(texts, " ")
        counts = np.asarray(pc.list_value_length(lists), np.int64)
        starts = np.cumsum(counts) - counts
        known = lists.flatten().dictionary_encode()
        codes, pieces = np.asarray(known.indices, np.int64), strings(known.dictionary)
        opening, closing = outer_bytes(known.dictionary)
        # Empty pieces count as white space, and so do all control letters; of others than ASCII the letter itself is asked.
        bare, late = opening <= 32, closing <= 32
        for code in np.flatnonzero(opening > 127).tolist():
            bare[code] = pieces[code][0].isspace()
        for code in np.flatnonzero(closing > 127).tolist():
            late[code] = pieces[code][-1].isspace()
        bare |= late
        # A first piece has no space in front and is encoded apart; white space at its end matters only before others.
        first = np.zeros(len(codes), bool)
        first[starts] = True
        odd = np.where(first, late[codes] & (np.repeat(counts, counts) > 1), bare[codes])
        whole = np.add.reduceat(odd, starts) > 0 if len(starts) else np.zeros(0, bool)
        if self.added.pattern != NEVER:
            whole |= np.asarray(pc.match_substring_regex(texts, self.added.pattern), bool)
        inside = ~first & ~np.repeat(whole, counts)
        used = np.flatnonzero(np.bincount(codes[inside], minlength=len(pieces)))
        wanted = [pieces[code] for code in used.tolist()]
        held = self.found(wanted)
        # Behind the pieces come every text's first one, or the whole of it.
        held += [self.whole(texts[row].as_py()) if alone else self._head(pieces[codes[start]])
                 for row, (alone, start) in enumerate(zip(whole.tolist(), starts.tolist()))]
        place = np.zeros(len(pieces), np.int64)
        place[used] = np.arange(len(used))
        place = np.where(first, len(used) + np.cumsum(first) - 1, place[codes])[first | inside]
        sizes = np.fromiter(map(len, held), np.int64, len(held)) // 4
        ids = np.frombuffer(b"".join(held), "<u4")[ragged((np.cumsum(sizes) - sizes)[place], sizes[place])].tobytes()
        ends = np.concatenate(([0], np.cumsum(sizes[place])))[np.append(np.flatnonzero(first[first | inside]), len(place))].tolist()
        return [ids[4 * low:4 * high] for low, high in zip(ends[:-1], ends[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.encode_column(pa.array(texts, pa.large_string()))


@lru_cache(maxsize=4)
def piece_encoder(path: str = BYTE_BPE) -> PieceEncoder:
    """One encoder per worker process, so that its cache outlives a task."""
    return PieceEncoder(path)
