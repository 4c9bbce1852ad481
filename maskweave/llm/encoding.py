"""Token ids of whole texts by the tokenizers library, piece by piece with a bounded cache.

A public tokenizer's pre-tokenizer never joins characters across a single blank between
two other characters: what follows the blank starts a new pre-token (with the blank, where
the vocabulary keeps it).  So a text is cut at such blanks, every distinct piece is encoded
once by the library, and the ids are put together by array operations.  New pieces are given
to the library many to a text, and the tokens show where each one lies.  Where the vocabulary
drops white space, pieces of Latin letters skip the library's normaliser and its splitting, which
leave them as they are.  The result equals encoding the whole text at once; ``tests/llm`` compares them.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are encoded at once.
STEP = 6_000_000
#: Pieces whose ids a worker keeps.
MAX_PIECES = 400_000
#: Pieces that are given to the library in one text.
GROUP = 256
#: White space as any of the libraries' expressions has it, for the regular expressions of Arrow.
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
UNSAFE = f"{SPACE} | {SPACE}"
SAFE_BLANK = re.compile(r"(?<=\S) (?=\S)")


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of every (start, size), one after another."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, number of ids of each part); a part is its ids as 32-bit values."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    return np.frombuffer(b"".join(parts), np.uint32), sizes


@lru_cache(maxsize=2)
def encoder(path: str, keeps_blanks: bool) -> "Encoder":
    """The encoder of this Python worker; its cache serves all tasks that the worker runs.

    ``clear()`` gives the cache's memory back.
    """
    return Encoder(path, keeps_blanks)


def byte_letters() -> dict[int, int]:
    """The byte-level form of every byte that is not its own, as the libraries print it."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in shown)}


#: Letters that no normaliser changes but for their case.
PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
BYTE_LETTERS = byte_letters()
#: Marks that may follow letters, and such pieces.
MARKS = ".,;:!?"
MARKED = r"^\pL+[.,;:!?]+$"


class Encoder:
    def __init__(self, path: str, keeps_blanks: bool) -> None:
        """``keeps_blanks``: the vocabulary has tokens with a leading blank (else it drops white space)."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one core
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.whole = (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)
        self.plain = (normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit())
        self.lead = " " if keeps_blanks else ""
        vocab = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocab.values()) + 1, bool)  # U+0120 is the byte-level form of a blank
        self.edge[[i for t, i in vocab.items() if (t.startswith("\u0120") if keeps_blanks else t.endswith("</w>"))]] = True
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([], pa.string())  # of pieces after a blank
        self.ids = np.zeros(0, np.uint32)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._add(pa.array([""]))

    def _encode(self, pieces: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _lines(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of pieces that the library sees apart in one text.

        With blanks kept, such a piece has no white space at its edges and no blank, so that only its
        first token starts with one; else it is letters, of which only the last token ends a word.  A
        group of pieces whose tokens do not show as many pieces is encoded piece by piece.
        """
        groups = [pieces[i : i + GROUP] for i in range(0, len(pieces), GROUP)]
        ids, sizes = [], []
        for group, line in zip(groups, self._encode([self.lead + " ".join(g) for g in groups])):
            found = np.frombuffer(line, np.uint32)
            edges = np.flatnonzero(self.edge[found])
            ends = np.append(edges[1:], len(found)) if self.lead else edges + 1
            if len(edges) != len(group) or (edges[0] if self.lead else len(found) - ends[-1]):
                found, counts = joined(self._encode([self.lead + p for p in group]))
            else:
                counts = np.diff(ends, prepend=0)
            ids.append(found)
            sizes.append(counts)
        return (np.concatenate(ids), np.concatenate(sizes)) if ids else joined([])

    def _plain_lines(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`_lines` of plain pieces, without normaliser and splitting."""
        pieces = [p.lower() if p.isascii() else p.lower().encode().decode("latin-1").translate(BYTE_LETTERS) for p in pieces]
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = self.plain
        try:
            return self._lines(pieces)
        finally:
            self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = self.whole

    def _marked(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of ASCII pieces without white space and "|", which stands apart between them."""
        mark = self._encode(["|"])[0]
        groups = [pieces[i : i + GROUP] for i in range(0, len(pieces), GROUP)]
        ids, sizes = [], []
        for group, line in zip(groups, self._encode([" | ".join([*g, ""]) for g in groups])):
            found = np.frombuffer(line, np.uint32)
            ends = np.flatnonzero(found == np.frombuffer(mark, np.uint32)[0])
            if len(ends) != len(group) or len(mark) != 4:
                found, counts = joined(self._encode(group))
            else:
                counts = np.diff(ends, prepend=-1) - 1
                found = np.delete(found, ends)
            ids.append(found)
            sizes.append(counts)
        return (np.concatenate(ids), np.concatenate(sizes)) if ids else joined([])

    def _add(self, fresh: pa.Array) -> np.ndarray:
        """Encode pieces that are not known yet; their numbers."""
        pieces = fresh.to_pylist()
        if self.lead:
            ways = [self._lines, self._each]
            way = [0 if p and " " not in p and p == p.strip() else 1 for p in pieces]
        else:
            ways = [self._plain_lines, self._lines, self._marked, self._each]
            way = [0 if PLAIN(p) else 1 if p.isalpha() else 2 if p and p.isascii() and "|" not in p and len(p.split()) == 1 else 3 for p in pieces]
        order = np.argsort(way, kind="stable")
        bounds = np.searchsorted(np.array(way)[order], np.arange(len(ways) + 1))
        found = [f([pieces[i] for i in order[a:b].tolist()]) for f, a, b in zip(ways, bounds, bounds[1:])]
        sizes = np.concatenate([f[1] for f in found])
        ids = np.concatenate([f[0] for f in found])
        numbers = np.empty(len(pieces), np.int64)
        numbers[order] = self._keep(fresh.take(pa.array(order)), ids, sizes)
        return numbers

    def _add_split(self, fresh: pa.Array) -> np.ndarray:
        """:meth:`_add`, with letters that marks follow put together from the letters' ids and the marks'.

        Where blanks are kept, the vocabulary's splitting parts letters and marks, and marks stand without a blank.
        """
        ends = pc.match_substring_regex(fresh, MARKED).to_numpy(zero_copy_only=False) if self.lead else np.zeros(len(fresh), bool)
        numbers = np.empty(len(fresh), np.int64)
        numbers[~ends] = self._add(fresh.filter(pa.array(~ends)))
        if not ends.any():
            return numbers
        pieces = fresh.filter(pa.array(ends))
        letters = pc.utf8_rtrim(pieces, MARKS)
        number = pc.index_in(letters, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        if (number < 0).any():
            new = letters.filter(pa.array(number < 0)).dictionary_encode()
            number[number < 0] = self._add(new.dictionary)[new.indices.to_numpy()]
        marks = pc.replace_substring_regex(pieces, r"^\pL+", "").dictionary_encode()
        tail, tail_sizes = joined(self._encode(marks.dictionary.to_pylist()))
        which = marks.indices.to_numpy()
        every = np.concatenate([self.ids, tail])
        starts = np.column_stack([self.starts[number], (len(self.ids) + np.cumsum(tail_sizes) - tail_sizes)[which]]).ravel()
        sizes = np.column_stack([self.sizes[number], tail_sizes[which]])
        numbers[ends] = self._keep(pieces, every[ragged(starts, sizes.ravel())], sizes.sum(axis=1))
        return numbers

    def _keep(self, pieces: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        numbers = len(self.sizes) + np.arange(len(pieces))
        self.known = pa.concat_arrays([self.known, pieces])
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, ids])
        return numbers

    def _each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return joined(self._encode([self.lead + p for p in pieces]))

    def _split(self, texts: pa.Array) -> pa.ListArray:
        """The pieces of every text; without leading blanks, the first one is empty."""
        if not self.lead:
            # such a vocabulary drops white space and lower-cases: blanks may stand before marks, and ASCII be lowered
            # first (not before combining marks, which are composed with letters before these are lowered)
            if not pc.any(pc.match_substring_regex(texts, r"\pM")).as_py():
                texts = pc.ascii_lower(texts)
            texts = pc.replace_substring_regex(texts, r"(\pL)([.,])([ \n])", r"\1 \2\3")
            return pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise("", texts, " "), "\n", " "), " ")
        parts = pc.split_pattern(texts, " ")
        unsafe = np.flatnonzero(pc.match_substring_regex(texts, UNSAFE).to_numpy(zero_copy_only=False))
        if not len(unsafe):
            return parts
        lists = np.arange(len(texts))
        lists[unsafe] = len(texts) + np.arange(len(unsafe))
        other = pa.array([SAFE_BLANK.split(t) for t in texts.take(pa.array(unsafe)).to_pylist()], parts.type)
        return pa.concat_arrays([parts, other]).take(pa.array(lists))

    def encode(self, texts: pa.Array, max_pieces: int = MAX_PIECES) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids before each text); nulls are empty texts."""
        if len(self.known) > max_pieces:
            self.clear()
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        parts = self._split(texts.cast(pa.string()).fill_null(""))
        counts = pc.list_value_length(parts).to_numpy().astype(np.int64)
        before = np.concatenate([[0], np.cumsum(counts)])
        coded = parts.flatten().dictionary_encode()
        words, places = coded.dictionary.cast(pa.string()), coded.indices.to_numpy()
        number = pc.index_in(words, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        fresh = np.flatnonzero(number < 0)
        if len(fresh):
            number[fresh] = self._add_split(words.take(pa.array(fresh)))
        which = number[places]
        firsts = before[:-1]
        sizes = self.sizes[which]
        sizes[firsts] = 0  # nothing stands before a first piece, so it is encoded by itself
        head, head_sizes = joined(self._encode(words.take(pa.array(places[firsts])).to_pylist()))
        starts = self.starts[which]
        starts[firsts], sizes[firsts] = len(self.ids) + np.cumsum(head_sizes) - head_sizes, head_sizes
        ids = np.concatenate([self.ids, head])[ragged(starts, sizes)]
        return ids, np.concatenate([[0], np.cumsum(sizes)])[before]
