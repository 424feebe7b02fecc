"""Token ids of whole texts by a public tokenizer file, with each distinct piece encoded once a worker."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from wardlight.llm.common import ragged, row_sums, words_of

#: Fixed: how the tokenizer file word_bpe_49k.json cuts a lower-cased text into pieces.
#: Letters between these and white space are pieces too.
PLAIN_PIECES = r"('s|'t|'re|'ve|'m|'ll|'d|[\p{N}]|[^\x09-\x0D\x20\p{L}\p{N}]+)"
#: A character outside printable ASCII, white space and the composed letters and signs from U+00A1 to U+024F.
ODD = "[^\x09-\x0d\x20-\x7e\u00a1-\u012f\u0131-\u024f]"
_WORKERS: dict[str, Encoder] = {}


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return {b: chr(b if b in shown else next(hidden)) for b in range(256)}


class Encoder:
    """Ids of texts, the same as the tokenizer gives for the whole text.

    White space never reaches a piece, so a text's ids are those of its words joined. Texts in letters up to U+024F,
    which are composed already, are lower-cased and cut into pieces column-wise, and each distinct piece goes to the
    vocabulary's merges once; the distinct words of any other text go to the tokenizer as they are. What has been seen
    is kept for the worker's next batch, up to `most` entries, and then begun anew.
    """

    def __init__(self, path: str, most: int = 400_000):
        import os

        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.clear()

    @classmethod
    def get(cls, path: str) -> Encoder:
        if path not in _WORKERS:
            _WORKERS[path] = cls(path)
        return _WORKERS[path]

    def clear(self) -> None:
        self.seen: dict[str, int] = {}
        self.seen_pieces: dict[str, int] = {}
        self.made = 0
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.sizes = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64)

    def piece(self, piece: str) -> list[int]:
        text = piece if piece.isascii() else "".join(self.letters[b] for b in piece.encode())
        return [t.id for t in self.model.tokenize(text)]

    def word(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def numbers(self, words: list[str], pieces: bool) -> np.ndarray:
        """Places of the words, or pieces, in starts and sizes."""
        if self.made + len(words) > self.most and self.made:
            self.clear()
        seen, ids_of = (self.seen_pieces, self.piece) if pieces else (self.seen, self.word)
        out = np.fromiter((seen.get(w, -1) for w in words), np.int64, len(words))
        fresh = np.flatnonzero(out < 0).tolist()
        got, sizes, first = [], [], self.made
        for i in fresh:
            ids = ids_of(words[i])
            got += ids
            sizes.append(len(ids))
            seen[words[i]] = self.made
            self.made += 1
        if fresh:
            n, m = len(got), self.made
            if self.used + n > len(self.ids):
                self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(n, self.used) + n, np.uint32)])
            if m > len(self.sizes):
                self.starts, self.sizes = (np.concatenate([x[:first], np.zeros(2 * m - first, np.int64)]) for x in (self.starts, self.sizes))
            sizes = np.array(sizes, np.int64)
            self.ids[self.used : self.used + n] = got
            self.sizes[first:m], self.starts[first:m] = sizes, self.used + np.cumsum(sizes) - sizes
            self.used += n
            out[fresh] = np.arange(first, m)
        return out

    def ragged_ids(self, texts: pa.Array, table: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word of the texts its first id and number of ids, and the texts' offsets in the words."""
        words, distinct, offsets = words_of(texts)
        places = self.numbers(distinct.to_pylist(), table == "pieces")
        return self.starts[places][words], self.sizes[places][words], offsets

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end_id after each, one text after the other, and the texts' offsets in them."""
        texts = pc.fill_null(texts, "")
        odd = pc.or_(pc.match_substring_regex(texts, ODD), pc.match_substring(texts, "<|"))
        if pc.any(odd).as_py():
            at, sizes, offsets = self.ragged_ids(pc.if_else(odd, texts, ""), "words")
            strange = self._ids(at, sizes, offsets, end_id)
            rest = self.encode(pc.if_else(odd, "", texts), end_id)
            which = odd.to_numpy(zero_copy_only=False)
            lengths = np.where(which, np.diff(strange[1]), np.diff(rest[1]))
            out = np.empty(int(lengths.sum()), np.uint32)
            begin = np.cumsum(lengths) - lengths
            for own, (ids, off) in ((which, strange), (~which, rest)):
                out[ragged(begin[own], lengths[own])] = ids[ragged(off[:-1][own], lengths[own])]
            return out, np.concatenate([[0], np.cumsum(lengths)])
        apart = pc.replace_substring_regex(pc.utf8_lower(texts), PLAIN_PIECES, r" \1 ")
        return self._ids(*self.ragged_ids(apart, "pieces"), end_id)

    def _ids(self, at: np.ndarray, sizes: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        lengths = row_sums(sizes, offsets) + 1
        ends = np.cumsum(lengths)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        body = np.ones(len(out), bool)
        body[ends - 1] = False
        out[ends - 1] = end_id
        out[body] = self.ids[ragged(at, sizes)]
        return out, np.concatenate([[0], ends])
