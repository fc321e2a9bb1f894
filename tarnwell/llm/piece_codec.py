"""SentencePiece encoding and decoding by an Aho-Corasick automaton and a single-pass Viterbi.

The automaton over all pieces reads a word once; at each position the pieces that end there (the node's and its output
links') relax the best score of that position from the best score where each piece begins. A step's score is the piece's own;
for a BPE model, which the given 32,000-piece file is, a step also pays ``CLASH`` if its piece cannot stand next to the last
piece of the path it extends, that is, if merging the two pieces' characters by rank does not give the two back. A path without
a clash is what merging gives for that beginning of the word, and there is exactly one for each beginning; as a clash costs
more than any word's pieces, the best path is the library's encoding. For a unigram model there are no clashes. Characters
without a piece become their UTF-8 bytes' pieces.

No piece has a space mark after another character, so a text falls into words that are encoded one by one; the ids of words of
up to ``WORD_CHARS`` characters are kept (up to ``max_words``).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from tarnwell.llm.common import batch, id_and_text, map_arrow

MARK = "▁"
NEVER = float("-inf")
CLASH = 1e12  # beyond the sum of any word's scores
WORD_CHARS = 48
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class PieceCodec:
    """Encodes and decodes by the pieces of a SentencePiece ``.model`` file whose normaliser only marks spaces."""

    def __init__(self, path: str, kind: str = "bpe", max_words: int = 600_000):
        if kind not in ("bpe", "unigram"):
            raise ValueError("kind must be bpe or unigram")
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.kind, self.max_words = kind, max_words
        self.pieces = [sp.id_to_piece(i) for i in range(len(sp))]
        self.unk = sp.unk_id()
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.values = {i: v for v, i in self.bytes.items()}
        self.silent = {i for i in range(len(sp)) if sp.is_control(i)}
        plain = [i for i in range(len(sp)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unused(i) or i == self.unk)]
        self.ids = {self.pieces[i]: i for i in plain}
        self.score = {self.pieces[i]: sp.get_score(i) for i in plain}
        self.characters = {p for p in self.ids if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.beside: dict[tuple[str, str], bool] = {}
        self.trees: dict[str, tuple[float, str, str] | None | bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def merge(self, word: str) -> tuple[list[str], tuple[float, str, str] | None]:
        """BPE by score, the best adjacent pair first, the leftmost of equals; and the last merge (its rank, the two parts)."""
        parts, last = list(word), None
        score = self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            last = (-best, parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, last

    def tree(self, piece: str) -> tuple[float, str, str] | None | bool:
        """The last merge that makes a piece of its characters; None for one character, False if merging does not make it."""
        v = self.trees.get(piece, self)
        if v is self:
            parts, last = self.merge(piece)
            v = self.trees[piece] = last if parts == [piece] else False
        return v

    def stands(self, left: str, right: str) -> bool:
        """Whether merging ``left`` and ``right`` as one run of characters gives the two back: the latest merge on either side
        of the border is undone, again and again; no pair that comes to face the border may have merged before it. An empty
        ``left`` is the beginning of the word."""
        k = (left, right)
        v = self.beside.get(k)
        if v is None:
            if len(self.beside) > 600_000:
                self.beside.clear()
            v = self.beside[k] = self._stands(left, right)
        return v

    def _stands(self, left: str, right: str) -> bool:
        if self.tree(right) is False:  # merging never makes this piece
            return False
        if not left:
            return True
        if MARK * 2 in left + right:  # pieces of marks alone have equal scores: merge them in full
            return self.merge(left + right)[0] == [left, right]
        score, tree, limit = self.score, self.tree, float("inf")
        while True:
            s = score.get(left + right)
            if s is not None and -s < limit:
                return False
            a, b = tree(left), tree(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and a[0] > b[0]:
                limit, left = a[0], a[2]
            else:
                limit, right = b[0] + 0.5, b[1]

    def viterbi(self, word: str) -> list[str]:
        """The best path over characters that all have pieces."""
        n = len(word)
        best = [0.0] + [NEVER] * n
        last = [""] * (n + 1)
        bpe, score, beside = self.kind == "bpe", self.score, self.beside
        for end, p in self.automaton.iter(word):
            end += 1
            at = end - len(p)
            s = best[at] + score[p]
            if s <= best[end]:
                continue
            if bpe:
                before = last[at]
                ok = beside.get((before, p))
                if not (self.stands(before, p) if ok is None else ok):
                    s -= CLASH
                    if s <= best[end]:
                        continue
            best[end], last[end] = s, p
        out = []
        while n:
            out.append(last[n])
            n -= len(last[n])
        return out[::-1]

    def encode_word(self, word: str) -> tuple[int, ...]:
        ids = self.ids
        if self.characters.issuperset(word):
            out = [ids[p] for p in self.viterbi(word)]
        else:
            out, run = [], ""
            for ch in [*word, None]:
                if ch is not None and ch in self.characters:
                    run += ch
                    continue
                if run:
                    out += [ids[p] for p in self.viterbi(run)]
                    run = ""
                if ch is not None:
                    out += [self.bytes[b] for b in ch.encode()] if self.bytes else [self.unk]
        made = tuple(out)
        if len(word) <= WORD_CHARS:
            if len(self.words) >= self.max_words:
                self.words.clear()
            self.words[word] = made
        return made

    def encode(self, text: str) -> list[int]:
        """Ids of a text, with the mark that stands for the space before it; no ids for the empty text."""
        if not text:
            return []
        out: list[int] = []
        get, make = self.words.get, self.encode_word
        for w in WORD.findall(MARK + text.replace(" ", MARK)):
            out += get(w) or make(w)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, unknown pieces become U+2047 between spaces."""
        out, raw = [], bytearray()

        def flush() -> None:
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()

        for i in ids:
            v = self.values.get(i)
            if v is not None:
                raw.append(v)
                continue
            flush()
            if i == self.unk:
                out.append(" ⁇ ")
            elif i not in self.silent:
                out.append(self.pieces[i])
        flush()
        text = "".join(out)
        return text.removeprefix(MARK).replace(MARK, " ")


SCHEMA = "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, decoded_bytes long, round_trip boolean"


def encode_decode(docs: DataFrame, model_path: str, kind: str = "bpe", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: number of pieces, those from byte fallback, crc32 of the ids (little-endian, unsigned
    32-bit), length of the decoded text in UTF-8 and whether it is the text again.

    Texts are encoded whole, in one pass without a shuffle. A null text is the empty text: no pieces, round trip true. A text
    that holds the space mark U+2581 itself decodes to spaces there, so its round trip is false. Null ids stay null; repeated
    rows give repeated results; other columns are ignored; an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for b in batches:
            codec = codec or PieceCodec(model_path, kind)
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = codec.encode(t)
                back = codec.decode(ids)
                fallback = sum(map(codec.values.__contains__, ids))
                rows.append((i, len(ids), fallback, zlib.crc32(np.array(ids, "<u4").tobytes()), len(back.encode()), back == t))
            if rows:
                yield batch(SCHEMA, list(zip(*rows, strict=True)))

    return map_arrow(id_and_text(docs, id_col, text_col), run, SCHEMA)
