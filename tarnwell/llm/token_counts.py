"""Token counts by a compiled finite-state transducer.

The byte-level BPE tokenizer is compiled, as far as the texts need it, into one deterministic machine. Two machines are
multiplied:

* the pre-tokenizer: eight control states (fresh, letters, numbers, other, white space with a pending character, and three
  for the contractions that begin at an apostrophe), which mark where a piece ends with one character of delay;
* BPE inside a piece: the encoding of a prefix ``p`` ends in exactly one token, and two neighbouring tokens are possible
  only if encoding their concatenation alone gives the two back. So the state after ``p`` need only hold, for each suffix
  of ``p`` that a longer token could begin with, that suffix, the token before it, and how many tokens fewer the shorter
  prefix has. There are finitely many such states; a transition is annotated with the tokens it emits (it may be negative,
  as a later byte can merge tokens emitted before).

States are made when first reached and thrown away together beyond ``max_states``, as in a lazy regular-expression
machine, so memory is bounded and counts do not depend on it.

A text longer than ``chunk_chars`` is cut into chunks. A chunk's state map is (head, count, exit): after an ASCII letter
followed by a space the machine is in one known state whatever it was in before, so only the head up to there depends on the
entry state; from there on the count and the exit state are fixed. Maps compose associatively, and an inclusive prefix scan
(log-depth doubling) over the chunks gives the count at the end of each. Inside a chunk, a word between two single spaces is
a round trip from that same known state, so its count is kept as one transition (for words of up to ``WORD_CHARS`` characters,
and up to ``max_words`` of them, so that texts without spaces cannot fill the memory).
"""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from tarnwell.llm.common import batch, id_and_text, map_arrow

SYNC = re.compile("[A-Za-z] ")
WORD_CHARS = 64
START, SPACE = ("F",), ("W", 0, " ")
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class CountTransducer:
    """Counts the tokens that a byte-level BPE ``tokenizers`` file gives for a text, special tokens in the text included."""

    def __init__(self, path: str, max_states: int = 150_000, max_words: int = 600_000, chunk_chars: int = 65_536):
        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_alphabet()
        raw = lambda s: bytes(to_byte[c] for c in s)
        special = {t["content"] for t in spec["added_tokens"]}
        self.special = re.compile("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.rank: dict[tuple[bytes, bytes], int] = {}
        self.made: dict[bytes, tuple[int, bytes, bytes]] = {}  # token: rank of its merge and the two parts
        for i, (a, b) in enumerate(pairs):
            a, b = raw(a), raw(b)
            self.rank[a, b] = i
            self.made.setdefault(a + b, (i, a, b))
        self.tokens = {raw(t) for t in spec["model"]["vocab"] if t not in special}
        self.prefixes = {t[:i] for t in self.tokens for i in range(1, len(t))}
        self.max_states, self.max_words, self.chunk_chars = max_states, max_words, chunk_chars
        self.classes: dict[str, str] = {}
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.words: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        """Forget the compiled states; they are made again when reached again."""
        self.bpe_states: list[tuple] = [((b"", None, 0),)]
        self.bpe_ids: dict[tuple, int] = {self.bpe_states[0]: 0}
        self.bpe_next: dict[int, tuple[int, int]] = {}
        self.product: dict[tuple[tuple, str], tuple[tuple, int]] = {}

    # -- the pre-tokenizer's classes, as the library itself has them ------------------------------------------------

    def kind(self, ch: str) -> str:
        """L letter, N number, W white space, O other: asked of the library's own pre-tokenizer, once for each character."""
        k = self.classes.get(ch)
        if k is None:
            one = lambda s: len(self.tok.pre_tokenizer.pre_tokenize_str(s)) == 1
            k = self.classes[ch] = "L" if one("a" + ch) else "N" if one("1" + ch) else "O" if one("!" + ch) else "W"
        return k

    # -- BPE inside a piece -----------------------------------------------------------------------------------------

    def adjacent(self, left: bytes | None, right: bytes) -> bool:
        """Whether the token ``right`` can follow the token ``left``.

        Undo the latest merge on either side of the border, again and again. The two tokens stand if no pair that comes to
        face the border would have merged across it before the merge undone last; on equal ranks the left pair goes first.
        """
        if len(self.fits) > 300_000:
            self.fits.clear()
        k, rank, made, limit = (left, right), self.rank, self.made, 1 << 60
        while True:
            if rank.get((left, right), 1 << 60) < limit:
                self.fits[k] = False
                return False
            a, b = made.get(left), made.get(right)
            if a is None and b is None:
                self.fits[k] = True
                return True
            if b is None or a is not None and a[0] > b[0]:
                limit, left = a[0], a[2]
            else:
                limit, right = b[0] + 1, b[1]

    def advance(self, state: int, text: str) -> tuple[int, int]:
        """The BPE state after the bytes of ``text``, and the tokens that they emit."""
        emitted, table = 0, self.bpe_next
        for byte in text.encode("utf-8", "surrogatepass"):
            hit = table.get(state << 8 | byte)
            if hit is None:
                hit = self.advance_byte(state, byte)
            state, d = hit
            emitted += d
        return state, emitted

    def advance_byte(self, state: int, byte: int) -> tuple[int, int]:
        """Compile one transition."""
        b, tokens, prefixes, fits = bytes((byte,)), self.tokens, self.prefixes, self.fits
        last, delta, grown = None, 0, []
        for u, left, d in self.bpe_states[state]:
            u += b
            if last is None and u in tokens:
                ok = left is None or fits.get((left, u))
                if ok is None:
                    ok = self.adjacent(left, u)
                if ok:
                    last, delta = u, d + 1
            if u in prefixes:
                grown.append((u, left, d))
        key = (*[(u, left, d - delta) for u, left, d in grown], (b"", last, 0))
        i = self.bpe_ids.get(key)
        if i is None:
            i = self.bpe_ids[key] = len(self.bpe_states)
            self.bpe_states.append(key)
        self.bpe_next[state << 8 | byte] = hit = i, delta
        return hit

    # -- the product ------------------------------------------------------------------------------------------------

    def begin(self, ch: str, space: bool = False) -> tuple[tuple, int]:
        """The state when a piece begins with ``ch``, or with a space and ``ch``."""
        kind = self.kind(ch)
        if kind == "W":
            return ("W", 0, ch), 0
        q, n = self.advance(0, " ") if space else (0, 0)
        q, m = self.advance(q, ch)
        return ("A" if ch == "'" and not space else kind, q), n + m

    def move(self, key: tuple, ch: str) -> tuple[tuple, int]:
        at = key[0]
        if at == "F":
            return self.begin(ch)
        if at == "W":
            _, q, last = key
            if self.kind(ch) == "W":
                q, n = self.advance(q, last)
                return ("W", q, ch), n
            if last == " ":
                return self.begin(ch, True)
            alone, (new, n) = self.advance(0, last)[1], self.begin(ch)
            return new, alone + n
        if at == "A":
            if ch in "stmd":
                return ("F",), self.advance(key[1], ch)[1]
            if ch in "rvl":
                return ("A" + ch, key[1]), 0
            at = "O"  # an apostrophe like any other mark
        elif at in ("Ar", "Av", "Al"):
            if ch == ("l" if at == "Al" else "e"):
                q, n = self.advance(key[1], at[1])
                return ("F",), n + self.advance(q, ch)[1]
            q, n = self.advance(0, at[1])
            new, m = self.move(("L", q), ch)
            return new, n + m
        if self.kind(ch) == at:
            q, n = self.advance(key[1], ch)
            return (at, q), n
        return self.begin(ch)

    def finish(self, key: tuple) -> int:
        """What the end of the text emits."""
        if key[0] == "W":
            return self.advance(key[1], key[2])[1]
        return self.advance(0, key[0][1])[1] if key[0] in ("Ar", "Av", "Al") else 0

    def run(self, key: tuple, text: str) -> tuple[int, tuple]:
        """Tokens emitted over ``text`` from the state ``key``, and the state reached."""
        total, product = 0, self.product
        for ch in text:
            hit = product.get((key, ch))
            if hit is None:
                if len(self.bpe_states) > self.max_states or len(product) > 2 * self.max_states:
                    key = self.portable(key)
                    self.reset()
                    key, product = self.enter(key), self.product
                hit = product[key, ch] = self.move(key, ch)
            key, n = hit
            total += n
        return total, key

    def run_words(self, text: str) -> tuple[int, tuple]:
        """As :meth:`run` from the state after a space, by transitions over whole words."""
        words = self.words
        parts = text.split(" ")
        last = parts.pop()
        total, key, get = 0, SPACE, words.get
        for w in parts:
            if key is SPACE:
                n = get(w)
                if n is None:
                    n, key = self.over_word(w)
            else:
                n, key = self.run(key, w + " ")
                if key == SPACE:
                    key = SPACE
            total += n
        n, key = self.run(key, last)
        return total + n, key

    def over_word(self, w: str) -> tuple[int, tuple]:
        """From the state after a space over ``w`` and a space; the transition is kept if it is a round trip."""
        if w.isascii() and w.isalpha():
            if len(self.bpe_states) > self.max_states:
                self.reset()
            n, key = self.advance(0, " " + w)[1], SPACE
        else:
            n, key = self.run(SPACE, w + " ")
        if key == SPACE:
            key = SPACE
            if len(w) <= WORD_CHARS:
                if len(self.words) >= self.max_words:
                    self.words.clear()
                self.words[w] = n
        return n, key

    # -- chunk maps -------------------------------------------------------------------------------------------------

    def chunk_map(self, chunk: str) -> tuple[str, int, tuple | None]:
        """(head, count after it, exit state); exit None: the whole chunk is head."""
        m = SYNC.search(chunk)
        if not m:
            return chunk, 0, None
        count, key = self.run_words(chunk[m.end() :])
        return chunk[: m.end()], count, self.portable(key)

    def portable(self, key: tuple) -> tuple:
        """A state that outlives :meth:`reset`."""
        return (key[0], self.bpe_states[key[1]], *key[2:]) if len(key) > 1 else key

    def enter(self, key: tuple) -> tuple:
        if len(key) > 1:
            i = self.bpe_ids.get(key[1])
            if i is None:
                i = self.bpe_ids[key[1]] = len(self.bpe_states)
                self.bpe_states.append(key[1])
            key = (key[0], i, *key[2:])
        return key

    def compose(self, a: tuple, b: tuple) -> tuple:
        """First ``a``, then ``b``; associative."""
        (head, n, at), (head2, n2, at2) = a, b
        if at is None:
            return head + head2, n2, at2
        m, key = self.run(self.enter(at), head2)
        return head, n + m + n2, at2 if at2 is not None else self.portable(key)

    def scan(self, maps: list[tuple]) -> list[tuple]:
        """Inclusive prefix scan by doubling."""
        step = 1
        while step < len(maps):
            maps = [self.compose(maps[i - step], m) if i >= step else m for i, m in enumerate(maps)]
            step *= 2
        return maps

    def count_plain(self, text: str) -> int:
        """Tokens of a text in which special tokens' strings do not occur.

        Between two single spaces the machine goes from its state after a space back to it, if what lies between ends in
        no white space; the tokens emitted over such a round trip are kept (up to ``max_words``), as a transition over a
        whole word.
        """
        if len(text) <= self.chunk_chars:
            head, n, at = self.chunk_map(text)
            m, key = self.run(START, head)
            return n + m + self.finish(key) if at is None else n + m + self.finish(self.enter(at))
        maps = [self.chunk_map(text[i : i + self.chunk_chars]) for i in range(0, len(text), self.chunk_chars)]
        head, n, at = self.scan(maps)[-1]
        m, key = self.run(START, head)
        return n + m + self.finish(key) if at is None else n + m + self.finish(self.enter(at))

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self.count_plain(text)
        parts = self.special.split(text)
        return sum(self.count_plain(p) for p in parts if p) + len(parts) - 1


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, n_bytes, n_tokens, over_limit) for each row of ``docs``, in one pass without a shuffle.

    A null text is the empty text (0 bytes, 0 tokens); a null id stays null; repeated rows give repeated results; other
    columns are ignored; an empty table gives an empty table. Texts are counted whole, however long.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = None
        for b in batches:
            if machine is None:
                machine = CountTransducer(tokenizer_path)
                gc.freeze()  # the tables are never garbage; the collector need not walk them
            n = [machine.count(t) for t in b.column(1).to_pylist()]
            yield batch(SCHEMA, [b.column(0), pc.cast(pc.binary_length(b.column(1)), pa.int64()), n, [x > limit for x in n]])

    return map_arrow(id_and_text(docs, id_col, text_col), count, SCHEMA)
