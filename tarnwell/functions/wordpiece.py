"""WordPiece: normalisation, splitting into words and marks, and greedy longest matches over any vocabulary."""

from __future__ import annotations

import unicodedata


def _is_cjk(c: int) -> bool:
    return 0x4E00 <= c <= 0x9FFF or 0x3400 <= c <= 0x4DBF or 0x20000 <= c <= 0x2CEAF or 0xF900 <= c <= 0xFAFF or 0x2F800 <= c <= 0x2FA1F


def _is_mark(ch: str) -> bool:
    c = ord(ch)
    return 33 <= c <= 47 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 126 or unicodedata.category(ch).startswith("P")


def normalise(text: str, lower: bool = True) -> str:
    """Control characters go, white space becomes blanks, Chinese characters stand alone, accents go with lower-casing."""
    out = []
    for ch in text:
        c = ord(ch)
        if c in (0, 0xFFFD) or (unicodedata.category(ch) in ("Cc", "Cf", "Cn", "Co") and ch not in "\t\n\r"):
            continue
        out.append(" " if ch.isspace() else f" {ch} " if _is_cjk(c) else ch)
    text = "".join(out)
    if lower:
        text = "".join(ch for ch in unicodedata.normalize("NFD", text) if unicodedata.category(ch) != "Mn").lower()
    return text


def words(text: str) -> list[str]:
    """Runs between blanks, every mark alone."""
    out, run = [], []
    for ch in text:
        if ch == " " or _is_mark(ch):
            if run:
                out.append("".join(run))
                run = []
            if ch != " ":
                out.append(ch)
        else:
            run.append(ch)
    return [*out, "".join(run)] if run else out


class WordPiece:
    """``vocab``: piece to id; ``unk`` stands for a word that no pieces make or that has over ``longest`` characters."""

    def __init__(self, vocab: dict[str, int], unk: str = "[UNK]", lower: bool = True, longest: int = 100, prefix: str = "##"):
        self.vocab, self.unk, self.lower, self.longest, self.prefix = vocab, vocab[unk], lower, longest, prefix
        self.most = max(map(len, vocab), default=1)

    def word(self, w: str) -> list[int]:
        if len(w) > self.longest:
            return [self.unk]
        out, at = [], 0
        while at < len(w):
            head = self.prefix if at else ""
            for end in range(min(len(w), at + self.most), at, -1):
                i = self.vocab.get(head + w[at:end])
                if i is not None:
                    out.append(i)
                    at = end
                    break
            else:
                return [self.unk]
        return out

    def encode(self, text: str) -> list[int]:
        return [i for w in words(normalise(text, self.lower)) for i in self.word(w)]
