"""Byte-pair encoding of whole words by backtracking over longest matches.

The vocabulary file is a public ``tokenizers`` JSON of the word-end kind: every word is a string of
bytes whose last byte carries an end mark, and merges have the order of their token numbers.

Encoding a word: an Aho-Corasick automaton over all tokens gives the longest token that starts at each
place. Tokens are taken from the left; two neighbours may stand together only if merging their joined
bytes would have left a boundary between them (``compatible``, memoised as a pair table). If a token
does not fit, the next shorter token is tried, and where none is left, the place is marked dead and the
last token is taken back. Each place dies at most once, so a word takes linear time, and the result is
exactly that of applying the merges in order of rank.

Decoding: token strings lie end to end in one byte blob; an offset table gives each token's span.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata

import ahocorasick
import numpy as np

WHITE_SPACE = "\t-\r \u0085   -     　"
WORD_END = "</w>"
#: Words longer than this are encoded each time, and the memo is emptied at this many words.
MEMO_WORD, MEMO_WORDS = 48, 500_000
NEVER = 1 << 60


def _ranges(major: str) -> str:
    """A character class body of all characters whose general category begins with `major`."""
    flags = "".join("x" if unicodedata.category(chr(c))[0] == major else " " for c in range(sys.maxunicode + 1))
    return "".join(f"\\U{m.start():08x}-\\U{m.end() - 1:08x}" for m in re.finditer("x+", flags))


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


class _Memo(dict):
    """Word -> packed token numbers; long words are not kept."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        packed = np.array(self.encode(word), "<u4").tobytes()
        if len(word) <= MEMO_WORD:
            self[word] = packed
        return packed


class WordBpe:
    def __init__(self, spec: str):
        """spec: the text of the vocabulary file."""
        spec = json.loads(spec)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != WORD_END:
            raise ValueError("not a BPE vocabulary with word ends")
        letters = byte_letters()
        # inner alphabet: one character for each byte, and another for each byte that ends a word
        inner = [chr(b) for b in range(256)]
        self._last = [chr(0x100 + b) for b in range(256)]
        n = max(max(vocab.values()), *(t["id"] for t in spec["added_tokens"])) + 1
        spell, shown = [""] * n, [""] * n
        for b in range(256):
            for word, char in ((letters[b], inner[b]), (letters[b] + WORD_END, self._last[b])):
                spell[vocab[word]] = char
        self.split: list[tuple[int, int] | None] = [None] * n
        self.merge: dict[tuple[int, int], int] = {}
        before = -1
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            if whole <= before or whole <= max(left, right) or (left, right) in self.merge:
                raise ValueError("token numbers don't follow the order of merges")
            before = whole
            self.split[whole], self.merge[left, right] = (left, right), whole
            spell[whole] = spell[left] + spell[right]
        for word, i in vocab.items():
            shown[i] = word
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for word, i in self.special.items():
            shown[i] = word
        number = {s: i for i, s in enumerate(spell) if s}
        self.length = [len(s) for s in spell]
        #: The longest token that is a proper beginning of each token, or -1.
        self.shorter = [next((number[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in number), -1) for s in spell]
        self._automaton = ahocorasick.Automaton()
        for s, i in number.items():
            self._automaton.add_word(s, i)
        self._automaton.make_automaton()
        self._pairs: dict[int, bool] = {}
        self._memo = _Memo(self.encode_word)
        self._specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        letter, digit = _ranges("L"), _ranges("N")
        self._words = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{letter}]+|[{digit}]|[^{WHITE_SPACE}{letter}{digit}]+")
        self._ascii = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
        # decoding: tokens are joined by a space, so each span ends in one
        spans = [(s + " ").encode() for s in shown]
        self.blob = np.frombuffer(b"".join(spans), np.uint8)
        self.offset = np.zeros(n + 1, np.int64)
        np.cumsum([len(s) for s in spans], out=self.offset[1:])

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of both leaves exactly these two tokens.

        Undoes merges from the latest to the earliest. At each moment x ends the left token and y begins
        the right one; had a merge of x and y come before either was merged elsewhere, the boundary
        would have gone. Of equal merges, the one further left comes first.
        """
        key = left << 32 | right
        if (known := self._pairs.get(key)) is not None:
            return known
        x, y, x_until, y_until, good = left, right, NEVER, NEVER, True
        split, merge = self.split, self.merge
        while True:
            joined = merge.get((x, y), NEVER)
            if joined < x_until and joined <= y_until:
                good = False
                break
            if x > y:
                if (parts := split[x]) is None:
                    break
                x_until, x = x, parts[1]
            else:
                if (parts := split[y]) is None:
                    break
                y_until, y = y, parts[0]
        if len(self._pairs) > 2_000_000:
            self._pairs.clear()
        self._pairs[key] = good
        return good

    def encode_word(self, word: str) -> list[int]:
        """Token numbers of one word of the normalised text."""
        data = word.encode("utf-8", "surrogatepass")
        n = len(data)
        text = data[:-1].decode("latin-1") + self._last[data[-1]]
        length = self.length
        longest = [-1] * n
        for end, token in self._automaton.iter(text):
            longest[end + 1 - length[token]] = token  # ends ascend, so the longest stays
        token = longest[0]
        if length[token] == n and self.whole(token):
            return [token]
        alive = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        place, pairs, shorter = 0, self._pairs, self.shorter
        while True:
            end = place + length[token]
            if alive[end]:
                good = not out or ((known := pairs.get(out[-1] << 32 | token)) is None and self.compatible(out[-1], token)) or known
                if good:
                    out.append(token)
                    place = end
                    if place == n:
                        return out
                    token = longest[place]
                    continue
            token = shorter[token]
            if token < 0:
                alive[place] = 0
                token = out.pop()
                place -= length[token]

    def whole(self, token: int) -> bool:
        """Whether merging a token's own bytes gives that token: its two parts must have been left apart until then."""
        return True if self.split[token] is None else self._whole(token)

    def _whole(self, token: int) -> bool:
        key = -1 - token
        if (known := self._pairs.get(key)) is None:
            known = self._pairs[key] = self._merged(token)
        return known

    def _merged(self, token: int) -> bool:
        def apart(x: int, y: int, until: int) -> bool:
            """No merge across the boundary of x and y before `until`."""
            x_until, y_until, split = until, until, self.split
            while True:
                joined = self.merge.get((x, y), NEVER)
                if joined < x_until and joined <= y_until and joined != until:
                    return False
                if x > y:
                    if (parts := split[x]) is None:
                        return True
                    x_until, x = x, parts[1]
                else:
                    if (parts := split[y]) is None:
                        return True
                    y_until, y = y, parts[0]

        left, right = self.split[token]
        return self.whole(left) and self.whole(right) and apart(left, right, token)

    def words(self, text: str) -> list[str]:
        """Words of a stretch of text without special strings, normalised."""
        if text.isascii():
            return self._ascii.findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # a capital sigma is lowered by itself, whatever stands around it
            text = text.replace("Σ", "σ")
        return self._words.findall(text.lower())

    def encode_packed(self, text: str | None) -> bytes:
        """Token numbers as little-endian unsigned 32-bit integers; null counts as empty."""
        if not text:
            return b""
        memo = self._memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        if "<|" not in text or len(parts := self._specials.split(text)) == 1:
            return b"".join(map(memo.__getitem__, self.words(text)))
        out = []
        for k, part in enumerate(parts):
            out += [self.special[part].to_bytes(4, "little")] if k % 2 else map(memo.__getitem__, self.words(part))
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode_packed(self, packed: bytes | None) -> str:
        """The tokens' strings, joined by a space."""
        ids = np.frombuffer(packed or b"", "<u4")
        if not len(ids):
            return ""
        out, step = [], 1 << 20
        for k in range(0, len(ids), step):  # so that a very long document needs little memory at once
            part = ids[k : k + step]
            start = self.offset[part]
            size = self.offset[part + 1] - start
            place = np.cumsum(size)
            at = np.repeat(start - (place - size), size) + np.arange(place[-1])
            out.append(self.blob[at].tobytes())
        return b"".join(out)[:-1].decode()

    def decode(self, ids) -> str:
        return self.decode_packed(np.array(list(ids), "<u4").tobytes())


_models: dict[int, tuple[str, WordBpe]] = {}


def model(spec: str) -> WordBpe:
    """The encoder of a vocabulary file's text, built once in each Python worker."""
    key = hash(spec)
    if key not in _models:
        _models.clear()
        _models[key] = (spec, WordBpe(spec))
    return _models[key][1]
