"""Whole texts to token ids with the tokenizers library, word by word.

Both vocabularies split a text before they merge, and the split doesn't depend
on what stands before a cut between white space and other characters. So each
distinct word is encoded once and the ids are joined; the result equals encoding
the text at once, which the tests check.

Latin-1 texts are split as the file's pre-tokenizer would and the library's model
encodes each word. Other texts, whose letters depend on the Unicode version, are
cut at white space only and the whole library encodes each piece. Texts that
hold one of the file's added tokens, such as an end mark, go through the library
at once, which gives that token's own id.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from struct import pack

import numpy as np

#: Unicode White_Space as the library's regexes take it (Python's \s has more).
_SPACE = "\t-\r \x85\xa0  -     　"
_KEEP_SPACE = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+").findall
_DROP_SPACE = re.compile(f"[^{_SPACE}]+").findall
#: Fixed value: the pattern of byte-level BPE where the file asks for the library's own.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters, numbers and white space of Latin-1.
_LATIN = {kind: "".join(re.escape(chr(c)) for c in range(256) if test(chr(c))) for kind, test in (("L", str.isalpha), ("N", lambda c: c.isnumeric()), ("S", lambda c: c.isspace() and not "\x1c" <= c <= "\x1f"))}


def _byte_letters() -> dict[int, str]:
    """Byte to the letter that stands for it in byte-level vocabularies: printable
    Latin-1 stands for itself, the others take the code points from 256 on in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def _latin_pattern(pattern: str) -> str:
    """A pre-tokenizer's pattern with its Unicode classes spelled out for Latin-1 texts."""
    inside = re.sub(r"\[[^]]*\]", lambda m: m[0].replace(r"\s", _LATIN["S"]).replace(r"\p{L}", _LATIN["L"]).replace(r"\p{N}", _LATIN["N"]), pattern)
    return inside.replace(r"\p{L}", f"[{_LATIN['L']}]").replace(r"\p{N}", f"[{_LATIN['N']}]").replace(r"\s", f"[{_LATIN['S']}]").replace(r"\S", f"[^{_LATIN['S']}]")


class _Known(dict):
    """Ids of words, found when first asked for."""

    def __init__(self, find) -> None:
        super().__init__()
        self.find = find

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self.find(word)
        return ids


class Encoder:
    """encode(texts) gives the ids of each as little-endian unsigned 32-bit bytes.

    At most `remember` words are kept from one text to the next, so memory is
    bounded by that and by the distinct words of one text.
    """

    def __init__(self, path: str, remember: int = 700_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]
        self.remember = remember
        self.letters, self.tokenize = _byte_letters(), self.tokenizer.model.tokenize
        self.known, self.words = _Known(self._whole), _Known(self._word)
        self.pieces = _KEEP_SPACE if self._ids(" ") else _DROP_SPACE
        made = json.loads(self.tokenizer.to_str())
        forms = made["normalizer"] or {"normalizers": []}
        forms = [f["type"] for f in forms.get("normalizers", [forms])]
        self.lowers = "Lowercase" in forms
        self.split = self._splitter(made["pre_tokenizer"] or {}) if {*forms} <= {"NFC", "Replace", "Lowercase"} else None
        # A file made some other way may fit neither form of cutting; then texts are encoded at once.
        probe = "It's a1 b\n\nc  d,e \t x y\xa0 \n \xe9\xdf\xc9Z's 12ab!? don't\x1f \x85 \xbd\xb2x"
        self.cuts = b"".join(map(self._whole, self.pieces(probe + "é"))) == self._whole(probe + "é")
        if self.split and self._latin(probe) != self._whole(probe):
            self.split = None
        self.known.clear()
        self.words.clear()

    @staticmethod
    def _splitter(how: dict):
        parts = how.get("pretokenizers", [how])
        if [p.get("type") for p in parts] == ["ByteLevel"] and parts[0].get("use_regex") and not parts[0].get("add_prefix_space"):
            return re.compile(_latin_pattern(_BYTE_LEVEL)).findall
        if [p.get("type") for p in parts] == ["Split", "ByteLevel"] and parts[0].get("behavior") == "Removed" and parts[0].get("invert") and not parts[1].get("use_regex"):
            return re.compile(_latin_pattern(parts[0]["pattern"].get("Regex", ""))).findall
        return None

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _whole(self, text: str) -> bytes:
        return np.array(self._ids(text), "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        found = [t.id for t in self.tokenize(word.encode().decode("latin-1").translate(self.letters))]
        return pack(f"<{len(found)}I", *found)

    def _latin(self, text: str) -> bytes:
        """Of Latin-1 characters, all normal forms are the same but for case."""
        return b"".join(map(self.words.__getitem__, self.split(text.lower() if self.lowers else text)))

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.cuts:
            return [self._whole(t) for t in texts]
        out = []
        for text in texts:
            if any(map(text.__contains__, self.added)):
                out.append(self._whole(text))
            elif self.split and _is_latin(text):
                out.append(self._latin(text))
            else:
                out.append(b"".join(map(self.known.__getitem__, self.pieces(text))))
            for memo in (self.known, self.words):
                if len(memo) > self.remember:
                    memo.clear()
        return out


def _is_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker and vocabulary file."""
    return Encoder(path)
