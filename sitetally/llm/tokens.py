"""Token ids of a public tokenizer, with a bounded memory of words already encoded."""

from __future__ import annotations

import os
import re
import unicodedata
from array import array

import numpy as np

#: The tokenizer of the registered queries, a name in the installed package of public tokenizers.
TOKENIZER = "word_bpe_49k.json"
#: Id appended to each document.
END_ID = 1
#: Words kept by a worker, in two generations of this many.
WORD_MEMORY = 300_000


def tokenizer_file(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _classes() -> tuple[str, str, dict[int, str]]:
    """Regular-expression classes of letters and digits below U+0180, and the byte alphabet of byte-level BPE for them.

    The byte alphabet writes printable bytes as themselves and the others as characters from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    alphabet = {b: chr(b if b in plain else next(others)) for b in range(256)}
    chars = [chr(c) for c in range(0x21, 0x180)]
    letters = "".join(c for c in chars if unicodedata.category(c)[0] == "L")
    digits = "".join(c for c in chars if unicodedata.category(c)[0] == "N")
    return letters, digits, {ord(c): "".join(alphabet[b] for b in c.encode()) for c in chars}


_LETTERS, _DIGITS, _BYTES = _classes()
#: The splitter of the tokenizer, for text of these characters and the white space below.
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\\s{_LETTERS}{_DIGITS}]+")
#: Texts with other characters, a letter whose lower case is two, or a control string go through the tokenizer by white space.
_OTHER = re.compile("[^\t-\r -~\u00a1-\u012f\u0131-\u017f]|<\\|")


#: Latin-1 bytes of plain text: what _OTHER lets pass.
_PLAIN = bytes(c for c in range(256) if not _OTHER.search(chr(c)))


def _is_latin(text: str) -> bool:
    """Whether _OTHER finds nothing in text; most texts are told by their Latin-1 bytes."""
    if "<|" in text:
        return False
    try:
        return not text.encode("latin-1").translate(None, _PLAIN)
    except UnicodeEncodeError:
        return not _OTHER.search(text)


class _Words(dict):
    """Ids of words; one that isn't there is taken from the older generation or encoded."""

    def __init__(self, encode, code: str, old: dict):
        self.encode, self.code, self.old = encode, code, old

    def __missing__(self, word) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = array(self.code, self.encode(word)).tobytes()
        self[word] = ids
        return ids


class WordEncoder:
    """Encodes texts word by word: the ids of a text are those of its words in order.

    The tokenizer lower-cases, cuts a text into letters, single digits and runs of other signs, and encodes each by itself.
    Texts of Latin letters are cut in the same way here, and only words not met lately go to the tokenizer's model. Other
    texts are cut at white space, which no token crosses, and new pieces go through the whole tokenizer.
    """

    def __init__(self, path: str, memory: int = WORD_MEMORY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.memory, self.words = memory, _Words(self._ids, self.code, {})
        self.latin = self._cuts_latin()

    def _cuts_latin(self) -> bool:
        """Whether this tokenizer works as described, tried on a text that holds every such character."""
        probe = " ".join(chr(c) + "Aé1" + chr(c) for c in [*range(0x21, 0x7F), *range(0xA1, 0x130), *range(0x131, 0x180)]) + " it's WE'LL éa'd --x 12³"
        direct = [i for w in _SPLIT.findall(probe.lower()) for i in self._ids(w)]
        return direct == self.tokenizer.encode(probe, add_special_tokens=False).ids

    def _ids(self, word: str | bytes) -> list[int]:
        """Ids of a word as cut here (str), or of a piece between white space (bytes)."""
        if isinstance(word, bytes):
            return self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
        return [t.id for t in self.tokenizer.model.tokenize(word if word.isascii() else word.translate(_BYTES))]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian integers of self.dtype; an empty text has none."""
        out = []
        for data in texts:
            text = data.decode()
            words = _SPLIT.findall(text.lower()) if self.latin and _is_latin(text) else data.split()
            out.append(b"".join(map(self.words.__getitem__, words)))
            if len(self.words) > self.memory:
                self.words.old = {}  # else each generation would hold all before
                self.words = _Words(self._ids, self.code, self.words)
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file; it stays for later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
