"""Token ids of whole texts by a public tokenizer file, with a cache of white-space chunks.

The tokenizer drops white space and never joins ids across it, so a text's ids are those of
its chunks in order.  Chunks are cut at ASCII white space only.  A chunk that is letters or
digits followed by ASCII punctuation is two independent parts.  A worker encodes each
distinct part once and keeps it while there is room.  A part of Latin letters only is one
pre-token whatever surrounds it, so it goes to the tokenizer's model directly.
"""

from __future__ import annotations

import os
import re

from proofgrain.llm.common import kept

CHUNKS_KEPT, PARTS_KEPT = 500_000, 900_000
#: Up to here, letters are composed, and their lower case does not depend on the text around.
_LATIN_END, _DOTTED_I = "\u0250", "\u0130"
_PARTS = re.compile(r"([^\W_]+)([!-&(-/:-@\[-`{-~]+)")


def byte_letters() -> str:
    """The printable letter that stands for each byte in a byte-level vocabulary: printable
    Latin-1 characters stand for themselves, the others follow from U+0100 on in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return "".join(chr(b if b in own else next(rest)) for b in range(256))


class Parts(dict):
    """Little-endian unsigned 32-bit ids by part."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]

    def __missing__(self, part: str) -> bytes:
        if part.isalpha() and max(part) < _LATIN_END and _DOTTED_I not in part:
            ids = [t.id for t in self.model.tokenize(part.lower().encode("utf-8").decode("latin-1").translate(self.letters))]
        else:
            ids = self.tokenizer.encode(part, add_special_tokens=False).ids
        found = b"".join([self.id_bytes[i] for i in ids])
        if len(self) < PARTS_KEPT:
            self[part] = found
        return found


class Chunks(dict):
    """The same by white-space chunk, as UTF-8."""

    def __init__(self, path: str):
        self.parts = Parts(path)

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8")
        cut = None if "<|" in text else _PARTS.fullmatch(text)
        found = self.parts[cut[1]] + self.parts[cut[2]] if cut else self.parts[text]
        if len(self) < CHUNKS_KEPT:
            self[chunk] = found
        return found


def encode(path: str, texts: list[bytes], end_id: int) -> list[bytes]:
    """The ids of each text and ``end_id``, as little-endian unsigned 32-bit integers."""
    get = kept("chunks_" + re.sub(r"\W", "_", path), lambda: Chunks(path)).__getitem__
    end = end_id.to_bytes(4, "little")
    # lower case is what the tokenizer makes of ASCII letters; marked specials keep theirs
    return [b"".join(map(get, (t if b"<|" in t else t.lower()).split())) + end for t in texts]
