"""Token ids of whole texts for a byte-level BPE vocabulary in the tokenizers library's JSON form.

Texts of ASCII and Latin letters go to tiktoken, which is several times faster on one core and is built here from the
same vocabulary; there, both libraries cut and merge alike. All other texts go to the tokenizers library itself,
since the two may know different Unicode versions. Long texts are cut in front of a space that a visible character
follows: a pre-token starts there, so no merge crosses the cut and memory is bounded by the segment size. A text
without such a place is one segment, whatever its length; runs of blanks too long for tiktoken go to the library.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np

#: Fixed value: the pre-token pattern of this family of vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SAFE = re.compile(" (?=[!-~À-ɏ])")
_OTHER = re.compile("[^\x00-\x7e\xa1-ɏ]")
SEGMENT = 1 << 20


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """The text in pieces of about `size` characters that can be encoded one by one."""
    start = 0
    while len(text) - start > size and (cut := _SAFE.search(text, start + size)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in such vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class TextEncoder:
    """Ids as unsigned 32-bit integers. literal_specials: the spelling of a special token is ordinary text."""

    def __init__(self, path: str, literal_specials: bool = False):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = literal_specials
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        as_byte = byte_characters()
        ranks = {bytes(as_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in specials}
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=specials)
        self.allowed = set() if literal_specials else set(specials)

    def _by_library(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def encode(self, text: str) -> np.ndarray:
        made = []
        for part in segments(text):
            if _OTHER.search(part):
                made.append(self._by_library(part))
                continue
            try:
                made.append(self.fast.encode_to_numpy(part, allowed_special=self.allowed, disallowed_special=()).astype("<u4", copy=False))
            except ValueError:  # a run of blanks too long for its pattern engine
                made.append(self._by_library(part))
        return made[0] if len(made) == 1 else np.concatenate(made)


_ENCODERS: dict[tuple[str, bool], TextEncoder] = {}


def text_encoder(path: str, literal_specials: bool = False) -> TextEncoder:
    """The worker's encoder for a vocabulary file; it lives as long as the worker process."""
    key = (path, literal_specials)
    if key not in _ENCODERS:
        _ENCODERS[key] = TextEncoder(path, literal_specials)
    return _ENCODERS[key]
