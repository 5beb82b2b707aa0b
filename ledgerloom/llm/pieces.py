"""Token ids and token counts by public tokenizers.

Texts go to the tokenizer in batches of about equal bytes, long ones cut at
boundaries no token can cross. ``TokenCounter`` sends all texts that way. For
``WordEncoder``, texts of Latin characters are cut into the pieces that the
tokenizer itself would give its model; a Python worker sends every distinct
piece to the model once and remembers the result.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator


#: Bytes given to the whole tokenizer in one call.
BATCH_BYTES = 256 << 10
#: Pieces a worker remembers before it starts anew.
MEMORY = 400_000
#: Longer pieces are encoded but not remembered.
LONG_PIECE = 48

# In normal form C, lower-casing changes each character on its own, and white
# space is the same to Python and to the tokenizers.
_LATIN = re.compile(r"[\x00-\x1b\x20-įı-ſ]*")
# Letters and numbers among them.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ſ"
_NUMBERS = "0-9²³¹¼-¾"
# Letters of other scripts that all versions of Unicode know as such and no normal form changes.
_OLD_LETTERS = "A-Za-zα-ωА-яא-תء-غف-يअ-हก-ฮぁ-ゖァ-ヺ一-龥가-힣"
_SAFE = re.compile(rf"[{_OLD_LETTERS}](?= [{_OLD_LETTERS}])|[ぁ-ゖァ-ヺ一-龥](?=[、。，！？；：])")
# Characters that stand for bytes in the vocabularies: printable ones for
# themselves, all others for code points from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_NAMES = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(_PRINTABLE))}
_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a file, loaded once per Python worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(path)
        loaded.no_truncation()
        loaded.no_padding()
        _loaded[path] = loaded
    return _loaded[path]


def balanced(texts: Iterable[str], max_bytes: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Lists of texts with about equal bytes of UTF-8."""
    batch, size = [], 0
    for text in texts:
        batch.append(text)
        size += 16 + (len(text) if text.isascii() else len(text.encode()))
        if size >= max_bytes:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


def parts(text: str, max_chars: int) -> Iterator[str]:
    """Parts of about ``max_chars``, cut before a space between two letters or between a CJK letter and a stop.

    There a new token starts, whatever surrounds it: the space belongs to the
    word that follows or to none, a run of letters ends at a stop, and no
    special token holds either.
    """
    begin = 0
    while len(text) - begin > max_chars:
        found = _SAFE.search(text, begin + max_chars)
        if found is None:
            break
        cut = found.end()
        yield text[begin:cut]
        begin = cut
    yield text[begin:] if begin else text


def encoded(model, texts: Iterable[tuple[int, str]], part_chars: int) -> Iterator[tuple[int, list]]:
    """Numbers of texts with the encoding of each of their parts, in order."""
    held = [(k, part) for k, text in texts for part in parts(text, part_chars)]
    found = (
        e for batch in balanced(part for _, part in held) for e in model.encode_batch_fast(batch, add_special_tokens=False)
    )
    yield from zip((k for k, _ in held), found, strict=True)


class TokenCounter:
    """Number of tokens by any tokenizer file."""

    def __init__(self, path: str, part_chars: int = 1 << 16):
        self.tokenizer = tokenizer(path)
        self.part_chars = part_chars

    def count(self, texts: list[str]) -> list[int]:
        counts = [0] * len(texts)
        for k, e in encoded(self.tokenizer, enumerate(texts), self.part_chars):
            counts[k] += len(e)
        return counts


class _Memory(dict):
    """Results by piece, made when first asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str):
        made = self.make(piece)
        if len(piece) <= LONG_PIECE:
            self[piece] = made
        return made


def _words32(ids: Iterable[int]) -> bytes:
    return array("I", ids).tobytes()


class WordEncoder:
    """Ids, as little-endian 32-bit bytes, by a tokenizer that lower-cases and drops white space."""

    # The pieces that the tokenizer's own pattern keeps.
    _PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    _PIECE = re.compile(
        rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+"
    )

    def __init__(self, path: str, part_chars: int = 1 << 16):
        self.tokenizer = tokenizer(path)
        self.part_chars = part_chars
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        settings = json.loads(self.tokenizer.to_str())
        self.can_cut = settings["model"]["type"] == "BPE" and self._known_steps(settings)
        self.known = _Memory(self._piece)

    def _known_steps(self, settings: dict) -> bool:
        """Whether ``_PIECE`` stands for the steps before the model."""
        kinds = [n["type"] for n in (settings["normalizer"] or {}).get("normalizers", [])]
        steps = (settings["pre_tokenizer"] or {}).get("pretokenizers", [])
        if kinds != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"]:
            return False
        split, level = steps
        return (
            split["pattern"].get("Regex") == self._PATTERN
            and split["behavior"] == "Removed"
            and split["invert"]
            and not level["use_regex"]
            and not level["add_prefix_space"]
        )

    def _piece(self, piece: str) -> bytes:
        named = piece if piece.isascii() and piece.isalpha() else piece.encode().decode("latin-1").translate(_BYTE_NAMES)
        return _words32(token.id for token in self.tokenizer.model.tokenize(named))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > MEMORY:
            self.known = _Memory(self._piece)
        recall = self.known.__getitem__
        found: list = [None] * len(texts)
        others: list[tuple[int, str]] = []
        for k, text in enumerate(texts):
            if self.can_cut and _LATIN.fullmatch(text) and not any(s in text for s in self.specials):
                found[k] = list(map(recall, self._PIECE.findall(text.lower())))
            else:
                found[k] = []
                others.append((k, text))
        for k, e in encoded(self.tokenizer, others, self.part_chars):
            found[k].append(_words32(e.ids))
        return [b"".join(f) for f in found]
