"""Byte-level pre-tokens: parts of a text that a tokenizer file encodes independently.

The pre-tokenizer's pattern always ends a token before the last space of a run that visible
text follows, and around a line break between visible characters. Encoding the parts between
these places alone gives the ids of the whole text, so each distinct part is encoded once.
Special strings hold no such place, so they stay whole.
"""

from __future__ import annotations

import json
import os
import re
import string
import sys
from array import array
from functools import lru_cache
from operator import attrgetter

_SPACES = re.compile(r"(?= \S)")
# Signs that count as white space, beside the space and the line break.
_OTHER_SPACES = [chr(code) for code in range(sys.maxunicode + 1) if chr(code).isspace() and chr(code) not in " \n"]
# Signs that make pre-tokens of their own behind a word; an apostrophe may begin a contraction.
_ENDS = "".join(sign for sign in string.punctuation if sign != "'")
# One word of Latin letters, with what may stand around it: three pre-tokens at most.
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_PLAIN = re.compile(f"([ \\n]?)([{_LATIN}]+)([.,;:!?]?)")


def _byte_signs() -> list[str]:
    """The character that stands for each byte: itself if it is visible, else one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(byte if byte in visible else next(others)) for byte in range(256)]


_SIGNS = _byte_signs()
_ID = attrgetter("id")


def _payload(ids) -> bytes:
    made = array("I", ids)
    if sys.byteorder != "little":
        made.byteswap()
    return made.tobytes()


def cut(text: str) -> list[str]:
    """The parts of a text; a part's first character tells how it is encoded.

    A space before a part is left out and stands for itself: a part that begins the text
    without one is marked by a leading tab instead. A line break stays.
    """
    if (
        "  " in text or "\n\n" in text or " \n" in text or "\n " in text
        or text[:1] in (" ", "\n", "\t") or text[-1:] in (" ", "\n") or any(space in text for space in _OTHER_SPACES)
    ):
        return [part[1:] if part[0] == " " and part[1:2] not in ("\t", "\n") else "\t" + part
                for part in _SPACES.split(text) if part]
    if not text:
        return []
    parts = text.replace("\n", " \n").split(" ")
    parts[0] = "\t" + parts[0]
    return parts


def part_text(part: str) -> str:
    """What a part from ``cut`` stands for in the text."""
    first = part[:1]
    return part[1:] if first == "\t" else part if first == "\n" else " " + part


class Encoder:
    """Ids of parts, by the library; a lone word skips the steps before the model."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        stage = made.get("pre_tokenizer") or {}
        if made.get("normalizer") or {key: stage.get(key) for key in plain} != plain:
            raise ValueError(f"{path} does not split texts at bytes only")
        special = made["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["normalized"] or re.search(r"\s", t["content"]) for t in special):
            raise ValueError(f"{path} has special tokens that reach beyond themselves")
        if made.get("truncation") or made.get("padding"):
            raise ValueError(f"{path} truncates or pads")
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.signs: dict[str, list[int]] = {}
        # An added token that is a word, signs, or a word with signs behind it would have to be found inside such parts.
        inside = re.compile(f"[{_LATIN}]*[{re.escape(_ENDS)}]*")
        self.direct = not any(inside.fullmatch(t["content"]) for t in special)

    def _model_ids(self, text: str) -> list[int]:
        if text.isascii():
            mapped = "Ġ" + text[1:] if text[0] == " " else text
        else:
            mapped = "".join([_SIGNS[byte] for byte in text.encode()])
        return list(map(_ID, self.model.tokenize(mapped)))

    def _sign(self, sign: str) -> list[int]:
        if sign not in self.signs:
            self.signs[sign] = self.tokenizer.encode(sign, add_special_tokens=False).ids
        return self.signs[sign]

    def ids(self, part: str) -> list[int]:
        text = part_text(part)
        plain = _PLAIN.fullmatch(text) if self.direct else None
        if not plain:
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        before, word, after = plain.groups()
        if before == " ":
            found = self._model_ids(" " + word)
        else:
            found = self._model_ids(word)
            if before:
                found = self._sign(before) + found
        return found + self._sign(after) if after else found

    def count(self, part: str) -> int:
        return len(self.ids(part))


class Payloads(dict):
    """Little-endian unsigned 32-bit ids of parts, encoded when first asked for.

    Lives as long as its worker process, over tasks. Once full it becomes the older
    generation of a new one, which takes over what is still in use. Words of A-Z and a-z,
    with a line break before them or a sign behind, go to the model without further tests.
    """

    def __init__(self, encoder: Encoder, older: dict[str, bytes] | None = None):
        super().__init__()
        self.encoder, self.older = encoder, older or {}

    def __missing__(self, part: str) -> bytes:
        found = self.older.get(part)
        if found is None:
            found = self._encoded(part)
        self[part] = found
        return found

    def _encoded(self, part: str) -> bytes:
        if self.encoder.direct:
            if part.isascii():
                if part.isalpha():
                    return self._model("Ġ" + part)
                word = part.rstrip(_ENDS)
                if word != part and word.isalpha():
                    return self[word] + self["\t" + part[len(word) :]]
                if part[0] in "\t\n" and part[1:].isalpha():
                    word = self._model(part[1:])
                    return word if part[0] == "\t" else self["\t\n"] + word
            elif plain := _PLAIN.fullmatch(part):
                before, word, sign = plain.groups()
                if sign:
                    return self[before + word] + self["\t" + sign]
                if not before:
                    return _payload(self.encoder._model_ids(" " + word))
        return _payload(self.encoder.ids(part))

    def _model(self, mapped: str) -> bytes:
        return _payload(map(_ID, self.encoder.model.tokenize(mapped)))


@lru_cache(maxsize=4)
def _payloads(path: str) -> list[Payloads]:
    return [Payloads(encoder(path))]


def payloads(path: str, remembered: int) -> Payloads:
    """The payloads of this worker process, at most about twice ``remembered`` parts."""
    held = _payloads(path)
    if len(held[0]) > remembered:
        held[0].older = {}
        held[0] = Payloads(encoder(path), dict(held[0]))
    return held[0]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)
