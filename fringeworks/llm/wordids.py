"""Token ids of whole texts, each distinct word encoded once per Python worker.

A tokenizer file that normalises by NFC and lower case and cuts texts, before its
merges, at white space and between letters and other characters, gives a text the
ids of its white-space separated words in a row. A word of ASCII and Latin-1
letters without apostrophe (which contractions attach to letters) has the ids of
its runs of letters and of others in a row; a run of such letters, in lower case
and with its bytes written as the file's byte alphabet, goes to the merges as it
is. Other words, and all texts with other tokenizer files, are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array

from .scratch import kept_by_workers

#: Words and runs together that a worker keeps in each of two generations, some 40 MB each.
CAPACITY = 250_000
#: Longer words are encoded but not kept.
LONGEST_KEPT = 64
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_PLAIN = re.compile(f"[!-&(-~{_LETTERS}]*")
_RUNS = re.compile(f"[{_LETTERS}]+|[^{_LETTERS}]+")


#: What a file must say for texts to be cut into words.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_alphabet() -> dict[int, str]:
    """The printable Latin-1 character of each byte; the others follow from 256 on."""
    kept = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173}
    rest = (b for b in range(256) if b not in kept)
    return {b: chr(b) for b in kept} | {b: chr(256 + n) for n, b in enumerate(rest)}


def cuts_words(tokenizer) -> bool:
    told = json.loads(tokenizer.to_str())
    if any(t["normalized"] for t in told["added_tokens"]):  # may stand in a text in other letters than their own
        return False
    before = (told["normalizer"] or {}).get("normalizers", []), (told["pre_tokenizer"] or {}).get("pretokenizers", [])
    kinds = [[x["type"] for x in steps] for steps in before]
    if kinds != [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]]:
        return False
    blank, split = before[0][1], before[1][0]
    prefix, regex = before[1][1]["add_prefix_space"], before[1][1]["use_regex"]
    return (blank["pattern"], blank["content"], split["pattern"]) == ({"Regex": r"\s+"}, " ", {"Regex": _SPLIT}) and not prefix and not regex


class _Known(dict):
    def __init__(self, make, capacity: int):
        self.make, self.capacity, self.old = make, capacity, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.make(word)
        if len(word) <= LONGEST_KEPT:
            if len(self) >= self.capacity:  # what is not asked for in a whole generation goes
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class WordIds:
    """``encode(texts)`` returns little-endian unsigned 32-bit ids as bytes, one value per text."""

    def __init__(self, path: str, capacity: int = CAPACITY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.alphabet, self.by_word = self.tokenizer.model, byte_alphabet(), cuts_words(self.tokenizer)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = _Known(self._word, capacity)  # a run is a word as well, with the same ids

    def _ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _run(self, run: str) -> bytes:
        if not run.isalpha():
            return self._ids(run)
        if not run.isascii():
            run = run.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.model.tokenize(run)]).tobytes()

    def _word(self, word: str) -> bytes:
        if not _PLAIN.fullmatch(word):
            return self._ids(word)
        runs = [run.lower() for run in _RUNS.findall(word)]
        return self._run(word) if runs == [word] else b"".join([self.known[run] for run in runs])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Null texts count as empty."""
        if not self.by_word:
            return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        out = []
        get = self.known.__getitem__
        for text in texts:
            text = text or ""
            if any(t in text for t in self.added):
                out.append(self._ids(text))
                continue
            for c in "\t\n\r\x0b\x0c":
                if c in text:
                    text = text.replace(c, " ")
            out.append(b"".join(map(get, text.split(" "))))
        return out


_encoders: dict[str, WordIds] = {}
kept_by_workers.append(_encoders)


def encoder(path: str) -> WordIds:
    """The worker's encoder for a tokenizer file; Spark reuses Python workers between tasks.

    It goes when the worker turns to another function (``scratch.turn_to``).
    """
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]
