"""Byte-level BPE encoding of whole texts with the ids of the tokenizers library."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array

#: The pattern (a fixed value) by which the byte-level pre-tokenizer cuts a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts with a longer run of white space are left to the tokenizers library: the other engine's pattern matcher keeps a state for each of its characters.
LONGEST_BLANK, BLANK = 50_000, re.compile(r"\s+")


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _kind(category: str) -> str:
    return category[0] if category[0] in "LNZ" else "-"


def _unsettled() -> re.Pattern:
    """Matches the code points that Unicode tables of different age may class differently as letter, number, space or neither; and all
    beyond the first plane but for symbols. Those that 3.2 and today's table class alike, and that have a class today, are settled."""
    old, now = unicodedata.ucd_3_2_0.category, unicodedata.category
    ranges: list[list[int]] = []
    for code in [*range(0x10000), *range(0x1F000, 0x1FB00)]:
        c = chr(code)
        if now(c) not in ("Cn", "Cs") and _kind(old(c)) == _kind(now(c)):
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
    return re.compile("[^" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others by rank above 255."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Ids by bytes, where the file is a plain byte-level BPE whose k-th merge makes the k-th id after the bytes; else None."""
    model, cut = spec["model"], spec["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or spec["normalizer"] or cut.get("type") != "ByteLevel" or cut["add_prefix_space"] or not cut.get("use_regex", True) or any(not t["special"] for t in spec["added_tokens"]):
        return None
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    vocab, byte_of = model["vocab"], _byte_of()
    if any(vocab.get(t) != 256 + k for k, t in enumerate(merged)) or sorted(vocab.get(c, -1) for c in byte_of) != list(range(256)):
        return None
    return {bytes(map(byte_of.__getitem__, t)): vocab[t] for t in [*byte_of, *merged]}


class BpeEncoder:
    """Ids of texts by a tokenizers file (special tokens in a text are plain text, none is added).

    Where the file's merges can be stated as ranks (_ranks), texts of settled code points are merged by the tiktoken library, which does the
    same merges on the same pieces in a sixth of the time; all other texts and files go through the tokenizers library. No memory grows with the texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, "rb") as file:
            ranks = _ranks(json.load(file))
        self.fast = None
        if ranks:
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
            self.unsettled = _unsettled()

    def settled(self, text: str) -> bool:
        return (text.isascii() or not self.unsettled.search(text)) and (len(text) <= LONGEST_BLANK or max(map(len, BLANK.findall(text)), default=0) <= LONGEST_BLANK)

    def exact(self, texts: list[str]) -> list[bytes]:
        """By the tokenizers library."""
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if self.fast is None:
            return self.exact(texts)
        out: list[bytes | None] = [array("I", self.fast.encode_ordinary(x)).tobytes() if self.settled(x) else None for x in texts]
        rest = [k for k, x in enumerate(out) if x is None]
        if rest:
            for k, ids in zip(rest, self.exact([texts[k] for k in rest]), strict=True):
                out[k] = ids
        return out


_encoders: dict[str, BpeEncoder] = {}


def encoder(path: str) -> BpeEncoder:
    """One encoder for each Python worker: a vocabulary, nothing of the texts."""
    if path not in _encoders:
        _encoders[path] = BpeEncoder(path)
    return _encoders[path]


def vocabulary(path: str) -> int:
    """One more than the greatest id of a tokenizers file."""
    with open(path, "rb") as file:
        spec = json.load(file)
    listed = spec["model"]["vocab"]
    own = len(listed) if isinstance(listed, list) else max(listed.values(), default=-1) + 1
    return max([own, *(t["id"] + 1 for t in spec.get("added_tokens") or [])])
