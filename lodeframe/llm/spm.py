"""SentencePiece models on the tokenizers library: parsing, rebuilding, encoding, decoding and parity."""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2
#: Chunks that a worker remembers, and the longest that is worth it: together they bound its memory.
REMEMBERED, LONGEST = 400_000, 64


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message; fixed-width values stay bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        wire = key & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire in (1, 2, 5):
            size, at = _varint(data, at) if wire == 2 else ((8 if wire == 1 else 4), at)
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {wire} of field {key >> 3}")
        yield key >> 3, value


@dataclass
class PieceModel:
    """What encoding needs of a model file."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        out = cls()
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                out.pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
            elif number == 2:
                spec = dict(_fields(value))
                out.kind, out.byte_fallback, out.unk_id = spec.get(3, UNIGRAM), bool(spec.get(35, 0)), spec.get(40, 0)
            elif number == 3:
                spec = dict(_fields(value))
                out.charsmap, out.dummy_prefix, out.squeeze = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
        return out

    def tokenizer(self):
        """The same model for the tokenizers library. BPE merges are all splits of a piece into two pieces, best score first."""
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers

        if self.kind == UNIGRAM:
            model = models.Unigram([(p, s) for p, s, _ in self.pieces], unk_id=self.unk_id, byte_fallback=self.byte_fallback)
        elif self.kind == BPE:
            ids = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            known = {p for p, _, kind in self.pieces if kind in (NORMAL, USER)}
            merges = []
            for piece, score, kind in self.pieces:
                if kind == NORMAL:
                    merges += [(-score, len(piece), ids[piece], (piece[:k], piece[k:])) for k in range(1, len(piece)) if piece[:k] in known and piece[k:] in known]
            merges.sort(key=lambda m: m[:3])
            model = models.BPE(ids, [m[-1] for m in merges], unk_token=self.pieces[self.unk_id][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        else:
            raise ValueError(f"model type {self.kind}")
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(MARK))
        out = Tokenizer(model)
        out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
        # back: markers become blanks, byte pieces join to UTF-8, the dummy prefix goes
        back = [decoders.Replace(MARK, " "), *([decoders.ByteFallback()] if self.byte_fallback else []), decoders.Fuse()]
        out.decoder = decoders.Sequence([*back, *([decoders.Strip(" ", 1, 0)] if self.dummy_prefix else [])])
        return out

    def cuttable(self) -> bool:
        """No piece reaches over the blank between two words, and the normaliser is the identity."""
        return not self.charsmap and not self.squeeze and self.dummy_prefix and not any(MARK in p.lstrip(MARK) for p, _, _ in self.pieces)


class Memory(dict):
    """Remembers up to `limit` short entries. When it is full it stays as it is, since what comes often came early; after four times as many new
    entries it starts afresh, in case the texts have changed."""

    def __init__(self, limit: int = REMEMBERED):
        super().__init__()
        self.limit, self.passed = limit, 0

    def add(self, new: dict) -> None:
        if len(self) < self.limit:
            self.update((k, v) for k, v in new.items() if len(k) <= LONGEST)
        else:
            self.passed += len(new)
            if self.passed > 4 * self.limit:
                self.clear()
                self.passed = 0


class PieceCodec:
    """Encodes and decodes by the rebuilt tokenizer and holds every distinct chunk against the SentencePiece library.

    threads: for batches, of the tokenizers library's pool; the first codec of a process sets its size.
    """

    def __init__(self, path: str, threads: int = 2):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece

        self.parallel = "true" if threads > 1 else "false"

        with open(path, "rb") as file:
            self.model = PieceModel.parse(file.read())
        self.backend = self.model.tokenizer()
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.cut = self.model.cuttable()
        self.chunks = Memory(REMEMBERED)
        #: Chunks on which the library doesn't agree, and texts that chunks decode to where these aren't the chunks themselves.
        self.odd: set[str] = set()
        self.changed: dict[str, str] = {}
        #: What has no text of its own: control pieces none, the unknown piece a mark (fixed value).
        self.silent = {i: " \u2047 " if kind == UNKNOWN else "" for i, (_, _, kind) in enumerate(self.model.pieces) if kind in (UNKNOWN, CONTROL)}

    def _batch(self, texts: list[str]) -> tuple[list[bytes], list[bool], list[str]]:
        os.environ["TOKENIZERS_PARALLELISM"] = self.parallel
        own = [x.ids if t else [] for x, t in zip(self.backend.encode_batch_fast(texts, add_special_tokens=False), texts, strict=True)]
        theirs = self.library.encode(texts, num_threads=1)
        return [array("I", x).tobytes() for x in own], [a == b for a, b in zip(own, theirs, strict=True)], self.decode_batch(own)

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool], list[str]]:
        """Little-endian unsigned 32-bit ids, whether the SentencePiece library agrees on the text, and the text that the ids decode to. Ids and text are the rebuilt tokenizer's in any case.

        A text whose blanks stand alone is its chunks between them, since no piece reaches over a blank; each distinct chunk is encoded, decoded and held against the library once.
        """
        out: list[tuple[bytes, bool, str]] = [(b"", True, "")] * len(texts)
        again: list[tuple[int, list[str], list[bytes | None], list[int]]] = []
        whole: list[int] = []
        get = self.chunks.get
        for k, text in enumerate(texts):
            if not self.cut or MARK in text or "  " in text or text[:1] in ("", " ") or text[-1] == " ":
                whole.append(k)
                continue
            parts = text.split(" ")
            found = list(map(get, parts))
            if None in found or self.odd or self.changed:
                again.append((k, parts, found, [i for i, x in enumerate(found) if x is None]))
            else:
                out[k] = b"".join(found), True, text
        if again:
            new = list({parts[i] for _, parts, _, holes in again for i in holes})
            ids, same, back = self._batch(new) if new else ([], [], [])
            learned = dict(zip(new, ids, strict=True))
            self.chunks.add(learned)
            # what is out of the ordinary stays known, so that texts with it are told apart
            self.odd |= {x for x, ok in zip(new, same, strict=True) if not ok}
            self.changed |= {x: b for x, b in zip(new, back, strict=True) if x != b}
            for k, parts, found, holes in again:
                for i in holes:
                    found[i] = learned[parts[i]]
                ok = not self.odd or self.odd.isdisjoint(parts)
                out[k] = b"".join(found), ok, texts[k] if self.changed.keys().isdisjoint(parts) else " ".join([self.changed.get(x, x) for x in parts])
        if whole:
            for k, *both in zip(whole, *self._batch([texts[k] for k in whole]), strict=True):
                out[k] = tuple(both)
        return [x for x, _, _ in out], [ok for _, ok, _ in out], [b for _, _, b in out]

    def decode_batch(self, ids: list[list[int]]) -> list[str]:
        """The texts of ids, by the rebuilt tokenizer; control and unknown ids cut a text into parts that it decodes by themselves."""
        out = self.backend.decode_batch(ids, skip_special_tokens=False)
        for k, row in enumerate(ids):
            if not self.silent.keys().isdisjoint(row):
                out[k] = self._parts(row)
        return out

    def _parts(self, row: list[int]) -> str:
        parts, at, lead = [], 0, self.model.dummy_prefix
        for k, x in enumerate([*row, -1]):
            if x == -1 or x in self.silent:
                run = row[at:k]
                text = self.backend.decode(run, skip_special_tokens=False) if run else ""
                # only the first text loses a blank that stands for the dummy prefix
                if run and any(parts) and lead and self.model.pieces[run[0]][0].startswith(MARK):
                    text = " " + text
                parts += [text, self.silent.get(x, "")]
                at = k + 1
        return "".join(parts)


_codecs: dict[str, PieceCodec] = {}


def codec(path: str, threads: int = 2) -> PieceCodec:
    if path not in _codecs:
        _codecs[path] = PieceCodec(path, threads)
    return _codecs[path]


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_pieces(docs: DataFrame, path: str | None = None, text: str = "text", doc_id: str = "doc_id", threads: int = 2, with_ids: bool = True) -> DataFrame:
    """One row a document: doc_id, n_tokens, ids_crc32, decoded_sha256, round_trip, parity and, with_ids, the ids.

    The ids are the rebuilt tokenizer's. round_trip: the decoded ids are the text. parity: the SentencePiece library gives
    the same ids; each distinct chunk between blanks is held against the library once a worker. Null and empty
    texts have no ids and round-trip to the empty text; texts of any length are encoded whole. Repeated rows and null ids stay, an empty table gives no rows, other columns, whatever their names, are ignored.
    No shuffle; memory is bounded by a batch and the chunks remembered.
    """
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = codec(path, threads)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                rows = batch.slice(k, 512)
                texts = [x or "" for x in rows["text"].to_pylist()]
                ids, same, back = both.encode(texts)
                out = [
                    rows["doc_id"],
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.encode("utf-8", "replace")).hexdigest() for x in back]),
                    pa.array([a == b for a, b in zip(texts, back, strict=True)]),
                    pa.array(same, pa.bool_()),
                ]
                names = ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip", "parity"]
                if with_ids:
                    out, names = [*out, pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names=names)

    schema = "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean, parity boolean" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def decode_pieces(df: DataFrame, path: str | None = None, ids: str = "ids", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and text of rows with ids. Null ids give a null text."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = codec(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                rows = batch.slice(k, 512)
                found = rows["ids"].to_pylist()
                texts = [None if x is None else t for x, t in zip(found, both.decode_batch([x or [] for x in found]), strict=True)]
                yield pa.RecordBatch.from_arrays([rows["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, "doc_id long, text string")
