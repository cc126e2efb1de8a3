"""SentencePiece encoding and decoding for merge-type (BPE) models.

A prefix table holds, for each prefix of a chunk, the one last token of the prefix's encoding: of the vocabulary entries that end there
(found by an automaton) it is the one that is compatible with the last token of the prefix before it. Two tokens are compatible if merging
their joined text gives just these two. Ids are then recovered backwards. Chunks end only where no vocabulary entry can span, so they are
independent, and frequent ones are remembered up to a bound.
"""

from __future__ import annotations

import re
from array import array
from sys import byteorder

import numpy as np
from pyspark.sql import DataFrame

from ._common import derive

SPACE = "▁"
NORMAL, BYTE = 1, 6
LETTER = re.compile(r"[^\W\d_]")


class PieceModel:
    """A merge-type model, from the bytes of its file. Raises ValueError for other types, other normalisation or a vocabulary without byte fallback."""

    def __init__(self, data: bytes, chunks: int = 250_000, pairs: int = 300_000):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(data)
        trainer, rule = proto.trainer_spec, proto.normalizer_spec
        if trainer.model_type != 2 or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix:
            raise ValueError("only merge-type models with byte fallback are known")
        if rule.precompiled_charsmap or not rule.add_dummy_prefix or rule.remove_extra_whitespaces or not rule.escape_whitespaces:
            raise ValueError("only the identity normalisation with a leading space is known")
        if any(p.type not in (1, 2, 3, 6) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not known")
        self.pieces = [p.piece for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.byte_ids = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.begin, self.end = trainer.bos_id, trainer.eos_id
        self._known: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._signs = {p for p in self.ids if len(p) == 1}
        if any(not self._signs.issuperset(p) for p in self.ids):
            raise ValueError("each sign of an entry must be an entry")
        self._unknown = re.compile(f"([^{''.join(map(re.escape, sorted(self._signs)))}])", re.S)
        self._pairs: dict[tuple[str, str], bool] = {}
        self._bounds = chunks, pairs
        self._automaton = None
        self._splitter = self._split_pattern()

    def _split_pattern(self) -> re.Pattern:
        """Chunks begin at spaces; besides, a run of letters and a run of breakers part. A breaker is a sign that no entry holds beside a letter."""
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            return re.compile(r".+", re.S)
        beside = {c for p in self.ids for a, b in zip(p, p[1:], strict=False) for c, d in ((a, b), (b, a)) if LETTER.match(d) and not LETTER.match(c)}
        breakers = "".join(re.escape(chr(c)) for c in range(128) if not LETTER.match(chr(c)) and chr(c) not in beside)
        other = rf"{SPACE}*[^{SPACE}]+|{SPACE}+"
        if not breakers:
            return re.compile(other)
        ends = rf"(?=[^\W\d_]|[{SPACE}{breakers}]|\Z)"
        return re.compile(rf"{SPACE}*[^\W\d_]++{ends}|{SPACE}*[{breakers}]++{ends}|{other}")

    def merged(self, text: str) -> list[str]:
        """Plain merging: the best-scored pair first, the leftmost of equals. For vocabulary entries and pairs of them only, as it is slow."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _build(self):
        """The automaton over the entries that merging can reach, and over no others."""
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for piece in self.ids:
            if self.merged(piece) == [piece]:
                automaton.add_word(piece, piece)
        automaton.make_automaton()
        return automaton

    def tokens(self, chunk: str) -> list[str]:
        """The tokens of one chunk by its prefix table; a sign that is no entry is a token of its own, which merges with nothing."""
        if self._automaton is None:
            self._automaton = self._build()
        if not self._signs.issuperset(chunk):
            parts = self._unknown.split(chunk)  # unknown signs at odd places
            return [t for i, part in enumerate(parts) for t in (part if i % 2 else self.tokens(part) if part else ())]
        last: list[str] = [""] * (len(chunk) + 1)
        known, get = self._pairs, self._pairs.get
        for end, piece in self._automaton.iter(chunk):
            end += 1
            if last[end]:
                continue
            before = last[end - len(piece)]
            if not before:
                if end == len(piece):
                    last[end] = piece
                continue
            fits = get((before, piece))
            if fits is None:
                if len(known) >= self._bounds[1]:
                    known.clear()
                fits = known[before, piece] = self.merged(before + piece) == [before, piece]
            if fits:
                last[end] = piece
        found, at = [], len(chunk)
        while at:
            found.append(last[at])
            at -= len(last[at])
        return found[::-1]

    def _encoded(self, chunk: str) -> bytes:
        tokens = self.tokens(chunk)
        try:
            ids = [self.ids[t] for t in tokens]
        except KeyError:
            ids = [i for t in tokens for i in ((self.ids[t],) if t in self.ids else [self.byte_ids[b] for b in t.encode("utf-8")])]
        found = array("I", ids)
        if byteorder != "little":
            found.byteswap()
        data = found.tobytes()
        if len(chunk) <= 64:
            if len(self._known) >= self._bounds[0]:  # the older generation goes
                self._old, self._known = self._known, {}
            self._known[chunk] = data
        return data

    def _find(self, chunk: str) -> bytes:
        data = self._old.get(chunk)
        if data is None:
            return self._encoded(chunk)
        self._known[chunk] = data
        return data

    def encode_bytes(self, text: str, ends: bool = True) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, with begin and end ids if ``ends``."""
        out = [np.array([self.begin], "<u4").tobytes()] if ends else []
        if text:
            for chunk in self._splitter.findall(SPACE + text.replace(" ", SPACE)):
                out.append(self._known.get(chunk) or self._find(chunk))
        if ends:
            out.append(np.array([self.end], "<u4").tobytes())
        return b"".join(out)

    def encode(self, text: str, ends: bool = True) -> list[int]:
        return np.frombuffer(self.encode_bytes(text, ends), "<u4").tolist()

    def decode(self, ids) -> str:
        """Joins the pieces: control ids vanish, runs of byte ids become UTF-8 text, the first piece loses one leading space."""
        out, held, first = [], bytearray(), True
        pieces, kinds = self.pieces, self.kinds
        for i in ids:
            kind = kinds[i]
            if kind == BYTE:
                held.append(int(pieces[i][1:-1], 16))
                continue
            if held:
                out.append(_utf8(bytes(held)))
                held.clear()
                first = False
            if kind == NORMAL:
                piece = pieces[i]
                if first and piece[0] == SPACE:
                    piece = piece[1:]
                first = False
                out.append(piece)
            elif kind == 2:
                out.append(" ⁇ ")
                first = False
        if held:
            out.append(_utf8(bytes(held)))
        return "".join(out).replace(SPACE, " ")


def _utf8(data: bytes) -> str:
    """Text of the bytes; each byte outside a well-formed sequence becomes one replacement sign."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError as e:
        good = data[: e.start].decode("utf-8")
        return good + "�" + _utf8(data[e.start + 1 :])


_MODELS: dict[int, PieceModel] = {}


def load(data: bytes) -> PieceModel:
    """The model of these bytes, built once a worker."""
    key = hash(data)
    if key not in _MODELS:
        _MODELS[key] = PieceModel(data)
    return _MODELS[key]


def encode(documents: DataFrame, model_path: str, keep: list[str] | None = None, decoded: bool = False) -> DataFrame:
    """Adds n_tokens and input_ids (array<int>), and with ``decoded`` decoded_text. Null text counts as empty: begin and end ids only. The model file (bounded, about 0.5 MB) is read on the driver and broadcast."""
    shared = _shared(documents, model_path)

    def make():
        model = load(shared.value)

        def run(texts):
            ids = [np.frombuffer(model.encode_bytes(t or ""), "<u4").astype(np.int32) for t in texts]
            return [[len(x) for x in ids], ids, *([[model.decode(x.tolist()) for x in ids]] if decoded else [])]

        return run

    return derive(documents, make, ["text"], "n_tokens long, input_ids array<int>" + (", decoded_text string" if decoded else ""), keep)


def digests(documents: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: ids and decoded texts are hashed beside the text they come from, not shipped. Null text counts as empty; extra columns are left out."""
    shared = _shared(documents, model_path)

    def make():
        from hashlib import sha256

        model = load(shared.value)

        def run(texts):
            counts, of_ids, of_texts = [], [], []
            for text in texts:
                data = model.encode_bytes(text or "")
                counts.append(len(data) // 4)
                of_ids.append(sha256(data).hexdigest())
                of_texts.append(sha256(model.decode(np.frombuffer(data, "<u4").tolist()).encode("utf-8", "surrogatepass")).hexdigest())
            return [counts, of_ids, of_texts]

        return run

    return derive(documents, make, ["text"], "n_tokens long, ids_sha256 string, decoded_sha256 string", keep=["doc_id"])


def _shared(documents: DataFrame, model_path: str):
    with open(model_path, "rb") as f:
        return documents.sparkSession.sparkContext.broadcast(f.read())
