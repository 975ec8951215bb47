"""Operator 8: SentencePiece encoding with byte spans, and decoding.

A text is normalised here by longest prefixes of the model's compiled character map (a double-array trie), and each
normalised byte keeps the place of the source bytes it came from. The library segments; its pieces, laid end to end, must
be the normalised text, which projects each piece to its source bytes. A narrow pass: texts are never shuffled or cut.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from weftline.llm.common import prepared, table

#: Bytes of text that are encoded at once.
SLICE_BYTES = 1 << 20

_META = "▁".encode()


@dataclass
class CharacterMap:
    """The compiled map of a model: a double-array trie over UTF-8 from source strings to their normal forms."""

    blob: bytes

    @cached_property
    def units(self) -> list[int]:
        size = struct.unpack_from("<I", self.blob)[0]
        return np.frombuffer(self.blob, "<u4", size // 4, 4).tolist()

    @cached_property
    def forms(self) -> bytes:
        return self.blob[4 + struct.unpack_from("<I", self.blob)[0] :]

    def longest(self, text: bytes, at: int) -> tuple[int, int]:
        """Length of the longest source string that starts there and the place of its normal form; (0, 0) if none does."""
        units = self.units
        step = lambda u: (u >> 10) << ((u & 0x200) >> 6)
        node = step(units[0])
        best = (0, 0)
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units) or units[node] & 0x800000FF != text[i]:
                break
            has_form = units[node] >> 8 & 1
            node ^= step(units[node])
            if has_form:
                best = (i + 1 - at, units[node] & 0x7FFFFFFF)
        return best

    def form(self, place: int) -> bytes:
        return self.forms[place : self.forms.index(0, place)]


@dataclass
class Normaliser:
    """What a model does to a text before it is segmented, with the source place of each byte."""

    charsmap: CharacterMap | None
    dummy_prefix: bool
    squeeze: bool
    escape: bool
    suffix: bool
    kept: tuple[bytes, ...]

    @classmethod
    def of(cls, model: bytes) -> Normaliser:
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        kept = tuple(p.piece.encode() for p in proto.pieces if p.type == p.USER_DEFINED)
        charsmap = CharacterMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        return cls(charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces, proto.trainer_spec.treat_whitespace_as_suffix, kept)

    def __call__(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(normalised bytes, source place of each and, last, of the end)."""
        if not data:
            return np.zeros(0, np.uint8), np.zeros(1, np.int64)
        plain = self.charsmap is None and not self.kept and not self.squeeze and not self.suffix
        return self._plain(data) if plain else self._general(data)

    def _plain(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Without a map only spaces change."""
        source = np.frombuffer(data, np.uint8)
        lengths = np.where(source == 0x20, len(_META), 1) if self.escape else np.ones(len(source), np.int64)
        out = np.repeat(source, lengths)
        place = np.repeat(np.arange(len(source)), lengths)
        if self.escape:
            first = np.flatnonzero(source == 0x20)
            at = (np.cumsum(lengths) - lengths)[first]
            for k, byte in enumerate(_META):
                out[at + k] = byte
        if self.dummy_prefix:
            mark = np.frombuffer(_META if self.escape else b" ", np.uint8)
            out, place = np.r_[mark, out], np.r_[np.zeros(len(mark), np.int64), place]
        return out, np.r_[place, len(source)]

    def _next(self, data: bytes, at: int) -> tuple[bytes, int]:
        """The normal form of the longest prefix there and the source bytes it takes."""
        for symbol in sorted(self.kept, key=len, reverse=True):
            if data.startswith(symbol, at):
                return symbol, len(symbol)
        if self.charsmap:
            length, place = self.charsmap.longest(data, at)
            if length:
                return self.charsmap.form(place), length
        lead = data[at]
        length = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return data[at : at + length], length

    def _general(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        out, place = bytearray(), []
        space = _META if self.escape else b" "
        at = 0
        while self.squeeze and at < len(data):  # leading white space goes
            form, length = self._next(data, at)
            if form not in (b" ", b""):
                break
            at += length
        started = at
        if self.dummy_prefix and not self.suffix and at < len(data):
            out += space
            place += [started] * len(space)
        after_space = self.squeeze
        while at < len(data):
            form, length = self._next(data, at)
            if after_space and self.squeeze:
                form = form.lstrip(b" ")
            same = form == data[at : at + length]  # then its bytes are their own source
            for k, byte in enumerate(form):
                piece = space if byte == 0x20 else bytes([byte])
                out += piece
                place += [at + k * same] * len(piece)
            if form:
                after_space = form.endswith(b" ") and self.squeeze
            at += length
        end = len(data)
        while self.squeeze and out.endswith(space):
            end = place[-len(space)]
            del out[-len(space) :], place[-len(space) :]
        if self.dummy_prefix and self.suffix and out:
            out += space
            place += [end] * len(space)
        return np.frombuffer(bytes(out), np.uint8), np.array([*place, end], np.int64)


class Codec:
    """A model's pieces with their byte lengths, and encoding of slices of texts."""

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.normalise = Normaliser.of(model)
        size = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i).encode() for i in range(size)]
        self.unknown = self.library.unk_id()
        surface = [b"" if self.library.is_control(i) else bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p for i, p in enumerate(pieces)]
        self.lengths = np.array([len(s) for s in surface])
        self.pool = np.frombuffer(b"".join(surface), np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def spans(self, data: bytes, ids: np.ndarray) -> np.ndarray | None:
        """The end of each piece in the source bytes; a piece starts where the one before ends. None: the pieces are not the normalised text."""
        normal, place = self.normalise(data)
        lengths = self.lengths[ids]
        if (ids == self.unknown).any():
            found = self.library.encode(data.decode(), return_type="proto").pieces
            lengths = np.where(lengths == 0, 0, lengths)
            told = [len(p.piece.encode()) for p in found]
            same = len(told) == np.count_nonzero(lengths) and sum(told) == len(normal)
            if same:
                lengths[lengths > 0] = told
        else:
            ends = np.cumsum(lengths)
            total = int(ends[-1]) if len(ends) else 0
            laid = self.pool[np.repeat(self.starts[ids] - (ends - lengths), lengths) + np.arange(total)] if total else normal[:0]
            same = np.array_equal(laid, normal)
        if not same:
            return None
        return place[np.cumsum(lengths)].astype("<u4")

    def encode(self, texts: list[str], begin: bool, end: bool) -> list[list[int]]:
        return self.library.encode(texts, add_bos=begin, add_eos=end, num_threads=1)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids, num_threads=1)


def _slices(texts: list[str]) -> list[tuple[int, int]]:
    out, start, size = [], 0, 0
    for i, x in enumerate(texts):
        size += len(x)
        if size >= SLICE_BYTES:
            out.append((start, i + 1))
            start, size = i + 1, 0
    return out if start == len(texts) else [*out, (start, len(texts))]


def _coder(model: Callable[[], bytes], begin: bool, end: bool) -> Callable[[pa.Array], pa.Array]:
    cache: list[Codec] = []

    def code(texts: pa.Array) -> pa.Array:
        if not cache:
            cache.append(Codec(model()))
        codec = cache[0]
        texts = texts.fill_null("").to_pylist()
        ids, ends, decoded = [], [], []
        for a, b in _slices(texts):
            found = codec.encode(texts[a:b], begin, end)
            decoded += codec.decode(found)
            for text, own in zip(texts[a:b], found, strict=True):
                own = np.array(own, "<u4")
                ids.append(own.tobytes())
                spans = codec.spans(text.encode(), own)
                ends.append(None if spans is None else spans.tobytes())
        return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(ends, pa.binary()), pa.array(decoded, pa.string())], ["ids", "ends", "decoded"])

    return code


def piece_codec(spark: SparkSession, text: Column, model_path: str, begin: bool = True, end: bool = True) -> Column:
    """A struct of a text: ids and ends (packed little-endian unsigned 32-bit integers) and decoded, the text of the ids.

    ends has, for each id, where its piece ends in the text's UTF-8; the piece starts where the one before ends, so
    begin and end ids span nothing. A null text is the empty one. Where the pieces do not add up to the normalised text, which no
    known text does, ends is null and the job goes on. Repeated rows have the same result, an empty table an empty one, and a very long text is
    encoded whole. The model is read on the driver and broadcast.
    """
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    return F.arrow_udf(_coder(lambda: model.value, begin, end), "ids binary, ends binary, decoded string")(F.coalesce(text.cast("string"), F.lit("")))


def unpacked(packed: Column) -> Column:
    """Packed integers as an array of longs."""

    def wide(values: pa.Array) -> pa.Array:
        lists = [None if v is None else np.frombuffer(v, "<u4").astype(np.int64) for v in values.to_pylist()]
        return pa.array(lists, pa.list_(pa.int64()))

    return F.arrow_udf(wide, "array<bigint>")(packed)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, model_path: str | None = None, text_col: str = "text") -> DataFrame:
    """The rows with a column `encoded` from piece_codec; a column of that name is replaced."""
    spark = prepared(docs.sparkSession)
    return docs.withColumn("encoded", piece_codec(spark, F.col(text_col), model_path or default_model()))


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return encoded.select(
        id_col,
        F.floor(F.octet_length("encoded.ids") / 4).alias("n_tokens"),
        F.sha2("encoded.ids", 256).alias("ids_sha256"),
        F.sha2(F.col("encoded.decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.sha2("encoded.ends", 256).alias("ends_sha256"),
    )


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents and their decoded texts, as digests."""
    return digests(encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES = {"op8_sentencepiece": op8_sentencepiece}
