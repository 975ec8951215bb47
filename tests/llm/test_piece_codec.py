import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2

from weftline.llm.piece_codec import CharacterMap, Codec, Normaliser, default_model, encode_documents, op8_sentencepiece, unpacked

TEXTS = [None, "", " ", "  two  spaces ", "Ünïcode 中文 😀‍👩", "tab\tand\nlines\r\n", "▁already▁marked", "<s> [INST] </s> <unk> <0x0A>", "a" * 5000, "\x00\x01�", "ﬁ ㍿ é 　x", "x " * 2000]


@pytest.fixture(scope="module")
def model():
    with open(default_model(), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def codec(model):
    return Codec(model)


def remade(model, **spec):
    """The model with another normaliser; the character map is made by the library from its own rules."""
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    for k, v in spec.items():
        setattr(proto.normalizer_spec, k, v)
    return proto.SerializeToString()


def test_ids_and_texts_are_the_librarys(spark, model):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    for r in encode_documents(rows).select("doc_id", "encoded").collect():
        ids = library.encode(TEXTS[r.doc_id] or "", add_bos=True, add_eos=True)
        assert np.frombuffer(r.encoded.ids, "<u4").tolist() == ids and r.encoded.decoded == library.decode(ids)
        ends = np.frombuffer(r.encoded.ends, "<u4").tolist()
        assert len(ends) == len(ids) and ends == sorted(ends) and ends[0] == 0 and ends[-1] == len((TEXTS[r.doc_id] or "").encode())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab  ▁é中😀\n\t<>0x")), max_size=40))
def test_spans_hold_their_pieces_bytes(text):
    with open(default_model(), "rb") as f:
        codec = _codec(f.read())
    data = text.encode()
    ids = np.array(codec.encode([text], True, True)[0])
    ends = codec.spans(data, ids).tolist()
    start = 0
    for i, end in zip(ids.tolist(), ends, strict=True):
        surface = codec.pool[codec.starts[i] : codec.starts[i] + codec.lengths[i]].tobytes().replace("▁".encode(), b" ")
        source = data[start:end]
        assert source.replace("▁".encode(), b" ") in (surface, surface[1:]), (text, i, surface, source)
        start = end
    assert start == len(data)


_KEPT = []


def _codec(model):
    if not _KEPT:
        _KEPT.append(Codec(model))
    return _KEPT[0]


def double_array(forms):
    """A compiled character map: a double-array trie of source strings, and their forms ended by zeros."""
    pool, place = b"", {}
    for key in sorted(forms):
        place[key] = len(pool)
        pool += forms[key] + b"\0"
    units = {0: 0}
    taken = {0}

    def put(node, prefix):
        children = sorted({k[len(prefix)] for k in forms if k.startswith(prefix) and len(k) > len(prefix)})
        labels = ([0] if prefix in forms else []) + children
        offset = next(o for o in range(1, 1 << 20) if all((node ^ o ^ c) not in taken for c in labels))
        base = node ^ offset
        taken.update(base ^ c for c in labels)
        units[node] = units.get(node, 0) | offset << 10 | (0x100 if prefix in forms else 0)
        if prefix in forms:
            units[base] = 0x80000000 | place[prefix]
        for c in children:
            units[base ^ c] = c
        for c in children:
            put(base ^ c, prefix + bytes([c]))

    put(0, b"")
    size = (max(units) | 255) + 1
    words = np.zeros(size, "<u4")
    for k, v in units.items():
        words[k] = v
    return np.uint32(words.nbytes).astype("<u4").tobytes() + words.tobytes() + pool


FORMS = {"ﬁ".encode(): b"fi", "㍿".encode(): "株式会社".encode(), "　".encode(): b" ", b"\t": b" ", b"\n": b" ", "​".encode(): b"", b"ab": b"X", b"abc": b"YZ", "é".encode(): "é".encode()}


def test_longest_prefixes_win():
    charsmap = CharacterMap(double_array(FORMS))
    for key, form in FORMS.items():
        length, place = charsmap.longest(b"zz" + key + b"!", 2)
        assert length == len(key) and charsmap.form(place) == form
    assert charsmap.longest(b"a", 0) == (0, 0) and charsmap.longest(b"abd", 0)[0] == 2


@pytest.mark.parametrize("squeeze", [False, True])
@pytest.mark.parametrize("prefix", [False, True])
def test_normalising_with_a_map_is_the_librarys(model, squeeze, prefix):
    own = remade(model, precompiled_charsmap=double_array(FORMS), remove_extra_whitespaces=squeeze, add_dummy_prefix=prefix)
    library, codec = sentencepiece.SentencePieceProcessor(model_proto=own), Codec(own)
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice([*(k.decode() for k in FORMS), " ", "a", "q", "中", "▁"]) for _ in range(rng.randint(0, 12)))
        normal, place = codec.normalise(text.encode())
        assert normal.tobytes().decode() == library.normalize(text), repr(text)
        assert len(place) == len(normal) + 1 and (np.diff(place) >= 0).all()
        ids = np.array(codec.encode([text], True, True)[0])
        ends = codec.spans(text.encode(), ids)
        assert len(ends) == len(ids)


def test_no_map_is_the_plain_path(model):
    normaliser = Normaliser.of(model)
    general = Normaliser(*[getattr(normaliser, f) for f in ("charsmap", "dummy_prefix", "squeeze", "escape", "suffix", "kept")])
    for text in filter(None, TEXTS):
        a, b = normaliser(text.encode()), general._general(text.encode())
        assert a[0].tobytes() == b[0].tobytes()


def test_query_digests(spark, model):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = op8_sentencepiece(spark, sf).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = library.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_empty_table_and_clashing_column(spark):
    df = spark.createDataFrame([], "doc_id long, text string, encoded int")
    assert encode_documents(df).collect() == []
    packed = spark.createDataFrame([(bytes([1, 0, 0, 0, 255, 255, 255, 255]),), (None,), (b"",)], "b binary")
    assert [r[0] for r in packed.select(unpacked(packed["b"])).collect()] == [[1, 2**32 - 1], None, []]


def test_pieces_that_are_not_the_text_have_no_spans_and_raise_nothing():
    codec = Codec(open(default_model(), "rb").read())
    ids = np.array(codec.encode(["other words"], True, True)[0])
    assert codec.spans(b"some text", ids) is None and codec.spans(b"", ids) is None
    assert codec.spans(b"x \xe2\x98\x83\xf0\x9f\xa5\xb7 y", np.r_[ids, codec.unknown]) is None
