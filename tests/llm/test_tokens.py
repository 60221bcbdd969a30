import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from talentgrid.llm import bpe, token_counts, token_files
from talentgrid.llm.common import new_folder, tokenizer_text
from talentgrid.llm.pieces import library_encoder

LONG = "word " * 60_000 + "é" * 5000
TEXTS = ["", "Hello  world\n\n  x ", "a<|endoftext|> b  <|endoftext|>c", None, "naïve 你好 　x\x1c1٠²", "'s 't's", " lead", LONG]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_str(tokenizer_text())


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def strings(n):
    rng = random.Random(1)
    letters = "abcdet ethi   \n\t'sS.,!?0129éßñ你好😀  \x1c\x85　A٠²_-"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) + rng.choice(["", "<|endoftext|>", " "]) for _ in range(n)]


def test_codec_and_pieces_are_the_librarys(library):
    codec, decoder, pieces = bpe.Codec(tokenizer_text()), bpe.Decoder(tokenizer_text()), library_encoder(tokenizer_text())
    texts = strings(3000) + [t for t in TEXTS if t] + ["the" * 3000, "a" * 2999, "x" + " " * 4000 + "y"]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids(x) for x in codec.encode(texts)] == want and [ids(x) for x in pieces(texts)] == want
    assert [decoder.decode(x).decode() for x in codec.encode(texts)] == [library.decode(x, skip_special_tokens=False) for x in want]


def test_compatible_pairs_are_what_encoding_gives(library):
    codec, rng = bpe.Codec(tokenizer_text()), random.Random(2)
    letters = {v: k for k, v in bpe.byte_letters().items()}
    plain = [i for i in range(50256) if library.id_to_token(i).isascii() and library.id_to_token(i).isalpha()]
    for _ in range(4000):
        a, b = rng.choice(plain), rng.choice(plain)
        whole = library.id_to_token(a) + library.id_to_token(b)
        assert codec.compatible(a, b) == (library.encode(whole, add_special_tokens=False).ids == [a, b]), whole
    assert len(letters) == 256


def test_documents_round_trip(docs_of, library):
    rows = [(i if i % 5 else None, t) for i, t in enumerate(TEXTS)] + [(1, TEXTS[1])] * 2
    got = bpe.decode_documents(bpe.encode_documents(docs_of(rows))).collect()
    want = [(i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in rows]
    assert sorted(((r.doc_id, ids(r.ids), r.text) for r in got), key=str) == sorted(want, key=str)
    assert sorted(map(tuple, bpe.round_trip(docs_of(rows)).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert bpe.encode_documents(docs_of([]).limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_planes_round_trip(kind):
    rng = np.random.default_rng(1)
    for n in (1, 7, 8, 9, 1000, 65536):
        x = rng.integers(0, 2**32, n, dtype=np.uint32)
        planes = token_files.to_planes(x, kind)
        assert len(planes) == (32 if kind == "bit" else 4) and (token_files.from_planes(planes, n, kind) == x).all()


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_token_files(spark, docs_of, library, kind):
    rows = [(9 - i, t) for i, t in enumerate(TEXTS)] + [(3, "again"), (3, "again"), (None, "no id")]
    folder = new_folder(spark, "t")
    manifest = token_files.write_token_files(docs_of(rows).repartition(3), folder, kind=kind)
    got = sorted(token_files.read_token_files(manifest, folder).collect(), key=lambda r: r.start)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for r, (i, t) in zip(got, order, strict=True):
        own = library.encode(t or "", add_special_tokens=False).ids + [0]
        assert tuple(r) == (i, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        start += len(own)
    empty = token_files.write_token_files(docs_of([]).limit(0), folder + "e")
    assert empty.count() == 0 and token_files.read_token_files(empty, folder + "e").count() == 0


def test_incomplete_file_is_refused(tmp_path):
    import pyarrow as pa
    (tmp_path / "f").write_bytes(token_files.MAGIC + b"x" * 40)
    with pytest.raises(ValueError):
        token_files.PlaneReader(pa.OSFile(str(tmp_path / "f")))


@pytest.mark.parametrize("block_bytes", [2, 6, 64, 1 << 20])
def test_counts_over_block_boundaries(spark, docs_of, block_bytes):
    small = [(i, t) for i, t in enumerate(strings(25))] + [(30, None), (31, ""), (None, "x y"), (7, "again"), (7, "again")]
    folder = new_folder(spark, "t")
    listing = token_counts.write_flat_files(docs_of(small).repartition(2), folder)
    found = listing.join(token_counts.count_tokens(listing, folder, block_bytes=block_bytes), ["file", "nth"])
    library = Tokenizer.from_str(tokenizer_text())
    library.encode_special_tokens = True
    want = [(i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in small]
    assert sorted(((r.doc_id, r.n_tokens) for r in found.collect()), key=str) == sorted(want, key=str)


def test_no_files_no_counts(spark, docs_of):
    assert token_counts.document_token_counts(docs_of([]).limit(0)).count() == 0


def test_ids_too_wide_and_end_ids_of_ordinary_text_are_refused(spark, docs_of):
    rows = docs_of([(1, "some ordinary text")])
    with pytest.raises(Exception, match="too narrow"):
        token_counts.write_flat_files(rows, new_folder(spark, "t"), end_id=70_000, width=2)
    used = Tokenizer.from_str(tokenizer_text()).encode("some ordinary text", add_special_tokens=False).ids[0]
    with pytest.raises(Exception, match="ordinary text"):
        token_counts.write_flat_files(rows, new_folder(spark, "t"), end_id=used)
