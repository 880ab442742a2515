"""Byte-level BPE and token files against the public libraries."""

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from vacantia.llm import duck_bpe, pretokens, token_files
from vacantia.llm.files import opened

RANKS = P.path("byte_bpe_50k.tiktoken")
ALPHABET = " \n\t 'sSrevlltdmMabé1٣²Ⅷ,.-_　中\U0001F600\x1c\x85"


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=duck_bpe.read_ranks(RANKS), special_tokens={})


def odd_texts(n=400, seed=1):
    pick = random.Random(seed)
    made = ["".join(pick.choice(ALPHABET) for _ in range(pick.randint(0, 40))) for _ in range(n)]
    return [*made, "", " ", "\n", "don't we'll'S", "a" * 3000, " " * 500, "ab" * 200, "<|endoftext|> x", "twice", "twice"]


def docs(spark, texts):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(10_000, None, "x", 1), (None, "no id", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int")


def test_pieces(reference):
    for size in (1 << 20, 50):
        pretokens.CHUNK_CHARS, before = size, pretokens.CHUNK_CHARS
        texts = odd_texts(3000, 2)
        encoder = pretokens.Encoder(lambda words: [reference.encode_ordinary(w) for w in words])
        assert [x.tolist() for x in encoder.encode(texts)] == [reference.encode_ordinary(t) for t in texts]
        pretokens.CHUNK_CHARS = before


def test_cache_is_dropped_when_full(reference):
    encoder = pretokens.Encoder(lambda words: [reference.encode_ordinary(w) for w in words], cached_words=3)
    for text in ("one two three four", "five six", "one seven"):
        assert encoder.encode([text])[0].tolist() == reference.encode_ordinary(text)


def test_a_slice_of_new_words_fits_a_worker():
    """What a worker needs beside its caches does not grow with the batch (here 4 MB of words not met before)."""
    pick = random.Random(7)
    texts = [" ".join(f"{pick.getrandbits(44):x}" for _ in range(170)) for _ in range(2000)]
    encoder = pretokens.Encoder(lambda words: [[1, 2, 3, 4]] * len(words))
    encoder.encode(["warm up"])
    tracemalloc.start()
    for at, end in duck_bpe._slices(np.array([len(t) for t in texts])):
        encoder.encode(texts[at:end])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    caches = sum(x.nbytes for x in (encoder.known.keys, encoder.known.first, encoder.known.count, encoder.known.flat))
    assert peak - caches < 30 << 20


def test_very_long_pieces(reference):
    """A piece may be a whole text: a run of letters, alike or not."""
    own = duck_bpe.Coder(RANKS)
    rng = random.Random(5)
    for text in ("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=100_000)), "ab" * 40_001, "a" * 50_003):
        assert own.encoder.encode([text])[0].tolist() == reference.encode_ordinary(text)
    many = own.encoder.encode(["a" * 4_000_000])[0]
    assert own.decode(many, np.array([len(many)])) == [b"a" * 4_000_000]


def test_long_pieces(reference):
    own, pick = duck_bpe.Coder(RANKS), random.Random(3)
    for word in ["a" * 700, "ab" * 300, "".join(pick.choice("abcdetion") for _ in range(400)), " " * 900, "é" * 200]:
        assert own.encode_pieces([word])[0] == reference._encode_single_piece(word.encode())


def test_round_trip(spark, reference):
    texts = odd_texts()
    coded = duck_bpe.encode(docs(spark, texts), RANKS, decoded="decoded")
    got = {r.doc_id: r for r in coded.collect()}
    for i, text in enumerate(texts):
        assert got[i].ids == reference.encode_ordinary(text) and bytes(got[i].decoded) == text.encode()
    assert got[10_000].ids == [] and bytes(got[10_000].decoded) == b"" and None in got
    again = {r.doc_id: bytes(r.decoded) for r in duck_bpe.decode(coded.select("doc_id", "ids"), RANKS).collect()}
    assert again == {i: bytes(r.decoded) for i, r in got.items()}
    digest = {r.doc_id: r for r in duck_bpe.digests(coded).collect()}
    ids = reference.encode_ordinary(texts[0])
    assert digest[0].n_tokens == len(ids)
    assert digest[0].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert duck_bpe.encode(docs(spark, texts).limit(0), RANKS).count() == 0


def test_unknown_ids_are_errors():
    with pytest.raises(ValueError):
        duck_bpe.Coder(RANKS).decode(np.array([60_000]), np.array([1]))


def test_token_files(spark):
    texts = odd_texts()
    layout = token_files.Layout(sequence=16, rows=4, file_ids=500)
    manifest = token_files.write(docs(spark, texts), P.path("byte_bpe_50k.json"), 2, layout)
    crc = lambda ids: zlib.crc32(np.asarray(ids, "<u4").tobytes())
    got = sorted(token_files.read_documents(spark, manifest, crc, "crc long").collect(), key=lambda r: r.start)
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    at = 0
    for row, (i, text) in zip(got, [(None, "no id"), *enumerate(texts), (10_000, "")], strict=True):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        assert (row.doc_id, row.start, row.n_tokens, row.crc) == (i, at, len(ids), crc(ids))
        at += len(ids)
    files = manifest.collect()
    assert sum(f.n_ids for f in files) == at and len(files) > 2
    one = token_files.TokenFile(max(files, key=lambda f: f.n_ids).file)
    total, size = max(f.n_ids for f in files), layout.sequence
    whole = one.tokens(0, total)
    for i in range(-(-total // size)):
        assert one.mask(i).sum() == min(size, total - i * size)
        assert (one.ids(i)[one.mask(i)] == whole[i * size : (i + 1) * size]).all()
    with pytest.raises(ValueError):
        one.tokens(total, 10 * size)
    one.close()


def test_added_tokens(spark, tmp_path):
    """The query's ids are those of the library in its default state, also where a text holds an added token."""
    from vacantia.llm.queries import op10_token_files

    end = "<|endoftext|>"
    texts = [*odd_texts(100), f"a {end} b", end, end * 3, f" {end} \n {end}x", f"don{end}'t  {end[:-1]}", f"{'a b ' * 400}{end}  "]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in op10_token_files(spark, str(tmp_path)).collect()}
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for i, text in [*enumerate(texts), (None, "no id"), (10_000, "")]:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        assert got[i] == (len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())), text
    assert len(tokenizer.encode(end, add_special_tokens=False).ids) == 1


def test_ids_that_do_not_fit_are_errors(tmp_path):
    for wide, largest in ((False, 65_535), (True, 70_000)):
        place = str(tmp_path / f"wide-{wide}")
        writer = token_files.TokenWriter(place, token_files.Layout(sequence=4, rows=2, wide=wide))
        writer.add(np.array([1, largest], np.int64))
        if not wide:
            with pytest.raises(ValueError):
                writer.add(np.array([65_536], np.int64))
        writer.add(np.array([], np.int64))
        writer.close()
        assert token_files.TokenFile(place).reader.get_batch(0)["ids"].to_pylist()[0][:2] == [1, largest]


def test_no_documents_no_files(spark):
    manifest = token_files.write(docs(spark, []).limit(0), P.path("byte_bpe_50k.json"), 2)
    assert manifest.count() == 0 and token_files.read_documents(spark, manifest, len, "n long").count() == 0


def test_places(tmp_path):
    assert opened(str(tmp_path))[1] == str(tmp_path)
    assert opened(f"file://{tmp_path}")[1] == str(tmp_path) == opened(f"file:{tmp_path}")[1]
