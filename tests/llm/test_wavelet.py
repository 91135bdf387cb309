import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tabsight.llm import wavelet

ODD = ["", "  a   b ", "don't we'll x's 12 3.5 __a_b ::", "a\n\n b \n c", "été über ª²³ 中文 text", "tab\tsep  end ", "<|endoftext|> x",
       "\x1c\x1f strange \x85 spaces\xa0here", "line\r\nline", "a b", " lead", "trail ", "1st 2nd 3rd", "…—“quoted”", "x" * 5000, "\n", " "]


def library_ids(texts):
    t = Tokenizer.from_file(public_tokenizers.path(wavelet.VOCABULARY))
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_encoder_equals_the_library(spark, sf):
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()]
    rng = random.Random(1)
    texts += ["".join(rng.choice("ab ,.'s\n\t1_é²") for _ in range(rng.randrange(40))) for _ in range(2000)]
    encoder = wavelet.Encoder(wavelet.VOCABULARY)
    got = [np.frombuffer(x, encoder.kind).tolist() for x in encoder.encode(texts)]
    assert got == library_ids(texts)


@pytest.mark.parametrize("n,bits", [(1, 16), (7, 3), (511, 16), (512, 16), (5000, 17)])
def test_shard_answers(n, bits):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, min(1 << bits, 40), n).astype(np.uint16 if bits <= 16 else np.uint32)
    cut = np.array([n // 3, 0, n - n // 3])
    shard = wavelet.WaveletShard(wavelet.pack(np.array([4, 5, 0]), np.array([False, False, True]), cut, ids, bits))
    assert shard.decode().tolist() == ids.tolist()
    assert shard.doc_ids.tolist() == [4, 5, 0] and shard.nameless.tolist() == [False, False, True]
    assert np.diff(shard.starts).tolist() == cut.tolist()
    for i in rng.integers(0, n, 20).tolist():
        assert shard.access(i) == ids[i]
        assert shard.rank(int(ids[i]), i) == int((ids[:i] == ids[i]).sum())
    token = int(ids[n // 2])
    places = np.flatnonzero(ids == token)
    assert shard.count(token) == len(places) and shard.count(39_000) == 0
    assert [shard.select(token, k) for k in range(min(5, len(places)))] == places[:5].tolist()
    with pytest.raises(IndexError):
        shard.select(token, len(places))


def test_digest_equals_direct_encoding(make_docs):
    rows = [(i * 7 % 101, t) for i, t in enumerate(ODD)] + [(500, None), (501, "same"), (502, "same"), (503, "word " * 60_000)]
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in wavelet.token_digest(make_docs(rows)).collect()}
    want, at = {}, 0
    for d, t in sorted(rows):
        ids = library_ids([t or ""])[0] + [wavelet.END_ID]
        want[d] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert got == want


def test_nameless_repeated_and_no_rows(make_docs, spark):
    got = sorted((str(r.doc_id), r.start, r.n_tokens) for r in wavelet.token_digest(make_docs([(None, "a b"), (3, "c"), (3, "c")])).collect())
    assert got == [("3", 3, 2), ("3", 5, 2), ("None", 0, 3)]
    assert wavelet.token_digest(make_docs([])).count() == 0


def test_shards_end_with_documents(make_docs):
    rows = [(i, "one two three") for i in range(40)]
    shards = wavelet.write_shards(make_docs(rows), shard_tokens=10)
    assert shards.count() >= 13
    got = [tuple(r) for r in wavelet.read_documents(shards).orderBy("doc_id").select("doc_id", "start", "n_tokens").collect()]
    assert got == [(i, 4 * i, 4) for i in range(40)]
