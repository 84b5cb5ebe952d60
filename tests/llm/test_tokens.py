import base64
import random

import pytest

from caseloom.llm import tokens

PATH = f"{tokens.VOCABULARIES}/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.serialise_model(tokens.read_ranks(PATH)))


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_and_round_trip(encoder, reference):
    rng = random.Random(0)
    texts = ["<|endoftext|> plain", "it's  we'LL\n\n\t x", "été 写真 🧿👩‍👩‍👧", "\x00\x07 \u00a0\u2009\u200b\ufeff", "a" * 5000, " " * 3000, "ﬀ ½ ² Ⅷ"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x3000), rng.randrange(0x1F300, 0x1FAFF), 32, 10])) for _ in range(200)).encode("utf-8", "replace").decode() for _ in range(300)]
    for t in texts:
        ids = encoder.encode(t)
        assert ids == reference.encode_ordinary(t) and encoder.decode(ids) == t


def test_known_pretokens_are_forgotten(reference):
    e = tokens.Encoder(tokens.serialise_model(tokens.read_ranks(PATH)), remembered=3)
    for t in ("one two three four", "five six", "one two seven", ""):
        assert e.encode(t) == reference.encode_ordinary(t)


def test_documents(spark, reference):
    rows = [(1, "some text"), (2, ""), (3, None), (3, None), (None, "x"), (4, "word " * 100_000)]
    df = spark.createDataFrame([(*r, [7]) for r in rows], "doc_id long, text string, ids array<int>")
    got = sorted(((r.doc_id, r.ids) for r in tokens.encode_documents(df, PATH).collect()), key=str)
    assert got == sorted(((d, reference.encode_ordinary(t or "")) for d, t in rows), key=str)
    assert tokens.encode_documents(df.limit(0), PATH).count() == 0
