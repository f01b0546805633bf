import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from kilnwork.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


def texts():
    rng = random.Random(3)
    pools = ["abcdefghij  \n", "aàéßÉÄöÑ ñ", "'stdrevm l", "Σσς ΑΩ İI", "0123456789٣½", "#$%&*!.,<>|", "日本語 ไทย हिन्दी", "̧́eİ  \x1c\x85​", "🙂👍🏽"]
    out = ["", " ", "a" * 5000, "don't we'll I'M", "<|endoftext|>", "x<|startoftext|>y <|endoftext|><|endoftext|", "<|STARTOFTEXT|>", "AbAb" * 300, "ﬁ Å Ω"]
    for _ in range(400):
        pool = "".join(rng.sample(pools, rng.randint(1, 3)))
        out.append("".join(rng.choice(pool) for _ in range(rng.randint(1, 200))))
    return out


def test_same_as_library():
    library, v = Tokenizer.from_file(PATH), bpe.load(PATH)
    for t, (ids, shown) in zip(texts(), bpe.encode(texts(), v), strict=True):
        expected = library.encode(t, add_special_tokens=False).ids
        assert bpe.ids_of(ids) == expected, repr(t)
        assert shown == library.decode(expected, skip_special_tokens=False) == bpe.decode(expected, v)


def test_documents(spark):
    library = Tokenizer.from_file(PATH)
    rows = [(1, "Hello  world", 5), (1, "Hello  world", 5), (2, None, 6), (None, "", 7), (3, "x" * 30000, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digest_documents(docs, PATH).collect()}
    expected = set()
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        shown = library.decode(ids, skip_special_tokens=False)
        expected.add((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()))
    assert got == expected
    assert bpe.digest_documents(docs, PATH).count() == len(rows)
    full = bpe.encode_documents(docs, PATH).where("doc_id = 1").first()
    assert list(full.token_ids) == library.encode("Hello  world").ids and full.text == "Hello  world"
    assert bpe.encode_documents(docs.limit(0), PATH).count() == 0
