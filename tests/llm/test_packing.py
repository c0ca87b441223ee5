import numpy as np
import pytest

from vellum.llm import packing
from vellum.llm.tokens import Encoder

ODD = [
    "İstanbul don't DON'T 'S a'b,.c <|startoftext|> <|STARTOFTEXT|> x\x1c\x85 é É, ́a ΣΑΣ, ß. K. 12,3. , . Å ﬁn Ⅷ ١٢ 一二, 한글. ǅ",
    "", "   \n", "x" * 3000 + " y.", "é,\tÉ.\r\n<|endoftext|>,", "a.. b,, ., 'll, it's.", "word " * 5000,
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


def test_ids_are_the_tokenizers(tokenizer):
    own = Encoder(packing.tokenizer_path())
    for _ in range(2):  # the second time from memory
        got = [np.frombuffer(x, "<u4").tolist() for x in own.encode([t.encode() for t in ODD])]
        assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in ODD]


@pytest.mark.parametrize("seed", range(8))
def test_pieces_fill_sequences_without_overlap(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 400, rng.integers(0, 60))
    pieces, n = packing.assign(lengths, capacity=128)
    for d, length in enumerate(lengths):
        own = sorted(p[1:3].tolist() for p in pieces if p[0] == d)
        assert [s for s, _ in own] == np.concatenate(([0], np.cumsum([k for _, k in own])[:-1])).tolist() and sum(k for _, k in own) == length
    for s in range(n):
        own = sorted((p[4], p[2]) for p in pieces if p[3] == s)
        assert own[0][0] == 0 and all(a + k == b for (a, k), (b, _) in zip(own, own[1:], strict=False)) and sum(k for _, k in own) <= 128
    assert n - int(lengths.sum()) / 128 < 1


def test_costs_are_balanced():
    lengths = np.concatenate((np.full(8, 100), np.full(64, 12)))
    pieces, n = packing.assign(lengths, capacity=256, quadratic=1 / 64)
    cost = np.zeros(n)
    np.add.at(cost, pieces[:, 3], pieces[:, 2] + pieces[:, 2] ** 2 / 64)
    assert cost.max() / cost.min() < 1.3


def test_documents_come_back_whole(spark, tokenizer):
    rows = [(i % 5 if i else None, t, "s", i) for i, t in enumerate([*ODD, None])] + [(2, "again", "s", 0), (2, "again", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string, length int")
    got = packing.pack(docs, packing.tokenizer_path()).collect()
    want = sorted(([i, *tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t, _, _ in rows), key=str)
    texts = {}
    by_place = sorted(got, key=lambda r: (str(r["doc_id"]), r["doc_tokens"], r["start"]))
    for r in by_place:
        assert len(r["ids"]) == 4 * r["length"]
    # pieces of one document share id and token count; equal documents come as often as they are there
    for r in by_place:
        texts.setdefault((r["doc_id"], r["doc_tokens"]), {}).setdefault(r["start"], []).append(np.frombuffer(r["ids"], "<u4").tolist())
    back = []
    for (i, _), parts in texts.items():
        for k in range(len(parts[0])):
            whole = []
            for s in sorted(parts):
                whole += sorted(parts[s])[k]
            back.append([i, *whole])
    assert sorted(back, key=str) == want


def test_an_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), packing.tokenizer_path()).count() == 0
