import os
import random

import numpy as np
import pytest

from signloom.llm import tokens as K
from signloom.llm.queries import tokenizer_file

FILE = tokenizer_file()
pytestmark = pytest.mark.skipif(not os.path.exists(FILE), reason="no tokenizer files here")
tokenizers = pytest.importorskip("tokenizers")

TEXTS = [
    "", None, " ", "\n\n\t ", "Hello world, it's 2025!", "因為小荷學妹要尋找竹編包裹，所以考試日半夜先到白鷺溪口。", "café café ñ ﬁ", "👩‍🏫🙂👍🏽", "<|endoftext|> is text", "a" * 3000, "龍契士神覚醒ーション", "x\x1cy \x1f z", "１２３ 456", " 　 ",
    "don't I'LL we've", "тест проба", "\r\n a\r b", "名" * 2000, " lead and trail ",
]


@pytest.fixture(scope="module")
def public():
    t = tokenizers.Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_equals_the_public_tokenizer(spark, public):
    rng = random.Random(8)
    alphabet = "abcXYZ  \n.,'0189éßжδ的一是不了人我在有他🙂​"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 200))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, [0], 1) for i, t in enumerate(texts)] + [(None, "x", [0], 1)], "doc_id int, text string, ids array<int>, tokens int")
    got = {r["doc_id"]: r["ids"] for r in K.encode_texts(df, "doc_id", "text", FILE).collect()}
    want = public(texts)
    assert [i for i in range(len(texts)) if got[i] != want[i]] == []
    assert got[None] == public(["x"])[0]
    counts = {r["doc_id"]: r["tokens"] for r in K.count_tokens(df, "doc_id", "text", FILE).collect()}
    assert all(counts[i] == len(want[i]) for i in range(len(texts)))
    assert K.encode_texts(df.limit(0), "doc_id", "text", FILE).count() == 0


def test_repeated_rows_come_out_as_often(spark):
    df = spark.createDataFrame([(1, "a")] * 3, "doc_id int, text string")
    assert K.encode_texts(df, "doc_id", "text", FILE).count() == 3


def test_pieces_are_merged_whole_however_they_are_cut(public, monkeypatch):
    with open(FILE, "rb") as f:
        bpe = K.Bpe(f.read())
    monkeypatch.setattr(K, "REMEMBERED", 10)
    for _ in range(2):
        assert [np.frombuffer(p, np.int32).tolist() for p in bpe.encode(TEXTS)] == public(TEXTS)
    uncut = [x for w in K.WORDS.findall(TEXTS[5]) for x in bpe.merge(w.encode())]
    assert uncut == public([TEXTS[5]])[0]
