import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from anchorline.llm import bpe
from tests.llm.plain import FOLDER, documents

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "It's <|endoftext|>THE café \x1cA\x1db  don't 12½ ²x Σας ΟΔΟΣ İx 日本語 مرحبا 🙂🙂 a​b ǅ ſs __a_b'll '",
    "<|startoftext|>x<|endoftext|>", "a" * 3000, "'" * 50 + "s" * 40, "̀abc é", "ﬁ Ⅷ ①", "<|endoftext|", "a\xa0b c　d",
]


def reference(text):
    tokenizer = Tokenizer.from_file(PATH)
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    return len(ids), " ".join(map(str, ids)), tokenizer.decode(ids, skip_special_tokens=False)


def test_equals_the_tokenizers_library(spark):
    texts = ODD + [r.text for r in documents(spark).limit(60).collect()]
    assert bpe.load(PATH).encode(texts) == [reference(t) for t in texts]


def test_one_word_tree_and_many_word_tree_agree():
    words = [w for w in "unbelievable thththereon donaudampfschiff a ab aaaaaaaaaaaaaaaaaaaaaaa".split()]
    loaded = bpe.load(PATH)
    for word in words:
        ids = [int(x) for x in loaded.encode([word])[0][1].split()]
        assert loaded._long_word(word.encode()) == ids


def test_merges_are_leftmost_and_lowest_first():
    assert bpe.merge_word(list("aaab"), {("a", "a"): 0, ("aa", "a"): 1}) == ["aaa", "b"]
    assert bpe.merge_word(list("abcb"), {("c", "b"): 0, ("a", "b"): 1}) == ["ab", "cb"]
    assert bpe.merge_word([], {}) == [] and bpe.merge_word(["a"], {}) == ["a"]


def test_rows_with_nulls_repeats_and_other_columns(spark):
    df = spark.createDataFrame(
        [(1, None, "x"), (1, "", "y"), (None, "The end", "z"), (2, "The end", "z"), (2, "The end", "z")],
        "doc_id long, text string, ids string",
    )
    got = bpe.encode_decode(df, PATH)
    assert got.columns == ["id", "n_tokens", "ids", "decoded"]
    want = reference("The end")
    assert sorted((r.id or 0, *r[1:]) for r in got.collect()) == [
        (0, *want), (1, 0, "", ""), (1, 0, "", ""), (2, *want), (2, *want),
    ]
    assert bpe.digests(df.limit(0), PATH).count() == 0


@pytest.mark.parametrize("name", ["op3_bpe_codec"])
def test_query_equals_the_library(spark, name):
    from anchorline.llm.registry import QUERIES

    got = {r.doc_id: r for r in QUERIES[name](spark, FOLDER).collect()}
    rows = documents(spark).collect()
    assert len(got) == len(rows)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for row in rows[:80]:
        n, ids, decoded = reference(row.text or "")
        assert tuple(got[row.doc_id]) == (row.doc_id, n, sha(ids), sha(decoded))
