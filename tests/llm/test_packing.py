import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from anchorline.llm import byte_tokens, packing
from anchorline.llm.registry import QUERIES
from tests.llm.plain import FOLDER, documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "It's <|endoftext|>THE café \x1cA\x1db  don't 12½ ²x Σας \n x\n\n  y  ", "<|endoftext|>x<|endoftext|>",
    "a" * 3000, "a <|endoftext|> b  <|endoftext|>", "x\xa0 y", " lead", "  lead\n z", "tail \n", "a\n b\t c",
]


def ids_of(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], np.uint32) for t in texts]


def padding(rows, docs):
    """Check every piece; the number of padded tokens."""
    ids = dict(zip((i for i, _ in docs), ids_of([t for _, t in docs]), strict=True))
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(ids)
    for doc, found in pieces.items():
        at = 0
        for r in sorted(found, key=lambda r: r.start):
            part = ids[doc][at:at + r.length]
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids[doc]), zlib.crc32(part.tobytes()))
            at += r.length
        assert at == len(ids[doc])
    padded = 0
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        padded += 0 if at & (at - 1) == 0 else 1024 - at
    return padded


def test_ids_equal_the_tokenizers_library(spark):
    texts = ODD + [r.text for r in documents(spark).limit(60).collect()]
    want = [ids[:-1].tobytes() for ids in ids_of(texts)]
    assert [byte_tokens.load(PATH).ids(t) for t in texts] == want


@pytest.mark.parametrize("texts", [
    ["x y z"] * 300, ["hello " * 300] * 20, [None, "", "a"], ODD, ["word " * 1023, "word " * 1024, "word " * 2047],
])
def test_every_token_is_in_one_gapless_piece(spark, texts):
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert padding(packing.pack(df, PATH).collect(), docs) == 0


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in documents(spark).collect()]
    assert padding(QUERIES["op9_packing"](spark, FOLDER).collect(), docs) == 0


def test_empty_table_repeats_null_ids_and_clashing_columns(spark):
    df = spark.createDataFrame(
        [(None, "a b", 1), (None, "a b", 2), (7, "a b", 3)], "doc_id long, text string, sequence_id long"
    )
    got = packing.pack(df, PATH).collect()
    each = int(got[0].doc_tokens)
    assert sum(r.length for r in got if r.doc_id is None) == 2 * each and sum(r.length for r in got) == 3 * each
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_closest_fill_equals_trying_all():
    rnd = random.Random(3)
    for _ in range(200):
        counts = {rnd.randint(1, 12): rnd.randint(0, 3) for _ in range(4)}
        room, sums = rnd.randint(1, 30), {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        fill = packing.closest_fill(counts, room)
        assert all(fill[n] <= counts[n] for n in fill)
        assert sum(n * c for n, c in fill.items()) == max(s for s in sums if s <= room)


def placed(counts, window):
    """Check where each remainder goes; the plan."""
    plan = packing.plan_windows(counts, window)
    length = np.array([n for n, c in counts.items() for _ in range(c)], np.int64)
    index = np.array([i for c in counts.values() for i in range(c)], np.int64)
    pieces, windows = {}, {}
    for row, start, size, sequence, offset in zip(*packing.placer(plan)(length, index), strict=True):
        pieces.setdefault(row, []).append((start, size))
        windows.setdefault(sequence, []).append((offset, size))
    assert set(pieces) == set(range(len(length))) and set(windows) == set(range(plan.sequences))
    for total, found in [(length[r], p) for r, p in pieces.items()] + [(None, w) for w in windows.values()]:
        at = 0
        for begin, size in sorted(found):
            assert begin == at and size > 0
            at += size
        assert at == total if total is not None else at == window or at & (at - 1) == 0
    return plan


def test_plans_place_each_token_once():
    rnd = random.Random(5)
    for _ in range(300):
        placed({rnd.randint(1, 15): rnd.randint(0, 6) for _ in range(5)}, 16)
    for counts in ({}, {600: 5000}, {1023: 900, 700: 3}, {n: rnd.randint(0, 3) for n in range(1, 1024)}):
        placed(counts, 1024)


def test_only_slack_is_cut():
    assert placed({10: 3, 6: 3, 4: 4}, 16).cut() == 0  # 10 + 6 three times, and one window of fours
    first = [(u.size, u.start, u.offset) for u in placed({10: 3}, 16).uses if u.sequence == 0]
    assert first == [(10, 0, 0), (6, 0, 10)]  # a whole one, and six tokens of another to close the slack


def test_closest_fills_hold_nearly_all_tokens(spark):
    counts = {}
    for ids in ids_of([r.text for r in documents(spark).collect()]):
        rest = len(ids) % 1024
        counts[rest] = counts.get(rest, 0) + bool(rest)
    plan, total = placed(counts, 1024), sum(n * c for n, c in counts.items())
    closing = sum(u.count * u.size for u in plan.uses if u.offset and u.start + u.size < u.length)
    assert closing < 0.1 * total
