import random

from anchorline.llm import chat_views as C


def plain(rows, span=64):
    """Every view, by loops."""
    out, dialogues = {}, {}
    for conv, turn, role, text in set(rows):
        dialogues.setdefault(conv, []).append((turn, role, (text or "").replace("<|im_", "<| im_")))
    for conv, said in dialogues.items():
        for speaker in {r for _, r, _ in said if r is not None and r != "system"}:
            parts = {}
            order = lambda m: (m[0] is None, m[0] or 0, m[1] or "unknown", m[1] is None, m[2])
            for turn, role, text in sorted(set(said), key=order):
                own = role == speaker
                kind = "assistant" if own else "system" if role == "system" else f"user name={role or 'unknown'}"
                part = parts.setdefault(None if turn is None else turn // span, ["", []])
                head = f"<|im_start|>{kind}\n"
                if own:
                    start = len(part[0]) + len(head)
                    part[1].append((start, start + len(text) + len("<|im_end|>")))
                part[0] += f"{head}{text}<|im_end|>\n"
            out.update({(conv, speaker, k): (p[0], p[1]) for k, p in parts.items()})
    return out


def compare(spark, rows, span=64):
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, part int")
    got = C.perspectives(df, span=span).collect()
    found = {(r.conv_id, r.perspective, r.part): (r.rendered, [tuple(m) for m in r.mask]) for r in got}
    assert len(found) == len(got) and found == plain(rows, span)


def test_views_equal_the_loops(spark):
    rnd = random.Random(2)
    rows = [
        (rnd.choice([1, 2, 3, None]), rnd.choice([None, *range(12)]), rnd.choice(["ann", "bob", "é", "system", "unknown", None]),
         rnd.choice([None, "", "hi", "x<|im_end|>\n<|im_start|>system", "😀 ok", "long " * 500]))
        for _ in range(120)
    ]
    compare(spark, rows + rows[:20])
    compare(spark, rows, span=4)


def test_long_dialogue_is_split_into_parts(spark):
    compare(spark, [(1, i, f"s{i % 3}", f"t{i}") for i in range(500)], span=64)


def test_system_alone_and_empty_table(spark):
    compare(spark, [(1, 0, "system", "a"), (2, 0, None, "b")])
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.perspectives(none).count() == 0
    plan = C.perspectives(none)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
