import hashlib
import itertools
import random
import re
import zlib

from anchorline.llm import turn_repair as T
from anchorline.llm.registry import QUERIES

PATTERN = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """(cost, audit, repaired rows) by trying all edits; `rows` are (role, text, fault)."""
    def tries(i, made):
        """All (cost, audit, rows) that edit the rows from the i-th on; at most two inserts in one place."""
        for n in range(3):
            for roles in itertools.product(("user", "assistant"), repeat=n):
                extra = [(r, "") for r in roles]
                if not PATTERN.match("".join(r[0] for r, _ in made + extra)):
                    continue
                if i == len(rows):
                    if PATTERN.fullmatch("".join(r[:1] for r, _ in made + extra)):
                        yield 5 * n, "I" * n, extra
                    continue
                role, text, fault = rows[i]
                ways = [(2, "D", [])]
                if fault not in ("blank", "duplicate"):
                    late = 5 * (fault == "truncated")
                    ways += [(late, "K", [(role, text)])] * (role[:1] in ("s", "u", "a") and role != "")
                    ways += [(1 + late, "R", [(r, text)]) for r in ("user", "assistant")]
                for cost, edit, kept in ways:
                    initials = "".join(r[0] for r, _ in made + extra + kept)
                    if not re.fullmatch(r"s?(ua)*u?", initials):
                        continue
                    for more, audit, rest in tries(i + 1, made + extra + kept):
                        yield 5 * n + cost + more, "I" * n + edit + audit, extra + kept + rest
    return min(tries(0, []), key=lambda x: x[:2])


def by_strings(rows):
    """The same from one best (cost, audit, rows) for each last initial, message by message."""
    best = {"": (0, "", [])}

    def inserted():
        for last, (cost, audit, made) in list(best.items()):
            for n in range(4):
                yield last, cost, audit, made
                last = "a" if last == "u" else "u"
                cost, audit, made = cost + 5, audit + "I", [*made, ("user" if last == "u" else "assistant", "")]

    for role, text, fault in rows:
        found = []
        for last, cost, audit, made in inserted():
            found.append((last, (cost + 2, audit + "D", made)))
            if fault not in ("blank", "duplicate"):
                cost += 5 * (fault == "truncated")
                due = "a" if last == "u" else "u"
                found.append((due, (cost + 1, audit + "R", [*made, ("user" if due == "u" else "assistant", text)])))
                if role[:1] == due or role[:1] == "s" and not made:
                    found.append((role[0], (cost, audit + "K", [*made, (role, text)])))
        best = {}
        for last, way in found:
            best[last] = min(best.get(last, way), way, key=lambda x: x[:2])
    return min(((c, a, m) for last, c, a, m in inserted() if last in ("", "a")), key=lambda x: x[:2])


def faults(said):
    seen, out = set(), []
    for role, text in said:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def plain(rows):
    """What the query returns, by loops over messages and strings."""
    out, said = {}, {}
    for conv, turn, role, text in rows:
        said.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code:
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            said[conv] += [(turn is not None, turn or 0, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    for conv, kept in said.items():
        kept.sort()
        marked = faults([r[2:] for r in kept])
        turns = [r[1] for r in kept if r[0]]
        cost, audit, made = by_strings(marked)
        pairs = zip(marked, marked[1:], strict=False)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(sum(m[2] == f for m in marked) for f in ("blank", "duplicate", "truncated")),
            sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in pairs), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest(),
        )
    return out


def byte(role, fault):
    return {"s": 1, "u": 2, "a": 3}.get(role[:1], 0) | {"blank": 4, "duplicate": 8, "truncated": 16}.get(fault, 0)


def test_audit_is_the_first_of_all_cheapest_edits():
    rnd = random.Random(3)
    for _ in range(150):
        rows = [(rnd.choice(["system", "user", "user", "assistant", "assistant", "tool"]), f"t{i}",
                 rnd.choice(["", "", "", "blank", "duplicate", "truncated"])) for i in range(rnd.randint(0, 3))]
        cost, audit, made = cheapest(rows)
        assert by_strings(rows) == (cost, audit, made)
        assert T.repair(bytes(byte(r, f) for r, _, f in rows)) == (cost, audit)
        assert [m[1:] for m in T.edited(audit, iter([r[:2] for r in rows]))] == made


def by_greedy(kinds):
    """The first cheapest audit from costs of all suffixes: whichever least letter still leads to the least cost."""
    costs = [[len(c) * 5 for c in T.CLOSING]]
    for k in reversed(kinds):
        row = [10 ** 9] * 4
        for a, b, cost, _ in T.steps(k):
            row[a] = min(row[a], cost + costs[-1][b])
        costs.append(row)
    costs.reverse()
    state, out = 0, []
    for i, k in enumerate(kinds):
        ways = [(edits, b) for a, b, cost, edits in T.steps(k) if a == state and cost + costs[i + 1][b] == costs[i][a]]
        edits, state = min(ways)
        out.append(edits)
    return costs[0][0], "".join(out) + T.CLOSING[state]


def test_long_conversations_equal_the_costs_of_all_suffixes():
    rnd = random.Random(4)
    for n in (1, 2, 3, 17, 64, 501, 3000):
        kinds = bytes(rnd.choice([0, 1, 2, 2, 3, 3, 18, 19, 4, 10]) for _ in range(n))
        assert T.repair(kinds) == by_greedy(kinds)


def test_query_equals_loops(spark, tmp_path):
    rnd = random.Random(6)
    texts = [None, "", " \t", "Yes.", "no", "Why?! ", "é。", "x\n", "Yes."]
    rows = []
    for conv in [None, *range(70)]:
        turns = rnd.sample(range(8), rnd.randint(1, 5))
        rows += [(conv, rnd.choice([t, t, t, None]), rnd.choice(["user", "assistant", "system", None, "", "u2"]), rnd.choice(texts)) for t in turns]
    rows += rows[:5]
    schema = "conv_id long, turn long, role string, text string, kind string, place int"
    spark.createDataFrame([(*r, "x", 0) for r in rows], schema).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op12_turn_repair"](spark, str(tmp_path)).collect()
    found = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}
    assert len(found) == len(got) and found == plain(rows)


def test_empty_table_and_long_texts(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert QUERIES["op12_turn_repair"](spark, f"{tmp_path}/none").count() == 0
    rows = [(5, t, "user" if t % 2 == 0 else "assistant", "word " * 50_000 + f"{t}.") for t in range(4)]
    left = T.repaired(df := T.typed(spark.createDataFrame(rows, schema)), T.audits(df)).orderBy("place").collect()
    assert [(r.edit, r.role, r.text) for r in left] == [("K", r[2], r[3]) for r in rows]
