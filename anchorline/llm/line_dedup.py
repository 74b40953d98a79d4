"""Repeated lines, by winnowing over line hashes.

The lines of a text are hashed, blank ones aside. Every shortest window of consecutive lines that together have at
least `words` words, from each line onwards and from each line back, selects its smallest hash as a fingerprint. Places
with an equal fingerprint are joined to the first of them: the smallest id, then text, then line. Each match is
extended line by line both ways, as far as the windows of the fingerprint reach; fingerprints beyond extend in
turn. A stretch that holds a whole window is a later repeated run and is deleted.

A window that the extension does not reach may still have a copy at another, later place of its fingerprint. Such windows
are joined once more, by fingerprint and content, to the first of them. That settles all of them: had an earlier copy
of such a window been reached from the first place, the window would have been reached as well.

Each line of a run with at least `words` words is in such a window within the run. So exactly the lines of runs that
occur at an earlier place too are deleted, whatever else their lines are shared with. Lines are compared by 128-bit hashes.

Lines are compared without white space at their ends; other differences count. Lines end with a line feed. Null
and empty texts have no lines and stay as they are. Rows equal in id and text are one document and get the same
result; null ids come last. Lines of fewer words stay unless their run is long enough. Other columns come through.
"""

from __future__ import annotations

import hashlib
from collections import deque
from itertools import takewhile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorline.llm.common import map_rows, text_of
from anchorline.session import stable

#: Bytes of the hash of one line.
SIZE = 16


def line_hashes(text: str) -> tuple[list[int], list[bytes], list[int]]:
    """Number, hash and word count of each line that is not blank."""
    places, hashes, words = [], [], []
    for i, line in enumerate(text.split("\n")):
        bare = line.strip()
        if bare:
            places.append(i)
            hashes.append(hashlib.blake2b(bare.encode(), digest_size=SIZE).digest())
            words.append(len(bare.split()))
    return places, hashes, words


def selected(hashes: list, words: list[int], least: int) -> list[tuple[int, int, int]]:
    """(fingerprint, first, last) of the shortest window with at least `least` words that ends at each line, as far as
    there is one. The fingerprint is the place of its smallest hash, the first among equals."""
    out, start, total = [], 0, 0
    queue: deque[int] = deque()  # places in the window whose hash is smaller than all later ones
    for end, count in enumerate(words):
        total += count
        while queue and hashes[queue[-1]] > hashes[end]:
            queue.pop()
        queue.append(end)
        while total - words[start] >= least:  # the shortest window that ends here
            total -= words[start]
            start += 1
            if queue[0] < start:
                queue.popleft()
        if total >= least:
            out.append((queue[0], start, end))
    return out


def fingerprints(hashes: list, words: list[int], least: int) -> list[int]:
    """Places of the smallest hash (the first among equals) of every window with at least `least` words."""
    return sorted({at for at, _, _ in selected(hashes, words, least)})


def text_fingerprints(text: str, least: int) -> list[tuple[int, bytes, bytes, bytes, list[tuple[int, int]]]]:
    """(place, hash, hashes of the lines before it, nearest first, and after it, windows) of each fingerprint. A
    window is the number of its lines before and after the fingerprint; the lines reach as far as the windows do."""
    _, hashes, words = line_hashes(text)
    end, windows = len(words) - 1, {}
    for at, first, last in selected(hashes, words, least):
        windows[first, last] = at
    for at, first, last in selected(hashes[::-1], words[::-1], least):
        windows.setdefault((end - last, end - first), end - at)
    of: dict[int, list[tuple[int, int]]] = {}
    for (first, last), at in windows.items():
        of.setdefault(at, []).append((at - first, last - at))
    return [
        (at, hashes[at], b"".join(hashes[at - max(x for x, _ in found):at][::-1]),
         b"".join(hashes[at + 1:at + 1 + max(y for _, y in found)]), found)
        for at, found in of.items()
    ]


def in_common(a: bytes, b: bytes) -> int:
    """How many hashes two rows of hashes have in common from their start on."""
    starts = range(0, min(len(a), len(b)), SIZE)
    return sum(1 for _ in takewhile(lambda i: a[i:i + SIZE] == b[i:i + SIZE], starts))


def extended(
    before: bytes, after: bytes, other_before: bytes, other_after: bytes, windows: list[tuple[int, int]]
) -> tuple[tuple[int, int] | None, list[tuple[int, int]]]:
    """How far a match of two fingerprints goes before and after them, None if it holds no window; and the windows
    that it does not hold."""
    left, right = in_common(before, other_before), in_common(after, other_after)
    beyond = [(x, y) for x, y in windows if x > left or y > right]
    return (left, right) if len(beyond) < len(windows) else None, beyond


def content_key(before: bytes, own: bytes, after: bytes, window: tuple[int, int]) -> bytes:
    """Hash of all lines of a window and of the place of its fingerprint."""
    x, y = window
    whole = x.to_bytes(8, "little") + own + before[:SIZE * x] + after[:SIZE * y]
    return hashlib.blake2b(whole, digest_size=SIZE).digest()


def _selected(keyed: DataFrame, words: int) -> DataFrame:
    def rows(part: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("id", "text_key", "line", "hash", "before", "after", "windows")}
        for key, ident, text in zip(part["text_key"], part["id"], part["text"], strict=True):
            for at, own, before, after, windows in text_fingerprints(text, words):
                made = [{"before": x, "after": y} for x, y in windows]
                for name, value in zip(out, (ident, key, at, own, before, after, made), strict=True):
                    out[name].append(value)
        return out

    kind = keyed.schema["id"].dataType.simpleString()
    schema = (
        f"id {kind}, text_key long, line int, hash binary, before binary, after binary, "
        "windows array<struct<before:int,after:int>>"
    )
    return map_rows(keyed, rows, schema).dropDuplicates(["id", "text_key", "line"])


def _joined_to_first(places: DataFrame, key: str, *carried: str) -> DataFrame:
    """Places joined to the first place of equal key, without the first ones themselves. `at` is the first place with
    its columns `carried`; `source` is equal for all places of one run that meet the same run."""
    place = F.struct(F.col("id").isNull().alias("none"), "id", "text_key", "line", *carried)
    first = places.groupBy(key).agg(F.min(place).alias("at"), F.count("*").alias("n")).where("n > 1")
    own = F.col("id").eqNullSafe(F.col("at.id")) & (F.col("text_key") == F.col("at.text_key"))
    source = F.xxhash64("at.id", "at.text_key", F.col("at.line") - F.col("line"))
    return (
        places.join(first.select(key, "at"), key).where(~(own & (F.col("line") == F.col("at.line"))))
        .withColumn("source", source)
    )


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_of(text_col)
    return docs.select(docs[id_col].alias("id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 10) -> DataFrame:
    """(id, text_key, matches): for each text with repeated lines, the stretches (first, last) of its lines that equal
    lines at an earlier place; `source` is equal where that place is in the same run. Blank lines are not counted."""
    chosen = stable(_selected(_keyed(docs, id_col, text_col), words))
    kind = chosen.schema["id"].dataType.simpleString()
    met = _joined_to_first(chosen, "hash", "before", "after").select(
        "id", "text_key", "line", "hash", "before", "after", "windows", "source",
        F.col("at.before").alias("other_before"), F.col("at.after").alias("other_after"),
    )

    def extend(part: dict[str, list]) -> dict[str, list]:
        reach, beyond = [], []
        for own, before, after, other_before, other_after, windows in zip(
            *(part[k] for k in ("hash", "before", "after", "other_before", "other_after", "windows")), strict=True
        ):
            pairs = [(w["before"], w["after"]) for w in windows]
            held, rest = extended(before, after, other_before, other_after, pairs)
            reach.append(held and {"before": held[0], "after": held[1]})
            beyond.append([
                {"key": content_key(before, own, after, w), "before": w[0], "after": w[1]} for w in rest
            ])
        return {k: part[k] for k in ("id", "text_key", "line", "source")} | {"reach": reach, "beyond": beyond}

    grown = stable(map_rows(met, extend, (
        f"id {kind}, text_key long, line int, source long, reach struct<before:int,after:int>, "
        "beyond array<struct<key:binary,before:int,after:int>>"
    )))
    match = lambda of: F.struct(
        (F.col("line") - F.col(f"{of}.before")).alias("first"), (F.col("line") + F.col(f"{of}.after")).alias("last"),
        "source",
    ).alias("match")
    reached = grown.where("reach is not null").select("id", "text_key", match("reach"))
    rest = grown.select("id", "text_key", "line", F.explode("beyond").alias("window")).withColumn("key", F.col("window.key"))
    again = _joined_to_first(rest, "key").select("id", "text_key", match("window"))
    return reached.unionAll(again).groupBy("id", "text_key").agg(F.collect_set("match").alias("matches"))


def without_lines(text: str, matches: list[dict]) -> tuple[str, int]:
    """The text without the runs of matched lines, and the number of deleted lines. Blank lines within a run go
    with it."""
    places, _, _ = line_hashes(text)
    runs: list[list[int]] = []
    for match in sorted(matches, key=lambda m: (m["source"], m["first"])):
        if runs and runs[-1][0] == match["source"] and match["first"] <= runs[-1][2] + 1:
            runs[-1][2] = max(runs[-1][2], match["last"])
        else:
            runs.append([match["source"], match["first"], match["last"]])
    gone = {i for _, first, last in runs for i in range(first, last + 1)}
    drop = {i for _, first, last in runs for i in range(places[first], places[last] + 1)}
    return "\n".join([line for i, line in enumerate(text.split("\n")) if i not in drop]), len(gone)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 10) -> DataFrame:
    """`docs` with later repeated runs deleted from the text, the number of deleted lines (`deleted`) and of lines
    left (`left`), blank ones not counted. Texts without a deletion come through as they are, null included."""
    found = repeated_lines(docs, id_col, text_col, words).withColumnsRenamed({"id": "__id", "text_key": "__key"})
    columns = [f for f in docs.schema.fields if f.name not in ("deleted", "left")]
    keyed = docs.select([f"`{f.name}`" for f in columns]).withColumn("__own", F.xxhash64(text_of(text_col)))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__key"))
    joined = keyed.join(found, same, "left").drop("__id", "__key", "__own")

    def rows(part: dict[str, list]) -> dict[str, list]:
        made, gone, left = [], [], []
        for text, matches in zip(part[text_col], part["matches"], strict=True):
            if matches:
                text, n = without_lines(text, matches)
            else:
                n = 0
            made.append(text), gone.append(n), left.append(sum(1 for x in (text or "").split("\n") if x.strip()))
        return {f.name: part[f.name] for f in columns} | {text_col: made, "deleted": gone, "left": left}

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in columns)
    return map_rows(joined, rows, f"{schema}deleted long, left long")
