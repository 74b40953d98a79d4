"""Near-duplicate texts by order MinHash.

A text is the sequence of its runs of five words, each labelled with how often it has occurred before in the
text. A sketch holds the `size` labelled runs with the smallest hashes, in the order of the text; two texts share it
with a chance that falls with each edit and with each change of order. Texts that share one of `tables` sketches are
candidates. Sketches of short texts hold most of the text, so two of them rarely share one: texts of up to `short` runs
are also candidates where they share one of their rarest runs, as many as similar texts cannot all differ in (prefix
filter), which misses no pair. A candidate pair is verified by a banded alignment: the longest common subsequence of the two sequences
within the band that the similarity allows. The similarity is aligned / (a + b - aligned); 0.8 and more is a link.

Pairs within a group of candidates are not listed. Each group compares its members with one centre, the text whose
sketches are the most common. Groups whose members are not all linked then are compared in blocks: a block counts the runs that
its texts share, all at once, and aligns a pair only if these are enough and the two are not linked yet, in the block or
before. It hands back as many links as join its texts, never all pairs. At first each member takes part in one block of
its group; what is still not linked to the centre's class then meets all other members of its group. So every pair of
candidates has been compared, or is in one class already.

Words are runs of word characters, in lower case. A text of fewer than five words is one run; texts without words
(null, empty, marks only) link with nothing. Equal texts are one class whatever their ids, and are compared once;
repeated rows and null ids are such copies. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorline.llm.common import map_rows, text_of
from anchorline.llm.graph import components
from anchorline.llm.vectors import groups
from anchorline.session import stable

WORD = re.compile(r"\w+")
RUN = 5
#: Members of a centre that get its runs together; texts of a block; runs whose places are counted at once.
MEMBERS, BLOCK, COLUMNS = 64, 256, 8192


def mix(x: np.ndarray) -> np.ndarray:
    """A well spread 64-bit hash of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word -> 64-bit hash; forgets everything when it is full."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        made = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        self[word] = made
        return made


_HASHES = WordHashes()


def labelled_runs(text: str) -> np.ndarray:
    """Hashes of the text's runs of words, each with the number of its occurrence."""
    words = np.array([_HASHES[w] for w in WORD.findall(text.lower())], np.uint64)
    if not len(words):
        return words
    runs = np.zeros(max(1, len(words) - RUN + 1), np.uint64)
    for i in range(min(RUN, len(words))):
        runs = mix(runs + words[i:i + len(runs)] + np.uint64(i + 1))
    order = np.argsort(runs, kind="stable")
    ordered = runs[order]
    first = np.r_[True, ordered[1:] != ordered[:-1]]
    if first.all():
        return runs
    place = np.arange(len(runs))
    nth = np.empty(len(runs), np.uint64)
    nth[order] = place - np.maximum.accumulate(np.where(first, place, 0))
    return np.where(nth > 0, mix(runs + nth * np.uint64(0x9E3779B97F4A7C15)), runs)


def sketches(runs: np.ndarray, tables: int, size: int) -> np.ndarray:
    """One number for each sketch: the hash of its runs in the order of the text."""
    seeds = mix(np.arange(1, tables + 1, dtype=np.uint64))
    size = min(size, len(runs))
    hashed = (runs[None, :] ^ seeds[:, None]) * np.uint64(0x9E3779B97F4A7C15)
    hashed ^= hashed >> np.uint64(32)
    chosen = np.argpartition(hashed, size - 1, axis=1)[:, :size] if size < len(runs) else np.tile(
        np.arange(len(runs)), (tables, 1)
    )
    chosen.sort(axis=1)
    out = seeds
    for i in range(size):
        out = mix(out + runs[chosen[:, i]])
    return out.view(np.int64)


def aligned(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Similarity of two sequences of distinct runs, 0 if it is below `least`. Only places that differ by no more
    than the runs that a similar pair may leave out can be aligned; there the longest increasing chain counts."""
    total = len(a) + len(b)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(i) or len(i) < least * (total - len(i)):
        return 0.0
    band = total * (1 - least) / (1 + least) + 1e-9  # a whole number of places may come out just below it
    near = np.abs(i - j) <= band
    chain = j[near][np.argsort(i[near], kind="stable")]
    if len(chain) and (np.diff(chain) <= 0).any():
        ends: list[int] = []
        for x in chain.tolist():
            at = bisect_left(ends, x)
            ends[at:at + 1] = [x]
        length = len(ends)
    else:
        length = len(chain)
    made = length / (total - length) if length else 0.0
    return made if made >= least else 0.0


def _sketched(docs: DataFrame, id_col: str, text_col: str, tables: int, size: int, short: int) -> DataFrame:
    """One row for each different text: (text_key, first_id, keys, runs); `runs` of short texts only."""
    def rows(part: dict[str, list]) -> dict[str, list]:
        keys: list[list[int] | None] = []
        few: list[list[int] | None] = []
        for text in part["text"]:
            runs = labelled_runs(text)
            keys.append(sketches(runs, tables, size).tolist() if len(runs) else None)
            few.append(runs.view(np.int64).tolist() if 0 < len(runs) <= short else None)
        return {"text_key": part["text_key"], "id": part["id"], "keys": keys, "runs": few}

    kind = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(docs[id_col].alias("id"), text_of(text_col).alias("text")).withColumn("text_key", F.md5("text"))
    made = map_rows(keyed, rows, f"text_key string, id {kind}, keys array<long>, runs array<long>")
    return made.groupBy("text_key").agg(
        F.min("id").alias("first_id"), F.first("keys").alias("keys"), F.first("runs").alias("runs")
    )


def _rare_runs(known: DataFrame, least: float) -> DataFrame:
    """(no, key) for those of the rarest runs of each short text that another short text has too. Of n runs the first
    n - least * n + 1, in one order for all texts, hold one of the first runs of every similar text."""
    runs = stable(known.where("runs is not null").select("no", F.size("runs").alias("of"), F.explode("runs").alias("run")))
    counts = runs.groupBy("run").agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("n", "run")))
    sizes = F.col("of") - F.ceil(F.col("of") * least - 1e-9).cast("int") + 1
    rarest = runs.join(counts, "run").groupBy("no", "of").agg(ordered.alias("runs"))
    return (
        rarest.select("no", F.explode(F.slice("runs", F.lit(1), sizes)).alias("rare")).where("rare.n > 1")
        .select("no", F.xxhash64("rare.run").alias("key"))
    )


def _verify(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """`pairs` (centre, member) that are similar. A centre's runs go once to every few members of it, and rows of
    a group follow each other, so that a task holds one pair at a time."""
    sized = pairs.join(pairs.groupBy("centre").agg(F.count("*").alias("n")), "centre")
    chunk = F.pmod(F.xxhash64("member"), F.ceil(F.col("n") / MEMBERS).cast("int")).alias("chunk")
    dealt = sized.select("centre", chunk, "member")
    rows = dealt.join(texts.withColumnRenamed("no", "member"), "member").select("centre", "chunk", "member", "runs")
    heads = dealt.select("centre", "chunk").distinct().join(texts.withColumnRenamed("no", "centre"), "centre")
    rows = heads.select("centre", "chunk", F.lit(None).cast("long").alias("member"), "runs").unionAll(rows)
    rows = rows.repartition("centre", "chunk").sortWithinPartitions("centre", "chunk", F.col("member").asc_nulls_first())

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, np.uint64)
        for part in parts:
            centres, members = [], []
            for centre, member, runs in zip(
                part["centre"].to_pylist(), part["member"].to_pylist(), part["runs"].to_pylist(), strict=True
            ):
                runs = np.frombuffer(runs, np.uint64)
                if member is None:
                    head = runs
                elif aligned(head, runs, least):
                    centres.append(centre), members.append(member)
            yield pa.RecordBatch.from_pydict({
                "centre": pa.array(centres, pa.int64()), "member": pa.array(members, pa.int64())
            })

    return rows.mapInArrow(compare, "centre long, member long")


def shared_runs(texts: list[np.ndarray]) -> np.ndarray:
    """How many runs each two texts share: products of the marks of a bounded number of runs at a time."""
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    runs, place, times = np.unique(np.concatenate(texts), return_inverse=True, return_counts=True)
    common = times > 1  # a run of one text is shared by none
    column = np.cumsum(common) - 1
    owner, place = owner[common[place]], column[place[common[place]]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    shared = np.zeros((len(texts), len(texts)), np.float32)
    for start in range(0, int(common.sum()), COLUMNS):
        low, high = np.searchsorted(place, [start, start + COLUMNS])
        marks = np.zeros((len(texts), COLUMNS), np.float32)
        marks[owner[low:high], place[low:high] - start] = 1
        shared += marks @ marks.T
    return shared


def joined_pairs(
    no: np.ndarray, root: np.ndarray, apart: np.ndarray, texts: list[np.ndarray], least: float
) -> list[tuple[int, int]]:
    """Links that join the texts of a block: pairs in different classes, one of them apart, that are similar."""
    own: dict[int, int] = {}

    def find(x: int) -> int:
        while own.setdefault(x, x) != x:
            x = own[x] = own[own[x]]
        return x

    sizes = np.array([len(t) for t in texts], np.float32)
    shared = shared_runs(texts)
    total = sizes[:, None] + sizes[None, :] - shared
    fits = (shared >= least * total - 1e-3) & apart[:, None] & (root[:, None] != root[None, :])
    a, b = np.nonzero(fits)
    best = np.argsort(-(shared[a, b] / total[a, b]), kind="stable")
    out = []
    for i, j in zip(a[best].tolist(), b[best].tolist(), strict=True):
        x, y = find(int(root[i])), find(int(root[j]))
        if x != y and aligned(texts[i], texts[j], least):
            own[max(x, y)] = min(x, y)
            out.append((int(no[i]), int(no[j])))
    return out


def _blocks(rows: DataFrame, texts: DataFrame, least: float, whole: bool) -> DataFrame:
    """Links (a, b) between different classes of the groups `rows` (key, no, root, apart). Each group is cut into blocks;
    with `whole`, blocks of rows that are apart meet all blocks of their group, else each block is by itself."""
    hashed = F.xxhash64("no", F.lit(int(whole)))
    if whole:
        sizes = rows.groupBy("key").agg(
            F.ceil(F.sum(F.col("apart").cast("int")) / BLOCK).cast("int").alias("asks"),
            F.ceil(F.sum((~F.col("apart")).cast("int")) / BLOCK).cast("int").alias("rest"),
        )
        rest = F.col("asks") + F.pmod(hashed, F.col("rest"))
        own = F.when(F.col("apart"), F.pmod(hashed, F.col("asks"))).otherwise(rest)
        last = F.col("asks") - 1 + F.when(F.col("apart"), F.col("rest")).otherwise(0)
        other = F.explode(F.sequence(F.lit(0), last))
    else:
        sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("asks"))
        own = F.pmod(hashed, F.col("asks"))
        other = F.col("own")
    dealt = (
        rows.join(sizes, "key").withColumn("own", own.cast("int")).withColumn("other", other)
        .select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("block"), "no", "root", "apart")
        .join(texts, "no").repartition("block").sortWithinPartitions("block")
    )

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups(parts, "block"):
            column = lambda name: part[name].to_numpy(zero_copy_only=False)  # noqa: B023, E731
            texts = [np.frombuffer(x, np.uint64) for x in part["runs"].to_pylist()]
            links = joined_pairs(column("no"), column("root"), column("apart"), texts, least)
            if links:
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.mapInArrow(compare, "a long, b long")


def _unlinked(grouped: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (key, no, root, apart) of the groups whose members are not all linked yet; those that are not in their
    centre's class are `apart`. Centres themselves are left out: every member of theirs has been compared with them. Of
    groups with the same members one is enough."""
    of = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
    rows = (
        grouped.join(of("member"), "member", "left").join(of("centre"), "centre", "left")
        .select("key", F.col("member").alias("no"), F.coalesce("member_root", "member").alias("root"),
                F.coalesce("centre_root", "centre").alias("to"))
    )
    members = F.struct(F.count("*"), F.bit_xor(F.xxhash64("no")), F.bit_xor(F.xxhash64("no", "no")), F.min("to"))
    split = (
        rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), members.alias("members"))
        .where("low <> high").groupBy("members").agg(F.min("key").alias("key"))
    )
    return rows.join(split.select("key"), "key").select("key", "no", "root", (F.col("root") != F.col("to")).alias("apart"))


def find_classes(docs: DataFrame, known: DataFrame, text_col: str, least: float) -> DataFrame:
    """(node, root): the smallest number of the class of each text that is similar to another one."""
    rows = known.where("keys is not null").select("no", F.explode(F.array_distinct("keys")).alias("key"))
    rows = rows.unionAll(_rare_runs(known, least))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = stable(rows.join(sizes, "key"))
    common = rows.groupBy("no").agg(F.sum("n").alias("weight"))
    best = rows.join(common, "no").groupBy("key").agg(F.max(F.struct("weight", "no")).alias("best"))
    grouped = stable(
        rows.join(best.select("key", F.col("best.no").alias("centre")), "key").where("no <> centre")
        .select("key", "centre", F.col("no").alias("member"))
    )
    pairs = grouped.select("centre", "member").distinct()
    wanted = known.join(pairs.select(F.explode(F.array("centre", "member")).alias("no")).distinct(), "no")
    keyed = docs.select(F.md5(text_of(text_col)).alias("text_key"), text_of(text_col).alias("text"))
    given = keyed.join(wanted.select("text_key", "no"), "text_key").groupBy("no").agg(F.first("text").alias("text"))
    texts = stable(map_rows(given, lambda part: {
        "no": part["no"], "runs": [labelled_runs(text).tobytes() for text in part["text"]]
    }, "no long, runs binary"))
    links = stable(_verify(pairs, texts, least))
    roots = stable(components(links.select(F.col("centre").alias("a"), F.col("member").alias("b"))))
    for whole in (False, True):  # each member in one block of its group, then against all of its group
        more = stable(_blocks(_unlinked(grouped, roots), texts, least, whole))
        if not more.isEmpty():
            roots = stable(components(more.unionAll(roots.select("node", "root"))))  # the classes so far are stars
    return roots


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, tables: int = 24, size: int = 6,
    short: int = 50,
) -> DataFrame:
    """One row for each row of `docs`: (id, text_key, class_id, kept, repeats). `class_id` is the smallest id of the
    class. `kept` marks the rows with that id, among several texts of that id those with the smallest text key; then
    `repeats`, the number of rows equal in id and text, is above 1 only for rows given more than once."""
    known = stable(
        _sketched(docs, id_col, text_col, tables, size, short).withColumn("no", F.monotonically_increasing_id())
    )
    roots = find_classes(docs, known, text_col, least)
    classes = (
        known.join(roots, known["no"] == roots["node"], "left")
        .select("text_key", "first_id", F.when(F.col("keys").isNotNull(), F.coalesce("root", "no")).alias("root"))
    )
    given = docs.select(docs[id_col].alias("id"), F.md5(text_of(text_col)).alias("text_key"))
    given = stable(given.groupBy("id", "text_key").agg(F.count("*").alias("repeats")).join(classes, "text_key"))
    first = F.min(F.struct(F.col("id").isNull(), "id", "text_key"))
    heads = given.where("root is not null").groupBy("root").agg(first.alias("head"))
    out = given.join(heads, "root", "left")
    alone = F.col("root").isNull()
    return out.select(
        "id", "text_key", F.when(alone, F.col("id")).otherwise(F.col("head.id")).alias("class_id"),
        (alone | (F.col("head.id").eqNullSafe(F.col("id")) & (F.col("head.text_key") == F.col("text_key")))).alias("kept"),
        "repeats",
    )
