"""Mixing sources to target weights by pivotal dependent rounding.

Each source is to give a share of the words of all documents, so each of its documents is wanted `target / size of the
source` times: some whole copies, and one more with a probability. Documents are paired. Of a pair, words of copies move
from one document to the other, at random in one of two directions and so far that one of the two probabilities becomes
0 or 1; the chances are such that each probability stays right on average, and the words of the pair stay the same. One
document of the pair is settled, the other goes into the next pair. So a source's words never drift from its target.

Pairs are formed in a reduction tree. Documents with an open probability are numbered by source and a hash of their id;
tasks settle blocks of `block` numbers, of each block and source one document stays open, and these form the next level.
Levels are written, and there are as many as the logarithm of the number of rows. Of the one document that is open
at the end its first words are taken, as many as its probability asks for: a source's words meet its target but for one.

Rows equal in id, source and size are one row with a count in the tree, so a frequent id is no block of its own. They
have equal chances, and which of them takes the extra copy makes no difference. Choices come from the numbers of level
and block, so reruns agree. Words are stretches without ASCII white space. Null texts have no words; documents
without words take none. Null and empty sources are two sources. Null ids and repeated rows are documents of their own.
An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorline.llm.common import text_of
from anchorline.operators.batches import with_row_index
from anchorline.session import stable

WORD = r"[^\x20\x09-\x0D]+"
#: Open documents of one task of the tree; changes choices, not the words of a source.
BLOCK = 4096
EDGE = 1e-9


def sized(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, source, size, copies): documents by id, source and number of words, and how many rows are alike."""
    words = F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words.alias("size"))
    return rows.groupBy("id", "source", "size").agg(F.count("*").alias("copies"))


def targets(classes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, place, source_size, target): sources by code point, null last, weigh as `weights` repeated, and share
    `share` of all words. A target stops at `most` times its source's words; what it leaves is shared by the others."""
    sizes = classes.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).cast("long").alias("source_size"))
    placed = with_row_index(sizes, [F.col("source").asc_nulls_last()], "place")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights)).cast("int"))
    known = stable(placed.withColumn("weight", weight).withColumn("most", F.col("source_size") * most))
    sums = known.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    words, left, open_weight = (sums["words"] or 0) * share, 0.0, sums["weight"] or 1.0
    left, stopped = words, -1
    while True:  # a round stops at least one more source; three numbers come back
        per = left / open_weight if open_weight else 0.0
        over = F.col("most") <= F.col("weight") * per
        row = known.agg(
            F.count_if(over).alias("n"), F.sum(F.when(over, F.col("most"))).alias("words"),
            F.sum(F.when(~over, F.col("weight"))).alias("weight"),
        ).first()
        if row["n"] == stopped:
            break
        stopped, left, open_weight = row["n"], words - (row["words"] or 0.0), row["weight"] or 0.0
    target = F.when(over, F.col("most")).otherwise(F.col("weight") * F.lit(left) / F.lit(open_weight or 1.0))
    return known.select("source", "place", "source_size", target.alias("target"))


def pivot(words: np.ndarray, chance: np.ndarray, random: np.random.Generator) -> tuple[np.ndarray, int]:
    """Settle documents of one source: their chances as 0 or 1, and the place of the one that stays open, or -1."""
    settled, draws = chance.copy(), random.random(len(words))
    open_ = -1
    for i in range(len(words)):
        if open_ < 0:
            open_ = i
        else:
            a, b = open_, i
            # up: words move from b to a; down: from a to b
            up = min(words[a] * (1 - settled[a]), words[b] * settled[b])
            down = min(words[a] * settled[a], words[b] * (1 - settled[b]))
            move = up if draws[i] * (up + down) < down else -down
            settled[a] += move / words[a]
            settled[b] -= move / words[b]
            for x in (a, b):
                if settled[x] < EDGE or settled[x] > 1 - EDGE:
                    settled[x] = round(settled[x])
            open_ = next((x for x in (a, b) if 0 < settled[x] < 1), -1)
        if open_ >= 0 and not EDGE <= settled[open_] <= 1 - EDGE:
            settled[open_] = round(settled[open_])
            open_ = -1
    return settled, open_


def reduce_open(given: DataFrame, block: int, seed: int) -> DataFrame:
    """(item, chance) for documents (item, place, size, chance) with open chances, numbered within all sources by `item`:
    0 or 1, but for one document of each source, which may stay open."""
    def level(number: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def settle(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("item", kind="stable")
            random = np.random.default_rng([seed, number, int(pdf["place"].iloc[0]), int(pdf["block"].iloc[0])])
            chance, open_ = pivot(pdf["size"].to_numpy(np.float64), pdf["chance"].to_numpy(np.float64), random)
            pdf = pdf.assign(chance=chance, open=np.arange(len(pdf)) == open_)
            return pdf[["item", "place", "size", "chance", "open"]]

        return settle

    done, number, width = [], 0, block
    now = given
    while True:
        dealt = now.withColumn("block", F.call_function("div", F.col("item"), F.lit(width)))
        made = stable(
            dealt.groupBy("place", "block").applyInPandas(
                level(number), "item long, place long, size long, chance double, open boolean"
            )
        )
        done.append(made.where("not open").select("item", "chance"))
        now = made.where("open").select("item", "place", "size", "chance")
        if now.groupBy("place").count().where("count > 1").isEmpty():
            done.append(now.select("item", "chance"))
            return reduce(DataFrame.unionAll, done)
        number, width = number + 1, width * block


def mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2, block: int = BLOCK, seed: int = 11,
) -> DataFrame:
    """One row for each row of `docs`: (id, source, size, source_size, target, copies, cut, taken). `copies` counts the
    whole copies that the mix takes, `cut` the first words of one more, `taken` all words."""
    classes = sized(docs, id_col, source_col, text_col)
    order = [F.col("source").asc_nulls_last(), F.xxhash64("id", "size"), F.col("id"), F.col("size")]
    numbered = stable(with_row_index(classes, order, "item"))
    known = targets(numbered, weights, share, most).withColumnRenamed("source", "__source")
    wanted = numbered.join(known, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    rate = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate + EDGE).cast("long")
    extra = F.greatest(rate - whole, F.lit(0.0)) * F.col("copies")  # copies beyond the whole ones, of all rows alike
    wanted = wanted.withColumn("whole", whole).withColumn("extra", extra)
    wanted = stable(
        wanted.withColumn("more", F.floor(F.col("extra") + EDGE).cast("long"))
        .withColumn("chance", F.col("extra") - F.col("more"))
    )
    given = wanted.where(f"chance > {EDGE}").select("item", "place", "size", "chance")
    settled = reduce_open(given, block, seed).withColumnRenamed("chance", "settled")
    rows = wanted.join(settled, "item", "left").withColumn("settled", F.coalesce("settled", F.lit(0.0)))
    nth = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("nth")
    rows = rows.select("id", "source", "size", "source_size", "target", "whole", "more", "settled", nth)
    last = F.col("nth") == F.col("more") + 1

    def extra_copy() -> Column:
        return (F.col("nth") <= F.col("more")) | (last & (F.col("settled") == 1))

    copies = F.col("whole") + extra_copy().cast("long")
    cut = F.when(last & (F.col("settled") < 1), F.round(F.col("settled") * F.col("size")).cast("long")).otherwise(0)
    rows = rows.select("id", "source", "size", "source_size", "target", copies.alias("copies"), cut.cast("long").alias("cut"))
    return rows.withColumn("taken", F.col("copies") * F.col("size") + F.col("cut"))
