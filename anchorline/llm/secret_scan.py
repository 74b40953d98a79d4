"""Scan for secrets through a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived: any match contains all trigrams of one
of its alternatives. The index lists, for each trigram that a rule asks for, the texts that contain it. The alternatives
are joined with the postings by trigram, and the texts that are in all postings of one are the rule's candidates; only these
are searched with that rule. Rules without mandatory trigrams search every text. Rules may be as many as one likes.

Spans are found by splitting a text at the matches, so they are leftmost and non-overlapping for each rule; offsets
count code points, ends are exclusive. A match that is too short is dropped but has used up its text.

Null texts are empty and have no spans. Equal texts (repeated rows, copies under other ids) are indexed once and have
equal spans; null ids stay null. Columns of `docs` come through unchanged except those named like the results. An
empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorline.llm.common import text_of

#: Alternatives of a query beyond this number are cut to shorter, weaker ones.
MOST_STRINGS = 24
#: An alternative of more trigrams asks for the first of them only, which lets more texts be searched, never fewer.
MOST_GRAMS = 62


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, the group that has to have `least` characters, and whether case counts.
    Case is ignored for ASCII letters only. `scan` is a pattern with the same long enough matches that is faster."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    any_case: bool = False
    scan: str = ""

    def regex(self) -> str:
        return ("(?i)" if self.any_case else "") + (self.scan or self.pattern)


#: The three kinds whose spans are always reported.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         least=8, group=2, any_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]+", least=32, scan=r"[0-9a-f]{32,}"),
)
#: Kinds that this method adds.
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hosted_git", r"gh[opsu]_[A-Za-z0-9]+", least=40),
    Rule("chat_bot", r"xox[abprs]-[A-Za-z0-9-]+", least=20),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=40),
)
RULES = BASE + ADDED


def trigram_query(rule: Rule) -> list[frozenset[str]]:
    """Alternatives, each a set of lower-case trigrams that a match has to contain; no alternative if the
    rule has no mandatory trigram."""
    parser = re._parser  # the standard library's own reading of the pattern

    def strings(node: tuple) -> set[str] | None:
        """All strings that a node can match, if they are few."""
        kind, value = str(node[0]), node[1]
        if kind == "LITERAL":
            return {chr(value).lower()}
        if kind == "IN" and all(str(k) == "LITERAL" for k, _ in value):
            return {chr(v).lower() for _, v in value}
        if kind == "SUBPATTERN":
            return sequence_strings(value[-1])
        if kind == "BRANCH":
            found = [sequence_strings(x) for x in value[1]]
            return None if None in found else set().union(*found)
        if kind == "MAX_REPEAT" and value[1] != parser.MAXREPEAT and value[1] <= 2:
            once = sequence_strings(value[2])
            if once is not None:
                out = {""}
                made = {""} if value[0] == 0 else set()
                for n in range(1, value[1] + 1):
                    out = {a + b for a in out for b in once}
                    made |= out if n >= value[0] else set()
                return made
        return None

    def sequence_strings(nodes: list) -> set[str] | None:
        out = {""}
        for node in nodes:
            found = strings(node)
            if found is None or len(out) * len(found) > MOST_STRINGS:
                return None
            out = {a + b for a in out for b in found}
        return out

    def grams(texts: set[str]) -> list[frozenset[str]]:
        made = [frozenset(t[i:i + 3] for i in range(len(t) - 2)) for t in texts]
        return [] if any(not m for m in made) else made

    runs, run = [], {""}
    for node in parser.parse(rule.pattern):
        found = strings(node)
        if found is None or len(run) * len(found) > MOST_STRINGS:
            runs, run = [*runs, run], found or {""}
        else:
            run = {a + b for a in run for b in found}
    query: list[frozenset[str]] = []
    for alternatives in filter(None, map(grams, [*runs, run])):
        joined = [a | b for a in query for b in alternatives] if query else alternatives
        query = joined if len(joined) <= MOST_STRINGS else query
    return [q for q in dict.fromkeys(query) if not any(o < q for o in query)]


def spans(text: Column, rule: Rule, number: int) -> Column:
    """Array of (start, `number`, end) of the rule's matches in `text`."""
    pattern = F.lit(rule.regex())
    between = F.split(text, rule.regex(), -1)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    checked = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    sizes = F.arrays_zip(
        F.transform(between, F.length).alias("gap"), F.transform(whole, F.length).alias("size"),
        F.transform(checked, F.length).alias("checked"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("out"))
    ends = F.aggregate(
        F.slice(sizes, F.lit(1), F.size(whole)), start,
        lambda done, x: F.struct(
            (done["at"] + x["gap"] + x["size"]).alias("at"),
            F.when(x["checked"] >= rule.least, F.concat(done["out"], F.array(F.struct(
                (done["at"] + x["gap"]).alias("start"), F.lit(number).alias("kind"),
                (done["at"] + x["gap"] + x["size"]).alias("end"),
            )))).otherwise(done["out"]).alias("out"),
        ),
    )
    return ends["out"]


def candidates(spark: SparkSession, texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(__key, __rules): the numbers of the rules whose trigram query a text (`__key`, `__text`) satisfies. Texts that
    satisfy none are left out."""
    terms = [
        F.struct(F.lit(gram).alias("gram"), F.lit(no).alias("rule"), F.lit(nth).alias("alternative"),
                 F.lit(1 << i).cast("long").alias("bit"), F.lit((1 << len(grams)) - 1).cast("long").alias("all"))
        for no, rule in enumerate(rules) for nth, alternative in enumerate(trigram_query(rule))
        for grams in [sorted(alternative)[:MOST_GRAMS]] for i, gram in enumerate(grams)
    ]
    if not terms:
        return texts.select("__key", F.array().cast("array<int>").alias("__rules")).limit(0)
    asked = spark.range(1).select(F.inline(F.array(*terms)))  # as large as the rules
    grams = sorted({g for rule in rules for q in trigram_query(rule) for g in q})
    postings = (
        texts.select("__key", F.lower("__text").alias("__lower"))
        .select("__key", F.explode(
            F.filter(F.array(*map(F.lit, grams)), lambda g: F.contains("__lower", g))
        ).alias("gram"))
    )
    met = (
        postings.join(F.broadcast(asked), "gram").groupBy("__key", "rule", "alternative", "all")
        .agg(F.bit_or("bit").alias("has")).where("has = all")
    )
    return met.groupBy("__key").agg(F.collect_set("rule").alias("__rules"))  # no more than there are rules


def find_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """`docs` with the column `spans`: array of (start, number of the rule in `rules`, end), sorted."""
    text, empty = text_of(text_col), F.array().cast("array<struct<start:int,kind:int,end:int>>")
    key = F.md5(F.encode(text, "UTF-8"))
    found = candidates(docs.sparkSession, docs.select(key.alias("__key"), text.alias("__text")), rules)
    matches = [
        F.when(F.array_contains("__rules", no), spans(text, rule, no)).otherwise(empty) if trigram_query(rule)
        else spans(text, rule, no) for no, rule in enumerate(rules)
    ]
    columns = [f"`{c}`" for c in docs.columns if c != "spans"]
    return (
        docs.withColumn("__key", key).join(found, "__key", "left")
        .withColumn("__spans", F.array_sort(F.concat(*matches)))
        .select(*columns, F.col("__spans").alias("spans"))
    )


def listing(rules: tuple[Rule, ...], column: Column, of: tuple[Rule, ...] | None = None) -> Column:
    """The spans of the rules `of` as text: kind:start:end, joined by commas."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    last = len(rules if of is None else of)
    shown = F.transform(
        F.filter(column, lambda x: x["kind"] < last),
        lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string")),
    )
    return F.array_join(shown, ",")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """`docs` with each stretch of text that spans cover replaced by `mark`; texts without spans stay as they
    are, null included."""
    text = F.col(text_col)
    begun = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate("spans", begun, lambda a, x: F.struct(
        F.greatest(a["at"], x["end"]).alias("at"),
        F.when(x["start"] < a["at"], a["out"]).otherwise(
            F.concat(a["out"], F.substr(text, a["at"] + 1, x["start"] - a["at"]), F.lit(mark))
        ).alias("out"),
    ))
    tail = F.substr(text, done["at"] + 1)
    masked = F.when(F.size("spans") > 0, F.concat(done["out"], tail)).otherwise(text)
    return docs.withColumn(text_col, masked)
