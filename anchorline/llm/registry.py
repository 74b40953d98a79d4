"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorline.llm import (
    ann, bpe, chat_views, line_dedup, mixing, near_dedup, packing, prefix_trie, secret_scan, toxicity, turn_repair,
    url_filter, vector_dedup,
)
from anchorline.llm.common import prepared, table
from anchorline.session import stable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with the SQL that gives the same rows."""
    def keep(query: Query) -> Query:
        QUERIES[query.__name__] = lambda spark, folder: query(prepared(spark), folder)
        if sql:
            SQL[query.__name__] = sql
        return query

    return keep


@register()
def op3_bpe_codec(spark: SparkSession, folder: str) -> DataFrame:
    """Token count and digests of ids and decoded text of every document."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.digests(table(spark, folder, "documents"), path).withColumnRenamed("id", "doc_id")


def toxic_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Trained on rows that are not held out; labels of held-out rows are not read."""
    learn = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2
    return toxicity.train(docs.where(learn).select("doc_id", "text"), labels.where(learn))


@register()
def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Score of every document, and whether its label was held out."""
    docs = table(spark, folder, "documents").select(
        "doc_id", "text",
        (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2).alias("held_out"),
    )
    model = toxic_model(docs, table(spark, folder, "labels"))
    scored = toxicity.score(docs, model, keep=["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@register()
def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents in windows of 1024 tokens."""
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


SECRETS_SQL = r"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
patterns(no, kind, least) as (values
    (0, 'assign', 8), (1, 'access', 16), (2, 'hex', 32), (3, 'private_key', 1), (4, 'hosted_git', 40),
    (5, 'chat_bot', 20), (6, 'web_token', 40)),
matched as (
    select rid, no, kind, least,
        case no
            when 0 then regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0)
            when 1 then regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0)
            when 2 then regexp_extract_all(t, '[0-9a-f]+', 0)
            when 3 then regexp_extract_all(t, '-----BEGIN [A-Z ]*PRIVATE KEY-----', 0)
            when 4 then regexp_extract_all(t, 'gh[opsu]_[A-Za-z0-9]+', 0)
            when 5 then regexp_extract_all(t, 'xox[abprs]-[A-Za-z0-9-]+', 0)
            else regexp_extract_all(t, 'eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+', 0) end as found,
        case no
            when 0 then regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2)
            else null end as second,
        case no
            when 0 then string_split_regex(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)')
            when 1 then string_split_regex(t, 'AKIA[A-Z0-9]+')
            when 2 then string_split_regex(t, '[0-9a-f]+')
            when 3 then string_split_regex(t, '-----BEGIN [A-Z ]*PRIVATE KEY-----')
            when 4 then string_split_regex(t, 'gh[opsu]_[A-Za-z0-9]+')
            when 5 then string_split_regex(t, 'xox[abprs]-[A-Za-z0-9-]+')
            else string_split_regex(t, 'eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+') end as gaps
    from d, patterns),
each as (
    select rid, no, kind, least, unnest(range(1, len(found) + 1)) as i, unnest(found) as whole,
        unnest(coalesce(second, found)) as checked, unnest(gaps[1:len(found)]) as gap
    from matched where len(found) > 0),
placed as (
    select *, sum(length(gap) + length(whole)) over (partition by rid, no order by i) as stop from each),
kept as (
    select rid, no, kind, stop - length(whole) as start, stop from placed where length(checked) >= least),
texts as (
    select rid, count(*) filter (no = 0) as n_assign, count(*) filter (no = 1) as n_access,
        count(*) filter (no = 2) as n_hex,
        string_agg(concat(kind, ':', start, ':', stop), ',' order by start, no) filter (no < 3) as base,
        string_agg(concat(kind, ':', start, ':', stop), ',' order by start, no) as spans
    from kept group by rid)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
    sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join texts using (rid)
"""


@register(SECRETS_SQL)
def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of secrets in every document."""
    found = secret_scan.find_spans(table(spark, folder, "documents").select("doc_id", "text"))
    count = lambda n: F.size(F.filter("spans", lambda x: x["kind"] == n)).cast("long")
    base = secret_scan.listing(secret_scan.RULES, F.col("spans"), secret_scan.BASE)
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(F.encode(base, "UTF-8"), 256).alias("base_sha256"),
        secret_scan.listing(secret_scan.RULES, F.col("spans")).alias("spans"),
    )


@register()
def op1_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Class of near-duplicates of every document, and the one that stays."""
    docs = table(spark, folder, "documents")
    found = near_dedup.near_duplicates(docs)
    each = found.withColumn("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats"))))
    return each.select(F.col("id").alias("doc_id"), "class_id", (F.col("kept") & (F.col("__row") == 1)).alias("kept"))


@register()
def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without later repeated runs of lines."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    done = line_dedup.drop_repeated_lines(docs)
    return done.select(
        "doc_id", F.col("deleted").alias("n_deleted"), F.col("left").alias("n_left"),
        F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("text_sha256"),
    )


@register()
def op8_vector_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links and component of every vector."""
    return vector_dedup.link_vectors(table(spark, folder, "embeddings")).withColumnRenamed("id", "vec_id")


@register()
def op6_ann(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest vectors found for every twentieth vector."""
    found = ann.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)
    return found.withColumnRenamed("id", "vec_id")


URL_RULES = [
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"),
    ("net/fr/", "block"),
]


@register()
def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page: its rule's, else that of its path template."""
    pages = url_filter.with_host_and_path(table(spark, folder, "pages").select("page_id", "url"))
    judged = url_filter.judge(url_filter.apply_rules(pages, URL_RULES))
    method = F.when(F.col("rejected"), "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", "rule", F.coalesce("label", method).alias("verdict"), "template", "template_purity"
    )


CHAT_SQL = r"""
with said as (
    select distinct conv_id, turn, role, replace(coalesce(text, ''), '<|im_', '<| im_') as text from conversations),
speakers as (select distinct conv_id, role as perspective from said where role <> 'system'),
marked as (
    select s.conv_id, p.perspective, cast(floor(s.turn / 64) as bigint) as part, s.turn,
        coalesce(s.role, 'unknown') as role, s.role is null as nobody, s.text, coalesce(s.role = p.perspective, false) as own,
        concat('<|im_start|>', case when coalesce(s.role = p.perspective, false) then 'assistant'
            when s.role = 'system' then 'system' else concat('user name=', coalesce(s.role, 'unknown')) end, chr(10)) as head,
        concat(s.text, '<|im_end|>') as body
    from said s join speakers p on s.conv_id is not distinct from p.conv_id),
placed as (
    select *, sum(length(head) + length(body) + 1) over w as stop,
        row_number() over w as nth
    from marked window w as (
        partition by conv_id, perspective, part order by turn is null, turn, role, nobody, text
        rows between unbounded preceding and current row))
select conv_id, perspective, part, count(*) as n_turns,
    sha256(string_agg(concat(head, body, chr(10)), '' order by nth)) as rendered_sha256,
    sum(length(head) + length(body) + 1)::bigint as n_chars,
    coalesce(string_agg(concat(stop - 1 - length(body), ':', stop - 1), ',' order by nth) filter (own), '') as mask
from placed group by conv_id, perspective, part
"""


@register(CHAT_SQL)
def op10_chat_views(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation as each of its speakers, with masks."""
    views = chat_views.perspectives(table(spark, folder, "conversations"))
    shown = F.transform("mask", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string")))
    return views.select(
        "conv_id", "perspective", "part", "n_turns",
        F.sha2(F.encode("rendered", "UTF-8"), 256).alias("rendered_sha256"),
        F.length("rendered").cast("long").alias("n_chars"), F.array_join(shown, ",").alias("mask"),
    )


def crc_sql(text: str) -> str:
    """SQL for the CRC-32 of a text of ASCII characters, bit by bit."""
    step = "xor(c::bigint, x::bigint)"
    return f"""xor(list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length({text}) + 1),
        lambda i: [ord(substr({text}, i, 1)), 0, 0, 0, 0, 0, 0, 0]))),
        lambda c, x: case when {step} & 1 = 1 then xor({step} >> 1, 3988292384) else {step} >> 1 end), 4294967295)"""


TRIE_SQL = f"""
with said as (
    select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
        row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as nth
    from conversations where conv_id is not null),
named as (
    select conv_id, nth, sha256(concat(length(role), ':', role, text)) as name, length(text) as size from said),
convs as (
    select conv_id, conv_id - conv_id % 100 as head, {crc_sql("cast(conv_id as varchar)")} % 6 as h
    from (select distinct conv_id from named)),
rows_of as (
    select c.conv_id, 0 as part, t.nth, t.name, t.size from convs c join named t on t.conv_id = c.head and t.nth <= c.h
    union all
    select c.conv_id, 1, t.nth, t.name, t.size from convs c join named t on t.conv_id = c.conv_id and t.nth > c.h),
placed as (
    select conv_id, row_number() over w as depth, string_agg(name, '') over w as path, size
    from rows_of window w as (partition by conv_id order by part, nth rows between unbounded preceding and current row)),
members as (
    select conv_id, depth, sha256(path) as path, size from placed
    union all select conv_id, 0, sha256(''), 0 from convs),
nodes as (
    select path, depth, min(conv_id) as conv_id, count(*) as n_convs, min(size) as size from members group by path, depth),
linked as (
    select n.*, up.path as parent from nodes n left join members up on up.conv_id = n.conv_id and up.depth = n.depth - 1),
below as (
    select parent, count(*) as n_children from linked where parent is not null group by parent),
sums as (
    select m.path, count(*) filter (not exists (select 1 from below b where b.parent = w.path)) as n_leaves,
        sum((w.n_convs - 1) * w.size) as saved_tokens
    from linked w join members m on m.conv_id = w.conv_id and m.depth <= w.depth group by m.path),
lasts as (
    select conv_id, path from members qualify row_number() over (partition by conv_id order by depth desc) = 1),
ended as (
    select path, string_agg(conv_id, ',' order by conv_id) as ids from lasts group by path)
select n.conv_id, n.depth::bigint as depth, p.conv_id as parent_conv_id, n.n_convs::bigint as n_convs,
    coalesce(b.n_children, 0)::bigint as n_children, s.n_leaves::bigint as n_leaves,
    s.saved_tokens::bigint as saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256
from linked n left join nodes p on p.path = n.parent left join below b on b.parent = n.path
    join sums s on s.path = n.path left join ended e on e.path = n.path
"""


def rebuilt_paths(messages: DataFrame) -> DataFrame:
    """Paths of all conversations, each started with up to five turns of the first one of its hundred."""
    own = stable(prefix_trie.paths(messages))
    taken = F.crc32(F.col("id").cast("string").cast("binary")) % 6
    return prefix_trie.started_with(own, F.col("id") - F.col("id") % 100, taken, most=5)


@register(TRIE_SQL)
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """The nodes of the prefix trie of the rebuilt conversations."""
    given = stable(rebuilt_paths(table(spark, folder, "conversations")))
    nodes = prefix_trie.trie(given).join(prefix_trie.digest_of_ends(given), "node", "left")
    none = F.sha2(F.lit(""), 256)
    return nodes.select(
        F.col("first_id").alias("conv_id"), "depth", F.col("parent_first_id").alias("parent_conv_id"),
        F.col("n_members").alias("n_convs"), "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )


def damaged(messages: DataFrame) -> DataFrame:
    """Conversations with planted faults, by the checksum of id and turn; nulls of role and text count as one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(F.col("fault") == 1, "").when(
        F.col("fault") == 2, F.translate(said("text"), ".!?", "")
    ).otherwise(said("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(said("role"))
    rows = messages.select("conv_id", "turn", "role", "text", fault.alias("fault")).where("fault <> 0")
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


REPAIR_SQL = f"""
with recursive given as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
        concat(coalesce(cast(conv_id as varchar), ' '), ':', coalesce(cast(turn as varchar), ' ')) as name
    from conversations),
coded as (select *, {crc_sql("name")} % 20 as fault from given),
damaged as (
    select conv_id, turn, case fault when 4 then 'user' else role end as role,
        case fault when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
        unnest(case fault when 3 then [1, 2] else [1] end) as copy
    from coded where fault <> 0),
placed as (
    select conv_id, turn, role, text, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare,
        row_number() over (partition by conv_id order by turn nulls first, role, text) as place
    from damaged),
numbered as (select *, row_number() over (partition by conv_id, role, text order by place) as nth from placed),
typed as materialized (
    select conv_id, turn, role, text, place, role[1] as initial,
        case when bare = '' then 'blank' when nth > 1 then 'duplicate' when bare[-1] not in ('.', '!', '?') then 'truncated'
            else '' end as fault
    from numbered),
moves(before, inserts, after, edit) as (
    select s.state, i.n, e.after, e.edit
    from (values (0), (1), (2), (3)) s(state), (values (0), (1), (2), (3)) i(n),
        lateral (select case when i.n = 0 then s.state when (s.state = 2) = (i.n % 2 = 0) then 2 else 3 end as at) a,
        lateral (
            select a.at as after, 'D' as edit union all
            select case when a.at = 2 then 3 else 2 end, 'R' union all
            select 1, 's' where a.at = 0 union all
            select case when a.at = 2 then 3 else 2 end, case when a.at = 2 then 'a' else 'u' end) e),
conv as (
    select conv_id, row_number() over () as c, count(place) as n
    from (select g.conv_id, t.place from (select distinct conv_id from given) g
        left join typed t on t.conv_id is not distinct from g.conv_id) group by conv_id),
keyed as materialized (select c.c, t.* from typed t join conv c on t.conv_id is not distinct from c.conv_id),
ways(c, place, state, cost, audit) as (
    select c, 0::bigint, 0, 0::bigint, '' from conv
    union all
    select c, place, state, best.cost, best.audit from (
        select w.c, t.place, m.after as state, min({{'cost': w.cost + 5 * m.inserts
                + case m.edit when 'D' then 2 when 'R' then 1 else 0 end
                + case when m.edit <> 'D' and t.fault = 'truncated' then 5 else 0 end,
            'audit': concat(w.audit, repeat('I', m.inserts), case when m.edit in ('D', 'R') then m.edit else 'K' end)}}) as best
        from ways w join keyed t on t.c = w.c and t.place = w.place + 1 join moves m on m.before = w.state
        where m.edit = 'D' or t.fault not in ('blank', 'duplicate') and (m.edit = 'R' or m.edit = t.initial)
        group by w.c, t.place, m.after)),
chosen as (
    select v.conv_id, v.c, min({{'cost': w.cost + case w.state when 1 then 10 when 2 then 5 else 0 end,
        'audit': concat(w.audit, case w.state when 1 then 'II' when 2 then 'I' else '' end)}}) as best
    from conv v join ways w on w.c = v.c and w.place = v.n group by v.conv_id, v.c),
edits as (
    select c, i, best.audit[i] as edit,
        length(replace(best.audit[1:i], 'I', '')) as place
    from chosen, lateral (select unnest(range(1, length(best.audit) + 1)) as i)),
kept as (
    select e.c, e.i, e.edit, case when e.edit = 'I' then '' else t.text end as text, t.role, t.initial,
        row_number() over (partition by e.c order by e.i) as nth
    from edits e left join keyed t on t.c = e.c and t.place = e.place and e.edit <> 'I' where e.edit <> 'D'),
formed as (
    select k.*, case when exists (
        select 1 from kept f where f.c = k.c and f.nth = 1 and f.edit = 'K' and f.initial = 's') then 1 else 0 end as ahead
    from kept k),
texts as (
    select c, string_agg(concat(case when edit = 'K' then role when (nth - ahead) % 2 = 1 then 'user' else 'assistant' end,
        ':', text), chr(10) order by i) as whole
    from formed group by c),
pairs as (
    select c, count(*) as illegal from (
        select c, initial, lag(initial) over (partition by c order by place) as above,
            row_number() over (partition by c order by place) as nth from keyed)
    where nth > 1 and concat(above, initial) not in ('su', 'ua', 'au') group by c),
sums as (
    select c, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
        count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated
    from keyed group by c)
select h.conv_id, coalesce(s.gaps, 0)::bigint as gaps, coalesce(s.blank, 0)::bigint as blank,
    coalesce(s.duplicate, 0)::bigint as duplicate, coalesce(s.truncated, 0)::bigint as truncated,
    coalesce(p.illegal, 0)::bigint as illegal, h.best.cost::bigint as cost, h.best.audit as audit,
    sha256(coalesce(t.whole, '')) as repaired_sha256
from chosen h left join sums s on s.c = h.c left join pairs p on p.c = h.c left join texts t on t.c = h.c
"""


@register(REPAIR_SQL)
def op12_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation."""
    given = table(spark, folder, "conversations")
    rows = turn_repair.typed(damaged(given))
    plans = stable(turn_repair.audits(rows))
    left = turn_repair.digests(turn_repair.repaired(rows, plans)).withColumnRenamed("id", "__id")
    ids = given.select("conv_id").distinct()
    found = ids.join(plans, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    found = found.join(left, F.col("conv_id").eqNullSafe(F.col("__id")), "left")
    none = F.sha2(F.lit(""), 256)
    return found.select(
        "conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in turn_repair.FIGURES[:-1]),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", none).alias("repaired_sha256"),
    )


@register()
def op11_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """The words that a mix of one and a half times the corpus takes of every document."""
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies", "cut")
