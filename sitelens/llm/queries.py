"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelens.catalog.registry import Tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, path: fn(Tables(spark, path))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


MIX_SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents
), totals as (
  select source, sum(size)::bigint as source_size from sized group by source
), weighed as (
  select *, case (row_number() over (order by source asc nulls last) - 1) % 3 when 0 then 3 when 1 then 1 else 2 end::bigint as weight
  from totals
), levels as (
  select *, row_number() over o as k,
    1.5::double * (sum(source_size) over ())::double
      - 2.0::double * coalesce(sum(source_size) over (o rows between unbounded preceding and 1 preceding), 0)::double as rest,
    (sum(weight) over (o rows between current row and unbounded following))::double as open_weight
  from weighed window o as (order by 2.0::double * source_size::double / weight asc, source asc nulls last)
), level as (
  select k as k0, rest as r0, open_weight as w0 from levels
  where 2.0::double * source_size::double * open_weight >= rest * weight order by k limit 1
), targets as (
  select source, source_size,
    case when k0 is not null and k >= k0 then r0 * weight / w0 else 2.0::double * source_size::double end as target
  from levels left join level on true
), rated as (
  select d.doc_id, d.size, t.source_size, t.target,
    case when t.source_size > 0 then t.target / t.source_size else 0.0::double end as rate,
    ('0x' || substr(md5('11|' || d.doc_id::varchar), 1, 12))::bigint::double / 281474976710656.0::double as u
  from sized d join targets t on d.source is not distinct from t.source
)
select doc_id, size, source_size, target,
  (size * (floor(rate) + case when u < rate - floor(rate) then 1 else 0 end))::bigint as taken
from rated
"""


@query("op6_source_mix", MIX_SQL)
def op6(t: Tables):
    from sitelens.llm.mixing import mixed

    return mixed(t.documents).select(
        "row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


#: CTE of the table that ``crc32_sql`` looks up.
CRC = """crc_table AS (
  SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_prepend(i::UBIGINT, list_transform(range(8), lambda k: 0::UBIGINT)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM range(256) t(i)))"""


def crc32_sql(text: str) -> str:
    """crc32 of the UTF-8 bytes of a text; ``crc`` is the list of ``CRC``."""
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::UBIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {data}), lambda c, b: xor(c >> 8, crc[(xor(c & 255, b) + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT"


SHARD_SQL = f"""
with recursive {CRC}, sized as (
  select doc_id, text, (coalesce(strlen(text), 0) + 1)::bigint as size, coalesce({crc32_sql('text')}, 0) as text_crc32, coalesce(sha256(text), '') as digest
  from documents, crc_table
), grouped as (
  select digest, min(doc_id) as first, sum(size)::bigint as bytes from sized group by digest
), ends as (
  select digest, first, bytes, (sum(bytes) over (order by first, digest))::bigint as e from grouped
), facts as (
  select list(e order by e) as es, max(e) as total, greatest(-(-max(e) // 8), max(bytes)) as low, -(-max(e) // 8) + max(bytes) as high from ends
), search as (
  select es, total, low, high from facts
  union all
  select es, total, case when fits then low else mid + 1 end, case when fits then mid else high end from (
    select *, list_reduce(list_prepend(0::bigint, range(8)), lambda a, k: coalesce(list_max(list_filter(es, lambda x: x <= a + mid)), a)) >= total as fits
    from (select *, (low + high) // 2 as mid from search where low < high))
), cuts as (
  select list_transform(range(1, 8), lambda n: list_reduce(list_prepend(0::bigint, range(n)), lambda a, k: coalesce(list_max(list_filter(es, lambda x: x <= a + low)), a))) as cut
  from search where low = high
), placed as (
  select s.*, g.first, len(list_filter(cut, lambda c: g.e > c))::integer as shard from sized s join ends g using (digest), cuts
)
select doc_id, size, text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by first, digest, doc_id) - 1 as slot, null::integer as grown_shard from placed
"""


@query("op7_minimax_shards", SHARD_SQL)
def op7(t: Tables):
    from sitelens.llm.sharding import shard

    return shard(t.documents, 8).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op1_language_id")
def op1(t: Tables):
    from sitelens.llm import langid
    from sitelens.llm.text import bucket

    docs = t.documents.select("doc_id", "text", "lang")
    model = langid.train(docs.filter(bucket("doc_id", 4) != 2))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("row.doc_id", (bucket("row.doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query("op3_cost_packing")
def op3(t: Tables):
    import public_tokenizers

    from sitelens.llm.packing import pack

    return pack(t.documents, public_tokenizers.path("byte_bpe_50k.json"))


@query("op5_quality_score")
def op5(t: Tables):
    from sitelens.llm import quality
    from sitelens.llm.text import bucket

    docs = t.documents.select("doc_id", "text")
    model = quality.train(docs, t.labels.filter(bucket("doc_id", 4) != 2))
    return quality.scored(docs, model).select(
        "row.doc_id",
        (bucket("row.doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


NEAR_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), shingles as (
  select doc_id, case when w is null or len(w) = 0 then []::varchar[] when len(w) = 1 then [w[1]]
    else list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) end as s from words
), grams as (
  select distinct doc_id, unnest(s) as g from shingles
), sizes as (
  select doc_id, count(*) as n from grams group by doc_id
), matches as (
  select a.doc_id as a, b.doc_id as b, count(*) as met from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2
), near as (
  select a, b from matches join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * met >= 80 * (x.n + y.n - met)
), edges as (
  select a, b from near union all select b, a from near
), reach(id, c) as (
  select distinct a, a from edges
  union
  select e.b, r.c from reach r join edges e on e.a = r.id
), least_id as (
  select id, min(c) as c from reach group by id
)
select s.doc_id, coalesce(z.n, 0)::bigint as n_shingles, coalesce(l.c, s.doc_id) as component_id, coalesce(l.c, s.doc_id) = s.doc_id as kept
from shingles s left join sizes z on z.doc_id = s.doc_id left join least_id l on l.id = s.doc_id
"""


@query("op2_near_duplicates", NEAR_SQL)
def op2(t: Tables):
    from sitelens.llm.neardup import classes

    return classes(t.documents, width=2)


@query("op4_context_tree")
def op4(t: Tables):
    from sitelens.llm.ctw import scored
    from sitelens.llm.text import bucket

    found = scored(t.documents.select("doc_id", "text"), bucket("doc_id", 10) != 0)
    return found.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"
    )


TOP_SQL = """
with good as (
  select vec_id, [floor(256 * x::double) for x in embedding] as e from embeddings
  where embedding is not null and len(embedding) > 0 and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), pairs as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score
  from good q join good c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::integer as rank, vec_id, score
from pairs qualify rank <= 5
"""


@query("op10_va_file_top_k", TOP_SQL)
def op10(t: Tables):
    from sitelens.llm.vafile import top_k

    return top_k(t.embeddings, F.col("vec_id") % 50 == 0, 5)


WARC_SQL = """
with payloads as (
  select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as d from pages
), kept as (
  select body as kept_body, max(page_id) as largest from payloads group by body
)
select page_id, strlen(body)::bigint as payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (1 + ((('0x' || substr(d, (1 + 5 * (i // 4))::bigint, 5))::bigint >> (5 * (3 - i % 4))::bigint) & 31))::bigint, 1) for i in range(32)], '') as payload_digest,
  case when page_id = largest then 'response' else 'revisit' end as record_type,
  case when page_id = largest then null else largest end as refers_to
from payloads join kept on body = kept_body
"""


@query("op9_warc_index", WARC_SQL)
def op9(t: Tables):
    from sitelens.llm.warc import captured_pages

    return captured_pages(t.pages).select(
        F.col("page").cast("bigint").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("bigint").alias("refers_to"),
    )


VECTOR_SQL = """
with recursive good as (
  select vec_id, label, embedding::double[] as e from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0 and len([x for x in embedding if x <> 0]) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from good a join good b on a.label = b.label and a.vec_id <> b.vec_id
  where list_dot_product(a.e, b.e) >= 0.93 * sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e))
), degrees as (
  select a, count(*) as n from links group by a
), reach(id, c) as (
  select distinct a, a from links
  union
  select l.b, r.c from reach r join links l on l.a = r.id
), least_id as (
  select id, min(c) as c from reach group by id
)
select v.vec_id, coalesce(n, 0)::bigint as n_links, coalesce(c, v.vec_id) as component_id, coalesce(c, v.vec_id) = v.vec_id as kept
from embeddings v left join degrees on a = v.vec_id left join least_id on id = v.vec_id
"""


@query("op8_vector_near_duplicates", VECTOR_SQL)
def op8(t: Tables):
    from sitelens.llm.flatgraph import near_vectors

    return near_vectors(t.embeddings)


LINE_SQL = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as n
  from documents
), keyed as (
  select doc_id, n, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines
), repeated as (
  select key, max(doc_id) as keeper from keyed where length(key) >= 40 group by key having count(distinct doc_id) >= 5
), judged as (
  select doc_id, n, line, keeper is not null and doc_id < keeper as dropped from keyed left join repeated using (key)
)
select doc_id, count(*) as n_lines, count(*) filter (dropped) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by n) filter (not dropped), '')) as kept_sha256
from judged group by doc_id
"""


@query("op11_line_dedup", LINE_SQL)
def op11(t: Tables):
    from sitelens.llm.linededup import without_repeated_lines

    return without_repeated_lines(t.documents.select("doc_id", "text")).select(
        "row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


STEP = """case when q = 1 and c = 's' then 2 when q in (1, 2, 4) and c = 'u' then 3 when q = 3 and c = 'a' then 4 end"""
REPAIR_SQL = f"""
with recursive {CRC}, coded as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    {crc32_sql("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as code from conversations, crc_table
), harmed as (
  select conv_id, turn, case when code = 4 then 'user' else role end as role,
    case code when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, unnest(case when code = 3 then [0, 1] else [0] end) as copy
  from coded where code <> 0
), ordered as (
  select *, trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body,
    row_number() over (partition by conv_id order by turn asc nulls first, role, sha256(text), copy) as n,
    row_number() over (partition by conv_id, role, text order by turn asc nulls first, copy) as met from harmed
), faulty as (
  select *, case when body = '' then 'blank' when met > 1 then 'duplicate' when right(body, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
    left(role, 1) as c, lag(left(role, 1)) over (partition by conv_id order by n) as before from ordered
), counted as (
  select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (fault = 'blank') as blank,
    count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (before is not null and before || c not in ('su', 'ua', 'au')) as illegal from faulty group by conv_id
), best as (
  select conv_id, n as pos, [{{c: 0::bigint, a: ''}}, {{c: 6::bigint, a: 'II'}}, {{c: 3::bigint, a: 'I'}}, {{c: 0::bigint, a: ''}}] as f from counted
  union all
  select conv_id, pos - 1, [
      list_min([g[1], {{c: 3 + f3.c, a: 'I' || f3.a}}]), list_min([g[2], {{c: 3 + f3.c, a: 'I' || f3.a}}]), f3, list_min([g[4], {{c: 3 + g[3].c, a: 'I' || g[3].a}}])] from (
    select *, list_min([g[3], {{c: 3 + g[4].c, a: 'I' || g[4].a}}]) as f3 from (
      select b.conv_id, b.pos, list_transform([1, 2, 3, 4], lambda q: list_min(list_filter([
          {{c: 4 + f[q].c, a: 'D' || f[q].a}},
          case when fault not in ('blank', 'duplicate') and ({STEP}) is not null then {{c: (fault = 'truncated')::int * 3 + f[{STEP}].c, a: 'K' || f[{STEP}].a}} end,
          case when fault not in ('blank', 'duplicate') then {{c: 3 + (fault = 'truncated')::int * 3 + f[case q when 3 then 4 else 3 end].c, a: 'R' || f[case q when 3 then 4 else 3 end].a}} end
        ], lambda x: x is not null))) as g
      from best b join faulty r on r.conv_id is not distinct from b.conv_id and r.n = b.pos))
), chosen as (
  select b.conv_id, b.f[1].c as cost, b.f[1].a as audit from best b where b.pos = 0
), walked as (
  select conv_id, audit, 1 as k, 1::bigint as i, 1 as q, null::varchar as done from chosen
  union all
  select conv_id, audit, k + 1, i + (e <> 'I')::int, case when e in ('I', 'R') then due when e = 'K' then ({STEP}) else q end,
    case when e = 'D' then done else coalesce(done || chr(10), '') || case when e = 'K' then role when due = 4 then 'assistant' else 'user' end || ':' || case when e = 'I' then '' else text end end
  from (select w.*, substr(audit, k, 1) as e, case q when 3 then 4 else 3 end as due, r.role, r.text, r.c
    from walked w left join faulty r on r.conv_id is not distinct from w.conv_id and r.n = w.i where k <= length(audit))
)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(cost, 0) as cost, coalesce(audit, '') as audit, sha256(coalesce(done, '')) as repaired_sha256
from (select distinct conv_id from conversations) o
left join counted c on c.conv_id is not distinct from o.conv_id
left join (select conv_id, cost, chosen.audit, done from chosen join walked using (conv_id) where k = length(walked.audit) + 1) w on w.conv_id is not distinct from o.conv_id
"""


@query("op12_conversation_repair", REPAIR_SQL)
def op12(t: Tables):
    from sitelens.llm.repair import damaged, repair

    return repair(damaged(t.conversations)).withColumnRenamed("conv", "conv_id")


NEGATIVE_SQL = """
with good as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor(256 * x::double) for x in embedding] as e
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), pairs as (
  select a.vec_id as anchor_id, x.vec_id, a.label = x.label as same, list_dot_product(a.e, x.e)::bigint as score
  from good a join good x on a.vec_id <> x.vec_id and len(a.e) = len(x.e) where a.vec_id % 100 = 0
), positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from pairs where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select anchor_id, positive_id, (row_number() over (partition by anchor_id, positive_id order by score desc, vec_id))::integer as rank,
  vec_id as negative_id, positive_score, score as negative_score
from positives join pairs using (anchor_id)
where not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
qualify rank <= 5
"""


@query("op13_hard_negatives", NEGATIVE_SQL)
def op13(t: Tables):
    from sitelens.llm.hardneg import hard_negatives

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(t.embeddings.withColumn("label", moved), F.col("vec_id") % 100 == 0)
