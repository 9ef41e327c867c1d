"""The registered queries opN_<name>: each operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldseries.operators.materialize import shared_folder

from . import byte_bpe, decontaminate, fingerprint, hard_negatives, language, line_dedup, main_text, merkle, near_dedup, pii, rlz_dedup, substring_dedup, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


@query("op3_language")
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    profiles = language.fit_profiles(docs.where(~held_out()))
    return language.predict(docs, profiles).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query("op9_byte_bpe")
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.tokens(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN).drop("ids")


LINE_SQL = r"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
x as (select doc_id, unnest(l) as line, generate_subscripts(l, 1) as pos from d),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from x),
c as (select key, max(doc_id) as keeper from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
m as (select k.*, c.keeper is not null and c.keeper <> k.doc_id as gone from k left join c on k.key = c.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from m group by doc_id
"""


@query("op10_line_dedup", LINE_SQL)
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_common_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


NEAR_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') as l from documents),
s as (
  select doc_id, list_distinct(case when len(l) = 0 then [] when len(l) < 5 then [array_to_string(l, ' ')]
         else list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' ')) end) as s from w),
n as (select doc_id, len(s) as n from s),
e as (select doc_id, hash(unnest(s)) as g from s),
i as (select a.doc_id as x, b.doc_id as y, count(*) as c from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
k as (select x, y from i join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= 75 * (p.n + q.n - c)),
b as (select x, y from k union all select y, x from k),
r as (select doc_id as x, doc_id as y from n union select r.x, b.y from r join b on r.y = b.x)
select n.doc_id, n.n as n_shingles, min(r.y) as component_id, min(r.y) = n.doc_id as kept
from n join r on r.x = n.doc_id group by n.doc_id, n.n
"""


@query("op1_near_dedup", NEAR_SQL)
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


@query("op2_decontaminate")
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op5_fingerprints")
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edits(documents(spark, sf_dir))


WARC_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as d from pages),
f as (select d, min(page_id) as first from p where n >= 100 group by d)
select p.page_id, p.n as payload_bytes, p.d as payload_digest,
       case when f.first < p.page_id then 'revisit' else 'response' end as record_type,
       case when f.first < p.page_id then f.first end as refers_to
from p left join f on p.d = f.d
"""


@query("op6_warc", WARC_SQL)
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    found = warc.read_archives(spark, folder)
    response = F.col("record_type") == "response"

    def number(urn: str):
        return F.nullif(F.regexp_extract(urn, r"^<urn:page:(-?\d*)>$", 1), F.lit("")).cast("long")

    return found.select(
        number("record_id").alias("page_id"),
        F.when(response, F.length("payload")).otherwise(F.col("payload_length")).cast("long").alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )


@query("op7_main_text")
def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


def _written(spans):
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in pii.KINDS])
    each = F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string")))
    return F.array_join(each, ",")


def _of_kind(spans: str, kind: int):
    """Number of spans of a kind. A second parameter of the lambda would be the position in the array."""
    return F.size(F.filter(spans, lambda x: x["kind"] == kind))


@query("op8_private")
def op8_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_private(documents(spark, sf_dir))
    counts = [_of_kind("base", k).cast("long").alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    every = F.array_sort(F.concat("base", "extra"))
    return found.select("doc_id", *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(every).alias("spans"), F.size("extra").cast("long").alias("n_extra"))


@query("op4_substrings")
def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.drop_repeats(documents(spark, sf_dir)).drop("kept")


@query("op13_merkle")
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    found = F.struct(*[F.col(c) for c in fields[:-1]], merkle.deleted_newlines().alias("text"))
    return merkle.manifest(docs, fields, "doc_id", "source", found)


NEGATIVES_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
c as (select vec_id, unnest(e) as x, generate_subscripts(e, 1) as i from v),
a as (select * from v where vec_id % 100 = 0),
ac as (select c.* from c where vec_id in (select vec_id from a)),
dot as (select ac.vec_id as anchor_id, c.vec_id as other_id, sum(ac.x * c.x) as score from ac join c on ac.i = c.i group by 1, 2),
s as (select a.vec_id as anchor_id, v.vec_id as other_id, a.label = v.label as same, coalesce(dot.score, 0)::bigint as score
      from a cross join v left join dot on dot.anchor_id = a.vec_id and dot.other_id = v.vec_id),
p as (select anchor_id, other_id as positive_id, score as positive_score from (
        select *, row_number() over (partition by anchor_id order by score desc, other_id) as r
        from s where same and other_id <> anchor_id) where r <= 5),
n as (select p.anchor_id, p.positive_id, p.positive_score, s.other_id as negative_id, s.score as negative_score,
             row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other_id) as rank
      from p join s on s.anchor_id = p.anchor_id and not s.same
      where 80 * p.positive_score <= 100 * s.score and s.score <= p.positive_score)
select anchor_id, positive_id, rank::integer as rank, negative_id, positive_score, negative_score from n where rank <= 5
"""


@query("op12_hard_negatives", NEGATIVES_SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


_FOLLOWING = ", ".join(f"lead(word, {k}) over o" for k in range(1, rlz_dedup.WINDOW))
RLZ_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as l from documents),
x as (select doc_id, unnest(l) as word, generate_subscripts(l, 1) as i from w),
k as (select doc_id, i, word, case when lead(word, 12) over o is not null then concat_ws(' ', word, FOLLOWING) end as win
      from x window o as (partition by doc_id order by i)),
f as (select win, min(doc_id) as first from k where win is not null group by win),
m as (select k.*, coalesce(f.first < k.doc_id, false) as dup from k left join f using (win)),
c as (select *, max(case when dup then i end) over (partition by doc_id order by i rows between unbounded preceding and current row) as last_dup from m),
g as (select doc_id, i, word, coalesce(last_dup >= i - 12, false) as gone from c)
select d.doc_id, count(g.i) as n_words, count(g.i) filter (where g.gone) as n_removed,
       sha256(coalesce(string_agg(g.word, ' ' order by g.i) filter (where not g.gone), '')) as kept_sha256
from documents d left join g on g.doc_id = d.doc_id group by d.doc_id
""".replace("FOLLOWING", _FOLLOWING)


@query("op11_rlz_dedup", RLZ_SQL)
def op11_rlz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rlz_dedup.drop_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
