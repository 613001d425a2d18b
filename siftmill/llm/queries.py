"""The queries opN_<name> over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table


def op1_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, find, written

    found = find(read_table(spark, sf_dir, "documents"))
    base, extra = F.col("base"), F.col("extra")
    counts = [F.size(F.filter(base, lambda b: b["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(base, extra).alias("spans"))


def op2_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    found = score(docs, fit(docs, labels.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.to_json("spans").alias("spans"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op4_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .caps import link_vectors

    return link_vectors(read_table(spark, sf_dir, "embeddings"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import cut_repeats

    cut = cut_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("runs", F.lit(0).cast("long"), lambda acc, r: acc + r["end"] - r["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("runs").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_chats, read_chats

    text = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return read_chats(format_chats(read_table(spark, sf_dir, "conversations").select(probe.columns).union(probe)), in_order=True)


def op8_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .pieces import round_trip

    return round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, identify

    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    found = identify(docs, fit(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "langs")


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import inspect, store

    return inspect(store(read_table(spark, sf_dir, "documents")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import hard_negatives

    return hard_negatives(read_table(spark, sf_dir, "embeddings"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact import exact_copies

    return exact_copies(read_table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tries import prefix_trie

    c = F.col("c")
    return prefix_trie(read_table(spark, sf_dir, "conversations"), borrow=F.crc32(c.cast("string")) % 4, base=c - c % 20, most=3)


_NEGATIVES = """with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
p as (select anchor_id, other as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, other) <= 5)
select p.anchor_id, positive_id, cast(row_number() over (partition by p.anchor_id, positive_id order by score desc, other) as integer) as rank, other as negative_id, positive_score, score as negative_score
from p join s on p.anchor_id = s.anchor_id and not s.same and 80 * positive_score <= 100 * score and score <= positive_score
qualify row_number() over (partition by p.anchor_id, positive_id order by score desc, other) <= 5"""

_EXACT = """select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size, row_number() over (partition by t order by doc_id desc nulls last) = 1 as kept, sha256(t) as text_sha256
from (select doc_id, coalesce(text, '') as t from documents) window same as (partition by t)"""

# DuckDB has no crc32: one step of the register for each bit.
_CRC = "xor(list_reduce(list_transform(string_split(cast(conv_id as varchar), ''), lambda x: cast(ascii(x) as bigint)), lambda a, b: list_reduce([1, 2, 3, 4, 5, 6, 7, 8], lambda r, i: xor(r >> 1, (r & 1) * 3988292384), xor(a, b)), 4294967295), 4294967295)"
_TRIE = f"""with t as (select conv_id, coalesce(role, '') || chr(10) || coalesce(text, '') as x, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as words,
    row_number() over (partition by conv_id order by turn nulls first, sha256(coalesce(role, '') || chr(10) || coalesce(text, ''))) - 1 as pos from conversations where conv_id is not null),
c as (select conv_id, {_CRC} % 4 as h from (select distinct conv_id from t)),
r as (select c.conv_id as c, 0 as own, t.pos, x, words from c join t on t.conv_id = c.conv_id - c.conv_id % 20 and t.pos < h union all select c.conv_id, 1, t.pos, x, words from c join t on t.conv_id = c.conv_id and t.pos >= h),
d as (select c, row_number() over (partition by c order by own, pos) as d, sha256(x) as x, words from r),
m as (select c, d, words, sha256(string_agg(x, ',') over (partition by c order by d rows unbounded preceding)) as k from d union all select conv_id, 0, 0, '' from c),
n as (select d, k, min(c) as conv, count(*) as n, any_value(words) as words from m group by d, k),
up as (select n.d, n.k, n.conv, n.n, n.words, m.k as parent from n left join m on m.c = n.conv and m.d = n.d - 1),
kids as (select parent, count(*) as kids from up where parent is not null group by parent),
own as (select up.*, coalesce(kids, 0) as kids, (n - 1) * words as saved from up left join kids on kids.parent = up.k),
below as (select m.k, sum(case when kids = 0 then 1 else 0 end) as leaves, sum(saved) as saved from own join m on m.c = own.conv and m.d <= own.d group by m.k),
ends as (select k, sha256(string_agg(cast(c as varchar), ',' order by c)) as ends from (select c, k from m qualify d = max(d) over (partition by c)) group by k)
select own.conv as conv_id, cast(own.d as bigint) as depth, p.conv as parent_conv_id, cast(own.n as bigint) as n_convs, cast(own.kids as bigint) as n_children, cast(leaves as bigint) as n_leaves, cast(below.saved as bigint) as saved_tokens, coalesce(ends, sha256('')) as ends_sha256
from own join below on below.k = own.k left join n p on p.k = own.parent left join ends on ends.k = own.k"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op11_hard_negatives": _NEGATIVES, "op12_exact_dedup": _EXACT, "op13_conversation_trie": _TRIE}
