"""The operators of this subpackage as queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytecnn, langid, mpegts, ngramjoin, packing, piececodec, rules, substrdedup, suffixdedup, tokencount


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = langid.held_out(folds=3, fold=1)
    model = langid.fit_languages(docs.where(~out))
    return langid.identify_languages(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score", "mixture")


def op2_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpegts.read_media(mpegts.with_media(read(spark, sf_dir, "documents")))


def op3_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    out = langid.held_out(folds=5, fold=0)
    model = bytecnn.fit_quality(docs, labels.where(~out))
    return bytecnn.score_quality(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(read(spark, sf_dir, "documents"), keep_text=False)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.similar_documents(read(spark, sf_dir, "documents"))


def op6_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op7_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piececodec.encode_decode(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), keep_ids=False)


def op8_rule_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    forest, threshold = rules.fit_rules(docs, labels)
    return rules.apply_rules(docs, forest, threshold).drop("anomaly")


def op9_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrdedup.remove_repeats(read(spark, sf_dir, "documents"), keep_text=False)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language_mixture, op2_transport_stream, op3_byte_cnn, op4_suffix_dedup, op5_jaccard_join, op6_certified_packing, op7_piece_codec, op8_rule_forest, op9_block_anchors, op10_token_counts)}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
ORACLE_SQL: dict[str, str] = {
    "op5_jaccard_join": f"""with recursive w as (select doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as t from documents),
s as (select distinct doc_id, unnest(case when len(t) >= 3 then [t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] for i in range(1, len(t) - 1)] when len(t) > 0 then [array_to_string(t, ' ')] else []::varchar[] end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 70 * (x.n + y.n - shared)),
e as (select a, b from l union all select b, a from l), d as (select a as doc_id, count(*) as n_similar from e group by a),
r(doc_id, other) as (select a, b from e union select r.doc_id, e.b from r join e on e.a = r.other), c as (select doc_id, least(doc_id, min(other)) as component_id from r group by doc_id)
select w.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(n_similar, 0) as n_similar, coalesce(component_id, w.doc_id) as component_id from w left join n using (doc_id) left join d using (doc_id) left join c using (doc_id)""",
    # The hexadecimal text stands for bytes. Pieces of 699 bytes keep the cost of substring apart from a text's length.
    "op4_suffix_dedup": """with b as (select doc_id, hex(coalesce(text, '')) as x from documents),
e as (select doc_id, base, substring(x, 2 * base + 1, 1398) as part from (select doc_id, x, unnest(range(0, length(x) // 2 - 199, 500)) as base from b)),
s as (select doc_id, base + j as i, md5(substring(part, 2 * j + 1, 400)) as h from (select *, unnest(range(length(part) // 2 - 199)) as j from e)),
f as (select doc_id, i from s semi join (select h from s group by h having count(*) > 1) using (h)),
g as (select doc_id, i, lag(i) over (partition by doc_id order by i) as before from f),
r as (select doc_id, i, sum((before is null or i > before + 200)::int) over (partition by doc_id order by i) as k from g),
p as (select doc_id, min(i) as lo, max(i) + 200 as hi from r group by doc_id, k),
q as (select doc_id, lo, hi, lag(hi, 1, 0) over w as from_, row_number() over w as k, count(*) over (partition by doc_id) as n from p window w as (partition by doc_id order by lo)),
c as (select doc_id, count(*) as n_spans, sum(hi - lo)::bigint as n_removed, string_agg(substring(x, (2 * from_ + 1)::bigint, (2 * (lo - from_))::bigint), '' order by lo) || substring(any_value(x), (2 * max(hi) + 1)::bigint) as kept from q join b using (doc_id) group by doc_id)
select b.doc_id, length(b.x) // 2 as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, b.x))) as kept_sha256 from b left join c using (doc_id)""",
    "op9_block_anchors": f"""with w as (select doc_id, {_WORDS.format("coalesce(text, '')")} as t from documents),
x as (select doc_id, i, md5(array_to_string(t[i : i + 49], ' ')) as h from (select doc_id, t, unnest(range(1, greatest(len(t) - 48, 1))) as i from w)),
f as (select h, min(doc_id) as least from x group by h), g as (select distinct doc_id, i + k as i from x join f using (h), range(50) k(k) where doc_id > least),
o as (select doc_id, unnest(t) as word, unnest(range(1, len(t) + 1)) as i from w),
k as (select doc_id, string_agg(word, ' ' order by i) as kept, count(*) as n from o anti join g using (doc_id, i) group by doc_id)
select w.doc_id, len(t)::bigint as n_words, len(t)::bigint - coalesce(k.n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join k using (doc_id)""",
}
