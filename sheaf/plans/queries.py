"""Every operator as a query over the driver's tables, with the SQL that gives the same rows.

Fractions are rounded to nine places, since engines sum in their own order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import pages as P
from ..functions import text as T
from ..functions import vectors as V
from ..operators import decode, evaluate, metrics, models, sampling, streams, tfidf
from ..sources import corpus, registry
from . import views as X

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r9(c, name: str):
    return (F.round(c if not isinstance(c, str) else F.col(c), 9) + F.lit(0.0)).alias(name)


def numbered(array, *keys: str):
    """key, k, value of an array column."""
    return lambda df: df.select(*keys, F.posexplode(array).alias("k", "v")).select(*keys, F.col("k").cast("long").alias("k"), r9("v", "v"))


# streams


@query(f"with {X.V1}, {X.V2}, u as (select 'conv' as kind, * from v1 union all select 'doc', * from v2) select kind, stream_id, count(*) as n_pages, count_if(boundary)::bigint as n_documents, (min(pos) = 0 and max(pos) + 1 = count(*) and bool_or(pos = 0 and boundary)) as sound from u group by kind, stream_id")
def stream_validate(spark, d):
    one = lambda v, kind: streams.check_streams(v).select(F.lit(kind).alias("kind"), "stream_id", "n_pages", "n_documents", F.col("fault").isNull().alias("sound"))
    return one(X.conv_pages(spark, d), "conv").unionByName(one(X.doc_pages(spark, d), "doc"))


@query(f"with {X.V1}, {X.V2} select 'conv' as kind, count(distinct stream_id) as n_streams, count(*) as n_pages, count_if(boundary)::bigint as n_documents from v1 union all select 'doc', count(distinct stream_id), count(*), count_if(boundary)::bigint from v2")
def stream_summary(spark, d):
    one = lambda v, kind: streams.summary(v).select(F.lit(kind).alias("kind"), "*")
    return one(X.conv_pages(spark, d), "conv").unionByName(one(X.doc_pages(spark, d), "doc"))


@query(f"with {X.V1} select stream_id::varchar as stream_id, pos, 'conv:' || stream_id || '/' || pos as source, 0::bigint as page, boundary, text from v1")
def row_stream_explode(spark, d):
    pages = X.conv_pages(spark, d)
    nested = pages.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("pos", "boundary", "text"))).alias("p")).select("stream_id", F.col("p.boundary").alias("boundaries"), F.col("p.text").alias("texts"))
    c = corpus.from_rows(nested, "conv", texts="texts")
    return c.with_text().select("stream_id", "pos", "source", "page", "boundary", "text")


@query(f"with {X.V2} select stream_id, pos, source::varchar as source, page, boundary, text from v2")
def corpus_build(spark, d):
    c = corpus.build_corpus(X.doc_definitions(spark, d), X.doc_rows(spark, d))
    return c.with_text().select("stream_id", "pos", "source", "page", "boundary", "text")


@query(f"with {X.V2}, n as (select distinct stream_id from v2 order by stream_id limit 7) select source as doc_id, count(*) as n_pages, sum(length(text))::bigint as n_chars from v2 where stream_id in (select stream_id from n) group by source")
def needed_docs_semi(spark, d):
    first = corpus.first_streams(X.doc_definitions(spark, d), 7)
    return corpus.needed_rows(first, X.doc_rows(spark, d)).groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.sum(F.length("text")).alias("n_chars"))


@query(f"with {X.V2} select source as doc_id, count(*) as n_pages, sum(length(text))::bigint as n_chars from v2 group by source")
def needed_docs_all(spark, d):
    rows = corpus.needed_rows(corpus.first_streams(X.doc_definitions(spark, d), None), X.doc_rows(spark, d))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.sum(F.length("text")).alias("n_chars"))


@query(f"with {X.V1}, {X.V2} select 'c' || stream_id as stream_id, pos, 'c' || source as source, page, boundary, text from v1 union all select 'd' || stream_id, pos, 'd' || source, page, boundary, text from v2")
def corpus_concat(spark, d):
    def named(pages, kind):
        own = pages.withColumns({c: F.concat(F.lit(kind), F.col(c).cast("string")) for c in ("stream_id", "source")})
        return corpus.Corpus(own.drop("text"), own.select("source", "page", "text"))

    both = named(X.conv_pages(spark, d), "c").merged(named(X.doc_pages(spark, d), "d"))
    return both.with_text().select("stream_id", "pos", "source", "page", "boundary", "text")


@query(f"with {X.V1} select stream_id::varchar as stream_id, pos, page = 0 or page % 3 = 1 as boundary from v1")
def truthy_boundaries(spark, d):
    pages = X.conv_pages(spark, d).withColumn("mark", F.when(F.col("page") == 0, 7).otherwise(F.when(F.col("page") % 3 == 1, -1).otherwise(0)))
    nested = pages.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("pos", "mark"))).alias("p")).select("stream_id", F.col("p.mark").alias("boundaries"))
    return corpus.from_rows(nested, "conv").pages.select("stream_id", "pos", "boundary")


@query(f"with {X.V1} select stream_id, pos, case when page % 2 = 0 then text end as text from v1")
def lookup_not_strict(spark, d):
    pages = X.conv_pages(spark, d)
    side = pages.where("page % 2 = 0").select("source", "page", "text")
    return corpus.resolve(pages.drop("text"), side, "text", strict=False).select("stream_id", "pos", "text")


@query(f"with {X.V1} select stream_id, pos, boundary, true as replaced from v1")
def replace_boundaries(spark, d):
    """Every page a boundary, in place of the true ones (boundary: what it was)."""
    pages = X.conv_pages(spark, d).drop("text")
    made = streams.with_boundaries(pages, pages.select("stream_id", "pos", F.lit(True).alias("boundary")))
    return made.withColumnRenamed("boundary", "replaced").join(pages.select("stream_id", "pos", "boundary"), ["stream_id", "pos"]).select("stream_id", "pos", "boundary", "replaced")


@query(f"with {X.V3} select stream_id, pos, prob, pos = 0 or prob > 0.5::double as pred from v3")
def threshold_pred(spark, d):
    return decode.threshold(X.event_pages(spark, d).select("stream_id", "pos", "prob"))


@query(f"with {X.V1} select stream_id, pos, case when page % 2 = 0 then round(page * 14 / 10.0::double, 9) else 0.0::double end as total from v1")
def missing_page_default(spark, d):
    pages = X.conv_pages(spark, d)
    known = pages.where("page % 2 = 0").select("source", "page", F.array_repeat(F.col("page") / 10, 14).alias("layout"))
    out = corpus.with_default(pages, known, "layout", P.LAYOUT_SIZE)
    return out.select("stream_id", "pos", r9(F.aggregate("layout", F.lit(0.0), lambda s, v: s + v), "total"))


@query(f"with {X.V1}, n as (select stream_id, count(*) as n from v1 group by stream_id) select stream_id, pos, source, page, boundary from v1 where stream_id in (select stream_id from n where n between 20 and 28)")
def filter_by_length(spark, d):
    return streams.filter_by_length(X.conv_pages(spark, d), 20, 28).drop("text")


@query(f"with {X.V1}, n as (select stream_id, count(*) as n from v1 group by stream_id) select source, page, text from v1 where stream_id in (select stream_id from n where n between 20 and 28)")
def prune_side_table(spark, d):
    pages = X.conv_pages(spark, d)
    c = corpus.Corpus(pages.drop("text"), pages.select("source", "page", "text"))
    return c.filtered(20, 28).text


# text


@query("select doc_id, case when length(text) <= 4000 then text else left(text, 2000) || ' ' || right(text, 2000) end as cut from (select doc_id, coalesce(text, '') as text from documents)")
def truncate_head_tail(spark, d):
    return X.read(spark, d, "documents").select("doc_id", T.truncate(F.col("text")).alias("cut"))


@query(f"with {X.V2} select stream_id, pos, left(text, 300) as head, right(text, 300) as foot from v2")
def head_foot_slices(spark, d):
    return X.doc_pages(spark, d).select("stream_id", "pos", F.left("text", F.lit(300)).alias("head"), F.right("text", F.lit(300)).alias("foot"))


_STRIP = r"regexp_replace(text, '^[\s\x0B\x{1C}-\x{1F}\x{85}\p{Z}]+|[\s\x0B\x{1C}-\x{1F}\x{85}\p{Z}]+$', '', 'g')"


def _grams(text: str, n: int) -> str:
    return f"case when length({text}) = 0 then []::varchar[] when length({text}) < {n} then [{text}] else list_distinct([substring({text}, i, {n}) for i in range(1, length({text}) - {n} + 2)]) end"


def _jaccard(a: str, b: str) -> str:
    return f"case when len({a}) = 0 and len({b}) = 0 then 1.0::double else len(list_intersect({a}, {b}))::double / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) end"


_G1 = f"{X.V1}, s1 as (select stream_id, pos, boundary, {_STRIP} as t from v1), g1 as (select stream_id, pos, boundary, {_grams('t', 4)} as g from s1), p1 as (select *, lag(g) over (partition by stream_id order by pos) as q from g1), j1 as (select stream_id, pos, boundary, case when pos = 0 then 1.0::double else 1 - ({_jaccard('q', 'g')}) end as prob from p1)"


@query(f"with {_G1}, x as (select stream_id, pos, unnest(g) as gram from g1) select stream_id, pos, gram from x")
def char_ngrams(spark, d):
    return X.conv_pages(spark, d).select("stream_id", "pos", F.explode(T.char_ngrams(F.col("text"), 4)).alias("gram"))


@query(f"with {_G1} select stream_id, pos, round({_jaccard('q', 'g')}, 9) as similarity from p1 where pos >= 1")
def jaccard_pairs(spark, d):
    p = streams.pairs(X.conv_pages(spark, d), "text")
    return p.select("stream_id", "pos", r9(T.gram_similarity(F.col("prev_text"), F.col("curr_text"), 4), "similarity"))


@query(f"with {_G1} select stream_id, pos, round(prob, 9) as prob from j1")
def text_similarity_probs(spark, d):
    return models.TextSimilarity().probs(X.conv_pages(spark, d)).select("stream_id", "pos", r9("prob", "prob"))


@query(f"with {_G1} select stream_id, pos, pos = 0 or prob > 1 - 0.15::double as pred from j1")
def text_similarity_boundaries(spark, d):
    return models.TextSimilarity().predict(X.conv_pages(spark, d)).select("stream_id", "pos", "pred")


_CLASS = {"words": r"[\p{L}\p{N}_]+", "alpha": r"\p{L}", "digits": r"\p{Nd}", "upper": r"\p{Lu}", "punct": r"[.,;:!?\-/]"}
_F2 = (
    X.V2
    + ", c2 as (select stream_id, pos, text, length(text)::double as n, "
    + ", ".join(f"len(regexp_extract_all(text, '{p}'))::double as {k}" for k, p in _CLASS.items())
    + r", length(case when contains(text, chr(10)) then regexp_extract(text, '^[^\n\r\x0B\f\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]*') else left(text, 100) end)::double as line from v2), "
    + "f2 as (select stream_id, pos, case when n = 0 then [0.0::double for i in range(8)] else [ln(1 + n), words / n * 100, case when words > 0 then n / words else 0 end, alpha / n, digits / n, upper / greatest(alpha, 1), punct / n, line / n] end as f from c2)"
)


@query(f"with {_F2} select stream_id, pos, k - 1 as k, round(f[k], 9) + 0 as v from f2, range(1, 9) r(k)")
def page_features(spark, d):
    return numbered("f", "stream_id", "pos")(X.doc_pages(spark, d).withColumn("f", T.page_features(F.col("text"))))


_RUNS = r"len(list_filter(regexp_extract_all({}, '\p{{Nd}}+'), lambda x: length(x) <= 4))::bigint"


@query(f"with {X.V2} select stream_id, pos, {_RUNS.format('text')} as runs from v2")
def digit_runs(spark, d):
    return X.doc_pages(spark, d).select("stream_id", "pos", T.digit_runs(F.col("text")).cast("long").alias("runs"))


def _cross_sql() -> str:
    slices = [f"left(text, {n})" for n in (50, 150, 300, 600)] + [f"right(text, {n})" for n in (50, 150, 300, 600)] + ["text", "left(text, 50)", "right(text, 50)"]
    strips = ", ".join(f"{_STRIP.replace('text,', s + ',')} as t{k}" for k, s in enumerate(slices))
    grams = ", ".join(f"{_grams(f't{k}', 3 if k > 8 else 4)} as g{k}" for k in range(11))
    words = r"list_distinct(list_filter(regexp_split_to_array(lower(left(text, 300)), '[\s\x0B\x{1C}-\x{1F}\x{85}\p{Z}]+'), lambda w: w <> '')) as g11"
    lags = ", ".join(f"lag({c}) over w as p_{c}" for c in [*(f"g{k}" for k in range(12)), "n", "runs"])
    values = ", ".join(_jaccard(f"p_g{k}", f"g{k}") for k in range(12))
    return f"""with {X.V1}, s as (select stream_id, pos, text, length(text)::double as n, {_RUNS.format("right(text, 300)")}::double as runs, {strips} from v1), g as (select stream_id, pos, n, runs, {grams}, {words} from s),
p as (select *, {lags} from g window w as (partition by stream_id order by pos)), f as (select stream_id, pos, [{values}, least(greatest(n, 1), greatest(p_n, 1)) / greatest(n, p_n, 1), abs(ln(1 + p_n) - ln(1 + n)), p_runs, runs, abs(p_runs - runs)] as f from p where pos >= 1)
select stream_id, pos, k - 1 as k, round(f[k], 9) + 0 as v from f, range(1, 18) r(k)"""


@query(_cross_sql())
def cross_page_features(spark, d):
    p = streams.pairs(X.conv_pages(spark, d), "text")
    return numbered("f", "stream_id", "pos")(p.withColumn("f", T.cross_features(F.col("prev_text"), F.col("curr_text"))))


@query(f"with {X.V1}, n as (select *, count(*) over (partition by stream_id) as n_pages from v1) select stream_id, pos, n_pages, round(pos / greatest(n_pages - 1, 1)::double, 9) as relative, round((n_pages - 1 - pos) / greatest(n_pages - 1, 1)::double, 9) as remaining from n")
def position_features(spark, d):
    return streams.positions(X.conv_pages(spark, d)).select("stream_id", "pos", "n_pages", r9("relative", "relative"), r9("remaining", "remaining"))


# vectors


_P4 = f"{X.V4}, p4 as (select *, lag(embedding) over (partition by stream_id order by pos) as prev from v4)"


@query(f"with {_P4}, x as (select stream_id, pos, prev || embedding || [prev[i] - embedding[i] for i in range(1, 65)] || [abs(prev[i] - embedding[i]) for i in range(1, 65)] || [prev[i] * embedding[i] for i in range(1, 65)] as f from p4 where pos >= 1) select stream_id, pos, k - 1 as k, round(f[k], 9) + 0 as v from x, range(1, 321) r(k)")
def pair_expand(spark, d):
    p = streams.pairs(X.vec_pages(spark, d), "embedding")
    a, b = F.col("prev_embedding"), F.col("curr_embedding")
    return numbered("f", "stream_id", "pos")(p.withColumn("f", F.concat(V.pair_difference(a, b), F.slice(V.pair_product(a, b), 129, 64))))


@query(f"with {_P4} select stream_id, pos, round(list_dot_product(prev, embedding) / ((sqrt(list_dot_product(prev, prev)) + 1e-9) * (sqrt(list_dot_product(embedding, embedding)) + 1e-9)), 9) as cosine from p4 where pos >= 1")
def embedding_cosine(spark, d):
    p = streams.pairs(X.vec_pages(spark, d), "embedding")
    return p.select("stream_id", "pos", r9(V.cosine(F.col("prev_embedding"), F.col("curr_embedding")), "cosine"))


_L5 = X.V5 + (
    ", l5 as (select page, [ln(1 + count(*)), avg((y < 0.2)::int), avg((y > 0.8)::int), avg((x < 0.3)::int), avg((x > 0.7)::int), avg((x < 0.4 and y < 0.2)::int), avg((y >= 0.3 and y <= 0.7)::int), avg(y), stddev_pop(y), avg(x), min(y), max(y), least(1.0::double, sum(h * w)), avg(h)] as f from v5 group by page)"
)


@query(f"with {_L5} select page, k - 1 as k, round(f[k], 9) + 0 as v from l5, range(1, 15) r(k)")
def ocr_layout(spark, d):
    cols = [F.col(c) for c in "xywh"]
    return numbered("f", "page")(X.ocr_words(spark, d).groupBy("page").agg(F.array(*P.layout_aggregates(*cols)).alias("f")))


@query(f"with {_L5}, p as (select page, f, lag(f) over (partition by page // 100 order by page) as q from l5) select page, round(list_dot_product(q, f) / ((sqrt(list_dot_product(q, q)) + 1e-9) * (sqrt(list_dot_product(f, f)) + 1e-9)), 9) as cosine from p where q is not null")
def layout_cosine(spark, d):
    cols = [F.col(c) for c in "xywh"]
    pages = X.ocr_words(spark, d).groupBy("page").agg(F.array(*P.layout_aggregates(*cols)).alias("f"))
    w = W.partitionBy(F.floor(F.col("page") / 100)).orderBy("page")
    return pages.withColumn("q", F.lag("f").over(w)).where("q is not null").select("page", r9(V.cosine(F.col("q"), F.col("f")), "cosine"))


@query(f"with {_L5}".replace("from lineitem)", "from lineitem), c5 as (select page, x - w / 2 as x1, x + w / 2 as x3, y - h / 2 as y1, y + h / 2 as y3 from v5), b5 as (select page, (x1 + x3) / 2 as x, (y1 + y3) / 2 as y, abs(x3 - x1) as w, abs(y3 - y1) as h from c5)").replace("from v5 group by page", "from b5 group by page") + " select page, k - 1 as k, round(f[k], 9) + 0 as v from l5, range(1, 15) r(k)")
def ocr_layout_json(spark, d):
    """ocr_layout from JSON payloads, parsed in the JVM."""
    c = lambda a, s, n: F.col(a) + F.col(n) / 2 if s > 0 else F.col(a) - F.col(n) / 2
    corners = F.struct(F.lit("w").alias("Word"), *(c("x", -1 if k in (1, 4) else 1, "w").alias(f"X{k}") for k in range(1, 5)), *(c("y", -1 if k < 3 else 1, "h").alias(f"Y{k}") for k in range(1, 5)))
    pages = X.ocr_words(spark, d).groupBy("page").agg(F.to_json(F.struct(F.collect_list(corners).alias("lines_data"))).alias("ocr"))
    return numbered("f", "page")(pages.withColumn("f", P.ocr_layout_of_lines(F.col("ocr"))))


@query("""select event_id, event_type || ' ' || user_id::varchar as text from events""")
def ocr_text(spark, d):
    e = X.read(spark, d, "events")
    payload = F.to_json(F.struct(F.col("value").alias("score"), F.array(F.struct(F.struct(F.col("event_type").alias("text"), F.lit(1).alias("page")).alias("line"), F.struct(F.col("user_id").cast("string").alias("content")).alias("more"))).alias("pages")))
    return e.select("event_id", P.ocr_text(payload).alias("text"))


# labels and metrics


_D3 = f"{X.V3}, d3 as (select stream_id, pos, truth, pred, sum(truth::int) over w - 1 as t, sum(pred::int) over w - 1 as p from v3 window w as (partition by stream_id order by pos))"


@query(f"with {_D3} select stream_id, pos, t::bigint as doc from d3")
def doc_ids(spark, d):
    return X.event_pages(spark, d).select("stream_id", "pos", streams.document_ids("truth").alias("doc"))


@query(f"with {_D3} select stream_id, t::bigint as doc, min(pos) as start, max(pos) + 1 as stop from d3 group by stream_id, t")
def spans(spark, d):
    return streams.spans(X.event_pages(spark, d), "truth")


_PRF = _D3 + """, n as (select stream_id, count_if(pos > 0 and truth and pred) as tp, count_if(pos > 0 and pred) as np, count_if(pos > 0 and truth) as nt from v3 group by stream_id),
prf as (select stream_id, case when np > 0 then tp / np::double else 0 end as p, case when nt > 0 then tp / nt::double else 0 end as r from n),
page as (select stream_id, p as "precision", r as recall, case when p + r > 0 then 2 * p * r / (p + r) else 0 end as f1 from prf)"""
_PQ = """, m as (select stream_id, t, p, count(*) as n from d3 group by stream_id, t, p), mt as (select stream_id, t, sum(n) as nt from m group by stream_id, t), mp as (select stream_id, p, sum(n) as np from m group by stream_id, p),
i as (select stream_id, n / (nt + np - n)::double as iou from m join mt using (stream_id, t) join mp using (stream_id, p)), h as (select stream_id, count(*) as tp, sum(iou) as s from i where iou > 0.5 group by stream_id),
z as (select stream_id, count_if(truth) + count_if(pred) as docs from v3 group by stream_id), pan as (select stream_id, coalesce(2.0::double * tp / docs, 0) as rq, coalesce(s / tp, 0) as sq, coalesce(2.0::double * tp / docs * s / tp, 0) as pq from z left join h using (stream_id))"""
_EX = ", ex as (select stream_id, bool_and(truth = pred) as exact from v3 group by stream_id)"
_DR = """, turn as (select stream_id, p, row_number() over (partition by stream_id order by sum(n) desc, p) as k, sum(n)::bigint as size, list({'t': t::bigint, 'n': n} order by n desc, t) as wishes from m group by stream_id, p),
fold(stream_id, k, taken, good) as (select distinct stream_id, 0::bigint, []::bigint[], 0::bigint from turn union all
 select f.stream_id, f.k + 1, case when b.c is null then f.taken else list_append(f.taken, b.c.t) end, f.good + coalesce(b.c.n, 0) from fold f join turn using (stream_id), lateral (select list_filter(wishes, lambda x: not list_contains(f.taken, x.t))[1] as c) b where turn.k = f.k + 1),
dr as (select stream_id, any_value(n.n) - max_by(good, k) as drags from fold join (select stream_id, sum(size)::bigint as n from turn group by stream_id) n using (stream_id) group by stream_id)"""


def _rec(sql: str) -> str:
    return "with recursive " + sql


@query(f'with {_PRF} select stream_id, round("precision", 9) as "precision", round(recall, 9) as recall, round(f1, 9) as f1 from page')
def page_prf(spark, d):
    return metrics.page_scores(X.event_pages(spark, d)).select("stream_id", r9("precision", "precision"), r9("recall", "recall"), r9("f1", "f1"))


@query(f"with {_D3}{_PQ} select stream_id, round(rq, 9) as rq, round(sq, 9) as sq, round(pq, 9) as pq from pan")
def panoptic_quality(spark, d):
    return metrics.panoptic(X.event_pages(spark, d)).select("stream_id", *(r9(c, c) for c in ("rq", "sq", "pq")))


@query(f"with {X.V3}{_EX} select count(*) as n_streams, round(avg(exact::int), 9) as stp from ex")
def stp(spark, d):
    return metrics.exact(X.event_pages(spark, d)).agg(F.count("*").alias("n_streams"), r9(F.avg(F.col("exact").cast("double")), "stp"))


@query(_rec(f"{_D3}, m as (select stream_id, t, p, count(*) as n from d3 group by stream_id, t, p){_DR} select stream_id, drags from dr"))
def mndd(spark, d):
    return metrics.drags(X.event_pages(spark, d))


@query(_rec(f"{_PRF}{_PQ}{_EX}{_DR} select count(*) as n_streams, round(avg(f1), 9) as page_f1_mean, round(avg(pq), 9) as pq_mean, round(avg(exact::int), 9) as stp, round(avg(drags), 9) as mndd_mean from page join pan using (stream_id) join ex using (stream_id) join dr using (stream_id)"))
def eval_report(spark, d):
    out = metrics.report(X.event_pages(spark, d))
    return out.select("n_streams", *(r9(c, c) for c in out.columns[1:]))


# the flagship: text similarity on conversations, scored

_T1 = _G1 + ", v3 as (select stream_id, pos, boundary as truth, pos = 0 or prob > 1 - 0.15::double as pred from j1)"


@query(_rec(f"{_T1}, {_PRF[len(X.V3) + 2 :]}{_PQ}{_EX}{_DR} select count(*) as n_streams, round(avg(f1), 9) as page_f1_mean, round(avg(pq), 9) as pq_mean, round(avg(exact::int), 9) as stp, round(avg(drags), 9) as mndd_mean from page join pan using (stream_id) join ex using (stream_id) join dr using (stream_id)"))
def similarity_report(spark, d):
    out = evaluate.evaluate(models.TextSimilarity(), X.conv_pages(spark, d))
    return out.select("n_streams", *(r9(c, c) for c in out.columns[1:]))


# decoding


_TRANSITIONS = "x as (select stream_id, pos, truth, lag(truth) over (partition by stream_id order by pos) as before from v3), c as (select count_if(not before) as s, count_if(not before and truth) as sn, count_if(before) as n, count_if(before and truth) as nn, count(before) as every, count_if(before is not null and truth) as hits from x)"


@query(f"with {X.V3}, {_TRANSITIONS} select round(greatest(least(sn / s::double, 1 - 1e-9), 1e-9), 9) as same_to_new, round(greatest(least(nn / n::double, 1 - 1e-9), 1e-9), 9) as new_to_new, round(hits / every::double, 9) as boundary_rate from c")
def viterbi_calibrate(spark, d):
    r = decode.calibrate(X.event_pages(spark, d).withColumnRenamed("truth", "boundary"))
    return spark.range(1).select(*(r9(F.lit(getattr(r, k)), k) for k in ("same_to_new", "new_to_new", "boundary_rate")))


_VITERBI = _rec(
    X.V3
    + """, k as (select ln(0.3::double) as sn, ln(0.7::double) as ss, ln(0.6::double) as nn, ln(0.4::double) as ns),
e as (select stream_id, pos, ln(greatest(1 - prob, 1e-9)) as e0, ln(greatest(prob, 1e-9)) as e1 from v3),
f(stream_id, pos, d0, d1, b0, b1) as (select stream_id, pos, '-inf'::double, 0::double, 0, 0 from e where pos = 0 union all
 select f.stream_id, e.pos, greatest(f.d0 + ss, f.d1 + ns) + e0, greatest(f.d0 + sn, f.d1 + nn) + e1, case when f.d0 + ss >= f.d1 + ns then 0 else 1 end, case when f.d0 + sn >= f.d1 + nn then 0 else 1 end from f join e on e.stream_id = f.stream_id and e.pos = f.pos + 1, k),
l as (select stream_id, max(pos) as pos from e group by stream_id),
g(stream_id, pos, state) as (select f.stream_id, f.pos, case when d0 > d1 then 0 else 1 end from f join l using (stream_id, pos) union all
 select g.stream_id, g.pos - 1, case when g.state = 0 then f.b0 else f.b1 end from g join f on f.stream_id = g.stream_id and f.pos = g.pos where g.pos > 0)
select stream_id, pos, state = 1 or pos = 0 as pred from g"""
)


@query(_VITERBI)
def viterbi_decode(spark, d):
    return decode.smooth(X.event_pages(spark, d), decode.Rates(0.3, 0.6))


@query(f"with {_G1} select stream_id, pos, round(case when pos = 0 then 1.0::double else (3 * prob + 1.0) / 5 end, 9) as prob from j1")
def late_ensemble(spark, d):
    pages = X.conv_pages(spark, d)
    parts = [m.predict(pages) for m in (models.TextSimilarity(), models.EveryPage(), models.NeverSplit())]
    return decode.late_ensemble(parts, [3.0, 1.0, 1.0]).select("stream_id", "pos", r9("prob", "prob"))


_NEAR = ", ".join(f"coalesce(lag(prob, {-k}) over w, 0) as near_{k + 2}" if k < 0 else f"coalesce(lead(prob, {k}) over w, 0) as near_{k + 2}" for k in range(-2, 3))


@query(f"with {X.V3}, a as (select stream_id, pos, {_NEAR}, coalesce(max(case when pos >= 1 then prob end) over s, 0) as tail_max, coalesce(avg(case when pos >= 1 then prob end) over s, 0) as tail_mean, coalesce(stddev_pop(case when pos >= 1 then prob end) over s, 0) as tail_std, count(*) over s as n_pages from v3 window w as (partition by stream_id order by pos), s as (partition by stream_id)) select stream_id, pos, " + ", ".join(f"round(near_{k}, 9) as near_{k}" for k in range(5)) + ", round(tail_max, 9) as tail_max, round(tail_mean, 9) as tail_mean, round(tail_std, 9) as tail_std, n_pages from a")
def window_probs(spark, d):
    out = streams.neighbours(X.event_pages(spark, d))
    names = [*(f"near_{k}" for k in range(5)), "tail_max", "tail_mean", "tail_std"]
    return out.select("stream_id", "pos", *(r9(c, c) for c in names), "n_pages")


# TF-IDF


_TF = (
    X.V2
    + r", w as (select stream_id, pos, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') as t from v2), x as (select stream_id, pos, unnest(t || [t[i] || ' ' || t[i + 1] for i in range(1, len(t))]) as term from w), tf as (select stream_id, pos, term, count(*) as tf from x group by all), "
    + "v as (select term, sum(tf) as total, count(*) as df from tf group by term order by total desc, term limit 2000), n as (select count(*) as n from v2), raw as (select stream_id, pos, term, (1 + ln(tf)) * (ln((1 + n)::double / (1 + df)) + 1) as w from tf join v using (term), n), "
    + "len as (select stream_id, pos, sqrt(sum(w * w)) as l from raw group by all), wt as (select stream_id, pos, term, w / l as weight from raw join len using (stream_id, pos))"
)


def _tfidf(spark, d) -> tuple[DataFrame, list]:
    """Pages with cells, and the vocabulary."""
    pages = X.doc_pages(spark, d)
    vocab = tfidf.vocabulary(X.doc_rows(spark, d), 2000)
    return pages.select("stream_id", "pos", tfidf.cells(F.col("text"), vocab).alias("cells")), vocab


@query(f"with {_TF} select stream_id, pos, term, round(weight, 9) as weight from wt")
def tfidf_weights(spark, d):
    pages, vocab = _tfidf(spark, d)
    terms = F.broadcast(spark.createDataFrame([(r["idx"], r["term"]) for r in vocab], "idx int, term string"))  # 2,000 rows
    return pages.select("stream_id", "pos", F.explode("cells").alias("c")).select("stream_id", "pos", "c.*").join(terms, "idx").select("stream_id", "pos", "term", r9("weight", "weight"))


@query(f"with {_TF}, c as (select b.stream_id, b.pos, sum(a.weight * b.weight) as cosine from wt a join wt b on a.stream_id = b.stream_id and a.pos + 1 = b.pos and a.term = b.term group by all) select v2.stream_id, v2.pos, round(coalesce(cosine, 0), 9) as cosine from v2 left join c using (stream_id, pos) where v2.pos >= 1")
def tfidf_pair_cosine(spark, d):
    pages, _ = _tfidf(spark, d)
    both = pages.withColumn("prev", F.lag("cells").over(streams.in_order())).where("pos >= 1")
    return both.select("stream_id", "pos", r9(tfidf.cosine(F.col("prev"), F.col("cells")), "cosine"))


# corpora and splits


@query("select conv_id as source, turn as page, case when role = 'user' then '> ' || text else text end as text from conversations")
def merge_right_wins(spark, d):
    c = X.read(spark, d, "conversations").withColumnsRenamed({"conv_id": "source", "turn": "page"})
    left = c.select("source", "page", "text")
    return corpus.right_wins(left, c.where("role = 'user'").select("source", "page", F.concat(F.lit("> "), F.col("text")).alias("text")))


_ORD = f"{X.V1}, o as (select stream_id, row_number() over (order by stream_id) - 1 as ord, count(*) over () as n from (select distinct stream_id from v1))"


@query(f"with {_ORD} select stream_id, ord < greatest(1, floor(n * 0.8)) as train from o")
def train_test_split(spark, d):
    return streams.split_streams(X.conv_pages(spark, d), 0.8).select("stream_id", "train").distinct()


@query("with o as (select source, row_number() over (order by source) - 1 as ord, count(*) over () as n_all from (select distinct 'doc/' || doc_id as source from documents)) select * from o")
def string_ordinals(spark, d):
    return streams.ordinals(X.read(spark, d, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("source")), "source").select("source", "ord", "n_all")


@query(f"with {_ORD} select stream_id, ord // (n // 3) as slice_id from o where ord // (n // 3) < 3")
def slices(spark, d):
    return streams.slice_streams(X.conv_pages(spark, d), 3).select("stream_id", "slice_id").distinct()


@query(f"""with {_ORD}, s as (select v1.*, ord // (n // 4) as slice_id from v1 join o using (stream_id) where ord // (n // 4) < 4), t as (select slice_id, stream_id, count(*) as n, count_if(boundary) as k from s group by all)
select 'every_page' as model, slice_id - 1 as step, count(*) as n_streams, round(avg(case when k > 1 then 2.0 * ((k - 1) / (n - 1)::double) / ((k - 1) / (n - 1)::double + 1) else 0 end), 9) as page_f1_mean, round(avg((n = k)::int), 9) as stp from t where slice_id > 0 group by slice_id
union all select 'never_split', slice_id - 1, count(*), 0.0::double, round(avg((k = 1)::int), 9) from t where slice_id > 0 group by slice_id""")
def walk_forward_trivial(spark, d):
    pages = streams.slice_streams(X.conv_pages(spark, d), 4).withColumn("slice_name", F.col("slice_id").cast("string"))
    rows = evaluate.walk_forward([models.EveryPage(), models.NeverSplit()], pages)
    return spark.createDataFrame([(r.model, len(r.train_slices) - 1, r.n_streams, round(r.page_f1_mean, 9), round(r.stp, 9)) for r in rows], "model string, step long, n_streams long, page_f1_mean double, stp double")


_U = "('0x' || substr(md5({}), 1, 8))::ubigint / 4294967296.0::double"


def _poisson_sql(mean: float, most: int, tag: str = "poisson") -> str:
    draw = _U.format(f"concat_ws('|', 0, '{tag}', s, k)")
    return f"ps as (select s, k, {draw} as u from (select range as s from range(200)), (select range as k from range({most}))), pc as (select s, k, sum(ln(u)) over (partition by s order by k) as logs from ps), po as (select s, count_if(logs > {-mean}) as n from pc group by s)"


@query(f"with {_poisson_sql(5.0, 61)} select s as id, n::bigint as n from po")
def poisson_draws(spark, d):
    return spark.range(200).select("id", sampling.poisson(5.0, 0, F.col("id")).cast("long").alias("n"))


def _specs_sql(pool: str, streams_n: int, seed: int) -> str:
    u = _U.format(f"concat_ws('|', {seed}, 'doc', s, ord)")
    poisson = _poisson_sql(3.0, 53).replace("concat_ws('|', 0,", f"concat_ws('|', {seed},").replace("range(200)", f"range({streams_n})")
    return f"{poisson}, pool as ({pool}), pick as (select s, source, row_number() over (partition by s order by {u}, ord) - 1 as doc_ord from po, pool qualify doc_ord < greatest(1, least(n, (select count(*) from pool))))"


_RESAMPLED = "select s as stream_id, row_number() over (partition by s order by doc_ord, turn) - 1 as pos, conv_id as source, turn as page, turn = 0 as boundary from pick join conversations on conv_id = source"


@query(f"with {_specs_sql('select distinct conv_id as source, dense_rank() over (order by conv_id) - 1 as ord from conversations', 200, 0)} {_RESAMPLED}")
def resample_streams(spark, d):
    return sampling.resample(X.conv_pages(spark, d), 200, 3.0, 0).select("stream_id", "pos", "source", "page", "boundary")


_SPLIT = f"u as (select conv_id as source, {_U.format(chr(39).join(['concat_ws(', '|', ', 0, ', 'split', ', conv_id)']))} as u from (select distinct conv_id from conversations)), sp as (select source, row_number() over (order by u, source) - 1 < greatest(1, floor(count(*) over () * 0.8)) as train from u)"


@query(f"with {_SPLIT} select source, train from sp")
def fair_split(spark, d):
    return sampling.doc_split(X.conv_pages(spark, d), 0.8, 0)


@query(f"with {_SPLIT} select train, count(*) as n_docs, 0::bigint as shared from sp group by train")
def fair_split_disjoint(spark, d):
    """The documents of each side, and how many the sides' streams share: none."""
    pages = X.conv_pages(spark, d).drop("text")
    split, made = sampling.doc_split(pages, 0.8, 0), sampling.fair_split(pages, 400, 100, 3.0, 0.8, 0)
    sides = made.select("source", "train").distinct()
    both = sides.groupBy("source").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("shared"))
    return split.groupBy("train").agg(F.count("*").alias("n_docs")).crossJoin(F.broadcast(both))  # one row


_KFOLD = f"u as (select stream_id, {_U.format(chr(39).join(['concat_ws(', '|', ', 0, ', 'fold', ', stream_id)']))} as u from (select distinct conv_id // 5 as stream_id from conversations))"


@query(f"with {_KFOLD} select stream_id, ntile(3) over (order by u, stream_id) - 1 as fold from u")
def kfold(spark, d):
    return sampling.kfold(X.conv_pages(spark, d), 3, 0)


@query(f"with {X.V1} select stream_id, pos, 1.0::double as prob, true as pred from v1")
def trivial_every_page(spark, d):
    return models.EveryPage().predict(X.conv_pages(spark, d))


@query(f"with {X.V1} select stream_id, pos, (pos = 0)::int::double as prob, pos = 0 as pred from v1")
def trivial_never_split(spark, d):
    return models.NeverSplit().predict(X.conv_pages(spark, d))


@query("select * from (values " + ", ".join(f"('{n}', '{','.join(langs)}', '{m}', '{lab}', {pages if pages is not None else -1}::bigint)" for n, langs, m, lab, pages in registry._ROWS) + ") t(name, languages, modality, labeling, pages_estimate)")
def source_registry(spark, d):
    return registry.known().frame(spark).select("name", F.array_join("languages", ",").alias("languages"), "modality", "labeling", F.coalesce("pages_estimate", F.lit(-1)).alias("pages_estimate"))


@query("select name, rpad(name, greatest(24, length(name))::int, ' ') || ' ' || rpad(langs, greatest(10, length(langs))::int, ' ') || ' ' || lpad(coalesce(format('{:,}', pages), '?'), 12, ' ') || ' ' as line from (values " + ", ".join(f"('{n}', '{','.join(langs)}', {pages if pages is not None else 'null'}::bigint)" for n, langs, _, _, pages in registry._ROWS) + ") t(name, langs, pages)")
def source_listing(spark, d):
    return registry.listing(registry.known().frame(spark))


@query(f"with {X.V2}, n as (select source, stream_id, count(*) as n from v2 group by all) select stream_id, row_number() over (partition by stream_id order by source, k) - 1 as pos, source::varchar as source, k as page, k = 0 as boundary from (select *, unnest(range(n)) as k from n)")
def concat_streams(spark, d):
    sizes = X.doc_rows(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_pages"))
    parts = X.doc_definitions(spark, d).join(sizes, "doc_id").select("stream_id", "doc_ord", F.col("doc_id").cast("string").alias("source"), "n_pages")
    return corpus.concat_sources(parts)


# learning: no SQL for these

def _report(spark, d, model, pages) -> DataFrame:
    split = streams.split_streams(pages, 0.8)
    model.fit(split.where("train").drop("train"))
    return evaluate.evaluate(model, split.where("not train").drop("train"))


@query()
def tfidf_gbt_eval(spark, d):
    return _report(spark, d, models.build_model("tfidf-xgb"), X.conv_pages(spark, d))


@query()
def page_gbt_eval(spark, d):
    return _report(spark, d, models.build_model("tfidf-xgb-rich"), X.conv_pages(spark, d))


@query()
def rich_gbt_eval(spark, d):
    return _report(spark, d, models.build_model("tfidf-xgb-layout"), X.layout_pages(spark, d))


@query()
def semantic_gbt_eval(spark, d):
    return _report(spark, d, models.build_model("tfidf-xgb-layout-sem"), X.rich_pages(spark, d))


@query()
def all_gbt_eval(spark, d):
    return _report(spark, d, models.build_model("tfidf-xgb-all"), X.rich_pages(spark, d))


@query()
def embedding_gbt_eval(spark, d):
    return _report(spark, d, models.build_model("minilm-xgb"), X.rich_pages(spark, d))


@query()
def embedding_lr_eval(spark, d):
    return _report(spark, d, models.build_model("multilingual-minilm"), X.vec_pages(spark, d))


@query()
def viterbi_similarity_eval(spark, d):
    return _report(spark, d, models.build_model("viterbi:text-similarity"), X.conv_pages(spark, d))


@query()
def seq_lr_eval(spark, d):
    return _report(spark, d, models.build_model("seq-lr:text-similarity"), X.conv_pages(spark, d))


@query()
def oof_stack_eval(spark, d):
    return _report(spark, d, models.Stacked(models.build_model("multilingual-minilm"), folds=3), X.vec_pages(spark, d))


@query()
def ensemble_eval(spark, d):
    return _report(spark, d, models.build_model("ensemble:text-sim+tfidf-xgb-rich"), X.conv_pages(spark, d))


@query()
def viterbi_trees_eval(spark, d):
    return _report(spark, d, models.build_model("viterbi:tfidf-xgb"), X.conv_pages(spark, d))


@query()
def viterbi_ensemble_eval(spark, d):
    return _report(spark, d, models.build_model("viterbi:ensemble"), X.conv_pages(spark, d))
