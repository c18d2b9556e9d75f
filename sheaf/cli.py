"""Command line: python -m sheaf.cli COMMAND. Exit code 2 means a user's error."""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import evaluate, models, sampling, streams
from .sources import corpus, registry

SMOKE = ["TFFTFFFF", "TFFTT", "TFF", "TFFF", "TFFFFF"]
SLICES = [["T", "TFF"], ["TFTFFF"], ["TFFTTF"]]


class UserError(Exception):
    pass


def session() -> SparkSession:
    made = SparkSession.builder.appName("sheaf").getOrCreate()
    made.sparkContext.setLogLevel("ERROR")
    return made


def fixture(spark: SparkSession, groups: list[list[str]]):
    rows, n = [], 0
    for g, marks in enumerate(groups):
        for m in marks:
            rows += [(n, p, c == "T", g, f"slice{g + 1}") for p, c in enumerate(m)]
            n += 1
    return spark.createDataFrame(rows, "stream_id long, pos long, boundary boolean, slice_id long, slice_name string")


def said(c: corpus.Corpus, out: str) -> str:
    r = streams.summary(c.pages).first()
    return f"{out}: {r['n_streams']} streams, {r['n_pages']} pages"


def sources_list(spark, a):
    for r in registry.listing(registry.known().frame(spark)).orderBy("name").collect():
        print(r["line"])


def data_import(spark, a):
    defs = corpus.read_definitions(spark, a.definitions)
    c = corpus.build_corpus(defs, spark.read.parquet(a.rows), a.max_streams)
    c.save(a.out)
    print(said(c, a.out))


def data_filter(spark, a):
    c = corpus.Corpus.load(spark, a.input).filtered(a.min_pages, a.max_pages)
    if c.pages.isEmpty():
        raise UserError("no stream has a length in these bounds")
    c.save(a.out)
    print(said(c, a.out))


def data_resample(spark, a):
    c = corpus.Corpus.load(spark, a.input)
    made = c.only(sampling.resample(c.pages, a.n_streams, a.mean_docs, a.seed).select("stream_id", "pos", "source", "page", "boundary"))
    made.save(a.out)
    print(said(made, a.out))


def data_fair_split(spark, a):
    c = corpus.Corpus.load(spark, a.input)
    both = sampling.fair_split(c.pages, a.n_train, a.n_test, a.mean_docs, a.train_frac, a.seed)
    for name, out, train in (("train", a.train_out, True), ("test", a.test_out, False)):
        part = c.only(both.where(F.col("train") == train).select("stream_id", "pos", "source", "page", "boundary"))
        part.save(out)
        print(name, said(part, out))


def streams_build(spark, a):
    """Stream definitions and labels for the files of a directory. Pages are counted in the files, unless --pages says how many each has."""
    if corpus.list_files(spark, a.dir, a.pattern).isEmpty():
        raise UserError(f"there is no {a.pattern} below {a.dir}")
    files = corpus.scan_files(spark, a.dir, a.pattern)
    sizes = files.select("source", F.lit(a.pages).cast("long").alias("n_pages")) if a.pages else corpus.page_counts(files)
    specs = sampling.stream_specs(files.select("source"), a.n_streams, a.mean_docs, a.seed)
    pages = corpus.concat_sources(specs.join(sizes, "source"))
    pages.write.mode("overwrite").parquet(f"{a.out}/pages")
    print(f"{a.out}: {a.n_streams} streams, {pages.count()} pages")


def eval_smoke(spark, a):
    for m in (models.EveryPage(), models.NeverSplit()):
        show(m.name, evaluate.evaluate(m, fixture(spark, [SMOKE])).first())


def eval_prospective_smoke(spark, a):
    print(evaluate.format_results(evaluate.walk_forward([models.EveryPage(), models.NeverSplit()], fixture(spark, SLICES))))


def show(name: str, r) -> None:
    print(f"{name}: {r['n_streams']} streams, page F1 {r['page_f1_mean']:.3f}, PQ {r['pq_mean']:.3f}, STP {r['stp']:.3f}, MNDD {r['mndd_mean']:.3f}")


def featured(c: corpus.Corpus, *names: str):
    """Pages with all features that the corpus has, and an embedding where one of the models reads it."""
    pages = c.with_text()
    if any(map(models.needs_embedding, names)):
        pages = models.encode_distinct(pages)
    if c.layout is not None:
        pages = corpus.with_default(pages, c.layout, "layout", 14)
    return pages if c.visual is None else corpus.with_default(pages, c.visual, "visual", 17)


def eval_run(spark, a):
    if a.model not in models.MODELS:
        raise UserError(f"there is no model {a.model!r}; there are {', '.join(models.MODELS)}")
    c = corpus.Corpus.load(spark, a.corpus)
    if a.test_corpus:
        other = corpus.Corpus.load(spark, a.test_corpus)
        train, test = featured(c, a.model), featured(corpus.Corpus(other.pages, *(getattr(c.merged(other), k) for k in ("text", "layout", "visual"))), a.model)
    else:
        both = streams.split_streams(featured(c, a.model), a.train_frac)
        train, test = both.where("train").drop("train"), both.where("not train").drop("train")
    if test.isEmpty():
        raise UserError("no stream is left to test on")
    m = models.build_model(a.model, a.threshold, a.trees, a.vocab)
    if hasattr(m, "fit"):
        m.fit(train)
    show(a.model, evaluate.evaluate(m, test).first())


def eval_prospective(spark, a):
    if a.slices < 2:
        raise UserError("there must be two slices at least")
    pages = featured(corpus.Corpus.load(spark, a.corpus), *a.models.split(","))
    if pages.select("stream_id").distinct().count() < a.slices:
        raise UserError("there are fewer streams than slices")
    sliced = streams.slice_streams(pages, a.slices).withColumn("slice_name", F.concat(F.lit("slice"), (F.col("slice_id") + 1).cast("string")))
    made = [models.build_model(n, trees=a.trees, vocab=a.vocab) for n in a.models.split(",")]
    print(evaluate.format_results(evaluate.walk_forward(made, sliced)))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sheaf", description=__doc__)
    areas = top.add_subparsers(required=True)

    def command(area, name, run, *options):
        p = area.add_parser(name)
        for flags, how in options:
            p.add_argument(*flags, **how)
        p.set_defaults(run=run)

    o = lambda *flags, **how: (flags, how)
    place = [o("--in", dest="input", required=True), o("--out", required=True)]
    drawn = [o("--mean-docs", type=float, default=3.0), o("--seed", type=int, default=0)]
    area = areas.add_parser("sources").add_subparsers(required=True)
    command(area, "list", sources_list)
    area = areas.add_parser("data").add_subparsers(required=True)
    command(area, "import", data_import, o("--definitions", required=True), o("--rows", required=True), o("--max-streams", type=int, default=50), o("--out", required=True))
    command(area, "filter", data_filter, *place, o("--min-pages", type=int, default=1), o("--max-pages", type=int, default=10**9))
    command(area, "resample-streams", data_resample, *place, o("--n-streams", type=int, default=200), *drawn)
    command(area, "fair-split", data_fair_split, o("--in", dest="input", required=True), o("--train-out", required=True), o("--test-out", required=True), o("--n-train", type=int, default=400), o("--n-test", type=int, default=100), o("--train-frac", type=float, default=0.8), *drawn)
    area = areas.add_parser("streams").add_subparsers(required=True)
    command(area, "build", streams_build, o("dir"), o("out"), o("--n-streams", type=int, default=100), o("--mean-docs", type=float, default=10.0), o("--seed", type=int, default=0), o("--pattern", default="*.pdf"), o("--pages", type=int, default=None))
    area = areas.add_parser("eval").add_subparsers(required=True)
    command(area, "baseline-smoke", eval_smoke)
    command(area, "prospective-smoke", eval_prospective_smoke)
    trees = o("--trees", type=int, default=None), o("--vocab", type=int, default=None)
    command(area, "run", eval_run, o("--corpus", required=True), o("--test-corpus"), o("--model", required=True), o("--train-frac", type=float, default=0.8), o("--threshold", type=float, default=0.5), *trees)
    command(area, "prospective", eval_prospective, o("--corpus", required=True), o("--models", default="trivial:every-page,trivial:never-split"), o("--slices", type=int, default=4), *trees)
    return top


def main(args: list[str] | None = None) -> int:
    given = parser().parse_args(args)
    try:
        given.run(session(), given)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        print(f"there is no such file or directory: {', '.join(map(str, (e.getMessageParameters() or {}).values()))}", file=sys.stderr)
        return 2
    except (UserError, ValueError, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
