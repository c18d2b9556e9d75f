from sheaf import cli
from sheaf.sources.corpus import Corpus

from .test_functions import a_pdf


def saved(spark, path):
    rows = [(str(s), p, f"d{s}.{p // 2}", p % 2, p % 2 == 0, f"{'start' if p % 2 == 0 else 'more'} text {s}") for s in range(8) for p in range(2 + s % 4)]
    df = spark.createDataFrame(rows, "stream_id string, pos long, source string, page long, boundary boolean, text string")
    Corpus(df.drop("text"), df.select("source", "page", "text")).save(path)


def test_commands(spark, tmp_path, capsys):
    at = str(tmp_path / "c")
    saved(spark, at)
    assert cli.main(["sources", "list"]) == 0 and "tobacco800" in capsys.readouterr().out
    assert cli.main(["eval", "baseline-smoke"]) == 0 and "page F1 0.183, PQ 0.100, STP 0.000, MNDD 3.600" in capsys.readouterr().out
    assert cli.main(["eval", "prospective-smoke"]) == 0 and "0.571" in capsys.readouterr().out
    assert cli.main(["data", "filter", "--in", at, "--out", at + "f", "--max-pages", "3"]) == 0 and "4 streams, 10 pages" in capsys.readouterr().out
    assert cli.main(["data", "filter", "--in", at, "--out", at + "g", "--min-pages", "9"]) == 2
    assert cli.main(["data", "resample-streams", "--in", at, "--out", at + "r", "--n-streams", "5"]) == 0 and "5 streams" in capsys.readouterr().out
    assert cli.main(["eval", "run", "--corpus", at, "--model", "text-similarity"]) == 0 and "2 streams" in capsys.readouterr().out
    assert cli.main(["eval", "run", "--corpus", at, "--model", "no"]) == 2
    assert cli.main(["eval", "prospective", "--corpus", at, "--slices", "2"]) == 0 and "never_split" in capsys.readouterr().out
    assert cli.main(["eval", "prospective", "--corpus", at, "--slices", "99"]) == 2
    for command in (["streams", "build", at + "no", at + "s"], ["eval", "run", "--corpus", at + "no", "--model", "text-similarity"], ["data", "resample-streams", "--in", at, "--out", at + "t", "--n-streams", "0"]):
        assert cli.main(command) == 2
    (tmp_path / "pdf").mkdir()
    assert cli.main(["streams", "build", str(tmp_path / "pdf"), at + "s"]) == 2
    (tmp_path / "pdf" / "x.pdf").write_bytes(a_pdf(["one", "two"]))
    capsys.readouterr()
    assert cli.main(["streams", "build", str(tmp_path / "pdf"), at + "s", "--n-streams", "3"]) == 0 and "3 streams, 6 pages" in capsys.readouterr().out
    assert spark.read.parquet(at + "s/pages").where("boundary").count() == 3
    assert cli.main(["data", "fair-split", "--in", at, "--train-out", at + "a", "--test-out", at + "b", "--n-train", "6", "--n-test", "2"]) == 0 and "2 streams" in capsys.readouterr().out
    assert cli.main(["eval", "run", "--corpus", at + "a", "--test-corpus", at + "b", "--model", "multilingual-minilm"]) == 0 and "2 streams" in capsys.readouterr().out
