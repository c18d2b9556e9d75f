import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.functions import pages as P
from sheaf.functions import text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


def test_ngrams_and_jaccard(spark):
    assert sorted(one(spark, "  abcabc ", lambda c: T.char_ngrams(c, 3))) == ["abc", "bca", "cab"]
    assert one(spark, "ab", lambda c: T.char_ngrams(c, 3)) == ["ab"]
    assert one(spark, " \n", lambda c: T.char_ngrams(c, 3)) == []
    assert one(spark, "x", lambda c: T.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 1.0
    assert one(spark, "x", lambda c: T.jaccard(F.array(c), F.array(c, F.lit("y")))) == 0.5


def test_page_features_of_odd_texts(spark):
    assert one(spark, "p 12 id 12345 9", T.digit_runs) == 2
    assert one(spark, "", T.page_features) == [0.0] * 8 == one(spark, None, T.page_features)
    f = one(spark, "Ab 1.\nxy", T.page_features)
    assert np.allclose(f, [np.log1p(8), 3 / 8 * 100, 8 / 3, 4 / 8, 1 / 8, 1 / 4, 1 / 8, 5 / 8])
    assert one(spark, "a" * 4001, T.truncate) == "a" * 2000 + " " + "a" * 2000 and one(spark, None, T.truncate) == ""


def words(*boxes):
    return [{"Word": f"w{k}", **{c: float(b[(0 if c[0] == "X" else 1) + (2 if c[1] == "3" else 0)]) for c in P.CORNERS}} for k, b in enumerate(boxes)]


def test_ocr_shapes(spark):
    shapes = {
        json.dumps({"lines_data": words((0, 0, 1, 1))}): "w0",
        json.dumps({"analyzeResult": {"readResults": [{"lines": [{"text": "a"}, {"text": "b"}]}]}}): "a b",
        json.dumps([{"text": "x", "content": "y"}, "z"]): "x y",
        "not json": "not json",
        "": "",
    }
    got = spark.createDataFrame([(k,) for k in [*shapes, None]], "v string").select("v", P.ocr_text("v")).collect()
    assert {r[0]: r[1] for r in got} == shapes | {None: ""}
    deep = "[" * 900 + json.dumps({"text": "deep"}) + "]" * 900
    assert P.text_in(deep) == "deep"


def test_layout_both_ways(spark):
    payloads = [json.dumps({"lines_data": words((0.1, 0.1, 0.2, 0.15), (0.5, 0.9, 0.9, 0.95), (0.3, 0.4, 0.5, 0.5))}), "bad", "", None, json.dumps({"lines_data": []})]
    df = spark.createDataFrame([(p,) for p in payloads], "v string")
    rows = df.select(P.ocr_layout("v").alias("a"), P.ocr_layout_of_lines(F.when(F.col("v") != "bad", F.col("v"))).alias("b")).collect()
    for r in rows:
        assert np.allclose(r.a, r.b)
    assert rows[0].a[0] == np.log1p(3) and rows[1].a == [0.0] * 14


def test_images(spark):
    pixels = np.tile(np.arange(192, dtype=np.uint8), (96, 1))
    raw = b"P5 192 96 255\n" + pixels.tobytes()
    visual = P.image_features()
    got = [r[0] for r in spark.createDataFrame([(raw,), (b"junk",), (None,)], "v binary").select(visual("v")).collect()]
    assert got[1] == got[2] == [0.0] * 17
    assert got[0][0] == 2.0 and np.isclose(got[0][1], pixels.mean() / 255) and got[0][6] < got[0][7]


def a_pdf(texts, compressed=False):
    """A PDF of one page a text; compressed: its page objects stand in an object stream."""
    import zlib

    parts, leaves = [(1, b"<< /Type /Catalog /Pages 2 0 R >>")], []
    kids = b" ".join(b"%d 0 R" % (10 + 2 * k) for k in range(len(texts)))
    leaves.append((2, b"<< /Type /Pages /Kids [" + kids + b"] /Count %d >>" % len(texts)))
    for k, t in enumerate(texts):
        leaves.append((10 + 2 * k, b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * k)))
        shown = zlib.compress(b"BT /F1 12 Tf (" + t.encode("latin-1") + b") Tj 0 -14 Td [(two) -20 ( \\(2\\)\\101)] TJ ET")
        parts.append((11 + 2 * k, b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(shown) + shown + b"\nendstream"))
    if compressed:
        head, body = b"", b""
        for n, x in leaves:
            head += b"%d %d " % (n, len(body))
            body += x + b" "
        data = zlib.compress(head + body)
        leaves = [(99, b"<< /Type /ObjStm /N %d /First %d /Length %d /Filter /FlateDecode >>\nstream\n" % (len(leaves), len(head), len(data)) + data + b"\nendstream")]
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n" % n + x + b"\nendobj\n" for n, x in parts + leaves) + b"%%EOF"


@pytest.mark.parametrize("compressed", [False, True])
def test_pdf_pages(compressed):
    from sheaf.functions import pdf

    raw = a_pdf(["first page", "café"], compressed)
    assert pdf.page_count(raw) == 2
    assert pdf.page_texts(raw) == ["first page\ntwo (2)A", "café\ntwo (2)A"]
    for bad in (b"", b"no pdf", a_pdf([])):
        with pytest.raises(ValueError):
            pdf.page_count(bad)


def a_png(pixels, color, depth=8, kind=0, palette=b""):
    """A PNG of rows of samples, all filtered the same way."""
    import struct
    import zlib

    height, width = pixels.shape[:2]
    flat = pixels.reshape(height, -1).astype(np.uint8)
    if depth < 8:
        flat = np.packbits((flat[..., None] >> np.arange(depth)[::-1] & 1).reshape(height, -1).astype(np.uint8), axis=1)
    step, rows = max(1, flat.shape[1] // width), b""
    for y in range(height):
        x, up = flat[y].astype(int), (flat[y - 1] if y else np.zeros_like(flat[0])).astype(int)
        left, corner = np.append(np.zeros(step, int), x)[: len(x)], np.append(np.zeros(step, int), up)[: len(x)]
        p = left + up - corner
        pa, pb, pc = abs(p - left), abs(p - up), abs(p - corner)
        guess = [0 * x, left, up, (left + up) // 2, np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, up, corner))][kind]
        rows += bytes([kind]) + ((x - guess) & 255).astype(np.uint8).tobytes()
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, 0)) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_image_decoders():
    r = np.random.default_rng(0)
    grey, rgb = r.integers(0, 256, (96, 192)), r.integers(0, 256, (96, 192, 3))
    want = (grey / 255).reshape(96, 96, 2).mean(2)
    luma = (rgb @ [0.299, 0.587, 0.114] / 255).reshape(96, 96, 2).mean(2)
    for kind in range(5):
        grid, width, height = P.decode_image(a_png(grey, 0, kind=kind))
        assert np.allclose(grid, want) and (width, height) == (192, 96)
        assert np.allclose(P.decode_image(a_png(rgb, 2, kind=kind))[0], luma)
        assert np.allclose(P.decode_image(a_png(np.dstack([rgb, grey]), 6, kind=kind))[0], luma)
    bits = r.integers(0, 4, (96, 96))
    assert np.allclose(P.decode_image(a_png(bits, 0, depth=2))[0], bits / 3)
    assert np.allclose(P.decode_image(a_png(bits, 3, palette=bytes([0, 0, 0, 255, 255, 255, 255, 0, 0, 0, 0, 255])))[0], np.array([0, 1, 0.299, 0.114])[bits])
    assert np.allclose(P.decode_image(b"P6 192 96 255\n" + rgb.astype(np.uint8).tobytes())[0], luma)


def test_gram_sets_against_plain_python():
    from sheaf.functions import grams

    r = np.random.default_rng(1)
    texts = ["", " ", "ab", "abc", "abcd ", " x\U0001f600yz\U0001f600yz\n"] + ["".join(r.choice(list("ab é\n"), r.integers(0, 40))) for _ in range(600)]
    other = texts[::-1]
    for n in (3, 4):
        sets = [[({t[i : i + n] for i in range(len(t) - n + 1)} or ({t} - {""})) for t in (x.strip() for x in part)] for part in (texts, other)]
        want = [len(a & b) / len(a | b) if a | b else 1.0 for a, b in zip(*sets)]
        assert np.allclose(grams.gram_jaccard(texts, other, n), want)
