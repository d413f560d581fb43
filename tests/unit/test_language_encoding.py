import re

import pytest

from webloom.functions import encoding as E
from webloom.functions.language import Profiles, vectors

TEXTS = {"en": "the quick brown fox jumps over the lazy dog and the cat sat on the mat with them", "de": "der schnelle braune Fuchs springt über den faulen Hund und die Katze saß auf der Matte", "fr": "le renard brun rapide saute par-dessus le chien paresseux et le chat était sur le tapis"}


def plain(text, size=256):
    kept, space = [], False
    for c in text:
        if c.isalpha():
            kept.append(c)
            space = False
        elif c.isspace():
            if not space:
                kept.append(" ")
            space = True
        else:
            space = False
    counts = [0] * size
    for i in range(len(kept)):
        for n in range(1, 6):
            if i - n + 1 >= 0:
                h = 2166136261
                for c in kept[i - n + 1 : i + 1]:
                    h = ((h ^ ord(c)) * 16777619) % 2**32
                b = ((h >> 8) ^ h) & 255
                counts[b if size > 255 else b % size] += 1
    return [min(255, c * 256 // len(kept)) for c in counts] if kept else counts


@pytest.mark.parametrize("text", ["", "a", "a - b", "  x\n\ty ", "123", "Größe und 中文 été", "🙂 a🙂b"])
@pytest.mark.parametrize("size", [256, 100, 300])
def test_vectors_match_the_plain_version(text, size):
    assert vectors(["other", text, None, text * 3], size)[1].tolist() == plain(text, size)


def test_detection():
    p = Profiles.train({k: [v] * 3 for k, v in TEXTS.items()})
    for lang, text in TEXTS.items():
        assert p.detect(text * 2)[0] == lang
    assert p.detect("", cutoff=0) == ("unknown", 0) and p.detect("x", langs=[]) == ("unknown", 0)
    top = p.detect(TEXTS["de"], n_results=2, cutoff=5000)
    assert [x[0] for x in top][0] == "de" and len(top) == 2 and top[0][1] <= top[1][1]
    assert p.detect(TEXTS["de"], langs=["en"], cutoff=5000)[0] == "en" and p.detect("x", n_results=0) == [] and p.supported() == ["de", "en", "fr"]


@pytest.mark.parametrize(
    ("data", "html5", "raw"),
    [
        (b"\xff\xfeH\x00e\x00", "utf-16-le", "utf-16"),
        ("Mieux vaut être seul que mal accompagné.".encode("cp1252"), "cp1252", None),
        ("äöü".encode(), "utf-8", "utf-8"),
        (b"Hello", "cp1252", "ascii"),
        ("Potrzeba jest matką wynalazków.".encode("iso8859-2"), "iso8859-2", "iso8859-2"),
        ("Съешь же ещё этих мягких французских булок".encode("cp1251"), "cp1251", "cp1251"),
        ("Съешь же ещё этих мягких французских булок".encode("koi8-r"), "koi8-r", "koi8-r"),
        ("いろはにほへと ちりぬるを わかよたれそ".encode("shift_jis"), "shift_jis", "shift_jis"),
        ("いろはにほへと ちりぬるを わかよたれそ".encode("euc_jp"), "euc_jp", "euc_jp"),
        ("키스의 고유조건은 입술끼리 만나야 하고".encode("euc_kr"), "euc_kr", "euc_kr"),
        ("Ξεσκεπάζω την ψυχοφθόρα βδελυγμία".encode("cp1253"), "cp1253", None),
    ],
)
def test_encodings(data, html5, raw):
    assert E.detect_encoding(data) == html5
    assert raw is None or E.detect_encoding(data, html5_compatible=False) == raw
    d = E.EncodingDetector()
    d.update(data[:3])
    d.update(data[3:])
    assert d.encoding() == html5


@pytest.mark.parametrize("pad", range(3))
def test_encodings_of_long_texts(pad):
    """Characters at the places where long data is cut, and such that are only in its middle."""
    for text, codec in (("äß€", "utf-8"), ("いろはにほへと", "shift_jis"), ("いろはにほへと", "euc_jp"), ("키스의고유조건은", "euc_kr")):
        part = text.encode(codec)
        assert E.detect_encoding(b"x" * pad + b" " + part * (60_000 // len(part)) + b" " + part * (120_000 // len(part)) + b" " + b"y" * pad) == codec
        assert E.detect_encoding(b"x" * (100_000 + pad) + b" " + part * 3 + b" " + b"y" * 100_000) == codec
    assert E.detect_encoding("äß€ ".encode() * 20_000 + b"\xff" + "äß€ ".encode() * 20_000) == "utf-8"
    assert E.detect_encoding("é ".encode("cp1252") * 100_000) == "cp1252"


def test_long_texts_come_back_by_their_encoding(spark, tmp_path):
    from webloom.plans import details

    rows = [(i, "x" * i + " " + "äß€" * 20_000, "de") for i in range(6)] + [(9, "x" * 100_000 + " ä " + "y" * 100_000, "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [(r["utf8"], r["utf16"]) for r in details.detect_encoding_roundtrip(spark, str(tmp_path)).collect()] == [(True, True)] * 7


def test_odd_texts_come_back_by_their_encoding(spark, tmp_path):
    """Null, marks at the beginning, and zeros, at which UTF-16 looks like UTF-32 and UTF-8 like UTF-16."""
    from webloom.plans import details

    texts = [None, "", "\ufeff", "\ufeffäb", "\ufeff\ufeffx", "\ufeff" + "ä" * 140_000, "\0", "\0a", "\0abc", "\0\0\0", "\0\x10\0\x10", "\0ä", "\0äbc def", "ä\0\0\0\0", "äöü\0\0", "\0" * 5000 + "ä"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'de' lang").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: (r["utf8"], r["utf16"]) for r in details.detect_encoding_roundtrip(spark, str(tmp_path)).collect()} == dict.fromkeys(range(len(texts)), (True, True))


def test_utf16_and_utf32_are_told_apart():
    raw = lambda text, codec: E.detect_encoding(text.encode(codec), html5_compatible=False)
    assert raw("\0abc", "utf-16") == "utf-16" and raw("abc", "utf-32") == raw("äb", "utf-32") == "utf-32"
    assert E.detect_encoding("\0\0\0".encode("utf-16")) == "utf-16-le"
    assert raw("Hi 这是", "utf-16-le") == raw("ab ä", "utf-16-le") == "utf-16-le" and raw("abä", "utf-16-be") == "utf-16-be"


def test_meta_and_labels():
    page = '<!doctype html><!-- <meta charset="greek"> --><meta charset=latin1><p>äöü'.encode()
    assert E.detect_encoding(page) == "utf-8" and E.detect_encoding(page, from_html_meta=True) == "cp1252"
    assert {x: E.map_encoding(x) for x in ("ascii", "csisolatin9", "utf-7", "utf-16", "oops", " UTF8 ")} == {"ascii": "cp1252", "csisolatin9": "iso8859-15", "utf-7": "utf-8", "utf-16": "utf-16-le", "oops": "utf-8", " UTF8 ": "utf-8"}
    assert E.map_encoding("oops", fallback_utf8=False) is None


def test_decoding():
    assert E.bytes_to_str("Übung".encode(), "ascii") == "Übung"
    assert E.bytes_to_str("Übung".encode("cp1252"), "utf-8") == "Übung"
    assert E.bytes_to_str("﻿x".encode()) == "x" and E.bytes_to_str("﻿x".encode(), strip_bom=False) == "﻿x"
    assert E.bytes_to_str("x".encode("utf-16"), "utf-16-le") == "x"
    assert E.bytes_to_str(b"\x81\xffa", "ascii", fallback_encodings=()) == "a"


@pytest.mark.parametrize(
    ("data", "mime"),
    [(b"%PDF-1.4", "application/pdf"), (b"  <!DOCTYPE html><x>", "text/html"), (b'<?xml version="1"?><!DOCTYPE x "-//W3C//DTD XHTML', "application/xhtml+xml"), (b"<?xml version='1.0'?><svg >", "image/svg+xml"), (b"<?xml version='1.0'?><a/>", "application/xml"), (b"RIFFxxxxWAVE", "image/webp"), (b"\x1f\x8b\x08", "application/gzip"), (b"PK\x03\x04", "application/zip"), (b"plain text", "text/plain"), (b"\x00\x01\x02abc", "application/octet-stream"), (b"", "text/plain"), ("é".encode() * 9, "application/octet-stream")],
)
def test_mime(data, mime):
    assert E.detect_mime(data) == mime


def test_splits_match_a_plain_version(spark):
    import hashlib

    from webloom.functions import language as L

    rows = [(lang, f"{lang} line {i} " + "x" * (i % 3) * 100) for lang, n in (("en", 400), ("de", 60), (None, 30), ("fr", 4)) for i in range(n)]
    rows += rows[:50] + [("en", None)]
    df = spark.createDataFrame(rows, "lang string, line string")
    for least, enough in ((0, 1), (100, 15)):
        want = {}
        for lang in ("en", "de", None, "fr"):
            lines = sorted({x for k, x in rows if k == lang and x is not None and len(x) >= least}, key=lambda x: hashlib.sha1(x.encode()).hexdigest())
            if len(lines) < enough:
                continue
            a = b = int(len(lines) * 0.05)
            want |= {(lang, x): "test" if i < a else "val" if a < i < a + b else "train" for i, x in enumerate(lines)}
        got = L.split_examples(df, least=least, least_examples=enough).collect()
        assert len(got) == len(want) and {(r.lang, r.line): r.part for r in got} == want


def test_held_out_lines_are_judged_by_others(spark):
    from webloom.functions import language as L

    rows = [(k, f"{v} {i}", "test" if i < 3 else "train") for k, v in TEXTS.items() for i in range(12)]
    examples = spark.createDataFrame(rows, "lang string, line string, part string")
    got = L.held_out(examples).collect()
    assert len(got) == 9 and all(r.lang == r.predicted for r in got)
    assert {r.predicted for r in L.held_out(examples, truncate=0).collect()} <= {*TEXTS, "unknown"}


def test_profiles_are_summed_within_tasks(spark, monkeypatch):
    """A row for each language leaves a task, not one for each bucket of each text, and a task holds a bounded number of sums."""
    from webloom.functions import language as L

    docs = spark.createDataFrame([(f"l{i % 5}" if i % 7 else None, TEXTS["de"][i % 9 :] if i % 11 else None) for i in range(80)], "lang string, text string").coalesce(2)
    want = {}
    for r in docs.collect():
        if r["lang"] and r["text"] is not None:
            want.setdefault(r["lang"], []).append(r["text"])
    for most in (1000, 1):
        monkeypatch.setattr(L, "_LANGS", most)
        trained = L.train_profiles(docs)
        got = {r["lang"]: (r["n"], r["vector"]) for r in trained.collect()}
        assert got == {k: (len(v), L.Profiles.train({k: v}).vecs[0].tolist()) for k, v in want.items()}
    plan = trained._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan


def test_pages_are_read_once_for_their_language(spark):
    from webloom.plans import catalogue

    plan = catalogue.page_language_stats(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"ArrowEvalPython", plan)) == 2 and len(re.findall(r"extracted\(", plan)) == 0
