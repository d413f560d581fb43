import importlib
import importlib.util

import pytest

import __spark_entry__ as entry


def test_queries_and_oracles_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 40


def test_flagship_runs(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["lang", "pages", "chars"] and rows.count() > 0


def test_entry_works_without_the_removable_parts(monkeypatch):
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith(("webloom.llm", "corpus_pipeline")) else real(name, *a))
    left = entry.queries()
    assert "page_language_stats" in left and not any(q.startswith("op") or q == "pipeline" for q in left)


def test_entry_does_not_hide_broken_modules(monkeypatch):
    if importlib.util.find_spec("webloom.llm") is None:
        pytest.skip("removed")
    monkeypatch.setitem(__import__("sys").modules, "webloom.llm.queries", None)
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: object())
    with pytest.raises(ImportError):
        entry.queries()


def test_small_queries_match_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    for name in ("encoding_map", "html_title", "html_links", "http_parse", "digest_verify", "dataset_split", "detect_mime", "extract_main_content", "extract_options", "bulk_actions", "warc_length_filter", "text_lines", "lang_detect", "html_tag_counts", "extract_plain_text_basic", "extract_plain_text_minimal_html", "html_inner_text", "page_language_stats", "warc_keep_meta", "warc_recompress", "digest_reasons", "header_edit", "html_many", "text_ascii_lower"):
        got = entry.queries()[name](spark, folder)
        want = con.sql(f"select {', '.join(got.columns)} from ({entry.oracle_sql()[name]})").fetchall()
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr), name


def test_intermediate_tables_can_be_deleted(spark):
    from pathlib import Path

    from webloom import session

    base = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(base.iterdir())
    with session.scratch(spark):
        kept = session.shared_dir(spark)
        with session.scratch(spark):
            session.written(spark.range(3))
            got = session.written(session.written(spark.range(5)), kept)
        assert {p.name for p in set(base.iterdir()) - before} == {kept.rsplit("/", 1)[-1]} and got.count() == 5
    assert set(base.iterdir()) == before


def test_small_scans_are_dealt_out_and_large_ones_left_alone(spark):
    from webloom.session import spread

    df = spark.range(100)
    parts = lambda d: d.rdd.getNumPartitions()
    assert parts(spread(df.coalesce(1))) == 4 and spread(df.repartition(9)).sameSemantics(df.repartition(9)) and parts(spread(df.repartition(9))) == 9


def test_batch_sizes_of_the_session_stay(spark):
    from webloom.session import prepare

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, "77")
    prepare(spark)
    assert spark.conf.get(name) == "77"
    spark.conf.set(name, was)


def test_detail_queries_match_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from webloom.plans import catalogue, details

    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    names = [n for n, f in catalogue.QUERIES.items() if f.__module__ == details.__name__]
    assert len(names) > 20
    for name in names:
        got = entry.queries()[name](spark, folder)
        want = con.sql(f"select {', '.join(got.columns)} from ({entry.oracle_sql()[name]})").fetchall()
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)), name
