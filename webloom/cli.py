"""The command lines of ``python -m webloom``; each is one job of the library over paths or globs."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.sources import archive as A


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="webloom", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *args: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=text)
        for a in args:
            p.add_argument(a)
        p.add_argument("--strict", action=argparse.BooleanOptionalAction, default=True)
        p.add_argument("--invalid-header", choices=("eof", "error"), default="eof")
        return p

    p = command("recompress", "write archives again with another codec", "source", "target")
    p.add_argument("--compression", choices=("gzip", "lz4", "zstd", "uncompressed"), default="gzip")
    p = command("index", "write a CDXJ index as text", "source", "target")
    p.add_argument("--fields", default="offset,length,filename")
    p = command("check", "count block digests that hold, don't hold or are missing; exit code 1 if any doesn't hold", "source")
    p.add_argument("--payload", action="store_true", help="payload digests too")
    p.add_argument("--bad", metavar="PATH", help="write the records that don't hold, as JSON lines")
    p = command("extract", "write one record's bytes to standard output", "source", "offset")
    p.add_argument("--headers", action=argparse.BooleanOptionalAction, default=True)
    p = command("text", "write the plain text of HTML responses as Parquet", "source", "target")
    p.add_argument("--main-content", action="store_true")
    p = command("benchmark", "count records and time it", "source")
    p.add_argument("--record-types", default="")
    p.add_argument("--parse-http", action=argparse.BooleanOptionalAction, default=False)
    p.add_argument("--verify-digests", action="store_true")
    return top


def _read(spark: SparkSession, args: argparse.Namespace, **options: str) -> DataFrame:
    A.register(spark)
    return spark.read.format("warc").options(strict=str(args.strict).lower(), invalid_header=args.invalid_header, **options).load(args.source)


def check(spark: SparkSession, args: argparse.Namespace) -> int:
    states = A.verify(_read(spark, args, parse_http="false"))
    if args.payload:
        states = states.union(A.verify(_read(spark, args), payload=True).select("record_id", "payload"))
    found = {r["status"]: r["n"] for r in states.groupBy(F.col("block").alias("status")).agg(F.count("*").alias("n")).collect()}
    print(", ".join(f"{k}: {found.get(k, 0)}" for k in ("OK", "FAIL", "NO_DIGEST")))
    if args.bad:
        states.where("block = 'FAIL'").write.mode("overwrite").json(args.bad)
    return int(bool(found.get("FAIL")))


def extract(args: argparse.Namespace) -> int:
    r = A.record_at(args.source, int(args.offset), parse_http=False, strict=args.strict, invalid=args.invalid_header)
    if r is None:
        print("no record there", file=sys.stderr)
        return 1
    sys.stdout.buffer.write(A.W.serialise(r) if args.headers else r.body or b"")
    return 0


def text(spark: SparkSession, args: argparse.Namespace) -> int:
    from webloom.functions.encoding import decoded, encoding_of
    from webloom.functions.extract import extract_plain_text

    pages = _read(spark, args, record_types="response").where("http_content_type in ('text/html', 'application/xhtml+xml')")
    html = decoded("body", encoding_of("body", from_html_meta=True))
    found = pages.select("filename", "stream_pos", A.header_value("WARC-Target-URI").alias("url"), extract_plain_text(html, main_content=args.main_content).alias("text"))
    found.write.mode("overwrite").parquet(args.target)
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.command == "extract":
        return extract(args)
    spark = spark or SparkSession.builder.appName("webloom").getOrCreate()
    if args.command == "recompress":
        print(A.recompress(spark, args.source, args.target, args.compression, strict=str(args.strict).lower(), invalid_header=args.invalid_header), "bytes written")
    elif args.command == "index":
        sizes = A.match_files(spark, args.source).withColumnRenamed("path", "filename")
        A.write_index(_read(spark, args), args.target, sizes, tuple(args.fields.split(",")))
    elif args.command == "check":
        return check(spark, args)
    elif args.command == "text":
        return text(spark, args)
    else:
        began = time.time()
        options = {"record_types": args.record_types} if args.record_types else {}
        n = _read(spark, args, parse_http=str(args.parse_http).lower(), verify_digests=str(args.verify_digests).lower(), body="false", **options).count()
        took = time.time() - began
        print(f"{n} records in {took:.2f} s ({n / max(took, 1e-9):.2f} records/s)")
    return 0
