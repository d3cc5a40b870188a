"""Command line: python -m folioframe -f INPUT [-t OUTPUT] [-o JSON|XML] [-c CONFIG | -b NAME]."""

from __future__ import annotations

import argparse
import logging
import sys
from datetime import datetime
from pathlib import Path

from pyspark.sql import functions as F

from folioframe.api import process
from folioframe.operators.bioc import COLLECTION
from folioframe.plans.configs import NAMES, default_config
from folioframe.plans.rules import read_config
from folioframe.session import build_session
from folioframe.sources import bioc_io, files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="folioframe", description="Structure articles and their supplements.")
    p.add_argument("-f", "--file-path", required=True, help="file or directory")
    p.add_argument("-t", "--target-dir", default="folioframe_output", help="directory to write to")
    p.add_argument("-o", "--output-format", default="JSON", type=str.upper, choices=["JSON", "XML"], help="format of the full text")
    rules = p.add_mutually_exclusive_group(required=True)
    rules.add_argument("-c", "--config", help="file of extraction rules")
    rules.add_argument("-b", "--default-config", choices=NAMES, help="name of a rule set that comes along")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    source, target = Path(args.file_path), Path(args.target_dir)
    if not source.exists():
        raise FileNotFoundError(source)
    if target.exists() and not target.is_dir():
        raise NotADirectoryError(target)
    target.mkdir(parents=True, exist_ok=True)
    handler = logging.FileHandler(target / f"folioframe-{datetime.now():%Y%m%d-%H%M%S}.log")
    log = logging.getLogger("folioframe")
    log.setLevel(logging.INFO)
    log.addHandler(handler)
    config = read_config(args.config) if args.config else default_config(args.default_config)
    spark = build_session()
    done = process(lambda pattern: files.scan(spark, str(source.resolve()), pattern), config)
    base = str(source.resolve() if source.is_dir() else source.resolve().parent)
    rows = done.withColumn("key", F.regexp_replace(F.regexp_replace("key", r"^file:/*", "/"), f"^{base}/", "")).persist()
    bad = rows.where("error IS NOT NULL").select("key", F.lit(False).alias("ok"), "error")
    good = rows.where("error IS NULL").select("key", F.from_json("bioc", COLLECTION).alias("bioc"), F.col("abbreviations"), F.col("tables"))
    status = bad.unionByName(_write(good, str(target.resolve()), args.output_format == "XML")).persist()
    for r in bioc_io.tally(status).collect():
        log.info("%s: %d", "written" if r["ok"] else "failed", r["n"])
    for r in status.where(~F.col("ok")).toLocalIterator():
        log.error("%s: %s", r["key"], r["error"])
    handler.close()
    return 0


def _write(good, target: str, xml: bool):
    tables = F.size(F.coalesce(F.from_json(F.get_json_object("tables", "$.documents"), "array<string>"), F.array()))
    bioc = bioc_io.to_xml(F.col("bioc")) if xml else bioc_io.to_json(F.col("bioc"), True)
    return bioc_io.write_texts(good.select("key", bioc.alias("bioc"), "abbreviations", F.when(tables > 0, F.col("tables")).alias("tables")), target, xml)


if __name__ == "__main__":
    sys.exit(main())
