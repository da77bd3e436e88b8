"""python -m tidepack.cli generate | compress | decompress | explain"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from .config import Settings
from .operators.segments import compress_table, decompress_table, read_segments, write_segments
from .plans.tree import Plan
from .sources import files, generators
from .sources.header import dtypes_of, parse_header, read_header, render_header, write_header


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidepack")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, wants in (("generate", "output"), ("compress", "header input output"), ("decompress", "header input output"), ("explain", "input")):
        p = commands.add_parser(name)
        for w in wants.split():
            p.add_argument(f"--{w}", required=True)
        if name == "generate":
            p.add_argument("--size", type=int, default=100_000)
            p.add_argument("--seed", type=int, default=1)
        if name != "explain":
            p.add_argument("--format", choices=("bin", "csv"), default="bin")
            p.add_argument("--padding", type=int, default=0)
        if name in ("compress", "decompress"):
            p.add_argument("--batch", type=int)
        if name == "compress":
            p.add_argument("--mode", choices=("independent", "adaptive"))
            p.add_argument("--plan", help="a fixed plan, such as scale(delta(afl))")
        p.add_argument("--config", help="an INI file with a section [tidepack]")
    o = parser.parse_args(args)
    settings = Settings.load(o.config, batch=getattr(o, "batch", None), mode=getattr(o, "mode", None))
    spark = settings.apply(spark or SparkSession.builder.appName("tidepack").getOrCreate())

    log = logging.getLogger("tidepack.cli")
    log.info("%s: %s", o.command, settings)

    def write(df, schema, path):
        if o.format == "csv":
            files.write_csv(df, path, schema)
        else:
            files.write_binary(df, path, render_header(schema), o.padding)

    if o.command == "generate":
        schema = parse_header(generators.HEADER)
        write(generators.generate(spark, o.size, o.seed), schema, o.output)
        write_header(spark, schema, f"{o.output}.header")
    elif o.command == "compress":
        schema = read_header(spark, o.header)
        df = files.read_csv(spark, o.input, schema) if o.format == "csv" else files.read_binary(spark, o.input, render_header(schema), o.padding)
        write_segments(compress_table(df, "row_idx", settings.batch, settings.mode, o.plan and Plan.parse(o.plan)), o.output)
    elif o.command == "decompress":
        schema = read_header(spark, o.header)
        write(decompress_table(read_segments(spark, o.input), dtypes_of(schema), batch=settings.batch), schema, o.output)
    else:
        segments = read_segments(spark, o.input)
        segments.select("column", "part", "n_rows", "raw_bytes", "enc_bytes", "ratio", "plan").orderBy("column", "part").show(1000, False)
    log.info("%s: done", o.command)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
