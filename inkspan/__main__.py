"""Command line: render files, write archives, read a document from an archive. Any error: a message and exit 1."""

from __future__ import annotations

import argparse
import os
import sys

from . import api
from .functions import templates


def _count(x: str) -> int:
    n = int(x)
    if n < 1:
        raise argparse.ArgumentTypeError("must be at least 1")
    return n


def _arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="inkspan")
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("render", help="one file, - for standard input, or a folder's XML files")
    r.add_argument("input", nargs="?", default="-")
    r.add_argument("--output")
    r.add_argument("--template", help="a file with {{section}} placeholders")
    s = sub.add_parser("shard").add_subparsers(dest="action", required=True)
    w = s.add_parser("write")
    source = w.add_mutually_exclusive_group(required=True)
    source.add_argument("--zip")
    source.add_argument("--dir")
    w.add_argument("--output", default=".")
    w.add_argument("--limit", type=_count)
    w.add_argument("--jobs", type=_count)
    g = s.add_parser("read")
    g.add_argument("--shard", required=True)
    g.add_argument("--key")
    g.add_argument("--offset", type=int)
    g.add_argument("--length", type=_count)
    g.add_argument("--index")
    g.add_argument("--output")
    return p


def _put(text: str, output: str | None) -> None:
    if output is None:
        sys.stdout.write(text + "\n")
    else:
        with open(output, "w", encoding="utf-8") as f:
            f.write(text)


def _render(a: argparse.Namespace) -> None:
    template = templates.DEFAULT
    if a.template:
        with open(a.template, encoding="utf-8") as f:
            template = f.read()
    templates.parse(template)
    if a.input == "-" or not os.path.isdir(a.input):
        raw = sys.stdin.read() if a.input == "-" else open(a.input, encoding="utf-8").read()
        if not raw.strip():
            raise ValueError("empty input")
        return _put(api.parse_to_markdown(raw, template), a.output)
    names = sorted(n for n in os.listdir(a.input) if n.lower().endswith(".xml"))
    if not names:
        raise ValueError(f"no .xml files found in '{a.input}'")
    whole = []
    for n in names:
        with open(os.path.join(a.input, n), encoding="utf-8") as f:
            raw = f.read()
        if not raw.strip():
            raise ValueError(f"empty input '{n}'")
        text = api.parse_to_markdown(raw, template)
        if a.output is None:
            whole.append(text)
        else:
            os.makedirs(a.output, exist_ok=True)
            _put(text, os.path.join(a.output, os.path.splitext(n)[0] + ".md"))
    if a.output is None:
        from .sources.sinks import DOC_SEPARATOR

        _put(DOC_SEPARATOR.join(whole), None)


def _write(a: argparse.Namespace) -> None:
    from pyspark.sql import SparkSession

    from .sources.sinks import write_archive_set

    builder = SparkSession.builder.appName("inkspan")
    if a.jobs:
        builder = builder.master(f"local[{a.jobs}]")
    spark = builder.getOrCreate()
    source = os.path.abspath(a.zip or a.dir)
    for row in write_archive_set(spark, f"file://{source}", f"file://{os.path.abspath(a.output)}", a.limit).collect():  # one row an archive
        skipped = row.supplemental + row.unsupported + row.malformed
        print(f"{row.shard}: {row.written} written, {skipped} skipped", file=sys.stderr)


def _read(a: argparse.Namespace) -> None:
    """One frame by key or by place, without Spark."""
    import zstandard

    from .sources.shards import parse_index

    if a.key is not None and a.offset is None and a.length is None:
        stem = a.shard.removesuffix(".zst")
        with open(a.index or f"{stem}.idx", encoding="utf-8") as f:
            found = next((e for e in parse_index(os.path.basename(stem), f.read()) if e[0] == a.key), None)
        if found is None:
            raise ValueError(f"no document with key {a.key}")
        offset, length = found[2:]
    elif a.key is None and a.offset is not None and a.length is not None:
        offset, length = a.offset, a.length
    else:
        raise ValueError("give --key, or --offset and --length")
    with open(a.shard, "rb") as f:
        f.seek(offset)
        _put(zstandard.ZstdDecompressor().decompress(f.read(length)).decode(), a.output)


def main(argv: list[str] | None = None) -> int:
    a = _arguments().parse_args(argv)
    try:
        _render(a) if a.command == "render" else _write(a) if a.action == "write" else _read(a)
    except (ValueError, OSError, UnicodeDecodeError) as e:
        print(f"inkspan: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
