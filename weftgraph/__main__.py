"""Command line: index a folder or a file, or ask a collection."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .api import Index, collection_name
from .operators.retrieve import falling


def parser() -> argparse.ArgumentParser:
    # The flags.
    p = argparse.ArgumentParser(prog="weftgraph", description=__doc__)
    p.add_argument("-m", "--mode", choices=("index", "query"), required=True)
    source = p.add_mutually_exclusive_group()
    source.add_argument("-i", "--input", help="a text file")
    source.add_argument("--input-dir", help="a folder of text files")
    p.add_argument("--file-pattern", default="*.txt")
    p.add_argument("-c", "--collection", help="by default from the path")
    p.add_argument("-q", "--question")
    p.add_argument("--force-rebuild", action="store_true")
    names = p.add_mutually_exclusive_group()
    names.add_argument("--no-entity-resolution", dest="dedup", action="store_const", const="none")
    names.add_argument("--enable-entity-resolution", dest="dedup", action="store_const", const="standard", help="titles and similar spellings")
    names.add_argument("--enable-entity-resolution-light", dest="dedup", action="store_const", const="light", help="word prefixes (the default)")
    length = p.add_mutually_exclusive_group()
    length.add_argument("--verbose-extraction", dest="validity", action="store_const", const="verbose", help="phrases may be entities (the default)")
    length.add_argument("--compact-extraction", dest="validity", action="store_const", const="standard")
    p.set_defaults(dedup="light", validity="verbose")
    p.add_argument("--no-visualize", action="store_true", help="write no HTML page")
    p.add_argument("--doc-type", help="type of all texts, by default found chunk by chunk")
    p.add_argument("--viz3d", action="store_true", help="show the layered projection")
    p.add_argument("--similarity-threshold", type=float, default=0.75)
    p.add_argument("-v", "--verbose", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    p = parser()
    a = p.parse_args(argv)
    if not (a.input or a.input_dir or a.collection):
        p.error("one of --input, --input-dir and --collection is needed")
    if a.mode == "query" and not a.question:
        p.error("--question is needed to query")
    if a.mode == "index" and not (a.input or a.input_dir):
        p.error("--input or --input-dir is needed to index")
    spark = SparkSession.builder.appName("weftgraph").getOrCreate()
    path = a.input or a.input_dir
    index = Index(spark, a.collection or collection_name(spark, path), dedup=a.dedup, validity=a.validity)
    if a.mode == "index":
        single = a.input is not None
        stats = index.build(path, "*" if single else a.file_pattern, "overwrite" if a.force_rebuild else "append", a.doc_type, validate=not single)
        stats.show(truncate=False)
        if not a.no_visualize:
            index.page(f"{index.store.path}/graph.html", index.collection)
        if a.viz3d:
            index.layered()[0].show(50, truncate=False)
    else:
        row = index.query(a.question, thresholds=falling(a.similarity_threshold))
        print(row.select("response").first()["response"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
