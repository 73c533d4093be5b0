"""Command line: ``python -m docketry.cli COMMAND``; rows come out as JSON lines.

An error is one line on stderr and exit code 1.
"""

from __future__ import annotations

import argparse
import datetime
import importlib
import json
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Hits by default and at most.
HITS, MOST = 20, 1000


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docketry")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("queries", help="names of the registered queries")
    run = sub.add_parser("run", help="a registered query")
    run.add_argument("name")
    for name in ("search", "documents"):
        s = sub.add_parser(name, help=f"BM25 search: {'blocks' if name == 'search' else name}")
        s.add_argument("query")
    index = sub.add_parser("index", help="refresh a stored index, and search it if a query is given")
    index.add_argument("root")
    index.add_argument("--query")
    links = sub.add_parser("links", help="literal references between documents")
    links.add_argument("--pattern")
    request = sub.add_parser("request", help="check a request file and print it in normal form")
    request.add_argument("file")
    ingest = sub.add_parser("ingest", help="a meeting's directory pages and lists into a repository; prints its lists")
    ingest.add_argument("meeting")
    ingest.add_argument("--list", help="URL of the list to take as the current one")
    notes = sub.add_parser("notes", help="discover, fetch and select a meeting's notes; prints the selected one's blocks")
    notes.add_argument("meeting")
    notes.add_argument("--group", default="R1")
    notes.add_argument("--snapshot", help="identifier of the snapshot to select")
    for s in (ingest, notes):
        s.add_argument("--root", required=True, help="folder of the repository")
        s.add_argument("--url", required=True, nargs="+", help="directory pages")
        s.add_argument("--pages", default="docketry.sources.directory:http_get", help="module:function that gets a page")
        s.add_argument("--files", default="docketry.sources.directory:http_bytes", help="module:function that gets a file")
        s.add_argument("--limit", type=int, default=MOST)
    for s in (run, *[sub.choices[n] for n in ("search", "documents", "index", "links")]):
        s.add_argument("--data", required=True, help="folder of the Parquet tables")
        s.add_argument("--limit", type=int, default=HITS)
    return p


# Header names of a document list, without case.
ALIASES = {"tdoc_id": ["tdoc", "tdoc number"], "title": ["title"], "status": ["tdoc status", "status"]}


def _acquired(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Pages first, landed in the repository's folder, then what they name."""
    from docketry.sources import acquisition, directory, listings
    from docketry.sources.repository import Repository

    spark.dataSource.register(directory.DirectorySource)
    landed = f"{a.root.rstrip('/')}/pages/{uuid.uuid4().hex}"
    spark.read.format("meeting_directory").option("url", " ".join(a.url)).option("fetch", a.pages).load().write.parquet(landed)
    pages, repo = spark.read.parquet(landed), Repository(spark, a.root)
    module, name = a.files.split(":")
    fetch = getattr(importlib.import_module(module), name)
    if a.command == "ingest":
        return acquisition.ingest_meeting(repo, pages, a.meeting, fetch, ALIASES, a.list)
    found = acquisition.Notes(repo, fetch)
    found.discover(listings.page_links(pages).select("name", "link"), a.group, a.meeting, datetime.datetime.now())
    found.fetch(a.group, a.meeting)
    return found.load(a.group, a.meeting, a.snapshot)


def _rows(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    from docketry.operators import index, links, search
    from docketry.plans import registry, search_queries
    from pyspark.sql import functions as F

    if not 1 <= a.limit <= MOST:
        raise ValueError(f"limit must be from 1 to {MOST}")
    if a.command in ("ingest", "notes"):
        return _acquired(spark, a).limit(a.limit)
    if a.command == "run":
        return registry.queries()[a.name](spark, a.data).limit(a.limit)
    docs = search_queries.table(spark, a.data, "documents")
    if a.command == "index":
        fresh = index.refresh(spark, a.root, docs.select("doc_id", "text"))
        if not a.query:
            return fresh.groupBy("state").count()
        return index.search(spark, a.root, a.query).orderBy(F.desc("score"), "doc_id", "pos").limit(a.limit)
    if a.command == "links":
        texts = docs.select(F.col("doc_id").cast("string").alias("source"), "text")
        return (links.reference_edges(texts, a.pattern) if a.pattern else links.reference_edges(texts)).limit(a.limit)
    hits = search.search_blocks(search_queries.blocks(spark, a.data), a.query)
    return search.top_blocks(hits, a.limit).drop("tokens") if a.command == "search" else search.rollup_documents(hits, a.limit)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(argv)
    try:
        if a.command == "queries":
            from docketry.plans import registry

            print("\n".join(sorted(registry.queries())))
        elif a.command == "request":
            from docketry.plans.study import normalize_request
            from docketry.sources import requests

            with open(a.file, encoding="utf-8") as f:
                print(requests.to_yaml(normalize_request(**requests.from_yaml(f.read()))), end="")
        else:
            spark = spark or SparkSession.builder.appName("docketry").getOrCreate()
            for line in _rows(spark, a).toJSON().collect():  # at most MOST rows
                print(json.dumps(json.loads(line), ensure_ascii=False, sort_keys=True))
    except Exception as e:
        print(f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
