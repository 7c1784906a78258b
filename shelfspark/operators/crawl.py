"""Crawls: pages by breadth and nested sitemaps, by iterating over what is new.

Each round reads the last round's pages, follows their links and keeps those not
seen by an anti join; only these are written, as a batch of a ledger, so a crawl
that ends in the middle goes on from its last round when it is started again.
Batches of rounds are merged eight at a time, so few folders are read however
many rounds there are, and a page is written once for each power of eight.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.ledger import Ledger
from .numbering import numbered
from .written import shared_dir

#: Batches of as many rounds each that are merged into one.
MERGED = 8


def _span(name: str) -> tuple[int, int]:
    first, last = name.split("-")
    return int(first), int(last)


def _live(names: list[str]) -> list[str]:
    """Batches that no other one contains, by round."""
    out: list[str] = []
    for name in sorted(names, key=lambda n: (_span(n)[0], -_span(n)[1])):
        if not out or _span(name)[1] > _span(out[-1])[1]:
            out.append(name)
    return out


def _merge(ledger: Ledger, schema) -> None:
    """Merge the last batches while eight of them cover as many rounds each."""
    while True:
        live = _live(ledger.committed())
        size = [b - a + 1 for a, b in map(_span, live)]
        if len(live) < MERGED or len(set(size[-MERGED:])) > 1:
            return
        last = live[-MERGED:]
        name = f"{_span(last[0])[0]:07d}-{_span(last[-1])[1]:07d}"
        ledger.put(ledger.read(schema, last).coalesce(max(1, size[-1] // MERGED)), name)
        for old in last:
            ledger.forget(old)


def rounds(first: DataFrame, follow: Callable[[DataFrame], DataFrame], folder: str | None = None, most: int | None = None, order: list[str] | None = None) -> DataFrame:
    """All rows with a ``url`` that ``first`` has or ``follow`` comes to from rows of
    the round before, each at its least ``depth`` (0 for ``first``).

    ``follow`` takes a round's rows and returns the columns of ``first``, each URL
    once.  With ``most``, rounds end when as many rows are there, and a round keeps
    no more than are missing, the first by ``order``.  A ``folder`` with rounds of
    the same crawl is gone on from."""
    spark = first.sparkSession
    start = first.withColumn("depth", F.lit(0))
    ledger = Ledger(spark, folder or f"{shared_dir(spark)}/crawl-{uuid.uuid4().hex}")
    ledger.drop_staged()
    schema = start.schema
    for f in schema.fields:
        f.nullable = True

    def kept(new: DataFrame, have: int) -> DataFrame:
        return new if most is None else new.orderBy(*order).limit(most - have)

    if not ledger.committed():
        ledger.put(kept(start, 0), f"{0:07d}-{0:07d}")
    live = _live(ledger.committed())
    have = ledger.read(schema, live).count() if most is not None or len(live) > 1 else 0
    while most is None or have < most:
        live = _live(ledger.committed())
        depth = _span(live[-1])[1]
        seen = ledger.read(schema, live)
        now = ledger.read(schema, live[-1:]).where(F.col("depth") == depth)
        new = follow(now).join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth + 1)).select(start.columns)
        n = ledger.put(kept(new, have), f"{depth + 1:07d}-{depth + 1:07d}")
        if n == 0:
            break
        have += n
        _merge(ledger, schema)
    return ledger.read(schema, _live(ledger.committed()))


def crawl(seeds: DataFrame, links: DataFrame, most: int | None = None, folder: str | None = None) -> DataFrame:
    """Pages by breadth from ``seeds`` (``url``, ``ord``) along ``links`` (``src``,
    ``dst``, ``ord``): ``url``, ``depth`` and ``ord``, which orders the pages of one
    depth as a queue would; the first ``most`` of them by depth and order."""

    def follow(now: DataFrame) -> DataFrame:
        step = now.select(F.col("url").alias("src"), F.col("ord").alias("po")).join(links.select("src", "dst", F.col("ord").alias("lo")), "src")
        new = step.groupBy(F.col("dst").alias("url")).agg(F.min(F.struct("po", "lo")).alias("o"))
        # numbers that grow with the order, if not by one: ranges by their place, rows within
        dealt = new.select("url", "o.po", "o.lo").repartitionByRange("po", "lo", "url").sortWithinPartitions("po", "lo", "url")
        return dealt.select("url", F.monotonically_increasing_id().alias("ord"))

    first = seeds.groupBy("url").agg(F.min("ord").cast("long").alias("ord"))
    pages = rounds(first, follow, folder, most, ["ord", "url"])
    return pages if most is None else pages.orderBy("depth", "ord", "url").limit(most)


def products(pages: DataFrame, links: DataFrame, most: int | None = None) -> DataFrame:
    """Product URLs that crawled ``pages`` show (``links`` to products only), each
    where it is found first: ``url``, ``depth``, ``page_ord``, ``ord``; the first ``most`` in that order."""
    at = pages.select(F.col("url").alias("src"), "depth", F.col("ord").alias("page_ord"))
    shown = at.join(links, "src").groupBy(F.col("dst").alias("url")).agg(F.min(F.struct("depth", "page_ord", "ord")).alias("o"))
    found = shown.select("url", "o.*")
    return found if most is None else found.orderBy("depth", "page_ord", "ord", "url").limit(most)


def parsed_sitemaps(files: DataFrame) -> DataFrame:
    """Sitemap files (``url``, ``body``) to ``url``, ``children`` (sitemaps that an
    index names, in order) and ``locs`` (URLs of one that names none); a broken file has neither."""
    kind = "sitemap array<struct<loc:string>>, url array<struct<loc:string>>"
    x = F.from_xml("body", kind)

    def texts(column: str):
        trimmed = F.transform(F.coalesce(F.col(column), F.array()), lambda s: F.trim(s["loc"]))
        return F.filter(trimmed, lambda s: s.isNotNull() & (s != ""))

    named = files.select("url", x.alias("x")).select("url", texts("x.sitemap").alias("children"), texts("x.url").alias("locs"))
    return named.withColumn("locs", F.when(F.size("children") == 0, F.col("locs")).otherwise(F.array().cast("array<string>")))


def sitemap_urls(seeds: DataFrame, files: DataFrame, folder: str | None = None) -> DataFrame:
    """URLs of sitemaps from ``seeds`` (``url``, ``ord``) down, each once, with its
    number ``n`` in the order in which the files name them depth first.

    A sitemap is read once: at its least depth, there at its first place; for files
    that form a tree that is the order of a recursive reader.  Missing files name nothing."""
    read = parsed_sitemaps(files)

    def follow(now: DataFrame) -> DataFrame:
        step = now.join(read, "url").select("path", F.posexplode("children").alias("place", "child"))
        return step.groupBy(F.col("child").alias("url")).agg(F.min(F.concat("path", F.array(F.col("place").cast("long")))).alias("path"))

    first = seeds.groupBy("url").agg(F.array(F.min("ord").cast("long")).alias("path"))
    maps = rounds(first, follow, folder)
    named = maps.join(read, "url").select("path", F.posexplode("locs").alias("place", "loc"))
    once = named.groupBy(F.col("loc").alias("url")).agg(F.min(F.concat("path", F.array(F.col("place").cast("long")))).alias("path"))
    return numbered(once, ["path"], "n").select("url", "n")
