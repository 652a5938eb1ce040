"""Contracts of what needs a network or a library that isn't here; callers inject implementations."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame


class Probe(NamedTuple):
    status: int | None
    content_type: str
    size: int
    error: str


Fetcher = Callable[[str], Probe]
Store = Callable[[str, bytes], str]
Recogniser = Callable[[bytes], str]
Rewriter = Callable[[str], str]


def probe_urls(plan: DataFrame, fetch: Fetcher, tasks: int = 8) -> DataFrame:
    """(url, is_image, status, content_type, size, error) of each planned URL, probed once by the given function."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [fetch(u) for u in pdf.url]
            yield pd.DataFrame({"url": pdf.url, "is_image": pdf.is_image, "status": pd.array([g.status for g in got], "Int64"), "content_type": [g.content_type for g in got], "size": [g.size for g in got], "error": [g.error for g in got]})

    return plan.select("url", "is_image").repartition(tasks, "url").mapInPandas(run, "url string, is_image boolean, status long, content_type string, size long, error string")


def upload(assets: DataFrame, store: Store) -> DataFrame:
    """(content_key, url, status) of assets (content_key, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, content in zip(pdf.content_key, pdf.content, strict=True):
                try:
                    rows.append((key, store(key, bytes(content)), "uploaded"))
                except OSError:
                    rows.append((key, None, "failed"))
            yield pd.DataFrame(rows, columns=["content_key", "url", "status"])

    return assets.select("content_key", "content").mapInPandas(run, "content_key string, url string, status string")


def recognise(images: DataFrame, engine: Recogniser) -> DataFrame:
    """(path, text) of images (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf.path, "text": [engine(bytes(c)) for c in pdf.content]})

    return images.select("path", "content").mapInPandas(run, "path string, text string")
