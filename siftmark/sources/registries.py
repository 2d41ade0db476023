"""What the registries of packages answer, over HTTP."""

from __future__ import annotations

import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from siftmark.operators.dependencies import NPM, PYPI

URLS = {PYPI: "https://pypi.org/pypi/{}/json", NPM: "https://registry.npmjs.org/{}"}
SECONDS, PAUSE, TASKS = 5.0, 0.5, 2
SCHEMA = "registry string, package string, http_status int, body string"


def answer(url: str, seconds: float) -> tuple[int | None, str | None]:
    """(status, body) of a request; the status is null where no answer came, and the body but for status 200."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept": "application/json"}), timeout=seconds) as got:
            return got.status, got.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, None
    except (OSError, ValueError):
        return None, None


def ask(packages: DataFrame, urls: dict[str, str] = URLS, seconds: float = SECONDS, pause: float = PAUSE, tasks: int = TASKS) -> DataFrame:
    """(registry, package, http_status, body) of the different packages (registry, package). So many tasks ask at a time,
    each with a pause after a request, as registries want to be asked slowly. Rows with a null are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for registry, package in zip(*(c.to_pylist() for c in batch.columns)):
                status, body = answer(urls[registry].format(urllib.parse.quote(package, safe="@")), seconds)
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((registry, pa.string()), (package, pa.string()), (status, pa.int32()), (body, pa.string()))], ["registry", "package", "http_status", "body"])
                time.sleep(pause)

    known = packages.where(packages["registry"].isin(*urls) & packages["package"].isNotNull())
    return known.select("registry", "package").distinct().repartition(tasks).mapInArrow(run, SCHEMA)
