"""Sources of papers and works: JSON pages, binaries, archives, feeds.

Hosted services are not reached. A cursor-paginated service is read through ``PagedSource`` from
pages saved as files, and everything else from files as they are.
"""

from __future__ import annotations

import gzip
import io
import json
import re
import tarfile
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillforge.functions.text import detect_format, latex_to_text
from quillforge.schemas import CORPUS, WORKS

FILES = T.MapType(T.StringType(), T.StringType())
#: Fixed value: the depth beyond which inputs are no longer followed.
DEEPEST = 15


def read_works(spark: SparkSession, path: str) -> DataFrame:
    """Works as JSON lines."""
    return spark.read.schema(WORKS).json(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A corpus export, one JSON array a file."""
    return spark.read.schema(CORPUS).json(path, multiLine=True)


def read_binaries(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, format) of fetched files; format by magic bytes, null for neither kind."""
    return spark.read.format("binaryFile").load(path).select("path", "content", detect_format(F.col("content")).alias("format"))


def read_texts(spark: SparkSession, path: str, limit: int = 40_000) -> DataFrame:
    """(path, text, head) of whole text files; head is what a bounded prompt takes."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.input_file_name().alias("path"), F.col("value").alias("text"), F.substring("value", 1, limit).alias("head"))


def members_of(content: bytes | None) -> dict[str, str]:
    """The TeX files of an archive, or a lone gzipped TeX file; {} for anything else."""
    if not content:
        return {}
    try:
        with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as archive:
            return {m.name: archive.extractfile(m).read().decode("utf-8", "replace") for m in archive if m.isfile() and m.name.lower().endswith(".tex")}
    except tarfile.TarError:
        pass
    try:
        text = gzip.decompress(content).decode("utf-8", "replace")
    except (OSError, EOFError):
        return {}
    return {"main.tex": text} if "\\" in text else {}


@F.pandas_udf(FILES)
def archive_files(content: pd.Series) -> pd.Series:
    """Name to text of each archive's TeX files."""
    return content.map(members_of)


def main_file(files: Column) -> Column:
    """the name of the first file that begins a document, else declares a class, else is longest."""
    entries = F.array_sort(F.map_entries(files))
    first = lambda mark: F.try_element_at(F.filter(entries, lambda e: F.contains(e["value"], F.lit(mark))), F.lit(1))["key"]
    longest = F.try_element_at(F.array_sort(F.transform(entries, lambda e: F.struct((-F.length(e["value"])).alias("n"), e["key"].alias("key")))), F.lit(1))["key"]
    return F.coalesce(first("\\begin{document}"), first("\\documentclass"), longest)


_INPUT = re.compile(r"\\(?:input|include)\{([^}]+)\}")


def expand(main: str | None, files: dict[str, str] | None) -> str | None:
    """inputs replaced by their files' texts, by name without folder and ending; what is missing or
    within itself is left out."""
    if main is None or not files or main not in files:
        return None
    named = {PurePosixPath(name).stem: text for name, text in files.items()}

    def fill(text: str, above: tuple[str, ...]) -> str:
        if len(above) > DEEPEST:
            return text
        pieces = _INPUT.split(text)
        for i in range(1, len(pieces), 2):
            name = PurePosixPath(pieces[i].strip()).stem
            pieces[i] = fill(named[name], (*above, name)) if name in named and name not in above else ""
        return "".join(pieces)

    return fill(files[main], ())


@F.pandas_udf(T.StringType())
def inlined(main: pd.Series, files: pd.Series) -> pd.Series:
    """F12 for columns."""
    return pd.Series([expand(m, dict(f) if f is not None else None) for m, f in zip(main, files, strict=True)])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of the TeX archives under a path."""
    files = read_binaries(spark, path).where("format = 'latex'").select("path", archive_files("content").alias("files"))
    whole = files.select("path", inlined(main_file(F.col("files")), F.col("files")).alias("tex")).where("tex is not null")
    return whole.select("path", latex_to_text(F.col("tex")).alias("text"))


def entries_of_feed(feed: Column) -> Column:
    """(id, names) of each entry of an Atom document."""
    schema = "entry array<struct<id: string, author: array<struct<name: string>>>>"
    parsed = F.from_xml(feed, schema)
    last = lambda e: F.regexp_replace(F.element_at(F.split(e["id"], "/abs/"), -1), r"v\d+$", "")
    return F.transform(parsed["entry"], lambda e: F.struct(last(e).alias("id"), F.transform(e["author"], lambda a: a["name"]).alias("names")))


@dataclass
class Answer:
    """What a transport gives for a URL."""

    status: int
    content: bytes = b""
    headers: dict[str, str] = field(default_factory=dict)


#: What is tried again, and what means that there is nothing to have.
AGAIN, NOTHING = (429, 500, 502, 503, 504), (403, 404, 410)
#: Seconds between two requests to a service, by kind of service.
SPACING = {"source": 3.0, "works": 0.15, "citations": 1.1}


class Fetcher:
    """Spaced requests with exponential backoff, over a transport that the caller gives.

    transport: a function from URL to Answer. A service's wish in Retry-After comes before the backoff.
    """

    def __init__(self, transport: Callable[[str], Answer], spacing: float = 0.0, attempts: int = 5, delay: float = 2.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.transport, self.spacing, self.attempts, self.delay, self.clock, self.sleep = transport, spacing, attempts, delay, clock, sleep
        self.last: float | None = None

    def get(self, url: str) -> bytes | None:
        """The content; None for what isn't to be had; an error after ``attempts`` tries or for any other status."""
        pause = self.delay
        for _ in range(self.attempts):
            if self.last is not None and (early := self.spacing - (self.clock() - self.last)) > 0:
                self.sleep(early)
            try:
                answer = self.transport(url)
            finally:
                self.last = self.clock()
            if answer.status == 200:
                return answer.content
            if answer.status in NOTHING:
                return None
            if answer.status not in AGAIN:
                raise OSError(f"{url}: status {answer.status}")
            self.sleep(float(answer.headers.get("Retry-After") or pause))
            pause *= 2
        raise OSError(f"{url}: gave up after {self.attempts} tries")


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """(id, path, written) of files (id, content, ext), each whole under its id's stem in ``folder``, relative to it.

    One that is there already (S21) is left as it is. folder: on a file system that pyarrow reaches from all nodes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        uri = f"file://{folder}" if "://" not in folder else folder
        system, place = fs.FileSystem.from_uri(uri)
        system.create_dir(place, recursive=True)
        for pdf in batches:
            rows = []
            for paper, content, ext in zip(pdf.id, pdf.content, pdf.ext, strict=True):
                name = f"{paper.replace('/', '_')}.{ext}"
                fresh = system.get_file_info(f"{place}/{name}").type == fs.FileType.NotFound
                if fresh:
                    # Under a name of its own first: a task that dies leaves no half a file.
                    draft = f"{place}/_draft-{uuid.uuid4().hex}"
                    with system.open_output_stream(draft) as out:
                        out.write(content)
                    system.move(draft, f"{place}/{name}")
                rows.append((paper, name, fresh))
            yield pd.DataFrame(rows, columns=["id", "path", "written"])

    return files.select("id", "content", "ext").mapInPandas(run, "id string, path string, written boolean")


class _Page(InputPartition):
    def __init__(self, cursor: str) -> None:
        super().__init__(cursor)


class PagedReader(DataSourceReader):
    """Follows ``next`` from page to page; each page is a partition of its own."""

    def __init__(self, options: dict) -> None:
        self.folder, self.first, self.most = options["path"], options.get("first", "page-0.json"), int(options.get("most", 400))

    def _load(self, name: str) -> dict:
        from pyarrow import fs

        uri = self.folder if "://" in self.folder else f"file://{self.folder}"
        system, path = fs.FileSystem.from_uri(uri)
        with system.open_input_stream(f"{path}/{name}") as own:
            return json.loads(own.read())

    def partitions(self) -> list[_Page]:
        pages, name, rows = [], self.first, 0
        while name and rows < self.most:
            page = self._load(name)
            if not page["results"]:
                break
            pages.append(_Page(name))
            rows += len(page["results"])
            name = page.get("next")
        return pages

    def read(self, partition: _Page) -> Iterator[tuple[str, int, str]]:
        for i, row in enumerate(self._load(partition.value)["results"]):
            yield partition.value, i, json.dumps(row)


class PagedSource(DataSource):
    """S3: rows (page, pos, json) of saved result pages, until one is empty, last, or ``most`` rows are there.

    Whole pages come; take ``orderBy("page", "pos").limit(most)`` for the exact number.
    """

    @classmethod
    def name(cls) -> str:
        return "result_pages"

    def schema(self) -> str:
        return "page string, pos long, json string"

    def reader(self, schema: T.StructType) -> PagedReader:
        return PagedReader(dict(self.options))
