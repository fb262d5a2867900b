"""Language-model providers and converters behind small interfaces, called on executors."""

from __future__ import annotations

import json
import pathlib
import shutil
import subprocess
import time
import uuid
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


class Provider(Protocol):
    def complete(self, messages: str, schema_name: str) -> str:
        """The JSON answer to JSON messages."""


class Converter(Protocol):
    name: str

    def convert(self, content: bytes) -> str:
        """The Markdown of a document."""


class BatchConverter(Protocol):
    name: str

    def convert_batch(self, items: list[tuple[str, bytes]]) -> list[tuple[str, bool, str | None, str | None]]:
        """(key, ok, markdown, error) of (key, content) of one batch, in any order."""


class SourceAdapter(Protocol):
    """Finds documents of one kind of source; all give rows of the same columns, so what follows doesn't depend on it."""

    def discover(self, spark: SparkSession, path: str) -> DataFrame:
        """path, id, bytes, content of each document."""


class LocalFolder:
    """All PDF files of a folder, whatever its store."""

    def discover(self, spark: SparkSession, path: str) -> DataFrame:
        from pyspark.sql import functions as F

        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
        return files.select("path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("id"), F.col("length").alias("bytes"), "content")


class FixtureConverter:
    """Gives every document the same Markdown, for tests and dry runs."""

    name = "local-fixture"

    def __init__(self, markdown: str):
        self.markdown = markdown

    def convert(self, content: bytes) -> str:
        return self.markdown


class LocalCommand:
    """A converter that is a program: it is given a file and a folder, and leaves its Markdown there.

    Both are made below ``scratch``, for one call, and are gone after it.
    """

    name = "local-command"

    def __init__(self, command: list[str], scratch: str, seconds: float = 1800):
        self.command, self.scratch, self.seconds = command, scratch, seconds

    def convert(self, content: bytes) -> str:
        folder = pathlib.Path(self.scratch, uuid.uuid4().hex)
        folder.mkdir(parents=True)
        try:
            given = folder / "original.pdf"
            given.write_bytes(content or b"")
            done = subprocess.run([*self.command, str(given), str(folder)], capture_output=True, text=True, timeout=self.seconds, check=False)
            if done.returncode:
                raise RuntimeError(done.stderr.strip() or f"exit code {done.returncode}")
            found = sorted(folder.glob("**/*.md"))
            if not found:
                raise ValueError("no Markdown in what the converter left")
            return found[0].read_text(encoding="utf-8", errors="replace")
        finally:
            shutil.rmtree(folder, ignore_errors=True)


class EchoProvider:
    """Answers from the request alone: the same answer on each run, without a network."""

    def complete(self, messages: str, schema_name: str) -> str:
        asked = json.loads(messages)
        if schema_name == "block-summary":
            return json.dumps({"blocks": [{"block_id": b["block_id"], "summary_text": b["text"][:80], "role": "other", "importance": "medium", "concepts": []} for b in asked["blocks"]]})
        if schema_name == "sections":
            return json.dumps({"sections": [{"section_id": s["section_id"], "summary": " ".join(s["texts"])[:200], "role": "other"} for s in asked["sections"]]})
        if schema_name == "graph":
            nodes = [{"id": f"n{i}", "type": "concept", "label": b["summary_text"][:40], "source_block_ids": [b["block_id"]]} for i, b in enumerate(asked["blocks"])]
            edges = [{"source": f"n{i}", "target": f"n{i + 1}", "type": "supports", "source_block_ids": []} for i in range(len(nodes) - 1)]
            return json.dumps({"nodes": nodes, "edges": edges})
        return json.dumps({})

    def health(self) -> dict[str, str]:
        return {"provider": "echo", "check": "none needed"}


def provider_health(spark: SparkSession, provider: Provider) -> DataFrame:
    """One row: whether a provider answers when asked how it is, and what it says or the error."""
    try:
        said, error = json.dumps(provider.health()), None
    except Exception as e:  # noqa: BLE001  the provider's errors are its own
        said, error = None, str(e)
    return spark.createDataFrame([(error is None, said, error)], "ok boolean, said string, error string")


def answered(requests: DataFrame, provider: Provider, schema_name: str, key: str = "request_id", at_once: int | None = None, retries: int = 2, wait: float = 10.0, seconds: float | None = None) -> DataFrame:
    """key, answer, error of requests (key, messages).

    ``at_once`` bounds the calls that run at one time, by the number of partitions.
    A call is tried again but not after its time budget; an error is a row, not a
    failed task.  Write the result before using it twice: a lost task calls again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            answers, errors = [], []
            for messages in pdf["messages"]:
                answer = error = None
                began = time.monotonic()
                for turn in range(retries + 1):
                    try:
                        answer, error = provider.complete(messages, schema_name), None
                        break
                    except Exception as e:  # noqa: BLE001  the provider's errors are its own
                        error = str(e)
                        if turn == retries or seconds is not None and time.monotonic() - began + wait > seconds:
                            break
                        time.sleep(wait)
                answers.append(answer)
                errors.append(error)
            yield pd.DataFrame({key: pdf[key], "answer": pd.Series(answers, dtype=object), "error": pd.Series(errors, dtype=object)})

    rows = requests.select(key, "messages")
    if at_once:
        rows = rows.repartition(at_once, key)
    kind = requests.schema[key].dataType.simpleString()
    return rows.mapInPandas(run, f"`{key}` {kind}, answer string, error string")


def converted(files: DataFrame, converter: Converter, key: str = "bundle_path", content: str = "content") -> DataFrame:
    """key, ok, markdown, error of documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, raw in zip(pdf[key], pdf[content], strict=True):
                try:
                    rows.append((k, True, converter.convert(raw), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((k, False, None, str(e)))
            yield pd.DataFrame(rows, columns=[key, "ok", "markdown", "error"])

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, content).mapInPandas(run, f"`{key}` {kind}, ok boolean, markdown string, error string")


def converted_in_batches(files: DataFrame, converter: BatchConverter, size: int, key: str = "bundle_path", content: str = "content") -> DataFrame:
    """key, ok, markdown, error of documents, handed over ``size`` at a time within each task; a batch that fails fails its documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), size):
                part = pdf.iloc[i : i + size]
                try:
                    rows = converter.convert_batch(list(zip(part[key], part[content], strict=True)))
                except Exception as e:  # noqa: BLE001
                    rows = [(k, False, None, str(e)) for k in part[key]]
                told = {r[0] for r in rows}
                rows = [*rows, *((k, False, None, "no result") for k in part[key] if k not in told)]
                yield pd.DataFrame(rows, columns=[key, "ok", "markdown", "error"])

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, content).mapInPandas(run, f"`{key}` {kind}, ok boolean, markdown string, error string")
