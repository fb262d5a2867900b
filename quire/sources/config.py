"""Settings of a library: defaults, merging, environment, work limits, and the local converter.

All of this is a few facts for each run, so it is plain Python on the driver; only
``merged_settings`` is for tables of settings of many libraries.
"""

from __future__ import annotations

import os
import re
import shutil
import subprocess
import time
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    import yaml
except ImportError:  # settings are then read as JSON, which is YAML too
    yaml = None

CONFIG_FILE = "library.yaml"
# Fixed values.
DEFAULTS: dict[str, Any] = {
    "schema_version": 1,
    "naming": {"template": "default", "duplicate_strategy": "append-counter", "rename_on_convert": True, "sanitize": {"max_length": 180, "ascii_slug": False}},
    "metadata": {"default_mode": "fast", "language_detection": "auto"},
    "converter": {"executable": "convert-pdf", "local_backend": None, "local_jobs": "auto", "max_wait_seconds": None},
    "output": {"json": False},
}
#: Files that a request to the batch converter may hold at most.
MOST_FILES = 50
_VERSION = re.compile(r"\d+(?:\.\d+)+")


def merged(base: Mapping, override: Mapping) -> dict:
    """Both mappings as one: where both have a mapping these are merged too, else the second one's value counts."""
    out = dict(base)
    for key, value in override.items():
        old = out.get(key)
        out[key] = merged(old, value) if isinstance(old, Mapping) and isinstance(value, Mapping) else value
    return out


def parsed_config(text: str | None) -> dict:
    """The settings of a file's text over the defaults; a file that is missing or empty has none of its own."""
    import json

    given = (yaml.safe_load(text) if yaml else json.loads(text or "null")) if text and text.strip() else {}
    if not isinstance(given or {}, Mapping):
        raise ValueError("settings must be a mapping")
    return merged(DEFAULTS, given or {})


def load_config(spark: SparkSession, library: str) -> dict:
    """The settings of a library, read through Spark's file systems."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{library}/{CONFIG_FILE}")
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return parsed_config(spark.read.text(str(path), wholetext=True).first()["value"] if there else None)


def merged_settings(base: DataFrame, override: DataFrame, by: str = "library") -> DataFrame:
    """The same for rows (by, path, value), one for each leaf, its keys joined by dots.

    A base leaf goes where the override has a leaf at its path, above it or below it:
    each path is joined to its own ancestors, so all joins are on keys.
    """
    above = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, r"\."))), lambda n: F.array_join(F.slice(F.split(c, r"\."), F.lit(1), n), "."))
    leaves = override.select(by, F.col("path").alias("_p"))
    rows = base.withColumn("_above", above(F.col("path")))
    covered = rows.select(by, "path", F.explode("_above").alias("_p")).join(leaves, [by, "_p"], "left_semi").select(by, "path")
    opened = rows.select(by, "path").join(leaves.select(by, F.explode(above(F.col("_p"))).alias("path")), [by, "path"], "left_semi")
    return base.join(covered.unionByName(opened).distinct(), [by, "path"], "left_anti").unionByName(override)


def setting(env: Mapping[str, str], name: str, config: Mapping, key: str, default: Any = None) -> Any:
    """An environment variable that isn't empty, else the configured value, else the default."""
    return env.get(name) or config.get(key, default)


def positive_seconds(value: str | float) -> float:
    seconds = float(value)
    if not seconds > 0:
        raise ValueError("must be a number of seconds above zero")
    return seconds


def workers_for(workers: int, batches: int) -> int:
    """As many as asked for, one at least and no more than there is work; none without work."""
    return min(max(1, workers), batches) if batches > 0 else 0


def local_jobs(config: Mapping, asked: int | None, pending: int) -> int:
    """Jobs of the local converter: as asked or configured, within 1 and the pending papers; "auto" is 1."""
    stated = asked if asked is not None else config.get("converter", {}).get("local_jobs", "auto")
    number = int(stated) if isinstance(stated, int) or isinstance(stated, str) and stated.isdigit() else 1
    return max(1, min(number, max(1, pending)))


def batch_size(asked: int) -> int:
    return max(1, min(asked, MOST_FILES))


class Deadline:
    """A budget of seconds that starts now; without a number it never ends."""

    def __init__(self, seconds: float | None):
        self.end = None if seconds is None else time.monotonic() + positive_seconds(seconds)

    def left(self, most: float | None = None) -> float | None:
        """Seconds that remain, ``most`` at most; an error once there are none."""
        if self.end is None:
            return most
        rest = self.end - time.monotonic()
        if rest <= 0:
            raise TimeoutError("the time budget is used up")
        return rest if most is None else min(rest, most)


def upload_url(answer: str | Mapping) -> str:
    """The address out of the forms in which services give one."""
    if not isinstance(answer, Mapping):
        return answer
    found = next((answer[k] for k in ("url", "upload_url", "file_url") if answer.get(k)), None)
    if found is None:
        raise KeyError("no upload address")
    return found


@dataclass(frozen=True)
class ProviderConfig:
    base_url: str
    api_key: str
    model: str
    temperature: float
    timeout_seconds: float


def provider_config(config: Mapping, env: Mapping[str, str] | None = None, prefix: str = "LIBRARY_AI") -> ProviderConfig:
    """The language model's settings; an error names all that is missing."""
    env, own = os.environ if env is None else env, config.get("ai") or {}
    key_name = own.get("api_key_env") or f"{prefix}_API_KEY"
    key, model = env.get(key_name) or env.get(f"{prefix}_API_KEY") or "", setting(env, f"{prefix}_MODEL", own, "model", "")
    missing = [name for name, value in ((key_name, key), (f"{prefix}_MODEL or ai.model", model)) if not value]
    if missing:
        raise ValueError("missing settings of the provider: " + ", ".join(missing))
    base = str(setting(env, f"{prefix}_BASE_URL", own, "base_url", "http://localhost/v1")).rstrip("/")
    return ProviderConfig(base, key, str(model), float(setting(env, f"{prefix}_TEMPERATURE", own, "temperature", 0)), positive_seconds(setting(env, f"{prefix}_TIMEOUT_SECONDS", own, "timeout_seconds", 60)))


def wants_local_check(config: Mapping) -> bool:
    """Whether the settings name a local converter that is not just the default."""
    own = config.get("converter") or {}
    executable = own.get("executable")
    return bool(executable) and (executable != DEFAULTS["converter"]["executable"] or bool(own.get("local_backend")) or own.get("local_jobs") not in (None, "auto"))


def version_in(output: str) -> str | None:
    """The first dotted number of what a program says of itself, else all that it says."""
    found = _VERSION.search(output)
    return found[0] if found else output.strip() or None


@dataclass(frozen=True)
class LocalConverter:
    executable: str
    exists: bool
    version: str | None = None
    error: str | None = None


def local_converter(config: Mapping, probe: bool = False) -> LocalConverter:
    """The configured program: where it is, and with ``probe`` what version it states."""
    asked = str((config.get("converter") or {}).get("executable") or DEFAULTS["converter"]["executable"])
    path = shutil.which(os.path.expanduser(asked))
    if path is None:
        return LocalConverter(asked, False, error=f"no such program: {asked}")
    if not probe:
        return LocalConverter(path, True)
    try:
        done = subprocess.run([path, "--version"], capture_output=True, text=True, timeout=10, check=False)
    except (OSError, subprocess.TimeoutExpired) as e:
        return LocalConverter(path, True, error=str(e))
    said = f"{done.stdout}\n{done.stderr}".strip()
    return LocalConverter(path, True, version_in(said)) if said or not done.returncode else LocalConverter(path, True, error=f"exit code {done.returncode}")


def diagnostics(spark: SparkSession, library: str, env: Mapping[str, str] | None = None, strict: bool = False, prefix: str = "LIBRARY_AI") -> DataFrame:
    """(area, fact, value) of a library's surroundings: folders, settings, keys that are set (never their values), the local converter."""
    env = os.environ if env is None else env
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    exists = lambda p: fs_path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path(p))
    rows = [("library", "path", library), ("library", "config_exists", exists(f"{library}/{CONFIG_FILE}"))]
    rows += [("library", f"{x}_exists", exists(f"{library}/{x}")) for x in ("inbox", "collections", "indexes")]
    try:
        config = load_config(spark, library)
    except Exception as e:  # noqa: BLE001  whatever is wrong with the file is a fact to report
        rows.append(("library", "config_error", str(e).splitlines()[0]))
        config = {}
    own, ai = config.get("converter") or {}, config.get("ai") or {}
    rows += [("converter", k, own.get(k)) for k in ("executable", "local_backend", "local_jobs", "max_wait_seconds")]
    key_name = ai.get("api_key_env") or f"{prefix}_API_KEY"
    rows += [("ai", "api_key_env", key_name), ("ai", "api_key_available", bool(env.get(key_name) or env.get(f"{prefix}_API_KEY")))]
    rows += [("ai", f"{k}_configured", bool(setting(env, f"{prefix}_{k.upper()}", ai, k))) for k in ("base_url", "model")]
    if config and (strict or wants_local_check(config)):
        local = local_converter(config, probe=strict)
        rows += [("converter", "local_exists", local.exists), ("converter", "local_version", local.version), ("converter", "local_error", local.error)]
    text = lambda v: None if v is None else str(v).lower() if isinstance(v, bool) else str(v)
    return spark.createDataFrame([(a, k, text(v)) for a, k, v in rows], "area string, fact string, value string")
