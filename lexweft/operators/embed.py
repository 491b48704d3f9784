"""Embedding providers: they add a column ``vec`` of doubles to a frame with a text column."""

from __future__ import annotations

import hashlib
import http.client
import json
import logging
import re
import threading
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidConfig
from ..functions import text as tx
from ..functions import vectors as vx

log = logging.getLogger(__name__)


#: Kinds of failure, in the order in which a request can meet them: no text, no answer, an answer with an error status,
#: one that isn't JSON, an empty one, one without the field, one whose field isn't a list, one with an empty list,
#: one whose entries aren't numbers; and vectors that a table hasn't, or texts without words for the hashing provider.
FAILURES = ("no_text", "request", "status", "json", "empty_response", "no_field", "no_list", "empty_list", "values", "missing", "no_words")


class EmbeddingProvider(ABC):
    """Embeds texts in a role (document or query); ``model`` names what made the vectors, for caches."""

    model = "unnamed"
    dim = 0

    @abstractmethod
    def answer(self, df: DataFrame, role: str, text: str = "text") -> DataFrame:
        """``df`` with columns vec array<double>, all zeros where embedding failed, and failure: null or one of FAILURES."""

    def ask(self, df: DataFrame, role: str, text: str = "text") -> DataFrame:
        """``answer`` for rows whose texts differ and aren't null."""
        return self.answer(df, role, text)

    def embed(self, df: DataFrame, role: str, text: str = "text") -> DataFrame:
        """``df`` with a column vec array<double>; all zeros where embedding failed."""
        return self.answer(df, role, text).drop("failure")


def outcome(vec: str = "vec", failure: str = "failure") -> list[Column]:
    """Aggregates that ``DataFrame.observe`` takes along: n, n_ok, n_failed, and one count for each kind of failure."""
    bad = F.col(failure).isNotNull() | vx.is_zero(F.col(vec))
    return [F.count(F.lit(1)).alias("n"), F.count_if(~bad).alias("n_ok"), F.count_if(bad).alias("n_failed"), *[F.count_if(F.col(failure) == k).alias(k) for k in FAILURES]]


def observed(seen: Observation) -> dict[str, int]:
    """What ``outcome`` counted; nothing where Spark saw beforehand that there are no rows, and left the pass out."""
    try:
        return seen.get
    except Py4JJavaError:
        return {}


class LookupProvider(EmbeddingProvider):
    """Vectors that are at hand: a frame with the join keys and ``embedding``."""

    model = "lookup"

    def __init__(self, vectors: DataFrame, keys: list[str], dim: int):
        self.vectors, self.keys, self.dim = vectors, keys, dim

    def answer(self, df: DataFrame, role: str, text: str = "text") -> DataFrame:
        known = self.vectors.select(*self.keys, F.col("embedding").alias("vec"))
        out = df.join(known, self.keys, "left").withColumn("failure", F.when(F.col("vec").isNull(), "missing"))
        return out.withColumn("vec", vx.or_zeros(F.col("vec"), self.dim).cast("array<double>"))


def hashed(text: str, dim: int) -> np.ndarray:
    """Unit vector of counts of words by the first eight digits of their md5, modulo dim; zeros without words."""
    out = np.bincount([_digits(w) % dim for w in _WORDS.findall(text)], minlength=dim).astype(np.float64)
    size = np.linalg.norm(out)
    return out / size if size else out


@lru_cache(maxsize=1 << 18)
def _digits(word: str) -> int:
    return int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "big")


#: Unicode White_Space; Python's own \s also takes U+001C to U+001F.
_WORDS = re.compile("[^\t-\r \x85\xa0  -     　]+")


class HashingProvider(EmbeddingProvider):
    """Deterministic vectors without any model."""

    def __init__(self, dim: int = 64):
        self.dim, self.model = dim, f"md5-words-{dim}"

    def answer(self, df: DataFrame, role: str, text: str = "text") -> DataFrame:
        dim = self.dim

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                made = [hashed(t or "", dim) for t in batch[text]]
                why = ["no_text" if t is None else None if v.any() else "no_words" for t, v in zip(batch[text], made, strict=True)]
                yield batch.assign(vec=made, failure=why)

        return df.mapInPandas(run, _answered(df))


def _answered(df: DataFrame) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField("vec", T.ArrayType(T.DoubleType())), T.StructField("failure", T.StringType())])


def read_response(body: str) -> tuple[list[float] | None, str | None]:
    """The first inner vector of [{"embedding": [[...]]}], or the kind of failure."""
    try:
        found = json.loads(body)
    except ValueError:
        return None, "json"
    if not isinstance(found, list):
        return None, "json"
    if not found:
        return None, "empty_response"
    if not isinstance(found[0], dict) or "embedding" not in found[0]:
        return None, "no_field"
    held = found[0]["embedding"]
    if not isinstance(held, list):
        return None, "no_list"
    if not held:
        return None, "empty_list"
    vec = held[0]
    if not isinstance(vec, list) or not vec or any(isinstance(x, bool) or not isinstance(x, int | float) for x in vec):
        return None, "values"
    return [float(x) for x in vec], None


def decode_response(body: str, dim: int) -> list[float]:
    """The vector of a response; zeros for a failed one."""
    return read_response(body)[0] or [0.0] * dim


class Pace:
    """Spaces the requests of a task, and holds all of them back while the service is overloaded."""

    def __init__(self, per_second: float | None = None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep, self.next, self.lock = 1 / per_second if per_second else 0.0, clock, sleep, 0.0, threading.Lock()

    def wait(self) -> None:
        with self.lock:
            now = self.clock()
            at = max(now, self.next)
            self.next = at + self.gap
        if at > now:
            self.sleep(at - now)

    def hold(self, seconds: float) -> None:
        """No request begins within so many seconds."""
        with self.lock:
            self.next = max(self.next, self.clock() + seconds)


#: Statuses under 500 that are worth another try: timeout, too early, too many requests.
AGAIN = (408, 425, 429)


class HttpProvider(EmbeddingProvider):
    """POSTs {"content": prompt} to an endpoint, a text in each request, ``batch`` at once in each task.

    Each distinct text is asked once. A task makes up to ``per_second`` requests a second. Lost connections, timeouts,
    statuses of 500 and more and AGAIN are tried again up to ``retries`` times, after a pause for the whole task: as long
    as the service says (Retry-After), else ``pause`` seconds, doubled with each try. Other statuses, and answers
    that can't be read, are final.
    """

    def __init__(self, url: str, dim: int = 768, timeout: float = 30.0, retries: int = 2, batch: int = 10, per_second: float | None = None, pause: float = 0.5):
        self.url, self.dim, self.timeout, self.retries, self.batch, self.model = url, dim, timeout, retries, batch, url
        self.per_second, self.pause = per_second, pause

    def answer(self, df: DataFrame, role: str, text: str = "text") -> DataFrame:
        keyed = df.withColumn("_key", F.sha2(F.col(text), 256))
        asked = keyed.where(F.col(text).isNotNull()).select("_key", F.col(text).alias("_text")).dropDuplicates(["_key"])
        made = self.ask(asked, role, "_text").select("_key", "vec", "failure")
        out = keyed.join(made, "_key", "left").drop("_key").withColumn("failure", F.when(F.col(text).isNull(), "no_text").otherwise(F.col("failure")))
        return out.withColumn("vec", vx.or_zeros(F.col("vec"), self.dim).cast("array<double>"))

    def ask(self, df: DataFrame, role: str, text: str = "text") -> DataFrame:
        url, dim, timeout, retries, batch_size, per_second, pause = self.url, self.dim, self.timeout, self.retries, self.batch, self.per_second, self.pause

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pace = Pace(per_second)

            def one(prompt: str) -> tuple[list[float] | None, str | None]:
                request = urllib.request.Request(url, json.dumps({"content": prompt}).encode(), {"Content-Type": "application/json"})
                why = "request"
                for n in range(retries + 1):
                    pace.wait()
                    rest = pause * 2**n
                    try:
                        with urllib.request.urlopen(request, timeout=timeout) as answer:
                            return read_response(answer.read().decode("utf-8", "replace"))
                    except urllib.error.HTTPError as error:
                        why = "status"
                        if error.code < 500 and error.code not in AGAIN:
                            break
                        said = error.headers.get("Retry-After") or ""
                        rest = float(said) if said.isdigit() else rest
                    except (urllib.error.URLError, http.client.HTTPException, OSError):
                        why = "request"
                    if n < retries:
                        pace.hold(rest)
                return None, why

            with ThreadPoolExecutor(batch_size) as pool:
                for batch in batches:
                    made = [*pool.map(one, batch["_prompt"])]
                    yield batch.drop(columns="_prompt").assign(vec=[v or [0.0] * dim for v, _ in made], failure=[why for _, why in made])

        return df.withColumn("_prompt", tx.prompt(F.col(text), role)).mapInPandas(run, _answered(df))


class CachedProvider(EmbeddingProvider):
    """Keeps another provider's vectors as Parquet, keyed by role, model and a hash of the text.

    Files lie in folders by role, model and bucket of the key's hash, so that a lookup lists and reads its own buckets
    only, and of their files first the keys without the vectors; Bloom filters let a lookup of up to FEW keys skip row
    groups. Failed vectors are kept as their kind of failure, and their texts are asked again in the next run. Files that
    can't be read are counted in ``unreadable``, moved to ``path``/_unreadable, and what they held is embedded again.
    ``answer`` asks and writes what is missing at once; ``seen`` holds the counts of that pass.
    """

    BUCKETS, FEW = 64, 10
    _SCHEMA = "key string, vec array<double>, failure string, made bigint, role string, model string, bucket int"

    def __init__(self, inner: EmbeddingProvider, path: str):
        if not path:
            raise InvalidConfig("an embedding cache needs a path")
        self.inner, self.path, self.model, self.dim = inner, path.rstrip("/"), inner.model, inner.dim
        self.unreadable, self.seen = 0, {}

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.BUCKETS)).cast("int")

    def answer(self, df: DataFrame, role: str, text: str = "text") -> DataFrame:
        spark = df.sparkSession
        keyed = df.withColumn("_key", F.sha2(F.col(text), 256))
        keys = keyed.where("_key is not null").select("_key", self._bucket("_key").alias("_bucket"))
        buckets = [r["_bucket"] for r in keys.select("_bucket").distinct().collect()]
        few = [r["_key"] for r in keys.select("_key").distinct().limit(self.FEW + 1).collect()]
        known = self.read(spark, role, buckets, few if len(few) <= self.FEW else None)
        asked = keyed.where("_key is not null").select("_key", F.col(text).alias("_text")).dropDuplicates(["_key"])
        if known is not None:
            asked = asked.join(known.where("failure is null").select(F.col("key").alias("_key")), "_key", "left_anti")
        seen = Observation()
        new = self.inner.ask(asked, role, "_text").observe(seen, *outcome())
        bad = F.coalesce(F.col("failure"), F.when(vx.is_zero(F.col("vec")), "values"))
        new = new.select(F.col("_key").alias("key"), F.when(bad.isNull(), F.col("vec")).alias("vec"), bad.alias("failure"), F.unix_timestamp().alias("made"), F.lit(role).alias("role"), F.md5(F.lit(self.model).cast("binary")).alias("model"), self._bucket("_key").alias("bucket"))
        self._write(new, self.path)
        self.seen = observed(seen)
        held = self.read(spark, role, buckets, few if len(few) <= self.FEW else None)
        if held is None:
            return keyed.drop("_key").withColumn("vec", vx.or_zeros(F.lit(None), self.dim).cast("array<double>")).withColumn("failure", F.lit("no_text"))
        held = held.join(keys.select(F.col("_key").alias("key")).distinct(), "key", "left_semi")
        vectors = held.groupBy(F.col("key").alias("_key")).agg(F.max_by(F.struct("vec", "failure"), F.struct(F.col("failure").isNull(), "made")).alias("_v"))
        out = keyed.join(vectors, "_key", "left").withColumns({"failure": F.when(F.col("_key").isNull(), "no_text").when(F.col("_v").isNull(), "missing").otherwise(F.col("_v.failure")), "vec": vx.or_zeros(F.col("_v.vec"), self.dim).cast("array<double>")})
        return out.drop("_key", "_v")

    def _write(self, rows: DataFrame, path: str) -> None:
        bloom = {"parquet.bloom.filter.enabled#key": "true", "parquet.bloom.filter.expected.ndv#key": "100000"}
        rows.repartition("bucket").write.mode("append").options(**bloom).partitionBy("role", "model", "bucket").parquet(path)

    def _files(self, spark: SparkSession, path: str):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at

    def _folder(self, role: str | None, bucket: int) -> str:
        return f"{self.path}/role={role}/model={hashlib.md5(self.model.encode()).hexdigest()}/bucket={bucket}"

    def _listed(self, spark: SparkSession, role: str, buckets: list[int]) -> list[str]:
        """Files of a role's buckets; the driver sees as many names as Spark's own listing would."""
        out = []
        for b in buckets:
            files, at = self._files(spark, self._folder(role, b))
            if files.exists(at):
                out += [s.getPath().toString() for s in files.listStatus(at) if s.getPath().getName().endswith(".parquet")]
        return sorted(out)

    def _load(self, spark: SparkSession, files: list[str]) -> DataFrame:
        return spark.read.schema(self._SCHEMA).option("basePath", self.path).option("ignoreCorruptFiles", "true").parquet(*files)

    def read(self, spark: SparkSession, role: str, buckets: list[int], keys: list[str] | None = None) -> DataFrame | None:
        """What the cache has in these buckets (of these few keys), or None where there is none; sets unreadable files aside."""
        files = self._listed(spark, role, buckets)
        if not files:
            return None
        plain = lambda p: p.split(":", 1)[-1].lstrip("/")  # noqa: E731 - file:/a and file:///a are one
        good = {plain(r["f"]) for r in self._load(spark, files).select(F.col("_metadata.file_path").alias("f")).distinct().collect()}  # from footers alone
        bad = [f for f in files if plain(f) not in good and plain(urllib.parse.quote(f, safe="/:=")) not in good]
        for f in bad:
            target = f"{self.path}/_unreadable/{uuid.uuid4().hex}"
            store, at = self._files(spark, target)
            store.mkdirs(at.getParent())
            store.rename(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f), at)
        if bad:
            self.unreadable += len(bad)
            log.warning("embedding cache: %d files can't be read; moved to %s/_unreadable", len(bad), self.path)
        left = [f for f in files if f not in set(bad)]
        if not left:
            return None
        out = self._load(spark, left)
        return out.where(F.col("key").isin(keys)) if keys else out

    def compact(self, spark: SparkSession, role: str, most: int = 8) -> int:
        """Folds each bucket of more than ``most`` files into one file with the last vector of each key; how many buckets.

        Old files go when the new one is written, so nothing else may read these buckets meanwhile.
        """
        full = [(b, f) for b in range(self.BUCKETS) if len(f := self._listed(spark, role, [b])) > most]
        if full:
            held = self.read(spark, role, [b for b, _ in full])
            if held is not None:
                last = held.where("failure is null").groupBy("role", "model", "bucket", "key").agg(F.max_by("vec", "made").alias("vec"), F.max("made").alias("made"))
                self._write(last.select("key", "vec", F.lit(None).cast("string").alias("failure"), "made", "role", "model", "bucket"), self.path)
            for _, names in full:
                for f in names:
                    store, at = self._files(spark, f)
                    store.delete(at, False)
        return len(full)

    def clear(self, spark: SparkSession) -> None:
        files, at = self._files(spark, self.path)
        files.delete(at, True)
