"""Sampling of conversation configurations, and pluggable completers, scorers and classifiers."""

from __future__ import annotations

import hashlib
import json
import os
import random
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

import pandas as pd
from pyspark import AccumulatorParam, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Lengths of conversations and their weights.
LENGTHS = ((4, 0.4), (8, 0.3), (12, 0.2), (16, 0.1))


def sample_configs(spark: SparkSession, n: int, vocabulary: dict[str, list[str]], names: list[str], seed: int = 42) -> DataFrame:
    """n configurations, by ``configs_of``."""
    return configs_of(spark.range(n), vocabulary, names, seed)


def configs_of(rows: DataFrame, vocabulary: dict[str, list[str]], names: list[str], seed: int = 42) -> DataFrame:
    """A configuration for each row (id), the same for the same id: a uniform choice from each list, a weighted length, one or two agents named with replacement."""
    pick = lambda values, salt: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "id"), F.lit(len(values))) + 1).cast("int"))
    u = F.pmod(F.xxhash64(F.lit(seed), F.lit("length"), "id"), F.lit(1 << 30)) / float(1 << 30)
    length, total = F.lit(LENGTHS[-1][0]), 0.0
    steps = []
    for size, weight in LENGTHS[:-1]:
        total += weight
        steps.append((total, size))
    for bound, size in reversed(steps):
        length = F.when(u < bound, size).otherwise(length)
    agents = F.pmod(F.xxhash64(F.lit(seed), F.lit("agents"), "id"), F.lit(2)) + 1
    named = F.transform(F.sequence(F.lit(1), agents.cast("int")), lambda k: F.element_at(F.array(*map(F.lit, names)), (F.pmod(F.xxhash64(F.lit(seed), F.lit("name"), "id", k), F.lit(len(names))) + 1).cast("int")))
    return rows.select("id", *(pick(v, k).alias(k) for k, v in vocabulary.items()), length.alias("n_messages"), agents.cast("int").alias("n_agents"), named.alias("agent_names"))


def with_retry(call: Callable, tries: int = 5, base: float = 1.0, again: tuple[str, ...] = ("rate_limit", "429"), sleep: Callable = time.sleep) -> Callable:
    """The call, tried anew after base * 2**k + U(0, 1) seconds when the error names a limit."""

    def run(*args):
        for k in range(tries):
            try:
                return call(*args)
            except Exception as error:
                if k == tries - 1 or not any(a in str(error).lower() for a in again):
                    raise
                sleep(base * 2**k + random.random())

    return run


@dataclass(frozen=True)
class ClientConfig:
    """Where a model is called: plain values that may stand in a plan; the key is read from the environment of the executor."""

    model: str
    provider: str = ""
    base_url: str = ""
    key_variable: str = ""
    temperature: float = 0.8

    @property
    def name(self) -> str:
        """The model with its provider before it, once."""
        return f"{self.provider}/{self.model}" if self.provider and not self.model.startswith(f"{self.provider}/") else self.model

    def key(self) -> str:
        return os.environ.get(self.key_variable, "") if self.key_variable else ""


def client(config: ClientConfig, send: Callable[[str, str, ClientConfig], str]) -> Callable[[], Callable[[dict], dict]]:
    """For ``apply_model``: a client made once a partition that sends a row's ``prompt`` and reads a JSON object from the answer."""

    def make() -> Callable[[dict], dict]:
        key = config.key()
        return lambda row: json.loads(send(row["prompt"], key, config))

    return make


def generated(spark: SparkSession, n: int, configure: Callable[[SparkSession, int], DataFrame], prompt: Callable[[DataFrame], Column], make: Callable, schema: str, **options) -> DataFrame:
    """n conversations: configurations of any kind, their prompts, and a model's answers, failures as rows."""
    rows = configure(spark, n)
    return apply_model(rows.withColumn("prompt", prompt(rows)), make, schema, again=("rate_limit", "429", "connection"), **options)


def embedded(rows: DataFrame, text: str, make: Callable[[], Callable[[list[str]], list[list[float]]]]) -> DataFrame:
    """``rows`` with ``embedding``, by a model that is loaded once a partition and takes a batch of texts."""
    names = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for batch in batches:
            model = model or make()
            yield batch.assign(embedding=model(batch[text].fillna("").tolist()))[[*names, "embedding"]]

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType()))]))


def within(bounds: dict[str, int]) -> Callable[[dict], dict]:
    """A check of scores: whole numbers from 0 to the bound of each name."""

    def check(got: dict) -> dict:
        for name, most in bounds.items():
            value = got.get(name)
            if not isinstance(value, int) or isinstance(value, bool) or not 0 <= value <= most:
                raise ValueError(f"{name} must be 0 to {most}, not {value}")
        return got

    return check


class CallLog:
    """Answers of paid calls in a folder that all executors reach, each an object named by a hash of its row and its model.

    An answer is written as it arrives, aside first and then renamed, so a task that is tried again, or a job that is
    started again, finds it there and doesn't call. Failures aren't kept. Equal rows share an answer.
    """

    def __init__(self, path: str, model: str = "") -> None:
        self.path, self.model = path.rstrip("/"), model

    def _place(self, row: dict) -> tuple[object, str, str]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path)
        name = hashlib.sha256(json.dumps([self.model, row], sort_keys=True, default=str).encode()).hexdigest()
        return store, f"{root}/{name[:2]}", name

    def get(self, row: dict) -> dict | None:
        store, folder, name = self._place(row)
        if not store.get_file_info(f"{folder}/{name}.json").is_file:
            return None
        with store.open_input_stream(f"{folder}/{name}.json") as file:
            return json.loads(file.read())

    def put(self, row: dict, answer: dict) -> None:
        store, folder, name = self._place(row)
        store.create_dir(folder)
        aside = f"{folder}/.{name}-{uuid.uuid4().hex}"
        with store.open_output_stream(aside) as file:
            file.write(json.dumps(answer).encode())
        store.move(aside, f"{folder}/{name}.json")


class Pace:
    """At most ``rate`` calls a second together by up to ``tasks`` tasks: each keeps to an equal share of the budget."""

    def __init__(self, rate: float, tasks: int, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.gap, self.clock, self.sleep = tasks / rate, clock, sleep
        self.next, self.lock = 0.0, threading.Lock()

    def __call__(self) -> None:
        with self.lock:
            now = self.clock()
            at = max(now, self.next)
            self.next = at + self.gap
        if at > now:
            self.sleep(at - now)


class _Most(AccumulatorParam):
    """Rows done by partition: of two reports of a partition the greater counts, so a task tried again counts once."""

    def zero(self, value: dict) -> dict:
        return {}

    def addInPlace(self, first: dict, second: dict) -> dict:  # noqa: N802  Spark's name
        for key, done in second.items():
            first[key] = max(first.get(key, 0), done)
        return first


class Progress:
    """Rows done, counted on the driver. ``watch`` calls back there while a job runs, with numbers that only grow."""

    def __init__(self, spark: SparkSession) -> None:
        self.done = spark.sparkContext.accumulator({}, _Most())

    def total(self) -> int:
        return sum(self.done.value.values())

    @contextmanager
    def watch(self, callback: Callable[[int], None], every: float = 0.5) -> Iterator[None]:
        stop, seen = threading.Event(), [-1]

        def look() -> None:
            now = self.total()
            if now > seen[0]:
                seen[0] = now
                callback(now)

        def run() -> None:
            while not stop.wait(every):
                look()

        thread = threading.Thread(target=run, daemon=True)
        thread.start()
        try:
            yield
        finally:
            stop.set()
            thread.join()
            look()


def apply_model(rows: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str, workers: int = 5, errors: bool = True, check: Callable[[dict], dict] | None = None, again: tuple[str, ...] = ("rate_limit", "429"), progress: Progress | None = None, log: CallLog | None = None, rate: float | None = None) -> DataFrame:
    """Rows through a client made once a partition, ``workers`` calls at a time in the order of the rows.

    ``check`` may refuse an answer. With ``errors`` a failure is a row with its message in ``error``. ``progress`` counts
    the rows done, ``log`` keeps answers over retries and restarts, ``rate`` is the most calls a second of all tasks together. Partitions
    stay as they are.
    """
    context = rows.sparkSession.sparkContext
    # no more tasks run at once than there are slots
    tasks = max(1, min(context.defaultParallelism, rows.rdd.getNumPartitions())) if rate else 1
    done_by = progress.done if progress else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call, done, pace = make(), 0, Pace(rate, tasks) if rate else None

        def paced(row: dict) -> dict:
            if pace:
                pace()
            return call(row)

        tried = with_retry(paced, again=again)

        def one(row: dict) -> dict:
            start = time.time()
            try:
                got = log.get(row) if log else None
                if got is None:
                    got = tried(row)
                    got = check(got) if check else got
                    if log:
                        log.put(row, got)
                got = {**got, "error": None}
            except Exception as error:
                if not errors:
                    raise
                got = {"error": str(error)}
            return {**row, **got, "processing_time": time.time() - start}

        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                out = list(pool.map(one, batch.to_dict("records")))
                done += len(out)
                if done_by:
                    done_by.add({TaskContext.get().partitionId(): done})
                yield pd.DataFrame(out)

    names = [part.split()[0] for part in schema.split(", ")]
    return rows.mapInPandas(lambda batches: (b.reindex(columns=names) for b in run(batches)), schema)
