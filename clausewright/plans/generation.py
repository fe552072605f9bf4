"""Calls of an injected generator on the executors: in lanes, at a bounded rate, several at a time, and stored as they come."""

from __future__ import annotations

import math
import queue
import threading
import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import shared_folder, staged

#: What to do about a status of the generator's server.
HINTS = {400: "check the model's name and the messages", 401: "check the key and its region", 403: "check that the service is enabled for the key", 429: "wait, or check the balance", 500: "try again later", 503: "try again later"}

Chat = Callable[[str, str], "str | tuple[str, int]"]
Answer = tuple["str | None", "int | None", "str | None"]


class ChatError(RuntimeError):
    """A failed call of a generator; `status` as of HTTP, where there is one."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(f"HTTP {status}: {HINTS.get(status, 'unknown status')}: {message}" if status else message)


class TokenBucket:
    """Lets `rate` calls a second pass, after a first `burst`; all without a rate."""

    def __init__(self, rate: float | None, burst: int = 1):
        self.rate, self.burst, self.level, self.at = rate, burst, float(burst), time.monotonic()

    def take(self) -> None:
        if self.rate is None:
            return
        now = time.monotonic()
        self.level, self.at = min(self.burst, self.level + (now - self.at) * self.rate), now
        if self.level < 1:
            time.sleep((1 - self.level) / self.rate)
            self.level, self.at = 1.0, time.monotonic()
        self.level -= 1


def answers_of(prompts: Iterable[tuple[str, str]], chat: Chat, in_flight: int, timeout: float, bucket: TokenBucket) -> Iterator[tuple[int, Answer]]:
    """(place, (answer, tokens, error)) of each prompt, as answers come, with `in_flight` calls at a time. A call that is late is given up; its thread does not hold the process."""
    done: queue.SimpleQueue = queue.SimpleQueue()

    def call(place: int, system: str, user: str) -> None:
        try:
            got = chat(system, user)
            done.put((place, (*got, None) if isinstance(got, tuple) else (got, None, None)))
        except ChatError as e:
            done.put((place, (None, None, str(e))))
        except BaseException as e:  # raised where the answers are read
            done.put((place, e))

    left, running = enumerate(prompts), {}
    while True:
        while len(running) < in_flight and (following := next(left, None)) is not None:
            place, (system, user) = following
            bucket.take()
            running[place] = time.monotonic() + timeout
            threading.Thread(target=call, args=(place, system, user), daemon=True).start()
        if not running:
            return
        try:
            place, found = done.get(timeout=max(0.0, min(running.values()) - time.monotonic()))
        except queue.Empty:
            for place in [p for p, end in running.items() if end <= time.monotonic()]:
                del running[place]
                yield place, (None, None, f"no answer within {timeout:g} seconds")
            continue
        if place in running:
            del running[place]
            if isinstance(found, BaseException):
                raise found
            yield place, found


def generate(prompts: DataFrame, chat: Chat, timeout: float = 90, in_flight: int = 4, lanes: int | None = None, rate: float | None = None) -> DataFrame:
    """`prompts` (qid, system, user, others) with answer, tokens and error in place of system and user, by an injected generator that is called once for each row on the executors.

    Each task has `in_flight` calls under way. `lanes` deals the rows over so many tasks; `rate` is how many calls a second all
    lanes begin together (it needs `lanes`, of which each has its share). `chat` returns a text, or a text and the tokens it
    used. Where it raises ChatError, or takes longer than `timeout` seconds, the answer is null and `error` says why; any other
    exception ends the job.
    """
    if rate is not None and not lanes:
        raise ValueError("a rate needs a number of lanes")
    share = rate / lanes if rate is not None and lanes else None

    also = [c for c in prompts.columns if c not in ("system", "user")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket = TokenBucket(share)
        for frame in frames:
            made: list[Answer] = [(None, None, None)] * len(frame)
            for place, answer in answers_of(zip(frame["system"], frame["user"], strict=True), chat, in_flight, timeout, bucket):
                made[place] = answer
            yield pd.DataFrame({**{c: frame[c] for c in also}, "answer": [m[0] for m in made], "tokens": pd.array([m[1] for m in made], "Int64"), "error": [m[2] for m in made]})

    dealt = prompts.repartition(lanes) if lanes else prompts
    kinds = ", ".join(f"`{c}` {t}" for c, t in prompts.dtypes if c in also)
    return dealt.mapInPandas(run, f"{kinds}, answer string, tokens long, error string")


def _stored(prompts: DataFrame, path: str) -> DataFrame:
    kind = dict(prompts.dtypes)["qid"]
    schema = f"qid {kind}, prompt string, answer string, tokens long, error string"
    try:
        return prompts.sparkSession.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return prompts.sparkSession.createDataFrame([], schema)


def generate_stored(prompts: DataFrame, chat: Chat, path: str, batch: int = 1000, at: Callable[[int], None] = lambda done: None, **how) -> DataFrame:
    """What generate() returns, kept in a table at `path`: answers are appended a batch of about `batch` questions at a time, and only questions without an answer there are asked.

    So a run that ends early is resumed by calling it again, and asks no question again whose batch was appended; a question
    whose prompt has changed, or whose call failed, is asked. `at` is called behind each batch. A task that is lost with its
    executor asks its questions anew. (qid, prompt) is a key; rows that repeat it are asked once.
    """
    key = F.sha2(F.concat_ws("\n", F.coalesce("system", F.lit("")), F.coalesce("user", F.lit(""))), 256)
    asked = prompts.select("qid", "system", "user", key.alias("prompt")).dropDuplicates(["qid", "prompt"])
    same = lambda a, b: a["qid"].eqNullSafe(b["qid"]) & (a["prompt"] == b["prompt"])
    answered = _stored(prompts, path).filter("answer is not null")
    left = asked.join(answered, same(asked, answered), "left_anti")
    left = staged(left, f"{shared_folder(prompts.sparkSession)}/left")
    batches = max(1, math.ceil(left.count() / batch))
    for b in range(batches):
        part = left.filter(F.pmod(F.xxhash64("qid", "prompt"), F.lit(batches)) == b)
        generate(part, chat, **how).write.mode("append").parquet(path)
        at(b + 1)
    every = _stored(prompts, path)
    told = F.max_by(F.struct("answer", "tokens", "error"), F.when(F.col("answer").isNotNull(), 1).otherwise(0)).alias("a")
    kept = every.join(asked.select(F.col("qid").alias("_qid"), F.col("prompt").alias("_prompt")), F.col("qid").eqNullSafe(F.col("_qid")) & (F.col("prompt") == F.col("_prompt")), "left_semi")
    return kept.groupBy("qid", "prompt").agg(told).select("qid", "a.answer", "a.tokens", "a.error")
