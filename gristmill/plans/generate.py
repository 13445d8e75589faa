"""Generation of questions and answers through pluggable backends, as partitions' work with bounded concurrency."""

from __future__ import annotations

import importlib
import json
import logging
import re
import time
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from http.client import HTTPException
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions.questions import clean_answer, parsed_or_whole, question_lines
from gristmill.functions.text import memo_key, sha256, strip, truncate_context
from gristmill.operators.ids import settle
from gristmill.settings import TRUNCATE_KEEP, TRUNCATE_MARK, TRUNCATE_OVER, Settings

log = logging.getLogger(__name__)

ASK = "You write training questions about source code and text. Write questions that the given content alone answers, of different kinds and difficulty, one on each line, and nothing else."
REPLY = "You see a passage and then a question that a reader of it asked. Answer in a few clear sentences, so that someone who has not seen the passage learns from the answer alone."


def ask_prompt(content: str) -> list[dict]:
    return [{"role": "system", "content": ASK}, {"role": "user", "content": f"Content:\n{content}\n\nQuestions:"}]


def answer_prompt(question: str, content: str) -> list[dict]:
    return [{"role": "system", "content": REPLY}, {"role": "user", "content": f"Content:\n{content}\n\nQuestion: {question}\n\nAnswer:"}]


def shortened(content: str) -> str:
    return content if len(content) <= TRUNCATE_OVER else content[:TRUNCATE_KEEP] + TRUNCATE_MARK + content[-TRUNCATE_KEEP:]


def fenced_prompt(content: str) -> list[dict]:
    """For models with small contexts."""
    return [{"role": "system", "content": ASK}, {"role": "user", "content": f"```\n{shortened(content)}\n```\nQuestions:"}]


def retry_prompt(content: str) -> list[dict]:
    return [{"role": "user", "content": f"Ask three questions about this, each on a line of its own that ends with a question mark:\n{shortened(content)}"}]


class Generator(Protocol):
    """What a backend offers: text. None means failure; exceptions are failures of the one file or question.

    ``loose`` text is parsed for questions anywhere in it, and answers are cleaned; else each line that ends with a question
    mark is one. A backend with ``batched`` = True takes lists of all but the last two arguments and returns a list.
    """

    loose: bool

    def ask(self, content: str, temperature: float, max_tokens: int) -> str | None: ...

    def answer(self, question: str, content: str, temperature: float, max_tokens: int) -> str | None: ...


@dataclass
class StubGenerator:
    """Always the same questions and answers for the same content; ``fail`` is a pattern of content that gets none."""

    per_file: int = 2
    fail: str = ""
    loose: bool = False

    def ask(self, content: str, temperature: float, max_tokens: int) -> str | None:
        if self.fail and re.search(self.fail, content):
            return None
        words = list(dict.fromkeys(re.findall(r"\w+", content)))[: self.per_file]
        return "\n".join(f"What does {w} mean here?" for w in words) or None

    def answer(self, question: str, content: str, temperature: float, max_tokens: int) -> str | None:
        return f"It is one of {len(content.split())} words."


def last_lines_text(lines: Iterator[str]) -> str | None:
    """The text of a stream of ``data:`` lines; lines that aren't JSON are left out."""
    text = []
    for line in lines:
        data = line[6:].strip() if line.startswith("data: ") else ""
        if data and data != "[DONE]":
            try:
                text.append(json.loads(data)["choices"][0]["delta"].get("content") or "")
            except (ValueError, KeyError, IndexError, TypeError, AttributeError):
                continue
    return "".join(text).strip() or None


#: Model lists by server, with the time of asking.
_MODELS: dict[tuple, tuple[float, list[str]]] = {}


@dataclass
class HttpGenerator:
    """An OpenAI-style chat server, read as a stream; retried with a fixed delay, with a fresh buffer each time."""

    settings: Settings
    loose: bool = False  # free text instead of one question a line
    opener: Callable = urllib.request.urlopen

    def models(self) -> list[str]:
        """The server's models; asked for once in ``model_list_ttl`` seconds by all tasks of a process."""
        key = (self.settings.base_url, self.opener)
        if key in _MODELS and time.time() - _MODELS[key][0] < self.settings.model_list_ttl:
            return _MODELS[key][1]
        try:
            with self.opener(f"{self.settings.base_url}/v1/models", timeout=30) as r:
                ids = [m["id"] for m in json.loads(r.read()).get("data", [])]
        except (OSError, ValueError, KeyError, TypeError) as e:
            log.error("model list: %s", e)
            return []
        _MODELS[key] = (time.time(), ids)
        return ids

    def model(self) -> str:
        """The wanted model if the server has it, else its first."""
        have = self.models()
        if self.settings.model in have:
            return self.settings.model
        if not have:
            raise ValueError("the server lists no models")
        return have[0]

    def call(self, chat: list[dict], temperature: float, max_tokens: int) -> str | None:
        body = json.dumps({"model": self.model(), "messages": chat, "temperature": temperature, "max_tokens": max_tokens, "stream": True}).encode()
        for attempt in range(self.settings.retries):
            if attempt:
                time.sleep(self.settings.retry_delay)
            try:
                request = urllib.request.Request(f"{self.settings.base_url}/v1/chat/completions", body, {"Content-Type": "application/json"})
                with self.opener(request, timeout=self.settings.request_timeout) as r:
                    return last_lines_text(x.decode("utf-8", "replace").rstrip("\r\n") for x in r)
            except (OSError, HTTPException) as e:  # no connection, or a stream that broke off
                log.warning("attempt %d: %s", attempt + 1, e)
        return None

    def ask(self, content: str, temperature: float, max_tokens: int) -> str | None:
        if self.loose:
            return self.call(fenced_prompt(content), temperature, max_tokens) or self.call(retry_prompt(content), temperature, max_tokens)
        return self.call(ask_prompt(content), temperature, max_tokens)

    def answer(self, question: str, content: str, temperature: float, max_tokens: int) -> str | None:
        return self.call(answer_prompt(question, shortened(content) if self.loose else content), temperature, max_tokens)


def as_text(chat: list[dict]) -> str:
    """A chat for a model without a chat template."""
    return "\n\n".join(f"{m['role'].capitalize()}: {m['content']}" for m in chat)


@dataclass
class LocalGenerator:
    """A model in the Python workers: ``load()`` is called once in each and gives ``generate(prompts, max_tokens)``.

    ``generate`` gets at most ``batch`` prompts and returns a text for each. ``load`` may name a function as
    ``package.module:function``; it must be importable, or be sent along, on executors. Prompts are
    shortened, and the temperature isn't passed on.
    """

    load: str | Callable[[], Callable[[list[str], int], list[str]]]
    batch: int = 8
    loose: bool = True
    batched: bool = True

    def model(self) -> Callable[[list[str], int], list[str]]:
        load = self.load
        if isinstance(load, str):
            module, _, name = load.partition(":")
            load = getattr(importlib.import_module(module), name)
        return load()

    def prompt(self, args: list[str]) -> Column:
        """The prompt for these columns: content, or question and content."""
        hole = "\x00{}\x00".format
        whole = as_text(fenced_prompt(hole("content")) if args == ["content"] else answer_prompt(hole("question"), hole("content")))
        of = {hole("content"): truncate_context(F.col("content")), hole("question"): F.col("question")}
        return F.concat(*[of.get(x, F.lit(x)) for x in re.split("(\x00.*?\x00)", whole)])


#: Backends by name; a factory takes the settings.
BACKENDS: dict[str, Callable[[Settings], Generator]] = {
    "stub": lambda s: StubGenerator(), "http": lambda s: HttpGenerator(s), "http-loose": lambda s: HttpGenerator(s, loose=True), "local": lambda s: LocalGenerator(s.local_model, s.local_batch),
}


def generator(settings: Settings) -> Generator:
    if settings.backend not in BACKENDS:
        raise ValueError(f"unknown backend {settings.backend!r}; known: {', '.join(BACKENDS)}")
    return BACKENDS[settings.backend](settings)


def _guarded(f: Callable, *args) -> tuple:
    try:
        return f(*args), None
    except Exception as e:  # the row's failure, not the task's
        return None, str(e)


def _by_threads(prompts: DataFrame, call: Callable, args: list[str], s: Settings) -> DataFrame:
    """A call for each prompt, ``files_in_flight`` at a time in a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(max(1, s.files_in_flight)) as pool:
            for b in batches:
                got = list(pool.map(lambda *x: _guarded(call, *x, s.temperature, s.max_tokens), *(b[a] for a in args)))
                yield pd.DataFrame({"_memo": b["_memo"], "result": pd.Series([x for x, _ in got], dtype=object, index=b.index), "error": pd.Series([e for _, e in got], dtype=object, index=b.index)})

    return prompts.mapInPandas(run, "_memo string, result string, error string")


def _by_batches(prompts: DataFrame, g: LocalGenerator, args: list[str], s: Settings) -> DataFrame:
    """Batches of at most ``g.batch`` prompts for a model that each worker loads once."""

    def make() -> Callable:
        generate = g.model()

        def predict(asked: np.ndarray) -> dict[str, np.ndarray]:
            n = len(asked)
            got, error = _guarded(lambda: list(generate(asked.tolist(), s.max_tokens)))
            if error is None and len(got) != n:
                got, error = None, f"the model gave {len(got)} texts for {n} prompts"
            # no text is an empty one, and so is no error: a prediction is never null
            return {"result": np.array([x or "" for x in got or [""] * n], dtype=object), "error": np.array([error or ""] * n, dtype=object)}

        return predict

    model = predict_batch_udf(make, return_type=T.StructType().add("result", T.StringType()).add("error", T.StringType()), batch_size=g.batch)
    return prompts.select("_memo", model(g.prompt(args)).alias("x")).select("_memo", F.nullif(F.col("x.result"), F.lit("")).alias("result"), F.nullif(F.col("x.error"), F.lit("")).alias("error"))


def _called(prompts: DataFrame, g: Generator, call: Callable | None, args: list[str], s: Settings) -> DataFrame:
    """(_memo, result, error) of ``prompts(_memo, ...)``, each asked once, dealt to ``model_tasks`` tasks, settled.

    Without the explicit count, as many tasks would call as adaptive execution leaves, often one.
    """
    tasks = s.model_tasks or prompts.sparkSession.sparkContext.defaultParallelism
    prompts = prompts.select("_memo", *args).dropDuplicates(["_memo"]).repartition(tasks)
    return settle(_by_batches(prompts, g, args, s) if getattr(g, "batched", False) else _by_threads(prompts, call, args, s))


def _memo(s: Settings, *args: str) -> Column:
    """Names a generation by all that it depends on."""
    return memo_key(F.concat_ws("_", F.lit(s.backend), F.lit(s.model or s.local_model), *[sha256(F.col(a)) for a in args]), F.lit(s.temperature), F.lit(s.max_tokens))


def _remembered(prompts: DataFrame, memo: DataFrame | None, column: str) -> tuple[DataFrame, DataFrame | None]:
    """(prompts without a remembered result, (_memo, ``column``) of the others).

    The memo is looked up by key: few prompts are broadcast to its scan; with many, both sides are shuffled, where Spark puts
    a Bloom filter of the prompts' keys in front of the memo's exchange if that is large.
    """
    if memo is None:
        return prompts, None
    wanted = settle(prompts.select("_memo").distinct())
    few = wanted.count() <= FEW
    known = settle(memo.where(F.col(column).isNotNull()).select(F.col("memo_key").alias("_memo"), column).join(F.broadcast(wanted) if few else wanted, "_memo", "left_semi"))
    return prompts.join(known.select("_memo"), "_memo", "left_anti"), known


#: Prompts (a key of 32 characters each) up to which their keys are broadcast.
FEW = 200_000


def ask(files: DataFrame, g: Generator, s: Settings, memo: DataFrame | None = None) -> DataFrame:
    """_memo, file_path, content, questions, error and fresh: a model call for each different content that ``memo`` doesn't have.

    Calls are settled before they are joined, as they can't be repeated; ``fresh`` marks questions that a call gave.
    """
    files = files.select("file_path", "content").withColumn("_memo", _memo(s, "content"))
    left, known = _remembered(files, memo, "questions")
    got = _called(left, g, None if getattr(g, "batched", False) else g.ask, ["content"], s)
    parsed = parsed_or_whole if g.loose else question_lines
    got = got.select("_memo", parsed(F.col("result")).alias("questions"), "error", F.lit(True).alias("fresh"))
    if known is not None:
        got = got.unionByName(known.select("_memo", "questions", F.lit(None).cast("string").alias("error"), F.lit(False).alias("fresh")))
    return files.join(got, "_memo").select("_memo", "file_path", "content", "questions", "error", "fresh")


def answer(asked: DataFrame, g: Generator, s: Settings, memo: DataFrame | None = None) -> DataFrame:
    """_memo, file_path, place, question, answer, error and fresh for ``asked(file_path, place, question, content)``; a call for
    each different question and content that ``memo`` doesn't have."""
    asked = asked.select("file_path", "place", "question", "content").withColumn("_memo", _memo(s, "question", "content"))
    left, known = _remembered(asked, memo, "answer")
    got = _called(left, g, None if getattr(g, "batched", False) else g.answer, ["question", "content"], s).select("_memo", "result", "error", F.lit(True).alias("fresh"))
    if known is not None:
        got = got.unionByName(known.select("_memo", F.col("answer").alias("result"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("fresh")))
    said = clean_answer(F.col("result"), F.col("question")) if g.loose else F.nullif(strip(F.col("result")), F.lit(""))
    return asked.join(got, "_memo").select("_memo", "file_path", "place", "question", said.alias("answer"), "error", "fresh")


def answers_batch(g: Generator, pairs: list[tuple[str, str]], s: Settings) -> list[str | None]:
    """Answers to (question, content) pairs, each in its pair's place; None where one failed."""
    with ThreadPoolExecutor(max(1, s.files_in_flight)) as pool:
        return [x for x, _ in pool.map(lambda p: _guarded(g.answer, *p, s.temperature, s.max_tokens), pairs)]
