"""Batch scorers: the place where a language model plugs in.

A scorer is loaded once for each Python worker and gives two log-probabilities for each prompt;
everything after that is columns.  ``StubScorer`` stands in where no model is at hand; ``HttpScorer``
posts to a chat-completions address and is never used unless configured.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import time
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Scorer(Protocol):
    def load(self) -> None: ...

    def score(self, prompts: list[str]) -> list[tuple[float, float]]:
        """(log p of reject, log p of approve) of each prompt."""
        ...


class StubScorer:
    """Deterministic log-probabilities from the md5 of the prompt."""

    def load(self) -> None:
        pass

    def score(self, prompts: list[str]) -> list[tuple[float, float]]:
        out = []
        for p in prompts:
            u = (int(hashlib.md5(p.encode("utf-8", "replace")).hexdigest()[:12], 16) + 0.5) / 2**48
            out.append((math.log(u), math.log(1 - u)))
        return out


class Generator(Protocol):
    def load(self) -> None: ...

    def generate(self, prompts: list[str]) -> list[str]:
        """One response for each prompt; greedy where the temperature is 0."""
        ...


class StubGenerator:
    """Deterministic answers from the md5 of the prompt: a reason, or an action, as JSON or as text.

    The first hexadecimal digit decides: below 8 reject, else approve.  In mixed form the second
    says how the answer is worded: 0 to 9 JSON, a and b a JSON without a known action, c and d plain
    text, e and f nothing of use.
    """

    def __init__(self, form: str = "json"):
        self.form = form

    def load(self) -> None:
        pass

    def generate(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            h = hashlib.md5(p.encode("utf-8", "replace")).hexdigest()
            action = "reject" if h[0] < "8" else "approve"
            if self.form == "reason" or self.form == "mixed" and h[1] <= "9":
                out.append(json.dumps({"reason": f"Sign {h[2:6]}.", "action": action}))
            elif self.form == "mixed":
                out.append({"a": '{"action": "hold"} then ' + action, "b": '{"action": "hold"}', "c": action.upper() + " it", "d": f"I would {action}.", "e": "", "f": "unsure"}[h[1]])
            else:
                out.append(json.dumps({"action": action}))
        return out


class StubClassifier:
    """Two logits for each text from its md5, where a fine-tuned classifier would stand."""

    def load(self) -> None:
        pass

    def logits(self, texts: list[str]) -> list[tuple[float, float]]:
        return [(0.0, (int(hashlib.md5(t.encode("utf-8", "replace")).hexdigest()[:4], 16) - 32768) / 8192) for t in texts]


@dataclass
class HttpScorer:
    """Asks a chat-completions service; the answer's word becomes a sure decision.

    One connection for each worker is kept open; calls are spaced to ``per_second`` and repeated with
    growing pauses where the service is busy, fails or cannot be reached.  Never used unless an
    address is configured.
    """

    base_url: str = field(default_factory=lambda: os.environ.get("SCORER_BASE_URL", ""))
    model: str = field(default_factory=lambda: os.environ.get("SCORER_MODEL", ""))
    key_variable: str = "SCORER_API_KEY"
    timeout: float = 60.0
    temperature: float = 0.0
    per_second: float = 5.0
    tries: int = 4
    pause: float = 1.0

    def load(self) -> None:
        if not self.base_url:
            raise ValueError("no address of a scoring service")
        self._connection, self._last = None, 0.0

    def _post(self, body: bytes) -> dict:
        from http.client import HTTPConnection, HTTPException, HTTPSConnection
        from urllib.parse import urlsplit

        at = urlsplit(f"{self.base_url.rstrip('/')}/chat/completions")
        head = {"Content-Type": "application/json", "Authorization": f"Bearer {os.environ.get(self.key_variable, '')}"}
        for attempt in range(self.tries):
            time.sleep(max(0.0, self._last + 1 / self.per_second - time.monotonic()))
            self._last = time.monotonic()
            try:
                if self._connection is None:
                    self._connection = (HTTPSConnection if at.scheme == "https" else HTTPConnection)(at.netloc, timeout=self.timeout)
                self._connection.request("POST", at.path, body, head)
                reply = self._connection.getresponse()
                content = reply.read()
                if reply.status == 200:
                    return json.loads(content)
                problem = f"status {reply.status}"
                if reply.status not in (408, 429) and reply.status < 500:
                    break
            except (OSError, HTTPException) as e:
                self._connection, problem = None, str(e)
            if attempt + 1 < self.tries:
                time.sleep(self.pause * 2**attempt)
        raise ConnectionError(f"the scoring service did not answer: {problem}")

    def generate(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            body = json.dumps({"model": self.model, "temperature": self.temperature, "messages": [{"role": "user", "content": p}]}).encode()
            out.append(self._post(body)["choices"][0]["message"]["content"])
        return out

    def score(self, prompts: list[str]) -> list[tuple[float, float]]:
        out = []
        for answer in self.generate(prompts):
            text = answer.lower()
            reject = 0 <= text.find("reject") < (text.find("approve") if "approve" in text else len(text))
            out.append((-1e-6, -14.0) if reject else (-14.0, -1e-6))
        return out


def apply(df: DataFrame, scorer: Scorer, prompt: str, key: str, batch: int = 64) -> DataFrame:
    """(key, logprob_reject, logprob_approve); a null prompt is an empty one."""
    kind = df.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer.load()
        for part in parts:
            prompts = part["p"].fillna("").tolist()
            found = [x for a in range(0, len(prompts), batch) for x in scorer.score(prompts[a : a + batch])]
            yield pd.DataFrame({"k": part["k"], "logprob_reject": [x[0] for x in found], "logprob_approve": [x[1] for x in found]})

    return df.select(F.col(key).alias("k"), F.col(prompt).alias("p")).mapInPandas(run, f"k {kind}, logprob_reject double, logprob_approve double").withColumnRenamed("k", key)


def generate(df: DataFrame, generator: Generator, prompt: str, key: str, out: str = "response", batch: int = 64) -> DataFrame:
    """(key, out): one response for each row, asked in batches; a null prompt is an empty one."""
    kind = df.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generator.load()
        for part in parts:
            prompts = part["p"].fillna("").tolist()
            yield pd.DataFrame({"k": part["k"], "r": [x for a in range(0, len(prompts), batch) for x in generator.generate(prompts[a : a + batch])]})

    return df.select(F.col(key).alias("k"), F.col(prompt).alias("p")).mapInPandas(run, f"k {kind}, r string").withColumnsRenamed({"k": key, "r": out})


def classify(df: DataFrame, classifier, text: str, key: str, batch: int = 64) -> DataFrame:
    """(key, prob): softmax share of the positive class from a classifier's two logits."""
    kind = df.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classifier.load()
        for part in parts:
            texts = part["t"].fillna("").tolist()
            found = [x for a in range(0, len(texts), batch) for x in classifier.logits(texts[a : a + batch])]
            yield pd.DataFrame({"k": part["k"], "prob": [1 / (1 + math.exp(min(max(a - b, -700.0), 700.0))) for a, b in found]})

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, prob double").withColumnRenamed("k", key)


def effective_max_length(requested: int, tokenizer_max: float | None) -> int:
    """The requested length, or the tokenizer's own limit where it has a smaller one (beyond 1e6 it has none)."""
    return min(requested, int(tokenizer_max)) if tokenizer_max and 0 < tokenizer_max <= 1e6 else requested


def model_settings(model: str | None = None, tag: str | None = None, template: str | None = None, default: str = "local-chat-model") -> dict[str, str]:
    """Name, file tag and chat template of a model; what is not given follows from its name."""
    from scoreloom.functions.parsing import slug

    name = (model or "").strip() or default
    return {"model_name_or_path": name, "model_tag": slug(tag or name.rstrip("/").rsplit("/", 1)[-1]), "template": (template or "").strip() or "default"}


def decide(df: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Adds logprob_delta, prob (its logistic), pred_action and pred_label; a tie at the threshold rejects."""
    d = F.col("logprob_reject") - F.col("logprob_approve")
    return df.withColumns({"logprob_delta": d, "prob": 1 / (1 + F.exp(-d)), "pred_action": F.when(d >= threshold, "reject").otherwise("approve"), "pred_label": F.when(d >= threshold, 1).otherwise(0)})


def chat(system: Column, user: Column, answer: Column) -> Column:
    """A chat sample: struct<system, conversations: array<struct<from, value>>>."""
    turn = lambda who, text: F.struct(F.lit(who).alias("from"), text.alias("value"))
    return F.struct(system.alias("system"), F.array(turn("human", user), turn("gpt", answer)).alias("conversations"))
