"""Asking a classifier, once for each distinct question; answers of a service are kept by functions/ledger.py."""

from __future__ import annotations

import hashlib
import json
import sys
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CHECK_PROMPT, NO_ANSWER, SERVICE_MODEL, TITLE_PROMPT

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package


class Classifier(Protocol):
    """What a classifier must offer. It is sent to the executors, so it must be picklable. One that can also say its answers
    as columns, title_column and check_column, isn't called row by row."""

    def title(self, title: str) -> str: ...

    def check(self, description: str, code: str) -> str: ...


class RuleClassifier:
    """An offline classifier: the first rule whose word is in the title gives the code, and a check is
    passed if the description holds a word of the code's rules."""

    def __init__(self, rules: list[tuple[str, str]]) -> None:
        self.rules = rules

    def title(self, title: str) -> str:
        return next((code for word, code in self.rules if word in title), NO_ANSWER)

    def check(self, description: str, code: str) -> str:
        broad = code[:-1]
        return "Yes." if any(c.startswith(broad) and w in description for w, c in self.rules) else "No."

    def title_column(self, title: Column) -> Column:
        out = F.lit(NO_ANSWER)
        for word, code in reversed(self.rules):
            out = F.when(F.contains(title, F.lit(word)), F.lit(code)).otherwise(out)
        return out

    def check_column(self, description: Column, code: Column) -> Column:
        text, own = (F.coalesce(c, F.lit("")) for c in (description, code))
        broad = F.left(own, F.greatest(F.length(own) - 1, F.lit(0)))
        passed = F.lit(False)
        for word, other in self.rules:
            passed = passed | (F.startswith(F.lit(other), broad) & F.contains(text, F.lit(word)))
        return F.when(passed, "Yes.").otherwise("No.")


@dataclass(frozen=True)
class HttpTransport:
    """Posts JSON bodies to a service: a callable for ServiceClassifier. Refusals for load (429) and errors of the
    service (5xx) or the line are tried again, each time after twice the wait. The same body always has the
    same Idempotency-Key, so a service that knows such keys doesn't answer, or charge, it twice."""

    url: str
    headers: dict[str, str] = field(default_factory=dict)
    tries: int = 5
    wait: float = 1.0
    timeout: float = 60.0

    def __call__(self, body: str) -> tuple[int, str]:
        data = body.encode()
        own = {"Content-Type": "application/json", "Idempotency-Key": hashlib.sha256(data).hexdigest(), **self.headers}
        for left in reversed(range(self.tries)):
            try:
                with urllib.request.urlopen(urllib.request.Request(self.url, data, own), timeout=self.timeout) as said:
                    return said.status, said.read().decode()
            except urllib.error.HTTPError as e:
                if not left or e.code != 429 and e.code < 500:
                    return e.code, e.read().decode("utf-8", "replace")
            except OSError:
                if not left:
                    raise
            time.sleep(self.wait * 2 ** (self.tries - 1 - left))
        raise AssertionError("a last try returns or raises")


class ServiceClassifier:
    """A chat-completion service behind a function that posts a JSON body and returns (status, text).
    The record's text is only ever data in the body; any failure gives N/A."""

    def __init__(self, post: Callable[[str], tuple[int, str]], model: str = SERVICE_MODEL) -> None:
        self.post, self.model = post, model

    def _ask(self, prompt: str) -> str:
        try:
            status, text = self.post(json.dumps({"model": self.model, "messages": [{"role": "user", "content": prompt}]}))
            said = json.loads(text)
            if status != 200:
                raise ValueError(said["error"]["message"])
            return said["choices"][0]["message"]["content"]
        except Exception:
            return NO_ANSWER

    def title(self, title: str) -> str:
        return self._ask(TITLE_PROMPT % title)

    def check(self, description: str, code: str) -> str:
        return self._ask(CHECK_PROMPT % (description, code))


def _answers(df: DataFrame, columns: list[str], ask: Callable[..., str], concurrency: int, threads: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for f in frames:
                args = [tuple("" if pd.isna(v) else v for v in row) for row in f[columns].itertuples(index=False)]
                yield f.assign(answer=list(pool.map(lambda a: ask(*a), args)))

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", answer string"
    return df.repartition(max(1, concurrency // threads)).mapInPandas(run, schema)


def ask_titles(titles: DataFrame, classifier: Classifier, concurrency: int, threads: int = 1) -> DataFrame:
    """(title, answer) for each distinct title. concurrency bounds the calls at a time. The caller stores
    the result before using it twice: answers cost money and need not repeat."""
    if hasattr(classifier, "title_column"):
        return titles.select("title").filter(F.col("title").isNotNull()).distinct().withColumn("answer", classifier.title_column(F.col("title")))
    return _answers(titles.select("title").filter(F.col("title").isNotNull()).distinct(), ["title"], classifier.title, concurrency, threads)


def ask_checks(rows: DataFrame, classifier: Classifier, concurrency: int, threads: int = 1) -> DataFrame:
    """The rows with the answer whether soc_code suits the description."""
    if hasattr(classifier, "check_column"):
        return rows.withColumn("answer", classifier.check_column(F.col("description"), F.col("soc_code")))
    return _answers(rows, ["description", "soc_code"], classifier.check, concurrency, threads)
