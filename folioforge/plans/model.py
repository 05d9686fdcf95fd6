"""Model calls: a client interface, a deterministic stand-in, and batched calls over a prompt column.

Calls are not deterministic for the optimiser, and costly: ask() writes answers to a table before
anything reads them, so no plan calls a model twice for a row.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.shipping import ship


#: Prompts and answers that a worker holds at once.
SLICE = 256


class ModelClient(Protocol):
    def generate(self, prompts: list[str]) -> list[str]: ...

    def models(self) -> list[str]: ...


@dataclass(frozen=True)
class StubModel:
    """Answers that depend on the prompt alone: canned ones for prompts that hold a key, else kind's.

    {chars} in a canned answer becomes the length of its prompt, which shows where prompts are cut.
    Kinds: echo (the prompt), quote (what follows its first empty line), score, verdict.
    """

    kind: str = "echo"
    canned: tuple[tuple[str, str], ...] = ()

    def generate(self, prompts: list[str]) -> list[str]:
        return [next((a.replace("{chars}", str(len(p))) for k, a in self.canned if k in p), None) or self._made(p) for p in prompts]

    def _made(self, prompt: str) -> str:
        n = int.from_bytes(hashlib.sha256(prompt.encode()).digest()[:4], "big")
        if self.kind == "echo":
            return prompt
        if self.kind == "quote":
            return prompt.partition("\n\n")[2]
        if self.kind == "score":
            return json.dumps({"score": 1 + n % 10, "reason": "stub"})
        if self.kind == "verdict":
            return json.dumps({"preserved": n % 4 != 0, "supported": n % 3 != 0, "reason": "stub", "note": "stub"})
        return ""

    def models(self) -> list[str]:
        return ["stub"]


@dataclass(frozen=True)
class HttpModel:
    """A model server: {model, prompt, stream, options} answered by {response}, or for chat {model, messages, ..} by {message}.

    A chat's messages are the system's text, pairs of examples (asked, answered), and the prompt.
    """

    url: str
    model: str
    temperature: float = 0.3
    max_tokens: int = 4096
    timeout_s: float = 300.0
    pause_s: float = 0.0
    chat: bool = False
    system: str = ""
    examples: tuple[tuple[str, str], ...] = ()

    def request(self, prompt: str) -> tuple[str, dict]:
        """Path and body of the call for a prompt."""
        common = {"model": self.model, "stream": False, "options": {"temperature": self.temperature, "num_predict": self.budget()}}
        if not self.chat:
            return "/api/generate", common | {"prompt": prompt}
        given = [{"role": "system", "content": self.system}] if self.system else []
        shown = [{"role": role, "content": text} for pair in self.examples for role, text in zip(("user", "assistant"), pair)]
        return "/api/chat", common | {"messages": [*given, *shown, {"role": "user", "content": prompt}]}

    def budget(self) -> int:
        """Tokens of an answer: models that reason first get more."""
        return self.max_tokens + (3000 if "qwen3" in self.model else 0)

    def generate(self, prompts: list[str]) -> list[str]:
        from urllib.request import Request, urlopen

        out = []
        for prompt in prompts:
            path, body = self.request(prompt)
            with urlopen(Request(self.url + path, json.dumps(body).encode(), {"Content-Type": "application/json"}), timeout=self.timeout_s) as r:
                answer = json.loads(r.read())
                out.append(answer.get("message", {}).get("content", "") if self.chat else answer.get("response", ""))
            if self.pause_s:
                time.sleep(self.pause_s)
        return out

    def models(self) -> list[str]:
        from urllib.request import urlopen

        with urlopen(f"{self.url}/api/tags", timeout=10) as r:
            return [m["name"] for m in json.loads(r.read()).get("models", [])]


def suggest(client: ModelClient, wanted: str) -> tuple[bool, list[str]]:
    """Whether the model is there, and else which others of known families are."""
    names = client.models()
    return any(n == wanted or n.startswith(wanted + ":") for n in names), [n for n in names if any(f in n for f in ("gemma", "eeve", "llama"))]


def call(df: DataFrame, key: str, prompt: Column, client: ModelClient, batch: int = 32) -> DataFrame:
    """(key, answer, error): blank prompts get blank answers; a failed call gets its error, not a text, and costs only its row."""
    ship(df.sparkSession)
    kind = df.schema[key].dataType

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            prompts = b.column(1).to_pylist()
            answer: list[str | None] = [""] * len(prompts)
            error: list[str | None] = [None] * len(prompts)
            asked = [i for i, p in enumerate(prompts) if p and p.strip()]
            for at in range(0, len(asked), batch):
                part = asked[at : at + batch]
                try:
                    for i, a in zip(part, client.generate([prompts[i] for i in part])):
                        answer[i] = a
                except Exception:
                    for i in part:
                        try:
                            answer[i] = client.generate([prompts[i]])[0]
                        except Exception as e:
                            answer[i], error[i] = None, f"{type(e).__name__}: {e}"
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(answer, pa.string()), pa.array(error, pa.string())], [key, "answer", "error"])

    source = df.select(key, prompt.alias("prompt"))
    return source.mapInArrow(answers, f"`{key}` {kind.simpleString()}, answer string, error string")


def ask(df: DataFrame, key: str, prompt: Column, client: ModelClient, path: str) -> DataFrame:
    """call(), written to path and read again. Rows that path has an answer for are not asked again."""
    spark = df.sparkSession
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, answer string, error string"
    done = stored(spark, path, schema)
    todo = df.join(done.where("error is null").select(key), key, "left_anti") if done is not None else df
    call(todo, key, prompt, client).write.mode("append").parquet(path)
    fresh = spark.read.schema(schema).parquet(path)
    best = F.max_by(F.struct("answer", "error"), F.when(F.col("error").isNull(), 1).otherwise(0))
    return fresh.groupBy(key).agg(best.alias("a")).select(key, "a.*")


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    return spark.read.schema(schema).parquet(path) if there else None
