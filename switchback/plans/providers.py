"""Models behind a small protocol, and their use in plans.

A provider is called for whole batches inside ``mapInPandas`` and its replies are written down
before anything else reads them, so that a repeated action or a lost executor causes no second call for
a reply that is on file.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from switchback.functions.citations import cited, invalid, stripped
from switchback.functions.text import REFUSAL, refused
from switchback.plans.lineage import written


class ModelProvider(Protocol):
    name: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def chat(self, prompts: list[str], schema: dict | None = None, temperature: float = 0.0, system: str = "") -> list[str]: ...


@dataclass(frozen=True)
class FakeProvider:
    """Deterministic stand-in: hashed bags of words as vectors, replies by a rule of the prompt."""

    name: str = "fake"
    dim: int = 64
    reply: Callable[[str], str] | None = None
    log: str | None = None  # file to which every prompt is appended

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim))
        for k, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                out[k, h % self.dim] += 1 if h >> 40 & 1 else -1
        return out.tolist()

    def chat(self, prompts: list[str], schema: dict | None = None, temperature: float = 0.0, system: str = "") -> list[str]:
        prompts = [f"{system}\n\n{p}" if system else p for p in prompts]
        if self.log:
            with open(self.log, "a", encoding="utf-8") as f:
                f.writelines(json.dumps(p) + "\n" for p in prompts)
        return [self.reply(p) if self.reply else p[:80] for p in prompts]


@dataclass(frozen=True)
class HttpProvider:
    """A chat and embedding server with the common JSON interface; needs a network."""

    name: str
    url: str
    embedder: str
    key: str = ""

    def _post(self, route: str, body: dict) -> dict:
        from urllib.request import Request, urlopen

        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        with urlopen(Request(f"{self.url.rstrip('/')}/{route}", json.dumps(body).encode(), head), timeout=300) as r:
            return json.load(r)

    def embed(self, texts: list[str]) -> list[list[float]]:
        data = self._post("embeddings", {"model": self.embedder, "input": texts})["data"]
        return [d["embedding"] for d in sorted(data, key=lambda d: d["index"])]

    def chat(self, prompts: list[str], schema: dict | None = None, temperature: float = 0.0, system: str = "") -> list[str]:
        lead = [{"role": "system", "content": system}] if system else []
        extra = {"response_format": {"type": "json_schema", "json_schema": {"name": "reply", "schema": schema}}} if schema else {}
        return [
            self._post("chat/completions", {"model": self.name, "temperature": temperature, "messages": [*lead, {"role": "user", "content": p}]} | extra)["choices"][0]["message"]["content"]
            for p in prompts
        ]


def provider_from_env(url: str = "MODEL_URL", name: str = "MODEL_NAME", embedder: str = "EMBEDDER_NAME") -> ModelProvider:
    """The server that three environment variables name; the stand-in unless all are set."""
    found = [os.environ.get(v, "") for v in (url, name, embedder)]
    return HttpProvider(found[1], found[0], found[2], os.environ.get("MODEL_KEY", "")) if all(found) else FakeProvider()


def replies(prompts: DataFrame, provider: ModelProvider, schema: dict | None = None, batch: int = 32, system: str = "") -> DataFrame:
    """``(id, reply)`` of ``prompts(id, prompt)``, written down once; ``system`` is said before each prompt."""

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lo in range(0, len(f), batch):
                g = f.iloc[lo : lo + batch]
                yield pd.DataFrame({"id": g["id"], "reply": provider.chat(g["prompt"].tolist(), schema, system=system)})

    return written(prompts.select("id", "prompt").mapInPandas(call, "id string, reply string"), "replies")


def structured(rows: DataFrame, ddl: str, col: str = "reply") -> DataFrame:
    """``record`` parsed from a JSON reply; what cannot be parsed is null and flagged."""
    return rows.withColumn("record", F.from_json(col, ddl, {"mode": "PERMISSIVE"})).withColumn("unparsed", F.try_parse_json(F.col(col)).isNull())


def embedded(texts: DataFrame, provider: ModelProvider, cache: str, task: str = "", batch: int = 32) -> DataFrame:
    """``(id, vector)`` of ``texts(id, text)``; only texts that are not in the parquet cache are embedded.

    The cache is keyed by model, task and a hash of the text, so a changed text is never served a stale vector; it is partitioned by
    model, so that only this one's part is read.
    """
    spark: SparkSession = texts.sparkSession
    key = F.sha2(F.concat(F.lit(f"{task}: " if task else ""), F.coalesce("text", F.lit(""))), 256)
    keyed = texts.select("id", F.col("text"), key.alias("key"))
    own = f"{cache}/model={quote(provider.name, safe='')}"
    try:
        known = spark.read.schema("key string, vector array<double>").parquet(own)
    except AnalysisException:  # nothing on file yet
        known = spark.createDataFrame([], "key string, vector array<double>")

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lo in range(0, len(f), batch):
                g = f.iloc[lo : lo + batch]
                yield pd.DataFrame({"key": g["key"], "vector": provider.embed([(f"{task}: " if task else "") + (t or "") for t in g["text"]])})

    fresh = keyed.join(known.select("key"), "key", "left_anti").groupBy("key").agg(F.first("text").alias("text"))
    made = written(fresh.mapInPandas(call, "key string, vector array<double>"), "vectors")
    vectors = known.unionByName(made).groupBy("key").agg(F.first("vector").alias("vector"))
    made.write.mode("append").parquet(own)
    return keyed.join(vectors, "key").select("id", "vector")


def gated_replies(rows: DataFrame, may: DataFrame, provider: ModelProvider, system: str = "") -> DataFrame:
    """Rows with ``draft``; only those of ``may(id, prompt)`` reach the provider - two plans, not a condition."""
    drafts = replies(may, provider, system=system).withColumnRenamed("reply", "draft")
    asked = rows.join(drafts, "id")
    rest = rows.join(may.select("id"), "id", "left_anti").withColumn("draft", F.lit(None).cast("string"))
    return asked.unionByName(rest)


def cited_answers(questions: DataFrame, provider: ModelProvider) -> DataFrame:
    """Answers of ``questions(id, prompt, retrieved array)`` with valid citations only.

    A refusal that cites is cut to the refusal; other answers with an unknown id are asked for once
    more with the known ids; what is unknown then is replaced.  ``retried`` and ``removed`` tell what happened.
    """
    first = questions.join(replies(questions, provider), "id").withColumn("bad", invalid(F.col("reply"), F.col("retrieved")))
    first = written(first, "answers")
    settled = first.where(F.size("bad") == 0).withColumn("answer", F.col("reply")).withColumn("retried", F.lit(False))
    refusal = first.where((F.size("bad") > 0) & refused(F.col("reply"))).withColumn("answer", F.lit(REFUSAL)).withColumn("retried", F.lit(False))
    again = first.where((F.size("bad") > 0) & ~refused(F.col("reply")))
    hint = F.concat("prompt", F.lit("\n\nCite only these ids: "), F.array_join("retrieved", ", "))
    second = replies(again.select("id", hint.alias("prompt")), provider).withColumnRenamed("reply", "answer")
    repaired = again.join(second, "id").withColumn("retried", F.lit(True))
    every = settled.unionByName(refusal).unionByName(repaired)
    every = every.withColumn("left", invalid(F.col("answer"), F.col("retrieved")))
    return every.select("id", stripped(F.col("answer"), F.col("left")).alias("answer"), "retried", F.size("left").alias("removed"), cited(F.col("answer")).alias("cited"))


def compared(prompts: DataFrame, one: ModelProvider, two: ModelProvider) -> DataFrame:
    """``(id, first, second, same)``: the labels two models give to the very same prompts."""
    from switchback.functions.text import earliest_label

    a = replies(prompts, one).select("id", earliest_label(F.col("reply")).alias("first"))
    b = replies(prompts, two).select("id", earliest_label(F.col("reply")).alias("second"))
    return a.join(b, "id").withColumn("same", F.col("first").eqNullSafe(F.col("second")))


# what a summary is for, and for whom
MODES = {"naive": "Summarize this trip report.", "briefing": "Write a briefing: hazards first, then conditions, then the rest. Say nothing the report does not say.", "headline": "Write one line that names the most important fact of the report."}
AUDIENCES = {"hiker": "The reader plans to hike this trail tomorrow.", "ranger": "The reader is the ranger on duty and decides on closures."}


def summary_prompt(body, mode: str, audience: str):
    """Prompt column of a report's body for a mode and an audience."""
    return F.concat(F.lit(f"{MODES[mode]} {AUDIENCES[audience]}\n\nReport:\n"), body)
