"""Model calls as a pluggable function over batches, with a deterministic stand-in where no model is at hand.

A model is a picklable factory without arguments; it is called once per Python worker and gives a function from a list
of prompts to a list of answers. Nothing here opens a connection.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Model = Callable[[list[str]], list[str]]
_loaded: dict[object, Model] = {}


def _once(factory: Callable[[], Model]) -> Model:
    """The model of a factory, made once a worker; factories are one if they pickle alike, whatever their names."""
    key = hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()
    if key not in _loaded:
        _loaded[key] = factory()
    return _loaded[key]


def ask(df: DataFrame, prompt: str, factory: Callable[[], Model], answer: str = "answer", error: str = "error", retries: int = 3, wait: float = 60.0, batch: int = 32) -> DataFrame:
    """``df`` with the columns ``answer`` and ``error`` (null where it went well).

    Prompts go out ``batch`` at a time; a failing batch is tried again after wait * 2**n seconds, then its rows keep a null
    answer and the message. Null prompts aren't asked.
    """
    names = [c for c in df.columns if c not in (answer, error)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema)

    def run(frames):
        model = _once(factory)
        for frame in frames:
            answers, errors = [None] * len(frame), [None] * len(frame)
            at = [i for i, p in enumerate(frame[prompt]) if p is not None]
            for s in range(0, len(at), batch):
                part = at[s : s + batch]
                for n in range(retries + 1):
                    try:
                        for i, a in zip(part, model([frame[prompt].iloc[i] for i in part])):
                            answers[i] = a
                        break
                    except Exception as e:  # noqa: BLE001 - any failure of a model is data here
                        if n == retries:
                            for i in part:
                                errors[i] = str(e)[:500]
                        else:
                            time.sleep(wait * 2**n)
            yield frame[names].assign(**{answer: pd.Series(answers, index=frame.index, dtype=object), error: pd.Series(errors, index=frame.index, dtype=object)})

    return df.select(*names).mapInPandas(run, f"{schema}, `{answer}` string, `{error}` string")


#: Models by name; ``register`` adds one, ``model`` gives its factory.
MODELS: dict[str, Callable[[], Model]] = {}


def register(name: str, factory: Callable[[], Model]) -> None:
    MODELS[name] = factory


def model(name: str) -> Callable[[], Model]:
    if name not in MODELS:
        raise ValueError(f"no model {name!r}; there are: {', '.join(sorted(MODELS)) or 'none'}")
    return MODELS[name]


def available(factory: Callable[[], Model], probe: str = "ping") -> bool:
    """Whether a model can be made and answers a prompt."""
    try:
        return len(_once(factory)([probe])) == 1
    except Exception:  # noqa: BLE001 - whatever is wrong, it isn't available
        return False


def flattened(messages: Column) -> Column:
    """A chat, an array of structs role and content, as one prompt: system texts as they are, others after their role, the turn of the assistant last."""
    lines = F.transform(F.filter(messages, lambda m: F.coalesce(m["content"], F.lit("")) != ""), lambda m: F.when(m["role"] == "system", m["content"]).otherwise(F.concat(F.initcap(m["role"]), F.lit(": "), m["content"])))
    return F.concat(F.array_join(lines, "\n\n"), F.lit("\n\nAssistant:"))


def run_report(asked: DataFrame, *by: str, error: str = "error") -> DataFrame:
    """(by..., asked, answered, failed) of rows that ``ask`` returned."""
    return asked.groupBy(*by).agg(F.count("*").alias("asked"), F.count("answer").alias("answered"), F.count(error).alias("failed"))


# References to numbered sources in an explanation.
NUMBERED = r"(?i)\b(?:Members?|Sources?)\s+\d+(?:\s*(?:,|and)\s*\d+)*\b"


def named_sources(explanation: Column, sources: Column) -> Column:
    """"Source 0" or "Members 1 and 3" replaced by the names; numbers out of range go, a reference without any stays.

    The text is taken apart at its references and put together again with their names; null sources change nothing.
    """

    def spoken(reference: Column) -> Column:
        numbers = F.transform(F.regexp_extract_all(reference, F.lit(r"\d+"), 0), lambda n: n.try_cast("int"))
        names = F.transform(F.filter(numbers, lambda n: n < F.size(sources)), lambda n: F.get(sources, n))
        n, final = F.size(names), F.try_element_at(names, F.lit(-1))
        listed = F.concat(F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.when(n > 2, ", and ").otherwise(" and "), final)
        return F.when(n == 0, reference).when(n == 1, final).otherwise(listed)

    replaced = F.transform(F.regexp_extract_all(explanation, F.lit(NUMBERED), 0), spoken)
    rest = F.split(explanation, NUMBERED, -1)
    whole = F.array_join(F.transform(rest, lambda part, i: F.concat(part, F.coalesce(F.get(replaced, i), F.lit("")))), "")
    return F.when(F.coalesce(F.size(sources), F.lit(0)) <= 0, explanation).otherwise(whole)
