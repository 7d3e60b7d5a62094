"""Asking a caller's model from executors, with a response table as cache."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, functions as F

from factloom.session import materialize

RESPONSES = "key string, response string"
#: Calls of one task at the same time.
THREADS = 4


def request_key(model: str, system: Column, user: Column) -> Column:
    return F.sha2(F.concat_ws("\0", F.lit(model), system, user), 256)


def ask(
    requests: DataFrame, complete: Callable[[str, str], str], partitions: int | None = None, threads: int = THREADS
) -> DataFrame:
    """Add ``response`` and ``error`` to ``key, system, user`` rows; a failed call hits only its row.

    Up to ``threads`` calls of a task run at the same time, as calls mostly wait; answers keep the order of
    the rows. ``partitions`` sets how many tasks there are; by default the requests keep their own.
    """
    rows = requests.select("key", "system", "user")
    if partitions:
        rows = rows.repartition(partitions, "key")

    def one(system: str, user: str) -> tuple[str | None, str | None]:
        try:
            return complete(system, user), None
        except Exception as exc:  # noqa: BLE001
            return None, str(exc) or type(exc).__name__

    def run(batches):
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                # A bounded number of calls is handed over at a time.
                for low in range(0, len(batch), 16 * threads):
                    part = batch.iloc[low : low + 16 * threads]
                    answers = list(pool.map(one, part["system"], part["user"]))
                    yield part[["key"]].assign(response=[a for a, _ in answers], error=[e for _, e in answers])

    return rows.mapInPandas(run, "key string, response string, error string")


def asked_in_runs(complete: Callable[[str, str], str], system: str, threads: int = THREADS):
    """For ``mapInPandas``: ``response`` for ``block, ..., user`` rows whose equal requests lie in one run of a block.

    A block's answers are kept while its run lasts; a failed call leaves its rows without an answer.
    """

    def one(user: str) -> str | None:
        try:
            return complete(system, user)
        except Exception:  # noqa: BLE001
            return None

    def run(batches):
        known: dict[tuple[str, str], str | None] = {}
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                if batch.empty:
                    continue
                rows = list(zip(batch["block"], batch["user"]))
                asked = list(dict.fromkeys(row for row in rows if row not in known))
                # A bounded number of calls is handed over at a time.
                for low in range(0, len(asked), 16 * threads):
                    part = asked[low : low + 16 * threads]
                    known.update(zip(part, pool.map(one, [user for _, user in part])))
                answers = [known[row] for row in rows]
                known = {row: answer for row, answer in known.items() if row[0] == rows[-1][0]}
                yield batch.drop(columns=["block", "user"]).assign(response=answers)

    return run


def ask_cached(
    requests: DataFrame,
    complete: Callable[[str, str], str],
    cache: DataFrame | None = None,
    partitions: int | None = None,
    threads: int = THREADS,
) -> tuple[DataFrame, DataFrame]:
    """(answers for every distinct key, new cache rows): only keys missing from ``cache`` are asked.

    The answers are written before use, so that a model is not asked again for a retried read.
    """
    missing = requests.dropDuplicates(["key"])
    if cache is not None:
        missing = missing.join(cache, "key", "left_anti")
    asked = materialize(ask(missing, complete, partitions, threads), "responses")
    fresh = asked.where(F.col("error").isNull()).select("key", "response")
    answers = asked
    if cache is not None:
        known = cache.join(requests.select("key").distinct(), "key", "left_semi")
        answers = asked.unionByName(known.select("key", "response"), allowMissingColumns=True)
    return answers, fresh
