"""A stream of questions against static tables; stateless, so each micro-batch is a plan of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from docquarry.operators import router


def routed_stream(questions: DataFrame) -> DataFrame:
    """Routes a streaming DataFrame (qid, question)."""
    return router.route(questions)


def answer_stream(questions: DataFrame, answer_batch: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Starts a query that answers each micro-batch and appends it to ``path``; batches that a restart repeats are overwritten."""

    def run(batch: DataFrame, number: int) -> None:
        answer_batch(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return questions.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()
