"""Model calls with a second try for replies that cannot be parsed (LLM6, LLM7, USE6)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.functions.payload import repair_object
from docmill.functions.text import is_blank
from docmill.operators.dispatch import BAD_PAYLOAD, EMPTY_PAYLOAD
from docmill.operators.prompts import request_rows, retry_prompts
from docmill.operators.usage import model_usage

#: A request may be asked so often at most.
TRIES = 2
FAILED_CALL = "Model call failed"
CALL_COLUMNS = ("payload", "failed", "status_code", "usage", "provider_style", "service", "model")

Call = Callable[[DataFrame], DataFrame]
Save = Callable[[DataFrame, str], DataFrame]


def ask(prompts: DataFrame, call: Call, save: Save, tries: int = TRIES) -> tuple[DataFrame, DataFrame]:
    """Answers and usage rows of prompt rows with request_id, system_prompt, user_prompt and response_schema.

    ``call`` adds ``CALL_COLUMNS`` to request rows; it may be costly, so its rows are kept as a table by ``save`` and a lost
    executor does not ask again.  What is wrong with a reply is kept with it, so every reply is parsed once for that.  A
    reply that holds no JSON object, even after repair, is asked for once more with the schema written out; a call that
    failed is not.  Each try works on what the one before left open, and the number of tries is fixed, so nothing is collected.

    Answers: one row per prompt with the payload of the last try made, ``tries`` and ``error`` (null if the payload parses).
    Usage: one row per call made that leaves one, both tries of a request included, with ``try``.
    """
    todo, closed, calls = prompts, [], []
    for n in range(1, tries + 1):
        parses = F.coalesce(~F.col("failed"), F.lit(True)) & repair_object(F.col("payload")).isNotNull()
        error = (
            F.when(F.col("failed"), F.lit(FAILED_CALL))
            .when(~parses & is_blank(F.col("payload")), F.lit(EMPTY_PAYLOAD))
            .when(~parses, F.lit(BAD_PAYLOAD))
        )
        done = save(call(request_rows(todo)).withColumn("try", F.lit(n)).withColumn("error", error), f"try-{n}")
        calls.append(model_usage(done).withColumn("try", F.lit(n)))
        again = F.col("error").isNotNull() & ~F.coalesce(F.col("failed"), F.lit(False)) if n < tries else F.lit(False)
        closed.append(done.where(~again).select(*prompts.columns, "payload", F.col("try").alias("tries"), "error"))
        if n < tries:
            left = done.where(again).withColumn("__parsed", F.lit(None).cast("string"))
            todo = retry_prompts(left, "__parsed").select(*prompts.columns)
    answers, usage = closed[0], calls[0]
    for a, u in zip(closed[1:], calls[1:], strict=True):
        answers, usage = answers.unionByName(a), usage.unionByName(u)
    return answers, usage
