"""Model calls through a table of answers (L8 and the provider's plan and schema calls).

A request is its prompt's SHA-256. Prompts that are equal are asked once, a
prompt that the table has an answer for is not asked at all, and what a call
returned or raised is stored before it is used: a lost executor or a second
run asks nothing twice that was answered. Calls are a seam: ``make_fn()`` gives
a batch function (list of prompts -> list of texts), one for each partition.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.plan import parse_plans, plan_prompts, plan_view
from ..session import ship_package
from .crawl import hot_split_join
from .extract import CompiledSchema, SelectorError
from .inference import extraction_prompts

ANSWERS = "digest string, response string, error string"
Caller = Callable[[], Callable[[list[str]], list[str]]]


def with_digest(prompts: DataFrame) -> DataFrame:
    return prompts.withColumn("digest", F.sha2(F.coalesce("prompt", F.lit("")), 256))


def stored_answers(spark, store: str) -> DataFrame:
    """One answer for each digest of the table at ``store``: a response if there is one, else an error.
    A store that isn't there yet has none."""
    from pyspark.errors import AnalysisException

    try:
        held = spark.read.schema(ANSWERS).option("recursiveFileLookup", True).parquet(store)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], ANSWERS)
    best = F.min(F.struct(F.col("error").isNotNull().alias("failed"), "response", "error"))
    return held.groupBy("digest").agg(best.alias("_a")).select("digest", "_a.response", "_a.error")


def _call(make_fn: Caller):
    def run(batches: Iterator):
        import pandas as pd

        fn = make_fn()
        for pdf in batches:
            prompts = list(pdf["prompt"])
            answers: list[tuple[str | None, str | None]] = [(None, "no prompt")] * len(prompts)
            some = [i for i, p in enumerate(prompts) if p is not None]
            groups = [some] if some else []
            while groups:
                some = groups.pop()
                try:
                    got = fn([prompts[i] for i in some])
                    if len(got) != len(some):
                        raise ValueError(f"{len(got)} answers to {len(some)} prompts")
                    for i, text in zip(some, got):
                        answers[i] = (None, "no answer") if text is None else (str(text), None)
                except Exception as e:  # noqa: BLE001 - a provider's error is an outcome of its prompts
                    if len(some) > 1:  # asked again one by one: only what fails itself fails
                        groups += [[i] for i in some]
                    else:
                        answers[some[0]] = (None, str(e) or type(e).__name__)
            yield pd.DataFrame({"digest": pdf["digest"], "response": [a for a, _ in answers], "error": [e for _, e in answers]}, dtype=object)
    return run


def answered(prompts: DataFrame, make_fn: Caller, store: str, retry_failed: bool = False, tasks: int | None = None) -> DataFrame:
    """``prompts`` (with ``prompt``) plus digest, response and error; exactly one of these two is null.

    Prompts without a stored answer are asked and their answers appended to
    ``store`` (Parquet, a folder for each run). A null prompt is not asked;
    where a batch fails its prompts are asked again one by one. Stored failures count as
    answers unless ``retry_failed``. ``tasks``: how many tasks ask (calls wait
    on a network more than they compute).
    """
    spark = prompts.sparkSession
    ship_package(spark)
    keyed = with_digest(prompts)
    known = stored_answers(spark, store)
    if retry_failed:
        known = known.filter(F.col("error").isNull())
    once = keyed.groupBy("digest").agg(F.min("prompt").alias("prompt"), F.count(F.lit(1)).alias("_n"))
    misses = once.join(known.select("digest"), "digest", "left_anti").select("digest", "prompt")
    misses = misses.repartition(tasks, "digest") if tasks else misses
    misses.mapInPandas(_call(make_fn), ANSWERS).write.parquet(f"{store.rstrip('/')}/run-{uuid.uuid4().hex}")
    answers = stored_answers(spark, store)
    # A prompt that very many rows share is split over tasks.
    rows = keyed.count()
    spread = [c for c in keyed.columns if c not in ("prompt", "digest")] or ["prompt"]
    return hot_split_join(keyed, answers, "digest", "inner", rows, spread)


def planned(jobs: DataFrame, make_fn: Caller, store: str) -> DataFrame:
    """L8 as one flow: prompt -> call -> parse -> view, for every job (job_id, goal, seed_urls, max_depth).

    outcome: ``ok``, ``fallback`` (the answer is no JSON) or ``plan_error``
    (no usable plan, or the call failed: then ``error`` is its message).
    Plan columns as in ``parse_plans``; ``view`` is null without a plan.
    """
    asked = answered(plan_prompts(jobs), make_fn, store).select("job_id", "response", "error")
    asked = jobs.select("job_id", "seed_urls").join(asked, "job_id")
    failed = F.col("error").isNotNull()
    parsed = parse_plans(asked.filter(~failed).select("job_id", "seed_urls", F.col("response").alias("raw")))
    shown = parsed.join(plan_view(parsed.filter(F.col("outcome") != "plan_error")), "job_id", "left")
    shown = shown.withColumn("error", F.when(F.col("outcome") == "plan_error", F.lit("unusable plan")))
    lost = asked.filter(failed).select("job_id", F.lit("plan_error").alias("outcome"), "error")
    return shown.unionByName(lost, allowMissingColumns=True)


def _schema_of(text: str | None):
    import json

    try:
        schema = json.loads(text or "")
    except ValueError:
        return None, "the answer is no JSON"
    if not isinstance(schema, dict):
        return None, "the answer is no schema"
    try:
        return CompiledSchema(schema), None
    except (SelectorError, KeyError, TypeError, AttributeError) as e:
        return None, str(e) if isinstance(e, SelectorError) else "the answer is no schema"


def scraped(pages: DataFrame, make_fn: Caller, store: str, goal: str, description: str) -> DataFrame:
    """The provider's schema call and what follows: each page (page_id, url, html) is shown to the model, its answer is the page's CSS
    schema, and the page's records are extracted with it.

    -> page_id, rec_no, record map<string,string>, error. A page whose call
    failed or whose answer is no schema has one row with the error; a page
    where the schema finds nothing has none.
    """
    asked = answered(extraction_prompts(pages, goal, description), make_fn, store).select("page_id", "response", F.col("error").alias("call_error"))
    rows = pages.select("page_id", "html").join(asked, "page_id")

    def run(batches: Iterator):
        import pandas as pd

        compiled: dict[str, tuple] = {}
        for pdf in batches:
            out = []
            for page, html, response, error in zip(pdf["page_id"], pdf["html"], pdf["response"], pdf["call_error"]):
                schema = None
                if error is None or error != error:  # null
                    if len(compiled) > 1000:  # schemas differ from page to page: keep no more than these
                        compiled.clear()
                    if response not in compiled:
                        compiled[response] = _schema_of(response)
                    schema, error = compiled[response]
                if schema is None:
                    out.append((page, 0, None, error))
                else:
                    out += [(page, n, {k: v for k, v in r.items()}, None) for n, r in enumerate(schema.records(html))]
            if out:
                yield pd.DataFrame(out, columns=["page_id", "rec_no", "record", "error"]).astype({"record": object, "error": object})

    return rows.mapInPandas(run, "page_id long, rec_no long, record map<string,string>, error string")
