"""Model stages over Arrow batches: a model is made once a Python worker, and a failing row becomes an error row."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from voicelake.functions.text import clause_plan

_models: dict = {}


def worker_model(name: str, factory: Callable[[], Callable]) -> Callable:
    """The worker's model of that name, made at its first use; as a module's function it is not pickled, so the cache outlives tasks."""
    if name not in _models:
        _models[name] = factory()
    return _models[name]


def _one(model, value):
    try:
        return model(value) if not hasattr(model, "batch") else model.batch([value])[0]
    except Exception as wrong:  # noqa: BLE001  whatever a model raises is that row's result
        return wrong


def _answers(model, values: list) -> list:
    """An (output, ms) or exception a value. A batch that fails, or gives too few answers, is halved until its bad rows stand alone."""
    if len(values) < 2 or not hasattr(model, "batch"):
        return [_one(model, v) for v in values]
    try:
        found = list(model.batch(values))
    except Exception:  # noqa: BLE001
        found = []
    if len(found) == len(values):
        return found
    half = len(values) // 2
    return _answers(model, values[:half]) + _answers(model, values[half:])


def _outputs(values: list, kind: pa.DataType) -> tuple[pa.Array, dict[int, str]]:
    """The outputs as one array, and what is wrong with those that the type cannot hold."""
    try:
        return pa.array(values, kind), {}
    except (pa.ArrowException, TypeError, ValueError, OverflowError):
        held, wrong = [], {}
        for k, value in enumerate(values):
            try:
                held.append(pa.array([value], kind)[0].as_py())
            except (pa.ArrowException, TypeError, ValueError, OverflowError) as error:
                held.append(None)
                wrong[k] = str(error)
        return pa.array(held, kind), wrong


def _values(column: pa.Array) -> list:
    """Python values of a column; a list of numbers comes as a numpy array, nulls as None."""
    listed = pa.types.is_list(column.type) or pa.types.is_large_list(column.type)
    if listed and (pa.types.is_floating(column.type.value_type) or pa.types.is_integer(column.type.value_type)):
        return [x.values.to_numpy(zero_copy_only=False) if x.is_valid else None for x in column]
    return column.to_pylist()


def _slices(batch: pa.RecordBatch, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about so many bytes."""
    rows = max(1, int(batch.num_rows * most_bytes / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def results(model, column: pa.Array, kind: pa.DataType) -> pa.StructArray:
    """The result of each value: status, output, code, message, stage_ms. Null values are skipped."""
    values = _values(column)
    answers = iter(_answers(model, [v for v in values if v is not None]))
    status, output, code, message, took = [], [], [], [], []
    for value in values:
        answer = None if value is None else next(answers)
        if answer is None:
            row = ("skipped", None, None, None, 0.0)
        elif isinstance(answer, Exception):
            row = ("failed", None, "UNSUPPORTED_CAPABILITY" if isinstance(answer, NotImplementedError) else "INFERENCE_FAILED", str(answer), 0.0)
        else:
            row = ("success", answer[0], None, None, float(answer[1]))
        for part, x in zip((status, output, code, message, took), row, strict=True):
            part.append(x)
    made, wrong = _outputs(output, kind)
    for k, error in wrong.items():
        status[k], code[k], message[k], took[k] = "failed", "INFERENCE_FAILED", error, 0.0
    text = lambda x: pa.array(x, pa.string())
    return pa.StructArray.from_arrays([text(status), made, text(code), text(message), pa.array(took, pa.float64())], names=["status", "output", "code", "message", "stage_ms"])


def apply_engine(df: DataFrame, stage: str, factory: Callable[[], Callable], column: str, out: str | None = None, model_id: str | None = None, output: str = "string", batch_bytes: int = 1 << 20) -> DataFrame:
    """Adds the struct ``out`` (default: the stage's name): status, output, code, message, stage_ms.

    factory() -> model; model(value) -> (output, ms), or model.batch(values) -> one (output, ms) or exception each. Values
    and outputs may be of any type, samples too (``output`` is the type). NotImplementedError gives code
    UNSUPPORTED_CAPABILITY, anything else INFERENCE_FAILED; the job goes on. A batch holds about ``batch_bytes`` at most, since
    each stage is a worker of its own and all of a task's workers hold one at a time. A worker keeps a model by stage and ``model_id``, by default a digest of the factory.
    """
    out, names = out or stage, df.columns
    name = f"{stage}/{model_id or hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()}"
    result = StructType.fromDDL(f"status string, output {output}, code string, message string, stage_ms double")
    plain = df.toDF(*[f"c{k}" for k in range(len(names))])  # columns of any name
    at, kind = names.index(column), to_arrow_type(result["output"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_model(name, factory)
        for batch in batches:
            for part in _slices(batch, batch_bytes):
                yield pa.RecordBatch.from_arrays([*part.columns, results(model, part.column(at), kind)], names=[*part.schema.names, "result"])

    return plain.mapInArrow(run, StructType([*plain.schema.fields, StructField("result", result)])).toDF(*names, out)


def unpack_result(df: DataFrame, result: str) -> tuple[DataFrame, DataFrame]:
    """(rows with data, rows with an error): success and partial both count as data."""
    good = F.col(f"{result}.status").isin("success", "partial")
    return df.filter(good), df.filter(~good)


def _said(stage: str) -> Column:
    """A stage's output, null where it failed or is blank."""
    return F.when((F.col(f"{stage}.status") == "success") & (F.trim(f"{stage}.output") != ""), F.col(f"{stage}.output"))


def _failure(stages: list[str]) -> Column:
    """The first failed stage, its code and message."""
    return F.coalesce(*[F.when(F.col(f"{s}.status") == "failed", F.struct(F.lit(s).alias("failed_stage"), F.col(f"{s}.code").alias("code"), F.col(f"{s}.message").alias("message"))) for s in stages])


def _spoken(done: DataFrame, keys: list[str], last: str, stages: list[str], tts, chunked: bool, audio: str | None) -> DataFrame:
    """One row an utterance that has text or failed; blank ones are skipped. ``audio`` is the type of the synthesised samples, an array, if they are wanted."""
    texts = done.select(*keys, _said(last).alias("_text"), _failure(stages).alias("_failure"), F.when(F.col(f"{last}.status") == "success", F.col(f"{last}.stage_ms")).alias("mt_ms"))
    texts = texts.filter("_text IS NOT NULL OR _failure IS NOT NULL")
    plan = F.when(F.col("_text").isNotNull(), clause_plan(F.col("_text"), chunked))
    clauses = texts.select(*keys, "mt_ms", "_failure", F.posexplode_outer(plan).alias("clause_idx", "clause_text"))
    made = apply_engine(clauses, "tts", tts, "clause_text", output=audio or "string")
    parts = [F.struct("clause_idx", "clause_text", *([F.col("tts.output").alias("samples")] if audio else []))]
    ordered = F.array_sort(F.collect_list(F.when(F.col("clause_text").isNotNull(), parts[0])), lambda a, b: a["clause_idx"] - b["clause_idx"])
    silent = F.when(F.col("tts.status") == "failed", F.struct(F.lit("tts").alias("failed_stage"), F.col("tts.code").alias("code"), F.col("tts.message").alias("message")))
    spoken = [F.when(F.count("tts.output") > 0, F.flatten(F.filter(F.transform(ordered, lambda c: c["samples"]), lambda x: x.isNotNull()))).alias("samples")] if audio else []
    joined = made.groupBy(*keys).agg(
        F.when(F.count("clause_text") > 0, F.array_join(F.transform(ordered, lambda c: c["clause_text"]), " ")).alias("translated_text"), F.count("clause_text").alias("clauses"), *spoken,
        F.first("mt_ms").alias("mt_ms"), F.sum("tts.stage_ms").alias("tts_ms"), F.count_if(F.col("tts.status") == "failed").alias("failed_clauses"), F.coalesce(F.first("_failure", True), F.first(silent, True)).alias("_failure"),
    )
    status = F.when(F.col("translated_text").isNull(), "failed").when(F.col("failed_clauses") > 0, "partial").otherwise("success")
    return joined.select("*", status.alias("status"), "_failure.*").drop("_failure")


def reject_unsupported_target(df: DataFrame, stage: str, target: Column, allowed: tuple[str, ...] = ("en",), output: str = "string") -> DataFrame:
    """Results of a stage that only translates into some languages, by the primary subtag: the others' rows fail, whatever the stage said."""
    refused = ~F.coalesce(F.lower(F.split(target, "[-_]")[0]).isin(*allowed), F.lit(False))
    message = F.concat(F.lit("no direct translation into "), F.coalesce(target, F.lit("an unknown language")))
    wrong = F.struct(F.lit("failed").alias("status"), F.lit(None).cast(output).alias("output"), F.lit("UNSUPPORTED_CAPABILITY").alias("code"), message.alias("message"), F.lit(0.0).alias("stage_ms"))
    return df.withColumn(stage, F.when(refused, wrong).otherwise(F.col(stage)) if stage in df.columns else F.when(refused, wrong))


def translate_direct(df: DataFrame, keys: list[str], column: str, translate, tts, chunked: bool = True, target: Column | None = None, audio: str | None = None) -> DataFrame:
    """Speech translation, blank results skipped, clauses spoken one by one; what fails keeps a row with its stage, code and message.

    Direct models translate into English only: with ``target``, rows of another target language fail, and the model does not see them.
    """
    stage = "speech_translation"
    if target is None:
        done = apply_engine(df, stage, translate, column)
    else:
        open_ = F.coalesce(F.lower(F.split(target, "[-_]")[0]) == "en", F.lit(False))
        asked = df.withColumns({"_target": target, "_heard": F.when(open_, F.col(column))})
        done = reject_unsupported_target(apply_engine(asked, stage, translate, "_heard"), stage, F.col("_target"))
    return _spoken(done, keys, stage, [stage], tts, chunked, audio)


def translate_cascade(df: DataFrame, keys: list[str], column: str, stt, translate, tts, chunked: bool = True, audio: str | None = None) -> DataFrame:
    """Recognition, translation, clauses, synthesis; blanks are skipped after either text stage, and what fails keeps a row."""
    heard = apply_engine(df, "stt", stt, column)
    outcome = F.struct("stt.status", "stt.code", "stt.message")  # the text goes on once, as what was heard
    done = apply_engine(heard.select(*keys, outcome.alias("stt"), _said("stt").alias("_heard")), "translation", translate, "_heard")
    return _spoken(done, keys, "translation", ["stt", "translation"], tts, chunked, audio)


def speech_to_speech(df: DataFrame, keys: list[str], column: str, model, output: str = "array<float>") -> DataFrame:
    """One stage from samples to samples; empty audio is skipped, what fails keeps a row; one clause, no separate stage times."""
    done = apply_engine(df, "s2s", model, column, output=output)
    size = F.size("s2s.output") if output.startswith("array") else F.length("s2s.output")
    kept = done.filter((F.col("s2s.status") == "failed") | ((F.col("s2s.status") == "success") & (size > 0)))
    clauses = F.when(F.col("s2s.status") == "success", 1).otherwise(0)
    return kept.select(*keys, F.col("s2s.output").alias("output"), clauses.alias("clauses"), F.lit(0.0).alias("mt_ms"), F.lit(0.0).alias("tts_ms"), F.col("s2s.status").alias("status"), F.col("s2s.code").alias("code"), F.col("s2s.message").alias("message"))
