"""Detection over DataFrames.

``detect`` adds a result column, ``detect_all`` gives a row for each candidate. Rows that the native stages decide never
send their content to Python: the Arrow stage gets a null for them, or their first 2 kB if a language is asked for.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import asdict
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from byteloom.functions import bytes as B
from byteloom.functions import stages as S
from byteloom.operators import residual
from byteloom.operators.options import MINIMUM_THRESHOLD, DetectOptions
from byteloom.tables import names
from byteloom.tables.models import Models, standard

NATIVE, REST = "__native", "__rest"


@lru_cache(4)
def _standard_models() -> Models:
    return standard()


@lru_cache(1)
def _shared_standard(application: str):
    from pyspark import SparkContext

    return SparkContext.getOrCreate().broadcast(_standard_models())


def share(spark: SparkSession, models: Models | None):
    """The models as a broadcast, of 64 kB for each; the standard ones are sent once for a session."""
    return _shared_standard(spark.sparkContext.applicationId) if models is None else spark.sparkContext.broadcast(models)


def _displayed(found: residual.Found, options: DetectOptions) -> dict:
    return asdict(found) | {"encoding": names.display(found.encoding, options.prefer_superset, options.compat_names)}


def display_name(encoding: Column, options: DetectOptions) -> Column:
    """Registered names as they are reported: preferred superset first, then display name."""
    out = encoding
    for wanted, table in ((options.prefer_superset, names.PREFERRED_SUPERSET), (options.compat_names, names.COMPAT_NAMES)):
        if wanted:
            out = F.coalesce(F.try_element_at(S.literal_map(table), out), out)
    return out


def native(df: DataFrame, content: str, output: str, options: DetectOptions) -> DataFrame:
    """Adds the result where the native stages decide, with registered names and no language filled in; else null."""
    return S.decided(df, content, output, options.allowed, options.empty_input_encoding, options.max_bytes)


def _rest_udf(options: DetectOptions, shared):
    """(content, registered encoding decided natively) -> result. Content alone: the whole detection."""

    @F.pandas_udf(S.RESULT)
    def rest(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        models = shared.value
        for contents, encodings in batches:
            asked = [(k, c, e) for k, (c, e) in enumerate(zip(contents, encodings)) if c is not None]
            out = [residual.Found(None, 0.0)] * len(contents)
            known = [(k, bytes(c), e) for k, c, e in asked if e is not None and len(c)]
            for (k, _, e), lang in zip(known, residual.languages([c for _, c, _ in known], [e for _, _, e in known], models)):
                out[k] = residual.Found(e, 0.0, lang)
            for k, c, e in asked:
                if e is None:
                    out[k] = residual.detect_all(bytes(c), options, models)[0]
            yield pd.DataFrame({f: [getattr(x, f) for x in out] for f in ("encoding", "confidence", "language", "mime_type")})

    return rest


def detect(df: DataFrame, content: str = "content", output: str = "detected", options: DetectOptions | None = None, models: Models | None = None) -> DataFrame:
    """Adds ``output``: struct(encoding, confidence, language, mime_type). Null content gives a null result."""
    options = options or DetectOptions()
    found = native(df, content, NATIVE, options)
    # A mark, an escape or a declaration may have a language of its own already.
    lingual = F.col(f"{NATIVE}.encoding").isNotNull() & F.col(f"{NATIVE}.language").isNull() & F.lit(options.language)
    sent = F.when(F.col(NATIVE).isNull(), F.col(content)).when(lingual, B.head(F.col(content), residual.LANGUAGE_BYTES))
    rest = _rest_udf(options, share(df.sparkSession, models))
    found = found.withColumn(REST, rest(sent, F.col(f"{NATIVE}.encoding")))
    filled = F.col(NATIVE).withField("language", F.coalesce(F.col(f"{NATIVE}.language"), F.when(lingual, F.col(f"{REST}.language"))))
    found = found.withColumn(output, F.when(F.col(content).isNotNull(), F.when(F.col(NATIVE).isNull(), F.col(REST)).otherwise(filled))).drop(NATIVE, REST)
    return found.withColumn(output, F.col(output).withField("encoding", display_name(F.col(f"{output}.encoding"), options)))


def detect_native(df: DataFrame, content: str = "content", output: str = "detected", options: DetectOptions | None = None) -> DataFrame:
    """As ``detect``, by native stages alone: null where they can't decide, and no language but a given one."""
    options = options or DetectOptions()
    return native(df, content, output, options).withColumn(output, F.col(output).withField("encoding", display_name(F.col(f"{output}.encoding"), options)))


def column(content: Column, options: DetectOptions | None = None) -> Column:
    """Detection as one column expression, for use where a DataFrame isn't at hand (every row goes through Arrow)."""
    return _whole_udf(options or DetectOptions())(content)


def _whole_udf(options: DetectOptions):
    @F.pandas_udf(S.RESULT)
    def whole(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        models = _standard_models()
        for contents in batches:
            out = [None if c is None else _displayed(residual.detect_all(bytes(c), options, models)[0], options) for c in contents]
            # A struct can't be null here, so all of a null's fields are.
            yield pd.DataFrame([o or dict.fromkeys(("encoding", "confidence", "language", "mime_type")) for o in out], columns=["encoding", "confidence", "language", "mime_type"])

    return whole


def register(spark: SparkSession, name: str = "detect_encoding", options: DetectOptions | None = None) -> None:
    """Makes detection a SQL function: ``SELECT detect_encoding(content).encoding``."""
    spark.udf.register(name, _whole_udf(options or DetectOptions()))


def above_threshold(found: Column, minimum: float | None = None, ignore: bool = False) -> Column:
    """The results of a list that reach a threshold: above 0.20, or from ``minimum`` on; all of them if none does."""
    if ignore and minimum is None:
        return found
    least = F.lit(MINIMUM_THRESHOLD if minimum is None else minimum)
    kept = F.filter(found, lambda f: f["confidence"] > least if minimum is None else f["confidence"] >= least)
    return F.when(F.size(kept) > 0, kept).otherwise(found)


def candidate_log(df: DataFrame, content: str = "content", id_cols: Iterable[str] = ("id",), options: DetectOptions | None = None) -> DataFrame:
    """For debugging: (ids, line) with every candidate of each value, whatever its confidence, in a line of JSON."""
    ids = list(id_cols)
    found = detect_all(df, content, ids, options, ignore_threshold=True)
    listed = found.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("rank", "encoding", "confidence", "language", "mime_type"))).alias("candidates"))
    return listed.select(*ids, F.to_json("candidates").alias("line"))


def detect_all(
    df: DataFrame, content: str = "content", id_cols: Iterable[str] = ("id",), options: DetectOptions | None = None,
    minimum_threshold: float | None = None, ignore_threshold: bool = False, models: Models | None = None,
) -> DataFrame:
    """(ids, rank, encoding, confidence, language, mime_type): every candidate of each row, likeliest first.

    Candidates are kept as ``above_threshold`` says. Null content gives no rows.
    """
    options = options or DetectOptions()
    shared, ids = share(df.sparkSession, models), list(id_cols)

    @F.pandas_udf(f"array<{S.RESULT}>")
    def everything(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        models = shared.value
        for contents in batches:
            out = []
            for content in contents:
                found = [] if content is None else residual.detect_all(bytes(content), options, models)
                out.append([_displayed(f, options) for f in sorted(found, key=lambda f: -f.confidence)])
            yield pd.Series(out)

    listed = df.where(F.col(content).isNotNull()).select(*ids, everything(F.col(content)).alias("__all"))
    listed = listed.withColumn("__all", above_threshold(F.col("__all"), minimum_threshold, ignore_threshold))
    return listed.select(*ids, F.posexplode("__all").alias("pos", "found")).select(*ids, (F.col("pos") + 1).alias("rank"), "found.*")
