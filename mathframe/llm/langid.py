"""Language of web pages by Bayesian fusion of four kinds of evidence.

*   Text: naive Bayes over hashed byte trigrams, trained from documents with known languages.
    The mean log likelihood counts as ``TEXT_GRAMS`` independent grams at most, since grams aren't.
*   Markup: how often pages of a language declare a language in ``<html lang=...>``.
*   Address suffix: how often pages of a language have a last label such as ``fr``.
*   Host: the languages of other pages of the host, smoothed by those of its domain, these by
    those of all pages.  A page's own share is taken out.

The second to fourth kind are grouped sums of the text posteriors over all pages, so hot hosts are
pre-aggregated before they are shuffled.  Declared languages and country suffixes start
with ``TRUST`` pages in favour of the language that they name.

Training takes at most ``SAMPLE`` documents of each language, chosen by a hash of their ids; more than
``MOST_LANGUAGES`` languages are an error.

Defined results: a page without text has no text evidence, one without (known) declaration, suffix or host no
such evidence; a page without any has the overall prior.  Ties go to the language that sorts first.
Rows stay, repeated ones too; texts are taken whole; columns of ``pages`` other than the three that are named don't
matter, whatever their names.  Without training languages language and probability are null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowmap import append_columns, quoted
from .bytetext import LOWER, NOT_ALNUM, pieces
from .shipping import ship_package
from .storage import Scratch

BUCKET_BITS = 16
SAMPLE = 1000
#: Tasks that read the sample at most.
SAMPLE_TASKS = 8
MOST_LANGUAGES = 400
TEXT_GRAMS = 40.0
TRUST = 20.0
#: Pages that a domain's, or all pages', shares count as for a host.
SMOOTH = 5.0

# Languages that country suffixes name.
SUFFIX_LANGUAGES = {"at": "de", "br": "pt", "cn": "zh", "de": "de", "es": "es", "fr": "fr", "it": "it", "jp": "ja", "mx": "es", "nl": "nl", "pl": "pl", "pt": "pt", "ru": "ru", "uk": "en", "us": "en"}

_TAGS = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[^>]*>|&[a-z0-9#]{1,10};"


def visible_text(html: Column) -> Column:
    return F.regexp_replace(html, _TAGS, " ")


def declared_language(html: Column) -> Column:
    """Primary subtag of the html element's lang, or empty."""
    return F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})\b""", 1))


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)


def _grams(column: pa.Array):
    """(bucket, row) of the byte trigrams of each piece; marks count as blanks."""
    for piece in pieces(column, NOT_ALNUM):
        data = LOWER[piece.data]
        data = np.where(NOT_ALNUM[data] | ((data >= 0x30) & (data <= 0x39)), 0x20, data).astype(np.uint32)
        n = max(0, len(data) - 2)
        code = (data[:n] << 16) | (data[1 : n + 1] << 8) | data[2 : n + 2]
        row = piece.rows[np.searchsorted(piece.offsets, np.arange(n), side="right") - 1]
        last = piece.rows[np.searchsorted(piece.offsets, np.arange(2, n + 2), side="right") - 1]
        used = (row == last) & ~((data[:n] == 0x20) & (data[1 : n + 1] == 0x20))
        yield ((code[used] * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64), row[used]


def _sampled(known: DataFrame, most: int, counts: dict[str, int]) -> DataFrame:
    """At most ``most`` rows (lang, text) of each language, those with the least hashes of their ids.

    Rows are first thinned by their hash to about twice as many as are wanted, so that no language is sorted whole.
    """
    scale = 1 << 30
    spark = known.sparkSession
    limits = spark.createDataFrame([(lang, min(scale, 2 * scale * most // n + 1)) for lang, n in counts.items()], "lang string, upto long")
    hashed = known.withColumn("hash", F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(scale)))
    thin = hashed.join(F.broadcast(limits), "lang").where("hash < upto")
    rank = F.row_number().over(W.partitionBy("lang").orderBy("hash", "id", F.xxhash64("text")))
    return thin.withColumn("rank", rank).where(F.col("rank") <= most).select("lang", "text")


def train_text(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and log likelihoods (bucket, language)."""
    known = docs.select(quoted(id_column).alias("id"), quoted(lang_column).cast("string").alias("lang"), quoted(text_column).alias("text")).where("lang is not null")
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(counts)
    table = np.zeros((1 << BUCKET_BITS, len(languages)))
    if not languages:
        return languages, table
    ship_package(docs.sparkSession)

    def run(batches):
        for batch in batches:
            names, out = batch.column(0).to_pylist(), []
            for lang in sorted(set(names)):
                total = np.zeros(1 << BUCKET_BITS, np.int64)
                for bucket, _ in _grams(batch.column(1).filter(pa.array([x == lang for x in names]))):
                    total += np.bincount(bucket, minlength=len(total))
                used = np.flatnonzero(total)
                out.append((lang, used.astype(np.int32).tobytes(), total[used].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), *(pa.array([x[i] for x in out], pa.binary()) for i in (1, 2))], names=["lang", "bucket", "seen"])

    # The sample is bounded, so a few tasks are enough, and what they send to the driver is bounded, too.
    found = _sampled(known, sample, counts).coalesce(SAMPLE_TASKS).mapInArrow(run, "lang string, bucket binary, seen binary")
    for r in found.toLocalIterator():
        table[np.frombuffer(r.bucket, np.int32), languages.index(r.lang)] += np.frombuffer(r.seen, np.int64)
    return languages, np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * len(table)))


def _text_scores(column: pa.Array, table: np.ndarray) -> np.ndarray:
    """Mean log likelihood of each text's grams, times the grams it counts as."""
    n, k = len(column), table.shape[1]
    total, count = np.zeros((n, k)), np.zeros(n)
    for bucket, row in _grams(column):
        if not len(row):
            continue
        edges = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        total[row[edges]] += np.add.reduceat(table[bucket], edges, axis=0)
        count += np.bincount(row, minlength=n)
    return total / np.maximum(1, count)[:, None] * np.minimum(count, TEXT_GRAMS)[:, None]


def _softmax(logs: np.ndarray) -> np.ndarray:
    powers = np.exp(logs - logs.max(axis=1, keepdims=True))
    return powers / powers.sum(axis=1, keepdims=True)


def _lists(values: np.ndarray) -> pa.Array:
    """Rows as lists of doubles."""
    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(values.ravel(), pa.float64()))


def _matrix(column: pa.Array, k: int) -> np.ndarray:
    """Lists of ``k`` doubles as rows; a null gives zeros."""
    out = np.zeros((len(column), k))
    given = column.is_valid()
    out[given.to_numpy(zero_copy_only=False)] = column.filter(given).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
    return out


def identify(pages: DataFrame, docs: DataFrame, *, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", **training) -> DataFrame:
    """One row for each page: its id, language, probability, declared and host."""
    spark = pages.sparkSession
    languages, table = train_text(docs, **training)
    count = len(languages)
    url, html = quoted(url_column), quoted(html_column)
    base = pages.select(quoted(id_column).alias("id"), host_of(url).alias("host"), declared_language(html).alias("declared"), visible_text(html).alias("text"))
    if not count:
        return base.select(F.col("id").alias(id_column), F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("probability"), "declared", "host")
    shared = spark.sparkContext.broadcast(table)

    def make():
        table = shared.value

        def run(column: pa.Array) -> list[pa.Array]:
            score = _text_scores(column, table)
            return [_lists(score), _lists(_softmax(score))]

        return run

    numbers = T.ArrayType(T.DoubleType())
    scored = append_columns(base, "text", [T.StructField("score", numbers), T.StructField("post", numbers)], make).drop("text")
    labels = F.split("host", r"\.")
    named = F.size(labels) > 1
    scored = scored.withColumns({"suffix": F.when(named, F.element_at(labels, -1)).otherwise(""), "domain": F.when(named, F.concat_ws(".", F.slice(labels, -2, 2))).otherwise(F.col("host"))})
    scratch = Scratch(spark)
    scored = scratch.write(scored, "scores")

    sums = lambda: F.array(*(F.sum(F.get("post", k)) for k in range(count)))
    summed = lambda key: scored.where(F.col(key) != "").groupBy(key).agg(sums().alias(f"{key}_sums"))
    overall = scored.agg(sums().alias("sums")).first().sums
    prior = np.array([x or 0.0 for x in overall], float) + 1.0
    prior /= prior.sum()
    joined = scored
    for key in ("host", "domain"):
        joined = joined.join(scratch.write(summed(key), f"{key}s"), key, "left")
    for key, target in (("declared", {x: x for x in languages}), ("suffix", SUFFIX_LANGUAGES)):
        joined = joined.join(scratch.write(_likelihoods(summed(key), key, target, languages), f"{key}-logs"), key, "left")
    joined = joined.select("id", "declared", "host", "score", "post", "host_sums", "domain_sums", "declared_logs", "suffix_logs")
    schema = T.StructType([joined.schema["id"], T.StructField("language", T.StringType()), T.StructField("probability", T.DoubleType()), joined.schema["declared"], joined.schema["host"]])

    def fuse(batches):
        for batch in batches:
            of = lambda name: _matrix(batch.column(name), count)
            post, shares = of("post"), prior[None, :]
            for level in ("domain_sums", "host_sums"):  # shares of the other pages, smoothed by the level above
                others = np.maximum(of(level) - post, 0.0)
                shares = (others + SMOOTH * shares) / (others.sum(axis=1, keepdims=True) + SMOOTH)
            every = _softmax(of("score") + np.log(shares) + of("declared_logs") + of("suffix_logs"))
            best = every.argmax(axis=1)
            found = [pa.array([languages[i] for i in best.tolist()], pa.string()), pa.array(every[np.arange(len(best)), best], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *found, batch.column("declared"), batch.column("host")], names=schema.names)

    return joined.mapInArrow(fuse, schema).withColumnRenamed("id", id_column)


def _likelihoods(sums: DataFrame, key: str, named: dict[str, str], languages: list[str]) -> DataFrame:
    """Log likelihoods of the key's values for each language, up to a constant of the value.

    A value has the log of its smoothed share in each language over its overall share; values
    seen rarely have little say.
    """
    places = [x for value, lang in named.items() if lang in languages for x in (F.lit(value), F.lit(languages.index(lang)))]
    place = F.create_map(*places)[F.col(key)] if places else F.lit(None).cast("int")
    column = F.col(f"{key}_sums")
    total = F.aggregate(column, F.lit(0.0), lambda acc, x: acc + x)
    placed = sums.withColumns({"place": place, "total": total})
    trusted = lambda i: F.when(F.col("place") == i, F.lit(TRUST)).otherwise(F.lit(0.0))
    whole = F.col("total") + F.when(F.col("place").isNotNull(), F.lit(TRUST)).otherwise(F.lit(0.0)) + len(languages)
    return placed.select(key, F.transform(f"{key}_sums", lambda x, i: F.log((x + trusted(i) + 1.0) / whole)).alias(f"{key}_logs"))
