"""A corpus mixed from sources at target shares of its tokens.

The token table by (source, language, topic) is raked (iterative proportional fitting) to the source targets and to the pool's own language and topic shares, under
the cap on repeats. The fitted weight over the available tokens is a document's expected number of uses; documents are then drawn by sequential
Poisson sampling on these calibrated rates: copy c of a document comes in while (c - 1 + u) / rate stays below its source's cut, with u a hash of the id.
The cut is found exactly from token histograms, so a source hits its share to about one document instead of by chance.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Mapping
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from platewise.functions.text import lower_key, split_key
from platewise.session import materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BINS = 4096
_encodings: dict[str, object] = {}


def _encoding(name: str, table: bytes, pattern: str):
    """The encoding of a vocabulary file's content, built once per Python worker."""
    if name not in _encodings:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in table.splitlines() if line)}
        _encodings[name] = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[name]


def token_count(spark: SparkSession, text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of the whole text in the public vocabulary at ``vocabulary``; 0 for null. Strings of special tokens are ordinary text.

    The file is read where the job is started and sent to the tasks (some hundred KB to a few MB, as vocabularies are), so no worker needs the path."""
    import public_tokenizers

    content = Path(vocabulary).read_bytes()
    held, pattern, name = spark.sparkContext.broadcast(content), public_tokenizers.PATTERN, hashlib.sha1(content).hexdigest()

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        encode = _encoding(name, held.value, pattern).encode_ordinary
        return pd.Series([len(encode(t)) if isinstance(t, str) else 0 for t in texts], dtype="int64")

    return count(text)


def subject_topics(documents: DataFrame, topics: int = 8) -> tuple[list[str], Column]:
    """The ``topics`` most frequent subject words (counted over all documents) and a column with the first of them in a subject, else 'other'."""
    clean = F.regexp_replace(F.lower(F.coalesce(F.col("subject"), F.lit(""))), r"^(?:\s*(?:re|fwd?|aw|wg|tr)\s*:)+", "")
    found = F.array_distinct(F.filter(F.split(clean, r"[^\p{L}]+"), lambda w: F.length(w) > 3))
    top = documents.select(F.explode(found).alias("w")).groupBy("w").count().orderBy(F.desc("count"), "w").limit(topics)
    pivots = [r["w"] for r in top.collect()]
    if not pivots:
        return [], F.lit("other")
    first = F.try_element_at(F.filter(F.array(*map(F.lit, pivots)), lambda w: F.array_contains(found, w)), F.lit(1))
    return pivots, F.coalesce(first, F.lit("other"))


def rake(cells: pd.DataFrame, targets: Mapping[str, float], caps: Mapping[str, int], total: float | None = None, rounds: int = 200) -> pd.DataFrame:
    """``cells`` (source, lang, topic, tokens) with ``rate``: expected uses of a document of the cell.

    Source weights come out exactly (as far as caps allow), language and topic weights as near to the pool's shares as the caps leave them."""
    cells = cells.reset_index(drop=True)
    if cells.empty:
        return cells.assign(weight=0.0, rate=0.0)
    have = cells["tokens"].to_numpy(float)
    cap = cells["source"].map(caps).to_numpy(float)
    pool = cells.groupby("source")["tokens"].sum()
    listed = {s: targets[s] for s in pool.index}
    whole = sum(listed.values())
    wanted = {s: t / whole for s, t in listed.items()}
    if total is None:
        total = min((caps[s] * pool[s] / w for s, w in wanted.items() if w > 0), default=0.0)
    weight = have.copy()
    pools = {k: cells.groupby(k)["tokens"].sum() / have.sum() for k in ("lang", "topic")}
    index = {k: cells.groupby(k).indices for k in ("source", "lang", "topic")}
    for _ in range(rounds):
        before = weight.copy()
        for k in ("lang", "topic"):
            for name, rows in index[k].items():
                if (now := weight[rows].sum()) > 0:
                    weight[rows] *= pools[k][name] * total / now
        for name, rows in index["source"].items():
            weight[rows] = _fill(weight[rows], cap[rows] * have[rows], wanted[name] * total)
        if np.abs(weight - before).max() <= 1e-9 * max(total, 1):
            break
    return cells.assign(weight=weight, rate=np.divide(weight, have, out=np.zeros_like(weight), where=have > 0))


def _fill(weight: np.ndarray, most: np.ndarray, target: float) -> np.ndarray:
    """``weight`` scaled to ``target`` with no entry above ``most``; what a full entry cannot take goes to the others in proportion."""
    target = min(target, most.sum())
    full = np.zeros(len(weight), dtype=bool)
    weight = np.where(weight > 0, weight, 1e-12)
    while True:
        rest = target - most[full].sum()
        scale = rest / weight[~full].sum() if (~full).any() else 0.0
        over = ~full & (weight * scale > most)
        if not over.any():
            return np.where(full, most, weight * scale)
        full |= over


def mix(
    documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, total_tokens: float | None = None, seed: int = 11, topics: int = 8
) -> tuple[DataFrame, DataFrame]:
    """(``doc_id, source, tokens, repeats``) of the documents used, and the report (``source, target_share, max_repeats, tokens_available, tokens, share, documents, most_used``).

    Every listed source is reported: one without documents with 0 tokens. Unlisted sources and null sources are not used. Texts that are null or empty have no tokens and
    are not used. Without ``total_tokens`` the corpus is as large as the caps allow with all present sources at their share (missing sources' shares fall
    to the others in proportion). Copies of a text under other ids are separate documents."""
    spark = documents.sparkSession
    # a source listed twice counts by its smallest entry
    listed = targets.select(split_key("source").alias("source"), "target_share", "max_repeats").filter("source is not null").groupBy("source").agg(F.min(F.struct("target_share", "max_repeats")).alias("t"))
    wanted = listed.select("source", "t.*")
    # the targets are a stated list; they and the raked table (its sources x languages x topics) are what the driver sees
    goals = {r["source"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in wanted.collect()}
    _, topic = subject_topics(documents, topics)
    pool = documents.select(
        "doc_id",
        split_key("source").alias("source"),
        F.coalesce(F.regexp_replace(lower_key("lang"), "[-_].*$", ""), F.lit("?")).alias("lang"),
        topic.alias("topic"),
        token_count(spark, F.col("text"), vocabulary).alias("tokens"),
    )
    usable = wanted.filter("target_share > 0 and max_repeats > 0").select("source")
    pool = materialize(pool, "mixture-pool").filter("tokens > 0").join(F.broadcast(usable), "source", "left_semi")
    cells = pool.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens")).toPandas()
    fitted = rake(cells, {s: t for s, (t, _) in goals.items()}, {s: c for s, (_, c) in goals.items()}, total_tokens)
    rates = spark.createDataFrame([(r.source, r.lang, r.topic, float(r.rate), goals[r.source][1]) for r in fitted.itertuples()], "source string, lang string, topic string, rate double, cap int")
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 40)) + F.lit(0.5)) / F.lit(float(1 << 40))
    rated = pool.join(F.broadcast(rates), ["source", "lang", "topic"]).filter("rate > 0").withColumn("u", u)
    copies = rated.select("source", "tokens", "u", "rate", F.explode(F.sequence(F.lit(0), F.col("cap") - 1)).alias("copy")).select(
        "source", "tokens", ((F.col("copy") + F.col("u")) / F.col("rate")).alias("mark")
    )
    budget = fitted.groupby("source")["weight"].sum().to_dict()
    cuts = _cuts(copies, budget)
    used = (
        rated.join(F.broadcast(spark.createDataFrame(list(cuts.items()), "source string, cut double")), "source")
        .withColumn("repeats", F.least(F.col("cap"), F.greatest(F.lit(0), F.ceil(F.col("cut") * F.col("rate") - F.col("u")).cast("int"))))
        .filter("repeats > 0")
        .select("doc_id", "source", "tokens", "repeats")
    )
    drawn = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("most_used"))
    there = pool.groupBy("source").agg(F.sum("tokens").alias("tokens_available"))
    every = Window.partitionBy(F.lit(1))  # the listed sources
    zero = F.lit(0).cast("long")
    report = (
        wanted.join(there, "source", "left").join(drawn, "source", "left")
        .withColumn("all_tokens", F.sum("tokens").over(every))
        .select(
            "source", "target_share", "max_repeats", F.coalesce("tokens_available", zero).alias("tokens_available"), F.coalesce("tokens", zero).alias("tokens"),
            F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("share"), F.coalesce("documents", zero).alias("documents"), F.coalesce("most_used", F.lit(0)).alias("most_used"),
        )
    )
    return used, report


def _cuts(copies: DataFrame, budget: Mapping[str, float]) -> dict[str, float]:
    """Per source the mark up to which copies are taken so that their tokens come nearest to the budget: two passes of histograms of ``BINS`` bins a source.

    The histograms are summed up along the marks in Spark; one bin a source comes to the driver."""
    spark = copies.sparkSession
    span = {s: (0.0, 4.0, 0.0) for s in budget}  # low, width, tokens below low
    for _ in range(2):
        told = F.broadcast(spark.createDataFrame([(s, lo, w, below, float(budget[s])) for s, (lo, w, below) in span.items()], "source string, lo double, width double, below double, budget double"))
        inside = copies.join(told.select("source", "lo", "width"), "source").filter("mark >= lo and mark < lo + width")
        counted = inside.groupBy("source", F.floor((F.col("mark") - F.col("lo")) / F.col("width") * BINS).cast("int").alias("bin")).agg(F.sum("tokens").alias("tokens"))
        upto = counted.withColumn("upto", F.sum("tokens").over(Window.partitionBy("source").orderBy("bin"))).join(told.select("source", "below", "budget"), "source")
        # the first bin that reaches the budget, else what all bins hold together
        reached = F.min(F.when(F.col("below") + F.col("upto") >= F.col("budget") - 1e-6, F.struct("bin", (F.col("below") + F.col("upto") - F.col("tokens")).alias("before"))))
        found = {r["source"]: r for r in upto.groupBy("source").agg(reached.alias("at"), F.max(F.col("below") + F.col("upto")).alias("all")).collect()}
        new = {}
        for s, (lo, width, _) in span.items():
            if s in found:
                at, step = found[s]["at"], width / BINS
                new[s] = (lo + width, step, float(found[s]["all"])) if at is None else (lo + at["bin"] * step, step, float(at["before"]))
        span = {s: new.get(s, span[s]) for s in span}
    # the last, very narrow bin goes in if that brings the sum nearer to the budget
    tail = F.broadcast(spark.createDataFrame([(s, lo, w) for s, (lo, w, _) in span.items()], "source string, lo double, width double"))
    last = {r["source"]: r["t"] for r in copies.join(tail, "source").filter("mark >= lo and mark < lo + width").groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    return {s: lo + w if abs(below + last.get(s, 0) - budget[s]) < abs(below - budget[s]) else lo for s, (lo, w, below) in span.items()}
