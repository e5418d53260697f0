"""Every repeat and split of an evaluation at once, over all genes of the universe.

A prediction belongs to a *source* (the key mean, dose mean or set of nearest drugs that answers a condition), so its genes are held once per (repeat, split, source) and only
where they are not 0; a gene without a row is exactly 0 in predictions and truth alike. Scores count these zeros: sums over the whole universe need the number of its genes only.
Means are over all training conditions of a source, a missing value being 0, as over the dense matrix. Conditions at a dose that was never trained have no answer and no row.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewise.functions import scalars as S
from platewise.session import materialize

RUN = ["repeat", "split"]
MEAN_KEYS = {"global_mean": None, "drug_mean": "drug", "cell_mean": "cell_line"}
MODELS = ["dummy", *MEAN_KEYS, "nearest_chemical"]


def _means(train: DataFrame, values: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(RUN, keys, n) of the training conditions and (RUN, keys, gene_symbol, m) of their genes that are not 0 throughout."""
    sizes = train.groupBy(*RUN, *keys).agg(F.count(F.lit(1)).alias("n"))
    sums = train.select(*RUN, *keys, "condition_id").join(values.filter("y <> 0"), "condition_id").groupBy(*RUN, *keys, "gene_symbol").agg(F.sum(F.col("y").cast("double")).alias("s"))
    return sizes, sums.join(sizes, [*RUN, *keys]).select(*RUN, *keys, "gene_symbol", (F.col("s") / F.col("n")).alias("m"))


def _named(kind: str, keys: Sequence[str]):
    return F.to_json(F.struct(F.lit(kind).alias("kind"), *keys))


#: Values and sources that one task averages.
VALUES, ANSWERS = 1_000_000, 20_000
#: Runs are bits of a condition's words, so a value travels once for all runs.
BITS = 62


def _listed(runs: DataFrame) -> list[tuple]:
    """The repeats and splits; their places number them."""
    return sorted((r[0], r[1]) for r in runs.select(*RUN).distinct().collect())


def _number(listed: Sequence[tuple]):
    """The place of a row's run."""
    return F.coalesce(*[F.when((F.col("repeat") == r) & (F.col("split") == s), F.lit(i)) for i, (r, s) in enumerate(listed)], F.lit(-1))


def _words(listed: Sequence[tuple]):
    """Aggregate: the runs of a group's rows as bits of an array of numbers."""
    bit = lambda r, s, i: F.when((F.col("repeat") == r) & (F.col("split") == s), F.lit(1 << i % BITS).cast("long")).otherwise(F.lit(0).cast("long"))
    parts = [[bit(r, s, i) for i, (r, s) in enumerate(listed) if i // BITS == w] for w in range(max(1, -(-len(listed) // BITS)))]
    one = lambda bits: F.bit_or(bits[0] if len(bits) == 1 else F.greatest(*bits)) if bits else F.max(F.lit(0).cast("long"))
    return F.array(*map(one, parts)).alias("runs")


def _matrix(words: pd.Series) -> np.ndarray:
    return np.concatenate(words.to_numpy()).reshape(len(words), -1) if len(words) else np.zeros((0, 1), dtype=np.int64)


def _in_run(words: np.ndarray, i: int) -> np.ndarray:
    return (words[:, i // BITS] >> (i % BITS)) & 1 == 1 if len(words) else np.zeros(0, dtype=bool)


def _averaged(asked: DataFrame, members: DataFrame, values: DataFrame, listed: Sequence[tuple], block: Sequence[str] | None = None) -> DataFrame:
    """(RUN, source, genes, v) of ``asked`` (RUN, source, groups, n, columns of ``block``): the mean over the ``n`` conditions of each of its groups, averaged over the groups.

    ``members`` (condition_id, group, runs, columns of ``block``) are the training conditions of the groups. A value travels once, with all its runs, and its sums never leave the task. Tasks are by the columns of ``block``;
    without them by gene, every source going to each, so that no group need fit a task: a source then has a row for each."""
    n_v, n_a = values.count(), asked.count()
    n = max(8, -(-n_v // VALUES), -(-n_a // ANSWERS) if block else 1)
    place = lambda *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    at = place(*block) if block else F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    kind = dict(values.dtypes)["gene_symbol"]
    none = lambda kind: F.array().cast(f"array<{kind}>")
    told = asked.select(at.alias("block"), _number(listed).alias("run"), "source", "groups", F.col("n").cast("array<long>").alias("n"), F.lit("").alias("group"), F.lit("0").cast(kind).alias("gene_symbol"), F.lit(0.0).alias("y"), none("long").alias("runs"))
    held = members.join(values.filter("y <> 0"), "condition_id")
    held = held.select((place(*block) if block else place("gene_symbol")).alias("block"), F.lit(-1).alias("run"), F.lit("").alias("source"), none("string").alias("groups"), none("long").alias("n"), "group", "gene_symbol", F.col("y").cast("double").alias("y"), "runs")
    kinds = dict(asked.dtypes)
    schema = f"repeat {kinds['repeat']}, split {kinds['split']}, source string, genes array<{kind}>, v array<float>"
    return told.unionByName(held).repartition(n, "block").groupBy("block").applyInPandas(_means_task(list(listed)), schema)


def _means_task(listed: Sequence[tuple]):
    def task(key, pdf: pd.DataFrame) -> pd.DataFrame:
        asked, held = pdf[pdf["run"] >= 0], pdf[pdf["run"] < 0]
        out = []
        if len(asked) and len(held):
            group, named = pd.factorize(held["group"])
            gene, genes = pd.factorize(held["gene_symbol"], sort=True)
            genes, y, words = np.asarray(genes), held["y"].to_numpy(), _matrix(held["runs"])
            cell, where = np.unique(group.astype(np.int64) * len(genes) + gene, return_inverse=True)
            owner, gene = cell // len(genes), cell % len(genes)
            start = np.searchsorted(owner, np.arange(len(named) + 1))
            place = {g: i for i, g in enumerate(named)}
            for i, part in asked.groupby("run"):
                own = _in_run(words, i)
                sums = np.bincount(where[own], y[own], len(cell))
                for source, groups, n in zip(part["source"], part["groups"], part["n"]):
                    parts = [(slice(start[k], start[k + 1]), m) for k, m in ((place.get(g), m) for g, m in zip(groups, n)) if k is not None]
                    if not parts:
                        continue
                    if len(parts) == 1:
                        codes, p = gene[parts[0][0]], sums[parts[0][0]] / parts[0][1]
                    else:
                        codes, at = np.unique(np.concatenate([gene[x] for x, _ in parts]), return_inverse=True)
                        p = np.bincount(at, np.concatenate([sums[x] / m for x, m in parts]), len(codes))
                    p = (p / len(groups)).astype(np.float32)
                    there = p != 0
                    if there.any():
                        out.append((*listed[i], source, genes[codes[there]], p[there]))
        return pd.DataFrame(out, columns=[*RUN, "source", "genes", "v"])

    return task


def predict(model: str, runs: DataFrame, values: DataFrame, similarity: DataFrame | None = None, pack: bool = False) -> tuple[DataFrame, DataFrame]:
    """Answers of ``model`` for the test conditions: (RUN, condition_id, cell_line, source, is_fallback) and (RUN, source, gene_symbol, predicted), without zeros; with ``pack`` as :func:`packed`.

    ``runs`` (repeat, split, condition_id, cell_line, drug, dose, part) has the conditions of every repeat and split, ``values`` (condition_id, gene_symbol, y) the truth that is not 0.
    ``similarity`` is (drug, other, similarity) or :func:`features.text_units` of the drugs. Only sources that answer a test condition are computed."""
    runs = runs.withColumn("dose", F.round("dose", 6))
    listed = _listed(runs)
    train, test = runs.filter("part <> 'test'"), runs.filter("part = 'test'")
    answered = test.join(train.select(*RUN, "dose").distinct(), [*RUN, "dose"], "left_semi")
    shown = [*RUN, "condition_id", "cell_line", "source", "is_fallback"]
    if model == "dummy":
        kinds = dict(runs.dtypes)
        nothing = runs.sparkSession.createDataFrame([], f"repeat {kinds['repeat']}, split {kinds['split']}, source string, genes array<{dict(values.dtypes)['gene_symbol']}>, v array<float>")
        told, parts = answered.withColumns({"source": F.lit("zero"), "is_fallback": F.lit(False)}).select(*shown), [nothing]
    elif model == "nearest_chemical":
        told, parts = _nearest(answered, train, values, similarity, shown, listed)
    else:
        key, by_dose, parts = MEAN_KEYS[model], _named("dose", ["dose"]), []
        alone = lambda df: df.select(*RUN, "source", F.array("source").alias("groups"), F.array("n").alias("n")).distinct()
        if key:
            known = train.groupBy(*RUN, key, "dose").agg(F.count(F.lit(1)).alias("n"))
            told = answered.join(known, [*RUN, key, "dose"], "left").withColumns({"source": F.when(F.col("n").isNotNull(), _named(key, [key, "dose"])).otherwise(by_dose), "is_fallback": F.col("n").isNull()})
            told = materialize(told, "answers")
            by_key = told.filter("not is_fallback")
            group = train.filter(F.col(key).isNotNull() & F.col("dose").isNotNull()).withColumn("group", _named(key, [key, "dose"])).groupBy("condition_id", "group").agg(_words(listed))
            group = group.join(by_key.select(F.col("source").alias("group")).distinct(), "group", "left_semi")
            parts = [_averaged(alone(by_key), group.withColumn("source", F.col("group")), values, listed, ["source"])]
        else:
            told = answered.withColumns({"source": by_dose, "is_fallback": F.lit(False)})
        lone = told.filter("is_fallback").drop("n") if key else told
        n = train.groupBy(*RUN, "dose").agg(F.count(F.lit(1)).alias("n"))
        doses = materialize(alone(lone.select(*RUN, "dose", "source").distinct().join(n, [*RUN, "dose"])), "dose-answers")
        group = train.filter("dose is not null").withColumn("group", by_dose).groupBy("condition_id", "group").agg(_words(listed)).join(doses.select(F.col("source").alias("group")).distinct(), "group", "left_semi")
        parts.append(_averaged(doses, group, values, listed))
        told = told.select(*shown)
    parts = parts if pack else [x.select(*RUN, "source", F.inline(F.arrays_zip(F.col("genes").alias("gene_symbol"), F.col("v").alias("predicted")))) for x in parts]
    return told, parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _closest_of_pairs(asked: DataFrame, train: DataFrame, at: list[str], similarity: DataFrame) -> DataFrame:
    """(RUN, at, drug, other, tied): the training drugs of the same ``at`` most similar to each asked one."""
    pool = train.select(*RUN, *at, F.col("drug").alias("other")).distinct()
    pairs = asked.join(pool, [*RUN, *at]).join(similarity, ["drug", "other"])
    one = Window.partitionBy(*RUN, *at, "drug")
    top = pairs.withColumn("top", F.max("similarity").over(one)).filter("similarity = top")
    return top.select(*RUN, *at, "drug", "other", F.count(F.lit(1)).over(one).alias("tied"))


#: Asked drugs that one task compares with all drugs of their dose, and pairs held at once.
ASKED, PAIRS = 500, 1_000_000


def _closest_of_units(asked: DataFrame, train: DataFrame, at: list[str], units: DataFrame) -> DataFrame:
    """:func:`_closest_of_pairs` from ``units`` (drug, units): a drug and another are compared once for all runs, and only where they meet; pairs that are not the best never leave the task."""
    kinds, run = dict(asked.dtypes), F.concat_ws("|", *RUN)
    gathered = lambda df, name: df.groupBy(*at, "drug").agg(F.collect_set(run).alias(name)).join(units, "drug")
    n = 1 if "cell_line" in at else max(2, -(-units.count() // ASKED))
    block = F.pmod(F.xxhash64("drug"), F.lit(n)).cast("int").alias("block")
    nothing = F.lit(None).cast("array<string>")
    rows = gathered(asked, "asked").select(*at, "drug", "units", "asked", nothing.alias("pool"), block).unionByName(
        gathered(train, "pool").select(*at, "drug", "units", nothing.alias("asked"), "pool", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"))
    )
    schema = ", ".join(f"{c} {kinds[c]}" for c in at) + ", run string, drug string, other string, tied long"
    found = rows.groupBy(*at, "block").applyInPandas(_closest_task(at), schema)
    cut = F.split("run", "[|]", 2)
    return found.select(cut[0].cast(kinds["repeat"]).alias("repeat"), cut[1].alias("split"), *at, "drug", "other", "tied")


def _closest_task(at: list[str]):
    def matrix(units, codes):
        m = np.zeros((len(units), len(codes)), dtype=np.float32)
        for i, u in enumerate(units):
            m[i, [codes[x] for x in u if x in codes]] = 1
        return m, np.array([len(u) for u in units], dtype=np.float64)

    def task(key, pdf: pd.DataFrame) -> pd.DataFrame:
        asked, pool = pdf[pdf["asked"].notna()], pdf[pdf["pool"].notna()]
        out = []
        if len(asked) and len(pool):
            codes = {u: i for i, u in enumerate(sorted({u for units in pool["units"] for u in units}))}
            them, sizes = matrix(pool["units"], codes)
            others, runs = pool["drug"].to_numpy(), {}
            for i, held in enumerate(pool["pool"]):
                for r in held:
                    runs.setdefault(r, []).append(i)
            runs = {r: np.array(i) for r, i in runs.items()}
            step = max(1, PAIRS // len(pool))
            for start in range(0, len(asked), step):
                some = asked.iloc[start : start + step]
                mine, own = matrix(some["units"], codes)
                low = (mine @ them.T).astype(np.float64)
                similar = low / (own[:, None] + sizes - low)
                for drug, wanted, row in zip(some["drug"], some["asked"], similar):
                    for r in wanted:
                        have = runs.get(r)
                        if have is None:
                            continue
                        s = row[have]
                        top = s.max()
                        if top > 0:
                            best = have[s == top]
                            out += [(*key[: len(at)], r, drug, others[i], len(best)) for i in best]
        return pd.DataFrame(out, columns=[*at, "run", "drug", "other", "tied"])

    return task


def _nearest(answered: DataFrame, train: DataFrame, values: DataFrame, similarity: DataFrame, shown: list[str], listed: Sequence[tuple]) -> tuple[DataFrame, list[DataFrame]]:
    """The most similar training drugs of the same line and dose, ties averaged; else those at the dose over all lines. Without any similar drug the answer is 0."""
    triple = ["cell_line", "drug", "dose"]
    wanted = answered.select(*RUN, *triple).distinct()
    closest = _closest_of_pairs if "other" in similarity.columns else _closest_of_units

    def means(top: DataFrame, at: list[str], block: list[str] | None) -> DataFrame:
        group = lambda name: F.to_json(F.struct(*at, F.col(name).alias("drug")))
        sizes = train.groupBy(*RUN, *at, F.col("drug").alias("other")).agg(F.count(F.lit(1)).alias("n"))
        asked = top.join(sizes, [*RUN, *at, "other"]).groupBy(*RUN, "source", *(block or [])).agg(F.collect_list(F.struct(group("other").alias("group"), "n")).alias("g"))
        asked = materialize(asked.select(*RUN, "source", *(block or []), F.col("g.group").alias("groups"), F.col("g.n").alias("n")), "nearest-asked")
        used = asked.select(F.explode("groups").alias("group")).distinct()
        members = train.withColumn("group", group("drug")).groupBy("condition_id", "group", *(block or [])).agg(_words(listed)).join(used, "group", "left_semi")
        return _averaged(asked, members, values, listed, block)

    at = ["cell_line", "dose"]
    line = materialize(closest(wanted.filter("cell_line is not null"), train.filter("cell_line is not null"), at, similarity).withColumn("source", _named("line", triple)), "nearest-line")
    near = line.select(*RUN, *triple, "source").distinct()
    left = wanted.join(near, [*RUN, *triple], "left_anti")
    top = closest(left.select(*RUN, "drug", "dose").distinct(), train, ["dose"], similarity)
    dose = materialize(left.join(top, [*RUN, "drug", "dose"]).withColumn("source", _named("dose", triple)), "nearest-dose")
    far = dose.select(*RUN, *triple, "source").distinct()
    sources = near.withColumn("is_fallback", F.lit(False)).unionByName(far.withColumn("is_fallback", F.lit(True)))
    # lines of the answered are compared null-safe: a condition without a line has its answer at the dose
    keys = [*RUN, "drug", "dose", F.coalesce("cell_line", F.lit("")).alias("l"), F.col("cell_line").isNull().alias("no_line")]
    told = answered.select("*", *keys[-2:]).join(sources.select(*keys, "source", "is_fallback"), [*RUN, "drug", "dose", "l", "no_line"], "left")
    told = told.withColumns({"source": F.coalesce("source", F.lit("zero")), "is_fallback": F.coalesce("is_fallback", F.lit(True))}).select(*shown)
    return told, [means(line, at, at), means(dose, ["dose"], None)]


def set_scores(told: DataFrame, predicted: DataFrame, values: DataFrame, sets: DataFrame) -> DataFrame:
    """One row per (RUN, condition_id) of ``told`` over its DE genes: n_de_genes, de_pearson (needs two genes), de_mse, sign_accuracy (0 agrees only with 0), de_distance; null without DE genes."""
    truth = sets.select("condition_id", "gene_symbol").join(values.select("condition_id", "gene_symbol", F.col("y").cast("double").alias("y")), ["condition_id", "gene_symbol"], "left")
    rows = told.select(*RUN, "condition_id", "source").join(truth, "condition_id", "left").join(predicted, [*RUN, "source", "gene_symbol"], "left")
    there = F.col("gene_symbol").isNotNull()
    p, y = F.when(there, F.coalesce(F.col("predicted").cast("double"), F.lit(0.0))), F.when(there, F.coalesce("y", F.lit(0.0)))
    n = F.count("gene_symbol")
    return rows.groupBy(*RUN, "condition_id").agg(
        n.cast("int").alias("n_de_genes"), F.when(n > 1, S.pearson(p, y)).alias("de_pearson"), F.avg((p - y) * (p - y)).alias("de_mse"),
        F.avg((F.signum(p) == F.signum(y)).cast("double")).alias("sign_accuracy"), F.sqrt(F.sum((p - y) * (p - y))).alias("de_distance"),
    )


def coded(genes: DataFrame, *frames: DataFrame) -> list[DataFrame]:
    """``genes`` and ``frames`` with numbers instead of gene symbols, in the order of the symbols; genes outside ``genes`` have no row left."""
    names = materialize(genes.select("gene_symbol").distinct().orderBy("gene_symbol").withColumn("code", F.monotonically_increasing_id()), "harness-genes")
    many = {r[0]: r[1] for r in names.groupBy(F.shiftright("code", 33)).count().collect()}
    before = F.array(*[F.lit(sum(n for q, n in many.items() if q < p)) for p in range(max(many, default=0) + 1)])
    names = names.withColumn("code", (before[F.shiftright("code", 33).cast("int")] + F.col("code").bitwiseAND(F.lit((1 << 33) - 1))).cast("int"))
    named = lambda df: df.join(names, "gene_symbol").withColumn("gene_symbol", F.col("code")).drop("code")
    return [names.select(F.col("code").alias("gene_symbol")), *map(named, frames)]


def packed(predicted: DataFrame) -> DataFrame:
    """One row per (RUN, source) with its genes in order and their predictions."""
    both = F.sort_array(F.collect_list(F.struct("gene_symbol", "predicted")))
    return predicted.groupBy(*RUN, "source").agg(both.alias("b")).select(*RUN, "source", F.col("b.gene_symbol").alias("genes"), F.col("b.predicted").cast("array<float>").alias("v"))


#: Sources and truths of a run that one task compares; blocks of sources beyond the first send the run's truths once more, blocks of truths its sources.
SOURCES, TRUTHS = 50_000, 50_000
DISC = ["closer_global", "ties_global", "others_global", "closer_line", "ties_line", "others_line"]
#: Genes of a run's union that travel in one row.
GENES = 100_000


def score(told: DataFrame, predicted: DataFrame, values: DataFrame, sets: DataFrame, genes: DataFrame, topk: Sequence[int] = (50, 100), places: int = 9, blocks: tuple[int, int] = (SOURCES, TRUTHS)) -> DataFrame:
    """One row per (repeat, split, condition_id) of ``told``: n_de_genes, de_pearson, de_mse, sign_accuracy, all_gene_pearson, topk_overlap_k, de_distance, disc_rank and disc_top1 (global, within_line).

    ``values`` and ``sets`` (condition_id, gene_symbol, rank) hold genes of ``genes`` (gene_symbol) only. Without DE genes the scores over them are null; discrimination is over the genes that are DE in
    a test condition of the same repeat and split, with correlations rounded to ``places`` so that equal ones tie. It is null where there is no other candidate.

    Where ``told`` and ``predicted`` have a column ``model`` all models are scored at once and the result has it too; the truths are sent once for all.

    A source meets the truths of its run in blocks (``blocks``: sources and truths of a task) and leaves counts only, so no pair of a source and a condition is ever written. A condition's own truth is looked up among
    the truths it meets there and is sent with it to other blocks only."""
    if dict(genes.dtypes)["gene_symbol"] == "string":
        genes, values, sets, predicted = coded(genes, values, sets, predicted)  # predictions not packed yet
    by_model = "model" in told.columns
    if by_model:  # from here on the model is a part of the source
        name = F.concat_ws("|", "model", "source")
        told, predicted = told.withColumn("source", name).drop("model"), predicted.withColumn("source", name).drop("model")
    told, predicted = materialize(told, "harness-told"), materialize(predicted if "genes" in predicted.columns else packed(predicted), "harness-predicted")
    n_genes = genes.select(F.countDistinct("gene_symbol")).first()[0]
    first = [r[0] for r in genes.orderBy("gene_symbol").limit(2 * max(topk)).collect()]
    listed = _listed(told)
    most = told.groupBy(*RUN).agg(F.countDistinct("source").alias("sources"), F.countDistinct("condition_id").alias("truths")).agg(F.max("sources"), F.max("truths")).first()
    n_s, n_t = (max(1, -(-(most[i] or 0) // blocks[i])) for i in (0, 1))
    truth = values.select("condition_id", "gene_symbol", F.col("y").cast("double").alias("y"), F.lit(None).cast("int").alias("rank")).unionByName(sets.select("condition_id", "gene_symbol", F.lit(None).cast("double").alias("y"), F.col("rank").cast("int").alias("rank")))
    truth = truth.repartition("condition_id").groupBy("condition_id", "gene_symbol").agg(F.max("y").alias("y"), F.max("rank").alias("rank"))  # one shuffle for all that follows
    both = F.sort_array(F.collect_list(F.struct("gene_symbol", F.coalesce("y", F.lit(0.0)).alias("y"), F.coalesce("rank", F.lit(0)).alias("rank"))))
    truth = truth.groupBy("condition_id").agg(both.alias("b")).select("condition_id", F.col("b.gene_symbol").alias("genes"), F.col("b.y").alias("v"), F.col("b.rank").alias("rank"))
    candidates = materialize(told.groupBy("condition_id", "cell_line").agg(_words(listed)).join(truth, "condition_id", "left"), "harness-truth")
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def rows(kind: str, df: DataFrame, s, t) -> DataFrame:
        have = lambda c, t: F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c)
        kinds = {"source": "string", "condition_id": "string", "cell_line": "string", "is_fallback": "boolean", "genes": "array<int>", "p": "array<float>", "v": "array<double>", "rank": "array<int>"}
        return df.select((F.col("run") if "run" in df.columns else number).alias("run"), s.alias("s"), *[have(c, t) for c, t in kinds.items()]).select("*", t.alias("t")).withColumn("kind", F.lit(kind))

    own, home, number = block("source", n_s), block("condition_id", n_t), _number(listed)
    of_run = lambda words: F.filter(F.array(*map(F.lit, range(len(listed)))).cast("array<int>"), lambda i: F.getbit(F.element_at(words, (F.floor(i / BITS) + 1).cast("int")), F.pmod(i, F.lit(BITS))) == 1)
    each = candidates.select("*", F.explode(of_run(F.col("runs"))).alias("run"))
    sent = [rows("source", predicted.withColumnRenamed("v", "p"), own, every(n_t)), rows("told", told, own, home), rows("truth", each, every(n_s), home)]
    if n_t > 1:  # elsewhere a condition brings its own truth along, and the genes that are DE in a run are those of all blocks
        away = told.join(candidates.select("condition_id", "genes", "v").distinct(), "condition_id", "left")
        sent.append(rows("told", away, own, every(n_t)).filter(F.col("t") != home))
        bits = [F.bit_or(F.col("runs")[w]) for w in range(max(1, -(-len(listed) // BITS)))]
        union = candidates.select("runs", F.explode(F.filter(F.arrays_zip("genes", "rank"), lambda x: x["rank"] > 0)["genes"]).alias("g")).groupBy("g").agg(F.array(*bits).alias("runs"))
        union = union.select("g", F.explode(of_run(F.col("runs"))).alias("run")).groupBy("run", F.floor(F.col("g") / GENES)).agg(F.collect_list("g").alias("genes"))
        sent.append(rows("union", union, every(n_s), every(n_t)))
    tagged = sent[0]
    for more in sent[1:]:
        tagged = tagged.unionByName(more)
    kinds = dict(told.dtypes)
    numbers = ["de_pearson", "de_mse", "sign_accuracy", "all_gene_pearson", *[f"topk_overlap_{k}" for k in topk], "de_distance"]
    schema = f"repeat {kinds['repeat']}, split string, condition_id string, source string, is_fallback boolean, n_de_genes int, " + ", ".join(f"{c} double" for c in numbers) + ", " + ", ".join(f"{c} long" for c in DISC)
    bundles = tagged.mapInArrow(_bundle, "run int, s int, t int, rows binary").repartition(max(1, len(listed)) * n_s * n_t, "run", "s", "t")
    counted = bundles.groupBy("run", "s", "t").applyInPandas(_unbundled(_block_scores(list(topk), places, n_genes, first, listed, n_t > 1)), schema)
    if n_t > 1:
        counted = counted.groupBy(*RUN, "condition_id", "source").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("is_fallback", "n_de_genes", *numbers)], *[F.sum(c).alias(c) for c in DISC])
    for name, at in (("global", "global"), ("within_line", "line")):
        some, closer, ties = F.col(f"others_{at}") > 0, F.col(f"closer_{at}"), F.col(f"ties_{at}")
        counted = counted.withColumns({f"disc_rank_{name}": F.when(some, (closer + ties * 0.5) / F.col(f"others_{at}")), f"disc_top1_{name}": F.when(some, ((closer == 0) & (ties == 0)).cast("double"))})
    if by_model:
        counted = counted.withColumn("model", F.substring_index("source", "|", 1))
    return counted.drop("source", *DISC)


def _bundle(batches):
    """Rows for the same task (run, s, t) of a batch as one row of compressed columns: arrays of many rows side by side take about half the room that they take row by row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("run", "s", "t")])
        order = np.lexsort(keys[::-1])
        batch, keys = batch.take(pa.array(order)), keys[:, order]
        start = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1])
        made = []
        for a, b in zip(start, [*start[1:], batch.num_rows]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_batch(batch.slice(a, b - a))
            made.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([*(pa.array(k[start].astype(np.int32)) for k in keys), pa.array(made, pa.binary())], names=["run", "s", "t", "rows"])


def _unbundled(task):
    def opened(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return task(key, pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in pdf["rows"]]).to_pandas())

    return opened


def _centred(squares, total, n):
    """Sum of squared deviations; what only rounding leaves of a constant is 0."""
    left = squares - total * total / n
    return np.where(left > squares * 1e-12, left, 0.0)


def _at(have, asked):
    """For every gene of ``asked`` its place in the ordered ``have``, and whether it is there."""
    if not len(have):
        return np.zeros(len(asked), dtype=np.int64), np.zeros(len(asked), dtype=bool)
    k = np.minimum(np.searchsorted(have, asked), len(have) - 1)
    return k, have[k] == asked


def _block_scores(topk: Sequence[int], places: int, n_genes: int, first: Sequence[int], listed: Sequence[tuple], several: bool):
    """The task of :func:`score`: sources of a block with the conditions they answer, against the truths of a block. ``several``: there are more blocks of truths."""
    most, g, first = max(topk), float(n_genes), np.asarray(first, dtype=np.int64)
    empty = np.zeros(0)
    ints = lambda x: np.asarray(x if x is not None else empty, dtype=np.int64)
    floats = lambda x: np.asarray(x if x is not None else empty, dtype=np.float64)

    def own_scores(genes, y, rank, sg, sv, whole, places_of):
        """n_de_genes to de_distance of one condition; ``whole``: sums of its source, ``places_of``: its first genes by size, with their places."""
        tp, tpp, constant = whole
        k, there = _at(sg, genes)
        p = np.where(there, sv[k], 0.0) if len(sg) else np.zeros(len(genes))
        ty, spread, deviation = y.sum(), _centred(tpp, tp, g), _centred((y * y).sum(), y.sum(), g)
        r = float(((p * y).sum() - tp * ty / g) / np.sqrt(spread * deviation)) if spread > 0 and deviation > 0 else 0.0
        de = rank > 0
        n = int(de.sum())
        if not n:
            return [0, None, None, None, r, *[None] * len(topk), None]
        a, b, places_rank = p[de], y[de], rank[de]
        off = ((a - b) ** 2).sum()
        pearson = None
        if n > 1:
            x, z = a - a.mean(), b - b.mean()
            pearson = 0.0 if a.min() == a.max() or b.min() == b.max() else float((x * z).sum() / np.sqrt((x * x).sum() * (z * z).sum()))
        k, there = _at(places_of[0], genes[de])
        meets = np.maximum(places_rank, places_of[1][k])[there]
        overlaps = []
        for size in (min(n, k) for k in topk):
            both = int((meets <= size).sum())
            overlaps.append(0.0 if constant else both / (2 * size - both))
        return [n, pearson, float(off / n), float((np.sign(a) == np.sign(b)).mean()), r, *overlaps, float(np.sqrt(off))]

    def joined(parts, ints_or_floats):
        return np.concatenate([ints_or_floats(x) for x in parts] or [ints_or_floats(None)])

    def block(key, pdf: pd.DataFrame) -> pd.DataFrame:
        of = {kind: part for kind, part in pdf.groupby("kind", sort=False)}
        nothing = pdf.iloc[:0]
        t, told, sources, unions = (of.get(kind, nothing) for kind in ("truth", "told", "source", "union"))
        line, names = pd.factorize(t["cell_line"], use_na_sentinel=False)
        line_of = {None if pd.isna(x) else x: i for i, x in enumerate(names)}
        order = np.argsort(line, kind="stable")
        t, line = t.iloc[order], line[order]
        n_t, edges = len(t), np.searchsorted(line, np.arange(len(names) + 1))
        place = {c: i for i, c in enumerate(t["condition_id"])}
        many = np.array([0 if x is None else len(x) for x in t["genes"]], dtype=np.int64)
        cuts = np.concatenate([[0], np.cumsum(many)]).astype(np.int64)
        k_all, y_all, rank_all, owner = joined(t["genes"], ints), joined(t["v"], floats), joined(t["rank"], ints), np.repeat(np.arange(n_t), many)
        union = np.sort(joined(unions["genes"], ints)) if several else np.unique(k_all[rank_all > 0])
        n = float(max(1, len(union)))

        def within(genes, v):
            k, there = _at(union, genes)
            return k[there], v[there]

        k, there = _at(union, k_all)
        k, y, owner = k[there], y_all[there], owner[there]
        ty, tyy = np.bincount(owner, y, n_t), np.bincount(owner, y * y, n_t)
        b = _centred(tyy, ty, n)
        order = np.argsort(k, kind="stable")
        owner, y, start = owner[order], y[order], np.searchsorted(k[order], np.arange(len(union) + 1))

        def rounded(dot, tp, ty, a, b):
            ok = (a > 0) & (b > 0)
            return np.rint(np.where(ok, (dot - tp * ty / n) / np.sqrt(np.where(ok, a * b, 1.0)), 0.0) * 10.0**places)

        held, out = {}, []
        for source, part in zip(sources["source"], zip(sources["genes"], sources["p"])):
            held.setdefault(source, []).append(part)
        for source, rows in told.groupby("source", sort=False):
            parts = held.get(source, [])
            sg, sv = joined([x for x, _ in parts], ints), joined([x for _, x in parts], floats)
            if len(parts) > 1:
                order = np.argsort(sg)
                sg, sv = sg[order], sv[order]
            size = np.abs(sv)
            constant = not len(sg) or (len(sg) == n_genes and size.max() == size.min())
            top = sg[np.lexsort((sg, -size))[:most]]
            if len(sg) < most:
                top = np.concatenate([top, first[~_at(sg, first)[1]]])[:most]
            by = np.argsort(top)
            whole, places_of = (sv.sum(), (sv * sv).sum(), constant), (top[by], by + 1)
            uk, w = within(sg, sv)
            tp, tpp = w.sum(), (w * w).sum()
            a = _centred(tpp, tp, n)
            begin, many = start[uk], start[uk + 1] - start[uk]
            at = np.repeat(begin - np.concatenate([[0], np.cumsum(many)[:-1]])[: len(many)], many).astype(np.int64) + np.arange(many.sum())
            r = rounded(np.bincount(owner[at], y[at] * np.repeat(w, many), n_t), tp, ty, a, b)
            ordered = np.sort(r) if len(rows) > 8 else None
            for c, of_line, fallback, genes, v in zip(*(rows[c] for c in ("condition_id", "cell_line", "is_fallback", "genes", "v"))):
                j = place.get(c)
                scores = [None] * (6 + len(topk))
                if j is not None:
                    here, own, cut = 1, r[j], slice(cuts[j], cuts[j + 1])
                    scores = own_scores(k_all[cut], y_all[cut], rank_all[cut], sg, sv, whole, places_of)
                else:  # its own truth is in another block
                    gk, gv = within(ints(genes), floats(v))
                    j, there = _at(uk, gk)
                    dot = (w[j] * gv)[there].sum() if len(uk) else 0.0
                    here, own = 0, rounded(dot, tp, gv.sum(), a, _centred((gv * gv).sum(), gv.sum(), n))
                if ordered is None:
                    found = [int((r > own).sum()), int((r == own).sum()) - here, n_t - here]
                else:
                    low, high = np.searchsorted(ordered, own), np.searchsorted(ordered, own, "right")
                    found = [int(n_t - high), int(high - low) - here, n_t - here]
                i = line_of.get(None if pd.isna(of_line) else of_line)
                same = r[edges[i] : edges[i + 1]] if i is not None else empty
                found += [int((same > own).sum()), int((same == own).sum()) - here, len(same) - here]
                out.append([*listed[int(key[0])], c, source, fallback, *scores, *found])
        named = ["repeat", "split", "condition_id", "source", "is_fallback", "n_de_genes", "de_pearson", "de_mse", "sign_accuracy", "all_gene_pearson", *[f"topk_overlap_{k}" for k in topk], "de_distance", *DISC]
        made = pd.DataFrame(out, columns=named)
        return made.astype({"n_de_genes": "Int32", **{c: "float64" for c in named[6:-6]}, **{c: "int64" for c in DISC}})

    return block
