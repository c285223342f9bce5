"""Mixing to target weights by soft membership, in DataFrame functions only.

Classifier. A naive Bayes model over all words and a few binned counts predicts each document's domain posteriors. It is
fitted on ``train_rows`` labelled rows at most (a hash order of the ids picks them), whole texts. A token has a weight if
its presence tells the domains apart beyond chance: ``information`` is half of the likelihood-ratio statistic, 7 is a
chance of 0.001 with three domains. No other bound picks tokens. Smoothing and temperature are those with the least log
loss on half of the labelled rows, for a model of the other half; the model is then fitted on all of them. Tokens are
known by 64-bit hashes. A text's tokens meet their weights in a broadcast join and are added up where the text lies;
copies of a text are scored together.

Rates. The rates of documents minimize the squared difference between the expected domain totals and the targets,
relative to the present totals, plus ``ridge`` times the squared distance of the rates from one, and are nonnegative. The
solution is max(0, 1 - p.y) for a document of posteriors p, with one number of y for each domain. Projected steps find
it: every step takes the projection and the gradient at every document and adds them up, one aggregation, and a few
numbers go to the driver, which scales the step by Newton's matrix. The first steps run on cells of documents whose
posteriors agree to ``GRID``-ths, which are few; the last ones on the documents themselves, until no domain is off the
solution by more than ``tolerance`` times its target.

A rate r gives floor(r + u) copies, u in [0, 1) from the id's hash: the same in every run.

Defined cases: null text has no tokens and the posteriors of a text without words; rows of one id get the same u; a
null id is hashed as null; labels of unknown documents and null labels are ignored; without labels all domains are
equally likely; an empty table gives none; texts of any length are whole; other columns pass through, and an output name
that is among them is refused.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .scratch import Scratch, columns_of, refuse_clash
from .text import words

#: Rates of texts that may be broadcast, in bytes; beyond it they are joined by a shuffle.
BROADCAST_BYTES = 8 << 20
#: The grain of the cells on which the solver starts.
GRID = 32
#: Names of the columns that ``mix_rates`` adds.
ADDED = ("mix_tokens", "mix_share", "mix_rate", "mix_copies")


@dataclass(frozen=True)
class Mix:
    """Target shares by domain, and the bounds of the classifier and of the solver."""

    targets: dict[str, float] = field(default_factory=lambda: {"clean": 0.90, "junk": 0.08, "toxic": 0.02})
    train_rows: int = 20_000
    information: float = 7.0
    smoothing: tuple[float, ...] = (0.1, 0.5, 1.0)
    temperatures: tuple[float, ...] = (1.0, 2.0, 4.0, 8.0, 16.0)
    ridge: float = 1e-7
    steps: int = 100
    tolerance: float = 1e-6

    @property
    def names(self) -> list[str]:
        return sorted(self.targets)


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of a table of quality and toxic marks."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain")).where("doc_id is not null and domain is not null")


def _bin(name: str, x: Column, top: int) -> Column:
    return F.concat(F.lit(f"\x01{name}"), F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(top)).cast("string"))


def tokens_of(text: Column, ws: Column) -> Column:
    """Distinct words, and counted features as words of their own (marked by a character that no word begins with)."""
    n = F.greatest(F.size(ws), F.lit(1))
    x = F.coalesce(text, F.lit(""))
    marks = x
    for c in "#*$%&|<>!":
        marks = F.replace(marks, F.lit(c), F.lit(""))
    bins = [
        _bin("marks", (F.length(x) - F.length(marks)) * 4 / n, 8),
        _bin("length", F.length(x) / n, 12),
        _bin("words", F.log2(n + 1), 12),
        _bin("distinct", F.size(F.array_distinct(ws)) * 10 / n, 10),
    ]
    return F.concat(F.array_distinct(ws), F.array(*bins))


def _numbers(values: Sequence, kind: str) -> Column:
    """An array that the optimizer folds to one constant; one expression for each value would be slow to plan."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>") if len(values) else F.array().cast(f"array<{kind}>")


@dataclass(frozen=True)
class Posterior:
    """Log weights by token hash and domain; as large as the labelled rows' telling tokens are many."""

    names: list[str]
    tokens: list[int]
    weight: list[list[float]]
    base: list[float]
    temperature: float = 1.0


#: A token of every text, by which copies are counted; no word begins with its mark.
_EVERY = "\x01every"


def _logs(rows: DataFrame, by: Sequence[str], models: Sequence[Posterior], work: Scratch) -> DataFrame:
    """``by``, copies, and l0, l1, ...: each model's logs of the posteriors, but for a common summand.

    ``rows`` has a row for each ``by`` and token hash, the hash of ``_EVERY`` among them; rows that are alike in ``by``
    are copies. The weights are a table of the models' tokens, which the labelled rows bound; it is broadcast.
    """
    spark, d = rows.sparkSession, range(len(models[0].names))
    known = sorted({t for m in models for t in m.tokens})
    cols = [_numbers(known, "bigint").alias("token")]
    for i, m in enumerate(models):
        for j in d:
            own = dict(zip(m.tokens, m.weight[j], strict=True))
            cols.append(_numbers([own.get(t, 0.0) for t in known], "double").alias(f"w{i}_{j}"))
    weights = spark.range(1).select(F.inline(F.arrays_zip(*cols)))
    every = spark.range(1).select(F.xxhash64(F.lit(_EVERY)).alias("token"), *[F.lit(0.0).alias(f"w{i}_{j}") for i in range(len(models)) for j in d], F.lit(1).alias("one"))
    weights = work.cut(weights.withColumn("one", F.lit(0)).unionByName(every))
    sums = [F.sum("one").alias("copies"), *[F.sum(f"w{i}_{j}").alias(f"w{i}_{j}") for i in range(len(models)) for j in d]]
    got = rows.join(F.broadcast(weights), "token").groupBy(*by).agg(*sums)
    logs = [F.array(*[F.lit(float(m.base[j])) + F.col(f"w{i}_{j}") / F.col("copies") for j in d]).alias(f"l{i}") for i, m in enumerate(models)]
    return got.select(*by, "copies", *logs)


def softmax(logs: Column, temperature: float) -> Column:
    exps = F.transform(F.array(logs), lambda a: F.transform(a, lambda v: F.exp((v - F.array_max(a)) / F.lit(temperature))))[0]
    return F.transform(F.array(exps), lambda a: F.transform(a, lambda v: v / F.aggregate(a, F.lit(0.0), lambda p, q: p + q)))[0]


def cell_of(share: Column) -> Column:
    """Whole GRID-ths for each domain; they sum to GRID, as cumulated shares are rounded."""
    cum = lambda a, i: F.round(F.aggregate(F.slice(a, 1, i), F.lit(0.0), lambda p, q: p + q) * GRID).cast("int")
    return F.transform(F.array(share), lambda a: F.transform(a, lambda v, i: cum(a, i + 1) - cum(a, i)))[0]


def _information(counts: Sequence[Column], sizes: Sequence[int]) -> Column:
    """Information of a token's presence about the domain, over rows of which ``sizes`` are of each domain."""
    total, every = max(1, sum(sizes)), sum(counts[1:], counts[0])
    info = F.lit(0.0)
    for n, c in zip(sizes, counts, strict=True):
        for seen, margin in ((c, every), (F.lit(float(n)) - c, F.lit(float(total)) - every)):
            info = info + F.when(seen > 0, seen * F.log(seen * F.lit(float(total)) / (margin * F.lit(float(max(1, n)))))).otherwise(0.0)
    return info


def fit_posterior(docs: DataFrame, labelled: DataFrame, mix: Mix, doc_id: str = "doc_id", text: str = "text", work: Scratch | None = None) -> Posterior:
    """A naive Bayes model of the presence of tokens; ``labelled`` has doc_id and domain."""
    work = work or Scratch(docs.sparkSession, "posterior")
    picked = labelled.where(F.col("domain").isin(mix.names)).orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(mix.train_rows)
    x = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("x")).join(F.broadcast(picked), "doc_id")
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).cast("int")
    rows = work.cut(x.select(F.monotonically_increasing_id().alias("row"), "domain", half.alias("half"), tokens_of(F.col("x"), words(F.col("x"))).alias("tokens")))
    many = {(r["domain"], r["half"]): r["n"] for r in rows.groupBy("domain", "half").agg(F.count("*").alias("n")).collect()}
    # The first model, of half the rows, tells how much to smooth; the second is of all.
    sizes = [[many.get((d, 0), 0) for d in mix.names], [many.get((d, 0), 0) + many.get((d, 1), 0) for d in mix.names]]
    place = F.array_position(F.array(*map(F.lit, mix.names)), F.col("domain")).cast("int") - 1
    one = lambda i, h: F.sum(((place == i) & (F.col("half") <= h)).cast("int")).cast("double").alias(f"c{h}{i}")
    per = rows.select("domain", "half", F.explode("tokens").alias("token")).select("domain", "half", F.xxhash64("token").alias("token")).groupBy("token").agg(*[one(i, h) for h in (0, 1) for i in range(len(mix.names))])
    info = [_information([F.col(f"c{h}{i}") for i in range(len(mix.names))], sizes[h]) for h in (0, 1)]
    telling = per.withColumn("told0", info[0] >= mix.information).withColumn("told1", info[1] >= mix.information).where("told0 or told1").orderBy("token").collect()

    def model(h: int, a: float) -> Posterior:
        total, own = sum(sizes[h]), [r for r in telling if r[f"told{h}"]]
        weight: list[list[float]] = [[] for _ in mix.names]
        base = [math.log((n + 1) / (total + len(mix.names))) for n in sizes[h]]
        for i, n in enumerate(sizes[h]):
            for r in own:
                p = (r[f"c{h}{i}"] + a) / (n + 2 * a)
                weight[i].append(math.log(p / (1 - p)))
                base[i] += math.log(1 - p)
        return Posterior(mix.names, [r["token"] for r in own], weight, base)

    held = rows.where("half = 1").select("row", "domain", F.explode(F.array_append("tokens", F.lit(_EVERY))).alias("token"))
    held = _logs(held.select("row", "domain", F.xxhash64("token").alias("token")), ["row", "domain"], [model(0, a) for a in mix.smoothing], work)
    loss = lambda i, t: -F.log(F.greatest(F.get(softmax(F.col(f"l{i}"), t), place), F.lit(1e-12)))
    choices = [(i, a, t) for i, a in enumerate(mix.smoothing) for t in mix.temperatures]
    got = held.agg(*[F.avg(loss(i, t)) for i, _, t in choices]).first()
    best = min(range(len(choices)), key=lambda j: (got[j] if got[j] is not None else 0.0, j))
    work.drop(rows)
    found = model(1, choices[best][1])
    return Posterior(found.names, found.tokens, found.weight, found.base, choices[best][2])


def _rate(p: Column, y: Sequence[float]) -> Column:
    """The rate of a document of these posteriors."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - sum((F.get(p, F.lit(i)) * F.lit(float(v)) for i, v in enumerate(y)), F.lit(0.0)))


def solve_rates(rows: DataFrame, mix: Mix, start: Sequence[float] | None = None, first: Sequence[float] | None = None) -> tuple[list[float], list[float]]:
    """(y, first): the number of each domain that the rates follow from, and the domains' present shares.

    ``rows`` has tokens and p, of documents or of cells. The steps lower the dual, which is convex and quadratic in
    pieces: sum of n x^2 / 2, plus y.target, plus ridge / 2 times the sum of first y^2, for x = max(0, 1 - p.y). A step
    that does not lower it enough is halved.
    """
    d = len(mix.names)
    y = np.zeros(d) if start is None else np.array(start, dtype=float)
    whole = float(rows.agg(F.sum("tokens")).first()[0] or 0)
    goal = sum(mix.targets.values())
    if not whole or not goal:
        return list(y), [0.0] * d
    target = np.array([mix.targets[name] / goal for name in mix.names])
    p = [F.get("p", F.lit(i)) for i in range(d)]
    n = F.col("tokens") / F.lit(whole)
    x = F.col("x")
    live = F.when(x > 0, n).otherwise(0.0)
    sums = [F.sum(n * x * x / 2), *[F.sum(n * x * v) for v in p], *[F.sum(live * p[i] * p[j]) for i in range(d) for j in range(d)]]
    first = None if first is None else np.array(first)

    def at(y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        nonlocal first
        got = np.array([float(v) for v in rows.withColumn("x", _rate(F.col("p"), list(y))).agg(*sums).first()])
        share = got[1 : d + 1]
        first = np.maximum(share, 1e-6) if first is None else first
        pull = mix.ridge * first
        return got[0] + y @ target + pull @ (y * y) / 2, target + pull * y - share, got[d + 1 :].reshape(d, d) + np.diag(pull)

    value, slope, bend = at(y)
    size = 1.0
    step = None
    for _ in range(mix.steps):
        if np.max(np.abs(slope) / np.maximum(target, 1e-6)) <= mix.tolerance:
            break
        step = -np.linalg.solve(bend, slope) if step is None else step
        new = at(y + size * step)
        if new[0] <= value + 1e-4 * size * (slope @ step) + 1e-14 * abs(value):
            y, (value, slope, bend), size, step = y + size * step, new, 1.0, None
        elif size < 1e-12:
            break
        else:
            size /= 2
    return [float(v) for v in y], [float(v) for v in first]


def mixed_shares(rated: DataFrame, mix: Mix = Mix()) -> dict[str, float]:
    """Each domain's expected share of the tokens at the rates that ``mix_rates`` gave; to be held against the targets."""
    w = F.col("mix_tokens") * F.col("mix_rate")
    got = rated.agg(*[F.sum(w * F.get("mix_share", F.lit(i))) for i in range(len(mix.names))]).first()
    whole = sum(v or 0.0 for v in got)
    return {name: (v or 0.0) / whole if whole else 0.0 for name, v in zip(mix.names, got, strict=True)}


def posteriors(docs: DataFrame, model: Posterior, text: str = "text", work: Scratch | None = None) -> DataFrame:
    """(t1, t2, tokens, copies, p) of every different text, t1 and t2 being 128 bits of it; null counts as empty."""
    work = work or Scratch(docs.sparkSession, "posterior")
    x = F.col("x")
    src = docs.select(F.coalesce(F.col(text), F.lit("")).alias("x")).select(*_keys(x), words(x).alias("ws"), "x")
    # What a text has once is counted before the explode, not for every token.
    src = src.select("t1", "t2", F.size("ws").cast("long").alias("tokens"), F.array_append(tokens_of(x, F.col("ws")), F.lit(_EVERY)).alias("own"))
    rows = src.select("t1", "t2", "tokens", F.explode_outer("own").alias("token")).select("t1", "t2", "tokens", F.xxhash64("token").alias("token"))
    return _logs(rows, ["t1", "t2", "tokens"], [model], work).select("t1", "t2", "tokens", "copies", softmax(F.col("l0"), model.temperature).alias("p"))


def _keys(x: Column) -> tuple[Column, Column]:
    return F.xxhash64(x).alias("t1"), F.xxhash64(F.lit(7), x, F.lit(7)).alias("t2")


def _rated(docs: DataFrame, labelled: DataFrame, mix: Mix, doc_id: str, text: str, keep: bool, names: Sequence[str]) -> DataFrame:
    work = Scratch(docs.sparkSession, "mixing")
    model = fit_posterior(docs, labelled, mix, doc_id, text, work)
    scored = work.cut(posteriors(docs, model, text, work))
    few = scored.where("tokens > 0").select((F.col("tokens") * F.col("copies")).alias("tokens"), "p")
    n = F.sum("tokens")
    mean = F.array(*[F.sum(F.col("tokens") * F.get("p", F.lit(i))) / n for i in range(len(mix.names))])
    cells = work.cut(few.groupBy(cell_of(F.col("p")).alias("cell")).agg(n.alias("tokens"), mean.alias("p")))
    y, first = solve_rates(cells, mix)
    y, _ = solve_rates(few, mix, y, first)
    work.drop(cells)
    said = scored.select(F.col("t1").alias("_mix_1"), F.col("t2").alias("_mix_2"), F.col("tokens").alias(names[0]), F.col("p").alias(names[1]), _rate(F.col("p"), y).alias(names[2]))
    said = F.broadcast(said) if 80 * scored.count() <= BROADCAST_BYTES else said
    one, two = _keys(F.coalesce(F.col(text), F.lit("")))
    own = docs.withColumn("_mix_1", one).withColumn("_mix_2", two).drop(*[text] * (not keep))
    out = own.join(said, ["_mix_1", "_mix_2"]).drop("_mix_1", "_mix_2")
    u = F.pmod(F.xxhash64(F.lit("mix"), F.col(doc_id)), F.lit(1 << 20)) / float(1 << 20)
    return out.withColumn(names[3], F.floor(F.col(names[2]) + u).cast("long"))


def mix_rates(docs: DataFrame, labelled: DataFrame, mix: Mix = Mix(), doc_id: str = "doc_id", text: str = "text", keep: bool = True) -> DataFrame:
    """``docs`` with ``mix_tokens``, ``mix_share`` (posteriors), ``mix_rate`` and ``mix_copies``; the text column only if ``keep``."""
    refuse_clash(docs, ADDED)
    return _rated(docs, labelled, mix, doc_id, text, keep, ADDED)


def mix_documents(docs: DataFrame, labelled: DataFrame, mix: Mix = Mix(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document as many times as its rate says, with its own columns only."""
    names = [f"_{x}" for x in ADDED]
    out = _rated(docs, labelled, mix, doc_id, text, True, names).where(F.col(names[3]) > 0)
    return out.withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(0), F.col(names[3]).cast("int")))).select(*columns_of(docs))
