"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule reads one counted feature of a text. On a bounded sample, picked by the texts' hashes, the characters, words and
lines that each feature touches are counted (its cost, in passes over them: ``PASSES``), and which rules reject which
documents. The rules then run in the order of rejections per cost: the next one is the rule with the most rejections among
the sample's documents that are left, for the features that no earlier rule has computed. A feature is computed only for
documents that all earlier rules let through. The order is the same in every run on the same table; it changes the cost,
never the verdict, which is "no rule rejects". :func:`quality_report` counts the base features of every row, as its
callers ask, so there the cascade saves only the other rules; :func:`quality_rules` saves all that follow a rejection.

Defined cases: a null text counts as an empty one, which fails the first base rule (fewer than ten words); a repeated
row gets its own verdict; texts of any length are whole; other columns pass through untouched, and an output name that is
among them is refused (``prefix`` changes the names of all outputs); an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .scratch import columns_of, refuse_clash
from .text import BLANKS, lines, words

WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """``feature`` adds the named columns to a frame for the rows where the given condition holds; ``fails`` reads them."""

    name: str
    features: tuple[str, ...]
    fails: Callable[[dict[str, Column]], Column]


#: Rules of every run: too few words, and too many words in windows that recur.
BASE = (
    Rule("few_words", ("n_words",), lambda c: c["n_words"] < 10),
    Rule("repeated_windows", ("n_words", "n_repeat_words"), lambda c: 100 * c["n_repeat_words"] > 20 * c["n_words"]),
)
#: The method's own rules; each is lenient enough that prose in any of the languages passes.
DEFAULT = (
    Rule("symbols", ("n_words", "n_symbols"), lambda c: 100 * c["n_symbols"] > 15 * c["n_words"]),
    Rule("word_length", ("n_words", "word_chars"), lambda c: (c["word_chars"] < 2 * c["n_words"]) | (c["word_chars"] > 15 * c["n_words"])),
    Rule("duplicate_lines", ("n_lines", "n_dup_lines"), lambda c: (100 * c["n_dup_lines"] > 30 * c["n_lines"]) & (c["n_lines"] > 3)),
    Rule("shouting", ("n_words", "n_marks"), lambda c: 2 * c["n_marks"] > c["n_words"]),
)


#: What each feature costs: passes over a text's characters, its words and its lines, and the feature that it starts from.
PASSES = {
    "words": (7, 1, 0, None), "lines": (2, 0, 1, None), "n_words": (0, 0, 0, "words"), "n_lines": (0, 0, 0, "lines"),
    "word_chars": (6, 0, 0, None), "n_symbols": (8, 0, 0, None), "n_marks": (1, 0, 0, None), "n_dup_lines": (1, 0, 4, "lines"), "n_repeat_words": (10, 40, 0, "words"),
}
#: Features and other columns while they are computed.
_OWN = "_quality_"


class _Features:
    """Adds features to a frame, each once, guarded by a condition on the rows that still need it."""

    def __init__(self, df: DataFrame, text: str):
        self.df, self.text, self.p, self.have = df, text, _OWN, set()

    def col(self, name: str) -> Column:
        return F.col(self.p + name)

    def add(self, name: str, needed: Column) -> None:
        if name in self.have:
            return
        self.have.add(name)
        text = F.coalesce(F.col(self.text), F.lit(""))
        put = lambda k, x: self.df.withColumn(self.p + k, F.when(needed, x))
        if name == "words":
            self.df = put(name, words(text))
        elif name == "lines":
            self.df = put(name, lines(text))
        elif name == "n_words":
            self.add("words", needed)
            self.df = put(name, F.size(self.col("words")).cast("long"))
        elif name == "word_chars":
            kept = text
            for c in BLANKS:
                kept = F.replace(kept, F.lit(c), F.lit(""))
            self.df = put(name, F.length(kept).cast("long"))
        elif name in ("n_symbols", "n_marks"):
            left = text
            for c in {"n_symbols": "#*$%&|<>", "n_marks": "!"}[name]:
                left = F.replace(left, F.lit(c), F.lit(""))
            self.df = put(name, (F.length(text) - F.length(left)).cast("long"))
        elif name == "n_lines":
            self.add("lines", needed)
            self.df = put(name, F.size(self.col("lines")).cast("long"))
        elif name == "n_dup_lines":
            self.add("lines", needed)
            self.df = put(name, (F.size(self.col("lines")) - F.size(F.array_distinct(self.col("lines")))).cast("long"))
        elif name == "n_repeat_words":
            self.add("words", needed)
            self._repeats(needed)
        else:
            raise ValueError(f"no feature {name}")

    def _repeats(self, needed: Column) -> None:
        """Words inside windows that occur twice or more in the text.

        Equal windows have equal hashes, so a text whose window hashes are all distinct is done. Only the others sort
        (hash, window, position), which brings equal windows together, compared in full; their positions, in order,
        each cover what lies before the next, five words at most.
        """
        w, p = self.col("words"), self.p
        n = F.size(w)
        starts = F.when(n >= WINDOW, F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        d = self.df.withColumn(p + "_h", F.when(needed, F.transform(starts, lambda i: F.xxhash64(F.slice(w, i + 1, WINDOW)))))
        h = F.col(p + "_h")
        d = d.withColumn(p + "_some", F.size(F.array_distinct(h)) < F.size(h))
        rows = F.transform(h, lambda x, i: F.struct(x.alias("h"), F.slice(w, i + 1, WINDOW).alias("w"), i.alias("i")))
        d = d.withColumn(p + "_s", F.when(F.col(p + "_some"), F.sort_array(rows)))
        s = F.col(p + "_s")
        same = lambda e, j: F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False)) & F.coalesce(F.get(s, j)["w"] == e["w"], F.lit(False))
        d = d.withColumn(p + "_p", F.sort_array(F.transform(F.filter(s, lambda e, i: same(e, i - 1) | same(e, i + 1)), lambda e: e["i"])))
        at = F.col(p + "_p")
        covered = F.aggregate(F.transform(at, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b)
        d = d.withColumn(p + "n_repeat_words", F.when(needed, F.coalesce(covered, F.lit(0)).cast("long")))
        self.df = d.drop(p + "_h", p + "_some", p + "_s", p + "_p")


def cascade(docs: DataFrame, rules: Sequence[Rule], text: str = "text", prefix: str = "", always: Sequence[str] = ()) -> DataFrame:
    """Adds the features, ``rejected_by`` and ``kept``; rules run in the given order, and features after a rejection stay null.

    ``always`` names features that every row gets, whatever the verdict.
    """
    f = _Features(docs, text)
    for name in always:
        f.add(name, F.lit(True))
    f.df = f.df.withColumn(_OWN + "rejected_by", F.lit(None).cast("string"))
    by = F.col(_OWN + "rejected_by")
    for r in rules:
        for name in r.features:
            f.add(name, by.isNull())
        fails = r.fails({x: f.col(x) for x in r.features})
        f.df = f.df.withColumn(_OWN + "rejected_by", F.when(by.isNotNull(), by).when(fails, F.lit(r.name)))
    added = [*sorted(f.have - {"words", "lines"}), "rejected_by", "kept"]
    refuse_clash(docs, [*[prefix + x for x in added], *[_OWN + x for x in (*added, "words", "lines")]])
    # A one-element explode: a filter on the verdict stays above it, where it reads one column. Below, the optimizer
    # would put the whole chain of features into the filter's condition, each as often as it is named.
    done = f.df.withColumn(_OWN + "kept", F.explode(F.array(by.isNull())))
    return done.select(*columns_of(docs), *[F.col(_OWN + x).alias(prefix + x) for x in added])


def plan_order(docs: DataFrame, rules: Sequence[Rule], text: str = "text", sample_rows: int = 400, computed: Sequence[str] = ()) -> list[Rule]:
    """The rules by rejections per cost on ``sample_rows`` rows at most; ``computed`` names features that cost nothing.

    The sample is only counted: it decides the order, and with it the cost, and no verdict.
    """
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    every = sorted({x for r in rules for x in r.features})

    def counted(sample: DataFrame) -> list:
        """A few numbers for each row; the limit on top reads no more partitions than it needs."""
        judged = cascade(sample, [], always=[*every, "n_words", "n_lines"])
        bits = sum((F.when(r.fails({x: F.col(x) for x in r.features}), 1 << i).otherwise(0) for i, r in enumerate(rules)), F.lit(0))
        return judged.select(bits.alias("bits"), F.length("text").alias("c"), F.col("n_words").alias("w"), F.col("n_lines").alias("l")).limit(sample_rows).collect()

    got = counted(rows.where(F.pmod(F.xxhash64("text"), F.lit(16)) == 0))
    if len(got) < sample_rows // 4:  # a small table
        got = counted(rows)
    left, out, open_ = Counter(r["bits"] for r in got), [], list(range(len(rules)))
    size = [sum(r[x] or 0 for r in got) for x in "cwl"]

    def needs(name: str) -> set[str]:
        start = PASSES[name][3]
        return {name} | (needs(start) if start else set())

    have = set().union(*map(needs, computed)) if computed else set()
    while open_:
        total = max(1, sum(left.values()))

        def worth(i: int, total: int = total) -> tuple[float, str]:
            fresh = set().union(*(needs(x) for x in rules[i].features)) - have
            cost = 1 + sum(p * n for x in fresh for p, n in zip(PASSES[x][:3], size, strict=True))
            return -sum(n for b, n in left.items() if b >> i & 1) / total / cost, rules[i].name

        best = min(open_, key=worth)
        open_.remove(best)
        out.append(rules[best])
        have |= set().union(*(needs(x) for x in rules[best].features))
        left = Counter({b: n for b, n in left.items() if not b >> best & 1})
    return out


def quality_rules(docs: DataFrame, rules: Sequence[Rule] = DEFAULT, text: str = "text") -> DataFrame:
    """The rows that base rules and ``rules`` all accept, with their own columns only."""
    order = plan_order(docs, [*BASE, *rules], text)
    mark = "_quality_out_"
    return cascade(docs, order, text, mark).where(F.col(mark + "kept")).select(*columns_of(docs))


def quality_report(docs: DataFrame, rules: Sequence[Rule] = DEFAULT, text: str = "text", prefix: str = "") -> DataFrame:
    """Every row with all base features, ``base_failed``, ``rejected_by`` and ``kept``."""
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    refuse_clash(docs, [prefix + "base_failed"])
    order = plan_order(docs, [*BASE, *rules], text, computed=base)
    out = cascade(docs, order, text, prefix, always=base)
    failed = F.lit(False)
    for r in BASE:
        failed = failed | r.fails({x: F.col(prefix + x) for x in r.features})
    return out.withColumn(prefix + "base_failed", failed)
