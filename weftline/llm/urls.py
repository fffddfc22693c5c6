"""URL filters: host and path rules, and a ratio of character language models for what no rule decides.

Two variable-order Markov models, of accepted and of rejected URLs, give each character a probability
after the longest kept context before it, smoothed by what shorter contexts give (Witten-Bell). All
contexts are kept that stand ``least`` times, which their suffixes then do too. The model is stored as
one number for each context and character: by how much that context changes the log ratio against its
suffix; the log ratio of a URL is then a plain sum over all kept contexts at all its places. It is
broadcast up to ``SENT_ROWS`` and joined beyond. The mean over places is compared with a threshold, set on
labelled URLs that the models have not seen. DataFrame operations only.

Rows: a null URL counts as empty. A URL without ``://`` has empty host and path and meets no rule.
Without labelled URLs of both kinds the models say nothing and everything else is accepted. Repeated
rows are judged alike, a ratio at the threshold is accepted, long URLs are scored whole; an empty table
gives an empty table. Columns named like the results (``__host``, ``__path``, ``__rule``, ``__score``,
``__verdict``) are replaced; others pass through.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.staging import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of the models: others become ``*``; digits become ``0``; ``^`` begins a URL and ``$`` ends it.
ALPHABET = LOWER + "0./-_:?=&%#~+@,;!*$"
ORDER = 4
#: Rows of a model, some 30 bytes each, that are sent to every task.
SENT_ROWS = 1_500_000
RESULTS = ("__host", "__path", "__rule", "__score", "__verdict")


@dataclass(frozen=True)
class Rule:
    """``allow`` or ``block`` for a host with its subdomains and the paths that begin so; ``text`` is like ``example.org/es/``."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty where there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(rules: Sequence[Rule], host_: Column, path_: Column) -> Column:
    """The text of the longest rule that fits, else null."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.text))
    return reduce(lambda out, r: out.when(r.fits(host_, path_), F.lit(r.text)), ordered[1:], F.when(ordered[0].fits(host_, path_), F.lit(ordered[0].text))) if ordered else F.lit(None).cast("string")


def spelled(url: Column) -> Column:
    """A URL in the models' characters, with begin and end."""
    known = "".join("\\" + c if c in "-^]\\" else c for c in ALPHABET.replace("$", ""))
    text = F.regexp_replace(F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER), "[0-9]", "0")
    return F.concat(F.lit("^"), F.regexp_replace(text, f"(?s)[^{known}]", "*"), F.lit("$"))


def _places(rows: DataFrame, *kept: str) -> DataFrame:
    """``kept``, k and gram: for each place of ``__s`` after the begin, the character with the k characters before it, k from 0 to ORDER."""
    at = rows.select(*kept, "__s", F.explode(F.sequence(F.lit(2), F.length("__s"))).alias("__i"))
    each = at.select(*kept, "__s", "__i", F.explode(F.array(*map(F.lit, range(ORDER + 1)))).alias("k")).filter("k < __i")
    return each.select(*kept, "k", F.expr("substring(__s, __i - k, k + 1)").alias("gram"))


def ratio_model(rows: DataFrame, least: int = 8) -> DataFrame:
    """key (hash of context and character) and delta, staged. ``rows``: __s, __good. ``len(ALPHABET)`` rows for each context that stands ``least`` times."""
    grams = staged(_places(rows, "__good").groupBy("k", "gram").agg(F.count_if("__good").alias("good"), F.count_if(~F.col("__good")).alias("bad")), "grams")
    split = grams.select("k", F.expr("substring(gram, 1, k)").alias("context"), F.expr("substring(gram, k + 1, 1)").alias("char"), "good", "bad")
    totals = split.groupBy("k", "context").agg(*[f for c in ("good", "bad") for f in (F.sum(c).alias(f"n_{c}"), F.count_if(F.col(c) > 0).alias(f"kinds_{c}"))])
    # A suffix is at least as frequent as what it ends, so the kept set is closed.
    kept = staged(totals.filter((F.col("k") == 0) | (F.col("n_good") + F.col("n_bad") >= least)), "contexts")
    every = kept.select("*", F.explode(F.split(F.lit(ALPHABET), "")).alias("char")).filter("char != ''").join(split.select("k", "context", "char", "good", "bad"), ["k", "context", "char"], "left").na.fill(0, ["good", "bad"])
    every = staged(every, "table")
    smooth = lambda c, below: (F.col(c) + F.col(f"kinds_{c}") * below) / (F.col(f"n_{c}") + F.col(f"kinds_{c}"))
    own = lambda c, below: F.when(F.col(f"n_{c}") > 0, smooth(c, below)).otherwise(below)
    flat = F.lit(1.0 / len(ALPHABET))
    # The first order cannot be empty of a character: half a count is added to each.
    level = every.filter("k = 0").select("context", "char", *[((F.col(c) + 0.5) / (F.col(f"n_{c}") + 0.5 * len(ALPHABET))).alias(f"p_{c}") for c in ("good", "bad")])
    levels = [level.select("context", "char", "p_good", "p_bad", (F.ln("p_good") - F.ln("p_bad")).alias("delta"))]
    for k in range(1, ORDER + 1):
        below = levels[-1].select(F.col("context").alias("suffix"), "char", F.col("p_good").alias("b_good"), F.col("p_bad").alias("b_bad"))
        here = every.filter(F.col("k") == k).withColumn("suffix", F.expr("substring(context, 2)")).join(below, ["suffix", "char"])
        here = here.select("context", "char", *[own(c, F.coalesce(F.col(f"b_{c}"), flat)).alias(f"p_{c}") for c in ("good", "bad")], (F.ln("b_good") - F.ln("b_bad")).alias("below"))
        levels.append(staged(here.select("context", "char", "p_good", "p_bad", (F.ln("p_good") - F.ln("p_bad") - F.col("below")).alias("delta")), "level"))
    table = reduce(DataFrame.unionByName, levels).select(F.xxhash64(F.concat("context", "char")).alias("key"), "delta")
    return staged(table, "ratios")


def scores(rows: DataFrame, model: DataFrame, key: str) -> DataFrame:
    """``key`` and score, the mean log ratio over the places of ``__s``. The URLs stay in place until they are one row each."""
    places = _places(rows, key, "__n").select(key, "__n", F.xxhash64("gram").alias("key"))
    model = F.broadcast(model) if model.count() <= SENT_ROWS else model
    return places.join(model, "key").groupBy(key, "__n").agg((F.sum("delta") / F.col("__n")).alias("score"))


def threshold(scored: DataFrame, step: float = 0.01) -> float:
    """The mean log ratio that best parts __good from others: the least sum of both error rates, over a histogram of at most 4001 bins."""
    bins = scored.groupBy(F.greatest(F.lit(-2000), F.least(F.lit(2000), F.round(F.col("score") / step))).cast("int").alias("bin")).agg(F.count_if("__good").alias("good"), F.count_if(~F.col("__good")).alias("bad")).collect()
    good, bad = sum(r["good"] for r in bins), sum(r["bad"] for r in bins)
    if not good or not bad:
        return 0.0
    below_good = below_bad = 0
    best, at = 2.0, 0.0
    for r in sorted(bins, key=lambda r: r["bin"]):
        wrong = below_good / good + 1 - below_bad / bad
        if wrong < best - 1e-12:
            best, at = wrong, (r["bin"] - 0.5) * step
        below_good += r["good"]
        below_bad += r["bad"]
    return at


def judge(df: DataFrame, rules: Sequence[Rule], url_col: str = "url", least: int = 8) -> DataFrame:
    """``df`` with __host, __path, __rule, __score and __verdict (allow or block).

    URLs on which rules decide train the models, four fifths of them, and set the threshold, the rest.
    Distinct URLs are scored once; hot URLs are one row.
    """
    df = df.drop(*[c for c in RESULTS if c in df.columns and c != url_col])
    url = F.coalesce(F.col(url_col), F.lit(""))
    known = df.withColumns({"__host": host(url), "__path": path(url)}).withColumn("__rule", longest_rule(rules, F.col("__host"), F.col("__path")))
    says = F.create_map(*[x for r in rules for x in (F.lit(r.text), F.lit(r.verdict))]) if rules else F.create_map(F.lit(""), F.lit(""))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = known.select(url.alias("__url"), "__rule").distinct().repartition(tasks, "__url")
    distinct = staged(found.select("__url", spelled(F.col("__url")).alias("__s"), says[F.col("__rule")].eqNullSafe("allow").alias("__good"), F.col("__rule").isNotNull().alias("__known"), (F.pmod(F.xxhash64("__url"), F.lit(5)) == 0).alias("__apart")), "urls")
    # Few and short as URLs may be, their characters in all contexts are many: they are dealt to all tasks.
    distinct = distinct.repartition(tasks, "__url").withColumn("__n", (F.length("__s") - 1).cast("double"))
    model = ratio_model(distinct.filter("__known and not __apart").select("__s", "__good"), least)
    scored = staged(scores(distinct, model, "__url").join(distinct.select("__url", "__good", "__known", "__apart"), "__url", "right").select("__url", "__good", "__known", "__apart", F.coalesce("score", F.lit(0.0)).alias("score")), "scores")
    at = threshold(scored.filter("__known and __apart"))
    out = known.withColumn("__url", url).join(scored.select("__url", F.col("score").alias("__score")), "__url", "left")
    verdict = F.coalesce(says[F.col("__rule")], F.when(F.col("__score") >= at, F.lit("allow")).otherwise(F.lit("block")))
    return out.select(*[out[c] for c in df.columns], "__host", "__path", "__rule", "__score", verdict.alias("__verdict"))
