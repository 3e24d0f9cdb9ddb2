"""Quality rules by document and by host, in DataFrame expressions only.

Each text is measured once, inside its row. Rule failures are then summed by host, the
failure rates are shrunk towards a Beta prior fitted to all hosts by moments, and a host
whose shrunk rate is too high takes its documents with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import pick, written

BLANK = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def words_of(text: str) -> Column:
    """Runs of what isn't a blank."""
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), BLANK), lambda w: w != "")


def _repeated(words: str, n: str) -> Column:
    """Hashes of the three-word windows with their places, sorted; ties by place."""
    window = lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.cast("int").alias("at"))
    return F.when(F.col(n) >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), (F.col(n) - 3).cast("int")), window)))


def measured(docs: DataFrame) -> DataFrame:
    """docs: text and any columns beside it. Adds n_words, word_chars, n_symbols, n_dup_lines
    and n_repeat_words, and drops text."""
    blank = F.translate(F.coalesce("text", F.lit("")), BLANK_CHARS, "")
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(BLANK_CHARS)) != "")
    out = docs.withColumns({"_words": words_of("text"), "_lines": lines, "_full": blank})
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length("_full").cast("long"),
        "n_symbols": (F.length("_full") - F.length(F.translate("_full", SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
    })
    out = out.withColumn("_sorted", _repeated("_words", "n_words")).drop("text", "_lines", "_full", "_words")
    at = lambda i: F.get("_sorted", i)["h"]
    twice = F.filter("_sorted", lambda x, i: (x["h"] == F.coalesce(at(i - 1), F.bitwise_not(x["h"]))) | (x["h"] == F.coalesce(at(i + 1), F.bitwise_not(x["h"]))))
    out = out.withColumn("_places", F.sort_array(F.transform(twice, lambda x: x["at"]))).drop("_sorted")
    # words under windows that begin at sorted places: three each, less what the last one covers
    covered = F.aggregate("_places", F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")))
    return out.withColumn("n_repeat_words", F.coalesce(covered["n"], F.lit(0)).cast("long")).drop("_places")


def host_verdicts(counts: DataFrame, most: float = 0.5) -> DataFrame:
    """counts: host, n and failed, a row for each host. Returns host, host_rate (shrunk) and
    host_failed.

    The prior Beta(a, b) has the mean of the hosts' rates and their variance beyond what
    the binomial alone brings, at least a millionth and at most what any Beta has.
    """
    rate = F.col("failed") / F.col("n")
    prior = counts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"), F.avg(1 / F.col("n")).alias("inv"))
    m = F.col("m")
    spread = F.greatest(F.col("v") - m * (1 - m) * F.col("inv"), F.lit(1e-6))
    strength = F.greatest(m * (1 - m) / spread - 1, F.lit(1.0))
    prior = prior.select((m * strength).alias("a"), strength.alias("s"))
    shrunk = (F.col("failed") + F.col("a")) / (F.col("n") + F.col("s"))
    joined = counts.join(F.broadcast(prior))  # one row, whatever the input
    return joined.select("host", shrunk.alias("host_rate"), (shrunk > most).alias("host_failed"))


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", min_words: int = 50, max_repeat: int = 50, most: float = 0.5) -> DataFrame:
    """Measures every text and judges it by base rules and by its host.

    base_failed: fewer than ``min_words`` words, or more than ``max_repeat`` % of them in
    three-word windows that occur twice or more. kept: not base_failed, and of a host whose
    shrunk rate of base failures is at most ``most``. Returns doc_id, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host_rate.

    Null and empty texts have no words and fail. Rows without a host are one host of their
    own; ids play no part, so rows without one and repeated rows count like all others.
    Very long texts are measured whole, inside one row. An empty table gives an empty
    result. Other columns are ignored.
    """
    table = measured(pick(docs, doc_id=doc_id, host=host, text=text))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    table = written(table.withColumn("base_failed", failed), "measured")
    counts = table.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    counts = written(counts, "host-counts")
    verdicts = written(host_verdicts(counts, most), "host-verdicts").withColumnRenamed("host", "h")
    joined = table.join(verdicts, F.col("host").eqNullSafe(F.col("h")), "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"), "host_rate")
