"""Quality rules as a bitmask ledger: every rule is evaluated once per document, failures are stored as bits
beside the measurements, and policies (versioned sets of rules) and ablations work on the bits alone.

Null and empty texts have no words and fail `few_words`. Very long texts are measured whole. Repeated rows get a
row each; an empty table gives no rows; columns that clash with the measurements are not read, or passed on by keep().
Windows are compared by 64-bit hashes within one text: two different ones of a text would have to collide to count as
repeated, for which a text of a million words has a chance of 1 in 30 million. Lines are compared whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.llm import common

#: Words in a window whose repetition counts.
WINDOW = 8
#: Rules in the order of their bits: name -> true where the document fails.
RULES = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "many_symbols": "5 * n_symbols > n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
}
#: Versioned policies: the rules that reject.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "many_symbols", "duplicate_lines", "long_words"),
}


def mask(policy: str | tuple[str, ...]) -> int:
    """The bits of a policy."""
    names = list(RULES)
    return sum(1 << names.index(r) for r in (POLICIES[policy] if isinstance(policy, str) else policy))


def _let(value: Column, use) -> Column:
    """use(value) with value computed once: a lambda's variable is not inlined where it is used several times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_words(words: Column, n: Column, width: int = WINDOW) -> Column:
    """Words inside windows of `width` words that occur twice or more in the text, the first included."""
    def hashed(h, span):
        # Hashes of `span` words become hashes of twice as many, until a window is reached.
        if span == width:
            return F.filter(h, lambda x, i: i <= n - width)
        return _let(F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + span))), lambda twice: hashed(twice, 2 * span))

    def covered(h):
        # Positions sorted by hash: equal neighbours are repeated windows.
        order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        marks = _let(order, lambda o: F.filter(
            F.transform(o, lambda x, k: F.when(
                (F.coalesce(F.get(o, k - 1)["h"] == x["h"], F.lit(False))) | (F.coalesce(F.get(o, k + 1)["h"] == x["h"], F.lit(False))), x["i"])),
            lambda p: p.isNotNull()))
        none = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-width).alias("last"))
        return F.aggregate(F.array_sort(marks), none,
                           lambda a, p: F.struct((a["sum"] + F.least(F.lit(width), p - a["last"])).alias("sum"), p.alias("last")),
                           lambda a: a["sum"])

    if width & (width - 1):
        raise ValueError("the window must be a power of two")
    each = F.transform(words, lambda x: F.xxhash64(x))
    many = _let(_let(each, lambda h: hashed(h, 1)), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))
    return F.when(n >= width, many).otherwise(F.lit(0).cast("long"))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id (or a struct of the columns `keep` in its place) and the measurements of every whole text."""
    text = common.whole_text(text_col)
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: x.rlike(f"[^{common.SPACE_CLASS}]"))
    line_counts = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    repeats = _let(common.words(F.col("_t")), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeated_words(w, F.size(w)).alias("n_repeat_words")))
    columns = [F.col(id_col).alias("doc_id")] if keep is None else [F.struct(*[F.col(c) for c in keep]).alias("doc_id")]
    return docs.select(*columns, text.alias("_t")).select(
        "doc_id",
        repeats.alias("_r"),
        line_counts.alias("_l"),
        (F.length("_t") - F.length(F.regexp_replace("_t", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
    ).select("doc_id", "_r.n_words", "_r.word_chars", "n_symbols", "_l.n_lines", "_l.n_dup_lines", "_r.n_repeat_words")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Measurements and `failed`, a bit for each rule that the document fails."""
    bits = [F.when(F.expr(test), F.lit(1 << k)).otherwise(F.lit(0)) for k, test in enumerate(RULES.values())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measure(docs, id_col, text_col, keep).withColumn("failed", total.cast("long"))


def apply_policy(book: DataFrame, policy: str | tuple[str, ...] = "v1") -> DataFrame:
    """Adds base_failed and kept; no text is read again."""
    hit = lambda p: F.col("failed").bitwiseAND(F.lit(mask(p))) != 0
    return book.withColumns({"base_failed": hit("base"), "kept": ~hit(policy) & ~hit("base")})


def ablations(book: DataFrame, policy: str | tuple[str, ...] = "v1") -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that only it rejects, by one pass over the bits."""
    full = mask(policy)
    names = [r for r in RULES if mask((r,)) & full]
    hits = F.col("failed").bitwiseAND(F.lit(full))
    counts = [F.count_if(hits.bitwiseAND(F.lit(mask((r,)))) != 0).alias(f"{r}__fails") for r in names]
    alone = [F.count_if(hits == mask((r,))).alias(f"{r}__alone") for r in names]
    return book.agg(*counts, *alone).select(F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.col(f"{r}__fails").alias("fails"), F.col(f"{r}__alone").alias("only_by_it")) for r in names])).alias("x")).select("x.*")


def judge(docs: DataFrame, policy: str = "v1", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, measurements, failed, base_failed, kept: one row per document."""
    return apply_policy(ledger(docs, id_col, text_col), policy)


def keep(docs: DataFrame, policy: str = "v1", text_col: str = "text") -> DataFrame:
    """The documents that a policy keeps, with all their columns; no join, as the verdict is the row's own."""
    return apply_policy(ledger(docs, text_col=text_col, keep=docs.columns), policy).filter("kept").select("doc_id.*")
