"""Secret scan: fixed patterns, and sliding-window Shannon entropy over candidate strings.

A candidate is a run of base64-like characters. Over it slides a window of fixed width; the counts of the
characters in the window, and the sum of c*log2(c) from which its entropy follows, are updated by the character
that enters and the one that leaves. Windows over hexadecimal text and over mixed text have thresholds of their
own, as the alphabets differ. Runs of hot windows become a span, unless an allow-list pattern fits the candidate.

Arrays grow by appending only within blocks of bounded size, as an array is copied whenever it grows: places of matches
are running sums over blocks of about the root of their number, windows are slid in blocks of BLOCK. So the work for a
candidate grows with its length, and that for many matches little faster than their number.

Spans count code points, end exclusive. Null text counts as empty: no spans, and the digest of no spans. Very
long texts and candidates are read whole. Spans that start together are in the order of their kinds. Repeated rows get a
row each, an empty table no rows; further columns are not read, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.llm import common

# The patterns of the three base kinds, in their order, and the least length of what counts.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = {"assign": (ASSIGN, 2, 6), "access": (ACCESS, 0, 20), "hex": (HEX, 0, 24)}

#: Candidates for the entropy scan.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Characters in a window.
WIDTH = 20
#: Bits a character, from which a window is hot, by the class of the candidate's characters.
HOT = {"hex": 3.0, "mixed": 3.6}
#: Candidates that are no secrets: all letters, all digits, a repeated character, words joined by marks, placeholders.
ALLOW = r"(?i)^(?:[a-z]+|[0-9]+|(.)\1+|[a-z][a-z_/=-]*[a-z]|.*(?:example|sample|placeholder|dummy|xxxx).*)$"
#: Windows that are slid in one go.
BLOCK = 128
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Counters of the characters in a window, of five bits each, in one long.
COUNTERS = 12


def _let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column) -> Column:
    """Running sums of an array of numbers."""
    nothing = F.array().cast("array<int>")

    def sums(part):
        def add(a, x):
            return _let(a["sum"] + x, lambda total: F.struct(total.alias("sum"), F.concat(a["out"], F.array(total)).alias("out")))

        return F.aggregate(part, F.struct(F.lit(0).alias("sum"), nothing.alias("out")), add, lambda a: a["out"])

    def in_blocks(v, width):
        inside = F.transform(F.sequence(F.lit(0), ((F.size(v) - 1) / width).cast("int")), lambda k: sums(F.slice(v, k * width + 1, width)))
        return _let(inside, lambda x: _let(sums(F.transform(x, lambda part: F.element_at(part, -1))), lambda before: F.flatten(
            F.transform(x, lambda part, k: _let(F.coalesce(F.get(before, k - 1), F.lit(0)), lambda more: F.transform(part, lambda n: n + more))))))

    return _let(values, lambda v: F.when(F.size(v) == 0, nothing).otherwise(_let(F.ceil(F.sqrt(F.size(v))).cast("int"), lambda width: in_blocks(v, width))))


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """Matches from left to right, as structs (start, end, value): what lies between them gives their places."""
    p = F.lit(pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))
    values = found if group == 0 else F.regexp_extract_all(text, p, F.lit(group))

    def placed(m, gaps, v):
        ends = running(F.transform(m, lambda x, i: F.length(F.get(gaps, i)) + F.length(x)))
        return _let(ends, lambda e: F.transform(m, lambda x, i: F.struct((F.get(e, i) - F.length(x)).alias("start"), F.get(e, i).alias("end"), F.get(v, i).alias("value"))))

    nothing = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return _let(found, lambda m: F.when(F.size(m) == 0, nothing).otherwise(
        _let(F.split(text, pattern), lambda gaps: _let(values, lambda v: placed(m, gaps, v)))))


def _xlog(n: Column) -> Column:
    """n*log2(n) from a table; counts reach WIDTH + 1 before the leaving character is taken off."""
    return F.get(F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(WIDTH + 2)]), n)


def window_entropies(candidate: Column) -> Column:
    """Shannon entropy, in bits a character, of every window, by incremental counts."""
    codes = F.transform(F.filter(F.split(candidate, ""), lambda c: c != ""), lambda c: F.instr(F.lit(SYMBOLS), c))
    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), len(SYMBOLS) // COUNTERS + 1).alias("n"), F.lit(0.0).cast("double").alias("s"), F.array().cast("array<double>").alias("out"))
    at, bits = (lambda c: (c / COUNTERS).cast("int")), (lambda c: (c % COUNTERS) * 5)
    count = lambda n, c: F.call_function("shiftright", F.get(n, at(c)), bits(c)).bitwiseAND(F.lit(31)).cast("int")
    one = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), bits(c))

    def move(a, x):
        enter, leave = x["enter"], x["leave"]
        more, less = count(a["n"], enter), count(a["n"], leave) + F.when(enter == leave, 1).otherwise(0)
        counts = F.transform(a["n"], lambda c, k: c + F.when(k == at(enter), one(enter)).otherwise(0) - F.when(k == at(leave), one(leave)).otherwise(0))
        change = _let(more, lambda m: _xlog(m + 1) - _xlog(m)) + F.when(leave.isNull(), 0.0).otherwise(_let(less, lambda m: _xlog(m - 1) - _xlog(m)))
        return _let(a["s"] + change, lambda t: F.struct(counts.alias("n"), t.alias("s"), F.when(
            x["full"], F.concat(a["out"], F.array(F.lit(math.log2(WIDTH)) - t / WIDTH))).otherwise(a["out"]).alias("out")))

    def slid(part):
        steps = F.transform(part, lambda c, i: F.struct(c.alias("enter"), F.get(part, i - WIDTH).alias("leave"), (i >= WIDTH - 1).alias("full")))
        return F.aggregate(steps, zero, move, lambda a: a["out"])

    def in_blocks(chars):
        starts = F.sequence(F.lit(0), ((F.size(chars) - WIDTH) / BLOCK).cast("int"))
        return F.flatten(F.transform(starts, lambda k: _let(F.slice(chars, k * BLOCK + 1, BLOCK + WIDTH - 1), slid)))

    return _let(codes, lambda chars: F.when(F.size(chars) < WIDTH, F.array().cast("array<double>")).otherwise(in_blocks(chars)))


def hot_spans(found: Column) -> Column:
    """Spans of a candidate (start, end, value) that hot windows cover; overlapping windows make one span."""
    limit = F.when(found["value"].rlike("^[0-9a-fA-F]+$"), F.lit(HOT["hex"])).otherwise(F.lit(HOT["mixed"]))

    def merged(hot):  # a span begins, or ends, at a window without a hot neighbour on that side
        first = F.filter(F.transform(hot, lambda i, k: F.when(F.coalesce(i - F.get(hot, k - 1) > WIDTH, F.lit(True)), i)), lambda i: i.isNotNull())
        last = F.filter(F.transform(hot, lambda i, k: F.when(F.coalesce(F.get(hot, k + 1) - i > WIDTH, F.lit(True)), i)), lambda i: i.isNotNull())
        return _let(last, lambda ends: F.transform(first, lambda i, k: F.struct((found["start"] + i).alias("start"), (found["start"] + F.get(ends, k) + WIDTH).alias("end"))))

    def hot(least):  # the class is told once for a candidate, not for each window
        return F.filter(F.transform(window_entropies(found["value"]), lambda e, i: F.when(e >= least, i)), lambda i: i.isNotNull())

    return _let(_let(limit - 1e-9, hot), merged)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans (text), found (the spans as structs)."""
    text = F.col("_t")

    def kind(name: str) -> Column:
        pattern, group, least = KINDS[name]
        strong = F.filter(located(text, pattern, group), lambda m: F.length(m["value"]) >= least)
        return F.transform(strong, lambda m: F.struct(m["start"].alias("start"), F.lit(list(KINDS).index(name)).alias("rank"), F.lit(name).alias("kind"), m["end"].alias("end")))

    candidates = F.filter(located(text, CANDIDATE), lambda m: ~m["value"].rlike(ALLOW))
    entropy = F.transform(F.flatten(F.transform(candidates, hot_spans)), lambda m: F.struct(m["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), F.lit("entropy").alias("kind"), m["end"].alias("end")))
    # A kind is looked for only where a cheaper test has found a trace of it.
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    traces = {"assign": "(?i)(?:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]", "access": "AKIA[A-Z0-9]{16}", "hex": "[0-9a-f]{24}"}
    base = docs.select(F.col(id_col).alias("doc_id"), common.whole_text(text_col).alias("_t"))
    found = base.select("doc_id", *[F.when(text.rlike(t), kind(k)).otherwise(none).alias(k) for k, t in traces.items()],
                        F.when(text.rlike(CANDIDATE), entropy).otherwise(none).alias("entropy"))

    def listed(*names: str) -> Column:
        return F.array_sort(F.concat(*[F.col(n) for n in names]))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", m["kind"], m["start"], m["end"])), ",")

    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in (*KINDS, "entropy")],
        F.sha2(joined(listed(*KINDS)), 256).alias("base_sha256"),
        joined(listed(*KINDS, "entropy")).alias("spans"),
        listed(*KINDS, "entropy").alias("found"),
    )
